"""The pipeline, stage by stage, on rows made to be awkward."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkbeam.llm import quality, toxicity


@pytest.fixture(scope="module")
def through(spark, small, tmp_path_factory):
    """What each stage left, each read from where it was written."""
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("_row", F.lit("x"))
    docs = docs.withColumn("n_shingles", F.lit(None).cast("int"))
    copy = docs.orderBy("doc_id").limit(3)
    docs = docs.union(copy)  # the same rows again
    left = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, small).write.parquet(path)
        docs = left[name] = spark.read.parquet(path)
    return left


def test_all_but_the_last_keep_the_columns(through):
    for name in ["quality", "toxicity", "near_duplicates", "personal_data"]:
        assert through[name].columns == through["documents"].columns


def test_stages_only_drop_rows(through):
    ids = [{r.doc_id for r in through[n].select("doc_id").collect()} for n in through]
    assert all(later <= earlier for earlier, later in zip(ids, ids[1:]))
    assert ids[-1] == ids[-2] == ids[-3]


def test_one_row_of_an_id_stays(through):
    assert through["near_duplicates"].groupBy("doc_id").count().where("count > 1").isEmpty()


def test_clean_documents_stay(spark, small, through):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    left = {r.doc_id for r in through["toxicity"].select("doc_id").collect()}
    clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()}
    assert len(clean & left) >= 0.95 * len(clean)


def test_empty_and_null_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [Row(None, None, None, None, None), Row(1, "", "en", "s", 0), Row(1, "", "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, small).collect()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_quality_stage_keeps_what_the_scores_say(spark, small, through):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(through["documents"], labels).collect() if r.predicted}
    assert rows_of(through["quality"]) == [r for r in rows_of(through["documents"]) if r[0] in good]


def test_toxicity_stage_keeps_what_the_grades_say(spark, small, through):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    clean = {r.doc_id for r in toxicity.severity(through["quality"], labels).collect() if not r.predicted}
    assert rows_of(through["toxicity"]) == [r for r in rows_of(through["quality"]) if r[0] in clean]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(texts):
    """For each text, the number of the first one that links lead to."""
    sets, first = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while first[i] != i:
            i = first[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((top(i), top(j)))
                first[y] = x
    return [top(i) for i in range(len(texts))]


def test_near_copy_stage_keeps_one_of_each_group(through):
    before = rows_of(through["toxicity"])
    left = Counter(rows_of(through["near_duplicates"]))
    groups = {}
    for row, group in zip(before, classes([r[1] for r in before])):
        groups.setdefault(group, []).append(row)
    assert sum(left.values()) == len(groups)
    for own in groups.values():
        assert sum(min(left[row], 1) for row in set(own)) == 1


def test_near_copy_stage_goes_by_rows(spark, small):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long), (1, "something else that has nothing to do with it"), (None, long), (None, long + " eleven"), (2, None), (2, ""), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row_number int")
    left = corpus_pipeline.without_near_copies(spark, docs, small)
    assert left.columns == docs.columns
    texts = sorted(r.text or "" for r in left.collect())
    assert texts[:3] == ["", "", ""] and len(texts) == 5 and rows[1][1] in texts


def test_personal_data_stage_changes_texts_only(through):
    key = lambda r: repr((r[0], r[2:]))
    before, after = (sorted(rows_of(through[n]), key=key) for n in ("near_duplicates", "personal_data"))
    assert [key(r) for r in before] == [key(r) for r in after]
    changed = [(a[1], b[1]) for a, b in zip(before, after) if a[1] != b[1]]
    assert changed and all(re.search(r"\d|@|[A-Za-z0-9]{8}", a) for a, _ in changed)


def test_packing_stage_holds_every_token_once(through):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, bins = Counter(), {}
    for row in through["personal_data"].collect():
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), 2048)):
            cut = np.array(ids[at : at + 2048], "<u4")
            want[row.doc_id, n, at, len(cut), zlib.crc32(cut.tobytes())] += 1
    got = through["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        upto = 0
        for offset, length in sorted(own):
            assert offset == upto
            upto += length
        assert upto <= 2048
    assert len(bins) <= 3 - (-sum(r.length for r in got) // 2048)
