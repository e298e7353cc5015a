"""Repeated strings against a search of all places, for several lengths."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.dataset as ds
import pytest

from larkbeam.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i] += 1
                gone[min(len(d), i + length)] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        left = bytes(b for b, g in zip(d, gone) if not g)
        spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def compare(spark, texts, length):
    df = spark.createDataFrame([(i, t, "x", 1, i) for i, t in enumerate(texts)], "doc_id int, text string, nid string, _k1 int, pos int")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed(df.repartition(3), length=length).collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_covers_have_every_difference():
    for q in (2, 3, 13):
        v, d = suffix_dedup.difference_cover(q)
        assert {(a - b) % v for a in d.tolist() for b in d.tolist()} == set(range(v)) and len(d) == q + 1


def test_ranges():
    rnd = random.Random(1)
    for _ in range(300):
        ranges = [sorted((rnd.randrange(30), rnd.randrange(30))) for _ in range(rnd.randint(0, 5))]
        gone = [sorted((rnd.randrange(30), rnd.randrange(30))) for _ in range(rnd.randint(0, 5))]
        a, b = (suffix_dedup.joined(*np.array(x, np.int64).reshape(-1, 2).T) for x in (ranges, gone))
        cells = lambda x: {i for lo, hi in x for i in range(lo, hi + 1)}
        assert suffix_dedup.places_in(*a).tolist() == sorted(cells(ranges))
        assert suffix_dedup.places_in(*suffix_dedup.without(*a, *b)).tolist() == sorted(cells(ranges) - cells(gone))


@pytest.mark.parametrize("length", [1, 5, 30, 400])
def test_made_up_texts(spark, length):
    rnd = random.Random(length)
    letters = "ab" if length == 5 else "abcdefgh é漢"
    word = lambda n: "".join(rnd.choices(letters, k=n))
    shared = [word(rnd.randint(length - 2, 4 * length + 3)) for _ in range(5)]
    texts = [None, "", word(3), "a" * (3 * length), "b" * length, "b" * (length + 1)]
    for _ in range(30):
        parts = [rnd.choice([word(rnd.randint(0, 2 * length)), rnd.choice(shared), rnd.choice(shared)[rnd.randrange(3) :]]) for _ in range(rnd.randint(0, 5))]
        texts.append("".join(parts))
    texts += [texts[-1], texts[-2], texts[-2], texts[-3][1:]]  # copies, and nearly one
    want = compare(spark, texts, length)
    assert any(n for _, n, _, _ in want)


def test_long_text_and_short_passage_at_its_end(spark, monkeypatch):
    rnd = random.Random(9)
    passage = "".join(rnd.choices("abcdef ", k=500))
    long = "".join(rnd.choices("abcdef ghij", k=1 << 18))
    monkeypatch.setattr(suffix_dedup, "_PLACE", 12)  # so that places of this text are folded
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 14)
    compare(spark, [long + passage, passage[:401] + "x", "y" + passage[50:460], passage[1:400]], 400)


def test_given_documents(spark, small):
    texts = ds.dataset(f"{small}/documents.parquet").to_table(columns=["text"])["text"].to_pylist()
    want = compare(spark, texts, 400)
    assert sum(n for _, n, _, _ in want) > 1000


def test_empty_table_and_odd_ids(spark):
    schema = "doc_id long, text string"
    assert suffix_dedup.removed(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "z" * 400), (1, "z" * 400), (1, "z" * 399), (2, None)], schema)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.removed(df).collect())
    assert got == [(0, 0, 0), (399, 0, 0), (400, 400, 1), (400, 400, 1)]
