"""The operators of this subpackage as named queries over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.llm import (
    bpe, edit_counts, fill_in_middle, filter_audit, html_text, minhash, mpeg_audio, packing, pseudonyms, quality,
    suffix_dedup, toxicity, vector_search,
)
from larkbeam.sources.tables import table

Plan = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan

    return add


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""

    def digests(enc: bpe.Encoder, ids) -> tuple[int, str, str]:
        written = hashlib.sha256(enc.decimals(ids)).hexdigest()
        return len(ids), written, hashlib.sha256(enc.decode_bytes(ids)).hexdigest()

    return bpe.encode_texts(
        table(spark, directory, "documents"), ["doc_id"], "text", word_bpe(),
        "n_tokens long, ids_sha256 string, decoded_sha256 string", digests,
    )


@query("op6_best_fit_packing")
def best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence of 2048 tokens."""
    return packing.pack(table(spark, directory, "documents"), ["doc_id"], "text", word_bpe(), 2048)


@query("op2_minhash_near_duplicates")
def minhash_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    """Components of documents that share 80 of 100 pairs of neighbouring words."""
    return minhash.near_duplicates(table(spark, directory, "documents"), width=2, percent=80)


@query("op3_ordinal_toxicity")
def ordinal_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """The expected grade of abuse of every document."""
    return toxicity.severity(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op9_quality_discriminant")
def quality_discriminant(spark: SparkSession, directory: str) -> DataFrame:
    """The quality of every document, learned from two thirds of the labels."""
    return quality.quality_scores(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op10_feistel_pseudonyms")
def feistel_pseudonyms(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymised(docs, count="replaced")


@query("op1_mpeg_audio")
def mpeg_audio_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Every document stored as MPEG audio and read back."""
    return mpeg_audio.round_trip(table(spark, directory, "documents"), ["doc_id"], "text")


@query("op4_html_main_text")
def html_main_text(spark: SparkSession, directory: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extracted(table(spark, directory, "pages"), ["page_id", "url"], "html")


@query("op7_edited_token_counts")
def edited_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    """Token counts of every document before and after eight edits.

    Each edit takes up to 40 characters out at a place that depends on the text,
    and puts a piece of up to 60 from elsewhere in the document there.
    """
    size = F.length("text")

    def edit(i: Column) -> Column:
        def place(salt: int) -> Column:
            return F.pmod(F.xxhash64("text", i, F.lit(salt)), size + 1).cast("int")

        taken = F.substr(F.col("text"), place(2) + 1, F.pmod(F.xxhash64("text", i), F.lit(61)).cast("int"))
        stop = place(1) + F.pmod(F.xxhash64("text", i, F.lit(3)), F.lit(41)).cast("int")
        return F.struct(place(1).alias("start"), stop.alias("stop"), taken.alias("new"))

    docs = table(spark, directory, "documents")
    edits = F.transform(F.sequence(F.lit(0), F.lit(7)), edit)
    return edit_counts.edited_counts(
        docs.select("doc_id", "text", edits.alias("edits")), ["doc_id"], "text", "edits",
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
    )


@query(
    "op8_vector_approximation_search",
    """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
    ), pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
    ), ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id, score
        FROM pairs
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
)
def vector_approximation_search(spark: SparkSession, directory: str) -> DataFrame:
    """The ten best of all vectors for every hundredth vector."""
    return vector_search.top_k(table(spark, directory, "embeddings"), "vec_id % 100 = 0", k=10)


@query(
    "op11_filter_interaction_audit",
    """
    WITH docs AS (
        SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS text,
               coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic,
               regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+') AS words
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    ), failed AS (
        SELECT part, good, toxic,
               [CAST(len(words) < 50 AS INTEGER),
                CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER),
                CAST(100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) AS INTEGER),
                CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER),
                CAST(doc_id > min(doc_id) OVER (PARTITION BY text) AS INTEGER)] AS f
        FROM docs
    ), masks AS (
        SELECT part, f, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (good) AS BIGINT) AS good,
               CAST(count(*) FILTER (toxic) AS BIGINT) AS toxic
        FROM failed GROUP BY part, f
    ), letters AS (
        SELECT unnest([1, 2, 3, 4, 5]) AS i
    ), orders AS (
        SELECT [a.i, b.i, c.i, d.i, e.i] AS o
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
    ), firsts AS (
        SELECT o, part, f, n, good, toxic,
               coalesce(list_position(list_transform(o, lambda x: f[x]), 1), 6) AS hit
        FROM orders, masks
    ), steps AS (
        SELECT o, part, i AS step,
               sum(CASE WHEN hit > i THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN hit = i THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN hit < i AND f[o[i]] = 1 THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN f[o[i]] = 1 AND list_sum(f) = 1 THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN hit = i THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN hit = i THEN toxic ELSE 0 END) AS toxic_lost
        FROM firsts, letters GROUP BY o, part, i
    )
    SELECT part, list_aggregate(list_transform(o, lambda x: substr('ABCDE', x, 1)), 'string_agg', '') AS filter_order,
           CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, o[step]) AS BIGINT) AS shapley
    FROM steps
    """,
)
def filter_interaction_audit(spark: SparkSession, directory: str) -> DataFrame:
    """What five filters remove at each step of each of their 120 orders, for every source."""
    counts = filter_audit.failure_counts(table(spark, directory, "documents"), table(spark, directory, "labels"))
    return filter_audit.audit(counts, "ABCDE", ["good", "toxic"])


@query(
    "op12_fill_in_middle",
    """
    WITH units AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
               list_transform([1, 9, 17, 25], lambda i: list_reduce(
                   list_transform(string_split(substr(sha256('1:' || CAST(doc_id AS VARCHAR)), i, 8), ''),
                                  lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT)),
                   lambda a, b: 16 * a + b)) AS h
        FROM documents
    ), cuts AS (
        SELECT *, CAST(len(u) AS BIGINT) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a,
               greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b
        FROM units
    ), parts AS (
        SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
               array_to_string(u[b + 1:], '') AS suffix,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                         OR h[3] % 100 >= 90 THEN 'plain'
                    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM cuts
    )
    SELECT doc_id, n, form,
           CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text
                            WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
    """,
)
def fill_in_middle_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with its middle at the end, as a digest, and as it comes back from that."""
    made = fill_in_middle.fill_in_middle(table(spark, directory, "documents"), ["doc_id"])
    kept = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    digested = made.select(*kept, F.sha2("output", 256).alias("output_sha256"), "output")
    back = fill_in_middle.restored(digested, [*kept, "output_sha256"])
    return back.select(*kept, "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


@query("op13_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """What is left of every document without strings of 400 bytes that occur elsewhere too."""
    return suffix_dedup.removed(table(spark, directory, "documents"))
