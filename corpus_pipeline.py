"""From raw documents to packed sequences, in stages that are each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept. All but the last return the columns of ``docs``, whatever other
columns those have. Null and empty texts, repeated rows and an empty table go
through every stage as the stage's operator states.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.llm import minhash, packing, pseudonyms, quality, toxicity
from larkbeam.operators.reduce import reduced_anti_join
from larkbeam.sources.files import rewritten
from larkbeam.sources.tables import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five words a shingle, similarity 0.8 or more.

    Rows are told apart by a number of their own, so ids may be null or repeat.
    """
    number = "_row_number"
    while number in docs.columns:
        number += "_"
    numbered = rewritten(docs.withColumn(number, F.monotonically_increasing_id()), name="numbered")
    found = minhash.near_duplicates(numbered, doc_id=number, width=5, percent=80)
    gone = rewritten(found.where("NOT kept").select("doc_id"), name="near")
    return reduced_anti_join(numbered, gone, number, "doc_id").select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return pseudonyms.pseudonymised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence of 2048 tokens."""
    return packing.pack(docs, ["doc_id"], "text", public_tokenizers.path("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", without_near_copies),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Models and tokens are out of reach of SQL; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = rewritten(stage(spark, docs, sf_dir), name=name)
    return STAGES[-1][1](spark, docs, sf_dir)
