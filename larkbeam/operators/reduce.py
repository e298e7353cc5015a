"""Keeping rows that cannot match away from a shuffle, with a filter of bounded size.

A semi join shuffles all of its larger side, however few rows match. A Bloom
filter of the smaller side's keys leaves most of the others out first. Here the
filter is a table of words of 64 bits, at most ``WORDS`` of them whatever the
number of keys, so it may always be broadcast. More keys than it holds only let
more rows through, and the join that follows decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most 16 MB of words and their numbers.
WORDS = 1 << 20

#: Bits of its word that a key sets.
BITS = 4


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), key), F.lit(words)).cast("int")


def _mask(key: Column) -> Column:
    spread, one, mask = F.xxhash64(F.lit(2), key), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    for i in range(BITS):
        place = F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", one, place))
    return mask


def bloom(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """The filter of the non-null values of ``key``: ``_bloom_word`` and ``_bloom_bits``, at most ``words`` rows."""
    known = keys.where(F.col(key).isNotNull())
    return known.groupBy(_word(F.col(key), words).alias("_bloom_word")).agg(F.bit_or(_mask(F.col(key))).alias("_bloom_bits"))


def maybe_in(df: DataFrame, column: str, words_table: DataFrame, words: int = WORDS, negate: bool = False) -> DataFrame:
    """The rows whose ``column`` may be among the keys of the filter; none that is gets lost.

    With ``negate``, the others, null values included: none of them is among the keys.
    """
    key, side = F.col(column), F.broadcast(words_table)
    same = (_word(key, words) == F.col("_bloom_word")) & (F.col("_bloom_bits").bitwiseAND(_mask(key)) == _mask(key))
    return df.join(side, same & key.isNotNull(), "left_anti" if negate else "left_semi")


def reduced_semi_join(df: DataFrame, keys: DataFrame, column: str, key: str, words: int = WORDS) -> DataFrame:
    """The rows of ``df`` whose ``column`` is among the values of ``key`` in ``keys``.

    Only rows that pass the filter are shuffled. ``keys`` is read twice, so let
    it be a written table. Values must be of one type. Nulls match nothing, rows
    that repeat stay as often as they occur, and no column of ``keys`` is added.
    """
    found = keys.select(F.col(key).alias("_bloom_key")).where("_bloom_key IS NOT NULL").distinct()
    passed = maybe_in(df, column, bloom(keys, key, words), words)
    return passed.join(found.hint("merge"), F.col(column) == F.col("_bloom_key"), "left_semi")


def reduced_anti_join(df: DataFrame, keys: DataFrame, column: str, key: str, words: int = WORDS) -> DataFrame:
    """The other rows of ``df``, those with a null ``column`` included. Most are not shuffled if the keys are few."""
    found = keys.select(F.col(key).alias("_bloom_key")).where("_bloom_key IS NOT NULL").distinct()
    words_table = bloom(keys, key, words)
    passed = maybe_in(df, column, words_table, words)
    rest = passed.join(found.hint("merge"), F.col(column) == F.col("_bloom_key"), "left_anti")
    return maybe_in(df, column, words_table, words, negate=True).union(rest)
