"""Frequent values of a group, found by a summary that merges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from larkbeam.operators.reduce import bloom, maybe_in
from larkbeam.sources.files import rewritten

#: Counters that a task holds before it hands out those of the groups it has seen.
HELD = 200_000


class Summary:
    """Counters for at most ``size`` values, of any number of rows.

    ``lost`` bounds by how much a value's counter, or its missing one, is short of its
    rows. It is at most the share ``1 / (size + 1)`` of ``rows``: whenever a counter too many
    makes it rise, ``size + 1`` counters fall by as much. Counters, ``rows`` and ``lost`` of
    summaries of different rows may be added, and both hold for the sums.
    """

    def __init__(self, size: int):
        self.size, self.rows, self.lost = size, 0, 0
        self.counters: dict = {}

    def add(self, counts: dict) -> None:
        for value, n in counts.items():
            self.counters[value] = self.counters.get(value, 0) + n
            self.rows += n
        if len(self.counters) > self.size:
            fall = sorted(self.counters.values(), reverse=True)[self.size]
            self.counters = {v: n - fall for v, n in self.counters.items() if n > fall}
            self.lost += fall


def frequent(df: DataFrame, keys: Sequence[str], value: str, over: tuple[int, int]) -> DataFrame:
    """The values that more than ``a`` of ``b`` rows of a group have, for ``over`` of ``(a, b)``: ``keys``, ``value``, ``n``, ``n_rows``.

    Counts are exact. Counting every value of every group would shuffle them all. Here each
    task keeps a summary of each group, of twice as many counters as there can be such
    values, and their sums tell which values may be frequent: at most twice as many again.
    Only rows with these, and few others that pass a filter of bounded size, are then
    counted. Nulls are values and keys like others; values and keys must not be floating-point numbers. An empty table has no rows.
    """
    a, b = over
    size = -(-2 * b // a)
    fields = [df.schema[c] for c in [*keys, value]]
    schema = T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in ("_n", "_rows", "_lost"))])
    arrow = to_arrow_schema(schema)
    columns = [*keys, value]

    def given(summaries: dict[tuple, Summary]) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, own in summaries.items():
            rows += [(*key, v, n, 0, 0) for v, n in own.counters.items()]
            rows.append((*key, None, 0, own.rows, own.lost))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries: dict[tuple, Summary] = {}
        for batch in batches:
            counted = pa.Table.from_batches([batch]).group_by(columns).aggregate([([], "count_all")])
            by_key: dict[tuple, dict] = {}
            for *key, own, n in zip(*[counted.column(c).to_pylist() for c in [*columns, "count_all"]]):
                by_key.setdefault(tuple(key), {})[own] = n
            for key, counts in by_key.items():
                summaries.setdefault(key, Summary(size)).add(counts)
            if sum(len(s.counters) for s in summaries.values()) > HELD:
                yield from given(summaries)
                summaries = {}
        yield from given(summaries)

    parts = rewritten(df.select(*columns).mapInArrow(run, schema), name="summaries")
    named = [F.col(k).alias(f"_of_{k}") for k in keys]
    totals = parts.groupBy(*named).agg(F.sum("_rows").alias("n_rows"), F.sum("_lost").alias("_lost"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    counters = parts.groupBy(*columns).agg(F.sum("_n").alias("_n")).join(totals, same)
    able = counters.where((F.col("_n") + F.col("_lost")) * b > F.col("n_rows") * a)
    able = rewritten(able.select(*columns, "n_rows", F.xxhash64(*columns).alias("_hash")), name="able")
    passed = maybe_in(df.select(*columns, F.xxhash64(*columns).alias("_hash")), "_hash", bloom(able, "_hash"))
    counts = passed.groupBy(*columns).agg(F.count("*").alias("n"))
    # a false one that passed is no value of ``able``
    right = able.select(*[F.col(c).alias(f"_able_{c}") for c in columns], "n_rows")
    for c in columns:
        same = (F.col(c).eqNullSafe(F.col(f"_able_{c}"))) if c == columns[0] else same & F.col(c).eqNullSafe(F.col(f"_able_{c}"))
    return counts.join(right, same).where(F.col("n") * b > F.col("n_rows") * a).select(*columns, "n", "n_rows")
