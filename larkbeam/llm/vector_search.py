"""Exact top-k search by inner product with a vector-approximation file.

Every component is cut to a cell of one byte. Cells alone bound the score of a
pair from both sides, with room for rounding, which rules nearly all pairs out. Only the vectors left
are read exactly, those with the highest upper bounds first, until no bound of
the others reaches the k-th score found.

Queries and vectors meet in blocks, so neither side is sent out whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema as _arrow

from larkbeam.llm.batches import small_batches
from larkbeam.sources.files import rewritten

SCALE = 1024
CELLS = 256

#: Vectors whose largest components differ by more bits than this have cells of their own.
CLASS_BITS = 8

QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
_AT_ONCE = 64
_EPS = float(np.finfo(np.float64).eps)
_LONG = 1 << 63

#: Lowest value and width of cells of each component, by length and class of vector.
Marks = dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]


def scaled(vector: Column) -> Column:
    """``floor(1024 * x)`` of each component as doubles, or null if the vector takes no part."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))

    def whole(c: Column) -> Column:
        y = c * SCALE  # from 2 ** 52 on, doubles are whole
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)

    return F.when(finite, F.transform(x, whole))


def _class(v: Column) -> Column:
    bits = F.log2(F.array_max(F.transform(v, F.abs)))
    return F.coalesce(F.floor(F.least(bits, F.lit(2000.0)) / CLASS_BITS), F.lit(-1)).cast("int")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _marks(vectors: DataFrame) -> Marks:
    at = F.posexplode("v").alias("i", "x")
    ends = vectors.select("dim", "class", at).groupBy("dim", "class", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    marks: Marks = {}
    for (dim, size), own in ends.orderBy("dim", "class", "i").toPandas().groupby(["dim", "class"]):
        low, high = own["low"].to_numpy(), own["high"].to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):
            marks[int(dim), int(size)] = low, np.maximum(high / CELLS - low / CELLS, _EPS)
    return marks


def _mark(marks: Marks, dim: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return marks.get((dim, size), (np.zeros(dim), np.ones(dim)))


def cells_of(v: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        at = np.nan_to_num((v - low) / width, nan=0.0)
    return np.clip(at, 0, CELLS - 1).astype(np.uint8)


def _approximated(vectors: DataFrame, marks: Marks) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, sizes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cells = np.empty(batch.num_rows, object)
            for dim, size in {*zip(dims.tolist(), sizes.tolist())}:
                own = np.flatnonzero((dims == dim) & (sizes == size))
                found = cells_of(_matrix(batch.column(3).take(pa.array(own)), dim), *_mark(marks, dim, size))
                cells[own] = [row.tobytes() for row in found]
            made = pa.array(cells.tolist(), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], made], names=["rid", "dim", "class", "cells"])

    rows = small_batches(vectors).select("rid", "dim", "class", "v")
    return rows.mapInArrow(cut, "rid long, dim int, class int, cells binary")


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers not above and not below the score of each query with any vector of each row of cells.

    Sums are taken in doubles and widened by more than they can be off, as are the cells.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        most = abs(low) + CELLS * width
        middle = low + (cells + 0.5) * width
        size = abs(queries)
        reach = size @ (0.5 * width + 8 * _EPS * most) + 4 * (queries.shape[1] + 8) * _EPS * (size @ most)
        centre = queries @ middle.T
        least, greatest = centre - reach[:, None] * (1 + 8 * _EPS), centre + reach[:, None] * (1 + 8 * _EPS)
    return np.nan_to_num(least, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(greatest, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _meet(marks: Marks, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if vectors.num_rows and queries.num_rows:
            dim = vectors.column("dim")[0].as_py()
            low, width = _mark(marks, dim, vectors.column("class")[0].as_py())
            rid = vectors.column("rid").to_numpy()
            raw = b"".join(vectors.column("cells").to_pylist())
            cells = np.frombuffer(raw, np.uint8).reshape(len(rid), dim)
            asked, q = queries.column("qid").to_numpy(), _matrix(queries.column("v"), dim)
            for at in range(0, len(q), _AT_ONCE):
                least, most = bounds(q[at : at + _AT_ONCE], cells, low, width)
                for i, (a, b) in enumerate(zip(least, most)):
                    others = rid != asked[at + i]
                    a, b, r = a[others], b[others], rid[others]
                    bar = np.partition(a, -k)[-k] if len(a) > k else -np.inf
                    good = b >= bar
                    out.append((np.full(int(good.sum()), asked[at + i]), r[good], a[good], b[good]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [*[np.empty(0, np.int64)] * 2, *[np.empty(0)] * 2]
        return pa.table(dict(zip(("qid", "rid", "least", "most"), map(pa.array, columns))))

    return find


def score(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of whole numbers given as doubles, exactly."""
    if a.shape[0] * float(abs(a).max(initial=0)) * float(abs(b).max(initial=0)) < 2.0**62:
        return int(a.astype(np.int64) @ b.astype(np.int64))
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))


def _scored(pairs: DataFrame) -> DataFrame:
    """``over`` and ``score``, the exact score of ``_v`` and ``_q``; ``reach``, a double not above it.

    Where a long cannot hold the score, ``over`` is its sign.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in batch.columns[4:]:
                edges, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
                sides.append([flat[a:b] for a, b in zip(edges[:-1], edges[1:])])
            exact = [score(a, b) for a, b in zip(*sides)]
            over = [(x >= _LONG) - (x < -_LONG) for x in exact]
            fits = [0 if o else x for o, x in zip(over, exact)]
            reach = [2.0**63 if o > 0 else -np.inf if o else np.nextafter(float(x), -np.inf) for o, x in zip(over, fits)]
            made = [pa.array(over, pa.int32()), pa.array(fits, pa.int64()), pa.array(reach, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], schema=_arrow(schema))

    kept = pairs.select("qid", "query_id", "rid", "vec_id")
    schema = kept.schema.add("over", "integer").add("score", "long").add("reach", "double")
    return small_batches(pairs).select("qid", "query_id", "rid", "vec_id", "_v", "_q").mapInArrow(work, schema)


def top_k(
    df: DataFrame, is_query: str, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` best for every query.

    ``is_query`` is a condition in SQL on the id, which the result calls
    ``vec_id``. All rows but the query's own are candidates; rows that repeat an
    id are rows of their own. Scores are inner products of ``floor(1024 * x)``,
    and ties go to the smaller id, nulls first. Vectors that are null or hold a
    null or a number that is not finite take no part. Components may have any size: scores are exact,
    and a score among the best that a long cannot hold raises an error, as does a component
    that a double cannot hold 1024 times. A query
    meets vectors of its own length; an empty one scores 0. A query without
    others has no rows. Other columns are ignored. An empty table gives an empty one.
    """
    made = df.select(F.col(vec_id).alias("vec_id"), scaled(F.col(vector)).alias("v")).where("v IS NOT NULL")
    made = made.withColumns({"dim": F.size("v"), "class": _class(F.col("v")), "rid": F.monotonically_increasing_id()})
    rows = rewritten(made, name="vectors")
    queries = rows.where(is_query).select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), "dim", "v")
    # of equal vectors only the first can be among the best: k, and one if the query is among them
    first = Window.partitionBy("dim", "v").orderBy("vec_id", "rid")
    able = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    able = rewritten(able, name="able")
    marks = _marks(rows)
    cells = rewritten(_approximated(able, marks), name="cells")
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    vector_blocks = max(1, -(-cells.count() // VECTOR_BLOCK))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = cells.withColumn("vb", F.pmod(F.xxhash64("rid"), F.lit(vector_blocks))).withColumn("qb", every(query_blocks))
    right = queries.select("qid", "dim", "v", F.pmod(F.xxhash64("qid"), F.lit(query_blocks)).alias("qb"))
    # a query meets every class of its length; there are at most some 130 of them
    classes = cells.select(F.col("dim").alias("_dim"), F.col("class").alias("_class")).distinct()
    met_by = right.join(classes, F.col("dim") == F.col("_dim"))
    right = met_by.select("qid", "v", "qb", F.col("_dim").alias("dim"), F.col("_class").alias("class"), every(vector_blocks).alias("vb"))
    keys = ["dim", "class", "qb", "vb"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _meet(marks, k), "qid long, rid long, least double, most double"
    )
    met = rewritten(met, name="met")

    def best(column: str, *more: str) -> Window:
        return Window.partitionBy("qid").orderBy(F.desc(column), *more)

    # no vector whose upper bound is under the k-th lower bound can be among the best
    lows = met.withColumn("_n", F.row_number().over(best("least"))).where(F.col("_n") <= k)
    bars = lows.groupBy("qid").agg(F.when(F.count("*") == k, F.min("least")).alias("bar"))
    left_over = met.join(bars, "qid").where("bar IS NULL OR most >= bar").select("qid", "rid", "most")
    waves = left_over.withColumn("_n", F.row_number().over(best("most", "rid")))
    waves = rewritten(waves, name="waves")
    exact, asked = able.select("rid", "vec_id", F.col("v").alias("_v")), queries.select("qid", "query_id", F.col("v").alias("_q"))

    def read(some: DataFrame) -> DataFrame:
        return _scored(some.join(exact, "rid").join(asked, "qid"))

    near = rewritten(read(waves.where(F.col("_n") <= k)), name="near")
    reached = near.groupBy("qid").agg(F.when(F.count("*") == k, F.min("reach")).alias("reached"))
    rest = waves.where(F.col("_n") > k).join(reached, "qid").where("reached IS NULL OR most >= reached")
    scored = near.union(read(rest))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("over"), F.desc("score"), "vec_id", "rid"))
    best_of = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    fits = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit into a long")).cast("long"))
    return best_of.select("query_id", "rank", "vec_id", fits.alias("score"))
