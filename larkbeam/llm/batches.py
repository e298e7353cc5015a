"""Running Python over Arrow batches, and what a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that Spark hands to Python at a time, at most.
ROWS_PER_BATCH = 1000


def _store() -> dict[str, Any]:
    return sys.modules.setdefault("larkbeam_worker_store", types.ModuleType("store")).__dict__


def let_go() -> None:
    """Forget what the worker keeps, and give its memory back to the system."""
    kept = _store().setdefault("kept", {})
    if kept:
        kept.clear()
        gc.collect()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)  # else freed memory stays with the worker


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """``make()``, once in each Python worker, as long as nothing else is asked for.

    Functions of this package reach the workers by value, so globals of their
    modules last for one task. This store lasts as long as the worker, which may
    serve other operators later; then what it kept for the one before goes.
    """
    store = _store()
    kept = store.setdefault("kept", {})
    store["asked"] = True
    if key not in kept:
        let_go()
        kept[key] = make()
    return kept[key]


def started(work: Callable[[], Any]) -> Any:
    """``work()``, for which the worker keeps nothing unless that asks for it.

    Else the tables of an operator that ran before stay in memory beside every one that needs none.
    """
    store = _store()
    store["asked"] = False
    rows = work()
    if not store["asked"]:
        let_go()
    return rows


def slices_of(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of one fit into memory several times."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands at most 1,000 rows to Python at a time.

    By default it is 10,000, which for long texts is more memory than a worker
    has, both there and in the executor. A lower setting stays as it is.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= ROWS_PER_BATCH:
        conf.set(key, str(ROWS_PER_BATCH))
    return df


def map_batches(
    df: DataFrame,
    keep: Sequence[str],
    texts: str,
    work: Callable[[], Callable[[list], list[tuple]]],
    added: str,
) -> DataFrame:
    """Columns ``keep`` of ``df``, and the columns ``added`` that Python makes from ``texts``.

    ``work()`` is called once a task and gives a function from the values of a
    batch to a tuple for each. What it keeps by ``per_worker`` it asks for before it returns. Only the columns needed are read, and those of
    ``keep`` pass through as they are, nulls included.
    """
    schema = StructType([*df.select(*keep).schema.fields, *_parse(added).fields])
    arrow = to_arrow_schema(schema)
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = started(work)
        for batch in slices_of(batches):
            made = rows(batch.column(n).to_pylist())
            new = [
                pa.array(list(values), type=field.type)
                for values, field in zip(zip(*made), list(arrow)[n:])
            ] or [pa.array([], type=field.type) for field in list(arrow)[n:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], schema=arrow)

    return small_batches(df).select(*keep, F.col(texts).alias("_value")).mapInArrow(run, schema)


def _parse(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def filter_batches(
    df: DataFrame, texts: str, work: Callable[[], Callable[[list], Sequence[bool]]]
) -> DataFrame:
    """The rows of ``df`` whose text passes, with all columns as they are."""
    schema, at = df.schema, df.columns.index(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = started(work)
        for batch in slices_of(batches):
            yield batch.filter(pa.array(list(passes(batch.column(at).to_pylist())), pa.bool_()))

    return small_batches(df).mapInArrow(run, schema)


def held_out(doc_id: str) -> Column:
    """Whether a document is left out of learning: a third of them, by id."""
    third = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3
    return F.coalesce(third == 1, F.lit(False))
