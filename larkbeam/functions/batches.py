"""Python functions that Spark calls with batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# types as objects: a type in text needs a session when the module is imported
_WORDS = (
    T.StructType()
    .add("key", T.LongType())
    .add("position", T.IntegerType())
    .add("word", T.StringType())
)


@F.pandas_udf(T.DoubleType())
def compound(amount: pd.Series, rate: pd.Series, years: pd.Series) -> pd.Series:
    """An amount after some years of interest."""
    return amount * np.power(1 + rate, years)


@F.arrow_udf(T.StringType())
def title(text: pa.Array) -> pa.Array:
    """Each word with a capital first letter."""
    return pc.utf8_title(text)


@F.arrow_udtf(returnType=_WORDS)
class Words:
    """The words of each text in a table of keys and texts, with their positions."""

    def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
        words = pc.split_pattern(rows.column(1), " ")
        row = pc.list_parent_indices(words)
        _, first = np.unique(row, return_index=True)
        position = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        yield pa.table(
            {
                "key": pc.take(rows.column(0), row),
                "position": pa.array(position, pa.int32()),
                "word": pc.list_flatten(words),
            }
        )


def aggregate_batches(
    df: DataFrame,
    keys: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    merge: Mapping[str, Callable],
) -> DataFrame:
    """A Python aggregate that sees a batch at a time, never a whole group.

    ``partial`` reduces a batch to one row per key with the columns of
    ``schema``; Spark combines these with ``merge`` before and after the
    shuffle. A grouped Pandas function would load each group into one task.
    """

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield partial(batch)

    partials = df.mapInPandas(reduce, schema)
    return partials.groupBy(*keys).agg(*[f(name).alias(name) for name, f in merge.items()])
