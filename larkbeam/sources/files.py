"""Writing tables in the file formats Spark has, and reading them back."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkbeam.session import scratch_path, setting

_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_PADDED = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}

#: Options under which what is read equals what was written. In CSV and XML this is so for text only as
#: ``spelled`` writes it: plain, they have no nulls beside empty strings, and no line breaks or control characters.
OPTIONS = {
    "csv": {"header": "true", "escape": '"', "maxCharsPerColumn": "-1", **_PADDED, **_TIMES},
    "json": _TIMES,
    "xml": {"rowTag": "row", "ignoreSurroundingSpaces": "false", **_TIMES},
    "orc": {},
    "parquet": {},
}

#: Formats whose files are read whole by one task, and bytes of such a file, about.
_WHOLE_FILES = {"xml"}
_FILE_BYTES = 32 << 20

#: Folders that a task writes to side by side; only a task with more of them sorts what is left.
_OPEN_FOLDERS = 16

#: Formats that lose some text.
_SPELLED = {"csv", "xml"}
#: Characters that they cannot hold, and what they look like after a backslash.
_NAMED = {chr(c): f"u{c:04x}" for c in [*range(0x20), 0x7F, 0x85, 0x2028, 0x2029, 0xFFFE, 0xFFFF]}


def spelled(text: Column) -> Column:
    """Text of any kind as visible characters on one line; never null or empty, and without padding."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, name in _NAMED.items():
        out = F.replace(out, F.lit(char), F.lit(f"\\{name}"))
    # the bar keeps white space at the ends off the edge
    return F.coalesce(F.concat(F.lit("|"), out, F.lit("|")), F.lit("\\N"))


def unspelled(text: Column) -> Column:
    """What ``spelled`` was given."""
    hidden = F.lit(chr(0))  # stands for a backslash meanwhile: spelled text has no such character
    out = F.replace(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("\\\\"), hidden)
    for char, name in _NAMED.items():
        if char != chr(0):
            out = F.replace(out, F.lit(f"\\{name}"), F.lit(char))
    # now what is left of zeros in the text, and then the backslashes
    parts = F.split(out, r"\\u0000", -1)
    back = F.transform(parts, lambda part: F.replace(part, hidden, F.lit("\\")))
    return F.when(text != "\\N", F.array_join(back, chr(0)))


def _texts(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, T.StringType)]


def write(df: DataFrame, path: str, form: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``df``, with one folder per value of ``partition_by``.

    Rows of a folder are brought together so that it gets few files, while
    adaptive execution splits folders that are too large for one task.
    """
    options = OPTIONS[form]
    if form in _WHOLE_FILES:
        options = {**options, "maxRecordsPerFile": str(_rows_per_file(df))}
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    # else a task sorts all its rows by folder, in memory that rises with what it is dealt
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", str(_OPEN_FOLDERS)):
        df.write.partitionBy(*partition_by).format(form).options(**options).save(path)


def _rows_per_file(df: DataFrame) -> int:
    """Rows that make a file of some ``_FILE_BYTES``, by the mean length of their texts and names."""
    length = F.lit(0).cast("double")
    for name in _texts(df.schema):
        length = length + F.coalesce(F.octet_length(name), F.lit(0))
    text = df.agg(F.avg(length)).first()[0] or 0.0
    return max(1, int(_FILE_BYTES / (text + sum(2 * len(name) + 30 for name in df.columns))))


def read(spark: SparkSession, path: str, form: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).format(form).options(**OPTIONS[form]).load(path)


def rewritten(
    df: DataFrame, form: str = "parquet", partition_by: Sequence[str] = (), name: str = "table"
) -> DataFrame:
    """``df`` read back from a new table in the shared folder.

    The written table also cuts the lineage: a lost executor does not make
    Spark compute ``df`` again. Text columns keep nulls, empty strings, line breaks and padding in every format.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    texts = [c for c in _texts(df.schema) if c not in partition_by] if form in _SPELLED else []
    write(df.withColumns({c: spelled(F.col(c)) for c in texts}), path, form, partition_by)
    return read(spark, path, form, df.schema).withColumns({c: unspelled(F.col(c)) for c in texts})


def bucket_count(rows: int) -> int:
    """Buckets of some two million rows each."""
    return max(8, rows // 2_000_000)


def bucketed(df: DataFrame, key: str, buckets: int, name: str = "bucketed") -> DataFrame:
    """``df`` as a table bucketed and sorted by ``key``.

    Tables with equal bucket counts join and aggregate on the key without a
    shuffle. A bucket is read by one task, so the key should be unique or
    nearly so: aggregate or salt a table with hot keys first.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    (
        df.repartition(buckets, key)
        .write.bucketBy(buckets, key)
        .sortBy(key)
        .option("path", scratch_path(spark, name))
        .saveAsTable(table)
    )
    return spark.table(table)
