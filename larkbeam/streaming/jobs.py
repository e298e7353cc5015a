"""Reading tables as streams, and running a stream until its input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkbeam.functions.times import utc_instant
from larkbeam.session import scratch_path, setting
from larkbeam.sources.tables import SCHEMAS


def event_stream(
    spark: SparkSession, directory: str, files_per_batch: int | None = None, table: str = "events"
) -> DataFrame:
    """The event table as a stream, with ``ts`` as an instant for watermarks.

    Without ``files_per_batch`` a run reads all files there are in one
    micro-batch, so no row of a finite table is late, whatever the order of its
    files. With it, a micro-batch reads that many files.
    """
    # as a pattern, the path may name a file or a folder
    path = f"{directory}/{{{table}}}.parquet"
    reader = spark.readStream.schema(SCHEMAS["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path)
    return stream.withColumn("ts", utc_instant(F.col("ts")))


class LateRows(RuntimeError):
    """Rows came after the watermark and were left out."""


def drained(
    stream: DataFrame, name: str, path: str | None = None, late: str = "fail", partitions: int = 0
) -> DataFrame:
    """Run ``stream`` over all input there is, and return what it appended.

    The rows go to files in the shared folder, exactly once even if tasks are
    retried, and not through the driver. With the ``path`` of an earlier run,
    the stream goes on where that one ended. Rows that come after the watermark
    raise ``LateRows`` with their number, unless ``late`` is "drop". State is
    kept in ``partitions``, by default as many as there are cores; a stream
    keeps their number for good, so give one where executors come and go.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{path}/state")
        .option("path", f"{path}/rows")
        .trigger(availableNow=True)
    )
    # a stream keeps its number of state partitions for good: one for each core there is
    cores = spark.sparkContext.defaultParallelism
    with (
        setting(spark, "spark.sql.shuffle.partitions", str(partitions or cores)),
        setting(spark, "spark.sql.streaming.numRecentProgressUpdates", "1000000"),
    ):
        query = writer.start()
        query.awaitTermination()
    dropped = sum(
        state["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for state in progress["stateOperators"]
    )
    if dropped and late != "drop":
        raise LateRows(f"{dropped} rows came after the watermark")
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def left_open(spark: SparkSession, path: str) -> DataFrame:
    """What an aggregation that ran to ``path`` still holds: ``key`` and ``value`` of each group that is not over.

    A run ends with groups whose window the watermark has not passed, which it cannot
    append: further rows may come. Their state is read as a table, each in the partition that keeps it, and
    left as it is, so a later run goes on from there. ``value`` has the parts of the aggregates, such as
    ``count``, and ``sum``.
    """
    return spark.read.format("statestore").load(f"{path}/state").select("key", "value")
