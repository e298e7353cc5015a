"""Sessions, and the place a job may write to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(
    cpus: int | str = 8, app: str = "larkbeam", memory: str = "16g", checkpoint_dir: str | None = None
) -> SparkSession:
    """A session on this machine, for tests and the benchmark.

    On a cluster, pass the session that the cluster made; nothing in the
    package depends on the settings below.
    """
    partitions = os.cpu_count() if cpus == "*" else cpus
    builder = SparkSession.builder
    if checkpoint_dir:
        builder = builder.config(_CHECKPOINT_DIR, checkpoint_dir)
    return (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table or a stream's checkpoint.

    It lies in the folder that ``spark.checkpoint.dir`` names, which all
    executors share. Only a local session may do without that setting.
    """
    base = spark.conf.get(_CHECKPOINT_DIR, None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="larkbeam-")
    return f"{base.rstrip('/')}/larkbeam/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for as long as the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
