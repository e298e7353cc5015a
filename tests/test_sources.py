import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from larkbeam.session import scratch_path, setting
from larkbeam.sources import files
from larkbeam.sources.files import bucket_count, bucketed, read, rewritten, write
from larkbeam.sources.tables import register_views, table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("form", ["csv", "json", "xml", "orc", "parquet"])
def test_formats_keep_values(spark, form):
    rows = [
        (1, "plain", 0.1, dt.datetime(2024, 1, 2, 3, 4, 5, 678901), True),
        (2, 'quote " comma , line', -1e300, dt.datetime(1969, 12, 31, 23, 59, 59), False),
        (3, "é ü 漢字 😀", 1 / 3, None, None),
        (None, "<tag>&amp;", None, dt.datetime(2024, 1, 1), True),
    ]
    df = spark.createDataFrame(rows, "a bigint, b string, c double, d timestamp_ntz, e boolean")
    assert sorted(map(repr, rewritten(df, form).collect())) == sorted(map(repr, df.collect()))


@pytest.mark.parametrize("form", ["csv", "json", "xml", "orc", "parquet"])
def test_formats_keep_text(spark, form):
    texts = [
        None, "", " ", "  both  ", "line\nfeed", "a\r\nb\rc", "\ttab\t", 'q"uo""te', '"', "a,b", "\\", "\\\\", "\\n", "\\N", "N", "\\u000a", "\\\\u0000",
        "x\0y\0\0", "\\\0", "\0\\u0000", "|", "||", "<row>", "</b>]]>&lt;&#10;", "<!-- c -->", "\x01\x1f\x7f\x85\u2028\ufffe", "é漢😀", "NaN", "null", "#x", "x" * 100_000,
    ]
    df = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "i int, t string, last string")
    got = {r.i: (r.t, r.last) for r in rewritten(df.repartition(2), form).collect()}
    assert got == {i: (t, str(i)) for i, t in enumerate(texts)}


def test_partitioned_tables_are_pruned(spark, small):
    path = scratch_path(spark, "partitioned")
    lines = table(spark, small, "lineitem")
    write(lines, path, "parquet", ["l_returnflag", "l_linestatus"])
    stored = read(spark, path, "parquet", lines.schema)
    chosen = stored.where("l_returnflag = 'R' AND l_linestatus = 'F'").select("l_orderkey")
    assert "PartitionFilters: [isnotnull(l_returnflag" in plan_of(chosen)
    assert chosen.count() == lines.where("l_returnflag = 'R' AND l_linestatus = 'F'").count()
    assert stored.count() == lines.count()


def test_bucketed_tables_join_without_shuffle(spark, small):
    orders = bucketed(table(spark, small, "orders"), "o_orderkey", 8, "o")
    lines = table(spark, small, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    lines = bucketed(lines, "l_orderkey", 8, "l")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        assert "SortMergeJoin" in plan_of(joined)
        assert "Exchange" not in plan_of(joined)
        assert joined.count() == lines.count()


def test_bucket_count():
    assert bucket_count(10) == 8
    assert bucket_count(100_000_000) == 50
    assert bucket_count(10**12) == 500_000


def test_scratch_lies_in_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(base)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_views(spark, small):
    register_views(spark, small)
    assert spark.sql("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey").first()[0] == 25


def test_xml_is_cut_into_files_by_bytes(spark, monkeypatch):
    """A file of XML is read by one task, so one task's rows must not all go into one."""
    monkeypatch.setattr(files, "_FILE_BYTES", 100_000)
    rows = spark.range(3000).select("id", F.repeat(F.lit("é"), 200).alias("t")).coalesce(1)
    back = rewritten(rows, "xml")
    sizes = [os.path.getsize(f.removeprefix("file:")) for f in back.inputFiles()]
    assert len(sizes) > 10 and max(sizes) < 150_000
    assert back.exceptAll(rows).isEmpty() and back.count() == 3000
    assert rewritten(rows.limit(0), "xml").count() == 0


def test_folders_are_written_without_a_sort(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 40).alias("part"))
    path = scratch_path(spark, "unsorted")
    write(rows, path, "parquet", ["part"])
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = runs.apply(runs.size() - 1).physicalPlanDescription()
    assert "REBALANCE" in plan and "Sort" not in plan
    assert read(spark, path, "parquet", "id bigint, part bigint").exceptAll(rows).isEmpty()
