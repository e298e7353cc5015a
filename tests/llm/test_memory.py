"""What stays in the memory of Python workers, and how many of them a task needs."""

import sys

from pyspark.sql import functions as F

from larkbeam.llm import minhash, quality
from larkbeam.llm.batches import filter_batches, map_batches, per_worker


def test_workers_keep_no_tables_that_the_next_operator_does_not_ask_for(spark):
    docs = spark.range(64).repartition(16).select(F.col("id").cast("string").alias("text"))
    kept = lambda: len(getattr(sys.modules.get("larkbeam_worker_store"), "kept", {}))

    def asks():
        per_worker(("large table",), lambda: bytearray(1000))
        return lambda texts: [(kept(),) for _ in texts]

    def does_not():
        return lambda texts: [(kept(),) for _ in texts]

    def found(work):
        return {r.n for r in map_batches(docs, [], "text", work, "n int").collect()}

    assert found(asks) == {1}
    assert found(does_not) == {0}
    assert found(asks) == {1}
    assert filter_batches(docs, "text", lambda: lambda texts: [kept() == 0 for _ in texts]).count() == 64


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow") + plan.count("FlatMapGroupsInArrow")


def test_texts_are_not_read_in_the_task_that_sums_their_statistics(spark, small, monkeypatch):
    taken, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda stats, labels: taken.append(stats) or train(stats, labels))
    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    assert quality.keep_good(docs, labels).count() > 0
    assert [python_nodes(x) for x in taken] == [0]


def test_links_are_found_once(spark, monkeypatch):
    taken, components = [], minhash.components
    monkeypatch.setattr(minhash, "components", lambda edges: taken.append(edges) or components(edges))
    docs = spark.createDataFrame([(i, f"one two three four five {i // 2}") for i in range(8)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, width=2).collect()}
    assert got == {i: i // 2 * 2 for i in range(8)}
    assert len(taken) == 2 and [python_nodes(x) for x in taken] == [0, 0]
