"""What Spark makes of the queries: pushdown, pruning, and no joins without keys."""

import pytest
from pyspark.sql import functions as F

from larkbeam.operators.skew import hot_groups
from larkbeam.operators.windows import running
from larkbeam.plans import all_queries
from larkbeam.session import setting
from larkbeam.sources.tables import table

BATCH = sorted(n for n in all_queries() if not n.startswith("stream_"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def details_of(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", BATCH)
def test_no_join_without_keys_and_no_row_at_a_time_python(spark, small, name):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = plan_of(all_queries()[name].plan(spark, small))
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = details_of(all_queries()["star_discount_forecast"].plan(spark, small))
    assert "GreaterThanOrEqual(l_shipdate,1997-01-01T00:00)" in plan
    assert "LessThan(l_quantity,24.0)" in plan
    assert "GreaterThanOrEqual(l_discount,0.045)" in plan
    assert "l_orderkey" not in plan


def test_top_per_group_is_cut_before_the_shuffle(spark, small):
    plan = plan_of(all_queries()["win_top_per_group"].plan(spark, small))
    before_shuffle = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before_shuffle


def test_lines_are_summed_before_the_join(spark, small):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = plan_of(all_queries()["star_revenue_by_region"].plan(spark, small))
    assert plan.count("hashpartitioning(l_orderkey") == 1


def test_windows_shuffle_the_rows_once_even_in_pieces(spark, small):
    events = table(spark, small, "events").select("event_id", "user_id", "ts", "value")
    columns = {"n": ("sum", F.lit(1).cast("bigint"))}
    plain = running(events, ["user_id"], ["ts", "event_id"], columns)
    assert plan_of(plain).count("Exchange hashpartitioning") == 1
    hot = hot_groups(events, ["user_id"], 12)
    cut = running(events, ["user_id"], ["ts", "event_id"], columns, hot)
    shuffles = [line for line in plan_of(cut).splitlines() if "Exchange hashpartitioning" in line]
    # the other groups, the hot rows, and twice the totals of segments, which are few
    assert len(shuffles) == 4
    assert sum("_seg" in line for line in shuffles) == 2
