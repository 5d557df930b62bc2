"""Plan shape checks: native expressions only, bounded exchanges, filters pushed to the scan."""

import re

from pyspark.sql import functions as F

from conftest import SF001
from kestrel.plans import load_all
from kestrel.operators import feedback as FB
from kestrel.sources.tables import action_log


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_or_cross_joins_in_batch_plans(spark):
    reg = load_all()
    for name, spec in reg.items():
        if name in ("m7_train_score", "m15_tournament"):  # Spark ML fits: eager by nature
            continue
        plan = _plan(spec.build(spark, SF001))
        assert "PythonUDF" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan, name
        # No cross joins anywhere: neither cartesian products nor nested-loop joins.
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def _final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Final Plan"): plan.index("Initial Plan")]


def test_history_exchanges_and_reads(spark):
    """Totals, their window, rows by user, rows by channel; two reads.  H9: rows, bucket totals, their way back."""
    for name, exchanges, reads in (("e1_feature_build", 4, 2), ("h1_user_7d", 3, 2), ("h9_strike_history", 4, 2)):
        plan = _final_plan(load_all()[name].build(spark, SF001))
        shuffles = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]
        assert len(shuffles) <= exchanges, name
        assert len(re.findall(r"FileScan|Scan parquet", plan)) <= reads, name


def test_lookback_filter_pushed_down(spark):
    df = FB.lookback(action_log(spark, SF001), "2024-01-31 00:00:00", 7)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(ts", plan), plan


def test_views_prune_columns(spark):
    df = load_all()["h7_gap_hours"].build(spark, SF001)
    plan = _plan(df)
    scan = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "props" not in scan and "value" not in scan
