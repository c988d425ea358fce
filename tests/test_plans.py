"""Plan regression tests: the scale properties the design relies on."""

import re
import tempfile

import pytest

from txnwatch.catalog import REGISTRY
from txnwatch.plans import dashboard as dash
from txnwatch.plans import monitoring as mon
from txnwatch.sources import store
from txnwatch.sources.fixtures import fixture_views
from txnwatch.sources.tables import read_table

from conftest import SF_SMALL

KEY_QUERIES = ["fraud_trend", "overview_kpis", "top_alerts", "monitoring_frame", "dashboard_filter",
               "velocity_1h", "rolling_ties", "roc_auc", "sequential_id", "stratified_sample"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", KEY_QUERIES)
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = plan_of(REGISTRY[name].fn(spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["velocity_1h", "avg_amount_24h", "rolling_ties"])
def test_rolling_windows_take_one_scan_and_one_exchange(spark, name):
    plan = plan_of(REGISTRY[name].fn(spark, SF_SMALL))
    assert plan.count("FileScan parquet") == 1
    assert len(re.findall(r"\bExchange ", plan)) == 1
    assert "Join" not in plan
    specs = re.findall(r"windowspecdefinition\(([^)]*)\)", plan)
    assert specs and all(spec.split(",")[1].strip().startswith("_bucket") for spec in specs)


def test_dashboard_date_filter_prunes_both_tables(spark):
    txn, pred = fixture_views(read_table(spark, SF_SMALL, "events"))
    root = tempfile.mkdtemp(prefix="plan-")
    store.write_monitoring_data(txn, pred, root)
    tx, pr = store.read_monitoring_tables(spark, root)
    f = dash.dashboard_filter(mon.monitoring_frame(tx, pr), "2024-01-03", "2024-01-05", None, None)
    plan = f._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) >= 2  # the two tables, plus a dynamic partition pruning subquery scan
    assert all("PartitionFilters: [" in s and "txn_date" in s.split("PartitionFilters: [")[1] for s in scans)


def jobs(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.mark.parametrize("name", ["fraud_trend", "overview_kpis", "top_alerts", "monitoring_frame", "date_bounds",
                                  "distinct_channels", "fk_orphans", "velocity_1h", "hybrid_score"])
def test_building_a_query_only_reads_file_footers(spark, name):
    tables = len([t for t in ("events", "orders") if t])  # at most a footer read a table
    before = jobs(spark)
    REGISTRY[name].fn(spark, SF_SMALL)
    assert jobs(spark) - before <= tables


@pytest.mark.parametrize("name", ["date_bounds", "distinct_channels", "distinct_categories", "fk_orphans"])
def test_unused_windows_are_pruned(spark, name):
    plan = plan_of(REGISTRY[name].fn(spark, SF_SMALL))
    if name == "fk_orphans":  # scores of the predictions need their own windows, the keys do not
        assert plan.count("FileScan parquet") >= 2
    else:
        assert "Window" not in plan
