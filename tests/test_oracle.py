"""The correctness gate: every registered query against its DuckDB SQL."""

import pytest

from txnwatch.catalog import REGISTRY

from conftest import SF_SMALL
from oracle_check import compare, duck

ORACLE = sorted(n for n, e in REGISTRY.items() if e.sql)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", ORACLE)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, SF_SMALL, name, con)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    import importlib.util
    import os

    path = os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("spark_entry", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(mod.oracle_sql()) <= set(mod.queries())


@pytest.mark.parametrize("name", ["fraud_trend", "scalar_functions", "live_stream_trend", "live_stream_rollups"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = compare(spark, SF_SMALL, name, con)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert r["status"] == "ok", r
