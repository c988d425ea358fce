"""Benchmark: prints ONE JSON line with per-query seconds.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)

Two groups are timed:

* ``store_*``: the production shape. ``store_build`` derives the
  transactions and predictions tables from ``events`` (rolling windows, rule
  table, scoring) and writes them to a scratch store; the monitoring and
  dashboard queries then read the stored Parquet tables.
* ``e2e_*``: registered catalog queries, each from the raw tables.

``value`` is the sum over all timed queries. Each query is run to completion
with a ``count``-free full collect (results are small) or a write.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txnwatch.catalog import REGISTRY  # noqa: E402
from txnwatch.plans import dashboard as dash  # noqa: E402
from txnwatch.plans import monitoring as mon  # noqa: E402
from txnwatch.session import get_spark  # noqa: E402
from txnwatch.sources import store  # noqa: E402
from txnwatch.sources.fixtures import predictions_from_transactions, transactions_from_events  # noqa: E402
from txnwatch.sources.tables import read_table  # noqa: E402

E2E = [
    "fraud_trend",
    "overview_kpis",
    "top_alerts",
    "velocity_1h",
    "avg_amount_24h",
    "rolling_ties",
    "hybrid_score",
    "stratified_sample",
    "train_test_split_sizes",
    "roc_auc",
    "average_precision",
    "sequential_id",
    "iforest_score",
    "logistic_score",
    "live_stream_trend",
]


def _timed(fn):
    t0 = time.perf_counter()
    fn()
    return round(time.perf_counter() - t0, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    out_root = tempfile.mkdtemp(prefix="txnwatch-bench-")
    times: dict[str, float] = {}

    def build(src_dir: str, root: str):
        # enrichment job: transactions first, then score the stored rows
        txn = transactions_from_events(read_table(spark, src_dir, "events"))
        stage = f"{root}/stage_txn"
        txn.write.mode("overwrite").parquet(stage)
        staged = spark.read.parquet(stage)
        store.write_monitoring_data(staged, predictions_from_transactions(staged), root)

    # Warm-up on the smallest scale (JIT, class loading, Python workers) over
    # the same code paths; not timed.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        build(warm_dir, tempfile.mkdtemp(prefix="txnwatch-warm-"))
        for name in ("fraud_trend", "top_alerts", "roc_auc", "iforest_score"):
            REGISTRY[name].fn(spark, warm_dir).collect()

    times["store_build"] = _timed(lambda: build(sf_dir, out_root))
    tx, pr = store.read_monitoring_tables(spark, out_root)
    frame = mon.monitoring_frame(tx, pr)
    totals = store.read_totals(spark, out_root)
    stored = {
        "store_fraud_trend": lambda: mon.trend_from_totals(totals).collect(),
        "store_overview_kpis": lambda: mon.overview_from_totals(totals).collect(),
        "store_risk_distribution": lambda: mon.risk_distribution(pr).collect(),
        "store_channel_success_rates": lambda: mon.channels_from_totals(totals).collect(),
        "store_joined_trend": lambda: mon.fraud_trend(tx, pr).collect(),
        "store_top_alerts": lambda: mon.recent_alerts(tx, pr).collect(),
        "store_dashboard": lambda: dash.dashboard_report(
            frame, "2024-01-03", "2024-01-27", ["atm", "mobile", "web"], None
        ),
    }
    for name, fn in stored.items():
        times[name] = _timed(fn)

    for name in E2E:
        if name in REGISTRY:
            times[f"e2e_{name}"] = _timed(lambda n=name: REGISTRY[n].fn(spark, sf_dir).collect())

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
