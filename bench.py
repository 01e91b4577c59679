"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from querytrail.catalog import QUERIES  # noqa: E402
from querytrail.session import build_session  # noqa: E402

HEADLINE = [
    "event_to_hour_pipeline", "hourly_client", "hourly_client_domain", "top_clients",
    "top_clients_from_facts", "top_blocked_domains", "category_breakdown", "summary_all_time",
    "traffic_daily", "daily_client", "monthly_client", "policy_decision",
    "policy_decision_shuffled", "queries_over_rate", "resolver_nodes", "encode_batch",
    "sink_hourly_upsert", "month_rollover", "stream_minute_metrics", "stream_10min_batches",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM code paths and the Python workers before the clock runs.
    for name in ("top_clients", "encode_batch"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
