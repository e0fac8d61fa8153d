"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from logspark.plans import QUERIES
from logspark.session import build_session

HEADLINE = [
    "service_latency",
    "search_filtered",
    "facets",
    "volume_5m",
    "histogram_p95",
    "format_counts",
    "parsed_logs",
    "perf_report",
    "pii_census",
    "pii_redact_hash",
    "zscore_spikes",
    "rare_patterns",
    "error_bursts",
    "baseline_stats",
    "band_breaches",
    "service_edges",
    "blast_radius",
    "rule_alerts",
    "alert_sessions",
    "slo_burn_rate",
    "multiline_join",
    "session_asof",
    "lockouts",
    "compliance_report",
    "tier_assign",
    "stream_ticks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
