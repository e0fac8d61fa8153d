"""The continuous job: batches that run twice, state across batches, compaction."""

import datetime
import json

from pyspark.sql import functions as F

from logspark.operators import alerts, anomaly, metrics, topology
from logspark.session import scratch_path
from logspark.streaming import continuous, tables

START = datetime.datetime(2024, 5, 1, 23, 58)
SCHEMA = "id STRING, timestamp TIMESTAMP, level STRING, service STRING, response_time BIGINT, status_code BIGINT"


def logs(spark, rows):
    return spark.createDataFrame([(str(i), START + datetime.timedelta(seconds=s), level, service, ms, 200) for i, s, level, service, ms in rows], SCHEMA)


def process(spark, rows, batch_id, path, **options):
    continuous.process_logs(logs(spark, rows), batch_id, path, thresholds=anomaly.default_thresholds(spark), rules=alerts.default_rules(spark), gap_seconds=60, burst_seconds=100, burst_above=2, **options)


FIRST = [(1, 0, "ERROR", "a", 5), (2, 30, "INFO", "a", 5000), (3, 50, "ERROR", "a", 5), (4, 55, "INFO", "b", 5), (5, 56, None, None, None)]
SECOND = [(6, 90, "ERROR", "a", 5), (7, 99, "ERROR", "b", 5), (8, 101, "ERROR", "a", None)]
THIRD = [(9, 400, "ERROR", "a", 5)]


def seconds(frame, *columns):
    at = lambda v: int((v - START).total_seconds()) if isinstance(v, datetime.datetime) else v
    return sorted(tuple(at(r[c]) for c in columns) for r in frame.collect())


def test_outputs_add_up_and_a_batch_may_run_twice(spark):
    path = scratch_path(spark, "job")
    for rows, k in ((FIRST, 0), (SECOND, 1), (SECOND, 1), (THIRD, 2), (THIRD, 2)):
        process(spark, rows, k, path)
    whole = logs(spark, FIRST + SECOND + THIRD)
    assert tables.read_daily(spark, f"{path}/hot", whole.schema).count() == 9
    assert sorted(continuous.services(spark, path).collect()) == sorted(topology.log_rollup(whole).collect())
    assert seconds(continuous.bursts(spark, path), "service", "timestamp", "errors_in_window") == [("a", 90, 3), ("a", 101, 3)]
    want = alerts.alert_sessions(alerts.firings(metrics.log_metrics(whole), alerts.default_rules(spark)), gap_seconds=60)
    columns = ("rule_name", "service", "starts_at", "last_seen", "n")
    got = seconds(continuous.alerts(spark, path, gap_seconds=60), *columns)
    assert got == seconds(want, *columns)
    assert got == [("high_error_rate", "a", 0, 101, 4), ("high_error_rate", "a", 400, 400, 1), ("high_error_rate", "b", 99, 99, 1), ("high_latency_p95", "a", 30, 30, 1)]
    sent = [(json.loads(r.value)["rule_name"], r.key, r.batch) for r in continuous.of_batches(spark, path, "sink").collect()]
    assert sorted(sent) == [("high_error_rate", "a", 0), ("high_error_rate", "a", 2), ("high_error_rate", "b", 1), ("high_latency_p95", "a", 0)]


def test_own_sink_and_a_batch_without_times(spark):
    path, seen = scratch_path(spark, "job"), []
    process(spark, FIRST, 0, path, sink=lambda rows, k: seen.append((k, rows.count())))
    untimed = spark.createDataFrame([("9", None, "ERROR", "a", 1, 200)], SCHEMA)
    continuous.process_logs(untimed, 1, path, thresholds=anomaly.default_thresholds(spark), rules=alerts.default_rules(spark))
    assert seen == [(0, 2)]


def spans(spark, rows):
    made = [(t, s, p, service, "op", START + datetime.timedelta(seconds=at), 10 * s, s % 2 == 0) for t, s, p, service, at in rows]
    return spark.createDataFrame(made, "trace_id BIGINT, span_id BIGINT, parent_span_id BIGINT, service STRING, operation STRING, start_time TIMESTAMP, duration BIGINT, error BOOLEAN")


def test_edges_across_batches(spark):
    rows = [(1, 1, None, "a", 0), (1, 2, 1, "b", 1), (1, 3, 2, "c", 2), (2, 1, None, "a", 3), (2, 2, 1, "b", 4), (2, 3, 1, "b", 5), (3, 5, 9, "x", 6), (3, 6, 5, "x", 7)]
    path = scratch_path(spark, "job")
    # Children before parents, parents before children, both at once.
    for k, part in enumerate(([rows[1], rows[3]], [rows[0], rows[2], rows[4]], [rows[1 + 4], rows[6], rows[7]])):
        continuous.process_spans(spans(spark, part), k, path)
        continuous.process_spans(spans(spark, part), k, path)
    key = lambda frame: sorted((r["from"], r["to"], r.calls, r.traces, r.error_count, r.avg_latency, r.first_seen, r.last_seen) for r in frame.collect())
    assert key(continuous.edges(spark, path)) == key(topology.dependencies(spans(spark, rows))) != []
    continuous.compact(spark, path, "calls", upto=1)
    assert tables.batches(spark, f"{path}/calls") == [1, 2]
    assert key(continuous.edges(spark, path)) == key(topology.dependencies(spans(spark, rows)))


def test_spans_before_the_stretch_are_not_joined(spark):
    path = scratch_path(spark, "job")
    continuous.process_spans(spans(spark, [(1, 1, None, "a", 0)]), 0, path, trace_seconds=60)
    continuous.process_spans(spans(spark, [(1, 2, 1, "b", 59)]), 1, path, trace_seconds=60)
    continuous.process_spans(spans(spark, [(1, 3, 1, "b", 61)]), 2, path, trace_seconds=60)
    assert [r.calls for r in continuous.edges(spark, path).collect()] == [1]


def test_a_lost_compaction_is_finished(spark):
    path = scratch_path(spark, "job")
    for k in range(3):
        tables.write_batch(topology.log_rollup(logs(spark, FIRST)), f"{path}/services", k)
    rows = continuous.of_batches(spark, path, "services", before=2).drop("batch")
    continuous.ADDED["services"](rows).withColumn("upto", F.lit(1)).write.parquet(f"{path}/services-sum")
    tables.drop_folder(spark, f"{path}/services/batch=0")  # the run was lost here
    continuous.compact(spark, path, "services", upto=0)
    assert tables.batches(spark, f"{path}/services") == [1, 2]
    assert {r.service: r.log_count for r in continuous.services(spark, path).collect()} == {"a": 9, "b": 3}
