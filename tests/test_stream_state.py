"""Late rows, pattern counts and baseline moments over several batches."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from logspark.operators import anomaly, moments
from logspark.session import scratch_path
from logspark.streaming import late, state, tables

START = datetime.datetime(2024, 5, 1, 23, 0)


def logs(spark, rows):
    made = [(str(i), START + datetime.timedelta(minutes=m), level, "a") for i, (m, level) in enumerate(rows)]
    return spark.createDataFrame(made, "id STRING, timestamp TIMESTAMP, level STRING, service STRING")


def per_minute(rows):
    return rows.groupBy(F.date_trunc("minute", "timestamp").alias("bucket"), "service").agg(F.count(F.lit(1)).alias("n"))


def counts(frame):
    return sorted((r.bucket, r.n) for r in frame.collect())


def test_late_rows_are_kept_and_repaired(spark):
    base = scratch_path(spark, "late")
    first = logs(spark, [(0, "INFO"), (100, "INFO")])
    # The latest time is minute 100 and the delay ten minutes: 89 is late, 90 is not.
    second = logs(spark, [(89, "ERROR"), (90, "INFO"), (10, "INFO"), (200, "INFO")])
    third = logs(spark, [(190, "INFO"), (5, "INFO")])
    tables.in_runs(spark, [first, second, third], lambda s: late.land(s, f"{base}/landed", f"{base}/checkpoint"))
    behind = late.late_rows(spark, f"{base}/landed", first.schema)
    minutes = lambda frame: sorted(int((r.timestamp - START).total_seconds() // 60) for r in frame.collect())
    assert minutes(behind) == [5, 10, 89]
    in_time = late.read_daily(spark, f"{base}/landed/rows", first.schema)
    assert minutes(in_time) == [0, 90, 100, 190, 200]
    late.overwrite_days(per_minute(in_time).withColumn("event_date", F.to_date("bucket")), f"{base}/ticks")
    repair = lambda: late.repair(spark, f"{base}/landed", first.schema, f"{base}/ticks", per_minute)
    assert repair() == ["2024-05-01", "2024-05-02"]
    want = counts(per_minute(first.union(second).union(third)))
    assert counts(spark.read.parquet(f"{base}/ticks")) == want
    assert repair() == [] and counts(spark.read.parquet(f"{base}/ticks")) == want


def test_a_repair_touches_only_days_of_new_late_rows(spark):
    base = scratch_path(spark, "late")
    schema = logs(spark, []).schema
    land = lambda rows, k: late.land_batch(logs(spark, rows), k, base)
    land([(0, "INFO"), (2000, "INFO")], 0)
    land([(10, "INFO")], 1)
    assert late.repair(spark, base, schema, f"{base}/t", per_minute) == ["2024-05-01"]
    land([(100, "INFO")], 2)
    assert late.repair(spark, base, schema, f"{base}/t", per_minute) == ["2024-05-02"]


def test_landing_a_batch_twice_changes_nothing(spark):
    base = scratch_path(spark, "late")
    schema = logs(spark, []).schema
    batches = [[(0, "INFO"), (500, "INFO")], [(3, "INFO"), (499, "INFO")], [(1000, "INFO")]]
    for k in (0, 1, 1, 2, 1):
        late.land_batch(logs(spark, batches[k]), k, base)
    assert late.landed(spark, base, schema).count() == 5
    assert late.late_rows(spark, base, schema).count() == 1


def messages(spark, rows):
    made = [(f"{i:03d}", START + datetime.timedelta(seconds=s), text) for i, s, text in rows]
    return spark.createDataFrame(made, "id STRING, timestamp TIMESTAMP, message STRING")


@pytest.mark.parametrize("ttl", [None, 3600])
def test_rare_patterns_over_batches(spark, ttl):
    rng = random.Random(4)
    shapes = ["user alice logged in", "disk sda full", "common event"]
    rows = [(i, i, shapes[2] if rng.random() < 0.8 else rng.choice(shapes) + (" from 10.0.0.1" if rng.random() < 0.3 else "")) for i in range(240)]
    rows += [(300 + i, 239, "common event") for i in range(5)]
    pieces = [messages(spark, [r for r in rows if low <= r[1] < high]).repartition(3) for low, high in ((0, 3), (3, 90), (90, 91), (91, 240))]
    base = scratch_path(spark, "rare")

    def start(stream):
        found = state.rare_patterns(stream, buckets=3, ttl_seconds=ttl).writeStream.format("parquet")
        found = found.option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        return state.with_state_store(spark, found.start)

    tables.in_runs(spark, pieces, start)
    key = lambda r: (r.id, r.pattern, r.occurrence)
    got = sorted(map(key, spark.read.parquet(f"{base}/rows").collect()))
    assert got == sorted(map(key, anomaly.rare_patterns(messages(spark, rows)).collect())) and len(got) >= 15


def test_rare_patterns_are_forgotten_in_event_time(spark):
    """Ten minutes after its last record a pattern counts as new; an hour later its state is gone."""
    at = [0, 1, 2, 3, 4, 5, 6, 7, 500, 1101, 1102, 5000, 5001]
    cuts = (0, 5, 501, 1102, 5000, 9999)
    rows = [(i, s, "same text") for i, s in enumerate(at)]
    base = scratch_path(spark, "rare")

    def start(stream):
        found = state.rare_patterns(stream, buckets=1, ttl_seconds=600, watermark="0 seconds").writeStream.format("parquet")
        found = found.option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        return state.with_state_store(spark, found.start)

    tables.in_runs(spark, [messages(spark, [r for r in rows if a <= r[1] < b]) for a, b in zip(cuts, cuts[1:])], start)
    got = sorted((int(r.id), r.occurrence) for r in spark.read.parquet(f"{base}/rows").collect())
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (9, 1), (10, 2), (11, 1), (12, 2)]


def metric_rows(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), START + datetime.timedelta(minutes=17 * i), f"s{i % 3}", rng.gauss(50, 9) + i / 10) for i in range(n)]
    return spark.createDataFrame(rows, "name STRING, ts TIMESTAMP, service STRING, value DOUBLE")


def close(got, want):
    rows = lambda frame: {r["name"]: (r["n"], r["mean"], r["std"], r["trend"]) for r in frame.collect()}
    a, b = rows(got), rows(want)
    assert a.keys() == b.keys()
    for k in a:
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[k], b[k])), (a[k], b[k])


@pytest.mark.parametrize("unit", ["hour", "day"])
def test_merged_segments_equal_the_plain_baseline(spark, unit):
    metrics = metric_rows(spark, 400, 1)
    close(moments.stats(moments.merged(moments.segments(metrics, unit=unit))), anomaly.baseline_stats(metrics, days=None))


def test_few_rows_have_no_trend(spark):
    metrics = metric_rows(spark, 9, 2)
    assert {r.trend for r in moments.stats(moments.merged(moments.segments(metrics))).collect()} == {0.0}


def test_baseline_state_merges_batches_and_expires(spark):
    metrics = metric_rows(spark, 900, 3)  # ten days
    path = scratch_path(spark, "baseline")
    cuts = [START + datetime.timedelta(days=d) for d in (0, 2, 5, 6, 99)]
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = metrics.where((F.col("ts") >= low) & (F.col("ts") < high))
        state.update_baseline(part, k, path)
        if k == 2:
            state.update_baseline(part, k, path)  # the batch runs again
    whole_hours = metrics.withColumn("ts", F.date_trunc("hour", "ts"))
    want = anomaly.baseline_stats(whole_hours.join(metrics.select("name", "service", "value", F.col("ts").alias("at")), ["name", "service", "value"]), order=("ts", "at"))
    got = state.baseline(spark, path)
    key = lambda frame: {r["name"]: (r["n"], round(r["mean"], 6), round(r["std"], 6)) for r in frame.collect()}
    assert key(got) == key(want)
    assert len(tables.batches(spark, path)) == 2


def test_state_before_the_first_batch_is_empty(spark):
    assert state.baseline(spark, scratch_path(spark, "nothing")).collect() == []
