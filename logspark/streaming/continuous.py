"""The continuous job: every batch of records goes to the store, metrics, anomalies, services and alerts.

Each output is a table of the batches' increments (``tables.write_batch``), made so that adding the increments up
gives what the batch operator gives for all rows: counts and sums add, times take the minimum or maximum, alert runs of
several batches join where they are at most the gap apart. What needs earlier rows reads them back: error bursts
the last minutes of the stored rows, edges the spans of the trace that came before. A batch that runs twice replaces
its own increments and nothing else. ``compact`` adds up old increments.

Below ``path``: ``hot/event_date=D/batch=N``, and ``metrics``, ``thresholds``, ``bursts``, ``services``, ``runs``,
``open_alerts`` (state), ``sink``, ``spans`` and ``calls``, each with ``batch=N``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.timefx import seconds_before
from logspark.operators.alerts import DEDUP_SECONDS, alert_sessions, firings
from logspark.operators.anomaly import BURST_ABOVE, BURST_SECONDS, error_bursts, threshold_anomalies
from logspark.operators.metrics import log_metrics
from logspark.operators.ordered import from_micros, micros, running, type_of
from logspark.operators.topology import calls_between, calls_by_trace, edges_of, log_rollup
from logspark.sources.intake import kafka_rows
from logspark.streaming.tables import advance, batches, drop_folder, exists, latest, read_batches, read_daily, write_batch, write_daily_batch

KEYS = ["rule_name", "service"]
TRACE_SECONDS = 86400


def of_batches(spark: SparkSession, path: str, name: str, **which: int) -> DataFrame | None:
    """Increments of one output with ``batch``; None before the first."""
    known = batches(spark, f"{path}/{name}")
    if not known:
        return None
    schema = spark.read.parquet(f"{path}/{name}/batch={known[-1]}").schema
    return read_batches(spark, f"{path}/{name}", schema, **which)


def merged_runs(runs: DataFrame, keys: Sequence[str], gap_seconds: int, *, chunk_seconds: int = 86400) -> DataFrame:
    """Join runs ``(starts_at, last_seen, n)`` of one key that overlap or are at most the gap apart.

    The latest end so far is carried over chunks of time, so a key with very many runs is not one task.
    """
    kind, start = type_of(runs, "starts_at"), micros(F.col("starts_at"))
    rows = runs.select(*keys, start.alias("__us"), micros(F.col("last_seen")).alias("__to"), "n")
    rows = rows.groupBy(*keys, "__us").agg(F.max("__to").alias("__to"), F.sum("n").alias("n"))
    rows = rows.withColumn("__chunk", F.floor(F.col("__us") / (chunk_seconds * 1_000_000)).cast("bigint"))
    ends = running(rows, keys, "__chunk", ["__us"], {"__before": ("max_before", F.col("__to"))})
    opens = F.col("__before").isNull() | (F.col("__us") - F.col("__before") > gap_seconds * 1_000_000)
    begun = running(ends, keys, "__chunk", ["__us"], {"__start": ("max", F.when(opens, F.col("__us")))})
    joined = begun.groupBy(*keys, "__start").agg(F.max("__to").alias("__end"), F.sum("n").alias("n"))
    return joined.select(*keys, from_micros(F.col("__start"), kind).alias("starts_at"), from_micros(F.col("__end"), kind).alias("last_seen"), "n")


def update_alerts(fired: DataFrame, batch_id: int, path: str, *, gap_seconds: int = DEDUP_SECONDS) -> DataFrame:
    """Alert runs of a batch of firings ``(rule_name, service, ts)``; returns the alerts that begin in it.

    A run goes on from an open alert of an earlier batch when it starts at most the gap after its last firing.
    The open alerts are the last run of every key.
    """
    spark = fired.sparkSession
    runs = alert_sessions(fired, keys=KEYS, gap_seconds=gap_seconds)
    write_batch(runs, f"{path}/runs", batch_id)
    runs = spark.read.schema(runs.schema).parquet(f"{path}/runs/batch={batch_id}")
    known = latest(spark, f"{path}/open_alerts", runs.schema, before=batch_id).select(*KEYS, F.col("last_seen").alias("__open"))
    new = runs.join(known, KEYS, "left").where(F.col("__open").isNull() | (micros(F.col("starts_at")) - micros(F.col("__open")) > gap_seconds * 1_000_000)).drop("__open")

    def last(rows: DataFrame) -> DataFrame:
        whole = merged_runs(rows, KEYS, gap_seconds)
        return whole.groupBy(*KEYS).agg(F.max(F.struct("last_seen", "starts_at", "n")).alias("r")).select(*KEYS, "r.starts_at", "r.last_seen", "r.n")

    advance(spark, f"{path}/open_alerts", batch_id, runs, last)
    return new


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """New alerts as key and JSON value, below ``sink/batch=N``."""
    return lambda alerts, batch_id: write_batch(kafka_rows(alerts, "service"), f"{path}/sink", batch_id)


def kafka_sink(servers: str, topic: str) -> Callable[[DataFrame, int], None]:
    """New alerts to a topic; a batch that runs again may send its alerts again, so readers go by key and start."""
    return lambda alerts, _: kafka_rows(alerts, "service").write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def process_logs(
    batch: DataFrame, batch_id: int, path: str, *, thresholds: DataFrame, rules: DataFrame, sink: Callable[[DataFrame, int], None] | None = None,
    gap_seconds: int = DEDUP_SECONDS, burst_seconds: int = BURST_SECONDS, burst_above: int = BURST_ABOVE,
) -> None:
    """All outputs of one batch of log records ``(id, timestamp, level, service, response_time, status_code, ..)``."""
    spark = batch.sparkSession
    write_daily_batch(batch.where(F.col("timestamp").isNotNull()), f"{path}/hot", batch_id)
    stored = read_daily(spark, f"{path}/hot", batch.schema)
    rows = stored.where(F.col("batch") == batch_id).drop("batch", "event_date")
    write_batch(log_metrics(rows), f"{path}/metrics", batch_id)
    metrics = spark.read.parquet(f"{path}/metrics/batch={batch_id}")
    write_batch(threshold_anomalies(metrics, thresholds), f"{path}/thresholds", batch_id)
    write_batch(log_rollup(rows), f"{path}/services", batch_id)
    first = rows.agg(F.min("timestamp").alias("t")).first()["t"]
    if first is None:
        return
    back = seconds_before(F.lit(first), burst_seconds)
    recent = stored.where((F.col("event_date") >= F.to_date(back)) & (F.col("timestamp") > back) & (F.col("batch") <= batch_id))
    bursts = error_bursts(recent, window_seconds=burst_seconds, above=burst_above)
    write_batch(bursts.where(F.col("timestamp") >= F.lit(first)), f"{path}/bursts", batch_id)
    new = update_alerts(firings(metrics, rules), batch_id, path, gap_seconds=gap_seconds)
    (sink or table_sink(path))(new, batch_id)


def process_spans(batch: DataFrame, batch_id: int, path: str, *, trace_seconds: int | None = TRACE_SECONDS) -> None:
    """Calls that become known with a batch of spans: new children of any parent, and new parents of earlier children.

    Earlier spans are read back as far as ``trace_seconds`` before the batch's first one; None reads all of them.
    """
    spark = batch.sparkSession
    # Sorted by time, so that row groups before the stretch are skipped; spans may be of any age, so not by day.
    write_batch(batch.where(F.col("start_time").isNotNull()).sortWithinPartitions("start_time"), f"{path}/spans", batch_id)
    stored = of_batches(spark, path, "spans", before=batch_id + 1)
    new, old = stored.where(F.col("batch") == batch_id), stored.where(F.col("batch") < batch_id)
    if trace_seconds is not None:
        first = new.agg(F.min("start_time").alias("t")).first()["t"]
        if first is not None:
            old = old.where(F.col("start_time") >= seconds_before(F.lit(first), trace_seconds))
    calls = calls_between(new, new.unionByName(old)).unionByName(calls_between(old, new))
    write_batch(calls_by_trace(calls), f"{path}/calls", batch_id)


def run(stream: DataFrame, process: Callable[..., None], path: str, checkpoint: str, *, trigger: dict[str, Any] | None = None, **options: Any):
    """Start the job that calls ``process(batch, batch_id, path, **options)`` for every batch that has rows."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            process(batch, batch_id, path, **options)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def services(spark: SparkSession, path: str) -> DataFrame:
    """Log count, errors and time range per service over all batches."""
    return ADDED["services"](of_batches(spark, path, "services"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of the service graph over all batches."""
    return edges_of(of_batches(spark, path, "calls"))


def alerts(spark: SparkSession, path: str, *, gap_seconds: int = DEDUP_SECONDS) -> DataFrame:
    """Alert runs over all batches."""
    return merged_runs(of_batches(spark, path, "runs"), KEYS, gap_seconds)


def bursts(spark: SparkSession, path: str) -> DataFrame:
    """Error bursts over all batches; an instant that two batches share has its later, larger count."""
    rows = of_batches(spark, path, "bursts")
    return rows.groupBy("service", "timestamp").agg(F.max("errors").alias("errors"), F.max("errors_in_window").alias("errors_in_window"))


#: How the increments of an output are added up: keys and aggregates.
ADDED: dict[str, Callable[[DataFrame], DataFrame]] = {
    "services": lambda rows: rows.groupBy("service").agg(
        F.sum("log_count").alias("log_count"), F.sum("log_errors").alias("log_errors"),
        F.min("log_first_seen").alias("log_first_seen"), F.max("log_last_seen").alias("log_last_seen"),
    ),
    "calls": calls_by_trace,
}


def compact(spark: SparkSession, path: str, name: str, *, upto: int) -> None:
    """Replace the increments of the batches up to ``upto`` by their sum.

    The sum is written aside first and moved into place after the increments are gone; ``finish`` completes a run that was
    lost in between. Only for batches whose checkpoint is committed, which never run again, and between two batches.
    """
    finish(spark, path, name)
    known = [b for b in batches(spark, f"{path}/{name}") if b <= upto]
    if len(known) > 1:
        rows = of_batches(spark, path, name, before=known[-1] + 1)
        ADDED[name](rows.drop("batch")).withColumn("upto", F.lit(known[-1])).write.mode("overwrite").parquet(f"{path}/{name}-sum")
        finish(spark, path, name)


def finish(spark: SparkSession, path: str, name: str) -> None:
    """Put a complete sum in the place of its increments; repeating any step is harmless."""
    aside = f"{path}/{name}-sum"
    if not exists(spark, f"{aside}/_SUCCESS"):
        return
    total = spark.read.parquet(aside)
    upto = total.agg(F.max("upto")).first()[0]
    for old in batches(spark, f"{path}/{name}") if upto is not None else []:
        if old < upto:
            drop_folder(spark, f"{path}/{name}/batch={old}")
    if upto is not None:
        write_batch(total.drop("upto"), f"{path}/{name}", upto)
    drop_folder(spark, aside)
