"""Structured Streaming twins of the batch operators, and the fan-out job.

Event time must be TIMESTAMP (not NTZ). All windows close by watermark; rows later than that go
to batch repair (rewrite of the affected days).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logspark.operators.anomaly import BURST_ABOVE, SPIKE_ROWS, SPIKE_Z
from logspark.operators.metrics import count_if
from logspark.operators.multiline import CONTINUATION, FLUSH_SECONDS, START
from logspark.session import scratch_path

WATERMARK = "10 minutes"


def file_stream(spark: SparkSession, folder: str, schema: Any, *, glob: str | None = None, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def run_available(stream: DataFrame, name: str, *, mode: str = "append") -> DataFrame:
    """Process what is available now into a table of the shared folder and read it back."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    q = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def live_tail(logs: DataFrame, condition: Column) -> DataFrame:
    """Filtered live records."""
    return logs.where(condition)


def sliding_error_bursts(
    logs: DataFrame, *, ts: str = "timestamp", width: str = "5 minutes", slide: str = "1 minute", above: int = BURST_ABOVE, watermark: str = WATERMARK, by: tuple[str, ...] = ()
) -> DataFrame:
    """Sliding windows with more than ``above`` errors; the watermark follows the error records."""
    return (
        logs.where(F.col("level") == "ERROR")
        .withWatermark(ts, watermark)
        .groupBy(F.window(ts, width, slide).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("errors"))
        .where(F.col("errors") > above)
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "errors")
    )


def ticks(logs: DataFrame, *, ts: str = "timestamp", width: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Requests and errors per service in tumbling windows: the input of burn rates, volume and error ratio."""
    return (
        logs.withWatermark(ts, watermark)
        .groupBy(F.window(ts, width).alias("w"), "service")
        .agg(F.count(F.lit(1)).alias("n"), count_if(F.col("level").isin("ERROR", "FATAL")).alias("errors"))
        .select(F.col("w.start").alias("bucket"), "service", "n", "errors")
    )


def burn_rate_ticks(logs: DataFrame, slos: DataFrame, **options: Any) -> DataFrame:
    """Burn rate per SLO and window; ``slos`` is a static table with its budget filled in."""
    known = slos.select("slo", "service", "error_budget", "burn_rate_threshold")
    rated = ticks(logs, **options).join(known, "service")
    return rated.withColumn("burn_rate", F.col("errors") / F.col("n") / F.col("error_budget"))


def alert_sessions(firings: DataFrame, *, ts: str = "ts", gap: str = "5 minutes", watermark: str = WATERMARK) -> DataFrame:
    """Deduplicated alerts: one session per rule and service with a count."""
    return (
        firings.withWatermark(ts, watermark)
        .groupBy(F.session_window(ts, gap).alias("s"), "rule_name", "service")
        .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last_seen"))
        .select("rule_name", "service", F.col("s.start").alias("starts_at"), "last_seen", "n")
    )


def first_alerts(firings: DataFrame, *, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Only the first firing of each rule and service while it repeats within the watermark."""
    return firings.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["rule_name", "service"])


def alert_groups(alerts: DataFrame, *, ts: str = "ts", width: str = "30 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Alert groups per tick, service and severity with more than one alert."""
    return (
        alerts.withWatermark(ts, watermark)
        .groupBy(F.window(ts, width).alias("w"), F.coalesce("service", F.lit("unknown")).alias("service"), "severity")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .where(F.col("alerts") > 1)
        .select(F.col("w.start").alias("bucket"), "service", "severity", "alerts")
    )


def _micros(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[us]").astype("int64")


ENTRY_SCHEMA = "source STRING, line_no BIGINT, value STRING, lines BIGINT"
#: The open entry of a source; ``value`` is null once it was flushed. ``opened_us`` stays, as it tells that there was one.
#: A source without lines for so long after its last entry is forgotten: its next indented start may open one.
FORGET_SECONDS = 86400
ENTRY_STATE = "line_no BIGINT, value STRING, lines BIGINT, opened_us BIGINT"


def _entries(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Entries of one source: the open one is the state, closed ones are emitted."""
    columns = ["source", "line_no", "value", "lines"]
    held = state.get if state.exists else None
    if state.hasTimedOut:
        if held[1] is None:
            state.remove()
            return
        yield pd.DataFrame([(key[0], *held[:3])], columns=columns)
        state.update((held[0], None, held[2], held[3]))
        state.setTimeoutTimestamp(max(held[3] // 1000, state.getCurrentWatermarkMs()) + FORGET_SECONDS * 1000)
        return
    rows = pd.concat(list(batches)).sort_values("line_no", kind="stable")
    at = _micros(rows["timestamp"]).to_numpy()
    no, text = rows["line_no"].to_numpy(), rows["value"].to_numpy(dtype=object)
    more = rows["value"].str.match(CONTINUATION).to_numpy(dtype=bool)
    opens = rows["value"].str.contains(START, regex=True).to_numpy(dtype=bool) & ~more
    indented = np.flatnonzero(rows["value"].str.contains(START, regex=True).to_numpy(dtype=bool) & more)
    if held is None and len(indented) and not opens[: indented[0]].any():
        opens[indented[0]] = True  # the first entry of a source may open indented
    opener = np.maximum.accumulate(np.where(opens, np.arange(len(no)), -1))
    opened = np.where(opener >= 0, at[np.maximum(opener, 0)], held[3] if held else np.iinfo(np.int64).min)
    belongs = more & ~opens & ((opener >= 0) | (held is not None and held[1] is not None)) & (at < opened + FLUSH_SECONDS * 1_000_000)
    # The entry that was open before the batch has place -1.
    entry = np.where(belongs, opener, np.arange(len(no)))
    made = pd.DataFrame({"entry": entry, "value": text}).groupby("entry", sort=True)["value"].agg(joined="\n".join, size="size")
    where = made.index.to_numpy()
    out = pd.DataFrame({"source": key[0], "line_no": no[np.maximum(where, 0)], "value": made["joined"].to_numpy(dtype=object), "lines": made["size"].to_numpy()})
    old = held if held is not None and held[1] is not None else None
    if len(where) and where[0] == -1:
        first = out.iloc[0]
        if old is not None:
            old = (old[0], old[1] + "\n" + first["value"], old[2] + int(first["lines"]), old[3])
        out, where = out.iloc[1:], where[1:]
    last = int(opener[-1])
    final = int(at[-1])
    if last >= 0:
        if old is not None:
            out = pd.concat([pd.DataFrame([(key[0], *old[:3])], columns=columns), out])
        mine = out["line_no"] == no[last]
        now = (int(no[last]), str(out.loc[mine, "value"].iloc[0]), int(out.loc[mine, "lines"].iloc[0]), int(at[last]))
        out = out[~mine]
    else:
        now = old if old is not None else held
    if now is not None:
        if now[1] is not None and final >= now[3] + FLUSH_SECONDS * 1_000_000:
            out = pd.concat([out, pd.DataFrame([(key[0], *now[:3])], columns=columns)])
            now = (now[0], None, now[2], now[3])
        state.update(now)
        wait = FORGET_SECONDS if now[1] is None else FLUSH_SECONDS
        state.setTimeoutTimestamp(max((now[3] // 1000) + wait * 1000, state.getCurrentWatermarkMs() + 1))
    yield out[columns]


def multiline_entries(lines: DataFrame, *, watermark: str = "1 minute") -> DataFrame:
    """Streaming join of continuation lines ``(source, line_no, timestamp, value)``.

    The open entry of a source is its only state; it is flushed by the next start line, by a line
    five seconds later, or by the watermark. Line numbers grow with the batches, times with the lines.
    The same rows come out as from ``multiline.join_lines`` with ``ts``.
    """
    return (
        lines.withWatermark("timestamp", watermark)
        .groupBy("source")
        .applyInPandasWithState(_entries, ENTRY_SCHEMA, ENTRY_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


SPIKE_SCHEMA = "name STRING, ts TIMESTAMP, seq BIGINT, value DOUBLE, baseline DOUBLE, z_score DOUBLE"
SPIKE_STATE = "recent ARRAY<DOUBLE>, at_us ARRAY<BIGINT>"


def _spikes_of(max_age_seconds: int):
    max_age = max_age_seconds * 1_000_000

    def spikes_of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Rolling z-scores of one series; the state is its last values and their times."""
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        recent, at = (list(x) for x in state.get) if state.exists else ([], [])
        values = np.concatenate([recent, rows["value"].to_numpy(float)])
        times = np.concatenate([np.array(at, np.int64), _micros(rows["ts"]).to_numpy()])
        mean, std, oldest = np.full(len(values), np.nan), np.ones(len(values)), np.zeros(len(values), np.int64)
        if len(values) > SPIKE_ROWS:
            before = np.lib.stride_tricks.sliding_window_view(values, SPIKE_ROWS)[:-1]
            mean[SPIKE_ROWS:], std[SPIKE_ROWS:], oldest[SPIKE_ROWS:] = before.mean(axis=1), before.std(axis=1), times[:-SPIKE_ROWS]
        z = np.where(oldest > times - max_age, np.abs(values - mean) / np.where(std == 0, 1.0, std), np.nan)
        tail = slice(len(recent), None)
        out = rows[["ts", "seq", "value"]].assign(name=key[0], baseline=mean[tail], z_score=z[tail])
        state.update((values[-SPIKE_ROWS:].tolist(), times[-SPIKE_ROWS:].tolist()))
        expiry = (int(times[-1]) + max_age) // 1000
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield out[out["z_score"] > SPIKE_Z][["name", "ts", "seq", "value", "baseline", "z_score"]]

    return spikes_of


def spikes(series: DataFrame, *, max_age_seconds: int = 3600, watermark: str = WATERMARK) -> DataFrame:
    """Streaming twin of the rolling z-score ``(name, ts, seq, value)``.

    A series keeps its last ten values; it is forgotten when the watermark has left them behind.
    """
    return (
        series.withWatermark("ts", watermark)
        .groupBy("name")
        .applyInPandasWithState(_spikes_of(max_age_seconds), SPIKE_SCHEMA, SPIKE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def fan_out(stream: DataFrame, outputs: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str, *, trigger: dict[str, Any] | None = None):
    """Continuous job: every micro-batch is turned into several tables below ``path``.

    Each table is written to a folder named by the batch, overwriting it, so a batch that runs
    twice after a failure leaves its rows once. The batch is cached while its outputs are written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, make in outputs.items():
                make(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
