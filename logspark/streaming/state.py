"""Stateful operators that keep counts by pattern and moments by series over the batches of a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logspark.functions.timefx import seconds_before
from logspark.operators.anomaly import BASELINE_DAYS, CONFIDENCE, RARE_BELOW, signature
from logspark.operators.moments import merged, segments, stats
from logspark.streaming.jobs import WATERMARK
from logspark.streaming.tables import advance, latest

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
BUCKETS = 64
RARE_SCHEMA = "id STRING, timestamp TIMESTAMP, pattern STRING, occurrence BIGINT"


def with_state_store(spark: SparkSession, start: Callable[[], Any]) -> Any:
    """Start a query whose state lies in RocksDB, which map state and expiry need; other queries keep their store."""
    before = spark.conf.get(STORE_KEY, None)
    spark.conf.set(STORE_KEY, STORE)
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(STORE_KEY)
        else:
            spark.conf.set(STORE_KEY, before)


def _first_of(below: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first rows of each pattern of a batch; the last of them counts those left out."""
        for batch in batches:
            rows = batch.to_pandas().sort_values(["pattern", "timestamp", "id"], kind="stable")
            by = rows.groupby("pattern", sort=False)
            turn, size = by.cumcount(), by["pattern"].transform("size")
            kept = rows[turn < below].assign(more=(size - below).where(turn == below - 1, 0).clip(lower=0))
            yield pa.RecordBatch.from_pandas(kept[["bucket", "pattern", "timestamp", "id", "more"]], schema=pa.schema([*batch.schema, pa.field("more", pa.int64())]), preserve_index=False)

    return first


class PatternCounts(StatefulProcessor):
    """How often each pattern of a bucket was seen, up to the limit, and when last.

    With ``ttl_ms`` a pattern not seen for that long in event time counts from the start again; a timer
    removes it from the state once the watermark has passed its end.
    """

    def __init__(self, below: int, ttl_ms: int | None) -> None:
        self.below, self.ttl_ms = below, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "pattern STRING", "n BIGINT, last_ms BIGINT")

    def before(self, pattern: str, first_ms: int) -> tuple[int, int]:
        if not self.seen.containsKey((pattern,)):
            return 0, 0
        n, last = self.seen.getValue((pattern,))
        return (0, 0) if self.ttl_ms is not None and first_ms - last > self.ttl_ms else (n, last)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # A task has combined its rows before, so a pattern sends a few rows per Arrow batch.
        frame = pd.concat(list(rows)).sort_values(["pattern", "timestamp", "id"], kind="stable")
        by = frame.groupby("pattern", sort=False)
        at = frame["timestamp"].astype("datetime64[ms]").astype("int64")
        summary = pd.DataFrame({"n": by.size() + by["more"].sum(), "first": at.groupby(frame["pattern"]).min(), "last": at.groupby(frame["pattern"]).max()})
        known = {p: self.before(p, int(first)) for p, first in summary["first"].items()}
        for p, n, last in zip(summary.index, summary["n"], summary["last"]):
            old, seen = known[p]
            if self.ttl_ms is not None or old < self.below:
                self.seen.updateValue((p,), (min(old + int(n), self.below), max(seen, int(last))))
        if self.ttl_ms is not None and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), 0) + self.ttl_ms)
        frame["occurrence"] = by.cumcount() + 1 + frame["pattern"].map({p: n for p, (n, _) in known.items()})
        yield frame.loc[frame["occurrence"] <= self.below, ["id", "timestamp", "pattern", "occurrence"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = [(k[0], v[1]) for k, v in self.seen.iterator()]
        for p, last in held:
            if last < mark - self.ttl_ms:
                self.seen.removeKey((p,))
        if any(last >= mark - self.ttl_ms for _, last in held):
            self.handle.registerTimer(mark + self.ttl_ms)
        return iter(())

    def close(self) -> None:
        pass


def rare_patterns(logs: DataFrame, *, message: str = "message", ts: str = "timestamp", tie: str = "id", below: int = RARE_BELOW, buckets: int = BUCKETS, ttl_seconds: int | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Streaming twin of the rare pattern rule: records whose pattern was seen fewer than ``below`` times before.

    Patterns are dealt to buckets by hash; each is one map in the state store. Of a pattern only the first
    rows of every Arrow batch are shuffled, so one that fills a stream sends little to its task. Records
    count in the order of arrival, and by time and id within a batch. With ``ttl_seconds`` rows behind the watermark are
    dropped. Start the query by ``with_state_store``.
    """
    marked = logs.select(signature(F.col(message)).alias("pattern"), F.col(ts).alias("timestamp"), F.col(tie).cast("string").alias("id")).where("pattern IS NOT NULL")
    bucketed = marked.select(F.pmod(F.xxhash64("pattern"), F.lit(buckets)).cast("int").alias("bucket"), "pattern", "timestamp", "id")
    few = bucketed.mapInArrow(_first_of(below), "bucket INT, pattern STRING, timestamp TIMESTAMP, id STRING, more BIGINT")
    counts = PatternCounts(below, None if ttl_seconds is None else ttl_seconds * 1000)
    if ttl_seconds is not None:
        few = few.withWatermark("timestamp", watermark)
    found = few.groupBy("bucket").transformWithStateInPandas(counts, RARE_SCHEMA, "Append", "None" if ttl_seconds is None else "EventTime")
    return found.withColumn("confidence", F.lit(CONFIDENCE["rare_log_pattern"]))


BASELINE_SCHEMA = "name STRING, segment TIMESTAMP, n BIGINT, mean DOUBLE, m2 DOUBLE, cross DOUBLE, arrived BIGINT"


def update_baseline(batch: DataFrame, batch_id: int, path: str, *, keys: Sequence[str] = ("name",), order: Sequence[str] = ("ts", "service"), unit: str = "hour", days: int = BASELINE_DAYS) -> DataFrame:
    """Add the segments of a batch of metric values to the state at ``path`` and return it; expired ones go.

    A segment is kept per series, ``unit`` and batch, so rows that arrive late for their hour just add a segment behind
    the earlier ones. The state has at most ``days`` of them, and a batch that runs twice replaces its version.
    """
    rows = segments(batch, keys, order=order, unit=unit).withColumn("arrived", F.lit(batch_id).cast("bigint"))

    def fold(parts: DataFrame) -> DataFrame:
        newest = parts.agg(F.max("segment")).scalar()
        return parts.where(F.col("segment") > seconds_before(newest, days * 86400))

    return advance(batch.sparkSession, path, batch_id, rows, fold)


def baseline(spark: SparkSession, path: str, schema: T.StructType | str = BASELINE_SCHEMA, *, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Count, mean, deviation and trend per series from the newest state."""
    return stats(merged(latest(spark, path, schema), keys, order=("segment", "arrived")), keys)


def track_baselines(stream: DataFrame, path: str, checkpoint: str, *, trigger: dict[str, Any] | None = None, **options: Any):
    """Continuous job that keeps the baseline state of a stream of metric values."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            update_baseline(batch, batch_id, path, **options)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
