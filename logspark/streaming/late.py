"""Late rows: kept beside the stream and repaired by day.

A streaming aggregation drops rows behind its watermark without a trace. ``land`` splits every batch before that: rows
behind the watermark go to ``late``, the others to ``rows``, both by event day and batch. The watermark of a batch is the
latest event time of the batches before it less ``delay_seconds``, which is what Spark's own watermark is; it is read
from ``progress``, one row a batch, so that a batch that runs again splits alike.

``repair`` recomputes a daily table for the days that late rows touched since the last repair, from all rows
of those days, and replaces just those days. It can run at any time, also twice.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.operators.ordered import micros
from logspark.sources.files import overwrite_days
from logspark.streaming.tables import batches, read_batches, read_daily, write_batch, write_daily_batch

DELAY_SECONDS = 600
PROGRESS = "max_us BIGINT, rows BIGINT, late BIGINT"
REPAIRED = "upto BIGINT, event_date DATE"


def watermark_us(spark: SparkSession, path: str, batch_id: int, delay_seconds: int) -> int | None:
    """Latest event time before the batch, less the delay, in microseconds; none before the first rows."""
    latest = read_batches(spark, f"{path}/progress", PROGRESS, before=batch_id).agg(F.max("max_us").alias("us")).first()["us"]
    return None if latest is None else latest - delay_seconds * 1_000_000


def land_batch(batch: DataFrame, batch_id: int, path: str, *, ts: str = "timestamp", delay_seconds: int = DELAY_SECONDS) -> None:
    """Rows, late rows and progress of one batch; rows without a time belong to no day and are left out."""
    mark = watermark_us(batch.sparkSession, path, batch_id, delay_seconds)
    late = F.lit(False) if mark is None else micros(F.col(ts)) < mark
    flagged = batch.where(F.col(ts).isNotNull()).withColumn("__late", late).persist()
    try:
        write_daily_batch(flagged.where(~F.col("__late")).drop("__late"), f"{path}/rows", batch_id, ts)
        write_daily_batch(flagged.where("__late").drop("__late"), f"{path}/late", batch_id, ts)
        seen = flagged.agg(F.max(micros(F.col(ts))).alias("max_us"), F.count(F.lit(1)).alias("rows"), F.count_if("__late").alias("late"))
        write_batch(seen, f"{path}/progress", batch_id)
    finally:
        flagged.unpersist()


def land(stream: DataFrame, path: str, checkpoint: str, *, ts: str = "timestamp", delay_seconds: int = DELAY_SECONDS, trigger: dict[str, Any] | None = None):
    """Continuous job that lands every batch; see ``land_batch``."""
    write = lambda batch, batch_id: land_batch(batch, batch_id, path, ts=ts, delay_seconds=delay_seconds)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def landed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows, late ones included, with ``event_date`` and ``batch``."""
    return read_daily(spark, f"{path}/rows", schema).unionByName(read_daily(spark, f"{path}/late", schema))


def late_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return read_daily(spark, f"{path}/late", schema)


def repair(spark: SparkSession, path: str, schema: T.StructType, table: str, make: Callable[[DataFrame], DataFrame], *, ts: str = "bucket") -> list[str]:
    """Recompute the days of ``table`` that late rows have touched since the last repair of it; returns these days.

    ``make`` turns rows into the table's rows, whose day is that of ``ts``; its groups must not span days. What
    was repaired is noted below ``table`` itself after the days are replaced, so a lost run is done again.
    """
    done = read_batches(spark, f"{path}/repaired", REPAIRED).agg(F.max("upto")).first()[0]
    known = batches(spark, f"{path}/progress")
    if not known:
        return []
    late = late_rows(spark, path, schema).where(F.col("batch") > (-1 if done is None else done))
    touched = late.groupBy("event_date").agg(F.lit(known[-1]).cast("bigint").alias("upto")).select("upto", "event_date")
    days = sorted(r.event_date for r in touched.collect())  # one row a day
    if days:
        rows = landed(spark, path, schema).where(F.col("event_date").isin(days)).drop("event_date", "batch")
        overwrite_days(make(rows).withColumn("event_date", F.to_date(ts)), table)
        write_batch(touched, f"{path}/repaired", known[-1])
    return [d.isoformat() for d in days]
