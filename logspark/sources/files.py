"""Text files in, tables and exports out."""

from __future__ import annotations

import datetime
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.functions.timefx import EXACT_TIMES, span_seconds
from logspark.operators.tiers import HOT, WARM, union_tiers


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all text files of a folder with their file name; files are split across tasks."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("source"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a number that grows along each file, for order-dependent steps.

    The number is the block offset of the split followed by the position inside it, so no file
    has to be read by one task.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    return lines.select("source", (F.col("__block") * F.lit(1 << 20) + F.col("__id") % F.lit(1 << 33)).alias("line_no"), "value")


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and modification time of the files, newest first; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .load(path)
        .select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
        .orderBy(F.col("modified_at").desc(), "filename")
    )


def land_lines(df: DataFrame, path: str, *, line: str = "value") -> None:
    """Append text lines as new files of a folder."""
    df.select(F.col(line).alias("value")).write.mode("append").text(path)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header, every value quoted, quotes escaped."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**EXACT_TIMES).json(path)


def export_topology(services: DataFrame, dependencies: DataFrame, deployments: DataFrame, path: str) -> None:
    """Snapshot of the service graph: three JSON tables below one folder."""
    for name, table in (("services", services), ("dependencies", dependencies), ("deployments", deployments)):
        export_json(table, f"{path}/{name}")


def write_hot(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Daily partitions by event day."""
    df.withColumn("event_date", F.to_date("timestamp")).write.mode(mode).partitionBy("event_date").parquet(path)


def write_warm(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Monthly partitions sorted by time, service and level, so that row groups can be skipped.

    Rows are spread over days before the write; a busy month is not one task.
    """
    table = df.withColumn("event_month", F.date_format("timestamp", "yyyy-MM"))
    spread = table.repartition(F.col("event_month"), F.to_date("timestamp"), F.hour("timestamp"))
    spread.sortWithinPartitions("event_month", "timestamp", "service", "level").write.mode(mode).partitionBy("event_month").parquet(path)


def write_cold(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """JSON below ``year/month/day``; the schema is kept in ``_schema``, so that reading infers nothing."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd"}
    table = df.withColumns({n: F.date_format("timestamp", f) for n, f in parts.items()})
    table.write.mode(mode).options(**EXACT_TIMES).partitionBy(*parts).json(path)
    known = cold_schema(df.sparkSession, path) if mode == "append" else None
    fields = {f.name: f for f in [*(known.fields if known else []), *df.schema.fields]}
    whole = T.StructType(list(fields.values()))
    if whole != known:
        df.sparkSession.createDataFrame([(whole.json(),)], "value STRING").coalesce(1).write.mode("overwrite").text(f"{path}/_schema")


def cold_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The kept schema of a cold tier; None if there is none."""
    if not _exists(spark, f"{path}/_schema"):
        return None
    return T.StructType.fromJson(json.loads(spark.read.text(f"{path}/_schema").first()["value"]))


def read_cold(spark: SparkSession, path: str) -> DataFrame:
    """The cold tier with its partition columns; files are opened only as the query needs them."""
    schema = cold_schema(spark, path)
    return spark.read.json(path) if schema is None else spark.read.schema(schema).json(path)


def read_range(spark: SparkSession, paths: Mapping[str, str], start: datetime.datetime, end: datetime.datetime, now: datetime.datetime) -> DataFrame:
    """Rows of ``[start, end]`` from the tiers that can hold them, with filters on their partition columns.

    ``paths`` names the folders of the tiers (``hot``, ``warm``, ``cold``); a tier that the range does not
    touch is not listed. Columns that a tier lacks are NULL.
    """
    hot, warm = (datetime.timedelta(seconds=span_seconds(x, m="month")) for x in (HOT, WARM))
    needed = {"hot": end >= now - hot, "warm": start < now - hot and end >= now - warm, "cold": start < now - warm}
    first, last = start.date(), end.date()
    parts = []
    for tier in (t for t, wanted in needed.items() if wanted and t in paths):
        table = read_cold(spark, paths[tier]) if tier == "cold" else spark.read.parquet(paths[tier])
        if tier == "hot":
            table = table.where(F.col("event_date").between(first, last)).drop("event_date")
        elif tier == "warm":
            table = table.where(F.col("event_month").between(f"{first:%Y-%m}", f"{last:%Y-%m}")).drop("event_month")
        else:
            days = F.col("year") * 10_000 + F.col("month").cast("int") * 100 + F.col("day").cast("int")
            table = table.where(days.between(int(f"{first:%Y%m%d}"), int(f"{last:%Y%m%d}"))).drop("year", "month", "day")
            table = table.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        parts.append(table.where(F.col("timestamp").between(start, end)))
    if not parts:
        raise ValueError("no tier of the given paths holds this range")
    return union_tiers(*parts)


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop path and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    folder, store = _store(spark, path)
    return store.exists(folder)


def partitions(spark: SparkSession, path: str) -> list[tuple[str, datetime.date, datetime.date]]:
    """Partition folders of a daily, monthly or ``year/month/day`` table, each with its first day and the day after its last.

    Only folder names are listed, on any Hadoop file system.
    """
    found = []

    def visit(below: str, values: dict[str, str]) -> None:
        folder, store = _store(spark, f"{path}/{below}" if below else path)
        for status in store.listStatus(folder) if store.exists(folder) else []:
            name = status.getPath().getName()
            key, eq, value = name.partition("=")
            if not status.isDirectory() or not eq or not value[:1].isdigit():
                continue
            here, got = f"{below}/{name}" if below else name, values | {key: value}
            if key == "event_date":
                day = datetime.date.fromisoformat(value)
                found.append((here, day, day + datetime.timedelta(days=1)))
            elif key == "event_month":
                first = datetime.date.fromisoformat(f"{value}-01")
                found.append((here, first, (first + datetime.timedelta(days=31)).replace(day=1)))
            elif key == "day":
                day = datetime.date(int(got["year"]), int(got["month"]), int(value))
                found.append((here, day, day + datetime.timedelta(days=1)))
            elif key in ("year", "month"):
                visit(here, got)

    visit("", {})
    return sorted(found)


def expire(spark: SparkSession, path: str, before: datetime.datetime, *, ts: str = "timestamp") -> dict[str, list[str]]:
    """Remove the rows of a tier table up to ``before``: whole partitions are dropped, the one it cuts is rewritten.

    Works on all three layouts. The rewritten partition is staged and replaces the old one when it is complete, so a
    lost run leaves the old rows and can be repeated.
    """
    done: dict[str, list[str]] = {"dropped": [], "rewritten": []}
    for name, first, end in partitions(spark, path):
        cut = datetime.datetime.combine(first, datetime.time()) <= before
        if not cut:
            continue
        whole = datetime.datetime.combine(end, datetime.time()) <= before
        if not whole:
            keys = dict(k.split("=") for k in name.split("/"))
            cold = "year" in keys
            table = read_cold(spark, path) if cold else spark.read.parquet(path)
            if cold:
                table = table.withColumns({"month": F.lpad(F.col("month").cast("string"), 2, "0"), "day": F.lpad(F.col("day").cast("string"), 2, "0")})
            held = table.where(F.lit(True))
            for key, value in keys.items():
                held = held.where(F.col(key) == (int(value) if key == "year" else value))
            held = held.where(F.col(ts) > F.lit(before))
            whole = held.isEmpty()
            if not whole:
                writer = held.repartition(F.hour(ts)).sortWithinPartitions(ts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**EXACT_TIMES).partitionBy(*keys)
                (writer.json if cold else writer.parquet)(path)
                done["rewritten"].append(name)
        if whole:
            folder, store = _store(spark, f"{path}/{name}")
            store.delete(folder, True)
            done["dropped"].append(name)
    return done


def drop_days_before(spark: SparkSession, path: str, first_day: datetime.date) -> list[str]:
    """Delete the daily or monthly partitions that end before ``first_day`` and return their names."""
    gone = [name for name, _, end in partitions(spark, path) if end <= first_day]
    for name in gone:
        folder, store = _store(spark, f"{path}/{name}")
        store.delete(folder, True)
    return gone


def overwrite_days(df: DataFrame, path: str) -> None:
    """Replace only the partitions present in ``df`` (late-data repair, retention)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
