"""Terms, histograms, facets, rates and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.metrics import count_if, is_error, truncated
from logspark.operators.ordered import type_of

# Default facet fields and sizes.
FACET_FIELDS = ("level", "service", "environment", "status_code")
TOP = 10


def terms(df: DataFrame, field: str, *, size: int = TOP) -> DataFrame:
    """Top values of a field by count; missing values do not count; ties by value."""
    return (
        df.where(F.col(field).isNotNull())
        .groupBy(F.col(field).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("value"))
        .limit(size)
    )


def date_histogram(df: DataFrame, unit: str, *, ts: str = "timestamp", week_start: str = "monday") -> DataFrame:
    """Count per calendar unit; empty units are left out."""
    bucket = truncated(df, ts, unit)
    if unit == "week" and week_start == "sunday":
        day = F.make_dt_interval(F.lit(1))
        bucket = (F.date_trunc("week", F.col(ts) + day) - day).cast(type_of(df, ts))
    return df.where(F.col(ts).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def facets(df: DataFrame, fields: Sequence[str] = FACET_FIELDS, *, size: int | None = TOP) -> DataFrame:
    """Value counts of several fields over all matches, in one pass; ``size=None`` keeps every value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    counts = (
        df.select(F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy("p.field", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if size is None:
        return counts
    best = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("value"))
    return counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)


def volume_rate(df: DataFrame, *, width: str = "5 minutes", seconds: int = 300, ts: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """Records and records per second in tumbling windows."""
    return (
        df.groupBy(F.window(ts, width).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("bucket"), *by, "n", (F.col("n") / F.lit(float(seconds))).alias("rate"))
    )


def error_ratio(df: DataFrame, *, width: str = "5 minutes", ts: str = "timestamp", by: Sequence[str] = ()) -> DataFrame:
    """Share of ERROR and FATAL records in tumbling windows."""
    return (
        df.groupBy(F.window(ts, width).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"), count_if(is_error()).alias("errors"))
        .select(F.col("w.start").alias("bucket"), *by, "n", "errors", (F.col("errors") / F.col("n")).alias("ratio"))
    )


def top_services(df: DataFrame, *, k: int = TOP, width: str = "5 minutes", seconds: int = 300, ts: str = "timestamp") -> DataFrame:
    """Top services by log rate in each window."""
    rates = volume_rate(df, width=width, seconds=seconds, ts=ts, by=["service"])
    best = Window.partitionBy("bucket").orderBy(F.col("n").desc(), F.col("service"))
    return rates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def availability(df: DataFrame, *, up: str = "up", ts: str = "timestamp", unit: str = "hour") -> DataFrame:
    """Mean of a 0/1 up signal per service and hour."""
    return df.groupBy(truncated(df, ts, unit).alias("bucket"), "service").agg(
        F.avg(F.col(up).cast("double")).alias("availability"), F.count(F.lit(1)).alias("n")
    )


def search_with_aggs(df: DataFrame, *, terms_of: Sequence[str] = (), histogram: str | None = None, size: int = TOP) -> DataFrame:
    """Aggregations of a search result as long rows ``(agg, value, n)``: terms per field and one date histogram."""
    parts = []
    if terms_of:
        parts.append(facets(df, terms_of, size=size).select(F.concat(F.lit("terms:"), "field").alias("agg"), "value", "n"))
    if histogram:
        h = date_histogram(df, histogram)
        parts.append(h.select(F.lit(f"date_histogram:{histogram}").alias("agg"), F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("value"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
