"""Per-service latency and error figures, and metric tables derived from logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.ordered import nearest_rank, type_of

# Nearest-rank percentiles of the report, in thousandths.
PERCENTILES = {"p50": 500, "p90": 900, "p95": 950, "p99": 990}
# A service is healthy below both limits.
HEALTHY_ERROR_RATE = 0.05
HEALTHY_DURATION_MS = 1000.0
# Upper bounds of the latency histogram, in ms.
LATENCY_BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000)

UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def is_error(level: str = "level") -> Column:
    return F.col(level).isin("ERROR", "FATAL")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def truncated(df: DataFrame, ts: str, unit: str) -> Column:
    """``date_trunc`` that keeps the timestamp kind of the input column."""
    return F.date_trunc(unit, F.col(ts)).cast(type_of(df, ts))


def service_latency(logs: DataFrame, *, by: Sequence[str] = ("service",), value: str = "response_time") -> DataFrame:
    """Requests, errors, error rate, nearest-rank latencies and health per group."""
    known = logs.where(_known(by))
    volume = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), count_if(is_error()).alias("errors"), F.avg(value).alias("avg_ms")
    )
    ranks = nearest_rank(known, by, value, PERCENTILES, count="__n").drop("__n")
    rate = F.col("errors") / F.col("requests")
    return volume.join(ranks, list(by), "left").select(
        *by,
        "requests",
        "errors",
        rate.alias("error_rate"),
        *[F.coalesce(F.col(p).cast("double"), F.lit(0.0)).alias(p) for p in PERCENTILES],
        F.when((rate < HEALTHY_ERROR_RATE) & (F.col("avg_ms") < HEALTHY_DURATION_MS), "healthy")
        .otherwise("degraded")
        .alias("status"),
    )


def approximate_latency(logs: DataFrame, *, by: Sequence[str] = ("service",), value: str = "response_time", accuracy: int = 10000) -> DataFrame:
    """One-shuffle variant with mergeable sketches, for dashboards that tolerate a rank error of 1/accuracy."""
    return logs.groupBy(*by).agg(
        *[F.percentile_approx(value, p / 1000, accuracy).alias(name) for name, p in PERCENTILES.items()]
    )


def _known(columns: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return cond


def service_metrics(logs: DataFrame, *, unit: str = "hour") -> DataFrame:
    """Long metric table ``(ts, service, name, value)``: error_rate, latency_p95, throughput per bucket."""
    base = logs.where(_known(["service"])).select(
        truncated(logs, "timestamp", unit).alias("ts"), "service", "level", "response_time"
    )
    key = ["ts", "service"]
    volume = base.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("level") == "ERROR").alias("e"))
    p95 = nearest_rank(base, key, "response_time", {"latency_p95": 950}, count="__n").drop("__n")
    wide = volume.join(p95, key, "left").select(
        *key,
        (F.col("e") / F.col("n")).alias("error_rate"),
        F.col("latency_p95").cast("double").alias("latency_p95"),
        (F.col("n").cast("double") / UNIT_SECONDS[unit]).alias("throughput"),
    )
    return wide.unpivot(key, ["error_rate", "latency_p95", "throughput"], "name", "value").where(
        F.col("value").isNotNull()
    )


def log_metrics(logs: DataFrame) -> DataFrame:
    """Metric samples carried by single log records: latency_p95, error_rate (0/1), status_code; absent ones omitted."""
    latency = F.when(F.col("response_time") != 0, F.col("response_time").cast("double"))
    status = F.when(F.col("status_code") != 0, F.col("status_code").cast("double"))
    return (
        logs.select(
            "id",
            F.col("timestamp").alias("ts"),
            "service",
            latency.alias("latency_p95"),
            F.when(F.col("level") == "ERROR", 1.0).otherwise(0.0).alias("error_rate"),
            status.alias("status_code"),
        )
        .unpivot(["id", "ts", "service"], ["latency_p95", "error_rate", "status_code"], "name", "value")
        .where(F.col("value").isNotNull())
    )


def ingest_counts(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ingested records per label set."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(df: DataFrame, value: str, *, by: Sequence[str] = (), bounds: Sequence[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative histogram rows ``(.., le, count)``; the last bound is infinity."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        *[count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("binf")
    )
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("binf").alias("count")))
    return counts.select(*by, F.explode(F.array(*rows)).alias("h")).select(*by, "h.le", "h.count")


def histogram_quantile(histogram: DataFrame, q: float, *, by: Sequence[str] = ()) -> DataFrame:
    """Quantile by linear interpolation inside the bucket that holds the rank.

    A rank in the infinite bucket gives the highest finite bound.
    """
    bounds = F.array_sort(F.collect_list(F.struct("le", "count")))
    per_group = histogram.groupBy(*by).agg(bounds.alias("b"))
    total = F.element_at("b", -1)["count"]
    rank = F.lit(q) * total
    at = F.array_position(F.transform("b", lambda x: x["count"] >= F.col("rank")), True).cast("int")
    here = F.element_at("b", F.col("at"))
    below = F.when(F.col("at") > 1, F.try_element_at("b", F.col("at") - 1))
    low, low_n = F.coalesce(below["le"], F.lit(0.0)), F.coalesce(below["count"], F.lit(0))
    finite = low + (here["le"] - low) * (F.col("rank") - low_n) / (here["count"] - low_n)
    value = F.when(F.isnan(here["le"]) | (here["le"] == float("inf")), low).otherwise(finite)
    return (
        per_group.withColumn("rank", rank)
        .withColumn("at", at)
        .select(*by, total.alias("n"), F.when(total > 0, value).alias("quantile"))
    )
