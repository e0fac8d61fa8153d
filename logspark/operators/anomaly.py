"""Thresholds, spikes, rare patterns, bursts, baselines and bands."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.functions.timefx import as_of_or_latest, hour, seconds_before, weekday
from logspark.operators.metrics import truncated
from logspark.operators.ordered import nearest_rank, rolling_count, row_numbers, time_chunk, with_lookback
from logspark.schema import literal_table
from logspark.session import cut_lineage

# Detector settings.
SENSITIVITY = 0.95
SPIKE_ROWS = 10
SPIKE_Z = 3.0
SPIKE_FULL_CONFIDENCE_Z = 5.0
RARE_BELOW = 5
BURST_ABOVE = 5
BURST_SECONDS = 300
BASELINE_DAYS = 7
TREND_MIN_ROWS = 10
BAND_STD = 2.0
DROP_SHARE = 0.3
THRESHOLDS = {"error_rate": 0.05, "latency_p95": 1000.0}
CONFIDENCE = {"rare_log_pattern": 0.7, "cluster_outlier": 0.8, "error_burst": 0.9}
# Parts of a message that vary, and their placeholders. Numbers come last; replacing
# them first would leave no address or identifier to find.
PLACEHOLDERS = (
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("UUID", r"(?i)[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"),
    ("IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("NUM", r"\d+"),
)

ANOMALY_COLUMNS = ("type", "metric", "service", "value", "confidence", "ts", "algorithm")


def default_thresholds(spark: SparkSession) -> DataFrame:
    return literal_table(spark, THRESHOLDS.items(), "name STRING, threshold DOUBLE")


def threshold_anomalies(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metric values above their static threshold; metric names share one spelling. From zero down a threshold gives confidence 1."""
    return metrics.join(thresholds, "name").where(F.col("value") > F.col("threshold")).select(
        F.lit("threshold").alias("type"),
        F.col("name").alias("metric"),
        "service",
        "value",
        "threshold",
        F.when(F.col("threshold") > 0, F.least(F.lit(1.0), F.try_divide("value", "threshold"))).otherwise(1.0).alias("confidence"),
        "ts",
        F.lit("statistical").alias("algorithm"),
    )


def zscore_spikes(
    series: DataFrame,
    keys: Sequence[str],
    *,
    ts: str = "ts",
    tie: str = "seq",
    value: str = "value",
    rows: int = SPIKE_ROWS,
    limit: float = SPIKE_Z,
    max_age_seconds: int | None = 3600,
    chunk_seconds: int = 3600,
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Values more than ``limit`` deviations from the mean of the ``rows`` values before them.

    The current value is left out of its own window (inside it, ten values can never exceed 3).
    All earlier values must be younger than ``max_age_seconds``. A zero deviation divides by 1.
    """
    chunked = series.where(F.col(value).isNotNull()).select(*keys, ts, tie, value).withColumn("__chunk", time_chunk(F.col(ts), chunk_seconds))
    numbered = row_numbers(chunked, keys, "__chunk", [ts, tie], "__rn").drop("__chunk")
    split = with_lookback(numbered, keys, "__rn", rows, max(chunk_rows, rows))
    before = Window.partitionBy(*keys, "__part").orderBy("__rn").rowsBetween(-rows, -1)
    seen = split.withColumns(
        {
            "__n": F.count(F.lit(1)).over(before),
            "baseline": F.avg(value).over(before),
            "__std": F.stddev_pop(value).over(before),
            "__oldest": F.min(ts).over(before),
        }
    )
    fresh = F.lit(True) if max_age_seconds is None else F.col("__oldest") > seconds_before(F.col(ts), max_age_seconds)
    z = F.abs(F.col(value) - F.col("baseline")) / F.when(F.col("__std") == 0, 1.0).otherwise(F.col("__std"))
    return (
        seen.where(F.col("__own") & (F.col("__n") == rows) & fresh)
        .withColumn("z_score", z)
        .where(F.col("z_score") > limit)
        .select(
            *keys, ts, tie, value, "baseline", "z_score",
            F.least(F.lit(1.0), F.col("z_score") / SPIKE_FULL_CONFIDENCE_Z).alias("confidence"),
        )
    )


def signature(message: Column) -> Column:
    """Message with its variable parts replaced by placeholders."""
    out = message
    for name, pattern in PLACEHOLDERS:
        out = F.regexp_replace(out, pattern, name)
    return out


def pattern_counts(logs: DataFrame, *, message: str = "message", by: Sequence[str] = ()) -> DataFrame:
    """Message templates with count and time range."""
    return logs.groupBy(signature(F.col(message)).alias("pattern"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen")
    )


def rare_patterns(logs: DataFrame, *, message: str = "message", ts: str = "timestamp", tie: str = "id", below: int = RARE_BELOW) -> DataFrame:
    """Records whose pattern was seen fewer than ``below`` times before them.

    The rank limit is applied per task before the shuffle, so a frequent pattern moves few rows.
    """
    marked = logs.select(tie, ts, signature(F.col(message)).alias("pattern"))
    order = Window.partitionBy("pattern").orderBy(ts, tie)
    return (
        marked.withColumn("occurrence", F.row_number().over(order))
        .where(F.col("occurrence") <= below)
        .withColumn("confidence", F.lit(CONFIDENCE["rare_log_pattern"]))
    )


def error_bursts(
    logs: DataFrame,
    *,
    by: Sequence[str] = ("service",),
    ts: str = "timestamp",
    window_seconds: int = BURST_SECONDS,
    above: int = BURST_ABOVE,
    chunk_seconds: int = 60,
) -> DataFrame:
    """Instants with more than ``above`` errors in the trailing window, the current ones included."""
    errors = logs.where(F.col("level") == "ERROR")
    counts = rolling_count(errors, by, ts, window_seconds, chunk_seconds=chunk_seconds, name="errors_in_window", at="errors")
    return counts.where(F.col("errors_in_window") > above)


def _retained(metrics: DataFrame, as_of: Any, days: int | None) -> DataFrame:
    if days is None:
        return metrics
    now = as_of_or_latest(metrics, "ts", as_of)
    return metrics.where(F.col("ts") > seconds_before(now, days * 86400))


def baseline_stats(
    metrics: DataFrame,
    keys: Sequence[str] = ("name",),
    *,
    order: Sequence[str] = ("ts", "service"),
    as_of: Any = None,
    days: int | None = BASELINE_DAYS,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """Mean, population deviation, count and trend (slope per row, from ten rows on) of the retained values."""
    kept = _retained(metrics, as_of, days).withColumn("__chunk", time_chunk(F.col("ts"), chunk_seconds))
    numbered = row_numbers(kept, keys, "__chunk", list(order), "__rn")
    return numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.regr_slope("value", "__rn").alias("slope"),
    ).select(*keys, "n", "mean", "std", F.when(F.col("n") >= TREND_MIN_ROWS, F.col("slope")).otherwise(0.0).alias("trend"))


def baseline_means(metrics: DataFrame, keys: Sequence[str] = ("name",), *, as_of: Any = None, days: int | None = BASELINE_DAYS) -> DataFrame:
    """Mean and deviation only; one partial aggregation, no ordering."""
    return _retained(metrics, as_of, days).groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def seasonality(metrics: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Sum and count per hour of day and per weekday (Sunday 0), as rows ``(.., cycle, slot, sum, count)``."""
    cycles = F.array(
        F.struct(F.lit("hourly").alias("cycle"), hour(F.col("ts")).alias("slot")),
        F.struct(F.lit("daily").alias("cycle"), weekday(F.col("ts")).alias("slot")),
    )
    return metrics.select(*keys, "value", F.explode(cycles).alias("c")).groupBy(*keys, "c.cycle", "c.slot").agg(
        F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count")
    )


def expected_band(metrics: DataFrame, keys: Sequence[str] = ("name",), *, as_of: Any = None, days: int | None = BASELINE_DAYS) -> DataFrame:
    """Expected value and band per hour of day: hourly mean ± 2 deviations, never below zero."""
    stats = baseline_means(metrics, keys, as_of=as_of, days=days)
    hours = seasonality(metrics, keys).where(F.col("cycle") == "hourly")
    centre = F.col("mean") + (F.col("sum") / F.col("count") - F.col("mean"))
    return hours.join(stats, list(keys)).select(
        *keys,
        F.col("slot").alias("hour"),
        centre.alias("expected"),
        "std",
        (centre + BAND_STD * F.col("std")).alias("upper"),
        F.greatest(F.lit(0.0), centre - BAND_STD * F.col("std")).alias("lower"),
    )


def band_breaches(metrics: DataFrame, keys: Sequence[str] = ("name",), *, as_of: Any = None, days: int | None = BASELINE_DAYS) -> DataFrame:
    """Metric values outside their expected band."""
    band = expected_band(metrics, keys, as_of=as_of, days=days).drop("std")
    return (
        metrics.withColumn("hour", hour(F.col("ts")))
        .join(band, [*keys, "hour"])
        .where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    )


def throughput_drop(
    logs: DataFrame, *, by: Sequence[str] = ("service",), unit: str = "hour", buckets: int = 24, share: float = DROP_SHARE
) -> DataFrame:
    """Buckets whose record count is at least ``share`` below the mean of the ``buckets`` counts before them.

    Buckets without records count 0 between a group's first bucket and the last one of all groups, so an
    outage fires and goes on to fire until its zeros fill the mean.
    """
    at = truncated(logs, "timestamp", unit)
    some = logs.where(at.isNotNull()).groupBy(*by, at.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    end = logs.agg(F.max(at)).scalar()
    every = F.explode(F.sequence(F.col("__first"), end, F.expr(f"INTERVAL 1 {unit}")))
    steps = some.groupBy(*by).agg(F.min("bucket").alias("__first")).select(*by, every.alias("bucket"))
    counts = steps.join(some, [*by, "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(-buckets, -1)
    return (
        counts.withColumns({"baseline": F.avg("n").over(before), "__seen": F.count(F.lit(1)).over(before)})
        .where((F.col("__seen") == buckets) & (F.col("n") <= (1 - share) * F.col("baseline")))
        .drop("__seen")
    )


def merge_anomalies(anomalies: DataFrame, *, sensitivity: float = SENSITIVITY) -> DataFrame:
    """One row per type, metric and minute: best confidence, hits, algorithms; weak ones are left out."""
    minute = truncated(anomalies, "ts", "minute")
    per_algorithm = anomalies.groupBy("type", "metric", minute.alias("minute"), "algorithm").agg(
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("hits")
    )
    return (
        per_algorithm.groupBy("type", "metric", "minute")
        .agg(
            F.max("confidence").alias("confidence"),
            F.sum("hits").alias("hits"),
            F.array_join(F.array_sort(F.collect_set("algorithm")), ",").alias("algorithms"),
        )
        .where(F.col("confidence") >= sensitivity)
    )


def recent_anomalies(anomalies: DataFrame, *, as_of: Any = None, hours: int = 24, limit: int = 10) -> DataFrame:
    """The newest anomalies of the last day."""
    now = as_of_or_latest(anomalies, "ts", as_of)
    kept = anomalies.where(F.col("ts") > seconds_before(now, hours * 3600))
    return kept.orderBy(F.col("ts").desc(), "type", "metric", "service").limit(limit)


def metric_vectors(metrics: DataFrame, names: Sequence[str], keys: Sequence[str] = ("ts", "service")) -> DataFrame:
    """Wide table with one column per metric; rows lacking a metric are left out."""
    return metrics.groupBy(*keys).pivot("name", list(names)).agg(F.max("value")).dropna(subset=list(names))


def fit_centres(vectors: DataFrame, columns: Sequence[str], *, k: int = 4, rounds: int = 50) -> tuple[list[float], list[float], list[list[float]]]:
    """Means, deviations and ``k`` cluster centres of standardised columns, by Lloyd's rounds.

    The start is fixed: centre i has the (i + 1/2) / k quantile of every column, by nearest rank. Figures are rounded to nine
    digits after each round, so the result doesn't depend on the layout of the data. Each round is one
    aggregation; only the centres reach the driver.
    """
    first = vectors.agg(F.array(*[F.avg(c) for c in columns]).alias("mean"), F.array(*[F.stddev_pop(c) for c in columns]).alias("std")).first()
    if first["mean"][0] is None:
        return [0.0] * len(columns), [1.0] * len(columns), [[0.0] * len(columns)] * k
    mean, std = [round(m, 9) for m in first["mean"]], [round(s, 9) or 1.0 for s in first["std"]]
    long = vectors.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "name", "value")
    ranks = nearest_rank(long, ["name"], "value", {f"q{i}": (2 * i + 1) * 500 // k for i in range(k)})
    start = {r["name"]: [r[f"q{i}"] for i in range(k)] for r in ranks.collect()}  # a row for each column
    centres = [[round((start[c][i] - m) / s, 9) for c, m, s in zip(columns, mean, std)] for i in range(k)]
    for _ in range(rounds):
        placed = with_cluster(vectors, columns, mean, std, centres)
        sums = placed.groupBy("cluster").agg(*[F.avg((F.col(c) - m) / s).alias(c) for c, m, s in zip(columns, mean, std)])
        moved = {r["cluster"]: [round(r[c], 9) for c in columns] for r in sums.collect()}
        new = [moved.get(i, centre) for i, centre in enumerate(centres)]
        if new == centres:
            break
        centres = new
    return mean, std, centres


def with_cluster(
    vectors: DataFrame, columns: Sequence[str], mean: Sequence[float], std: Sequence[float], centres: Sequence[Sequence[float]]
) -> DataFrame:
    """Add the nearest centre (the first of equal ones) and the distance to it, of standardised columns."""
    point = [(F.col(c) - m) / s for c, m, s in zip(columns, mean, std)]
    distance = lambda centre: F.sqrt(sum(((p - v) * (p - v) for p, v in zip(point, centre)), F.lit(0.0)))
    near = F.array_min(F.array(*[F.struct(F.round(distance(c), 9).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)]))
    return vectors.select("*", F.inline(F.array(near)))


def cluster_outliers(vectors: DataFrame, columns: Sequence[str], *, k: int = 4, deviations: float = 3.0) -> DataFrame:
    """Rows far from their cluster centre: distance above the cluster's mean + ``deviations`` · std."""
    held = cut_lineage(vectors)  # every round reads the vectors again
    placed = with_cluster(held, columns, *fit_centres(held, columns, k=k))
    spread = placed.groupBy("cluster").agg(F.avg("distance").alias("__mean"), F.stddev_pop("distance").alias("__std"))
    return (
        placed.join(spread, "cluster")
        .where(F.col("distance") > F.round(F.col("__mean") + deviations * F.col("__std"), 9))
        .select(*vectors.columns, "cluster", "distance", F.lit(CONFIDENCE["cluster_outlier"]).alias("confidence"))
    )


def mahalanobis_outliers(vectors: DataFrame, columns: Sequence[str], *, deviations: float = 3.0) -> DataFrame:
    """Rows whose Mahalanobis distance from the mean of all is above ``deviations``.

    One aggregation gives the means and the population covariances; the driver inverts the small matrix (a
    pseudo-inverse, so columns that depend on each other are fine), and the distance is a column expression. Rows with a
    null in one of the columns are left out.
    """
    known = vectors.dropna(subset=list(columns))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = known.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = sums[f"c{i}_{j}"] or 0.0
    inverse = np.linalg.pinv(cov, hermitian=True)
    off = [F.col(c) - F.lit(sums[f"m{i}"]) for i, c in enumerate(columns)]
    square = sum((float(inverse[i, j]) * (1 if i == j else 2) * off[i] * off[j] for i, j in pairs), F.lit(0.0))
    distance = F.sqrt(F.greatest(square, F.lit(0.0)))
    return known.withColumn("distance", distance).where(F.col("distance") > deviations).withColumn("confidence", F.lit(CONFIDENCE["cluster_outlier"]))
