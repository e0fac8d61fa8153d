"""Mergeable moments of a series: count, mean, spread and trend from segments, in batch or as they arrive.

A segment is a stretch of rows of one series: count ``n``, ``mean``, ``m2`` (squared deviations from its mean) and
``cross`` (sum of row number deviation times value deviation, rows numbered inside the segment). Segments that follow
each other in time merge exactly: counts before a segment shift its row numbers, and the deviations between segment means are
added. So baselines of any range of segments need no values, and an arriving segment changes no earlier one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.anomaly import TREND_MIN_ROWS
from logspark.operators.metrics import truncated

FIELDS = ("n", "mean", "m2", "cross")


def segments(metrics: DataFrame, keys: Sequence[str] = ("name",), *, order: Sequence[str] = ("ts", "service"), value: str = "value", unit: str = "hour") -> DataFrame:
    """``(*keys, segment, n, mean, m2, cross)``: one segment per series and ``unit`` of the first order column.

    Choose a unit whose rows of one series fit a task. Null values are left out.
    """
    at = truncated(metrics, order[0], unit)
    rows = metrics.where(F.col(value).isNotNull() & F.col(order[0]).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("__x"), at.alias("segment"))
    numbered = rows.withColumn("__i", F.row_number().over(Window.partitionBy(*keys, "segment").orderBy(*order)))
    return numbered.groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__x").alias("mean"),
        (F.var_pop("__x") * F.count(F.lit(1))).alias("m2"),
        (F.covar_pop("__i", "__x") * F.count(F.lit(1))).alias("cross"),
    )


def merged(parts: DataFrame, keys: Sequence[str] = ("name",), *, order: Sequence[str] = ("segment",)) -> DataFrame:
    """One row per series with the moments of all its segments, taken one after the other by ``order``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    n = F.col("n").cast("double")
    placed = parts.withColumns(
        {
            "__middle": F.coalesce(F.sum("n").over(before), F.lit(0)) + (n + 1) / 2,
            "__n": F.sum("n").over(whole),
            "__mean": F.sum(n * F.col("mean")).over(whole) / F.sum("n").over(whole),
        }
    )
    off, lag = F.col("mean") - F.col("__mean"), F.col("__middle") - (F.col("__n") + 1) / 2
    return placed.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.first("__mean").alias("mean"),
        F.sum(F.col("m2") + n * off * off).alias("m2"),
        F.sum(F.col("cross") + n * lag * off).alias("cross"),
    )


def stats(moments: DataFrame, keys: Sequence[str] = ("name",)) -> DataFrame:
    """Count, mean, population deviation and trend (slope per row, from ten rows on) of merged moments."""
    n = F.col("n").cast("double")
    rows: Column = n * (n * n - 1) / 12  # squared deviations of the numbers 1 to n
    return moments.select(
        *keys, "n", "mean", F.sqrt(F.greatest(F.col("m2"), F.lit(0.0)) / n).alias("std"),
        F.when(F.col("n") >= TREND_MIN_ROWS, F.col("cross") / rows).otherwise(0.0).alias("trend"),
    )
