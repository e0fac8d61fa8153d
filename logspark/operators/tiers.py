"""Age tiers, tier pruning, union of tiers, retention."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.timefx import as_of_or_latest, seconds_before, span_seconds
from logspark.operators.ordered import micros

# Tier ages, upper bound included; and the retention of each kind of table.
HOT = "7d"
WARM = "30d"
RETENTION = {"warm": "30d", "alerts": "24h", "services": "24h", "deployments": "7d", "anomalies": "24h"}


def _age_seconds(ts: Column, now: Column) -> Column:
    return (micros(now) - micros(ts)) / 1_000_000


def tier(ts: Column, now: Column, *, hot: str = HOT, warm: str = WARM) -> Column:
    age = _age_seconds(ts, now)
    return F.when(age <= span_seconds(hot, m="month"), "hot").when(age <= span_seconds(warm, m="month"), "warm").otherwise("cold")


def assign_tier(df: DataFrame, *, ts: str = "timestamp", as_of: Any = None, hot: str = HOT, warm: str = WARM) -> DataFrame:
    """Add ``tier`` by age and the ``event_date`` partition column (event day, not arrival day)."""
    now = as_of_or_latest(df, ts, as_of)
    return df.withColumns({"tier": tier(F.col(ts), now, hot=hot, warm=warm), "event_date": F.to_date(ts)})


def tiers_for(start: Column, end: Column, now: Column, *, hot: str = HOT, warm: str = WARM) -> Column:
    """Tiers whose age interval overlaps ``[start, end]``, hottest first (a long range includes the warm tier)."""
    hot_s, warm_s = span_seconds(hot, m="month"), span_seconds(warm, m="month")
    oldest, youngest = _age_seconds(start, now), _age_seconds(end, now)
    return F.array_compact(
        F.array(
            F.when(youngest <= hot_s, "hot"),
            F.when((oldest > hot_s) & (youngest <= warm_s), "warm"),
            F.when(oldest > warm_s, "cold"),
        )
    )


def union_tiers(*parts: DataFrame) -> DataFrame:
    """All rows of several tiers; columns a tier lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def tier_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def retain(df: DataFrame, kind: str, *, ts: str = "timestamp", as_of: Any = None, span: str | None = None) -> DataFrame:
    """Rows younger than the retention of ``kind``. ``files.expire`` does the same to a stored tier table."""
    now = as_of_or_latest(df, ts, as_of)
    return df.where(F.col(ts) > seconds_before(now, span_seconds(span or RETENTION[kind], m="month")))
