"""Clock, spans of time, timestamp parsing and calendar features."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds per unit. ``m`` is ambiguous and must be named by the caller.
SPAN_UNITS = {"s": 1, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}
M_UNITS = {"minute": 60, "month": 2592000}

# Accepted timestamp layouts in order, each with the shape of the texts it can read.
# The shape is tested first; a failed parse costs far more than a failed pattern.
OFFSET_LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?[+-]\d{4}$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]Z"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd'T'HH:mmXXX"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)? ?[+-]\d{4}$", "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS][ ]Z"),
    (r"^\d{1,2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$", "d/MMM/yyyy:HH:mm:ss Z"),
)
ZONE_LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?$", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?$", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}$", "yyyy-MM-dd HH:mm:ss,SSS"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
)
EPOCH_MILLIS = r"^\d{13}$"
HEADER_TIME = r"^[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}$"


#: Options that write JSON times with their microseconds.
EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def span_seconds(span: str, *, m: str) -> int:
    """``7d`` → seconds. Query ranges use ``m="minute"``; retention and SLO windows ``m="month"`` (30 days)."""
    found = re.fullmatch(r"(\d+)([shdwmy])", span)
    if not found:
        raise ValueError(f"not a time span: {span!r}")
    unit = M_UNITS[m] if found[2] == "m" else SPAN_UNITS[found[2]]
    return int(found[1]) * unit


def seconds_before(at: Column, seconds: float) -> Column:
    return at - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def seconds_after(at: Column, seconds: float) -> Column:
    return at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def as_of_or_latest(df: DataFrame, ts: str, as_of: Any = None) -> Column:
    """``as_of`` as a column; by default the latest timestamp of the data, as a scalar subquery.

    The subquery reads ``df`` once more; pass ``as_of`` when ``df`` is costly to compute.
    """
    if as_of is None:
        return df.agg(F.max(ts).alias("as_of")).scalar()
    return as_of if isinstance(as_of, Column) else F.lit(as_of)


def header_time(text: Column, as_of: Column) -> Column:
    """Month, day and time without a year: the latest year that is not more than a day after ``as_of``."""
    plain = F.regexp_replace(text, " +", " ")
    years = [F.concat((F.year(as_of) - back).cast("string"), F.lit(" "), plain) for back in (-1, 0, 1)]
    read = [F.try_to_timestamp(y, F.lit("yyyy MMM d HH:mm:ss")) for y in years]
    last = seconds_after(as_of.cast("timestamp"), 86400)
    return F.coalesce(*[F.when(text.rlike(HEADER_TIME) & (r <= last), r) for r in read])


def parse_timestamp(text: Column, *, zone: str | None = None, as_of: Column | None = None) -> Column:
    """First layout that fits, in UTC; NULL when none does (the caller quarantines it, it is not set to now).

    Texts without an offset are read in ``zone``. Texts without a year need ``as_of``.
    """
    read = lambda shape, layout: F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)))
    tries = [read(*x) for x in OFFSET_LAYOUTS]
    for x in ZONE_LAYOUTS:
        tries.append(F.to_utc_timestamp(read(*x), zone) if zone else read(*x))
    tries.append(F.when(text.rlike(EPOCH_MILLIS), F.timestamp_millis(text.try_cast("bigint"))))
    if as_of is not None:
        local = header_time(text, as_of)
        tries.append(F.to_utc_timestamp(local, zone) if zone else local)
    return F.coalesce(*tries)


def hour(ts: Column) -> Column:
    return F.hour(ts)


def weekday(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def is_weekend(ts: Column) -> Column:
    return F.dayofweek(ts).isin(1, 7)


def add_time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    c = F.col(ts)
    return df.withColumns({"hour": hour(c), "day_of_week": weekday(c), "is_weekend": is_weekend(c)})
