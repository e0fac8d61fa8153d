"""Filters, full-text search, relevance, projection and paging over log tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.timefx import as_of_or_latest, seconds_before, span_seconds

# Result cap and default range of a search, page size limit of the entries report.
MAX_RESULTS = 10_000
DEFAULT_RANGE = "24h"
MAX_PAGE_SIZE = 500
# The partition column of daily tables.
DAY = "event_date"
# The quick ranges of the free search; anything else means 24 hours.
QUICK_RANGES = {"15m": 15 * 60, "1h": 3600, "24h": 86400}

OPERATORS = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
}


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equals(filters: Mapping[str, Any]) -> Column:
    """Field equality; a list value means IN."""
    return _all([F.col(f).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(f) == v for f, v in filters.items()])


def compare(field: str, op: str, value: Any) -> Column:
    """``> >= < <= = == != <>`` on one field (applied here, whereas a parsed comparison was lost before)."""
    return OPERATORS[op](F.col(field), value)


def time_between(start: Any, end: Any, *, ts: str = "timestamp", day: str | None = None) -> Column:
    """Closed interval on ``ts`` and, when ``day`` is given, on the partition column too."""
    conditions = []
    for bound, ge in ((start, True), (end, False)):
        if bound is None:
            continue
        value = bound if isinstance(bound, Column) else F.lit(bound)
        conditions.append(F.col(ts) >= value if ge else F.col(ts) <= value)
        if day:
            as_day = value.cast("date")
            conditions.append(F.col(day) >= as_day if ge else F.col(day) <= as_day)
    return _all(conditions)


def partition_of(df: DataFrame, day: str | None) -> str | None:
    """The partition column of a daily table, where the table has it; time ranges then prune whole days."""
    return day if day in df.columns else None


def within(df: DataFrame, span: str = DEFAULT_RANGE, *, as_of: Any = None, ts: str = "timestamp", day: str | None = DAY) -> DataFrame:
    """Rows of the last ``span`` (``24h 7d 1w 1m 1y``; here ``m`` is minutes) up to ``as_of``."""
    now = as_of_or_latest(df, ts, as_of)
    return df.where(time_between(seconds_before(now, span_seconds(span, m="minute")), now, ts=ts, day=partition_of(df, day)))


def has_all_words(text: str, *, field: str = "message") -> Column:
    """Every word of ``text`` occurs as a whole word of the field, in any order and case."""
    words = F.split(F.lower(F.col(field)), r"[^\p{L}\p{N}_]+")
    return _all([F.array_contains(words, w) for w in dict.fromkeys(re.findall(r"\w+", text.lower()))])


def contains_text(text: str, *, field: str = "message") -> Column:
    """Case-insensitive substring."""
    return F.lower(F.col(field)).contains(text.lower())


def matches(pattern: str, *, field: str = "message", ignore_case: bool = True) -> Column:
    return F.col(field).rlike(f"(?i){pattern}" if ignore_case else pattern)


def entries(
    df: DataFrame,
    *,
    level: str | None = None,
    endpoint: str | None = None,
    start: datetime | str | None = None,
    end: datetime | str | None = None,
    text: str | None = None,
    day: str | None = DAY,
) -> DataFrame:
    """The entries filter: level equal (upper-cased), endpoint contains, closed time range, message contains."""
    conditions = [time_between(start, end, day=partition_of(df, day))]
    if level:
        conditions.append(F.col("level") == level.upper())
    if endpoint:
        conditions.append(F.col("endpoint").contains(endpoint))
    if text:
        conditions.append(contains_text(text))
    return df.where(_all(conditions))


def quick_search(
    df: DataFrame, *, text: str | None = None, level: str | None = None, service: str | None = None, time_range: str | None = None, as_of: Any = None,
    day: str | None = DAY,
) -> DataFrame:
    """The free search: level equal, service contains, message contains, quick range."""
    conditions = []
    if level:
        conditions.append(F.col("level") == level)
    if service:
        conditions.append(F.col("service").contains(service))
    if text:
        conditions.append(contains_text(text))
    if time_range:
        now = as_of_or_latest(df, "timestamp", as_of)
        start = seconds_before(now, QUICK_RANGES.get(time_range, QUICK_RANGES["24h"]))
        conditions.append(time_between(start, None, day=partition_of(df, day)))
    return df.where(_all(conditions))


def fielded(
    df: DataFrame,
    *,
    fields: Mapping[str, Any] | None = None,
    comparisons: Sequence[tuple[str, str, Any]] = (),
    text: str | None = None,
    start: Any = None,
    end: Any = None,
    day: str | None = DAY,
) -> DataFrame:
    """Fielded search from arguments: equality or IN per field, comparisons, all words of ``text``, time range."""
    conditions = [equals(fields or {}), time_between(start, end, day=partition_of(df, day))]
    conditions += [compare(*c) for c in comparisons]
    if text:
        conditions.append(has_all_words(text))
    return df.where(_all(conditions))


def project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The named fields that exist."""
    return df.select(*[f for f in fields if f.split(".")[0] in df.columns])


def relevance(df: DataFrame, text: str, *, field: str = "message", name: str = "score") -> DataFrame:
    """Add the summed occurrences of every term of ``text``; terms are literal, not patterns."""
    terms = text.lower().split()
    low = F.lower(F.coalesce(F.col(field), F.lit("")))
    # Java and RE2 share this escaping of the special characters.
    quoted = [re.sub(r"([^\w\s])", r"\\\1", t, flags=re.ASCII) for t in terms]
    score = reduce(lambda a, b: a + b, [F.regexp_count(low, F.lit(q)) for q in quoted], F.lit(0))
    return df.withColumn(name, score.cast("bigint"))


def newest(df: DataFrame, *, ts: str = "timestamp", tie: str = "id", offset: int = 0, limit: int | None = MAX_RESULTS) -> DataFrame:
    """Newest first with a unique tie-break; ``limit=None`` gives all. Deep pages should use :func:`newest_after` instead."""
    ordered = df.orderBy(F.col(ts).desc(), F.col(tie)).offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def newest_after(
    df: DataFrame, last: tuple[Any, Any], *, ts: str = "timestamp", tie: str = "id", limit: int | None = MAX_RESULTS
) -> DataFrame:
    """Keyset paging: the page that follows the row ``(last_ts, last_tie)``; cost does not grow with depth."""
    last_ts, last_tie = F.lit(last[0]), F.lit(last[1])
    later = (F.col(ts) < last_ts) | ((F.col(ts) == last_ts) & (F.col(tie) > last_tie))
    return newest(df.where(later), ts=ts, tie=tie, limit=limit)


def page(df: DataFrame, number: int, size: int, *, ts: str = "timestamp", tie: str = "id", max_size: int | None = MAX_PAGE_SIZE) -> DataFrame:
    """One page with the total match count on every row; ``max_size=None`` lifts the page size limit."""
    size = min(size, max_size) if max_size else size
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return newest(df, ts=ts, tie=tie, offset=(number - 1) * size, limit=size).withColumn("total", total)
