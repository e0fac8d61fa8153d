"""Order-dependent operators that stay distributed when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sends a hot key to one task. Here every key is cut along its
order column into chunks: running values are computed inside ``(key, chunk)`` and the totals of
all earlier chunks are carried in from a small per-chunk summary. The results are the same as
those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.session import cut_lineage

ALL = "__all"


def micros(col: Column) -> Column:
    """Epoch microseconds of a timestamp of either kind."""
    return F.unix_micros(col.cast("timestamp"))


def from_micros(col: Column, like: T.DataType) -> Column:
    return F.timestamp_micros(col).cast(like)


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def time_chunk(ts: Column, seconds: int) -> Column:
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def running(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    specs: Mapping[str, tuple[str, Column]],
    *,
    peers: bool = False,
) -> DataFrame:
    """Add running values over ``order`` within ``keys``.

    ``specs`` maps an output name to ``(kind, expression)`` with kind ``sum``, ``max``, ``last``
    (skips nulls) or ``max_before`` (the maximum of the earlier rows only). ``chunk`` is a column
    that never decreases along ``order``. Rows with a null key form no group and are left out.
    ``peers`` includes rows with equal order values (a RANGE frame).
    """
    part = [*keys, chunk]
    ordered = Window.partitionBy(*part).orderBy(*order)
    begin, here = Window.unboundedPreceding, Window.currentRow
    frame = ordered.rangeBetween(begin, here) if peers else ordered.rowsBetween(begin, here)
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(begin, -1)
    position = F.struct(*order)

    summary, carry, local, final = [], [], {}, {}
    for name, (kind, expr) in specs.items():
        total, before = f"__{name}_total", f"__{name}_before"
        if kind == "sum":
            summary.append(F.sum(expr).alias(total))
            carry.append(F.sum(total).over(earlier).alias(before))
            local[name] = F.sum(expr).over(frame)
            final[name] = F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(before), F.lit(0))
        elif kind == "max":
            summary.append(F.max(expr).alias(total))
            carry.append(F.max(total).over(earlier).alias(before))
            local[name] = F.max(expr).over(frame)
            final[name] = F.greatest(F.col(name), F.col(before))
        elif kind == "max_before":
            summary.append(F.max(expr).alias(total))
            carry.append(F.max(total).over(earlier).alias(before))
            local[name] = F.max(expr).over(ordered.rowsBetween(begin, -1))
            final[name] = F.greatest(F.col(name), F.col(before))
        elif kind == "last":
            summary.append(F.max_by(expr, F.when(expr.isNotNull(), position)).alias(total))
            carry.append(F.last(total, ignorenulls=True).over(earlier).alias(before))
            local[name] = F.last(expr, ignorenulls=True).over(frame)
            final[name] = F.coalesce(F.col(name), F.col(before))
        else:
            raise ValueError(f"unknown running kind {kind!r}")

    carried = df.groupBy(*part).agg(*summary).select(*part, *carry)
    # Inner, so that both sides get the same derived filters and share one shuffle of the rows.
    out = df.withColumns(local).join(carried, part).withColumns(final)
    return out.select(*df.columns, *specs)


def row_numbers(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], name: str) -> DataFrame:
    """1-based position within ``keys``."""
    return running(df, keys, chunk, order, {name: ("sum", F.lit(1).cast("bigint"))})


def with_lookback(df: DataFrame, keys: Sequence[str], position: str, rows: int, chunk_rows: int) -> DataFrame:
    """Split positions into chunks and repeat the last ``rows`` rows of each in the next one.

    Adds ``__part`` (the chunk) and ``__own`` (false for a repeated row), so that a ROWS frame
    reaching ``rows`` back can run inside ``(keys, __part)``.
    """
    if chunk_rows < rows:
        raise ValueError("chunk_rows must be at least the look-back")
    zero_based = F.col(position) - 1
    home = F.floor(zero_based / chunk_rows).cast("bigint")
    tail = zero_based % chunk_rows >= chunk_rows - rows
    copies = F.array_compact(
        F.array(
            F.struct(home.alias("__part"), F.lit(True).alias("__own")),
            F.when(tail, F.struct((home + 1).alias("__part"), F.lit(False).alias("__own"))),
        )
    )
    return df.withColumn("__copy", F.explode(copies)).select(*df.columns, "__copy.*")


def sessions(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int, *, chunk_seconds: int = 86400) -> DataFrame:
    """Runs of instants at most ``gap`` apart: start, end and row count per run.

    Rows are counted per instant first, so repeated rows of one instant never gather in a task.
    """
    kind = type_of(df, ts)
    us, start = F.col("__us"), F.col("__start")
    ticks = df.groupBy(*keys, micros(F.col(ts)).alias("__us")).agg(F.count(F.lit(1)).alias("__rows"))
    # Read four times below, so the per-instant rows are written once to the shared folder.
    ticks = cut_lineage(ticks.withColumn("__chunk", F.floor(us / (chunk_seconds * 1_000_000)).cast("bigint")))
    linked = running(ticks, keys, "__chunk", ["__us"], {"__before": ("max_before", us)})
    opens = F.col("__before").isNull() | (us - F.col("__before") > gap_seconds * 1_000_000)
    begun = running(linked, keys, "__chunk", ["__us"], {"__start": ("max", F.when(opens, us))})
    return begun.groupBy(*keys, "__start").agg(F.max("__us").alias("__end"), F.sum("__rows").alias("n")).select(
        *keys, from_micros(start, kind).alias("starts_at"), from_micros(F.col("__end"), kind).alias("last_seen"), "n"
    )


def rolling_count(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    window_seconds: int,
    *,
    weight: Column | None = None,
    chunk_seconds: int = 60,
    name: str = "window_count",
    at: str = "n",
) -> DataFrame:
    """Rows in ``(t - window, t]`` at every distinct ``(keys, t)``; the old end is open.

    Rows are first counted per instant. Each instant then adds its count at ``t`` and takes it
    away at ``t + window``, which turns the sliding count into a running sum.
    """
    kind = type_of(df, ts)
    weight = F.lit(1).cast("bigint") if weight is None else weight
    part = list(keys) or [ALL]
    base = df if keys else df.withColumn(ALL, F.lit(0))
    ticks = base.groupBy(*part, micros(F.col(ts)).alias("__us")).agg(F.sum(weight).alias(at))
    span = window_seconds * 1_000_000
    steps = ticks.select(
        *part,
        F.explode(
            F.array(
                F.struct(F.col("__us"), F.col(at).alias("__step"), F.col(at)),
                F.struct((F.col("__us") + span).alias("__us"), (-F.col(at)).alias("__step"), (F.col(at) * 0).alias(at)),
            )
        ).alias("s"),
    ).select(*part, "s.*")
    chunked = steps.withColumn("__chunk", F.floor(F.col("__us") / (chunk_seconds * 1_000_000)).cast("bigint"))
    totals = running(chunked, part, "__chunk", ["__us"], {name: ("sum", F.col("__step"))}, peers=True)
    return totals.where(F.col(at) > 0).select(*keys, from_micros(F.col("__us"), kind).alias(ts), at, name)


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, permille: Mapping[str, int], *, count: str = "n", weight: str | None = None
) -> DataFrame:
    """Exact nearest-rank percentiles: element ``ceil(p * n)`` of the sorted values.

    Values are counted per distinct value, then per coarse value band. The band totals say which
    band holds each rank, so only those bands are ever sorted. ``permille`` maps an output name
    to a rank in thousandths; ranks are computed in integers. ``weight`` names a column that holds
    how many rows a row stands for.
    """
    part = list(keys) or [ALL]
    base = df if keys else df.withColumn(ALL, F.lit(0))
    magnitude = F.floor(F.log1p(F.abs(F.col(value).cast("double"))) / F.log(F.lit(1.02)))
    band = (F.signum(F.col(value).cast("double")) * magnitude).cast("bigint")
    freq = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)).otherwise(0)) if weight else F.count(value)
    # Nulls are dropped by their zero count, after the aggregate: a filter before it would repeat
    # the value expression, which may be a costly parse.
    counted = base.groupBy(*part, value).agg(freq.alias("__freq"), F.max(band).alias("__band"))
    counted = counted.where(F.col("__freq") > 0)

    whole = Window.partitionBy(*part)
    upto = whole.orderBy("__band").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bands = (
        counted.groupBy(*part, "__band")
        .agg(F.sum("__freq").alias("__bn"))
        .select(*part, "__band", "__bn", F.sum("__bn").over(upto).alias("__upto"), F.sum("__bn").over(whole).alias(count))
    )
    ranks = {name: F.floor((F.col(count) * p + 999) / 1000).cast("bigint") for name, p in permille.items()}
    first = F.col("__upto") - F.col("__bn")
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | ((rank > first) & (rank <= F.col("__upto")))
    hits = bands.where(wanted).select(*part, "__band", first.alias("__first"), count)

    inside = Window.partitionBy(*part, "__band").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.join(hits, [*part, "__band"]).withColumn("__cum", F.col("__first") + F.sum("__freq").over(inside))
    picks = [
        F.max(F.when((rank <= F.col("__cum")) & (rank > F.col("__cum") - F.col("__freq")), F.col(value))).alias(name)
        for name, rank in ranks.items()
    ]
    return placed.groupBy(*part).agg(F.first(count).alias(count), *picks).select(*keys, count, *permille)
