"""Join continuation lines (stack traces) to the line that opened them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.ordered import micros, running

# A start line names an error; a continuation line is indented.
START = r"(?i)Exception|Error|Caused by:|at\s+\w+\."
CONTINUATION = r"^\s+"
FLUSH_SECONDS = 5


def is_start(line: Column, custom: Sequence[str] = ()) -> Column:
    out = line.rlike(START)
    for pattern in custom:
        out = out | line.rlike(pattern)
    return out


def join_lines(
    df: DataFrame,
    *,
    line: str = "value",
    source: str = "source",
    order: str = "line_no",
    ts: str | None = None,
    custom_starts: Sequence[str] = (),
    chunk_lines: int = 100_000,
) -> DataFrame:
    """One row per entry: ``(source, line_no, value, lines)``.

    A start line opens an entry of its source; later indented lines belong to the last opened
    entry; all other lines stand alone. An indented start line opens only when its source has no
    entry yet. With ``ts`` an entry is flushed ``FLUSH_SECONDS`` after the time of its first line: an indented
    line from then on stands alone, and no entry holds more than the lines of those seconds.
    The last opener is carried from chunk to chunk, so a large source is not one task.
    Parse the result like any other line: joined entries get levels and redaction too.
    """
    c = F.col(line)
    flagged = df.where(F.col(source).isNotNull()).select(
        source, order, line, *([micros(F.col(ts)).alias("__at")] if ts else []), is_start(c, custom_starts).alias("__start"), c.rlike(CONTINUATION).alias("__more"),
        F.floor(F.col(order) / chunk_lines).cast("bigint").alias("__chunk"),
    )
    first = flagged.where("__start").groupBy(source).agg(F.min(order).alias("__first"))
    known = flagged.join(first, source, "left")
    opens = F.col("__start") & (~F.col("__more") | (F.col(order) == F.col("__first")))
    carried = {"__open": ("max", F.when(opens, F.col(order)))}
    belongs = F.col("__more") & F.col("__open").isNotNull()
    if ts:
        carried["__opened"] = ("last", F.when(opens, F.col("__at")))
        belongs = belongs & (F.col("__at") < F.col("__opened") + FLUSH_SECONDS * 1_000_000)
    held = running(known, [source], "__chunk", [order], carried)
    entry = F.when(belongs, F.col("__open")).otherwise(F.col(order))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), c.alias("text"))))
    return held.groupBy(source, entry.alias("__entry")).agg(pieces.alias("__pieces")).select(
        source, F.col("__entry").alias(order),
        F.array_join(F.transform("__pieces", lambda p: p["text"]), "\n").alias(line),
        F.size("__pieces").cast("bigint").alias("lines"),
    )
