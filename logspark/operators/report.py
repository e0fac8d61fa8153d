"""Performance report over raw text lines, requirement rows and recommendations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.text import with_line_figures
from logspark.operators.metrics import PERCENTILES, count_if
from logspark.operators.ordered import ALL, nearest_rank
from logspark.session import cut_lineage

# Targets of the report.
P95_TARGET_MS = 500
P99_TARGET_MS = 1000
ERROR_RATE_TARGET = 0.01
CPU_TARGET = 0.8
MEMORY_TARGET = 0.85
LOAD_TARGET = 1.0

SYSTEM = ("cpu", "memory", "load")


def performance_report(lines: DataFrame, line: str = "value", *, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: requests, errors, error rate, throughput, bytes, latency ranks, system averages.

    Requests are lines with a duration, errors are error lines; both follow the text patterns, so
    a line such as ``1500ms`` also counts as an error. Throughput assumes 50 lines per second over
    at least a minute. Empty lines are ignored.
    """
    part = list(by) or [ALL]
    base = lines.where(F.length(line) > 0)
    base = base if by else base.withColumn(ALL, F.lit(0))
    figures = with_line_figures(base.select(*part, line), line)
    seconds = F.greatest(F.lit(60), F.ceil(F.col("lines") / 50))
    # One row per distinct duration, written to the shared folder: the text is read and matched
    # once, although totals and ranks both need it.
    per_duration = cut_lineage(
        figures.groupBy(*part, "duration_ms").agg(
            F.count(F.lit(1)).alias("lines"),
            count_if(F.col("is_error")).alias("errors"),
            F.sum("bytes").alias("bytes"),
            *[agg(c).alias(f"{c}_{n}") for c in SYSTEM for n, agg in (("sum", F.sum), ("n", F.count))],
        )
    )
    volume = per_duration.groupBy(*part).agg(
        F.sum("lines").alias("lines"),
        F.coalesce(F.sum(F.when(F.col("duration_ms").isNotNull(), F.col("lines"))), F.lit(0)).alias("requests"),
        F.sum("errors").alias("errors"),
        F.coalesce(F.sum("bytes").try_cast("bigint"), F.lit(0)).alias("total_bytes"),
        *[(F.sum(f"{c}_sum") / F.sum(f"{c}_n")).alias(c) for c in SYSTEM],
    )
    ranks = nearest_rank(per_duration, part, "duration_ms", PERCENTILES, count="__n", weight="lines").drop("__n")
    return volume.join(ranks, part, "left").select(
        *by,
        "requests",
        "errors",
        F.when(F.col("requests") > 0, F.col("errors") / F.col("requests")).otherwise(0.0).alias("error_rate"),
        (F.col("requests") / seconds).alias("throughput_rps"),
        "total_bytes",
        *[F.coalesce(F.col(p), F.lit(0.0)).alias(p) for p in PERCENTILES],
        *SYSTEM,
    )


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def _percent(x: Column) -> Column:
    return _half_up(x * 100)


def nfr_rows(report: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Requirement against current value, one row each; capacity rows only when samples exist."""
    c = F.col
    row = lambda cat, need, now: F.struct(F.lit(cat).alias("category"), need.alias("requirement"), now.alias("current"))
    sustain = F.greatest(F.lit(1).cast("bigint"), _half_up(F.when(c("throughput_rps") == 0, 1.0).otherwise(c("throughput_rps")) * 1.5))
    rows = [
        row("Latency", F.lit(f"p95 <= {P95_TARGET_MS} ms; p99 <= {P99_TARGET_MS} ms"),
            F.format_string("p95=%d ms; p99=%d ms", _half_up(c("p95")), _half_up(c("p99")))),
        row("Reliability", F.lit(f"Error rate <= {ERROR_RATE_TARGET * 100:.2f}%"), F.format_string("Error rate %.2f%%", c("error_rate") * 100)),
        row("Throughput", F.format_string("Sustain >= %d RPS with SLO latency", sustain), F.format_string("%.2f RPS observed", c("throughput_rps"))),
        F.when(c("cpu").isNotNull(), row("Capacity", F.lit(f"Avg CPU <= {CPU_TARGET * 100:.0f}%"), F.format_string("Avg CPU %d%%", _percent(c("cpu"))))),
        F.when(c("memory").isNotNull(), row("Capacity", F.lit(f"Avg Memory <= {MEMORY_TARGET * 100:.0f}%"), F.format_string("Avg Memory %d%%", _percent(c("memory"))))),
    ]
    present = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return report.select(*by, F.posexplode(present).alias("i", "r")).select(*by, (c("i") + 1).alias("nfr"), "r.*")


def recommendations(report: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Advice for each figure beyond its target."""
    c = F.col
    # Texts of the report.
    rules = [
        F.when(c("p95") > P95_TARGET_MS, F.format_string(
            f"Improve p95 latency to <= {P95_TARGET_MS} ms (observed %d ms). Consider caching, DB indexing, or reducing external calls.", _half_up(c("p95")))),
        F.when(c("p99") > P99_TARGET_MS, F.lit(
            f"Reduce long-tail p99 latency to <= {P99_TARGET_MS} ms; investigate GC pauses, cold paths, and lock contention.")),
        F.when(c("error_rate") > ERROR_RATE_TARGET, F.format_string(
            f"Reduce error rate to <= {ERROR_RATE_TARGET * 100:.2f}%% (observed %.2f%%). Ensure retries, timeouts, circuit breakers.", c("error_rate") * 100)),
        F.when(c("cpu") > CPU_TARGET, F.format_string(
            f"CPU utilization high (%d%%). Plan capacity to keep avg CPU <= {CPU_TARGET * 100:.0f}%%.", _percent(c("cpu")))),
        F.when(c("memory") > MEMORY_TARGET, F.format_string(
            "Memory utilization high (%d%%). Tune heap sizes, fix leaks, or scale memory.", _percent(c("memory")))),
        F.when(c("load") > LOAD_TARGET, F.format_string(
            "System load average indicates saturation (%.2f). Increase concurrency limits or add capacity.", c("load"))),
    ]
    return report.select(*by, F.explode(F.array_compact(F.array(*rules))).alias("recommendation"))


def report_rows(report: DataFrame) -> DataFrame:
    """The report as ``(metric, value)`` rows in export order, requirement rows last."""
    c = F.col
    names = {
        "requests": c("requests"), "errors": c("errors"), "errorRate": c("error_rate"), "throughputRps": c("throughput_rps"),
        **{f"latency_{p}": c(p) for p in PERCENTILES},
        "system_cpuUtilization": c("cpu"), "system_memoryUtilization": c("memory"), "system_loadAverage": c("load"),
    }
    figures = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("metric"), F.coalesce(v.cast("string"), F.lit("")).alias("value")) for i, (n, v) in enumerate(names.items())])
    flat = report.select(F.explode(figures).alias("r")).select("r.*")
    needs = nfr_rows(report).select(
        (c("nfr") + len(names)).alias("i"),
        F.concat(F.lit("nfr_"), c("nfr").cast("string")).alias("metric"),
        F.concat_ws("", "category", F.lit(": "), "requirement", F.lit(" | "), "current").alias("value"),
    )
    return flat.unionByName(needs)
