"""Alert rules as table rows, alert state over time, grouping, routing, suppression and SLOs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.functions.levels import lookup
from logspark.functions.timefx import as_of_or_latest, span_seconds
from logspark.operators.metrics import count_if
from logspark.operators.ordered import from_micros, micros, rolling_count, running, sessions, type_of
from logspark.schema import literal_table
from logspark.session import cut_lineage

RULE_SCHEMA = (
    "rule_name STRING, metric STRING, op STRING, threshold DOUBLE, baseline_factor DOUBLE, severity STRING,"
    " description STRING, labels MAP<STRING,STRING>, enabled BOOLEAN"
)
# The default rules.
DEFAULT_RULES = [
    ("high_error_rate", "error_rate", ">", 0.05, None, "critical", "Error rate exceeded 5%", {}, True),
    ("high_latency_p95", "latency_p95", ">", 1000.0, None, "warning", "P95 latency exceeded 1000ms", {}, True),
    ("low_throughput", "throughput", "<", None, 0.5, "warning", "Throughput dropped below 50% of baseline", {}, True),
]
# Severity order, state windows, SLO defaults, runbook addresses.
SEVERITY_ORDER = {"info": 1, "warning": 2, "critical": 3}
DEDUP_SECONDS = 300
GROUPING_WINDOW = "10 minutes"
SLO_OBJECTIVE = 0.999
SLO_BURN_THRESHOLD = 2.0
SLO_CRITICAL_BURN = 10.0
SLO_WINDOW = "30d"
RUNBOOKS = {
    "high_error_rate": "https://runbooks.example.com/high-error-rate",
    "high_latency_p95": "https://runbooks.example.com/high-latency",
    "low_throughput": "https://runbooks.example.com/low-throughput",
}
GENERAL_RUNBOOK = "https://runbooks.example.com/general"
# Alert level to ticket and message attributes.
URGENCY = {"critical": "1", "error": "2", "warning": "3", "info": "4"}
IMPACT = {"critical": "1", "error": "2", "warning": "3", "info": "4"}
PRIORITY = {"critical": "Highest", "error": "High", "warning": "Medium", "info": "Low"}
CHAT_COLOUR = {"critical": "danger", "error": "danger", "warning": "warning", "info": "good"}
CARD_COLOUR = {"critical": "FF0000", "error": "FF6600", "warning": "FFCC00", "info": "00CC00"}
TICKET_LEVELS = ("critical", "error")


def default_rules(spark: SparkSession) -> DataFrame:
    return literal_table(spark, DEFAULT_RULES, RULE_SCHEMA)


def holds(value: Column, op: Column, limit: Column) -> Column:
    """Comparison named in a column; each operator means what it says (``>=`` once acted as ``>``)."""
    return (
        F.when(op == ">", value > limit)
        .when(op == "<", value < limit)
        .when(op == ">=", value >= limit)
        .when(op == "<=", value <= limit)
        .when(op.isin("=", "=="), value == limit)
        .when(op.isin("!=", "<>"), value != limit)
    )


def evaluate_rules(metrics: DataFrame, rules: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """Every metric value against every enabled rule on that metric, with ``fired``.

    Rules meet metrics by name. ``baselines(name[, service], mean)`` serve the rules with a
    ``baseline_factor``. A missing metric or baseline gives no alert.
    """
    active = rules.where("enabled").select(F.col("metric").alias("name"), "rule_name", "op", "threshold", "baseline_factor", "severity", "labels")
    joined = metrics.join(active, "name")
    if baselines is not None:
        keys = [c for c in ("name", "service") if c in baselines.columns]
        joined = joined.join(baselines.select(*keys, F.col("mean").alias("__mean")), keys, "left")
    else:
        joined = joined.withColumn("__mean", F.lit(None).cast("double"))
    limit = F.coalesce("threshold", F.col("baseline_factor") * F.col("__mean"))
    return joined.select(
        "rule_name", "severity", "labels", "service", "ts", "name", "value", limit.alias("limit"),
        F.coalesce(holds(F.col("value"), F.col("op"), limit), F.lit(False)).alias("fired"),
    )


def firings(metrics: DataFrame, rules: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    return evaluate_rules(metrics, rules, baselines).where("fired").drop("fired")


def alert_sessions(fired: DataFrame, *, keys: Sequence[str] = ("rule_name", "service"), gap_seconds: int = DEDUP_SECONDS) -> DataFrame:
    """Deduplicated alerts: firings of one key at most ``gap`` apart are one alert with a count."""
    return sessions(fired, keys, "ts", gap_seconds)


def alert_states(
    evaluated: DataFrame,
    *,
    keys: Sequence[str] = ("rule_name", "service"),
    hold_seconds: int = 0,
    step_seconds: int = 3600,
    chunk_seconds: int = 86400,
) -> DataFrame:
    """Alert islands: consecutive firing evaluations, kept when they last at least ``hold_seconds``.

    An island ends at the first evaluation that does not fire, or where the next evaluation is more than
    ``step_seconds`` (one evaluation interval) away: what was not evaluated does not count as held. Without
    such an end it is still firing.
    """
    kind = type_of(evaluated, "ts")
    us, quiet = F.col("__us"), ~F.col("fired")
    rows = evaluated.groupBy(*keys, micros(F.col("ts")).alias("__us")).agg(F.max("fired").alias("fired"), F.max("value").alias("value"))
    rows = cut_lineage(rows.withColumn("__chunk", F.floor(us / (chunk_seconds * 1_000_000)).cast("bigint")))
    linked = running(rows, keys, "__chunk", ["__us"], {"__before": ("max_before", us)})
    step = step_seconds * 1_000_000
    gap = F.coalesce(us - F.col("__before") > step, F.lit(False))
    # A quiet row closes the island before it and a gap opens a new one; a quiet row after a gap closes nothing.
    breaks = quiet.cast("bigint") + gap.cast("bigint")
    numbered = running(linked.withColumn("__gap", gap), keys, "__chunk", ["__us"], {"__quiet": ("sum", breaks)})
    island = F.when(quiet, F.col("__quiet") - 1).otherwise(F.col("__quiet"))
    newest = Window.partitionBy(*keys)
    grouped = numbered.groupBy(*keys, island.alias("__island")).agg(
        count_if(F.col("fired")).alias("n"),
        F.min(F.when(F.col("fired"), us)).alias("__start"),
        F.max(F.when(F.col("fired"), us)).alias("__last"),
        F.min(F.when(quiet, us)).alias("__quiet_at"),
        F.max(us).alias("__seen"),
    ).withColumn("__newest", F.max("__seen").over(newest))
    lapsed = F.when(F.col("__last") < F.col("__newest"), F.col("__last") + step)
    grouped = grouped.withColumn("__end", F.coalesce("__quiet_at", lapsed))
    held = (F.col("__last") - F.col("__start")) / 1_000_000 + step_seconds
    return grouped.where((F.col("n") > 0) & (held >= hold_seconds)).select(
        *keys,
        from_micros(F.col("__start"), kind).alias("starts_at"),
        from_micros(F.col("__last"), kind).alias("last_seen"),
        from_micros(F.col("__end"), kind).alias("ends_at"),
        "n",
        F.when(F.col("__end").isNull(), "firing").otherwise("resolved").alias("status"),
    )


def severity_rank(severity: Column) -> Column:
    return lookup(SEVERITY_ORDER, severity, 0)


def alert_groups(alerts: DataFrame, *, width: str = GROUPING_WINDOW, ts: str = "ts") -> DataFrame:
    """Groups of more than one alert per window, service (or ``unknown``) and severity."""
    service = F.coalesce("service", F.lit("unknown"))
    return (
        alerts.groupBy(F.window(ts, width).alias("w"), service.alias("service"), "severity")
        .agg(F.count(F.lit(1)).alias("alerts"), F.max_by("severity", severity_rank(F.col("severity"))).alias("highest"))
        .where(F.col("alerts") > 1)
        .select(
            F.col("w.start").alias("bucket"),
            F.concat_ws("-", "service", "severity").alias("group_key"),
            "alerts",
            F.col("highest").alias("severity"),
            F.format_string("%d alerts grouped for %s", F.col("alerts"), F.concat_ws("-", "service", "severity")).alias("description"),
        )
    )


def route(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """Alert and channel pairs: severity at or above the channel's minimum, service in its list.

    ``channels(channel, min_severity, services, enabled)``; NULL filters let everything through.
    Channels are expanded to the severities they accept, so the join is an equality.
    """
    names = F.array(*[F.lit(s) for s in SEVERITY_ORDER])
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SEVERITY_ORDER.items() for x in kv]), F.col("min_severity")), F.lit(0))
    accepted = F.filter(names, lambda s: severity_rank(s) >= F.col("__floor"))
    wide = channels.where("enabled").withColumn("__floor", floor)
    wide = wide.select("channel", "services", F.explode(accepted).alias("severity"))
    listed = F.col("services").isNull() | F.array_contains("services", F.col("service"))
    return alerts.join(wide, "severity").where(listed).drop("services")


def suppress(alerts: DataFrame, suppressions: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts not covered by a suppression: closed time window, rule list, label equality.

    ``suppressions(start_time, end_time, rules, labels, enabled)``; a NULL part matches everything.
    A missing rule list stands for all names of the rule table, which keeps the anti join an equality.
    """
    every = rules.agg(F.collect_set("rule_name")).scalar()
    wide = suppressions.where("enabled").select(
        F.col("start_time").alias("__from"), F.col("end_time").alias("__to"), F.col("labels").alias("__labels"),
        F.explode(F.coalesce("rules", every)).alias("__rule"),
    )
    in_time = F.col("__from").isNull() | F.col("__to").isNull() | ((F.col("ts") >= F.col("__from")) & (F.col("ts") <= F.col("__to")))
    own = lambda k: F.when(k == "service", F.col("service")).otherwise(F.try_element_at("labels", k))
    same = F.col("__labels").isNull() | F.forall(F.map_entries("__labels"), lambda e: F.coalesce(own(e["key"]) == e["value"], F.lit(False)))
    return alerts.join(wide, (F.col("rule_name") == F.col("__rule")) & in_time & same, "left_anti")


def count_in_window(
    logs: DataFrame, condition: Column, count: int, window_seconds: int, *, by: Sequence[str] = (), ts: str = "timestamp", chunk_seconds: int = 60
) -> DataFrame:
    """Instants at which at least ``count`` matching records lie in the trailing window."""
    seen = rolling_count(logs.where(condition), by, ts, window_seconds, chunk_seconds=chunk_seconds, name="in_window", at="matched")
    return seen.where(F.col("in_window") >= count)


def summary(rule: Column, value: Column) -> Column:
    return (
        F.when(rule == "high_error_rate", F.format_string("Error rate is %.2f%% (threshold: 5%%)", value * 100))
        .when(rule == "high_latency_p95", F.format_string("P95 latency is %.0fms (threshold: 1000ms)", value))
        .when(rule == "low_throughput", F.format_string("Throughput is %.2f RPS", value))
        .otherwise(F.concat(rule, F.lit(" alert triggered")))
    )


def runbook(rule: Column, runbooks: Mapping[str, str] = RUNBOOKS) -> Column:
    return lookup(dict(runbooks), rule, GENERAL_RUNBOOK)


def fingerprint(rule: Column, labels: Column, service: Column) -> Column:
    """Digest of rule, labels and service (a short prefix of their text was the same for every rule)."""
    named = F.struct(rule.alias("ruleName"), labels.alias("labels"), F.coalesce(service, F.lit("unknown")).alias("service"))
    return F.sha2(F.to_json(named), 256)


def annotate(fired: DataFrame, runbooks: Mapping[str, str] = RUNBOOKS) -> DataFrame:
    return fired.withColumns(
        {
            "summary": summary(F.col("rule_name"), F.col("value")),
            "runbook": runbook(F.col("rule_name"), runbooks),
            "fingerprint": fingerprint(F.col("rule_name"), F.col("labels"), F.col("service")),
        }
    )


def level_attributes(level: Column) -> dict[str, Column]:
    return {
        "urgency": lookup(URGENCY, level, "3"),
        "impact": lookup(IMPACT, level, "3"),
        "priority": lookup(PRIORITY, level, "Medium"),
        "chat_colour": lookup(CHAT_COLOUR, level, "warning"),
        "card_colour": lookup(CARD_COLOUR, level, "FFCC00"),
    }


def ticket_outbox(alerts: DataFrame) -> DataFrame:
    """Ticket payloads of critical and error alerts ``(title, level, service, count, time_range, query, message)``."""
    level = F.col("level")
    attributes = level_attributes(level)
    details = F.format_string(
        "Level: %s\nService: %s\nCount: %d\nTime Range: %s\nQuery: %s\nMessage: %s",
        level, F.coalesce("service", F.lit("Unknown")), F.col("count"), F.col("time_range"), F.col("query"), F.col("message"),
    )
    title = F.concat(F.lit("Log Alert: "), F.col("title"))
    incident = F.to_json(
        F.struct(
            title.alias("short_description"), details.alias("description"), attributes["urgency"].alias("urgency"), attributes["impact"].alias("impact"),
            F.lit("Software").alias("category"), F.lit("Application").alias("subcategory"), F.lit("IT Operations").alias("assignment_group"),
        )
    )
    issue = F.to_json(
        F.struct(
            F.struct(
                F.struct(F.lit("OPS").alias("key")).alias("project"), title.alias("summary"), details.alias("description"),
                F.struct(F.lit("Bug").alias("name")).alias("issuetype"), F.struct(attributes["priority"].alias("name")).alias("priority"),
                F.array(F.lit("log-alert"), F.lit("auto-generated"), level).alias("labels"),
            ).alias("fields")
        )
    )
    targets = F.array(
        F.struct(F.lit("incident").alias("target"), incident.alias("payload")), F.struct(F.lit("issue").alias("target"), issue.alias("payload"))
    )
    keep = [c for c in alerts.columns if c not in ("query", "message", "time_range")]
    return alerts.where(level.isin(*TICKET_LEVELS)).select(*keep, F.explode(targets).alias("t")).select(*keep, "t.*")


def notification(alerts: DataFrame) -> DataFrame:
    """Chat message payload of every alert."""
    level = F.col("level")
    field = lambda n, v: F.struct(F.lit(n).alias("title"), v.alias("value"))
    payload = F.to_json(
        F.struct(
            level_attributes(level)["chat_colour"].alias("color"), F.col("title"),
            F.array(
                field("Level", F.upper(level)), field("Service", F.coalesce("service", F.lit("Unknown"))),
                field("Count", F.col("count").cast("string")), field("Time Range", F.col("time_range")),
            ).alias("fields"),
            F.col("message").alias("text"),
        )
    )
    return alerts.withColumn("payload", payload)


def slo_defaults(slos: DataFrame) -> DataFrame:
    """SLO rows with defaults: objective 0.999, budget ``1 - objective``, window 30d, threshold 2."""
    objective = F.coalesce("objective", F.lit(SLO_OBJECTIVE))
    return slos.select(
        "slo", "service", objective.alias("objective"),
        F.coalesce("error_budget", F.round(1 - objective, 12)).alias("error_budget"),
        F.coalesce("window", F.lit(SLO_WINDOW)).alias("window"),
        F.coalesce("burn_rate_threshold", F.lit(SLO_BURN_THRESHOLD)).alias("burn_rate_threshold"),
    )


def window_seconds(window: Column) -> Column:
    """Length of an SLO window text; here ``m`` is a month of 30 days."""
    sizes = {u: span_seconds(f"1{u}", m="month") for u in "hdwmy"}
    amount = F.regexp_extract(window, r"^(\d+)[hdwmy]$", 1).try_cast("bigint")
    return F.coalesce(amount * lookup(sizes, F.right(window, F.lit(1)), 0), F.lit(30 * 86400))


def burn_rates(logs: DataFrame, slos: DataFrame, *, windows: Sequence[str] = ("1h", "6h", "1d", "7d"), as_of: Any = None, ts: str = "timestamp") -> DataFrame:
    """Error rate over budget per SLO and look-back window (the SLO's own window included), with remaining budget.

    Logs are reduced to one row per service and second of age before they meet the windows; a window
    is open at its old end. A window without requests has a NULL burn rate. A budget of zero is burnt by
    any error: the burn rate is infinite, and NULL without errors.
    """
    now = as_of_or_latest(logs, ts, as_of)
    known = slo_defaults(slos)
    # Age in whole seconds, rounded so that age < window holds exactly for ts > now - window.
    age = F.floor((micros(now) - micros(F.col(ts))) / 1_000_000)
    longest = F.greatest(F.lit(max(span_seconds(w, m="month") for w in windows)), known.agg(F.max(window_seconds(F.col("window")))).scalar())
    per_age = logs.where(F.col("service").isNotNull() & (F.col(ts) <= now) & (age < longest)).groupBy("service", age.alias("__age")).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("level").isin("ERROR", "FATAL")).alias("e")
    )
    spans = F.array_distinct(F.concat(F.array(*[F.lit(w) for w in windows]), F.array("window")))
    wide = known.withColumn("look_back", F.explode(spans)).withColumn("__secs", window_seconds(F.col("look_back")))
    hits = wide.join(per_age, "service").where(F.col("__age") < F.col("__secs"))
    figures = hits.groupBy("slo", "look_back").agg(F.sum("n").alias("requests"), F.sum("e").alias("errors"))
    rate = F.try_divide(F.col("errors"), F.col("requests"))
    spent = F.when(F.col("errors") > 0, F.lit(float("inf")))
    burn = F.when(F.col("error_budget") > 0, F.try_divide(rate, F.col("error_budget"))).otherwise(spent)
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("requests", "errors")}
    return wide.drop("__secs").join(figures, ["slo", "look_back"], "left").withColumns(zero).select(
        "slo", "service", "look_back", "requests", "errors", burn.alias("burn_rate"), (1 - burn).alias("budget_left"),
        F.when(burn > F.greatest(F.lit(SLO_CRITICAL_BURN), F.col("burn_rate_threshold")), "critical")
        .when(burn > F.col("burn_rate_threshold"), "warning").alias("severity"),
    )
