"""Parsing, text features, performance report and personal data."""

from pyspark.sql import functions as F

from logspark.functions import levels, pii, text, timefx
from logspark.operators import parse as P
from logspark.operators import report as R
from logspark.plans.adapters import ctes
from logspark.plans.registry import query

WITH_LINES = f"WITH {ctes('lines')}"
WITH_LOGS = f"WITH {ctes('logs')}"

FORMAT = """CASE WHEN starts_with(value, '{') AND json_valid(value) THEN 'json'
 WHEN regexp_matches(value, '^<\\d+>\\w{3}\\s+\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2}\\s+\\S+\\s+.+$') THEN 'rfc3164'
 WHEN regexp_matches(value, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z \\w+ \\w+ ') THEN 'kubernetes'
 WHEN regexp_matches(value, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z \\w+ ') THEN 'docker'
 WHEN len(list_distinct(regexp_extract_all(value, '(\\w+)=(?:"([^"]*)"|([^\\s]+))', 1))) > 1 THEN 'logfmt'
 ELSE 'raw' END"""


@query("format_counts", WITH_LINES + f" SELECT {FORMAT} AS format, count(*) AS n FROM lines GROUP BY 1")
def format_counts(t):
    return P.format_counts(t.lines)


@query(
    "parsed_logs",
    WITH_LINES
    + """ SELECT line_no, l.source, CASE seq % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'docker' WHEN 2 THEN 'logfmt' WHEN 3 THEN 'rfc3164' ELSE 'raw' END AS format,
 CASE WHEN seq % 5 < 3 THEN date_trunc('second', timestamp)::TIMESTAMP WHEN seq % 5 = 3 THEN TIMESTAMP '2024-01-15 10:30:00' -
  CASE WHEN TIMESTAMP '2024-01-14 10:30:00' > (SELECT max(timestamp) FROM logs) THEN INTERVAL 1 YEAR ELSE INTERVAL 0 YEAR END END AS timestamp,
 CASE WHEN seq % 5 < 4 THEN level WHEN endpoint = '/error' THEN 'ERROR' ELSE 'INFO' END AS level,
 CASE seq % 5 WHEN 0 THEN message WHEN 1 THEN concat('[main] GET ', endpoint, ' response_time=', response_time, 'ms ', message)
  WHEN 3 THEN message ELSE value END AS message,
 CASE WHEN seq % 5 IN (0, 2, 3) THEN service END AS service,
 CASE WHEN seq % 5 = 2 THEN response_time END AS response_time,
 CASE WHEN seq % 5 = 2 THEN status_code END::INTEGER AS status_code
 FROM lines l JOIN logs ON seq = line_no""",
)
def parsed_logs(t):
    now = t.logs.agg(F.max("timestamp")).scalar()
    logs = P.parse_logs(t.lines, as_of=now).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return logs.select("line_no", "source", "format", "timestamp", "level", "message", "service", "response_time", "status_code")


@query(
    "parse_quarantine",
    WITH_LINES + " SELECT format, count(*) AS n, count(*) FILTER (WHERE format = 'rfc3164') AS rejected FROM (SELECT " + FORMAT + " AS format FROM lines) GROUP BY 1",
)
def parse_quarantine(t):
    """Outcome counts per format: received and rejected; without ``as_of`` syslog times cannot be read."""
    parsed = P.parse_logs(t.lines)
    bad = P.quarantine(parsed).groupBy("format").agg(F.count(F.lit(1)).alias("rejected"))
    all_ = parsed.groupBy("format").agg(F.count(F.lit(1)).alias("n"))
    return all_.join(bad, "format", "left").select("format", "n", F.coalesce("rejected", F.lit(0)).cast("bigint").alias("rejected"))


@query(
    "parse_logfmt",
    WITH_LINES
    + """ SELECT line_no, 'ts' AS key, concat(replace(CAST(date_trunc('second', timestamp) AS VARCHAR), ' ', 'T'), 'Z') AS val FROM lines JOIN logs ON seq = line_no WHERE seq % 5 = 2
 UNION ALL SELECT line_no, 'level', lower(level) FROM lines JOIN logs ON seq = line_no WHERE seq % 5 = 2
 UNION ALL SELECT line_no, 'service', service FROM lines JOIN logs ON seq = line_no WHERE seq % 5 = 2
 UNION ALL SELECT line_no, 'duration', concat(response_time, 'ms') FROM lines JOIN logs ON seq = line_no WHERE seq % 5 = 2
 UNION ALL SELECT line_no, 'status', CAST(status_code AS VARCHAR) FROM lines JOIN logs ON seq = line_no WHERE seq % 5 = 2""",
)
def parse_logfmt(t):
    typed = P.read_fields(t.lines).where(F.col("format") == "logfmt")
    return typed.select("line_no", F.explode("fields").alias("key", "val"))


@query(
    "coerced_values",
    WITH_LINES
    + """, kv AS (SELECT unnest(regexp_extract_all(value, '(\\w+)=(?:"([^"]*)"|([^\\s]+))', 1)) AS key,
  unnest(regexp_extract_all(value, '(\\w+)=(?:"([^"]*)"|([^\\s]+))', 3)) AS v FROM lines WHERE line_no % 5 = 2)
 SELECT key, CASE WHEN v IN ('true','false') THEN 'boolean' WHEN v = 'null' THEN 'null' WHEN regexp_full_match(v, '\\d+') THEN 'integer'
  WHEN regexp_full_match(v, '\\d*\\.\\d+') THEN 'double' ELSE 'string' END AS kind, count(*) AS n,
  sum(CASE WHEN regexp_full_match(v, '\\d+') THEN CAST(v AS BIGINT) END)::BIGINT AS total FROM kv GROUP BY 1, 2""",
)
def coerced_values(t):
    pairs = P.read_fields(t.lines).where(F.col("format") == "logfmt").select(F.explode("fields").alias("key", "v"))
    typed = pairs.select("key", text.coerced(F.col("v")).alias("c"))
    return typed.groupBy("key", F.col("c.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("c.as_integer").alias("total"))


@query(
    "parse_syslog",
    WITH_LINES
    + """, p AS (SELECT line_no, value, TRY_CAST(nullif(regexp_extract(value, '^<(\\d+)>', 1), '') AS INTEGER) AS priority FROM lines)
 SELECT line_no, priority, CAST(floor(priority / 8) AS INTEGER) AS facility, priority % 8 AS severity,
 CASE WHEN priority IS NOT NULL THEN regexp_extract(value, '^<\\d+>(\\w{3} \\d{2} \\S+) ', 1) END AS header_time,
 CASE WHEN priority IS NOT NULL THEN regexp_extract(value, '^<\\d+>\\w{3} \\d{2} \\S+ (\\S+) ', 1) END AS hostname,
 CASE WHEN priority IS NOT NULL THEN regexp_extract(value, '^<\\d+>\\w{3} \\d{2} \\S+ \\S+ (.+)$', 1) ELSE value END AS message,
 CASE priority % 8 WHEN 3 THEN 'ERROR' WHEN 4 THEN 'WARN' WHEN 7 THEN 'DEBUG' ELSE 'INFO' END AS level FROM p""",
)
def parse_syslog(t):
    return P.parse_syslog(t.lines).drop("source", "value")


@query(
    "app_entries",
    WITH_LINES
    + """ SELECT line_no, l.source, concat(replace(CAST(date_trunc('second', timestamp) AS VARCHAR), ' ', 'T'), 'Z') AS timestamp, level, endpoint, response_time,
 concat('response_time=', response_time, 'ms ', message) AS message FROM lines l JOIN logs ON seq = line_no WHERE seq % 5 = 1 AND level IN ('INFO', 'WARN', 'ERROR')""",
)
def app_entries(t):
    return P.app_entries(t.lines)


@query(
    "levels",
    WITH_LOGS
    + """ SELECT level, CASE level WHEN 'DEBUG' THEN 5 WHEN 'INFO' THEN 9 WHEN 'WARN' THEN 13 ELSE 17 END AS severity_number,
 CASE WHEN regexp_matches(message, '(?i)\\berror\\b') THEN 'ERROR' ELSE 'INFO' END AS from_message, count(*) AS n FROM logs GROUP BY ALL""",
)
def levels_query(t):
    return (
        t.logs.select(
            "level",
            levels.severity_number(F.col("level")).alias("severity_number"),
            levels.extract_level([], F.col("message")).alias("from_message"),
        )
        .groupBy("level", "severity_number", "from_message")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "services_named",
    WITH_LINES
    + """ SELECT nullif(regexp_extract(value, '(?i)service[=:](\\w+)', 1), '') AS service, count(*) AS n FROM lines GROUP BY 1""",
)
def services_named(t):
    return t.lines.groupBy(text.service_in(F.col("value")).alias("service")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "time_features",
    WITH_LOGS
    + """ SELECT id, CAST(hour(timestamp) AS INTEGER) AS hour, CAST(dayofweek(timestamp) AS INTEGER) AS day_of_week,
 dayofweek(timestamp) IN (0, 6) AS is_weekend FROM logs""",
)
def time_features(t):
    return timefx.add_time_features(t.logs).select("id", "hour", "day_of_week", "is_weekend")


@query(
    "message_features",
    "SELECT doc_id, CAST(length(text) AS INTEGER) AS message_length, CAST(len(string_split_regex(text, '\\s+')) AS INTEGER) AS word_count FROM documents",
)
def message_features(t):
    c = F.col("text")
    return t.table("documents").select("doc_id", text.message_length(c).alias("message_length"), text.word_count(c).alias("word_count"))


@query(
    "number_tokens",
    """WITH x AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '(?i)[-+]?(?:\\d*\\.\\d+|\\d+)(?:e[-+]?\\d+)?'), lambda s: TRY_CAST(s AS DOUBLE)) AS v0 FROM documents),
 y AS (SELECT doc_id, list_filter(v0, lambda n: isfinite(n)) AS v FROM x)
 SELECT doc_id, len(v)::BIGINT AS numbers, round(list_max(v), 6) AS largest FROM y WHERE len(v) > 0""",
)
def number_tokens(t):
    v = text.number_tokens(F.lower("text"))
    return (
        t.table("documents").select("doc_id", v.alias("v")).where(F.size("v") > 0)
        .select("doc_id", F.size("v").cast("bigint").alias("numbers"), F.round(F.array_max("v"), 6).alias("largest"))
    )


def report_sql(key: str, source: str) -> str:
    """The report over ``source(g, value)`` grouped by ``key``."""
    num = "list_transform(regexp_extract_all(l, '[-+]?(?:\\d*\\.\\d+|\\d+)(?:e[-+]?\\d+)?'), lambda s: CAST(s AS DOUBLE))"
    dur = "(response_time|latency|duration|took)[^\\d]*([\\d.]+)\\s*(ms|s|sec|seconds|millisecond)"
    return f"""low AS (SELECT {key} AS g, lower(value) AS l FROM {source} WHERE length(value) > 0),
 f AS (SELECT g, l, regexp_matches(l, '(error|exception|fail|timeout|5\\d{{2}})') AS is_error, regexp_matches(l, '{dur}') AS labelled,
  regexp_matches(l, '\\s(20\\d|30\\d|40\\d|50\\d)\\s') AND regexp_matches(l, '\\s(\\d+)$') AS access, {num} AS v FROM low),
 d AS (SELECT *, CASE WHEN labelled THEN CAST(regexp_extract(regexp_extract(l, '{dur}', 2), '^(\\d+\\.?\\d*|\\.\\d+)', 1) AS DOUBLE)
   * CASE WHEN regexp_extract(l, '{dur}', 3) IN ('ms', 'millisecond') THEN 1 ELSE 1000 END
   WHEN access AND len(v) >= 2 AND v[-1] < 120000 THEN v[-1] END AS ms,
  CASE WHEN NOT labelled AND access AND len(v) >= 2 AND v[-2] > 0 THEN v[-2] END AS b,
  TRY_CAST(nullif(regexp_extract(l, 'cpu\\s*(avg|usage|util(?:ization)?)?[^\\d]*([\\d.]+)\\s*%', 2), '') AS DOUBLE) / 100 AS c,
  TRY_CAST(nullif(regexp_extract(l, 'mem(?:ory)?\\s*(usage|util(?:ization)?)?[^\\d]*([\\d.]+)\\s*%', 2), '') AS DOUBLE) / 100 AS m,
  TRY_CAST(nullif(regexp_extract(regexp_extract(l, 'load(?:\\s*avg(?:erage)?)?[^\\d]*([\\d.]+)', 1), '^(\\d+\\.?\\d*|\\.\\d+)', 1), '') AS DOUBLE) AS ld FROM f),
 report AS (SELECT g, count(ms) AS requests, count(*) FILTER (WHERE is_error) AS errors,
  CASE WHEN count(ms) > 0 THEN count(*) FILTER (WHERE is_error)::DOUBLE / count(ms) ELSE 0.0 END AS error_rate,
  count(ms)::DOUBLE / greatest(60, ceil(count(*) / 50)) AS throughput_rps, coalesce(sum(b), 0)::BIGINT AS total_bytes,
  coalesce(quantile_disc(ms, 0.5), 0)::DOUBLE AS p50, coalesce(quantile_disc(ms, 0.9), 0)::DOUBLE AS p90,
  coalesce(quantile_disc(ms, 0.95), 0)::DOUBLE AS p95, coalesce(quantile_disc(ms, 0.99), 0)::DOUBLE AS p99,
  avg(c) AS cpu, avg(m) AS memory, avg(ld) AS load FROM d GROUP BY g)"""


REPORT_COLUMNS = "requests, errors, error_rate, throughput_rps, total_bytes, p50, p90, p95, p99, round(cpu, 6) AS cpu, round(memory, 6) AS memory, round(load, 6) AS load"


def rounded_report(df):
    return df.withColumns({c: F.round(c, 6) for c in ("cpu", "memory", "load")})


@query("perf_report", WITH_LINES + ", " + report_sql("0", "lines") + f" SELECT {REPORT_COLUMNS} FROM report")
def perf_report(t):
    return rounded_report(R.performance_report(t.lines))


@query("perf_report_by_source", WITH_LINES + ", " + report_sql("source", "lines") + f" SELECT g AS source, {REPORT_COLUMNS} FROM report")
def perf_report_by_source(t):
    return rounded_report(R.performance_report(t.lines, by=["source"]))


@query(
    "perf_report_documents",
    "WITH t AS (SELECT source, unnest(string_split(text, chr(10))) AS value FROM documents), " + report_sql("source", "t") + f" SELECT g AS source, {REPORT_COLUMNS} FROM report",
)
def perf_report_documents(t):
    """Every line of every document, per source."""
    lines = t.table("documents").select("source", F.explode(F.split("text", "\n")).alias("value"))
    return rounded_report(R.performance_report(lines, by=["source"]))


NFR = """, nfr AS (
 SELECT g, 1 AS nfr, 'Latency' AS category, 'p95 <= 500 ms; p99 <= 1000 ms' AS requirement, printf('p95=%d ms; p99=%d ms', floor(p95 + 0.5)::BIGINT, floor(p99 + 0.5)::BIGINT) AS current FROM report
 UNION ALL SELECT g, 2, 'Reliability', 'Error rate <= 1.00%', printf('Error rate %.2f%%', error_rate * 100) FROM report
 UNION ALL SELECT g, 3, 'Throughput', printf('Sustain >= %d RPS with SLO latency', greatest(1, floor(CASE WHEN throughput_rps = 0 THEN 1.0 ELSE throughput_rps END * 1.5 + 0.5)::BIGINT)), printf('%.2f RPS observed', throughput_rps) FROM report
 UNION ALL SELECT g, 4, 'Capacity', 'Avg CPU <= 80%', printf('Avg CPU %d%%', floor(cpu * 100 + 0.5)::BIGINT) FROM report WHERE cpu IS NOT NULL
 UNION ALL SELECT g, 4 + (cpu IS NOT NULL)::INTEGER, 'Capacity', 'Avg Memory <= 85%', printf('Avg Memory %d%%', floor(memory * 100 + 0.5)::BIGINT) FROM report WHERE memory IS NOT NULL)"""


@query("nfr_rows", WITH_LINES + ", " + report_sql("source", "lines") + NFR + " SELECT g AS source, nfr::INTEGER AS nfr, category, requirement, current FROM nfr")
def nfr_rows(t):
    return R.nfr_rows(R.performance_report(t.lines, by=["source"]), by=["source"])


@query(
    "recommendations",
    WITH_LINES + ", " + report_sql("source", "lines")
    + """ SELECT g AS source, printf('Improve p95 latency to <= 500 ms (observed %d ms). Consider caching, DB indexing, or reducing external calls.', floor(p95 + 0.5)::BIGINT) AS recommendation FROM report WHERE p95 > 500
 UNION ALL SELECT g, 'Reduce long-tail p99 latency to <= 1000 ms; investigate GC pauses, cold paths, and lock contention.' FROM report WHERE p99 > 1000
 UNION ALL SELECT g, printf('Reduce error rate to <= 1.00%% (observed %.2f%%). Ensure retries, timeouts, circuit breakers.', error_rate * 100) FROM report WHERE error_rate > 0.01
 UNION ALL SELECT g, printf('System load average indicates saturation (%.2f). Increase concurrency limits or add capacity.', load) FROM report WHERE load > 1""",
)
def recommendations(t):
    return R.recommendations(R.performance_report(t.lines, by=["source"]), by=["source"])


@query(
    "report_rows",
    WITH_LINES + ", " + report_sql("0", "lines") + NFR
    + """ SELECT i::INTEGER AS i, metric, value FROM (
 SELECT 0 AS i, 'requests' AS metric, requests::VARCHAR AS value FROM report UNION ALL SELECT 1, 'errors', errors::VARCHAR FROM report
 UNION ALL SELECT 2, 'errorRate', error_rate::VARCHAR FROM report UNION ALL SELECT 3, 'throughputRps', throughput_rps::VARCHAR FROM report
 UNION ALL SELECT 4, 'latency_p50', p50::VARCHAR FROM report UNION ALL SELECT 5, 'latency_p90', p90::VARCHAR FROM report
 UNION ALL SELECT 6, 'latency_p95', p95::VARCHAR FROM report UNION ALL SELECT 7, 'latency_p99', p99::VARCHAR FROM report
 UNION ALL SELECT 8, 'system_cpuUtilization', coalesce(cpu::VARCHAR, '') FROM report UNION ALL SELECT 9, 'system_memoryUtilization', coalesce(memory::VARCHAR, '') FROM report
 UNION ALL SELECT 10, 'system_loadAverage', coalesce(load::VARCHAR, '') FROM report
 UNION ALL SELECT 11 + nfr, concat('nfr_', nfr), concat(category, ': ', requirement, ' | ', current) FROM nfr)""",
)
def report_rows(t):
    return R.report_rows(R.performance_report(t.lines))


# The oracle's regex engine has no look-ahead: the SSN exclusions are spelled out as alternatives.
SQL_PATTERNS = {
    **pii.RECORD_PATTERNS,
    "SSN": r"\b(?:00[1-9]|0[1-9]\d|[1-578]\d{2}|6[0-57-9]\d|66[0-57-9])[-\s]?(?:0[1-9]|[1-9]\d)[-\s]?(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})\b",
}


def census_sql(table: str, column: str, patterns: dict[str, str]) -> str:
    parts = [
        f"SELECT '{k}' AS type, '{column}' AS field, len(regexp_extract_all({column}, '{p}'))::BIGINT AS n FROM {table}" for k, p in patterns.items()
    ]
    return "SELECT type, field, sum(n)::BIGINT AS matches, count(*) AS records FROM (" + " UNION ALL ".join(parts) + ") WHERE n > 0 GROUP BY 1, 2"


def redact_sql(table: str, key: str, column: str, patterns: dict[str, str], token) -> str:
    """One CTE per type: the pieces between matches, interleaved with tokens."""
    ctes_ = [f"s0 AS (SELECT {key}, {column} AS orig, {column} AS cur FROM {table})"]
    for i, (kind, p) in enumerate(patterns.items()):
        gate = "orig" if kind.isupper() else "cur"
        tokens = f"list_transform(regexp_extract_all(cur, '{p}'), lambda m: {token(kind)})"
        joined = f"array_to_string(list_transform(list_zip(string_split_regex(cur, '{p}'), {tokens}), lambda z: concat(z[1], coalesce(z[2], ''))), '')"
        ctes_.append(f"s{i + 1} AS (SELECT {key}, orig, CASE WHEN regexp_matches({gate}, '{p}') THEN {joined} ELSE cur END AS cur FROM s{i})")
    return "WITH " + ",\n".join(ctes_) + f" SELECT {key}, cur AS text FROM s{len(patterns)}"


@query("pii_census", census_sql("documents", "text", SQL_PATTERNS))
def pii_census(t):
    return pii.census(t.table("documents"), ["text"])


@query("pii_census_conversations", census_sql("conversations", "text", SQL_PATTERNS))
def pii_census_conversations(t):
    return pii.census(t.table("conversations"), ["text"])


@query("pii_redact_hash", redact_sql("documents", "doc_id", "text", SQL_PATTERNS, lambda k: f"concat('[{k}_', substring(sha256(m), 1, 8), ']')"))
def pii_redact_hash(t):
    return pii.redact(t.table("documents").select("doc_id", "text"), "hash")


@query("pii_redact_mask", redact_sql("documents", "doc_id", "text", SQL_PATTERNS, lambda k: f"concat('[{k}_', repeat('*', least(length(m), 8)), ']')"))
def pii_redact_mask(t):
    return pii.redact(t.table("documents").select("doc_id", "text"), "mask")


@query("pii_redact_remove", redact_sql("conversations", "conv_id, turn", "text", SQL_PATTERNS, lambda k: f"'[{k}_REDACTED]'"))
def pii_redact_remove(t):
    return pii.redact(t.table("conversations").select("conv_id", "turn", "text"), "remove")


TEXT_REDACTED = {k: p for k, p in pii.TEXT_PATTERNS.items() if k not in pii.NOT_REDACTED}


@query("pii_text_hash", redact_sql("documents", "doc_id", "text", TEXT_REDACTED, lambda k: f"concat('[{k.upper()}:', substring(sha256(m), 1, 8), ']')"))
def pii_text_hash(t):
    return t.table("documents").select("doc_id", pii.redacted_text(F.col("text"), "hash").alias("text"))


@query(
    "pii_text_mask",
    redact_sql("documents", "doc_id", "text", TEXT_REDACTED, lambda k: "CASE WHEN length(m) > 4 THEN concat(substring(m, 1, 2), repeat('*', length(m) - 4), right(m, 2)) ELSE repeat('*', length(m)) END"),
)
def pii_text_mask(t):
    return t.table("documents").select("doc_id", pii.redacted_text(F.col("text"), "mask").alias("text"))


@query(
    "pii_distinct",
    "SELECT type, count(DISTINCT m) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{k}' AS type, unnest(regexp_extract_all(text, '{p}')) AS m FROM documents" for k, p in pii.TEXT_PATTERNS.items())
    + ") GROUP BY 1",
)
def pii_distinct(t):
    return pii.distinct_counts(t.table("documents"), "text")
