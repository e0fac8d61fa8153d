"""Alerting and SLO queries."""

from pyspark.sql import functions as F

from logspark.operators import alerts as L
from logspark.operators import anomaly as A
from logspark.plans.adapters import ctes
from logspark.plans.registry import query

WITH = f"WITH {ctes('logs', 'metrics')}"

EVALUATED = """rules AS (SELECT * FROM (VALUES ('high_error_rate', 'error_rate', '>', 0.05::DOUBLE, NULL::DOUBLE, 'critical'), ('high_latency_p95', 'latency_p95', '>', 1000.0::DOUBLE, NULL::DOUBLE, 'warning'),
  ('low_throughput', 'throughput', '<', NULL::DOUBLE, 0.5::DOUBLE, 'warning')) r(rule_name, metric, op, threshold, factor, severity)),
 base AS (SELECT name, service, avg(value) AS mean FROM metrics WHERE ts > (SELECT max(ts) FROM metrics) - INTERVAL 7 DAY GROUP BY 1, 2),
 ev AS (SELECT rule_name, severity, m.service, ts, m.name, value, coalesce(threshold, factor * mean) AS "limit",
  coalesce(CASE op WHEN '>' THEN value > coalesce(threshold, factor * mean) ELSE value < coalesce(threshold, factor * mean) END, false) AS fired
  FROM metrics m JOIN rules ON metric = m.name LEFT JOIN base b ON b.name = m.name AND b.service = m.service)"""


def evaluated(t):
    metrics = t.metrics.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return L.evaluate_rules(metrics, L.default_rules(t.spark), A.baseline_means(metrics, ("name", "service"), as_of=t.metrics_as_of))


def fired(t):
    return evaluated(t).where("fired").drop("fired")


@query("rule_alerts", WITH + ", " + EVALUATED + ' SELECT rule_name, severity, service, ts, name, value, round("limit", 6) AS "limit" FROM ev WHERE fired')
def rule_alerts(t):
    return fired(t).drop("labels").withColumn("limit", F.round("limit", 6))


@query(
    "alert_sessions",
    WITH + ", " + EVALUATED
    + """, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY rule_name, service ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS o FROM ev WHERE fired),
 g AS (SELECT *, sum(o) OVER (PARTITION BY rule_name, service ORDER BY ts) AS k FROM f)
 SELECT rule_name, service, min(ts) AS starts_at, max(ts) AS last_seen, count(*) AS n FROM g GROUP BY rule_name, service, k""",
)
def alert_sessions(t):
    """Hourly metrics, hence a two-hour gap."""
    return L.alert_sessions(fired(t), gap_seconds=7200)


STATES = """, q0 AS (SELECT *, lag(ts) OVER p AS prev, lead(ts) OVER p AS nxt FROM ev WINDOW p AS (PARTITION BY rule_name, service ORDER BY ts)),
 q AS (SELECT *, sum((NOT fired)::INTEGER + coalesce(ts - prev > INTERVAL 1 HOUR, false)::INTEGER) OVER (PARTITION BY rule_name, service ORDER BY ts) AS k FROM q0),
 isl AS (SELECT rule_name, service, min(ts) AS starts_at, max(ts) AS last_seen, max(nxt) AS m, bool_or(nxt IS NULL) AS open, count(*) AS n FROM q WHERE fired GROUP BY rule_name, service, k),
 states AS (SELECT rule_name, service, starts_at, last_seen, CASE WHEN NOT open THEN CASE WHEN m - last_seen > INTERVAL 1 HOUR THEN last_seen + INTERVAL 1 HOUR ELSE m END END AS ends_at, n,
  CASE WHEN open THEN 'firing' ELSE 'resolved' END AS status FROM isl)"""


@query("alert_states", WITH + ", " + EVALUATED + STATES + " SELECT * FROM states")
def alert_states(t):
    return L.alert_states(evaluated(t))


@query("alert_for_duration", WITH + ", " + EVALUATED + STATES + " SELECT * FROM states WHERE epoch(last_seen - starts_at) + 3600 >= 10800")
def alert_for_duration(t):
    return L.alert_states(evaluated(t), hold_seconds=3 * 3600)


@query(
    "alert_groups",
    WITH + ", " + EVALUATED
    + """ SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket, concat(service, '-', severity) AS group_key, count(*) AS alerts, severity,
 concat(count(*), ' alerts grouped for ', service, '-', severity) AS description FROM ev WHERE fired GROUP BY 1, service, severity HAVING count(*) > 1""",
)
def alert_groups(t):
    return L.alert_groups(fired(t), width="1 day")


CHANNELS = """SELECT 'pager' AS channel, 'critical' AS min_severity, CAST(NULL AS {strings}) AS services, true AS enabled
 UNION ALL SELECT 'team-chat', 'warning', {list}, true UNION ALL SELECT 'archive', NULL, NULL, true UNION ALL SELECT 'old-mail', NULL, NULL, false"""


@query(
    "alert_routing",
    WITH + ", " + EVALUATED
    + f""", ch AS ({CHANNELS.format(strings='VARCHAR[]', list="['svc-1', 'svc-2']")}), rk(s, r) AS (VALUES ('info', 1), ('warning', 2), ('critical', 3))
 SELECT severity, rule_name, service, ts, channel FROM ev JOIN rk a ON a.s = severity JOIN ch ON enabled LEFT JOIN rk m ON m.s = min_severity
 WHERE fired AND a.r >= coalesce(m.r, 0) AND (services IS NULL OR list_contains(services, service))""",
)
def alert_routing(t):
    channels = t.values(CHANNELS.format(strings="ARRAY<STRING>", list="array('svc-1', 'svc-2')"))
    return L.route(fired(t).select("severity", "rule_name", "service", "ts"), channels)


SUPPRESSIONS = """SELECT CAST('2024-01-05 00:00:00' AS {ts}) AS start_time, CAST('2024-01-07 00:00:00' AS {ts}) AS end_time, CAST(NULL AS {strings}) AS rules, CAST(NULL AS {map}) AS labels, true AS enabled
 UNION ALL SELECT NULL, NULL, {list}, {svc}, true UNION ALL SELECT NULL, NULL, NULL, NULL, false"""


@query(
    "alert_suppressed",
    WITH + ", " + EVALUATED
    + """ SELECT rule_name, severity, service, ts FROM ev WHERE fired AND NOT (ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-07 00:00:00')
 AND NOT (rule_name IN ('high_latency_p95', 'low_throughput') AND service = 'svc-3')""",
)
def alert_suppressed(t):
    text = SUPPRESSIONS.format(ts="TIMESTAMP_NTZ", strings="ARRAY<STRING>", map="MAP<STRING,STRING>", list="array('high_latency_p95', 'low_throughput')", svc="map('service', 'svc-3')")
    kept = L.suppress(fired(t), t.values(text), L.default_rules(t.spark))
    return kept.select("rule_name", "severity", "service", "ts")


@query(
    "alert_annotations",
    WITH + ", " + EVALUATED
    + """ SELECT rule_name, service, ts, CASE rule_name WHEN 'high_error_rate' THEN printf('Error rate is %.2f%% (threshold: 5%%)', value * 100)
  WHEN 'high_latency_p95' THEN printf('P95 latency is %.0fms (threshold: 1000ms)', value) ELSE printf('Throughput is %.2f RPS', value) END AS summary,
 concat('https://runbooks.example.com/', CASE rule_name WHEN 'high_latency_p95' THEN 'high-latency' ELSE replace(rule_name, '_', '-') END) AS runbook,
 sha256(concat('{"ruleName":"', rule_name, '","labels":{},"service":"', service, '"}')) AS fingerprint FROM ev WHERE fired""",
)
def alert_annotations(t):
    return L.annotate(fired(t)).select("rule_name", "service", "ts", "summary", "runbook", "fingerprint")


SLOS = """SELECT 'checkout' AS slo, 'svc-1' AS service, CAST(0.9 AS DOUBLE) AS objective, CAST(NULL AS DOUBLE) AS error_budget, '30d' AS {q}window{q}, CAST(1.5 AS DOUBLE) AS burn_rate_threshold
 UNION ALL SELECT 'search', 'svc-2', NULL, NULL, NULL, NULL UNION ALL SELECT 'login', 'svc-3', 0.5, 0.25, '1w', NULL"""


@query(
    "slo_burn_rate",
    WITH
    + f""", s0 AS ({SLOS.format(q='"')}), s AS (SELECT slo, service, coalesce(error_budget, round(1 - coalesce(objective, 0.999::DOUBLE), 12)) AS budget, coalesce("window", '30d') AS w, coalesce(burn_rate_threshold, 2.0::DOUBLE) AS th FROM s0),
 w(look_back, hrs) AS (VALUES ('1h', 1), ('6h', 6), ('1d', 24), ('7d', 168), ('30d', 720), ('1w', 168)),
 f AS (SELECT slo, s.service, look_back, budget, th, count(l.id) AS requests, count(*) FILTER (WHERE level IN ('ERROR', 'FATAL')) AS errors FROM s JOIN w ON look_back IN ('1h', '6h', '1d', '7d') OR look_back = w
  LEFT JOIN logs l ON l.service = s.service AND l.timestamp > (SELECT max(timestamp) FROM logs) - to_hours(hrs) GROUP BY ALL)
 SELECT slo, service, look_back, requests, errors, round(errors::DOUBLE / nullif(requests, 0) / budget, 6) AS burn_rate, round(1 - errors::DOUBLE / nullif(requests, 0) / budget, 6) AS budget_left,
 CASE WHEN errors::DOUBLE / nullif(requests, 0) / budget > greatest(10, th) THEN 'critical' WHEN errors::DOUBLE / nullif(requests, 0) / budget > th THEN 'warning' END AS severity FROM f""",
)
def slo_burn_rate(t):
    rates = L.burn_rates(t.logs, t.values(SLOS.format(q="`")))
    return rates.withColumns({"burn_rate": F.round("burn_rate", 6), "budget_left": F.round("budget_left", 6)})


@query(
    "count_window_alert",
    WITH
    + """, e AS (SELECT *, count(*) OVER (PARTITION BY environment ORDER BY timestamp RANGE BETWEEN INTERVAL 30 MINUTE - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW) AS k
 FROM logs WHERE level IN ('ERROR', 'WARN') AND response_time > 100) SELECT environment, timestamp, count(*) AS matched, k AS in_window FROM e WHERE k >= 3 GROUP BY ALL""",
)
def count_window_alert(t):
    condition = F.col("level").isin("ERROR", "WARN") & (F.col("response_time") > 100)
    return L.count_in_window(t.logs, condition, 3, 1800, by=["environment"])


@query(
    "level_attributes",
    WITH
    + """, l AS (SELECT CASE level WHEN 'ERROR' THEN CASE status_code WHEN 500 THEN 'critical' ELSE 'error' END WHEN 'WARN' THEN 'warning' WHEN 'INFO' THEN 'info' ELSE 'other' END AS level FROM logs)
 SELECT level, count(*) AS n, CASE level WHEN 'critical' THEN '1' WHEN 'error' THEN '2' WHEN 'info' THEN '4' ELSE '3' END AS urgency, urgency AS impact,
 CASE level WHEN 'critical' THEN 'Highest' WHEN 'error' THEN 'High' WHEN 'info' THEN 'Low' ELSE 'Medium' END AS priority,
 CASE level WHEN 'critical' THEN 'danger' WHEN 'error' THEN 'danger' WHEN 'info' THEN 'good' ELSE 'warning' END AS chat_colour,
 CASE level WHEN 'critical' THEN 'FF0000' WHEN 'error' THEN 'FF6600' WHEN 'info' THEN '00CC00' ELSE 'FFCC00' END AS card_colour FROM l GROUP BY level""",
)
def level_attributes(t):
    level = F.expr("CASE level WHEN 'ERROR' THEN CASE status_code WHEN 500 THEN 'critical' ELSE 'error' END WHEN 'WARN' THEN 'warning' WHEN 'INFO' THEN 'info' ELSE 'other' END")
    counts = t.logs.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns(L.level_attributes(F.col("level")))


def outbox_alerts(t):
    return fired(t).select(
        F.col("rule_name").alias("title"),
        F.when(F.col("severity") == "critical", "critical").otherwise("warning").alias("level"),
        "service", F.lit(1).alias("count"), F.lit("1h").alias("time_range"), F.col("name").alias("query"), F.lit("limit passed").alias("message"), "ts",
    )


DETAILS = """concat('Level: ', level, '\\n', 'Service: ', service, '\\n', 'Count: 1\\n', 'Time Range: 1h\\n', 'Query: ', name, '\\n', 'Message: limit passed')"""


@query(
    "ticket_outbox",
    WITH + ", " + EVALUATED
    + f""", a AS (SELECT *, severity AS level FROM ev WHERE fired AND severity = 'critical')
 SELECT rule_name AS title, level, service, 1 AS count, ts, 'incident' AS target, concat('{{"short_description":"Log Alert: ', rule_name, '","description":"', {DETAILS},
  '","urgency":"1","impact":"1","category":"Software","subcategory":"Application","assignment_group":"IT Operations"}}') AS payload FROM a
 UNION ALL SELECT rule_name, level, service, 1, ts, 'issue', concat('{{"fields":{{"project":{{"key":"OPS"}},"summary":"Log Alert: ', rule_name, '","description":"', {DETAILS},
  '","issuetype":{{"name":"Bug"}},"priority":{{"name":"Highest"}},"labels":["log-alert","auto-generated","critical"]}}}}') FROM a""",
)
def ticket_outbox(t):
    return L.ticket_outbox(outbox_alerts(t))


@query(
    "notifications",
    WITH + ", " + EVALUATED
    + """ SELECT rule_name AS title, service, ts, concat('{"color":"', CASE severity WHEN 'critical' THEN 'danger' ELSE 'warning' END, '","title":"', rule_name,
 '","fields":[{"title":"Level","value":"', upper(severity), '"},{"title":"Service","value":"', service, '"},{"title":"Count","value":"1"},{"title":"Time Range","value":"1h"}],"text":"limit passed"}') AS payload
 FROM ev WHERE fired""",
)
def notifications(t):
    return L.notification(outbox_alerts(t)).select("title", "service", "ts", "payload")


@query(
    "alert_history",
    WITH + ", " + EVALUATED + " SELECT rule_name, service, ts, severity FROM ev WHERE fired ORDER BY ts DESC, rule_name, service LIMIT 100",
)
def alert_history(t):
    return fired(t).select("rule_name", "service", "ts", "severity").orderBy(F.col("ts").desc(), "rule_name", "service").limit(100)
