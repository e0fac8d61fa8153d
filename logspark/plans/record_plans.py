"""Intake, multiline, enrichment, audit and tier queries."""

from datetime import timedelta

from pyspark.sql import functions as F

from logspark.operators import audit as U
from logspark.operators import enrich as E
from logspark.operators import multiline, tiers
from logspark.operators import parse as P
from logspark.plans.adapters import ctes
from logspark.plans.registry import query
from logspark.session import scratch_path
from logspark.sources import files
from logspark.sources import intake as I

WITH_LOGS = f"WITH {ctes('logs')}"
WITH_MESSAGES = f"WITH {ctes('messages')}"
WITH_AUDIT = f"WITH {ctes('audit')}"

ENTRIES = f"""WITH {ctes('trace_lines')},
 f AS (SELECT *, regexp_matches(value, '(?i)Exception|Error|Caused by:|at\\s+\\w+\\.') AS st, regexp_matches(value, '^\\s+') AS more FROM trace_lines),
 o AS (SELECT *, st AND (NOT more OR line_no = min(CASE WHEN st THEN line_no END) OVER (PARTITION BY source)) AS opens FROM f),
 e AS (SELECT *, CASE WHEN more THEN coalesce(max(CASE WHEN opens THEN line_no END) OVER (PARTITION BY source ORDER BY line_no ROWS UNBOUNDED PRECEDING), line_no) ELSE line_no END AS entry FROM o),
 entries AS (SELECT source, entry AS line_no, string_agg(value, chr(10) ORDER BY e.line_no) AS value, count(*) AS lines FROM e GROUP BY source, entry)"""


@query("multiline_join", ENTRIES + " SELECT * FROM entries")
def multiline_join(t):
    return multiline.join_lines(t.view("trace_lines"), chunk_lines=5000)


@query(
    "multiline_flushed",
    f"""WITH {ctes('trace_lines', 'logs')},
 f AS (SELECT t.*, logs.timestamp AS stamp, regexp_matches(value, '(?i)Exception|Error|Caused by:|at\\s+\\w+\\.') AS st, regexp_matches(value, '^\\s+') AS more FROM trace_lines t JOIN logs ON logs.seq = t.line_no // 4),
 o AS (SELECT *, st AND (NOT more OR line_no = min(CASE WHEN st THEN line_no END) OVER (PARTITION BY source)) AS opens FROM f),
 k AS (SELECT *, max(CASE WHEN opens THEN line_no END) OVER (PARTITION BY source ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS opener FROM o),
 e AS (SELECT k.*, CASE WHEN k.more AND k.stamp < p.stamp + INTERVAL 5 SECOND THEN k.opener ELSE k.line_no END AS entry FROM k LEFT JOIN (SELECT source AS s, line_no AS l, stamp FROM f) p ON k.source = s AND k.opener = l)
 SELECT source, entry AS line_no, string_agg(value, chr(10) ORDER BY e.line_no) AS value, count(*) AS lines FROM e GROUP BY source, entry""",
)
def multiline_flushed(t):
    """An entry takes no line that comes five seconds after it was opened."""
    logs = t.logs.select(F.col("seq").alias("__seq"), "timestamp")
    lines = t.view("trace_lines").join(logs, F.floor(F.col("line_no") / 4) == F.col("__seq")).drop("__seq")
    return multiline.join_lines(lines, ts="timestamp", chunk_lines=5000)


@query(
    "multiline_parsed",
    ENTRIES
    + """ SELECT CASE WHEN regexp_matches(value, '(?i)\\b(ERROR)\\b') THEN 'ERROR' ELSE 'INFO' END AS level, count(*) AS n, sum(lines)::BIGINT AS lines FROM entries GROUP BY 1""",
)
def multiline_parsed(t):
    entries = multiline.join_lines(t.view("trace_lines"))
    return P.parse_logs(entries).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("lines").alias("lines"))


def messages(t):
    return I.envelopes(t.view("messages").select("topic", "value", "timestamp"))


@query(
    "intake_outcomes",
    WITH_MESSAGES
    + """ SELECT 'kafka' AS transport, CASE WHEN contains(topic, 'metric') THEN 'metric' WHEN contains(topic, 'trace') THEN 'trace' ELSE 'log' END AS type,
 count(*) AS received, count(*) FILTER (WHERE json_valid(value)) AS processed, count(*) FILTER (WHERE NOT json_valid(value)) AS failed FROM messages GROUP BY 2""",
)
def intake_outcomes(t):
    return I.outcome_counts(messages(t))


@query(
    "otel_logs",
    WITH_MESSAGES
    + """ SELECT level, severity_number, message, service, attr_b, count(*) AS n FROM (SELECT coalesce(value->>'level', value->>'severity', 'INFO') AS level,
  CASE upper(level) WHEN 'CRITICAL' THEN 21 WHEN 'WARN' THEN 13 ELSE 9 END AS severity_number, coalesce(value->>'message', value->>'msg') AS message, value->>'serviceName' AS service,
  coalesce(value->>'$.tags.b', value->>'$.attributes.b') AS attr_b FROM messages WHERE topic = 'logs' AND json_valid(value)) GROUP BY ALL""",
)
def otel_logs(t):
    logs = I.log_records(I.split_signals(messages(t))["log"])
    return logs.groupBy("level", "severity_number", "message", "service", F.col("attributes")["b"].alias("attr_b")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "otel_metrics",
    WITH_MESSAGES
    + """ SELECT value->>'metricName' AS name, 'gauge' AS type, value->>'$.labels.user' AS "user", count(*) AS n, sum(CAST(value->>'value' AS DOUBLE)) AS total
 FROM messages WHERE topic = 'app-metrics' GROUP BY ALL""",
)
def otel_metrics(t):
    metrics = I.metric_records(I.split_signals(messages(t))["metric"])
    return metrics.groupBy("name", "type", F.col("attributes")["user"].alias("user")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query(
    "otel_spans",
    WITH_MESSAGES
    + """ SELECT value->>'traceID' AS trace_id, value->>'spanID' AS span_id, NULL::VARCHAR AS parent_span_id, value->>'operation' AS operation,
 CAST(value->>'start' AS DOUBLE) AS start_time, CAST(value->>'end' AS DOUBLE) AS end_time, CAST(value->>'end' AS DOUBLE) - CAST(value->>'start' AS DOUBLE) AS duration, value->>'$.process.serviceName' AS service, false AS error
 FROM messages WHERE topic = 'traces'""",
)
def otel_spans(t):
    return I.span_records(I.split_signals(messages(t))["trace"]).drop("tags")


@query("intake_quarantine", WITH_MESSAGES + " SELECT topic AS source, timestamp, value AS raw FROM messages WHERE NOT json_valid(value)")
def intake_quarantine(t):
    return I.split_signals(messages(t))["quarantine"].select("source", "timestamp", "raw")


@query(
    "field_lists",
    """SELECT conv_id, turn, role, CAST(length(text) AS VARCHAR) AS size, 'yes' AS seen FROM conversations""",
)
def field_lists(t):
    c = t.table("conversations")
    flat = F.array(F.lit("role"), "role", F.lit("seen"), F.lit("no"), F.lit("size"), F.length("text").cast("string"), F.lit("seen"), F.lit("yes"))
    values = c.select("conv_id", "turn", I.field_values(flat).alias("f"))
    get = lambda k: F.expr(f"variant_get(f['{k}'], '$', 'string')").alias(k)
    return values.select("conv_id", "turn", get("role"), get("size"), get("seen"))


RANGES = """SELECT '10.0.0.0' AS first_ip, '10.0.0.127' AS last_ip, 'DE' AS country, 'BE' AS region, 'Berlin' AS city
 UNION ALL SELECT '10.0.0.128', '10.0.0.200', 'FR', 'IDF', 'Paris' UNION ALL SELECT '10.1.0.0', '10.4.255.255', 'US', 'CA', 'Oakland'"""
ADDRESS = "concat('10.', CAST(user_id % 6 AS STRING), '.', CAST(event_id % 3 AS STRING), '.', CAST(event_id % 250 AS STRING))"


@query(
    "geo_enrich",
    f"""WITH e AS (SELECT event_id AS id, user_id % 6 AS b, event_id % 3 AS c, event_id % 250 AS d, {ADDRESS} AS client_ip FROM events)
 SELECT id, client_ip, CASE WHEN b BETWEEN 1 AND 4 THEN 'US' WHEN b = 0 AND c = 0 AND d <= 127 THEN 'DE' WHEN b = 0 AND c = 0 AND d <= 200 THEN 'FR' END AS country,
 CASE WHEN b BETWEEN 1 AND 4 THEN 'Oakland' WHEN b = 0 AND c = 0 AND d <= 127 THEN 'Berlin' WHEN b = 0 AND c = 0 AND d <= 200 THEN 'Paris' END AS city FROM e""",
)
def geo_enrich(t):
    e = t.table("events").select(F.col("event_id").alias("id"), F.expr(ADDRESS).alias("client_ip"))
    return E.add_geo(e, t.values(RANGES)).select("id", "client_ip", "geo.country", "geo.city")


@query(
    "session_asof",
    WITH_LOGS
    + """, s AS (SELECT user_id, timestamp AS started_at, concat('sess-', id) AS session_id FROM logs WHERE endpoint = '/signup')
 SELECT l.id, l.user_id, l.timestamp, s.session_id FROM logs l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.timestamp >= s.started_at""",
)
def session_asof(t):
    logs = t.logs.select("id", "user_id", "timestamp")
    starts = t.logs.where(F.col("endpoint") == "/signup").select("user_id", F.col("timestamp").alias("started_at"), F.concat(F.lit("sess-"), "id").alias("session_id"))
    return E.add_session(logs, starts, chunk_seconds=86400)


@query(
    "service_meta",
    WITH_LOGS
    + """ SELECT id, service, n_name AS owner, n_regionkey AS tier FROM logs LEFT JOIN nation ON service = concat('svc-', CAST(n_nationkey AS VARCHAR))""",
)
def service_meta(t):
    meta = t.table("nation").select(
        F.concat(F.lit("svc-"), F.col("n_nationkey").cast("string")).alias("service"), F.col("n_name").alias("owner"), F.col("n_regionkey").alias("tier")
    )
    return E.add_service_metadata(t.logs.select("id", "service"), meta)


@query(
    "alias_fill",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'svc-a' ELSE 'svc-b' END AS service, CASE WHEN turn % 2 = 0 THEN '1.0' ELSE '2.0' END AS version,
 CASE WHEN turn % 3 = 0 THEN 'prod' WHEN turn % 3 = 1 THEN 'stage' END AS environment FROM conversations""",
)
def alias_fill(t):
    c = t.table("conversations").selectExpr(
        "conv_id", "turn", "CASE role WHEN 'user' THEN 'svc-a' ELSE '' END AS service", "'svc-b' AS serviceName",
        "CASE WHEN turn % 2 = 0 THEN '1.0' END AS version", "CAST(NULL AS STRING) AS serviceVersion", "'2.0' AS app_version",
        "CASE WHEN turn % 3 = 0 THEN 'prod' END AS environment", "'' AS env", "CASE WHEN turn % 3 = 1 THEN 'stage' END AS stage",
    )
    return E.add_aliases(c).select("conv_id", "turn", "service", "version", "environment")


LEXICON = """SELECT 'the' AS word, CAST(1.0 AS DOUBLE) AS score UNION ALL SELECT 'and', 0.5 UNION ALL SELECT 'of', -1.0 UNION ALL SELECT 'le', 2.0 UNION ALL SELECT 'en', -0.25"""


@query(
    "sentiment",
    f"""WITH lx AS ({LEXICON}), w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS word FROM documents),
 a AS (SELECT doc_id, count(*) AS words, round(sum(coalesce(score, 0)) / count(*), 6) AS sentiment FROM w LEFT JOIN lx USING (word) GROUP BY 1)
 SELECT doc_id, coalesce(words, 0) AS words, coalesce(sentiment, 0.0) AS sentiment FROM documents LEFT JOIN a USING (doc_id)""",
)
def sentiment(t):
    scored = E.sentiment(t.table("documents"), t.values(LEXICON), key="doc_id", text="text")
    return scored.withColumn("sentiment", F.round("sentiment", 6))


@query(
    "audit_log",
    WITH_AUDIT
    + """ SELECT event_id, timestamp, actor, action, reason FROM audit WHERE action = 'auth.failed' AND timestamp >= TIMESTAMP '2024-01-03 00:00:00' AND timestamp <= TIMESTAMP '2024-01-20 00:00:00'""",
)
def audit_log(t):
    return U.audit_log(t.audit, action="auth.failed", start="2024-01-03 00:00:00", end="2024-01-20 00:00:00")


@query(
    "lockouts",
    WITH_AUDIT
    + """, a AS (SELECT *, count(*) FILTER (WHERE action = 'auth.success') OVER (PARTITION BY actor ORDER BY timestamp, event_id) AS g FROM audit),
 b AS (SELECT *, count(*) FILTER (WHERE reason = 'invalid_password') OVER (PARTITION BY actor, g ORDER BY timestamp, event_id) AS attempts FROM a)
 SELECT actor, timestamp, event_id, attempts, timestamp + INTERVAL 30 MINUTE AS locked_until FROM b WHERE reason = 'invalid_password' AND attempts >= 5""",
)
def lockouts(t):
    return U.lockouts(t.audit, chunk_seconds=86400)


@query(
    "compliance_report",
    f"WITH {ctes('audit', 'users')}"
    + """, p AS (SELECT * FROM audit WHERE timestamp >= (SELECT max(timestamp) FROM audit) - INTERVAL 30 DAY)
 SELECT (SELECT count(*) FROM users) AS total_users, (SELECT count(*) FROM users WHERE is_active) AS active_users, 5::BIGINT AS total_roles, count(*) AS audit_entries,
 count(*) FILTER (WHERE action = 'auth.success') AS logins, count(*) FILTER (WHERE action = 'auth.failed') AS failed_logins, count(*) FILTER (WHERE action = 'access.denied') AS access_denials,
 count(*) FILTER (WHERE reason = 'account_locked') AS account_lockouts, count(*) FILTER (WHERE action = 'pii.detected') AS pii_detections,
 concat_ws('; ', CASE WHEN failed_logins > logins * 0.1 THEN 'High failed login rate detected - consider implementing additional security measures' END,
  CASE WHEN account_lockouts > 0 THEN 'Account lockouts detected - review user training and password policies' END) AS recommendations FROM p""",
)
def compliance_report(t):
    return U.compliance_report(t.audit, t.users, U.default_roles(t.spark))


REQUESTS = """SELECT CAST(o_custkey AS STRING) AS user_name, CASE o_orderkey % 5 WHEN 0 THEN 'logs:read' WHEN 1 THEN 'logs:search' WHEN 2 THEN 'users:write' WHEN 3 THEN 'health:read' ELSE 'config:delete' END AS permission FROM orders"""


@query(
    "access_review",
    f"WITH {ctes('users')}, requests AS (SELECT DISTINCT * FROM ({REQUESTS}))"
    + """, g(role, permission) AS (VALUES ('admin', 'logs:read'), ('admin', 'users:write'), ('analyst', 'logs:read'), ('analyst', 'logs:search'), ('operator', 'logs:read'), ('operator', 'health:read'), ('viewer', 'logs:read'))
 SELECT r.user_name, r.permission, coalesce(u.role = 'super-admin' OR EXISTS (SELECT 1 FROM g WHERE g.role = u.role AND g.permission = r.permission), false) AS granted FROM requests r LEFT JOIN users u USING (user_name)""",
)
def access_review(t):
    orders = t.table("orders").selectExpr(
        "CAST(o_custkey AS STRING) AS user_name",
        "CASE o_orderkey % 5 WHEN 0 THEN 'logs:read' WHEN 1 THEN 'logs:search' WHEN 2 THEN 'users:write' WHEN 3 THEN 'health:read' ELSE 'config:delete' END AS permission",
    )
    return U.access_review(orders, t.users, U.default_roles(t.spark))


@query(
    "user_permissions",
    f"WITH {ctes('users')}"
    + """, g(role, k) AS (VALUES ('super-admin', 1), ('admin', 14), ('analyst', 7), ('operator', 5), ('viewer', 3)) SELECT user_name, k::BIGINT AS permissions FROM users JOIN g USING (role)""",
)
def user_permissions(t):
    granted = U.user_permissions(t.users, U.default_roles(t.spark))
    return granted.groupBy("user_name").agg(F.count(F.lit(1)).alias("permissions"))


TIERED = """tiered AS (SELECT id, timestamp, CAST(timestamp AS DATE) AS event_date, CASE WHEN timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 7 DAY THEN 'hot'
 WHEN timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 20 DAY THEN 'warm' ELSE 'cold' END AS tier FROM logs)"""


def tiered(t):
    return tiers.assign_tier(t.logs.select("id", "timestamp"), warm="20d")


@query("tier_assign", WITH_LOGS + ", " + TIERED + " SELECT * FROM tiered")
def tier_assign(t):
    """The given data spans 30 days, so the warm tier ends at 20."""
    return tiered(t)


@query("tier_counts", WITH_LOGS + ", " + TIERED + " SELECT tier, count(*) AS n FROM tiered GROUP BY 1")
def tier_counts(t):
    return tiers.tier_counts(tiered(t))


@query(
    "tier_union",
    WITH_LOGS + ", " + TIERED
    + """ SELECT id, timestamp, tier, CASE WHEN tier = 'hot' THEN event_date END AS event_date FROM tiered WHERE tier IN ('hot', 'warm')""",
)
def tier_union(t):
    """A query from ten days ago to now needs the hot and the warm tier; the warm one lacks a column."""
    rows = tiered(t)
    hot, warm = rows.where("tier = 'hot'"), rows.where("tier = 'warm'").drop("event_date")
    return tiers.union_tiers(hot, warm).select("id", "timestamp", "tier", "event_date")


@query(
    "tier_pruning",
    WITH_LOGS
    + """, q AS (SELECT service, min(timestamp) AS s, max(timestamp) - INTERVAL 1 DAY AS e, (SELECT max(timestamp) FROM logs) AS now FROM logs GROUP BY 1)
 SELECT service, concat_ws(',', CASE WHEN e >= now - INTERVAL 7 DAY THEN 'hot' END, CASE WHEN s < now - INTERVAL 7 DAY AND e >= now - INTERVAL 20 DAY THEN 'warm' END, CASE WHEN s < now - INTERVAL 20 DAY THEN 'cold' END) AS tiers FROM q""",
)
def tier_pruning(t):
    now = t.logs.agg(F.max("timestamp")).scalar()
    q = t.logs.groupBy("service").agg(F.min("timestamp").alias("s"), F.max("timestamp").alias("e"))
    needed = tiers.tiers_for(F.col("s"), F.col("e") - F.expr("INTERVAL 1 DAY"), F.col("now"), warm="20d")
    return q.withColumn("now", now).select("service", F.array_join(needed, ",").alias("tiers"))


@query(
    "retention",
    f"WITH {ctes('deployments')} SELECT * FROM deployments WHERE timestamp > (SELECT max(timestamp) FROM deployments) - INTERVAL 7 DAY",
)
def retention(t):
    return tiers.retain(t.deployments, "deployments")


@query(
    "tier_lifecycle",
    WITH_LOGS
    + """, n AS (SELECT *, (SELECT max(timestamp) FROM logs) AS now FROM logs), t AS (SELECT *, CASE WHEN timestamp >= now - INTERVAL 7 DAY THEN 'hot' WHEN timestamp >= now - INTERVAL 20 DAY THEN 'warm' ELSE 'cold' END AS tier FROM n)
 SELECT tier, timestamp::DATE AS day, count(*) AS n, min(timestamp) AS oldest, sum(response_time)::BIGINT AS response_time FROM t
 WHERE timestamp > now - CASE tier WHEN 'hot' THEN INTERVAL 5 DAY WHEN 'warm' THEN INTERVAL 15 DAY ELSE INTERVAL 25 DAY END GROUP BY 1, 2""",
)
def tier_lifecycle(t):
    """Records written to their tiers, expired there by age, and read back."""
    now = t.logs.agg(F.max("timestamp").alias("now")).first()["now"]
    base = scratch_path(t.spark, "tiers")
    rows = tiers.assign_tier(t.logs, as_of=now, warm="20d").drop("event_date")
    parts = []
    for tier, write, days in (("hot", files.write_hot, 5), ("warm", files.write_warm, 15), ("cold", files.write_cold, 25)):
        path = f"{base}/{tier}"
        write(rows.where(F.col("tier") == tier), path)
        if now is not None:
            files.expire(t.spark, path, now - timedelta(days=days))
        parts.append((files.read_cold(t.spark, path) if tier == "cold" else t.spark.read.schema(rows.schema).parquet(path)).select("tier", "timestamp", "response_time"))
    kept = tiers.union_tiers(*parts)
    return kept.groupBy("tier", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("oldest"), F.sum("response_time").alias("response_time"))
