"""Search, paging, facets, histograms and rates."""

from pyspark.sql import functions as F

from logspark.operators import aggregate as A
from logspark.operators import metrics as M
from logspark.operators import search as S
from logspark.plans.adapters import ctes
from logspark.plans.registry import query

WITH_LOGS = f"WITH {ctes('logs')}"
ENTRY = "id, timestamp, level, service, endpoint, response_time, message"
ENTRY_COLUMNS = ENTRY.split(", ")


@query(
    "service_latency",
    WITH_LOGS
    + """
SELECT service, count(*) AS requests, count(*) FILTER (WHERE level IN ('ERROR','FATAL')) AS errors,
 count(*) FILTER (WHERE level IN ('ERROR','FATAL'))::DOUBLE / count(*) AS error_rate,
 quantile_disc(response_time, 0.5)::DOUBLE AS p50, quantile_disc(response_time, 0.9)::DOUBLE AS p90,
 quantile_disc(response_time, 0.95)::DOUBLE AS p95, quantile_disc(response_time, 0.99)::DOUBLE AS p99,
 CASE WHEN count(*) FILTER (WHERE level IN ('ERROR','FATAL'))::DOUBLE / count(*) < 0.05 AND avg(response_time) < 1000
  THEN 'healthy' ELSE 'degraded' END AS status
FROM logs GROUP BY service""",
)
def service_latency(t):
    return M.service_latency(t.logs)


@query("service_metrics", f"WITH {ctes('metrics')} SELECT * FROM metrics")
def service_metrics(t):
    return t.metrics


@query(
    "search_filtered",
    WITH_LOGS
    + f""" SELECT {ENTRY} FROM logs WHERE level IN ('ERROR','WARN') AND environment = 'prod' AND response_time >= 50
 AND timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""",
)
def search_filtered(t):
    found = S.fielded(
        t.logs,
        fields={"level": ["ERROR", "WARN"], "environment": "prod"},
        comparisons=[("response_time", ">=", 50)],
        start="2024-01-05 00:00:00",
        end="2024-01-20 12:00:00",
    )
    return S.project(found, ENTRY_COLUMNS)


@query(
    "search_words",
    WITH_LOGS
    + f""" SELECT {ENTRY} FROM logs WHERE list_contains(string_split_regex(lower(message), '[^\\p{{L}}\\p{{N}}_]+'), 'took')
 AND list_contains(string_split_regex(lower(message), '[^\\p{{L}}\\p{{N}}_]+'), 'error') AND service IN ('svc-1','svc-3')""",
)
def search_words(t):
    return S.project(S.fielded(t.logs, fields={"service": ["svc-1", "svc-3"]}, text="ERROR took"), ENTRY_COLUMNS)


@query(
    "search_substring",
    "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')",
)
def search_substring(t):
    return t.table("documents").where(S.contains_text("License", field="text")).select("doc_id", "source")


@query(
    "search_regex",
    r"SELECT page_id, url FROM pages WHERE regexp_matches(html, '(?i)<title>[^<]*(error|the)[^<]*</title>')",
)
def search_regex(t):
    return t.table("pages").where(S.matches(r"<title>[^<]*(error|the)[^<]*</title>", field="html")).select("page_id", "url")


@query(
    "relative_range",
    WITH_LOGS
    + f""" SELECT {ENTRY} FROM logs WHERE timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 7 DAY
 AND timestamp <= (SELECT max(timestamp) FROM logs)""",
)
def relative_range(t):
    return S.project(S.within(t.logs, "7d"), ENTRY_COLUMNS)


@query(
    "entries_filter",
    WITH_LOGS
    + f""" SELECT {ENTRY} FROM logs WHERE level = 'ERROR' AND contains(endpoint, 'err') AND contains(lower(message), 'user=1')
 AND timestamp >= TIMESTAMP '2024-01-02 00:00:00' AND timestamp <= TIMESTAMP '2024-01-28 00:00:00'""",
)
def entries_filter(t):
    found = S.entries(t.logs, level="error", endpoint="err", start="2024-01-02 00:00:00", end="2024-01-28 00:00:00", text="USER=1")
    return S.project(found, ENTRY_COLUMNS)


@query(
    "entries_page",
    WITH_LOGS
    + f""", m AS (SELECT {ENTRY} FROM logs WHERE level = 'WARN')
 SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY timestamp DESC, id LIMIT 50 OFFSET 100""",
)
def entries_page(t):
    return S.page(S.project(S.entries(t.logs, level="warn"), ENTRY_COLUMNS), 3, 50)


@query(
    "quick_search",
    WITH_LOGS
    + f"""  SELECT {ENTRY} FROM logs WHERE level = 'ERROR' AND contains(service, 'svc') AND contains(lower(message), 'took')
 AND timestamp >= (SELECT max(timestamp) FROM logs) - INTERVAL 24 HOUR""",
)
def quick_search(t):
    return S.project(S.quick_search(t.logs, text="Took", level="ERROR", service="svc", time_range="24h"), ENTRY_COLUMNS)


@query("newest_logs", WITH_LOGS + f" SELECT {ENTRY} FROM logs ORDER BY timestamp DESC, id LIMIT 100 OFFSET 20")
def newest_logs(t):
    return S.newest(S.project(t.logs, ENTRY_COLUMNS), offset=20, limit=100)


@query(
    "newest_after",
    WITH_LOGS
    + f""" SELECT {ENTRY} FROM logs WHERE timestamp < TIMESTAMP '2024-01-15 00:00:00'
 OR (timestamp = TIMESTAMP '2024-01-15 00:00:00' AND id > '5000') ORDER BY timestamp DESC, id LIMIT 100""",
)
def newest_after(t):
    from datetime import datetime

    return S.newest_after(S.project(t.logs, ENTRY_COLUMNS), (datetime(2024, 1, 15), "5000"), limit=100)


@query(
    "relevance",
    """SELECT doc_id, (len(regexp_extract_all(lower(text), 'the')) + len(regexp_extract_all(lower(text), 'tion')))::BIGINT AS score
 FROM documents""",
)
def relevance(t):
    return S.relevance(t.table("documents"), "the TION", field="text").select("doc_id", "score")


@query(
    "sql_errors_by_service",
    WITH_LOGS
    + """ SELECT service, count(*) AS error_count FROM logs WHERE level = 'ERROR' AND timestamp > TIMESTAMP '2024-01-10 00:00:00'
 GROUP BY service ORDER BY error_count DESC, service LIMIT 5""",
)
def sql_errors_by_service(t):
    """SQL over the log table is Spark SQL with named parameters."""
    return t.spark.sql(
        "SELECT service, count(*) AS error_count FROM {logs} WHERE level = :level AND timestamp > CAST(:since AS TIMESTAMP_NTZ)"
        " GROUP BY service ORDER BY error_count DESC, service LIMIT 5",
        args={"level": "ERROR", "since": "2024-01-10 00:00:00"},
        logs=t.logs,
    )


@query(
    "terms_level",
    WITH_LOGS + " SELECT level AS value, count(*) AS n FROM logs GROUP BY level ORDER BY n DESC, value LIMIT 10",
)
def terms_level(t):
    return A.terms(t.logs, "level")


@query(
    "terms_user",
    WITH_LOGS + " SELECT user_id AS value, count(*) AS n FROM logs GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
)
def terms_user(t):
    return A.terms(t.logs, "user_id")


@query(
    "date_histogram",
    WITH_LOGS + " SELECT date_trunc('day', timestamp)::TIMESTAMP AS bucket, count(*) AS n FROM logs GROUP BY 1",
)
def date_histogram(t):
    return A.date_histogram(t.logs, "day")


@query(
    "date_histogram_week",
    WITH_LOGS
    + """ SELECT (date_trunc('week', timestamp + INTERVAL 1 DAY) - INTERVAL 1 DAY)::TIMESTAMP AS bucket, count(*) AS n
 FROM logs GROUP BY 1""",
)
def date_histogram_week(t):
    return A.date_histogram(t.logs, "week", week_start="sunday")


FACETS = """, pairs AS (
 SELECT 'level' AS field, level AS value FROM logs UNION ALL SELECT 'service', service FROM logs
 UNION ALL SELECT 'environment', environment FROM logs UNION ALL SELECT 'status_code', CAST(status_code AS VARCHAR) FROM logs),
 counts AS (SELECT field, value, count(*) AS n FROM pairs WHERE value IS NOT NULL GROUP BY 1, 2)"""


@query(
    "facets",
    WITH_LOGS
    + FACETS
    + """ SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS INTEGER) AS rank
 FROM counts) WHERE rank <= 10""",
)
def facets(t):
    return A.facets(t.logs)


@query("facets_all", WITH_LOGS + FACETS + " SELECT * FROM counts WHERE field IN ('level', 'service')")
def facets_all(t):
    return A.facets(t.logs, ("level", "service"), size=None)


@query(
    "search_aggs",
    WITH_LOGS
    + """, m AS (SELECT * FROM logs WHERE environment = 'prod' AND timestamp >= TIMESTAMP '2024-01-10 00:00:00'
  AND timestamp <= TIMESTAMP '2024-01-12 00:00:00')
 SELECT 'terms:service' AS agg, service AS value, count(*) AS n FROM m GROUP BY service
 UNION ALL SELECT 'date_histogram:hour', strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S'), count(*) FROM m GROUP BY 2""",
)
def search_aggs(t):
    found = S.fielded(t.logs, fields={"environment": "prod"}, start="2024-01-10 00:00:00", end="2024-01-12 00:00:00")
    return A.search_with_aggs(found, terms_of=["service"], histogram="hour")


BUCKET = "time_bucket(INTERVAL 5 MINUTE, timestamp)"


@query("volume_5m", WITH_LOGS + f" SELECT {BUCKET} AS bucket, count(*) AS n, count(*)::DOUBLE / 300 AS rate FROM logs GROUP BY 1")
def volume_5m(t):
    return A.volume_rate(t.logs)


@query(
    "error_ratio_5m",
    WITH_LOGS
    + f""" SELECT {BUCKET} AS bucket, count(*) AS n, count(*) FILTER (WHERE level IN ('ERROR','FATAL')) AS errors,
 count(*) FILTER (WHERE level IN ('ERROR','FATAL'))::DOUBLE / count(*) AS ratio FROM logs GROUP BY 1""",
)
def error_ratio_5m(t):
    return A.error_ratio(t.logs)


@query(
    "top_services",
    WITH_LOGS
    + """, r AS (SELECT date_trunc('hour', timestamp)::TIMESTAMP AS bucket, service, count(*) AS n, count(*)::DOUBLE / 3600 AS rate
 FROM logs GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY bucket ORDER BY n DESC, service) AS INTEGER) AS rank
 FROM r) WHERE rank <= 3""",
)
def top_services(t):
    return A.top_services(t.logs, k=3, width="1 hour", seconds=3600)


@query(
    "availability_1h",
    WITH_LOGS
    + """ SELECT date_trunc('hour', timestamp)::TIMESTAMP AS bucket, service,
 sum(CASE WHEN status_code < 500 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS availability, count(*) AS n FROM logs GROUP BY 1, 2""",
)
def availability_1h(t):
    return A.availability(t.logs.withColumn("up", F.col("status_code") < 500))


HISTOGRAM = """, hist AS (SELECT service, b.le AS le, count(*) FILTER (WHERE response_time <= b.le) AS count
 FROM logs, (SELECT unnest([1.0,5.0,10.0,25.0,50.0,100.0,250.0,500.0,1000.0,2500.0,5000.0,'inf'::DOUBLE]) AS le) b GROUP BY 1, 2)"""


@query("latency_histogram", WITH_LOGS + HISTOGRAM + " SELECT service, le, count FROM hist")
def latency_histogram(t):
    return M.latency_histogram(t.logs, "response_time", by=["service"])


@query(
    "histogram_p95",
    WITH_LOGS
    + HISTOGRAM
    + """, w AS (SELECT *, max(count) OVER (PARTITION BY service) AS n, lag(le) OVER (PARTITION BY service ORDER BY le) AS low,
  lag(count) OVER (PARTITION BY service ORDER BY le) AS low_n FROM hist),
 f AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY le) AS k FROM w WHERE count >= 0.95 * n)
 SELECT service, n, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (0.95 * n - coalesce(low_n, 0))
  / (count - coalesce(low_n, 0)) END, 6) AS quantile FROM f WHERE k = 1""",
)
def histogram_p95(t):
    hist = M.latency_histogram(t.logs, "response_time", by=["service"])
    return M.histogram_quantile(hist, 0.95, by=["service"]).withColumn("quantile", F.round("quantile", 6))


@query(
    "log_metrics",
    WITH_LOGS
    + """ SELECT * FROM (SELECT id, timestamp AS ts, service, 'latency_p95' AS name, response_time::DOUBLE AS value FROM logs WHERE response_time <> 0
 UNION ALL SELECT id, timestamp, service, 'error_rate', CASE WHEN level = 'ERROR' THEN 1.0 ELSE 0.0 END::DOUBLE FROM logs
 UNION ALL SELECT id, timestamp, service, 'status_code', status_code::DOUBLE FROM logs)""",
)
def log_metrics(t):
    return M.log_metrics(t.logs)


@query("ingest_counts", WITH_LOGS + " SELECT service, level, count(*) AS n FROM logs GROUP BY 1, 2")
def ingest_counts(t):
    return M.ingest_counts(t.logs, ["service", "level"])
