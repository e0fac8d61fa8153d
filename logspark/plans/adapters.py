"""The given tables seen as logs, lines, spans, audit events, metrics, deployments and users.

The view texts run unchanged in Spark and in the oracle, so both sides start from equal rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators.metrics import service_metrics
from logspark.session import cut_lineage

LOGS = """
SELECT CAST(event_id AS STRING) AS id, event_id AS seq, ts AS timestamp,
 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
 concat('svc-', CAST(user_id % 8 AS STRING)) AS service,
 CASE user_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'staging' ELSE 'dev' END AS environment,
 concat('/', event_type) AS endpoint, CAST(floor(value * 10) AS BIGINT) AS response_time,
 CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 500 ELSE 503 END ELSE 200 END AS status_code,
 CAST(user_id AS STRING) AS user_id,
 concat('GET /', event_type, ' took ', CAST(CAST(floor(value * 10) AS BIGINT) AS STRING), ' ms user=', CAST(user_id AS STRING)) AS message
FROM events"""

LINES = """
SELECT seq AS line_no, concat('host-', CAST(seq % 4 AS STRING)) AS source,
 CASE seq % 5
 WHEN 0 THEN concat('{"timestamp":"', iso, '","level":"', level, '","service":"', service, '","message":"', message, '"}')
 WHEN 1 THEN concat(iso, ' ', level, ' [main] GET ', endpoint, ' response_time=', rt, 'ms ', message)
 WHEN 2 THEN concat('ts=', iso, ' level=', lower(level), ' service=', service, ' duration=', rt, 'ms status=', CAST(status_code AS STRING))
 WHEN 3 THEN concat('<', CAST(128 + CASE level WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 4 WHEN 'INFO' THEN 6 ELSE 7 END AS STRING), '>Jan 15 10:30:00 ', service, ' ', message)
 ELSE concat('10.0.0.', CAST(CAST(user_id AS BIGINT) % 250 AS STRING), ' - - "GET ', endpoint, '" ', CAST(status_code AS STRING), ' ', CAST(length(message) AS STRING), ' ', rt) END AS value
FROM (SELECT *, concat(replace(CAST(date_trunc('second', timestamp) AS STRING), ' ', 'T'), 'Z') AS iso, CAST(response_time AS STRING) AS rt FROM logs) x"""

SPANS = """
SELECT trace_id, span_id, CASE WHEN span_id > 1 THEN span_id - 1 END AS parent_span_id, service, operation, start_time, duration, error
FROM (SELECT l_orderkey AS trace_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS span_id,
  n_name AS service, concat('op-', l_returnflag) AS operation, l_shipdate AS start_time, l_quantity * 20 AS duration, l_returnflag = 'R' AS error
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) x"""

AUDIT = """
SELECT event_id, ts AS timestamp, CAST(user_id AS STRING) AS actor,
 CASE event_type WHEN 'signup' THEN 'auth.success' WHEN 'error' THEN 'auth.failed' WHEN 'view' THEN 'access.denied' WHEN 'purchase' THEN 'pii.detected' ELSE 'user.updated' END AS action,
 CASE WHEN event_type = 'error' THEN CASE event_id % 8 WHEN 0 THEN 'user_not_found' WHEN 4 THEN 'account_locked' ELSE 'invalid_password' END END AS reason
FROM events"""

METRICS = """
SELECT date_trunc('hour', timestamp) AS ts, service, 'error_rate' AS name, CAST(sum(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS value FROM logs GROUP BY 1, 2
UNION ALL SELECT date_trunc('hour', timestamp), service, 'latency_p95', CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY response_time) AS DOUBLE) FROM logs GROUP BY 1, 2
UNION ALL SELECT date_trunc('hour', timestamp), service, 'throughput', CAST(count(*) AS DOUBLE) / 3600 FROM logs GROUP BY 1, 2"""

DEPLOYMENTS = """
SELECT concat('svc-', CAST(user_id % 8 AS STRING)) AS service, concat('1.', CAST(event_id % 100 AS STRING)) AS version, ts AS timestamp
FROM events WHERE event_type = 'signup'"""

USERS = """
SELECT CAST(c_custkey AS STRING) AS user_name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'super-admin' WHEN 'BUILDING' THEN 'admin' WHEN 'FURNITURE' THEN 'analyst' WHEN 'HOUSEHOLD' THEN 'operator' ELSE 'viewer' END AS role, c_acctbal > 0 AS is_active
FROM customer"""

# Log messages as text lines: errors open a stack trace of two indented lines, warnings are indented notes.
TRACE_LINES = """
SELECT seq * 4 AS line_no, concat('host-', CAST(seq % 4 AS STRING)) AS source,
 CASE level WHEN 'ERROR' THEN concat('java.lang.IllegalStateException: ', message) WHEN 'WARN' THEN concat('  note ', message) ELSE message END AS value FROM logs
UNION ALL SELECT seq * 4 + 1, concat('host-', CAST(seq % 4 AS STRING)), concat('    at com.shop.', service, '.run(Main.java)') FROM logs WHERE level = 'ERROR'
UNION ALL SELECT seq * 4 + 2, concat('host-', CAST(seq % 4 AS STRING)), '    ... 3 more' FROM logs WHERE level = 'ERROR'"""

# Intake messages of three topics; some are not JSON.
MESSAGES = """
SELECT event_id, ts AS timestamp, CASE event_id % 4 WHEN 0 THEN 'app-metrics' WHEN 1 THEN 'traces' ELSE 'logs' END AS topic,
 CASE event_id % 4 WHEN 0 THEN concat('{"metricName":"', event_type, '","value":', CAST(user_id AS STRING), ',"labels":{"user":"', CAST(user_id AS STRING), '"}}')
 WHEN 1 THEN concat('{"traceID":"t', CAST(event_id AS STRING), '","spanID":"s1","operation":"', event_type, '","start":', CAST(event_id AS STRING), ',"end":', CAST(event_id + user_id AS STRING), ',"process":{"serviceName":"svc-', CAST(user_id % 8 AS STRING), '"}}')
 WHEN 2 THEN concat('{"time":"2024-01-01T00:00:00Z","severity":"', CASE event_type WHEN 'error' THEN 'CRITICAL' ELSE 'info' END, '","msg":"', event_type, '","serviceName":"svc-', CAST(user_id % 8 AS STRING), '","attributes":{"a":"1","b":"2"},"tags":{"b":"3"}}')
 ELSE CASE WHEN event_id % 3 = 0 THEN concat('{"broken":', event_type) ELSE concat('{"message":"', event_type, '","level":"WARN"}') END END AS value
FROM events"""

VIEWS = {
    "logs": LOGS,
    "lines": LINES,
    "trace_lines": TRACE_LINES,
    "messages": MESSAGES,
    "spans": SPANS,
    "audit": AUDIT,
    "metrics": METRICS,
    "deployments": DEPLOYMENTS,
    "users": USERS,
}
NEEDS = {"lines": ("logs",), "trace_lines": ("logs",), "metrics": ("logs",)}


def _ordered(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for one in (*NEEDS.get(name, ()), name):
            if one not in out:
                out.append(one)
    return out


def ctes(*names: str) -> str:
    """``a AS (...), b AS (...)`` for the named views and what they need."""
    return ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _ordered(names))


class Tables:
    """The given parquet tables of one folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def view(self, name: str) -> DataFrame:
        base = ", ".join(
            f"{t} AS (SELECT * FROM parquet.`{self.path(t)}`)"
            for t in ("events", "lineitem", "supplier", "nation", "customer")
        )
        return self.spark.sql(f"WITH {base}, {ctes(name)} SELECT * FROM {name}")

    @cached_property
    def logs(self) -> DataFrame:
        return self.view("logs")

    @cached_property
    def lines(self) -> DataFrame:
        return self.view("lines")

    @cached_property
    def spans(self) -> DataFrame:
        return self.view("spans")

    @cached_property
    def audit(self) -> DataFrame:
        return self.view("audit")

    @cached_property
    def deployments(self) -> DataFrame:
        return self.view("deployments")

    @cached_property
    def users(self) -> DataFrame:
        return self.view("users")

    @cached_property
    def metrics(self) -> DataFrame:
        """Hourly metrics, computed by the library instead of the view text; written once, as most users read them several times."""
        return cut_lineage(service_metrics(self.logs))

    @cached_property
    def metrics_as_of(self) -> Column:
        """Latest metric bucket, read from the logs instead of the derived metrics."""
        return self.logs.agg(F.date_trunc("hour", F.max("timestamp")).cast("timestamp_ntz")).scalar()

    def values(self, text: str) -> DataFrame:
        """A small literal table; the same text serves the oracle."""
        return self.spark.sql(f"SELECT * FROM ({text})")
