"""Anomaly detection and baselines."""

from pyspark.sql import functions as F

from logspark.operators import anomaly as A
from logspark.plans.adapters import ctes
from logspark.plans.registry import query
from logspark.session import cut_lineage

WITH_LOGS = f"WITH {ctes('logs')}"
WITH_METRICS = f"WITH {ctes('metrics')}"

THRESHOLD_ROWS = """SELECT 'threshold' AS type, name AS metric, service, value, threshold, least(1.0::DOUBLE, value / threshold) AS confidence, ts, 'statistical' AS algorithm
 FROM metrics JOIN (VALUES ('error_rate', 0.05::DOUBLE), ('latency_p95', 1000.0::DOUBLE)) th(tn, threshold) ON tn = name WHERE value > threshold"""


def threshold_rows(t):
    return A.threshold_anomalies(t.metrics, A.default_thresholds(t.spark))


@query("threshold_anomalies", WITH_METRICS + " " + THRESHOLD_ROWS)
def threshold_anomalies(t):
    return threshold_rows(t)


def spike_sql(age: str) -> str:
    return f"""w AS (SELECT event_type AS name, ts, event_id AS seq, value, avg(value) OVER p AS baseline, stddev_pop(value) OVER p AS sd,
  count(*) OVER p AS n, min(ts) OVER p AS oldest FROM events WINDOW p AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)),
 z AS (SELECT *, abs(value - baseline) / CASE WHEN sd = 0 THEN 1.0 ELSE sd END AS z_score FROM w WHERE n = 10 {age}),
 spikes AS (SELECT name, ts, seq, value, baseline, z_score, least(1.0::DOUBLE, z_score / 5) AS confidence FROM z WHERE z_score > 3)"""


SPIKE_COLUMNS = "name, ts, seq, value, round(baseline, 6) AS baseline, round(z_score, 5) AS z_score, round(confidence, 5) AS confidence"


def series(t):
    e = t.table("events")
    return e.select(F.col("event_type").alias("name"), "ts", F.col("event_id").alias("seq"), "value")


def rounded(df):
    return df.withColumns({"baseline": F.round("baseline", 6), "z_score": F.round("z_score", 5), "confidence": F.round("confidence", 5)})


@query("zscore_spikes", "WITH " + spike_sql("") + f" SELECT {SPIKE_COLUMNS} FROM spikes")
def zscore_spikes(t):
    return rounded(A.zscore_spikes(series(t), ["name"], max_age_seconds=None))


@query("zscore_spikes_recent", "WITH " + spike_sql("AND oldest > ts - INTERVAL 3 HOUR") + f" SELECT {SPIKE_COLUMNS} FROM spikes")
def zscore_spikes_recent(t):
    """Only windows whose values all fall into the last three hours; small chunks exercise the look-back copies."""
    return rounded(A.zscore_spikes(series(t), ["name"], max_age_seconds=3 * 3600, chunk_rows=64))


def pattern_sql(text: str) -> str:
    for name, pattern in A.PLACEHOLDERS:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


@query(
    "pattern_counts",
    WITH_LOGS + f" SELECT {pattern_sql('message')} AS pattern, count(*) AS n, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM logs GROUP BY 1",
)
def pattern_counts(t):
    return A.pattern_counts(t.logs)


@query(
    "rare_patterns",
    f"""WITH p AS (SELECT event_id AS id, ts AS timestamp, {pattern_sql("concat(event_type, ' ', CAST(user_id // 4 % 2 AS VARCHAR), ' ', props, ' u', chr(CAST(97 + user_id % 26 AS INTEGER)))")} AS pattern FROM events)
 SELECT id, timestamp, pattern, CAST(occurrence AS INTEGER) AS occurrence, 0.7::DOUBLE AS confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY timestamp, id) AS occurrence FROM p) WHERE occurrence <= 5""",
)
def rare_patterns(t):
    e = t.table("events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.expr("concat(event_type, ' ', CAST(user_id div 4 % 2 AS STRING), ' ', props, ' u', char(97 + user_id % 26))").alias("message"),
    )
    return A.rare_patterns(e)


def burst_sql(partition: str, columns: str, width: str, above: int) -> str:
    return (
        WITH_LOGS
        + f""", e AS (SELECT *, count(*) OVER ({partition} ORDER BY timestamp RANGE BETWEEN {width} - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW) AS k
  FROM logs WHERE level = 'ERROR') SELECT {columns} timestamp, count(*) AS errors, k AS errors_in_window FROM e WHERE k > {above} GROUP BY ALL"""
    )


@query("error_bursts", burst_sql("PARTITION BY service", "service,", "INTERVAL 1 HOUR", 2))
def error_bursts(t):
    """Per service; a one-hour window, because this data is too thin for more than five in five minutes."""
    return A.error_bursts(t.logs, window_seconds=3600, above=2)


@query("error_bursts_global", burst_sql("", "", "INTERVAL 1 HOUR", 5))
def error_bursts_global(t):
    return A.error_bursts(t.logs, by=[], window_seconds=3600)


STATS = """kept AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, service) AS rn FROM metrics WHERE ts > (SELECT max(ts) FROM metrics) - INTERVAL 7 DAY),
 stats AS (SELECT name, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std, regr_slope(value, rn) AS trend FROM kept GROUP BY name)"""


@query(
    "baseline_stats",
    WITH_METRICS + ", " + STATS + " SELECT name, n, round(mean, 6) AS mean, round(std, 6) AS std, round(trend, 8) AS trend FROM stats",
)
def baseline_stats(t):
    s = A.baseline_stats(t.metrics, as_of=t.metrics_as_of)
    return s.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6), "trend": F.round("trend", 8)})


SEASON = """season AS (SELECT name, 'hourly' AS cycle, hour(ts)::INTEGER AS slot, sum(value) AS sum, count(*) AS count FROM metrics GROUP BY 1, 3
 UNION ALL SELECT name, 'daily', dayofweek(ts)::INTEGER, sum(value), count(*) FROM metrics GROUP BY 1, 3)"""


@query("seasonality", WITH_METRICS + ", " + SEASON + " SELECT name, cycle, slot, round(sum, 6) AS sum, count FROM season")
def seasonality(t):
    return A.seasonality(t.metrics).withColumn("sum", F.round("sum", 6))


BAND = (
    STATS + ", " + SEASON
    + """, band AS (SELECT name, slot AS hour, sum / count AS expected, std, sum / count + 2 * std AS upper, greatest(0.0::DOUBLE, sum / count - 2 * std) AS lower
 FROM season JOIN stats USING (name) WHERE cycle = 'hourly')"""
)


@query(
    "baseline_band",
    WITH_METRICS + ", " + BAND + " SELECT name, hour, round(expected, 6) AS expected, round(std, 6) AS std, round(upper, 6) AS upper, round(lower, 6) AS lower FROM band",
)
def baseline_band(t):
    return A.expected_band(t.metrics, as_of=t.metrics_as_of).withColumns({c: F.round(c, 6) for c in ("expected", "std", "upper", "lower")})


@query(
    "band_breaches",
    WITH_METRICS + ", " + BAND
    + """ SELECT ts, service, name, value, hour, round(expected, 6) AS expected, round(upper, 6) AS upper, round(lower, 6) AS lower
 FROM metrics JOIN band USING (name) WHERE hour = hour(ts) AND (value < lower OR value > upper)""",
)
def band_breaches(t):
    return A.band_breaches(t.metrics, as_of=t.metrics_as_of).withColumns({c: F.round(c, 6) for c in ("expected", "upper", "lower")})


@query(
    "throughput_drop",
    WITH_LOGS
    + """, seen AS (SELECT service, date_trunc('hour', timestamp)::TIMESTAMP AS bucket, count(*) AS n FROM logs GROUP BY 1, 2),
 steps AS (SELECT service, unnest(range(min(bucket), (SELECT max(bucket) FROM seen) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS bucket FROM seen GROUP BY 1),
 c AS (SELECT service, bucket, coalesce(n, 0) AS n FROM steps LEFT JOIN seen USING (service, bucket)),
 w AS (SELECT *, avg(n) OVER p AS baseline, count(*) OVER p AS k FROM c WINDOW p AS (PARTITION BY service ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
 SELECT service, bucket, n, round(baseline, 6) AS baseline FROM w WHERE k = 24 AND n <= 0.7 * baseline""",
)
def throughput_drop(t):
    return A.throughput_drop(t.logs).withColumn("baseline", F.round("baseline", 6))


SPIKE_ROWS = """SELECT 'time_series_spike' AS type, name AS metric, NULL AS service, value, NULL::DOUBLE AS threshold, confidence, ts, 'timeSeries' AS algorithm FROM spikes"""


def all_anomalies(t):
    spikes = A.zscore_spikes(series(t), ["name"], max_age_seconds=None)
    as_rows = spikes.select(
        F.lit("time_series_spike").alias("type"), F.col("name").alias("metric"), F.lit(None).cast("string").alias("service"),
        "value", F.lit(None).cast("double").alias("threshold"), "confidence", "ts", F.lit("timeSeries").alias("algorithm"),
    )
    return threshold_rows(t).withColumn("ts", F.col("ts").cast("timestamp_ntz")).unionByName(as_rows)


ANOMALIES = WITH_METRICS + ", " + spike_sql("") + f", anomalies AS ({THRESHOLD_ROWS} UNION ALL {SPIKE_ROWS})"


@query(
    "anomaly_merge",
    ANOMALIES
    + """ SELECT type, metric, date_trunc('minute', ts)::TIMESTAMP AS minute, round(max(confidence), 5) AS confidence, count(*) AS hits,
 string_agg(DISTINCT algorithm, ',') AS algorithms FROM anomalies GROUP BY 1, 2, 3 HAVING max(confidence) >= 0.95""",
)
def anomaly_merge(t):
    return A.merge_anomalies(all_anomalies(t)).withColumn("confidence", F.round("confidence", 5))


@query(
    "recent_anomalies",
    ANOMALIES
    + """ SELECT type, metric, service, value, threshold, round(confidence, 5) AS confidence, ts, algorithm FROM anomalies
 WHERE ts > (SELECT max(ts) FROM anomalies) - INTERVAL 24 HOUR ORDER BY ts DESC, type, metric, service LIMIT 10""",
)
def recent_anomalies(t):
    # Read twice, for the rows and for the latest time.
    return A.recent_anomalies(cut_lineage(all_anomalies(t))).withColumn("confidence", F.round("confidence", 5))


@query("cluster_outliers")
def cluster_outliers(t):
    """Iterative clustering has no SQL form; rows only."""
    names = ["error_rate", "latency_p95", "throughput"]
    return A.cluster_outliers(A.metric_vectors(t.metrics, names), names)


@query(
    "mahalanobis_outliers",
    WITH_METRICS
    + """, v AS (SELECT ts, service, max(value) FILTER (WHERE name = 'error_rate') AS x, max(value) FILTER (WHERE name = 'latency_p95') AS y, max(value) FILTER (WHERE name = 'throughput') AS z FROM metrics GROUP BY 1, 2),
 c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, var_pop(y) AS d, covar_pop(y, z) AS e, var_pop(z) AS f FROM v WHERE x + y + z IS NOT NULL),
 i AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM c),
 m AS (SELECT ts, service, x, y, z, ((d * f - e * e) * (x - mx) ** 2 + (a * f - c * c) * (y - my) ** 2 + (a * d - b * b) * (z - mz) ** 2
  + 2 * (c * e - b * f) * (x - mx) * (y - my) + 2 * (b * e - c * d) * (x - mx) * (z - mz) + 2 * (b * c - a * e) * (y - my) * (z - mz)) / det AS q FROM v, i WHERE x + y + z IS NOT NULL)
 SELECT ts, service, round(x, 9) AS error_rate, y AS latency_p95, round(z, 9) AS throughput, round(sqrt(q), 5) AS distance, 0.8::DOUBLE AS confidence FROM m WHERE sqrt(q) > 3""",
)
def mahalanobis_outliers(t):
    """Hours of a service whose metrics are unusual together."""
    names = ["error_rate", "latency_p95", "throughput"]
    found = A.mahalanobis_outliers(A.metric_vectors(t.metrics, names), names)
    return found.withColumns({"error_rate": F.round("error_rate", 9), "throughput": F.round("throughput", 9), "distance": F.round("distance", 5)})
