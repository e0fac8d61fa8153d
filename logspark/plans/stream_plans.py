"""Streaming twins over the given tables: everything available is processed, then read back.

Append mode emits closed windows only, so each oracle keeps the windows that end before the
watermark (latest event time minus the delay).
"""

from pyspark.sql import functions as F

from logspark.operators import alerts as L
from logspark.operators import anomaly as A
from logspark.operators import metrics as M
from logspark.operators import parse as P
from logspark.operators.ordered import micros
from logspark.plans.adapters import ctes
from logspark.plans.anomaly_plans import STATS, WITH_METRICS, burst_sql, pattern_sql
from logspark.plans.registry import query
from logspark.plans.topology_plans import CALLS, WITH_SPANS
from logspark.session import scratch_path
from logspark.streaming import jobs as J
from logspark.streaming import continuous, late, state
from logspark.streaming.tables import in_runs

WITH_LOGS = f"WITH {ctes('logs')}"
CLOSED = "(SELECT max(timestamp) FROM logs) - INTERVAL 10 MINUTE"


def log_stream(t):
    return as_logs(J.file_stream(t.spark, t.sf_dir, t.table("events").schema, glob="events.parquet"))


def as_logs(events):
    return events.selectExpr(
        "CAST(event_id AS STRING) AS id", "event_id AS seq", "CAST(ts AS TIMESTAMP) AS timestamp",
        "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level",
        "concat('svc-', user_id % 8) AS service", "event_type", "value", "CAST(floor(value * 10) AS BIGINT) AS response_time",
        "concat('GET /', event_type, ' took ', CAST(floor(value * 10) AS BIGINT), ' ms user=', user_id) AS message",
    )


def by_time(df, ts, pieces):
    """Number of the piece, from 1, of equal stretches of the time range."""
    low, high = df.agg(F.min(micros(F.col(ts))), F.max(micros(F.col(ts)))).first()
    return (F.floor((micros(F.col(ts)) - low) * pieces / ((high or 0) - (low or 0) + 1)) + 1).cast("int") if low is not None else F.lit(1)


def over_runs(t, make, name, pieces=3):
    """The rows that ``make`` gives for log records that arrive over several runs, each starting from the checkpoint."""
    events, base, kinds = t.table("events"), scratch_path(t.spark, name), []
    piece = by_time(events, "ts", pieces)

    def start(stream):
        rows = make(as_logs(stream))
        kinds.append(rows.schema)
        return rows.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()

    in_runs(t.spark, [events.where(piece == k) for k in range(1, pieces + 1)], start)
    return t.spark.read.schema(kinds[0]).parquet(f"{base}/table")


def ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(
    "stream_error_burst",
    WITH_LOGS
    + f""", k AS (SELECT time_bucket(INTERVAL 20 MINUTE, timestamp) - to_minutes(20 * i::INTEGER) AS window_start FROM logs, (SELECT unnest(range(3)) AS i) WHERE level = 'ERROR')
 SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS errors FROM k WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM logs WHERE level = 'ERROR') - INTERVAL 10 MINUTE GROUP BY 1 HAVING count(*) > 5""",
)
def stream_error_burst(t):
    bursts = over_runs(t, lambda logs: J.sliding_error_bursts(logs, width="1 hour", slide="20 minutes"), "error-burst")
    return ntz(bursts, "window_start", "window_end")


@query(
    "stream_ticks",
    WITH_LOGS
    + f""" SELECT date_trunc('minute', timestamp)::TIMESTAMP AS bucket, service, count(*) AS n, count(*) FILTER (WHERE level = 'ERROR') AS errors FROM logs
 WHERE date_trunc('minute', timestamp) + INTERVAL 1 MINUTE <= {CLOSED} GROUP BY 1, 2""",
)
def stream_ticks(t):
    return ntz(J.run_available(J.ticks(log_stream(t)), "ticks"), "bucket")


@query(
    "stream_burn_rate",
    WITH_LOGS
    + f""" SELECT time_bucket(INTERVAL 6 HOUR, timestamp) AS bucket, concat(service, '-availability') AS slo, count(*) AS n, round(count(*) FILTER (WHERE level = 'ERROR')::DOUBLE / count(*) / 0.1, 6) AS burn_rate
 FROM logs WHERE service IS NOT NULL AND time_bucket(INTERVAL 6 HOUR, timestamp) + INTERVAL 6 HOUR <= {CLOSED} GROUP BY 1, 2""",
)
def stream_burn_rate(t):
    """One SLO for every service."""
    none = lambda kind: F.lit(None).cast(kind)
    services = t.logs.where("service IS NOT NULL").select("service").distinct()
    slos = services.select(
        F.concat("service", F.lit("-availability")).alias("slo"), "service", F.lit(0.9).alias("objective"), none("double").alias("error_budget"), none("string").alias("window"), F.lit(1.5).alias("burn_rate_threshold"),
    )
    rates = J.run_available(J.burn_rate_ticks(log_stream(t), L.slo_defaults(slos), width="6 hours"), "burn-rate")
    return ntz(rates, "bucket").select("bucket", "slo", "n", F.round("burn_rate", 6).alias("burn_rate"))


@query(
    "stream_alert_sessions",
    WITH_LOGS
    + f""", f AS (SELECT 'error_seen' AS rule_name, service, timestamp, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY service ORDER BY timestamp) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM logs WHERE level = 'ERROR'),
 g AS (SELECT *, sum(o) OVER (PARTITION BY service ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS k FROM f)
 SELECT rule_name, service, min(timestamp) AS starts_at, max(timestamp) AS last_seen, count(*) AS n FROM g GROUP BY rule_name, service, k HAVING max(timestamp) + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM logs WHERE level = 'ERROR') - INTERVAL 10 MINUTE""",
)
def stream_alert_sessions(t):
    errors = lambda logs: logs.where("level = 'ERROR'").select(F.lit("error_seen").alias("rule_name"), "service", F.col("timestamp").alias("ts"))
    return ntz(over_runs(t, lambda logs: J.alert_sessions(errors(logs), gap="1 hour"), "alert-sessions"), "starts_at", "last_seen")


@query("stream_tail", WITH_LOGS + " SELECT id, timestamp, level, message FROM logs WHERE level = 'ERROR' AND service = 'svc-2'")
def stream_tail(t):
    tail = J.live_tail(log_stream(t), (F.col("level") == "ERROR") & (F.col("service") == "svc-2"))
    return ntz(J.run_available(tail.select("id", "timestamp", "level", "message"), "tail"), "timestamp")


@query(
    "stream_spikes",
    """WITH w AS (SELECT event_type AS name, ts, event_id AS seq, value, avg(value) OVER p AS baseline, stddev_pop(value) OVER p AS sd, count(*) OVER p AS n, min(ts) OVER p AS oldest
  FROM events WINDOW p AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
 SELECT name, ts, seq, value, round(baseline, 6) AS baseline, round(abs(value - baseline) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 5) AS z_score FROM w
 WHERE n = 10 AND oldest > ts - INTERVAL 3 HOUR AND abs(value - baseline) / CASE WHEN sd = 0 THEN 1 ELSE sd END > 3""",
)
def stream_spikes(t):
    series = lambda logs: logs.select(F.col("event_type").alias("name"), F.col("timestamp").alias("ts"), "seq", "value")
    found = ntz(over_runs(t, lambda logs: J.spikes(series(logs), max_age_seconds=3 * 3600), "spikes"), "ts")
    return found.withColumns({"baseline": F.round("baseline", 6), "z_score": F.round("z_score", 5)})


@query(
    "stream_multiline",
    WITH_LOGS
    + """, e AS (SELECT *, concat('host-', seq % 4) AS source, lead(timestamp) OVER (PARTITION BY seq % 4 ORDER BY seq) AS nxt FROM logs)
 SELECT source, seq * 4 AS line_no, CASE level WHEN 'ERROR' THEN concat('java.lang.IllegalStateException: ', message, chr(10), '    at com.shop.', service, chr(10), '    ... 3 more') ELSE message END AS value,
 CASE level WHEN 'ERROR' THEN 3 ELSE 1 END::BIGINT AS lines FROM e
 WHERE NOT (level = 'ERROR' AND nxt IS NULL AND timestamp + INTERVAL 5 SECOND >= (SELECT max(timestamp) FROM logs) - INTERVAL 1 MINUTE)""",
)
def stream_multiline(t):
    """An entry opened by the last line of its source stays open until the watermark passes it."""
    trace = F.array(F.concat(F.lit("java.lang.IllegalStateException: "), "message"), F.concat(F.lit("    at com.shop."), "service"), F.lit("    ... 3 more"))

    def lines(logs):
        return logs.select(
            F.concat(F.lit("host-"), (F.col("seq") % 4).cast("string")).alias("source"), "timestamp", "seq",
            F.posexplode(F.when(F.col("level") == "ERROR", trace).otherwise(F.array("message"))).alias("pos", "value"),
        ).select("source", "timestamp", (F.col("seq") * 4 + F.col("pos")).alias("line_no"), "value")

    return over_runs(t, lambda logs: J.multiline_entries(lines(logs)), "multiline")


@query(
    "stream_fan_out",
    WITH_LOGS
    + """ SELECT 'logs' AS output, count(*) AS n FROM logs UNION ALL SELECT 'metrics', count(*) + count(*) FILTER (WHERE response_time <> 0) FROM logs
 UNION ALL SELECT 'errors', count(*) FILTER (WHERE level = 'ERROR') FROM logs""",
)
def stream_fan_out(t):
    """The continuous job: parsed records, metric samples and errors as three tables of one stream."""
    text = F.concat_ws(" ", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "level", F.lit("[main]"), "message")
    parsed = P.parse_logs(log_stream(t).select(text.alias("value"), "id", F.col("response_time").alias("ms"))).withColumn("response_time", F.col("ms"))
    base = scratch_path(t.spark, "fan-out")
    outputs = {"logs": lambda b: b, "metrics": M.log_metrics, "errors": lambda b: b.where("level = 'ERROR'")}
    J.fan_out(parsed, outputs, f"{base}/tables", f"{base}/checkpoint").awaitTermination()
    parts = [t.spark.read.parquet(f"{base}/tables/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("output"), "n") for n in outputs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Quarters of the time range of the events; every 25th event comes one quarter late.
ARRIVALS = """a AS (SELECT *, CASE WHEN event_id % 25 = 0 THEN least(q + 1, 4) ELSE q END AS arrival FROM (
 SELECT *, 1 + (4 * (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))) // (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events) AS q FROM events) x)"""


def log_pieces(t, *, delayed, pieces=4):
    """Log records in pieces by time; if ``delayed``, every 25th comes one piece late."""
    logs = t.logs.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    piece = by_time(logs, "timestamp", pieces)
    if delayed:
        piece = F.when(F.col("seq") % 25 == 0, F.least(piece + 1, F.lit(pieces))).otherwise(piece)
    held = logs.withColumn("__piece", piece)
    return [held.where(F.col("__piece") == k).drop("__piece") for k in range(1, pieces + 1)]


TICK = "date_trunc('minute', timestamp)::TIMESTAMP"


@query(
    "stream_late_repair",
    f"""WITH {ctes("logs")}, {ARRIVALS}, m AS (SELECT arrival, max(ts) AS top FROM a GROUP BY 1),
 b AS (SELECT a.*, ts < (SELECT max(top) FROM m WHERE m.arrival < a.arrival) - INTERVAL 10 MINUTE AS late FROM a),
 r AS (SELECT logs.*, coalesce(late, false) AS late FROM logs JOIN b ON seq = event_id)
 SELECT {TICK} AS bucket, service, count(*) AS n, count(*) FILTER (WHERE level = 'ERROR') AS errors, count(*) FILTER (WHERE late) AS late FROM r GROUP BY 1, 2""",
)
def stream_late_repair(t):
    """Minute counts per service written by day from the rows in time, then repaired for the days of late rows."""
    base = scratch_path(t.spark, "late")
    pieces = log_pieces(t, delayed=True)
    schema = pieces[0].schema
    in_runs(t.spark, pieces, lambda stream: late.land(stream, f"{base}/landed", f"{base}/checkpoint"))
    minute = lambda rows: rows.groupBy(F.date_trunc("minute", "timestamp").alias("bucket"), "service").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == "ERROR").alias("errors"))
    in_time = late.read_daily(t.spark, f"{base}/landed/rows", schema)
    late.overwrite_days(minute(in_time).withColumn("event_date", F.to_date("bucket")), f"{base}/ticks")
    late.repair(t.spark, f"{base}/landed", schema, f"{base}/ticks", minute)
    behind = late.late_rows(t.spark, f"{base}/landed", schema).groupBy(F.date_trunc("minute", "timestamp").alias("bucket"), "service").agg(F.count(F.lit(1)).alias("late"))
    ticks = t.spark.read.parquet(f"{base}/ticks").drop("event_date")
    return ntz(ticks.join(behind, ["bucket", "service"], "left").withColumn("late", F.coalesce("late", F.lit(0))), "bucket")


MESSAGE = "concat(event_type, ' ', CAST(user_id // 4 % 2 AS VARCHAR), ' ', props, ' u', chr(CAST(97 + user_id % 26 AS INTEGER)))"


@query(
    "stream_rare_patterns",
    f"""WITH {ARRIVALS}, p AS (SELECT CAST(event_id AS VARCHAR) AS id, ts AS timestamp, event_id, {pattern_sql(MESSAGE)} AS pattern, q FROM a)
 SELECT id, timestamp, pattern, occurrence, 0.7::DOUBLE AS confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY q, timestamp, id) AS occurrence FROM p) WHERE occurrence <= 5""",
)
def stream_rare_patterns(t):
    """The rare pattern rule over four runs of one stream; counts live in the state store."""
    shape = F.expr("concat(event_type, ' ', CAST(user_id div 4 % 2 AS STRING), ' ', props, ' u', char(97 + user_id % 26))").alias("message")
    events = t.table("events").select(F.col("event_id").alias("seq"), shape)
    pieces = [p.select("seq", "id", "timestamp").join(events, "seq").drop("seq") for p in log_pieces(t, delayed=False)]
    base = scratch_path(t.spark, "rare")

    def start(stream):
        rows = state.rare_patterns(stream).writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/checkpoint")
        return state.with_state_store(t.spark, lambda: rows.trigger(availableNow=True).start())

    in_runs(t.spark, pieces, start)
    return ntz(t.spark.read.parquet(f"{base}/rows"), "timestamp")


@query("stream_baseline", WITH_METRICS + ", " + STATS + " SELECT name, n, round(mean, 6) AS mean, round(std, 6) AS std, round(trend, 8) AS trend FROM stats")
def stream_baseline(t):
    """Baselines from merged moments of metric values that arrive in three runs."""
    metrics = t.metrics.withColumn("ts", F.col("ts").cast("timestamp"))
    held = metrics.withColumn("__piece", by_time(metrics, "ts", 3))
    base = scratch_path(t.spark, "baseline")
    in_runs(t.spark, [held.where(F.col("__piece") == k).drop("__piece") for k in (1, 2, 3)], lambda s: state.track_baselines(s, f"{base}/state", f"{base}/checkpoint"))
    found = state.baseline(t.spark, f"{base}/state")
    return found.select("name", "n", *[F.round(c, d).alias(c) for c, d in (("mean", 6), ("std", 6), ("trend", 8))])


GAP = 3600


_ran = {}


def continuous_logs(t):
    """The whole job over three runs; the folder of its tables. A session runs it once for a data folder."""
    key = t.spark.sparkContext.applicationId, t.sf_dir
    if key not in _ran:
        base = scratch_path(t.spark, "continuous")
        thresholds, rules = A.default_thresholds(t.spark), L.default_rules(t.spark)
        start = lambda s: continuous.run(s, continuous.process_logs, f"{base}/tables", f"{base}/checkpoint", thresholds=thresholds, rules=rules, gap_seconds=GAP, burst_seconds=3600, burst_above=2)
        in_runs(t.spark, log_pieces(t, delayed=False, pieces=3), start)
        _ran[key] = f"{base}/tables"
    return _ran[key]


SAMPLES = """s AS (SELECT service, timestamp AS ts, 'error_rate' AS name, CASE level WHEN 'ERROR' THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM logs WHERE service IS NOT NULL
 UNION ALL SELECT service, timestamp, 'latency_p95', response_time::DOUBLE FROM logs WHERE response_time <> 0)"""


@query("continuous_rows", WITH_LOGS + " SELECT timestamp::DATE AS event_date, level, count(*) AS n, sum(response_time)::BIGINT AS response_time FROM logs GROUP BY 1, 2")
def continuous_rows(t):
    """Rows of the daily store."""
    rows = late.read_daily(t.spark, f"{continuous_logs(t)}/hot", t.logs.withColumn("timestamp", F.col("timestamp").cast("timestamp")).schema)
    return rows.groupBy("event_date", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("response_time").alias("response_time"))


@query(
    "continuous_anomalies",
    WITH_LOGS + f""", {SAMPLES} SELECT name AS metric, service, value, round(CASE WHEN value > 0 THEN least(1, value / t) ELSE 1 END, 6) AS confidence, count(*) AS n
 FROM s JOIN (VALUES ('error_rate', 0.05::DOUBLE), ('latency_p95', 1000::DOUBLE)) x(name, t) USING (name) WHERE value > t GROUP BY ALL""",
)
def continuous_anomalies(t):
    """Threshold anomalies of the metric samples of all batches."""
    found = continuous.of_batches(t.spark, continuous_logs(t), "thresholds")
    return found.groupBy("metric", "service", "value", F.round("confidence", 6).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


@query("continuous_bursts", burst_sql("PARTITION BY service", "service,", "INTERVAL 1 HOUR", 2))
def continuous_bursts(t):
    """Error bursts whose window reaches back into earlier batches."""
    return ntz(continuous.bursts(t.spark, continuous_logs(t)), "timestamp")


@query(
    "continuous_services",
    WITH_LOGS + " SELECT service, count(*) AS log_count, count(*) FILTER (WHERE level = 'ERROR') AS log_errors, min(timestamp) AS log_first_seen, max(timestamp) AS log_last_seen FROM logs WHERE service IS NOT NULL GROUP BY 1",
)
def continuous_services(t):
    """Service figures, with the increments of the first runs added up by a compaction."""
    base = continuous_logs(t)
    continuous.compact(t.spark, base, "services", upto=1)
    return ntz(continuous.services(t.spark, base), "log_first_seen", "log_last_seen")


RUNS = WITH_LOGS + f""", {SAMPLES}, f AS (SELECT CASE name WHEN 'error_rate' THEN 'high_error_rate' ELSE 'high_latency_p95' END AS rule_name, service, ts FROM s WHERE value > CASE name WHEN 'error_rate' THEN 0.05 ELSE 1000 END),
 g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL {GAP} SECOND THEN 0 ELSE 1 END AS o FROM f WINDOW w AS (PARTITION BY rule_name, service ORDER BY ts)),
 r AS (SELECT *, sum(o) OVER (PARTITION BY rule_name, service ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT rule_name, service, min(ts) AS starts_at{{}} FROM r GROUP BY rule_name, service, k"""


@query("continuous_alerts", RUNS.format(", max(ts) AS last_seen, count(*) AS n"))
def continuous_alerts(t):
    """Deduplicated alerts over all batches."""
    return ntz(continuous.alerts(t.spark, continuous_logs(t), gap_seconds=GAP), "starts_at", "last_seen")


@query("alert_sink", RUNS.format(""))
def alert_sink(t):
    """What the alert sink received: each alert once, when it began."""
    sent = continuous.of_batches(t.spark, continuous_logs(t), "sink")
    body = F.from_json("value", "rule_name STRING, service STRING, starts_at TIMESTAMP")
    return ntz(sent.select(body.alias("v")).select("v.*"), "starts_at")


@query("continuous_edges", WITH_SPANS + ", " + CALLS + " SELECT * REPLACE (round(avg_latency, 6) AS avg_latency) FROM edges")
def continuous_edges(t):
    """Service edges from spans of which parents and children come in different runs."""
    base = scratch_path(t.spark, "continuous")
    spans = t.spans.withColumn("__piece", F.pmod(F.xxhash64("trace_id", "span_id"), F.lit(3)))
    pieces = [spans.where(F.col("__piece") == k).drop("__piece") for k in range(3)]
    in_runs(t.spark, pieces, lambda s: continuous.run(s, continuous.process_spans, f"{base}/tables", f"{base}/checkpoint", trace_seconds=None))
    return continuous.edges(t.spark, f"{base}/tables").withColumn("avg_latency", F.round("avg_latency", 6))
