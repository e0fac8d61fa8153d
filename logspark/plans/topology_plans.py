"""Service graph queries."""

from pyspark.sql import functions as F

from logspark.operators import topology as G
from logspark.plans.adapters import ctes
from logspark.plans.registry import query

WITH_SPANS = f"WITH RECURSIVE {ctes('spans')}"
WITH_ALL = f"WITH RECURSIVE {ctes('logs', 'spans', 'deployments', 'metrics')}"

CALLS = """calls AS (SELECT p.service AS "from", c.service AS "to", c.trace_id, c.span_id, c.operation, c.duration, c.error, c.start_time
 FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_span_id = p.span_id WHERE p.service <> c.service),
 edges AS (SELECT "from", "to", count(*) AS calls, count(DISTINCT trace_id) AS traces, count(*) FILTER (WHERE error) AS error_count,
  avg(duration) AS avg_latency, min(start_time) AS first_seen, max(start_time) AS last_seen, least(10.0::DOUBLE, 1 + 0.1::DOUBLE * count(*)) AS strength FROM calls GROUP BY 1, 2)"""


@query(
    "service_rollup",
    WITH_SPANS
    + """ SELECT service, count(*) AS span_count, count(*) FILTER (WHERE error) AS span_errors, round(avg(duration), 6) AS avg_duration,
 min(start_time) AS first_seen, max(start_time) AS last_seen FROM spans GROUP BY 1""",
)
def service_rollup(t):
    return G.service_rollup(t.spans).withColumn("avg_duration", F.round("avg_duration", 6))


@query("service_attributes", WITH_SPANS + " SELECT service, 'operation' AS kind, operation AS value, count(*) AS n FROM spans GROUP BY 1, 3")
def service_attributes(t):
    return G.service_attributes(t.spans)


def known(t):
    return G.services(t.spans, t.logs)


KNOWN = """known AS (SELECT service, coalesce(sc, 0) AS span_count, coalesce(lc, 0) AS log_count, coalesce(se, 0) + coalesce(le, 0) AS error_count,
 coalesce(ad, 0.0) AS avg_duration, least(coalesce(sf, lf), coalesce(lf, sf)) AS first_seen, greatest(coalesce(sl, ll), coalesce(ll, sl)) AS last_seen
 FROM (SELECT service, count(*) AS sc, count(*) FILTER (WHERE error) AS se, avg(duration) AS ad, min(start_time) AS sf, max(start_time) AS sl FROM spans GROUP BY 1) s
 FULL JOIN (SELECT service, count(*) AS lc, count(*) FILTER (WHERE level = 'ERROR') AS le, min(timestamp) AS lf, max(timestamp) AS ll FROM logs GROUP BY 1) l USING (service)),
 health AS (SELECT *, error_count::DOUBLE / (span_count + log_count) AS error_rate,
  CASE WHEN error_count::DOUBLE / (span_count + log_count) < 0.05 AND avg_duration < 1000 THEN 'healthy' ELSE 'degraded' END AS status FROM known)"""


@query("service_health", WITH_ALL + ", " + KNOWN + " SELECT * REPLACE (round(avg_duration, 6) AS avg_duration) FROM health")
def service_health(t):
    return G.service_health(known(t)).withColumn("avg_duration", F.round("avg_duration", 6))


@query("service_edges", WITH_SPANS + ", " + CALLS + " SELECT * REPLACE (round(avg_latency, 6) AS avg_latency) FROM edges")
def service_edges(t):
    return G.dependencies(t.spans).withColumn("avg_latency", F.round("avg_latency", 6))


@query("edge_operations", WITH_SPANS + ", " + CALLS + ' SELECT "from", "to", operation, count(*) AS calls FROM calls GROUP BY 1, 2, 3')
def edge_operations(t):
    return G.dependency_operations(t.spans)


@query(
    "service_halflife",
    WITH_SPANS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY start_time, trace_id, span_id) AS rn, count(*) OVER (PARTITION BY service) AS n FROM spans WHERE duration <> 0)
 SELECT service, round(sum(duration * pow(0.5, n - rn + 1)), 6) AS halving_mean FROM r GROUP BY 1""",
)
def service_halflife(t):
    return G.halving_mean(t.spans, ["service"], ["start_time", "trace_id", "span_id"], "duration").withColumn("halving_mean", F.round("halving_mean", 6))


@query(
    "edge_halflife",
    WITH_SPANS + ", " + CALLS
    + """, r AS (SELECT *, row_number() OVER p AS rn, count(*) OVER (PARTITION BY "from", "to") AS n FROM calls WHERE duration <> 0 WINDOW p AS (PARTITION BY "from", "to" ORDER BY start_time, trace_id, span_id))
 SELECT "from", "to", round(sum(duration * pow(0.5, n - rn + 1)), 6) AS halving_mean FROM r GROUP BY 1, 2""",
)
def edge_halflife(t):
    mean = G.halving_mean(G.call_rows(t.spans), ["from", "to"], ["start_time", "trace_id", "span_id"], "duration")
    return mean.withColumn("halving_mean", F.round("halving_mean", 6))


@query(
    "graph_nodes",
    WITH_ALL + ", " + KNOWN + " SELECT * REPLACE (round(avg_duration, 6) AS avg_duration) FROM health ORDER BY span_count + log_count DESC, service LIMIT 20",
)
def graph_nodes(t):
    return G.graph_nodes(known(t), limit=20).withColumn("avg_duration", F.round("avg_duration", 6))


@query(
    "graph_edges",
    WITH_SPANS + ", " + CALLS
    + ' SELECT "from" AS source, "to" AS target, strength, calls, round(avg_latency, 6) AS avg_latency FROM edges ORDER BY calls DESC, source, target LIMIT 100',
)
def graph_edges(t):
    return G.graph_edges(G.dependencies(t.spans), limit=100).withColumn("avg_latency", F.round("avg_latency", 6))


@query("graph_nodes_all", WITH_ALL + ", " + KNOWN + " SELECT * REPLACE (round(avg_duration, 6) AS avg_duration) FROM health")
def graph_nodes_all(t):
    return G.graph_nodes(known(t)).withColumn("avg_duration", F.round("avg_duration", 6))


@query(
    "graph_edges_all",
    WITH_SPANS + ", " + CALLS + ' SELECT "from" AS source, "to" AS target, strength, calls, round(avg_latency, 6) AS avg_latency FROM edges',
)
def graph_edges_all(t):
    return G.graph_edges(G.dependencies(t.spans)).withColumn("avg_latency", F.round("avg_latency", 6))


# Logs and spans name different services, so the incident graph links the log services among themselves.
LOG_EDGES = """log_edges AS (SELECT DISTINCT concat('svc-', CAST(user_id % 8 AS STRING)) AS "from", concat('svc-', CAST(event_id % 8 AS STRING)) AS "to"
 FROM events WHERE user_id % 8 <> event_id % 8 AND event_id % 8 <= user_id % 8 + 1)"""
INCIDENTS = """incidents AS (SELECT concat(service, '@', CAST(ts AS STRING)) AS incident_id, service, ts FROM metrics WHERE name = 'error_rate' AND value >= 0.5)"""


def log_edges(t):
    return t.table("events").selectExpr("concat('svc-', user_id % 8) AS `from`", "concat('svc-', event_id % 8) AS `to`", "user_id % 8 AS u", "event_id % 8 AS e").where(
        "u <> e AND e <= u + 1"
    ).select("from", "to").distinct()


def incidents(t):
    return t.metrics.where((F.col("name") == "error_rate") & (F.col("value") >= 0.5)).select(
        F.concat("service", F.lit("@"), F.col("ts").cast("string")).alias("incident_id"), "service", "ts"
    )


RADIUS = LOG_EDGES + ", " + INCIDENTS + """, hit AS (SELECT incident_id, service, ts, service AS affected FROM incidents
 UNION ALL SELECT incident_id, service, ts, "to" FROM incidents JOIN log_edges ON service = "from"),
 near AS (SELECT hit.*, version, timestamp AS deployed_at FROM hit JOIN deployments d ON d.service = affected AND abs(epoch_us(ts) - epoch_us(timestamp)) < 3600000000)"""


@query(
    "blast_radius",
    WITH_ALL + ", " + RADIUS
    + """, fan AS (SELECT "from" AS service, count(*) AS k FROM log_edges GROUP BY 1), dep AS (SELECT incident_id, count(*) AS d FROM near GROUP BY 1),
 sized AS (SELECT i.*, coalesce(k, 0) + 1 AS affected_services, coalesce(d, 0) AS deployments FROM incidents i LEFT JOIN fan USING (service) LEFT JOIN dep USING (incident_id))
 SELECT *, CASE WHEN affected_services > 10 THEN 'critical' WHEN affected_services > 5 THEN 'high' WHEN affected_services > 2 THEN 'medium' ELSE 'low' END AS severity FROM sized""",
)
def blast_radius(t):
    return G.blast_radius(incidents(t), log_edges(t), t.deployments)


@query("impacted_services", WITH_ALL + ", " + RADIUS + " SELECT * FROM hit")
def impacted_services(t):
    return G.impacted(incidents(t), log_edges(t))


@query("deploy_correlation", WITH_ALL + ", " + RADIUS + " SELECT * FROM near")
def deploy_correlation(t):
    return G.deploys_near(G.impacted(incidents(t), log_edges(t)), t.deployments)


# One walk per service and level, so the search stays small on a dense graph.
PATHS = """walk AS (SELECT (SELECT min("from") FROM edges) AS service, [(SELECT min("from") FROM edges)] AS path, 0 AS hops
  UNION ALL SELECT b."to", min(list_append(path, b."to")), hops + 1 FROM walk JOIN edges b ON b."from" = walk.service WHERE hops < 24 GROUP BY b."to", hops),
 best AS (SELECT service, path, hops, row_number() OVER (PARTITION BY service ORDER BY hops, path) AS k FROM walk)"""


def all_paths(t):
    edges = G.cut_lineage(G.dependencies(t.spans).select("from", "to", "calls"))
    return G.paths_from(edges, edges.agg(F.min("from")).first()[0])


@query("service_paths", WITH_SPANS + ", " + CALLS + ", " + PATHS + " SELECT service, array_to_string(path, ' > ') AS path, hops FROM best WHERE k = 1")
def service_paths(t):
    return all_paths(t).select("service", F.array_join("path", " > ").alias("path"), "hops")


@query(
    "recent_edges",
    WITH_SPANS + ", " + CALLS
    + """, k AS (SELECT service, max(start_time) AS last_seen FROM spans GROUP BY 1), kept AS (SELECT service FROM k WHERE last_seen >= (SELECT max(last_seen) FROM k) - INTERVAL 720 HOUR)
 SELECT "from", "to", calls FROM edges WHERE "from" IN (SELECT service FROM kept) AND "to" IN (SELECT service FROM kept)""",
)
def recent_edges(t):
    return G.recent_services(G.service_rollup(t.spans), G.dependencies(t.spans), hours=720)[1].select("from", "to", "calls")


@query(
    "correlated_services",
    WITH_ALL
    + """, c AS (SELECT service, epoch_us(timestamp) // 21600000000 AS b, count(*) FILTER (WHERE level = 'ERROR') AS x FROM logs GROUP BY 1, 2),
 bs AS (SELECT unnest(range((SELECT min(b) FROM c), (SELECT max(b) FROM c) + 1)) AS b), g AS (SELECT s.service, bs.b, coalesce(x, 0) AS x FROM (SELECT DISTINCT service FROM c) s CROSS JOIN bs LEFT JOIN c ON c.service = s.service AND c.b = bs.b),
 p AS (SELECT one.service AS service_a, two.service AS service_b, count(*) FILTER (WHERE one.x > 0 AND two.x > 0) AS shared_buckets, count(*) AS n,
  count(*) FILTER (WHERE one.x > 0) AS k1, count(*) FILTER (WHERE two.x > 0) AS k2, corr(one.x, two.x) AS strength FROM g one JOIN g two ON one.b = two.b AND one.service < two.service GROUP BY 1, 2)
 SELECT service_a, service_b, shared_buckets, round(shared_buckets::DOUBLE / n, 6) AS support, round(shared_buckets * n::DOUBLE / (k1 * k2), 6) AS lift, round(strength, 6) AS strength FROM p WHERE strength >= 0.03""",
)
def correlated_services(t):
    """Six-hour buckets and a low limit, because the given errors hardly correlate."""
    found = G.correlated_services(t.logs, seconds=21600, min_strength=0.03, block_buckets=20)
    return found.withColumns({c: F.round(c, 6) for c in ("support", "lift", "strength")})
