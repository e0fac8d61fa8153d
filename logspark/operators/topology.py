"""Service graph from spans and logs, blast radius, paths and correlation."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions.timefx import as_of_or_latest, seconds_before
from logspark.operators.metrics import HEALTHY_DURATION_MS, HEALTHY_ERROR_RATE, count_if
from logspark.operators.ordered import micros, time_chunk
from logspark.session import cut_lineage

# Edge strength, blast severities, deployment window, graph caps, correlation settings.
STRENGTH_STEP = 0.1
STRENGTH_MAX = 10.0
BLAST_LEVELS = ((10, "critical"), (5, "high"), (2, "medium"))
DEPLOY_WINDOW_SECONDS = 3600
MAX_NODES = 1000
MAX_EDGES = 5000
CORRELATION_SECONDS = 300
MIN_CORRELATION = 0.3
TILE_SERVICES = 256
VERSION_TAGS = ("version", "service.version")
ENDPOINT_TAGS = ("http.url", "http.route")


def service_rollup(spans: DataFrame) -> DataFrame:
    """Span count, error count, mean duration and time range per service."""
    return spans.groupBy("service").agg(
        F.count(F.lit(1)).alias("span_count"),
        count_if(F.col("error")).alias("span_errors"),
        F.avg("duration").alias("avg_duration"),
        F.min("start_time").alias("first_seen"),
        F.max("start_time").alias("last_seen"),
    )


def service_attributes(spans: DataFrame) -> DataFrame:
    """Operations, endpoints, versions and tags of each service, one row per distinct value.

    Sets are kept as rows: a service may have any number of endpoints or tags.
    """
    parts = [F.array(F.struct(F.lit("operation").alias("kind"), F.col("operation").alias("value")))]
    if "tags" in spans.columns:
        kind = lambda k: F.when(k.isin(*VERSION_TAGS), "version").when(k.isin(*ENDPOINT_TAGS), "endpoint")
        tags = F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>")))
        parts.append(F.transform(tags, lambda e: F.struct(F.lit("tag").alias("kind"), F.concat_ws(":", e["key"], e["value"]).alias("value"))))
        parts.append(F.transform(F.filter(tags, lambda e: kind(e["key"]).isNotNull()), lambda e: F.struct(kind(e["key"]).alias("kind"), e["value"].alias("value"))))
    return (
        spans.select("service", F.explode(F.concat(*parts)).alias("a"))
        .where(F.col("a.value").isNotNull())
        .groupBy("service", "a.kind", "a.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def log_rollup(logs: DataFrame) -> DataFrame:
    """Log count, ERROR count and time range per service."""
    return logs.where(F.col("service").isNotNull()).groupBy("service").agg(
        F.count(F.lit(1)).alias("log_count"),
        count_if(F.col("level") == "ERROR").alias("log_errors"),
        F.min("timestamp").alias("log_first_seen"),
        F.max("timestamp").alias("log_last_seen"),
    )


def services(spans: DataFrame, logs: DataFrame) -> DataFrame:
    """Services known from spans or logs."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return service_rollup(spans).join(log_rollup(logs), "service", "full").select(
        "service",
        zero("span_count"),
        zero("log_count"),
        (F.coalesce("span_errors", F.lit(0)) + F.coalesce("log_errors", F.lit(0))).alias("error_count"),
        F.coalesce("avg_duration", F.lit(0.0)).alias("avg_duration"),
        F.least("first_seen", "log_first_seen").alias("first_seen"),
        F.greatest("last_seen", "log_last_seen").alias("last_seen"),
    )


def service_health(known: DataFrame) -> DataFrame:
    """healthy below 5 % errors and one second; the rate is over spans and logs, so log-only services count too."""
    rate = F.col("error_count") / (F.col("span_count") + F.col("log_count"))
    return known.withColumn("error_rate", rate).withColumn(
        "status",
        F.when((F.col("error_rate") < HEALTHY_ERROR_RATE) & (F.col("avg_duration") < HEALTHY_DURATION_MS), "healthy").otherwise("degraded"),
    )


def calls_between(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Calls of child spans from parent spans of the same trace and another service, counted per parent span and operation.

    Children are counted before the join, so a parent span with many children sends few rows.
    """
    counted = children.where(F.col("parent_span_id").isNotNull()).groupBy("trace_id", "parent_span_id", "service", "operation").agg(
        F.count(F.lit(1)).alias("calls"),
        count_if(F.col("error")).alias("errors"),
        F.sum("duration").alias("duration"),
        F.min("start_time").alias("first_seen"),
        F.max("start_time").alias("last_seen"),
    )
    callers = parents.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("from"))
    return (
        counted.withColumnRenamed("service", "to")
        .join(callers, ["trace_id", "parent_span_id"])
        .where(F.col("from") != F.col("to"))
        .drop("parent_span_id")
    )


def service_calls(spans: DataFrame) -> DataFrame:
    """Parent-child calls between two services of one trace."""
    return calls_between(spans, spans)


def calls_by_trace(calls: DataFrame) -> DataFrame:
    """Calls added up per edge and trace; rows of several batches may be added up again."""
    return calls.groupBy("from", "to", "trace_id").agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.sum("duration").alias("duration"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def edges_of(calls: DataFrame) -> DataFrame:
    """Edges of the service graph from calls: calls, traces, strength, errors, mean latency, time range."""
    return calls_by_trace(calls).groupBy("from", "to").agg(
        F.sum("calls").alias("calls"),
        F.count(F.lit(1)).alias("traces"),
        F.sum("errors").alias("error_count"),
        (F.sum("duration") / F.sum("calls")).alias("avg_latency"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    ).withColumn("strength", F.least(F.lit(STRENGTH_MAX), 1 + STRENGTH_STEP * F.col("calls")))


def dependencies(spans: DataFrame) -> DataFrame:
    """Edges of the service graph of these spans."""
    return edges_of(service_calls(spans))


def dependency_operations(spans: DataFrame) -> DataFrame:
    """Operations of each edge, one row per distinct operation."""
    return service_calls(spans).groupBy("from", "to", "operation").agg(F.sum("calls").alias("calls"))


def halving_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, name: str = "halving_mean", chunk_seconds: int = 86400
) -> DataFrame:
    """The order-dependent mean ``m = (m + x) / 2`` from 0, in closed form over all rows.

    The last row weighs 1/2, the one before 1/4 and so on. Rows are weighed inside chunks of time (by the
    first order column), and each chunk's sum is halved once per row after it.
    """
    chunk = time_chunk(F.col(order[0]), chunk_seconds)
    rows = df.where(F.col(value).isNotNull() & (F.col(value) != 0)).select(*keys, *order, value, chunk.alias("__chunk"))
    latest = Window.partitionBy(*keys, "__chunk").orderBy(*[F.col(c).desc() for c in order])
    half = F.pow(F.lit(0.5), F.row_number().over(latest))
    chunks = rows.withColumn("__part", F.col(value) * half).groupBy(*keys, "__chunk").agg(F.sum("__part").alias("__part"), F.count(F.lit(1)).alias("__rows"))
    after = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(1, Window.unboundedFollowing)
    decayed = F.col("__part") * F.pow(F.lit(0.5), F.coalesce(F.sum("__rows").over(after), F.lit(0)))
    return chunks.withColumn("__part", decayed).groupBy(*keys).agg(F.sum("__part").alias(name))


def call_rows(spans: DataFrame) -> DataFrame:
    """Single calls between services, for order-dependent figures."""
    parents = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("from"))
    return (
        spans.where(F.col("parent_span_id").isNotNull())
        .withColumnRenamed("service", "to")
        .join(parents, ["trace_id", "parent_span_id"])
        .where(F.col("from") != F.col("to"))
    )


def graph_nodes(known: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Nodes with status; with a ``limit`` (``MAX_NODES`` is the configured graph size) the busiest stay."""
    nodes = service_health(known)
    if limit is None:
        return nodes
    return nodes.orderBy((F.col("span_count") + F.col("log_count")).desc(), "service").limit(limit)


def graph_edges(edges: DataFrame, *, limit: int | None = None) -> DataFrame:
    out = edges.select(F.col("from").alias("source"), F.col("to").alias("target"), "strength", "calls", "avg_latency")
    if limit is None:
        return out
    return out.orderBy(F.col("calls").desc(), "source", "target").limit(limit)


def impacted(incidents: DataFrame, edges: DataFrame) -> DataFrame:
    """Affected services of each incident: the service itself and its direct downstream services."""
    own = incidents.select("incident_id", "service", "ts", F.col("service").alias("affected"))
    down = incidents.join(edges.select(F.col("from").alias("service"), F.col("to").alias("affected")), "service")
    return own.unionByName(down.select("incident_id", "service", "ts", "affected"))


def deploys_near(affected: DataFrame, deployments: DataFrame, *, seconds: int = DEPLOY_WINDOW_SECONDS) -> DataFrame:
    """Deployments of an affected service less than ``seconds`` away (strict).

    Both sides meet on (service, time bucket); a deployment is offered to its own and the two
    neighbouring buckets, and the exact distance is checked after that.
    """
    span = seconds * 1_000_000
    bucket = F.floor(micros(F.col("ts")) / span)
    left = affected.withColumn("__bucket", bucket)
    at = micros(F.col("timestamp"))
    home = F.floor(at / span)
    right = deployments.select(
        F.col("service").alias("affected"), "version", F.col("timestamp").alias("deployed_at"),
        F.explode(F.array(home - 1, home, home + 1)).alias("__bucket"),
    )
    near = F.abs(micros(F.col("ts")) - micros(F.col("deployed_at"))) < span
    return left.join(right, ["affected", "__bucket"]).where(near).drop("__bucket")


def blast_severity(size: Column) -> Column:
    (top, top_name), *rest = BLAST_LEVELS
    out = F.when(size > top, top_name)
    for above, name in rest:
        out = out.when(size > above, name)
    return out.otherwise("low")


def blast_radius(incidents: DataFrame, edges: DataFrame, deployments: DataFrame) -> DataFrame:
    """Affected services, correlated deployments and severity per incident ``(incident_id, service, ts)``."""
    fan_out = edges.groupBy(F.col("from").alias("service")).agg(F.count(F.lit(1)).alias("downstream"))
    near = deploys_near(impacted(incidents, edges), deployments).groupBy("incident_id").agg(F.count(F.lit(1)).alias("deployments"))
    size = F.coalesce("downstream", F.lit(0)) + 1
    return (
        incidents.join(fan_out, "service", "left")
        .join(near, "incident_id", "left")
        .select(
            "incident_id", "service", "ts",
            size.cast("bigint").alias("affected_services"),
            F.coalesce("deployments", F.lit(0)).cast("bigint").alias("deployments"),
            blast_severity(size).alias("severity"),
        )
    )


def paths_from(edges: DataFrame, source: str, *, max_hops: int | None = None) -> DataFrame:
    """Best path from ``source`` to every reachable service: fewest hops, then the smallest path.

    Each round joins the newest frontier with the edges and keeps one path per service, so the
    state never exceeds the number of services and the rounds end by themselves. Rounds are checkpointed
    in the shared folder.
    """
    steps = edges.select(F.col("from").alias("service"), F.col("to").alias("next")).distinct()
    spark = edges.sparkSession
    start = spark.createDataFrame([(source, [source], 0)], "service STRING, path ARRAY<STRING>, hops INT")
    reached = frontier = cut_lineage(start)
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        candidates = (
            frontier.join(steps, "service")
            .select(F.col("next").alias("service"), F.concat("path", F.array("next")).alias("path"))
            .groupBy("service")
            .agg(F.min("path").alias("path"))
        )
        frontier = cut_lineage(candidates.join(reached.select("service"), "service", "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(frontier))
    return reached


def path_between(edges: DataFrame, source: str, target: str, *, max_hops: int | None = None) -> DataFrame:
    """The best path between two services; no row when there is none."""
    return paths_from(edges, source, max_hops=max_hops).where(F.col("service") == target).select("path", "hops")


def recent_services(known: DataFrame, edges: DataFrame, *, as_of: Any = None, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Services seen within ``hours`` and the edges between them."""
    now = as_of_or_latest(known, "last_seen", as_of)
    kept = known.where(F.col("last_seen") >= seconds_before(now, hours * 3600))
    names = kept.select("service")
    inner = edges.join(names.withColumnRenamed("service", "from"), "from", "left_semi")
    return kept, inner.join(names.withColumnRenamed("service", "to"), "to", "left_semi")


def _pair_sums(tile: pd.DataFrame) -> pd.DataFrame:
    """Products of all service pairs of two tiles over one block of buckets."""
    a, b = int(tile["tile_a"].iloc[0]), int(tile["tile_b"].iloc[0])
    grid = tile.pivot_table(index="bucket", columns="service", values="errors", aggfunc="sum", fill_value=0)
    home = tile.drop_duplicates("service").set_index("service")["tile"]
    left = [s for s in grid.columns if home[s] == a]
    right = [s for s in grid.columns if home[s] == b]
    x, y = grid[left].to_numpy(dtype=np.int64), grid[right].to_numpy(dtype=np.int64)
    products, both = x.T @ y, (x > 0).astype(np.int64).T @ (y > 0).astype(np.int64)
    i, j = np.nonzero(products)
    out = pd.DataFrame({"one": np.array(left, dtype=object)[i], "two": np.array(right, dtype=object)[j], "xy": products[i, j], "both": both[i, j]})
    out = out[out["one"] < out["two"]] if a == b else out[out["one"] != out["two"]]
    swap = out["one"] > out["two"]
    out.loc[swap, ["one", "two"]] = out.loc[swap, ["two", "one"]].to_numpy()
    return out


def correlated_services(
    logs: DataFrame,
    *,
    seconds: int = CORRELATION_SECONDS,
    min_strength: float = MIN_CORRELATION,
    tiles: int | None = None,
    block_buckets: int = 288,
) -> DataFrame:
    """Service pairs whose error counts per time bucket correlate, with support and lift.

    Errors are counted per (service, bucket) first. Pair sums then come from matrix products over
    blocks of buckets and tiles of services, so neither a bucket's pairs nor a service's history
    meet in one row-wise join. The number of tiles follows that of the services: a frame holds about
    ``2 * TILE_SERVICES`` services and ``block_buckets`` buckets at most. Pairs that never share a bucket cannot correlate positively and
    need no row; ``min_strength`` must be above zero.
    """
    if min_strength <= 0:
        raise ValueError("min_strength must be positive")
    bucket = F.floor(micros(F.col("timestamp")) / (seconds * 1_000_000)).cast("bigint")
    span = logs.agg((F.max(bucket) - F.min(bucket) + 1).alias("buckets")).scalar()
    counts = (
        logs.where((F.col("level") == "ERROR") & F.col("service").isNotNull())
        .groupBy("service", bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("errors"))
    )
    if tiles is None:
        tiles = max(1, -(-counts.select("service").distinct().count() // TILE_SERVICES))
    counts = counts.withColumn("tile", F.pmod(F.xxhash64("service"), F.lit(tiles)).cast("int"))
    others = F.sequence(F.lit(0), F.lit(tiles - 1))
    spread = counts.select("service", "bucket", "errors", "tile", F.floor(F.col("bucket") / block_buckets).alias("block"), F.explode(others).alias("other"))
    tiled = spread.withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")})
    sums = tiled.groupBy("block", "tile_a", "tile_b").applyInPandas(_pair_sums, "one STRING, two STRING, xy BIGINT, both BIGINT")
    pairs = sums.groupBy("one", "two").agg(F.sum("xy").alias("xy"), F.sum("both").alias("both"))
    single = counts.groupBy("service").agg(
        F.sum("errors").alias("s"), F.sum(F.col("errors") * F.col("errors")).alias("ss"), F.count(F.lit(1)).alias("k")
    )
    side = lambda key, tag: single.select(F.col("service").alias(key), *[F.col(c).alias(c + tag) for c in ("s", "ss", "k")])
    n = F.col("buckets").cast("double")
    top = n * F.col("xy") - F.col("s1") * F.col("s2")
    spread_1, spread_2 = n * F.col("ss1") - F.col("s1") * F.col("s1"), n * F.col("ss2") - F.col("s2") * F.col("s2")
    return (
        pairs.join(side("one", "1"), "one")
        .join(side("two", "2"), "two")
        .withColumn("buckets", span)
        .select(
            F.col("one").alias("service_a"), F.col("two").alias("service_b"), F.col("both").alias("shared_buckets"),
            (F.col("both") / n).alias("support"),
            (F.col("both") * n / (F.col("k1") * F.col("k2"))).alias("lift"),
            F.when((spread_1 > 0) & (spread_2 > 0), top / F.sqrt(spread_1 * spread_2)).alias("strength"),
        )
        .where(F.col("strength") >= min_strength)
    )
