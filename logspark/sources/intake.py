"""Message intake: signal routing, record normalising, quarantine of bad input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.levels import severity_number
from logspark.functions.text import json_map
from logspark.functions.timefx import EXACT_TIMES

# Intake topics.
TOPICS = ("logs", "metrics", "traces")
STRING_MAP = "map<string,string>"
# Aliases of record fields, first one present wins.
LOG_ALIASES = {
    "id": ("id",), "timestamp": ("timestamp", "time"), "level": ("level", "severity"), "message": ("message", "msg", "body"),
    "service": ("service", "serviceName"), "version": ("version", "serviceVersion"),
}
METRIC_ALIASES = {
    "id": ("id",), "timestamp": ("timestamp", "time"), "name": ("name", "metricName"), "value": ("value",), "type": ("type",), "unit": ("unit",),
}
SPAN_ALIASES = {
    "trace_id": ("traceId", "traceID"), "span_id": ("spanId", "spanID"), "parent_span_id": ("parentSpanId", "parentSpanID"),
    "operation": ("operationName", "operation"), "start_time": ("startTime", "start"), "end_time": ("endTime", "end"), "duration": ("duration",),
}


def kafka_stream(spark: SparkSession, servers: str, *, topics: str = ",".join(TOPICS), max_offsets: int | None = None) -> DataFrame:
    """Kafka records; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()


def signal(topic: Column) -> Column:
    """Kind of signal by topic or stream name."""
    return F.when(topic.contains("metric"), "metric").when(topic.contains("trace"), "trace").otherwise("log")


def envelopes(records: DataFrame, *, transport: str = "kafka") -> DataFrame:
    """Typed envelopes of raw records ``(topic, value, timestamp)``; ``body`` is NULL for bad JSON.

    An item that says it is a ``log``, ``metric`` or ``trace`` goes there, else its topic decides. The last
    value of a repeated key wins.
    """
    text = F.col("value").cast("string")
    said = F.lower(F.get_json_object(text, "$.type"))
    return records.select(
        F.when(said.isin("log", "metric", "trace"), said).otherwise(signal(F.col("topic"))).alias("type"), F.lit(transport).alias("transport"), F.col("topic").alias("source"), "timestamp",
        json_map(F.when(F.ltrim(text).startswith("{"), text)).alias("body"), text.alias("raw"),
    )


def split_signals(messages: DataFrame) -> dict[str, DataFrame]:
    """One filtered branch per signal and one for what could not be read."""
    good = F.col("body").isNotNull()
    parts = {kind: messages.where(good & (F.col("type") == kind)) for kind in ("log", "metric", "trace")}
    parts["quarantine"] = messages.where(~good)
    return parts


def outcome_counts(messages: DataFrame) -> DataFrame:
    """Received, processed and failed messages per transport and signal."""
    ok = F.col("body").isNotNull()
    return messages.groupBy("transport", "type").agg(
        F.count(F.lit(1)).alias("received"), F.count(F.when(ok, 1)).alias("processed"), F.count(F.when(~ok, 1)).alias("failed")
    )


def field_list(fields: Column) -> Column:
    """A flat ``[key, value, key, value]`` list as a map; the last value of a repeated key wins."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.size(fields) - 2, F.lit(2)),
        lambda i: F.struct(F.element_at(fields, i + 1).alias("key"), F.element_at(fields, i + 2).alias("value")),
    )
    keys = F.transform(pairs, lambda p: p["key"])
    kept = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))),
        lambda p: ~F.array_contains(F.slice(keys, p["i"] + 2, F.size(keys)), p["key"]),
    )
    entries = F.transform(kept, lambda p: F.struct(p["key"], p["value"]))
    return F.when(F.size(fields) >= 2, F.map_from_entries(entries)).otherwise(F.create_map().cast(STRING_MAP))


def field_values(fields: Column) -> Column:
    """Values of a field list as VARIANT: JSON where it parses, else the text."""
    return F.transform_values(field_list(fields), lambda _, v: F.coalesce(F.try_parse_json(v), v.cast("variant")))


def _alias(body: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(body, F.lit(n)), F.lit("")) for n in names])


def _object(body: str, *names: str) -> Column:
    """Union of JSON object fields; later names win."""
    objects = [F.coalesce(F.from_json(F.try_element_at(body, F.lit(n)), STRING_MAP), F.create_map().cast(STRING_MAP)) for n in names]
    out = objects[0]
    for o in objects[1:]:
        earlier = F.map_filter(out, lambda k, _: ~F.map_contains_key(o, k))
        out = F.map_concat(earlier, o)
    return out


def log_records(messages: DataFrame) -> DataFrame:
    """Normalised log records; attributes are the union of attributes, labels and tags."""
    level = F.coalesce(_alias("body", LOG_ALIASES["level"]), F.lit("INFO"))
    keep = {n: _alias("body", a).alias(n) for n, a in LOG_ALIASES.items() if n != "level"}
    return messages.select(
        *keep.values(), level.alias("level"), severity_number(level).alias("severity_number"),
        _object("body", "attributes", "labels", "tags").alias("attributes"), _object("body", "resource").alias("resource"),
    )


def metric_records(messages: DataFrame) -> DataFrame:
    """Normalised metrics; the type defaults to gauge."""
    cols = {n: _alias("body", a) for n, a in METRIC_ALIASES.items()}
    cols["value"] = cols["value"].try_cast("double")
    cols["type"] = F.coalesce(cols["type"], F.lit("gauge"))
    attributes = F.coalesce(F.try_element_at("body", F.lit("attributes")), F.try_element_at("body", F.lit("labels")))
    named = F.coalesce(F.from_json(attributes, STRING_MAP), F.create_map().cast(STRING_MAP))
    return messages.select(*[c.alias(n) for n, c in cols.items()], named.alias("attributes"))


def tag_map(text: Column) -> Column:
    """Tags as a map, from a JSON object or from an array of ``{"key": .., "value": ..}``; the last value of a key wins."""
    items = F.filter(F.from_json(text, "array<struct<key:string,value:string>>"), lambda e: e["key"].isNotNull())
    flat = F.flatten(F.transform(items, lambda e: F.array(e["key"], e["value"])))
    listed = F.when(F.ltrim(text).startswith("["), field_list(flat))
    return F.coalesce(listed, F.from_json(text, STRING_MAP), F.create_map().cast(STRING_MAP))


def span_records(messages: DataFrame) -> DataFrame:
    """Normalised spans with numeric times; a missing duration is ``end - start``."""
    cols = {n: _alias("body", a) for n, a in SPAN_ALIASES.items()}
    for n in ("start_time", "end_time", "duration"):
        cols[n] = cols[n].try_cast("double")
    cols["duration"] = F.coalesce(F.nullif(cols["duration"], F.lit(0.0)), cols["end_time"] - cols["start_time"])
    process = F.from_json(F.try_element_at("body", F.lit("process")), STRING_MAP)
    tags = tag_map(F.coalesce(F.try_element_at("body", F.lit("tags")), F.try_element_at("body", F.lit("attributes"))))
    failed = F.lower(F.coalesce(F.try_element_at(tags, F.lit("error")), _alias("body", ("error",)), F.lit("false"))) == "true"
    return messages.select(
        *[c.alias(n) for n, c in cols.items()],
        failed.alias("error"),
        F.coalesce(F.try_element_at(process, F.lit("serviceName")), _alias("body", ("serviceName",)), F.lit("unknown")).alias("service"),
        tags.alias("tags"),
    )


def kafka_rows(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as Kafka key and JSON value, for alert and live-record topics; times keep their microseconds."""
    value = F.to_json(F.struct(*df.columns), EXACT_TIMES).alias("value")
    return df.select(*([F.col(key).cast("string").alias("key")] if key else []), value)


def write_kafka(stream: DataFrame, servers: str, topic: str, checkpoint: str, *, key: str | None = None):
    """Continuous alert or live-record sink; needs the Kafka connector on the class path."""
    writer = kafka_rows(stream, key).writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
    return writer.option("topic", topic).option("checkpointLocation", checkpoint).start()
