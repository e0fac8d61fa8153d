"""Schemas of the conventional tables, and small constant tables."""

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGS = (
    "id STRING, timestamp TIMESTAMP, level STRING, message STRING, service STRING, version STRING,"
    " environment STRING, user_id STRING, trace_id STRING, span_id STRING, client_ip STRING,"
    " endpoint STRING, response_time BIGINT, status_code INT,"
    " geo STRUCT<country:STRING,region:STRING,city:STRING>, attributes MAP<STRING,STRING>,"
    " format STRING, raw STRING"
)

METRICS = (
    "ts TIMESTAMP, service STRING, name STRING, value DOUBLE, type STRING, unit STRING,"
    " attributes MAP<STRING,STRING>"
)

SPANS = (
    "trace_id STRING, span_id STRING, parent_span_id STRING, service STRING, operation STRING,"
    " start_time TIMESTAMP, end_time TIMESTAMP, duration DOUBLE, error BOOLEAN, tags MAP<STRING,STRING>"
)


def literal_table(spark: SparkSession, rows: Iterable[tuple], ddl: str) -> DataFrame:
    """A small constant table as part of the plan.

    Its size is known to the optimizer, which therefore broadcasts it and leaves the large side of
    a join unshuffled; a table made from driver rows has no size estimate.
    """
    fields = T.StructType.fromDDL(ddl)

    def cell(value: Any, field: T.StructField) -> Column:
        if isinstance(value, dict):
            value = F.create_map(*[F.lit(x) for kv in value.items() for x in kv])
        elif isinstance(value, list):
            value = F.array(*[F.lit(x) for x in value])
        return (value if isinstance(value, Column) else F.lit(value)).cast(field.dataType).alias(field.name)

    packed = F.array(*[F.struct(*[cell(v, f) for v, f in zip(row, fields)]) for row in rows])
    return spark.range(1).select(F.inline(packed))
