"""Figures read out of free text lines."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the performance report; all run on the lower-cased line.
ERROR_LINE = r"(error|exception|fail|timeout|5\d{2})"
DURATION = r"(response_time|latency|duration|took)[^\d]*([\d.]+)\s*(ms|s|sec|seconds|millisecond)"
ACCESS_STATUS = r"\s(20\d|30\d|40\d|50\d)\s"
TRAILING_INTEGER = r"\s(\d+)$"
NUMBER = r"[-+]?(?:\d*\.\d+|\d+)(?:e[-+]?\d+)?"
CPU = r"cpu\s*(avg|usage|util(?:ization)?)?[^\d]*([\d.]+)\s*%"
MEMORY = r"mem(?:ory)?\s*(usage|util(?:ization)?)?[^\d]*([\d.]+)\s*%"
LOAD = r"load(?:\s*avg(?:erage)?)?[^\d]*([\d.]+)"
MAX_ACCESS_MS = 120000
# Service name patterns, tried in this order.
SERVICE_PATTERNS = (r"(?i)service[=:](\w+)", r"(?i)app[=:](\w+)", r"(?i)component[=:](\w+)")


def found(text: Column, pattern: str, group: int) -> Column:
    """A capture, or NULL when the pattern does not hit."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def number(text: Column) -> Column:
    """The leading decimal number of a text such as ``1.5`` or ``1.2.3``."""
    return F.regexp_extract(text, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def number_tokens(text: Column) -> Column:
    """Numbers in a text; one that no double can hold is left out."""
    read = F.transform(F.regexp_extract_all(text, F.lit(f"(?i){NUMBER}"), F.lit(0)), lambda x: x.try_cast("double"))
    return F.filter(read, lambda x: F.abs(x) < F.lit(float("inf")))


def with_line_figures(df: DataFrame, line: str) -> DataFrame:
    """Add the report figures of one line: error flag, duration, bytes, cpu, memory, load.

    A labelled duration wins over the access-log reading. ``millisecond`` means ms (it used to be
    scaled like seconds).
    """
    low, unit, numbers = F.col("__low"), F.col("__unit"), F.col("__numbers")
    access = (unit == "") & low.rlike(ACCESS_STATUS) & low.rlike(TRAILING_INTEGER)
    last, previous = F.try_element_at(numbers, F.lit(-1)), F.try_element_at(numbers, F.lit(-2))
    enough = F.size(numbers) >= 2
    scale = F.when(unit.isin("ms", "millisecond"), 1.0).otherwise(1000.0)
    read = (
        df.withColumn("__low", F.lower(line))
        .withColumns({"__unit": F.regexp_extract(low, DURATION, 3), "__amount": F.regexp_extract(low, DURATION, 2)})
        .withColumn("__numbers", F.when(access, number_tokens(low)))
    )
    return read.select(
        *df.columns,
        low.rlike(ERROR_LINE).alias("is_error"),
        F.when(unit != "", number(F.col("__amount")) * scale).when(enough & (last < MAX_ACCESS_MS), last).alias("duration_ms"),
        F.when(enough & (previous > 0), previous).alias("bytes"),
        (number(F.regexp_extract(low, CPU, 2)) / 100.0).alias("cpu"),
        (number(F.regexp_extract(low, MEMORY, 2)) / 100.0).alias("memory"),
        number(F.regexp_extract(low, LOAD, 1)).alias("load"),
    )


def json_map(text: Column) -> Column:
    """The fields of a JSON object, NULL for anything else; the last value of a repeated key wins."""
    fields = F.from_json(text, "map<string,string>")
    keys = F.map_keys(fields)
    last = F.filter(F.map_entries(fields), lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), F.map_from_entries(last)).otherwise(fields)


def message_length(message: Column) -> Column:
    return F.length(message)


def word_count(message: Column) -> Column:
    """Pieces between white space; a leading or trailing blank counts one."""
    return F.size(F.split(message, r"\s+", -1))


def service_in(message: Column) -> Column:
    """Service named in a message, by the first pattern that hits; NULL when none does."""
    return F.coalesce(*[found(message, p, 1) for p in SERVICE_PATTERNS])


def first_of(*names: str) -> Column:
    """Alias fill: the first non-empty of several columns."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def coerced(value: Column) -> Column:
    """Typed view of a text value: kind and the value per kind (unsigned numbers only)."""
    is_int, is_float = value.rlike(r"^\d+$"), value.rlike(r"^\d*\.\d+$")
    return F.struct(
        F.when(value.isin("true", "false"), "boolean")
        .when(value == "null", "null")
        .when(is_int, "integer")
        .when(is_float, "double")
        .otherwise("string")
        .alias("kind"),
        F.when(value.isin("true", "false"), value == "true").alias("as_boolean"),
        F.when(is_int, value.try_cast("bigint")).alias("as_integer"),
        F.when(is_int | is_float, value.try_cast("double")).alias("as_double"),
    )
