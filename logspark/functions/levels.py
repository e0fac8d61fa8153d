"""Log levels: extraction, normalising, syslog and telemetry severities."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted level names and what they mean; any other name means INFO.
LEVELS = {
    "TRACE": "TRACE",
    "DEBUG": "DEBUG",
    "INFO": "INFO",
    "INFORMATION": "INFO",
    "WARN": "WARN",
    "WARNING": "WARN",
    "ERROR": "ERROR",
    "ERR": "ERROR",
    "FATAL": "FATAL",
    "CRITICAL": "FATAL",
    "CRIT": "FATAL",
}
# Level words searched in a message.
LEVEL_WORD = r"(?i)\b(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\b"
# Syslog severity to level.
SYSLOG_LEVELS = {0: "FATAL", 1: "FATAL", 2: "FATAL", 3: "ERROR", 4: "WARN", 5: "INFO", 6: "INFO", 7: "DEBUG"}
# Severity numbers of the public OpenTelemetry log data model.
SEVERITY_NUMBERS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "WARNING": 13, "ERROR": 17, "FATAL": 21, "CRITICAL": 21}


def lookup(mapping: dict, key: Column, default) -> Column:
    """A literal map lookup with a default; stays inside generated code."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def normalise_level(level: Column) -> Column:
    return lookup(LEVELS, F.upper(level.cast("string")), "INFO")


def syslog_level(severity: Column) -> Column:
    return lookup(SYSLOG_LEVELS, severity.cast("int"), "INFO")


def severity_number(level: Column) -> Column:
    return lookup(SEVERITY_NUMBERS, F.upper(level), SEVERITY_NUMBERS["INFO"])


def extract_level(fields: list[Column], message: Column) -> Column:
    """First non-empty level field, else the first level word of the message, else INFO."""
    given = [F.nullif(f, F.lit("")) for f in fields]
    word = F.nullif(F.regexp_extract(message, LEVEL_WORD, 1), F.lit(""))
    return normalise_level(F.coalesce(*given, word, F.lit("INFO")))
