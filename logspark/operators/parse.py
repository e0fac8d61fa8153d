"""Lines to structured log records, with a quarantine for what could not be read.

One parse step decides the format of a line (JSON, syslog header, the line patterns in listed
order, logfmt with more than one key, raw) and reads its fields into one map.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.levels import extract_level, syslog_level
from logspark.functions.once import evaluated
from logspark.functions.text import found, json_map, service_in
from logspark.functions.timefx import parse_timestamp

# Base patterns named in line formats (public grok vocabulary, as Java regular expressions).
BASE_PATTERNS = {
    "WORD": r"\b\w+\b",
    "NOTSPACE": r"\S+",
    "DATA": r".*?",
    "GREEDYDATA": r".*",
    "INT": r"[+-]?[0-9]+",
    "POSINT": r"\b[1-9][0-9]*\b",
    "NUMBER": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "USER": r"[a-zA-Z0-9._-]+",
    "PROG": r"[\x21-\x5a\x5c\x5e-\x7e]+",
    "HOSTNAME": r"\b[0-9A-Za-z][0-9A-Za-z-]{0,62}(?:\.[0-9A-Za-z][0-9A-Za-z-]{0,62})*\.?",
    "IPV4": r"(?:(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|[0-1]?[0-9]{1,2})",
    "IPV6": r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}",
    "IPORHOST": r"(?:%{IPV6}|%{IPV4}|%{HOSTNAME})",
    "URIPATH": r"(?:/[A-Za-z0-9$.+!*'(){},~:;=@#%&_\-]*)+",
    "URIPARAM": r"\?[A-Za-z0-9$.+!*'|(){},~@#%&/=:;_?\-\[\]<>]*",
    "MONTH": r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\b",
    "HTTPDATE": r"[0-9]{1,2}/%{MONTH}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-]?[0-9]+",
    "SYSLOGTIMESTAMP": r"%{MONTH} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}",
    "TIMESTAMP_ISO8601": r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:?[0-9]{2}(?::?[0-9]{2}(?:[:.,][0-9]+)?)?(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?",
    "LOGLEVEL": r"(?i:trace|debug|notice|info(?:rmation)?|warn(?:ing)?|err(?:or)?|crit(?:ical)?|fatal|severe|emerg(?:ency)?)",
    "JAVACLASS": r"(?:[a-zA-Z$_][a-zA-Z$_0-9]*\.)*[a-zA-Z$_][a-zA-Z$_0-9]*",
}
# Line formats in matching order. KUBERNETES comes before DOCKER, so a line with two
# words after its timestamp is read as KUBERNETES.
LINE_FORMATS = {
    "apache_common": r'%{IPORHOST:clientip} %{USER:ident} %{USER:auth} \[%{HTTPDATE:timestamp}\] "(?:%{WORD:verb} %{NOTSPACE:request}(?: HTTP/%{NUMBER:httpversion})?|%{DATA:rawrequest})" %{NUMBER:response} (?:%{NUMBER:bytes}|-)',
    "nginx_access": r'%{IPORHOST:remote_addr} - %{DATA:remote_user} \[%{HTTPDATE:time_local}\] "%{WORD:method} %{URIPATH:path}(?:%{URIPARAM:params})? HTTP/%{NUMBER:http_version}" %{INT:status} %{INT:body_bytes_sent} "%{DATA:http_referer}" "%{DATA:http_user_agent}"',
    "java_stacktrace": r"(?m:^)%{TIMESTAMP_ISO8601:timestamp}\s+%{LOGLEVEL:level}\s+\[%{DATA:thread}\]\s+%{JAVACLASS:class}\s*:\s*%{GREEDYDATA:message}",
    "syslog": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{IPORHOST:logsource} )?%{PROG:program}(?:\[%{POSINT:pid}\])?:\s*%{GREEDYDATA:message}",
    "json_log": r"\{.*\}",
    "kubernetes": r"%{TIMESTAMP_ISO8601:timestamp} %{WORD:stream} %{WORD:log_type} %{GREEDYDATA:message}",
    "docker": r"%{TIMESTAMP_ISO8601:timestamp} %{WORD:level} %{GREEDYDATA:message}",
}
# Texts without which a format cannot fit; searched before its pattern.
FORMAT_TEXTS = {
    "apache_common": ("[", '"'),
    "nginx_access": ("[", '"', " - "),
    "java_stacktrace": ("[", "]", ":"),
    "syslog": (":",),
    "json_log": ("{", "}"),
}
# RFC 3164 header, logfmt pair, and the application line.
RFC3164 = r"^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.+)$"
LOGFMT_PAIR = r'(\w+)=(?:"([^"]*)"|([^\s]+))'
APP_LINE = r"(\d{4}-\d{2}-\d{2}T[^\s]+)\s+(INFO|WARN|ERROR)\s+\[.*?\]\s+(?:(GET|POST|PUT|DELETE)\b)?\s*(\S*)\s*(.*)"
APP_DURATION = r"(?:\b(\d+)ms\b|response_time=(\d+)ms)"

SEP = "\u0001"


def expand(pattern: str, base: Mapping[str, str] | None = None) -> tuple[str, list[str]]:
    """A line format as one regular expression with numbered groups, and the field of each group."""
    known = {**BASE_PATTERNS, **(base or {})}
    fields: list[str] = []

    def one(m: re.Match) -> str:
        body = re.sub(r"%\{(\w+)(?::(\w+))?\}", one, known[m[1]])
        if m[2]:
            fields.append(m[2])
            return f"({body})"
        return f"(?:{body})"

    # Fields are appended outside-in, left to right, which is group order: base patterns capture nothing.
    return re.sub(r"%\{(\w+)(?::(\w+))?\}", one, pattern), fields


def _captures(line: Column, pattern: str, fields: list[str]) -> Column:
    """All groups of the first match in one regex pass, as a map without empty values."""
    if not fields:
        return F.create_map().cast("map<string,string>")
    template = SEP.join(f"${i + 1}" for i in range(len(fields)))
    # Formats describe one line; what a joined entry has below it belongs to the last field, the message.
    head, rest = F.substring_index(line, "\n", 1), F.regexp_extract(line, r"(?s)^[^\n]*(\n.*)$", 1)
    first = F.regexp_replace(head, f"^.*?(?:{pattern}).*$", template)
    joined = F.concat(first, rest) if fields[-1] == "message" else first
    pairs = F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.split(joined, SEP, -1))
    return F.map_filter(pairs, lambda _, v: v != "")


def logfmt(line: Column) -> Column:
    """``key=value`` and ``key="v v"`` pairs; the last value of a repeated key wins."""
    pairs = F.regexp_extract_all(line, F.lit(LOGFMT_PAIR), F.lit(0))
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.regexp_extract(p, LOGFMT_PAIR, 1).alias("key"),
            F.coalesce(found(p, LOGFMT_PAIR, 2), F.regexp_extract(p, LOGFMT_PAIR, 3)).alias("value"),
        ),
    )
    keys = F.transform(entries, lambda e: e["key"])
    last = F.filter(
        F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))),
        lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["key"]),
    )
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def syslog_fields(line: Column) -> Column:
    """RFC 3164 fields as a map; facility and severity come from the priority number."""
    pri = F.regexp_extract(line, RFC3164, 1).try_cast("int")
    return F.create_map(
        F.lit("priority"), pri.cast("string"),
        F.lit("facility"), F.floor(pri / 8).cast("string"),
        F.lit("severity_number"), (pri % 8).cast("string"),
        F.lit("timestamp"), F.regexp_extract(line, RFC3164, 2),
        F.lit("hostname"), F.regexp_extract(line, RFC3164, 3),
        F.lit("message"), F.regexp_extract(line, RFC3164, 4),
        F.lit("level"), syslog_level(pri % 8),
    )


def parse_syslog(df: DataFrame, line: str = "value") -> DataFrame:
    """RFC 3164 columns; a line without the header keeps its text as message, level INFO."""
    c = F.col(line)
    ok = c.rlike(RFC3164)
    pri = F.when(ok, F.regexp_extract(c, RFC3164, 1).try_cast("int"))
    return df.select(
        "*",
        pri.alias("priority"),
        F.floor(pri / 8).cast("int").alias("facility"),
        (pri % 8).alias("severity"),
        F.when(ok, F.regexp_extract(c, RFC3164, 2)).alias("header_time"),
        F.when(ok, F.regexp_extract(c, RFC3164, 3)).alias("hostname"),
        F.when(ok, F.regexp_extract(c, RFC3164, 4)).otherwise(c).alias("message"),
        syslog_level(pri % 8).alias("level"),
    )


def json_fields(line: Column) -> Column:
    return json_map(F.when(F.ltrim(line).startswith("{"), line))


def detect_format(
    line: Column, formats: Mapping[str, str] = LINE_FORMATS, base: Mapping[str, str] | None = None, parsed: Column | None = None
) -> Column:
    """Name of the first format that fits a line; ``parsed`` gives its JSON fields where they are at hand."""
    parsed = json_fields(line) if parsed is None else parsed
    out = F.when(parsed.isNotNull(), "json").when(line.rlike(RFC3164), "rfc3164")
    for name, text in formats.items():
        fits = line.rlike(expand(text, base)[0])
        if formats[name] == LINE_FORMATS.get(name):
            for part in reversed(FORMAT_TEXTS.get(name, ())):
                fits = line.contains(part) & fits
        out = out.when(fits, name)
    keys = F.array_distinct(F.regexp_extract_all(line, F.lit(LOGFMT_PAIR), F.lit(1)))
    return out.when(F.size(keys) > 1, "logfmt").otherwise("raw")


def read_fields(
    df: DataFrame, line: str = "value", *, formats: Mapping[str, str] | None = None, base: Mapping[str, str] | None = None
) -> DataFrame:
    """Add ``format`` and the ``fields`` map of each line. ``formats`` are custom ones, tried after the built-in list."""
    all_formats = {**LINE_FORMATS, **(formats or {})}
    c = F.col(line)
    read = evaluated(df, {"__json": json_fields(c)})
    typed = evaluated(read, {"format": detect_format(c, all_formats, base, F.col("__json"))})
    fields = F.when(F.col("format") == "json", F.col("__json"))
    fields = fields.when(F.col("format") == "rfc3164", syslog_fields(c))
    for name, text in all_formats.items():
        fields = fields.when(F.col("format") == name, _captures(c, *expand(text, base)))
    fields = fields.when(F.col("format") == "logfmt", logfmt(c))
    return evaluated(typed, {"fields": fields.otherwise(F.create_map(F.lit("message"), c))}).drop("__json")


def _pick(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in names])


# Aliases of the other conventional columns, first one present wins.
CONVENTIONAL = {
    "id": ("id", "_id"), "client_ip": ("client_ip", "clientip", "clientIp", "remote_addr"), "endpoint": ("endpoint", "path", "request", "url"),
    "user_id": ("user_id", "userId"), "trace_id": ("trace_id", "traceId", "traceID"), "span_id": ("span_id", "spanId", "spanID"),
}


def to_logs(parsed: DataFrame, line: str = "value", *, zone: str | None = None, as_of: Any = None) -> DataFrame:
    """Normalise parsed fields: aliases, UTC timestamp, level. A bad time stays NULL.

    Syslog times have no year; ``as_of`` (a time or column) supplies it. Columns that the input has keep
    its values.
    """
    message = F.coalesce(_pick("message", "msg", "body"), F.col(line))
    levels = [_pick(n) for n in ("level", "severity", "loglevel", "priority")]
    duration = F.coalesce(_pick("response_time"), found(_pick("duration"), r"^(\d+)\s*(?:ms)?$", 1))
    keep = [c for c in parsed.columns if c not in (line, "format", "fields")]
    now = as_of if as_of is None or isinstance(as_of, Column) else F.lit(as_of)
    timed = parsed.withColumn("__time", _pick("timestamp", "time", "ts", "time_local"))
    return timed.select(
        *keep,
        "format",
        parse_timestamp(F.col("__time"), zone=zone, as_of=now).alias("timestamp"),
        F.when(F.col("format") == "rfc3164", _pick("level")).otherwise(extract_level(levels, message)).alias("level"),
        message.alias("message"),
        F.coalesce(_pick("service", "serviceName", "hostname", "program"), service_in(message)).alias("service"),
        _pick("version", "serviceVersion", "app_version").alias("version"),
        _pick("environment", "env", "stage").alias("environment"),
        duration.try_cast("bigint").alias("response_time"),
        _pick("status_code", "status", "response").try_cast("int").alias("status_code"),
        *[_pick(*names).alias(n) for n, names in CONVENTIONAL.items() if n not in keep],
        F.col("fields").alias("attributes"),
        F.col(line).alias("raw"),
    )


def parse_logs(df: DataFrame, line: str = "value", **options) -> DataFrame:
    """Format detection, field reading and normalising in one projection (no shuffle)."""
    times = {n: options.pop(n, None) for n in ("zone", "as_of")}
    return to_logs(read_fields(df, line, **options), line, **times)


def quarantine(logs: DataFrame) -> DataFrame:
    """Records that named a time which could not be read (a syslog time without ``as_of`` too), or that were meant as JSON but are not."""
    has_time = F.coalesce(*[F.try_element_at("attributes", F.lit(n)) for n in ("timestamp", "time", "ts", "time_local")])
    bad_time = has_time.isNotNull() & F.col("timestamp").isNull()
    bad_json = F.ltrim("raw").startswith("{") & (F.col("format") != "json")
    return logs.where(bad_time | bad_json).withColumn("reason", F.when(bad_json, "bad_json").otherwise("bad_timestamp"))


def format_counts(df: DataFrame, line: str = "value", **options) -> DataFrame:
    formats = {**LINE_FORMATS, **options.get("formats", {})}
    return df.groupBy(detect_format(F.col(line), formats, options.get("base")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def app_entries(df: DataFrame, line: str = "value") -> DataFrame:
    """Entries of the application line format.

    The level must be exactly INFO, WARN or ERROR (any case); other lines are dropped. The duration
    is the first ``NNNms`` or ``response_time=NNNms`` anywhere in the line; 0 when absent or beyond 64 bits.
    """
    c = F.col(line)
    pattern = f"(?i){APP_LINE}"
    ms = F.coalesce(found(c, APP_DURATION, 1), found(c, APP_DURATION, 2), F.lit("0"))
    return df.where(c.rlike(pattern)).select(
        *[x for x in df.columns if x != line],
        F.regexp_extract(c, pattern, 1).alias("timestamp"),
        F.upper(F.regexp_extract(c, pattern, 2)).alias("level"),
        F.regexp_extract(c, pattern, 4).alias("endpoint"),
        F.coalesce(ms.try_cast("bigint"), F.lit(0)).alias("response_time"),
        F.trim(F.regexp_extract(c, pattern, 5)).alias("message"),
    )
