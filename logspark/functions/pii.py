"""Personal data: detection, census and redaction of text columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Record patterns, applied in this order.
RECORD_PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
    "SSN": r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b",
    "CREDIT_CARD": r"\b(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "IP_ADDRESS": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "MAC_ADDRESS": r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b",
    "API_KEY": r"\b[A-Za-z0-9]{32,}\b",
    "JWT_TOKEN": r"\beyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\.[A-Za-z0-9_-]*\b",
    "UUID": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b",
    "PASSWORD": r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*[^\s]+",
    "USERNAME": r"(?i)\b(?:username|user|login)\s*[:=]\s*[^\s]+",
}
# Text patterns of the access layer; the address is detected but not redacted.
TEXT_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "ssn": r"\b\d{3}-?\d{2}-?\d{4}\b",
    "creditCard": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b",
    "ipAddress": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "apiKey": r"\b[A-Za-z0-9]{32,}\b",
}
NOT_REDACTED = ("ipAddress",)
MODES = ("hash", "mask", "remove")

# Types whose matches can only begin (or end) with a letter, digit or underscore: one look-around
# says the same as a full word boundary there.
WORD_FIRST = {"SSN", "CREDIT_CARD", "IP_ADDRESS", "MAC_ADDRESS", "API_KEY", "JWT_TOKEN", "UUID", "PASSWORD", "USERNAME", "ssn", "creditCard", "phone", "ipAddress", "apiKey"}
WORD_LAST = (WORD_FIRST | {"PHONE"}) - {"JWT_TOKEN"}
# Every match of a type holds one of these texts (lower case); a plain search for them comes first.
REQUIRED = {
    "EMAIL": ("@",), "email": ("@",), "IP_ADDRESS": (".",), "ipAddress": (".",), "JWT_TOKEN": ("eyj",), "UUID": ("-",),
    "PASSWORD": ("password", "passwd", "pwd"), "USERNAME": ("user", "login"), "MAC_ADDRESS": (":", "-"),
}
# Every match of these types holds such a run of digits, or is at least so long.
DIGITS = {**dict.fromkeys(("PHONE", "SSN", "CREDIT_CARD", "ssn", "creditCard", "phone"), "[0-9]{4}"), **dict.fromkeys(("IP_ADDRESS", "ipAddress"), "[0-9][.][0-9]")}
LEAST_LENGTH = {"API_KEY": 32, "apiKey": 32}

# Word boundaries over ASCII letters only, whatever the Java version takes as a word character.
NOT_AFTER_WORD, NOT_BEFORE_WORD = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ASCII_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(kind: str, pattern: str) -> str:
    """The pattern with its word boundaries spelled out for Java."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern[len(flags):]
    if kind in WORD_FIRST and body.startswith(r"\b"):
        body = NOT_AFTER_WORD + body[2:]
    if kind in WORD_LAST and body.endswith(r"\b"):
        body = body[:-2] + NOT_BEFORE_WORD
    return flags + body.replace(r"\b", ASCII_BOUNDARY)


def possible(text: Column, kind: str) -> Column:
    """A cheap necessary condition for a match of a type."""
    out = F.lit(True)
    if kind in REQUIRED:
        out = F.lit(False)
        for word in REQUIRED[kind]:
            out = out | F.lower(text).contains(word)
    if kind in LEAST_LENGTH:
        out = out & (F.length(text) >= LEAST_LENGTH[kind])
    return out & text.rlike(DIGITS[kind]) if kind in DIGITS else out


def holds(text: Column, kind: str, pattern: str) -> Column:
    return possible(text, kind) & text.rlike(java(kind, pattern))


def all_matches(text: Column, kind: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(java(kind, pattern)), F.lit(0))
    return F.when(possible(text, kind), found).otherwise(F.array().cast("array<string>"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that a long chain of replacements does not repeat its input."""
    return F.element_at(F.transform(F.array(value), body), 1)


def replace_matches(text: Column, kind: str, pattern: str, token: Callable[[Column], Column]) -> Column:
    """Replace every match by a token computed from it: the pieces between matches, interleaved with tokens."""
    expression = java(kind, pattern)
    pieces = F.split(text, expression, -1)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(expression), F.lit(0)), token)
    return F.array_join(F.zip_with(pieces, tokens, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")


def _digest(match: Column) -> Column:
    return F.substring(F.sha2(match, 256), 1, 8)


def record_token(kind: str, mode: str) -> Callable[[Column], Column]:
    if mode == "hash":
        return lambda m: F.concat(F.lit(f"[{kind}_"), _digest(m), F.lit("]"))
    if mode == "mask":
        return lambda m: F.concat(F.lit(f"[{kind}_"), F.substring(F.lit("*" * 8), F.lit(1), F.length(m)), F.lit("]"))
    if mode == "remove":
        return lambda m: F.lit(f"[{kind}_REDACTED]")
    raise ValueError(f"unknown redaction mode {mode!r}")


def text_token(kind: str, mode: str) -> Callable[[Column], Column]:
    if mode == "hash":
        return lambda m: F.concat(F.lit(f"[{kind.upper()}:"), _digest(m), F.lit("]"))
    if mode == "mask":
        stars = lambda n: F.rpad(F.lit(""), n, "*") if isinstance(n, int) else F.regexp_replace(n, "(?s).", "*")
        return lambda m: F.when(
            F.length(m) > 4,
            F.concat(F.substring(m, 1, 2), stars(F.substring(m, F.lit(3), F.length(m) - 4)), F.right(m, F.lit(2))),
        ).otherwise(stars(m))
    if mode == "remove":
        return lambda m: F.lit(f"[{kind.upper()}_REDACTED]")
    raise ValueError(f"unknown redaction mode {mode!r}")


def redacted(text: Column, mode: str = "hash", patterns: Mapping[str, str] = RECORD_PATTERNS) -> Column:
    """Record redaction: a type is replaced in the running text when the original text holds it."""

    def chain(current: Column, left: list[tuple[str, str]]) -> Column:
        if not left:
            return current
        (kind, pattern), rest = left[0], left[1:]
        step = F.when(holds(text, kind, pattern), replace_matches(current, kind, pattern, record_token(kind, mode))).otherwise(current)
        return _let(step, lambda v: chain(v, rest)) if rest else step

    any_hit = F.lit(False)
    for kind, pattern in patterns.items():
        any_hit = any_hit | holds(text, kind, pattern)
    return F.when(any_hit, chain(text, list(patterns.items()))).otherwise(text)


def redacted_text(text: Column, mode: str = "hash", patterns: Mapping[str, str] = TEXT_PATTERNS) -> Column:
    """Text redaction of the access layer: every type runs on the running text."""
    kinds = [(k, p) for k, p in patterns.items() if k not in NOT_REDACTED]

    def chain(current: Column, left: list[tuple[str, str]]) -> Column:
        (kind, pattern), rest = left[0], left[1:]
        step = F.when(holds(current, kind, pattern), replace_matches(current, kind, pattern, text_token(kind, mode))).otherwise(current)
        return _let(step, lambda v: chain(v, rest)) if rest else step

    return chain(text, kinds)


def redacted_value(value: Column, kind: T.DataType, mode: str) -> Column | None:
    """A value with its strings redacted at any depth of arrays, maps and structs; None when it can hold none."""
    if isinstance(kind, T.StringType):
        return redacted(value, mode)
    if isinstance(kind, T.ArrayType):
        if redacted_value(value, kind.elementType, mode) is None:
            return None
        return F.transform(value, lambda x: redacted_value(x, kind.elementType, mode))
    if isinstance(kind, T.MapType):
        if redacted_value(value, kind.valueType, mode) is None:
            return None
        return F.transform_values(value, lambda _, v: redacted_value(v, kind.valueType, mode))
    if isinstance(kind, T.StructType):
        fields = {f.name: redacted_value(value[f.name], f.dataType, mode) for f in kind}
        if not any(x is not None for x in fields.values()):
            return None
        rebuilt = F.struct(*[(value[n] if x is None else x).alias(n) for n, x in fields.items()])
        return F.when(value.isNotNull(), rebuilt)
    return None


def redact(df: DataFrame, mode: str = "hash", columns: Sequence[str] | None = None) -> DataFrame:
    """Redact string columns and all strings inside array, map and struct columns."""
    named = [f for f in df.schema if columns is None or f.name in columns]
    out = {f.name: redacted_value(F.col(f.name), f.dataType, mode) for f in named}
    return df.withColumns({n: c for n, c in out.items() if c is not None})


def detections(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), patterns: Mapping[str, str] = RECORD_PATTERNS) -> DataFrame:
    """One row per record, type and field with the number of matches."""
    cells = F.array(
        *[
            F.struct(F.lit(kind).alias("type"), F.lit(c).alias("field"), F.size(all_matches(F.col(c), kind, p)).cast("bigint").alias("n"))
            for c in columns
            for kind, p in patterns.items()
        ]
    )
    return df.select(*keep, F.explode(cells).alias("d")).select(*keep, "d.*").where(F.col("n") > 0)


def census(df: DataFrame, columns: Sequence[str], patterns: Mapping[str, str] = RECORD_PATTERNS) -> DataFrame:
    """Matches and records per type and field."""
    return detections(df, columns, patterns=patterns).groupBy("type", "field").agg(
        F.sum("n").alias("matches"), F.count(F.lit(1)).alias("records")
    )


def distinct_matches(df: DataFrame, text: str, keep: Sequence[str], patterns: Mapping[str, str] = TEXT_PATTERNS) -> DataFrame:
    """Distinct matches per record and type, one row each."""
    cells = F.array(*[F.struct(F.lit(k).alias("type"), F.array_distinct(all_matches(F.col(text), k, p)).alias("found")) for k, p in patterns.items()])
    return (
        df.select(*keep, F.explode(cells).alias("d"))
        .select(*keep, "d.type", F.explode("d.found").alias("match"))
    )


def distinct_counts(df: DataFrame, text: str, patterns: Mapping[str, str] = TEXT_PATTERNS) -> DataFrame:
    """Distinct matches per type over all records."""
    return distinct_matches(df, text, [], patterns).groupBy("type").agg(F.count_distinct("match").alias("n"))
