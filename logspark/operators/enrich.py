"""Enrichment by lookup tables: place of an address, user session, service data, word sentiment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.functions.text import first_of
from logspark.operators.ordered import running, time_chunk

IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ip_number(ip: Column) -> Column:
    """IPv4 text as a number; NULL when it is not an address."""
    parts = [F.regexp_extract(ip, IPV4, i).try_cast("bigint") for i in range(1, 5)]
    ok = ip.rlike(IPV4)
    for p in parts:
        ok = ok & (p <= 255)
    a, b, c, d = parts
    return F.when(ok, ((a * 256 + b) * 256 + c) * 256 + d)


DOTTED = r":(\d{1,3}(?:\.\d{1,3}){3})$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def address_key(ip: Column) -> Column:
    """An address as text that sorts by value: ``4`` and 8 hexadecimal digits, or ``6`` and 32; NULL when it is none.

    An IPv4 address inside IPv6 (``::ffff:1.2.3.4``) has the key of the IPv4 address.
    """
    hex8 = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")
    groups = lambda text: F.filter(F.split(text, ":", -1), lambda g: g != "")
    # Eight groups, or "::" once in place of one or more; a single colon stands between groups only.
    shape = r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$"

    def digits(g: Column) -> Column:
        zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(g["head"]) - F.size(g["tail"]))
        return F.array_join(F.transform(F.concat(g["head"], zeros, g["tail"]), lambda x: F.lpad(x, 4, "0")), "")

    def mapped(text: Column) -> Column:
        return F.when(text.rlike("^0{20}ffff"), F.concat(F.lit("4"), F.substring(text, 25, 8))).otherwise(F.concat(F.lit("6"), text))

    def six(plain: Column) -> Column:
        sides = F.split(plain, "::", -1)
        tail = F.coalesce(groups(F.get(sides, F.lit(1))), F.array().cast("array<string>"))
        split = F.struct(groups(F.get(sides, F.lit(0))).alias("head"), tail.alias("tail"), (F.size(sides) == 2).alias("gap"))
        size = lambda g: F.size(g["head"]) + F.size(g["tail"])
        return F.when(plain.rlike(shape), bound(split, lambda g: F.when(F.when(g["gap"], size(g) < 8).otherwise(size(g) == 8), bound(digits(g), mapped))))

    def unfolded(low: Column) -> Column:
        pair = bound(hex8(ip_number(F.regexp_extract(low, DOTTED, 1))), lambda h: F.concat(F.regexp_replace(low, r"[\d.]+$", ""), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))
        return F.when(low.contains("."), pair).otherwise(low)

    four = bound(ip_number(ip), lambda n: F.concat(F.lit("4"), hex8(n)))
    return F.when(ip.contains(":"), bound(unfolded(F.lower(F.trim(ip))), six)).otherwise(four)


def add_geo(df: DataFrame, ranges: DataFrame, *, ip: str = "client_ip") -> DataFrame:
    """Left join with disjoint address ranges ``(first_ip, last_ip, country, region, city)`` of IPv4 and IPv6.

    Distinct addresses and range starts are put in one order by value; the last start seen is carried along, chunk by
    chunk of the address space (/16, or the first 48 bits of IPv6), so a range of any width is one row. The
    places found meet the records on the address. Ranges that are no addresses are left out.
    """
    kind = "struct<__end:string,geo:struct<country:string,region:string,city:string>>"
    place = F.struct(address_key(F.col("last_ip")).alias("__end"), F.struct(*[F.col(c).cast("string") for c in ("country", "region", "city")]).alias("geo"))
    starts = ranges.select(address_key(F.col("first_ip")).alias("__key"), F.lit(0).alias("__side"), F.lit(None).cast("string").alias("__ip"), place.cast(kind).alias("__place"))
    asked = df.select(F.col(ip).alias("__ip")).where(F.col(ip).isNotNull()).distinct()
    rows = starts.unionByName(asked.select(address_key(F.col("__ip")).alias("__key"), F.lit(1).alias("__side"), "__ip", F.lit(None).cast(kind).alias("__place"))).where("__key IS NOT NULL")
    chunk = F.conv(F.substring("__key", F.lit(2), F.when(F.col("__key").startswith("4"), 4).otherwise(12)), 16, 10).cast("bigint")
    placed = rows.withColumns({"__version": F.substring("__key", 1, 1), "__chunk": chunk})
    seen = running(placed, ["__version"], "__chunk", ["__key", "__side"], {"__last": ("last", F.col("__place"))})
    found = seen.where((F.col("__side") == 1) & (F.col("__key") <= F.col("__last.__end"))).select("__ip", F.col("__last.geo").alias("geo"))
    return df.join(found, F.col(ip) == F.col("__ip"), "left").select(*df.columns, "geo")


def add_service_metadata(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join with one row per service; Spark broadcasts the table while it is below its size limit."""
    return df.join(metadata, "service", "left")


def add_session(
    df: DataFrame, session_rows: DataFrame, *, user: str = "user_id", ts: str = "timestamp", tie: str = "id", chunk_seconds: int = 3600
) -> DataFrame:
    """As-of join: the latest session ``(user, started_at, session_id)`` started at or before each record.

    Both sides are put in one order per user; the last session seen is carried along, chunk by
    chunk, so a busy user does not fill one task. Records without a user keep a NULL session.
    """
    columns = [c for c in df.columns]
    events = df.where(F.col(user).isNotNull()).select(
        F.col(user).alias("__user"), F.col(ts).alias("__at"), F.lit(1).alias("__side"), F.col(tie).cast("string").alias("__tie"),
        F.lit(None).cast("string").alias("__session"), F.struct(*columns).alias("__row"),
    )
    starts = session_rows.select(
        F.col(user).alias("__user"), F.col("started_at").alias("__at"), F.lit(0).alias("__side"), F.col("session_id").alias("__tie"),
        F.col("session_id").alias("__session"), F.lit(None).cast(df.select(F.struct(*columns).alias("r")).schema["r"].dataType).alias("__row"),
    )
    both = events.unionByName(starts).withColumn("__chunk", time_chunk(F.col("__at"), chunk_seconds))
    seen = running(both, ["__user"], "__chunk", ["__at", "__side", "__tie"], {"session_id": ("last", F.col("__session"))})
    matched = seen.where(F.col("__side") == 1).select("__row.*", "session_id")
    anonymous = df.where(F.col(user).isNull()).withColumn("session_id", F.lit(None).cast("string"))
    return matched.unionByName(anonymous)


def add_aliases(df: DataFrame) -> DataFrame:
    """Fill service, version and environment from their aliases, as far as those columns exist."""
    aliases = {
        "service": ("service", "serviceName"),
        "version": ("version", "serviceVersion", "app_version"),
        "environment": ("environment", "env", "stage"),
    }
    out = {}
    for name, names in aliases.items():
        present = [n for n in names if n in df.columns]
        if present:
            out[name] = first_of(*present)
    return df.withColumns(out)


def sentiment(df: DataFrame, lexicon: DataFrame, *, key: str, text: str) -> DataFrame:
    """Mean word score per record over all of its words; unknown words score 0.

    Words of one record are summed where they were split (partial aggregation), so only one row
    per record is shuffled.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    tokens = df.select(key, F.explode_outer(words).alias("word"))
    scored = tokens.join(lexicon.select("word", "score"), "word", "left")
    return scored.groupBy(key).agg(
        F.count("word").alias("words"), F.coalesce(F.sum("score") / F.nullif(F.count("word"), F.lit(0)), F.lit(0.0)).alias("sentiment")
    )
