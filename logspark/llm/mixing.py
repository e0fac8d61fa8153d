"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Targets: each source gets its weight's share of the wanted words; a source above ``max_epochs`` times its
size is clamped there and the excess is shared out again by weight, until none is above. Sampling: a source
of size s and target t is taken floor(t / s) times as a whole; the remaining words come from its documents in
a seeded order until they are reached, to half of the last document.

Scale: sizes are taken once and the rest works on narrow rows. The order inside a source is cut into 4096
seeded buckets, so a source with a third of all documents is 4096 window groups; bucket totals are summed
first and only they are accumulated per source. Ranks of sources come from a range partitioning with
partition counts, and each round of clamping is one aggregation, so many sources do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.graph import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Added to the documents; names that begin with __mix_ are used inside.
ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_repeats", "mix_taken"]


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked_sources(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``(source, size, weight)``: weights repeat along the sources by code point, null last."""
    totals = sizes.groupBy("source").agg(F.sum("mix_size").alias("size"))
    order = F.asc_nulls_last("source")
    # monotonically_increasing_id counts rows in its lower 33 bits.
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = totals.repartitionByRange(order).sortWithinPartitions(order)
    placed = stored(placed.select("source", "size", F.spark_partition_id().alias("part"), row.alias("row")), "sources")
    counts = placed.groupBy("part").agg(F.max("row").alias("last"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("before"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("before") + F.col("row")) % len(weights) + 1).cast("int"))
    return placed.join(counts, "part").select("source", "size", weight.cast("bigint").alias("weight"))


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """``(source, size, weight, target)``, with water-filling below ``max_epochs * size``."""
    if percent > 100 * max_epochs:
        raise ValueError("the wanted words exceed what max_epochs allow")
    sources = stored(ranked_sources(sizes, weights), "weights")
    cap = F.col("size") * max_epochs
    wanted = (sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) * percent / 100
    clamped, free, level, count = 0, sources.agg(F.coalesce(F.sum("weight"), F.lit(1))).first()[0], 0.0, -1
    level = wanted / free
    while True:
        above = cap < F.col("weight") * level
        row = sources.agg(
            F.count(F.when(above, 1)).alias("n"),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)).alias("clamped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("free"),
        ).first()
        if row.n == count or not row.free:
            break
        count, clamped, free = row.n, row.clamped, row.free
        level = (wanted - clamped) / free
    share = F.col("weight") * F.lit(float(wanted - clamped)) / F.lit(float(free))
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(share))


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    percent: int = 150,
    max_epochs: int = 2,
    seed: str = "mix",
    *,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_repeats and mix_taken (words, repeats counted).

    Columns of these names are replaced, all others stay. A null text has size 0; null sources form one
    source; a null doc_id is ordered like the text "null". Equal rows are separate documents, each drawn for
    itself. An empty table gives no row. ``sizes`` may give (source, mix_size) where it is already stored.
    """
    base = docs.drop(*ADDED)
    names = base.columns
    sized = base if sizes is not None else base.withColumn("mix_size", words_in(F.col("text")))
    if sizes is not None:
        sized = docs.select(*names, "mix_size")
    wanted = targets(sizes if sizes is not None else sized.select("source", "mix_size"), weights, percent, max_epochs)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = sized.withColumn("__mix_key", key).withColumn("__mix_bucket", F.substring("__mix_key", 1, 3))
    buckets = sized.groupBy("source", F.col("__mix_bucket").alias("__part")).agg(F.sum("mix_size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "__part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words"))
    wanted = wanted.withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0))
    wanted = wanted.withColumn("rest", F.col("target") - F.col("whole") * F.col("size"))
    plan = buckets.alias("b").join(wanted.alias("w"), F.expr("b.source <=> w.source"))
    plan = plan.selectExpr("b.source AS __mix_source", "b.__part AS __mix_part", *[f"{c} AS __mix_{c}" for c in ("words", "size", "target", "whole", "rest")])
    inside = Window.partitionBy("source", "__mix_bucket").orderBy("__mix_key", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("__mix_before", F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    rows = rows.join(plan, F.expr("source <=> __mix_source AND __mix_bucket = __mix_part"))
    middle = F.col("__mix_words") + F.col("__mix_before") + F.col("mix_size") / 2
    repeats = (F.col("__mix_whole") + F.when(middle <= F.col("__mix_rest"), 1).otherwise(0)).cast("int")
    return rows.select(
        *names,
        "mix_size",
        F.col("__mix_size").alias("mix_source_size"),
        F.col("__mix_target").alias("mix_target"),
        repeats.alias("mix_repeats"),
        (repeats * F.col("mix_size")).cast("bigint").alias("mix_taken"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: weights 5, 2, 1 by source, 150 % of all words, at most two epochs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = stored(docs.select("doc_id", "source", words_in(F.col("text")).alias("mix_size")), "sizes")
    narrow = mixed(sizes, sizes=sizes.select("source", "mix_size"))
    names = {"mix_size": "size", "mix_source_size": "source_size", "mix_target": "target", "mix_taken": "taken", "mix_repeats": "repeats"}
    return narrow.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()])


OP8_SQL = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER () * 1.5 AS total, coalesce(sum(2 * n) OVER before, 0) AS clamped, sum(w) OVER rest AS free FROM s
  WINDOW before AS (ORDER BY CAST(n AS DOUBLE) / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), rest AS (ORDER BY CAST(n AS DOUBLE) / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, 2 * n < w * (CAST(total - clamped AS DOUBLE) / free) AS above FROM o),
v AS (SELECT max(total) - coalesce(sum(2 * n) FILTER (above), 0) AS words, sum(w) FILTER (NOT above) AS free FROM f),
t AS (SELECT source, n, CASE WHEN above THEN CAST(2 * n AS DOUBLE) ELSE w * CAST(words AS DOUBLE) / CAST(v.free AS DOUBLE) END AS target FROM f, v),
r AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS whole FROM t),
x AS (SELECT doc_id, size, n AS source_size, target, whole, target - whole * n AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END AS INTEGER) AS repeats,
 CAST((whole + CASE WHEN before + size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x"""
