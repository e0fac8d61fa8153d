"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each rule is a ratio of text counts. Its values are kept per language and source in a sketch: counts per
value with only the six highest bits kept, so a quantile is right to 1/32 of its value, sketches merge by
adding counts, and a sketch has at most some 1900 entries however many documents it holds. Limits follow
from the quantiles of the group: the upper limit lies ``SPREAD`` times the distance between median and
95th percentile above that percentile, the lower limit likewise below the 5th. Groups with fewer than
``MIN_DOCS`` documents use the merged sketch of their language.

Scale: text is read once and reduced to eight numbers a document. Sketches are built by aggregation with
map-side combination, so a language or source that holds a third of all rows costs 1900 rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.graph import stored
from logspark.llm.text import _SPACE, Texts, slices, texts_of, unique_in

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 100
SPREAD = 2
#: Rule: numerator, denominator, factor, least distance of a limit from the median (in units of 1 / factor).
RULES = {
    "word_length": ("word_chars", "n_words", 100, 100),
    "symbols": ("n_symbols", "n_words", 1000, 100),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 250),
    "repeats": ("n_repeat_words", "n_words", 1000, 150),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def per_text(flags: np.ndarray, texts: Texts) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[texts.offsets[1:]] - total[texts.offsets[:-1]]


def counts(texts: Texts) -> dict[str, np.ndarray]:
    """The counts of every text."""
    n = len(texts)
    letters = ~_SPACE[texts.data] & ((texts.data & 0xC0) != 0x80)
    starts, ends, owner = texts.lines
    solid = np.searchsorted(texts.starts, ends) > np.searchsorted(texts.starts, starts)
    owner = owner[solid]
    first, _, times = unique_in(owner, texts.hashes(starts[solid], ends[solid]))
    lines = np.bincount(owner, minlength=n)
    # Windows of three words; only those of texts with three words and more.
    hashes, bounds = texts.shingles(3)
    long = np.diff(texts.bounds) >= 3
    holder = np.repeat(np.arange(n), np.diff(bounds))
    at = np.flatnonzero(long[holder])
    place = texts.bounds[holder[at]] + at - bounds[holder[at]]
    order = np.lexsort((hashes[at], holder[at]))
    same = (hashes[at][order][1:] == hashes[at][order][:-1]) & (holder[at][order][1:] == holder[at][order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(texts.starts) + 4, np.int64)
    change[place[twice]] += 1
    np.subtract.at(change, place[twice] + 3, 1)
    repeated = np.cumsum(change)[: len(texts.starts)] > 0
    return {
        "n_words": np.diff(texts.bounds),
        "word_chars": per_text(letters, texts),
        "n_symbols": per_text(_SYMBOL[texts.data], texts),
        "n_dup_lines": lines - np.bincount(first, minlength=n),
        "n_repeat_words": np.bincount(texts.owner[repeated], minlength=n),
        "n_lines": lines,
    }


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            found = counts(texts_of(part.column("text")))
            kept = [part.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(found[c].astype(np.int64)) for c in COUNTS]], ["doc_id", "lang", "source", *COUNTS])


def features(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source)`` and the counts; a null text counts as empty."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return docs.mapInArrow(_features, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def value(rule: str) -> Column:
    top, bottom, factor, _ = RULES[rule]
    return F.floor(F.col(top) * factor / F.greatest(F.col(bottom), F.lit(1))).cast("bigint")


def sketches(found: DataFrame) -> DataFrame:
    """``(lang, source, rule, bucket, n)`` of the documents that pass the base rules."""
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), value(r).alias("value")) for r in RULES])
    rows = found.where(~failed()).select("lang", "source", F.inline(rules))
    return rows.selectExpr("lang", "source", "rule", "value", "greatest(length(bin(value)) - 6, 0) AS cut").selectExpr(
        "lang", "source", "rule", "shiftleft(shiftright(value, cut), cut) AS bucket"
    ).groupBy("lang", "source", "rule", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest-rank quantiles of each sketch: ``q05``, ``q50``, ``q95`` and ``docs``."""
    upto = Window.partitionBy(*keys, "rule").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "rule")
    run = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("docs", F.sum("n").over(whole))
    at = {f"q{p:02d}": F.min(F.when(F.col("upto") * 100 >= F.col("docs") * p, F.col("bucket"))) for p in (5, 50, 95)}
    return run.groupBy(*keys, "rule").agg(F.max("docs").alias("docs"), *[c.alias(n) for n, c in at.items()])


def limits(sketch: DataFrame) -> DataFrame:
    """``(lang, source, rule, low, high)``: limits of each group, from its own or its language's sketch."""
    own = quantiles(sketch, ["lang", "source"])
    merged = sketch.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    whole = quantiles(merged, ["lang"]).select(F.col("lang").alias("l"), F.col("rule").alias("r"), *[F.col(q).alias(f"l_{q}") for q in ("q05", "q50", "q95")])
    both = own.join(whole, F.expr("lang <=> l AND rule = r"))
    pick = {q: F.when(F.col("docs") >= MIN_DOCS, F.col(q)).otherwise(F.col(f"l_{q}")) for q in ("q05", "q50", "q95")}
    both = both.select("lang", "source", "rule", *[c.alias(q) for q, c in pick.items()])
    least = F.element_at(F.create_map(*[F.lit(x) for r, v in RULES.items() for x in (r, v[3])]), F.col("rule"))
    high = F.greatest(F.col("q95") + SPREAD * (F.col("q95") - F.col("q50")), F.col("q50") + least)
    low = F.least(F.col("q05") - SPREAD * (F.col("q50") - F.col("q05")), F.col("q50") - least)
    return both.select("lang", "source", "rule", low.alias("low"), high.alias("high"))


def judged(docs: DataFrame) -> DataFrame:
    """``(doc_id, counts, base_failed, kept, broken)`` per row of ``docs``; broken names the rules that failed.

    Null languages and null sources are groups of their own. Null, empty and blank texts have no word and
    fail the base rules. A null doc_id is returned as it is; repeated rows are judged alike and count each in
    the sketches. An empty table gives no row; other columns are ignored. Counts are 64 bits wide.
    """
    found = stored(features(docs), "features")
    wide = limits(sketches(found)).groupBy("lang", "source").pivot("rule", list(RULES)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    wide = wide.withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    rows = found.join(wide, F.expr("lang <=> g_lang AND source <=> g_source"), "left")
    out = [F.when((value(r) < F.col(f"{r}_low")) | (value(r) > F.col(f"{r}_high")), F.lit(r)) for r in RULES]
    rows = rows.withColumn("base_failed", failed()).withColumn("broken", F.array_compact(F.array(*out)))
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`, per language and source."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("broken")


def _sql_rule(rule: str) -> str:
    top, bottom, factor, _ = RULES[rule]
    return f"CAST(floor(CAST({top} * {factor} AS DOUBLE) / greatest({bottom}, 1)) AS BIGINT)"


def _sql_quantiles(source: str, keys: str) -> str:
    picks = ", ".join(f"min(bucket) FILTER (upto * 100 >= docs * {p}) AS q{p:02d}" for p in (5, 50, 95))
    return f"""SELECT {keys}, rule, max(docs) AS docs, {picks} FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}, rule ORDER BY bucket) AS upto,
 sum(n) OVER (PARTITION BY {keys}, rule) AS docs FROM {source}) q GROUP BY {keys}, rule"""


OP10_SQL = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w) x),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) x WHERE c > 1),
k AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM h, (VALUES (0), (1), (2)) t(j) GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(k.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM w LEFT JOIN k ON k.doc_id = w.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM c),
v AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{r}' AS rule, {_sql_rule(r)} AS value FROM b" for r in RULES)}),
s AS (SELECT lang, source, rule, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS bucket, count(*) AS n
  FROM v WHERE NOT base_failed GROUP BY ALL),
m AS (SELECT lang, rule, bucket, sum(n) AS n FROM s GROUP BY ALL),
o AS ({_sql_quantiles("s", "lang, source")}),
a AS ({_sql_quantiles("m", "lang")}),
p AS (SELECT o.lang, o.source, o.rule, CASE WHEN o.docs >= {MIN_DOCS} THEN o.q05 ELSE a.q05 END AS q05, CASE WHEN o.docs >= {MIN_DOCS} THEN o.q50 ELSE a.q50 END AS q50,
  CASE WHEN o.docs >= {MIN_DOCS} THEN o.q95 ELSE a.q95 END AS q95, CASE o.rule {" ".join(f"WHEN '{r}' THEN {x[3]}" for r, x in RULES.items())} END AS least
  FROM o JOIN a ON o.lang IS NOT DISTINCT FROM a.lang AND o.rule = a.rule),
t AS (SELECT lang, source, rule, least(q05 - {SPREAD} * (q50 - q05), q50 - least) AS low, greatest(q95 + {SPREAD} * (q95 - q50), q50 + least) AS high FROM p),
e AS (SELECT DISTINCT doc_id FROM v JOIN t ON v.lang IS NOT DISTINCT FROM t.lang AND v.source IS NOT DISTINCT FROM t.source AND v.rule = t.rule WHERE value < low OR value > high)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND e.doc_id IS NULL AS kept
FROM b LEFT JOIN e ON e.doc_id = b.doc_id"""
