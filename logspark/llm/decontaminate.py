"""Benchmark decontamination by size-partitioned MinHash containment search.

Method (after LSH Ensemble, Zhu et al. 2016): test items are partitioned by their number of shingles into
classes with upper bounds 4, 8, 16 ... A class of bound U searches document windows of 2U shingles that
overlap by U, so a passage as long as an item lies whole in one window. In a class the containment
threshold t turns into a Jaccard threshold of at least t * s / (s + 2U - t * s) with U / 2 < s <= U, that is
0.19 for t = 0.8, and one equal minimum among ``HASHES`` makes a candidate: a window at that threshold is
missed with probability 1.4e-6. That needs s different shingles in the item. An item that repeats shingles is
searched exactly besides: of its d different ones a text must hold ceil(t * d), so any d - ceil(t * d) + 1 of
them include one that the text has, and texts that hold one of these are candidates. Candidates are verified by
exact containment of the item's distinct shingles in the whole document.

Scale: one pass over the documents without a shuffle. Minima are taken once, over the smallest windows, and
merged in pairs for the larger ones. The items are a stated query set and handled in blocks of at most
``BLOCK_ITEMS``; only one block's shingles are sent to the tasks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.text import U64, constants, minima, slices, texts_of, unique_in

HASHES = 64
SHINGLE = 5
PERCENT = 80
SMALLEST = 4
BLOCK_ITEMS = 20_000
FILTER_BITS = 20


class Items:
    """Shingles and size classes of one block of test items."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        hashes, bounds = texts_of(pa.array(texts, pa.string()), lower=True).shingles(SHINGLE)
        lengths = np.diff(bounds)
        seeds = constants(HASHES, 5)
        self.ids = np.array(ids, np.int64)
        owner, self.hashes, _ = unique_in(np.repeat(np.arange(len(ids)), lengths), hashes)
        self.bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
        self.sizes = np.diff(self.bounds)
        signature = np.stack([minima((self.hashes ^ s) * s, self.bounds) for s in seeds], axis=1)
        limit = np.full(len(ids), SMALLEST)
        while (limit < lengths).any():
            limit[limit < lengths] *= 2
        self.classes: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for bound in sorted(set(limit[self.sizes > 0].tolist())):
            own = np.flatnonzero((limit == bound) & (self.sizes > 0))
            values = signature[own].ravel()
            order = np.argsort(values)
            present = np.zeros(1 << FILTER_BITS, bool)
            present[values >> U64(64 - FILTER_BITS)] = True
            self.classes.append((bound, values[order], np.repeat(own, HASHES)[order], present))
        self.repeated = self.indexed(np.flatnonzero((self.sizes > 0) & (self.sizes < lengths)))

    def indexed(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of which a text that holds one of these items has one at least: all but the share that may lack."""
        needed = -(-PERCENT * self.sizes[own] // 100)
        first = self.sizes[own] - needed + 1
        at = np.repeat(self.bounds[own] - np.r_[0, np.cumsum(first)[:-1]], first) + np.arange(first.sum()) if len(own) else np.zeros(0, np.int64)
        order = np.argsort(self.hashes[at], kind="stable")
        present = np.zeros(1 << FILTER_BITS, bool)
        present[self.hashes[at] >> U64(64 - FILTER_BITS)] = True
        return self.hashes[at][order], np.repeat(own, first)[order], present

    def __len__(self) -> int:
        return len(self.ids)


def merged(blocks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of each two neighbouring blocks of a text, not overlapping."""
    counts = (np.diff(bounds) + 1) // 2
    wider = np.r_[0, np.cumsum(counts)]
    owner = np.repeat(np.arange(len(counts)), counts)
    first = bounds[owner] + 2 * (np.arange(wider[-1]) - wider[owner])
    return (np.minimum.reduceat(blocks, first, axis=0) if len(first) else blocks[:0]), wider


def candidates(hashes: np.ndarray, bounds: np.ndarray, items: Items) -> np.ndarray:
    """Rows (text, item) that share a minimum in some window."""
    found = [np.zeros((0, 2), np.int64)]
    if not items.classes or not len(hashes):
        return found[0]
    size = items.classes[0][0]
    counts = -(-np.diff(bounds) // size)
    limits = np.r_[0, np.cumsum(counts)]
    owner = np.repeat(np.arange(len(counts)), counts)
    first = bounds[owner] + size * (np.arange(limits[-1]) - limits[owner])
    blocks = np.stack([np.minimum.reduceat((hashes ^ s) * s, first) for s in constants(HASHES, 5)], axis=1)
    for bound, values, holders, present in items.classes:
        while size < bound:
            blocks, limits = merged(blocks, limits)
            size *= 2
        windows = blocks.copy()
        owner = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        windows[inner] = np.minimum(blocks[inner], blocks[inner + 1])
        row, col = np.nonzero(present[windows >> U64(64 - FILTER_BITS)])
        seen = windows[row, col]
        low, high = np.searchsorted(values, seen, "left"), np.searchsorted(values, seen, "right")
        times = high - low
        text = np.repeat(owner[row], times)
        at = np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        found.append(np.stack([text, holders[at]], axis=1))
    values, holders, present = items.repeated
    if len(values):
        place = np.flatnonzero(present[hashes >> U64(64 - FILTER_BITS)])
        low, high = np.searchsorted(values, hashes[place], "left"), np.searchsorted(values, hashes[place], "right")
        times = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        text = np.searchsorted(bounds, place, side="right") - 1
        found.append(np.stack([np.repeat(text, times), holders[at]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def shared(texts: pa.Array, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, common shingles) of every pair with enough containment."""
    hashes, bounds = texts_of(texts, lower=True).shingles(SHINGLE)
    pairs = candidates(hashes, bounds, items)
    common = np.zeros(len(pairs), np.int64)
    held, last = None, -1
    for k, (text, item) in enumerate(pairs):
        if text != last:
            held, last = np.unique(hashes[bounds[text] : bounds[text + 1]]), text
        own = items.hashes[items.bounds[item] : items.bounds[item + 1]]
        at = np.minimum(np.searchsorted(held, own), len(held) - 1)
        common[k] = np.count_nonzero(held[at] == own)
    enough = 100 * common >= PERCENT * items.sizes[pairs[:, 1]]
    return pairs[enough, 0], pairs[enough, 1], common[enough]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """The items in blocks; null texts and texts without words have no shingle and match nothing."""
    items = benchmark.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    items = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    parts = -(-items.count() // BLOCK_ITEMS)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        yield Items([r.item_id for r in rows], [r.text for r in rows])


def matches(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_item, containment)`` per document and item with containment >= 0.8.

    Shingles are five words, A-Z lower-cased, and distinct. An item with fewer words is one shingle, so it
    matches only a text of just these words. Null, empty or blank texts match nothing; a null doc_id is
    returned as it is, an item with a null id is left out; repeated documents or items give repeated rows.
    Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint, containment double"
    out = spark.createDataFrame([], schema)
    for items in blocks_of(benchmark, item_col, item_text):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for part in slices(batch):
                    text, item, common = shared(part.column("text"), items)
                    sizes = items.sizes[item]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(pa.array(text)), pa.array(items.ids[item]), pa.array(common), pa.array(sizes), pa.array(common / sizes)],
                        ["doc_id", "item_id", "n_shared", "n_item", "containment"],
                    )

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of ``benchmark``; rows with a null text stay."""
    for items in blocks_of(benchmark, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    clean = np.ones(part.num_rows, bool)
                    clean[shared(part.column("text"), sent.value)[0]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` against whole `benchmark`."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SHINGLES = """SELECT DISTINCT {id}, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM (
 SELECT {id}, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})"""

OP5_SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
p AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN b ON d.g = b.g GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM p JOIN n USING (item_id) WHERE 100 * n_shared >= 80 * n_item"""
