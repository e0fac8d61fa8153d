"""Near-duplicate documents: b-bit MinHash candidates, exact confirmation, connected groups.

Method (Li and Koenig, "b-bit minwise hashing"): each document keeps the low ``BITS`` bits of its
``HASHES`` minima, packed into words. Full minima are used once, for the band keys. Documents that share
a band are candidates; their similarity is estimated from the number of equal b-bit values, corrected for
accidental equality, and whatever can reach the threshold is confirmed on the full shingle sets.

Scale: exact copies of a set collapse to one representative before banding, so a group of copies costs one
row. Bands become star links to the smallest member, never all pairs, and each set comes down to one row of
such links. Sets are confirmed against the centre they share most bands with first, in chunks of bounded
weight. Only candidate groups that are not connected by then are dealt into blocks; a task sees two blocks,
compares what is not connected yet with vector operations and returns only links that join two trees, at
most one per member. No candidate is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.graph import components, stored
from logspark.llm.text import U64, binary_rows, constants, minima, mix, signed, slices, texts_of, unique_in

HASHES = 128
ROWS = 4
BITS = 2
#: A pair is confirmed on its sets when the estimate is no more than this below the threshold: six deviations.
SLACK = 0.24
BLOCK_DOCS = 256
BLOCK_SHINGLES = 400_000


def similarity(equal: np.ndarray) -> np.ndarray:
    """Jaccard estimate from the share of equal b-bit values: J = (share - C) / (1 - C), C = 2**-BITS."""
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def packed(low: np.ndarray) -> np.ndarray:
    """Rows of BITS-wide values packed into 64-bit words."""
    per = 64 // BITS
    shifts = np.arange(per, dtype=U64) * U64(BITS)
    return (low.reshape(len(low), -1, per) << shifts).sum(axis=2, dtype=U64)


def equal_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many b-bit values agree, for packed rows."""
    differ = a ^ b
    for step in range(1, BITS):
        differ = differ | ((a ^ b) >> U64(step))
    ones = U64(sum(1 << i for i in range(0, 64, BITS)))
    return HASHES - np.bitwise_count(differ & ones).sum(axis=-1, dtype=np.int64)


def signatures(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    seeds = constants(HASHES, 9)
    keep = U64((1 << BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column("text"), lower=True)
                hashes, bounds = texts.shingles(n)
                owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
                owner, hashes, _ = unique_in(owner, hashes)
                bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
                sizes = np.diff(bounds)
                total = np.zeros((2, len(hashes) + 1), U64)
                np.cumsum(hashes, out=total[0, 1:])
                np.cumsum(mix(hashes ^ seeds[0]), out=total[1, 1:])
                digest = total[:, bounds[1:]] - total[:, bounds[:-1]]
                low = np.empty((len(texts), HASHES), U64)
                bands = np.zeros((len(texts), HASHES // ROWS), U64)
                for j in range(HASHES):
                    least = minima((hashes ^ seeds[j]) * seeds[j], bounds)
                    low[:, j] = mix(least) & keep
                    bands[:, j // ROWS] = mix(bands[:, j // ROWS] ^ least) + U64(j)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("mark"), pa.array(sizes), signed(digest[0]), signed(digest[1]), binary_rows(bands), binary_rows(packed(low))],
                    ["doc_id", "mark", "n_shingles", "d1", "d2", "bands", "packed"],
                )

    return run


def band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per band of each representative."""
    for batch in batches:
        width = HASHES // ROWS
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        ids = np.repeat(batch.column("rep").to_numpy(), width)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["band", "rep"])


class Forest:
    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def confirm(n: int, percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links of the sets of one task; only such as connect two trees that are not connected yet."""
    cut = percent / 100 - SLACK

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        words = np.frombuffer(b"".join(table.column("packed").to_pylist()), U64).reshape(len(ids), -1)
        texts = texts_of(table.column("text").combine_chunks(), lower=True)
        hashes, bounds = texts.shingles(n)
        owner, hashes, _ = unique_in(np.repeat(np.arange(len(ids)), np.diff(bounds)), hashes)
        bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
        sizes = np.diff(bounds)
        _, number = np.unique(hashes, return_inverse=True)
        mark = np.zeros(len(hashes) + 1, bool)
        trees, links = Forest(len(ids)), []
        _, first, known = np.unique(table.column("tree").to_numpy(), return_index=True, return_inverse=True)
        for i, j in enumerate(first[known]):
            trees.join(i, int(j))
        for i in range(len(ids) - 1):
            likely = np.flatnonzero(similarity(equal_values(words[i + 1 :], words[i])) >= cut) + i + 1
            fits = 100 * np.minimum(sizes[i], sizes[likely]) >= percent * np.maximum(sizes[i], sizes[likely])
            root = trees.find(i)
            likely = [j for j in likely[fits] if trees.find(j) != root]
            if not likely:
                continue
            own = number[bounds[i] : bounds[i + 1]]
            mark[own] = True
            for j in likely:
                common = int(np.count_nonzero(mark[number[bounds[j] : bounds[j + 1]]]))
                if 100 * common >= percent * (sizes[i] + sizes[j] - common) and trees.join(i, j):
                    links.append((ids[i], ids[j]))
            mark[own] = False
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    return run


def groups(docs: DataFrame, n: int = 5, percent: int = 80, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their distinct ``n``-word shingles
    (A-Z lower-cased). A text with fewer words is one shingle; null, empty and blank texts have no shingle
    and are linked with nothing. Rows of one id are one document: they share its result, and different texts
    of an id link whatever is like any of them (``n_shingles`` is the row's own). A row with a null id is linked
    with nothing: its component is null and it is kept. Other columns are ignored; an empty table gives no
    row. ``percent`` from 80 on: the bands find a pair at 0.8 with probability 1 - 5e-8.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("mark", F.xxhash64("text"))
    schema = "doc_id bigint, mark bigint, n_shingles bigint, d1 bigint, d2 bigint, bands binary, packed binary"
    marked = stored(docs.mapInArrow(signatures(n), schema), "signatures")
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    sets = ["n_shingles", "d1", "d2"]
    least = F.min(F.struct("doc_id", "mark")).alias("least")
    reps = marked.where(usable).groupBy(*sets).agg(least, F.first("bands").alias("bands"), F.first("packed").alias("packed"))
    reps = stored(reps.select(*sets, F.col("least.doc_id").alias("rep"), "least.mark", "bands", "packed"), "representatives")
    stars = stored(_stars(reps), "stars")
    joined = F.explode(F.array_union("lows", F.array("rep"))).alias("a")
    candidates = stored(components(stars.select(joined, F.col("low").alias("b"))), "candidates")
    texts = stored(_texts(docs, reps.join(candidates, reps["rep"] == candidates["id"])), "texts")
    near = stored(_near_centres(texts, stars, n, percent), "near")
    links = near.union(stored(_between(texts, components(near), n, percent), "between")).union(_same_ids(marked.where(usable), reps))
    found = components(links).select(F.col("id").alias("rep"), "root")
    classes = reps.join(found, "rep", "left").select(*sets, F.coalesce("root", "rep").alias("component_id"))
    own = F.when(usable, F.col("component_id")).otherwise(F.col("doc_id"))
    return marked.join(classes, sets, "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept")
    )


def _stars(reps: DataFrame) -> DataFrame:
    """``(rep, centre, low, lows)``: the smallest members of a set's bands, at most one per band, and the one met most."""
    bands = reps.select("rep", "bands").mapInArrow(band_keys, "band bigint, rep bigint")
    shared = bands.groupBy("band").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = bands.join(shared, "band").where("rep <> low").groupBy("rep", "low").agg(F.count(F.lit(1)).alias("n"))
    most = F.max_by("low", F.struct("n", -F.col("low"))).alias("centre")
    return met.groupBy("rep").agg(most, F.min("low").alias("least"), F.collect_list("low").alias("lows")).withColumnRenamed("least", "low")


def _texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One text for each candidate set."""
    members = members.select("rep", F.col("mark").alias("own"), "root", "n_shingles", "packed")
    once = docs.join(members, (docs["doc_id"] == members["rep"]) & (docs["mark"] == members["own"]))
    first = Window.partitionBy("rep", "own").orderBy("text")
    once = once.withColumn("turn", F.row_number().over(first)).where("turn = 1")
    return once.select("rep", "root", "n_shingles", "packed", "text")


def _parts() -> Column:
    return F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("w") / BLOCK_SHINGLES)).cast("int").alias("parts")


def _near_centres(texts: DataFrame, stars: DataFrame, n: int, percent: int) -> DataFrame:
    """Links found between each centre and the sets around it, which are cut into chunks."""
    around = stars.select("rep", "centre").join(texts.select("rep", "n_shingles"), "rep")
    weight = around.groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    weight = weight.select("centre", _parts())
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")
    members = around.select("rep", "centre").distinct().join(weight, "centre").select("rep", "centre", part)
    parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    centres = weight.select(F.col("centre").alias("rep"), "centre", parts)
    dealt = members.union(centres).join(texts, "rep").select("rep", F.col("rep").alias("tree"), "centre", "part", "packed", "text")
    return dealt.groupBy("centre", "part").applyInArrow(confirm(n, percent), "a bigint, b bigint")


def _between(texts: DataFrame, trees: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between the trees of a candidate group: its blocks meet each other. Connected groups are done."""
    trees = trees.select(F.col("id").alias("rep"), F.col("root").alias("tree"))
    members = texts.select("rep", "root", "n_shingles").join(trees, "rep", "left").withColumn("tree", F.coalesce("tree", "rep"))
    weight = members.groupBy("root").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"), F.min("tree").alias("low"), F.max("tree").alias("high")
    )
    open_groups = weight.where("low < high").select("root", _parts())
    members = members.select("rep", "root", "tree").distinct().join(open_groups, "root")
    block = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = members.withColumn("block", block).select("rep", "root", "tree", "block", other)
    dealt = dealt.select("rep", "root", "tree", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    dealt = dealt.join(texts.drop("root", "n_shingles"), "rep")
    return dealt.groupBy("root", "low", "high").applyInArrow(confirm(n, percent), "a bigint, b bigint")


def _same_ids(marked: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the representatives of different sets of one id."""
    own = F.struct("n_shingles", "d1", "d2")
    several = marked.groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low < high").select("doc_id")
    rows = marked.join(several, "doc_id").select("doc_id", "n_shingles", "d1", "d2").distinct()
    rows = rows.join(reps.select("rep", "n_shingles", "d1", "d2"), ["n_shingles", "d1", "d2"])
    return rows.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each group, the one with the smallest id.

    Rows of an id with the same text come down to one; different texts of a kept id stay, as do rows with a
    null id. All columns are kept as they are.
    """
    keep = groups(docs, n, percent).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    order = Window.partitionBy("doc_id", "text").orderBy("text", *[F.col(c) for c in docs.columns if c not in ("doc_id", "text")])
    ranked = docs.where("doc_id IS NOT NULL").withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
    single = ranked.join(keep, ranked["doc_id"] == keep["__id"], "left_semi")
    return single.unionByName(docs.where("doc_id IS NULL"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`: 3-word shingles, similarity 0.85."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=85)


OP9_SQL = """
WITH RECURSIVE w AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT e.b, r.o FROM r JOIN e ON e.a = r.doc_id),
c AS (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
