"""Product codes of vectors: Lloyd rounds over partition-local cover trees, in whole numbers.

Every component becomes ``floor(scale * x)``; vectors are cut into ``parts`` equal parts. Tasks pack their vectors
into chunks; a chunk has one cover tree for each part position over its distinct parts. A node covers a
stretch of the points in tree order: it knows its centre, its radius, and through cumulative counts and sums what any
stretch adds up to. Children stand more than half the parent's radius apart and cover their points within it.

A round assigns whole subtrees: with the nearest entry at distance d from a node's centre and radius r, only entries
within ``d + 2r`` can be nearest (or tie) for a point below. One entry left: the whole stretch goes there by two
reads of the cumulative sums. Several: the children are asked, with those entries only, and points of a leaf are
compared exactly, ties to the lower index. Floating point only widens the bound, so the result is that of plain Lloyd.

Results for odd input: vectors that are null, or hold a null or non-finite component, are left out, as are vectors
whose length differs from that of the smallest kept id or isn't a multiple of ``parts``. Repeated rows and ties are
ordinary rows; the starting entries are the smallest ids, ties by vector, null ids last; with fewer rows there are
fewer entries. Null labels form one group. An empty table gives no row. Other columns are ignored. A scaled
component beyond 2**24 is an error, as squared distances would leave the range of 64-bit numbers.

Scale: trees are built once and written; a round reads them and sends at most parts * entries * (width + 1) numbers
a task, which are added up before one small table reaches the driver (the codebooks). No vector is shuffled.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm.graph import stored

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CHUNK = 4096
LEAF = 12
LARGEST = 1 << 24
#: Labels that are sent to every task; more are joined by shuffle.
BROADCAST_LABELS = 50_000


def finite(vec: Column) -> Column:
    """Not null, and no component is null, infinite or not a number."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


@dataclass
class Tree:
    """Distinct points in tree order, and nodes in breadth-first order."""

    points: np.ndarray
    weight: np.ndarray  # vectors of each point
    slot: np.ndarray  # place of each vector's point
    centre: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    child: np.ndarray  # first child, or -1 for a leaf
    children: np.ndarray

    def __post_init__(self) -> None:
        self.points = self.points.astype(np.int64)
        self.counts = np.r_[0, np.cumsum(self.weight, dtype=np.int64)]
        self.sums = np.zeros((len(self.points) + 1, self.points.shape[1]), np.int64)
        np.cumsum(self.points * self.weight[:, None], axis=0, out=self.sums[1:])


FIELDS = ("points", "weight", "slot", "centre", "lo", "hi", "radius", "child", "children")


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def build(vectors: np.ndarray) -> Tree:
    points, slot, weight = np.unique(vectors, axis=0, return_inverse=True, return_counts=True)
    slot = slot.reshape(-1)
    n = len(points)
    order = np.arange(n)
    middle = int(np.argmin(squared(points, np.floor(points.mean(axis=0)).astype(np.int64))))
    nodes = [[middle, 0, n, 0.0, -1, 0]]
    at = 0
    while at < len(nodes):
        centre, lo, hi = nodes[at][:3]
        own = order[lo:hi].copy()
        far = squared(points[own], points[centre])
        radius2 = int(far.max())
        nodes[at][3] = float(np.sqrt(radius2)) * (1 + 1e-12)
        if hi - lo > LEAF:
            nodes[at][4] = len(nodes)
            begin, pick = lo, centre
            while len(own):
                # A child covers what lies within half the radius and isn't covered yet.
                near = 4 * squared(points[own], points[pick]) <= radius2
                taken = own[near]
                order[begin : begin + len(taken)] = taken
                nodes.append([pick, begin, begin + len(taken), 0.0, -1, 0])
                begin += len(taken)
                own, far = own[~near], far[~near]
                if len(own):
                    pick = int(own[far.argmax()])
            nodes[at][5] = len(nodes) - nodes[at][4]
        at += 1
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    points, weight = points[order], weight[order]
    centre, lo, hi, radius, child, children = (np.array(c) for c in zip(*nodes))
    return Tree(points, weight, place[slot], place[centre], lo, hi, radius, child, children)


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    size = hi - lo
    return np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def assign(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Stretches ``(lo, hi, entry)`` that cover all points, and how many points were compared one by one."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
    compared = 0
    while len(nodes):
        d = np.sqrt(squared(tree.points[tree.centre[nodes]][:, None], book[None]).astype(float))
        d[~open_] = np.inf
        limit = d.min(axis=1) + 2 * tree.radius[nodes]
        open_ = d <= (limit * (1 + 1e-9) + 1e-9)[:, None]
        sure = open_.sum(axis=1) == 1
        found.append((tree.lo[nodes[sure]], tree.hi[nodes[sure]], open_[sure].argmax(axis=1)))
        nodes, open_ = nodes[~sure], open_[~sure]
        leaf = tree.child[nodes] < 0
        last = nodes[leaf]
        if len(last):
            at = ranges(tree.lo[last], tree.hi[last])
            exact = squared(tree.points[at][:, None], book[None])
            exact[~np.repeat(open_[leaf], tree.hi[last] - tree.lo[last], axis=0)] = np.iinfo(np.int64).max
            found.append((at, at + 1, exact.argmin(axis=1)))
            compared += len(at)
        nodes, open_ = nodes[~leaf], open_[~leaf]
        size = tree.children[nodes]
        open_ = np.repeat(open_, size, axis=0)
        nodes = ranges(tree.child[nodes], tree.child[nodes] + size)
    return (*(np.concatenate(c) for c in zip(*found)), compared)


def pack(trees: list[Tree]) -> bytes:
    """Whole numbers as 32-bit values; cumulative sums are made again on reading."""
    out = io.BytesIO()
    held = {f"{name}{i}": getattr(t, name) for i, t in enumerate(trees) for name in FIELDS}
    np.savez(out, **{k: v if v.dtype.kind == "f" else v.astype(np.int32) for k, v in held.items()})
    return out.getvalue()


def unpack(raw: bytes, parts: int) -> list[Tree]:
    with np.load(io.BytesIO(raw)) as held:
        return [Tree(*(held[f"{name}{i}"] for name in FIELDS)) for i in range(parts)]


def chunks(rows: DataFrame, parts: int) -> DataFrame:
    """``(ids, labels, trees)`` per chunk of the rows ``(vec_id, label, vec)``, stored."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            n = len(table)
            vectors = table["vec"].combine_chunks().flatten().to_numpy().reshape(n, -1)
            if np.abs(vectors).max() > LARGEST:
                raise ValueError(f"a scaled component is larger than {LARGEST}")
            trees = [build(np.ascontiguousarray(part)) for part in np.split(vectors, parts, axis=1)]
            one = pa.array([0, n], pa.int32())
            lists = [pa.ListArray.from_arrays(one, table[c].combine_chunks()) for c in ("vec_id", "label")]
            held.clear()
            return pa.RecordBatch.from_arrays([*lists, pa.array([pack(trees)], pa.binary())], ["ids", "labels", "trees"])

        for batch in batches:
            while batch.num_rows:
                take = batch.slice(0, CHUNK - sum(b.num_rows for b in held))
                held.append(take)
                batch = batch.slice(take.num_rows)
                if sum(b.num_rows for b in held) == CHUNK:
                    yield made()
        if held:
            yield made()

    return stored(rows.mapInArrow(run, f"ids array<bigint>, labels array<{label}>, trees binary"), "vector-trees")


def totals(trees: DataFrame, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts and sums by entry of each part position; what reaches the driver has the size of the codebooks."""
    parts, width = len(books), books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, len(books[0]), width + 1), np.int64)
        for batch in batches:
            for raw in batch.column("trees"):
                for p, tree in enumerate(unpack(raw.as_py(), parts)):
                    lo, hi, entry, _ = assign(tree, books[p])
                    np.add.at(total[p, :, 0], entry, tree.counts[hi] - tree.counts[lo])
                    np.add.at(total[p, :, 1:], entry, tree.sums[hi] - tree.sums[lo])
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total.reshape(-1)[key])], ["key", "n"])

    out = np.zeros(parts * len(books[0]) * (width + 1), np.int64)
    for r in trees.select("trees").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r.key] = r.n
    out = out.reshape(parts, len(books[0]), width + 1)
    return [(t[:, 0], t[:, 1:]) for t in out]


def moved(book: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; unused entries stay."""
    used = counts > 0
    out = book.copy()
    out[used] = sums[used] // counts[used, None]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.reshape(-1).tolist()).encode()).hexdigest()


def coded(trees: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    """``(vec_id, label, code, error)`` per vector."""
    hexes = np.array([f"{k:02x}" for k in range(len(books[0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                code, error = None, 0
                for p, tree in enumerate(unpack(row.column("trees")[0].as_py(), len(books))):
                    lo, hi, entry, _ = assign(tree, books[p])
                    of = np.empty(len(tree.points), np.int64)
                    of[ranges(lo, hi)] = np.repeat(entry, hi - lo)
                    off = squared(tree.points, books[p][of])
                    digits = hexes[of[tree.slot]]
                    code = digits if code is None else np.char.add(code, digits)
                    error = error + off[tree.slot]
                yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), row.column("labels").flatten(), pa.array(code), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return trees.mapInArrow(run, f"vec_id bigint, label {label}, code string, error bigint")


def vector_codes(
    vectors: DataFrame, *, vec: str = "embedding", id_col: str = "vec_id", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` per kept vector; see the module for odd input."""
    kept = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    kept = kept.where(finite(F.col("vec"))).where((F.size("vec") > 0) & (F.size("vec") % parts == 0)).withColumn("vec", whole(F.col("vec"), scale))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vec").asc()]
    kind = kept.schema["label"].dataType.simpleString()
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256")).limit(0)
    kept = kept.where(F.size("vec") == len(first[0].vec))
    start = np.array([r.vec for r in kept.orderBy(*order).limit(entries).select("vec").collect()], np.int64)
    books = np.split(start, parts, axis=1)
    trees = chunks(kept, parts)
    for _ in range(rounds):
        books = [moved(book, *total) for book, total in zip(books, totals(trees, books))]
    rows = stored(coded(trees, books, kind), "vector-codes")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    if by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `embeddings`."""
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _round(r: int) -> str:
    return f"""
a{r} AS MATERIALIZED (SELECT vec_id, p.part, p.xs, first(k.entry ORDER BY p.n - 2 * list_dot_product(p.xs, k.xs) + list_dot_product(k.xs, k.xs), k.entry) AS entry,
  min(p.n - 2 * list_dot_product(p.xs, k.xs) + list_dot_product(k.xs, k.xs)) AS d FROM p JOIN k{r} k ON p.part = k.part GROUP BY ALL),
m{r} AS (SELECT part, entry, j, floor(sum(x) / count(*)) AS x FROM (SELECT part, entry, unnest(xs) AS x, generate_subscripts(xs, 1) AS j FROM a{r}) GROUP BY ALL),
k{r + 1} AS MATERIALIZED (SELECT k.part, k.entry, coalesce(n.xs, k.xs) AS xs FROM k{r} k LEFT JOIN (SELECT part, entry, list(x ORDER BY j) AS xs FROM m{r} GROUP BY ALL) n USING (part, entry)),"""


OP12_SQL = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT *, (len(e) / {PARTS})::BIGINT AS w FROM v),
q AS (SELECT vec_id, part, list_slice(e, part * w + 1, (part + 1) * w)::DOUBLE[] AS xs FROM w, (SELECT unnest(range({PARTS})) AS part)),
p AS MATERIALIZED (SELECT *, list_dot_product(xs, xs) AS n FROM q),
k0 AS MATERIALIZED (SELECT part, rank AS entry, xs FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM v ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{"".join(_round(r) for r in range(ROUNDS + 1))}
d AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1),
s AS (SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, j)) AS h FROM (SELECT part, entry, unnest(xs) AS x, generate_subscripts(xs, 1) AS j FROM k{ROUNDS}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM d JOIN v USING (vec_id), s"""
