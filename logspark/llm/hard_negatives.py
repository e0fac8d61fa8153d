"""Hard negatives of anchors by shared candidate lists, sorted once per anchor cluster.

Scores are inner products of whole vectors ``floor(scale * x)``; higher first, ties by the smaller id. Of every
anchor the ``positives`` best other rows of its label are taken, and for each of them the ``negatives`` best rows of
other labels whose score lies between ``least`` percent of the positive's score and that score.

Method: anchors are clustered by angle (centroids fitted on at most ``FIT_ANCHORS`` anchors). Candidates lie in chunks
of up to ``CHUNK`` rows. For a cluster the rows of a chunk are sorted once by an upper bound of their score,
``|x| cos(max(0, angle to the centroid - widest angle of the members))``; every member walks that list in steps and stops when the
bound of the next row, times the member's length, is below what it still looks for. Walks come in two rounds:
the first looks at the first ``HEAD`` rows of each list only; the scores found there, over all chunks, are
certain lower limits, with which the second round ends most walks early. Floating point only widens
bounds; scores are exact.

Results for odd input: rows with a null id or label, a null vector or a null or non-finite component take no part, nor do
rows whose length differs from the most frequent one (the smaller of several). Of rows that share an id the
smallest by label and vector takes part. An anchor without positives, or a positive without negatives, gives no
row. A vector of zeros scores 0 with all. An empty table gives no row; other columns are ignored. Scaled components so
large that scores could pass 2**53 are an error, because scores must stay exact.

Scale: chunks and blocks of at most some ``BLOCK`` anchors of one cluster are rows. Chunks are dealt to at most ``SHARDS`` shards
and blocks to groups of some ``GROUP``; a task reads the blocks of a group, then the chunks of a shard one by one, so
a block is sent once to each shard, a chunk once to each group, and never once for each pair. What an anchor has found carries over
from chunk to chunk of a shard, ends later walks, and leaves the task as the best ``k`` only. No vector reaches the driver but those of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.graph import stored
from logspark.llm.vector_codes import finite, whole

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST = 80
CLUSTERS = 16
FIT_ANCHORS = 4096
FIT_ROUNDS = 8
CHUNK = 4096
BLOCK = 1024
HEAD = 256
STEP = 256
SHARDS = 64
GROUP = 128
SLACK = 1e-6
#: Limits of what an unbounded search looks for; scores lie far within.
LOWEST, HIGHEST = -(1 << 60), 1 << 60
WANTS = "array<struct<j:int,low:bigint,high:bigint>>"


def rows_of(vectors: DataFrame, vec: str, id_col: str, label: str, scale: int) -> DataFrame:
    """``(id, label, x)``: one row per id, whole components."""
    kept = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vec).alias("x"))
    kept = kept.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("x"))).withColumn("x", whole(F.col("x"), scale))
    usual = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    kept = kept.where(F.size("x") == (usual[0].n if usual else 0))
    return kept.groupBy("id").agg(F.min(F.struct("label", "x")).alias("row")).select("id", "row.*")


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in 16 or 32 bits."""
    return x.astype("<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i4").tobytes()


def unpacked(load: pa.Buffer | bytes, rows: int, width: int) -> np.ndarray:
    """The vectors of ``packed`` in floating point."""
    size = len(memoryview(load)) // max(rows * width, 1)
    return np.frombuffer(load, "<i2" if size == 2 else "<i4").reshape(rows, width).astype(float)


def chunks(rows: DataFrame) -> DataFrame:
    """``(chunk, ids, labels, x)``: up to CHUNK rows with their vectors as one binary value."""
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = table["x"].combine_chunks().flatten().to_numpy()
            if len(x) and float(np.abs(x).max()) ** 2 * (len(x) // len(table)) >= 2**53:
                raise ValueError("scaled components are too large for exact scores")
            ends = pa.array([0, len(table)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, table[c].combine_chunks()) for c in ("id", "label")]
            held.clear()
            return pa.RecordBatch.from_arrays([*lists, pa.array([packed(x)], pa.binary())], ["ids", "labels", "x"])

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, CHUNK - sum(b.num_rows for b in held)))
                batch = batch.slice(held[-1].num_rows)
                if sum(b.num_rows for b in held) == CHUNK:
                    yield made()
        if held:
            yield made()

    made_ = rows.mapInArrow(run, f"ids array<bigint>, labels array<{label}>, x binary")
    return stored(made_.withColumn("chunk", F.monotonically_increasing_id()), "candidate-chunks")


def centroids(anchors: DataFrame) -> np.ndarray:
    """Unit vectors fitted by spherical k-means on a bounded sample, the anchors with the smallest hash of the id."""
    ids = anchors.select("id").orderBy(F.xxhash64("id"), "id").limit(FIT_ANCHORS)  # tasks send their smallest ids, not vectors
    sample = anchors.join(F.broadcast(ids), "id").select("x").collect()
    x = np.array([r.x for r in sample], float)
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    centre = np.unique(x, axis=0)
    centre = centre[np.linspace(0, len(centre) - 1, min(CLUSTERS, len(centre))).astype(int)]
    for _ in range(FIT_ROUNDS):
        near = (x @ centre.T).argmax(axis=1)
        for k in range(len(centre)):
            mean = x[near == k].sum(axis=0)
            if (size := np.linalg.norm(mean)) > 1e-12:
                centre[k] = mean / size
    return centre


def clustered(anchors: DataFrame, centre: np.ndarray) -> DataFrame:
    """Anchors with their cluster and the number of its block."""
    sent = anchors.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, centre.shape[1]))
            yield batch.append_column("cluster", pa.array((x @ sent.value.T).argmax(axis=1), pa.int32()))

    label = anchors.schema["label"].dataType.simpleString()
    near = anchors.mapInArrow(run, f"id bigint, label {label}, x array<bigint>, cluster int")
    size = near.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__blocks"))  # a row a cluster
    return near.join(F.broadcast(size), "cluster").withColumn("block", F.pmod(F.xxhash64("id"), "__blocks")).drop("__blocks")


class List:
    """The rows of a chunk, sorted once by their bound for the members of one cluster."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, members: np.ndarray) -> None:
        # Any direction gives a right bound; the members' mean is near to all of them.
        self.long = np.linalg.norm(members, axis=1)
        unit = members / np.maximum(self.long, 1e-300)[:, None]
        centre = unit.sum(axis=0)
        centre /= max(np.linalg.norm(centre), 1e-300)
        widest = np.arccos(np.clip(unit[self.long > 0] @ centre, -1, 1)).max(initial=0.0) + SLACK
        size = np.linalg.norm(x, axis=1)
        angle = np.arccos(np.clip(x @ centre / np.maximum(size, 1e-300), -1, 1))
        bound = size * (np.cos(np.maximum(angle - widest, 0)) + SLACK)
        order = np.argsort(-bound, kind="stable")
        self.bound, self.x, self.ids, self.labels = bound[order], x[order], ids[order], labels[order]

    def reach(self, at: int) -> np.ndarray:
        """Upper limit of each member's scores from place ``at`` on."""
        return self.long * self.bound[at] + SLACK


@dataclass
class Wants:
    """What the members of a block look for: the first ``k`` rows with scores in [low, high], of the same label or of others."""

    member: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int
    computed: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        """What was found on the lists so far, and the score and id of the k-th of each want."""
        self.limit, self.tie = self.low.astype(float), np.full(len(self.low), np.iinfo(np.int64).max)
        self.found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def walk(self, rows: List, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places among the wants, scores and ids found on the list before ``stop`` and on earlier lists."""
        limit, tie, found = self.limit, self.tie, self.found
        open_, at = np.flatnonzero(self.low <= self.high), 0
        while at < min(stop, len(rows.ids)):
            open_ = open_[rows.reach(at)[self.member[open_]] >= limit[open_]]
            if not len(open_):
                break
            part = slice(at, min(at + STEP, stop))
            own, of = np.unique(self.member[open_], return_inverse=True)
            near = rows.ids[part]
            score = x[own] @ rows.x[part].T
            self.computed += score.size
            fits = ((labels[own][:, None] == rows.labels[part][None]) == self.same) & (ids[own][:, None] != near[None])
            score = score[of]
            hit = fits[of] & (score <= self.high[open_, None]) & ((score > limit[open_, None]) | (score == limit[open_, None]) & (near[None] <= tie[open_, None]))
            row, column = np.nonzero(hit)
            if len(row):
                merged = np.r_[found[0], open_[row]], np.r_[found[1], score[row, column]], np.r_[found[2], near[column]]
                order = np.lexsort((merged[2], -merged[1], merged[0]))
                want = merged[0][order]
                rank = np.arange(len(want)) - np.searchsorted(want, want)
                found = tuple(m[order[rank < self.k]] for m in merged)
                last = order[rank == self.k - 1]
                limit[merged[0][last]], tie[merged[0][last]] = merged[1][last], merged[2][last]
            at += STEP
        self.found = found
        return found


def meet(anchors: DataFrame, candidates: DataFrame, shards: int, width: int, *, same: bool, k: int, head: bool) -> DataFrame:
    """``(anchor, j, score, id, rank)``: the first k rows for each want of the anchors ``(id, label, x, cluster, block, wants)``.

    With ``head`` only the first rows of each list are looked at.
    """
    members = anchors.groupBy("cluster", "block").agg(F.collect_list(F.struct("id", "label", "x", "wants")).alias("members"))
    label = anchors.schema["label"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column("members").slice(i, 1).flatten()
                one = {c: own.field(own.type.get_field_index(c)) for c in ("id", "label", "x", "wants")}
                wants = one["wants"].flatten()
                columns = [one["id"], one["label"], one["wants"].value_lengths(), *(wants.field(wants.type.get_field_index(c)) for c in ("j", "low", "high"))]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([packed(one["x"].flatten().to_numpy())], pa.binary())], ["ids", "labels", "n", "j", "low", "high", "x"])

    load = f"ids array<bigint>, labels array<{label}>, n array<int>, j array<int>, low array<bigint>, high array<bigint>, x binary"
    blocks = stored(members.select("members").mapInArrow(pack, load).withColumn("at", F.monotonically_increasing_id()), "anchor-blocks")
    groups = -(-blocks.count() // GROUP)
    # A task sorts few rows: the blocks of its group (kind 0), then the chunks of its shard.
    left = blocks.select(F.lit(0).alias("kind"), F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int").alias("group"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), *[c.split()[0] for c in load.split(", ")])
    right = candidates.select(F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("chunk"), F.lit(shards)).cast("int").alias("shard"), "ids", "labels", "x")
    sides = left.unionByName(right, allowMissingColumns=True).repartition("group", "shard").sortWithinPartitions("group", "shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []

        def found() -> Iterator[pa.RecordBatch]:
            for ids, _, _, wants, j in held:
                want, score, near = wants.found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[wants.member[want]], pa.int64()), pa.array(j[want], pa.int32()), pa.array(score.astype(np.int64)), pa.array(near, pa.int64())], ["anchor", "j", "score", "id"]
                )

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                kind, *key = (one.column(c)[0].as_py() for c in ("kind", "group", "shard"))
                if key != place:
                    yield from found()
                    place, held = key, []
                ids, labels = (one.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
                x = unpacked(one.column("x")[0].as_buffer(), len(ids), width)
                if kind == 0:
                    n, j, low, high = (one.column(c).flatten().to_numpy().copy() for c in ("n", "j", "low", "high"))
                    held.append((ids.copy(), labels.copy(), x, Wants(np.repeat(np.arange(len(ids)), n), low, high, same, k), j))
                    continue
                for own, own_labels, own_x, wants, _ in held:
                    wants.walk(List(x, ids, labels, own_x), own_x, own, own_labels, HEAD if head else len(ids))
        yield from found()

    found = sides.mapInArrow(run, "anchor bigint, j int, score bigint, id bigint")
    order = Window.partitionBy("anchor", "j").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def searched(near: DataFrame, wants: DataFrame, candidates: DataFrame, shards: int, width: int, *, same: bool, k: int, name: str) -> DataFrame:
    """Two rounds over wants ``(anchor, j, low, high)``: heads of the lists give certain lower limits for the whole walk."""

    def armed(rows: DataFrame) -> DataFrame:
        packed = rows.groupBy("anchor").agg(F.collect_list(F.struct("j", "low", "high")).cast(WANTS).alias("wants"))
        return near.join(packed, near["id"] == packed["anchor"]).drop("anchor")

    heads = meet(armed(wants), candidates, shards, width, same=same, k=k, head=True)
    floors = stored(heads.where(F.col("rank") == k).select("anchor", "j", F.col("score").alias("floor")), f"{name}-floors")
    raised = wants.join(floors, ["anchor", "j"], "left").select("anchor", "j", F.greatest("low", "floor").alias("low"), "high")
    return stored(meet(armed(raised), candidates, shards, width, same=same, k=k, head=False), name)


def hard_negatives(
    vectors: DataFrame, *, anchors: str = "id % 100 = 0", vec: str = "embedding", id_col: str = "vec_id", label: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; ``anchors`` is a condition on ``id``."""
    rows = stored(rows_of(vectors, vec, id_col, label, scale), "candidates")
    chosen = rows.where(anchors)
    empty = chosen.limit(0).select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(1).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))
    if chosen.isEmpty():
        return empty
    centre = centroids(chosen)
    width = centre.shape[1]
    near = stored(clustered(chosen, centre), "anchors")
    candidates = chunks(rows)
    shards = min(candidates.count(), SHARDS)
    bounds = (F.lit(0).alias("j"), F.lit(LOWEST).cast("bigint").alias("low"), F.lit(HIGHEST).cast("bigint").alias("high"))
    good = searched(near, near.select(F.col("id").alias("anchor"), *bounds), candidates, shards, width, same=True, k=positives, name="positives")
    good = good.select("anchor", F.col("rank").alias("j"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = F.col("positive_score") * least
    wants = good.select("anchor", "j", ((share + F.pmod(-share, F.lit(100))) / 100).cast("bigint").alias("low"), F.col("positive_score").alias("high"))
    bad = searched(near, wants.where("low <= high"), candidates, shards, width, same=False, k=negatives, name="negatives")
    named = bad.select("anchor", "j", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return good.join(named, ["anchor", "j"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `embeddings`; the label of every seventh id is moved on by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


OP13_SQL = f"""WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, a.label = b.label AS same, b.id, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id))::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= 100 * s.score AND s.score <= positive_score QUALIFY rank <= {NEGATIVES}"""
