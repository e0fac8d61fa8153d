"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of word n-grams.

The model (Chen and Goodman 1999) has the orders 1 to 3 over words as written and is trained on trusted text, so
its tables grow with the text. Below single words stands the probability of a word's spelling, which gives
unknown words theirs (``word_level``). Log p of a text is a sum of values of its grams and contexts. These meet the
model by their 64-bit hashes, in ``ROUNDS`` rounds by the middle word of three: a round counts the training grams
around its words, makes their part of the model, sends it the grams of all texts as compressed arrays by block and shard, and adds up
by text. What a round has written and shuffled is deleted before the next, so disk holds one round's share of the grams at a time.

The spelling model has order ``ORDER`` over UTF-8 bytes, so it knows every alphabet; it is trained on the
distinct words of trusted text and scores the distinct words of all. Its tables are built with joins and aggregations: counts
of the highest order, continuation counts below, three discounts per order, and for every gram
``gain = log p - log(weight(context)) - log p(shorter)``. As the interpolation weight belongs to the context,
log p of a text is a sum over its grams of gains of the gram and its suffixes and of the weights that
these have as contexts of the next byte. That makes scoring separable:

Sharded count joins: documents are cut into blocks; a block sends to each shard of the model the counts of
its grams there, as compressed arrays. Shards are formed by the last two bytes of a gram, so a shard holds
all suffixes it needs. Each shard adds up its part of every document's log probability, in integers, and the
parts are summed by block. Shards are salted by block, so a frequent gram doesn't gather in one task.

A document is kept when its perplexity is at most its language's quantile ``QUANTILE`` among trusted
documents that were held out of training, under the word model and under byte n-grams of whole texts. The
latter vary less from text to text, so single odd words show more; word order shows in the former.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.graph import scratch, stored
from logspark.llm.text import U64, Texts, constants, mix, signed, slices, texts_of

ORDER = 4
#: Hash of the word before the first one, and factors of the words of a gram.
BEGIN = 0
FACTORS = constants(3, 31)
QUANTILE = 0.99
#: Bytes at the language's usual rate that a text is averaged with, so that a few words are not judged alone.
PRIOR_BYTES = 100
#: Fixed point of log probabilities.
UNIT = 1 << 20
#: Grams of a model shard, and least number of shards.
SHARD_GRAMS = 500_000
LEAST_SHARDS = 8
#: Up to so many trusted ids (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
FLUSH = 1 << 21
LEAST_HELD_OUT = 50
#: Every fifth trusted document sets the quantiles instead of training.
HOLD_OUT = 5
START = 10
#: Rounds in which word grams are counted and looked up; texts of fewer than this many times ROUND_BYTES take fewer.
ROUNDS = 8
ROUND_BYTES = 1 << 24
#: Bytes of text whose grams are sent together, model rows of a shard and least number of shards in a round.
BLOCK_BYTES = 1 << 23
SHARD_WORDS = 2_000_000
LEAST_WORD_SHARDS = 24
Batches = Iterator[pa.RecordBatch]


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each byte, as a number, and the text it belongs to; texts start after line breaks."""
    sizes = np.diff(texts.offsets)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(texts.data)) - texts.offsets[owner]
    data = np.r_[np.zeros(ORDER - 1, np.int64), texts.data.astype(np.int64)]
    key = np.zeros(len(owner), np.int64)
    for back in range(ORDER - 1, -1, -1):
        byte = data[ORDER - 1 - back : len(data) - back]
        key = (key << 8) | np.where(place >= back, byte, START)
    return key, owner


def count_grams(batches: Batches) -> Batches:
    """Counts of the highest order, summed within the task; memory is bounded by flushing."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([c for _, c in held]), len(keys)).astype(np.int64)

    for batch in batches:
        for part in slices(batch):
            found = np.unique(grams(texts_of(part.column("text")))[0], return_counts=True)
            held.append(found)
            size += len(found[0])
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["gram", "n"])
                    size = 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], ["gram", "n"])


def discounts(table: DataFrame) -> list[float]:
    """D1, D2 and D3+ of one order from its counts."""
    return kneser_ney(table.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]).first())


def kneser_ney(counts: Iterable[int | None]) -> list[float]:
    """D1, D2 and D3+ of one order from how many of its grams occur one to four times."""
    n = [float(x or 0) for x in counts]
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
    return [min(max(d, 0.05), i + 1 - 0.05) for i, d in enumerate(raw)]


def model(trusted: DataFrame, folder: str | None = None) -> DataFrame:
    """``(level, gram, value)`` from texts: value is the gain of the gram plus the log weight it has as a context.

    The value of a gram of the highest order is its gain alone. Values are in units of 1 / UNIT.
    """
    counts = {ORDER: stored(trusted.select("text").mapInArrow(count_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")), "grams", folder)}
    for level in range(ORDER - 1, 0, -1):
        shorter = (F.col("gram") % F.lit(1 << (8 * level))).alias("gram")
        counts[level] = stored(counts[level + 1].groupBy(shorter).agg(F.count(F.lit(1)).alias("n")), "grams", folder)
    out: list[DataFrame] = []
    probability: dict[int, DataFrame] = {}
    weight_of: dict[int, DataFrame] = {}
    for level in range(1, ORDER + 1):
        table = counts[level]
        d = discounts(table)
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        context = F.floor(F.col("gram") / 256).cast("bigint")
        weights = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), (F.sum(discount) / F.sum("n")).alias("weight"))
        rows = table.withColumn("context", context).join(weights, "context")
        own = (F.col("n") - discount) / F.col("total")
        if level == 1:
            below = F.lit(1.0 / 256)
        else:
            lower = probability[level - 1].select(F.col("gram").alias("short"), F.col("p").alias("q"))
            rows = rows.join(lower, F.col("gram") % F.lit(1 << (8 * (level - 1))) == F.col("short"))
            below = F.col("q")
        p = own + F.col("weight") * below
        # Of a single byte the value is log p itself, with the weight of the empty context.
        gain = F.log(p) if level == 1 else F.log(p) - F.log("weight") - F.log(below)
        probability[level] = stored(rows.select("gram", p.alias("p"), gain.alias("gain")), "probabilities", folder)
        weight_of[level] = weights.select(F.col("context").alias("gram"), F.log("weight").alias("next"))
    for level in range(1, ORDER + 1):
        rows = probability[level]
        value, after = F.col("gain"), F.lit(0.0)
        if level < ORDER:
            # A context at the start of texts need not be a gram of its own.
            rows = rows.join(weight_of[level + 1], "gram", "full")
            after = F.coalesce("next", F.lit(0.0))
            value = F.coalesce("gain", F.lit(0.0)) + after
        fixed = [F.round(x * UNIT).cast("bigint").alias(n) for x, n in ((value, "value"), (after, "after"))]
        out.append(rows.select(F.lit(level).alias("level"), "gram", *fixed))
    whole = out[0]
    for table in out[1:]:
        whole = whole.unionByName(table)
    return stored(whole, "model", folder)


def shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    """By the last two bytes."""
    return ((gram & 0xFFFF) * 40503 >> 4) % shards


PACKED = "block bigint, shard int, load binary, ids array<bigint>, langs array<string>, roles array<tinyint>, sizes array<bigint>"


def pack(shards: int) -> Callable[[Batches], Batches]:
    """Counts of grams by block and shard, and one row (shard -1) that says which documents a block has."""

    def run(batches: Batches) -> Batches:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                block += 1
                texts = texts_of(part.column("text"))
                key, owner = grams(texts)
                sizes = np.diff(texts.offsets)
                last = texts.offsets[1:][sizes > 0] - 1
                ends = key[last]
                joined, times = np.unique((key << 24) | owner, return_counts=True)
                key, owner = joined >> 24, joined & 0xFFFFFF
                home, end_home = shard_of(key, shards), shard_of(ends, shards)
                loads = []
                for shard in range(shards):
                    own = home == shard
                    grams_, doc = key[own], owner[own]
                    fresh = np.r_[True, grams_[1:] != grams_[:-1]] if len(grams_) else np.zeros(0, bool)
                    step = doc.copy()
                    step[1:][~fresh[1:]] -= doc[:-1][~fresh[1:]]
                    at = np.flatnonzero(fresh)
                    arrays = [grams_[at], np.diff(np.r_[at, len(doc)]), step, times[own], ends[end_home == shard], np.flatnonzero(sizes > 0)[end_home == shard]]
                    loads.append(_compress(arrays))
                n = shards + 1
                columns = [
                    pa.array(np.full(n, block)),
                    pa.array(np.arange(-1, shards).astype(np.int32)),
                    pa.array([None, *loads], pa.binary()),
                    pa.array([part.column("doc_id").to_pylist()] + [None] * shards, pa.list_(pa.int64())),
                    pa.array([part.column("lang").to_pylist()] + [None] * shards, pa.list_(pa.string())),
                    pa.array([part.column("role").to_pylist()] + [None] * shards, pa.list_(pa.int8())),
                    pa.array([sizes.tolist()] + [None] * shards, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PACKED.split(", ")])

    return run


def _compress(arrays: list[np.ndarray]) -> bytes:
    """Lengths, then the arrays in 32 bits, split into planes of equal bytes and compressed."""
    head = np.array([len(a) for a in arrays], np.uint32)
    flat = np.concatenate([head, *[np.diff(arrays[0], prepend=0), *arrays[1:]]]).astype(np.uint32)
    planes = flat.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _expand(load: bytes) -> list[np.ndarray]:
    size = int.from_bytes(load[:8], "little")
    planes = np.frombuffer(pa.decompress(load[8:], size, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    flat = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
    bounds = np.r_[6, 6 + np.cumsum(flat[:6])]
    arrays = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    arrays[0] = np.cumsum(arrays[0])
    return arrays


def look_up(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]], grams_: np.ndarray, column: int) -> np.ndarray:
    """Sum of the values (1) or of the weights as a context (2) of each gram and its suffixes."""
    out = np.zeros(len(grams_), np.int64)
    for level, table in enumerate(tables, 1):
        keys, found = table[0], grams_ & ((1 << (8 * level)) - 1)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            out += np.where(keys[at] == found, table[column][at], 0)
        if level == 1 and column == 1:  # a byte that the model has never seen
            unseen = ~np.isin(found, keys)
            out[unseen] += round(np.log(1 / 4096) * UNIT)
    return out


def add_up(batches: Batches) -> Batches:
    """Model rows of a shard come first, then the blocks' counts; gives parts of log probabilities by block.

    Rows that say which documents a block has (shard -1) are passed on.
    """
    meta = ["ids", "langs", "roles", "sizes"]
    rows: list[list[np.ndarray]] = []
    tables, place = None, None
    for batch in batches:
        block = batch.column("block").to_numpy()
        home = batch.column("shard").to_numpy().astype(np.int64) << 32 | batch.column("salt").to_numpy()
        out: list[tuple[int, bytes]] = []
        about = pa.array(np.flatnonzero(home < 0))
        if len(about):
            columns = [batch.column("block").take(about), pa.nulls(len(about), pa.binary()), *[batch.column(c).take(about) for c in meta]]
            yield pa.RecordBatch.from_arrays(columns, ["block", "part", *meta])
        at = 0
        while at < len(block):
            if home[at] < 0:
                at += 1
                continue
            if home[at] != place:
                place, rows, tables = home[at], [], None
            if block[at] < 0:
                ends_here = np.flatnonzero((block[at:] >= 0) | (home[at:] != place))
                stop = at + int(ends_here[0]) if len(ends_here) else len(block)
                rows.append([batch.column(c).slice(at, stop - at).to_numpy(zero_copy_only=False) for c in ("level", "gram", "value", "after")])
                at = stop
                continue
            if tables is None:
                level, gram, value, after = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 4
                tables = []
                for k in range(1, ORDER + 1):
                    own = np.flatnonzero(level == k)
                    own = own[np.argsort(gram[own])]
                    tables.append((gram[own], value[own], after[own]))
            keys, spread, step, times, ends, end_docs = _expand(batch.column("load")[at].as_py())
            doc = np.cumsum(step)
            first = np.r_[0, np.cumsum(spread)[:-1]]
            if len(doc):  # steps restart at every gram
                doc -= np.repeat(np.r_[0, doc[first[1:] - 1]], spread)
            size = int(max(doc.max(initial=-1), end_docs.max(initial=-1))) + 1
            total = np.zeros(size, np.int64)
            np.add.at(total, doc, np.repeat(look_up(tables, keys, 1), spread) * times)
            # The last gram of a text is the context of nothing.
            np.subtract.at(total, end_docs, look_up(tables, ends, 2))
            out.append((int(block[at]), total.tobytes()))
            at += 1
        if out:
            none = [pa.nulls(len(out), batch.schema.field(c).type) for c in meta]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary()), *none], ["block", "part", *meta])


def by_document(batches: Batches) -> Batches:
    """Sum the parts of each block and say which document each sum belongs to; rows come by block."""
    names = ["doc_id", "lang", "role", "bytes", "log_p"]
    kinds = [pa.int64(), pa.string(), pa.int8(), pa.int64(), pa.int64()]
    block, total, meta = None, None, None

    def finish() -> Batches:
        if meta is not None:
            sums = np.zeros(len(meta["ids"]), np.int64)
            sums[: len(total)] = total
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((meta["ids"], meta["langs"], meta["roles"], meta["sizes"], sums.tolist()), kinds)], names)

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                yield from finish()
                block, total, meta = row["block"], np.zeros(0, np.int64), None
            if row["ids"] is not None:
                meta = row
            if row["part"] is not None:
                part = np.frombuffer(row["part"], np.int64)
                wide = np.zeros(max(len(part), len(total)), np.int64)
                wide[: len(total)] = total
                wide[: len(part)] += part
                total = wide
    yield from finish()


def scores(docs: DataFrame, table: DataFrame) -> DataFrame:
    """``(doc_id, lang, role, bytes, log_p)`` per row of ``docs(doc_id, lang, role, text)``; log_p in units of 1 / UNIT."""
    spark = docs.sparkSession
    shards = max(LEAST_SHARDS, -(-table.count() // SHARD_GRAMS))
    salts = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    packed = docs.mapInArrow(pack(shards), PACKED)
    every = F.array(*[F.lit(s) for s in range(salts)])
    home = F.pmod(F.shiftright(F.col("gram").bitwiseAND(0xFFFF) * 40503, 4), F.lit(shards)).cast("int")
    homes = F.when(F.col("level") == 1, F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(home))
    model_rows = table.select("level", "gram", "value", "after", F.explode(homes).alias("shard"))
    model_rows = model_rows.select(F.lit(-1).cast("bigint").alias("block"), "shard", F.explode(every).alias("salt"), "level", "gram", "value", "after")
    both = model_rows.unionByName(packed.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")), allowMissingColumns=True)
    sides = both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "block")
    parts = sides.mapInArrow(add_up, "block bigint, part binary, ids array<bigint>, langs array<string>, roles array<tinyint>, sizes array<bigint>")
    rows = parts.repartition("block").sortWithinPartitions("block")
    sums = rows.mapInArrow(by_document, "doc_id bigint, lang string, role tinyint, bytes bigint, log_p bigint")
    # Every text begins in the context of line breaks.
    begin = int.from_bytes(bytes([START] * ORDER), "big")
    start = table.where(F.expr(f"gram = {begin}L % shiftleft(1L, level * 8)")).agg(F.sum("after")).first()[0]
    return sums.withColumn("log_p", F.when(F.col("bytes") > 0, F.col("log_p") + (start or 0)).otherwise(0))


def word_keys(texts: Texts, rounds: int = 1, turn: int = 0) -> dict[str, np.ndarray]:
    """Of each word after one of this turn its place ``at``, its hash ``w``, that of the word before ``v``, and the hashes of the grams vw, uvw and of the context uv."""
    w = texts.words
    v = np.roll(w, 1)
    first = texts.bounds[:-1][np.diff(texts.bounds) > 0]
    v[first] = BEGIN
    at = np.flatnonzero(v % U64(rounds) == turn) if rounds > 1 else np.arange(len(w))
    u = np.roll(v, 1)
    u[first] = BEGIN
    u, v, w = u[at], v[at], w[at]
    a, b, c = FACTORS
    return {"at": at, "w": w, "v": v, "vw": mix(v * b + w * c + U64(2)), "uv": mix(u * b + v * c + U64(2)), "uvw": mix(u * a + v * b + w * c + U64(3))}


def training_grams(rounds: int, turn: int) -> Callable[[Batches], Batches]:
    """Counts of the three-word grams of each slice whose middle word has this turn, with the hashes of their parts."""
    names = ["uvw", "uv", "vw", "v", "w"]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in slices(batch):
                keys = word_keys(texts_of(part.column("text")), rounds, turn)
                _, at, n = np.unique(keys["uvw"], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*[signed(keys[c][at]) for c in names], pa.array(n)], [*names, "n"])

    return run


TRAINING = "uvw bigint, uv bigint, vw bigint, v bigint, w bigint, n bigint"


def spelled(batches: Batches) -> Batches:
    """The distinct words of each slice; ``trained`` is 1 in training text."""
    for batch in batches:
        for part in slices(batch):
            texts = texts_of(part.column("text"))
            trained = part.column("role").to_numpy(zero_copy_only=False)[texts.owner] == 1
            order = np.lexsort((~trained, texts.words))
            hashes, first = np.unique(texts.words[order], return_index=True)
            at = order[first]
            held = texts.data.tobytes()
            words = pa.array([held[a:b] for a, b in zip(texts.starts[at], texts.ends[at])], pa.binary())
            yield pa.RecordBatch.from_arrays([signed(hashes), words.cast(pa.string()), pa.array(trained[at].astype(np.int8))], ["w", "word", "trained"])


def shard_starts(shards: int) -> np.ndarray:
    """The smallest hash of each shard; shards are equal ranges of hashes."""
    return np.array([-((-s << 32) // shards) << 32 for s in range(shards)], U64)


def pack_model(shards: int) -> Callable[[Batches], Batches]:
    """Model rows ``(key, gain, after)`` as one value for each shard and about SHARD_WORDS rows of a task; their block is -1."""
    starts = shard_starts(shards)

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            key, gain, after = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("key", "gain", "after"))
            held.clear()
            order = np.argsort(key.view(U64))
            key, gain, after = key.view(U64)[order], gain[order], after[order]
            cuts = np.r_[np.searchsorted(key, starts), len(key)]
            loads = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                whole = _planes(np.diff(key[a:b], prepend=U64(0))) + _planes(gain[a:b]) + _planes(after[a:b])
                loads.append((b - a).item().to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array(np.full(shards, -1)), pa.array(np.arange(shards, dtype=np.int32)), pa.array(loads, pa.binary())], ["block", "shard", "load"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= SHARD_WORDS:
                yield made()
        if held:
            yield made()

    return run


def pack_words(rounds: int, turn: int, shards: int) -> Callable[[Batches], Batches]:
    """Per block and shard the keys of this turn's words with the texts that have them: how often each is a gram (``n``) and the context of a word (``m``).

    One row of each block has the ``ids`` of its texts with words.
    """
    starts = shard_starts(shards)

    def run(batches: Batches) -> Batches:
        block = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []
        size, texts_held = 0, 0

        def made() -> pa.RecordBatch:
            ids, key, owner, context = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((owner, key))
            key, owner, context = key[order], owner[order], context[order]
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(fresh)
            m = np.add.reduceat(context.astype(np.int64), at) if len(at) else at
            n = np.diff(np.r_[at, len(key)]) - m
            key, owner = key[at], owner[at]
            cuts = np.r_[np.searchsorted(key, starts), len(key)]
            loads = [_compress_keys(key[a:b], owner[a:b], n[a:b], m[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            lists = [None] * shards
            lists[block % shards] = ids
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(shards, block)), pa.array(np.arange(shards, dtype=np.int32)), pa.array(loads, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], ["block", "shard", "load", "ids"]
            )

        for batch in batches:
            for part in slices(batch):
                texts = texts_of(part.column("text"))
                keys = word_keys(texts, rounds, turn)
                some = np.diff(texts.bounds) > 0
                own = np.flatnonzero(texts.words % U64(rounds) == turn)
                number, bounds = (np.cumsum(some) - 1 + texts_held).astype(np.int32), texts.bounds[1:]
                key = np.concatenate([texts.words[own], *[keys[c] for c in ("vw", "uvw", "v", "uv")]])
                of_own, around = (number[np.searchsorted(bounds, x, side="right")] for x in (own, keys["at"]))
                owner = np.concatenate([of_own, *[around] * 4])
                context = np.zeros(len(key), bool)
                context[len(key) - 2 * len(keys["at"]) :] = True
                held.append((part.column("t").to_numpy()[some], key, owner, context))
                size += len(texts.data)
                texts_held += int(some.sum())
                if size >= BLOCK_BYTES:
                    yield made()
                    block, size, texts_held = block + 1, 0, 0
        if held:
            yield made()

    return run


def _planes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.dtype.itemsize).T.tobytes()


def _flat(data: bytes, kind: type, at: int, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def _compress_keys(key: np.ndarray, owner: np.ndarray, n: np.ndarray, m: np.ndarray) -> bytes | None:
    """Rows (key, owner, n, m) in order of key and owner: differences of the distinct keys, and the rest in 32 bits, as planes of equal bytes."""
    if not len(key):
        return None
    fresh = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(fresh)
    step = owner.astype(np.int64)
    step[1:][~fresh[1:]] -= owner[:-1][~fresh[1:]]
    parts = [np.array([len(at), len(key)], np.int64).tobytes(), _planes(np.diff(key[at], prepend=U64(0)))]
    parts += [_planes(x.astype(np.uint32)) for x in (np.diff(np.r_[at, len(key)]), step, n, m)]
    whole = b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def _expand_keys(load: bytes) -> tuple[np.ndarray, ...]:
    """The distinct keys, the rows of each, and owner, n and m of each row."""
    data = pa.decompress(load[8:], int.from_bytes(load[:8], "little"), "zstd", asbytes=True)
    distinct, rows = np.frombuffer(data, np.int64, 2)
    keys = np.cumsum(_flat(data, U64, 16, distinct), dtype=U64)
    at = 16 + 8 * distinct
    spread, step, n, m = (_flat(data, np.uint32, at + 4 * (distinct * (k > 0) + rows * max(k - 1, 0)), distinct if k == 0 else rows).astype(np.int64) for k in range(4))
    owner = np.cumsum(step)
    first = np.r_[0, np.cumsum(spread)[:-1]]
    owner -= np.repeat(np.r_[0, owner[first[1:] - 1]], spread)  # steps restart at every key
    return keys, spread, owner, n, m


def add_up_words(batches: Batches) -> Batches:
    """Model rows of a shard come first, then the blocks' keys; gives parts of log probabilities by block, and passes ids on."""
    place, rows, model_ = None, [], None
    for batch in batches:
        block, shard = batch.column("block").to_numpy(), batch.column("shard").to_numpy()
        out: list[tuple[int, bytes | None, pa.Scalar]] = []
        at = 0
        while at < len(block):
            if shard[at] != place:
                place, rows, model_ = shard[at], [], None
            if block[at] < 0:
                load = batch.column("load")[at].as_py()
                data = pa.decompress(load[8:], 24 * (n := int.from_bytes(load[:8], "little")), "zstd", asbytes=True)
                rows.append([np.cumsum(_flat(data, U64, 0, n), dtype=U64), _flat(data, np.int64, 8 * n, n), _flat(data, np.int64, 16 * n, n)])
                at += 1
                continue
            if model_ is None:
                key, gain, after = [np.concatenate(x) for x in zip(*rows)] if rows else [np.zeros(0, U64), *[np.zeros(0, np.int64)] * 2]
                order = np.argsort(key, kind="stable")  # few sorted runs
                key = key[order]
                fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
                model_ = [key[fresh], *(np.add.reduceat(x[order], fresh) if len(fresh) else x for x in (gain, after))]
                rows = []
            load, ids = batch.column("load")[at].as_py(), batch.column("ids").slice(at, 1)
            part = None
            if load is not None and len(model_[0]):
                keys, spread, owner, n, m = _expand_keys(load)
                found = np.minimum(np.searchsorted(model_[0], keys), len(model_[0]) - 1)
                known = model_[0][found] == keys
                gain, after = (np.repeat(np.where(known, x[found], 0), spread) for x in model_[1:])
                total = np.bincount(owner, n * gain + m * after).astype(np.int64)  # whole numbers, far below 2**53
                part = len(total).to_bytes(8, "little") + pa.compress(_planes(total), "zstd", asbytes=True)
            out.append((int(block[at]), part, ids))
            at += 1
        if out:
            columns = [pa.array([b for b, _, _ in out], pa.int64()), pa.array([x for _, x, _ in out], pa.binary()), pa.concat_arrays([x for _, _, x in out])]
            yield pa.RecordBatch.from_arrays(columns, ["block", "part", "ids"])


def by_text(batches: Batches) -> Batches:
    """Sum the parts of each block and say which text each sum belongs to; rows come by block."""
    block, total, ids = None, np.zeros(0, np.int64), None

    def finish() -> Batches:
        if ids is not None:
            sums = np.zeros(len(ids), np.int64)
            sums[: len(total)] = total
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums)], ["t", "log_p"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                yield from finish()
                block, total, ids = row["block"], np.zeros(0, np.int64), None
            if row["ids"] is not None:
                ids = row["ids"]
            if row["part"] is not None:
                n = int.from_bytes(row["part"][:8], "little")
                part = _flat(pa.decompress(row["part"][8:], 8 * n, "zstd", asbytes=True), np.int64, 0, n)
                total = np.pad(total, (0, max(0, n - len(total))))
                total[:n] += part
    yield from finish()


def single_counts(train: DataFrame, rounds: int, folder: str) -> DataFrame:
    """Per word how many words it follows (``n``), and of its two- and three-word grams how many there are (``g2``, ``g3``) and how many occur one to four times."""
    times = [f"{c}{i}" for c in "ab" for i in range(1, 5)]
    with scratch(train.sparkSession, "counts") as own:
        for turn in range(rounds):
            made = train.mapInArrow(training_grams(rounds, turn), TRAINING).select("uvw", "vw", "w", "n")
            three = made.groupBy("uvw").agg(F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in ("vw", "w")])
            two = three.groupBy("vw").agg(F.count(F.lit(1)).alias("n"), F.any_value("w").alias("w"), *[F.count_if(F.col("n") == i).alias(f"b{i}") for i in range(1, 5)])
            of_word = [F.count(F.lit(1)).alias("n"), F.sum("n").alias("g3"), *[F.count_if(F.col("n") == i).alias(f"a{i}") for i in range(1, 5)], *[F.sum(f"b{i}").alias(f"b{i}") for i in range(1, 5)]]
            part = stored(two.groupBy("w").agg(*of_word), "words-1", own)
            whole = whole.unionByName(part) if turn else part
        sums = whole.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "g3", *times)])
        return stored(sums.withColumn("g2", F.col("n")), "words-1", folder)


def word_level(docs: DataFrame, single: DataFrame, folder: str) -> DataFrame:
    """``(gram, p)`` of every word of ``docs(role, text)``: its probability over the spelling, which is trained on the words of role 1."""
    with scratch(docs.sparkSession, "spelling") as own:
        made = docs.select("text", "role").mapInArrow(spelled, "w bigint, word string, trained tinyint")
        vocabulary = stored(made.groupBy("w").agg(F.min("word").alias("word"), F.max("trained").alias("trained")), "vocabulary", own)
        text = F.concat("word", F.lit("\n")).alias("text")  # the end of the word is part of its spelling
        spelling = model(vocabulary.where("trained = 1").select(text), own)
        words = vocabulary.select(F.col("w").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(0).cast("tinyint").alias("role"), text)
        base = scores(words, spelling).select(F.col("doc_id").alias("gram"), F.exp(F.col("log_p") / F.lit(float(UNIT))).alias("base"))
        table = _discounted(single, discounts(single))
        total, weight = table.agg(F.sum("n"), F.sum("d") / F.sum("n")).first()
        known = table.select(F.col("w").alias("gram"), ((F.col("n") - F.col("d")) / F.lit(float(total or 1))).alias("own"))
        # Of very long words the base is 0 in floating point.
        p = F.greatest(F.coalesce("own", F.lit(0.0)) + F.lit(1.0 if weight is None else weight) * F.col("base"), F.lit(1e-300))
        return stored(base.join(known, "gram", "left").select("gram", p.alias("p")), "word-level", folder)


def _discounted(table: DataFrame, d: list[float]) -> DataFrame:
    return table.withColumn("d", F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]))


def word_model(train: DataFrame, words: DataFrame, d: dict[str, list[float]], rounds: int, turn: int, folder: str) -> DataFrame:
    """``(key, gain, after)`` in units of 1 / UNIT of the words of this turn and of the grams and contexts around them; a key can have several rows to add up.

    ``gain`` of a gram is log p - log(weight of its context) - log p of the gram without its first word, of a
    single word log p itself; ``after`` is the log weight that the gram has as a context. Every word of this turn in ``words`` has a row.
    """
    none = F.lit(0.0)
    with scratch(train.sparkSession, "word-round") as own:
        made = train.mapInArrow(training_grams(rounds, turn), TRAINING)
        three = stored(made.groupBy("uvw").agg(F.sum("n").alias("n"), *[F.any_value(c).alias(c) for c in ("uv", "vw", "v", "w")]), "words-3", own)
        two = stored(three.groupBy("vw").agg(F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v"), F.any_value("w").alias("w")), "words-2", own)
        lower = words
        # The remainder of the hash as an unsigned number.
        whole = words.where((F.pmod(F.shiftrightunsigned("gram", 1), F.lit(rounds)) * 2 + F.col("gram").bitwiseAND(1)) % rounds == turn)
        whole = whole.select(F.col("gram").alias("key"), F.log("p").alias("gain"), none.alias("after"))
        for table, gram, context, short in ((two, "vw", "v", "w"), (three, "uvw", "uv", "vw")):
            table = _discounted(table, d[gram]).select(F.col(gram).alias("gram"), F.col(context).alias("context"), F.col(short).alias("short"), "n", "d")
            weights = stored(table.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight")), "word-contexts", own)
            rows = table.join(weights, "context").join(lower.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short")
            p = (F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("below")
            level = rows.select("gram", p.alias("p"), (F.log(p) - F.log("weight") - F.log("below")).alias("gain"))
            level = lower = stored(level, "word-level", own) if gram == "vw" else level
            whole = whole.unionByName(level.select(F.col("gram").alias("key"), "gain", none.alias("after")))
            whole = whole.unionByName(weights.select(F.col("context").alias("key"), none.alias("gain"), F.log("weight").alias("after")))
        return stored(whole.select("key", *[F.round(F.col(c) * UNIT).cast("bigint").alias(c) for c in ("gain", "after")]), "word-model", folder)


def word_sums(docs: DataFrame, folder: str) -> DataFrame:
    """``(t, log_p)`` by the word model for the texts with words of ``docs(t, role, text)``; texts that share t are added up."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    rounds = max(1, min(ROUNDS, -(-size // ROUND_BYTES)))
    train, parts = docs.where("role = 1").select("text"), []
    with scratch(spark, "words") as own:
        single = single_counts(train, -(-rounds // 3), own)  # these rows are few
        counts = single.agg(*[F.sum(c).alias(c) for c in single.columns if c != "w"]).first()
        d = {"vw": kneser_ney(counts[f"a{i}"] for i in range(1, 5)), "uvw": kneser_ney(counts[f"b{i}"] for i in range(1, 5))}
        words = word_level(docs, single, own)
        shards = max(LEAST_WORD_SHARDS, -(-2 * ((counts["g2"] or 0) + (counts["g3"] or 0)) // (rounds * SHARD_WORDS)))
        for turn in range(rounds):
            with scratch(spark, "word-keys") as now:
                table = word_model(train, words, d, rounds, turn, now)
                model_rows = table.mapInArrow(pack_model(shards), "block bigint, shard int, load binary")
                sent = docs.select("t", "text").mapInArrow(pack_words(rounds, turn, shards), "block bigint, shard int, load binary, ids array<bigint>")
                sides = model_rows.unionByName(sent, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "block")
                found = sides.mapInArrow(add_up_words, "block bigint, part binary, ids array<bigint>").repartition("block").sortWithinPartitions("block")
                parts.append(stored(found.mapInArrow(by_text, "t bigint, log_p bigint"), "word-sums", own))
        whole = reduce(DataFrame.unionByName, parts)
        return stored(whole.groupBy("t").agg(F.sum("log_p").alias("sum")), "word-sums", folder)


def word_scores(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, role, bytes, log_p, byte_log_p)`` per row of ``docs(doc_id, lang, role, text)``, in units of 1 / UNIT.

    ``byte_log_p`` is that of the byte n-grams of whole texts. The model is trained on the rows of role 1. A text of blanks only counts as unknown bytes, 1 / 256 each.
    """
    docs = docs.withColumn("t", F.xxhash64("doc_id", "text"))
    with scratch(docs.sparkSession, "quality") as folder:
        sums = word_sums(docs, folder)
        with scratch(docs.sparkSession, "bytes") as own:
            of_bytes = scores(docs.select(F.col("t").alias("doc_id"), "lang", "role", "text"), model(docs.where("role = 1"), own))
            of_bytes = stored(of_bytes.groupBy(F.col("doc_id").alias("t")).agg(F.max("log_p").alias("byte_log_p")), "byte-sums", folder)
        # Repeated rows share t, so its sum holds their log p as many times.
        copies = docs.groupBy("t").agg(F.count(F.lit(1)).alias("copies"))
        sums = sums.join(copies, "t").select("t", F.expr("sum div copies").alias("log_p"))
        about = docs.select("doc_id", "lang", "role", "t", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"))
        blank = F.col("bytes") * F.lit(round(np.log(1 / 256) * UNIT))
        both = about.join(sums, "t", "left").join(of_bytes, "t", "left")
        return stored(both.select("doc_id", "lang", "role", "bytes", F.coalesce("log_p", blank).alias("log_p"), "byte_log_p"), "scores")


def judged(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(doc_id, lang, n_bytes, perplexity, threshold, byte_perplexity, byte_threshold, kept)`` per row of ``docs``.

    ``trusted`` has the ids (``doc_id``) of trusted documents; a fifth of them, by crc32 of the id, set the
    quantiles and the others train. Perplexity is per byte, and averaged with ``PRIOR_BYTES`` bytes at the
    language's mean rate before it is compared (``threshold`` refers to that). Languages with fewer than
    ``LEAST_HELD_OUT`` held-out documents, and null languages, use the quantile of all. Null and empty texts
    have null perplexity and are not kept. Null ids are scored and never trusted; repeated rows are scored
    alike. Without trusted text nothing is known: thresholds are null and every text stays. An empty table
    gives no row; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "text")])
    ids = trusted.select(F.col("doc_id").cast("bigint").alias("__id")).where("__id IS NOT NULL").distinct()
    small = ids.count() <= BROADCAST_IDS
    held = F.crc32(F.col("__id").cast("string").cast("binary")) % HOLD_OUT == 0
    role = F.when(F.col("__id").isNull(), 0).when(held, 2).otherwise(1).cast("tinyint")
    marked = docs.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "lang", role.alias("role"), "text")
    if not small:  # blocks must not change when a task is run again
        marked = stored(marked, "marked")
    found = word_scores(marked)
    named = [F.col(c).alias(f"word_{c}") for c in ("rate", "smooth", "limit")]
    found = _limited(found, quantile).select("doc_id", "lang", "role", "bytes", F.col("byte_log_p").alias("log_p"), *named)
    found = _limited(found, quantile)
    within = [F.coalesce(F.col(f"{c}smooth") * 1000 <= F.col(f"{c}limit"), F.lit(True)) for c in ("word_", "")]
    kept = F.col("rate").isNotNull() & within[0] & within[1]
    figures = [f(F.col(c)).alias(n) for c, n, f in (
        ("word_rate", "perplexity", F.exp), ("word_limit", "threshold", lambda x: F.exp(x / 1000)),
        ("rate", "byte_perplexity", F.exp), ("limit", "byte_threshold", lambda x: F.exp(x / 1000)),
    )]
    return found.select("doc_id", "lang", F.col("bytes").alias("n_bytes"), *figures, kept.alias("kept"))


def _limited(found: DataFrame, quantile: float) -> DataFrame:
    """``found`` with the rate of log_p per byte, the averaged rate, and the language's limit in thousandths."""
    columns = found.columns
    rate = -F.col("log_p") / F.lit(float(UNIT)) / F.col("bytes")
    found = found.withColumn("rate", F.when(F.col("bytes") > 0, rate))
    means = found.where("role = 2").groupBy("lang").agg(F.count("rate").alias("held"), F.sum("rate").alias("sum"))
    whole = means.agg(F.sum("held").alias("all_held"), F.sum("sum").alias("all_sum"))
    means = found.select("lang").distinct().alias("l").join(means.alias("m"), F.expr("l.lang <=> m.lang"), "left").join(F.broadcast(whole))
    means = means.select(F.expr("l.lang").alias("lang"), F.when(F.expr("m.held") >= LEAST_HELD_OUT, F.col("sum") / F.col("held")).alias("own"), (F.col("all_sum") / F.col("all_held")).alias("any"))
    means = means.select(F.col("lang").alias("m_lang"), F.coalesce(F.when(F.col("lang").isNotNull(), F.col("own")), "any").alias("mean"))
    found = found.join(means, F.expr("lang <=> m_lang"), "left")
    found = found.withColumn("smooth", (F.col("rate") * F.col("bytes") + F.coalesce("mean", "rate") * PRIOR_BYTES) / (F.col("bytes") + PRIOR_BYTES))
    # Quantiles from counts per thousandth of a nat: mergeable, and some thousand rows a language.
    held_out = found.where("role = 2 AND smooth IS NOT NULL").select("lang", F.ceil(F.col("smooth") * 1000).cast("bigint").alias("bucket"))
    counts = held_out.groupBy("lang", "bucket").agg(F.count(F.lit(1)).alias("n"))
    own = _quantile(counts, ["lang"], quantile)
    merged = _quantile(counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"], quantile)
    own = own.where(F.col("lang").isNotNull() & (F.col("docs") >= LEAST_HELD_OUT)).select(F.col("lang").alias("q_lang"), F.col("limit").alias("own"))
    rows = found.join(own, F.col("lang") == F.col("q_lang"), "left")
    limit = F.coalesce(F.col("own"), merged.agg(F.max("limit")).scalar())
    return rows.select(*columns, "rate", "smooth", limit.alias("limit"))


def _quantile(counts: DataFrame, keys: list[str], q: float) -> DataFrame:
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    run = counts.withColumn("upto", upto).withColumn("docs", F.sum("n").over(Window.partitionBy(*keys)))
    return run.groupBy(*keys).agg(F.max("docs").alias("docs"), F.min(F.when(F.col("upto") >= F.col("docs") * q, F.col("bucket"))).alias("limit"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that every label calls good and none toxic."""
    by_doc = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return by_doc.where("quality = 1 AND toxic = 0").select("doc_id")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`; trusted are those that `labels` calls good and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
