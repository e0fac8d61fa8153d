"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a GRU of ``HIDDEN`` units with softsign activations, which cost a fraction of tanh in
numpy and train as well here. A byte selects a row of input weights; the states of both directions give
a language distribution at every byte; a document's distribution is the mean over all its bytes. Training is
backpropagation through time with Adam in numpy, on windows of ``TRAIN_WINDOW`` bytes.

Bounds: the network learns from at most ``TRAIN_DOCS`` documents of each of the ``MAX_LANGS`` most frequent
languages, chosen by a hash of the id, and at most ``TRAIN_CHARS`` characters of each. Prediction reads every
byte of every text: texts are cut into windows of ``WINDOW`` bytes, which run side by side as columns of one
matrix, so a very long text needs no more memory per step than a short one. No shuffle of texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logspark.llm.text import slices, texts_of

HIDDEN = 8
WINDOW = 128
COLUMNS = 2048
TRAIN_DOCS = 400
TRAIN_CHARS = 2000
TRAIN_WINDOW = 48
TRAIN_STEPS = 700
TRAIN_BATCH = 192
MAX_LANGS = 256
LEAST_SCORE = 0.35
PAD = 256
UNKNOWN = "und"
F32 = np.float32


@dataclass
class Direction:
    """Weights of one direction: ``inputs`` by byte (update, reset, candidate), ``gates``, ``candidate``, ``head``."""

    inputs: np.ndarray
    gates: np.ndarray
    candidate: np.ndarray
    head: np.ndarray


@dataclass
class Network:
    langs: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray


def softsign(x: np.ndarray, spare: np.ndarray) -> None:
    """x / (1 + |x|), in place."""
    np.abs(x, out=spare)
    spare += 1
    x /= spare


def step(d: Direction, codes: np.ndarray, h: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, ...]:
    """One time step; ``h`` has a column per window. Gives gates (update over reset), candidate and new state."""
    n = len(h)
    rows = d.inputs[codes].T
    gates = d.gates @ h
    gates += rows[: 2 * n]
    softsign(gates, spare[: 2 * n, : h.shape[1]])
    gates *= 0.5
    gates += 0.5
    fresh = d.candidate @ (gates[n:] * h)
    fresh += rows[2 * n :]
    softsign(fresh, spare[:n, : h.shape[1]])
    after = fresh - h
    after *= gates[:n]
    after += h
    return gates, fresh, after


def unroll(d: Direction, codes: np.ndarray, states: np.ndarray, order: range, keep: list | None = None) -> None:
    """Run over ``codes[t]`` in the given order of t and put the states into ``states[t]``."""
    h = np.zeros(states.shape[1:], F32)
    spare = np.empty((2 * len(h), h.shape[1]), F32)
    for t in order:
        gates, fresh, after = step(d, codes[t], h, spare)
        if keep is not None:
            keep.append((t, h, gates, fresh))
        states[t] = after
        h = after


def softmax(x: np.ndarray) -> np.ndarray:
    """Over the axis before the last, in place."""
    x -= x.max(axis=-2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-2, keepdims=True)
    return x


def backpropagate(d: Direction, codes: np.ndarray, slope: np.ndarray, kept: list) -> dict[str, np.ndarray]:
    """Gradients of one direction; ``slope[t]`` is the loss gradient at the state of t."""
    n = HIDDEN
    grads = {"inputs": np.zeros_like(d.inputs), "gates": np.zeros_like(d.gates), "candidate": np.zeros_like(d.candidate)}
    carried = np.zeros_like(slope[0])
    rows = np.empty((len(kept), 3 * n, slope.shape[2]), F32)
    for i, (t, h, gates, fresh) in enumerate(reversed(kept)):
        after = slope[t] + carried
        update, reset = gates[:n], gates[n:]
        d_fresh = after * update * (1 - np.abs(fresh)) ** 2
        d_held = d.candidate.T @ d_fresh
        d_gates = np.concatenate([after * (fresh - h), d_held * h])
        d_gates *= 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
        grads["candidate"] += d_fresh @ (reset * h).T
        grads["gates"] += d_gates @ h.T
        carried = after * (1 - update) + d_held * reset + d.gates.T @ d_gates
        rows[i, : 2 * n], rows[i, 2 * n :] = d_gates, d_fresh
    order = np.array([t for t, *_ in reversed(kept)])
    np.add.at(grads["inputs"], codes[order].ravel(), rows.transpose(0, 2, 1).reshape(-1, 3 * n))
    grads["inputs"][PAD] = 0
    return grads


def train(texts: list[str], langs: list[str], seed: int = 17) -> Network | None:
    """Fit the network to labelled texts; None if there is nothing to learn from."""
    names = sorted(set(langs))
    samples = [(t.encode(), names.index(x)) for t, x in zip(texts, langs) if t.strip()]
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    by_class = [[b for b, y in samples if y == k] for k in range(len(names))]
    present = [k for k, b in enumerate(by_class) if b]

    def direction() -> Direction:
        inputs = rng.normal(0, 0.3, (257, 3 * HIDDEN)).astype(F32)
        inputs[:, :HIDDEN] -= 0.5
        inputs[PAD] = 0
        inputs[PAD, :HIDDEN] = -1e6  # the update gate is shut: a pad leaves the state as it is
        return Direction(
            inputs,
            rng.normal(0, 0.3, (2 * HIDDEN, HIDDEN)).astype(F32),
            rng.normal(0, 0.3, (HIDDEN, HIDDEN)).astype(F32),
            rng.normal(0, 0.3, (len(names), HIDDEN)).astype(F32),
        )

    net = Network(names, direction(), direction(), np.zeros((len(names), 1), F32))
    moments: dict[tuple[int, str], list[np.ndarray]] = {}
    for number in range(1, TRAIN_STEPS + 1):
        labels = rng.choice(present, TRAIN_BATCH)
        codes = np.full((TRAIN_WINDOW, TRAIN_BATCH), PAD)
        for i, y in enumerate(labels):
            text = by_class[y][rng.integers(len(by_class[y]))]
            begin = rng.integers(max(1, len(text) - TRAIN_WINDOW + 1))
            part = np.frombuffer(text[begin : begin + TRAIN_WINDOW], np.uint8)
            if number % 3 == 0:  # some short ones
                part = part[: rng.integers(4, TRAIN_WINDOW)]
            codes[: len(part), i] = part
        states, kept = np.empty((2, TRAIN_WINDOW, HIDDEN, TRAIN_BATCH), F32), ([], [])
        unroll(net.forward, codes, states[0], range(TRAIN_WINDOW), kept[0])
        unroll(net.backward, codes, states[1], range(TRAIN_WINDOW - 1, -1, -1), kept[1])
        slope = softmax(net.forward.head @ states[0] + net.backward.head @ states[1] + net.bias)
        real = (codes != PAD).astype(F32)[:, None, :]
        np.subtract.at(slope, (slice(None), labels, np.arange(TRAIN_BATCH)), 1)
        slope *= real / real.sum()
        rate = 0.02 * min(1.0, 2 * (1 - number / (TRAIN_STEPS + 1)))
        grads = [(2, net.__dict__, {"bias": slope.sum(axis=(0, 2))[:, None]})]
        for k, d in enumerate((net.forward, net.backward)):
            found = backpropagate(d, codes, d.head.T @ slope, kept[k])
            found["head"] = np.einsum("tlb,thb->lh", slope, states[k])
            grads.append((k, d.__dict__, found))
        for k, weights, found in grads:
            for name, grad in found.items():
                m, v = moments.setdefault((k, name), [np.zeros_like(grad), np.zeros_like(grad)])
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                weights[name] -= (rate * (m / (1 - 0.9**number)) / (np.sqrt(v / (1 - 0.99**number)) + 1e-6)).astype(F32)
    return net


def probabilities(net: Network, texts: pa.Array) -> np.ndarray:
    """Mean language distribution over the bytes of each text; zeros for an empty text."""
    held = texts_of(texts)
    sizes = np.diff(held.offsets)
    pieces = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), pieces)
    limits = np.r_[0, np.cumsum(pieces)]
    begin = held.offsets[owner] + WINDOW * (np.arange(limits[-1]) - limits[owner])
    lengths = np.minimum(WINDOW, held.offsets[owner + 1] - begin)
    data = np.r_[held.data, np.zeros(WINDOW, np.uint8)]
    order = np.argsort(-lengths, kind="stable")
    sums = np.zeros((len(net.langs), len(owner)))
    states = np.empty((WINDOW, HIDDEN, COLUMNS), F32)
    for at in range(0, len(order), COLUMNS):
        group = order[at : at + COLUMNS]
        span = int(lengths[group[0]])
        steps = np.arange(span)[:, None]
        codes = data[begin[group] + steps].astype(np.int64)
        if lengths[group[-1]] < span:
            codes[steps >= lengths[group]] = PAD
        own = states[:span, :, : len(group)]
        unroll(net.forward, codes, own, range(span))
        h = np.zeros((HIDDEN, len(group)), F32)
        spare = np.empty((2 * HIDDEN, len(group)), F32)
        total = np.zeros((len(net.langs), len(group)), F32)
        for t in range(span - 1, -1, -1):
            h = step(net.backward, codes[t], h, spare)[2]
            at_byte = net.forward.head @ own[t]
            at_byte += net.backward.head @ h
            at_byte += net.bias
            at_byte = softmax(at_byte)
            if lengths[group[-1]] <= t:
                at_byte[:, lengths[group] <= t] = 0
            total += at_byte
        sums[:, group] = total
    out = np.stack([np.bincount(owner, row, len(sizes)) for row in sums], axis=1)
    return out / np.maximum(sizes, 1)[:, None]


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 1 on division by 3; a null id is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame) -> Network | None:
    """Train on the bounded sample of the labelled documents that are not held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    narrow = known.select(F.col("doc_id").alias("__id"), "lang")
    common = narrow.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).select("lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("__id"), "__id")
    chosen = narrow.join(F.broadcast(common), "lang").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= TRAIN_DOCS)
    # At most TRAIN_DOCS * MAX_LANGS ids.
    texts = known.join(F.broadcast(chosen.select("__id").distinct()), F.col("doc_id") == F.col("__id"), "left_semi")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    rows = texts.select("doc_id", "lang", F.col("text").substr(start, F.lit(TRAIN_CHARS)).alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def decide(net: Network | None, texts: pa.Array, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicted language and score of each text."""
    if net is None:
        return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    chances = probabilities(net, texts)
    best = chances.argmax(axis=1)
    langs = np.where(letters, np.array(net.langs, object)[best], UNKNOWN)
    return langs, np.where(letters, np.clip(chances[np.arange(len(best)), best], 0, 1), 0.0)


def predictions(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row, from a network trained on ``docs`` itself.

    Null texts and texts without a letter give ``und`` with score 0, as does a table without labelled
    texts. Rows with a null id are predicted but not learned from; repeated rows are predicted alike. An
    empty table gives no row; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang")])
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                letters = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
                langs, scores = decide(sent.value, part.column("text"), letters)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out().alias("held_out"), letters.alias("letters"), "text")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def recognised(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is recognised with at least this score.

    ``lang`` is only learned from. Texts that are null or without letters go.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang")))
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                _, scores = decide(sent.value, part.column("text"), np.ones(part.num_rows, bool))
                yield part.filter(pa.array(scores >= least))

    return lettered.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`."""
    return predictions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
