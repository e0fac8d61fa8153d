"""Shared lists against brute force, early ends, odd input."""

import math

import numpy as np
import pytest

from logspark.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label string, id int, x string, chunk int, score int"


def brute(rows, every=10, positives=5, negatives=5, least=80, scale=256):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        one = (label, [math.floor(float(np.float32(x)) * scale) for x in v])
        held[i] = min(held.get(i, one), one)
    out = set()
    for a, (label, v) in held.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in held.items() if i != a]
        scored.sort()
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            fit = [r for r in scored if not r[2] and least * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out.update((a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(fit, 1))
    return out


def check(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3)
    every = options.pop("every", 10)
    got = H.hard_negatives(frame, anchors=f"id % {every} = 0", **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    want = brute(rows, every, **options)
    assert len(got) == len(set(map(tuple, got))) == len(want) and set(map(tuple, got)) == want
    return want


def vectors(n, width, seed, kinds=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(int(i), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(scale=0.6, size=width)], "abcdefgh"[int(rng.integers(kinds))]) for i in rng.permutation(n)]


def test_against_brute_force(spark, monkeypatch):
    for name, size in (("CHUNK", 90), ("HEAD", 16), ("STEP", 8), ("BLOCK", 7), ("CLUSTERS", 3)):
        monkeypatch.setattr(H, name, size)
    assert len(check(spark, vectors(400, 9, 1))) > 300


def test_other_numbers(spark):
    assert check(spark, vectors(200, 6, 2), every=7, positives=2, negatives=9, least=30, scale=50)


def test_odd_rows_and_ties(spark, monkeypatch):
    monkeypatch.setattr(H, "STEP", 4)
    monkeypatch.setattr(H, "HEAD", 4)
    rows = [
        (None, [1.0, 2.0], "a"), (10, None, "a"), (20, [1.0, None], "a"), (30, [math.nan, 1.0], "a"), (40, [math.inf, 1.0], "a"), (50, [1.0, 1.0], None),
        (60, [0.0, 0.0], "a"), (70, [-1.0, -1.0], "b"), (80, [1.0, 2.0], "a"), (80, [1.0, 2.0], "a"), (80, [0.5, 2.0], "b"), (-10, [1.0, -1.0], "c"),
        *((100 + i, [1.0, 2.0], "ab"[i % 2]) for i in range(60)), *((1000 + i, [0.9, 2.0], "c") for i in range(50)),
    ]
    assert len(check(spark, rows)) > 100


def test_anchor_without_partners(spark):
    assert check(spark, [(10, [1.0, 1.0], "a"), (11, [1.0, 1.0], "b")]) == set()
    assert check(spark, [(11, [1.0, 1.0], "a"), (12, [1.0, 1.0], "a")]) == set()


def test_empty(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert H.hard_negatives(frame).collect() == []


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        H.hard_negatives(spark.createDataFrame([(100, [1e9] * 8, 1), (200, [1e9] * 8, 1)], "vec_id bigint, embedding array<float>, label int")).collect()


def test_walks_end_early():
    """Candidates in other directions are never scored, and nothing is missed."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(3000, 16)) * 20, 400 + rng.normal(size=(40, 16)) * 20]).round()
    members = (400 + rng.normal(size=(5, 16)) * 10).round()
    ids = np.arange(len(x))
    rows = H.List(x, ids, np.zeros(len(x), int), members)
    wants = H.Wants(np.arange(5), np.full(5, H.LOWEST), np.full(5, H.HIGHEST), True, 5)
    want, score, found = wants.walk(rows, members, -1 - np.arange(5), np.zeros(5, int), len(x))
    assert wants.computed <= 5 * 2 * H.STEP
    for i in range(5):
        all_ = sorted(zip(-(x @ members[i]), ids))[:5]
        assert [(-s, k) for s, k in zip(score[want == i], found[want == i])] == all_


def test_blocks_meet_many_chunks(spark, monkeypatch):
    """A block goes once to a shard, however many chunks that has, and a task sorts blocks and chunks, not their pairs."""
    for name, size in (("CHUNK", 20), ("HEAD", 8), ("STEP", 4), ("BLOCK", 7), ("CLUSTERS", 3), ("SHARDS", 3), ("GROUP", 2)):
        monkeypatch.setattr(H, name, size)
    sent = []
    frame = type(spark.range(0))
    whole = frame.mapInArrow

    def counted(self, run, schema, *a, **b):
        if schema.startswith("anchor bigint"):
            sent.append(self.count())
        return whole(self, run, schema, *a, **b)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    assert check(spark, vectors(400, 9, 4), every=5)
    chunks, blocks = 400 // 20, 80 / 7
    assert len(sent) == 4 and max(sent) < blocks * chunks


def test_walks_carry_over():
    """What was found on one list ends the walk of the next and is merged with it."""
    x = np.array([[9.0, 0], [8, 0], [1, 0], [10, 0], [2, 0], [3, 0]])
    own, wants = np.array([[1.0, 0]]), H.Wants(np.zeros(1, int), np.array([H.LOWEST]), np.array([H.HIGHEST]), True, 2)
    for part in (slice(0, 3), slice(3, 6)):
        ids = np.arange(6)[part]
        want, score, found = wants.walk(H.List(x[part], ids, np.zeros(3, int), own), own, np.array([-1]), np.zeros(1, int), 3)
    assert [*want] == [0, 0] and [*score] == [10, 9] and [*found] == [3, 0]
