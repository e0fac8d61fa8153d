"""Cover-tree Lloyd against plain Lloyd, tree invariants, odd input."""

import hashlib
import math

import numpy as np
import pytest

from logspark.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, part int, __label int, error bigint"


def plain(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS, scale=V.SCALE):
    """Every vector against every entry, by Python numbers."""
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(groups[k]) for x in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cut):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return [(i, code, error, by_label[label], sha) for i, code, error, label in out]


def check(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = V.vector_codes(frame, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, **options), key=key)


def vectors(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, width))
    return [(int(i), [float(np.float32(x)) for x in centres[i % 7] + rng.normal(scale=0.2, size=width)], int(i % 5)) for i in rng.permutation(n)]


def test_against_plain_lloyd(spark, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 70)
    check(spark, vectors(400, 16, 1))


def test_other_sizes(spark):
    check(spark, vectors(150, 12, 2), parts=3, entries=5, rounds=2, scale=50)


def test_odd_rows(spark):
    same = [0.25, -0.5, 0.1, 1e-9, -1e-9, 3.0, 0.0, -0.0]
    rows = [
        (None, same, None), (None, [1.0] * 8, 1), (1, None, 1), (2, [0.0] * 7 + [None], 1), (3, [0.0] * 7 + [math.nan], 1), (4, [math.inf] * 8, 1), (5, same, None),
        (5, same, None), (6, same, 2), (6, [2.0] * 8, 2), *((100 + i, same, 3) for i in range(40)),
    ]
    check(spark, rows)


def test_other_lengths_are_left_out(spark):
    rows = [(1, [1.0] * 8, 1), (2, [2.0] * 16, 1), (3, [2.0] * 7, 1), (4, [], 1), (5, [3.0] * 8, 1)]
    got = V.vector_codes(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    assert sorted(r.vec_id for r in got) == [1, 5]


def test_empty(spark):
    frame = spark.createDataFrame([(1, None, 1, None, None, None, None)], SCHEMA)
    assert V.vector_codes(frame).collect() == [] and V.vector_codes(frame.limit(0)).collect() == []


def test_too_large(spark):
    with pytest.raises(Exception, match="larger than"):
        V.vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id bigint, embedding array<float>, label int")).collect()


def test_tree_covers_and_separates():
    points = np.random.default_rng(5).integers(-50, 50, size=(900, 3))
    tree = V.build(points)
    assert (tree.points[tree.slot] == points).all() and tree.counts[-1] == 900
    for i, (lo, hi) in enumerate(zip(tree.lo, tree.hi)):
        far = V.squared(tree.points[lo:hi], tree.points[tree.centre[i]])
        assert lo <= tree.centre[i] < hi and np.sqrt(far.max()) <= tree.radius[i]
        if tree.child[i] >= 0:
            kids = np.arange(tree.child[i], tree.child[i] + tree.children[i])
            assert tree.lo[kids[0]] == lo and tree.hi[kids[-1]] == hi and (tree.hi[kids[:-1]] == tree.lo[kids[1:]]).all()
            apart = np.sqrt(V.squared(tree.points[tree.centre[kids]][:, None], tree.points[tree.centre[kids]][None])) + 1e9 * np.eye(len(kids))
            assert (tree.radius[kids] <= tree.radius[i] / 2 + 1e-9).all() and apart.min() > tree.radius[i] / 2 - 1e-9


def test_whole_subtrees_are_assigned():
    """Far entries: a few tight groups go as a whole."""
    rng = np.random.default_rng(6)
    groups = rng.integers(-10000, 10000, size=(6, 4))
    points = np.concatenate([g + rng.integers(-20, 20, size=(300, 4)) for g in groups])
    lo, hi, entry, compared = V.assign(V.build(points), groups.astype(np.int64))
    assert compared < 100 and (hi - lo).sum() == len(np.unique(points, axis=0)) and set(entry) == set(range(6))
