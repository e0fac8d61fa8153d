"""Outliers by covariance against numpy; correlation with few services a tile."""

import numpy as np

from logspark.operators import anomaly, topology


def test_mahalanobis_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3)) @ np.array([[2.0, 1, 0], [0, 0.3, 5], [0, 0, 0.1]]) + [1, 2, 3]
    x[:5] += [[3, -3, 0], [0, 9, 0], [9, 9, 9], [0, 0, 60], [-9, 4, 1]]
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0)], "id INT, a DOUBLE, b DOUBLE, c DOUBLE")
    off = x - x.mean(axis=0)
    want = np.sqrt(np.einsum("ni,ij,nj->n", off, np.linalg.inv(np.cov(x.T, bias=True)), off))
    got = {r.id: r.distance for r in anomaly.mahalanobis_outliers(frame, ["a", "b", "c"]).collect()}
    assert sorted(got) == np.flatnonzero(want > 3).tolist() and len(got) >= 4
    assert all(abs(d - want[i]) < 1e-6 for i, d in got.items())


def test_mahalanobis_of_dependent_columns_and_few_rows(spark):
    frame = spark.createDataFrame([(float(i), 2.0 * i) for i in range(50)] + [(500.0, 1000.0)], "a DOUBLE, b DOUBLE")
    assert [r.a for r in anomaly.mahalanobis_outliers(frame, ["a", "b"]).collect()] == [500.0]
    assert anomaly.mahalanobis_outliers(frame.limit(1), ["a", "b"]).count() == 0
    assert anomaly.mahalanobis_outliers(frame.limit(0), ["a", "b"]).count() == 0


def test_cluster_outliers_find_the_far_row(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([c + rng.normal(scale=0.1, size=(100, 2)) for c in ([0, 0], [10, 0], [0, 10], [10, 10])])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(1000, 5.0, 2.0)]
    found = anomaly.cluster_outliers(spark.createDataFrame(rows, "id INT, a DOUBLE, b DOUBLE"), ["a", "b"])
    assert 1000 in {r.id for r in found.collect()} and found.count() < 12


def test_correlation_does_not_depend_on_the_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(f"s{int(s)}", "ERROR", int(t) * 300) for s, t in zip(rng.integers(0, 9, 400), rng.integers(0, 40, 400)) for _ in range(int(rng.integers(1, 4)))]
    logs = spark.createDataFrame(rows, "service STRING, level STRING, t BIGINT").selectExpr("service", "level", "timestamp_seconds(t) AS timestamp")
    key = lambda f: sorted((r.service_a, r.service_b, round(r.strength, 9), r.shared_buckets) for r in f.collect())
    whole = key(topology.correlated_services(logs, min_strength=0.01))
    monkeypatch.setattr(topology, "TILE_SERVICES", 2)
    assert key(topology.correlated_services(logs, min_strength=0.01)) == whole != []
