"""Clustering with bounds against plain rounds in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tellerflow.llm import kmeans, queries
from tellerflow.sources.tables import table


def plain(rows, k, rounds, dims, scale):
    """(id, cluster, distance) of every kept row, and the centroids."""
    kept = []
    for vec_id, row in rows:
        if row is not None and len(row) == dims and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in row):
            kept.append((vec_id, [math.floor(scale * x) for x in row]))
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    mid = [v for i, v in sorted(kept, key=lambda r: (r[0] is None, r[0] is not None and digest(r[0]), r[1]))[:k]]
    far = lambda v, m: sum((x - y) ** 2 for x, y in zip(v, m, strict=True))
    for turn in range(rounds + 1):
        near = [min((far(v, m), c) for c, m in enumerate(mid)) for _, v in kept]
        if turn < rounds:
            for c in range(len(mid)):
                mine = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == c]
                if mine:
                    mid[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return [(i, c, min(d, kmeans.TOP)) for (i, _), (d, c) in zip(kept, near, strict=True)], mid


def check(spark, rows, k=4, rounds=3, dims=3, scale=8.0, kind="array<double>"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").repartition(3)
    found = kmeans.cluster(frame, k, rounds, dims, scale)
    out = kmeans.table_of(found, frame).collect()
    want, mid = plain(rows, k, rounds, dims, scale)
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in out), key=order) == sorted(want, key=order)
    assert found.centroids == mid
    for r in out:
        mine = sum(d for _, c, d in want if c == r.cluster)
        assert r.cluster_inertia == min(mine, kmeans.TOP) and r.inertia == min(sum(d for *_, d in want), kmeans.TOP)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, mid[r.cluster])).encode()).hexdigest()
    return found


def test_any_vectors(spark):
    rng = random.Random(5)
    for spread in (0.1, 1.0, 30.0):
        rows = [(i, [rng.choice([0.0, 5.0, -9.0]) * spread + rng.gauss(0, spread) for _ in range(3)]) for i in range(400)]
        check(spark, rows + rows[:50], k=7)


def test_ties_go_to_the_smaller_number(spark):
    check(spark, [(i, [float(i % 3), 0.0, float(i % 2)]) for i in range(60)], k=9, scale=1.0)
    check(spark, [(i, [1.0, 1.0, 1.0]) for i in range(20)], k=5)


def test_numbers_of_any_size(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.random() * 10.0 ** rng.choice([0, 3, 9, 18, 30]) for _ in range(3)]) for i in range(80)]
    check(spark, rows, k=6)
    check(spark, [(1, [1e300, 0.0, 1.0]), (2, [1.7e308, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, [-1e300, 2.0, 2.0])], k=2)


def test_what_takes_no_part(spark):
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 2.0]), (6, [1.0, float("inf"), 2.0]),
            (7, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0]), (None, [4.0, 2.0, 3.0]), (8, [0.0, 2.0, 3.0]), (7, [9.0, 2.0, 3.0])]
    check(spark, rows, k=3, kind="array<float>")
    check(spark, rows, k=16, kind="array<float>")
    check(spark, rows[:6], kind="array<float>")
    check(spark, [])


def test_extra_columns_may_clash(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], "mine"), (2, [3.0, 4.0], "mine")], "vec_id int, embedding array<double>, at string")
    frame = frame.selectExpr("*", "at AS cluster", "at AS lower", "at AS distance", "at AS was")
    out = kmeans.table_of(kmeans.cluster(frame, 2, 1, 2), frame)
    assert [(r.vec_id, r.distance) for r in out.orderBy("vec_id").collect()] == [(1, 0), (2, 0)] and dict(out.dtypes)["vec_id"] == "int"


@pytest.mark.parametrize("seed", range(20))
def test_bounds_fall_by_enough_and_by_less_than_the_full_drift(seed):
    rng = np.random.default_rng(seed)
    k, dims = 8, 5
    old = rng.integers(-200, 200, (k, dims))
    new = old + rng.integers(-60, 60, (k, dims))
    radius = rng.random(k) * 120
    fall = kmeans.loosening(old.tolist(), new.tolist(), radius.tolist())
    drift = np.sqrt(((new - old) ** 2).sum(1))
    for a in range(k):
        ways = rng.normal(size=(4000, dims))
        ways /= np.sqrt((ways**2).sum(1))[:, None]
        points = old[a] + ways * radius[a] * rng.random((4000, 1)) ** 0.2
        before, after = (np.sqrt(((points[:, None] - at[None]) ** 2).sum(2)) for at in (old, new))
        nearer = np.delete(before - after, a, 1).max()
        full = np.delete(drift, a).max()
        assert nearer <= fall[a] + 1e-6 and fall[a] <= full * (1 + 1e-6)
    assert (fall < 0.999 * np.array([np.delete(drift, a).max() for a in range(k)])).any()


def test_settled_vectors_are_not_scanned(spark):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(40.0 * (i % 4 == j), 1.0) for j in range(4)]) for i in range(800)]
    found = check(spark, rows, k=4, dims=4)
    assert found.scanned[0] == (800, 800) and found.scanned[-1][0] < 400


def test_registered_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    want, _ = plain(rows, 16, 3, 64, 64.0)
    found = queries.QUERIES["op12_centroid_clustering"](spark, sf_dir).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found) == sorted(want)
