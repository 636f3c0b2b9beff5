"""Exact k-means against a brute-force version in Python numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from marketloom.llm import hamerly
from tests.oracle import check


def brute(rows, clusters, rounds, dim, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda k, v=v: (far(v, centroids[k]), k)) for _, v in kept]
        if turn < rounds:
            for k in range(len(centroids)):
                own = [v for (_, v), n in zip(kept, near, strict=True) if n == k]
                if own:
                    centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, k, far(v, centroids[k]), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, v), k in zip(kept, near, strict=True)), key=repr)


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    centers = [[rng.uniform(-2, 2) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centers)]) for i in range(n)]
    rows += [(n + i, list(rows[3][1])) for i in range(40)] + [rows[5], rows[5], (None, rows[7][1])]  # copies, repeated rows, no id
    rows += [(n + 50, None), (n + 51, []), (n + 52, rows[0][1][:-1]), (n + 53, [None, *rows[0][1][1:]]), (n + 54, [math.nan, *rows[0][1][1:]]), (n + 55, [math.inf, *rows[0][1][1:]])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "v", 2.0, 3.0) for r in rows], "vec_id long, embedding array<double>, cluster int, v string, upper double, lower double").repartition(3)


@pytest.mark.parametrize(("n", "dim", "clusters", "rounds"), [(300, 8, 12, 5), (60, 3, 40, 4), (10, 4, 80, 2), (50, 5, 1, 2), (40, 4, 5, 0)])
def test_equals_brute_force(spark, n, dim, clusters, rounds):
    rows = vectors(n, dim)
    out = hamerly.clustered(frame(spark, rows), clusters=clusters, rounds=rounds, dim=dim).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in out), key=repr) == brute(rows, clusters, rounds, dim)
    assert {r["inertia"] for r in out} == {sum(r["distance"] for r in out)}
    for k in {r["cluster"] for r in out}:
        assert {r["cluster_inertia"] for r in out if r["cluster"] == k} == {sum(r["distance"] for r in out if r["cluster"] == k)}


def test_large_components_stay_exact(spark):
    rows = [(i, [float(x) * 2.0**e for x in random.Random(i).choices(range(-9, 9), k=3)]) for e in (0, 18, 20) for i in range(e * 10, e * 10 + 20)]
    out = hamerly.clustered(frame(spark, rows), clusters=7, rounds=3, dim=3).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in out), key=repr) == brute(rows, 7, 3, 3)


def test_bounds_spare_scans():
    rng = np.random.default_rng(1)
    centers = rng.integers(-5000, 5000, (20, 16))
    v = np.repeat(centers, 200, axis=0) + rng.integers(-200, 200, (4000, 16))
    near, upper, lower = hamerly.full_scan(v, centers)
    moved = centers + rng.integers(-5, 6, centers.shape)
    scanned = hamerly.reassign(v, near, upper, lower, moved, np.sqrt(hamerly.own_squared(moved, centers).astype("f8")))
    assert scanned < 40
    assert (near == hamerly.full_scan(v, moved)[0]).all()
    d = np.sqrt(np.sort(hamerly.squared(v, moved), axis=1).astype("f8"))
    assert (upper >= d[:, 0] - 1e-6).all() and (lower <= d[:, 1] + 1e-6).all()


def test_nothing_to_cluster(spark):
    assert hamerly.clustered(frame(spark, [(1, None)]), dim=4).count() == 0
    assert hamerly.clustered(frame(spark, [(1, [1.0])]).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sql(spark):
    check(spark, hamerly.op13_hamerly_kmeans, hamerly.SQL["op13_hamerly_kmeans"])
