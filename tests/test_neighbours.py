"""The metric index for neighbours against all cosines; what it visits; hot cells and equal vectors."""

import numpy as np
import pytest

from marketloom.operators import neighbours as NB

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], SCHEMA).repartition(4)


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], "f8")
    cos = np.round((m / np.linalg.norm(m, axis=1)[:, None]) @ (m / np.linalg.norm(m, axis=1)[:, None]).T, 12)
    at = {i: n for n, i in enumerate(ids)}
    return {q: [int(ids[j]) for j in np.lexsort((ids, -cos[at[q]])) if ids[j] != q][:k] for q in queries}


def places(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["place"]):
        out.setdefault(r["query"], []).append(r["vec_id"])
    return out


def clusters(n, dim=8, groups=40, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    return [(i, centers[i % groups] + rng.normal(size=dim) * 0.05) for i in range(n)]


def test_equals_all_cosines(spark):
    rows = clusters(1500) + [(5000 + i, v) for i, v in enumerate(np.random.default_rng(1).normal(size=(500, 8)))]
    ask = [i for i, _ in rows if i % 7 == 0]
    df = frame(spark, [*rows, (9000, None), (9001, [0.0] * 8), (9002, [None] + [1.0] * 7), (9003, [float("nan")] * 8)])
    assert places(NB.nearest_vectors(df.where("vec_id % 7 = 0"), df, 5)) == brute(rows, ask, 5)


@pytest.mark.parametrize("dim", [16, 64])
def test_proportional_vectors_tie(spark, dim):
    """They differ in the last bit once they are of length one, and yet the smaller ids win."""
    rng = np.random.default_rng(dim)
    base = rng.normal(size=dim)
    rows = [(i, base * rng.uniform(0.1, 9)) for i in range(60)] + [(100 + i, v) for i, v in enumerate(rng.normal(size=(600, dim)))]
    df = frame(spark, rows)
    found = places(NB.nearest_vectors(df.where("vec_id < 60"), df, 5))
    assert found == {i: [j for j in range(6) if j != i][:5] for i in range(60)}


def test_equal_vectors_and_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(700)] + [(1000 + i, v) for i, v in enumerate(rng.normal(size=(60, 3)))]
    df = frame(spark, rows + rows[:50] + rows[:50])
    found = places(NB.nearest_vectors(df, df, 3))
    assert found == brute(rows, [i for i, _ in rows], 3)


def test_few_rows_and_none(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    assert places(NB.nearest_vectors(df, df, 5)) == {1: [2], 2: [1]}
    assert NB.nearest_vectors(df.limit(0), df, 5).count() == 0 and NB.nearest_vectors(df, df.limit(0), 5).count() == 0


def test_a_hot_cell_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(NB, "BLOCK", 16)
    monkeypatch.setattr(NB, "ASKS", 8)
    rows = [(i, np.array([1.0, 1e-3 * i, 1e-4 * (i * 7 % 50)])) for i in range(400)] + [(1000 + i, v) for i, v in enumerate(np.random.default_rng(2).normal(size=(40, 3)))]
    df = frame(spark, rows)
    assert places(NB.nearest_vectors(df, df, 4)) == brute(rows, [i for i, _ in rows], 4)


def test_work_grows_less_than_the_table(spark):
    """Vectors that a query is compared with, on clusters that stay as many: four times the rows, less than three times the products."""
    seen = {}
    for n in (2000, 8000):
        df = NB.unit_vectors(frame(spark, clusters(n, groups=80)))
        cells, placed = NB.into_cells(df)
        asked = df.where("id % 10 = 0").selectExpr("id AS rep", "v")
        near = NB.visits(cells, asked, 6)
        rest = NB.visits(cells, asked, 6, NB._search(cells, placed, near, 6))
        seen[n] = sum(int(cells.sizes[r["visits"]].sum()) for part in (near, rest) for r in part.collect()) / (n / 10)
    assert seen[8000] < 3 * seen[2000] and seen[8000] < 8000 / 10
