"""Ties, large groups, concurrent commits and held-out figures against plain versions."""

import math
import random
from fractions import Fraction
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import demand as D
from marketloom.operators import entities as E
from marketloom.operators import files as FI
from marketloom.operators import insight as N
from marketloom.operators import models as MO
from marketloom.operators import neighbours as NB
from marketloom.operators import ranking as R
from marketloom.sources import store


def test_last_so_far_takes_ties_and_crosses_cells(spark):
    rng = random.Random(3)
    clicks = [(i, rng.choice("ab"), rng.randint(0, 40) * 9000, float(i)) for i in range(60)]
    asked = [(100 + i, rng.choice("abc"), rng.randint(0, 40) * 9000) for i in range(60)] + [(300, "a", -1), (301, "a", None)]
    at = lambda c: F.timestamp_seconds(c)
    left = spark.createDataFrame(asked, "event_id long, user string, ts long").withColumn("ts", at("ts"))
    right = spark.createDataFrame([*clicks, (999, "a", None, 1.0)], "event_id long, user string, seen long, value double").withColumn("seen", at("seen"))
    got = {r["event_id"]: r["value"] for r in R.last_so_far(left, right, ["user"], "ts", "seen", ["event_id"]).collect()}
    want = {i: max(((s, e, v) for e, u, s, v in clicks if u == user and t is not None and s <= t), default=(0, 0, None))[2] for i, user, t in asked}
    assert got == want


def test_block_of_hundreds_is_paired_whole(spark):
    df = spark.createDataFrame([(i, "x") for i in range(600)], "id long, block string")
    pairs = E.block_pairs(df, "id", ["block"])
    assert pairs.count() == pairs.distinct().count() == 600 * 599 // 2


def test_similar_pairs_ask_for_all_rows(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(90, 4))
    df = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    u = m / np.sqrt((m * m).sum(axis=1))[:, None]
    cos = u @ u.T
    np.fill_diagonal(cos, -2)
    want = {tuple(sorted((i + 1, int(j) + 1))) for i in range(90) for j in np.argsort(-cos[i])[:3] if cos[i, j] >= 0.9}
    assert {tuple(r) for r in NB.similar_pairs(df, 3, 0.9).collect()} == want


def test_two_commits_at_once_keep_both_tables(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/b"
    first = store.Batch(spark, root)
    first.write("old", spark.range(1))
    first.commit()
    seen = store.latest_manifest(spark, root)
    monkeypatch.setattr(store, "latest_manifest", lambda *_: seen)  # neither sees the other
    for name, n in (("x", 2), ("y", 3)):
        b = store.Batch(spark, root)
        b.write(name, spark.range(n))
        b.commit()
    monkeypatch.undo()
    assert [store.read_batch(spark, root, n).count() for n in ("old", "x", "y")] == [1, 2, 3]
    newer = store.Batch(spark, root)
    newer.write("x", spark.range(7))
    newer.commit()
    assert store.read_batch(spark, root, "x").count() == 7 and store.read_batch(spark, root, "y").count() == 3


def test_binomial_of_any_counts():
    cases = [(k, n) for n in (1, 2, 7, 40, 300) for k in (0, 1, n // 2, n - 1, n, n + 1)]
    want = [float(sum(Fraction(math.comb(n, i), 2**n) for i in range(max(k, 0), n + 1))) for k, n in cases]
    got = N.exact_binomial(pd.Series([k for k, _ in cases]), pd.Series([n for _, n in cases]))
    assert got.tolist() == pytest.approx(want, rel=1e-9)
    big = N.exact_binomial(pd.Series([500_500_000, None]), pd.Series([1_000_000_000, 5]))
    assert big[0] == pytest.approx(1 - NormalDist().cdf((500_500_000 - 0.5 - 5e8) / math.sqrt(2.5e8)), rel=1e-3, abs=1e-12) and math.isnan(big[1])


def test_inverse_normal(spark):
    ps = [1e-12, 1e-5, 0.02, 0.03, 0.3, 0.5, 0.7, 0.98, 1 - 1e-5]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(MO.inverse_normal(F.col("p")).alias("z"))
    got = [r["z"] for r in df.collect()]
    assert got[:-2] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-8, abs=1e-9) and got[-2:] == [None, None]


def test_auc_counts_pairs(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 30) / 20000, rng.random() < 0.5) for _ in range(120)]
    hits, misses = [s for s, h in rows if h], [s for s, h in rows if not h]
    want = sum((a > b) + (a == b) / 2 for a in hits for b in misses) / len(hits) / len(misses)
    assert D.auc(spark.createDataFrame(rows, "s double, h boolean"), "s", "h").first()["auc"] == pytest.approx(want)


def test_held_out_figures_of_a_planted_model(spark):
    rng, ladder = np.random.default_rng(6), (50.0, 100.0, 200.0, 400.0, 800.0, 1600.0)
    rows = []
    for i in range(1500):
        x = float(rng.normal())
        units = math.exp(4.5 + 1.0 * x + 0.5 * rng.normal())
        k = sum(r <= units for r in ladder)
        rows.append((i, x, ladder[k - 1] if k else None, ladder[k - 1] if k else 0.0, ladder[k] if k < len(ladder) else None))
    df = spark.createDataFrame(rows, "id long, price double, x double, low double, high double")
    df, names = D.design(df, ["price"])
    got = D.cross_validate(df, "id", "x", "low", "high", names, ladder).first()
    assert got["rows"] == 1500 and got["badged"] == sum(r[2] is not None for r in rows)
    assert got["auc"] > 0.9 and 0.35 < got["rung_exact"] < 0.8 and got["rung_within_one"] > 0.9
    assert 0.7 < got["coverage_80"] <= 0.95 and 0.9 < got["coverage_95"] <= 1.0
    whole = D.fit_intervals(df, "low", "high", names)
    assert whole.beta[0] == pytest.approx(4.5, abs=0.1) and whole.beta[1] == pytest.approx(1.0, abs=0.1) and whole.sd == pytest.approx(0.5, abs=0.1)


def test_requests_with_words_of_limit():
    assert FI.parse_request("less than $20.50 rope, at least 4.5 stars") == {"min_rating": 4.5, "max_price": 20.5, "keywords": ["rope", "at", "least"]}
    assert FI.parse_request("nuts 5-10 over the hill") == {"min_price": 5.0, "max_price": 10.0, "keywords": ["nuts", "over", "hill"]}
    assert FI.parse_request("cord above 7", limits={"min_price": ("above",)}) == {"min_price": 7.0, "keywords": ["cord"]}
