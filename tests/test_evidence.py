"""Stability, gaps, forecasts, refits and taxonomies against plain versions and planted cases."""

import math
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from marketloom.operators import demand as D
from marketloom.operators import evidence as V
from marketloom.operators import forecast as FC
from marketloom.operators import taxonomy as X
from marketloom.operators.scores import LADDER, observation_interval, rule_checks


def test_rank_stability_of_a_clear_order_and_of_a_tie(spark):
    rows = [("a", 1.0, 1.0), ("b", 0.8, 0.8), ("c", 0.5, 0.6), ("d", 0.6, 0.5), ("e", None, 0.1), ("f", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r for r in V.rank_stability(df, "k", {"x": 0.5, "y": 0.5}, draws=40).collect()}
    assert set(got) == set("abcde")
    assert [got[k]["place"] for k in "abcde"] == [1, 2, 3, 3, 5]
    assert (got["a"]["best"], got["a"]["worst"], got["a"]["top3"]) == (1, 1, 1.0)
    assert (got["c"]["best"], got["c"]["worst"]) == (got["d"]["best"], got["d"]["worst"]) == (3, 4)
    assert math.isclose(got["c"]["top3"] + got["d"]["top3"], 1.0) and got["e"]["best"] == 5
    assert 0.9 < got["a"]["spearman"] < 1
    assert V.rank_stability(df.limit(0), "k", {"x": 1.0}, draws=5).count() == 0


def _market(spark, n=1200):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = ["plain"] if i % 2 else ["plain", "twin", "other twin"]
        strong = bool(i % 3 == 0)
        words += ["strong"] * strong
        rows.append((i, "hot" if i % 4 else "cold", words, float(rng.gamma(2.0, 20.0) * (2.5 if strong else 1))))
    rows += [(n + 1, "hot", None, 5.0), (n + 2, "hot", ["strong"], None), (n + 3, "tiny", ["strong"], 1.0)]
    return rows, spark.createDataFrame(rows, "id long, g string, features array<string>, units double")


def test_gaps_find_the_planted_feature_and_name_aliases(spark):
    rows, df = _market(spark)
    got = {(r["g"], r["feature"]): r for r in V.gap_analysis(df, "id", "g", "features", "units", reps=200).collect()}
    assert {f for g, f in got if g == "hot"} == {"strong", "twin"} and got["hot", "twin"]["aliases"] == ["other twin"]
    for g in ("hot", "cold"):
        r = got[g, "strong"]
        assert r["gap"] and r["low"] < r["lift"] < r["high"] and r["low"] > 1.8 and r["p"] < 1e-6
    assert not got["hot", "twin"]["gap"]
    # lift and interval are about those of a plain bootstrap over listings
    rng = np.random.default_rng(0)
    for g in ("hot", "cold"):
        own = [(u, "strong" in (w or [])) for _, k, w, u in rows if k == g and u is not None]
        u, s = np.array([u for u, _ in own]), np.array([s for _, s in own])
        assert math.isclose(got[g, "strong"]["lift"], u[s].mean() / u[~s].mean())
        plain = []
        for _ in range(400):
            at = rng.integers(0, len(u), len(u))
            plain.append(u[at][s[at]].mean() / u[at][~s[at]].mean())
        assert np.allclose([got[g, "strong"]["low"], got[g, "strong"]["high"]], np.percentile(plain, [2.5, 97.5]), rtol=0.06)
    assert V.gap_analysis(df.limit(0), "id", "g", "features", "units", reps=30).count() == 0


def test_forecast_of_lines_and_walks():
    line = np.arange(10.0) * 3 + 5
    paths = {name: path for name, _, path in FC.paths(line, 4, FC.orders())}
    assert set(paths) == {"moving_average", "linear_trend", "damped_trend", "autoregression"} and len(FC.orders()) == 8
    assert np.allclose(paths["linear_trend"], [35, 38, 41, 44]) and np.allclose(paths["moving_average"], 29)
    assert abs(paths["damped_trend"][0] - 35) < 1
    assert [name for name, *_ in FC.paths(line[:4], 1, FC.orders())] == ["moving_average", "linear_trend", "damped_trend"]
    rng = np.random.default_rng(1)
    noise, y = rng.normal(size=400), [0.0]
    for e in noise:
        y.append(0.7 * y[-1] + e)
    aic, path = FC._arma(np.array(y) + 50, 5, (1, 0, 0))
    z = np.array(y) - np.mean(y)
    step = (path - 50 - np.mean(y))[1:] / (path - 50 - np.mean(y))[:-1]
    assert np.allclose(step, (z[1:] @ z[:-1]) / (z[:-1] @ z[:-1]), atol=1e-3)  # least squares
    assert aic < FC._arma(np.array(y) + 50, 5, (0, 1, 0))[0]
    walk = np.cumsum(noise) + 100
    ma = np.cumsum(noise[1:] + 0.6 * noise[:-1]) + 100
    assert FC._arma(ma, 3, (0, 1, 1))[0] < FC._arma(ma, 3, (0, 1, 0))[0] and FC._arma(walk, 3, (0, 1, 0))[1].tolist() == [walk[-1]] * 3


def test_forecast_series_states_history_and_backtest(spark):
    rng = np.random.default_rng(5)
    wild = [float(v) for v in 50 + 30 * rng.normal(size=9)]
    rows = [("flat", i, 10.0) for i in range(14)] + [("short", 0, 1.0), ("short", 1, 2.0), ("short", 2, None), (None, 1, 1.0), ("zero", 1, 0.0), ("zero", 2, 0.0), ("zero", 3, 0.0)] + [("wild", i, v) for i, v in enumerate(wild)]
    got = {r["k"]: r for r in FC.forecast_series(spark.createDataFrame(rows, "k string, t int, y double"), "k", "t", "y").collect()}
    assert set(got) == {"flat", "short", "zero", "wild"}
    assert (got["short"]["status"], got["short"]["periods"], got["short"]["forecast"], got["short"]["confidence"]) == ("insufficient_history", 2, None, None)
    flat = got["flat"]
    assert flat["confidence"] == "HIGH" and flat["mape"] < 1e-9 and abs(flat["growth"]) < 1e-9 and np.allclose(flat["forecast"], 10) and len(flat["forecast"]) == 12
    assert got["zero"]["growth"] is None and got["zero"]["mape"] is None and got["zero"]["confidence"] == "LOW"
    mean = lambda n, h: np.mean([p for *_, p in FC.paths(np.array(wild[:n]), h, FC.orders())], axis=0)
    r = got["wild"]
    assert math.isclose(r["mape"], np.mean([abs(mean(n, 1)[0] - wild[n]) / wild[n] for n in (6, 7, 8)])) and np.allclose(r["forecast"], mean(9, 12))
    assert math.isclose(r["growth"], mean(9, 12).mean() / np.mean(wild) - 1) and math.isclose(r["slope"], np.polyfit(np.arange(9), wild, 1)[0]) and r["model"] in {"({},{},{})".format(*o) for o in FC.orders()}


def test_refits_cover_the_planted_coefficients(spark):
    rng = np.random.default_rng(8)
    size = rng.normal(size=500)
    units = np.exp(4.5 + 0.8 * size + 0.9 * rng.normal(size=500))
    shown = [max((r for r in LADDER if r <= u), default=None) for u in units]
    df = spark.createDataFrame(list(zip(range(500), size.tolist(), shown, strict=True)), "id long, size double, x double")
    low, high = observation_interval("x")
    df, names = D.design(df.withColumns({"low": low, "high": high}), ["size"])
    got = {r["term"]: r for r in V.refit_demand(df, "id", D.fit_intervals(df, "low", "high", names), LADDER, reps=40).collect()}
    for term, true in (("intercept", 4.5), ("size", 0.8), ("sd", 0.9)):
        assert got[term]["low"] < true < got[term]["high"] and abs(got[term]["corrected"] - true) < 0.15, got[term]
        assert got[term]["high"] - got[term]["low"] < 0.6


def test_natural_breaks_are_the_best_cuts():
    rng = np.random.default_rng(3)
    for _ in range(25):
        values, counts = np.arange(8.0), rng.integers(1, 4, 8)
        sums = rng.normal(size=8)
        n = np.concatenate([[0], np.cumsum(counts)])
        s = np.concatenate([[0], np.cumsum(sums)])

        def worth(cuts):
            at = [0, *cuts, 8]
            return sum((s[b] - s[a]) ** 2 / (n[b] - n[a]) if n[b] - n[a] >= 3 else -np.inf for a, b in zip(at, at[1:]))  # noqa: B023

        best = max(worth(c) for k in (1, 2, 3) for c in combinations(range(1, 8), k))
        got = X.natural_breaks(values, counts, sums, 3, 4)
        assert math.isclose(worth([int(c + 0.5) for c in got]), best, abs_tol=1e-9) if np.isfinite(best) else got == []
    assert X.natural_breaks(np.array([1.0]), np.array([9]), np.array([0.0]), 3, 4) == []


def test_f_tail_agrees_with_permutations():
    rng = np.random.default_rng(6)
    for size, tilt in ((40, 0.4), (300, 0.15)):
        group = rng.integers(0, 3, size)
        x = rng.normal(size=size) + tilt * group
        x -= x.mean()
        share = lambda v: sum((group == g).sum() * v[group == g].mean() ** 2 for g in range(3)) / (v**2).sum()  # noqa: B023, E731
        drawn = np.mean([share(rng.permutation(x)) >= share(x) - 1e-9 for _ in range(4000)])
        assert abs(X.f_tail(np.array([share(x)]), np.array([3.0]), np.array([float(size)]))[0] - drawn) < 0.02
    assert X.f_tail(np.array([0.0, 1.0]), np.array([2.0, 2.0]), np.array([10.0, 10.0])).tolist() == [1.0, 0.0]


def test_taxonomy_takes_planted_levels(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        kind, power = ("saw" if i % 2 else "drill"), float(rng.integers(1, 40))
        price = (200.0 if kind == "saw" else 20.0) * (1.8 if power >= 20 else 1.0) * math.exp(0.05 * rng.normal())
        rows.append((i, price, kind, f"shade {rng.integers(0, 3)}", power))
    rows += [(900, 30.0, None, None, None), (901, None, "saw", "shade 1", 3.0), (902, 10.0, "rare", None, float("nan"))]
    df = spark.createDataFrame(rows, "id long, price double, kind string, shade string, power double")
    tree, ranking = X.discover_taxonomy(df, "id", "price", ["kind", "shade"], ["power"])
    nodes = {r["node"]: r for r in tree.collect()}
    assert {n for n, r in nodes.items() if r["depth"] == 1} == {"kind=drill", "kind=saw", "kind=other"}
    assert nodes["kind=other"]["products"] == 2 and nodes["kind=other"]["eta2"] is None and nodes["kind=saw"]["products"] == 201
    assert {r["dim"] for n, r in nodes.items() if r["parent"] == "kind=saw"} == {"power"}
    cut = [r["label"] for r in nodes.values() if r["parent"] == "kind=saw"]
    assert any("19.5" in c for c in cut)
    root = {r["dim"]: r for r in ranking.where("depth = 1").collect()}
    assert root["kind"]["chosen"] and not root["shade"]["meaningful"] and root["kind"]["eta2"] > 0.8 and root["kind"]["p"] < 0.02
    empty, none = X.discover_taxonomy(df.limit(0), "id", "price", ["kind"], ["power"], depth=2)
    assert empty.count() == none.count() == 0


def test_rule_checks_skip_the_unknown_and_name_the_worst(spark):
    facts = spark.createDataFrame([(1.0, None, 5.0)], "a double, b double, c double")
    rules = [("fine", F.col("a"), F.col("a") == 1, "fail"), ("unknown", F.col("b"), F.col("b") > 0, "fail"), ("odd", F.col("c"), F.col("c") < 3, "warn")]
    got = {r["check"]: (r["value"], r["status"]) for r in rule_checks(facts, rules).collect()}
    assert got == {"fine": (1.0, "pass"), "odd": (5.0, "warn"), "all": (1.0, "warn")}
    assert [tuple(r) for r in rule_checks(facts, rules[1:2]).collect()] == [("all", 0.0, "pass")]
