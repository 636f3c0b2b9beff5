"""Anchored totals against a search for the factor, and the invariants of every draw."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import anchoring as A

ROWS = "id long, seg string, low double, high double, mean double, price double"
LEVELS = {"segment": "seg", "market": None}


def scaled(e, room, target):
    """The factor by bisection: the mean of min(factor * e, room) rises with it. Where none is enough, those at 0 share the rest."""
    some = sum(x > 0 for x in e)
    if not some or some * room < len(e) * target * (1 - 1e-12):
        return [room if x > 0 else (len(e) * target - (some * room if some else 0.0)) / (len(e) - some) for x in e]
    lo, hi = 0.0, 1.0
    mean = lambda f: sum(min(f * x, room) for x in e) / len(e)
    while mean(hi) < target and hi < 1e15:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < target else (lo, mid)
    return [min(hi * x, room) for x in e]


def expected(rows, draws, weight, inflation):
    out, sims = {}, sorted({s for s, _, _ in draws})
    units = {(s, i): u for s, i, u in draws}
    for level, col in LEVELS.items():
        for g in {(r[1] or A.NO_GROUP) if col else A.ALL for r in rows}:
            of = [r for r in rows if not col or (r[1] or A.NO_GROUP) == g]
            w = {r[0]: ((r[5] or 0.0) if weight else 1.0) for r in of}
            floor, mean = sum(r[2] * w[r[0]] for r in of), sum(r[4] * w[r[0]] for r in of)
            ceiling = sum(0.0 if w[r[0]] == 0 else math.inf if r[3] is None else r[3] * w[r[0]] for r in of)
            e = [max(sum(units[s, r[0]] * w[r[0]] for r in of) - floor, 0.0) for s in sims]
            m = sum(e) / len(e)
            e = scaled([max(m + inflation * (x - m), 0.0) for x in e], ceiling - floor, max(mean - floor, 0.0))
            out |= {(level, g, s): floor + x for s, x in zip(sims, e)}
    return out


def planted(seed, n=40, sims=30, open_share=0.0):
    rng, rows, draws = random.Random(seed), [], []
    for i in range(n):
        low = rng.choice([0.0, 50.0, 100.0])
        high = None if rng.random() < open_share else low + rng.choice([0.0, 20.0, 100.0])
        top = low + 200 if high is None else high
        mean = low + (top - low) * rng.choice([0.1, 0.5, 0.95])
        rows.append((i, rng.choice(["a", "b", "c", None]), low, high, mean, rng.choice([None, 2.0, 7.5])))
        draws += [(s, i, low + (top - low) * rng.random() ** 3) for s in range(sims)]
    return rows, draws


def run(spark, rows, draws, weight=None, inflation=A.INFLATION):
    totals = A.anchored_totals(spark.createDataFrame(draws, "sim int, id long, units double").repartition(4), spark.createDataFrame(rows, ROWS), "id", LEVELS, "low", "high", "mean", weight, inflation)
    return totals


@pytest.mark.parametrize(("seed", "weight", "open_share", "inflation"), [(1, None, 0.0, 1.3), (2, "price", 0.3, 1.3), (3, None, 0.0, 4.0)])
def test_equals_a_search_and_keeps_its_invariants(spark, seed, weight, open_share, inflation):
    rows, draws = planted(seed, open_share=open_share)
    totals = run(spark, rows, draws, weight, inflation)
    got = {(r["level"], r["member"], r["sim"]): r["total"] for r in totals.collect()}
    want = expected(rows, draws, weight, inflation)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v, rel=1e-7, abs=1e-6) for k, v in want.items())
    w = lambda r: (r[5] or 0.0) if weight else 1.0
    mean = lambda level, g: sum(v for k, v in got.items() if k[:2] == (level, g)) / 30
    assert mean("market", A.ALL) == pytest.approx(sum(r[4] * w(r) for r in rows), rel=1e-9)
    assert sum(mean("segment", g) for g in {k[1] for k in got if k[0] == "segment"}) == pytest.approx(mean("market", A.ALL), rel=1e-9)
    for (level, g, _), v in got.items():
        of = [r for r in rows if level == "market" or (r[1] or A.NO_GROUP) == g]
        assert v >= sum(r[2] * w(r) for r in of) - 1e-6
        if not open_share:
            assert v <= sum(r[3] * w(r) for r in of) + 1e-6


def test_no_room_no_spread_and_empty(spark):
    rows = [(1, "fixed", 10.0, 10.0, 10.0, None), (2, "full", 0.0, 8.0, 8.0, None), (3, "still", 5.0, None, 9.0, None), (None, "gone", 1.0, 2.0, 1.5, None)]
    draws = [(s, i, u) for s in range(4) for i, u in ((1, 10.0), (2, 2.0 + s), (3, 5.0), (9, 1.0))]
    got = {(r["member"], r["sim"]): r["total"] for r in run(spark, rows, draws).where("level = 'segment'").collect()}
    assert {k[0] for k in got} == {"fixed", "full", "still"}
    assert all(got["fixed", s] == 10.0 and got["full", s] == pytest.approx(8.0) and got["still", s] == 9.0 for s in range(4))
    none = A.anchored_totals(spark.createDataFrame([], "sim int, id long, units double"), spark.createDataFrame([], ROWS), "id", LEVELS, "low", "high", "mean")
    assert none.count() == 0 and A.level_intervals(none).count() == 0


def test_one_pass_over_draws_and_partial_sums(spark):
    rows, draws = planted(5)
    out = A.level_intervals(run(spark, rows, draws)).where("level = 'market'").first()
    assert out["low"] < out["mean"] < out["high"] and out["mean"] == pytest.approx(sum(r[4] for r in rows))
    assert not any(n in run(spark, rows, draws)._jdf.queryExecution().toString() for n in ("Python", "CartesianProduct"))
    assert run(spark, rows, draws).groupBy("level", "member").agg(F.count("*").alias("n")).where("n <> 30").count() == 0


def test_draws_of_a_family_follow_its_quantiles(spark):
    import numpy as np

    from marketloom.operators import demand as D

    df = spark.createDataFrame([(i, [1.0], 20.0, 90.0) for i in range(3)] + [(9, [1.0], 50.0, 50.0), (10, [1.0], 5.0, None)], "id long, _x array<double>, low double, high double")
    fit = D.Fit(["one"], np.array([3.5]), 0.9, 3, nu=3)
    got = D.family_draws(df, "id", "low", "high", fit, sims=2000)
    units = {i: sorted(r["units"] for r in got.where(f"id = {i}").collect()) for i in (0, 9)}
    q = D.within_bounds(df.where("id = 0"), "low", "high", fit, (0.25, 0.75)).first()
    assert units[0][0] >= 20 and units[0][-1] <= 90 and set(units[9]) == {50.0}
    assert np.mean(units[0]) == pytest.approx(q["units"], rel=0.03)
    assert np.quantile(units[0], 0.25) == pytest.approx(q["q0"], rel=0.05) and np.quantile(units[0], 0.75) == pytest.approx(q["q1"], rel=0.05)
    assert got.where("id = 10 AND units IS NOT NULL AND NOT isnan(units)").count() == 0


def test_draws_are_never_broadcast(spark, monkeypatch):
    """exploded draws look as small as their rows. Groups come with the draws, or both sides are sorted; the totals agree."""
    from marketloom.operators import demand as D

    rows = spark.range(40).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("seg"), F.lit(1.0).alias("low"), F.lit(9.0).alias("high"), F.lit(4.0).alias("mean"), F.lit(2.0).alias("price"), F.array(F.lit(1.0)).alias("_x"))
    fit, plans, once = D.Fit(["intercept"], np.array([1.0]), 0.5, 40), [], A.materialize
    monkeypatch.setattr(A, "materialize", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), once(df, tag))[1])
    apart, carried = D.family_draws(rows, "id", "low", "high", fit, sims=20), D.family_draws(rows, "id", "low", "high", fit, sims=20, keep=("seg",))
    got = [{(r[0], r[1], r[2]): r[3] for r in A.anchored_totals(d, rows, "id", LEVELS, "low", "high", "mean").collect()} for d in (apart, carried)]
    assert len(got[0]) == 80 and got[0].keys() == got[1].keys() and all(math.isclose(v, got[1][k], rel_tol=1e-9) for k, v in got[0].items())
    first, second = [p for tag, p in plans if tag == "drawn"]
    assert "SortMergeJoin [_key" in first and "_key" not in second


@pytest.mark.parametrize("nu", [None, 10, 5, 3])
def test_quantiles_settle_where_bisection_ends(nu):
    from marketloom.operators import demand as D

    rng = np.random.default_rng(3)
    m, lo = rng.normal(3, 3, 400), rng.choice([0.0, 50.0, 100.0, 1e4], 400)
    hi = lo + rng.choice([0.0, 1e-3, 50.0, 1e5], 400)
    lo[0], hi[1] = np.nan, np.nan
    u = rng.random((400, 20))
    got = D.quantiles_between(m, lo, hi, u, 0.7, nu)
    assert np.isnan(got[:2]).all() and (got[2:] >= lo[2:, None]).all() and (got[2:] <= hi[2:, None]).all()
    with np.errstate(divide="ignore"):
        a, b = (D.t_cdf((np.log(x) - m) / 0.7, nu) for x in (lo, hi))
    row, draw = np.nonzero(np.broadcast_to((hi > lo)[:, None], u.shape))
    want = D._bisected(m[row], lo[row], hi[row], (a[:, None] + u * (b - a)[:, None])[row, draw], 0.7, nu)
    chance = lambda v: D.t_cdf((np.log(v) - m[row]) / 0.7, nu)
    # bisection ends within 2 ** -50 of the bounds' distance, a step below 1e-13 settles
    near = np.abs(got[row, draw] - want) <= 1e-14 * hi[row] + 1e-9 * want
    assert (near | (np.abs(chance(got[row, draw]) - chance(want)) < 1e-12)).all() and near.mean() > 0.5


def test_draws_are_added_up_where_they_are_drawn(spark, monkeypatch):
    """each draw was a row with its listing's columns. Sums of a task are those of the rows, with unknown bounds, null keys and null groups."""
    from marketloom.operators import demand as D

    data = [(i, ["s", "t", None][i % 3], [1.0, i / 50], float(10 * (i % 4)), float(10 * (i % 4) + 15 * (i % 2 + 1))) for i in range(60)]
    data += [(70, "u", [1.0, 0.0], 5.0, None), (71, "s", [1.0, 0.0], 5.0, None), (None, "s", [1.0, 0.0], 1.0, 2.0)]
    df = spark.createDataFrame(data, "id long, seg string, _x array<double>, low double, high double").repartition(3)
    monkeypatch.setattr(D, "DRAWN", 7)
    for nu in (None, 3):
        fit = D.Fit(["one", "x"], np.array([2.5, 0.4]), 0.8, 60, nu=nu)
        rows = D.family_draws(df.where("id IS NOT NULL"), "id", "low", "high", fit, sims=12, keep=("seg",))
        by = rows.groupBy(F.coalesce("seg", F.lit(A.NO_GROUP)).alias("m"), "sim").agg(F.sum("units").alias("v")).collect()
        want = {("segment", r["m"], r["sim"]): r["v"] for r in by}
        want |= {("market", A.ALL, r["sim"]): r["v"] for r in rows.groupBy("sim").agg(F.sum("units").alias("v")).collect()}
        totals = D.family_totals(df, "id", "low", "high", fit, LEVELS, sims=12)
        got = {(r["level"], r["member"], r["sim"]): r["drawn"] for r in totals.collect()}
        assert got.keys() == want.keys() and all(v is None and got[k] is None or got[k] == pytest.approx(v, rel=1e-12) for k, v in want.items())
    known = df.where("id IS NOT NULL").withColumn("mean", F.lit(9.0)).withColumn("price", F.lit(1.0))
    once = lambda draws: {tuple(r)[:3]: r[3] for r in A.anchored_totals(draws, known, "id", LEVELS, "low", "high", "mean").collect()}
    a, b = once(totals), once(rows)
    assert len(a) == 60 and a.keys() == b.keys() and all(a[k] == pytest.approx(v, rel=1e-9) for k, v in b.items())
