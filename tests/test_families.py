"""Error families over planted markets: derivatives, the family that is chosen, market size and coverage."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketloom.operators import demand as D
from marketloom.operators.scores import LADDER, observation_interval


def market(seed: int, n: int, heavy: bool) -> pd.DataFrame:
    """Listings in five categories whose log units follow price, rating and age, and badges of what they sell."""
    rng = np.random.default_rng(seed)
    shift, own = rng.normal(0, 0.8, 5), rng.integers(0, 5, n)
    log_price = rng.normal(np.log(25) + 0.3 * shift[own], 0.6)
    rating, log_age = np.clip(rng.normal(4.3, 0.35, n), 1, 5).round(1), np.clip(rng.normal(np.log(500), 0.9, n), np.log(5), np.log(5000))
    mid = 3.2 + shift[own] - 0.9 * (log_price - np.log(25)) + 0.6 * (rating - 4.3) + 0.25 * (log_age - np.log(500))
    units = np.full(n, np.inf)
    while (over := units >= 2 * LADDER[-1]).any():  # what no badge can show is drawn again, so that nothing piles up at the end
        noise = rng.standard_t(3, n) / np.sqrt(3) if heavy else rng.normal(0, 1, n)
        units = np.where(over, np.exp(mid + 1.1 * noise), units)
    place = np.searchsorted(LADDER, units, side="right") - 1
    badge = [LADDER[i] if i >= 0 else None for i in place]
    unknown = rng.random(n) < 0.1
    return pd.DataFrame({"id": np.arange(n), "price": np.exp(log_price), "category": [f"c{i}" for i in own], "rating": [None if u else float(r) for u, r in zip(unknown, rating)], "log_age": log_age, "x": badge, "units_true": units})


def fitted(spark, seed: int, n: int, heavy: bool):
    rows = market(seed, n, heavy).astype(object)
    df = spark.createDataFrame(rows.where(rows.notna(), None).values.tolist(), "id long, price double, category string, rating double, log_age double, x double, units_true double")
    low, high = observation_interval("x")
    df, names = D.market_design(df.withColumns({"low": low, "high": high}), "price", ["rating", "log_age"], "category")
    fits = D.fit_families(df, "low", "high", names)
    got = D.within_bounds(df, "low", "high", fits[0])
    known = F.sum(F.coalesce("x", F.lit(0.0)))
    return names, fits, got.agg(F.sum("units"), F.sum("units_true"), F.avg(F.col("units_true").between(F.col("q0"), F.col("q1")).cast("double")), F.count(F.when(~F.col("units").between(F.col("low"), F.col("high")), 1)), known).first()


@pytest.mark.parametrize("nu", [None, 10, 3])
def test_derivatives_match_differences(nu):
    rng = np.random.default_rng(1)
    x = np.c_[np.ones(40), rng.normal(size=(40, 2))]
    lo = rng.normal(size=40) * 2
    hi = lo + rng.random(40) * 2
    hi[:5], lo[5:12], hi[12:15] = lo[:5], -np.inf, np.inf
    at = np.array([0.3, -0.2, 0.5, 0.1])
    f = lambda p: D.interval_sums(x, lo, hi, p[:-1], p[-1], nu)
    step = 1e-5 * np.eye(4)
    assert np.allclose([(f(at + d)[0] - f(at - d)[0]) / 2e-5 for d in step], f(at)[2:6], atol=1e-6)
    assert np.allclose([(f(at - d)[2:6] - f(at + d)[2:6]) / 2e-5 for d in step], f(at)[6:].reshape(4, 4), atol=1e-5)


def test_heavy_tails_are_chosen_and_the_size_is_near(spark):
    names, fits, (units, true, covered, outside, shown) = fitted(spark, 7, 3000, True)
    assert {"log_price", "log_price_bend1", "rating_missing"} <= set(names) and sum(n.startswith("category=") for n in names) == 4
    assert fits[0].nu == 3 and [f.aic for f in fits] == sorted(f.aic for f in fits)
    assert abs(units / true - 1) < 0.06 and 0.93 <= covered <= 0.97 and outside == 0 and shown < 0.9 * true


def test_degenerate_markets(spark):
    """No price spread, all unknown, one category, an empty table: a design without those columns, finite fits."""
    rows = [(i, 10.0, None, None, 50.0 if i < 3 else None) for i in range(30)]
    low, high = observation_interval("x")
    for data in (rows, []):
        df = spark.createDataFrame(data, "id long, price double, category string, rating double, x double").withColumns({"low": low, "high": high})
        df, names = D.market_design(df, "price", ["rating"], "category")
        fit = D.fit_families(df, "low", "high", names, families=(None,))[0]
        assert names == ["intercept"] and fit.rows == len(data) and np.isfinite(fit.beta[0]) and fit.sd > 0
        assert D.within_bounds(df, "low", "high", fit).count() == len(data)
