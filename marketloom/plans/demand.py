"""The demand model over the test tables: rows only, as draws and fits are beyond SQL; tests hold them against known truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import anchoring as A
from marketloom.operators import demand as D
from marketloom.operators.scores import LADDER, observation_interval
from marketloom.plans.base import MONTH, Book
from marketloom.session import materialize

Q = Book()
QUERIES, SQL = Q.queries, Q.sql


def _observed(v):
    """Listings whose month's sales show as badges: the rung they have reached, or nothing."""
    rung = F.array_max(F.filter(F.array(*[F.lit(x) for x in LADDER]), lambda x: x <= F.col("sales") * 10))
    sales = v.snapshot.where(F.col("period") == F.lit(MONTH).cast("timestamp_ntz")).select("id", "sales")
    df = v.parts.join(sales, "id", "left").withColumn("x", rung)
    low, high = observation_interval("x")
    df = df.withColumns({"low": low, "high": high})
    return D.design(df, ["price", "size"])


@Q.add("K4_interval_fit")
def k4(v):
    df, names = _observed(v)
    fit = D.fit_intervals(df, "low", "high", names)
    return v.spark.createDataFrame([(n, float(b), float(fit.sd), fit.rows) for n, b in zip(names, fit.beta, strict=True)], "term string, coefficient double, sd double, rows long")


@Q.add("K4_error_families")
def k4_families(v):
    """Normal and t errors over a price curve and categories, by AIC."""
    df, _ = _observed(v)
    df, names = D.market_design(df, "price", ["size"], "segment")
    fits = D.fit_families(df, "low", "high", names)
    return v.spark.createDataFrame([(f.family, float(f.sd), float(f.loglik), float(f.aic), f is fits[0], f.rows) for f in fits], "family string, sd double, loglik double, aic double, chosen boolean, rows long")


@Q.add("K6_family_units")
def k6_families(v):
    """Expected units and 95 % of each listing between its bounds, under the family of the least AIC."""
    df, _ = _observed(v)
    df, names = D.market_design(df, "price", ["size"], "segment")
    return D.within_bounds(df, "low", "high", D.fit_families(df, "low", "high", names)[0]).select("id", "low", "high", "units", "q0", "q1")


@Q.add("K6_expected_units")
def k6(v):
    df, names = _observed(v)
    return D.expected_units(df, "low", "high", D.fit_intervals(df, "low", "high", names)).select("id", "low", "high", "units")


@Q.add("K7_joint_intervals")
def k7(v):
    df, names = _observed(v)
    draws = D.joint_draws(df, "id", "low", "high", D.fit_intervals(df, "low", "high", names))
    return D.group_intervals(draws, df, "id", "segment")


@Q.add("K7_anchored_intervals")
def k7_anchored(v):
    """Products, segments and the market: 95 % of totals drawn under the family of the least AIC, inside the bounds, with means that add up."""
    df = materialize(_observed(v)[0].select("id", "title", "segment", "price", "size", "low", "high"), "listings")  # sales are read once
    df, names = D.market_design(df, "price", ["size"], "segment")
    df = materialize(df, "observed")
    fit, levels = D.fit_families(df, "low", "high", names)[0], {"product": "title", "segment": "segment", "market": None}
    drawn, rows = D.family_totals(df, "id", "low", "high", fit, levels), D.within_bounds(df, "low", "high", fit, ())
    return A.level_intervals(A.anchored_totals(drawn, rows, "id", levels, "low", "high", "units"))


@Q.add("K8_held_out_auc")
def k8(v):
    df, names = _observed(v)
    return D.cross_validate(df, "id", "x", "low", "high", names, LADDER)
