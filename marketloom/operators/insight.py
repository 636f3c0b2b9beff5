"""Reviews, requirements, sensitivity, evidence, significance, allocation of confidence, competing merges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def requirement_share(rules: list[Column]) -> Column:
    """Share of the rules that are met among those that can be judged (null: unknown); null if none can."""
    known = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in rules), F.lit(0))
    met = sum((F.when(r, 1).otherwise(0) for r in rules), F.lit(0))
    return F.try_divide(met, known)


def aspect_table(df: DataFrame, key: str, aspect: str, score: str, text: str) -> DataFrame:
    """For each aspect: distinct texts, mean score and the worst example (ties: smaller key)."""
    return df.groupBy(aspect).agg(F.count_distinct(key).alias("texts"), F.avg(score).alias("mean_score"), F.min_by(text, F.struct(F.col(score), F.col(key))).alias("worst"))


def pain_score(top3_share: Column, sentiment: Column) -> Column:
    return 0.6 * F.least(top3_share, F.lit(1.0)) + 0.4 * F.greatest(F.lit(0.0), -sentiment)


def consensus(df: DataFrame, key: str, attribute: str, value: str) -> DataFrame:
    """Most frequent value of each attribute of a product (ties: smaller) and the share that agrees."""
    n = df.where(F.col(value).isNotNull()).groupBy(key, attribute, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key, attribute).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("value"), (F.max("n") / F.sum("n")).alias("agreement"))


def fill_by_quantile(df: DataFrame, value: str, by: str, q: float, least: int = 3) -> DataFrame:
    """``filled``: unknown values take the group's quantile, or the overall one in groups with fewer than ``least`` values."""
    g = df.groupBy(by).agg(F.count(value).alias("_n"), F.percentile(value, F.lit(q)).alias("_q"))
    all_q = F.broadcast(df.agg(F.percentile(value, F.lit(q)).alias("_all")))
    j = df.join(g, by).crossJoin(all_q)
    return j.withColumn("filled", F.coalesce(F.col(value), F.when(F.col("_n") >= least, F.col("_q")).otherwise(F.col("_all")))).drop("_n", "_q", "_all")


def threshold_sweep(df: DataFrame, score: str, hit: str) -> DataFrame:
    """For each distinct score as threshold: rows at or above it, precision and coverage. The window sees one row per score."""
    g = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("long")).alias("k"))
    w = W.orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    total = F.broadcast(df.agg(F.count(F.lit(1)).alias("all")))
    g = g.withColumns({"taken": F.sum("n").over(w), "good": F.sum("k").over(w)}).crossJoin(total)
    return g.select(F.col(score).alias("threshold"), "taken", (F.col("good") / F.col("taken")).alias("precision"), (F.col("taken") / F.col("all")).alias("coverage"))


def pairwise_quality(predicted: DataFrame, gold: DataFrame, key: str, cluster: str) -> DataFrame:
    """Precision and recall over pairs, from cluster sizes: pairs in a group of n are n (n - 1) / 2, so no pair is made."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    size = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    j = predicted.select(key, F.col(cluster).alias("p")).join(gold.select(key, F.col(cluster).alias("g")), key)
    both, p, g = (size(j, *by).agg(pairs("n").alias(name)) for name, by in (("hits", ("p", "g")), ("predicted", ("p",)), ("gold", ("g",))))
    one = both.crossJoin(p).crossJoin(g)
    return one.select("hits", "predicted", "gold", F.try_divide("hits", "predicted").alias("precision"), F.try_divide("hits", "gold").alias("recall"))


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray, terms: int = 400) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, taken on the side where it ends soon."""
    lgamma = np.frompyfunc(math.lgamma, 1, 1)
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    small = 1e-300
    keep = lambda v: np.where(np.abs(v) < small, small, v)
    c, d = np.ones_like(x), 1 / keep(1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, terms):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / keep(1 + step * d), keep(1 + step / c)
            value = value * d * c
        if np.abs(d * c - 1).max(initial=0.0) < 1e-15:
            break
    front = (lgamma(a + b) - lgamma(a) - lgamma(b)).astype("f8") + a * np.log(x) + b * np.log1p(-x) - np.log(a)
    part = np.exp(front) * value
    return np.where(flip, 1 - part, part)


def exact_binomial(more: pd.Series, trials: pd.Series, p: float = 0.5) -> pd.Series:
    """One-sided chance of at least ``more`` successes, whatever the counts: a tail of a binomial is an incomplete beta function."""
    k, n = more.to_numpy("f8", na_value=np.nan), trials.to_numpy("f8", na_value=np.nan)
    out = np.where(np.isnan(k) | np.isnan(n), np.nan, np.where(k <= 0, 1.0, 0.0))
    real = (k > 0) & (k <= n)
    out[real] = incomplete_beta(np.full(real.sum(), p), k[real], n[real] - k[real] + 1)
    return pd.Series(out).astype(object).where(~np.isnan(out), None).astype("float64")


def binomial_test(more: str, trials: str) -> Column:
    @F.pandas_udf("double")
    def run(k: pd.Series, n: pd.Series) -> pd.Series:
        return exact_binomial(k, n)

    return run(F.col(more), F.col(trials))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a z value, by a fixed rational fit (error below 2e-7), in built-in functions."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)
