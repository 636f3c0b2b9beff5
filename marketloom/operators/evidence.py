"""How far a result can be trusted: ranks under other weights, gaps with intervals, refits of the demand model."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.expr import bh_qvalues
from marketloom.operators.demand import Fit, truncated_moments
from marketloom.operators.insight import normal_tail
from marketloom.session import materialize


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of its parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / float(1 << 32)


def rank_stability(df: DataFrame, key: str, weights: dict[str, float], draws: int = 300, spread: float = 0.3, seed: int = 7) -> DataFrame:
    """(key, place, best, worst, top3, spearman): places by the weighted mean of a row's known columns, and in ``draws`` rankings whose
    weights are each multiplied by a number in [1 - spread, 1 + spread). ``spearman`` is the median over draws of the rank
    correlation with the plain ranking. Equal scores share the better place. Rows are scopes (segments, leaves), not listings:
    a draw ranks all of them in one task."""
    spin = lambda c: F.when(F.col("draw") < 0, 1.0).otherwise(1 - spread + 2 * spread * uniform(F.lit(str(seed)), F.col("draw").cast("string"), F.lit(c)))
    drawn = df.sparkSession.range(-1, draws).select(F.col("id").alias("draw")).select("draw", *[(spin(c) * w).alias(f"_w_{c}") for c, w in weights.items()])
    known = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in weights}
    over = sum((F.when(known[c], F.col(c) * F.col(f"_w_{c}")).otherwise(0.0) for c in weights), F.lit(0.0))
    under = sum((F.when(known[c], F.col(f"_w_{c}")).otherwise(0.0) for c in weights), F.lit(0.0))
    scored = df.select(key, *weights).crossJoin(F.broadcast(drawn)).withColumn("score", F.round(F.try_divide(over, under), 9)).where("score IS NOT NULL")
    place = F.rank().over(W.partitionBy("draw").orderBy(F.desc("score"))).cast("long")
    ties = F.count(F.lit(1)).over(W.partitionBy("draw", "score"))
    ranked = materialize(scored.select(key, "draw", place.alias("place"), (place + (ties - 1) / 2).alias("mid")), "ranks")
    base = ranked.where("draw < 0").select(key, F.col("place").alias("own"), F.col("mid").alias("own_mid"))
    both = ranked.where("draw >= 0").join(base, key)
    rho = both.groupBy("draw").agg(F.corr("mid", "own_mid").alias("r")).agg(F.median("r").alias("spearman"))
    out = both.groupBy(key).agg(F.first("own").alias("place"), F.min("place").alias("best"), F.max("place").alias("worst"), F.avg((F.col("place") <= 3).cast("double")).alias("top3"))
    return out.crossJoin(F.broadcast(rho))


def gap_features(df: DataFrame, key: str, by: str, features: str, units: str, least: int = 8, support: int = 5) -> DataFrame:
    """(by, feature, aliases, listings_with, listings, supply, demand, lift) of every feature that at least ``support`` listings of a
    group of ``least`` or more have, and as many lack. ``features`` is an array of strings. Features of exactly the same
    listings are one signal: the one of the fewest words, then characters, then by name stands for them. Listings with
    unknown units take no part."""
    rows = df.where(F.col(units).isNotNull()).select(by, key, F.col(units).cast("double").alias("u"), F.array_distinct(F.filter(features, lambda f: f.isNotNull() & (f != ""))).alias("f"))
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("listings"), F.sum("u").alias("all_units")).where(F.col("listings") >= least)
    same = (F.count(F.lit(1)).alias("listings_with"), F.sum("u").alias("own_units"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), key)).alias("h2"))
    seen = rows.select(by, key, "u", F.explode("f").alias("feature")).groupBy(by, "feature").agg(*same)
    fit = seen.join(total, by).where((F.col("listings_with") >= support) & (F.col("listings") - F.col("listings_with") >= support))
    name = F.struct((F.length("feature") - F.length(F.replace("feature", F.lit(" ")))).alias("blanks"), F.length("feature").alias("size"), F.col("feature").alias("feature"))
    one = fit.groupBy(by, "listings_with", "h1", "h2", "listings", "all_units").agg(F.array_sort(F.collect_list(name)).alias("names"), F.min("own_units").alias("own_units"))
    names = F.transform("names", lambda x: x["feature"])
    without = F.try_divide(F.col("all_units") - F.col("own_units"), F.col("listings") - F.col("listings_with"))
    lift = F.when(without > 0, F.col("own_units") / F.col("listings_with") / without)
    return one.select(
        by, F.get(names, F.lit(0)).alias("feature"), F.array_sort(F.slice(names, F.lit(2), F.size(names))).alias("aliases"), "listings_with", "listings",
        (F.col("listings_with") / F.col("listings")).alias("supply"), F.try_divide("own_units", "all_units").alias("demand"), lift.alias("lift"),
    )


def _uniforms(keys: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Numbers in (0, 1) by key and replicate, from a mix of both."""
    x = keys[:, None].astype("u8") + (np.arange(1, reps + 1, dtype="u8") + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype("f8") / 2**53 + 2**-54


#: Shares of a Poisson count of mean 1 up to 0, 1, 2 and so on.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def gap_analysis(df: DataFrame, key: str, by: str, features: str, units: str, least: int = 8, support: int = 5, reps: int = 400, fdr: float = 0.10, seed: int = 23) -> DataFrame:
    """``gap_features`` with low and high (95 % of lift), p (one-sided, lift above 1), q (Benjamini-Hochberg over all rows) and gap.

    Listings are resampled by Poisson weights from a hash of key and replicate. A batch sends its sums per feature and replicate,
    so what is shuffled follows the features and not the listings, and a common feature is summed before it moves."""
    shown = materialize(gap_features(df, key, by, features, units, least, support), "gaps")
    mark = F.explode(F.array_union(F.array(F.lit("")), F.col(features)))
    rows = df.where(F.col(units).isNotNull()).select(F.col(by).alias("g"), F.xxhash64(key).alias("h"), F.col(units).cast("double").alias("u"), mark.alias("feature"))
    wanted = shown.select(F.col(by).alias("g"), "feature")
    rows = rows.join(wanted.unionByName(wanted.select("g", F.lit("").alias("feature")).distinct()), ["g", "feature"], "left_semi")

    def run(batches):
        for b in batches:
            for start in range(0, len(b), 2000):
                part = b.iloc[start : start + 2000]
                code, groups = pd.factorize(pd.MultiIndex.from_frame(part[["g", "feature"]]))
                order = np.argsort(code, kind="stable")
                at = np.searchsorted(code[order], np.arange(len(groups)))
                w = np.searchsorted(_POISSON, _uniforms(part["h"].to_numpy("i8").view("u8")[order], reps, seed)).astype("f8")
                n, s = np.add.reduceat(w, at), np.add.reduceat(w * part["u"].to_numpy()[order][:, None], at)
                yield pd.DataFrame({"g": [g[0] for g in groups], "feature": [g[1] for g in groups], "n": list(n), "s": list(s)})

    sums = rows.repartition("g", "feature", F.pmod("h", F.lit(64))).sortWithinPartitions("g", "feature").mapInPandas(run, f"g {dict(df.dtypes)[by]}, feature string, n array<double>, s array<double>")
    long = sums.select("g", "feature", F.posexplode(F.arrays_zip("n", "s")).alias("rep", "v")).groupBy("g", "feature", "rep").agg(F.sum("v.n").alias("n"), F.sum("v.s").alias("s"))
    long = materialize(long, "replicates")
    every = long.where("feature = ''").select("g", "rep", F.col("n").alias("n0"), F.col("s").alias("s0"))
    rest = (F.col("s0") - F.col("s")) / F.nullif(F.col("n0") - F.col("n"), F.lit(0.0))
    lifts = long.where("feature <> '' AND n > 0").join(every, ["g", "rep"]).select("g", "feature", F.when(rest > 0, F.col("s") / F.col("n") / rest).alias("l")).where("l IS NOT NULL")
    ln = F.when(F.col("l") > 0, F.log("l"))
    stats = lifts.groupBy("g", "feature").agg(F.count(F.lit(1)).alias("k"), F.percentile("l", F.lit(0.025)).alias("low"), F.percentile("l", F.lit(0.975)).alias("high"), F.avg(ln).alias("m"), F.stddev_pop(ln).alias("sd"))
    z = F.col("m") / F.col("sd")
    tail = normal_tail(z) / 2
    p = F.when((F.col("k") >= 20) & (F.col("sd") > 1e-9), F.when(z >= 0, tail).otherwise(1 - tail)).otherwise(1.0)
    enough = lambda c: F.when(F.col("k") >= 20, F.col(c)).alias(c)
    out = shown.join(stats.select(F.col("g").alias(by), "feature", enough("low"), enough("high"), p.alias("p")), [by, "feature"], "left").fillna({"p": 1.0})
    out = bh_qvalues(out, "p", tie=(by, "feature"))
    return out.withColumn("gap", (F.col("q") <= fdr) & (F.coalesce(F.col("low"), F.lit(0.0)) > 1) & (F.col("demand") > F.col("supply")))


def refit_demand(df: DataFrame, key: str, fit: Fit, ladder: tuple[float, ...], reps: int = 60, steps: int = 25, ridge: float = 1e-3, seed: int = 5) -> DataFrame:
    """(term, coefficient, corrected, low, high) of a normal fit: ``reps`` markets are drawn from it, shown as badges again and fitted.
    ``corrected`` is twice the estimate less the refits' mean; low and high hold 95 % of the refits around it. The row "sd" is the spread
    of the errors. Draws are hashes of key and replicate; all refits take a step in one pass, which returns sums only."""
    k, size = len(fit.columns), len(fit.columns) ** 2 + len(fit.columns) + 2
    rungs, tops = np.log(np.array(ladder)), np.log(np.array([*ladder[1:], 2 * ladder[-1]]))
    rows = materialize(df.select("_x", F.xxhash64(F.lit(seed), key).alias("h")), "refits")

    def sums_of(betas: np.ndarray, sds: np.ndarray):
        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                x, u = np.stack(b["_x"].to_numpy()), _uniforms(b["h"].to_numpy("i8").view("u8"), 2 * reps, seed)
                z, xx, out = np.sqrt(-2 * np.log(u[:, :reps])) * np.cos(2 * np.pi * u[:, reps:]), (x.T @ x).ravel(), []
                for r in range(reps):
                    units = x @ fit.beta + fit.sd * z[:, r]
                    at = np.searchsorted(rungs, units, side="right") - 1
                    lo, hi = np.where(at < 0, -np.inf, rungs[np.maximum(at, 0)]), np.where(at < 0, rungs[0], tops[np.maximum(at, 0)])
                    mid, var = truncated_moments(x @ betas[r], sds[r], lo, hi)
                    out.append(np.concatenate([xx, x.T @ mid, [mid @ mid + var.sum(), len(b)]]))
                yield pd.DataFrame({"s": [np.concatenate(out).tolist()]})

        return run

    betas, sds = np.tile(fit.beta, (reps, 1)), np.full(reps, fit.sd)
    for _ in range(steps):
        total = rows.mapInPandas(sums_of(betas, sds), "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        sums, moved = np.zeros(reps * size), 0.0
        for r in total:
            sums[r["i"]] = r["v"]
        for r, t in enumerate(sums.reshape(reps, size)):
            xx, xy, yy, n = t[: k * k].reshape(k, k), t[k * k : k * k + k], t[-2], max(t[-1], 1.0)
            penalty = np.eye(k) * ridge * n
            penalty[0, 0] = 1e-9
            new = np.linalg.solve(xx + penalty, xy)
            sd = math.sqrt(max((yy - 2 * new @ xy + new @ xx @ new) / n, 1e-6))
            moved = max(moved, np.abs(new - betas[r]).max(), abs(sd - sds[r]))
            betas[r], sds[r] = new, sd
        if moved < 1e-4:
            break
    out = []
    for i, name in enumerate([*fit.columns, "sd"]):
        drawn, own = (betas[:, i], fit.beta[i]) if i < k else (np.log(sds), math.log(fit.sd))
        fixed = 2 * own - drawn.mean()
        values = [own, fixed, *(np.quantile(drawn, [0.025, 0.975]) - drawn.mean() + fixed)]
        out.append((name, *[float(v) for v in (values if i < k else np.exp(values))]))
    return df.sparkSession.createDataFrame(out, "term string, coefficient double, corrected double, low double, high double")
