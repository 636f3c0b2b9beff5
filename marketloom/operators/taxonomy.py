"""A taxonomy found in the data: levels whose groups have prices of their own."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.operators.insight import incomplete_beta
from marketloom.session import materialize

def natural_breaks(values: np.ndarray, counts: np.ndarray, sums: np.ndarray, smallest: int, bins: int) -> list[float]:
    """Cuts of ordered distinct values into at most ``bins`` ranges of at least ``smallest`` rows that leave the least variance within:
    each count of ranges extends the best one of a range less. Of equal ones the fewest ranges; none: no valid cut."""
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0.0], np.cumsum(sums)])
    m = len(values)
    best = [np.where(n >= smallest, s**2 / np.maximum(n, 1), -np.inf)]
    best[0][0] = -np.inf
    back: list[np.ndarray] = []
    for _ in range(1, bins):
        now, frm = np.full(m + 1, -np.inf), np.zeros(m + 1, int)
        for j in range(1, m + 1):
            rows = n[j] - n[:j]
            gain = np.where(rows >= smallest, best[-1][:j] + (s[j] - s[:j]) ** 2 / np.maximum(rows, 1), -np.inf)
            frm[j] = int(gain.argmax())
            now[j] = gain[frm[j]]
        best.append(now)
        back.append(frm)
    ends = np.array([b[m] for b in best[1:]])
    if not len(ends) or not np.isfinite(ends).any():
        return []
    ranges, at, cuts = int(np.flatnonzero(ends >= ends.max() - 1e-9)[0]), m, []
    for k in range(ranges, -1, -1):
        at = back[k][at]
        cuts.append(float((values[at - 1] + values[at]) / 2))
    return cuts[::-1]


def f_tail(eta2: np.ndarray, groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Chance of at least this share of explained variance if groups don't matter: an incomplete beta function of what is left."""
    left, between = rows - groups, groups - 1
    out = np.where(eta2 >= 1, 0.0, 1.0)
    real = (eta2 > 0) & (eta2 < 1) & (left > 0) & (between > 0)
    out[real] = incomplete_beta(1 - eta2[real], left[real] / 2, between[real] / 2)
    return out


def _labelled(long: DataFrame, smallest: int, bins: int) -> tuple[DataFrame, DataFrame]:
    """Rows with label (the value itself, or for numbers their range), and the groups of ``smallest`` rows or more with their sums."""
    cells = long.where("number IS NOT NULL").groupBy("node", "dim", "number").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.count("x").alias("nx"))

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("number")
        known = g["nx"].sum()
        mean = g["s"].sum() / known if known else 0.0
        sums = (g["s"].fillna(0.0) - mean * g["nx"]).to_numpy("f8")
        return pd.DataFrame({"node": [g["node"].iloc[0]], "dim": [g["dim"].iloc[0]], "breaks": [natural_breaks(g["number"].to_numpy("f8"), g["n"].to_numpy(), sums, smallest, bins)]})

    breaks = cells.groupBy("node", "dim").applyInPandas(cut, "node string, dim string, breaks array<double>").where(F.size("breaks") > 0)
    named = long.join(breaks, ["node", "dim"], "left")
    above = F.size(F.filter("breaks", lambda b: b <= F.col("number")))
    show = lambda b: F.format_string("%.4g", b)
    ranged = F.when(above == 0, F.concat(F.lit("< "), show(F.get("breaks", F.lit(0))))).when(above == F.size("breaks"), F.concat(F.lit(">= "), show(F.element_at("breaks", -1))))
    ranged = ranged.otherwise(F.concat(show(F.get("breaks", above - 1)), F.lit(" to "), show(F.get("breaks", above))))
    label = F.when(F.col("number").isNull(), F.col("value")).when(F.col("breaks").isNotNull(), ranged)
    named = named.withColumn("label", label)
    big = named.where("label IS NOT NULL").groupBy("node", "dim", "label").agg(F.count(F.lit(1)).alias("size"), F.count("x").alias("nx"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    big = big.where(F.col("size") >= smallest)
    return named.drop("breaks"), big


def discover_taxonomy(
    df: DataFrame, key: str, price: str, words: list[str], numbers: list[str], depth: int = 3, coverage: float = 0.3, smallest: int = 3, bins: int = 4, alpha: float = 0.1, least: float = 0.05, near: float = 0.1
) -> tuple[DataFrame, DataFrame]:
    """(tree, ranking). Each level splits every node by the attribute that explains most of its log prices.

    An attribute is looked at where ``coverage`` of the node's rows state it and two groups hold ``smallest`` rows or more; numbers are cut
    into up to ``bins`` ranges, by their values to three significant digits, so that a cut looks at a bounded list. It counts with ``least``
    explained variance at a p of ``alpha`` or less. The best has the largest explained variance times squared coverage; of those within a
    share of ``near`` of it the one of fewest groups wins, then the larger, then by name. Rows without a value or in smaller
    groups go to ``other``, which is not split. tree: node, parent, depth, dim, label, products, price_median, eta2, p. ranking: node,
    depth, dim, coverage, groups, eta2, p, score, meaningful, chosen. Rows whose price is null or not positive are placed and counted, but
    explain nothing. All levels are aggregates, and p is the tail of an F distribution at every size."""
    digits = lambda c: F.format_string("%.2e", F.col(c).cast("double")).cast("double")
    dims = [F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value"), F.lit(None).cast("double").alias("number")) for c in words]
    dims += [F.struct(F.lit(c).alias("dim"), F.lit(None).cast("string").alias("value"), F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), digits(c)).alias("number")) for c in numbers]
    x = F.when(F.col(price) > 0, F.log(F.col(price).cast("double")))
    rows = materialize(df.select(F.col(key).alias("k"), x.alias("x"), F.array(*dims).alias("dims"), F.lit("").alias("node"), F.array().cast("array<string>").alias("used")), "taxonomy")
    tree, ranking = [], []
    for level in range(1, depth + 1):
        size = rows.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= 2 * smallest)
        long = rows.join(size.select("node"), "node", "left_semi").select("k", "x", "node", F.explode(F.filter("dims", lambda d: ~F.array_contains("used", d["dim"]))).alias("d"))
        long = long.select("k", "x", "node", "d.*").where("value IS NOT NULL OR number IS NOT NULL")
        stated = long.groupBy("node", "dim").agg(F.count(F.lit(1)).alias("stated")).join(size, "node")
        stated = stated.where(F.col("stated") >= coverage * F.col("rows"))
        named, groups = _labelled(long.join(stated.select("node", "dim"), ["node", "dim"], "left_semi"), smallest, bins)
        groups = materialize(groups, "groups")
        n, s = F.sum("nx"), F.sum("sx")
        total = F.sum("sxx") - s * s / n
        between = F.sum(F.when(F.col("nx") > 0, F.col("sx") * F.col("sx") / F.col("nx"))) - s * s / n
        found = groups.groupBy("node", "dim").agg(F.count(F.lit(1)).alias("groups"), n.alias("n"), F.when((n >= 3) & (total > 1e-12), F.greatest(between / total, F.lit(0.0))).otherwise(0.0).alias("eta2"), F.sum("size").alias("kept"))
        found = materialize(found.where("groups >= 2").join(stated, ["node", "dim"]), "found")
        named = materialize(named.where("label IS NOT NULL").join(groups.select("node", "dim", "label"), ["node", "dim", "label"], "left_semi").select("k", "x", "node", "dim", "label"), "named")

        tail = F.pandas_udf(lambda e, g, r: pd.Series(f_tail(e.to_numpy("f8"), g.to_numpy("f8"), r.to_numpy("f8"))), "double")
        p = F.when(F.col("eta2") > 0, tail("eta2", F.col("groups").cast("double"), F.col("n").cast("double"))).otherwise(1.0)
        share = F.col("stated") / F.col("rows")
        ranked = found.select("node", F.lit(level).alias("depth"), "dim", share.alias("coverage"), "groups", "eta2", p.alias("p"))
        ranked = ranked.withColumn("score", F.col("eta2") * F.col("coverage") * F.col("coverage")).withColumn("meaningful", (F.col("eta2") >= least) & (F.col("p") <= alpha))
        top = F.max(F.when(F.col("meaningful"), F.col("score"))).over(W.partitionBy("node"))
        ranked = ranked.withColumn("close", F.col("meaningful") & (F.col("score") >= (1 - near) * top))
        place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("close"), "groups", F.desc("score"), "dim"))
        ranked = materialize(ranked.withColumn("chosen", F.col("close") & (place == 1)).drop("close"), "ranked")
        ranking.append(ranked)
        best = ranked.where("chosen").select("node", "dim", "eta2", "p")
        label = named.join(best.select("node", "dim"), ["node", "dim"], "left_semi").select("k", "node", "label")
        split = rows.join(best, "node").join(label, ["k", "node"], "left")
        name = F.concat("dim", F.lit("="), F.coalesce("label", F.lit("other")))
        child = F.when(F.col("node") == "", name).otherwise(F.concat("node", F.lit("/"), name))
        split = materialize(split.select("k", "x", "dims", F.col("node").alias("parent"), child.alias("node"), F.array_append("used", F.col("dim")).alias("used"), "dim", F.coalesce("label", F.lit("other")).alias("label"), F.col("label").isNull().alias("other"), "eta2", "p"), "split")
        only = lambda c: F.first(F.when(~F.col("other"), F.col(c))).alias(c)
        tree.append(split.groupBy("node", "parent", "dim", "label").agg(F.lit(level).alias("depth"), F.count(F.lit(1)).alias("products"), F.exp(F.median("x")).alias("price_median"), only("eta2"), only("p")))
        rows = split.where("NOT other").select("k", "x", "dims", "node", "used")
        if rows.isEmpty():
            break
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return union(tree), union(ranking)
