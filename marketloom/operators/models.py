"""Models that need Python or pyspark.ml: outlier forest, relevance model, clusters, bootstrap, launch draws."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Rational fits of the inverse normal, in the middle and in the tails (relative error below 2e-9), and where they meet.
MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
EDGE = 0.02425
#: Texts that a task of a k-means takes.
PART = 100_000


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal in built-in functions; null outside (0, 1)."""

    def ratio(x: Column, fit: tuple) -> Column:
        top, bottom = F.lit(0.0), F.lit(0.0)
        for c in fit[0]:
            top = top * x + c
        for c in fit[1]:
            bottom = bottom * x + c
        return top / bottom

    q = p - 0.5
    far = lambda x: ratio(F.sqrt(-2 * F.log(x)), TAIL)
    return F.when((p <= 0) | (p >= 1), None).when(p < EDGE, far(p)).when(p > 1 - EDGE, -far(1 - p)).otherwise(q * ratio(q * q, MIDDLE))


def normal_score(rank: Column, n: Column) -> Column:
    """Inverse normal of (rank - 0.5) / n, with falling sign as ranks count from the best."""
    return -inverse_normal((rank - 0.5) / n)


def text_ratio(a: str, b: str) -> Column:
    """Matching-blocks similarity of two texts, 0 for a null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p, q).ratio() if isinstance(p, str) and isinstance(q, str) else 0.0 for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(F.col(a), F.col(b))


def outlier_scores(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 3) -> DataFrame:
    """(key, score): isolation forest on log1p of the columns, scores towards 1 are isolated.

    Trees are grown on a bounded sample chosen by a hash of the key; every row is scored, in Arrow batches. Rows with an unknown
    column are left out."""
    x = df.dropna(subset=columns).select(key, *[F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns])
    points = np.array([[r[c] for c in columns] for r in x.orderBy(F.xxhash64(F.lit(seed), key)).limit(8 * sample).collect()])
    rng = np.random.default_rng(seed)
    path = lambda n: 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n > 1)

    def grow(p: np.ndarray, depth: int):
        spread = np.ptp(p, axis=0) if len(p) else np.zeros(len(columns))
        if depth == 0 or len(p) <= 1 or not spread.any():
            return path(len(p))
        c = int(rng.choice(np.flatnonzero(spread)))
        cut = rng.uniform(p[:, c].min(), p[:, c].max())
        return c, cut, grow(p[p[:, c] < cut], depth - 1), grow(p[p[:, c] >= cut], depth - 1)

    size = min(sample, len(points))
    forest = [grow(points[rng.choice(len(points), size, replace=False)], math.ceil(math.log2(max(size, 2)))) for _ in range(trees)] if size else []

    def depth_of(tree, p: np.ndarray, at: int = 0) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(p), at + tree)
        c, cut, low, high = tree
        out, left = np.empty(len(p)), p[:, c] < cut
        out[left], out[~left] = depth_of(low, p[left], at + 1), depth_of(high, p[~left], at + 1)
        return out

    def run(batches):
        for b in batches:
            p = b[columns].to_numpy("f8")
            mean = np.mean([depth_of(t, p) for t in forest], axis=0) if forest else np.zeros(len(p))
            yield pd.DataFrame({key: b[key], "score": 2 ** (-mean / max(path(size), 1e-9))})

    return x.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, score double")


def hashed_vectors(df: DataFrame, text: str, size: int = 256) -> DataFrame:
    """Adds ``vector``: unit vectors of hashed words."""
    tokens = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+").transform(df)
    return Normalizer(inputCol="_tf", outputCol="vector").transform(HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=size).transform(tokens)).drop("_tokens", "_tf")


def blended_relevance(df: DataFrame, labels: DataFrame, key: str, text: str, base: str, label: str = "label", least: int = 8) -> DataFrame:
    """(key, relevance): a model of the labels weighs n / (n + 50) against the rule score ``base`` (0 to 1); without ``least`` labels
    of two classes the rule score stands alone."""
    vec = hashed_vectors(df, text)
    train = vec.join(labels.select(key, F.col(label).cast("double").alias("label")), key)
    counts = train.groupBy("label").count().collect()
    n = sum(r["count"] for r in counts)
    if n < least or len(counts) < 2:
        return df.select(key, F.col(base).cast("double").alias("relevance"))
    from pyspark.ml.functions import vector_to_array

    model = LogisticRegression(featuresCol="vector", labelCol="label", maxIter=20, regParam=0.01).fit(train)
    w = n / (n + 50)
    p = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(vec).select(key, (w * p + (1 - w) * F.col(base)).alias("relevance"))


def best_kmeans(df: DataFrame, key: str, text: str, ks: range = range(2, 6), seed: int = 5) -> DataFrame:
    """(key, cluster): k-means of hashed words with the k of the best cosine silhouette.

    Equal texts are fitted as one row with their count as its weight, in parts of ``PART`` texts in a fixed order, so that no task holds the table
    and a rerun starts from the same centres. Every row of ``df`` then gets its cluster."""
    texts = materialize(df.groupBy(text).agg(F.count(F.lit(1)).cast("double").alias("_copies")), "texts")
    vec = hashed_vectors(texts.repartition(-(-max(1, texts.count()) // PART), text).sortWithinPartitions(text), text, 128)
    judge = ClusteringEvaluator(featuresCol="vector", predictionCol="cluster", distanceMeasure="cosine", weightCol="_copies")
    models = [KMeans(featuresCol="vector", predictionCol="cluster", k=k, seed=seed, distanceMeasure="cosine", weightCol="_copies").fit(vec) for k in ks]
    return max(models, key=lambda m: judge.evaluate(m.transform(vec))).transform(hashed_vectors(df, text, 128)).select(key, "cluster")


def nearest_centroids(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(key, nearest, cosine): the group whose mean vector is nearest (ties: smaller). Means are one row per group, broadcast."""
    at = df.select(key, group, F.posexplode(vector).alias("i", "x"))
    mean = at.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy(group)))
    unit = mean.withColumn("m", F.col("m") / norm).groupBy(F.col(group).alias("nearest")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    j = df.select(key, vector).crossJoin(F.broadcast(unit))
    dot = F.aggregate(F.zip_with(vector, "c", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    own = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    s = j.select(key, "nearest", F.try_divide(dot, own).alias("cosine"))
    return s.groupBy(key).agg(F.max(F.struct("cosine", (-F.col("nearest")).alias("n"))).alias("b")).select(key, (-F.col("b.n")).alias("nearest"), F.col("b.cosine").alias("cosine"))


def bootstrap_mean(df: DataFrame, key: str, by: str, value: str, reps: int = 100, seed: int = 9) -> DataFrame:
    """(by, low, mean, high): Poisson bootstrap of a group's mean. Each row's weight in a replicate is drawn from a hash of seed,
    replicate and key, so rows are never gathered and a rerun agrees."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.col(key)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    steps, total, term = [], 0.0, math.exp(-1)
    for k in range(8):
        total += term
        steps.append(total)
        term /= k + 1
    w = sum((F.when(F.col("u") > s, 1).otherwise(0) for s in steps), F.lit(0))
    long = df.where(F.col(value).isNotNull()).select(key, by, value, F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep")).withColumn("u", u).withColumn("w", w)
    means = long.groupBy(by, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("m"))
    return means.groupBy(by).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.avg("m").alias("mean"), F.percentile("m", F.lit(0.975)).alias("high"))


def launch_draws(comparables: DataFrame, by: str, log_mean: str, log_sd: str, price: float, cost: float, elasticity: float, sims: int = 2000, seed: int = 13) -> DataFrame:
    """(by, p10, p50, p90, p_loss): monthly profit of a launch, units log-normal around the comparables and changed by the price."""
    sim = comparables.select(by, log_mean, log_sd, F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"))
    u = lambda tag: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), F.col("sim"), F.col(by)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    z = F.sqrt(-2 * F.log(u("r"))) * F.cos(2 * math.pi * u("a"))
    units = F.exp(F.col(log_mean) + F.col(log_sd) * z) * math.pow(price / 100.0, elasticity)
    p = sim.withColumn("profit", units * (price - cost))
    q = lambda x, n: F.percentile("profit", F.lit(x)).alias(n)
    return p.groupBy(by).agg(q(0.1, "p10"), q(0.5, "p50"), q(0.9, "p90"), F.avg((F.col("profit") < 1000).cast("double")).alias("p_loss"))


def pooled_growth(df: DataFrame, by: str, slope: str, variance: str) -> DataFrame:
    """Random-effects mean of slopes (DerSimonian and Laird), between-group variance and a 95 % interval, from four sums."""
    w = 1 / F.col(variance)
    s = df.where(F.col(variance) > 0).agg(F.count(F.lit(1)).alias("k"), F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(w * F.col(slope)).alias("wy"), F.sum(w * F.col(slope) * F.col(slope)).alias("wyy"))
    q = F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w")
    tau = F.greatest(F.lit(0.0), F.coalesce(F.try_divide(q - (F.col("k") - 1), F.col("w") - F.col("w2") / F.col("w")), F.lit(0.0)))
    j = df.where(F.col(variance) > 0).crossJoin(F.broadcast(s.select("k", tau.alias("tau2")))).withColumn("wr", 1 / (F.col(variance) + F.col("tau2")))
    g = j.groupBy("k", "tau2").agg((F.sum(F.col("wr") * F.col(slope)) / F.sum("wr")).alias("growth"), F.sqrt(1 / F.sum("wr")).alias("se"))
    return g.select("k", "tau2", "growth", (F.col("growth") - 1.96 * F.col("se")).alias("low"), (F.col("growth") + 1.96 * F.col("se")).alias("high"))


def taxonomy_segments(df: DataFrame, key: str, family: str, text: str, least: int = 12, share: float = 0.12, smallest: int = 3) -> DataFrame:
    """(key, segment, confidence): a family of at least ``least`` rows is split by its most distinctive words, one segment per word
    that at least ``smallest`` and ``share`` of its rows hold; the rest of a family stays together.

    A row goes to its most distinctive such word: the one whose share within the family exceeds its share overall most (ties: the
    smaller word). One pass over words, whatever the size of a family."""
    words = df.select(key, family, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("w"))
    rows = df.groupBy(family).agg(F.count(F.lit(1)).alias("rows"))
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("all")))
    overall = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    own = words.groupBy(family, "w").agg(F.count(F.lit(1)).alias("k")).join(rows, family).join(overall, "w").crossJoin(n)
    lift = F.col("k") / F.col("rows") / (F.col("df") / F.col("all"))
    heads = own.where((F.col("rows") >= least) & (F.col("k") >= smallest) & (F.col("k") >= share * F.col("rows")) & (F.col("k") < F.col("rows"))).select(family, "w", lift.alias("lift"))
    pick = words.join(heads, [family, "w"]).groupBy(key, family).agg(F.max(F.struct(F.round("lift", 9).alias("l"), F.col("w"))).alias("b"))
    out = df.select(key, family).join(pick, [key, family], "left")
    return out.select(key, F.concat_ws("/", family, F.coalesce("b.w", F.lit("other"))).alias("segment"), F.when(F.col("b").isNull(), 0.6).otherwise(1.0).alias("confidence"))


def density_groups(df: DataFrame, key: str, by: str, columns: list[str], eps: float, least: int = 4) -> DataFrame:
    """(key, cluster): density clusters per group over a few columns; -1 is noise, else the smallest core id.

    Rows meet only rows of their own and the neighbouring cells of a grid of width ``eps``, so no group is gathered; core rows
    within ``eps`` are linked, and components of links are the clusters."""
    from marketloom.functions.scale import connected_components

    cell = [F.floor(F.col(c) / eps) for c in columns]
    base = df.dropna(subset=columns).select(key, by, *columns, F.array(*cell).alias("cell"))
    shifts = [[]]
    for _ in columns:
        shifts = [s + [d] for s in shifts for d in (-1, 0, 1)]
    moved = F.array(*[F.array(*[F.get("cell", F.lit(i)) + d for i, d in enumerate(s)]) for s in shifts])
    a = base.select(F.col(key).alias("a"), F.col(by).alias("g"), *[F.col(c).alias(f"a_{c}") for c in columns], F.explode(moved).alias("cell"))
    b = base.select(F.col(key).alias("b"), F.col(by).alias("g"), *[F.col(c).alias(f"b_{c}") for c in columns], "cell")
    gap = F.sqrt(sum((F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in columns), F.lit(0.0)))
    near = a.join(b, ["g", "cell"]).where(gap <= eps).select("a", "b")
    core = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("a").alias("c"))
    links = near.join(core, F.col("a") == F.col("c"), "left_semi").join(core.withColumnRenamed("c", "d"), F.col("b") == F.col("d"), "left_semi")
    roots = connected_components(links.where("a < b")).toDF("c", "root")
    of_core = core.join(roots, "c", "left").select("c", F.coalesce("root", "c").alias("root"))
    border = near.join(of_core, F.col("b") == F.col("c")).groupBy(F.col("a").alias(key)).agg(F.min("root").alias("cluster"))
    return df.select(key).join(border, key, "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def synthetic_market(spark, listings: int, seed: int = 21, slope: float = 0.8, sd: float = 0.7) -> DataFrame:
    """id, segment, brand, price, x, units_true, badge: a market whose truth is known, from hashes of seed and id."""
    from marketloom.operators.scores import LADDER

    u = lambda tag: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), F.col("id")), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    z = lambda tag: F.sqrt(-2 * F.log(u(f"{tag}r"))) * F.cos(2 * math.pi * u(f"{tag}a"))
    df = spark.range(listings).withColumns({"segment": F.concat(F.lit("s"), F.floor(u("s") * 5).cast("string")), "brand": F.concat(F.lit("b"), F.floor(F.pow(u("b"), 2) * 20).cast("string")), "price": F.round(20 + 80 * u("p"), 2), "x": z("x")})
    df = df.withColumn("units_true", F.exp(4 + slope * F.col("x") + sd * z("e")))
    rungs = F.array(*[F.lit(x) for x in LADDER])
    return df.withColumn("badge", F.array_max(F.filter(rungs, lambda r: r <= F.col("units_true"))))


def compare_launches(comparables: DataFrame, by: str, log_mean: str, log_sd: str, offers: list[tuple[str, float, float]], elasticity: float = -1.2, sims: int = 1000, seed: int = 17) -> DataFrame:
    """(by, offer, mean_profit, p_best): offers (name, price, cost) under common random numbers, so that differences are the offers'."""
    sim = comparables.select(by, log_mean, log_sd, F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"))
    u = lambda tag: (F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), F.col("sim"), F.col(by)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    units = F.exp(F.col(log_mean) + F.col(log_sd) * F.sqrt(-2 * F.log(u("r"))) * F.cos(2 * math.pi * u("a")))
    each = F.array(*[F.struct(F.lit(n).alias("offer"), (units * math.pow(p / 100.0, elasticity) * (p - c)).alias("profit")) for n, p, c in offers])
    s = sim.withColumn("o", each)
    best = F.aggregate("o", F.get("o", F.lit(0)), lambda a, x: F.when(x["profit"] > a["profit"], x).otherwise(a)).getField("offer")
    rows = s.withColumn("best", best).select(by, "best", F.explode("o").alias("o"))
    return rows.groupBy(by, F.col("o.offer").alias("offer")).agg(F.avg("o.profit").alias("mean_profit"), F.avg((F.col("best") == F.col("o.offer")).cast("double")).alias("p_best"))
