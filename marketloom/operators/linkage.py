"""Average linkage over titles, in rounds of reciprocal nearest clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import ngrams as NG
from marketloom.operators.families import family_rows, family_vectors
from marketloom.session import materialize


def _nearest(asks: DataFrame, data: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine): the cluster nearest to each of ``asks`` (id, t, w), if the mean cosine of their members is above ``least``.

    Vectors are means of unit vectors, so their inner product is the mean over all pairs. Equal means are ordered by the smaller and
    then the larger id of the pair, so that the best pair of all is the nearest one of both its ends."""
    none = asks.sparkSession.createDataFrame([], "id long, bound double")
    pairs = NG.candidates(asks, data, none, least).where("a <> b")
    found = NG._cosines(pairs, NG._packed(asks), NG._packed(data)).where(F.col("cosine") > least)
    order = F.struct((-F.col("cosine")).alias("c"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return found.groupBy("a").agg(F.min_by(F.struct("b", "cosine"), order).alias("n")).select("a", "n.b", "n.cosine")


def average_linkage(points: DataFrame, vectors: DataFrame, distance: float) -> DataFrame:
    """(id, cluster): merges of the two nearest clusters by mean cosine distance, as long as it is below ``distance`` (below 1).

    ``points``: id (long), size (equal texts that it stands for); ``vectors``: id, t (long), w: non-negative unit vectors. ``cluster`` is
    the smallest id in it. A merge never brings two clusters nearer to a third than the nearer of them was. So all pairs of clusters
    that are nearest to each other merge in one round with the outcome of one merge after the other, and a cluster asks again only if it
    or its nearest one has merged; one that nothing is near to is done. Candidates come from bounded postings: common words alone, too
    light to reach the bound, join nothing. A cluster is held as its mean, at most the words of its texts."""
    least = 1.0 - distance
    clusters, means = materialize(points.select("id", "size"), "clusters"), materialize(vectors.select("id", "t", "w"), "means")
    labels = materialize(points.select("id", F.col("id").alias("cluster")), "labels")
    near = materialize(_nearest(means, means, least), "near")
    while True:
        turned = near.select(F.col("b").alias("a"), F.col("a").alias("b"))
        merges = materialize(near.where("a < b").select("a", "b").join(turned, ["a", "b"]), "merges")
        if merges.isEmpty():
            break
        home = merges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        gone = materialize(home.select("id").union(home.select("root")), "gone")
        labels = materialize(labels.join(home.toDF("cluster", "root"), "cluster", "left").select("id", F.coalesce("root", "cluster").alias("cluster")), "labels")
        sized = clusters.join(home, "id", "left").withColumn("root", F.coalesce("root", "id"))
        whole = sized.groupBy("root").agg(F.sum("size").alias("size"))
        heavy = means.join(sized, "id").groupBy("root", "t").agg(F.sum(F.col("w") * F.col("size")).alias("w"))
        active = near.select(F.col("a").alias("id")).join(home, "id", "left_anti")
        means = materialize(heavy.join(whole, "root").select(F.col("root").alias("id"), "t", (F.col("w") / F.col("size")).alias("w")).join(active, "id", "left_semi"), "means")
        clusters = materialize(whole.toDF("id", "size"), "clusters")
        still = near.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b", "cosine")
        again = active.join(still.select(F.col("a").alias("id")), "id", "left_anti")
        near = materialize(still.unionByName(_nearest(materialize(means.join(again, "id", "left_semi"), "asks"), means, least)), "near")
    return labels


def title_models(df: DataFrame, key: str, segment: str, text: str, distance: float = 0.75, smallest: int = 2) -> DataFrame:
    """(key, segment, model, products): texts of a segment joined by average linkage over weighted words and pairs of words.

    ``model`` is the smallest key in the group and null below ``smallest`` rows; ``products`` counts the group. Every group size takes
    the same way: there is no limit on a segment. ``key`` is a long that names one row; null keys are left out, equal rows count once, a null
    segment is one of its own. Texts of no word stay alone. Equal texts of a segment are one point with a size."""
    rows = materialize(family_rows(df, key, segment, text).withColumn("id", F.col("id").cast("long")), "rows")
    unit = family_vectors(rows, most=2, sublinear=True)
    worded = F.size(NG.words_of(F.col("text"))) > 0
    heads = rows.select("id", "family", F.when(worded, F.sha2("text", 256)).otherwise(F.concat(F.lit("#"), F.col("id").cast("string"))).alias("hash"))
    heads = materialize(heads, "hashed")
    group = materialize(heads.groupBy("family", "hash").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("size")), "groups")
    heads = materialize(heads.join(group, ["family", "hash"]), "heads")
    points = heads.where("id = head").select("id", "size")
    vectors = unit.join(points.select("id"), "id", "left_semi").select("id", F.xxhash64("family", "t").alias("t"), "w")
    found = average_linkage(points, vectors, distance)
    members = materialize(heads.join(found.toDF("head", "cluster"), "head").select("id", "family", "cluster"), "members")
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("products"))
    out = members.join(sizes, "cluster")
    return out.select(F.col("id").alias(key), F.col("family").alias("segment"), F.when(F.col("products") >= smallest, F.col("cluster")).alias("model"), "products")
