"""Families split into segments by many small k-means at once, and titles joined by average linkage; no family is in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators import ngrams as NG
from marketloom.session import materialize

#: Most segments that a family is tried with, and steps of its k-means.
MOST, STEPS = 6, 12
NO_FAMILY = "(none)"
DIGITS = 12


def family_rows(df: DataFrame, key: str, family: str, text: str) -> DataFrame:
    """(id, family, text): rows with a key, equal ones once; a missing family is one of its own, a missing text is empty."""
    named = df.select(F.col(key).alias("id"), F.coalesce(F.col(family).cast("string"), F.lit(NO_FAMILY)).alias("family"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return named.where("id IS NOT NULL").distinct()


def family_vectors(rows: DataFrame, most: int = 1, sublinear: bool = False, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(id, family, t, w): vectors of length one over the words (and with ``most`` of 2 also pairs of words) of (id, family, text).

    A word weighs its count times ln((1 + texts) / (1 + texts with it)) + 1, both counted in its family. A text without words has no rows.
    With a column n, a row counts as n texts."""
    rows = rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))
    grams = F.filter(NG.word_grams(F.col("text"), most), lambda g: ~g.isin(*ignored) if ignored else F.lit(True))
    tf = materialize(rows.select("id", "family", "n", F.explode(grams).alias("t")).groupBy("id", "family", "t").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n")), "words")
    texts = rows.groupBy("family").agg(F.sum("n").alias("texts"))
    seen = tf.groupBy("family", "t").agg(F.sum("n").alias("df")).join(texts, "family").select("family", "t", (F.log((1.0 + F.col("texts")) / (1 + F.col("df"))) + 1).alias("idf"))
    count = 1 + F.log(F.col("tf").cast("double")) if sublinear else F.col("tf").cast("double")
    raw = tf.join(seen, ["family", "t"]).select("id", "family", "t", (count * F.col("idf")).alias("w"))
    size = raw.groupBy("id", "family").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, ["id", "family"]).select("id", "family", "t", (F.col("w") / F.col("size")).alias("w"))


def _slots(ks: list[int]) -> list[tuple[int, int]]:
    return [(k, c) for k in ks for c in range(k)]


def _meet(vectors: DataFrame, labels: DataFrame, ks: list[int]) -> DataFrame:
    """Every row of ``labels`` (id, family, n, l<k>: its class among k, null for none) with the inner product of its vector and each class's
    sum (d<k>_<c>), and the class's rows (n<k>_<c>) and length of its sum (r<k>_<c>). A row counts n times; the join is one row per word of a text."""
    slots = _slots(ks)
    sums = vectors.join(labels, ["id", "family"]).groupBy("family", "t").agg(*[F.sum(F.when(F.col(f"l{k}") == c, F.col("n") * F.col("w"))).alias(f"s{k}_{c}") for k, c in slots])
    sums = materialize(sums.select("family", "t", *[F.coalesce(f"s{k}_{c}", F.lit(0.0)).alias(f"s{k}_{c}") for k, c in slots]), "sums")
    sizes = labels.groupBy("family").agg(*[F.sum(F.when(F.col(f"l{k}") == c, F.col("n")).otherwise(0)).alias(f"n{k}_{c}") for k, c in slots])
    lengths = sums.groupBy("family").agg(*[F.sqrt(F.sum(F.pow(f"s{k}_{c}", F.lit(2.0)))).alias(f"r{k}_{c}") for k, c in slots])
    dots = vectors.join(sums, ["family", "t"]).groupBy("id", "family").agg(*[F.sum(F.col("w") * F.col(f"s{k}_{c}")).alias(f"d{k}_{c}") for k, c in slots], F.lit(True).alias("worded"))
    met = labels.join(dots, ["id", "family"], "left").join(sizes, "family").join(lengths, "family", "left")
    return met.fillna(0.0, [f"{x}{k}_{c}" for x in "dr" for k, c in slots]).withColumn("worded", F.coalesce("worded", F.lit(False)))


def _nearest(k: int, score) -> Column:
    """The class of the highest score; ties and no score at all go to the smaller number."""
    each = [F.struct(F.coalesce(F.round(score(c), DIGITS), F.lit(-1.0)).alias("s"), F.lit(-c).alias("c")) for c in range(k)]
    return -F.array_max(F.array(*each))["c"]


def _cosine(k: int, c: int) -> Column:
    return F.when(F.col(f"r{k}_{c}") > 0, F.col(f"d{k}_{c}") / F.col(f"r{k}_{c}"))


def _silhouette(k: int) -> Column:
    """A row's silhouette by cosine distance, from sums alone: the mean distance of a unit vector to a class is 1 - x . sum / n, so no
    pair of rows meets. Rows without words, alone in their class, or in a family of one class have 0."""
    own, rest = F.lit(None).cast("double"), []
    for c in range(k):
        n, d, mine = F.col(f"n{k}_{c}"), F.col(f"d{k}_{c}"), F.col(f"l{k}") == c
        own = F.when(mine & (n > 1), (n - d) / (n - 1)).otherwise(own)
        rest.append(F.when(~mine & (n > 0), 1 - d / n))
    other = F.array_min(F.array(*rest))
    value = F.when(F.greatest(own, other) > 0, (other - own) / F.greatest(own, other)).otherwise(0.0)
    return F.when(F.col("worded") & own.isNotNull() & other.isNotNull(), value).otherwise(0.0)


def _mean(value: Column) -> Column:
    return F.sum(F.col("n") * value) / F.sum("n")


def _seeds(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, family, d0 ... d<MOST - 1>): inner products with the seeds of a row's family. The first seed is the row with the least hash, each
    later one the row that is farthest from the seeds before it (ties: the least hash, then the least id)."""
    found = rows.select("id", "family", "n")
    for j in range(MOST):
        far = F.greatest(*[F.col(f"d{i}") for i in range(j)], F.lit(-1.0)) if j else F.lit(0.0)
        pick = found.groupBy("family").agg(F.min(F.struct(F.round(far, DIGITS).alias("far"), F.xxhash64("id").alias("h"), F.col("id"))).alias("p")).select("family", F.col("p.id").alias("id"))
        seed = vectors.join(pick, ["id", "family"]).select("family", "t", F.col("w").alias("v"))
        dots = vectors.join(seed, ["family", "t"]).groupBy("id", "family").agg(F.sum(F.col("w") * F.col("v")).alias(f"d{j}"))
        found = materialize(found.join(dots, ["id", "family"], "left").fillna(0.0, [f"d{j}"]), "seeds")
    return found


def split_families(df: DataFrame, key: str, family: str, text: str, least: int = 12, bound: float = 0.12, share: float = 0.05, smallest: int = 3, largest: int = 10, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(key, family, segment, segments, silhouette, confidence) of every row: families of at least ``least`` rows are split where their
    texts form distinct groups, the others are one segment.

    All families take their k-means together, for 2 to ``MOST`` classes at once: centres are one table (family, word) with a column per
    class, and a step is one join of words with it, whatever the number and size of families. Equal texts of a family are one row with
    its count; it stands for the key of the least hash. The k of the highest mean silhouette wins
    (ties: the smaller). Classes below ``share`` of the family, held between ``smallest`` and ``largest`` rows, go row by row to the
    nearest class that stays. The split is kept if two classes stay and the mean silhouette then is ``bound`` or more.
    ``segment`` counts from 0, ``silhouette`` is null where nothing was tried or one class stayed, ``confidence`` is the cosine to the
    segment's centre (1 in a family that stays whole).

    Rows with a null key are left out and equal rows count once; a key is expected in one row. A null family is ``NO_FAMILY``; a text
    without words goes to the first class with a silhouette of 0. k-means ends when nothing moves, or after ``STEPS`` steps."""
    ks = list(range(2, MOST + 1))
    rows = materialize(family_rows(df, key, family, text), "rows")
    alike = rows.groupBy("family", "text").agg(F.min(F.struct(F.xxhash64("id").alias("h"), F.col("id"))).alias("head"), F.count(F.lit(1)).alias("n"))
    alike = materialize(alike.select(F.col("head.id").alias("id"), "family", "text", "n"), "alike")
    count = alike.groupBy("family").agg(F.sum("n").alias("rows"))
    tried = alike.join(count.where(F.col("rows") >= least).select("family"), "family", "left_semi")
    vectors = materialize(family_vectors(tried, ignored=ignored), "vectors")
    start = _seeds(vectors, tried)
    labels = materialize(start.select("id", "family", "n", *[_nearest(k, lambda c: F.col(f"d{c}")).alias(f"l{k}") for k in ks]), "labels")
    for _ in range(STEPS):
        met = _meet(vectors, labels, ks)
        moved = reduce(Column.__or__, [F.col(f"l{k}") != F.col(f"m{k}") for k in ks])
        step = met.select("id", "family", "n", *[f"l{k}" for k in ks], *[_nearest(k, lambda c, k=k: _cosine(k, c)).alias(f"m{k}") for k in ks])
        step = materialize(step.withColumn("moved", moved), "step")
        labels = step.select("id", "family", "n", *[F.col(f"m{k}").alias(f"l{k}") for k in ks])
        if step.where("moved").isEmpty():
            break
    quality = _meet(vectors, labels, ks).groupBy("family").agg(*[_mean(_silhouette(k)).alias(f"q{k}") for k in ks])
    best = F.array_max(F.array(*[F.struct(F.round(f"q{k}", DIGITS).alias("q"), F.lit(-k).alias("k")) for k in ks]))
    chosen = quality.select("family", (-best["k"]).alias("k"))
    label = F.coalesce(*[F.when(F.col("k") == k, F.col(f"l{k}")) for k in ks])
    one = materialize(labels.join(chosen, "family").select("id", "family", "n", label.alias("c")), "chosen")

    needed = F.greatest(F.lit(smallest), F.least(F.lit(largest), F.round(F.col("rows") * share)))
    large = one.groupBy("family", "c").agg(F.sum("n").alias("n")).join(count, "family").where(F.col("n") >= needed)
    large = large.select("family", "c", F.col("c").alias(f"l{MOST}"))
    kept = materialize(one.join(large, ["family", "c"], "left").select("id", "family", "n", f"l{MOST}"), "kept")
    near = F.coalesce(F.col(f"l{MOST}"), F.when(reduce(Column.__add__, [F.col(f"n{MOST}_{c}") for c in range(MOST)]) > 0, _nearest_kept()), F.lit(0))
    merged = materialize(_meet(vectors, kept, [MOST]).select("id", "family", "n", near.alias(f"l{MOST}")), "merged")

    met = materialize(_meet(vectors, merged, [MOST]), "met")
    classes = reduce(Column.__add__, [(F.col(f"n{MOST}_{c}") > 0).cast("int") for c in range(MOST)])
    of_family = met.groupBy("family").agg(F.max(classes).alias("classes"), _mean(_silhouette(MOST)).alias("silhouette"))
    of_family = of_family.select("family", F.when(F.col("classes") > 1, F.col("silhouette")).alias("silhouette"), ((F.col("classes") > 1) & (F.round("silhouette", DIGITS) >= bound)).alias("split"))
    before = reduce(Column.__add__, [((F.col(f"n{MOST}_{c}") > 0) & (F.col(f"l{MOST}") > c)).cast("int") for c in range(MOST)])
    own = F.coalesce(*[F.when(F.col(f"l{MOST}") == c, _cosine(MOST, c)) for c in range(MOST)], F.lit(0.0))
    parts = met.select(F.col("id").alias("head"), "family", before.alias("place"), classes.alias("classes"), F.least(F.greatest(own, F.lit(0.0)), F.lit(1.0)).alias("near"))
    parts = materialize(alike.select(F.col("id").alias("head"), "family", "text").join(parts, ["head", "family"], "left").join(of_family, "family", "left"), "parts")
    out = rows.join(parts, ["family", "text"])
    if_split = lambda c, other: F.when(F.coalesce("split", F.lit(False)), F.col(c)).otherwise(other)
    return out.select(F.col("id").alias(key), "family", if_split("place", F.lit(0)).alias("segment"), if_split("classes", F.lit(1)).alias("segments"), "silhouette", if_split("near", F.lit(1.0)).alias("confidence"))


def _nearest_kept() -> Column:
    """The nearest class that has rows: a class without any can't win a tie."""
    each = [F.when(F.col(f"n{MOST}_{c}") > 0, F.struct(F.round(F.coalesce(_cosine(MOST, c), F.lit(0.0)), DIGITS).alias("s"), F.lit(-c).alias("c"))) for c in range(MOST)]
    return -F.array_max(F.array(*each))["c"]
