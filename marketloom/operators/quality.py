"""Record quality: rejection, scores, rules, currency, schema evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.expr import violations

#: What a missing field costs, and what an issue costs.
FIELD_WEIGHTS = (("title", 25), ("price", 15), ("sales", 15), ("brand", 5), ("revenue", 5))
ISSUE_PENALTIES = (("invalid_price", 30), ("revenue_mismatch", 10))
MISMATCH = 0.35


def rejections(df: DataFrame, title: str, price: str, key: list, order: str, shortest: int, floor: float) -> DataFrame:
    """Adds ``reasons``: why a row is rejected, in order; the first row of a key in ``order`` is no duplicate."""
    again = F.row_number().over(W.partitionBy(*key).orderBy(order)) > 1
    rules = [(F.coalesce(F.length(title) < shortest, F.lit(True)), "missing_title"), (F.col(price).isNull(), "missing_price"), (F.col(price) <= floor, "invalid_price"), (again, "duplicate_record")]
    return df.withColumn("reasons", violations(*rules))


def to_base_currency(df: DataFrame, rates: DataFrame, currency: str, amount: str) -> DataFrame:
    """Adds ``amount`` in base currency. An unknown currency is an error, never a guess."""
    j = df.join(F.broadcast(rates.withColumnRenamed("currency", "_cur")), F.col(currency) == F.col("_cur"), "left")
    checked = F.when(F.col("rate").isNull(), F.raise_error(F.concat(F.lit("no rate for currency "), F.coalesce(F.col(currency), F.lit("null"))))).otherwise(F.col("rate"))
    return j.withColumn("amount", F.col(amount) * checked.cast("double")).drop("_cur", "rate")


def quality_score(df: DataFrame) -> DataFrame:
    """Adds confidence (0 to 100) and issues. Missing fields and issues cost points; a derived revenue is not compared."""
    off = F.try_divide(F.abs(F.col("price") * F.col("sales") - F.col("revenue")), F.col("revenue")) > MISMATCH
    df = df.withColumn("issues", violations((F.col("price") <= 0, "invalid_price"), (off, "revenue_mismatch")))
    missing = lambda c: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", 1).otherwise(0)
    cost = sum((missing(c) * w for c, w in FIELD_WEIGHTS), F.lit(0)) + sum((F.when(F.array_contains("issues", n), p).otherwise(0) for n, p in ISSUE_PENALTIES), F.lit(0))
    return df.withColumn("confidence", F.greatest(F.lit(0), 100 - cost))


def fingerprint(text: str, words: int = 3, shortest: int = 3) -> Column:
    """The longest words (ties by alphabet), sorted and joined."""
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1), lambda w: F.length(w) >= shortest))
    ranked = F.array_sort(F.transform(found, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.array_join(F.array_sort(F.transform(F.slice(ranked, 1, words), lambda x: x["w"])), " ")


def badge_count(text: Column) -> Column:
    """Units of a "1K+ bought" badge; null if there is no number."""
    n = F.regexp_extract(text, r"^(\d+)", 1).try_cast("long")
    return n * F.when(text.rlike(r"^\d+K"), 1000).otherwise(1)


def certification_score(text: str, weights: dict[str, float]) -> Column:
    """Sum of the two best matched weights over 1.8, at most 1; 0.1 for text without a match, null without text."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.lower(text), F.lit(k)), F.lit(w)) for k, w in weights.items()]))
    best = F.aggregate(F.slice(F.sort_array(hits, False), 1, 2), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.col(text).isNull(), None).when(F.size(hits) == 0, F.lit(0.1)).otherwise(F.least(F.lit(1.0), best / 1.8))


def identity_fit(df: DataFrame, quantity: str, price: str, candidates: list[str], low: float = 0.6, high: float = 1.6) -> DataFrame:
    """Share of rows in which a candidate is about price times quantity, for each candidate."""
    fit = lambda c: F.avg(((F.try_divide(F.col(c), F.col(quantity) * F.col(price)) > low) & (F.try_divide(F.col(c), F.col(quantity) * F.col(price)) < high)).cast("double")).alias(c)
    return df.agg(*[fit(c) for c in candidates]).unpivot([], candidates, "candidate", "fit")


def first_rule(rules: list[tuple[str, Column, Column | None]]) -> Column:
    """Name of the first rule whose condition holds and whose escape, if any, does not."""
    return F.coalesce(*[F.when(cond if escape is None else cond & ~escape, F.lit(name)) for name, cond, escape in rules])


def product_type(df: DataFrame, signals: DataFrame, title: str = "title", key: str = "id") -> DataFrame:
    """Type with most distinct whole-word signals: 0.95 sure if it is the only one, else 0.5 (ties by name). No signal, no row."""
    words = df.select(key, F.explode(F.array_distinct(F.split(title, " "))).alias("sig"))
    n = words.join(F.broadcast(signals), "sig").groupBy(key, "kind").agg(F.count_distinct("sig").alias("n"))
    w = W.partitionBy(key)
    n = n.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "kind"))).withColumn("kinds", F.count(F.lit(1)).over(w))
    return n.where("k = 1").select(key, "kind", F.when(F.col("kinds") == 1, F.lit(0.95)).otherwise(0.5).alias("confidence"))
