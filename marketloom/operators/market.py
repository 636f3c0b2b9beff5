"""Market size, concentration, price structure and brand tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.expr import weighted_mean


def coverage(c: str) -> Column:
    """Share of rows where the column is known."""
    return F.avg(F.col(c).isNotNull().cast("double"))


def totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Listings, known sales and revenue, and how much of each is known. A total without a known value is null, never 0."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("listings"), F.sum("sales").alias("sales"), F.sum("revenue").alias("revenue"),
        coverage("sales").alias("sales_coverage"), coverage("revenue").alias("revenue_coverage"),
    )


def shares(df: DataFrame, by: list[str], member: str, value: str) -> DataFrame:
    """Each member's value and share within its group; groups without a positive total have null shares."""
    known = df.groupBy(*by, member).agg(F.sum(value).alias("value"))
    total = F.sum("value").over(W.partitionBy(*by))
    return known.withColumn("share", F.when(total > 0, F.col("value") / total))


def concentration(df: DataFrame, by: list[str], member: str, value: str) -> DataFrame:
    """HHI (0 to 10 000), leader, and the share of the first 1, 3, 5 and 10 members; ties go to the smaller name."""
    s = shares(df.where(F.col(member).isNotNull()), by, member, value)
    s = s.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc_nulls_last("value"), member)))
    first = lambda k: F.sum(F.when(F.col("place") <= k, F.col("share"))).alias(f"top{k}_share")
    return s.groupBy(*by).agg(
        F.sum(F.pow(F.col("share") * 100, 2)).alias("hhi"), F.max(F.when((F.col("place") == 1) & F.col("share").isNotNull(), F.col(member))).alias("leader"),
        F.count(F.lit(1)).alias("members"), first(1), first(3), first(5), first(10),
    )


def hhi_label(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), None).when(c < 1500, "fragmented").when(c < 2500, "moderate").otherwise("concentrated")


def price_tiers(df: DataFrame, by: list[str], price: str = "price", low: float = 0.33, high: float = 0.66) -> DataFrame:
    """Lower and upper tier bounds at exact quantiles; null for fewer than three prices."""
    q = df.groupBy(*by).agg(F.count(price).alias("prices"), F.percentile(price, F.array(F.lit(low), F.lit(high))).alias("q"))
    bound = lambda i: F.when(F.col("prices") >= 3, F.get("q", F.lit(i)))
    return q.select(*by, "prices", bound(0).alias("tier_low"), bound(1).alias("tier_high"))


def segment_capacity(df: DataFrame, by: str = "segment", brand: str = "brand") -> DataFrame:
    """Size, coverage, concentration and price structure of each segment; shares are of all segments."""
    size = totals(df, [by]).join(df.groupBy(by).agg(F.count_distinct(brand).alias("brands"), F.median("price").alias("median_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price")), by)
    every = W.partitionBy(F.lit(0))
    size = size.withColumn("revenue_share", F.try_divide(F.col("revenue"), F.sum("revenue").over(every)))
    hhi = concentration(df, [by], brand, "revenue").select(by, "hhi", "leader", F.col("top1_share").alias("leader_share"), "top3_share")
    tiers = price_tiers(df, [by])
    prices = df.join(tiers, by)
    counts = prices.groupBy(by).agg(
        F.sum((F.col("price") <= F.col("tier_low")).cast("long")).alias("budget"), F.sum(((F.col("price") > F.col("tier_low")) & (F.col("price") <= F.col("tier_high"))).cast("long")).alias("middle"),
        F.sum((F.col("price") > F.col("tier_high")).cast("long")).alias("premium"),
    )
    return size.join(hhi, by, "left").join(tiers.drop("prices"), by, "left").join(counts, by, "left").withColumn("structure", hhi_label("hhi"))


def product_master(listings: DataFrame, key: list[str], at: str = "id") -> DataFrame:
    """One row per product: most frequent brand and segment (ties: smaller), price range, known totals, rating by reviews
    (unknown counts weigh 1), sellers, best listing (most sales, then reviews, then first) and the sorted listing ids."""
    weight = F.greatest(F.coalesce(F.col("reviews"), F.lit(1)), F.lit(1)).cast("double")
    best = F.max_by(at, F.struct(F.coalesce("sales", F.lit(-1.0)), F.coalesce(F.col("reviews").cast("double"), F.lit(-1.0)), -F.col(at)))
    return listings.groupBy(*key).agg(
        F.count(F.lit(1)).alias("listings"), F.mode("brand", True).alias("main_brand"), F.mode("segment", True).alias("main_segment"), F.min("price").alias("min_price"),
        F.max("price").alias("max_price"), F.median("price").alias("median_price"), F.sum("sales").alias("sales"), F.sum("revenue").alias("revenue"), coverage("sales").alias("sales_coverage"),
        weighted_mean(F.col("rating"), weight).alias("rating"), F.count_distinct("seller").alias("sellers"), best.alias("best_listing"), F.array_sort(F.collect_list(at)).alias("listing_ids"),
    )


def product_id(ids: Column | str) -> Column:
    """P and twelve hex digits of the SHA-1 of the sorted ids joined by a pipe."""
    return F.concat(F.lit("P"), F.substring(F.sha1(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), "|").cast("binary")), 1, 12))


def bayes_rating(df: DataFrame, by: list[str], rating: str, weight: str) -> DataFrame:
    """Group ratings pulled to the overall weighted mean with the strength of the median weight of rated rows."""
    rated = df.where(F.col(rating).isNotNull()).withColumn("_w", F.col(weight).cast("double"))
    prior = rated.agg(F.median("_w").alias("c"), F.try_divide(F.sum(F.col("_w") * F.col(rating)), F.sum("_w")).alias("m"))
    g = rated.groupBy(*by).agg(F.sum(F.col("_w") * F.col(rating)).alias("wr"), F.sum("_w").alias("w"), F.count(F.lit(1)).alias("rated"))
    return g.crossJoin(F.broadcast(prior)).select(*by, "rated", ((F.col("c") * F.col("m") + F.col("wr")) / (F.col("c") + F.col("w"))).alias("bayes_rating"))


def brand_table(df: DataFrame, as_of: Column, entrant_days: int = 365) -> DataFrame:
    """Listings, segments, prices against the segment's median, entrants and the top segment of each brand."""
    mid = df.join(df.groupBy("segment").agg(F.median("price").alias("_mid")), "segment", "left").withColumn("_index", F.try_divide(F.col("price"), F.col("_mid")))
    entrant = F.when(F.col("launched").isNotNull(), (F.datediff(as_of, "launched") <= entrant_days).cast("double"))
    base = mid.groupBy("brand").agg(
        F.count(F.lit(1)).alias("listings"), F.count_distinct("segment").alias("segments"), F.median("price").alias("median_price"), F.median("_index").alias("price_index"),
        F.avg(entrant).alias("entrant_share"), F.sum("revenue").alias("revenue"),
    )
    tops = df.groupBy("brand", "segment").agg(F.count(F.lit(1)).alias("n")).groupBy("brand").agg(F.min_by("segment", F.struct(-F.col("n"), "segment")).alias("top_segment"))
    return base.join(tops, "brand")
