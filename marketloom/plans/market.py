"""Market size, concentration and price structure over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import expr as X
from marketloom.functions.scale import exact_medians
from marketloom.operators import market as M
from marketloom.plans.base import MONTH, Book
from marketloom.session import materialize

Q = Book()
QUERIES, SQL = Q.queries, Q.sql
r6 = lambda c: F.round(c, 6)


def rounded(df, *cols):
    return df.withColumns({c: r6(F.col(c)) for c in cols})


@Q.add("F1_market_totals", """SELECT segment, count(*) AS listings, sum(sales) AS sales, sum(revenue) AS revenue, round(avg((sales IS NOT NULL)::INT), 6) AS sales_coverage,
  round(avg((revenue IS NOT NULL)::INT), 6) AS revenue_coverage FROM listing GROUP BY segment""")
def f1(v):
    return rounded(M.totals(v.listing, ["segment"]), "sales_coverage", "revenue_coverage").orderBy(F.desc_nulls_last("revenue"), "segment")


@Q.add("F2_brand_leaderboard", """SELECT brand, count(*) AS listings, sum(revenue) AS revenue, round(avg(price), 6) AS avg_price, count(DISTINCT segment) AS markets FROM listing
  GROUP BY brand ORDER BY revenue DESC NULLS LAST, brand LIMIT 10""")
def f2(v):
    g = v.listing.groupBy("brand").agg(F.count(F.lit(1)).alias("listings"), F.sum("revenue").alias("revenue"), r6(F.avg("price")).alias("avg_price"), F.count_distinct("segment").alias("markets"))
    return g.orderBy(F.desc_nulls_last("revenue"), "brand").limit(10)


@Q.add("F3_scoped_brands", """WITH b AS (SELECT segment, brand, count(*) AS n, sum(revenue) AS rev FROM listing GROUP BY ALL)
  SELECT brand, count(*) AS markets, sum(n)::BIGINT AS listings, round(sum(rev), 4) AS revenue, round(max(rev), 4) AS best_market_revenue FROM b GROUP BY brand""")
def f3(v):
    b = v.listing.groupBy("segment", "brand").agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").alias("rev"))
    return b.groupBy("brand").agg(F.count(F.lit(1)).alias("markets"), F.sum("n").alias("listings"), F.round(F.sum("rev"), 4).alias("revenue"), F.round(F.max("rev"), 4).alias("best_market_revenue"))


def _sold(v):
    """Listings of one seller each: a fact row is a listing, its product is the (brand, title) pair."""
    return v.listing.withColumns({"reviews": F.col("size"), "rating": F.when(F.col("size") % 5 != 0, (F.col("size") % 5).cast("double")), "seller": F.col("size") % 7})


_SOLD = "sold AS (SELECT *, size AS reviews, CASE WHEN size % 5 <> 0 THEN (size % 5)::DOUBLE END AS rating, size % 7 AS seller FROM listing)"


@Q.add("F4_product_master", f"""WITH {_SOLD},
  g AS (SELECT title, segment AS part, count(*) AS listings, min(price) AS min_price, max(price) AS max_price, round(median(price), 6) AS median_price, sum(sales) AS sales, round(sum(revenue), 4) AS revenue,
    round(avg((sales IS NOT NULL)::INT), 6) AS sales_coverage, round(sum(rating * greatest(reviews, 1)) / nullif(sum(CASE WHEN rating IS NOT NULL THEN greatest(reviews, 1) END), 0), 6) AS rating, count(DISTINCT seller) AS sellers,
    arg_max(id, (coalesce(sales, -1), reviews::DOUBLE, -id)) AS best_listing, array_to_string(list_sort(list(id)), ',') AS listing_ids FROM sold GROUP BY ALL),
  m AS (SELECT title, segment AS part, brand, row_number() OVER (PARTITION BY title, segment ORDER BY count(*) DESC, brand) AS k FROM sold GROUP BY title, segment, brand)
  SELECT g.title, g.part AS segment, listings, m.brand AS main_brand, g.part AS main_segment, min_price, max_price, median_price, sales, revenue, sales_coverage, rating, sellers, best_listing, listing_ids
  FROM g JOIN m ON m.title = g.title AND m.part = g.part AND k = 1""")
def f4(v):
    p = M.product_master(_sold(v), ["title", "segment"])
    return rounded(p, "median_price", "sales_coverage", "rating").withColumn("revenue", F.round("revenue", 4)).withColumn("listing_ids", F.array_join(F.transform("listing_ids", lambda x: x.cast("string")), ","))


@Q.add("F5_best_listing", f"WITH {_SOLD} SELECT brand, arg_max(id, (coalesce(sales, -1), reviews, -id)) AS best_listing, max(sales) AS best_sales FROM sold GROUP BY brand")
def f5(v):
    rows = X.latest(_sold(v), ["brand"], [F.desc_nulls_last("sales"), F.desc_nulls_last("reviews"), F.col("id")])
    return rows.select("brand", F.col("id").alias("best_listing"), F.col("sales").alias("best_sales"))


@Q.add("F6_group_mode", """WITH c AS (SELECT segment, brand, count(*) AS n FROM listing GROUP BY ALL)
  SELECT segment, brand AS main_brand FROM c QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, brand) = 1""")
def f6(v):
    return v.listing.groupBy("segment").agg(F.mode("brand", True).alias("main_brand"))


_SHARE = """bs AS (SELECT segment, brand, sum(revenue) AS value FROM listing GROUP BY ALL),
  sh AS (SELECT *, CASE WHEN sum(value) OVER (PARTITION BY segment) > 0 THEN value / sum(value) OVER (PARTITION BY segment) END AS share,
    row_number() OVER (PARTITION BY segment ORDER BY value DESC NULLS LAST, brand) AS place FROM bs),
  cc AS (SELECT segment, sum(power(share * 100, 2)) AS hhi, max(CASE WHEN place = 1 AND share IS NOT NULL THEN brand END) AS leader, count(*) AS members,
    sum(CASE WHEN place <= 1 THEN share END) AS top1, sum(CASE WHEN place <= 3 THEN share END) AS top3, sum(CASE WHEN place <= 5 THEN share END) AS top5, sum(CASE WHEN place <= 10 THEN share END) AS top10 FROM sh GROUP BY segment)"""
_TIERS = """tt AS (SELECT segment, CASE WHEN count(price) >= 3 THEN quantile_cont(price, 0.33) END AS tier_low, CASE WHEN count(price) >= 3 THEN quantile_cont(price, 0.66) END AS tier_high FROM listing GROUP BY segment)"""


@Q.add("F7_segment_capacity", f"""WITH {_SHARE}, {_TIERS},
  a AS (SELECT segment, count(*) AS listings, sum(sales) AS sales, sum(revenue) AS revenue, avg((sales IS NOT NULL)::INT) AS sales_coverage, avg((revenue IS NOT NULL)::INT) AS revenue_coverage,
    count(DISTINCT brand) AS brands, median(price) AS median_price, min(price) AS min_price, max(price) AS max_price FROM listing GROUP BY segment),
  n AS (SELECT l.segment, count(*) FILTER (WHERE price <= tier_low) AS budget, count(*) FILTER (WHERE price > tier_low AND price <= tier_high) AS middle, count(*) FILTER (WHERE price > tier_high) AS premium
    FROM listing l JOIN tt USING (segment) GROUP BY l.segment)
  SELECT segment, listings, sales, round(revenue, 4) AS revenue, round(sales_coverage, 6) AS sales_coverage, round(revenue_coverage, 6) AS revenue_coverage, brands, round(median_price, 6) AS median_price, min_price, max_price,
    round(revenue / sum(revenue) OVER (), 6) AS revenue_share, round(hhi, 6) AS hhi, leader, round(top1, 6) AS leader_share, round(top3, 6) AS top3_share, round(tier_low, 6) AS tier_low, round(tier_high, 6) AS tier_high,
    budget, middle, premium, CASE WHEN hhi < 1500 THEN 'fragmented' WHEN hhi < 2500 THEN 'moderate' ELSE 'concentrated' END AS structure
  FROM a LEFT JOIN cc USING (segment) LEFT JOIN tt USING (segment) LEFT JOIN n USING (segment)""")
def f7(v):
    c = M.segment_capacity(v.listing)
    return rounded(c, "sales_coverage", "revenue_coverage", "median_price", "revenue_share", "hhi", "leader_share", "top3_share", "tier_low", "tier_high").withColumn("revenue", F.round("revenue", 4))


@Q.add("F8_hhi", f"WITH {_SHARE} SELECT segment, round(hhi, 6) AS hhi, CASE WHEN hhi < 1500 THEN 'fragmented' WHEN hhi < 2500 THEN 'moderate' ELSE 'concentrated' END AS label FROM cc")
def f8(v):
    return M.concentration(v.listing, ["segment"], "brand", "revenue").select("segment", r6(F.col("hhi")).alias("hhi"), M.hhi_label("hhi").alias("label"))


@Q.add("F9_concentration", f"""WITH {_SHARE} SELECT segment, leader, members, round(top1, 6) AS top1_share, round(top3, 6) AS top3_share, round(top5, 6) AS top5_share, round(top10, 6) AS top10_share,
  round(1 - top10, 6) AS long_tail_share FROM cc""")
def f9(v):
    c = M.concentration(v.listing, ["segment"], "brand", "revenue").withColumn("long_tail_share", 1 - F.col("top10_share")).drop("hhi")
    return rounded(c, "top1_share", "top3_share", "top5_share", "top10_share", "long_tail_share")


@Q.add("F10_price_tiers", f"WITH {_TIERS} SELECT segment, (SELECT count(price) FROM listing l WHERE l.segment = tt.segment) AS prices, round(tier_low, 6) AS tier_low, round(tier_high, 6) AS tier_high FROM tt")
def f10(v):
    return rounded(M.price_tiers(v.listing, ["segment"]), "tier_low", "tier_high")


@Q.add("F11_price_distribution", """SELECT segment, min(price) AS min_price, max(price) AS max_price, round(avg(price), 6) AS avg_price, round(median(price), 6) AS median_price,
  count(*) FILTER (WHERE price < 950) AS low, count(*) FILTER (WHERE price >= 950 AND price < 1000) AS mid, count(*) FILTER (WHERE price >= 1000) AS high FROM listing GROUP BY segment""")
def f11(v):
    n = lambda cond, name: F.sum(F.when(cond, 1).otherwise(0)).alias(name)
    p = F.col("price")
    return v.listing.groupBy("segment").agg(F.min(p).alias("min_price"), F.max(p).alias("max_price"), r6(F.avg(p)).alias("avg_price"), r6(F.median(p)).alias("median_price"), n(p < 950, "low"), n((p >= 950) & (p < 1000), "mid"), n(p >= 1000, "high"))


@Q.add("F12_category_metrics", """WITH p AS (SELECT segment, title, sum(sales) AS sales, sum(revenue) AS revenue, count(*) AS n FROM listing GROUP BY ALL)
  SELECT segment, count(*) AS products, sum(n)::BIGINT AS listings, sum(sales) AS sales, round(sum(revenue), 4) AS revenue, round(sum(sales) * 12, 4) AS annual_sales, round(sum(n) / count(*), 6) AS listings_per_product FROM p GROUP BY segment""")
def f12(v):
    p = v.listing.groupBy("segment", "title").agg(F.sum("sales").alias("sales"), F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("n"))
    return p.groupBy("segment").agg(F.count(F.lit(1)).alias("products"), F.sum("n").alias("listings"), F.sum("sales").alias("sales"), F.round(F.sum("revenue"), 4).alias("revenue"), F.round(F.sum("sales") * 12, 4).alias("annual_sales"), r6(F.sum("n") / F.count(F.lit(1))).alias("listings_per_product"))


@Q.add("F13_type_distribution", "SELECT coalesce(CASE WHEN size % 10 <> 0 THEN segment END, 'unclassified') AS type, count(*) AS n FROM listing GROUP BY 1")
def f13(v):
    return v.listing.groupBy(F.coalesce(F.when(F.col("size") % 10 != 0, F.col("segment")), F.lit("unclassified")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@Q.add("F14_leaf_intelligence", """WITH s AS (SELECT 'category' AS scope, 'all' AS scope_id, * FROM listing UNION ALL SELECT 'segment', segment, * FROM listing UNION ALL SELECT 'brand', brand, * FROM listing)
  SELECT scope, scope_id, count(*) AS listings, count(DISTINCT brand) AS brands, sum(sales) AS sales, round(quantile_cont(price, 0.25), 6) AS p25, round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.75), 6) AS p75 FROM s GROUP BY ALL""")
def f14(v):
    scoped = v.listing.withColumn("s", F.explode(F.array(F.struct(F.lit("category").alias("scope"), F.lit("all").alias("scope_id")), F.struct(F.lit("segment").alias("scope"), F.col("segment").alias("scope_id")), F.struct(F.lit("brand").alias("scope"), F.col("brand").alias("scope_id")))))
    g = scoped.groupBy("s.scope", "s.scope_id").agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("brand").alias("brands"), F.sum("sales").alias("sales"), F.percentile("price", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return g.select("scope", "scope_id", "listings", "brands", "sales", *[r6(F.get("q", F.lit(i))).alias(n) for i, n in enumerate(("p25", "p50", "p75"))])


@Q.add("F15_bayes_rating", f"""WITH {_SOLD}, k AS (SELECT median(reviews) AS c, sum(reviews * rating) / sum(reviews) AS m FROM sold WHERE rating IS NOT NULL)
  SELECT brand, count(*) AS rated, round((c * m + sum(reviews * rating)) / (c + sum(reviews)), 6) AS bayes_rating FROM sold, k WHERE rating IS NOT NULL GROUP BY brand, c, m""")
def f15(v):
    return rounded(M.bayes_rating(_sold(v), ["brand"], "rating", "reviews"), "bayes_rating")


@Q.add("F16_brand_table", f"""WITH m AS (SELECT *, price / median(price) OVER (PARTITION BY segment) AS idx FROM listing),
  t AS (SELECT brand, segment, row_number() OVER (PARTITION BY brand ORDER BY count(*) DESC, segment) AS k FROM listing GROUP BY brand, segment)
  SELECT m.brand, count(*) AS listings, count(DISTINCT m.segment) AS segments, round(median(price), 6) AS median_price, round(median(idx), 6) AS price_index,
    round(avg((date_diff('day', launched::DATE, DATE '{MONTH}') <= 365)::INT), 6) AS entrant_share, round(sum(revenue), 4) AS revenue, any_value(t.segment) AS top_segment
  FROM m JOIN t ON t.brand = m.brand AND k = 1 GROUP BY m.brand""")
def f16(v):
    return rounded(M.brand_table(v.listing, F.lit(MONTH).cast("date")), "median_price", "price_index", "entrant_share").withColumn("revenue", F.round("revenue", 4))


@Q.add("F17_launch_cohorts", """WITH c AS (SELECT date_trunc('quarter', launched)::TIMESTAMP AS cohort, count(*) AS listings, sum(revenue) AS revenue FROM listing WHERE launched IS NOT NULL GROUP BY 1)
  SELECT cohort, listings, round(listings / sum(listings) OVER (), 6) AS listing_share, round(revenue / listings, 6) AS revenue_per_listing FROM c ORDER BY cohort DESC LIMIT 8""")
def f17(v):
    c = v.listing.where("launched IS NOT NULL").groupBy(F.date_trunc("quarter", "launched").cast("timestamp_ntz").alias("cohort")).agg(F.count(F.lit(1)).alias("listings"), F.sum("revenue").alias("revenue"))
    c = c.withColumn("listing_share", r6(F.col("listings") / F.sum("listings").over(W.partitionBy(F.lit(0)))))
    return c.select("cohort", "listings", "listing_share", r6(F.col("revenue") / F.col("listings")).alias("revenue_per_listing")).orderBy(F.desc("cohort")).limit(8)


@Q.add("F18_cohort_momentum", f"""WITH a AS (SELECT *, date_diff('day', launched::DATE, DATE '{MONTH}') AS age FROM listing)
  SELECT segment, round(avg(CASE WHEN age IS NOT NULL THEN (age <= 1000)::INT END), 6) AS new_listing_share, round(sum(CASE WHEN age <= 1000 THEN revenue END) / sum(revenue), 6) AS new_revenue_share, round(median(age), 6) AS median_age FROM a GROUP BY segment""")
def f18(v):
    a = v.listing.withColumn("age", F.datediff(F.lit(MONTH).cast("date"), "launched"))
    new = F.col("age") <= 1000
    return a.groupBy("segment").agg(r6(F.avg(new.cast("double"))).alias("new_listing_share"), r6(F.try_divide(F.sum(F.when(new, F.col("revenue"))), F.sum("revenue"))).alias("new_revenue_share"), r6(F.median("age")).alias("median_age"))


@Q.add("F19_period_series", """SELECT coalesce(segment, '__market__') AS scope, period, sum(sales) AS sales, round(sum(revenue), 4) AS revenue FROM history GROUP BY GROUPING SETS ((period), (segment, period))""")
def f19(v):
    g = v.history.groupingSets([["period"], ["segment", "period"]], "segment", "period").agg(F.sum("sales").alias("sales"), F.round(F.sum("revenue"), 4).alias("revenue"))
    return g.select(F.coalesce("segment", F.lit("__market__")).alias("scope"), "period", "sales", "revenue")


@Q.add("F23_supplier_price_level", """WITH q AS (SELECT l_suppkey AS supplier, l_extendedprice / l_quantity AS quote FROM lineitem), a AS (SELECT median(quote) AS m FROM q)
  SELECT supplier, round(median(quote) / m, 6) AS level, CASE WHEN median(quote) / m <= 0.95 THEN 'low' WHEN median(quote) / m >= 1.05 THEN 'high' ELSE 'typical' END AS label FROM q, a GROUP BY supplier, m""")
def f23(v):
    q = v.table("lineitem").select(F.col("l_suppkey").alias("supplier"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("quote"))
    # a supplier has few quotes, the market all of them: its median isn't taken in one task
    counts = materialize(q.groupBy("quote").agg(F.count(F.lit(1)).alias("n")), "quotes")
    mids, middle = q.groupBy("supplier").agg(F.median("quote").alias("mid")), exact_medians(counts, [], "quote", "n", "m")
    level = mids.crossJoin(F.broadcast(middle)).withColumn("level", F.col("mid") / F.col("m"))
    return level.select("supplier", r6(F.col("level")).alias("level"), F.when(F.col("level") <= 0.95, "low").when(F.col("level") >= 1.05, "high").otherwise("typical").alias("label"))


@Q.add("F25_keyword_summary", """WITH k AS (SELECT event_type AS segment, user_id AS keyword, count(*) AS searches, avg(value) AS rate FROM events GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY searches DESC, keyword) AS place FROM k)
  SELECT segment, count(*) AS keywords, sum(searches)::BIGINT AS searches, round(sum(searches * rate) / sum(searches), 6) AS rate, string_agg(keyword::VARCHAR, ',' ORDER BY place) FILTER (WHERE place <= 5) AS top5 FROM r GROUP BY segment""")
def f25(v):
    k = v.table("events").groupBy(F.col("event_type").alias("segment"), F.col("user_id").alias("keyword")).agg(F.count(F.lit(1)).alias("searches"), F.avg("value").alias("rate"))
    r = k.withColumn("place", F.row_number().over(W.partitionBy("segment").orderBy(F.desc("searches"), "keyword")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", F.col("keyword").cast("string").alias("k"))))), lambda x: x["k"]), ",")
    return r.groupBy("segment").agg(F.count(F.lit(1)).alias("keywords"), F.sum("searches").alias("searches"), r6(X.weighted_mean("rate", "searches")).alias("rate"), top.alias("top5"))


@Q.add("F33_field_coverage", """SELECT 'brand' AS field, count(*) AS n, round(avg((coalesce(trim(brand), '') <> '')::INT), 6) AS coverage FROM listing UNION ALL
  SELECT 'sales', count(*), round(avg((sales IS NOT NULL)::INT), 6) FROM listing UNION ALL SELECT 'title', count(*), round(avg((coalesce(trim(title), '') <> '')::INT), 6) FROM listing""")
def f33(v):
    share = lambda c: r6(F.avg((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("double"))).alias(c)
    one = v.listing.agg(F.count(F.lit(1)).alias("n"), *[share(c) for c in ("brand", "sales", "title")])
    return one.unpivot("n", ["brand", "sales", "title"], "field", "coverage").select("field", "n", "coverage")


@Q.add("F36_confusion_matrix", """SELECT d.lang AS actual, count(*) FILTER (WHERE l.quality = 1) AS kept, count(*) FILTER (WHERE l.quality = 0) AS dropped,
  round(count(*) FILTER (WHERE l.quality = 1 AND l.toxic = 0) / nullif(count(*) FILTER (WHERE l.quality = 1), 0), 6) AS clean_share FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang""", views=False)
def f36(v):
    j = v.table("documents").select("doc_id", "lang").join(v.table("labels"), "doc_id")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    good = F.col("quality") == 1
    return j.groupBy(F.col("lang").alias("actual")).agg(n(good).alias("kept"), n(~good).alias("dropped"), r6(F.try_divide(n(good & (F.col("toxic") == 0)), n(good))).alias("clean_share"))


@Q.add("F40_geo_rollup", """WITH s AS (SELECT s_nationkey AS k, count(*) AS suppliers, round(avg(s_acctbal), 6) AS mean_balance FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS k, count(*) AS customers, max(c_acctbal) AS best FROM customer GROUP BY 1)
  SELECT n_name AS country, coalesce(suppliers, 0) AS suppliers, mean_balance, coalesce(customers, 0) AS customers, best FROM s FULL OUTER JOIN c ON s.k = c.k JOIN nation ON n_nationkey = coalesce(s.k, c.k)""", views=False)
def f40(v):
    s = v.table("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"), r6(F.avg("s_acctbal")).alias("mean_balance"))
    c = v.table("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("best"))
    j = s.join(c, "k", "full_outer").join(v.table("nation"), F.col("n_nationkey") == F.col("k"))
    return j.select(F.col("n_name").alias("country"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), "mean_balance", F.coalesce("customers", F.lit(0)).alias("customers"), "best")


@Q.add("F41_universe_tree", """SELECT r_name AS industry, string_agg(n_name, ',' ORDER BY n_name) AS branches, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""", views=False)
def f41(v):
    j = v.table("region").join(v.table("nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("industry")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("branches"), F.count(F.lit(1)).alias("n"))


@Q.add("F43_overview", """SELECT count(*) AS listings, count(DISTINCT brand) AS brands, count(DISTINCT segment) AS segments, sum(sales) AS sales, round(sum(revenue), 4) AS revenue, round(avg((sales IS NOT NULL)::INT), 6) AS coverage FROM listing""")
def f43(v):
    return v.listing.agg(F.count(F.lit(1)).alias("listings"), F.count_distinct("brand").alias("brands"), F.count_distinct("segment").alias("segments"), F.sum("sales").alias("sales"), F.round(F.sum("revenue"), 4).alias("revenue"), r6(M.coverage("sales")).alias("coverage"))


@Q.add("F44_usage_metering", """SELECT user_id, count(*) AS n, round(sum(value), 4) AS used FROM events WHERE ts >= date_trunc('month', (SELECT max(ts) FROM events)) GROUP BY user_id""", views=False)
def f44(v):
    e = v.table("events")
    now = F.broadcast(e.agg(F.date_trunc("month", F.max("ts")).cast("timestamp_ntz").alias("since")))
    return e.join(now, F.col("ts") >= F.col("since")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("used"))


@Q.add("F48_pivot_observations", """SELECT date_trunc('hour', ts)::TIMESTAMP AS observed_at, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS click, arg_max(value, event_id) FILTER (WHERE event_type = 'error') AS error,
  arg_max(value, event_id) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1""", views=False)
def f48(v):
    at = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("observed_at")
    return v.table("events").groupBy(at).pivot("event_type", ["click", "error", "purchase"]).agg(F.max_by("value", "event_id"))


@Q.add("F53_portfolio", """SELECT c_mktsegment AS owner, count(*) AS orders, count(DISTINCT c_nationkey) AS markets, round(sum(o_totalprice), 2) AS value FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY value DESC""", views=False)
def f53(v):
    j = v.table("customer").join(v.table("orders"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("owner")).agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("c_nationkey").alias("markets"), F.round(F.sum("o_totalprice"), 2).alias("value")).orderBy(F.desc("value"))
