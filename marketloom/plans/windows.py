"""Window functions, sorts, set operations and joins over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import expr as X
from marketloom.operators import ranking as R
from marketloom.plans.base import MONTH, PREVIOUS, Book

Q = Book()
QUERIES, SQL = Q.queries, Q.sql
r6 = lambda c: F.round(c, 6)
month = lambda m: F.lit(m).cast("timestamp_ntz")
_RANK = "(rank() OVER (PARTITION BY segment ORDER BY sales) + (count(*) OVER (PARTITION BY segment, sales) - 1) / 2)"


@Q.add("G1_rank_share", f"SELECT id, round(CASE WHEN count(*) OVER (PARTITION BY segment) = 1 THEN 1.0 ELSE {_RANK} / count(*) OVER (PARTITION BY segment) END, 6) AS pct FROM listing WHERE sales IS NOT NULL UNION ALL SELECT id, NULL FROM listing WHERE sales IS NULL")
def g1(v):
    return R.with_rank_share(v.listing, "sales", ["segment"]).select("id", r6(F.col("pct")).alias("pct"))


@Q.add("G2_min_rank_desc", "SELECT id, rank() OVER (ORDER BY price DESC)::BIGINT AS place FROM listing")
def g2(v):
    # ranks by counting the prices above: one row per price in the window, not one per listing
    prices = v.listing.groupBy("price").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(W.orderBy(F.desc("price")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return v.listing.join(prices.withColumn("place", above + 1), "price").select("id", "place")


@Q.add("G3_rank_bands", """WITH r AS (SELECT id, segment, row_number() OVER (PARTITION BY segment ORDER BY price, id) AS k, count(*) OVER (PARTITION BY segment) AS n FROM listing)
  SELECT id, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((k - 1) * 4 / (n - 1))) END::INT AS band FROM r""")
def g3(v):
    return R.rank_bands(v.listing, "price", ["segment"], 4, "id").select("id", "band")


@Q.add("G4_quartiles", f"""WITH p AS (SELECT id, segment, count(*) OVER (PARTITION BY segment) AS n, {_RANK} / count(*) OVER (PARTITION BY segment) AS pct FROM listing WHERE sales IS NOT NULL)
  SELECT l.id, CASE WHEN n >= 4 THEN ceil(pct * 4) END::INT AS quartile FROM listing l LEFT JOIN p USING (id)""")
def g4(v):
    n = v.listing.groupBy("segment").agg(F.count("sales").alias("n"))
    d = R.with_rank_share(v.listing, "sales", ["segment"]).join(n, "segment")
    return d.select("id", F.when(F.col("n") >= 4, F.ceil(F.col("pct") * 4)).cast("int").alias("quartile"))


@Q.add("G5_position_vs_peers", """SELECT id, round(((rank() OVER (PARTITION BY segment ORDER BY price) - 1) + 0.5 * count(*) OVER (PARTITION BY segment, price)) / count(*) OVER (PARTITION BY segment), 6) AS position FROM listing""")
def g5(v):
    return R.position_vs_peers(v.listing, "price", ["segment"]).select("id", r6(F.col("position")).alias("position"))


@Q.add("G6_latest_snapshot", "SELECT id, period, sales FROM snapshot QUALIFY row_number() OVER (PARTITION BY id ORDER BY period DESC) = 1")
def g6(v):
    return v.snapshot.groupBy("id").agg(F.max("period").alias("period"), F.max_by("sales", "period").alias("sales"))


@Q.add("G7_keep_first", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1", views=False)
def g7(v):
    return X.latest(v.table("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@Q.add("G8_last_two_observations", """WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL)
  SELECT user_id, event_type, max(value) FILTER (WHERE k = 1) AS now, max(value) FILTER (WHERE k = 2) AS before, round(max(value) FILTER (WHERE k = 1) - max(value) FILTER (WHERE k = 2), 6) AS change FROM r WHERE k <= 2 GROUP BY ALL""", views=False)
def g8(v):
    top = X.top_per_group(v.table("events").where("value IS NOT NULL"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 2)
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("value")))
    return top.groupBy("user_id", "event_type").agg(at(1).alias("now"), at(2).alias("before"), r6(at(1) - at(2)).alias("change"))


@Q.add("G9_jumps", """WITH l AS (SELECT id, period, sales, lag(sales) OVER (PARTITION BY id ORDER BY period) AS prev FROM snapshot)
  SELECT id, period, round(sales / prev, 6) AS ratio, CASE WHEN sales / prev > 5 THEN 'high' ELSE 'medium' END AS severity FROM l WHERE prev > 0 AND sales / prev > 2""")
def g9(v):
    l = v.snapshot.withColumn("prev", F.lag("sales").over(W.partitionBy("id").orderBy("period"))).where("prev > 0")  # noqa: E741
    l = l.withColumn("ratio", F.col("sales") / F.col("prev")).where("ratio > 2")  # noqa: E741
    return l.select("id", "period", r6(F.col("ratio")).alias("ratio"), F.when(F.col("ratio") > 5, "high").otherwise("medium").alias("severity"))


@Q.add("G10_group_broadcast", "SELECT id, round(median(price) OVER (PARTITION BY segment), 6) AS segment_median, count(*) OVER (PARTITION BY brand) AS brand_listings FROM listing")
def g10(v):
    mid = v.listing.groupBy("segment").agg(r6(F.median("price")).alias("segment_median"))
    n = v.listing.groupBy("brand").agg(F.count(F.lit(1)).alias("brand_listings"))
    return v.listing.select("id", "segment", "brand").join(mid, "segment").join(n, "brand").select("id", "segment_median", "brand_listings")


@Q.add("G11_moving_average", """WITH m AS (SELECT segment, period, sum(sales) AS sales FROM history GROUP BY ALL)
  SELECT segment, period, CASE WHEN count(*) OVER w >= 6 THEN round(avg(sales) OVER w, 6) END AS trend, lag(sales, 12) OVER (PARTITION BY segment ORDER BY period) AS year_before FROM m WINDOW w AS (PARTITION BY segment ORDER BY period ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)""")
def g11(v):
    m = v.history.groupBy("segment", "period").agg(F.sum("sales").alias("sales"))
    o = W.partitionBy("segment").orderBy("period")
    w = o.rowsBetween(-6, 5)
    return m.select("segment", "period", F.when(F.count("sales").over(w) >= 6, r6(F.avg("sales").over(w))).alias("trend"), F.lag("sales", 12).over(o).alias("year_before"))


@Q.add("G12_trailing_forecast", "WITH m AS (SELECT segment, period, sum(sales) AS sales FROM history GROUP BY ALL) SELECT segment, period, round(avg(sales) OVER (PARTITION BY segment ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS forecast FROM m")
def g12(v):
    m = v.history.groupBy("segment", "period").agg(F.sum("sales").alias("sales"))
    return m.select("segment", "period", r6(F.avg("sales").over(W.partitionBy("segment").orderBy("period").rowsBetween(-2, 0))).alias("forecast"))


@Q.add("G13_first_last_growth", """SELECT brand, count(DISTINCT period) AS periods, arg_min(sales, period) AS first, arg_max(sales, period) AS last,
  round(CASE WHEN count(DISTINCT period) >= 3 THEN (arg_max(sales, period) - arg_min(sales, period)) / nullif(abs(arg_min(sales, period)), 0) * 100 END, 6) AS growth_pct
  FROM (SELECT brand, period, sum(sales) AS sales FROM history GROUP BY ALL) GROUP BY brand""")
def g13(v):
    m = v.history.groupBy("brand", "period").agg(F.sum("sales").alias("sales"))
    return R.growth_between(m, ["brand"], "sales").withColumn("growth_pct", r6(F.col("growth_pct")))


@Q.add("G14_group_anomalies", """WITH x AS (SELECT *, ln(sales) AS lp FROM listing WHERE sales > 0), m AS (SELECT *, median(lp) OVER (PARTITION BY segment) AS mid, count(*) OVER (PARTITION BY segment) AS n FROM x),
  d AS (SELECT *, median(abs(lp - mid)) OVER (PARTITION BY segment) AS mad FROM m)
  SELECT id, round(abs(lp - mid) / (1.4826 * mad), 6) AS z FROM d WHERE n >= 3 AND mad > 0 AND abs(lp - mid) / (1.4826 * mad) > 1.5 AND exp(abs(lp - mid)) > 1.5""")
def g14(v):
    x = v.listing.where("sales > 0").withColumn("lp", F.log("sales"))
    g = x.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.median("lp").alias("mid"))
    z = R.robust_z(x, "lp", ["segment"], 1 / 1.4826).join(g, "segment")
    return z.where((F.col("n") >= 3) & (F.abs("z") > 1.5) & (F.exp(F.abs(F.col("lp") - F.col("mid"))) > 1.5)).select("id", r6(F.abs("z")).alias("z"))


@Q.add("G15_iqr_outliers", """WITH q AS (SELECT event_type, count(*) AS n, quantile_cont(ln(1 + value), 0.25) AS a, quantile_cont(ln(1 + value), 0.75) AS b FROM events GROUP BY 1)
  SELECT event_id FROM events JOIN q USING (event_type) WHERE n >= 8 AND b > a AND (ln(1 + value) < a - 1.5 * (b - a) OR ln(1 + value) > b + 1.5 * (b - a))""", views=False)
def g15(v):
    return R.iqr_outliers(v.table("events"), "value", ["event_type"], 1.5).where("outlier").select("event_id")


@Q.add("G16_robust_z", """WITH m AS (SELECT *, median(value) OVER (PARTITION BY event_type) AS mid FROM events), d AS (SELECT *, median(abs(value - mid)) OVER (PARTITION BY event_type) AS mad FROM m)
  SELECT event_id, round(0.6745 * (value - mid) / mad, 6) AS z FROM d WHERE abs(0.6745 * (value - mid) / mad) > 3.5""", views=False)
def g16(v):
    return R.robust_z(v.table("events"), "value", ["event_type"]).where(F.abs("z") > 3.5).select("event_id", r6(F.col("z")).alias("z"))


@Q.add("G17_cumulative_share", """WITH b AS (SELECT segment, brand, sum(revenue) AS rev FROM listing GROUP BY ALL HAVING sum(revenue) IS NOT NULL)
  SELECT segment, brand, round(rev / sum(rev) OVER (PARTITION BY segment), 6) AS share, round(sum(rev) OVER (PARTITION BY segment ORDER BY rev DESC, brand ROWS UNBOUNDED PRECEDING) / sum(rev) OVER (PARTITION BY segment), 6) AS cumulative FROM b""")
def g17(v):
    b = v.listing.groupBy("segment", "brand").agg(F.sum("revenue").alias("rev")).where("rev IS NOT NULL")
    total = F.sum("rev").over(W.partitionBy("segment"))
    run = F.sum("rev").over(W.partitionBy("segment").orderBy(F.desc("rev"), "brand").rowsBetween(W.unboundedPreceding, 0))
    return b.select("segment", "brand", r6(F.col("rev") / total).alias("share"), r6(run / total).alias("cumulative"))


@Q.add("G18_largest_remainder", """WITH s AS (SELECT segment, count(*) AS n FROM listing GROUP BY 1), e AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS want FROM s),
  r AS (SELECT *, floor(want) AS base, row_number() OVER (ORDER BY want - floor(want) DESC, segment) AS k, 100 - sum(floor(want)) OVER () AS left_over FROM e) SELECT segment, (base + (k <= left_over)::INT)::BIGINT AS quota FROM r""")
def g18(v):
    every = W.partitionBy(F.lit(0))
    e = v.listing.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).withColumn("want", F.lit(100.0) * F.col("n") / F.sum("n").over(every)).withColumn("base", F.floor("want"))
    k = F.row_number().over(every.orderBy(F.desc(F.col("want") - F.col("base")), "segment"))
    return e.withColumn("extra", (k <= 100 - F.sum("base").over(every)).cast("long")).select("segment", (F.col("base") + F.col("extra")).alias("quota"))


@Q.add("G19_sales_tiers", """WITH r AS (SELECT id, row_number() OVER (PARTITION BY segment ORDER BY sales, id) AS k, count(*) OVER (PARTITION BY segment) AS n FROM listing WHERE sales IS NOT NULL)
  SELECT l.id, coalesce(CASE WHEN n IS NULL THEN NULL WHEN n = 1 THEN 'low' ELSE ['low', 'mid', 'high'][greatest(1, ceil((k - 1) * 3 / (n - 1)))::INT] END, 'unknown') AS tier FROM listing l LEFT JOIN r USING (id)""")
def g19(v):
    b = R.rank_bands(v.listing, "sales", ["segment"], 3, "id")
    return b.select("id", F.coalesce(F.get(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), F.col("band") - 1), F.lit("unknown")).alias("tier"))


@Q.add("G20_brand_changes", f"""WITH a AS (SELECT brand, sum(revenue) AS rev, count(*) AS n FROM history WHERE period = TIMESTAMP '{PREVIOUS}' GROUP BY 1), b AS (SELECT brand, sum(revenue) AS rev, count(*) AS n FROM history WHERE period = TIMESTAMP '{MONTH}' GROUP BY 1)
  SELECT brand, round(coalesce(b.rev, 0) / (SELECT sum(rev) FROM b) - coalesce(a.rev, 0) / (SELECT sum(rev) FROM a), 6) AS share_change, (coalesce(b.n, 0) - coalesce(a.n, 0))::BIGINT AS listing_change FROM a FULL OUTER JOIN b USING (brand)""")
def g20(v):
    def at(m, s):
        g = v.history.where(F.col("period") == month(m)).groupBy("brand").agg(F.sum("revenue").alias("rev"), F.count(F.lit(1)).alias(f"n{s}"))
        return g.withColumn(f"share{s}", F.col("rev") / F.sum("rev").over(W.partitionBy(F.lit(0)))).drop("rev")

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = at(PREVIOUS, 0).join(at(MONTH, 1), "brand", "full_outer")
    return j.select("brand", r6(zero("share1") - zero("share0")).alias("share_change"), (zero("n1") - zero("n0")).alias("listing_change"))


@Q.add("G21_auc", """WITH s AS (SELECT quality, length(text) AS x FROM documents JOIN labels USING (doc_id)), r AS (SELECT quality, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rk FROM s)
  SELECT round((sum(rk) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2) / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 6) AS auc FROM r""", views=False)
def g21(v):
    # rank sums from counts per score: the window sees one row per distinct score
    s = v.table("documents").join(v.table("labels"), "doc_id").groupBy(F.length("text").alias("x")).agg(F.sum("quality").cast("double").alias("pos"), F.sum(1 - F.col("quality")).cast("double").alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    return s.agg(r6(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg"))).alias("auc"))


@Q.add("G22_spearman", f"""WITH k AS (SELECT * FROM listing WHERE sales IS NOT NULL), r AS (SELECT segment, rank() OVER (PARTITION BY segment ORDER BY price) + (count(*) OVER (PARTITION BY segment, price) - 1) / 2 AS a, {_RANK} AS b FROM k)
  SELECT segment, round(corr(a, b), 6) AS spearman FROM r GROUP BY segment""")
def g22(v):
    return R.spearman(v.listing, "price", "sales", ["segment"]).withColumn("spearman", r6(F.col("spearman")))


@Q.add("G23_bh_qvalues", """WITH p AS (SELECT user_id, 1.0::DOUBLE / (1 + count(*)) AS p FROM events GROUP BY 1), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, user_id) AS raw, row_number() OVER (ORDER BY p, user_id) AS k FROM p)
  SELECT user_id, round(least(1, min(raw) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""", views=False)
def g23(v):
    p = v.table("events").groupBy("user_id").agg((F.lit(1.0) / (1 + F.count(F.lit(1)))).alias("p"))
    return X.bh_qvalues(p, "p", tie=("user_id",)).select("user_id", r6(F.col("q")).alias("q"))


@Q.add("H1_order_limit_offset", "SELECT id, title, revenue FROM listing ORDER BY revenue DESC NULLS LAST, id LIMIT 20 OFFSET 10")
def h1(v):
    return v.listing.select("id", "title", "revenue").orderBy(F.desc_nulls_last("revenue"), "id").offset(10).limit(20)


@Q.add("H2_top_k_per_group", "SELECT segment, brand, n, k FROM (SELECT segment, brand, count(*) AS n, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, brand)::INT AS k FROM listing GROUP BY segment, brand) WHERE k <= 3")
def h2(v):
    n = v.listing.groupBy("segment", "brand").agg(F.count(F.lit(1)).alias("n"))
    return X.top_per_group(n, ["segment"], [F.desc("n"), F.col("brand")], 3, "k")


@Q.add("H4_board_order", "SELECT id, row_number() OVER (PARTITION BY brand ORDER BY sales IS NULL, sales DESC, price DESC, id)::INT AS place FROM listing")
def h4(v):
    w = W.partitionBy("brand").orderBy(F.col("sales").isNull(), F.desc("sales"), F.desc("price"), "id")
    return v.listing.select("id", F.row_number().over(w).alias("place"))


@Q.add("H5_search_rank", """SELECT title, n, CASE WHEN title = 'red' THEN 0 WHEN starts_with(title, 'red') THEN 1 WHEN regexp_matches(title, '\\bred\\b') THEN 2 ELSE 3 END AS kind FROM (SELECT title, count(*) AS n FROM listing WHERE contains(title, 'red') GROUP BY title)""")
def h5(v):
    t = F.col("title")
    hits = v.listing.where(t.contains("red")).groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(t == "red", 0).when(t.startswith("red"), 1).when(t.rlike(r"\bred\b"), 2).otherwise(3)
    return hits.withColumn("kind", kind).orderBy("kind", F.length("title"), "title")


@Q.add("H6_union_by_name", "SELECT s_suppkey AS party, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer", views=False)
def h6(v):
    a = v.table("supplier").select(F.col("s_suppkey").alias("party"), F.col("s_acctbal").alias("balance"))
    b = v.table("customer").select(F.col("c_custkey").alias("party"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@Q.add("H7_distinct_keep_first", "SELECT title, min(id) AS id FROM listing GROUP BY title")
def h7(v):
    return v.listing.groupBy("title").agg(F.min("id").alias("id"))


@Q.add("H8_intersect", f"SELECT id FROM snapshot WHERE period = TIMESTAMP '{MONTH}' INTERSECT SELECT id FROM snapshot WHERE period = TIMESTAMP '{PREVIOUS}'")
def h8(v):
    at = lambda m: v.snapshot.where(F.col("period") == month(m)).select("id")
    return at(MONTH).intersect(at(PREVIOUS))


@Q.add("H9_except", f"SELECT id FROM snapshot WHERE period = TIMESTAMP '{MONTH}' EXCEPT SELECT id FROM snapshot WHERE period = TIMESTAMP '{PREVIOUS}'")
def h9(v):
    at = lambda m: v.snapshot.where(F.col("period") == month(m)).select("id")
    return at(MONTH).join(at(PREVIOUS), "id", "left_anti")


@Q.add("H10_skyline", """WITH k AS (SELECT * FROM listing WHERE sales IS NOT NULL) SELECT a.id, a.brand FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.brand = a.brand AND b.sales >= a.sales AND b.price <= a.price AND (b.sales > a.sales OR b.price < a.price))""")
def h10(v):
    return R.skyline(v.listing, "sales", "price", ["brand"]).select("id", "brand")


@Q.add("H11_best_not_dominated", """WITH k AS (SELECT * FROM listing WHERE sales IS NOT NULL), f AS (SELECT a.* FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.brand = a.brand AND b.sales >= a.sales AND b.price <= a.price AND (b.sales > a.sales OR b.price < a.price)))
  SELECT brand, coalesce(arg_max(id, (sales, -id)) FILTER (WHERE price < 1000), arg_max(id, (sales, -id))) AS pick FROM f GROUP BY brand""")
def h11(v):
    f = R.skyline(v.listing, "sales", "price", ["brand"])
    order = F.struct("sales", -F.col("id"))
    return f.groupBy("brand").agg(F.coalesce(F.max_by("id", F.when(F.col("price") < 1000, order)), F.max_by("id", order)).alias("pick"))
