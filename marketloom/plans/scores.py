"""Scores, statistics, trends and economics over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import expr as X
from marketloom.operators import scores as S
from marketloom.plans.base import MONTH, PREVIOUS, Book

Q = Book()
QUERIES, SQL = Q.queries, Q.sql
r6 = lambda c: F.round(c, 6)
month = lambda m: F.lit(m).cast("timestamp_ntz")
_LADDER = "[" + ", ".join(map(str, S.LADDER)) + "]::DOUBLE[]"
_PCT = "((rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER ())"


@Q.add("K1_badge_ladder", f"""WITH s AS (SELECT sales * 10 AS x FROM listing), a AS (SELECT count(x) AS n, avg(CASE WHEN x IS NOT NULL THEN list_contains({_LADDER}, x)::INT END) AS on_ladder, count(*) FILTER (WHERE x < 50) AS below FROM s)
  SELECT n, round(on_ladder, 6) AS on_ladder, below, n >= 10 AND on_ladder >= 0.98 AND below = 0 AS badges FROM a""")
def k1(v):
    return S.badge_ladder_found(v.listing.select((F.col("sales") * 10).alias("x")), "x").withColumn("on_ladder", r6(F.col("on_ladder")))


_INTERVAL = f"""iv AS (SELECT *, coalesce(x, 0) AS low, CASE WHEN x IS NULL THEN 50.0 WHEN NOT list_contains({_LADDER}, x) THEN x WHEN x = 10000 THEN 2 * x ELSE list_filter({_LADDER}, lambda r: r > x)[1] END::DOUBLE AS high FROM (SELECT *, sales * 10 AS x FROM listing))"""


def _interval(v):
    low, high = S.observation_interval("x")
    return v.listing.withColumn("x", F.col("sales") * 10).withColumns({"low": low, "high": high})


@Q.add("K2_observation_interval", f"WITH {_INTERVAL} SELECT id, low, high FROM iv")
def k2(v):
    return _interval(v).select("id", "low", "high")


@Q.add("K3_floor_ceiling", f"WITH {_INTERVAL} SELECT segment, sum(low) AS units_floor, sum(high) AS units_ceiling, round(sum(low * price), 2) AS revenue_floor, round(sum(high * price), 2) AS revenue_ceiling FROM iv GROUP BY segment")
def k3(v):
    i = _interval(v)
    s = lambda c, n: F.round(F.sum(F.col(c) * F.col("price")), 2).alias(n)
    return i.groupBy("segment").agg(F.sum("low").alias("units_floor"), F.sum("high").alias("units_ceiling"), s("low", "revenue_floor"), s("high", "revenue_ceiling"))


_DRAWS = "dr AS (SELECT (event_id % 50)::BIGINT AS sim, event_type AS brand, sum(CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE AS revenue FROM events GROUP BY ALL)"


def _draws(v):
    return v.table("events").groupBy((F.col("event_id") % 50).alias("sim"), F.col("event_type").alias("brand")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / F.lit(100.0)).alias("revenue"))


@Q.add("K9_share_intervals", f"""WITH {_DRAWS}, s AS (SELECT *, revenue / sum(revenue) OVER (PARTITION BY sim) AS share, row_number() OVER (PARTITION BY sim ORDER BY revenue DESC, brand) AS place FROM dr)
  SELECT brand, round(quantile_cont(share, 0.1), 6) AS low, round(quantile_cont(share, 0.9), 6) AS high, round(avg((place = 1)::INT), 6) AS p_first FROM s GROUP BY brand""")
def k9(v):
    w = W.partitionBy("sim")
    s = _draws(v).withColumns({"share": F.col("revenue") / F.sum("revenue").over(w), "place": F.row_number().over(w.orderBy(F.desc("revenue"), "brand"))})
    q = lambda p, n: r6(F.percentile("share", F.lit(p))).alias(n)
    return s.groupBy("brand").agg(q(0.1, "low"), q(0.9, "high"), r6(F.avg((F.col("place") == 1).cast("double"))).alias("p_first"))


@Q.add("K55_set_interval", f"WITH {_DRAWS}, t AS (SELECT sim, sum(revenue) AS total FROM dr WHERE brand IN ('click', 'purchase') GROUP BY sim) SELECT round(quantile_cont(total, 0.1), 4) AS low, round(quantile_cont(total, 0.5), 4) AS mid, round(quantile_cont(total, 0.9), 4) AS high FROM t")
def k55(v):
    t = _draws(v).where(F.col("brand").isin("click", "purchase")).groupBy("sim").agg(F.sum("revenue").alias("total"))
    q = lambda p, n: F.round(F.percentile("total", F.lit(p)), 4).alias(n)
    return t.agg(q(0.1, "low"), q(0.5, "mid"), q(0.9, "high"))


@Q.add("K10_unit_economics", "SELECT id, round(price * 0.85 - 3.5 - size, 6) AS margin FROM listing")
def k10(v):
    return v.parts.select("id", r6(F.col("price") * 0.85 - 3.5 - F.col("size")).alias("margin"))


@Q.add("K11_entrant_success", f"""WITH a AS (SELECT *, date_diff('day', launched::DATE, DATE '{MONTH}') <= 1780 AS entrant FROM listing WHERE sales IS NOT NULL AND launched IS NOT NULL), m AS (SELECT segment, median(sales) FILTER (WHERE NOT entrant) AS mid FROM a GROUP BY 1)
  SELECT segment, count(*) FILTER (WHERE entrant) AS entrants, round(avg(CASE WHEN entrant THEN (sales >= mid)::INT END), 6) AS success, round((count(*) FILTER (WHERE entrant AND sales >= mid) + 5 * 0.5) / (count(*) FILTER (WHERE entrant) + 5), 6)::DOUBLE AS shrunk FROM a JOIN m USING (segment) GROUP BY segment""")
def k11(v):
    a = v.listing.where("sales IS NOT NULL AND launched IS NOT NULL").withColumn("entrant", F.datediff(F.lit(MONTH).cast("date"), "launched") <= 1780)
    mid = a.groupBy("segment").agg(F.median(F.when(~F.col("entrant"), F.col("sales"))).alias("mid"))
    j = a.join(mid, "segment")
    win, n = F.col("entrant") & (F.col("sales") >= F.col("mid")), F.count(F.when(F.col("entrant"), 1))
    return j.groupBy("segment").agg(n.alias("entrants"), r6(F.avg(F.when(F.col("entrant"), (F.col("sales") >= F.col("mid")).cast("double")))).alias("success"), r6((F.count(F.when(win, 1)) + 2.5) / (n + 5)).alias("shrunk"))


@Q.add("K12_quality_gap", """WITH r AS (SELECT *, (size % 6)::DOUBLE AS rating, row_number() OVER (PARTITION BY segment ORDER BY revenue DESC NULLS LAST, id) AS k, count(revenue) OVER (PARTITION BY segment) AS n FROM listing)
  SELECT segment, round(sum(CASE WHEN rating < 4 THEN sales END) / sum(sales), 6) AS gap_share, round(median(CASE WHEN k <= ceil(0.1 * n) THEN rating END), 6) AS rating_bar FROM r GROUP BY segment""")
def k12(v):
    w = W.partitionBy("segment")
    r = v.listing.withColumns({"rating": (F.col("size") % 6).cast("double"), "k": F.row_number().over(w.orderBy(F.desc_nulls_last("revenue"), "id")), "n": F.count("revenue").over(w)})
    return r.groupBy("segment").agg(r6(F.try_divide(F.sum(F.when(F.col("rating") < 4, F.col("sales"))), F.sum("sales"))).alias("gap_share"), r6(F.median(F.when(F.col("k") <= F.ceil(0.1 * F.col("n")), F.col("rating")))).alias("rating_bar"))


@Q.add("K13_component_transform", "SELECT id, round(greatest(0, least(1, (price - 900) / 200)), 6) AS linear, round(greatest(0, least(1, log10(greatest(sales, 1)) / 3)), 6) AS logged FROM listing WHERE sales IS NOT NULL")
def k13(v):
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return v.listing.where("sales IS NOT NULL").select("id", r6(clip((F.col("price") - 900) / 200)).alias("linear"), r6(clip(F.log10(F.greatest("sales", F.lit(1.0))) / 3)).alias("logged"))


@Q.add("K14_geometric_index", """SELECT id, round(exp((0.5 * ln(greatest(coalesce(sales / 200, 0.5), 0.01)) + 0.3 * ln(greatest(size / 50, 0.01)) + 0.2 * ln(greatest(coalesce(sellers / 10, 0.5), 0.01))) / 1.0) * 100, 5) AS index, round(0.3 + CASE WHEN sales IS NOT NULL THEN 0.7 ELSE 0 END, 6)::DOUBLE AS coverage FROM listing""")
def k14(v):
    value, cover = X.geometric_index([(F.col("sales") / 200, 0.5), (F.col("size") / 50, 0.3), (F.col("sellers") / 10, 0.2)])
    return v.listing.select("id", F.round(value, 5).alias("index"), r6(cover).alias("coverage"))


@Q.add("K15_price_band_lift", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY price, id) AS k, count(*) OVER (PARTITION BY segment) AS n FROM listing), b AS (SELECT *, CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((k - 1) * 4 / (n - 1))) END::INT AS band FROM r)
  SELECT segment, band, count(*) AS listings, round(avg(sales) / first(seg_avg), 6) AS lift FROM (SELECT *, avg(sales) OVER (PARTITION BY segment) AS seg_avg FROM b) GROUP BY ALL""")
def k15(v):
    from marketloom.operators.ranking import rank_bands

    mean = v.listing.groupBy("segment").agg(F.avg("sales").alias("seg_avg"))
    b = rank_bands(v.listing, "price", ["segment"], 4, "id").groupBy("segment", "band").agg(F.count(F.lit(1)).alias("listings"), F.avg("sales").alias("own"))
    return b.join(mean, "segment").select("segment", "band", "listings", r6(F.col("own") / F.col("seg_avg")).alias("lift"))


@Q.add("K16_evidence_grade", "WITH a AS (SELECT segment, count(sales) AS n, avg((sales IS NOT NULL)::INT) AS cover FROM listing GROUP BY 1) SELECT segment, CASE WHEN n >= 100 AND cover >= 0.5 THEN 'A' WHEN n >= 100 THEN 'B' WHEN n >= 30 THEN 'C' ELSE 'D' END AS grade FROM a")
def k16(v):
    a = v.listing.groupBy("segment").agg(F.count("sales").alias("n"), F.avg(F.col("sales").isNotNull().cast("double")).alias("cover"))
    return a.select("segment", F.when((F.col("n") >= 100) & (F.col("cover") >= 0.5), "A").when(F.col("n") >= 100, "B").when(F.col("n") >= 30, "C").otherwise("D").alias("grade"))


_OPP = f"""sg AS (SELECT segment, sum(revenue) AS rev, avg(price) AS price, count(*) AS n, avg((sales IS NOT NULL)::INT) AS cover FROM listing GROUP BY 1),
  op AS (SELECT segment, cover, 0.5 * {_PCT.format(c='rev')} + 0.3 * (1 - {_PCT.format(c='n')} + 1.0 / count(*) OVER ()) + 0.2 * {_PCT.format(c='price')} AS raw FROM sg)"""


def _opportunity(v):
    g = v.listing.groupBy("segment").agg(F.sum("revenue").alias("rev"), F.avg("price").alias("price"), F.count(F.lit(1)).alias("n"), F.avg(F.col("sales").isNotNull().cast("double")).alias("cover"))
    flip = 1 - X.rank_share("n") + F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    mean, _ = X.mean_of_known([(X.rank_share("rev"), 0.5), (flip, 0.3), (X.rank_share("price"), 0.2)])
    return g.withColumn("raw", mean)


@Q.add("K17_opportunity_score", f"WITH {_OPP} SELECT segment, round(50 + (raw * 100 - 50) * cover, 5) AS score FROM op")
def k17(v):
    return _opportunity(v).select("segment", F.round(50 + (F.col("raw") * 100 - 50) * F.col("cover"), 5).alias("score"))


@Q.add("K18_opportunity_minus_difficulty", f"WITH {_OPP}, c AS (SELECT segment, count(DISTINCT brand) AS brands FROM listing GROUP BY 1) SELECT segment, round(raw * 100 - brands, 5) AS score FROM op JOIN c USING (segment)")
def k18(v):
    c = v.listing.groupBy("segment").agg(F.count_distinct("brand").alias("brands"))
    return _opportunity(v).join(c, "segment").select("segment", F.round(F.col("raw") * 100 - F.col("brands"), 5).alias("score"))


@Q.add("K20_rank_stability", f"""WITH {_OPP}, w AS (SELECT range AS draw, 0.7 + 0.06 * (range % 11) AS f FROM range(0, 50)), s AS (SELECT segment, draw, rank() OVER (PARTITION BY draw ORDER BY raw * f + cover * (1 - f) DESC, segment) AS place FROM op, w)
  SELECT segment, min(place) AS best, max(place) AS worst, round(avg((place <= 3)::INT), 6) AS top3 FROM s GROUP BY segment""")
def k20(v):
    w = v.spark.range(50).select(F.col("id").alias("draw"), (0.7 + 0.06 * (F.col("id") % 11)).alias("f"))
    s = _opportunity(v).crossJoin(F.broadcast(w))
    place = F.rank().over(W.partitionBy("draw").orderBy(F.desc(F.col("raw") * F.col("f") + F.col("cover") * (1 - F.col("f"))), "segment"))
    p = s.withColumn("place", place.cast("long"))
    return p.groupBy("segment").agg(F.min("place").alias("best"), F.max("place").alias("worst"), r6(F.avg((F.col("place") <= 3).cast("double"))).alias("top3"))


@Q.add("K21_signals", """SELECT id, CASE WHEN sales IS NULL THEN NULL WHEN sales >= 30 AND sellers <= 1 THEN 'strong_demand_few_sellers' WHEN sales >= 30 THEN 'strong_demand' ELSE 'none' END AS signal FROM listing""")
def k21(v):
    s = F.col("sales")
    return v.listing.select("id", F.when(s.isNull(), None).when((s >= 30) & (F.col("sellers") <= 1), "strong_demand_few_sellers").when(s >= 30, "strong_demand").otherwise("none").alias("signal"))


@Q.add("K22_product_score", """WITH s AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 90 WHEN 'click' THEN 60 WHEN 'view' THEN 30 END AS weight, least(1, value / 100) AS conf FROM events) SELECT user_id, round(avg(coalesce(weight, 0) * conf), 4) AS score FROM s GROUP BY user_id""", views=False)
def k22(v):
    w = F.when(F.col("event_type") == "purchase", 90).when(F.col("event_type") == "click", 60).when(F.col("event_type") == "view", 30).otherwise(0)
    return v.table("events").groupBy("user_id").agg(F.round(F.avg(w * F.least(F.lit(1.0), F.col("value") / 100)), 4).alias("score"))


@Q.add("K23_gap_lift", """WITH f AS (SELECT id, sales, unnest(string_split(title, ' ')) AS feature FROM listing), t AS (SELECT count(*) AS n, sum(sales) AS s FROM listing) SELECT feature, round(count(DISTINCT id) / any_value(t.n), 6) AS supply, round(sum(sales) / any_value(t.s), 6) AS demand, round(sum(sales) / any_value(t.s) / (count(DISTINCT id) / any_value(t.n)), 6) AS lift FROM f, t GROUP BY feature""")
def k23(v):
    f = v.listing.select("id", "sales", F.explode(F.split("title", " ")).alias("feature"))
    t = F.broadcast(v.listing.agg(F.count(F.lit(1)).alias("n"), F.sum("sales").alias("s")))
    g = f.groupBy("feature").agg(F.count_distinct("id").alias("k"), F.sum("sales").alias("d")).crossJoin(t)
    supply, demand = F.col("k") / F.col("n"), F.col("d") / F.col("s")
    return g.select("feature", r6(supply).alias("supply"), r6(demand).alias("demand"), r6(demand / supply).alias("lift"))


@Q.add("K28_linear_forecast", """WITH m AS (SELECT segment, date_diff('month', TIMESTAMP '1990-01-01', period) AS x, sum(sales) AS y FROM history GROUP BY ALL) SELECT segment, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x) + regr_slope(y, x) * (max(x) + 1), 3) AS next FROM m GROUP BY segment""")
def k28(v):
    x = (F.year("period") - 1990) * 12 + F.month("period") - 1
    m = v.history.groupBy("segment", x.alias("x")).agg(F.sum("sales").alias("y"))
    return m.groupBy("segment").agg(F.round(F.regr_slope("y", "x"), 5).alias("slope"), F.round(F.regr_intercept("y", "x") + F.regr_slope("y", "x") * (F.max("x") + 1), 3).alias("next"))


@Q.add("K32_trend_signals", """WITH m AS (SELECT brand, period, sum(sales) AS y FROM history GROUP BY ALL), x AS (SELECT *, date_diff('month', min(period) OVER (PARTITION BY brand), period) AS k FROM m WHERE y > 0)
  SELECT brand, count(*) AS periods, round(exp(regr_slope(ln(y), k)) - 1, 6) AS monthly_growth, CASE WHEN exp(regr_slope(ln(y), k)) - 1 > 0.01 THEN 'growing' WHEN exp(regr_slope(ln(y), k)) - 1 < -0.01 THEN 'declining' ELSE 'stable' END AS label FROM x GROUP BY brand""")
def k32(v):
    m = v.history.groupBy("brand", "period").agg(F.sum("sales").alias("y"))
    return S.trend_slope(m, ["brand"], "y").withColumn("monthly_growth", r6(F.col("monthly_growth")))


@Q.add("K33_competitor_profile", """WITH b AS (SELECT brand, sum(revenue) AS rev, median(price) AS mid FROM listing GROUP BY 1), s AS (SELECT *, rev / sum(rev) OVER () AS share, row_number() OVER (ORDER BY rev DESC NULLS LAST, brand) AS place FROM b)
  SELECT brand, round(share, 6) AS share, CASE WHEN place = 1 THEN 'leader' WHEN share >= 0.05 THEN 'challenger' ELSE 'niche' END AS position, round(mid / (SELECT median(price) FROM listing), 6) AS price_index FROM s""")
def k33(v):
    every = W.partitionBy(F.lit(0))
    b = v.listing.groupBy("brand").agg(F.sum("revenue").alias("rev"), F.median("price").alias("mid")).crossJoin(F.broadcast(v.listing.agg(F.median("price").alias("all"))))
    b = b.withColumns({"share": F.col("rev") / F.sum("rev").over(every), "place": F.row_number().over(every.orderBy(F.desc_nulls_last("rev"), "brand"))})
    return b.select("brand", r6(F.col("share")).alias("share"), F.when(F.col("place") == 1, "leader").when(F.col("share") >= 0.05, "challenger").otherwise("niche").alias("position"), r6(F.col("mid") / F.col("all")).alias("price_index"))


@Q.add("K34_brand_signals", """WITH b AS (SELECT brand, count(*) AS n, avg((sales IS NOT NULL)::INT) AS cover, count(DISTINCT segment) AS segs FROM listing GROUP BY 1) SELECT brand, array_to_string(list_filter([CASE WHEN n >= 80 THEN 'large' END, CASE WHEN cover > 0.32 THEN 'active' END, CASE WHEN segs = 6 THEN 'broad' END], lambda x: x IS NOT NULL), ',') AS signals FROM b""")
def k34(v):
    b = v.listing.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("sales").isNotNull().cast("double")).alias("cover"), F.count_distinct("segment").alias("segs"))
    return b.select("brand", F.array_join(X.violations((F.col("n") >= 80, "large"), (F.col("cover") > 0.32, "active"), (F.col("segs") == 6, "broad")), ",").alias("signals"))


@Q.add("K35_change_events", f"""WITH g AS (SELECT period, segment, sum(revenue) AS rev, count(DISTINCT brand) AS brands FROM history WHERE period IN (TIMESTAMP '{PREVIOUS}', TIMESTAMP '{MONTH}') GROUP BY ALL), j AS (SELECT a.segment, b.rev / a.rev - 1 AS size_change, b.brands - a.brands AS brand_change FROM g a JOIN g b ON a.segment = b.segment AND a.period < b.period)
  SELECT segment, 'size' AS kind, round(size_change, 6) AS value FROM j WHERE abs(size_change) > 0.1 UNION ALL SELECT segment, 'brands', brand_change::DOUBLE FROM j WHERE brand_change <> 0""")
def k35(v):
    g = v.history.groupBy("segment", "period").agg(F.sum("revenue").alias("rev"), F.count_distinct("brand").alias("brands"))
    at = lambda m, s: g.where(F.col("period") == month(m)).select("segment", F.col("rev").alias(f"r{s}"), F.col("brands").alias(f"b{s}"))
    j = at(PREVIOUS, 0).join(at(MONTH, 1), "segment").select("segment", (F.col("r1") / F.col("r0") - 1).alias("size"), (F.col("b1") - F.col("b0")).cast("double").alias("brands"))
    u = j.unpivot("segment", ["size", "brands"], "kind", "value")
    return u.where(F.when(F.col("kind") == "size", F.abs("value") > 0.1).otherwise(F.col("value") != 0)).select("segment", "kind", r6(F.col("value")).alias("value"))


@Q.add("K36_watch_changes", """WITH l AS (SELECT user_id, event_type, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prev, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
  SELECT user_id, event_type, round(value / prev - 1, 6) AS change, CASE WHEN value / prev - 1 > 0.5 THEN 'up' ELSE 'down' END AS direction FROM l WHERE k = 1 AND prev > 0 AND abs(value / prev - 1) > 0.5""", views=False)
def k36(v):
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    last = v.table("events").withColumns({"prev": F.lag("value").over(w), "next": F.lead("event_id").over(w)}).where("next IS NULL AND prev > 0")
    c = last.withColumn("change", F.col("value") / F.col("prev") - 1).where(F.abs("change") > 0.5)
    return c.select("user_id", "event_type", r6(F.col("change")).alias("change"), F.when(F.col("change") > 0.5, "up").otherwise("down").alias("direction"))


@Q.add("K37_keyword_score", f"""WITH k AS (SELECT user_id, count(*) AS n, avg(value) AS cost FROM events GROUP BY 1) SELECT user_id, round(0.6 * {_PCT.format(c='n')} + 0.4 * (1 - {_PCT.format(c='cost')} + 1.0 / count(*) OVER ()), 6) AS score FROM k""", views=False)
def k37(v):
    k = v.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("cost"))
    score, _ = X.mean_of_known([(X.rank_share("n"), 0.6), (1 - X.rank_share("cost") + F.lit(1.0) / F.count(F.lit(1)).over(W.partitionBy(F.lit(0))), 0.4)])
    return k.select("user_id", r6(score).alias("score"))


@Q.add("K42_economics", "SELECT id, round(size * 1.03::DOUBLE + 2, 6) AS landed_cost, round(price * 0.85 - 3 - (size * 1.03 + 2) - price * 0.1, 6) AS margin, round((price * 0.85 - 3 - (size * 1.03 + 2) - price * 0.1) / price, 6) AS margin_rate, round((price * 0.85 - 3 - (size * 1.03 + 2)) / price, 6) AS break_even_acos FROM listing")
def k42(v):
    e = S.unit_economics(F.col("price"), F.col("size").cast("double"), F.lit(3.0), F.lit(2.0))
    return v.parts.select("id", *[r6(c).alias(n) for n, c in e.items()])


@Q.add("K43_landed_cost", "SELECT round(median(size * 1.03::DOUBLE + 2), 6) AS landed, round(median(price * 0.85 - 3 - (size * 1.03::DOUBLE + 2)), 6) AS headroom, round(min((price * 0.75 - 5) / 1.03), 6) AS least_max_fob FROM listing")
def k43(v):
    landed = F.col("size") * 1.03 + 2
    return v.parts.agg(r6(F.median(landed)).alias("landed"), r6(F.median(F.col("price") * 0.85 - 3 - landed)).alias("headroom"), r6(F.min((F.col("price") * 0.75 - 5) / 1.03)).alias("least_max_fob"))


@Q.add("K45_supplier_score", f"""WITH s AS (SELECT l_suppkey AS k, count(*) AS n, avg(l_discount) AS d, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1) SELECT k AS supplier, round(0.4 * {_PCT.format(c='n')} + 0.35 * {_PCT.format(c='d')} + 0.25 * {_PCT.format(c='parts')}, 6) AS score FROM s""", views=False)
def k45(v):
    s = v.table("lineitem").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("d"), F.count_distinct("l_partkey").alias("parts"))
    return s.select("supplier", r6(0.4 * X.rank_share("n") + 0.35 * X.rank_share("d") + 0.25 * X.rank_share("parts")).alias("score"))


@Q.add("K46_offline_evidence", """WITH e(term, w, val) AS (VALUES ('the', 2.0, 100.0), ('que', 1.0, 10.0)) SELECT item_id, round(CASE WHEN count(w) > 0 THEN least(100, sum(w * (1 + log10(1 + val)))) END::DOUBLE, 6) AS score FROM benchmark LEFT JOIN e ON contains(lower(text), term) GROUP BY item_id""", views=False)
def k46(v):
    e = v.spark.createDataFrame([("the", 2.0, 100.0), ("que", 1.0, 10.0)], "term string, w double, val double")
    j = v.table("benchmark").join(F.broadcast(e), F.contains(F.lower("text"), F.col("term")), "left")
    s = F.sum(F.col("w") * (1 + F.log10(1 + F.col("val"))))
    return j.groupBy("item_id").agg(r6(F.when(s.isNotNull(), F.least(F.lit(100.0), s))).alias("score"))


@Q.add("K47_anomalies", """SELECT id, 'price_without_sales' AS code FROM listing WHERE price > 1050 AND sales IS NULL UNION ALL SELECT id, 'tiny_size' FROM listing WHERE size <= 1 UNION ALL SELECT id, 'many_sellers' FROM listing WHERE sellers >= 3""")
def k47(v):
    codes = X.violations(((F.col("price") > 1050) & F.col("sales").isNull(), "price_without_sales"), (F.col("size") <= 1, "tiny_size"), (F.col("sellers") >= 3, "many_sellers"))
    return v.listing.select("id", F.explode(codes).alias("code"))


@Q.add("K48_integrity", """SELECT 'duplicate_ids' AS "check", (count(*) - count(DISTINCT id))::DOUBLE AS value, CASE WHEN count(*) = count(DISTINCT id) THEN 'pass' ELSE 'fail' END AS status FROM listing UNION ALL
  SELECT 'orphan_orders', count(*)::DOUBLE, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'unlabelled_documents', count(*)::DOUBLE, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'warn' END FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def k48(v):
    ids = v.parts.agg((F.count(F.lit(1)) - F.count_distinct("id")).alias("n"))
    orphans = v.table("orders").join(v.table("customer"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count(F.lit(1)).alias("n"))
    open_docs = v.table("documents").join(v.table("labels"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return S.long_checks([("duplicate_ids", ids, "n", "fail"), ("orphan_orders", orphans, "n", "fail"), ("unlabelled_documents", open_docs, "n", "warn")])


@Q.add("K49_wilson", """WITH a AS (SELECT lang, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1), p AS (SELECT *, k / n AS p FROM a)
  SELECT lang, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM p""", views=False)
def k49(v):
    a = v.table("documents").select("doc_id", "lang").join(v.table("labels"), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("quality").cast("double").alias("k"))
    low, high = S.wilson(F.col("k"), F.col("n"))
    return a.select("lang", r6(low).alias("low"), r6(high).alias("high"))


@Q.add("K50_persistence_backtest", """WITH m AS (SELECT segment, period, sum(sales) AS y FROM history GROUP BY ALL), l AS (SELECT *, lag(y) OVER w AS prev, lag(y, 2) OVER w AS prev2 FROM m WINDOW w AS (PARTITION BY segment ORDER BY period))
  SELECT segment, round(sum(abs(y - prev)) / sum(CASE WHEN prev IS NOT NULL THEN y END), 6) AS wape, round(median(abs(y - prev) / y), 6) AS mdape, round(avg(CASE WHEN prev2 IS NOT NULL THEN (sign(y - prev) = sign(prev - prev2))::INT END), 6) AS direction FROM l GROUP BY segment""")
def k50(v):
    m = v.history.groupBy("segment", "period").agg(F.sum("sales").alias("y"))
    w = W.partitionBy("segment").orderBy("period")
    l = m.withColumns({"prev": F.lag("y").over(w), "prev2": F.lag("y", 2).over(w)})  # noqa: E741
    same = (F.signum(F.col("y") - F.col("prev")) == F.signum(F.col("prev") - F.col("prev2"))).cast("double")
    return l.groupBy("segment").agg(r6(F.sum(F.abs(F.col("y") - F.col("prev"))) / F.sum(F.when(F.col("prev").isNotNull(), F.col("y")))).alias("wape"), r6(F.median(F.abs(F.col("y") - F.col("prev")) / F.col("y"))).alias("mdape"), r6(F.avg(F.when(F.col("prev2").isNotNull(), same))).alias("direction"))


@Q.add("K54_ownership_hints", "SELECT c_mktsegment AS hint, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, hint LIMIT 20", views=False)
def k54(v):
    return v.table("customer").groupBy(F.col("c_mktsegment").alias("hint")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hint").limit(20)


@Q.add("K57_published_segments", f"WITH {_OPP} SELECT sg.segment, round(rev, 4) AS observed_revenue, round(raw * 100, 5) AS engine_score FROM sg JOIN op USING (segment) ORDER BY engine_score DESC, sg.segment")
def k57(v):
    o = _opportunity(v)
    return o.select("segment", F.round("rev", 4).alias("observed_revenue"), F.round(F.col("raw") * 100, 5).alias("engine_score")).orderBy(F.desc("engine_score"), "segment")


@Q.add("F24_supplier_ranking", f"""WITH s AS (SELECT l_suppkey AS k, avg(l_tax) AS tax, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT s_suppkey AS supplier, CASE WHEN s_acctbal > 0 THEN s_acctbal / 10000 END AS bal, 1 - tax * 10 AS rel, least(1, n / 1000) AS vol FROM supplier LEFT JOIN s ON k = s_suppkey)
  SELECT supplier, round((coalesce(0.5 * bal, 0) + coalesce(0.3 * rel, 0) + coalesce(0.2 * vol, 0)) / (CASE WHEN bal IS NULL THEN 0 ELSE 0.5 END + CASE WHEN rel IS NULL THEN 0 ELSE 0.3 END + CASE WHEN vol IS NULL THEN 0 ELSE 0.2 END), 6) AS score FROM j""", views=False)
def f24(v):
    s = v.table("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_tax").alias("tax"), F.count(F.lit(1)).alias("n"))
    j = v.table("supplier").join(s, "s_suppkey", "left")
    score, _ = X.mean_of_known([(F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 10000), 0.5), (1 - F.col("tax") * 10, 0.3), (F.least(F.lit(1.0), F.col("n") / 1000), 0.2)])
    return j.select(F.col("s_suppkey").alias("supplier"), r6(score).alias("score"))
