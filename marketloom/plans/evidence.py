"""Stability, gaps, forecasts and refits over the test tables. Draws and fits are beyond SQL; tests hold those against planted cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import expr as X
from marketloom.operators import demand as D
from marketloom.operators import evidence as V
from marketloom.operators import forecast as FC
from marketloom.operators import text as T
from marketloom.operators.taxonomy import discover_taxonomy
from marketloom.operators.scores import LADDER, rule_checks
from marketloom.plans.base import MONTH, Book
from marketloom.plans.demand import _observed

Q = Book()
QUERIES, SQL = Q.queries, Q.sql
r6 = lambda c: F.round(c, 6)
_WEIGHTS = {"revenue": 0.5, "calm": 0.3, "price": 0.2}
_SPIN = "0.7 + 0.6 * (('0x' || substr(md5('7|' || draw || '|{c}'), 1, 8))::BIGINT / 4294967296.0)"


@Q.add("K20_weight_stability", f"""WITH g AS (SELECT segment, sum(revenue) AS rev, count(*) AS n, avg(price) AS price FROM listing GROUP BY 1),
  d AS (SELECT segment, CASE WHEN rev IS NOT NULL THEN (rank() OVER (PARTITION BY rev IS NULL ORDER BY rev) + (count(*) OVER (PARTITION BY rev) - 1) / 2) / count(*) OVER (PARTITION BY rev IS NULL) END AS revenue,
    1.0 / n AS calm, (rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2) / count(*) OVER () AS price FROM g),
  w AS (SELECT range AS draw, {', '.join(f"{w} * CASE WHEN range < 0 THEN 1 ELSE {_SPIN.format(c=c).replace('draw', 'range')} END AS w_{c}" for c, w in _WEIGHTS.items())} FROM range(-1, 300)),
  s AS (SELECT segment, draw, round((coalesce(revenue * w_revenue, 0) + calm * w_calm + price * w_price) / (CASE WHEN revenue IS NULL THEN 0 ELSE w_revenue END + w_calm + w_price), 9) AS score FROM d, w),
  p AS (SELECT segment, draw, rank() OVER (PARTITION BY draw ORDER BY score DESC) AS place, rank() OVER (PARTITION BY draw ORDER BY score DESC) + (count(*) OVER (PARTITION BY draw, score) - 1) / 2 AS mid FROM s),
  b AS (SELECT p.*, o.place AS own, o.mid AS own_mid FROM p JOIN p o ON o.segment = p.segment AND o.draw < 0 WHERE p.draw >= 0), r AS (SELECT median(r) AS r FROM (SELECT corr(mid, own_mid) AS r FROM b GROUP BY draw))
  SELECT segment, any_value(own) AS place, min(place) AS best, max(place) AS worst, round(avg((place <= 3)::INT), 6) AS top3, round((SELECT r FROM r), 6) AS spearman FROM b GROUP BY segment""")
def k20(v):
    g = v.listing.groupBy("segment").agg(F.sum("revenue").alias("rev"), F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean"))
    d = g.select("segment", X.rank_share("rev").alias("revenue"), (1.0 / F.col("n")).alias("calm"), X.rank_share("mean").alias("price"))
    return V.rank_stability(d, "segment", _WEIGHTS).withColumns({"top3": r6("top3"), "spearman": r6("spearman")})


def _features(v):
    """Title words, and the size in steps of ten."""
    return v.listing.withColumn("features", F.concat(F.split("title", " "), F.array(F.concat(F.lit("size "), F.floor(F.col("size") / 10).cast("string")))))


@Q.add("K23_gap_features", """WITH l AS (SELECT segment, id, sales::DOUBLE AS u, list_distinct(list_append(string_split(title, ' '), 'size ' || (size // 10))) AS fs FROM listing WHERE sales IS NOT NULL),
  t AS (SELECT segment, count(*) AS listings, sum(u) AS all_units FROM l GROUP BY 1 HAVING count(*) >= 8), x AS (SELECT segment, id, u, unnest(fs) AS feature FROM l),
  s AS (SELECT segment, feature, count(*) AS n, sum(u) AS own, list(id ORDER BY id) AS ids FROM x GROUP BY ALL), k AS (SELECT * FROM s JOIN t USING (segment) WHERE n >= 5 AND listings - n >= 5),
  o AS (SELECT segment, ids, n, listings, all_units, any_value(own) AS own, list(feature ORDER BY length(feature) - length(replace(feature, ' ', '')), length(feature), feature) AS names FROM k GROUP BY ALL)
  SELECT segment, names[1] AS feature, array_to_string(list_sort(names[2:]), '|') AS aliases, n AS listings_with, listings, round(n / listings, 6) AS supply, round(own / all_units, 6) AS demand,
    round(own / n / ((all_units - own) / (listings - n)), 6) AS lift FROM o""")
def k23(v):
    g = V.gap_features(_features(v), "id", "segment", "features", "sales")
    return g.withColumns({"aliases": F.array_join("aliases", "|"), **{c: r6(c) for c in ("supply", "demand", "lift")}})


@Q.add("K23_gap_analysis")
def k23_intervals(v):
    return V.gap_analysis(_features(v), "id", "segment", "features", "sales")


@Q.add("K28_forecast_ensemble")
def k28(v):
    m = v.history.groupBy("brand", "period").agg(F.sum("revenue").alias("y"))
    return FC.forecast_series(m, "brand", "period", "y")


@Q.add("K5_refitted_demand")
def k5(v):
    df, names = _observed(v)
    return V.refit_demand(df, "id", D.fit_intervals(df, "low", "high", names), LADDER)


@Q.add("I21_common_words", r"""WITH RECURSIVE w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM benchmark), f AS (SELECT w FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 0.9 * (SELECT count(*) FROM benchmark)),
  e AS (SELECT DISTINCT x.item_id AS a, y.item_id AS b FROM w x JOIN w y USING (w) JOIN f USING (w)), r AS (SELECT item_id, item_id AS root FROM benchmark UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.item_id) SELECT item_id, min(root) AS "group" FROM r GROUP BY item_id""", views=False)
def i21(v):
    return T.discover_groups(v.table("benchmark"), "item_id", "text", 2, 0.9)


def _taxonomy(v):
    """Listings as packs of ``size`` pieces."""
    return discover_taxonomy(v.parts.withColumn("pack", F.col("price") * F.col("size")), "id", "pack", ["brand", "segment"], ["size"])


@Q.add("J11_taxonomy_ranking")
def j11_ranking(v):
    return _taxonomy(v)[1]


@Q.add("J11_taxonomy_tree")
def j11_tree(v):
    return _taxonomy(v)[0]


_RULES = (
    ("month_total_agrees", "abs(snap_revenue - revenue) / revenue", "abs(snap_revenue - revenue) <= 0.02 * revenue", "fail"),
    ("segment_sum_agrees", "abs(seg_revenue - revenue) / revenue", "abs(seg_revenue - revenue) <= 0.02 * revenue", "fail"),
    ("negative_figures", "outside", "outside = 0", "fail"),
    ("brand_share_sum", "brand_share", "abs(brand_share - 1) <= 0.02", "fail"),
    ("brand_share_range", "odd_shares", "odd_shares = 0", "fail"),
    ("repeated_ids", "twice", "twice = 0", "fail"),
    ("undecided_revenue_share", "open_revenue / revenue", "open_revenue <= 0.2 * revenue", "warn"),
    ("known_launch_share", "launched / listings", "launched >= 0.5 * listings", "warn"),
    ("listings_with_sales", "observed / listings", "observed >= 10", "warn"),
    ("sales_without_price", "unpriced_sales", "unpriced_sales = 0", "warn"),
    ("month_present", "dated", "dated = 1", "warn"),
    ("history_length", "periods", "periods >= 3", "fail"),
    ("history_id_share", "known_ids / listings", "known_ids <= listings", "fail"),
    ("sold_before_launch", "late", "late = 0", "fail"),
)


@Q.add("K48_integrity_checks", f"""WITH b AS (SELECT brand, sum(revenue) AS r FROM listing GROUP BY 1), g AS (SELECT segment, sum(revenue) AS r FROM listing GROUP BY 1),
  l AS (SELECT count(*)::DOUBLE AS listings, count(*) - count(DISTINCT id) AS twice, sum(revenue) AS revenue, count(launched)::DOUBLE AS launched, count(sales)::DOUBLE AS observed, coalesce(sum(sales) FILTER (WHERE price IS NULL), 0) AS unpriced_sales,
    coalesce(sum(revenue) FILTER (WHERE segment IS NULL OR size < 5), 0) AS open_revenue, count(*) FILTER (WHERE launched > TIMESTAMP '{MONTH}' + INTERVAL 1 MONTH AND sales > 0) AS late, count(*) FILTER (WHERE sales < 0 OR revenue < 0) AS outside FROM listing),
  s AS (SELECT sum(revenue) FILTER (WHERE period = TIMESTAMP '{MONTH}') AS snap_revenue, count(DISTINCT period) AS periods, count(DISTINCT id)::DOUBLE AS known_ids, max((period = TIMESTAMP '{MONTH}')::INT) AS dated FROM snapshot),
  f AS (SELECT l.*, s.*, (SELECT sum(r) FROM g) AS seg_revenue, (SELECT sum(r) FROM b) / revenue AS brand_share, (SELECT count(*) FROM b WHERE r < 0 OR r > (SELECT revenue FROM l)) AS odd_shares FROM l, s),
  r AS ({' UNION ALL '.join(f"SELECT '{n}' AS c, ({value})::DOUBLE AS v, CASE WHEN {ok} THEN 'pass' WHEN NOT ({ok}) THEN '{status}' END AS s FROM f" for n, value, ok, status in _RULES)}), k AS (SELECT * FROM r WHERE s IS NOT NULL)
  SELECT c AS "check", round(v, 6) AS value, s AS status FROM k UNION ALL SELECT 'all', count(*) FILTER (WHERE s <> 'pass'), CASE WHEN bool_or(s = 'fail') THEN 'fail' WHEN bool_or(s = 'warn') THEN 'warn' ELSE 'pass' END FROM k""")
def k48(v):
    month, one = F.lit(MONTH).cast("timestamp_ntz"), F.lit(1)
    l, s = v.listing, v.snapshot  # noqa: E741
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    late = (F.col("launched").cast("timestamp_ntz") > F.lit(MONTH).cast("timestamp_ntz") + F.expr("INTERVAL 1 MONTH")) & (F.col("sales") > 0)
    listing = l.agg(
        F.count(one).cast("double").alias("listings"), (F.count(one) - F.count_distinct("id")).alias("twice"), F.sum("revenue").alias("revenue"), F.count("launched").cast("double").alias("launched"), F.count("sales").cast("double").alias("observed"),
        total(F.when(F.col("price").isNull(), F.col("sales"))).alias("unpriced_sales"), total(F.when(F.col("segment").isNull() | (F.col("size") < 5), F.col("revenue"))).alias("open_revenue"),
        F.count(F.when(late, 1)).alias("late"), F.count(F.when((F.col("sales") < 0) | (F.col("revenue") < 0), 1)).alias("outside"),
    )
    seen = s.agg(F.sum(F.when(F.col("period") == month, F.col("revenue"))).alias("snap_revenue"), F.count_distinct("period").alias("periods"), F.count_distinct("id").cast("double").alias("known_ids"), F.max((F.col("period") == month).cast("int")).alias("dated"))
    segments = l.groupBy("segment").agg(F.sum("revenue").alias("r")).agg(F.sum("r").alias("seg_revenue"))
    brands = l.groupBy("brand").agg(F.sum("revenue").alias("r")).crossJoin(F.broadcast(listing.select("revenue")))
    shares = brands.agg((F.sum("r") / F.first("revenue")).alias("brand_share"), F.count(F.when((F.col("r") < 0) | (F.col("r") > F.col("revenue")), 1)).alias("odd_shares"))
    facts = listing.crossJoin(seen).crossJoin(segments).crossJoin(shares)
    return rule_checks(facts, [(n, F.expr(value), F.expr(ok), status) for n, value, ok, status in _RULES]).withColumn("value", r6("value"))
