"""Files, schema evidence and models over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import expr as X
from marketloom.operators import embedding as EM
from marketloom.operators import families as FA
from marketloom.operators import files as FI
from marketloom.operators import linkage as LI
from marketloom.operators import models as MO
from marketloom.operators import text as TX
from marketloom.plans.base import MONTH, Book
from marketloom.session import materialize, temp_path
from marketloom.sources import store

Q = Book()
QUERIES, SQL = Q.queries, Q.sql
r6 = lambda c: F.round(c, 6)
month = lambda m: F.lit(m).cast("timestamp_ntz")
_NATION = "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"


@Q.add("A1_csv_as_text", _NATION, views=False)
def a1(v):
    path = temp_path(v.spark, "csv")
    v.table("nation").write.option("header", "true").csv(path)
    return store.read_export(v.spark, path)


@Q.add("A2_other_encoding", "SELECT doc_id::VARCHAR AS doc_id, lang || 'é' AS lang FROM documents", views=False)
def a2(v):
    path = temp_path(v.spark, "latin")
    v.table("documents").select("doc_id", F.concat("lang", F.lit("é")).alias("lang")).write.option("header", "true").option("encoding", "ISO-8859-1").csv(path)
    return store.read_export(v.spark, path, encoding=None)


@Q.add("A5_json_envelope", "SELECT n_nationkey::VARCHAR AS id, n_name AS name_full FROM nation", views=False)
def a5(v):
    path = temp_path(v.spark, "json")
    row = F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("full")).alias("name"))
    v.table("nation").agg(F.collect_list(row).alias("items")).coalesce(1).write.json(path)
    return store.read_export(v.spark, path, "json").toDF("id", "name_full")


@Q.add("A7_rows_as_source", "SELECT r_regionkey AS id, r_name AS title FROM region", views=False)
def a7(v):
    return v.spark.createDataFrame([r.asDict() for r in v.table("region").collect()], "r_regionkey int, r_name string").toDF("id", "title")


@Q.add("A12_json_columns", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_type = 'click'", views=False)
def a12(v):
    return v.table("events").where("event_type = 'click'").select("event_id", F.from_json("props", "k long").getField("k").alias("k"))


@Q.add("A13_snapshot_order", "SELECT 'market_' || strftime(p, '%Y-%m-%d') || '.csv' AS file, p::DATE AS day, row_number() OVER (ORDER BY p)::INT AS place FROM (SELECT DISTINCT period AS p FROM snapshot)")
def a13(v):
    names = v.snapshot.select(F.concat(F.lit("in/market_"), F.date_format("period", "yyyy-MM-dd"), F.lit(".csv")).alias("path")).distinct()
    return FI.snapshot_order(names, "path")


@Q.add("A18_page_fields", None)
def a18(v):
    return FI.parse_pages(v.table("pages"))


@Q.add("B1_raw_sink", "SELECT c_custkey::VARCHAR AS c_custkey, c_acctbal::VARCHAR AS c_acctbal, c_mktsegment AS source FROM customer", views=False)
def b1(v):
    path = temp_path(v.spark, "raw")
    v.table("customer").select(F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), F.col("c_mktsegment").alias("source")).write.partitionBy("source").parquet(path)
    return v.spark.read.parquet(path)


@Q.add("B2_replace_market", "SELECT s_suppkey AS id, 'a' AS market FROM supplier WHERE s_suppkey < 10 UNION ALL SELECT s_suppkey, 'b' FROM supplier WHERE s_suppkey >= 10", views=False)
def b2(v):
    path, s = temp_path(v.spark, "curated"), v.table("supplier").select(F.col("s_suppkey").alias("id"))
    store.write_curated(s, path, "a")
    store.write_curated(s.where("id >= 10"), path, "b")
    store.write_curated(s.where("id < 10"), path, "a")
    return store.read_curated(v.spark, path)


@Q.add("B3_batch", "SELECT r_name AS name FROM region", views=False)
def b3(v):
    batch = store.Batch(v.spark, temp_path(v.spark, "batch"))
    batch.write("regions", v.table("region").select(F.col("r_name").alias("name")))
    batch.write("nations", v.table("nation"))
    batch.commit()
    return store.read_batch(v.spark, batch.root, "regions")


@Q.add("B8_filtered_export", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000", views=False)
def b8(v):
    path = temp_path(v.spark, "export")
    v.table("orders").where("o_totalprice > 400000").select("o_orderkey", "o_totalprice").write.parquet(path)
    return v.spark.read.parquet(path)


@Q.add("B12_flatten_structs", "SELECT brand, count(*) AS size_listings, max(price) AS size_best FROM listing GROUP BY brand")
def b12(v):
    nested = v.parts.groupBy("brand").agg(F.struct(F.count(F.lit(1)).alias("listings"), F.max("price").alias("best")).alias("size"))
    return nested.select("brand", F.col("size.listings").alias("size_listings"), F.col("size.best").alias("size_best"))


@Q.add("B14_run_registry", "SELECT source AS dataset, count(*) AS versions, max(doc_id) AS newest FROM documents GROUP BY source", views=False)
def b14(v):
    runs = v.table("documents").select(F.col("source").alias("dataset"), "doc_id")
    return runs.groupBy("dataset").agg(F.count(F.lit(1)).alias("versions"), F.max("doc_id").alias("newest"))


_LAUNCHED = "TIMESTAMP '2020-01-01' + to_hours(s_suppkey::INT)"


@Q.add("B14_run_lifecycle", f"""SELECT s_nationkey::VARCHAR AS dataset, s_suppkey::VARCHAR AS run, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS version, {_LAUNCHED} AS started,
  CASE WHEN s_acctbal > 2000 OR s_acctbal < 0 THEN {_LAUNCHED} + INTERVAL 30 MINUTE END AS completed, CASE WHEN s_acctbal > 2000 THEN 'success' WHEN s_acctbal < 0 THEN 'failed' ELSE 'running' END AS status, CASE WHEN s_acctbal < 0 THEN 'no rows' END AS note FROM supplier""", views=False)
def b14_lifecycle(v):
    """Runs start, then end in success or failure or are still on their way; their states come back from the registry."""
    start = F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("s_suppkey").cast("int"))
    s = v.table("supplier").select(F.col("s_nationkey").cast("string").alias("dataset"), F.col("s_suppkey").cast("string").alias("run"), start.alias("at"), "s_acctbal")
    book, text = store.Registry(v.spark, temp_path(v.spark, "registry")), lambda x: F.lit(x).cast("string")
    book.record(s.withColumns({"state": F.lit("running"), "note": text(None)}))
    ends = s.withColumn("at", F.col("at") + F.make_dt_interval(mins=F.lit(30)))
    book.record(ends.where("s_acctbal > 2000").withColumns({"state": F.lit("success"), "note": text(None)}))
    book.record(ends.where("s_acctbal < 0").withColumns({"state": F.lit("failed"), "note": text("no rows")}))
    return book.runs()


@Q.add("B10_upload_conflicts", """SELECT sha256(text) AS hash, count(*) AS copies, count(DISTINCT source) AS markets, min(doc_id) AS first, count(DISTINCT coalesce('=' || source, '') || '|' || coalesce('=' || lang, '')) > 1 AS conflict
  FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""", views=False)
def b10_conflicts(v):
    return store.upload_conflicts(v.table("documents"), "text", "doc_id", "source", "lang")


@Q.add("C14_units", r"""WITH t AS (SELECT id, size::VARCHAR || ' kg box of ' || (size * 7)::VARCHAR || 'g and 3oz' AS t FROM listing) SELECT id, round(greatest(size * 1000.0::DOUBLE, size * 7.0::DOUBLE, 3 * 28.3495::DOUBLE), 6) AS grams FROM listing""")
def c14(v):
    t = F.concat(F.col("size").cast("string"), F.lit(" kg box of "), (F.col("size") * 7).cast("string"), F.lit("g and 3oz"))
    return v.parts.select("id", r6(FI.best_unit(t, "gram")).alias("grams"))


@Q.add("C34_schema_assignment", None)
def c34(v):
    got = FI.map_headers(v.table("part").columns, {"title": ["p name"], "brand": ["p brand"], "price": ["p retailprice"], "category": ["p type"]}, pinned={"id": "p_partkey"})
    return v.spark.createDataFrame(sorted(got.items()), "field string, header string")


@Q.add("D10_request", None)
def d10(v):
    q = FI.parse_request("a red ring under $1000 with 4 stars")
    hit = v.parts.where(F.col("price") <= q.get("max_price", 1e18))
    for w in q["keywords"]:
        hit = hit.where(F.array_contains(F.split("title", " "), w))
    return hit.orderBy("price", "id").limit(20).select("id", "title", "price")


@Q.add("G24_normal_scores", None)
def g24(v):
    w = W.partitionBy("segment")
    ranked = v.listing.where("sales IS NOT NULL").withColumns({"k": F.row_number().over(w.orderBy(F.desc("sales"), "id")), "n": F.count(F.lit(1)).over(w)})
    return ranked.select("id", MO.normal_score(F.col("k"), F.col("n")).alias("z"))


@Q.add("H3_nearest_neighbours", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)
  SELECT query, vec_id FROM (SELECT q.vec_id AS query, d.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, d.v), 12) DESC, d.vec_id) AS k FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0) WHERE k <= 10""", views=False)
def h3(v):
    from marketloom.operators.neighbours import nearest_vectors

    e = v.table("embeddings")
    return nearest_vectors(e.where("vec_id % 50 = 0"), e, 10).select("query", "vec_id")


@Q.add("I3_outlier_forest", None)
def i3(v):
    return MO.outlier_scores(v.listing, "id", ["price", "sales"])


@Q.add("I6_trained_relevance", None)
def i6(v):
    d = v.table("documents").withColumn("base", F.least(F.lit(1.0), F.col("n_chars") / 5000))
    return MO.blended_relevance(d, v.table("labels"), "doc_id", "text", "base", "quality")


@Q.add("I19_text_ratio", None)
def i19(v):
    """Titles are compared once for each two that share a block, not once for each pair of rows."""
    from marketloom.operators.entities import row_pairs

    rows = v.parts.withColumn("block", F.concat_ws("|", "brand", "segment", F.col("size").cast("string")))
    titles = rows.select("block", "title").distinct()
    both = titles.withColumnRenamed("title", "title_a").join(titles.withColumnRenamed("title", "title_b"), "block").select("title_a", "title_b").distinct()
    known = materialize(both.withColumn("text", MO.text_ratio("title_a", "title_b")), "ratios")
    j = row_pairs(rows, "id", ["block"], ["title", "price"]).join(known, ["title_a", "title_b"], "left")
    return j.select("a", "b", (0.5 * F.coalesce("text", F.lit(0.0)) + 0.3 + 0.2 * F.least("price_a", "price_b") / F.greatest("price_a", "price_b")).alias("score"))


@Q.add("J2_family_clusters", None)
def j2(v):
    return MO.best_kmeans(v.parts, "id", "title")


@Q.add("J6_nearest_centroid", None)
def j6(v):
    return MO.nearest_centroids(v.table("embeddings"), "vec_id", "label", "embedding")


@Q.add("J9_variant_labels", """WITH t AS (SELECT id, segment, unnest(string_split(title, ' ')) AS w FROM listing), d AS (SELECT segment, w, count(*) AS df FROM t GROUP BY ALL) SELECT id, arg_min(w, (df, w)) AS variant FROM t JOIN d USING (segment, w) GROUP BY id""")
def j9(v):
    t = v.parts.select("id", "segment", F.explode(F.split("title", " ")).alias("w"))
    d = t.groupBy("segment", "w").agg(F.count(F.lit(1)).alias("df"))
    return t.join(d, ["segment", "w"]).groupBy("id").agg(F.min_by("w", F.struct("df", "w")).alias("variant"))


@Q.add("K5_bootstrap", None)
def k5(v):
    return MO.bootstrap_mean(v.listing, "id", "segment", "sales")


@Q.add("K53_price_bands", None)
def k53(v):
    from marketloom.operators.ranking import rank_bands

    b = rank_bands(v.listing, "price", ["segment"], 4, "id").withColumn("key", F.concat_ws("|", "segment", F.col("band").cast("string")))
    return MO.bootstrap_mean(b, "id", "key", "sales")


@Q.add("K19_explained_opportunity", f"""WITH g AS (SELECT segment, count(*) AS n, avg((sales IS NOT NULL)::INT) AS cover, sum(revenue) AS rev, count(DISTINCT brand) AS brands, avg((date_diff('day', launched::DATE, DATE '{MONTH}') <= 1780)::INT) AS fresh FROM listing GROUP BY 1),
  s AS (SELECT *, rev / max(rev) OVER () AS demand, 1 - n / max(n) OVER () AS room FROM g) SELECT segment, CASE WHEN n < 3 OR cover < 0.2 THEN NULL ELSE round(100 * (0.5 * demand + 0.3 * room + 0.2 * fresh), 4) END AS score,
  array_to_string(list_filter([CASE WHEN demand > 0.9 THEN 'high_demand' END, CASE WHEN room > 0.05 THEN 'less_crowded' END, CASE WHEN fresh > 0.3 THEN 'open_to_entrants' END], lambda x: x IS NOT NULL), ',') AS reasons FROM s""")
def k19(v):
    fresh = (F.datediff(F.lit(MONTH).cast("date"), "launched") <= 1780).cast("double")
    g = v.listing.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("sales").isNotNull().cast("double")).alias("cover"), F.sum("revenue").alias("rev"), F.avg(fresh).alias("fresh"))
    every = W.partitionBy(F.lit(0))
    g = g.withColumns({"demand": F.col("rev") / F.max("rev").over(every), "room": 1 - F.col("n") / F.max("n").over(every)})
    mean, _ = X.mean_of_known([(F.col("demand"), 0.5), (F.col("room"), 0.3), (F.col("fresh"), 0.2)])
    why = X.violations((F.col("demand") > 0.9, "high_demand"), (F.col("room") > 0.05, "less_crowded"), (F.col("fresh") > 0.3, "open_to_entrants"))
    return g.select("segment", F.when((F.col("n") >= 3) & (F.col("cover") >= 0.2), F.round(100 * mean, 4)).alias("score"), F.array_join(why, ",").alias("reasons"))


@Q.add("K30_pooled_growth", """WITH m AS (SELECT brand, date_diff('month', TIMESTAMP '1990-01-01', period) AS x, ln(sum(sales)) AS y FROM history GROUP BY brand, period), f AS (SELECT brand, regr_slope(y, x) AS b, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x) AS var FROM m GROUP BY brand HAVING count(*) >= 4),
  s AS (SELECT count(*) AS k, sum(1 / var) AS w, sum(1 / var / var) AS w2, sum(b / var) AS wy, sum(b * b / var) AS wyy FROM f), t AS (SELECT k, greatest(0, (wyy - wy * wy / w - (k - 1)) / (w - w2 / w)) AS tau2 FROM s), g AS (SELECT k, tau2, sum(b / (var + tau2)) / sum(1 / (var + tau2)) AS growth, sqrt(1 / sum(1 / (var + tau2))) AS se FROM f, t GROUP BY k, tau2)
  SELECT k, round(tau2, 9) AS tau2, round(growth, 7) AS growth, round(growth - 1.96 * se, 7) AS low, round(growth + 1.96 * se, 7) AS high FROM g""")
def k30(v):
    x = (F.year("period") - 1990) * 12 + F.month("period") - 1
    m = v.history.groupBy("brand", x.cast("double").alias("x")).agg(F.log(F.sum("sales")).alias("y"))
    f = m.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx")).where("n >= 4")
    f = f.withColumn("var", (F.col("syy") - F.col("b") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    g = MO.pooled_growth(f, "brand", "b", "var")
    return g.withColumn("tau2", F.round("tau2", 9)).withColumns({c: F.round(c, 7) for c in ("growth", "low", "high")})


_PCTL = "((rank() OVER (PARTITION BY brand ORDER BY {c}) + (count(*) OVER (PARTITION BY brand, {c}) - 1) / 2) / count(*) OVER (PARTITION BY brand))"


@Q.add("K38_shopping", f"WITH k AS (SELECT * FROM listing WHERE sales IS NOT NULL), s AS (SELECT id, brand, 0.6 * {_PCTL.format(c='sales')} + 0.4 * (1 - {_PCTL.format(c='price')} + 1.0 / count(*) OVER (PARTITION BY brand)) AS utility, NOT EXISTS (SELECT 1 FROM k b WHERE b.brand = a.brand AND b.sales >= a.sales AND b.price <= a.price AND (b.sales > a.sales OR b.price < a.price)) AS front FROM k a) SELECT id, brand, front, round(utility, 6) AS utility FROM s")
def k38(v):
    from marketloom.operators.ranking import skyline

    k = v.listing.where("sales IS NOT NULL").select("id", "brand", "sales", "price")
    front = skyline(k, "sales", "price", ["brand"]).select("id", F.lit(True).alias("front"))
    n = F.count(F.lit(1)).over(W.partitionBy("brand"))
    utility = 0.6 * X.rank_share("sales", "brand") + 0.4 * (1 - X.rank_share("price", "brand") + 1 / n)
    return k.withColumn("utility", r6(utility)).join(front, "id", "left").select("id", "brand", F.coalesce("front", F.lit(False)).alias("front"), "utility")


@Q.add("K39_recommend", "SELECT id, round(0.45 * list_contains(string_split(title, ' '), 'red')::INT + 0.2 * (1 - (price - 900) / 200) + 0.2 * coalesce(sales / 100, 0) + 0.15 * (size / 50), 6)::DOUBLE AS score FROM listing ORDER BY score DESC, id LIMIT 10")
def k39(v):
    hit = F.array_contains(F.split("title", " "), "red").cast("double")
    s = 0.45 * hit + 0.2 * (1 - (F.col("price") - 900) / 200) + 0.2 * F.coalesce(F.col("sales") / 100, F.lit(0.0)) + 0.15 * (F.col("size") / 50)
    return v.listing.select("id", r6(s).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@Q.add("K40_launch_draws", None)
def k40(v):
    c = v.listing.where("sales > 0").groupBy("segment").agg(F.avg(F.log("sales")).alias("m"), F.stddev(F.log("sales")).alias("s"))
    return MO.launch_draws(c, "segment", "m", "s", 120.0, 70.0, -1.2)


@Q.add("F49_market_brief", """WITH b AS (SELECT segment, brand, sum(revenue) AS rev, row_number() OVER (PARTITION BY segment ORDER BY sum(revenue) DESC NULLS LAST, brand) AS k FROM listing GROUP BY segment, brand) SELECT segment, string_agg(brand, ',' ORDER BY k) FILTER (WHERE k <= 3) AS leaders, round(sum(rev), 4) AS revenue, CASE WHEN count(rev) >= 20 THEN 'watch_leader' ELSE 'collect_data' END AS action FROM b GROUP BY segment""")
def f49(v):
    b = v.listing.groupBy("segment", "brand").agg(F.sum("revenue").alias("rev"))
    b = b.withColumn("k", F.row_number().over(W.partitionBy("segment").orderBy(F.desc_nulls_last("rev"), "brand")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "brand")))), lambda x: x["brand"]), ",")
    return b.groupBy("segment").agg(names.alias("leaders"), F.round(F.sum("rev"), 4).alias("revenue"), F.when(F.count("rev") >= 20, "watch_leader").otherwise("collect_data").alias("action"))


@Q.add("I9_nearest_label", """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), r AS (SELECT q.vec_id, d.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, d.v), 12) DESC, d.vec_id) AS k, list_dot_product(q.v, d.v) AS c FROM u q JOIN u d ON q.vec_id <> d.vec_id) SELECT vec_id, CASE WHEN c >= 0.35 THEN label END AS label FROM r WHERE k = 1""", views=False)
def i9(v):
    from marketloom.operators.neighbours import nearest_vectors

    e = v.table("embeddings")
    near = nearest_vectors(e, e, 1).join(e.select("vec_id", "label"), "vec_id")
    return near.select(F.col("query").alias("vec_id"), F.when(F.col("cosine") >= 0.35, F.col("label")).alias("label"))


@Q.add("K56_launch_attractiveness", "WITH g AS (SELECT segment, sum(revenue) AS rev, count(DISTINCT brand) AS brands, avg((sales IS NOT NULL)::INT) AS cover FROM listing GROUP BY 1), p AS (SELECT segment, (rank() OVER (ORDER BY rev) + (count(*) OVER (PARTITION BY rev) - 1) / 2) / count(*) OVER () AS demand, 1 - brands / 30 AS competition, cover FROM g) SELECT segment, round((0.5 * demand + 0.3 * competition + 0.2 * cover) / 1.0, 6)::DOUBLE AS score, 'pain,suppliers' AS unavailable FROM p")
def k56(v):
    g = v.listing.groupBy("segment").agg(F.sum("revenue").alias("rev"), F.count_distinct("brand").alias("brands"), F.avg(F.col("sales").isNotNull().cast("double")).alias("cover"))
    parts = {"demand": (X.rank_share("rev"), 0.5), "competition": (1 - F.col("brands") / 30, 0.3), "coverage": (F.col("cover"), 0.2), "pain": (F.lit(None).cast("double"), 0.2), "suppliers": (F.lit(None).cast("double"), 0.1)}
    mean, _ = X.mean_of_known(list(parts.values()))
    missing = F.array_join(X.violations(*[(c.isNull(), n) for n, (c, _) in parts.items() if n in ("pain", "suppliers")]), ",")
    return g.select("segment", r6(mean).alias("score"), missing.alias("unavailable"))


@Q.add("I17_stable_segments", """WITH o AS (SELECT id, segment AS family, segment || '/' || brand AS old_id FROM listing WHERE sales IS NOT NULL), n AS (SELECT id, segment || '/' || brand || CASE WHEN size > 45 THEN '/xl' ELSE '' END AS new_id FROM listing),
  b AS (SELECT * FROM o JOIN n USING (id)), v AS (SELECT old_id, new_id, count(*) AS n FROM b GROUP BY ALL), p AS (SELECT old_id, count(*) AS alive FROM b GROUP BY 1), f AS (SELECT new_id, v.old_id, row_number() OVER (PARTITION BY new_id ORDER BY v.n DESC, v.old_id) AS k FROM v JOIN p ON p.old_id = v.old_id WHERE 2 * v.n > alive)
  SELECT s.new_id, coalesce(f.old_id, 'new-' || s.new_id) AS stable_id FROM (SELECT DISTINCT new_id FROM n) s LEFT JOIN f ON f.new_id = s.new_id AND k = 1""")
def i17(v):
    from marketloom.operators.entities import stable_ids

    key = F.concat_ws("/", "segment", "brand")
    old = v.listing.where("sales IS NOT NULL").select("id", key.alias("old_id"))
    new = v.parts.select("id", F.concat(key, F.when(F.col("size") > 45, "/xl").otherwise("")).alias("new_id"))
    return stable_ids(old, new, "id")


@Q.add("I18_human_decisions", None)
def i18(v):
    """Clusters of matches, joined by human merges and cut by configuration: the size class is part of the product."""
    from marketloom.operators.entities import clusters
    from marketloom.plans.joins import _matches

    human = v.table("events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    merges = human.join(v.parts.select(F.col("id").alias("a")), "a", "left_semi").join(v.parts.select(F.col("id").alias("b")), "b", "left_semi").where("a < b").select("a", "b")
    c = clusters(v.parts, "id", _matches(v).unionByName(merges))
    return c.join(v.parts, "id").select("id", F.concat_ws("#", F.col("cluster").cast("string"), F.floor(F.col("size") / 25).cast("string")).alias("product"))


@Q.add("I22_hashed_embedding", None)
def i22(v):
    from pyspark.ml.functions import vector_to_array

    return MO.hashed_vectors(v.table("benchmark"), "text", 64).select("item_id", vector_to_array("vector").alias("embedding"))


@Q.add("I26_attributes", r"""SELECT id, CASE WHEN regexp_matches(title, '\b(red|blue|green)\b') THEN regexp_extract(title, '\b(red|blue|green)\b', 1) END AS color, CASE WHEN regexp_matches(title, '\b(small|large)\b') THEN regexp_extract(title, '\b(small|large)\b', 1) END AS size_word, round(CASE WHEN regexp_matches(title, '\b(red|blue|green)\b') AND size > 40 THEN 0.54 WHEN regexp_matches(title, '\b(red|blue|green)\b') THEN 0.9 ELSE 0 END, 6)::DOUBLE AS confidence FROM listing""")
def i26(v):
    found = lambda p: F.nullif(F.regexp_extract("title", rf"\b({p})\b", 1), F.lit(""))
    color = found("red|blue|green")
    sure = F.when(color.isNull(), 0.0).when(F.col("size") > 40, 0.9 * 0.6).otherwise(0.9)
    return v.parts.select("id", color.alias("color"), found("small|large").alias("size_word"), r6(sure).alias("confidence"))


_SCHEMA = {
    "color": {"kind": "enum", "patterns": {"red": r"\bred\b", "blue": r"\bblue\b"}},
    "state": {"kind": "list", "patterns": {w: rf"\b{w}\b" for w in ("old", "new", "hot", "cold")}},
    "weight": {"kind": "number", "unit": "gram", "plausible": (5000.0, 40000.0)},
    "maker": {"kind": "token", "pattern": r"brand#\d+", "context": "made by"},
}


@Q.add("I26_attribute_schema", """WITH l AS (SELECT id, title, CASE WHEN size % 3 = 0 THEN 'blue or red, hot' ELSE 'cold' END AS category, size * 1000.0 AS g, upper(brand) AS brand, size % 2 = 0 AS told FROM listing),
  w AS (SELECT id, string_split(title, ' ')[1] AS t, category, g, brand, told FROM l)
  SELECT id, 'color' AS attribute, CASE WHEN t IN ('red', 'blue') THEN [t] ELSE ['blue', 'red'] END AS values, NULL::DOUBLE AS number, CASE WHEN t IN ('red', 'blue') THEN 0.85 ELSE 0.459 END::DOUBLE AS confidence, CASE WHEN t IN ('red', 'blue') THEN 'title' ELSE 'category' END AS field, t NOT IN ('red', 'blue') AS conflict FROM w WHERE t IN ('red', 'blue') OR category LIKE 'blue%'
  UNION ALL SELECT id, 'state', CASE WHEN t IN ('old', 'new', 'hot', 'cold') THEN [t] WHEN category = 'cold' THEN ['cold'] ELSE ['hot'] END, NULL, CASE WHEN t IN ('old', 'new', 'hot', 'cold') THEN 0.85 ELSE 0.765 END, CASE WHEN t IN ('old', 'new', 'hot', 'cold') THEN 'title' ELSE 'category' END, false FROM w
  UNION ALL SELECT id, 'weight', [g::DOUBLE::VARCHAR], g, 0.72, 'description', false FROM w WHERE g BETWEEN 5000 AND 40000
  UNION ALL SELECT id, 'maker', [brand], NULL, 0.64, 'description', false FROM w WHERE told""")
def i26_schema(v):
    """Attributes of four kinds from three texts: the title, then a category, then a description with a maker told or not."""
    size = F.col("size")
    texts = v.parts.select("id", "title", F.when(size % 3 == 0, "blue or red, hot").otherwise("cold").alias("category"), F.concat(size.cast("string"), F.lit(" kg, "), F.when(size % 2 == 0, "made by ").otherwise("like "), F.lower("brand")).alias("description"))
    return TX.attributes(texts, "id", ["title", "category", "description"], _SCHEMA)


@Q.add("J1_taxonomy_segments", None)
def j1(v):
    return MO.taxonomy_segments(v.parts, "id", "segment", "title")


@Q.add("I22_projected_embedding", None)
def i22_projected(v):
    """Whole texts as 256 numbers from hashed words, pairs of words and letters."""
    return EM.projected_embedding(v.table("documents"), "doc_id", "text")


@Q.add("J1_split_families", None)
def j1_split(v):
    """Brands as families: split where titles form distinct groups."""
    return FA.split_families(v.parts, "id", "brand", "title")


@Q.add("J8_text_models", None)
def j8(v):
    """Titles of a brand joined by average linkage."""
    return LI.title_models(v.parts, "id", "brand", "title")


@Q.add("J3_density_groups", None)
def j3(v):
    return MO.density_groups(v.listing.withColumn("s", F.col("sales")), "id", "segment", ["price", "s"], 3.0)


@Q.add("K41_compare_launches", None)
def k41(v):
    c = v.listing.where("sales > 0").groupBy("segment").agg(F.avg(F.log("sales")).alias("m"), F.stddev(F.log("sales")).alias("s"))
    return MO.compare_launches(c, "segment", "m", "s", [("low", 90.0, 60.0), ("mid", 110.0, 60.0), ("high", 140.0, 65.0)])


@Q.add("K52_synthetic_market", None)
def k52(v):
    return MO.synthetic_market(v.spark, 2000).groupBy("segment").agg(F.count(F.lit(1)).alias("listings"), F.sum("units_true").alias("units"), F.sum("badge").alias("shown"))


@Q.add("K24_recommended_spec", """WITH f AS (SELECT segment, unnest(string_split(title, ' ')) AS feature, sales FROM listing), g AS (SELECT segment, feature, count(*) AS n, avg(sales) AS mean FROM f GROUP BY ALL HAVING count(*) >= 20 AND count(sales) >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(mean, 9) DESC, feature) AS k FROM g)
  SELECT segment, string_agg(feature, '+' ORDER BY k) AS spec FROM r WHERE k <= 2 GROUP BY segment""")
def k24(v):
    f = v.listing.select("segment", F.explode(F.split("title", " ")).alias("feature"), "sales")
    g = f.groupBy("segment", "feature").agg(F.count(F.lit(1)).alias("n"), F.count("sales").alias("known"), F.avg("sales").alias("mean")).where("n >= 20 AND known >= 5")
    top = X.top_per_group(g, ["segment"], [F.desc(F.round("mean", 9)), F.col("feature")], 2)
    return top.groupBy("segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), "+").alias("spec"))


@Q.add("A19_header_row", "SELECT 1 AS header_row", views=False)
def a19(v):
    """A title line above the header, as exports have it."""
    rows = [("Nations of the market", None, None), ("n nationkey", "n name", "n regionkey")] + [tuple(str(x) for x in r) for r in v.table("nation").orderBy("n_nationkey").collect()]
    df = v.spark.createDataFrame(rows, "a string, b string, c string").coalesce(1)
    return v.spark.createDataFrame([(FI.header_row(df, {"id": ["n nationkey"], "name": ["n name"]}),)], "header_row int")


@Q.add("A20_header_map", "SELECT * FROM (VALUES ('brand', 'p_brand'), ('title', 'p_name')) AS t(field, header)", views=False)
def a20(v):
    got = FI.greedy_headers(v.table("part").columns, {"title": ["p name"], "brand": ["p brand"]}, least=0.9)
    return v.spark.createDataFrame(sorted(got.items()), "field string, header string")


#: What event kinds and product names are called elsewhere; none is a mere close spelling of a header, which SQL could not tell.
_SYNONYMS = {"view": ["view", "page view"], "order": ["purchase", "buy"], "ring": ["ring", "ring red"], "small": ["small size"]}


@Q.add("C31_header_rules", """WITH h AS (SELECT event_type AS header FROM events UNION SELECT p_name FROM part), s(field, synonym) AS (VALUES ('view', 'view'), ('view', 'page view'), ('order', 'purchase'), ('order', 'buy'), ('ring', 'ring'), ('ring', 'ring red'), ('small', 'small size')),
  t AS (SELECT header, field, regexp_extract_all(lower(header), '[\\p{L}\\p{N}]+') AS hw, string_split(synonym, ' ') AS sw FROM h, s WHERE header IS NOT NULL)
  SELECT header, field, max(CASE WHEN hw = sw THEN 1 WHEN list_has_all(hw, sw) THEN CASE WHEN len(sw) > 1 THEN 0.8 ELSE 0.7 END ELSE 0 END)::DOUBLE AS score FROM t GROUP BY ALL""", views=False)
def c31(v):
    headers = v.table("events").select(F.col("event_type").alias("header")).union(v.table("part").select("p_name"))
    return FI.header_scores(headers, "header", _SYNONYMS)


@Q.add("C27_valid_names", "SELECT DISTINCT source, regexp_full_match(source, '[a-z0-9_-]{1,64}') AS valid FROM documents", views=False)
def c27(v):
    return v.table("documents").select("source").distinct().withColumn("valid", F.col("source").rlike("^[a-z0-9_-]{1,64}$"))


@Q.add("C33_field_plausibility", """SELECT 'lang' AS field, count(DISTINCT lang) <= 50 AND avg(length(lang)) <= 20 AS category, avg((try_cast(lang AS DOUBLE) IS NOT NULL)::INT) > 0.9 AS numeric FROM documents UNION ALL
  SELECT 'n_chars', count(DISTINCT n_chars) <= 50 AND avg(length(n_chars::VARCHAR)) <= 20, avg((try_cast(n_chars::VARCHAR AS DOUBLE) IS NOT NULL)::INT) > 0.9 FROM documents""", views=False)
def c33(v):
    d, out = v.table("documents"), None
    for c in ("lang", "n_chars"):
        t = F.col(c).cast("string")
        row = d.agg(((F.count_distinct(t) <= 50) & (F.avg(F.length(t)) <= 20)).alias("category"), (F.avg(t.try_cast("double").isNotNull().cast("double")) > 0.9).alias("numeric")).select(F.lit(c).alias("field"), "category", "numeric")
        out = row if out is None else out.unionByName(row)
    return out


@Q.add("J4_merge_centroids", """WITH RECURSIVE x AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), n AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM m),
  e AS (SELECT a.label AS a, b.label AS b FROM n a JOIN n b ON a.i = b.i AND a.label <> b.label GROUP BY ALL HAVING sum(a.m * b.m) >= 0.1), l AS (SELECT DISTINCT label FROM embeddings), r AS (SELECT label, label AS root FROM l UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.label) SELECT label, min(root) AS merged FROM r GROUP BY label""", views=False)
def j4(v):
    """Groups whose mean vectors are alike become one; one row per group is all that is compared."""
    from marketloom.functions.scale import connected_components

    at = v.table("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = at.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    n = m.withColumn("m", F.col("m") / F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy("label"))))
    pairs = n.toDF("a", "i", "ma").join(n.toDF("b", "i", "mb"), "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("cos")).where("cos >= 0.1")
    roots = connected_components(pairs.select("a", "b")).toDF("label", "root")
    labels = v.table("embeddings").select("label").distinct()
    return labels.join(roots, "label", "left").select("label", F.coalesce("root", "label").alias("merged"))
