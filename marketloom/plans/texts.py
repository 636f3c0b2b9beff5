"""Text, taxonomy and graph operators over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.operators import entities as E
from marketloom.operators import graph as G
from marketloom.operators import neighbours as NB
from marketloom.operators import ngrams as NG
from marketloom.operators import text as T
from marketloom.plans.base import Book

Q = Book()
QUERIES, SQL = Q.queries, Q.sql
r6 = lambda c: F.round(c, 6)

_TFIDF = r"""tk AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM benchmark), tf AS (SELECT item_id, token, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
  rw AS (SELECT item_id, token, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (token)), vx AS (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM rw)"""


@Q.add("I5_tfidf_cosine", f"WITH {_TFIDF} SELECT x.item_id AS a, y.item_id AS b, round(sum(x.w * y.w), 6) AS cosine FROM vx x JOIN vx y ON x.token = y.token AND x.item_id < y.item_id GROUP BY ALL", views=False)
def i5(v):
    # pairs come from shared tokens, so texts without one never meet
    vec = E.tfidf(v.table("benchmark"), "item_id", "text")
    j = vec.toDF("a", "token", "wa").join(vec.toDF("b", "token", "wb"), "token").where("a < b")
    return j.groupBy("a", "b").agg(r6(F.sum(F.col("wa") * F.col("wb"))).alias("cosine"))


@Q.add("E11_nearest_texts", f"""WITH {_TFIDF}, p AS (SELECT x.item_id AS a, y.item_id AS b, sum(x.w * y.w) AS c FROM vx x JOIN vx y ON x.token = y.token AND x.item_id <> y.item_id GROUP BY ALL)
  SELECT a, b, k::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 9) DESC, b) AS k FROM p) WHERE k <= 10""", views=False)
def e11(v):
    b = v.table("benchmark")
    return NG.nearest_texts(b, b, "item_id", "text", 10).select("a", "b", "place")


_PROTOTYPES = {"pos": ["the that this and of", "there where the other"], "neg": ["der die und nicht", "les des que pour"]}
_GRAMS = r"""px AS (SELECT kind || ':' || i AS id, kind, text FROM (VALUES ('pos', 0, 'the that this and of'), ('pos', 1, 'there where the other'), ('neg', 0, 'der die und nicht'), ('neg', 1, 'les des que pour')) AS p(kind, i, text)),
  tx AS (SELECT doc_id::VARCHAR AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT id, text FROM px), ws AS (SELECT id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM tx),
  wd AS (SELECT id, ' ' || unnest(w) || ' ' AS p FROM ws), ng AS (SELECT id, p, unnest([3, 4, 5]) AS n FROM wd),
  gr AS (SELECT id, 'word' AS space, unnest(w) AS gram FROM ws UNION ALL SELECT id, 'word', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM ws
    UNION ALL SELECT id, 'letter', unnest(list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i, n))) FROM ng WHERE length(p) >= n),
  gt AS (SELECT id, space, gram, count(*) AS tf FROM gr GROUP BY ALL), gd AS (SELECT space, gram, count(*) AS df FROM gt GROUP BY ALL),
  gw AS (SELECT id, space, gram, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM tx)) / (1 + df)) + 1) AS w FROM gt JOIN gd USING (space, gram)), gn AS (SELECT id, space, sqrt(sum(w * w)) AS s FROM gw GROUP BY ALL),
  gv AS (SELECT id, space, gram, w / s / sqrt(count(DISTINCT space) OVER (PARTITION BY id)) AS w FROM gw JOIN gn USING (id, space))"""


@Q.add("I5_prototype_relevance", f"""WITH {_GRAMS}, dt AS (SELECT x.id, px.kind, sum(x.w * y.w) AS c FROM gv x JOIN gv y USING (space, gram) JOIN px ON px.id = y.id WHERE x.id NOT LIKE '%:%' GROUP BY x.id, px.id, px.kind),
  sm AS (SELECT id, sum(c) FILTER (WHERE kind = 'pos') / 2 AS pos, sum(c) FILTER (WHERE kind = 'neg') / 2 AS neg FROM dt GROUP BY id)
  SELECT doc_id, round(coalesce(pos, 0), 6)::DOUBLE AS pos, round(coalesce(neg, 0), 6)::DOUBLE AS neg,
    round(100 / (1 + exp(-(-0.6 + 5 * (coalesce(pos, 0) - coalesce(neg, 0)) + 3.2 * coalesce(least(contains(text, 'the')::INT + contains(text, 'and')::INT, 2), 0) - 3.2 * coalesce(least(contains(text, 'que')::INT, 2), 0) + CASE WHEN source = 'src0' THEN 1.2 WHEN source = 'src1' THEN -3.0 ELSE 0 END))), 5) AS relevance
  FROM documents LEFT JOIN sm ON sm.id = doc_id::VARCHAR""", views=False)
def i5_prototypes(v):
    """Words, pairs of words and letters against wanted and unwanted examples, then keywords and category."""
    d = v.table("documents")
    near = NG.prototype_similarity(d, "doc_id", "text", _PROTOTYPES)
    has = lambda w: F.coalesce(F.contains(F.col("text"), F.lit(w)), F.lit(False)).cast("int")
    category = F.when(F.col("source") == "src0", True).when(F.col("source") == "src1", False)
    facts = d.select("doc_id", (has("the") + has("and")).alias("wanted"), has("que").alias("unwanted"), category.alias("category"))  # texts aren't joined
    score = T.relevance_score(F.col("pos"), F.col("neg"), F.col("wanted"), F.col("unwanted"), F.col("category"))
    return facts.join(near, "doc_id").select("doc_id", r6("pos").alias("pos"), r6("neg").alias("neg"), F.round(score, 5).alias("relevance"))


@Q.add("I9_similarity_tier", r"""WITH rf AS (SELECT doc_id, text, quality FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL), al AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
  tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS t FROM al), tf AS (SELECT doc_id, t, count(*) AS tf FROM tk GROUP BY ALL), dn AS (SELECT t, count(*) AS df FROM tf JOIN rf USING (doc_id) GROUP BY t),
  rw AS (SELECT doc_id, t, tf * (ln((1 + (SELECT count(*) FROM rf)) / (1 + df)) + 1) AS w FROM tf JOIN dn USING (t)), vx AS (SELECT doc_id, t, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM rw),
  cs AS (SELECT x.doc_id, rf.doc_id AS other, rf.quality, round(sum(x.w * y.w), 9) AS c FROM vx x JOIN vx y USING (t) JOIN rf ON rf.doc_id = y.doc_id WHERE x.doc_id <> y.doc_id GROUP BY ALL),
  tp AS (SELECT * FROM cs WHERE c >= 0.6 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, other) = 1)
  SELECT documents.doc_id, quality AS label, round(c, 6)::DOUBLE AS confidence FROM documents LEFT JOIN tp USING (doc_id)""", views=False)
def i9_tier(v):
    """The label of the nearest other labelled text, if it is near enough to say."""
    d = v.table("documents")
    known = d.join(v.table("labels").where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    near = NG.nearest_texts(d, known, "doc_id", "text", 1, least=0.6, sublinear=False)
    near = near.join(known.select(F.col("doc_id").alias("b"), "quality"), "b").select(F.col("a").alias("doc_id"), F.col("quality").alias("label"), r6("cosine").alias("confidence"))
    return d.select("doc_id").join(near, "doc_id", "left")


@Q.add("I7_score_unique_texts", "WITH u AS (SELECT text, length(text) % 7 AS score FROM documents GROUP BY text) SELECT doc_id, score::INT AS score FROM documents JOIN u USING (text)", views=False)
def i7(v):
    d = v.table("documents").withColumn("key", F.sha2("text", 256))
    unique = d.groupBy("key").agg((F.length(F.min("text")) % 7).alias("score"))
    return d.join(unique, "key").select("doc_id", "score")


@Q.add("I8_signal_words", r"SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'der', 'les', 'que'])), ',') AS words FROM documents", views=False)
def i8(v):
    terms = F.array(*[F.lit(x) for x in ("the", "der", "les", "que")])
    return v.table("documents").select("doc_id", F.array_join(F.array_sort(F.array_intersect(F.split(F.lower("text"), " "), terms)), ",").alias("words"))


@Q.add("I5_relevance_logit", """SELECT doc_id, round(100 / (1 + exp(-(-0.6 + 5 * (CASE WHEN lang = 'en' THEN 0.4 ELSE 0.1 END - 0.2) + 3.2 * least(contains(text, 'the')::INT + contains(text, 'and')::INT, 2) - 3.2 * least(contains(text, 'que')::INT, 2) + CASE WHEN source = 'src0' THEN 1.2 WHEN source = 'src1' THEN -3.0 ELSE 0 END))), 5) AS relevance FROM documents""", views=False)
def i5b(v):
    has = lambda w: F.contains(F.col("text"), F.lit(w)).cast("int")
    near = F.when(F.col("lang") == "en", 0.4).otherwise(0.1)
    category = F.when(F.col("source") == "src0", True).when(F.col("source") == "src1", False)
    return v.table("documents").select("doc_id", F.round(T.relevance_score(near, F.lit(0.2), has("the") + has("and"), has("que"), category), 5).alias("relevance"))


@Q.add("I10_category_scope", """WITH t AS (SELECT segment, unnest(string_split(title, ' ')) AS w FROM listing), s AS (SELECT segment, avg((w IN ('red', 'blue'))::INT) AS inc, avg((w IN ('ring'))::INT) AS exc FROM t GROUP BY 1) SELECT segment, CASE WHEN exc - inc > 0.3 THEN 'out' WHEN inc - exc > 0.05 THEN 'in' ELSE 'review' END AS scope FROM s""")
def i10(v):
    t = v.parts.select("segment", F.explode(F.split("title", " ")).alias("w"))
    share = lambda *ws: F.avg(F.col("w").isin(*ws).cast("double"))
    s = t.groupBy("segment").agg(share("red", "blue").alias("inc"), share("ring").alias("exc"))
    return s.select("segment", F.when(F.col("exc") - F.col("inc") > 0.3, "out").when(F.col("inc") - F.col("exc") > 0.05, "in").otherwise("review").alias("scope"))


@Q.add("I21_discover_groups", r"""WITH RECURSIVE w AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM benchmark), f AS (SELECT w FROM w GROUP BY 1 HAVING count(*) BETWEEN 2 AND 0.05 * (SELECT count(*) FROM benchmark)),
  e AS (SELECT DISTINCT x.item_id AS a, y.item_id AS b FROM w x JOIN w y USING (w) JOIN f USING (w)), r AS (SELECT item_id, item_id AS root FROM benchmark UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.item_id) SELECT item_id, min(root) AS "group" FROM r GROUP BY item_id""", views=False)
def i21(v):
    return T.discover_groups(v.table("benchmark"), "item_id", "text", 2, 0.05)


@Q.add("I25_similar_pairs", """WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), r AS (SELECT q.vec_id AS q, d.vec_id AS d, list_dot_product(q.v, d.v) AS c FROM u q JOIN u d ON q.vec_id <> d.vec_id),
  t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(c, 12) DESC, d) AS k FROM r) SELECT DISTINCT least(q, d) AS a, greatest(q, d) AS b FROM t WHERE k <= 3 AND c >= 0.3""", views=False)
def i25(v):
    e = v.table("embeddings")
    return NB.similar_pairs(e, 3, 0.3)


@Q.add("I27_configuration_key", "SELECT id, CASE WHEN regexp_matches(title, '(ring|bolt)') THEN 'part' ELSE 'product' END AS role, array_to_string(list_sort(string_split(title, ' ')), '+') AS configuration FROM listing")
def i27(v):
    return v.parts.select("id", F.when(F.col("title").rlike("(ring|bolt)"), "part").otherwise("product").alias("role"), F.array_join(F.array_sort(F.split("title", " ")), "+").alias("configuration"))


@Q.add("I28_domain_confidence", """SELECT id, round(least((0.3 * 0.8 + coalesce(0.25 * least(sales / 100, 1), 0) + 0.15 * size / 50) / (0.45 + CASE WHEN sales IS NULL THEN 0 ELSE 0.25 END), CASE WHEN sales IS NULL THEN 0.7 ELSE 1.0 END), 6)::DOUBLE AS confidence FROM listing""")
def i28(v):
    from marketloom.functions.expr import mean_of_known

    mean, _ = mean_of_known([(F.lit(0.8), 0.3), (F.least(F.col("sales") / 100, F.lit(1.0)), 0.25), (F.col("size") / 50, 0.15)])
    return v.listing.select("id", r6(F.least(mean, F.when(F.col("sales").isNull(), 0.7).otherwise(1.0))).alias("confidence"))


@Q.add("J5_class_labels", r"""WITH t AS (SELECT segment AS g, unnest(string_split(title, ' ')) AS token FROM listing), c AS (SELECT g, token, count(*) AS tf FROM t GROUP BY ALL), s AS (SELECT g, sum(tf) AS size FROM c GROUP BY 1), a AS (SELECT token, sum(tf) AS total FROM c GROUP BY 1),
  x AS (SELECT g, token, tf / size * ln(1 + (SELECT avg(size) FROM s) / (1 + total)) AS score FROM c JOIN s USING (g) JOIN a USING (token)) SELECT g AS segment, token, round(score, 6) AS score, k::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 12) DESC, token) AS k FROM x) WHERE k <= 3""")
def j5(v):
    return T.class_labels(v.parts, "segment", "title").withColumn("score", r6(F.col("score")))


@Q.add("J7_models_by_signature", "WITH s AS (SELECT id, segment, title || '|' || (size // 10)::VARCHAR AS sig FROM listing) SELECT id, CASE WHEN count(*) OVER (PARTITION BY segment, sig) >= 2 THEN sig ELSE 'other' END AS model FROM s")
def j7(v):
    s = v.parts.withColumn("sig", F.concat_ws("|", "title", F.floor(F.col("size") / 10).cast("string")))
    n = F.count(F.lit(1)).over(W.partitionBy("segment", "sig"))
    return s.select("id", F.when(n >= 2, F.col("sig")).otherwise("other").alias("model"))


@Q.add("J10_dominant_specs", "WITH c AS (SELECT segment, size, count(*) AS n FROM listing GROUP BY ALL) SELECT segment, size AS main_size FROM c QUALIFY row_number() OVER (PARTITION BY segment ORDER BY n DESC, size) = 1")
def j10(v):
    return v.parts.groupBy("segment").agg(F.mode("size", True).alias("main_size"))


@Q.add("J11_explained_variance", """WITH k AS (SELECT segment, CASE WHEN size % 10 <> 0 THEN brand END AS g, ln(sales) AS x FROM listing WHERE sales > 0), o AS (SELECT g, x FROM k WHERE g IS NOT NULL), m AS (SELECT g, count(*) AS n, avg(x) AS m FROM o GROUP BY g)
  SELECT (SELECT count(*) FROM m) AS groups, round((SELECT sum(n * m * m) / sum(n) - power(sum(n * m) / sum(n), 2) FROM m) / (SELECT var_pop(x) FROM o), 6) AS eta2, round((SELECT avg((g IS NOT NULL)::INT) FROM (SELECT CASE WHEN size % 10 <> 0 THEN brand END AS g FROM listing)), 6) AS coverage""")
def j11(v):
    d = v.listing.withColumn("g", F.when(F.col("size") % 10 != 0, F.col("brand")))
    return T.explained_variance(d, "sales", "g").select("groups", r6(F.col("eta2")).alias("eta2"), r6(F.col("coverage")).alias("coverage"))


@Q.add("J12_deepest_node", "SELECT id, CASE WHEN size >= 40 THEN segment || '/' || brand || '/' || title WHEN size >= 20 THEN segment || '/' || brand ELSE segment END AS node FROM listing")
def j12(v):
    path = F.array(F.struct(F.lit(1).alias("depth"), F.col("segment").alias("node")), F.struct(F.when(F.col("size") >= 20, 2).otherwise(0).alias("depth"), F.concat_ws("/", "segment", "brand").alias("node")), F.struct(F.when(F.col("size") >= 40, 3).otherwise(0).alias("depth"), F.concat_ws("/", "segment", "brand", "title").alias("node")))
    return v.parts.select("id", F.array_max(path).getField("node").alias("node"))


def _graph(v):
    n = G.nodes(v.parts, "brand", "brand", "brand").unionByName(G.nodes(v.parts, "segment", "segment", "segment")).unionByName(G.nodes(v.table("nation"), "nation", "n_nationkey", "n_name")).unionByName(G.nodes(v.table("region"), "region", "r_regionkey", "r_name"))
    sold = v.parts.groupBy("brand", "segment").agg((F.count(F.lit(1)) / 100).alias("strength")).where("strength >= 0.15")
    e = G.edges(sold, "IN", ("brand", "brand"), ("segment", "segment"), "strength").unionByName(G.edges(v.table("nation"), "LIES_IN", ("nation", "n_nationkey"), ("region", "n_regionkey")))
    return n, e


_EDGES = """ge AS (SELECT 'brand:' || brand AS src, 'segment:' || segment AS dst, 'IN' AS rel, count(*) / 100 AS strength FROM listing GROUP BY brand, segment HAVING count(*) / 100 >= 0.15 UNION ALL SELECT 'nation:' || n_nationkey::VARCHAR, 'region:' || n_regionkey::VARCHAR, 'LIES_IN', NULL FROM nation),
  gb AS (SELECT src, dst, strength FROM ge UNION ALL SELECT dst, src, strength FROM ge)"""


@Q.add("L1_graph_edges", f"WITH {_EDGES} SELECT src, dst, rel, round(strength, 6) AS strength FROM ge")
def l1(v):
    return _graph(v)[1].withColumn("strength", r6(F.col("strength")))


@Q.add("L2_replace_subgraph", f"WITH {_EDGES} SELECT src, dst, rel FROM ge WHERE rel <> 'IN' UNION ALL SELECT src, dst, 'SELLS_IN' FROM ge WHERE rel = 'IN'")
def l2(v):
    e = _graph(v)[1].select("src", "dst", "rel")
    new = e.where("rel = 'IN'").withColumn("rel", F.lit("SELLS_IN"))
    return e.join(new.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(new)


@Q.add("L3_neighbourhood", None)
def l3(v):
    start = v.spark.createDataFrame([("brand:Brand#2",)], "id string")
    return G.neighbourhood(_graph(v)[1], start, 3)


@Q.add("L4_cheapest_paths", None)
def l4(v):
    return G.cheapest_paths(_graph(v)[1], "brand:Brand#2", 4).withColumn("cost", r6(F.col("cost")))


from marketloom.plans.base import SQL_VIEWS  # noqa: E402

SQL["L3_neighbourhood"] = f"WITH RECURSIVE {SQL_VIEWS}, {_EDGES}, r AS (SELECT 'brand:Brand#2' AS id, 0 AS hops UNION SELECT gb.dst, r.hops + 1 FROM r JOIN gb ON gb.src = r.id WHERE r.hops < 3) SELECT id, min(hops) AS hops FROM r GROUP BY id"
SQL["L4_cheapest_paths"] = f"WITH RECURSIVE {SQL_VIEWS}, {_EDGES}, gd AS (SELECT src, dst, min(coalesce(2 - strength, 1.5)) AS step FROM gb GROUP BY ALL), r AS (SELECT 'brand:Brand#2' AS id, 0.0::DOUBLE AS cost, 0 AS n UNION ALL SELECT gd.dst, min(r.cost + gd.step)::DOUBLE, any_value(r.n) + 1 FROM r JOIN gd ON gd.src = r.id WHERE r.n < 4 GROUP BY gd.dst) SELECT id, round(min(cost), 6) AS cost FROM r GROUP BY id"


@Q.add("L5_node_listing", "SELECT 'nation:' || n_nationkey::VARCHAR AS id, n_name AS label FROM nation ORDER BY label LIMIT 10", views=False)
def l5(v):
    return _graph(v)[0].where("kind = 'nation'").orderBy("label").limit(10).select("id", "label")


@Q.add("L6_cypher_export", "SELECT 'region:' || r_regionkey::VARCHAR AS id, 'MERGE (n:Region {id: ''region:' || r_regionkey::VARCHAR || '''}) SET n.label = ''' || r_name || ''';' AS statement FROM region", views=False)
def l6(v):
    return G.to_cypher(_graph(v)[0].where("kind = 'region'"))


@Q.add("F42_graph_stats", f"WITH {_EDGES} SELECT rel, count(*) AS n FROM ge GROUP BY rel")
def f42(v):
    return _graph(v)[1].groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@Q.add("L8_alert_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE value > 50 GROUP BY ALL", views=False)
def l8(v):
    return v.table("events").where("value > 50").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@Q.add("L10_daily_summary", "SELECT event_type, count(*) AS n, round(max(value), 4) AS best FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1 ORDER BY n DESC, event_type LIMIT 12", views=False)
def l10(v):
    e = v.table("events")
    last = F.broadcast(e.agg(F.max("ts").alias("last")))
    day = e.crossJoin(last).where(F.expr("ts > last - INTERVAL 24 HOURS"))
    return day.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 4).alias("best")).orderBy(F.desc("n"), "event_type").limit(12)


@Q.add("C29_sentiment", None)
def c29(v):
    return v.table("conversations").select("conv_id", "turn", r6(T.sentence_sentiment("text")).alias("sentiment"))
