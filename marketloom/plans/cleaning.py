"""Parsing, cleaning, filters and quality over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import expr as X
from marketloom.operators import entities as E
from marketloom.operators import quality as QA
from marketloom.plans.base import MONTH, Book

Q = Book()
QUERIES, SQL = Q.queries, Q.sql
r6 = lambda c: F.round(c, 6)


@Q.add("C1_clean_text", r"""SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '_x000[0-9A-Fa-f]_', ' ', 'g'), '\s+', ' ', 'g')), '') AS text FROM pages""", views=False)
def c1(v):
    return v.table("pages").select("page_id", X.clean_text("html").alias("text"))


_RAW = """raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '$' || o_totalprice::VARCHAR WHEN 2 THEN ' ' || o_totalprice::VARCHAR || ' ' WHEN 3 THEN '1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') ELSE o_orderkey::VARCHAR END AS price,
  CASE o_orderkey % 4 WHEN 0 THEN '-' WHEN 1 THEN (o_orderkey % 100)::VARCHAR || '%' WHEN 2 THEN '0.' || (o_orderkey % 9 + 1)::VARCHAR ELSE (o_orderkey % 90 + 2)::VARCHAR END AS rate,
  CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'soon' END AS day FROM orders)"""


def _raw(v):
    k = F.col("o_orderkey")
    pick = lambda n, *cases: F.element_at(F.array(*cases), (k % n + 1).cast("int"))
    price = F.col("o_totalprice").cast("string")
    text = lambda c: c.cast("string")
    return v.table("orders").select(
        k.alias("id"), pick(5, F.lit("n/a"), F.concat(F.lit("$"), price), F.concat(F.lit(" "), price, F.lit(" ")), F.concat(F.lit("1,"), F.lpad(text(k % 1000), 3, "0")), text(k)).alias("price"),
        pick(4, F.lit("-"), F.concat(text(k % 100), F.lit("%")), F.concat(F.lit("0."), text(k % 9 + 1)), text(k % 90 + 2)).alias("rate"),
        pick(4, F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("soon")).alias("day"),
    )


@Q.add("C2_parse_number", f"WITH {_RAW} SELECT id, try_cast(trim(regexp_replace(price, '[,$]', '', 'g')) AS DOUBLE) AS price FROM raw", views=True)
def c2(v):
    return _raw(v).select("id", X.parse_number("price").alias("price"))


@Q.add("C3_parse_rate", f"""WITH {_RAW}, n AS (SELECT id, trim(rate) AS t, try_cast(replace(trim(rate), '%', '') AS DOUBLE) AS x FROM raw)
  SELECT id, CASE WHEN t IN ('-', '--') THEN NULL WHEN contains(t, '%') OR x > 1 THEN x / 100 ELSE x END AS rate FROM n""")
def c3(v):
    return _raw(v).select("id", X.parse_rate("rate").alias("rate"))


@Q.add("C4_parse_date", rf"""WITH {_RAW} SELECT id, CASE WHEN regexp_matches(day, '^-?\d+(\.\d+)?$') THEN NULL ELSE coalesce(try_strptime(day, '%Y-%m-%d'), try_strptime(day, '%Y/%m/%d')) END AS day FROM raw""")
def c4(v):
    return _raw(v).select("id", X.parse_date("day").alias("day"))


@Q.add("C5_empty_rows", f"WITH {_RAW} SELECT id, rate FROM raw WHERE nullif(trim(replace(rate, '-', '')), '') IS NOT NULL")
def c5(v):
    return _raw(v).select("id", "rate").where(F.nullif(F.trim(F.replace("rate", F.lit("-"), F.lit(""))), F.lit("")).isNotNull())


@Q.add("C6_derive_revenue", """SELECT id, CASE WHEN size % 3 = 0 THEN round(price * sales, 4) ELSE revenue END AS revenue, coalesce(size % 3 = 0 AND sales IS NOT NULL, FALSE) AS revenue_derived FROM listing""")
def c6(v):
    known = F.when(F.col("size") % 3 != 0, F.col("revenue"))
    derive = (F.col("size") % 3 == 0) & F.col("sales").isNotNull()
    return v.listing.select("id", F.when(derive, F.round(F.col("price") * F.col("sales"), 4)).otherwise(known).alias("revenue"), derive.alias("revenue_derived"))


@Q.add("C8_record_id", "SELECT doc_id, substr(sha1(coalesce(source, '') || '|' || doc_id::VARCHAR || '|' || coalesce(lang, '')), 1, 20) AS record_id FROM documents", views=False)
def c8(v):
    return v.table("documents").select("doc_id", X.record_id("source", "doc_id", "lang").alias("record_id"))


@Q.add("C9_listing_id", "SELECT s_suppkey, sha1('market|' || s_name) AS listing_id FROM supplier", views=False)
def c9(v):
    return v.table("supplier").select("s_suppkey", F.sha1(F.concat(F.lit("market|"), "s_name").cast("binary")).alias("listing_id"))


_REJECT = """rj AS (SELECT event_id, list_filter([CASE WHEN length(event_type) < 5 THEN 'missing_title' END, CASE WHEN value IS NULL THEN 'missing_price' END, CASE WHEN value <= 1 THEN 'invalid_price' END,
  CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, date_trunc('day', ts) ORDER BY event_id) > 1 THEN 'duplicate_record' END], lambda x: x IS NOT NULL) AS reasons FROM events)"""


def _rejections(v):
    return QA.rejections(v.table("events"), "event_type", "value", ["user_id", "event_type", F.date_trunc("day", "ts")], "event_id", 5, 1)


@Q.add("C10_rejection_reasons", f"WITH {_REJECT} SELECT event_id, array_to_string(reasons, ',') AS reasons FROM rj", views=True)
def c10(v):
    return _rejections(v).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@Q.add("C11_rejection_report", f"WITH {_REJECT} SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['accepted'] ELSE reasons END) AS reason FROM rj) GROUP BY reason")
def c11(v):
    reason = F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("accepted"))).otherwise(F.col("reasons"))).alias("reason")
    return _rejections(v).select(reason).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@Q.add("C12_decision_log", """SELECT id, 'price' AS field, p::VARCHAR AS value, 'not_positive' AS rule FROM (SELECT id, size - 5 AS p FROM listing) WHERE p <= 0 UNION ALL SELECT id, 'rating', r::VARCHAR, 'out_of_range' FROM (SELECT id, size // 5 AS r FROM listing) WHERE r > 5""")
def c12(v):
    x = v.listing.select("id", (F.col("size") - 5).alias("p"), F.floor(F.col("size") / 5).alias("r"))
    row = lambda cond, f, c, rule: F.when(cond, F.struct(F.lit(f).alias("field"), F.col(c).cast("string").alias("value"), F.lit(rule).alias("rule")))
    return x.select("id", F.explode(F.array_compact(F.array(row(F.col("p") <= 0, "price", "p", "not_positive"), row(F.col("r") > 5, "rating", "r", "out_of_range")))).alias("e")).select("id", "e.*")


@Q.add("C13_currency", """WITH r(lang, rate) AS (VALUES ('en', 1.0), ('de', 1.1), ('fr', 1.2), ('es', 1.3)) SELECT doc_id, n_chars AS local_amount, round(n_chars * rate::DOUBLE, 4) AS amount FROM documents JOIN r USING (lang)""", views=False)
def c13(v):
    rates = v.spark.createDataFrame([("en", 1.0), ("de", 1.1), ("fr", 1.2), ("es", 1.3)], "currency string, rate double")
    return QA.to_base_currency(v.table("documents"), rates, "lang", "n_chars").select("doc_id", F.col("n_chars").alias("local_amount"), F.round("amount", 4).alias("amount"))


@Q.add("C16_spec_conflict", "SELECT a.id AS a, b.id AS b, abs(a.size - b.size) / greatest(a.size, b.size) > 0.05 AS conflict FROM listing a JOIN listing b ON a.title = b.title AND a.brand = b.brand AND a.id < b.id")
def c16(v):
    return E.row_pairs(v.parts, "id", ["title", "brand"], ["size"]).select("a", "b", X.spec_conflict("size_a", "size_b").alias("conflict"))


@Q.add("C18_clean_title", r"SELECT id, trim(regexp_replace(regexp_replace(replace(lower(brand || ' ' || title || '!'), lower(brand), ' '), '[^a-z0-9 .]', ' ', 'g'), ' +', ' ', 'g')) AS title FROM listing")
def c18(v):
    return v.parts.select("id", X.clean_title(F.concat("brand", F.lit(" "), "title", F.lit("!")), "brand").alias("title"))


@Q.add("C19_brand_key", "SELECT brand, regexp_replace(lower(brand), '[^a-z0-9]', '', 'g') AS key, count(*) AS n FROM listing GROUP BY brand")
def c19(v):
    return v.parts.groupBy("brand").agg(F.count(F.lit(1)).alias("n")).select("brand", X.brand_key("brand").alias("key"), "n")


@Q.add("C21_title_fingerprint", r"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: len(x) > 2))) AS w FROM documents),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(w) DESC, w) AS k FROM w) SELECT doc_id, string_agg(w, ' ' ORDER BY w) AS fingerprint FROM r WHERE k <= 3 GROUP BY doc_id""", views=False)
def c21(v):
    return v.table("documents").select("doc_id", QA.fingerprint("text").alias("fingerprint")).where("fingerprint <> ''")


@Q.add("C22_badge_text", r"""WITH b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN (event_id % 50)::VARCHAR || 'K+ bought in past month' WHEN 1 THEN (event_id % 900 + 50)::VARCHAR || '+ bought in past month' ELSE 'new' END AS t FROM events)
  SELECT event_id, try_cast(regexp_extract(t, '^(\d+)', 1) AS BIGINT) * CASE WHEN regexp_matches(t, '^\d+K') THEN 1000 ELSE 1 END AS bought FROM b""", views=False)
def c22(v):
    k = F.col("event_id")
    t = F.when(k % 3 == 0, F.concat((k % 50).cast("string"), F.lit("K+ bought in past month"))).when(k % 3 == 1, F.concat((k % 900 + 50).cast("string"), F.lit("+ bought in past month"))).otherwise("new")
    return v.table("events").select("event_id", QA.badge_count(t).alias("bought"))


@Q.add("C24_first_attribute", "SELECT event_id, coalesce(try_cast(props->>'$.weight' AS DOUBLE), try_cast(props->>'$.k' AS DOUBLE)) AS weight FROM events", views=False)
def c24(v):
    first = lambda *names: F.coalesce(*[F.get_json_object("props", f"$.{n}").try_cast("double") for n in names])
    return v.table("events").select("event_id", first("weight", "k").alias("weight"))


@Q.add("C25_spec_bucket", "SELECT id, CASE WHEN size < 10 THEN '<10' WHEN size < 25 THEN '10-25' WHEN size < 40 THEN '25-40' ELSE '40+' END AS bucket FROM listing")
def c25(v):
    s = F.col("size")
    return v.parts.select("id", F.when(s < 10, "<10").when(s < 25, "10-25").when(s < 40, "25-40").otherwise("40+").alias("bucket"))


@Q.add("C26_price_band", "SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value < 20 THEN '<$20' WHEN value < 50 THEN '$20-50' WHEN value < 100 THEN '$50-100' WHEN value < 250 THEN '$100-250' ELSE '$250+' END AS band FROM events", views=False)
def c26(v):
    return v.table("events").select("event_id", X.price_band("value").alias("band"))


@Q.add("C28_annualise", "SELECT id, sales * 12 AS annual_sales FROM listing")
def c28(v):
    return v.listing.select("id", (F.col("sales") * 12).alias("annual_sales"))


@Q.add("C30_sentences", r"""SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?;]\s+|\n+'), lambda x: trim(x) <> ''))::BIGINT AS sentences FROM documents""", views=False)
def c30(v):
    return v.table("documents").select("doc_id", F.size(F.filter(F.split("text", r"[.!?;]\s+|\n+"), lambda s: F.trim(s) != "")).cast("long").alias("sentences"))


@Q.add("C32_column_profile", """SELECT round(avg((try_cast(lang AS DOUBLE) IS NOT NULL)::INT), 6) AS numeric_share, round(avg(starts_with(source, 'src')::INT), 6) AS source_share, count(DISTINCT lang) AS langs, min(n_chars) AS least, max(n_chars) AS most, round(quantile_cont(n_chars, 0.5), 6) AS mid FROM documents""", views=False)
def c32(v):
    share = lambda c, n: r6(F.avg(c.cast("double"))).alias(n)
    return v.table("documents").agg(
        share(F.col("lang").try_cast("double").isNotNull(), "numeric_share"), share(F.col("source").startswith("src"), "source_share"), F.count_distinct("lang").alias("langs"),
        F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), r6(F.percentile("n_chars", F.lit(0.5))).alias("mid"),
    )


@Q.add("C35_infer_identity", """WITH x AS (SELECT l_extendedprice / (l_quantity * p_retailprice) AS a, l_tax / (l_quantity * p_retailprice) AS b FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT 'l_extendedprice' AS candidate, round(avg((a > 0.6 AND a < 1.6)::INT), 6) AS fit FROM x UNION ALL SELECT 'l_tax', round(avg((b > 0.6 AND b < 1.6)::INT), 6) FROM x""", views=False)
def c35(v):
    j = v.table("lineitem").join(v.table("part"), F.col("p_partkey") == F.col("l_partkey"))
    return QA.identity_fit(j, "l_quantity", "p_retailprice", ["l_extendedprice", "l_tax"]).withColumn("fit", r6(F.col("fit")))


@Q.add("C36_foreign_share", r"SELECT doc_id, round(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / greatest(length(text), 1), 6) AS foreign_share FROM documents", views=False)
def c36(v):
    return v.table("documents").select("doc_id", r6(F.length(F.regexp_replace("text", r"[\x00-\x7F]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("foreign_share"))


@Q.add("C38_country_lookup", "SELECT c_custkey, n_name AS country, r_name AS region FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", views=False)
def c38(v):
    n = v.table("nation").join(v.table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return v.table("customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))


@Q.add("C40_certification_score", r"""WITH m AS (SELECT doc_id, list_sort(list_filter([CASE WHEN contains(lower(text), 'the') THEN 1.0 END, CASE WHEN contains(lower(text), 'ing') THEN 0.8 END, CASE WHEN contains(lower(text), 'que') THEN 0.6 END], lambda x: x IS NOT NULL), 'DESC') AS w FROM documents)
  SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.1 ELSE least(1, list_sum(w[1:2]) / 1.8) END::DOUBLE, 6) AS score FROM m""", views=False)
def c40(v):
    return v.table("documents").select("doc_id", r6(QA.certification_score("text", {"the": 1.0, "ing": 0.8, "que": 0.6})).alias("score"))


@Q.add("C41_unpivot", "SELECT id, 'price' AS metric, price AS value, 'observed' AS kind FROM listing UNION ALL SELECT id, 'sales', sales, 'observed' FROM listing WHERE sales IS NOT NULL UNION ALL SELECT id, 'revenue', revenue, 'derived' FROM listing WHERE revenue IS NOT NULL")
def c41(v):
    u = v.listing.unpivot("id", ["price", "sales", "revenue"], "metric", "value").where("value IS NOT NULL")
    return u.withColumn("kind", F.when(F.col("metric") == "revenue", "derived").otherwise("observed"))


@Q.add("C42_evidence_rows", "SELECT event_id, 'k' AS field, (props->>'$.k')::VARCHAR AS value FROM events WHERE (props->>'$.k') IS NOT NULL", views=False)
def c42(v):
    return v.table("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))


@Q.add("C43_plausibility", "SELECT 'price' AS field, round(avg((price > 0)::INT), 6) AS plausible FROM listing UNION ALL SELECT 'rating', round(avg((size <= 5)::INT), 6) FROM listing UNION ALL SELECT 'sales', round(avg((sales >= 0)::INT), 6) FROM listing")
def c43(v):
    a = v.listing.agg(*[r6(F.avg(c.cast("double"))).alias(n) for n, c in (("price", F.col("price") > 0), ("rating", F.col("size") <= 5), ("sales", F.col("sales") >= 0))])
    return a.unpivot([], ["price", "rating", "sales"], "field", "plausible")


_SCORE = """qs AS (SELECT id, greatest(0, 100 - CASE WHEN coalesce(title, '') = '' THEN 25 ELSE 0 END - CASE WHEN price IS NULL THEN 15 ELSE 0 END - CASE WHEN sales IS NULL THEN 15 ELSE 0 END - CASE WHEN coalesce(brand, '') = '' THEN 5 ELSE 0 END
  - CASE WHEN revenue IS NULL THEN 5 ELSE 0 END - CASE WHEN abs(price * sales - revenue) / revenue > 0.35 THEN 10 ELSE 0 END) AS confidence, coalesce(abs(price * sales - revenue) / revenue > 0.35, FALSE) AS inconsistent FROM listing)"""


@Q.add("I1_quality_score", f"WITH {_SCORE} SELECT id, confidence, inconsistent FROM qs")
def i1(v):
    return QA.quality_score(v.listing).select("id", "confidence", F.array_contains("issues", "revenue_mismatch").alias("inconsistent"))


@Q.add("I2_duplicates", """SELECT id, row_number() OVER (PARTITION BY title, brand, price ORDER BY id) > 1 AS content_duplicate, count(*) OVER (PARTITION BY title, brand) > 1 AS shared_title FROM listing""")
def i2(v):
    w = W.partitionBy("title", "brand")
    return v.parts.select("id", (F.row_number().over(W.partitionBy("title", "brand", "price").orderBy("id")) > 1).alias("content_duplicate"), (F.count(F.lit(1)).over(w) > 1).alias("shared_title"))


@Q.add("I4_revenue_consistency", "SELECT id, round(abs(price * sales - revenue) / revenue, 6) AS gap FROM listing WHERE abs(price * sales - revenue) / revenue > 0.35")
def i4(v):
    gap = F.abs(F.col("price") * F.col("sales") - F.col("revenue")) / F.col("revenue")
    return v.listing.where(gap > 0.35).select("id", r6(gap).alias("gap"))


@Q.add("D1_usable_for_market", f"WITH {_SCORE} SELECT id FROM qs WHERE confidence >= 75 AND NOT inconsistent")
def d1(v):
    return QA.quality_score(v.listing).where((F.col("confidence") >= 75) & ~F.arrays_overlap("issues", F.array(F.lit("revenue_mismatch"), F.lit("invalid_price")))).select("id")


@Q.add("D2_relevance_status", """SELECT d.doc_id, coalesce(CASE WHEN l.quality = 0 THEN 'not_relevant' END, CASE WHEN n_chars >= 3000 THEN 'relevant' WHEN n_chars >= 1000 THEN 'uncertain' ELSE 'not_relevant' END) AS status FROM documents d LEFT JOIN labels l USING (doc_id)""", views=False)
def d2(v):
    j = v.table("documents").select("doc_id", "n_chars").join(v.table("labels"), "doc_id", "left")
    auto = F.when(F.col("n_chars") >= 3000, "relevant").when(F.col("n_chars") >= 1000, "uncertain").otherwise("not_relevant")
    return j.select("doc_id", F.coalesce(F.when(F.col("quality") == 0, F.lit("not_relevant")), auto).alias("status"))


@Q.add("D3_search", "SELECT id, title, brand FROM listing WHERE (contains(lower(title), 'red') OR contains(lower(brand), 'red')) AND segment = 'ECONOMY' ORDER BY revenue DESC NULLS LAST, id LIMIT 25")
def d3(v):
    hit = F.lower("title").contains("red") | F.lower("brand").contains("red")
    return v.listing.where(hit & (F.col("segment") == "ECONOMY")).orderBy(F.desc_nulls_last("revenue"), "id").limit(25).select("id", "title", "brand")


@Q.add("D5_rule_classifier", r"SELECT page_id, CASE WHEN regexp_matches(url, '^https') THEN 'secure' WHEN regexp_matches(url, '\?') THEN 'query' WHEN regexp_matches(url, '/en/') AND NOT regexp_matches(url, '#') THEN 'english' END AS rule FROM pages", views=False)
def d5(v):
    u = F.col("url")
    return v.table("pages").select("page_id", QA.first_rule([("secure", u.rlike("^https"), None), ("query", u.rlike(r"\?"), None), ("english", u.rlike("/en/"), u.rlike("#"))]).alias("rule"))


@Q.add("D9_hard_filters", """WITH f AS (SELECT id, price <= 1000 AS a, size >= 10 AS b, sales >= 0.35 * max(sales) OVER () AS c FROM listing WHERE sales IS NOT NULL)
  SELECT count(*) AS rows, count(*) FILTER (WHERE NOT a) AS over_budget, count(*) FILTER (WHERE a AND NOT b) AS below_size, count(*) FILTER (WHERE a AND b AND NOT c) AS below_floor, count(*) FILTER (WHERE a AND b AND c) AS left_over FROM f""")
def d9(v):
    k = v.listing.where("sales IS NOT NULL")
    k = k.crossJoin(F.broadcast(k.agg(F.max("sales").alias("best"))))
    a, b, c = F.col("price") <= 1000, F.col("size") >= 10, F.col("sales") >= 0.35 * F.col("best")
    n = lambda x: F.count(F.when(x, 1))
    return k.agg(F.count(F.lit(1)).alias("rows"), n(~a).alias("over_budget"), n(a & ~b).alias("below_size"), n(a & b & ~c).alias("below_floor"), n(a & b & c).alias("left_over"))


@Q.add("D11_review_band", "SELECT id, round(price / 1000, 6) AS score FROM listing WHERE price / 1000 BETWEEN 0.95 AND 1.05")
def d11(v):
    s = F.col("price") / 1000
    return v.parts.where(s.between(0.95, 1.05)).select("id", r6(s).alias("score"))


@Q.add("D12_whole_words", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\b(idiot|stupid)\b')", views=False)
def d12(v):
    return v.table("documents").where(F.lower("text").rlike(r"\b(idiot|stupid)\b")).select("doc_id")


@Q.add("D13_global_search", """WITH s AS (SELECT doc_id, (contains(text, 'the')::INT + contains(text, 'que')::INT + contains(text, 'der')::INT) / 3 AS share FROM documents) SELECT doc_id, round(share, 6) AS share FROM s WHERE share > 0 AND (share = 1 OR (SELECT max(share) FROM s) < 1)""", views=False)
def d13(v):
    terms = F.array(F.lit("the"), F.lit("que"), F.lit("der"))
    s = v.table("documents").select("doc_id", (F.size(F.filter(terms, lambda t: F.contains(F.col("text"), t))) / F.lit(3)).alias("share"))
    best = F.broadcast(s.agg(F.max("share").alias("best")))
    return s.crossJoin(best).where((F.col("share") > 0) & ((F.col("share") == 1) | (F.col("best") < 1))).select("doc_id", r6(F.col("share")).alias("share"))


@Q.add("D16_freshness", f"SELECT id, max(period) AS last, date_diff('day', max(period)::DATE, DATE '{MONTH}') > 35 AS stale FROM snapshot GROUP BY id")
def d16(v):
    g = v.snapshot.groupBy("id").agg(F.max("period").alias("last"))
    return g.withColumn("stale", F.datediff(F.lit(MONTH).cast("date"), F.col("last").cast("date")) > 35)


@Q.add("D17_excluded_reason", "SELECT id, CASE WHEN size < 3 THEN 'rejected' WHEN segment = 'PROMO' THEN 'not_relevant' WHEN sales IS NULL THEN 'low_quality' END AS reason FROM listing")
def d17(v):
    return v.listing.select("id", F.coalesce(F.when(F.col("size") < 3, F.lit("rejected")), F.when(F.col("segment") == "PROMO", F.lit("not_relevant")), F.when(F.col("sales").isNull(), F.lit("low_quality"))).alias("reason"))


@Q.add("D19_row_scope", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')", views=False)
def d19(v):
    grants = v.table("customer").where(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    return v.table("orders").join(grants, "o_custkey", "left_semi").select("o_orderkey")


@Q.add("D20_product_type", r"""WITH s(kind, sig) AS (VALUES ('color', 'red'), ('color', 'blue'), ('size', 'small'), ('size', 'large')), h AS (SELECT id, kind, count(DISTINCT sig) AS n FROM listing JOIN s ON list_contains(string_split(title, ' '), sig) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, kind) AS k, count(*) OVER (PARTITION BY id) AS kinds FROM h) SELECT id, kind, CASE WHEN kinds = 1 THEN 0.95 ELSE 0.5 END::DOUBLE AS confidence FROM r WHERE k = 1""")
def d20(v):
    s = v.spark.createDataFrame([("color", "red"), ("color", "blue"), ("size", "small"), ("size", "large")], "kind string, sig string")
    return QA.product_type(v.parts, s)


@Q.add("D21_confidence_tiers", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'needs_review' WHEN n_chars < 2000 THEN 'sample_for_qa' ELSE 'auto' END AS tier FROM documents", views=False)
def d21(v):
    n = F.col("n_chars")
    return v.table("documents").select("doc_id", F.when(n < 500, "needs_review").when(n < 2000, "sample_for_qa").otherwise("auto").alias("tier"))


@Q.add("F34_issue_counts", f"WITH {_SCORE} SELECT confidence, count(*) AS n, count(*) FILTER (WHERE inconsistent) AS inconsistent FROM qs GROUP BY confidence")
def f34(v):
    q = QA.quality_score(v.listing)
    return q.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.array_contains("issues", "revenue_mismatch"), 1)).alias("inconsistent"))


@Q.add("F35_validation_report", """WITH c AS (SELECT avg((title IS NULL)::INT) AS missing_title, avg((sales IS NULL)::INT) AS missing_sales, avg((price <= 0)::INT) AS bad_price FROM listing)
  SELECT unnest(['missing_title', 'missing_sales', 'bad_price']) AS dimension, unnest([round(missing_title, 6), round(missing_sales, 6), round(bad_price, 6)]) AS affected, round(100 - 100 * (missing_title + missing_sales + bad_price) / 3, 6) AS score FROM c""")
def f35(v):
    share = lambda c, n: F.avg(c.cast("double")).alias(n)
    one = v.listing.agg(share(F.col("title").isNull(), "missing_title"), share(F.col("sales").isNull(), "missing_sales"), share(F.col("price") <= 0, "bad_price"))
    names = ["missing_title", "missing_sales", "bad_price"]
    one = one.withColumn("score", r6(100 - 100 * sum(F.col(n) for n in names) / 3))
    return one.unpivot("score", names, "dimension", "affected").select("dimension", r6(F.col("affected")).alias("affected"), "score")
