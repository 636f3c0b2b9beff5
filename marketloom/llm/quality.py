"""Quality rules: base measures of a text and the frequency of its lines across documents of a host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Documents on a host that may hold a line.
LINE_LIMIT = 20
#: A document is depleted if its lines within the limit hold less than this share of its words.
MIN_KEPT = 0.3


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_repeats(df: DataFrame, words: str = "_words") -> DataFrame:
    """Adds n_repeat_words: words in 3-word windows that the array of words holds twice or more.

    Windows are sorted as longs of hash bits and as many position bits as the array's size needs (at most 31), which finds all
    candidates at any size; these few are sorted again by the whole hash, so that only true repeats count.
    """
    windows = f"transform(slice({words}, 1, greatest(size({words}) - 2, 0)), (w, i) -> xxhash64(w, get({words}, i + 1), get({words}, i + 2)))"
    df = df.withColumn("_windows", F.expr(windows)).withColumn("_bits", F.expr("length(bin(size(_windows)))"))
    df = df.withColumn("_packed", F.expr("sort_array(transform(_windows, (h, i) -> shiftleft(h, _bits) | i))"))
    same = lambda step: f"shiftright(p, _bits) = shiftright(get(_packed, i {step} 1), _bits)"
    near = f"transform(filter(_packed, (p, i) -> {same('-')} OR {same('+')}), p -> CAST(p & (shiftleft(1L, _bits) - 1L) AS int))"
    df = df.withColumn("_pairs", F.expr(f"array_sort(transform({near}, p -> struct(get(_windows, p) AS h, p AS p)))"))
    true = "array_sort(transform(filter(_pairs, (x, i) -> x.h = get(_pairs, i - 1).h OR x.h = get(_pairs, i + 1).h), x -> x.p))"
    df = df.withColumn("_starts", F.expr(true))
    count = "aggregate(transform(_starts, (p, i) -> least(3, coalesce(get(_starts, i + 1) - p, 3))), 0L, (a, x) -> a + x)"
    return df.withColumn("n_repeat_words", F.expr(count)).drop("_windows", "_bits", "_packed", "_pairs", "_starts")


def base_measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _lines: (hash, words) of each line."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("_text", text).withColumn("_words", words_of(F.col("_text")))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.regexp_replace("_text", SPACE, "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count("_text", F.lit(SYMBOLS)).cast("long"))
    df = df.withColumn("_full", F.expr(r"filter(split(_text, '\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"))
    df = df.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
    df = with_repeats(df)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    line = lambda x: F.struct(F.xxhash64(F.btrim(F.regexp_replace(F.lower(x), SPACE, " "))).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    return df.withColumn("base_failed", failed).withColumn("_lines", F.transform("_full", line)).drop("_words", "_full")


def quality_verdicts(docs: DataFrame, limit: int = LINE_LIMIT, min_kept: float = MIN_KEPT) -> DataFrame:
    """doc_id, the base measures, n_removed_words, base_failed, kept; one row per row of ``docs``.

    Lines are compared in lower case with white space runs as one space. A line that more than ``limit`` documents hold on one
    host (``source``; null is a host) is removed from all but the first of them (smallest doc_id, then by a hash of the text), so
    what a copied document says is never lost with all its copies. A document is kept if it passes the base rules and keeps
    ``min_kept`` of its words. Null text has no words and fails the base; rows equal in id, text and host are one document and
    share their verdict; null ids come last; rows of one id with different texts are different documents. A text is measured
    whole, of any length that a Spark array of its words can hold. Other columns of ``docs`` are ignored, whatever their names.
    An empty table gives an empty one.
    """
    base = base_measures(docs.select("doc_id", "text", "source")).select(
        "doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"), F.xxhash64("_text").alias("_key"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"), F.col("source").isNull().alias("_no_host"),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_lines",
    )
    base = materialize(base, "quality")
    host, of = ["_host", "_no_host"], ["_id", "_key", "_host", "_no_host"]
    once = base.select(*of, "_lines").dropDuplicates(of)
    own = once.select(*of, F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("h"))
    common = materialize(own.groupBy(*host, "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > limit).drop("docs"), "common")
    lines = once.select(*of, F.explode("_lines").alias("l")).select(*of, F.col("l.h").alias("h"), F.col("l.n").cast("long").alias("n"))
    held = materialize(lines.join(common, [*host, "h"]).groupBy(*of, "h").agg(F.sum("n").alias("n")), "held")
    first = materialize(held.groupBy(*host, "h").agg(F.min(F.struct("_id", "_key")).alias("first")), "first")
    lost = held.join(first, [*host, "h"]).where(F.struct("_id", "_key") != F.col("first")).groupBy(*of).agg(F.sum("n").alias("n_removed_words"))
    out = base.join(lost, of, "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_removed_words") >= min_kept * F.col("n_words"))
    return out.withColumn("kept", kept).select("doc_id", *of, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def keep_good(docs: DataFrame, limit: int = LINE_LIMIT, min_kept: float = MIN_KEPT) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps."""
    good = quality_verdicts(docs, limit, min_kept).where("kept").select("_id", "_key", "_host", "_no_host").distinct()
    same = (F.coalesce(docs["doc_id"], F.lit((1 << 63) - 1)) == good["_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == good["_key"])
    same = same & (F.coalesce(docs["source"].cast("string"), F.lit("")) == good["_host"]) & (docs["source"].isNull() == good["_no_host"])
    return docs.join(good, same, "left_semi")


def op6_line_frequency_rules(spark, sf_dir: str) -> DataFrame:
    return quality_verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("_id", "_key", "_host", "_no_host")


def op6_sql() -> str:
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host, source IS NULL AS no_host FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
    g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: [ws[i], ws[i + 1], ws[i + 2]])) AS win FROM w WHERE len(ws) >= 3),
    r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
    n AS (SELECT doc_id, sum(least(3, coalesce(nx - p, 3)))::BIGINT AS n_repeat_words FROM (SELECT *, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS nx FROM r) GROUP BY doc_id),
    b AS (SELECT w.doc_id, host, no_host, ls, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
            len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN n USING (doc_id)),
    l AS (SELECT doc_id, host, no_host, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS h, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
            FROM (SELECT doc_id, host, no_host, unnest(ls) AS x FROM b)),
    c AS (SELECT host, no_host, h, min(doc_id) AS first FROM l GROUP BY ALL HAVING count(DISTINCT doc_id) > {LINE_LIMIT}),
    x AS (SELECT doc_id, sum(n)::BIGINT AS n_removed_words FROM l JOIN c USING (host, no_host, h) WHERE doc_id <> first GROUP BY doc_id),
    f AS (SELECT b.*, coalesce(n_removed_words, 0)::BIGINT AS n_removed_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b LEFT JOIN x USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= {MIN_KEPT} * n_words AS kept, n_removed_words FROM f
    """


QUERIES = {"op6_line_frequency_rules": op6_line_frequency_rules}
SQL = {"op6_line_frequency_rules": op6_sql()}
