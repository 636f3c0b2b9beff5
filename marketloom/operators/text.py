"""Relevance, labels, discovery and sentiment of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.scale import connected_components
from marketloom.operators.entities import token_rows

#: Sentiment of words, and words that turn it.
LEXICON = {"good": 1.0, "great": 1.5, "love": 1.5, "perfect": 1.5, "bad": -1.0, "poor": -1.0, "broken": -1.5, "terrible": -2.0, "hate": -1.5}
NEGATIONS = ("not", "no", "never", "without")


def sentence_sentiment(text: Column | str, lexicon: dict[str, float] = LEXICON, negations: tuple = NEGATIONS) -> Column:
    """tanh of a third of the summed word weights; a negation among the three words before turns a weight to -0.8 of it."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(text), r"[^a-z']+"), lambda w: w != "")
    weights = F.create_map(*[x for k, v in lexicon.items() for x in (F.lit(k), F.lit(v))])
    no = F.array(*[F.lit(n) for n in negations])
    before = lambda i: F.slice(words, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
    score = lambda w, i: F.coalesce(F.try_element_at(weights, w), F.lit(0.0)) * F.when((i > 0) & F.arrays_overlap(before(i), no), -0.8).otherwise(1.0)
    return F.tanh(F.aggregate(F.transform(words, score), F.lit(0.0), lambda a, x: a + x) / 3)


def relevance_score(similar: Column, unlike: Column, wanted: Column, unwanted: Column, category: Column) -> Column:
    """Logistic relevance in per cent. Keyword hits count two at most; ``category`` is true, false or unknown."""
    hits = lambda c: F.least(c, F.lit(2))
    z = -0.6 + 5 * (similar - unlike) + 3.2 * hits(wanted) - 3.2 * hits(unwanted) + F.when(category, 1.2).when(~category, -3.0).otherwise(0.0)
    return 100 / (1 + F.exp(-z))


def discover_groups(df: DataFrame, key: str, text: str, least: int = 2, share: float = 0.9) -> DataFrame:
    """(key, group): texts connected by words that stand in at least ``least`` and at most ``share`` of them.

    Each word links its texts to the first of them, so a word of n texts gives n links and not n squared."""
    words = df.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("w"))
    n = F.broadcast(df.agg(F.count(F.lit(1)).alias("n")))
    head = words.groupBy("w").agg(F.count(F.lit(1)).alias("df"), F.min(key).alias("head")).crossJoin(n).where((F.col("df") >= least) & (F.col("df") <= share * F.col("n")))
    links = words.join(head, "w").select(F.col(key).alias("a"), F.col("head").alias("b"))
    roots = connected_components(links).toDF(key, "root")
    return df.select(key).join(roots, key, "left").select(key, F.coalesce("root", key).alias("group"))


def class_labels(df: DataFrame, group: str, text: str, k: int = 3) -> DataFrame:
    """Class-based TF-IDF: a group's words by share of its words times ln(1 + average words per group / (1 + total count))."""
    t = token_rows(df.withColumn("_g", F.col(group)), "_g", text)
    size = t.groupBy("_g").agg(F.sum("tf").alias("size"))
    total = t.groupBy("token").agg(F.sum("tf").alias("all"))
    avg = F.broadcast(size.agg(F.avg("size").alias("mean")))
    s = t.join(size, "_g").join(total, "token").crossJoin(avg)
    s = s.withColumn("score", F.col("tf") / F.col("size") * F.log(1 + F.col("mean") / (1 + F.col("all"))))
    w = W.partitionBy("_g").orderBy(F.desc(F.round("score", 12)), "token")
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(F.col("_g").alias(group), "token", "score", "place")


def explained_variance(df: DataFrame, value: str, attribute: str) -> DataFrame:
    """Share of the variance of ln(value) that an attribute's groups explain, with its coverage."""
    x = F.log(value)
    known = df.where(F.col(attribute).isNotNull() & (F.col(value) > 0)).select(F.col(attribute).alias("g"), x.alias("x"))
    g = known.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    n, m = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) / n - m * m
    within = F.sum(F.col("n") * F.col("v")) / n
    return g.agg(F.count(F.lit(1)).alias("groups"), F.try_divide(between, between + within).alias("eta2")).crossJoin(F.broadcast(df.agg(F.avg(F.col(attribute).isNotNull().cast("double")).alias("coverage"))))


#: How sure a kind of attribute is, and a value by the place of the text that states it; what a conflict leaves of it.
KIND_SURE, PLACE_SURE, CONFLICT = {"number": 0.9, "enum": 0.85, "list": 0.85, "token": 0.8}, (1.0, 0.9, 0.8), 0.6


def attributes(df: DataFrame, key: str, fields: list[str], schema: dict[str, dict]) -> DataFrame:
    """(key, attribute, values, number, confidence, field, conflict): what the texts of a row state of each attribute of ``schema``.

    The first of ``fields`` that states an attribute gives it. Kinds: ``number`` (unit: see ``files.UNITS``; plausible: lowest and
    highest; the largest amount), ``enum`` and ``list`` (patterns: value -> pattern; values in the order of their first mention; an enum
    with several is a conflict and gives the first of them first), ``token`` (pattern; context: a pattern of bounded length that ends at
    most ``window`` characters before the token or starts at most so many after it; upper case, sorted). All in built-in expressions."""
    from marketloom.operators.files import best_unit

    def stated(text: Column, spec: dict) -> tuple[Column, Column]:
        if spec["kind"] == "number":
            amount = best_unit(text, spec["unit"], spec.get("plausible"))
            return F.when(amount.isNotNull(), F.array(amount.cast("string"))), amount
        if spec["kind"] == "token":
            pattern = f"(?:{spec['pattern']})"
            if context := spec.get("context"):
                gap = rf"[\s\S]{{0,{spec.get('window', 40)}}}"
                pattern = f"(?:(?<=(?:{context}){gap}){pattern}|{pattern}(?={gap}(?:{context})))"
            return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), F.upper))), F.lit(None)
        at = F.array(*[F.struct(F.regexp_instr(text, F.lit(pattern)).alias("at"), F.lit(value).alias("value")) for value, pattern in spec["patterns"].items()])
        return F.transform(F.array_sort(F.filter(at, lambda x: x["at"] > 0)), lambda x: x["value"]), F.lit(None)

    out = []
    for name, spec in schema.items():
        found = F.lit(None)
        for place, field in reversed(list(enumerate(fields))):
            values, number = stated(F.col(field), spec)
            several = F.size(values) > 1 if spec["kind"] == "enum" else F.lit(False)
            sure = KIND_SURE[spec["kind"]] * PLACE_SURE[min(place, len(PLACE_SURE) - 1)]
            row = F.struct(F.lit(name).alias("attribute"), values.alias("values"), number.cast("double").alias("number"), F.round(F.when(several, sure * CONFLICT).otherwise(sure), 3).alias("confidence"), F.lit(field).alias("field"), several.alias("conflict"))
            found = F.when(F.size(values) > 0, row).otherwise(found)
        out.append(found)
    return df.select(key, F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("_a")).select(key, "_a.*")
