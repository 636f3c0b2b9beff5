"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.scale import id_salt, rank_in_key, salts_for
from marketloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
SEED = 7


def n_words(text: Column) -> Column:
    """Runs of other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_bin(size: Column) -> Column:
    """Length in bits of the size, and its four leading bits: documents of like size stand together, which evens out what a
    source takes."""
    bits = F.length(F.bin(size))
    return (16 * bits + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0)))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """One row per source: no_source, source_key, source_size, target.

    Sources in code-point order, null last, take ``weights`` in turn and share all words; a target stops at ``cap`` times the
    source's size, and what is above goes to the others by weight. A source is capped if the level that water filling reaches
    over it and all sources with a higher ceiling per weight is no lower than its own. One row per source is all that these
    windows see.
    """
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = sizes.groupBy("no_source", "source_key").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy("no_source", "source_key")) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    by = by.withColumn("ceiling", F.col("source_size").cast("double") * cap).withColumn("total", F.sum("source_size").over(every).cast("double"))
    order = W.orderBy(F.col("ceiling") / F.col("weight"), "no_source", "source_key")
    by = by.withColumn("below", F.coalesce(F.sum("ceiling").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    by = by.withColumn("from_here", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("capped", (F.col("total") - F.col("below")) / F.col("from_here") >= F.col("ceiling") / F.col("weight"))
    free = lambda c, is_capped: F.sum(F.when(F.col("capped") == is_capped, F.col(c)).otherwise(0.0)).over(every)
    by = by.withColumn("fixed", free("ceiling", True)).withColumn("open", free("weight", False))
    level = F.try_divide(F.col("total") - F.col("fixed"), F.col("open"))
    target = F.when(F.col("capped"), F.col("ceiling")).otherwise(level * F.col("weight"))
    return by.select("no_source", "source_key", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken.

    Systematic sampling: within a source every document expects target / source_size copies; documents stand in order of size
    class and a hash of the id, the running sum of expected copies plus one random offset is taken, and a document is emitted
    once per whole number that the sum crosses at it. So a source's taken words differ from its target by about one document,
    no document is taken more than ``cap`` times, and a run with the same seed agrees.

    Null text has size 0 and is never worth a word; a null source is a source of its own; null ids are allowed. Rows equal in
    id, source and size count once in the order and get the same copies. An empty table gives an empty one.
    """
    offset = random.Random(seed).random()
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]
    sizes = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")).select("doc_id", "source", *key, "size"), "mix")
    targets = source_targets(sizes, weights, cap)
    salts = salts_for(sizes.count())
    items = sizes.select("doc_id", "no_source", "source_key", "size").distinct().withColumns({"size_bin": size_bin(F.col("size")), "salt": id_salt(F.col("doc_id"), salts)})
    ranked = rank_in_key(items, ["no_source", "source_key"], ["size_bin", "salt"], ["size", "doc_id"])
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    at = lambda i: F.floor(i.cast("double") * F.col("rate") + F.lit(offset))
    copies = (at(F.col("rank")) - at(F.col("rank") - 1)).cast("long")
    taken = ranked.join(targets, ["no_source", "source_key"]).withColumn("rate", rate).withColumn("copies", copies)
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("no_source").alias("_no"), F.col("source_key").alias("_key"), F.col("size").alias("_size"), "source_size", "target", "copies")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("no_source") == F.col("_no")) & (F.col("source_key") == F.col("_key")) & (F.col("size") == F.col("_size"))
    return sizes.join(taken, on).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as ``mix_plan`` takes it, with the columns of ``docs``."""
    plan = mix_plan(docs, weights, cap, seed).where("copies > 0").select("doc_id", "source", "size", "copies").distinct()
    keyed = docs.select(F.struct("*").alias("whole"), F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("_source"), n_words(F.col("text").cast("string")).alias("_size"))
    on = F.col("_id").eqNullSafe(F.col("doc_id")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size"))
    each = keyed.join(plan, on).select("whole", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("whole.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op1_sql() -> str:
    u = repr(random.Random(SEED).random())
    return f"""
    WITH d AS (SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_key,
                 coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
    s0 AS (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
    s1 AS (SELECT *, (row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 + 1.0::DOUBLE AS weight, 3 * source_size::DOUBLE AS ceiling,
             (sum(source_size) OVER ())::DOUBLE AS total FROM s0),
    s2 AS (SELECT *, coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             sum(weight) OVER (ORDER BY ceiling / weight, no_source, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS from_here FROM s1),
    s3 AS (SELECT *, (total - below) / from_here >= ceiling / weight AS capped FROM s2),
    s4 AS (SELECT *, sum(CASE WHEN capped THEN ceiling ELSE 0 END) OVER () AS fixed, sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS free FROM s3),
    s5 AS (SELECT no_source, source_key, source_size, CASE WHEN capped THEN ceiling ELSE (total - fixed) / nullif(free, 0) * weight END::DOUBLE AS target FROM s4),
    n AS (SELECT greatest(1, floor(sqrt(count(*))))::BIGINT AS salts FROM d),
    i AS (SELECT *, 16 * length(bin(size)) + (size >> greatest(length(bin(size)) - 4, 0)) AS size_bin, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT salts FROM n) AS salt
            FROM (SELECT DISTINCT * FROM d)),
    r AS (SELECT *, row_number() OVER (PARTITION BY no_source, source_key ORDER BY size_bin, salt, size, doc_id NULLS FIRST) AS rk FROM i),
    c AS (SELECT r.*, source_size, target, coalesce(target / nullif(source_size::DOUBLE, 0), 0) AS rate FROM r JOIN s5 USING (no_source, source_key)),
    t AS (SELECT *, (floor(rk::DOUBLE * rate + {u}::DOUBLE) - floor((rk - 1)::DOUBLE * rate + {u}::DOUBLE))::BIGINT AS copies FROM c)
    SELECT d.doc_id, d.size, t.source_size, t.target, copies * d.size AS taken, copies
    FROM d JOIN t ON d.doc_id IS NOT DISTINCT FROM t.doc_id AND d.no_source = t.no_source AND d.source_key = t.source_key AND d.size = t.size
    """


QUERIES = {"op1_mix_sources": op1_mix_sources}
SQL = {"op1_mix_sources": op1_sql()}
