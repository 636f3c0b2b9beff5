"""From an export to curated tables in one run: clean, score, resolve, measure, compare, publish together."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions import expr as X
from marketloom.operators import entities as E
from marketloom.operators import market as M
from marketloom.operators import quality as QA
from marketloom.operators import ranking as R
from marketloom.operators import scores as S
from marketloom.plans.base import MONTH, PREVIOUS, Book, Views
from marketloom.session import materialize, temp_path
from marketloom.sources import store

Q = Book()
QUERIES, SQL = Q.queries, Q.sql
#: Confidence from which a record counts towards the market.
USABLE = 75


def clean_records(df: DataFrame) -> DataFrame:
    """Cleaned text, a record id, confidence, issues and the reason why a record is left out; no record is dropped."""
    df = df.withColumns({"title": X.clean_text("title"), "brand": X.clean_text("brand"), "record_id": X.record_id("brand", "id")})
    df = QA.quality_score(df)
    reason = F.coalesce(F.when(F.col("title").isNull(), F.lit("rejected")), F.when(F.col("confidence") < USABLE, F.lit("low_quality")))
    return df.withColumn("excluded_reason", reason)


def resolve(df: DataFrame) -> DataFrame:
    """(id, cluster): listings of one product. Exact copies collapse first, so blocks hold distinct listings only."""
    head = df.groupBy("title", "brand", "size").agg(F.min("id").alias("head"))
    heads = df.join(head, F.col("id") == F.col("head"), "left_semi").withColumn("block", F.concat_ws("|", "brand", "title"))
    pairs = E.block_pairs(heads, "id", ["block"])
    side = lambda s: heads.select(F.col("id").alias(s), F.col("brand").alias(f"brand_{s}"), F.col("size").alias(f"size_{s}"), F.col("price").alias(f"price_{s}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    conflict, ratio = X.spec_conflict("size_a", "size_b"), F.least("price_a", "price_b") / F.greatest("price_a", "price_b")
    score = E.pair_score(F.lit(1.0), F.col("brand_a") == F.col("brand_b"), ~conflict, ratio, F.lit(None).cast("boolean"))
    decided = j.withColumn("decision", E.pair_decision(score, F.lit(False), conflict, ratio, F.col("brand_a") != F.col("brand_b")))
    c = E.clusters(heads, "id", decided.where("decision = 'match'")).withColumnRenamed("id", "head")
    return df.join(head, ["title", "brand", "size"]).join(c, "head").select("id", "cluster")


def process(v: Views, root: str) -> store.Batch:
    """Writes the curated tables of a market; they become visible together."""
    batch = store.Batch(v.spark, root)
    records = materialize(clean_records(v.listing), "records")
    used = records.where("excluded_reason IS NULL")
    products = resolve(records)
    history = materialize(v.history, "history")
    at = lambda m: history.where(F.col("period") == F.lit(m).cast("timestamp_ntz"))
    sold = records.join(products, "id").withColumns({"reviews": F.col("size"), "rating": F.when(F.col("size") % 5 != 0, (F.col("size") % 5).cast("double")), "seller": F.col("size") % 7})
    capacity = materialize(M.segment_capacity(used), "capacity")
    score, cover = X.mean_of_known([(X.rank_share("revenue"), 0.5), (1 - F.col("hhi") / 10000, 0.3), (F.col("sales_coverage"), 0.2)])
    batch.write("records", records)
    batch.write("products", M.product_master(sold, ["cluster"]))
    batch.write("segments", capacity)
    batch.write("brands", M.brand_table(used, F.lit(MONTH).cast("date")))
    batch.write("trends", S.trend_slope(history.groupBy("segment", "period").agg(F.sum("sales").alias("y")), ["segment"], "y"))
    batch.write("opportunities", capacity.select("segment", (100 * score).alias("score"), cover.alias("coverage")))
    batch.write("events", R.snapshot_diff(at(PREVIOUS), at(MONTH)))
    batch.write("anomalies", R.robust_z(used.where("sales > 0").withColumn("lp", F.log("sales")), "lp", ["segment"]).where(F.abs("z") > 3.5).select("id", "z"))
    batch.commit()
    return batch


def fingerprint(spark: SparkSession, sf_dir: str, tables: tuple[str, ...], config: dict) -> str:
    """A digest of what a run reads: files with size and time, and its configuration. Equal digests need no second run."""
    files = spark.read.format("binaryFile").load([f"{sf_dir}/{t}.parquet" for t in tables]).select("path", "length", "modificationTime")
    seen = sorted((r["path"], r["length"], str(r["modificationTime"])) for r in files.collect())
    return hashlib.sha256(json.dumps([seen, config], sort_keys=True).encode()).hexdigest()


@Q.add("process_dataset", """WITH a AS (SELECT id, greatest(0, 100 - CASE WHEN sales IS NULL THEN 15 ELSE 0 END - CASE WHEN revenue IS NULL THEN 5 ELSE 0 END - CASE WHEN abs(price * sales - revenue) / revenue > 0.35 THEN 10 ELSE 0 END) AS confidence, segment, brand FROM listing)
  SELECT 'records' AS "table", count(*) AS n FROM a UNION ALL SELECT 'segments', count(DISTINCT segment) FROM a WHERE confidence >= 75 UNION ALL SELECT 'brands', count(DISTINCT brand) FROM a WHERE confidence >= 75""")
def process_dataset(v):
    batch = process(v, temp_path(v.spark, "market"))
    out = None
    for name in ("records", "segments", "brands"):
        row = store.read_batch(v.spark, batch.root, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@Q.add("B11_input_fingerprint", None)
def b11(v):
    one, again, other = (fingerprint(v.spark, v.sf_dir, ("part", "lineitem"), c) for c in ({"k": 1}, {"k": 1}, {"k": 2}))
    return v.spark.createDataFrame([("again", one == again), ("other_config", one == other)], "run string, skipped boolean")


@Q.add("A14_inbox", "SELECT event_id, user_id FROM events", views=False)
def a14(v):
    """An inbox polled twice: files seen before are not taken again."""
    from marketloom.streaming.market import event_stream

    out = temp_path(v.spark, "inbox")
    for _ in range(2):
        stream = event_stream(v.spark, v.sf_dir).select("event_id", "user_id")
        stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{out}/data")


@Q.add("J13_branch_assignment", None)
def j13(v):
    """Each benchmark text's nearest language by the words that documents of the language use."""
    words = E.token_rows(v.table("documents").select("lang", "text"), "lang", "text")
    total = words.groupBy("lang").agg(F.sum("tf").alias("all"))
    weight = words.join(total, "lang").select("lang", "token", (F.col("tf") / F.col("all")).alias("w"))
    t = E.token_rows(v.table("benchmark"), "item_id", "text")
    score = t.join(weight, "token").groupBy("item_id", "lang").agg(F.sum(F.col("tf") * F.col("w")).alias("s"))
    return score.groupBy("item_id").agg(F.max_by("lang", F.struct(F.round("s", 12), "lang")).alias("branch"))
