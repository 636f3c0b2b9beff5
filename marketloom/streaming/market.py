"""Structured Streaming over event files: windows, sessions, deduplication, last values, alerts.

Every stream reads files, keeps a watermark and runs to the end of what is there (``availableNow``), so that a run can be held
against a batch query. Times without a zone are cast, as watermarks need a time zone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marketloom.session import temp_path

#: Groups that the keys of a stream with state in Python are dealt over.
BUCKETS = 512


def event_stream(spark: SparkSession, sf_dir: str, delay: str = "10 minutes", files: int = 1) -> DataFrame:
    """The events table as a stream with a watermark on ``ts``, a number of files per batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def run_to_end(stream: DataFrame, tag: str, mode: str = "append", key: tuple = ()) -> DataFrame:
    """Runs a stream over all there is and reads back what it wrote: all rows, of a complete result the newest, of updates the
    newest of each key."""
    spark, out = stream.sparkSession, temp_path(stream.sparkSession, tag)
    schema = stream.schema
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    else:

        def keep(df: DataFrame, batch: int) -> None:  # a batch that runs again writes the same folder
            df.write.mode("overwrite").parquet(f"{out}/data/batch={batch:08d}")

        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(schema).parquet(f"{out}/data")
    found = spark.read.parquet(f"{out}/data")
    newest = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("batch"))) if key else None
    if newest is not None:
        return found.withColumn("_k", newest).where("_k = 1").drop("_k", "batch")
    last = found.agg(F.max("batch")).first()[0]
    return found.where(F.col("batch") == last).drop("batch")


def tumbling_counts(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    g = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def first_alerts(stream: DataFrame, above: float) -> DataFrame:
    """One alert per event id, however often it arrives."""
    return stream.where(F.col("value") > above).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type", "value")


def value_changes(stream: DataFrame) -> DataFrame:
    """For each user and type: events seen and the last two values by time and id, kept as state from batch to batch.

    Keys share ``BUCKETS`` groups by their hash, and a group's keys are sorted and counted together: a group for each key would cost a
    call of Python for each. A group holds two rows of state for a key; the newest carries the number of events."""
    kinds = {"u": "i8", "unknown": "?", "e": str, "t": "i8", "i": "i8", "v": "f8", "c": "i8"}

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [np.array([np.nan if x is None else x for x in c] if k == "v" else c, kind) for (k, kind), c in zip(kinds.items(), state.get, strict=True)] if state.exists else [np.zeros(0, kind) for kind in kinds.values()]
        fresh = np.zeros(len(held[0]), bool)
        for b in batches:
            new = [*(b[k].to_numpy().astype(kind) for k, kind in list(kinds.items())[:-1]), np.ones(len(b), "i8")]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            order = np.lexsort((held[4], held[3], held[2], held[1], held[0]))
            u, unknown, e, t, i, v, c = held = [x[order] for x in held]
            fresh = np.concatenate([fresh, np.ones(len(b), bool)])[order]
            first = np.r_[True, (u[1:] != u[:-1]) | (unknown[1:] != unknown[:-1]) | (e[1:] != e[:-1])][: len(u)]
            starts = np.flatnonzero(first)
            last = np.r_[starts[1:], len(u)][: len(starts)] - 1
            n, touched = (np.add.reduceat(c, starts), np.logical_or.reduceat(fresh, starts)) if len(starts) else (c, fresh)
            second = last[last > starts] - 1
            c[:], fresh[:] = 0, False
            c[last], fresh[last] = n, touched
            keep = np.sort(np.r_[last, second])
            held, fresh = [x[keep] for x in held], fresh[keep]
        state.update(tuple(x.tolist() for x in held))
        u, unknown, e, _, _, v, c = held
        before = np.where(np.r_[False, c[:-1] == 0][: len(c)], np.r_[np.nan, v[:-1]][: len(v)], np.nan)
        yield pd.DataFrame({"u": u, "unknown": unknown, "e": e.astype(object), "c": c, "before": before, "now": v})[fresh & (c > 0)]

    oldest = F.lit(-(1 << 62))
    keyed = stream.select(
        F.coalesce("user_id", F.lit(0)).cast("long").alias("u"), F.col("user_id").isNull().alias("unknown"), F.coalesce(F.concat(F.lit("="), "event_type"), F.lit("")).alias("e"),
        F.coalesce(F.unix_micros("ts"), oldest).alias("t"), F.coalesce(F.col("event_id").cast("long"), oldest).alias("i"), F.col("value").cast("double").alias("v"),
    )
    held = "u array<long>, unknown array<boolean>, e array<string>, t array<long>, i array<long>, v array<double>, c array<long>"
    groups = keyed.withColumn("bucket", F.pmod(F.xxhash64("u", "e"), F.lit(BUCKETS))).groupBy("bucket")
    found = groups.applyInPandasWithState(step, "u long, unknown boolean, e string, c long, before double, now double", held, "update", GroupStateTimeout.NoTimeout)
    return found.select(F.when(~F.col("unknown"), F.col("u")).alias("user_id"), F.when(F.col("e") != "", F.expr("substring(e, 2)")).alias("event_type"), F.col("c").alias("n"), "before", "now")
