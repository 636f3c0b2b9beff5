"""Property graph as two DataFrames: build, neighbourhood, bounded paths, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize


def nodes(df: DataFrame, kind: str, key: str, label: str) -> DataFrame:
    """(id, kind, label) with ids that carry their kind."""
    return df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label")).distinct()


def edges(df: DataFrame, rel: str, a: tuple[str, str], b: tuple[str, str], strength: str | None = None) -> DataFrame:
    """(src, dst, rel, strength) between kinds; a missing strength is null."""
    end = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    return df.select(end(*a).alias("src"), end(*b).alias("dst"), F.lit(rel).alias("rel"), (F.col(strength).cast("double") if strength else F.lit(None).cast("double")).alias("strength"))


def both_ways(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "strength").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "strength"))


def neighbourhood(e: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(id, hops): nodes within ``hops`` of the start nodes, both directions, with the least number of steps.

    A frontier join per hop; only nodes that are new go on, and each hop is written, so plans do not grow."""
    links = materialize(both_ways(e).select("src", "dst").distinct(), "links")
    seen = start.select("id", F.lit(0).alias("hops"))
    front = seen
    for hop in range(1, hops + 1):
        step = front.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        front = materialize(step.join(seen, "id", "left_anti").withColumn("hops", F.lit(hop)), "front")
        seen = seen.unionByName(front)
    return seen


def cheapest_paths(e: DataFrame, start: str, most: int) -> DataFrame:
    """(id, cost): least cost from ``start`` over at most ``most`` edges; an edge costs 1 + (1 - strength), 1.5 without one."""
    spark = e.sparkSession
    cost = F.coalesce(2 - F.col("strength"), F.lit(1.5))
    links = materialize(both_ways(e).groupBy("src", "dst").agg(F.min(cost).alias("step")), "links")
    best = spark.createDataFrame([(start, 0.0)], "id string, cost double")
    for _ in range(most):
        step = best.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.col("step")).alias("cost"))
        best = materialize(best.unionByName(step).groupBy("id").agg(F.min("cost").alias("cost")), "best")
    return best


def to_cypher(n: DataFrame) -> DataFrame:
    """One MERGE statement per node, quotes escaped."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.col(c), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return n.select("id", F.concat(F.lit("MERGE (n:"), F.initcap("kind"), F.lit(" {id: "), quoted("id"), F.lit("}) SET n.label = "), quoted("label"), F.lit(";")).alias("statement"))
