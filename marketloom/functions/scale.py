"""Operators whose plain form would send one key, or all rows, to one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Rows in a part of a global order.
PART = 200_000


def salts_for(rows: int) -> int:
    """Cells a key is dealt over: the square root of the rows, so that cells and rows in a cell grow alike."""
    return max(1, math.isqrt(max(0, rows)))


def id_salt(col: Column, salts: int) -> Column:
    """A number from 0 to ``salts`` - 1 from an id's MD5; null ids get that of the empty string."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(salts)).cast("long")


def rank_in_key(rows: DataFrame, keys: list[str], cell: list[str], order: list, name: str = "rank") -> DataFrame:
    """Adds each row's 1-based place in its key, by ``cell`` and then ``order``.

    No task holds a whole key: cells (key and ``cell`` columns) are ranked on their own, and the rows before each cell come
    from a running sum over one count per cell. Keys and cells must not be null; rows equal in ``order`` share no rank.
    """
    w = W.partitionBy(*keys).orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)
    before = rows.groupBy(*keys, *cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    local = rows.withColumn("_at", F.row_number().over(W.partitionBy(*keys, *cell).orderBy(*order)))
    return local.join(before, [*keys, *cell]).withColumn(name, F.col("_before") + F.col("_at")).drop("_before", "_at")


def ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` as a table in parts of about ``PART`` rows, numbered in the order of ``keys`` and ``order`` (``_part``). A key may span parts."""
    parts = max(1, -(-rows.count() // PART))
    return materialize(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def exact_medians(counts: DataFrame, keys: list[str], value: str, n: str, name: str = "median") -> DataFrame:
    """(keys, ``name``): the exact median of a value that stands ``n`` times in each row, null where none is known; without keys one row.

    A group's values are never in one task: parts of a global order are counted, and only the one or two that hold the middle are read."""
    rows = ranged(counts.where(F.col(value).isNotNull()).select(*keys, value, n), keys, [value])
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    per = rows.groupBy(*keys, "_part").agg(F.sum(n).alias("_n"))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).withColumn("_all", F.sum("_n").over(whole))
    low, high = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    per = per.withColumns({"_low": low, "_high": high}).where("_before < _high AND _before + _n >= _low")
    at = lambda: F.struct(*keys, "_part").alias("_at")
    near = rows.withColumn("_at", at()).join(per.select(at(), "_before", "_low", "_high"), "_at")
    upto = F.col("_before") + F.sum(n).over(W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    first = lambda place: F.min(F.when(F.col("_upto") >= F.col(place), F.col(value)))
    found = near.withColumn("_upto", upto).groupBy(*keys).agg((0.5 * first("_low") + 0.5 * first("_high")).alias(name))
    if not keys:
        return found
    every = counts.select(F.struct(*keys).alias("_at")).distinct()
    return every.join(found.select(F.struct(*keys).alias("_at"), name), "_at", "left").select("_at.*", name)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node that it reaches.

    Rounds of contraction: each node moves to the neighbour that is first in a hashed order, edges are relabelled, loops go.
    Every round drops a constant share of the nodes whatever the shape, and ends as a table in the shared folder. Joins read
    tables on both sides, so adaptive execution can split the partition of a node with many edges. Nulls and loops are dropped.
    """
    first = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("v"))
    left = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    left = materialize(left.distinct(), "edges")
    labels = materialize(left.select(F.col("a").alias("node")).union(left.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node")), "labels")
    left = left.where("a <> b")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        moves = both.groupBy("a").agg(F.min(first(F.col("b"))).alias("m")).select("a", F.least(first(F.col("a")), "m").getField("v").alias("to")).where("a <> to")
        moves = materialize(moves, "moves")
        ma, mb = moves.toDF("a", "to_a"), moves.toDF("b", "to_b")
        new = left.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y")).where("x <> y")
        labels = materialize(labels.join(moves.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        left = materialize(new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    roots = materialize(labels.groupBy("label").agg(F.min("node").alias("root")), "roots")
    return labels.join(roots, "label").select("node", "root")
