"""Drawn totals of groups at several levels, wider by a factor, inside what is certain, and with means that add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Fixed value: how much wider than drawn the totals of a group are.
INFLATION = 1.3
#: The group that all rows are in, at a level without a column, and the one of rows without a group.
ALL, NO_GROUP = "all", "(none)"
SLACK = 1e-9


def members_of(levels: dict[str, str | None]) -> list[Column]:
    """A row's group at each level."""
    return [F.coalesce(F.col(c).cast("string"), F.lit(NO_GROUP)) if c else F.lit(ALL) for c in levels.values()]


def _levels(levels: dict[str, str | None]) -> Column:
    """A row's (level, member) at each level."""
    return F.explode(F.array(*[F.struct(F.lit(name).alias("level"), member.alias("member")) for name, member in zip(levels, members_of(levels), strict=True)]))


def anchored_totals(draws: DataFrame, rows: DataFrame, key: str, levels: dict[str, str | None], low: str, high: str, mean: str, weight: str | None = None, inflation: float = INFLATION) -> DataFrame:
    """(level, member, sim, total): sums of draws (sim, key, units) over the groups of each level, anchored.

    ``rows`` gives a key's bounds (``high`` null: none), its expected units and its group at each level (a column; None: all rows are
    one group). With ``weight`` (a price, say; null counts as 0) draws, bounds and means are multiplied by it. Of every group:

    * the part of a draw above the sum of lower bounds is spread around its mean by ``inflation``, and never falls below 0;
    * it is scaled by one factor, and held at the sum of upper bounds, so that the mean over the draws is the sum of the expected
      units. So means add up from level to level, and each draw lies between the sums of the bounds.

    The factor is exact: with draws in falling order, the first place where scaling it and all later draws to what the held ones leave
    keeps it below the ceiling. If no factor gives the mean, as too few draws are above the floor, these are at the ceiling and the others
    share what the mean still needs. A null key is left out; a null
    group is ``NO_GROUP``; a key is in one row. A group is summed before it is shuffled, and windows hold one group's sums, a row a draw.
    Draws may come as sums already, (level, member, sim, drawn) with the weight in them. Draws that carry the columns of all levels (and the weight) are those of ``rows`` and are summed where they are drawn; others meet
    their rows in a join that sorts both sides, as Spark takes exploded draws for as few as their rows and would broadcast them."""
    factor = F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    number = lambda c: F.col(c).cast("double")
    known = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), _levels(levels).alias("g"), factor.alias("_w"), (number(low) * factor).alias("_low"), (number(mean) * factor).alias("_mean"),
        F.when(factor == 0, 0.0).otherwise(number(high) * factor).alias("_high"))
    known = materialize(known.select("_key", "g.level", "g.member", "_w", "_low", "_high", "_mean"), "levels")
    sums = known.groupBy("level", "member").agg(F.sum("_low").alias("floor"), F.when(F.count_if(F.col("_high").isNull()) == 0, F.sum("_high")).alias("ceiling"), F.sum("_mean").alias("mean"))
    carried = [c for c in (*levels.values(), weight) if c]
    if "drawn" in draws.columns:
        total = draws.select("level", "member", "sim", "drawn")
    elif carried and set(carried) <= set(draws.columns):
        drawn = draws.where(F.col(key).isNotNull()).select("sim", "units", factor.alias("_w"), _levels(levels).alias("g")).select("sim", "units", "_w", "g.level", "g.member")
    else:
        drawn = draws.select(F.col(key).alias("_key"), "sim", "units").join(known.hint("merge"), "_key")
    if "drawn" not in draws.columns:
        total = drawn.groupBy("level", "member", "sim").agg(F.sum(F.col("units") * F.col("_w")).alias("drawn"))
    total = materialize(total.join(sums, ["level", "member"]), "drawn")

    group = W.partitionBy("level", "member")
    falling = group.orderBy(F.desc("e"), "sim")
    above = total.withColumn("e", F.greatest(F.col("drawn") - F.col("floor"), F.lit(0.0))).withColumn("m", F.avg("e").over(group))
    above = above.withColumn("e", F.greatest(F.col("m") + inflation * (F.col("e") - F.col("m")), F.lit(0.0)))
    room, target = F.coalesce(F.col("ceiling") - F.col("floor"), F.lit(float("inf"))), F.greatest(F.col("mean") - F.col("floor"), F.lit(0.0))
    placed = above.withColumns({"room": room, "target": F.least(target, room), "held": F.row_number().over(falling) - 1, "n": F.count(F.lit(1)).over(group), "some": F.count_if(F.col("e") > 0).over(group)})
    placed = placed.withColumn("rest", F.sum("e").over(falling.rowsBetween(0, W.unboundedFollowing)))
    taken = F.when(F.col("held") > 0, F.col("held") * F.col("room")).otherwise(0.0)
    scale = (F.col("n") * F.col("target") - taken) / F.when(F.col("rest") > 0, F.col("rest"))
    fits = (scale >= 0) & (scale * F.col("e") <= F.col("room") + SLACK * (1 + F.abs("target")))
    placed = placed.withColumn("scale", F.min_by(F.when(fits, scale), F.when(fits, F.col("held"))).over(group))
    left = F.col("n") * F.col("target") - F.when(F.col("some") > 0, F.col("some") * F.col("room")).otherwise(0.0)
    unscaled = F.when(F.col("e") > 0, F.col("room")).otherwise(left / (F.col("n") - F.col("some")))
    own = F.when(F.col("scale").isNotNull(), F.least(F.col("scale") * F.col("e"), F.col("room"))).otherwise(unscaled)
    return placed.select("level", "member", "sim", (F.col("floor") + own).alias("total"))


def level_intervals(totals: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(level, member, low, mean, high) of anchored totals."""
    return totals.groupBy("level", "member").agg(F.percentile("total", F.lit(low)).alias("low"), F.avg("total").alias("mean"), F.percentile("total", F.lit(high)).alias("high"))
