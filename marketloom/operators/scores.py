"""Observation intervals, indices, opportunity scores, economics, trends, anomalies and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rungs of the badge ladder that marketplaces show.
LADDER = (50.0, 100.0, 200.0, 300.0, 400.0, 500.0, 600.0, 700.0, 800.0, 900.0, 1000.0, 2000.0, 3000.0, 4000.0, 5000.0, 10000.0)


def observation_interval(sales: str, ladder: tuple = LADDER, badges: bool = True) -> tuple[Column, Column]:
    """Lower and upper bound of what a shown number means: a rung up to the next, below the first rung if nothing is shown, twice
    itself for the top rung; a number off the ladder is exact. Without badges a missing number has no upper bound (null)."""
    s, rungs = F.col(sales), F.array(*[F.lit(x) for x in ladder])
    above = F.element_at(F.filter(rungs, lambda x: x > s), 1) if len(ladder) < 2 else F.get(F.filter(rungs, lambda x: x > s), F.lit(0))
    on = F.array_contains(rungs, s)
    low = F.coalesce(s, F.lit(0.0))
    high = F.when(s.isNull(), F.lit(ladder[0]) if badges else F.lit(None).cast("double")).when(~on, s).when(s == ladder[-1], 2 * s).otherwise(above)
    return low, high


def badge_ladder_found(df: DataFrame, sales: str, ladder: tuple = LADDER, share: float = 0.98, least: int = 10) -> DataFrame:
    """Whether a column shows badges: nearly all values on the ladder, none below its first rung, enough of them."""
    on = F.avg(F.when(F.col(sales).isNotNull(), F.col(sales).isin(*ladder).cast("double")))
    below = F.count(F.when(F.col(sales) < ladder[0], 1))
    return df.agg(F.count(sales).alias("n"), on.alias("on_ladder"), below.alias("below")).withColumn("badges", F.coalesce((F.col("n") >= least) & (F.col("on_ladder") >= share) & (F.col("below") == 0), F.lit(False)))


def unit_economics(price: Column, cost: Column, fee: Column, freight: Column, duty_rate: float = 0.03, referral: float = 0.15, ad_rate: float = 0.10) -> dict[str, Column]:
    """Landed cost, margin, margin rate, break-even advertising share; null where an input is."""
    landed = cost * (1 + duty_rate) + freight
    before_ads = price * (1 - referral) - fee - landed
    margin = before_ads - price * ad_rate
    return {"landed_cost": landed, "margin": margin, "margin_rate": F.try_divide(margin, price), "break_even_acos": F.try_divide(before_ads, price)}


def trend_slope(df: DataFrame, by: list[str], value: str, period: str = "period", least: int = 3) -> DataFrame:
    """Monthly growth of a log-linear fit over positive values, with its label; null below ``least`` periods."""
    first = F.min(period).over(W.partitionBy(*by))
    months = F.round(F.months_between(F.col(period).cast("timestamp"), first.cast("timestamp")))
    pos = df.where(F.col(value) > 0).withColumn("_x", months)
    g = pos.groupBy(*by).agg(F.count(F.lit(1)).alias("periods"), F.regr_slope(F.log(value), F.col("_x")).alias("slope"))
    growth = F.when(F.col("periods") >= least, F.exp("slope") - 1)
    label = F.when(growth.isNull(), "insufficient_history").when(growth > 0.01, "growing").when(growth < -0.01, "declining").otherwise("stable")
    return g.select(*by, "periods", growth.alias("monthly_growth"), label.alias("label"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = F.try_divide(hits.cast("double"), n.cast("double"))
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (mid - half) / (1 + z * z / n), (mid + half) / (1 + z * z / n)


def long_checks(checks: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """One row per check (name, value, status): pass while the value is 0, else the given status."""
    out = None
    for name, df, value, status in checks:
        row = df.select(F.lit(name).alias("check"), F.col(value).cast("double").alias("value")).withColumn("status", F.when(F.col("value") == 0, "pass").otherwise(status))
        out = row if out is None else out.unionByName(row)
    return out


def rule_checks(facts: DataFrame, rules: list[tuple[str, Column, Column, str]]) -> DataFrame:
    """(check, value, status) from one row of facts: pass where a rule's condition holds, else its status; a rule whose condition is
    unknown says nothing. A last row "all" has the worst status and the number of rules that did not pass."""
    rank = F.create_map(F.lit("pass"), F.lit(0), F.lit("warn"), F.lit(1), F.lit("fail"), F.lit(2))
    rows = [F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), F.when(ok, "pass").when(~ok, status).alias("status")) for name, value, ok, status in rules]
    said = facts.select(F.filter(F.array(*rows), lambda r: r["status"].isNotNull()).alias("rows"))
    bad = F.size(F.filter("rows", lambda r: r["status"] != "pass")).cast("double")
    worst = F.array_max(F.transform("rows", lambda r: F.struct(F.element_at(rank, r["status"]).alias("rank"), r["status"].alias("status"))))["status"]
    every = F.struct(F.lit("all").alias("check"), bad.alias("value"), F.coalesce(worst, F.lit("pass")).alias("status"))
    return said.select(F.explode(F.concat("rows", F.array(every))).alias("r")).select("r.*")
