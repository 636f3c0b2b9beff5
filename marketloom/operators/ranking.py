"""Windows over snapshots and groups: outliers, bands, changes, skylines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def robust_z(df: DataFrame, value: str, by: list[str], factor: float = 0.6745, out: str = "z") -> DataFrame:
    """Adds the distance from the group's median in scaled median absolute deviations; null where the deviation is 0 or the group
    unknown. Medians come from counts per value that tasks combine, not from groups gathered in a window."""
    mid = df.groupBy(*by).agg(F.median(value).alias("_mid"))
    near = df.join(mid, by, "left").withColumn("_gap", F.abs(F.col(value) - F.col("_mid")))
    mad = near.groupBy(*by).agg(F.median("_gap").alias("_mad"))
    z = F.try_divide(factor * (F.col(value) - F.col("_mid")), F.col("_mad"))
    return near.join(mad, by, "left").withColumn(out, z).select(*df.columns, out)


def iqr_outliers(df: DataFrame, value: str, by: list[str], k: float = 3.0, least: int = 8, out: str = "outlier") -> DataFrame:
    """Values outside k interquartile ranges on a log scale; none in groups below ``least`` values or without spread."""
    x = F.log1p(F.col(value))
    q = df.groupBy(*by).agg(F.count(value).alias("_n"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    lo, hi = F.get("_q", F.lit(0)), F.get("_q", F.lit(1))
    far = (x < lo - k * (hi - lo)) | (x > hi + k * (hi - lo))
    return df.join(q, by).withColumn(out, F.coalesce((F.col("_n") >= least) & (hi > lo) & far, F.lit(False))).drop("_n", "_q")


def rank_bands(df: DataFrame, value: str, by: list[str], k: int, tie: str, out: str = "band") -> DataFrame:
    """k bands of the first-come rank with linearly interpolated quantile edges: ceil((rank - 1) * k / (n - 1)), 1 at least."""
    w = W.partitionBy(*by, F.col(value).isNotNull())
    rank, n = F.row_number().over(w.orderBy(value, tie)), F.count(F.lit(1)).over(w)
    band = F.when(n == 1, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.try_divide((rank - 1) * k, n - 1))))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), band.cast("int")))


def placed(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, peers, below, known): for each known value of a group how many rows share it, lie below it, and are known.

    Rows are counted per value first, so a group with a third of all rows is one row per distinct value in the window."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("peers"))
    w = W.partitionBy(*by)
    before = F.sum("peers").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    return g.withColumns({"below": F.coalesce(before, F.lit(0)), "known": F.sum("peers").over(w)})


def with_rank_share(df: DataFrame, value: str, by: list[str], out: str = "pct", single: float = 1.0) -> DataFrame:
    """Adds the average rank over the count of known values; null for null. ``single``: what a lone value gets."""
    share = F.when(F.col("known") == 1, F.lit(single)).otherwise((F.col("below") + (F.col("peers") + 1) / 2) / F.col("known"))
    return df.join(placed(df, value, by).select(*by, value, share.alias(out)), [*by, value], "left")


def position_vs_peers(df: DataFrame, value: str, by: list[str], out: str = "position") -> DataFrame:
    """Adds the share of known peers below plus half of those equal."""
    share = (F.col("below") + 0.5 * F.col("peers")) / F.col("known")
    return df.join(placed(df, value, by).select(*by, value, share.alias(out)), [*by, value], "left")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id", share: float = 0.01) -> DataFrame:
    """(key, change, before, after): NEW, REMOVED, PRICE and SALES changes above ``share`` between two snapshots."""
    o = old.select(F.col(key), F.col("price").alias("p0"), F.col("sales").alias("s0"), F.lit(True).alias("in0"))
    n = new.select(F.col(key), F.col("price").alias("p1"), F.col("sales").alias("s1"), F.lit(True).alias("in1"))
    j = o.join(n, key, "full_outer")
    moved = lambda a, b: F.coalesce(F.try_divide(F.abs(F.col(b) - F.col(a)), F.abs(F.col(a))) > share, F.lit(False))
    row = lambda cond, kind, a, b: F.when(cond, F.struct(F.lit(kind).alias("change"), F.col(a).alias("before"), F.col(b).alias("after")))
    kinds = F.array_compact(F.array(row(F.col("in0").isNull(), "NEW", "s0", "s1"), row(F.col("in1").isNull(), "REMOVED", "s0", "s1"), row(moved("p0", "p1"), "PRICE", "p0", "p1"), row(moved("s0", "s1"), "SALES", "s0", "s1")))
    return j.select(key, F.explode(kinds).alias("c")).select(key, "c.*")


def growth_between(df: DataFrame, by: list[str], value: str, period: str = "period", least: int = 3) -> DataFrame:
    """First and last value and growth in per cent; null growth for a zero or unknown base and for fewer than ``least`` periods."""
    g = df.groupBy(*by).agg(F.count_distinct(period).alias("periods"), F.min_by(value, period).alias("first"), F.max_by(value, period).alias("last"))
    return g.withColumn("growth_pct", F.when(F.col("periods") >= least, F.try_divide(F.col("last") - F.col("first"), F.nullif(F.abs("first"), F.lit(0.0))) * 100))


def skyline(df: DataFrame, better_high: str, better_low: str, by: list[str]) -> DataFrame:
    """Rows of each group that no other row dominates: as good in both criteria and better in one.

    A row stands if it has the least low value among rows of its high value, and every row with a higher one has a greater low
    value. So one row per distinct high value is all that the window sees. Rows with an unknown criterion take no part."""
    known = df.where(F.col(better_high).isNotNull() & F.col(better_low).isNotNull())
    best = known.groupBy(*by, better_high).agg(F.min(better_low).alias("_least"))
    above = F.min("_least").over(W.partitionBy(*by).orderBy(F.desc(better_high)).rowsBetween(W.unboundedPreceding, -1))
    front = best.withColumn("_above", above).where(F.col("_above").isNull() | (F.col("_above") > F.col("_least"))).drop("_above")
    return known.join(front, [*by, better_high]).where(F.col(better_low) == F.col("_least")).select(*df.columns)


def nearest_in_time(left: DataFrame, right: DataFrame, at: str, seen: str, days: int, by: list[str], tie: list[str]) -> DataFrame:
    """Each row of ``left`` with the nearest row of ``right`` within ``days`` (earlier first on ties), null where there is none.

    Both sides are keyed by blocks of ``days``, so that the range condition becomes an equi-join over three blocks."""
    block = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (86400 * days))
    l = left.withColumn("_block", F.explode(F.array(*[block(at) + k for k in (-1, 0, 1)]))).withColumn("_home", block(at))  # noqa: E741
    r = right.withColumn("_block", block(seen))
    gap = F.abs(F.datediff(F.col(at), F.col(seen)))
    near = l.join(r, [*by, "_block"]).where(gap <= days).withColumn("_gap", gap)
    keys = left.columns
    w = W.partitionBy(*keys).orderBy("_gap", seen, *tie)
    best = near.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_block", "_home")
    return left.join(best, keys, "left")


def last_so_far(left: DataFrame, right: DataFrame, by: list[str], at: str, seen: str, tie: list[str], span: int = 86400) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of its key that was ``seen`` at its time or before (the greatest by
    ``seen``, then ``tie``), null where there is none.

    Time is cut into cells of ``span`` seconds: within a cell the last row is carried forward in a window; what stood before
    a cell comes from one row per cell. So the rows of one key, however many, are not sorted in one task."""
    extra = [c for c in right.columns if c not in (*by, *tie)]
    other = F.struct(F.col(seen).alias("_at"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)])
    cell = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / span).alias("_cell")
    r = right.where(F.col(seen).isNotNull()).select(*by, F.col(seen).alias("_ts"), cell(seen), other.alias("_seen"))
    l = left.select(*by, F.col(at).alias("_ts"), cell(at), F.struct(*left.columns).alias("_row"))  # noqa: E741
    carried = W.partitionBy(*by, "_cell").orderBy("_ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_own", F.max("_seen").over(carried)).where(F.col("_row").isNotNull())
    before = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = l.select(*by, "_cell").distinct().join(r.groupBy(*by, "_cell").agg(F.max("_seen").alias("_best")), [*by, "_cell"], "full_outer")
    cells = cells.withColumn("_before", F.max("_best").over(before)).drop("_best")
    found = both.join(cells, [*by, "_cell"], "left").withColumn("_found", F.coalesce("_own", "_before"))
    return found.select("_row.*", *[F.col(f"_found._x{i}").alias(c) for i, c in enumerate(extra)])


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Rank correlation with average ranks over rows where both are known."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    return with_rank_share(with_rank_share(both, a, by, "_ra"), b, by, "_rb").groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))
