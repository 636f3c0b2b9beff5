"""Column builders: parsing, safe arithmetic and statistics that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions.scale import ranged
from marketloom.session import materialize

NUMBER = r"^-?\d+(\.\d+)?$"
#: Date formats tried in order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy", "MM/dd/yyyy", "yyyyMMdd", "MMM d, yyyy")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """White-space runs and spreadsheet escapes become one space; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(col(c), r"_x000[0-9A-Fa-f]_", " "), r"\s+", " ")), F.lit(""))


def parse_number(c: Column | str) -> Column:
    """A number without thousands commas and dollar signs; null if it is none."""
    return F.trim(F.regexp_replace(col(c), r"[,$]", "")).try_cast("double")


def parse_rate(c: Column | str) -> Column:
    """A share: per cent and values above 1 are divided by 100; dashes are null."""
    text = F.trim(col(c))
    value = parse_number(F.regexp_replace(text, "%", ""))
    return F.when(text.isin("-", "--"), None).when(text.contains("%") | (value > 1), value / 100).otherwise(value)


def parse_date(c: Column | str) -> Column:
    """The first format that fits; text that looks like a number is never a date unless it is eight digits."""
    text = F.trim(col(c))
    tried = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS])
    return F.when(text.rlike(NUMBER), None).otherwise(tried).cast("timestamp_ntz")


def record_id(*parts: Column | str, length: int = 20) -> Column:
    """First hex digits of the SHA-1 of the parts joined by a pipe; nulls count as empty."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]).cast("binary")), 1, length)


def clean_title(title: Column | str, brand: Column | str) -> Column:
    """Lower case without the brand and anything but letters, digits, spaces and full stops."""
    bare = F.replace(F.lower(col(title)), F.lower(F.coalesce(col(brand), F.lit("\u0000"))), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9 .]", " "), r" +", " "))


def brand_key(c: Column | str) -> Column:
    return F.nullif(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]", ""), F.lit(""))


def violations(*rules: tuple[Column, str]) -> Column:
    """Names of the rules whose condition is true, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in rules]))


def price_band(c: Column | str, edges: tuple = (20, 50, 100, 250)) -> Column:
    """Label of a left-closed band; null stays null."""
    p, out = col(c), F.when(col(c).isNull(), None).when(col(c) < edges[0], F.lit(f"<${edges[0]}"))
    for lo, hi in zip(edges, edges[1:], strict=False):
        out = out.when(p < hi, F.lit(f"${lo}-{hi}"))
    return out.otherwise(F.lit(f"${edges[-1]}+"))


def spec_conflict(a: Column | str, b: Column | str, share: float = 0.05) -> Column:
    """Whether two known values differ by more than a share of the larger; null if one is unknown."""
    a, b = col(a), col(b)
    return F.coalesce(F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b))), F.when(a == b, F.lit(0.0))) > share


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Mean of known values by weight; null without any."""
    v, w = col(value), col(weight)
    return F.try_divide(F.sum(F.when(v.isNotNull() & w.isNotNull(), v * w)), F.sum(F.when(v.isNotNull(), w)))


def mean_of_known(parts: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """Weighted mean over the components that are known, and the share of weight that they hold."""
    total = sum(w for _, w in parts)
    have = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    held = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    return F.try_divide(held, have), have / total


def geometric_index(parts: list[tuple[Column, float]], floor: float = 0.01, neutral: float = 0.5) -> tuple[Column, Column]:
    """Weighted geometric mean in per cent; unknown parts count ``neutral``. Second: the share of weight that is known."""
    total = sum(w for _, w in parts)
    logs = sum((F.log(F.greatest(F.coalesce(c, F.lit(neutral)), F.lit(floor))) * w for c, w in parts), F.lit(0.0))
    known = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    return F.exp(logs / total) * 100, known / total


def rank_share(c: Column | str, *by: str, single: float = 1.0) -> Column:
    """Average rank divided by the count of known values; null for null. ``single``: what a lone value gets."""
    c = col(c)
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    n = F.count(c).over(part)
    peers = F.count(c).over(W.partitionBy(*by, c))
    rank = F.rank().over(part.orderBy(c.asc_nulls_last())) + (peers - 1) / 2
    return F.when(c.isNull(), None).when(n == 1, F.lit(single)).otherwise(rank / n)


def bh_qvalues(df: DataFrame, p: str, out: str = "q", by: tuple = (), tie: tuple = ()) -> DataFrame:
    """Benjamini-Hochberg q-values: the least p * n / rank from the largest p down; null p stays out.

    Ranks and least values are taken in parts of a global order, and a row per part carries them from part to part."""
    rows = ranged(df.where(F.col(p).isNotNull()), list(by), [p, *tie]).withColumn("_at", F.struct(*by, "_part"))
    whole = W.partitionBy(*[F.col(f"_at.{c}") for c in by] or [F.lit(0)])
    per = rows.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_at._part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).withColumn("_all", F.sum("_n").over(whole)).drop("_n")
    ranked = rows.withColumn("_turn", F.row_number().over(W.partitionBy("_at").orderBy(p, *tie))).join(per, "_at")
    ranked = materialize(ranked.withColumn("_raw", F.col(p) * F.col("_all") / (F.col("_before") + F.col("_turn"))), "ranked")
    # from the last row backwards: a frame that ends with the rows to come is worked out anew for each row
    low = F.min("_raw").over(W.partitionBy("_at").orderBy(F.desc("_turn")).rowsBetween(W.unboundedPreceding, 0))
    later = F.min("_least").over(whole.orderBy(F.desc("_at._part")).rowsBetween(W.unboundedPreceding, -1))
    ends = ranked.groupBy("_at").agg(F.min("_raw").alias("_least")).withColumn("_later", later).drop("_least")
    q = ranked.withColumn("_low", low).join(ends, "_at").select(*df.columns, F.least("_low", "_later", F.lit(1.0)).alias(out))
    return q.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def top_per_group(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key in ``order``."""
    return top_per_group(df, by, order, 1, "_first").drop("_first")
