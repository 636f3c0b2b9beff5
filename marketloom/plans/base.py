"""How plan modules register queries, and the views of the test tables that they run on."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import ship

#: The month whose sales a listing shows, and the one before.
MONTH, PREVIOUS = "2000-01-01", "1999-12-01"

_CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))"
#: The same views for the SQL side.
SQL_VIEWS = f"""
snapshot AS (SELECT l_partkey AS id, date_trunc('month', l_shipdate)::TIMESTAMP AS period, sum(l_quantity) AS sales, CAST(sum({_CENTS}) AS DOUBLE) / 10000 AS revenue,
  count(DISTINCT l_suppkey) AS sellers FROM lineitem GROUP BY ALL),
listing AS (SELECT p_partkey AS id, p_name AS title, p_brand AS brand, p_type AS segment, p_size AS size, p_retailprice AS price, s.sales, s.revenue, s.sellers,
  (SELECT min(l_shipdate) FROM lineitem WHERE l_partkey = p_partkey) AS launched
  FROM part LEFT JOIN snapshot s ON s.id = p_partkey AND s.period = TIMESTAMP '{MONTH}'),
history AS (SELECT s.*, p_brand AS brand, p_type AS segment, p_retailprice AS price FROM snapshot s JOIN part ON p_partkey = s.id)
"""


class Views:
    """Market views over the driver's tables. Money is summed in whole ten-thousandths, so sums do not depend on their order."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def snapshot(self) -> DataFrame:
        """id, period (month), sales, revenue, sellers."""
        cents = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
        period = F.date_trunc("month", "l_shipdate").cast("timestamp_ntz")
        return (
            self.table("lineitem").groupBy(F.col("l_partkey").alias("id"), period.alias("period"))
            .agg(F.sum("l_quantity").alias("sales"), (F.sum(cents).cast("double") / 10000).alias("revenue"), F.count_distinct("l_suppkey").alias("sellers"))
        )

    @cached_property
    def parts(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("segment"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")
        )

    @cached_property
    def listing(self) -> DataFrame:
        """One row per listing with the sales of ``MONTH`` (null where it had none) and the first day that it sold."""
        now = self.snapshot.where(F.col("period") == F.lit(MONTH).cast("timestamp_ntz")).drop("period")
        first = self.table("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_shipdate").alias("launched"))
        return self.parts.join(now, "id", "left").join(first, "id", "left")

    @cached_property
    def history(self) -> DataFrame:
        return self.snapshot.join(self.parts.select("id", "brand", "segment", "price"), "id")


class Book:
    """Queries of one plan module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, views: bool = True):
        """Registers a function of ``Views``; ``sql`` is a select, or CTEs after ``WITH``, over the views above."""

        def keep(f):
            self.queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql:
                body = sql.strip()
                if not views:
                    self.sql[name] = body
                elif body.startswith("WITH "):
                    self.sql[name] = f"WITH {SQL_VIEWS}, {body[5:]}"
                else:
                    self.sql[name] = f"WITH {SQL_VIEWS} {body}"
            return f

        return keep
