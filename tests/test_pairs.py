"""Pairs of blocks that are not shuffled, and copies that stand as one class."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from marketloom.operators import entities as E
from marketloom.plans import registry
from marketloom.plans.base import Views
from tests.oracle import SF


def test_keys_of_several_rows_pair_once_without_a_shuffle_of_pairs(spark):
    """the first shared block names the method, also for repeated keys; no aggregate runs over pairs."""
    rows = [(i, f"x{i % 5}" if i % 4 else None, f"y{i % 7}") for i in range(60)] + [(3, "x1", "y1"), (3, "x1", "y1"), (8, "x3", None), (8, "x2", "y6")]
    got = E.block_pairs(spark.createDataFrame(rows, "id long, one string, two string").repartition(3), "id", ["one", "two"])
    want = {}
    for place, method in ((2, "two"), (1, "one")):
        for p, q in combinations(rows, 2):
            if p[0] != q[0] and p[place] is not None and p[place] == q[place]:
                want[min(p[0], q[0]), max(p[0], q[0])] = method
    assert sorted(map(tuple, got.collect())) == sorted((a, b, m) for (a, b), m in want.items())
    assert "keys=[a" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["E9_block_pairs", "I11_pair_score", "I12_pair_decision"])
def test_rows_that_meet_are_not_broadcast(spark, name):
    """exploded rows look as small as the table they are from, and one side went to the driver."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    meets = [x for x in plan.split("\n") if "Join [" in x and "_i#" in x]
    assert meets and all("SortMergeJoin" in x for x in meets)


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """300 copies of 8 parts under shifted keys, some without a brand, a size or a price; the other tables as they are."""
    place = str(tmp_path_factory.mktemp("copies"))
    part = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey < 8").crossJoin(spark.range(300).withColumnRenamed("id", "r"))
    few = part.select((F.col("p_partkey") + 1000 * F.col("r")).alias("p_partkey"), F.lit("ring").alias("p_name"), F.when(F.col("p_partkey") < 7, "b").alias("p_brand"), "p_type", F.when(F.col("p_partkey") != 5, 30 + F.col("p_partkey") % 3).cast("int").alias("p_size"),
        F.when(F.col("p_partkey") == 4, None).when(F.col("p_partkey") == 3, 10.0).otherwise(F.col("p_retailprice")).alias("p_retailprice"))
    few.coalesce(1).write.parquet(f"{place}/part.parquet")
    for t in ("lineitem", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(f"{place}/{t}.parquet")
    return place


def test_copies_are_decided_once(spark, copies):
    """pairs of classes, not of rows, and yet all pairs of rows are counted."""
    from marketloom.plans.joins import _decided

    assert _decided(Views(spark, copies)).count() <= 21
    n = dict(registry.queries()["I12_pair_decision"](spark, copies).collect())
    rows = 7 * 300
    assert sum(n.values()) == rows * (rows - 1) // 2 and (n["veto_spec"], n["veto_price"]) == (300 * 300 * 3, 300 * 300 * 4)
    assert registry.queries()["F52_matching_breakdown"](spark, copies).first()["pairs"] == rows * (rows - 1) // 2


@pytest.mark.parametrize("name", ["I20_clusters", "I15_product_ids", "I13_constrained_merge", "I18_human_decisions"])
def test_copies_share_a_cluster(spark, copies, name):
    """every row comes back, and copies are together; rows without a brand are alone."""
    found = registry.queries()[name](spark, copies).collect()
    if name == "I15_product_ids":
        assert sorted(r["listings"] for r in found if r["listings"] > 1) and sum(r["listings"] for r in found) == 2400
        return
    of = {r[0]: r[1] for r in found}
    assert len(found) == len(of) == 2400
    assert all(of[i] == of[i + 1000 * r] for i in range(7) for r in range(300)) and len({of[7 + 1000 * r] for r in range(300)}) == 300
