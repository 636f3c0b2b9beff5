"""Medians and q-values over parts of a global order, against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from marketloom.functions import expr as X
from marketloom.functions import scale as SC


def test_medians_over_parts(spark, monkeypatch):
    monkeypatch.setattr(SC, "PART", 40)
    rng = random.Random(4)
    rows = [(k, rng.choice([1.5, 2.0, rng.random()])) for k in ("a", "b", None) for _ in range(150)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None), ("a", None)]
    counts = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    want = {k: (statistics.median(x) if (x := [v for j, v in rows if j == k and v is not None]) else None) for k in {k for k, _ in rows}}
    assert {r["k"]: r["median"] for r in SC.exact_medians(counts, ["k"], "v", "n").collect()} == pytest.approx(want)
    assert [r["median"] for r in SC.exact_medians(counts, [], "v", "n").collect()] == [pytest.approx(statistics.median([v for _, v in rows if v is not None]))]
    assert [r["median"] for r in SC.exact_medians(counts.limit(0), [], "v", "n").collect()] == [None]


@pytest.mark.parametrize("by", [(), ("g",)])
def test_qvalues_over_parts(spark, monkeypatch, by):
    monkeypatch.setattr(SC, "PART", 30)
    rng = random.Random(6)
    rows = [(i, "xy"[i % 2] if i % 7 else None, round(rng.random() ** 3, 2) if i % 11 else None) for i in range(300)]
    got = {r["i"]: r["q"] for r in X.bh_qvalues(spark.createDataFrame(rows, "i long, g string, p double"), "p", by=by, tie=("i",)).collect()}
    want = {i: None for i, _, p in rows if p is None}
    for g in {r[1] for r in rows} if by else {None}:
        known, least = sorted((p, i) for i, h, p in rows if p is not None and (not by or h == g)), 1.0
        for k in range(len(known), 0, -1):
            least = min(least, known[k - 1][0] * len(known) / k)
            want[known[k - 1][1]] = least
    assert got == pytest.approx(want)


def test_no_frame_ends_with_the_rows_to_come(spark):
    out = X.bh_qvalues(spark.range(5).select("id", (F.col("id") / 10).alias("p")), "p", tie=("id",))
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("specifiedwindowframe(rowframe, unboundedpreceding$(), unboundedfollowing$())", "")


def test_the_market_median_is_not_taken_in_one_task(spark):
    from marketloom.plans import registry
    from tests.oracle import SF

    plan = registry.queries()["F23_supplier_price_level"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [median(" not in plan and "Aggregate [percentile(" not in plan
