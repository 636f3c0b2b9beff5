"""What the physical plans must show: pruned scans, pushed filters, no Python and no cross product where none is needed."""

import pytest

from marketloom.plans import registry
from marketloom.session import materialize
from tests.oracle import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(registry.queries()["A8_pruned_scan"](spark, SF))
    assert "GreaterThan(l_quantity,45.0)" in text and "l_comment" not in text
    scan = next(x for x in text.split("\n") if "FileScan" in x)
    assert "l_extendedprice" not in scan and "l_tax" not in scan


@pytest.mark.parametrize("name", ["F1_market_totals", "F7_segment_capacity", "F16_brand_table", "E6_snapshot_diff", "E9_block_pairs", "E15_asof_backward", "G11_moving_average", "K17_opportunity_score", "I1_quality_score"])
def test_core_queries_stay_in_the_jvm(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text and "CartesianProduct" not in text


def test_one_aggregation_per_snapshot(spark):
    text = plan(registry.queries()["F19_period_series"](spark, SF))
    assert text.count("FileScan") == 2


def test_materialized_tables_keep_their_schema(spark):
    df = spark.createDataFrame([(1, None, [1, 2])], "a int, b string, c array<long>")
    assert materialize(df).schema == df.schema and materialize(df).collect() == df.collect()
