"""Hand-computed and planted cases of single operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import expr as X
from marketloom.functions.scale import connected_components, rank_in_key
from marketloom.operators import demand as D
from marketloom.operators import entities as E
from marketloom.operators import insight as N
from marketloom.operators import market as M
from marketloom.operators import merging as MG
from marketloom.operators import quality as QA
from marketloom.operators import ranking as R
from marketloom.operators import scores as S
from marketloom.operators import text as T
from marketloom.plans.pipeline import resolve
from marketloom.sources import store


def one(df):
    return [tuple(r) for r in df.collect()]


def test_parsers(spark):
    df = spark.createDataFrame([("$1,234.5", "12%", "2024-01-02"), ("n/a", "-", "20240102"), (" 7 ", "0.5", "02.01.2024"), (None, "40", None)], "n string, r string, d string")
    got = df.select(X.parse_number("n"), X.parse_rate("r"), X.parse_date("d").cast("string")).collect()
    assert [tuple(r) for r in got] == [(1234.5, 0.12, "2024-01-02 00:00:00"), (None, None, None), (7.0, 0.5, "2024-01-02 00:00:00"), (None, 0.4, None)]


def test_totals_keep_unknown_apart_from_zero(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("b", 0.0, 0.0)], "s string, sales double, revenue double")
    assert sorted(one(M.totals(df, ["s"]))) == [("a", 2, 1.0, None, 0.5, 0.0), ("b", 1, 0.0, 0.0, 1.0, 1.0)]


def test_concentration_and_hhi(spark):
    df = spark.createDataFrame([("m", "x", 60.0), ("m", "y", 30.0), ("m", "z", 10.0), ("n", "x", None)], "s string, b string, v double")
    got = {r["s"]: r for r in M.concentration(df, ["s"], "b", "v").collect()}
    assert got["m"]["hhi"] == pytest.approx(4600) and got["m"]["leader"] == "x" and got["m"]["top3_share"] == pytest.approx(1)
    assert got["n"]["hhi"] is None and got["n"]["leader"] is None


def test_tiers_need_three_prices(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "s string, price double")
    got = {r["s"]: r["tier_low"] for r in M.price_tiers(df, ["s"]).collect()}
    assert got["a"] is None and got["b"] == pytest.approx(1.66)


def test_rank_share_averages_ties(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 9.0), (4, None)], "id int, v double")
    got = dict(one(df.select("id", X.rank_share("v"))))
    assert got == {1: 0.5, 2: 0.5, 3: 1.0, 4: None}
    assert one(df.where("id = 3").select(X.rank_share("v", single=0.5))) == [(0.5,)]


def test_rank_in_key_matches_a_window(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(rng.choice("aab"), rng.randrange(5), i) for i in range(300)], "k string, c int, i int")
    got = sorted(one(rank_in_key(df, ["k"], ["c"], ["i"]).select("k", "c", "i", "rank")))
    for key in "ab":
        own = sorted(x for x in got if x[0] == key)
        assert [x[3] for x in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    rng = random.Random(7)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(50, i) for i in range(80)], "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)], "empty": []}[shape]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(one(connected_components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: find(i) for i in root}


def test_outliers_without_spread_are_none(spark):
    df = spark.createDataFrame([("a", 5.0)] * 9 + [("a", 500.0)] + [("b", float(x)) for x in (1, 1000)], "g string, v double")
    assert not any(r["outlier"] for r in R.iqr_outliers(df, "v", ["g"]).collect())
    assert all(r["z"] is None for r in R.robust_z(df.where("g = 'a'"), "v", ["g"]).collect())


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, 10.0, 5.0), (2, 10.0, 5.0), (3, 10.0, None)], "id int, price double, sales double")
    new = spark.createDataFrame([(1, 10.05, 5.0), (3, 12.0, 4.0), (4, 1.0, 1.0)], "id int, price double, sales double")
    assert sorted(one(R.snapshot_diff(old, new).select("id", "change"))) == [(2, "REMOVED"), (3, "PRICE"), (4, "NEW")]


def test_nearest_in_time_ties_go_to_the_earlier(spark):
    l = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2024-01-10' AS at UNION ALL SELECT 2, TIMESTAMP_NTZ '2024-03-01'")  # noqa: E741
    r = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2024-01-08' AS seen, 'a' AS v UNION ALL SELECT 1, TIMESTAMP_NTZ '2024-01-12', 'b' UNION ALL SELECT 2, TIMESTAMP_NTZ '2024-01-01', 'c'")
    assert sorted(one(R.nearest_in_time(l, r, "at", "seen", 5, ["k"], ["v"]).select("k", "v"))) == [(1, "a"), (2, None)]


def test_observation_interval(spark):
    df = spark.createDataFrame([(None,), (50.0,), (73.0,), (10000.0,)], "s double")
    low, high = S.observation_interval("s")
    assert one(df.select(low, high)) == [(0.0, 50.0), (50.0, 100.0), (73.0, 73.0), (10000.0, 20000.0)]


def test_weighted_scores(spark):
    df = spark.createDataFrame([(0.5, None), (None, None)], "a double, b double")
    mean, cover = X.mean_of_known([(F.col("a"), 3.0), (F.col("b"), 1.0)])
    assert one(df.select(mean, cover)) == [(0.5, 0.75), (None, 0.0)]


def test_sentiment_turns_with_negation(spark):
    df = spark.createDataFrame([("this is good",), ("this is not good",), ("plain",)], "t string")
    got = [r[0] for r in df.select(T.sentence_sentiment("t")).collect()]
    assert got == pytest.approx([math.tanh(1 / 3), math.tanh(-0.8 / 3), 0.0])


def test_unknown_currency_is_an_error(spark):
    df, rates = spark.createDataFrame([("xx", 1.0)], "c string, a double"), spark.createDataFrame([("en", 1.0)], "currency string, rate double")
    with pytest.raises(Exception, match="no rate for currency xx"):
        QA.to_base_currency(df, rates, "c", "a").collect()


def test_vetoed_pairs_never_share_a_cluster(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, "match"), (2, 3, 0.8, "match"), (1, 3, 0.1, "veto_brand"), (3, 4, 0.75, "match")], "a long, b long, score double, decision string")
    component = spark.createDataFrame([(i, 1) for i in range(1, 5)], "id long, c long")
    assert sorted(one(MG.split_vetoed(pairs, component, "id"))) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_binomial_and_normal_tails(spark):
    import pandas as pd

    assert N.exact_binomial(pd.Series([3, 0, 2000]), pd.Series([3, 5, 2000])).tolist() == pytest.approx([0.125, 1.0, 0.0])
    got = spark.range(1).select(N.normal_tail(F.lit(1.959964))).first()[0]
    assert got == pytest.approx(0.05, abs=1e-5)


def test_interval_fit_recovers_a_planted_market(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        x = rng.gauss(0, 1)
        units = math.exp(4 + 0.8 * x + rng.gauss(0, 0.7))
        rung = max((r for r in S.LADDER if r <= units), default=None)
        rows.append((i, x, units, rung, f"g{i % 3}"))
    df = spark.createDataFrame(rows, "id long, x double, units_true double, shown double, g string")
    low, high = S.observation_interval("shown")
    df, names = D.design(df.withColumns({"low": low, "high": high}), ["x"])
    fit = D.fit_intervals(df, "low", "high", names)
    assert fit.beta[0] == pytest.approx(4, abs=0.1) and fit.beta[1] == pytest.approx(0.8, abs=0.1) and fit.sd == pytest.approx(0.7, abs=0.1)
    est = D.expected_units(df, "low", "high", fit).agg(F.sum("units"), F.sum("units_true"), F.sum("low"), F.sum("high"), F.count(F.when(F.col("units") < F.col("low"), 1))).first()
    assert est[2] <= est[0] <= est[3] and abs(est[0] / est[1] - 1) < 0.05 and est[4] == 0
    draws = D.joint_draws(df, "id", "low", "high", fit, sims=20)
    by_group = D.group_intervals(draws, df, "id", "g").collect()
    truth = {r["g"]: r["t"] for r in df.groupBy("g").agg(F.sum("units_true").alias("t")).collect()}
    assert all(r["low"] * 0.95 <= truth[r["g"]] <= r["high"] * 1.05 for r in by_group)
    again = D.group_intervals(D.joint_draws(df.repartition(7), "id", "low", "high", fit, sims=20), df, "id", "g").collect()
    assert {r["g"]: round(r["estimate"], 6) for r in again} == {r["g"]: round(r["estimate"], 6) for r in by_group}


def test_batch_lands_whole(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    batch = store.Batch(spark, root)
    batch.write("a", spark.range(3).toDF("x"))
    with pytest.raises(KeyError):
        store.read_batch(spark, root, "a")
    batch.write("b", spark.range(2).toDF("x"))
    batch.commit()
    assert store.read_batch(spark, root, "a").count() == 3
    second = store.Batch(spark, root)
    second.write("a", spark.range(7).toDF("x"))
    second.commit()
    assert (store.read_batch(spark, root, "a").count(), store.read_batch(spark, root, "b").count()) == (7, 2)


def test_curated_replaces_one_market(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.write_curated(spark.range(3).toDF("x"), path, "m")
    store.write_curated(spark.range(2).toDF("x"), path, "n")
    store.write_curated(spark.range(5).toDF("x"), path, "m")
    assert (store.read_curated(spark, path, "m").count(), store.read_curated(spark, path).count()) == (5, 7)


def test_exports_of_every_kind(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title\n1,"a, b"\n2,c\n')
    (tmp_path / "b.tsv").write_text("id\ttitle\n1\tx\n")
    (tmp_path / "c.jsonl").write_text('{"id": 1, "a": {"b": 2}}\n{"id": 2}\n')
    (tmp_path / "d.json").write_text('{"data": [{"id": 1, "a": {"b": [1, 2]}}, {"id": 2}]}')
    assert one(store.read_export(spark, f"file://{tmp_path}/a.csv")) == [("1", "a, b"), ("2", "c")]
    assert one(store.read_export(spark, f"file://{tmp_path}/b.tsv", "tsv")) == [("1", "x")]
    assert one(store.read_export(spark, f"file://{tmp_path}/c.jsonl", "jsonl").select("id", "`a.b`")) == [("1", "2"), ("2", None)]
    assert one(store.read_export(spark, f"file://{tmp_path}/d.json", "json").select("id", "`a.b`")) == [("1", "[1,2]"), ("2", None)]


def test_late_files_are_taken_up_where_a_stream_stopped(spark, tmp_path):
    from marketloom.streaming import market as ST

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    stream = ST.event_stream(spark, f"file://{tmp_path}", files=2)
    got = {tuple(r) for r in ST.run_to_end(ST.value_changes(stream), "t", "update", ("user_id", "event_type")).select("user_id", "event_type", "n").collect()}
    assert got == {tuple(r) for r in src.groupBy("user_id", "event_type").count().collect()}


def test_blocks_of_any_size_are_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 7)
    rows = [(k, "hot", "x" if k % 2 else None) for k in range(120)] + [(k, "pair", None) for k in (200, 201)] + [(300, "alone", "x"), (301, None, None)]
    df = spark.createDataFrame(rows, "id long, one string, two string")
    same = lambda k, x, y: x[k] is not None and x[k] == y[k]
    expected = {(x[0], y[0], "one" if same(1, x, y) else "two") for x in rows for y in rows if x[0] < y[0] and (same(1, x, y) or same(2, x, y))}
    got = one(E.block_pairs(df, "id", ["one", "two"]))
    assert len(got) == len(expected) and set(got) == expected
    assert one(E.block_pairs(df, "id", ["one"], 2, 50)) == [(200, 201, "one")]


def test_listings_of_a_product_with_many_sizes_resolve_together(spark):
    df = spark.range(60).select("id", F.lit("bolt").alias("title"), F.lit("b").alias("brand"), (2000 + F.col("id")).alias("size"), F.lit(1.0).alias("price"))
    assert {tuple(r) for r in resolve(df).collect()} == {(k, 0) for k in range(60)}


@pytest.mark.parametrize(("encoding", "text", "found"), [("utf-8-sig", "价格", "UTF-8"), ("gb18030", "商品标题", "GB18030"), ("latin-1", "café\né", "ISO-8859-1"), ("ascii", "plain", "UTF-8")])
def test_encoding_is_probed(spark, tmp_path, encoding, text, found):
    (tmp_path / "x.csv").write_bytes(f"name,n\n{text},1\n".encode(encoding))
    path = f"file://{tmp_path}/x.csv"
    assert store.probe_encoding(spark, path) == found
    df = store.read_export(spark, path, encoding=None)
    assert df.columns == ["name", "n"] and df.first()["name"] == text.split("\n")[0]


def test_registry_keeps_states_and_versions(spark, tmp_path):
    book = store.Registry(spark, f"file://{tmp_path}")
    at = "to_timestamp_ntz(at) AS at"
    put = lambda *rows: book.record(spark.createDataFrame(rows, "dataset string, run string, state string, at string, note string").selectExpr("dataset", "run", "state", at, "note"))
    put(("a", "r1", "running", "2024-01-01", None), ("a", "r2", "running", "2024-01-02", None), ("b", "r3", "running", "2024-01-01", None))
    put(("a", "r1", "failed", "2024-01-03", "no rows"))
    put(("a", "r2", "success", "2024-01-02", None))
    got = {r["run"]: (r["version"], r["status"], r["note"], str(r["completed"])[:10]) for r in book.runs().collect()}
    assert got == {"r1": (1, "failed", "no rows", "2024-01-03"), "r2": (2, "success", None, "2024-01-02"), "r3": (1, "running", None, "None")}


def test_upload_conflicts_tell_null_places_apart(spark):
    df = spark.createDataFrame([(1, "x", "m", "p"), (2, "x", "m", "p"), (3, "y", "m", None), (4, "y", "m", "p"), (5, "z", "m", "p"), (6, None, "m", "p"), (7, None, "n", "p")], "id int, text string, market string, period string")
    assert sorted((r["first"], r["copies"], r["conflict"]) for r in store.upload_conflicts(df, "text", "id", "market", "period").collect()) == [(1, 2, False), (3, 2, True)]


def test_headers_greedy_and_family_columns():
    from marketloom.operators import files as FI

    names = {"price": ["price", "unit price"], "title": ["title", "标题"]}
    assert FI.greedy_headers(["Unit Price", "商品标题", "Price ($)"], names) == {"price": "Unit Price", "title": "商品标题"}  # both are equal to a synonym: the later name
    sales = {"sales": ["sales", "unit sales"]}
    assert FI.map_headers(["Parent Unit Sales", "Sales"], sales, parent={"sales": ["parent unit sales"]}) == {"sales": "Sales"}
    assert FI.map_headers(["Parent Unit Sales"], sales, parent={"sales": ["parent unit sales"]}) == {}


def test_naming_rules_in_their_order():
    from marketloom.operators import files as FI

    cases = [("Price ($)", "price", 1.0), ("Item_Price", "price", 0.7), ("List Price/Unit", "list price", 0.8), ("商品标题", "标题", 0.75), ("标题 x", "标题", 0.7), ("Retail prise", "retail price", 0.6), ("stock", "price", 0.0), ("商品", "标题", 0.0), ("", "price", 0.0), ("$", "%", 0.0)]
    assert [FI.field_score(h, [s]) for h, s, _ in cases] == [v for *_, v in cases]
    assert FI.field_score("unit price", []) == 0 and FI.field_score("unit price", ["cost", "price"]) == 0.7
