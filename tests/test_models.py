"""Planted and brute-force cases of models and of schema evidence."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import files as FI
from marketloom.operators import graph as G
from marketloom.operators import models as MO


@pytest.mark.parametrize("seed", range(5))
def test_assignment_is_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    cost = rng.integers(0, 20, size=(4, 6)).astype("f8")
    best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(6), 4))
    got = FI.assign(cost)
    assert [i for i, _ in got] == [0, 1, 2, 3] and len({j for _, j in got}) == 4
    assert sum(cost[i, j] for i, j in got) == best


def test_headers_map_one_to_one():
    aliases = {"title": ["product name"], "price": ["cost", "price usd"], "id": ["asin"]}
    assert FI.map_headers(["Product Name", "Price", "Weight", "ASIN"], aliases) == {"title": "Product Name", "price": "Price", "id": "ASIN"}
    assert FI.map_headers(["a", "Weird"], {"price": ["cost"]}) == {}
    assert FI.map_headers(["Weird", "cost"], {"price": ["cost"]}, pinned={"price": "Weird"}) == {"price": "Weird"}


def test_header_row_is_found(spark):
    df = spark.createDataFrame([("Report", None), ("keyword", "searches"), ("ring", "12")], "a string, b string").coalesce(1)
    assert FI.header_row(df, {"keyword": [], "searches": []}) == 1


def test_request_in_words():
    assert FI.parse_request("red ring under $50 with 4 stars") == {"max_price": 50.0, "min_rating": 4.0, "keywords": ["red", "ring"]}
    assert FI.parse_request("bolts 10 to 20") == {"min_price": 10.0, "max_price": 20.0, "keywords": ["bolts"]}


def test_units_take_the_largest(spark):
    df = spark.createDataFrame([("2 kg or 500g",), ("3oz",), ("none",)], "t string")
    assert [r[0] for r in df.select(FI.best_unit("t", "gram")).collect()] == [2000.0, pytest.approx(85.0485), None]


def test_pages_without_scripts(spark):
    df = spark.createDataFrame([(1, "<title>A &amp; b</title><script>x</script><p>hi <a href=q>there</a></p>"), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in FI.parse_pages(df).collect()] == [(1, "A & b", 1, "hi there"), (2, "", 0, "")]


def test_planted_outliers_score_highest(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(50, 3), rng.gauss(20, 2)) for i in range(400)] + [(900, 5000.0, 1.0), (901, 1.0, 9000.0), (902, None, 5.0)]
    got = MO.outlier_scores(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"]).orderBy(F.desc("score")).collect()
    assert {r["id"] for r in got[:2]} == {900, 901} and len(got) == 402


def test_density_groups_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, g, rng.gauss(c, 0.5), rng.gauss(c, 0.5)) for i, (g, c) in enumerate([("g", 0)] * 25 + [("g", 8)] * 25 + [("h", 0)] * 20)] + [(99, "g", 50.0, 50.0), (100, "h", None, 1.0)]
    got = {r["id"]: r["cluster"] for r in MO.density_groups(spark.createDataFrame(rows, "id long, g string, x double, y double"), "id", "g", ["x", "y"], 0.8).collect()}
    near = {i: [j for j, h, p, q in rows if g == h and p is not None and (x - p) ** 2 + (y - q) ** 2 <= 0.64] for i, g, x, y in rows if x is not None}
    core = {i for i, n in near.items() if len(n) >= 4}
    seen, label = set(), {}
    for i in sorted(core):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                label[k] = i
                todo += [j for j in near[k] if j in core]
    expected = {i: min((label[j] for j in near.get(i, []) if j in core), default=-1) for i, *_ in rows}
    assert got == expected


def test_bootstrap_covers_the_mean_and_agrees_with_itself(spark):
    rng = random.Random(4)
    rows = [(i, "g", rng.gauss(10, 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    a, b = MO.bootstrap_mean(df, "id", "g", "v").first(), MO.bootstrap_mean(df.repartition(9), "id", "g", "v").first()
    mean = sum(r[2] for r in rows) / 500
    assert a["low"] < mean < a["high"] and a["high"] - a["low"] == pytest.approx(4 * 2 / 500**0.5, rel=0.3)
    assert a["low"] == pytest.approx(b["low"]) and a["high"] == pytest.approx(b["high"])


def test_dominant_offer_is_always_best(spark):
    df = spark.createDataFrame([("g", 4.0, 0.5)], "g string, m double, s double")
    got = {r["offer"]: r["p_best"] for r in MO.compare_launches(df, "g", "m", "s", [("bad", 100.0, 99.0), ("good", 100.0, 10.0)]).collect()}
    assert got == {"bad": 0.0, "good": 1.0}


def test_relevance_without_labels_is_the_rule_score(spark):
    df = spark.createDataFrame([(1, "a b", 0.3), (2, "c", 0.9)], "id long, t string, base double")
    none = spark.createDataFrame([], "id long, label int")
    assert sorted(tuple(r) for r in MO.blended_relevance(df, none, "id", "t", "base").collect()) == [(1, 0.3), (2, 0.9)]


def test_graph_steps_and_costs(spark):
    e = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", None), ("a", "c", "r", 0.0), ("c", "d", "r", 1.0)], "src string, dst string, rel string, strength double")
    assert dict(map(tuple, G.neighbourhood(e, spark.createDataFrame([("a",)], "id string"), 2).collect())) == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert dict(map(tuple, G.cheapest_paths(e, "a", 3).collect())) == {"a": 0.0, "b": 1.0, "c": 2.0, "d": 3.0}


def test_a_kmeans_takes_equal_texts_once_and_no_table_in_one_task(spark, monkeypatch):
    """Copies weigh what they count and aren't fitted apart; a table that comes as one part is fitted in several; a rerun agrees."""
    topics = ("laser toner ink", "garden hose spray")
    rows = [(i, f"{topics[i % 2]} n{i % 40}") for i in range(400)]
    df, seen = spark.createDataFrame(rows, "id long, title string").coalesce(1), []

    class Watched(MO.KMeans):
        def fit(self, vec):
            seen.append([len(p) for p in vec.select("title", "_copies").rdd.glom().collect()])
            return super().fit(vec)

    monkeypatch.setattr(MO, "KMeans", Watched)
    monkeypatch.setattr(MO, "PART", 10)
    runs = [{r["id"]: r["cluster"] for r in MO.best_kmeans(df, "id", "title").collect()} for _ in range(2)]
    assert runs[0] == runs[1] and set(runs[0]) == set(range(400))
    assert all(sum(parts) == 40 and max(parts) < 40 for parts in seen)
    of = {t: {runs[0][i] for i in range(t, 400, 2)} for t in (0, 1)}
    assert not of[0] & of[1], "topics share no cluster"
    assert all(len({runs[0][i] for i in range(n, 400, 40)}) == 1 for n in range(40))
