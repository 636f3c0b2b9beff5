"""Families split at once against planted groups and a silhouette over all pairs."""

import math
import random
from collections import Counter, defaultdict

import pytest

from marketloom.operators import families as FA

SCHEMA = "id long, cat string, title string, family int"
TOPICS = (("laser", "toner", "ink"), ("garden", "hose", "spray"), ("guitar", "string", "pick"))


def vectors(texts):
    words = [Counter(t.lower().split()) for t in texts]
    df = Counter(w for c in words for w in c)
    out = []
    for c in words:
        v = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({w: x / size for w, x in v.items()})
    return out


def cosine(a, b):
    return sum(x * b.get(w, 0.0) for w, x in a.items())


def silhouette(texts, labels):
    vs, total = vectors(texts), 0.0
    for i, v in enumerate(vs):
        gaps = defaultdict(list)
        for j, other in enumerate(vs):
            if i != j:
                gaps[labels[j]].append(1 - cosine(v, other))
        mean = {c: sum(g) / len(g) for c, g in gaps.items()}
        if v and labels[i] in mean and len(mean) > 1:
            own, near = mean[labels[i]], min(m for c, m in mean.items() if c != labels[i])
            total += (near - own) / max(own, near) if max(own, near) > 0 else 0.0
    return total / len(vs)


def planted():
    rng, rows = random.Random(4), []
    for i in range(60):
        topic = TOPICS[i % 3]
        rows.append((i, "mixed", " ".join(rng.sample(topic, 2) + [f"n{rng.randrange(200)}"]), 1))
    rows += [(100 + i, "plain", "steel bolt " + f"n{i}", 1) for i in range(20)]
    rows += [(200 + i, "few", " ".join(TOPICS[i % 3]), 1) for i in range(6)]
    rows += [(300 + i, "odd", "laser toner", 1) for i in range(14)] + [(320, "odd", None, 1), (321, "odd", "", 1), (322, "odd", "??", 1)]
    return rows + [(400, None, "hose", 1), (None, "mixed", "hose", 1), (0, *rows[0][1:])]


def test_planted_groups_split_and_others_stay(spark):
    rows = planted()
    out = {r["id"]: r for r in FA.split_families(spark.createDataFrame(rows, SCHEMA).repartition(5), "id", "cat", "title").collect()}
    assert set(out) == {r[0] for r in rows} - {None}
    for t in range(3):
        assert len({out[i]["segment"] for i in range(t, 60, 3)}) == 1
    assert {out[i]["segment"] for i in range(60)} == {0, 1, 2} and out[0]["segments"] == 3
    texts = [r[2] for r in rows[:60]]
    assert out[0]["silhouette"] == pytest.approx(silhouette(texts, [out[i]["segment"] for i in range(60)]), abs=1e-9)
    vs = vectors(texts)
    mates = [vs[i] for i in range(60) if out[i]["segment"] == out[0]["segment"]]
    centre = Counter()
    for v in mates:
        centre.update(v)
    assert out[0]["confidence"] == pytest.approx(cosine(vs[0], centre) / math.sqrt(sum(x * x for x in centre.values())), abs=1e-9)
    for i in (100, 119, 200, 205, 400):
        assert (out[i]["segment"], out[i]["segments"], out[i]["confidence"]) == (0, 1, 1.0)
    assert out[200]["silhouette"] is None and out[400]["family"] == FA.NO_FAMILY
    assert {out[i]["segments"] for i in (300, 320, 321, 322)} == {1}


def test_small_classes_join_the_nearest_and_silhouettes_hold(spark):
    """Random texts: whatever is chosen, the reported silhouette is that of the segments, no segment is below the least size."""
    rng = random.Random(11)
    rows = [(i, f"f{i % 3}", " ".join(f"w{int(rng.paretovariate(1))}" for _ in range(4)), 1) for i in range(150)]
    found = FA.split_families(spark.createDataFrame(rows, SCHEMA), "id", "cat", "title", bound=-1.0).collect()
    for f in ("f0", "f1", "f2"):
        of = {r["id"]: r for r in found if r["family"] == f}
        ids, sizes = sorted(of), Counter(r["segment"] for r in of.values())
        if len(sizes) > 1:
            assert of[ids[0]]["silhouette"] == pytest.approx(silhouette([rows[i][2] for i in ids], [of[i]["segment"] for i in ids]), abs=1e-9)
        assert min(sizes.values()) >= 3 and set(sizes) == set(range(len(sizes)))


def test_empty_and_no_family_gathered(spark):
    assert FA.split_families(spark.createDataFrame([], SCHEMA), "id", "cat", "title").count() == 0
    plan = FA.split_families(spark.createDataFrame(planted(), SCHEMA), "id", "cat", "title")._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "Python" not in plan and "Window" not in plan


def test_copies_are_one_row_and_weigh_what_they_count(spark, monkeypatch):
    """Texts that repeat are held once, and the silhouette is still that of all rows."""
    rng, sizes, keep = random.Random(9), {}, FA.materialize
    kinds = [" ".join(rng.sample(TOPICS[i % 3], 2) + [f"n{i}"]) for i in range(12)]
    rows = [(i, "a", kinds[min(rng.randrange(12), rng.randrange(12))], 1) for i in range(240)]

    def kept(df, tag):
        out = keep(df, tag)
        sizes.setdefault(tag, out.count() if tag in ("words", "alike") else None)
        return out

    monkeypatch.setattr(FA, "materialize", kept)
    out = {r["id"]: r for r in FA.split_families(spark.createDataFrame(rows, SCHEMA), "id", "cat", "title", bound=-1.0).collect()}
    assert sizes["alike"] == len({t for _, _, t, _ in rows}) and sizes["words"] <= 3 * sizes["alike"]
    assert set(out) == set(range(240))
    assert math.isclose(out[0]["silhouette"], silhouette([r[2] for r in rows], [out[r[0]]["segment"] for r in rows]), abs_tol=1e-9)
