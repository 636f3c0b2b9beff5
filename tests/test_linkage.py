"""Average linkage in rounds against one merge after the other."""

import math
import random
from collections import Counter

from marketloom.operators import linkage as L

SCHEMA = "id long, seg string, title string"


def unit(texts):
    grams = []
    for t in texts:
        w = t.lower().split()
        grams.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(g for c in grams for g in c)
    out = []
    for c in grams:
        v = {g: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        out.append({g: x / size for g, x in v.items()})
    return out


def one_by_one(ids, texts, distance=0.75):
    """Sums of cosines per pair of clusters; the best pair merges, ties by the smaller and then the larger id."""
    vs, sums, size = unit(texts), {}, dict.fromkeys(ids, 1)
    for i, a in enumerate(ids):
        for j in range(i):
            sums[frozenset((a, ids[j]))] = sum(x * vs[j].get(g, 0.0) for g, x in vs[i].items())
    group = {i: [i] for i in ids}
    while len(group) > 1:
        key = lambda p: (-round(sums[p] / math.prod(size[i] for i in p), 9), min(p), max(p))
        best = min(sums, key=key)
        if -key(best)[0] <= 1 - distance:
            break
        a, b = min(best), max(best)
        for c in group:
            if c not in best:
                sums[frozenset((a, c))] += sums.pop(frozenset((b, c)))
        del sums[best]
        size[a] += size[b]
        group[a] += group.pop(b)
    return {i: a for a, members in group.items() for i in members}


def texts(rng, n, words):
    return [" ".join(f"w{int(rng.paretovariate(0.8)) % words}" for _ in range(rng.randint(1, 5))) for _ in range(n)]


def expected(rows):
    out = {}
    for seg in {r[1] for r in rows}:
        of = sorted(r for r in rows if r[1] == seg)
        out |= one_by_one([r[0] for r in of], [r[2] for r in of])
    size = Counter(out.values())
    return {i: (c if size[c] >= 2 else None, size[c]) for i, c in out.items()}


def run(spark, rows):
    return {r["id"]: (r["model"], r["products"]) for r in L.title_models(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", "seg", "title").collect()}


def test_equals_one_merge_after_the_other(spark):
    rng = random.Random(3)
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(texts(rng, 300, 60))]
    got = run(spark, rows)
    assert got == expected(rows)
    assert len({m for m, _ in got.values()}) > 10


def test_copies_nulls_and_words_that_all_share(spark):
    rows = [(i, "a", f"steel bolt x{i // 3}") for i in range(12)] + [(20, "a", "steel bolt x0"), (21, "a", "bolt steel x0"), (22, "b", "steel bolt x0")]
    got = run(spark, rows + [(30, "a", None), (31, "a", ""), (None, "a", "steel"), (40, None, "lamp"), (41, None, "lamp"), (0, "a", "steel bolt x0")])
    whole = [r if r[1] else (r[0], "(none)", r[2]) for r in rows] + [(30, "a", ""), (31, "a", ""), (40, "(none)", "lamp"), (41, "(none)", "lamp")]
    assert got == expected(whole)
    assert got[30] == got[31] == (None, 1) and got[40] == got[41] == (40, 2) and got[22] == (None, 1)
    assert run(spark, [(1, "a", "one"), (2, "a", "two")]) == {1: (None, 1), 2: (None, 1)}
    assert L.title_models(spark.createDataFrame([], SCHEMA), "id", "seg", "title").count() == 0


def test_rounds_are_few(spark, monkeypatch):
    rounds, once = [], L._nearest
    monkeypatch.setattr(L, "_nearest", lambda *a: (rounds.append(1), once(*a))[1])
    rows = [(i, "a", f"k{i % 50} m{i % 50} n{i}") for i in range(600)]
    got = run(spark, rows)
    assert {n for _, n in got.values()} == {12} and len(rounds) < 20
