"""Projected embeddings against a version in plain Python, and how near their cosines come."""

import math
import random
from collections import Counter

import pytest
import xxhash

from marketloom.operators import embedding as EM

SCHEMA = "id long, text string"


def grams(text):
    words = text.lower().split()
    out = Counter(("word", w) for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    for w in words:
        padded = f" {w} "
        out.update(("letter", padded[i : i + n]) for n in (3, 4, 5) for i in range(len(padded) - n + 1))
    return out


def plain(text, size, places, seed):
    v = [0] * size
    for (space, gram), tf in grams(text).items():
        for j in range(places):
            h = xxhash.xxh64(f"{seed}:{j}\x1f{space}\x1f{gram}".encode(), seed=42).intdigest()
            signed = h - (1 << 64) if h >> 63 else h
            v[signed % size] += -tf if h >> 63 else tf
    length = math.sqrt(sum(x * x for x in v))
    return [x / length if length else 0.0 for x in v]


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_equals_plain_python_and_keeps_cosines(spark):
    rng = random.Random(2)
    pool = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(60)]
    texts = [" ".join(rng.sample(pool, 12)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "??"), (103, texts[0]), (None, "x"), (0, texts[0])]
    got = {r["id"]: r["embedding"] for r in EM.projected_embedding(spark.createDataFrame(rows, SCHEMA).repartition(4), "id", "text").collect()}
    assert set(got) == {*range(40), 100, 101, 102, 103} and all(len(v) == EM.SIZE for v in got.values())
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(plain(t, EM.SIZE, EM.PLACES, EM.SEED), abs=1e-12)
    assert got[103] == got[0] and not any(got[100]) and not any(got[101]) and not any(got[102])
    errors = []
    for i in range(40):
        for j in range(i):
            a, b = grams(texts[i]), grams(texts[j])
            true = sum(n * b[g] for g, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
            errors.append(cosine(got[i], got[j]) - true)
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 1.5 / math.sqrt(EM.SIZE) and max(map(abs, errors)) < 0.3


def test_empty_and_without_python(spark):
    out = EM.projected_embedding(spark.createDataFrame([], SCHEMA), "id", "text")
    assert out.count() == 0 and "Python" not in out._jdf.queryExecution().toString()


def test_texts_are_shuffled_once_and_nothing_else(spark):
    """A shuffle of grams or of places is many times the texts."""
    rows = [(i, f"some words of text {i}") for i in range(20)]
    out = EM.projected_embedding(spark.createDataFrame(rows, SCHEMA), "id", "text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange" in x and "Broadcast" not in x]
    assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]


def test_words_that_are_not_among_the_broadcast_ones(spark, monkeypatch):
    texts = [(i, f"some words of ünïque{i} text some") for i in range(9)] + [(9, "")]
    df = spark.createDataFrame(texts, SCHEMA)
    got = []
    for n in (0, 3, 1000):
        monkeypatch.setattr(EM, "WORDS", n)
        got.append({r["id"]: r["embedding"] for r in EM.projected_embedding(df, "id", "text").collect()})
    assert got[0] == got[1] == got[2] and got[0][1] == pytest.approx(plain(texts[1][1], EM.SIZE, EM.PLACES, EM.SEED), abs=1e-12)


def test_hashes_and_slices(monkeypatch):
    """a text's grams were rows of their own. Hashes agree at every length, and sums do however words are cut."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    grams = ["".join(rng.choices("abü日\U0001f600", k=rng.randint(0, 40))) for _ in range(300)]
    raw = [g.encode() for g in grams]
    sizes = np.array([len(b) for b in raw])
    place, sign = EM._addends(np.frombuffer(b"".join(raw), "u1"), np.cumsum(sizes) - sizes, sizes, "word", 100, 12, 7)
    for i, b in enumerate(raw):
        for j in range(12):
            h = xxhash.xxh64(f"7:{j}\x1fword\x1f".encode() + b, seed=42).intdigest()
            h -= (h >> 63) << 64
            assert place[i, j] == h % 100 and sign[i, j] == (1 if h >= 0 else -1)
    pool = ["".join(rng.choices("abcü日\U0001f600", k=rng.randint(1, 30))) for _ in range(50)]
    texts = [rng.choices(pool, k=k) for k in (40, 0, 1, 300, 0, 7, 2)]
    for words in (1, 5, 64, 10000):
        monkeypatch.setattr(EM, "WORDS", words)
        got = EM._sums(pa.array(texts, pa.list_(pa.string())), 64, 8, 7).astype(float)
        for v, t in zip(got, texts):
            length = math.sqrt(sum(v * v)) or 1.0
            assert (v / length).tolist() == pytest.approx(plain(" ".join(t), 64, 8, 7), abs=1e-12)
