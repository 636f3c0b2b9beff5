"""Small documents with every awkward row: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, salt string, _id long, _key string, lines string, copies int, whole string, label string"
EXTRA = (7, 1, "s", 9, "k", "l", 2, "w", "x")


def prose(rng: random.Random, words: int, marks: bool = True) -> str:
    stems = ["ka", "lo", "mi", "ter", "sun", "vor", "del", "pra", "qui", "non", "est", "ru"]
    out = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    if marks:
        for k in range(9, words, 10):
            out[k] += "." if k % 20 else ".\n"
    return " ".join(out).replace("\n ", "\n")


def documents(spark, seed: int = 5, plain: int = 40):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(55, 160)), "en" if i % 2 else "de", f"s{i % 3}", 10) for i in range(plain)]
    base = rows[3][1]
    rows += [(100 + i, base, "en", "s0", 10) for i in range(6)]  # exact copies
    rows += [(110 + i, base.replace("ka", f"ka{'x' * i}", 1), "de", "s1", 10) for i in range(1, 6)]  # near copies
    shared = prose(rng, 30, False)
    rows += [(120 + i, prose(rng, 60) + "\n" + shared + "\n" + prose(rng, 60), "en", "s2", 10) for i in range(14)]  # a passage that many share
    rows += [(140 + i, prose(rng, 60) + f"\nPage {i} of 14 printed on day {i * 7}\n" + prose(rng, 20), "de", "s1", 10) for i in range(14)]  # a template with fields
    rows += [(200, None, "en", "s0", None), (201, "", None, None, 0), (202, " \n\t ", "en", "s0", 4), (203, "one", "en", None, 3), (204, "!!! 12 ???", "en", "s0", 9)]
    rows += [(205, "again and again " * 40, "en", "s0", 600), (206, prose(rng, 30000), "en", "s0", 1), (207, "x" * 50000, None, "s9", 1), (208, "Ünï cödé ß   İstanbul 漢字 🙂 " * 12, "de", "s1", 1)]
    rows += [(7, rows[7][1], "en", "s1", 10), (209, "é" * 300, "fr", "s1", 300), (210, "line\nline\nline\n" * 30, "en", "s2", 1)]  # row 7 comes twice
    return rows, spark.createDataFrame([r + EXTRA for r in rows], COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
