"""Spelling variants against a brute-force version, with blocks divided down to single letters."""

import random
import re
import zlib
from collections import Counter

import pytest

from marketloom.llm import spelling
from tests.llm import cases
from tests.oracle import check


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    cuts = {}
    for w in words:
        for i in range(len(w)):
            cuts.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    near = {w: set() for w in words}
    for (_, rest), group in cuts.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def texts(seed=3):
    """Words of a common stem with typing errors, chains of forms, a stem that hundreds share, and a very long run."""
    rng = random.Random(seed)
    letters, rows = "abcdeéñst", []
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(30)]
    for k, w in enumerate(base):
        rows += [(k, f"{w} {w.title()} " * 60)]
        for _ in range(12):
            at, kind, c = rng.randrange(len(w)), rng.randrange(3), rng.choice(letters)
            v = w[:at] + (c if kind else "") + w[at + (kind < 2) :]
            rows.append((100 + k, f"{v} {v} " + f"{v[:-1]} {v[:-1]}"))
    rows += [(500, " ".join(f"gleichen{a}{b} gleichen{a}{b}" for a in letters for b in letters) + " gleichen gleichen gleichene " * 40)]
    rows += [(501, "strassenbahn " * 1000 + "strasenbahn " * 100 + "strasenbah " * 10), (None, "nullwort nullworte nullwort nullworte"), (502, None), (503, ""), (504, " 12 ×÷×÷×÷× ×÷×÷×÷× ")]
    rows += [(505, ("q" * 3000 + " ") * 3 + ("q" * 1500 + "z" + "q" * 1499 + " ") * 2 + ("q" * 3001 + " ") * 2)]
    return [*rows, rows[3], rows[3]]


@pytest.mark.parametrize("block", [4, 256])
def test_equals_brute_force(spark, block):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "k", 2, "b", 3) for r in rows], "doc_id long, text string, n int, key string, kind int, word string, near int")
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.spelling_variants(docs, block=block).collect()}
    expected = brute(rows)
    assert found == expected
    assert sum(1 for w, x in expected.items() if x[0] and x[0] != x[1]) > 0, "a chain of forms"
    assert sum(x[3] > 12 for x in expected.values()) > 3, "a crowded block"


def test_case_documents_and_no_documents(spark):
    rows, docs = cases.documents(spark)
    found = {r["word"]: r["n_near"] for r in spelling.spelling_variants(docs).collect()}
    assert found == {w: x[3] for w, x in brute((r[0], r[1]) for r in rows).items()}
    assert spelling.spelling_variants(cases.empty(spark)).count() == 0


def test_blocks_stay_small_and_pairs_meet_once(spark):
    words = spark.createDataFrame([("pre" + "".join(x), 2) for x in {tuple(random.Random(i).choices("abcd", k=5)) for i in range(900)}], "word string, n long")
    sizes = spelling.blocks(words, most=16).groupBy("key", "start", "end").count().collect()
    assert max(r["count"] for r in sizes if r["end"] - r["start"] > 1) <= 16
    found = spelling.near_counts(spelling.blocks(words, most=16)).groupBy("word").sum("near").collect()
    all_words = [r["word"] for r in words.collect()]
    expected = {w: sum(sum(a != b for a, b in zip(w, o, strict=True)) == 1 for o in all_words) for w in all_words}
    assert {r[0]: r[1] for r in found} == {w: n for w, n in expected.items() if n}


def test_one_edit():
    assert spelling.one_edit("abcdefg", "abcdxfg") == 4 and spelling.one_edit("abcdefg", "abcdefgh") == 7 and spelling.one_edit("aab", "ab") == 1
    assert spelling.one_edit("abc", "abc") == -1 and spelling.one_edit("abc", "acb") == -1 and spelling.one_edit("abc", "abcde") == -1


def test_sql(spark):
    check(spark, spelling.op11_spelling_variants, spelling.SQL["op11_spelling_variants"])
