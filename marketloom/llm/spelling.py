"""Spelling variants: words within one edit, by forward and reversed sorted dictionaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Letters of a word, its least code points and occurrences, and how much more frequent a form must be.
LETTERS, SHORTEST, LEAST, RATIO = r"A-Za-zÀ-ÿ", 7, 2, 10
#: One run in so many loses a letter, by its hash.
DELETED = 31
#: Words that a block may hold before it is divided, and code points of a window up to which pairs are compared in arrays.
BLOCK, WIDE = 256, 48
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, deleted: int = DELETED) -> DataFrame:
    """word, n: runs of letters, A-Z lower-cased; where ``deleted`` divides the CRC-32 of ``<doc_id>:<run>``, the letter at hash % length is taken out.

    Runs shorter than ``shortest`` can't make a word and are never cut out of the text; a null id is written as nothing.
    """
    run = F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = runs.withColumn("h", hashed).select(F.when(F.col("h") % deleted == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _block_key(word: Column, kind: Column, start: Column, end: Column) -> Column:
    """What the words of a block share: all before ``start``, and of a word of ``kind`` code points all from ``end``."""
    tail = kind - end
    return F.concat_ws(":", kind, start, end, word.substr(F.lit(1), start), F.when(tail > 0, word.substr(F.length(word) - tail + 1, tail)).otherwise(""))


def halves(words: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """key, kind, start, end, word, n: each word in the blocks of both dictionaries.

    Words within one edit have ``kind`` letters, or one of them has one more. If they first differ in the second half of ``kind``,
    they share its first half, else all behind it. So the forward dictionary has blocks of a shared first half, the reversed one
    of a shared second half, and a word stands in both under its own length and under one less.
    """
    kinds = F.array(F.length("word"), F.length("word") - 1)
    each = words.select("word", "n", F.explode(kinds).alias("kind")).where(F.col("kind") >= shortest)
    half = F.floor(F.col("kind") / 2).cast("int")
    windows = F.array(F.struct(half.alias("start"), F.col("kind").alias("end")), F.struct(F.lit(0).alias("start"), half.alias("end")))
    each = each.withColumn("w", F.explode(windows)).select("kind", "w.start", "w.end", "word", "n")
    return each.withColumn("key", _block_key(F.col("word"), F.col("kind"), F.col("start"), F.col("end")))


def _divided(rows: DataFrame) -> DataFrame:
    """The same words in two blocks each: the window where they may differ is cut in half, so that the rest of it is shared too."""
    middle = F.floor((F.col("start") + F.col("end")) / 2).cast("int")
    windows = F.array(F.struct("start", middle.alias("end")), F.struct(middle.alias("start"), "end"))
    each = rows.withColumn("w", F.explode(windows)).select("kind", "w.start", "w.end", "word", "n")
    return each.withColumn("key", _block_key(F.col("word"), F.col("kind"), F.col("start"), F.col("end")))


def blocks(words: DataFrame, shortest: int = SHORTEST, most: int = BLOCK) -> DataFrame:
    """Blocks as ``halves`` gives them; those above ``most`` words are divided, again and again, until the window is one letter.

    Each pair of near words shares exactly one block whose window holds the place where they first differ, so nothing is lost or
    found twice. A window of one letter holds no more words than there are letters (and pairs of letters) to put there.
    """
    todo, done = halves(words, shortest), []
    while True:
        big = materialize(todo.where("end - start > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).select("key"), "big")
        if big.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(big, "key", "left_anti"))
        todo = materialize(_divided(todo.join(big, "key", "left_semi")), "blocks")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def one_edit(a: str, b: str) -> int:
    """Where two words first differ if one insertion, deletion or replacement makes ``b`` of ``a``, else -1."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if len(b) - len(a) > 1 or a == b:
        return -1
    low, high = 0, len(a)  # of the shared prefix
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low if a[low + (len(a) == len(b)) :] == b[low + 1 :] else -1


def _hits(keys: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of sorted blocks that are near and first differ inside their block's window."""
    size, extra = np.array([len(w) for w in words]), None
    extra, width = size - kind, end - start
    fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:], len(keys)) - 1
    last = last[np.cumsum(fresh) - 1]
    left, right = [], []
    narrow = width < WIDE
    inside = [w[s : s + n + x] if k else "" for w, s, n, x, k in zip(words, start, width, extra, narrow, strict=True)]
    letters = np.array(inside, dtype=f"U{int((width[narrow] + 1).max(initial=1)) + 1}")
    letters = letters.view("u4").reshape(len(words), -1)
    place = np.arange(letters.shape[1])
    for shift in range(1, int((last - np.arange(len(keys))).max(initial=0)) + 1):
        r = np.flatnonzero((last - np.arange(len(keys)) >= shift) & narrow)
        for at in range(0, len(r), 50_000):
            a = r[at : at + 50_000]
            b = a + shift
            same = (extra[a] == 0) & (extra[b] == 0)
            x, y = a[same], b[same]
            one = (letters[x] != letters[y]).sum(axis=1) == 1
            left.append(x[one])
            right.append(y[one])
            mixed = extra[a] + extra[b] == 1
            x, y = np.where(extra[a] == 0, a, b)[mixed], np.where(extra[a] == 0, b, a)[mixed]  # the shorter, the longer
            n = width[x][:, None]
            differs = letters[x] != letters[y]
            shared = differs.argmax(axis=1)  # the longer one has a letter where the shorter has none
            behind = (letters[x][:, :-1] != letters[y][:, 1:]) & (place[:-1] >= shared[:, None]) & (place[:-1] < n)
            good = ~behind.any(axis=1) & ((shared < n[:, 0]) | (end[x] == kind[x]))
            left.append(x[good])
            right.append(y[good])
    for a in np.flatnonzero(~narrow):
        for b in range(a + 1, last[a] + 1):
            if extra[a] + extra[b] < 2 and start[a] <= (at := one_edit(words[a], words[b])) and (at < end[a] or end[a] == kind[a]):
                left.append(np.array([a]))
                right.append(np.array([b]))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def near_counts(blocked: DataFrame) -> DataFrame:
    """word, near, best: for each word and block the near words there, how many, and the most frequent (ties: the smallest).

    Both dictionaries are sorted, each task scans a range of keys, and a block is compared in arrays as it goes by. What leaves a
    task is a row for a word and block, never the pairs.
    """

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        words, n = part["word"].to_numpy(object), part["n"].to_numpy("i8")
        a, b = _hits(part["key"].to_numpy(object), *(part[c].to_numpy("i8") for c in ("kind", "start", "end")), words)
        one, other = np.concatenate([a, b]), np.concatenate([b, a])
        found = pd.DataFrame({"row": one, "n": -n[other], "other": words[other]}).sort_values(["row", "n", "other"], kind="stable")
        found = found.assign(near=found.groupby("row")["row"].transform("size")).drop_duplicates("row")
        return pd.DataFrame({"word": words[found["row"].to_numpy()], "near": found["near"].to_numpy("i8"), "best_n": -found["n"].to_numpy("i8"), "best": found["other"].to_numpy(object)})

    def scan(batches):
        kept = None
        for part in batches:
            part = part if kept is None else pd.concat([kept, part], ignore_index=True)
            cut = int((part["key"] != part["key"].iloc[-1]).to_numpy().sum()) if len(part) else 0
            kept = part.iloc[cut:]
            if cut:
                yield verify(part.iloc[:cut])
        if kept is not None and len(kept):
            yield verify(kept)

    ordered = blocked.repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInPandas(scan, "word string, near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word with a form: where following forms ends. Paths double in each round; a form is ten times as frequent, so they are short."""
    hops = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(hops.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        hops = step.select("word", "root")
        if step.where("moved").isEmpty():
            return hops


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, deleted: int = DELETED, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus.

    Words are counted by Spark; copies and frequent words meet in a count. Null and empty texts hold no words, a text or a run of
    any length counts whole, repeated rows count again, a null id hashes as an empty one, ties go to the smaller word by code
    point, other columns are ignored, an empty table gives an empty one.
    """
    words = materialize(word_counts(docs, shortest, least, deleted), "words")
    found = near_counts(blocks(words, shortest, block)).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
    kept = -F.col("b.n") >= ratio * F.col("n")
    forms = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(kept, F.col("b.best")).alias("form"), F.when(kept, -F.col("b.n")).alias("form_n"))
    forms = materialize(forms, "forms")
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_sql() -> str:
    return f"""
    WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256) r(i))),
    runs AS (SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{SHORTEST},}}')) AS r FROM documents) GROUP BY ALL),
    bytes AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
    hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
               FROM bytes, crc),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % {DELETED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
          WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
    cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
    pairs AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM w a JOIN cut b ON b.rest = a.word UNION SELECT b.word, a.word, a.n FROM w a JOIN cut b ON b.rest = a.word),
    best AS (SELECT word, n, other, count(*) OVER (PARTITION BY word) AS n_near FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, other) = 1),
    f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= {RATIO} * w.n THEN other END AS form, CASE WHEN b.n >= {RATIO} * w.n THEN b.n END AS form_n FROM w LEFT JOIN best b ON b.word = w.word),
    up AS (SELECT word, word AS at FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, up.at AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word JOIN f g ON g.word = up.at AND g.form IS NULL
    """


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
SQL = {"op11_spelling_variants": op11_sql()}
