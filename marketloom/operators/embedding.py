"""Texts as short dense vectors without a vocabulary: hashed n-grams under a seeded sparse projection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators.ngrams import words_of

#: Length of a vector, how many of its places a gram falls on, and the seed of the draws.
SIZE, PLACES, SEED = 256, 8, 7
#: Texts that a task takes, and words that it works out at once.
TEXTS, WORDS = 500, 1 << 16
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc, word: np.ndarray) -> np.ndarray:
    return _turned(acc + word * _P2, 31) * _P1


def _xxh64(words: list[np.ndarray], n: int, seed: int = 42) -> np.ndarray:
    """XXH64, as ``xxhash64`` has it, of strings of ``n`` bytes, each in little-endian words that zeros fill up. Words may be of any shapes that go together."""
    s, at = np.uint64(seed), 0
    with np.errstate(over="ignore"):
        h = s + _P5
        if n >= 32:
            lanes = [s + _P1 + _P2, s + _P2, s, s - _P1]
            for at in range(0, n // 32 * 4, 4):
                lanes = [_round(v, w) for v, w in zip(lanes, words[at : at + 4])]
            at += 4
            h = sum((_turned(v, r) for v, r in zip(lanes[1:], (7, 12, 18))), _turned(lanes[0], 1))
            for v in lanes:
                h = (h ^ _round(np.uint64(0), v)) * _P1 + _P4
        h = h + np.uint64(n)
        for w in words[at : n // 8]:
            h = _turned(h ^ _round(np.uint64(0), w), 27) * _P1 + _P4
        if n % 8:
            rest, left = words[n // 8], n % 8
            if left >= 4:
                h = _turned(h ^ ((rest & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            for i in range(left // 4 * 4, left):
                h = _turned(h ^ (((rest >> np.uint64(8 * i)) & np.uint64(255)) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _addends(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, space: str, size: int, places: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The drawn places of grams, and their signs (grams by draws). A gram is ``sizes`` bytes of ``text``."""
    place, sign = np.empty((len(starts), places), "i4"), np.empty((len(starts), places), "i1")
    heads: dict[int, list[int]] = {}
    for j in range(places):
        heads.setdefault(len(f"{seed}:{j}\x1f{space}\x1f"), []).append(j)
    order = np.argsort(sizes.astype("u2") if len(sizes) and sizes.max() < 1 << 16 else sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for own in (order[x:y] for x, y in zip(edges, edges[1:])):
        n = int(sizes[own[0]])
        for before, draws in heads.items():
            whole = np.zeros((len(own), -(-(before + n) // 8) * 8), "u1")
            whole[:, before : before + n] = text[starts[own][:, None] + np.arange(n)]
            first = np.zeros((len(draws), whole.shape[1]), "u1")
            first[:, :before] = [list(f"{seed}:{j}\x1f{space}\x1f".encode()) for j in draws]
            words = [np.ascontiguousarray(w) for w in whole.view("<u8").T]
            lead = -(-before // 8)
            words[:lead] = [w[:, None] | f for w, f in zip(words, first.view("<u8").T[:lead])]
            h = _xxh64([w if w.ndim == 2 else w[:, None] for w in words], before + n).view("i8")
            place[own[:, None], draws], sign[own[:, None], draws] = h % size, np.where(h >= 0, 1, -1)
    return place, sign


def _joined(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words with a blank before each and after the last, and where each begins and ends."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], "i4"), words.cast("binary")), b" ")[0]
    text = np.frombuffer(b" " + whole.as_py() + b" ", "u1")
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype("i8")
    ends = np.cumsum(sizes + 1)
    return text, ends - sizes, ends


def _word_sums(words: pa.Array, rows: np.ndarray, n: int, size: int, places: int, seed: int) -> np.ndarray:
    """What words add with their letters, as ``word_letters`` has them with blanks around it, each to its row: ``n`` by ``size`` numbers."""
    text, starts, ends = _joined(words)
    found = [(np.arange(len(words)), *_addends(text, starts, ends - starts, "word", size, places, seed))]
    at = np.flatnonzero((text & 0xC0) != 0x80)  # where characters begin
    chars = np.append(at, len(text))
    first, last = np.searchsorted(at, starts - 1), np.searchsorted(at, ends) + 1
    # the eight bytes from each place on
    ahead, eight = np.append(text, np.zeros(8, "u1")), np.zeros(len(text), "u8")
    for i in range(8):
        eight |= ahead[i : i + len(text)].astype("u8") << np.uint64(8 * i)
    for m in (3, 4, 5):
        runs = np.maximum(last - first - m + 1, 0)
        word = np.repeat(np.arange(len(words)), runs)
        begin = np.repeat(first - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
        s, sizes = chars[begin], chars[begin + m] - chars[begin]
        # few letters differ: of up to 8 bytes each is worked out once
        short = sizes <= 8
        packed = eight[s[short]] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (np.uint64(8) - sizes[short].astype("u8"))))
        _, one, back = np.unique(packed, return_index=True, return_inverse=True)
        place, sign = _addends(text, s[short][one], sizes[short][one], "letter", size, places, seed)
        found.append((word[short], place[back], sign[back]))
        if not short.all():
            found.append((word[~short], *_addends(text, s[~short], sizes[~short], "letter", size, places, seed)))
    word, place, sign = (np.concatenate(x) for x in zip(*found))
    return np.bincount(((rows * size).astype("i4" if n * size < 1 << 31 else "i8")[word][:, None] + place).ravel(), sign.ravel(), n * size).astype("i4").reshape(n, size)


def _sums(words: pa.ListArray, size: int, places: int, seed: int) -> np.ndarray:
    """The whole sums of texts (lists of words), by ``size``; ``WORDS`` words at once, however long a text is."""
    of = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    flat, out, step = words.flatten(), np.zeros((len(words), size), "i8"), max(1, WORDS)
    for a in range(0, len(flat), step):
        b = min(len(flat), a + step)
        coded = flat.slice(a, b - a).dictionary_encode()
        index, low = coded.indices.to_numpy(zero_copy_only=False), int(of[a])
        text, n = of[a:b] - low, int(of[b - 1]) + 1 - low
        # a word that stands once adds to its text, any other to a row of its own, which its texts take
        single = np.bincount(index, minlength=len(coded.dictionary)) == 1
        rows = np.where(single, 0, n - 1 + np.cumsum(~single))
        rows[index[single[index]]] = text[single[index]]
        sums = _word_sums(coded.dictionary, rows, n + int((~single).sum()), size, places, seed)
        out[low : low + n] += sums[:n]
        again = np.flatnonzero(~single[index])
        edges = np.flatnonzero(np.diff(text[again], prepend=-1, append=-1))
        taken = rows[index[again]]
        for x, y in zip(edges.tolist(), edges[1:].tolist()):
            for at in range(x, y, 4096):
                out[low + text[again[x]]] += np.add.reduce(sums[taken[at : min(y, at + 4096)]], axis=0, dtype="i4")
        # a word, a blank and the next word of its text stand together in the joined words
        bytes_, starts, ends = _joined(flat.slice(a, b - a + 1))
        pair = np.flatnonzero(of[a : b + 1][1:] == of[a : b + 1][:-1])
        place, sign = _addends(bytes_, starts[pair], ends[pair + 1] - starts[pair], "word", size, places, seed)
        sums = np.bincount((text[pair][:, None] * size + place).ravel(), sign.ravel(), n * size)
        out[low : low + n] += sums.astype("i8").reshape(n, size)
    return out


def projected_embedding(df: DataFrame, key: str, text: str, size: int = SIZE, places: int = PLACES, seed: int = SEED) -> DataFrame:
    """(key, embedding): words, pairs of words and runs of 3 to 5 letters by count, at length one, then projected to ``size`` numbers and
    at length one again.

    The projection is never stored: a gram falls on ``places`` drawn places with drawn signs, from the XXH64 of seed, draw and gram, so
    vectors agree between tables and runs. The cosine of two vectors estimates that of their grams with a standard error of about
    1 / sqrt(size). A text without words, or null, has zeros; equal texts have equal vectors; null keys are left out, equal rows count once and a
    key is in one row.

    Texts are dealt by key once, ``TEXTS`` to a task, and nothing else is shuffled. A task splits them in Spark and works out its grams in Arrow
    batches: a word with its letters once for ``WORDS`` words, pairs of words where they stand. A text is held as its words and its ``size`` numbers."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition(max(1, -(-df.count() // TEXTS)), "id").distinct()

    def project(batches):
        for b in batches:
            v = _sums(b.column("words"), size, places, seed).astype("f8")
            length = np.sqrt((v * v).sum(axis=1, keepdims=True))
            v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
            ends = pa.array((np.arange(b.num_rows + 1) * size).astype("i4"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], [key, "embedding"])

    listed = rows.select("id", words_of(F.col("text")).alias("words"))
    return listed.mapInArrow(project, f"`{key}` {df.schema[key].dataType.simpleString()}, embedding array<double>")
