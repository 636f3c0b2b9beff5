"""Best-fit packing of token sequences, large items matched first."""

from __future__ import annotations

import bisect
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scale import id_salt, rank_in_key, salts_for
from marketloom.session import materialize

CAPACITY = 4096
END_ID = 1
#: Parts of words that a worker remembers the tokens of; then it forgets them all.
CACHE_WORDS = 400_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: A word of Latin letters with marks behind it is cut by the tokenizer where the marks begin; its letters are lowered.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
PLAIN, LOWERED = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", re.compile("[a-zß-öø-ÿ]+")


class WordTokens:
    """Token ids of words as little-endian bytes. The tokenizer splits at white space, so a text's ids are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # words of lower-case Latin letters need no normalising, and are cut at white space only
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.parts: dict[str, bytes] = {}
        vocab = self.tok.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def ids(self, texts: list[str], tokenizer) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> None:
        """Lower-case letters go to the tokenizer a hundred words at a time, and are told apart by the tokens that close a word."""
        known = self.parts
        letters = [w for w in parts if LOWERED.fullmatch(w)]
        groups = [letters[k : k + 100] for k in range(0, len(letters), 100)]
        for group, ids in zip(groups, self.ids([" ".join(g) for g in groups], self.letters), strict=True):
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) == len(group):
                raw, at = ids.tobytes(), 0
                for w, to in zip(group, ends.tolist(), strict=True):
                    known[w], at = raw[at:to], to
        rest = [w for w in parts if w not in known]
        known.update(zip(rest, (x.tobytes() for x in self.ids(rest, self.tok)), strict=True))

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Words are told apart, cut and numbered in Arrow; Python sees each part once an array, and ids are gathered by number."""
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        bare = pc.utf8_rtrim(words, characters=MARKS)
        plain = pc.match_substring_regex(bare, PLAIN)
        heads = pc.if_else(plain, pc.utf8_lower(bare), words).dictionary_encode()
        tails = pc.if_else(plain, pc.utf8_ltrim(words, characters=LETTERS), "").dictionary_encode()
        parts = heads.dictionary.to_pylist() + tails.dictionary.to_pylist()
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        known = self.parts
        new = list({w for w in parts if w not in known})
        for k in range(0, len(new), 40_000):
            self.learn(new[k : k + 40_000])
        tokens = [known[w] for w in parts]
        sizes = np.fromiter(map(len, tokens), "i8", len(tokens)) // 4
        pool, starts = np.frombuffer(b"".join(tokens), "<u4"), np.cumsum(sizes) - sizes
        pairs = np.stack([heads.indices.to_numpy(), tails.indices.to_numpy() + len(heads.dictionary)], axis=1)[coded.indices.to_numpy()].ravel()
        each = sizes[pairs]
        ends = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(starts[pairs] - ends[:-1], each) + np.arange(ends[-1])]
        cuts = ends[2 * lists.offsets.to_numpy()].tolist()
        return [ids[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]


_TOKENS: dict[str, WordTokens] = {}


def chunks(sizes: list[int], limit: int = 2_500_000):
    """Slices of about ``limit`` in total."""
    at, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= limit:
            yield slice(at, k + 1)
            at, total = k + 1, 0
    if at < len(sizes):
        yield slice(at, len(sizes))


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids, cut every ``capacity`` tokens; ``end_id`` closes a document."""
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()

    def cut(batches):
        if path not in _TOKENS:  # one per worker process
            _TOKENS[path] = WordTokens(path)
        words = _TOKENS[path]
        for batch in batches:
            texts, keys = pc.fill_null(batch.column("text"), ""), batch.column("doc_id")
            out = {"row": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for part in chunks(pc.binary_length(texts).to_pylist()):
                for row, ids in enumerate(words.texts(texts[part.start : part.stop]), part.start):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for name, value in zip(out, (row, piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                            out[name].append(value)
            rows = out.pop("row")
            cols = [keys.take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *out])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first bin, pieces per bin, offset) that place ``counts[length]`` pieces of each length.

    Pieces above a third of the capacity come first: the largest left is matched with the largest left that fits beside it, so
    at most two share a bin. The others follow by falling length, each to the bin with the least room that still takes it, a new
    bin if there is none. All bins with equal room are handled as one, so work and runs depend on the capacity, not on the rows.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    large, runs, rank, bins = sorted(n for n in left if 3 * n > capacity), [], dict.fromkeys(left, 0), 0
    room: dict[int, list[tuple[int, int]]] = {}

    def place(n: int, first: int, k: int, per: int, offset: int) -> None:
        runs.append((n, rank[n], first, per, offset))
        rank[n] += k

    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        if at < 0:
            k, used = left[n], n
            place(n, bins, k, 1, 0)
            left[n] = 0
        else:
            m = large[at]
            k, used = (left[n] // 2 if m == n else min(left[n], left[m])), n + m
            if not k:  # one is left of the only length that fits
                k, used = left[n], n
                large_below = large[:at]
                if large_below:
                    m = large_below[-1]
                    k, used = 1, n + m
                    place(n, bins, 1, 1, 0)
                    place(m, bins, 1, 1, n)
                    left[n] -= 1
                    left[m] -= 1
                else:
                    place(n, bins, k, 1, 0)
                    left[n] = 0
            elif m == n:
                place(n, bins, 2 * k, 2, 0)
                left[n] -= 2 * k
            else:
                place(n, bins, k, 1, 0)
                place(m, bins, k, 1, n)
                left[n] -= k
                left[m] -= k
        room.setdefault(capacity - used, []).append((bins, k))
        bins += k
        large = [x for x in large if left[x]]
    gaps = sorted(room)
    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        c = left[n]
        while c:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                gap, first = capacity, bins
                k = -(-c // (capacity // n))
                bins += k
            else:
                gap = gaps[at]
                first, k = room[gap].pop()
                if not room[gap]:
                    del room[gap], gaps[at]
            per = min(gap // n, c)
            full = min(k, c // per)
            place(n, first, full * per, per, capacity - gap)
            c -= full * per
            rest = [(first, full, gap - n * per), (first + full, k - full, gap)]
            for lo, m, free in rest:
                if m and free:
                    if free not in room:
                        bisect.insort(gaps, free)
                    room.setdefault(free, []).append((lo, m))
    return runs


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens: a row per piece, with its sequence_id and offset.

    The driver sees one count per piece length, at most ``capacity`` of them, and hands out places by length and rank among
    pieces of that length; ranks come from salted cells, so thousands of equal documents spread over tasks. Null text counts as
    empty (its one token closes it), null ids are allowed, repeated rows are packed each, an empty table gives an empty one.
    """
    pieces = materialize(cut_pieces(docs, capacity, tokenizer, end_id), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = np.array(sorted(pack_lengths(counts, capacity)) or [(0, 0, 0, 1, 0)], "int64")
    salted = pieces.withColumn("salt", id_salt(F.col("doc_id"), salts_for(sum(counts.values()))))
    ranked = rank_in_key(salted, ["length"], ["salt"], ["doc_id", "piece", "start", "ids_crc32"]).drop("salt")

    def place(batches):
        length, rank, first, per, offset = runs.T
        key = length * (1 << 44) + rank
        for b in batches:
            n, r = b.column("length").to_numpy(zero_copy_only=False), b.column("rank").to_numpy(zero_copy_only=False) - 1
            k = np.searchsorted(key, n * (1 << 44) + r, "right") - 1
            sequence, at = first[k] + (r - rank[k]) // per[k], offset[k] + (r - rank[k]) % per[k] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(at)], [*b.schema.names[:5], "sequence_id", "offset"])

    cols = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank")).mapInArrow(place, cols)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
SQL: dict[str, str] = {}
