"""Language identification by unigram piece models, summed over all segmentations."""

from __future__ import annotations

import base64
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.sampling import picked, share_of
from marketloom.session import materialize

#: Training documents a language at most, an expected number: a hash of the id decides. Rounds of expectation maximisation.
SAMPLE, ROUNDS = 1500, 3
#: Probability mass added to every piece.
SMOOTH = 0.1
#: Words and bytes of words that a worker remembers; words longer than the third number are scored anew. Characters in a group.
CACHE_WORDS, CACHE_BYTES, CACHED, GROUP = 400_000, 32_000_000, 200, 1_000_000
#: Places of a word that are summed at a time, and places (over all words) in a step.
SLICE, CELLS = 4096, 200_000
#: Expected counts are sent in millionths, so that their sum does not depend on the order.
UNIT = 1_000_000
UNKNOWN = "und"
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = re.compile(r"[ \t\n\r\x0b\f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def load_pieces(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def as_tree(pieces: dict[bytes, int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """A trie, level by level: sorted keys (number of the parent in its level * 256 + byte), and piece ids (-1 for a mere beginning)."""
    level, out = {b"": 0}, []
    for n in range(1, max(map(len, pieces), default=0) + 1):
        begins = sorted((level[p[:-1]] << 8 | p[-1], p) for p in {p[:n] for p in pieces if len(p) >= n})
        out.append((np.array([k for k, _ in begins], "i8"), np.array([pieces.get(p, -1) for _, p in begins], "i8")))
        level = {p: i for i, (_, p) in enumerate(begins)}
    return out


def spans(words: list[bytes], tree: list[tuple[np.ndarray, np.ndarray]], lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, ...]:
    """word, begin, end, piece of every place where a piece stands in a word and begins in [lo, hi)."""
    parts = [w[lo : hi + len(tree)] for w in words] if hi is not None or lo else words
    sizes = np.fromiter(map(len, parts), "i8", len(parts))
    flat = np.frombuffer(b"".join(parts), "u1")
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(parts)), sizes)
    start, stop = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    at = np.arange(len(flat))
    if hi is not None:
        at = at[at - start < hi - lo]
    node, out = np.zeros(len(at), "i8"), []
    for n, (known, ids) in enumerate(tree, 1):
        inside = at + n <= stop[at]
        at, node = at[inside], node[inside]
        if not len(at):
            break
        code = node << 8 | flat[at + n - 1]
        k = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = known[k] == code
        at, node = at[hit], k[hit]
        piece = ids[node]
        own, piece = at[piece >= 0], piece[piece >= 0]
        begin = own - start[own] + lo
        out.append((word[own], begin, begin + n, piece))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, "i8") for _ in range(4))


def _sums(found: tuple[np.ndarray, ...], prob: np.ndarray, log: np.ndarray, base: int, ahead: bool) -> None:
    """Fills ``log`` (place - base x word x language) in place: at each place the log of the sum over the pieces that end there
    (``ahead``) or begin there, of the piece's probability times the sum at its other end. Rows of places already known stay."""
    word, begin, end, piece = found
    at, other = (end, begin) if ahead else (begin, end)
    order = np.argsort(at * log.shape[1] + word, kind="stable")
    at, other, word, piece = (x[order] for x in (at, other, word, piece))
    places, cuts = np.unique(at, return_index=True)
    for place, a, b in sorted(zip(places.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True), reverse=not ahead):
        w, far = word[a:b], log[other[a:b] - base, word[a:b]]
        head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        top = np.maximum.reduceat(far, head)
        top = np.where(np.isfinite(top), top, 0.0)
        part = np.exp(far - np.repeat(top, np.diff(np.append(head, len(w))), axis=0)) * prob[piece[a:b]]
        with np.errstate(divide="ignore"):
            log[place - base, w[head]] = np.log(np.add.reduceat(part, head)) + top


def _slices(words: list[bytes], tree: list, prob: np.ndarray, width: int):
    """Of words, slice by slice: its first and last place, how many places are carried from the slice before (the longest piece's),
    log sums up to each place from those on, and the pieces that begin from those on."""
    longest, back = max(map(len, words), default=0), len(tree)
    log = np.zeros((1, len(words), prob.shape[1]))
    for base in range(0, max(1, longest), max(width, back)):
        to, before, carried = min(base + max(width, back), longest), min(base, back), log
        log = np.full((before + to - base + 1, len(words), prob.shape[1]), -np.inf)
        log[: before + 1] = carried[-before - 1 :]
        found = spans(words, tree, base - before, to)
        own = (found[2] > base) & (found[2] <= to)
        _sums(tuple(x[own] for x in found), prob, log, base - before, True)
        yield base, to, before, log, found


def steps(words: list[bytes], cells: int = CELLS):
    """Positions of words of about one length, together no more than ``cells`` places in a slice."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * min(SLICE, len(words[order[at + n]]) + 1) <= cells:
            n += 1
        yield order[at : at + n]
        at += n


def forward(words: list[bytes], tree: list, prob: np.ndarray, width: int = SLICE) -> np.ndarray:
    """Of each word and language the log of the sum over all segmentations of the product of piece probabilities.

    A word is summed ``width`` places at a time with the last places carried over, so its length costs no memory.
    """
    out = np.full((len(words), prob.shape[1]), -np.inf)
    for own in steps(words):
        part = [words[k] for k in own]
        last = np.fromiter(map(len, part), "i8", len(part))
        for base, to, before, log, _ in _slices(part, tree, prob, width):
            done = np.flatnonzero((last > base) & (last <= to))
            out[np.array(own)[done]] = log[last[done] - base + before, done]
    return out


def expected(words: list[bytes], tree: list, prob: np.ndarray, weight: np.ndarray, width: int = SLICE) -> np.ndarray:
    """Expected piece counts (piece x language) of words with a weight per language, by forward and backward sums.

    A word of several slices is summed forward once, keeping what each slice needs of the one before; then slices are taken from
    the last to the first, so memory follows one slice and not the word.
    """
    out, back = np.zeros_like(prob), len(tree)
    for own in steps(words):
        part, share = [words[k] for k in own], weight[own]
        last, rows = np.fromiter(map(len, part), "i8", len(part)), np.arange(len(own))
        total, kept = np.zeros((len(part), prob.shape[1])), []
        for base, to, before, log, found in _slices(part, tree, prob, width):
            done = (last > base) & (last <= to)
            total[done] = log[last[done] - base + before, rows[done]]
            kept.append((base, to, before, log[: before + 1].copy()))
        behind = np.full((1, len(part), prob.shape[1]), -np.inf)
        for base, to, before, carried in reversed(kept):
            if len(kept) > 1:
                log = np.full((before + to - base + 1, *carried.shape[1:]), -np.inf)
                log[: before + 1] = carried
                found = spans(part, tree, base - before, to)
                near = (found[2] > base) & (found[2] <= to)
                _sums(tuple(x[near] for x in found), prob, log, base - before, True)
            found = tuple(x[found[1] >= base] for x in found)
            after = np.full((to - base + 1 + back, *carried.shape[1:]), -np.inf)
            after[to - base : to - base + len(behind)] = behind
            done = (last > base) & (last <= to)
            after[last[done] - base, rows[done]] = 0.0
            _sums(found, prob, after, base, False)
            word, begin, end, piece = found
            with np.errstate(invalid="ignore"):
                chance = np.exp(log[begin - base + before, word] + after[end - base, word] - total[word]) * prob[piece] * share[word]
            np.add.at(out, piece, np.nan_to_num(chance))
            behind = after[: back + 1]
    return out


def words_of(text: str) -> list[bytes]:
    """Lower-case words without marks around them, with the space before them, as the vocabulary writes them."""
    return [b" " + w for word in text.lower().encode("utf-8", "surrogatepass").split() if (w := word.strip(MARKS))]


def parts_of(text: str):
    """The text in parts of about ``GROUP`` characters, cut at white space, so that the words of a long one are never held at once."""
    at = 0
    while len(text) - at > GROUP and (space := SPACE.search(text, at + GROUP)):
        yield text[at : space.start()]
        at = space.start()
    yield text[at:]


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L); digits and numbers of other scripts are none."""
    return any(map(str.isalpha, text))


def first_counts(words: list[bytes], tree: list, size: int, weight: np.ndarray) -> np.ndarray:
    """Piece counts to start from: all places where a piece stands, by its length."""
    out = np.zeros((size, weight.shape[1]))
    for own in steps(words):
        part = [words[k] for k in own]
        for base in range(0, max(map(len, part)), SLICE):
            word, begin, end, piece = spans(part, tree, base, base + SLICE)
            np.add.at(out, piece, weight[own][word] * (end - begin)[:, None])
    return out


def normalised(counts: np.ndarray, pieces: dict[bytes, int]) -> np.ndarray:
    """Probabilities from counts: each piece of the vocabulary gets ``SMOOTH`` on top."""
    counts = counts.copy()
    counts[list(pieces.values())] += SMOOTH
    return counts / counts.sum(axis=0)


def fit_pieces(words: DataFrame, langs: int, pieces: dict[bytes, int], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities (piece x language) by expectation maximisation over segmentations.

    ``words`` has a row (word, counts) per word, a count per language. Each round is a Spark job: tasks send expected counts per
    piece, and the driver gets their sums, one number per piece and language, so it never holds the words.
    """
    tree, size = as_tree(pieces), max(pieces.values()) + 1
    prob = None

    def count(batches):
        total = np.zeros((size, langs))
        for b in batches:
            word = b.column("word").to_pylist()
            weight = np.array(b.column("counts").to_pylist(), "f8").reshape(len(word), langs)
            total += first_counts(word, tree, size, weight) if prob is None else expected(word, tree, prob, weight)
        piece, lang = np.nonzero(np.rint(total * UNIT))
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype("i4")), pa.array(lang.astype("i4")), pa.array(np.rint(total[piece, lang] * UNIT).astype("i8"))], ["piece", "lang", "n"])

    for _ in range(rounds + 1):
        got = words.mapInArrow(count, "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        piece, lang, n = (got.column(c).to_numpy() for c in ("piece", "lang", "n"))
        counts = np.zeros((size, langs))
        counts[piece, lang] = n / UNIT
        prob = normalised(counts, pieces)
    return prob


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray, dict[bytes, int]]:
    """Languages, piece probabilities and pieces, from documents that are not held out and have a language.

    Word counts come from a sample of about ``sample`` documents a language, by a hash of the id. Spark counts the words and fits
    the pieces; words that occur once count too, as a language may have one short document.
    """
    pieces = load_pieces(vocabulary or default_vocabulary())
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((1, 0)), pieces
    pick = F.lit(False)
    for lang in langs:
        pick = pick | ((F.col("lang") == lang) & picked(share_of(sample, sizes[lang]), "doc_id", F.lit("sample")))

    def words(batches):
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = Counter()
                for part in parts_of(text):
                    own.update(words_of(part))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])

    counts = [F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0)).cast("double") for lang in langs]
    own = known.where(pick).select("lang", "text").mapInArrow(words, "lang string, word binary, n long")
    own = own.groupBy("word").agg(F.array(*counts).alias("counts")).repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism), "word")
    return langs, fit_pieces(materialize(own, "words"), len(langs), pieces, rounds), pieces


def identify(docs: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document.

    A text's log probability in a language is the sum over its words; a word's is that of all ways to write it in pieces of the
    whole vocabulary, by a forward pass that each worker does once per word it remembers. score is the posterior of the best
    language under equal priors; ties go to the first by name. Null text and text without a letter give ``und`` with score 0, and
    so does everything when no document has a language to learn from. Null ids are scored too; repeated rows come back each, with
    one result; other columns of ``docs`` are ignored; an empty table gives an empty one. A text of any length is taken whole: its
    words are looked up a group at a time, and a long word in slices with the sums carried over.
    """
    langs, prob, pieces = train(docs, vocabulary, sample, rounds)
    tree = as_tree(pieces)
    cache: dict[bytes, int] = {}
    table = [np.zeros((0, len(langs)))]
    held = [0]

    def remember(words: set[bytes]) -> None:
        """Scores the words that are not known; with too many known ones the memory starts anew."""
        new = list(words.difference(cache))
        size = sum(map(len, new))
        if len(cache) + len(new) > CACHE_WORDS or held[0] + size > CACHE_BYTES:
            cache.clear()
            table[0], held[0] = table[0][:0], 0
            new = list(words)
            size = sum(map(len, new))
        cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
        table[0], held[0] = np.concatenate([table[0], forward(new, tree, prob)]), held[0] + size

    def score(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(langs)))
        group, long, size = [], [], 0
        parts = ((k, part) for k, text in enumerate(texts) for part in parts_of(text))
        for k, text in chain(parts, [(len(texts), None)]):
            if text is None or size > GROUP:
                remember({w for _, words in group for w in words})
                for j, words in group:
                    out[j] += table[0][np.fromiter(map(cache.__getitem__, words), "int64", len(words))].sum(axis=0)
                for (j, _), ll in zip(long, forward([w for _, w in long], tree, prob), strict=True):
                    out[j] += ll
                group, long, size = [], [], 0
            words = words_of(text or "")
            group += [(k, [w for w in words if len(w) <= CACHED])] if words else []
            long += [(k, w) for w in words if len(w) > CACHED]
            size += len(text or "")
        return out

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            pred, post = [UNKNOWN] * len(texts), [0.0] * len(texts)
            todo = [k for k, t in enumerate(texts) if isinstance(t, str) and langs and has_letter(t)]
            for k, ll in zip(todo, score([texts[k] for k in todo]), strict=True):
                p = np.exp(ll - ll.max())
                pred[k], post[k] = langs[int(p.argmax())], float(p.max() / p.sum())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred, pa.string()), pa.array(post, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
