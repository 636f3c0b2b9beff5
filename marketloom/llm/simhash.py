"""SimHash near-duplicates: fuzzy hashing of fingerprint segments with the binary Golay code."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scale import connected_components
from marketloom.llm.sampling import picked, share_of
from marketloom.session import materialize

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: (shift, bits) of the three segments of a fingerprint; the last is filled up with zeros to a code word's 23 bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101
#: Members of a bucket up to which all of it is compared by shifts; larger ones are searched from member to member.
SHIFTS = 16
#: Members of a bucket from which it is dealt over blocks that are compared pair by pair, and fingerprints that such buckets are found by.
LARGE, SAMPLED = 20_000, 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half the hashes of the word shingles; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), "int64", len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(words))
    cuts = zip((ends - sizes)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], seed) for a, b in cuts], "<u8")
    ones = np.zeros(64, "int64")
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, key (a hash of the text), fp: a long that holds the 64 bits."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column("text")], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(fps)], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, fp long")


def _text_key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error of at most 3 bits that has it, and the syndromes of the 23 single bits."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= GENERATOR << bit - 11
        return v

    single = np.array([syndrome(1 << i) for i in range(23)])
    error = np.zeros(1 << 11, "int64")
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return error, single


def near_codewords(values: np.ndarray) -> np.ndarray:
    """12-bit indices (n x 24, with repeats) of the code words that each 23-bit value or a neighbour of it decodes to.

    Two values that differ in at most two bits share an index: a value within one bit of both decodes to it.
    """
    error, single = golay()
    syndrome = np.zeros(len(values), "int64")
    for i in range(23):
        syndrome ^= (values >> i & 1) * single[i]
    flips = np.concatenate([[0], 1 << np.arange(23)])
    shifted = values[:, None] ^ flips
    return (shifted ^ error[syndrome[:, None] ^ np.concatenate([[0], single])]) >> 11


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every bucket of each fingerprint.

    Of three segments two differ in at most two bits each if all differ in no more than five together, so the index pair of some
    two segments is shared. A key holds which two, and both indices.
    """
    u = fps.view("u8")
    near = [np.sort(near_codewords(((u >> s) & ((1 << n) - 1)).astype("int64")), axis=1) for s, n in SEGMENTS]
    fresh = [np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], axis=1) for x in near]
    keys, rows = [], []
    for which, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ri, ci), (rj, cj) = np.nonzero(fresh[i]), np.nonzero(fresh[j])
        a, b = near[i][ri, ci], near[j][rj, cj]
        per_row = np.bincount(rj, minlength=len(u))
        starts = np.cumsum(per_row) - per_row
        times = per_row[ri]
        left = np.repeat(np.arange(len(ri)), times)
        right = starts[ri[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        keys.append(which << 24 | a[left] << 12 | b[right])
        rows.append(ri[left])
    return np.concatenate(keys), np.concatenate(rows)


def links_in_bucket(u: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of members within ``most`` bits that join the same members as all such pairs would; one fewer than members at most."""
    left, found = np.arange(len(u)), []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(u[left] ^ u[at]) <= most
            hit = left[near]
            found += [(at, x) for x in hit]
            todo += list(hit)
            left = left[~near]
    return found


def large_buckets(distinct: DataFrame, spread, large: int, sampled: int) -> DataFrame:
    """key, blocks: buckets of more than about ``large`` members, by the counts of a sample; a missed one is compared as one."""
    share = share_of(sampled, distinct.count())
    some = distinct.where(picked(share, "fp", F.lit("buckets"))).mapInPandas(spread, "key long, fp long, rep long")
    seen = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 2) & (F.col("n") > large * share))
    return seen.select("key", F.ceil(F.col("n") / (large * share)).cast("int").alias("blocks"))


def fingerprint_links(distinct: DataFrame, most: int = MAX_BITS, large: int = LARGE, sampled: int = SAMPLED) -> DataFrame:
    """Links (a, b) between the reps of distinct fingerprints, enough of them to reach all within ``most`` bits.

    ``distinct`` has a row (fp, rep) per fingerprint. ``most`` may be up to 5. Buckets are sorted apart by Spark and compared in
    arrays; the spanning links of a bucket are all that leaves it. The members of a large bucket are dealt over blocks, and every
    two blocks meet in a group of their own, so no task holds it and no pair is lost.
    """
    if most > 5:
        raise ValueError("segments of this code find differences of up to five bits")

    def spread(batches):
        for b in batches:
            fps = b["fp"].to_numpy("int64")
            for at in range(0, len(fps), 5000):
                key, row = bucket_keys(fps[at : at + 5000])
                yield pd.DataFrame({"key": key.astype("int64"), "fp": fps[row + at], "rep": b["rep"].to_numpy()[row + at]})

    def compare(key, fp, rep):
        u, out = fp.view("u8"), []
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        small = np.repeat(size <= SHIFTS, size)
        for shift in range(1, min(SHIFTS, int(size.max(initial=1)))):
            hit = np.flatnonzero((key[:-shift] == key[shift:]) & small[:-shift] & (np.bitwise_count(u[:-shift] ^ u[shift:]) <= most))
            out.append((rep[hit], rep[hit + shift]))
        for at, n in zip(edge[size > SHIFTS], size[size > SHIFTS], strict=True):
            pairs = np.array(links_in_bucket(u[at : at + n], most), "int64").reshape(-1, 2)
            out.append((rep[at + pairs[:, 0]], rep[at + pairs[:, 1]]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (rep[:0], rep[:0])
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def verify(batches):
        kept = None
        for b in batches:
            now = tuple(b[c].to_numpy("int64") for c in ("key", "fp", "rep"))
            if kept is not None:
                now = tuple(np.concatenate(x) for x in zip(kept, now, strict=True))
            cut = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
            kept = tuple(x[cut:] for x in now)
            if cut:
                yield compare(*(x[:cut] for x in now))
        if kept is not None and len(kept[0]):
            yield compare(*kept)

    keyed = distinct.mapInPandas(spread, "key long, fp long, rep long")
    hot = materialize(large_buckets(distinct, spread, large, sampled), "large")
    if (n := hot.count()) > 0:
        hot = F.broadcast(hot) if n <= 100_000 else hot
        block = F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks"))
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least(block, o), F.greatest(block, o)))
        dealt = keyed.join(hot, "key").select(F.explode(others).alias("key"), "fp", "rep")
        keyed = keyed.join(hot, "key", "left_anti").unionByName(dealt)
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    return keyed.mapInPandas(verify, "a long, b long").distinct()


def _grouped(docs: DataFrame, most: int, shingle: int, seed: int) -> DataFrame:
    """doc_id, key, fp, root (the same in a component), component_id; the last two are null with the id."""
    own = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = materialize(own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp", F.col("fp").alias("rep")), most))
    of = materialize(distinct.join(roots.toDF("fp", "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    of = of.select("fp", "root").join(of.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    of = materialize(of, "components")
    known, unknown = own.where("doc_id IS NOT NULL").join(of, "fp"), own.where("doc_id IS NULL")
    return known.unionByName(unknown, allowMissingColumns=True)


def near_duplicates(docs: DataFrame, most: int = MAX_BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links of at most ``most`` bits).

    Equal fingerprints are one node, so copies meet in a count and never in pairs. Null and empty texts have fingerprint zero and
    link like any other; rows with a null id keep their fingerprint and get a null component; repeated rows come back each, and
    rows of one id with different texts each with their own text's component; a text of any length is hashed whole; other columns
    are ignored; an empty table gives an empty one.
    """
    return _grouped(docs, most, shingle, seed).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` of each component: that with the smallest id, then by a hash of the text. Rows with a null id stay. Of rows
    equal in id and text one stays, by a hash of its columns; so a rerun keeps the same rows."""
    heads = _grouped(docs, most, SHINGLE, SEED).where("doc_id IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("head"))
    heads = heads.select(F.col("head.doc_id").alias("_id"), F.col("head.key").alias("_text_key")).distinct()
    known = docs.where("doc_id IS NOT NULL").withColumn("_row", F.struct(*docs.columns))
    known = known.select("_row", F.col("doc_id").cast("long").alias("_id"), _text_key().alias("_text_key")).join(heads, ["_id", "_text_key"], "left_semi")
    known = known.groupBy("_id", "_text_key").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")).select("_row.*")
    return known.unionByName(docs.where("doc_id IS NULL"))


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
SQL: dict[str, str] = {}
