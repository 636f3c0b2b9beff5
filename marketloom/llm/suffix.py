"""Exact removal of long repeated byte strings by distributed prefix doubling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import materialize

LENGTH = 100
#: Rank length at which positions are first sorted; only the position that is first in rank among the strings' starts is sent.
FIRST = 32
#: Rank length at which what is still open then is sorted again.
SECOND = 64
#: Bytes of text that a task names at a time, and within which it settles repeats before Spark sorts the rest.
NAMED, SETTLED = 2_000_000, 48_000_000
#: Rows of single strings that a task settles at once.
STRINGS = 2_000_000
#: Contexts of a rank within a task from which all but two go on without being compared: they are several anyhow.
HOT = 8
#: Marks of a place (last start) below zero: a run that its task found repeated, or one that it found open.
OPEN = 1 << 31
LAST_ID = (1 << 63) - 1


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit rank for each pair of ranks: equal pairs get equal ranks."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def ranks(data: bytes, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """Ranks of the strings of each length at every position, doubled from 8 bytes up; the last step overlaps."""
    now, at, out = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).astype("u8") if len(data) > 7 else np.zeros(0, "u8"), 8, {}
    for want in sorted(lengths):
        while at < want:
            step = min(at, want - at)
            now = pair(now[:-step], now[step:]) if len(now) > step else now[:0]
            at += step
        out[want] = now
    return out


def starts_of(data: bytes, begin: np.ndarray, size: np.ndarray, length: int, first: int) -> dict[str, np.ndarray]:
    """Runs of starts that share a leading position, over texts laid end to end.

    Every string of ``length`` bytes has one leading position: the start of the first-ranked string of ``first`` bytes in it
    (ties: the leftmost). Equal strings lead at the same place, so they can only be found in runs whose leading rank is equal.
    Returns doc (index), lo, hi (first and last start, from the text's own start), rank (of the leading position), context
    (rank of all bytes that the run's strings cover).
    """
    none = {k: np.zeros(0, t) for k, t in (("doc", "i8"), ("lo", "i8"), ("hi", "i8"), ("rank", "u8"), ("context", "u8"))}
    if not (size >= length).any():
        return none
    r = ranks(data, (first, length))
    lead = (r[first] & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(r[first]), dtype="u8")
    span = length - first + 1
    width = 1
    while 2 * width <= span:
        lead = np.minimum(lead[:-width], lead[width:])
        width *= 2
    lead = np.minimum(lead[: len(lead) - (span - width)], lead[span - width :])
    delta = np.zeros(len(data) + 1, "i1")
    whole = size >= length
    delta[begin[whole]] += 1
    delta[begin[whole] + size[whole] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(delta[:-1], dtype="i1"))
    owner = (lead[at] & np.uint64(0xFFFFFFFF)).astype("i8")
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    lo, hi, owner = at[cut], at[np.append(cut[1:], len(at)) - 1], owner[cut]
    doc = np.searchsorted(begin, lo, "right") - 1
    context = pair(pair(r[length][lo], r[length][hi]), ((hi - lo) << 8 | (owner - lo)).astype("u8"))
    return {"doc": doc, "lo": lo - begin[doc], "hi": hi - begin[doc], "rank": r[first][owner], "context": context}


def later(keys: list[np.ndarray], doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by keys, doc, lo: the first row of each group, and whether a row starts after it."""
    new = np.ones(len(doc), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return new, (doc > doc[head]) | ((doc == doc[head]) & (lo > lo[head]))


def settle(whole: dict[str, np.ndarray], hot: int = HOT) -> pa.RecordBatch:
    """Runs of a task as rows to sort, with what the task alone can tell.

    A run that repeats one of the same rank and context in the task is repeated. Of a rank with ``hot`` or more contexts all runs
    but those of the first two go on as open. So a task sends no more than ``hot`` contexts of a rank, however common it is. Runs
    with a verdict are marked by a place below zero and have a rank of their own.
    """
    order = np.lexsort((whole["lo"], whole["doc"], whole["context"], whole["rank"]))
    f = {k: v[order] for k, v in whole.items()}
    new, done = later([f["rank"], f["context"]], f["doc"], f["lo"])
    head = np.ones(len(order), bool)
    head[1:] = f["rank"][1:] != f["rank"][:-1]
    group = np.cumsum(head) - 1
    nth = np.cumsum(new) - np.cumsum(new)[np.flatnonzero(head)][group]  # of the context in its rank
    many = np.bincount(group, weights=new, minlength=1)[group] >= hot
    verdict = np.zeros(len(order), "i1")  # 1 repeated, 2 open
    verdict[order] = np.where(done, 1, np.where(many & (nth > 1), 2, 0))
    columns = []
    for v in (0, 1, 2):
        own = {k: c[verdict == v] for k, c in whole.items()}  # in the order of the texts, which compresses well
        if v:
            order = np.lexsort((own["lo"], own["key"], own["doc"]))
            own = {k: c[order] for k, c in own.items()}
            new = np.ones(len(order), bool)
            new[1:] = (own["doc"][1:] != own["doc"][:-1]) | (own["key"][1:] != own["key"][:-1]) | (own["lo"][1:] > own["hi"][:-1] + 1)
            first = np.flatnonzero(new)
            own = {k: c[first] for k, c in own.items()} | {"hi": own["hi"][np.append(first[1:], len(order)) - 1] if len(order) else own["hi"]}
            own["rank"] = pair(own["doc"].astype("u8"), own["lo"].astype("u8"))
        place = own["lo"] << 32 | own["hi"]
        columns.append([own["rank"].view("i8"), own["context"].view("i8"), own["doc"], own["key"], [place, -1 - place, -1 - (place | OPEN)][v]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["rank", "context", "doc", "key", "place"])


def merged(found: list[dict]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([x[k] for x in found]) for k in found[0]}


def parts_of(data, begin: np.ndarray, end: np.ndarray, length: int, named: int = NAMED):
    """Bytes of about ``named`` at a time with (range, from, bytes' begin, bytes' size) of what they hold: ranges of ``data`` end to end.
    A longer range is dealt by its starts over parts that overlap by ``length`` - 1 bytes, so memory does not follow a text."""
    held, size = [], 0
    for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        for at in range(a, max(a + 1, b - length + 1), named):
            to = min(b, at + named + length - 1)
            held.append((k, at - a, at, to))
            size += to - at
            if size >= named:
                yield _joined(data, held)
                held, size = [], 0
    if held:
        yield _joined(data, held)


def _joined(data, held: list[tuple]) -> tuple:
    k, offset, begin, end = (np.array(x, "i8") for x in zip(*held, strict=True))
    whole = bytes(data[held[0][2] : held[-1][3]]) if (begin[1:] == end[:-1]).all() else b"".join([bytes(data[a:b]) for _, _, a, b in held])
    return whole, k, offset, np.cumsum(end - begin) - (end - begin), end - begin


def _runs(length: int, first: int, hot: int = HOT, named: int = NAMED):
    """Tasks name positions, settle what they can, and send one row per run that is left."""

    def run(batches):
        found, held = [], 0
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
            data = memoryview(texts.buffers()[2] or b"")
            for part, text, offset, begin, size in parts_of(data, ends[:-1], ends[1:], length, named):
                got = starts_of(part, begin, size, length, first)
                if len(got["lo"]):
                    own, more = text[got["doc"]], offset[got["doc"]]
                    found.append(got | {"doc": ids[own], "key": keys[own], "lo": got["lo"] + more, "hi": got["hi"] + more})
                held += len(part)
                if held >= SETTLED and found:
                    yield settle(merged(found), hot)
                    found, held = [], 0
        if found:
            yield settle(merged(found), hot)

    return run


def _sorted_groups(batches, keys: tuple[str, str]):
    """Arrow batches sorted by two keys as dicts of arrays, with the head rows of the group that goes on from the batch before: the
    first of the first key, and the first of both. ``old`` counts those. So no group is ever held as a whole."""
    carried = None
    for batch in batches:
        now = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        if not len(now[keys[0]]):
            continue
        old = 0
        if carried is not None and carried[keys[0]][-1] == now[keys[0]][0]:
            old = len(carried[keys[0]])
            now = {n: np.concatenate([carried[n], now[n]]) for n in now}
        a, b = (now[k] for k in keys)
        same = a == a[-1]
        first = int(np.argmax(same))
        both = int(np.argmax(same & (b == b[-1])))
        carried = {n: c[[first, both] if both > first else [first]] for n, c in now.items()}
        yield old, now


def _compare(batches):
    """Of runs sorted by rank and context: repeated ones, and the first of each context where a rank has several contexts."""
    for old, f in _sorted_groups(batches, ("rank", "context")):
        marked = f["place"] < 0
        place = np.where(marked, -1 - f["place"], f["place"])
        is_open = marked & (place & OPEN > 0)
        f |= {"lo": (place >> 32).astype("i4"), "hi": (place & (OPEN - 1)).astype("i4")}
        new, repeated = later([f["rank"], f["context"]], f["doc"], f["lo"])
        head = np.concatenate([[True], f["rank"][1:] != f["rank"][:-1]])
        group = np.cumsum(head) - 1
        several = np.bincount(group, weights=new)[group] > 1
        repeated = (repeated | marked) & ~is_open
        pick = repeated | several | is_open
        pick[:old] &= old == 1  # a carried first context is sent once a second one comes; of two, both are sent
        pick[:old] &= ~repeated[:old] & ~marked[:old]
        if pick.any():
            yield pa.RecordBatch.from_arrays([pa.array(f[c][pick]) for c in ("doc", "key", "lo", "hi")] + [pa.array(repeated[pick])], ["doc", "key", "lo", "hi", "repeated"])


def _open_ranges(batch, length: int, named: int):
    """Of documents with open runs: doc, key, and parts of the text with what they hold."""
    docs, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for k, (text, spans) in enumerate(zip(batch.column(2).cast(pa.large_binary()), batch.column(3), strict=True)):
        v = spans.values
        lo, hi = (v.field(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("lo", "hi"))
        for part, run, offset, begin, size in parts_of(memoryview(text.as_buffer() or b""), lo, hi + length, length, named):
            yield docs[k], keys[k], part, lo[run] + offset, begin, size


def _narrow(length: int, second: int, hot: int = HOT, named: int = NAMED):
    """Runs of the starts that are still open, by leading positions of a longer rank."""

    def run(batches):
        found, held = [], 0
        for batch in batches:
            for doc, key, part, lo, begin, size in _open_ranges(batch, length, named):
                got = starts_of(part, begin, size, length, second)
                n, more = len(got["lo"]), lo[got["doc"]]
                found.append(got | {"doc": np.full(n, doc), "key": np.full(n, key), "lo": got["lo"] + more, "hi": got["hi"] + more})
                held += len(part)
                if held >= SETTLED:
                    yield settle(merged(found), hot)
                    found, held = [], 0
        if found:
            yield settle(merged(found), hot)

    return run


def _expand(length: int, first: int, named: int = NAMED):
    """The ranks of all strings of the runs that are still open, from the texts. check: half the rank of the string's last bytes,
    and the text's key. A string that a task has seen before is repeated and marked so, as a run with its neighbours."""

    def settle_strings(found: list) -> pa.RecordBatch:
        rank, check, doc, lo = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((lo, doc, check >> 32, rank))
        done = np.zeros(len(order), bool)
        done[order] = later([rank[order], check[order] >> 32], doc[order], lo[order])[1]
        key = (check & 0xFFFFFFFF)[done]
        order = np.lexsort((lo[done], key, doc[done]))
        key, old_doc, old_lo = key[order], doc[done][order], lo[done][order]
        new = np.ones(len(order), bool)
        new[1:] = (old_doc[1:] != old_doc[:-1]) | (key[1:] != key[:-1]) | (old_lo[1:] > old_lo[:-1] + 1)
        head = np.flatnonzero(new)
        hi = old_lo[np.append(head[1:], len(order)) - 1] if len(order) else old_lo
        key, old_doc, old_lo = key[head], old_doc[head], old_lo[head]
        live = ~done
        columns = [(rank[live], pair(old_doc.astype("u8"), old_lo.astype("u8")).view("i8")), (check[live], key), (doc[live], old_doc), (lo[live] << 32 | lo[live], -1 - (old_lo << 32 | hi))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["rank", "check", "doc", "place"])

    def run(batches):
        found, held = [], 0
        for batch in batches:
            for doc, key, part, lo, begin, size in _open_ranges(batch, length, named):
                for a, at, n in zip(lo.tolist(), begin.tolist(), size.tolist(), strict=True):
                    r = ranks(part[at : at + n], (first, length))
                    count = n - length + 1
                    tail = r[first][length - first : length - first + count] & np.uint64(0xFFFFFFFF00000000)
                    found.append((r[length][:count].view("i8"), tail.view("i8") | (int(key) & 0xFFFFFFFF), np.full(count, doc), np.arange(a, a + count)))
                    held += count
                if held >= STRINGS or len(found) > 50_000:
                    yield settle_strings(found)
                    found, held = [], 0
        if found:
            yield settle_strings(found)

    return run


def _repeats(batches):
    """Of single strings sorted by rank and check: those that start earlier elsewhere, neighbours in a text as one."""
    for old, f in _sorted_groups(batches, ("rank", "tail")):
        marked = f["place"] < 0
        place = np.where(marked, -1 - f["place"], f["place"])
        lo, hi = (place >> 32).astype("i4"), (place & 0xFFFFFFFF).astype("i4")
        repeated = later([f["rank"], f["tail"]], f["doc"], lo)[1] | marked
        repeated[:old] = False
        if repeated.any():
            key = (f["check"][repeated] & 0xFFFFFFFF).astype("u4").view("i4")
            yield pa.RecordBatch.from_arrays([pa.array(f["doc"][repeated]), pa.array(key), pa.array(lo[repeated]), pa.array(hi[repeated])], ["doc", "key", "lo", "hi"])


def _cut(length: int, keep_text: bool):
    """Removes the covered bytes."""

    def run(batches):
        for batch in batches:
            sizes, removed, runs, hashes, kept = [], [], [], [], []
            for text, spans in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
                data, keep, at, gone, n = text.as_py() or b"", [], 0, 0, 0
                if spans.is_valid:
                    v = spans.values
                    lo, hi = (v.field(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("lo", "hi"))
                    order = np.lexsort((hi, lo))
                    lo, end = lo[order], np.maximum.accumulate(hi[order] + length)
                    head = np.flatnonzero(np.concatenate([[True], lo[1:] > end[:-1]]))
                    n = len(head)
                    for a, b in zip(lo[head].tolist(), end[np.append(head[1:], len(lo)) - 1].tolist(), strict=True):
                        keep.append(data[at:a])
                        gone, at = gone + b - a, b
                left = b"".join([*keep, data[at:]])
                for out, x in zip((sizes, removed, runs, hashes, kept), (len(data), gone, n, hashlib.sha256(left).hexdigest(), left if keep_text else None), strict=True):
                    out.append(x)
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(hashes, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, first: int = FIRST, second: int = SECOND) -> DataFrame:
    """_doc, _key, lo, hi: runs of starts of strings of ``length`` bytes that also start earlier; rows may overlap."""
    if length < 8:
        raise ValueError("ranks start at 8 bytes")
    first, second = min(first, length), min(second, length)
    keyed = _keyed(docs)
    runs = keyed.mapInArrow(_runs(length, first, HOT, NAMED), "rank long, context long, doc long, key int, place long")
    runs = runs.repartition("rank").sortWithinPartitions("rank", "context", "doc", "place")
    places = "doc long, key int, lo int, hi int, repeated boolean"
    found = materialize(runs.mapInArrow(_compare, places), "runs")
    texts = lambda left: keyed.join(_open(left), ["_doc", "_key"]).select("_doc", "_key", "_text", "spans")
    longer = texts(found).mapInArrow(_narrow(length, second, HOT, NAMED), "rank long, context long, doc long, key int, place long")
    longer = longer.repartition("rank").sortWithinPartitions("rank", "context", "doc", "place").mapInArrow(_compare, places)
    strings = texts(longer).mapInArrow(_expand(length, first, NAMED), "rank long, check long, doc long, place long").withColumn("tail", F.shiftright("check", 32))
    strings = strings.repartition("rank").sortWithinPartitions("rank", "tail", "doc", "place").mapInArrow(_repeats, "doc long, key int, lo int, hi int")
    done = [x.where("repeated").select("doc", "key", "lo", "hi") for x in (found, longer)]
    return done[0].union(done[1]).union(strings).toDF("_doc", "_key", "lo", "hi")


def _open(found: DataFrame) -> DataFrame:
    return found.where("NOT repeated").groupBy(F.col("doc").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_doc"), F.hash(text).alias("_key"), text.alias("_text"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary, null without ``keep_text``): texts without bytes of
    strings that also start earlier.

    Prefix doubling: positions are ranked by 8 bytes, then by 16, ..., ``length``; the rank of a longer string is that of the
    pair of ranks at an offset. Spark sorts (rank, position) pairs three times, each time only those not yet decided: leading
    positions by the rank of 32 bytes and of their whole context, where unique ranks end and equal contexts are settled at once;
    where a rank has several contexts, leading positions by the rank of 64 bytes; then single strings by the rank of ``length``
    bytes. A task settles repeats among its own texts first, so copies by the thousand reach a sort once per task, and a common
    rank with few contexts per task. Ranks are 64-bit names of the strings, and a string is compared by two of them.

    A string is earlier in a smaller doc_id, or in the same document at a smaller start. Null text is empty; texts shorter than
    ``length`` keep all; a long text is named in overlapping parts of ``NAMED`` bytes; other columns of ``docs`` are ignored; null ids come last; rows equal in id and text are one document, which does not repeat itself by being
    stored twice; an empty table gives an empty one.
    """
    spans = repeated_spans(docs, length, first).groupBy("_doc", "_key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    whole = _keyed(docs).join(spans, ["_doc", "_key"], "left")
    whole = whole.select(F.when(F.col("_doc") < LAST_ID, F.col("_doc")).alias("doc_id"), "_text", "spans")
    return whole.mapInArrow(_cut(length, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False).drop("kept")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
SQL: dict[str, str] = {}
