"""Greedy merges under vetoes: blocks of bounded size in their tasks, anything larger in rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.scale import connected_components
from marketloom.session import materialize

#: Rows of a block that is merged in one task, and pairs that are decided at once.
LIMIT, AT_ONCE = 6000, 1 << 18
#: A column of rows as numbers, and where it is null.
Known = tuple[np.ndarray, np.ndarray]
Decide = Callable[[dict[str, Known], dict[str, Known]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _pairwise(df: DataFrame, labels: DataFrame | None, x: str, y: str) -> DataFrame:
    """``df`` with both ends under their labels, the smaller first; pairs inside one label are gone."""
    if labels is not None:
        of = lambda c: labels.toDF(c, f"_{c}")
        df = df.join(of(x), x, "left").join(of(y), y, "left").withColumns({x: F.coalesce(f"_{x}", x), y: F.coalesce(f"_{y}", y)}).drop(f"_{x}", f"_{y}")
    return df.where(F.col(x) != F.col(y)).withColumns({x: F.least(x, y), y: F.greatest(x, y)})


def merge_round(edges: DataFrame, vetoes: DataFrame) -> DataFrame | None:
    """(node, root) of the clusters that merge now, or None if none can: edges (x, y, rank) without a veto, each cluster's best first.

    Two rules find merges that one edge after the other would make as well, so that they can be made at once. A cluster without
    vetoes goes along its best edge whatever its neighbour does before: it can't be refused, and brings no veto that could refuse
    another. A cluster with vetoes takes its neighbours in turn, as long as each has its best edge here, has no other edge that comes
    before the next turn, and no veto against one before it."""
    both = edges.select("x", "y", "rank").union(edges.select(F.col("y"), F.col("x"), F.col("rank")))
    both = materialize(both, "both")
    best = both.groupBy("x").agg(F.min_by(F.struct("y", "rank"), "rank").alias("e")).select("x", F.col("e.y").alias("y"), F.col("e.rank").alias("rank"))
    if both.isEmpty():
        return None
    later = both.join(best.select("x", F.col("rank").alias("own")), "x").where("rank > own").groupBy("x").agg(F.min("rank").alias("second"))
    barred = vetoes.select("x").union(vetoes.select("y")).distinct().withColumn("barred", F.lit(True))
    turns = both.join(best.select(F.col("x").alias("y"), F.col("rank").alias("theirs")), "y").withColumn("good", F.col("rank") == F.col("theirs"))
    turns = materialize(turns.join(later.withColumnRenamed("x", "y"), "y", "left").select("x", "y", "rank", "good", "second"), "turns")
    limit = turns.groupBy("x").agg(F.least(F.min(F.when(~F.col("good"), F.col("rank"))), F.min(F.when(F.col("good"), F.col("second")))).alias("limit"))
    beside = turns.select("x", "y", "rank").toDF("hub", "x", "rx").join(vetoes, "x").join(turns.select("x", "y", "rank").toDF("hub", "y", "ry"), ["hub", "y"])
    clash = beside.groupBy(F.col("hub").alias("x")).agg(F.min(F.greatest("rx", "ry")).alias("clash"))
    bound = limit.join(clash, "x", "left").select("x", F.least("limit", "clash").alias("bound"))
    taken = turns.where("good").join(bound, "x", "left").where(F.col("bound").isNull() | (F.col("rank") < F.col("bound"))).select("x", "y")
    free = best.join(barred, "x", "left_anti").select("x", "y")
    return _followed(taken.select(F.col("y").alias("node"), F.col("x").alias("root")).union(free).distinct())


def _followed(hooks: DataFrame) -> DataFrame:
    """(node, root): where following hooks (one from a node at most) ends. Two that hook to each other end at the smaller; paths double."""
    back = hooks.select(F.col("root").alias("node"), F.col("node").alias("root"), F.lit(True).alias("back"))
    one_way = hooks.join(back, ["node", "root"], "left").where(F.col("back").isNull() | (F.col("node") > F.col("root")))
    step = materialize(one_way.select("node", "root", F.lit(True).alias("moved")), "hooks")
    while not step.where("moved").isEmpty():
        ahead = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = materialize(step.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "hooks")
    return step.select("node", "root")


def _within(edges: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Vetoes between clusters that edges still connect; the others can refuse nothing."""
    if vetoes.isEmpty():
        return vetoes
    home = connected_components(edges, "x", "y")
    return vetoes.join(home.toDF("x", "hx"), "x").join(home.toDF("y", "hy"), "y").where("hx = hy").select("x", "y")


def split_vetoed(pairs: DataFrame, component: DataFrame, key: str) -> DataFrame:
    """(key, cluster) of every row of ``component`` (key, its component): greedy merges of matched pairs by falling score; one that would
    join a vetoed pair is refused. Equal scores go by a hash of the pair, then by its ids, so that ties don't make chains.

    ``pairs``: a, b, score, decision (match, or veto and a reason). Rounds of joins over tables of clusters: in each the edges that
    greedy merging is bound to take are taken together, all over the component, and clusters, edges and vetoes are relabelled. So
    neither a component nor a cluster is in one task; a round leaves at most one edge and one veto for a pair of clusters. The number of rounds grows with
    the logarithm of a component, unless scores fall along a long chain of clusters that all have vetoes against others that edges still
    connect. ``cluster`` is the smallest key in it. Pairs with a null id or score are left out."""
    known = pairs.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    rank = F.struct((-F.col("score")).alias("s"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("h"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = known.where("decision = 'match' AND score IS NOT NULL").select(F.col("a").alias("x"), F.col("b").alias("y"), rank.alias("rank"))
    vetoes = known.where(F.col("decision").startswith("veto")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    labels, moved = component.toDF("node", "home").select("node", F.col("node").alias("label")), None
    labels, turn = materialize(labels.distinct(), "labels"), 0
    while True:
        vetoes = materialize(_pairwise(vetoes, moved, "x", "y").distinct(), "vetoes")
        edges = _pairwise(edges, moved, "x", "y").groupBy("x", "y").agg(F.min("rank").alias("rank")).join(vetoes, ["x", "y"], "left_anti")
        edges = materialize(edges, "edges")
        if turn % 2 == 0:
            vetoes = materialize(_within(edges, vetoes), "vetoes")
        moved, turn = merge_round(edges, vetoes), turn + 1
        if moved is None:
            break
        labels = materialize(labels.join(moved.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
    least = labels.groupBy("label").agg(F.min("node").alias("cluster"))
    return labels.join(least, "label").select(F.col("node").alias(key), "cluster")


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _hashed(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of longs, as ``xxhash64`` has it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = (seed + p5 + np.uint64(8)) ^ (_rotated(x * p2, 31) * p1)
    h = _rotated(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def merged_rows(keys: np.ndarray, columns: dict[str, Known], decide: Decide) -> np.ndarray:
    """For rows of rising keys the place of the first one in the cluster of each: what ``split_vetoed`` makes of all their pairs. Matched pairs
    are held, vetoes as one bit a pair."""
    n = len(keys)
    vetoes, found, step = [], [], max(1, AT_ONCE // n)
    own = lambda at: {c: (v[at], null[at]) for c, (v, null) in columns.items()}
    for start in range(0, n, step):
        rows = slice(start, min(n, start + step))
        score, match, veto = (np.broadcast_to(x, (rows.stop - start, n)) for x in decide(own((rows, None)), own((None, slice(None)))))
        vetoes += [int.from_bytes(bits.tobytes(), "little") for bits in np.packbits(veto, axis=1, bitorder="little")]
        x, y = np.nonzero(match & ~veto & (np.arange(n) > np.arange(start, rows.stop)[:, None]))
        found.append((score[x, y], (x + start).astype("i4"), y.astype("i4")))
    score, x, y = (np.concatenate(c) for c in zip(*found))
    by_hash = _hashed(keys[y].view("u8"), _hashed(keys[x].view("u8"), np.full(len(x), 42, "u8"))).view("i8")
    order = np.lexsort((y, x, by_hash, -score))
    x, y, root = x[order].astype("i8"), y[order].astype("i8"), list(range(n))
    members = [1 << i for i in range(n)]

    def first(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    while len(x):
        for a, b in zip(x[: 4 * n].tolist(), y[: 4 * n].tolist()):
            a, b = first(a), first(b)
            if a != b and not vetoes[a] & members[b]:
                a, b = min(a, b), max(a, b)
                root[b], members[a], vetoes[a] = a, members[a] | members[b], vetoes[a] | vetoes[b]
        # later edges of two clusters go the way of their first one: both are one by then, or stay apart
        at = np.array([first(i) for i in range(n)])
        x, y = at[x[4 * n :]], at[y[4 * n :]]
        x, y = np.minimum(x, y), np.maximum(x, y)
        apart = np.flatnonzero(x != y)
        apart = apart[np.sort(np.unique(x[apart] * n + y[apart], return_index=True)[1])]
        x, y = x[apart], y[apart]
    return np.array([first(i) for i in range(n)])


def merge_blocks(rows: DataFrame, key: str, by: list[str], columns: list[str], decide: Decide, pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, cluster) of ``rows``, one a key: ``split_vetoed`` over the pairs of rows that agree in ``by`` (none null), without writing pairs.

    A block of up to ``LIMIT`` rows is merged in its task, which decides its pairs from ``columns`` (numbers): ``decide`` gives (score, match,
    veto) of two sets of rows, each column as its values and where it is null. So rows are shuffled, and pairs neither shuffled nor
    written. Larger blocks go through rounds of joins over ``pairs`` of their rows, with the same decisions. ``key`` is a long."""
    rows = rows.where(F.col(key).isNotNull()).select(key, *by, *columns)
    block = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_block")).where("_n > 1")
    rows = materialize(rows.join(block, by, "left"), "blocks")

    def merge(batches):
        held = None

        def clusters(batch):
            named = batch.column("_block").to_numpy()
            keys = batch.column(key).to_numpy()
            values = {c: (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False), batch.column(c).is_null().to_numpy(zero_copy_only=False)) for c in columns}
            edges = [0, *(np.flatnonzero(np.diff(named)) + 1).tolist(), len(named)]
            out = [keys[a:b][merged_rows(keys[a:b], {c: (v[a:b], null[a:b]) for c, (v, null) in values.items()}, decide)] for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.concatenate(out))], [key, "cluster"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            # the last block may go on in the next batch
            ends = np.flatnonzero(np.diff(batch.column("_block").to_numpy()))
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                yield clusters(batch.slice(0, whole))
            held = batch.slice(whole)
        if held is not None and held.num_rows:
            yield clusters(held)

    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    small = rows.where(F.col("_n") <= LIMIT).select("_block", F.col(key).cast("long").alias(key), *numbers)
    out = small.repartition("_block").sortWithinPartitions("_block", key).mapInArrow(merge, f"{key} long, cluster long")
    out = out.unionByName(rows.where(F.col("_n").isNull()).select(key, F.col(key).alias("cluster")))
    large = rows.where(F.col("_n") > LIMIT).drop("_n", "_block")
    if not large.isEmpty():
        decided = pairs(large)
        home = connected_components(decided.where("decision = 'match'")).toDF(key, "home")
        out = out.unionByName(split_vetoed(decided, large.select(key).join(home, key, "left").select(key, F.coalesce("home", key).alias("home")), key))
    return out
