"""Exact top-k inner products by a dual-tree search over a cover tree."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.sampling import picked
from marketloom.session import materialize

K, EVERY, SCALE = 5, 50, 256
#: Vectors that the tree's upper centres are chosen from and whose scores give first bounds; every vector is indexed and searched.
SAMPLE = 4096
#: Vectors a leaf aims at, nodes below one at most (on each of two levels, so no more than 65,536 leaves), and rows of either side in a block.
LEAF_ROWS, MAX_LEAVES, BLOCK = 2048, 256, 4096
#: Leaves of the largest inner product with a query that it searches first, for a bound, and queries that are routed at a time.
NEAR, ROUTED = 3, 256


@dataclass
class Node:
    """A ball: all vectors below lie within ``radius`` of ``center``. ``leaf`` numbers nodes without children."""

    center: np.ndarray
    children: list[Node] = field(default_factory=list)
    leaf: int = -1
    radius: float = 0.0
    query_radius: float = 0.0
    worst: float = np.inf
    queries: int = 0
    rows: int = 0


def build_tree(points: np.ndarray, leaves: int) -> tuple[Node, np.ndarray]:
    """A cover tree over ``points``, radii halving from level to level until there are ``leaves`` nodes, and its leaf centres."""
    root = Node(points.mean(axis=0))
    reach = float(np.sqrt(((points - root.center) ** 2).sum(axis=1)).max(initial=0.0))
    level = [(root, points)]
    while len(level) < leaves and reach > 1:
        reach, below = reach / 2, []
        for node, own in level:
            gap = np.full(len(own), np.inf)
            owner, centers, at = np.zeros(len(own), "int64"), [], 0
            while gap.max(initial=-1.0) > reach and len(below) + len(centers) < leaves:
                centers.append(own[at])
                d = np.sqrt(((own - own[at]) ** 2).sum(axis=1))
                owner[d < gap] = len(centers) - 1
                gap, at = np.minimum(gap, d), 0
                at = int(gap.argmax())
            if len(centers) < 2:
                below.append((node, own))
                continue
            node.children = [Node(c) for c in centers]
            below += [(child, own[owner == k]) for k, child in enumerate(node.children)]
        level = below
    for k, (node, _) in enumerate(level):
        node.leaf = k
    return root, np.stack([node.center for node, _ in level])


def cover(node: Node, leaves: dict[int, dict]) -> Node:
    """Fills in radii, counts and the queries' worst kth score from the leaves up."""
    if node.leaf >= 0:
        own = leaves.get(node.leaf, {})
        node.radius, node.rows = own.get("radius") or 0.0, own.get("rows") or 0
        node.query_radius, node.queries = own.get("query_radius") or 0.0, own.get("queries") or 0
        node.worst = own["worst"] if node.queries else np.inf
        return node
    for c in node.children:
        cover(c, leaves)
        far = float(np.sqrt(((node.center - c.center) ** 2).sum()))
        node.rows, node.queries, node.worst = node.rows + c.rows, node.queries + c.queries, min(node.worst, c.worst)
        node.radius = max(node.radius, far + c.radius if c.rows else 0.0)
        node.query_radius = max(node.query_radius, far + c.query_radius if c.queries else 0.0)
    return node


def pairs_left(q: Node, d: Node, out: list[tuple[int, int]]) -> None:
    """Leaf pairs (query leaf, data leaf) that no bound excludes: a pair goes if even the best product of the two balls is below
    the worst kth score of the queries' ball."""
    if not q.queries or not d.rows:
        return
    norm = lambda x: float(np.sqrt((x**2).sum()))
    best = float(q.center @ d.center) + q.query_radius * norm(d.center) + d.radius * norm(q.center) + q.query_radius * d.radius
    if best < q.worst - 1e-6 * max(1.0, abs(best)):
        return
    if q.leaf >= 0 and d.leaf >= 0:
        out.append((q.leaf, d.leaf))
    elif d.leaf >= 0 or q.leaf < 0 and q.query_radius > d.radius:
        for c in q.children:
            pairs_left(c, d, out)
    else:
        for c in d.children:
            pairs_left(q, c, out)


def best_rows(q: np.ndarray, qid: np.ndarray, floor: np.ndarray, d: np.ndarray, did: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a block for each query, none below the query's floor, smaller ids first among equals."""
    order = np.argsort(did, kind="stable")
    d, did = d[order], did[order]
    score = np.rint(q @ d.T).astype("int64")
    own = did[None, :] == qid[:, None]
    rank = np.where(own, np.iinfo("int64").min, score * len(did) + np.arange(len(did) - 1, -1, -1))
    top = np.argpartition(rank, len(did) - min(k, len(did)), axis=1)[:, -k:]
    row = np.repeat(np.arange(len(qid)), top.shape[1])
    col = top.ravel()
    keep = ~own[row, col] & (score[row, col] >= floor[row])
    row, col = row[keep], col[keep]
    return pd.DataFrame({"query_id": qid[row], "vec_id": did[col], "score": score[row, col]})


def best_products(q: Node, centers: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What the inner product of a query of ``q`` and a vector of each ball can be at most."""
    return centers @ q.center + q.query_radius * np.sqrt((centers**2).sum(axis=1)) + radius * (np.sqrt((q.center**2).sum()) + q.query_radius)


def allowed_leaves(root: Node, parents: list[int], centers: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """(query group x leaf): the pairs that no bound excludes, down the pairs of upper nodes and then over their leaves."""
    pairs, groups = [], {}
    pairs_left(root, root, pairs)
    leaves_of = {}
    for k, p in enumerate(parents):
        leaves_of.setdefault(p, []).append(k)

    def nodes(node: Node):
        if node.leaf >= 0:
            groups[node.leaf] = node
        for c in node.children:
            nodes(c)

    nodes(root)
    out = np.zeros((len(groups), len(centers)), bool)
    for q, d in pairs:
        own = np.array(leaves_of.get(d, []), "i8")
        best = best_products(groups[q], centers[own], radius[own])
        out[q, own] = best >= groups[q].worst - 1e-6 * np.maximum(1.0, np.abs(best))
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, worked: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query, ties to the smaller vec_id.

    Components become floor(scale * x). Queries are rows whose vec_id ``every`` divides; candidates all rows of another vec_id.
    One cover tree holds both. Its upper nodes come from a bounded sample; a node with many vectors gets leaves below it, whose
    centres are vectors of its own, so a leaf holds about ``leaf_rows`` until there are 65,536 leaves. Every vector goes to its
    nearest leaf, and radii cover all rows. Each query first searches the few leaves of the largest product; the kth score found
    is its bound. Then node pairs are pruned by covering radii against the worst bound of the query group, the lowest level being
    a single query, and what is left is multiplied in blocks of bounded size. ``worked`` gets the products that each search takes.

    Null vectors, null or non-finite components, null ids and vectors of another than the most frequent length take no part; of
    query rows with one id the smallest vector asks; repeated rows are candidates each; fewer than k candidates give fewer rows.
    Other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    schema = "query_id long, rank int, vec_id long, score long"
    usual = ints.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usual is None or not usual["n"]:
        return spark.createDataFrame([], schema)
    ints, total = ints.where(F.size("v") == usual["n"]), usual["count"]
    seed = ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    points, ids = np.stack(seed["v"].to_numpy()), seed["vec_id"].to_numpy("int64")
    root, upper = build_tree(points, int(min(MAX_LEAVES, max(1, total // leaf_rows))))

    def nearest(m: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        leaf = ((to**2).sum(axis=1) - 2 * (m @ to.T)).argmin(axis=1)
        return leaf, np.sqrt(((m - to[leaf]) ** 2).sum(axis=1))

    def index(batches):
        for b in batches:
            if len(b):
                node, gap = nearest(np.stack(b["v"].to_numpy()), upper)
                yield b.assign(node=node.astype("int32"), gap=gap)

    def first_floor(batches):
        for b in batches:
            if len(b):
                m, own = np.stack(b["v"].to_numpy()), b["vec_id"].to_numpy("int64")
                node, gap = nearest(m, upper)
                score = np.where(ids[None, :] == own[:, None], -np.inf, np.rint(m @ points.T))
                low = np.sort(score, axis=1)[:, -k] if len(ids) >= k else np.full(len(own), -np.inf)
                yield b.assign(node=node.astype("int32"), gap=gap, floor=low)

    data = materialize(ints.mapInPandas(index, "vec_id long, v array<double>, node int, gap double"), "index")
    asked = ints.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked.mapInPandas(first_floor, "vec_id long, v array<double>, node int, gap double, floor double"), "asked")

    stats: dict[int, dict] = {n: {} for n in range(len(upper))}
    for r in data.groupBy("node").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("rows")).collect():
        stats[r["node"]] |= r.asDict()

    # leaves of nodes with many vectors: a hash picks about as many of its vectors as it needs leaves, for centres
    wanted = {n: min(MAX_LEAVES, r["rows"] // leaf_rows) for n, r in stats.items() if r.get("rows", 0) >= 2 * leaf_rows}
    pick = F.lit(False)
    for n, w in wanted.items():
        pick = pick | ((F.col("node") == n) & picked(w / stats[n]["rows"], "vec_id", F.lit("centre")))
    own = {n: [] for n in range(len(upper))}
    for r in data.where(pick).select("node", "v").collect() if wanted else []:
        own[r["node"]].append(r["v"])
    parents = [n for n in own for _ in own[n] or [0]]
    centers = np.array([c for n in own for c in own[n] or [upper[n]]])
    first = np.searchsorted(parents, np.arange(len(upper) + 1))

    def deeper(batches):
        for b in batches:
            if len(b):
                m, node = np.stack(b["v"].to_numpy()), b["node"].to_numpy()
                leaf, gap = np.zeros(len(m), "int32"), np.zeros(len(m))
                for n in np.unique(node):
                    at = np.flatnonzero(node == n)
                    near, gap[at] = nearest(m[at], centers[first[n] : first[n + 1]])
                    leaf[at] = first[n] + near
                yield pd.DataFrame({"vec_id": b["vec_id"], "v": b["v"], "leaf": leaf, "gap": gap})

    data = materialize(data.mapInPandas(deeper, "vec_id long, v array<double>, leaf int, gap double"), "leaves")
    radius, rows = np.zeros(len(centers)), np.zeros(len(centers), "int64")
    for r in data.groupBy("leaf").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("rows")).collect():
        radius[r["leaf"]], rows[r["leaf"]] = r["radius"], r["rows"]

    def group_stats(asked: DataFrame) -> np.ndarray:
        groups = {n: {"radius": s.get("radius"), "rows": s.get("rows")} for n, s in stats.items()}
        for r in asked.groupBy("node").agg(F.max("gap").alias("query_radius"), F.count(F.lit(1)).alias("queries"), F.min("floor").alias("worst")).collect():
            groups[r["node"]] |= r.asDict()
        cover(root, groups)
        return allowed_leaves(root, parents, centers, radius) & (rows > 0)

    def route(open_pairs: np.ndarray, most: int | None):
        """Of each query the leaves to search: all that its own bound leaves, or the ``most`` of the largest product."""

        def run(batches):
            for b in batches:
                for at in range(0, len(b), ROUTED):
                    q = b.iloc[at : at + ROUTED]
                    m, may = np.stack(q["v"].to_numpy()), open_pairs[q["node"].to_numpy()]
                    product = m @ centers.T
                    if most:
                        product = np.where(may, product, -np.inf)
                        top = np.argpartition(-product, min(most, len(centers)) - 1, axis=1)[:, :most]
                        may = np.zeros_like(may)
                        np.put_along_axis(may, top, np.isfinite(np.take_along_axis(product, top, axis=1)), axis=1)
                    else:
                        best = product + np.sqrt((m**2).sum(axis=1))[:, None] * radius
                        may = may & (best >= q["floor"].to_numpy()[:, None] - 1e-6 * np.maximum(1.0, np.abs(best)))
                    row, leaf = np.nonzero(may)
                    yield pd.DataFrame({"vec_id": q["vec_id"].to_numpy()[row], "leaf": leaf.astype("int32")})

        return run

    def search(asked: DataFrame, most: int | None, tag: str) -> DataFrame:
        """query_id, rank, vec_id, score of the best ``k`` in the leaves that ``asked`` is routed to."""
        ways = materialize(asked.mapInPandas(route(group_stats(asked), most), "vec_id long, leaf int"), tag)
        asking = {r["leaf"]: r["count"] for r in ways.groupBy("leaf").count().collect()}
        if worked is not None:
            worked.append(sum(int(rows[leaf]) * n for leaf, n in asking.items()))
        blocks = [(leaf, -(-int(rows[leaf]) // BLOCK), -(-n // BLOCK)) for leaf, n in asking.items()]
        salt = lambda c, n: F.pmod(F.xxhash64("vec_id", F.lit(c)), F.col(n)).cast("int")
        sizes = F.broadcast(spark.createDataFrame(blocks, "leaf int, data_blocks int, query_blocks int"))
        every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        ask = ways.join(sizes, "leaf").join(asked.select("vec_id", "v", "floor"), "vec_id").withColumn("qb", salt("query", "query_blocks"))
        ask = ask.withColumn("db", every_block("data_blocks")).select("leaf", "db", "qb", "vec_id", "v", "floor")
        held = data.join(sizes, "leaf").withColumn("db", salt("data", "data_blocks")).withColumn("qb", every_block("query_blocks")).select("leaf", "db", "qb", "vec_id", "v")
        key = ["leaf", "db", "qb"]
        found = held.groupBy(*key).cogroup(ask.groupBy(*key)).applyInPandas(multiply, "query_id long, vec_id long, score long")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def multiply(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(d) or not len(q):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        m, own = np.stack(d["v"].to_numpy()), d["vec_id"].to_numpy("int64")
        parts = [q.iloc[at : at + 512] for at in range(0, len(q), 512)]
        return pd.concat([best_rows(np.stack(p["v"].to_numpy()), p["vec_id"].to_numpy("int64"), p["floor"].to_numpy(), m, own, k) for p in parts])

    if not asked.isEmpty() and len(centers) > NEAR:
        kth = search(asked, NEAR, "near").where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
        asked = materialize(asked.join(kth, "vec_id", "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", "floor"))).drop("kth"), "bounds")
    return search(asked, None, "ways") if not asked.isEmpty() else spark.createDataFrame([], schema)


def op10_cover_tree_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_sql() -> str:
    return f"""
    WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e AS q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
    """


QUERIES = {"op10_cover_tree_topk": op10_cover_tree_topk}
SQL = {"op10_cover_tree_topk": op10_sql()}
