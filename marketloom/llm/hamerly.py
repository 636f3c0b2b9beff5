"""Exact k-means over whole numbers with Hamerly's bounds."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.session import materialize

DIM, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: What rounding of square roots and of their sums could make of a bound, and more.
SLACK = 1e-9
#: Vectors that meet all centroids at a time, and the largest value of a long.
SCANNED, LONG = 4096, (1 << 63) - 1


def whole_vectors(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v: vectors of ``dim`` finite components as floor(scale * x); others are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.where((F.size("embedding") == dim) & F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("v"))


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``v`` to every row of ``c``: in doubles or longs while these hold every sum, else in Python numbers."""
    most = max(int(np.abs(x).max(initial=0)) if len(x) else 0 for x in (v.astype(object) if v.dtype == object else v, c))
    reach = 4 * max(1, v.shape[1]) * most * most
    if reach < 1 << 53:
        a, b = v.astype("f8"), c.astype("f8")
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype("i8")
    kind = "i8" if reach < 1 << 62 else object
    a, b = v.astype(kind), c.astype(kind)
    return np.stack([((a - x) ** 2).sum(axis=1) for x in b], axis=1)


def own_squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row of ``v`` to the same row of ``c``."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = "i8" if 4 * max(1, v.shape[1]) * most * most < 1 << 62 else object
    return ((v.astype(kind) - c.astype(kind)) ** 2).sum(axis=1)


def full_scan(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), distance to it and to the second nearest, of every row."""
    near, first, second = np.empty(len(v), "i4"), np.empty(len(v)), np.full(len(v), np.inf)
    for at in range(0, len(v), SCANNED):
        d, part = squared(v[at : at + SCANNED], centroids), slice(at, at + SCANNED)
        near[part] = d.argmin(axis=1)
        ordered = np.sort(d, axis=1)
        first[part] = np.sqrt(ordered[:, 0].astype("f8"))
        if d.shape[1] > 1:
            second[part] = np.sqrt(ordered[:, 1].astype("f8"))
    return near, first, second


def reassign(v: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> int:
    """Brings ``near``, ``upper`` and ``lower`` to new centroids that moved by ``drift``, in place; the number of full scans.

    ``upper`` holds a bound from above of the distance to the own centroid, ``lower`` one from below to any other. The first grows
    by what the own centroid moved, the second shrinks by the most that another moved. Where the upper bound stays below the lower
    one, or below half the way to the centroid nearest to the own, nothing can have changed; else the own distance is taken
    exactly, and what is still unsure meets all centroids.
    """
    k = len(centroids)
    order = np.argsort(-drift, kind="stable")
    others = np.where(np.arange(k) == order[0], drift[order[1]] if k > 1 else 0.0, drift[order[0]])
    apart = squared(centroids, centroids).astype("f8")
    np.fill_diagonal(apart, np.inf)
    half = np.sqrt(apart.min(axis=1)) / 2
    upper += drift[near]
    lower -= others[near]
    bound = np.maximum(lower, half[near])
    unsure = np.flatnonzero(upper * (1 + SLACK) >= bound * (1 - SLACK))
    upper[unsure] = np.sqrt(own_squared(v[unsure], centroids[near[unsure]]).astype("f8"))
    unsure = unsure[upper[unsure] * (1 + SLACK) >= bound[unsure] * (1 - SLACK)]
    near[unsure], upper[unsure], lower[unsure] = full_scan(v[unsure], centroids)
    return len(unsure)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _assigned(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """vec_id, v, cluster, upper, lower: the first time by full scans, then by the bounds that the rows carry."""
    dim = centroids.shape[1]

    def step(batches):
        for b in batches:
            v = _matrix(b.column("v"), dim)
            if drift is None:
                near, upper, lower = full_scan(v, centroids)
            else:
                near, upper, lower = (b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "upper", "lower"))
                reassign(v, near, upper, lower, centroids, drift)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near, "int32"), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "upper", "lower"])

    return rows.mapInArrow(step, T.StructType([*rows.schema.fields[:2], *(T.StructField(c, t) for c, t in (("cluster", T.IntegerType()), ("upper", T.DoubleType()), ("lower", T.DoubleType())))]))


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster; an empty one keeps its centroid. Sums are exact whole numbers; a row per cluster comes to the driver."""
    sums = [F.sum(F.get("v", F.lit(i)).cast("decimal(19,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    new = centroids.copy()
    for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(centroids.shape[1])]
    return new


def start_key(seed: int) -> Column:
    """Hex SHA-256 of ``<seed>:<vec_id>``; null ids are written as null."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)


def kmeans(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance) of every vector that counts, and the final centroids.

    Each round is one pass over a table that carries, beside a vector, its cluster and Hamerly's two bounds, and one sum per
    cluster; centroids (``clusters`` x ``dim`` numbers) are all that the driver holds. Distances are exact, so ties go to the
    smaller number. Vectors that are null, of another length, or hold null or non-finite components are left out; rows that repeat
    count each, null ids are allowed and start last of equal hashes; fewer vectors than clusters make as many clusters; other
    columns are ignored; an empty table gives an empty one. Components beyond 2^28 are summed in Python numbers; a squared distance
    beyond a long is given as the largest long.
    """
    base = materialize(whole_vectors(rows, dim, scale), "vectors")
    first = base.orderBy(start_key(seed), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], "i8").reshape(-1, dim)
    if not first:
        return base.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    state = materialize(_assigned(base, centroids, None), "assigned")
    for left in range(rounds - 1, -1, -1):
        new = _means(state, centroids)
        drift, centroids = np.sqrt(own_squared(new, centroids).astype("f8")), new
        state = _assigned(state, centroids, drift)
        state = materialize(state, "assigned") if left else state

    def measured(batches):
        for b in batches:
            d = own_squared(_matrix(b.column("v"), dim), centroids[b.column("cluster").to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("cluster"), pa.array([min(int(x), LONG) for x in d] if d.dtype == object else d, "int64")], ["vec_id", "v", "cluster", "distance"])

    out = state.mapInArrow(measured, T.StructType([*state.schema.fields[:3], T.StructField("distance", T.LongType())]))
    return materialize(out, "clustered"), centroids


def clustered(rows: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: ``kmeans`` with a row of facts for each cluster."""
    found, centroids = kmeans(rows, **options)
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}
    total = min(sum(sums.values()), LONG)
    facts = [(k, min(d, LONG), total, hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, d in sums.items()]
    facts = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_hamerly_kmeans(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_sql() -> str:
    def assign(r: int) -> str:
        return f"""a{r} AS (SELECT v.r, any_value(v.vec_id) AS vec_id, any_value(v.v) AS v, min((v.sq - 2 * list_inner_product(v.f, c.v::DOUBLE[]) + list_inner_product(c.v::DOUBLE[], c.v::DOUBLE[]))::HUGEINT * {CLUSTERS} + c.k) AS best
                  FROM kept v, c{r} c GROUP BY v.r)"""

    def means(r: int) -> str:
        return f"""m{r} AS (SELECT k, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM
                  (SELECT best % {CLUSTERS} AS k, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best, unnest(v) AS x, unnest(range({DIM})) AS i FROM a{r - 1}) GROUP BY ALL) GROUP BY k),
                c{r} AS (SELECT c.k, coalesce(m.v::BIGINT[], c.v) AS v FROM c{r - 1} c LEFT JOIN m{r} m ON m.k = c.k)"""

    steps = ",\n".join([assign(0), *(f"{means(r)},\n{assign(r)}" for r in range(1, ROUNDS + 1))])
    return f"""
    WITH kept AS (SELECT row_number() OVER () AS r, vec_id, v, v::DOUBLE[] AS f, list_inner_product(v::DOUBLE[], v::DOUBLE[]) AS sq FROM
      (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    c0 AS (SELECT k, v FROM (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, 'null')), v) - 1)::INT AS k, v FROM kept) WHERE k < {CLUSTERS}),
    {steps},
    f AS (SELECT vec_id, (best % {CLUSTERS})::INT AS cluster, (best // {CLUSTERS})::BIGINT AS distance FROM a{ROUNDS})
    SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM f JOIN c{ROUNDS} c ON c.k = f.cluster
    """


QUERIES = {"op13_hamerly_kmeans": op13_hamerly_kmeans}
SQL = {"op13_hamerly_kmeans": op13_sql()}
