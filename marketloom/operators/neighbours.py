"""Exact nearest neighbours by cosine, by way of cells around pivots."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.session import materialize

#: Bytes that all pivots may take, rows of the data and queries in a group, and nearest cells that give a query its first bound.
PIVOT_BYTES, BLOCK, ASKS, NEAR = 4 << 20, 2048, 1024, 2
#: Digits of a cosine that count, half a unit of the last of them as a squared distance, and what rounding may do to a distance.
DIGITS, UNIT, SLACK = 12, 4e-12, 2e-6


def unit_vectors(rows: DataFrame) -> DataFrame:
    """id, v: vectors of length one. Null, empty and zero vectors and such with null or non-finite components take no part."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    known = rows.where(fine).select(F.col("vec_id").alias("id"), v.alias("v")).withColumn("size", size).where("id IS NOT NULL AND size > 0")
    return known.select("id", F.transform("v", lambda x: x / F.col("size")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _away(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of unit vectors to the pivots."""
    return np.sqrt(np.maximum(2 - 2 * (v @ pivots.T), 0))


class Cells:
    """Voronoi cells around pivots: how many vectors each holds, and between which distances of its pivot."""

    def __init__(self, pivots: np.ndarray, facts: list):
        self.pivots = pivots
        self.sizes, self.low, self.high = np.zeros(len(pivots), int), np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        for r in facts:
            self.sizes[r["cell"]], self.low[r["cell"]], self.high[r["cell"]] = r["n"], r["low"], r["high"]
        between = _away(pivots, pivots)
        self.between = np.where(between > 0, between, np.inf)

    def nearest(self, away: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For each query the ``NEAR`` nearest cells, and more until they hold ``wanted`` vectors."""
        order = np.argsort(away, axis=1, kind="stable")
        enough = (np.cumsum(self.sizes[order], axis=1) < wanted).sum(axis=1) + 1
        return [o[: max(NEAR, n)] for o, n in zip(order, enough, strict=True)]

    def reachable(self, away: np.ndarray, within: np.ndarray) -> list[np.ndarray]:
        """For each query the cells that may hold a vector ``within`` a distance of it.

        By the triangle inequality no vector of a cell is nearer than the pivot's distance less the cell's radius, nor than its
        inner radius less that distance; and all of a cell lie on their pivot's side of the plane halfway to the query's own."""
        own = away.argmin(axis=1)
        plane = (away**2 - away[np.arange(len(away)), own][:, None] ** 2) / (2 * self.between[own])
        least = np.maximum(np.maximum(away - self.high, self.low - away), plane)
        return [np.flatnonzero((x <= t + SLACK) & (self.sizes > 0)) for x, t in zip(least, within, strict=True)]


def into_cells(data: DataFrame) -> tuple[Cells, DataFrame]:
    """The cells of ``data`` (id, v), and its rows with their cell. Pivots are some of the vectors, by a hash of the id: about the
    square root of their number, ``PIVOT_BYTES`` at most."""
    first, rows = data.select("v").head(), data.count()
    most = max(1, PIVOT_BYTES // (8 * max(1, len(first["v"])))) if first else 1
    chosen = data.orderBy(F.xxhash64("id"), "id").limit(max(1, min(math.isqrt(rows), most))).select("v").collect()
    pivots = np.unique(np.array([r["v"] for r in chosen], "f8"), axis=0) if chosen else np.zeros((0, 0))

    def place(batches):
        for b in batches:
            away = _away(_matrix(b.column("v")), pivots)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, "int32"), pa.array(away[np.arange(len(cell)), cell])], ["id", "v", "cell", "away"])

    placed = materialize(data.select("id", "v").mapInArrow(place, "id long, v array<double>, cell int, away double"), "cells")
    facts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()
    return Cells(pivots, facts), placed


def best_of(cosines: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest of the rounded cosines, ties to the smaller id."""
    if len(ids) > 4 * k:
        edge = np.partition(cosines, len(ids) - k)[len(ids) - k]
        near = np.flatnonzero(cosines >= edge)
        return near[np.lexsort((ids[near], -cosines[near]))][:k]
    return np.lexsort((ids, -cosines))[:k]


def _pages(cells: Cells) -> tuple[np.ndarray, np.ndarray]:
    """A page for each cell, and the rows of each page: neighbouring cells share a page of about 8 * ``BLOCK`` rows, a larger cell has its own."""
    page, rows = np.zeros(len(cells.sizes), int), []
    for c in np.argsort(cells.between[0], kind="stable"):
        if not rows or rows[-1] + cells.sizes[c] > 8 * BLOCK:
            rows.append(0)
        page[c] = len(rows) - 1
        rows[-1] += int(cells.sizes[c])
    return page, np.array(rows, int)


def _above(reps: np.ndarray, worst: np.ndarray, left: np.ndarray, ids: np.ndarray, right: np.ndarray, k: int):
    """Parts of (rep, id, cosine): the best ``k`` of each query that reach its bound; only these are rounded and leave the task."""
    for at in range(0, len(reps), 512):
        cosines = left[at : at + 512] @ right.T
        q, d = np.nonzero(cosines >= (worst[at : at + 512] - 1e-11)[:, None])
        near = np.round(cosines[q, d], DIGITS)
        order = np.lexsort((ids[d], -near, q))
        q, d, near = q[order], d[order], near[order]
        few = np.arange(len(q)) - np.searchsorted(q, q) < k
        yield reps[at + q[few]], ids[d[few]], near[few]


def _on_pages(asks: DataFrame, page: np.ndarray) -> DataFrame:
    """``asks`` with the pages of the visited cells, each once."""

    def turn(batches):
        for b in batches:
            found = [np.unique(page[np.array(x, int)]).tolist() for x in b.column("visits").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("v"), pa.array(found, pa.list_(pa.int32())), b.column("worst")], ["rep", "v", "visits", "worst"])

    return materialize(asks.mapInArrow(turn, asks.schema), "pages")


def _search(cells: Cells, placed: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(rep, id, cosine): for each query of ``asks`` (rep, v, visits) the best ``k`` of each block of the cells that it visits.

    A cell is dealt over blocks of the data and of the queries by hashes; each pair of blocks is one matrix product in a group of
    its own, so neither a large cell nor one that all ask for is in one task. Queries with a ``worst`` neighbour may visit most cells:
    they go to pages of cells, once to each, in larger blocks, and bring home only what reaches that bound."""
    bounded = "worst" in asks.columns
    block, most = (8 * BLOCK, 16 * ASKS) if bounded else (BLOCK, ASKS)
    page, rows = _pages(cells) if bounded else (np.arange(len(cells.sizes)), cells.sizes)
    to_page = asks.sparkSession.createDataFrame(list(enumerate(page.tolist())), "cell int, page int")
    if bounded:
        asks = _on_pages(asks, page)
    visited = asks.select("rep", F.explode("visits").alias("page"))
    counts = {r["page"]: r["n"] for r in visited.groupBy("page").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = np.maximum(1, -(-rows // block))
    turns = np.array([max(1, -(-counts.get(c, 0) // most)) for c in range(len(parts))], int)
    table = asks.sparkSession.createDataFrame([(c, int(p), int(t)) for c, (p, t) in enumerate(zip(parts, turns, strict=True)) if c in counts] or [(-1, 1, 1)], "page int, parts int, turns int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n, by: F.pmod(F.xxhash64(F.col(c), F.lit(by)), F.col(n)).cast("int")
    bound = ["worst"] if bounded else []
    left = asks.select("rep", "v", *bound, F.explode("visits").alias("page")).join(F.broadcast(table), "page").select("rep", "v", *bound, "page", dealt("rep", "turns", "ask").alias("turn"), every("parts").alias("part"))
    right = placed.join(F.broadcast(to_page), "cell").join(F.broadcast(table), "page").select("id", "v", "page", dealt("id", "parts", "row").alias("part"), every("turns").alias("turn"))

    def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))]
        if len(x) and len(y):
            ids, reps, m, other = y["id"].to_numpy("i8"), x["rep"].to_numpy("i8"), np.stack(x["v"].to_numpy()), np.stack(y["v"].to_numpy())
            if bounded:
                out.extend(_above(reps, np.nan_to_num(x["worst"].to_numpy("f8"), nan=-np.inf), m, ids, other, k))
            else:
                for rep, cosines in zip(reps, np.round(m @ other.T, DIGITS), strict=True):
                    top = best_of(cosines, ids, k)
                    out.append((np.full(len(top), rep), ids[top], cosines[top]))
        rep, ids, cosines = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"rep": rep, "id": ids, "cosine": cosines})

    keys = ["page", "part", "turn"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, "rep long, id long, cosine double")


def visits(cells: Cells, asked: DataFrame, wanted: int, found: DataFrame | None = None) -> DataFrame:
    """(rep, v, visits): the cells that each query goes to. At first its nearest; then, with what these gave as ``found``, all others
    that could hold one of its ``wanted`` best."""
    again = found is not None

    def plan(batches):
        for b in batches:
            away = _away(_matrix(b.column("v")), cells.pivots)
            go = cells.nearest(away, wanted)
            if again:
                worst = b.column("worst").to_numpy(zero_copy_only=False)
                within = np.sqrt(np.maximum(2 - 2 * np.where(np.isnan(worst), -np.inf, worst) + UNIT, 0))
                go = [np.setdiff1d(x, seen) for x, seen in zip(cells.reachable(away, within), go, strict=True)]
            bound = {"worst": b.column("worst")} if again else {}
            yield pa.RecordBatch.from_pydict({"rep": b.column("rep"), "v": b.column("v"), "visits": pa.array([g.tolist() for g in go], pa.list_(pa.int32())), **bound})

    if again:
        place = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("cosine"), "id"))
        worst = found.withColumn("place", place).where(F.col("place") == wanted).select("rep", F.col("cosine").alias("worst"))
        asked = asked.join(worst, "rep", "left")
    return materialize(asked.mapInArrow(plan, "rep long, v array<double>, visits array<int>" + (", worst double" if again else "")).where(F.size("visits") > 0), "visits")


def nearest_vectors(queries: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, cosine, place): exact ``k`` nearest other rows by cosine (to ``DIGITS`` digits) of each query, ties to the smaller id.

    Rows that repeat count once. Equal vectors ask once, and of equal ones in the data only the ``k + 1`` smallest ids can be among anyone's nearest. A query
    searches its nearest cells, and then those that its worst neighbour so far does not rule out. No side is gathered; the driver
    has pivots and a count per cell."""
    ranked = unit_vectors(data).distinct().withColumn("turn", F.row_number().over(W.partitionBy("v").orderBy("id")))
    base = materialize(ranked.where(F.col("turn") <= k + 1).select("id", "v"), "vectors")
    every = materialize(unit_vectors(queries).distinct(), "queries")
    heads = materialize(every.groupBy("v").agg(F.min("id").alias("rep")), "heads")
    cells, placed = into_cells(base)
    if not len(cells.pivots):
        return heads.select(F.col("rep").alias("query"), F.col("rep").alias("vec_id"), F.lit(0.0).alias("cosine"), F.lit(0).alias("place")).limit(0)
    first = materialize(_search(cells, placed, visits(cells, heads, k + 1), k + 1), "first")
    rest = _search(cells, placed, visits(cells, heads, k + 1, first), k + 1)
    best = lambda by: F.row_number().over(W.partitionBy(by).orderBy(F.desc("cosine"), "id"))
    both = first.unionByName(rest).dropDuplicates(["rep", "id"])  # a page may hold cells that were searched before
    top = materialize(both.withColumn("place", best("rep")).where(F.col("place") <= k + 1).drop("place"), "top")
    own = every.join(heads, "v").select(F.col("id").alias("query"), "rep").join(top, "rep").where("query <> id")
    return own.withColumn("place", best("query")).where(F.col("place") <= k).select("query", F.col("id").alias("vec_id"), "cosine", "place")


def similar_pairs(data: DataFrame, k: int = 3, least: float = 0.55) -> DataFrame:
    """(a, b): each pair once of which one is among the other's ``k`` nearest, with a cosine of ``least`` or more. All rows ask."""
    near = nearest_vectors(data, data, k).where(F.col("cosine") >= least)
    return near.select(F.least("query", "vec_id").alias("a"), F.greatest("query", "vec_id").alias("b")).distinct()
