"""Exact top-k by inner product with best-first search in M-trees.

With M the largest norm of a block, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have the distance
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so nearest neighbours of q' are the highest inner products. Vectors
are dealt to blocks, each block holds one tree of pages: an inner page has, for each child, its
routing vector, covering radius and distance to the page's own routing vector; a leaf has vectors with
that distance. A search takes pages by their least possible distance and skips, by the triangle
inequality on the stored distances, children and vectors before their own distance is computed. Scores
are exact integers; bounds have a margin for rounding, and equal scores are not pruned."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultscope.llm.common import arrow_table

PAGE, FANOUT = 128, 16
FOUND = "query_id bigint, vec_id bigint, score bigint"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Page:
    """``rows`` of a leaf, or ``children`` of an inner page; ``centers`` and ``radii`` are those of the
    children; ``from_parent`` are the distances of rows or children to this page's own center."""

    from_parent: np.ndarray
    rows: np.ndarray | None = None
    children: list[Page] = field(default_factory=list)
    centers: np.ndarray | None = None
    radii: np.ndarray | None = None


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def grow(points: np.ndarray, rows: np.ndarray, center: np.ndarray) -> Page:
    """A tree over ``rows`` of ``points``, bulk-loaded around far-apart routing vectors."""
    own = points[rows]
    to_center = _distances(own, center)
    if len(rows) <= PAGE:
        return Page(to_center, rows=rows)
    near, which, pick = np.full(len(rows), np.inf), np.zeros(len(rows), dtype=np.int64), int(to_center.argmax())
    centers = []
    for k in range(FANOUT):
        d = _distances(own, own[pick])
        closer = d < near
        near[closer], which[closer] = d[closer], k
        centers.append(pick)
        pick = int(near.argmax())
        if near[pick] == 0:
            break
    if near.max() == 0 and len(centers) == 1:  # equal vectors: any cut will do
        groups = np.array_split(np.arange(len(rows)), FANOUT)
        centers = [centers[0]] * FANOUT
    else:
        groups = [np.flatnonzero(which == k) for k in range(len(centers))]
    used = [(own[c], g) for c, g in zip(centers, groups, strict=True) if len(g)]
    return Page(
        np.array([float(_distances(c[None], center)[0]) for c, _ in used]),
        children=[grow(points, rows[g], c) for c, g in used],
        centers=np.array([c for c, _ in used]),
        radii=np.array([_distances(own[g], c).max() for c, g in used]),
    )


class Tree:
    """``ids`` and integer ``vectors`` of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        norms = np.einsum("ij,ij->i", vectors, vectors).astype(np.float64)
        self.ids, self.vectors, self.most = ids, vectors, float(norms.max())
        points = np.hstack([vectors.astype(np.float64), np.sqrt(self.most - norms)[:, None]])
        self.center = points.mean(axis=0)
        self.root = grow(points, np.arange(len(ids)), self.center)
        self.pages = 0

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id), highest first, smaller id first among equals."""
        point = np.append(query.astype(np.float64), 0.0)
        square = float(query.astype(np.float64) @ query) + self.most
        margin = 1e-6 * (1.0 + np.sqrt(square))
        best: list[tuple[int, int]] = []
        bound = np.inf
        queue = [(0.0, 0, float(_distances(self.center[None], point)[0]), self.root)]
        pushed = 0
        while queue and queue[0][0] <= bound:
            _, _, to_center, page = heapq.heappop(queue)
            self.pages += 1
            gap = np.abs(page.from_parent - to_center)
            if page.rows is not None:
                rows = page.rows[gap <= bound]
                scores = self.vectors[rows] @ query
                if len(best) == k:
                    high = scores >= best[-1][0]
                    rows, scores = rows[high], scores[high]
                found = [(int(s), int(i)) for s, i in zip(scores, self.ids[rows], strict=True) if i != query_id]
                if found:
                    best = sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best) == k:
                        bound = np.sqrt(max(0.0, square - 2.0 * best[-1][0])) + margin
                continue
            at = np.flatnonzero(gap - page.radii <= bound)
            distances = _distances(page.centers[at], point)
            for i, d in zip(at, distances, strict=True):
                least = max(0.0, d - page.radii[i])
                if least <= bound:
                    pushed += 1
                    heapq.heappush(queue, (least, pushed, float(d), page.children[i]))
        return best


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id`` and the components times 256, rounded down; without rows that take no part."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    fits = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(fits, F.lit(False))).select("vec_id", F.transform("x", lambda v: F.floor(v * 256).cast("long")).alias("x"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, row in enumerate(column.to_pylist()):
        out[i, :len(row)] = row
    return out


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, block_rows: int = 16_384, query_rows: int = 4096, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's ``k`` best other rows.

    ``is_query`` is a condition on the column ``vec_id``. The score is the inner product of
    floor(256 x); equal scores go by smaller id; with fewer rows all are given. Null vectors, vectors
    with a null or non-finite component and rows of null id take no part. Shorter vectors count as
    filled with zeros. Rows of equal id are never each other's result. Other columns are ignored.
    Components times 256 must stay below 2^20 for exact 64-bit scores.

    Each task holds ``block_rows`` vectors and ``query_rows`` queries on average, whatever their number."""
    rows = whole_vectors(vectors, vec_id, vector)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(F.size("x")).alias("w")).first()
    n_blocks, n_lots, width = max(1, -(-size["n"] // block_rows)), max(1, -(-size["q"] // query_rows)), max(1, size["w"] or 1)
    place = F.xxhash64("vec_id")
    block, lot = F.pmod(place, F.lit(n_blocks)).cast("int"), F.pmod(F.shiftright(place, 20), F.lit(n_lots)).cast("int")
    held = rows.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_lots - 1))).alias("lot"), "vec_id", "x")
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), lot.alias("lot"), "vec_id", "x")

    def search(ours: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(ours) or not len(queries):
            return _FOUND.empty_table()
        tree = Tree(ours["vec_id"].to_numpy(), _matrix(ours["x"], width))
        return arrow_table([
            {"query_id": key, "vec_id": i, "score": s}
            for key, query in zip(queries["vec_id"].to_pylist(), _matrix(queries["x"], width), strict=True)
            for s, i in tree.search(key, query, k)], _FOUND)

    found = held.groupBy("block", "lot").cogroup(asked.groupBy("block", "lot")).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
