"""Exact top-k by inner product: dual-tree search over cover trees.

Each cell of the query/candidate grid builds a cover tree of its queries and one of its candidates. A node has a
centre among its points and a covering radius; its children's centres cover it at a fraction of the radius, are that
far apart, and the first child keeps the centre. For query node Q and data node R every inner product is at most

    <q, r> + radius(Q) |r| + radius(R) |q| + radius(Q) radius(R)

with centres q and r. A pair is dropped when that is below the worst k-th score among Q's queries; otherwise both sides
descend, best bounds first. k-th scores are shared between cells: queries first meet one block of candidates, and the
k-th scores found there go with them into all cells, whose trees prune against them from the beginning.

Pruning follows the data: where vectors have no clusters (say, directions spread evenly over many dimensions) the bound
of every node lies above every k-th score, all pairs are multiplied, and the work is that of a blocked product.

Scores are exact whole numbers of up to 64 bits; a larger one is an error. Equal scores go to the smaller id, so ties
and repeated rows have one result: rows of one id are candidates one by one, and none is a candidate of that id's query.
An empty table or no query gives no row. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.llm.vectors import matrix, search, usable
from nestwright.llm.work import Workspace

_LEAF, _SHRINK = 48, 0.7


class CoverTree:
    """Nodes as parallel arrays: centre, radius, children or points."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray] = []
        self.members: list[np.ndarray] = []
        self._grow(np.arange(len(points)), 0)
        self.centre_points = points[self.centre]
        self.norms = np.linalg.norm(self.centre_points, axis=1)
        self.radii = np.array(self.radius)

    def _grow(self, inside: np.ndarray, centre: int) -> None:
        stack = [(inside, centre, -1)]
        links: list[list[int]] = []
        while stack:
            inside, centre, parent = stack.pop()
            me = len(self.centre)
            far = np.sqrt(((self.points[inside] - self.points[centre]) ** 2).sum(1))
            radius = float(far.max())
            self.centre.append(centre)
            self.radius.append(radius)
            self.members.append(inside)
            links.append([])
            if parent >= 0:
                links[parent].append(me)
            if len(inside) <= _LEAF or radius == 0:
                continue
            reach, alone = radius * _SHRINK, []
            while len(inside):
                near = far <= reach
                part, inside = inside[near], inside[~near]
                if len(part) > 1:
                    stack.append((part, centre, me))
                else:
                    alone.append(centre)
                if len(inside):
                    centre = int(inside[0])
                    far = np.sqrt(((self.points[inside] - self.points[centre]) ** 2).sum(1))
            # points with no other in reach share leaves
            stack += [(np.array(alone[i : i + _LEAF]), alone[i], me) for i in range(0, len(alone), _LEAF)]
        self.children = [np.array(x, int) for x in links]

    def is_leaf(self, node: int) -> bool:
        return not len(self.children[node])


def _bounds(q: CoverTree, node: int, r: CoverTree, others: np.ndarray) -> np.ndarray:
    dots = r.centre_points[others] @ q.centre_points[node]
    return dots + q.radii[node] * r.norms[others] + r.radii[others] * (q.norms[node] + q.radii[node])


def _as_whole(x: np.ndarray, kind: type) -> np.ndarray:
    return x.astype(np.int64) if kind is np.int64 else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def top_products(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floors: np.ndarray | None = None, seen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, data id, score) of each query's k best of ``data``; whole-number coordinates, own ids left out.

    ``floors``: for each query a score that its k-th best has at least (NaN: none known), so lower ones need not be
    found. ``seen`` is told the number of pairs that were multiplied.
    """
    largest = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * queries.shape[1]
    kind = np.float64 if largest < 2**52 else np.int64 if largest < 2**62 else object
    fq, fd = (queries, data) if kind is np.float64 else (_as_whole(queries, kind), _as_whole(data, kind))
    q, r = CoverTree(queries), CoverTree(data)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, kind), np.zeros(0, np.int64))] * len(queries)
    worst = np.full(len(queries), -np.inf)
    if floors is not None:
        worst = np.where(np.isnan(floors), -np.inf, floors)
    worst -= np.abs(np.where(np.isfinite(worst), worst, 0)) * 2.0**-50  # a float may lie above the whole number
    slip = 1e-9 * (1 + q.norms.max() + q.radii.max()) * (1 + r.norms.max() + r.radii.max())  # rounding of the bounds

    def first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        if kind is object:
            return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
        return np.lexsort((ids, -scores))[:k]

    def base(asked: np.ndarray, points: np.ndarray) -> None:
        scores = fq[asked] @ fd[points].T
        if seen is not None:
            seen.append(scores.size)
        hits = (scores.astype(np.float64) >= worst[asked][:, None]) & (data_ids[points][None, :] != query_ids[asked][:, None])
        for i in np.flatnonzero(hits.any(1)):
            row, new = asked[i], np.flatnonzero(hits[i])
            s, ids = np.append(best[row][0], scores[i][new]), np.append(best[row][1], data_ids[points[new]])
            order = first(s, ids)
            best[row] = s[order], ids[order]
            if len(order) == k:
                low = float(s[order[-1]])
                worst[row] = max(worst[row], low - (abs(low) * 2.0**-50 if kind is not np.float64 else 0))

    todo: list[tuple[int, np.ndarray]] = [(0, np.array([0]))]
    while todo:
        node, others = todo.pop()
        asked = q.members[node]
        bound = _bounds(q, node, r, others) + slip
        keep = bound >= worst[asked].min()
        others = others[keep]
        if q.is_leaf(node):
            _visit(q, r, asked, others, worst, base, slip)
        else:
            deep = np.array([x for o in others.tolist() for x in (r.children[o].tolist() or [o])], int)
            todo += [(int(c), deep) for c in q.children[node]]
    n = [len(b[0]) for b in best]
    scores = [s for b in best for s in b[0].tolist()]
    if kind is object and any(not -(2**63) <= s < 2**63 for s in scores):
        raise OverflowError("a score does not fit into 64 bits")
    return np.repeat(query_ids, n), np.concatenate([b[1] for b in best]), np.array([int(s) for s in scores], np.int64)


def _visit(q: CoverTree, r: CoverTree, asked: np.ndarray, others: np.ndarray, worst: np.ndarray, base, slip: float) -> None:
    """Descend the data side for the queries of one leaf, best bounds first; here each query has a bound of its own."""
    points = q.points[asked]
    norms = np.linalg.norm(points, axis=1)
    while len(others):
        bound = points @ r.centre_points[others].T + norms[:, None] * r.radii[others] + slip
        order = np.argsort(-bound.max(0))
        batch, size, need, later = [], 0, np.zeros(len(asked), bool), []
        for j in order.tolist():
            open_to = bound[:, j] >= worst[asked]
            if not open_to.any():
                continue
            o = int(others[j])
            if r.is_leaf(o):
                batch.append(r.members[o])
                size += len(batch[-1])
                need |= open_to
            else:
                later += r.children[o].tolist()
            if size >= 128:
                base(asked[need], np.concatenate(batch))
                batch, size, need = [], 0, np.zeros(len(asked), bool)
        if batch:
            base(asked[need], np.concatenate(batch))
        others = np.array(later, int)


def _cell(k: int):
    def run(queries: pa.Table, data: pa.Table) -> tuple:
        take = lambda t: (matrix(t.column("vector").combine_chunks()), t.column("id").to_numpy())
        floors = queries.column("floor").to_numpy().astype(float) if "floor" in queries.column_names else None
        return top_products(*take(queries), *take(data), k, floors)

    return run


def exact_top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, block: int = 2048, group: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of floor(scale * x) with rows of other ids.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids.
    """

    def floor(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`")
        ok = df.where(usable(v) & F.col(f"`{id_col}`").isNotNull())
        return ok.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, floor).alias("vector"))

    work, order = Workspace(vectors.sparkSession, "topk"), [F.desc("score"), F.asc("vec_id")]
    columns = "query_id long, vec_id long, score long"
    asked, rows = whole(queries), whole(vectors)
    blocks = -(-rows.count() // block)
    if blocks > 2:  # k-th scores in one block of candidates, for all cells to prune by
        seeds = rows.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)) == 0)
        found = search(asked, seeds, _cell(k), columns, order, k, block, group, work)
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
        asked = work.table(asked.join(floors.groupBy("id").agg(F.max("floor").alias("floor")), "id", "left").select("id", "vector", "floor"), "floors")
        rows = rows.withColumn("floor", F.lit(None).cast("double"))
    return search(asked, rows, _cell(k), columns, order, k, block, group, work)
