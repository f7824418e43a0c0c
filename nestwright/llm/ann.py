"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by the sum of one full-dimensional codeword from each of ``books`` codebooks. The codebooks
start as residual k-means on a bounded sample and are refined in turns: codes by beam search, codewords by least
squares for those codes. Every row is encoded (codes and the squared norm of its approximation are stored); a query
makes one table of inner products with all codewords, so a candidate's approximate distance is a sum of looked-up
numbers and its stored norm. The best of each block are ranked again by exact distances to the original vectors.

Vectors that are null, empty or zero, or hold null or non-finite components, take no part, nor do null ids; vectors of
different lengths never meet. Equal distances go to the smaller id; rows of one id are candidates one by one, and none
is a candidate of that id's query. An empty table or no query gives no row. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.vectors import matrix, search, usable
from nestwright.llm.work import Workspace


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words**2).sum(1) - 2 * (x @ words.T)).argmin(1)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (n, books) by beam search: each step keeps the ``beam`` partial sums nearest to the vector."""
    n, (m, size, _) = len(x), books.shape
    sums, codes = np.zeros((n, 1, x.shape[1])), np.zeros((n, 1, 0), np.int16)
    for step in range(m):
        words = books[step]
        rest = x[:, None] - sums
        cost = (rest**2).sum(2)[:, :, None] - 2 * (rest @ words.T) + (words**2).sum(1)
        flat = cost.reshape(n, -1)
        width = min(beam if step + 1 < m else 1, flat.shape[1])
        best = np.argpartition(flat, width - 1, 1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (n, 1))
        origin, word = best // size, (best % size).astype(np.int16)
        sums = np.take_along_axis(sums, origin[:, :, None], 1) + words[word]
        codes = np.concatenate([np.take_along_axis(codes, origin[:, :, None], 1), word[:, :, None]], 2)
    return codes[:, 0]


def train(x: np.ndarray, books: int, words: int, beam: int, turns: int = 2, seed: int = 0) -> np.ndarray:
    """Codebooks (books, words, dimensions)."""
    rng = np.random.default_rng(seed)
    words = min(words, len(x))
    rest, out = x.copy(), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=False)]
        for _ in range(6):
            near = _nearest(rest, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            size = np.bincount(near, minlength=words)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        rest = rest - centres[_nearest(rest, centres)]
        out.append(centres)
    out = np.stack(out)
    for _ in range(turns):
        codes = encode(x, out, beam) + np.arange(books) * words
        gram = np.zeros((books * words, books * words))
        right = np.zeros((books * words, x.shape[1]))
        for i in range(books):
            np.add.at(right, codes[:, i], x)
            for j in range(books):
                np.add.at(gram, (codes[:, i], codes[:, j]), 1.0)
        gram[np.diag_indices_from(gram)] += 1e-3
        held = out.reshape(-1, x.shape[1])
        out = (held + np.linalg.solve(gram, right - gram @ held + 1e-3 * held)).reshape(out.shape)
    return out


def _encode(books: np.ndarray, beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x = matrix(part.column(1))
                codes = encode(x, books, beam)
                norms = (books[np.arange(books.shape[0]), codes].sum(1) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes.astype("<u2")], pa.binary()), pa.array(norms)], ["id", "vector", "codes", "norm"])

    return run


def _cell(books: np.ndarray, k: int, rerank: float):
    m = len(books)

    def run(queries: pa.Table, data: pa.Table) -> tuple:
        x, ids = matrix(data.column("vector").combine_chunks()), data.column("id").to_numpy()
        codes = np.frombuffer(b"".join(data.column("codes").to_pylist()), "<u2").reshape(-1, m)
        norms = data.column("norm").to_numpy()
        take = min(len(ids), max(24 * k, int(rerank * len(ids))) + 1)
        out: list[tuple] = []
        for q, me in zip(matrix(queries.column("vector").combine_chunks()), queries.column("id").to_numpy(), strict=True):
            table = books @ q
            near = norms.copy()
            for i in range(m):
                near -= 2 * table[i][codes[:, i]]
            near[ids == me] = np.inf
            best = np.argpartition(near, take - 1)[:take] if take < len(ids) else np.arange(len(ids))
            best = best[ids[best] != me]
            exact = np.sqrt(((x[best] - q) ** 2).sum(1))
            best = best[order := np.lexsort((ids[best], exact))[:k]]
            out.append((np.full(len(best), me), ids[best], exact[order]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    return run


def additive_search(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, books: int = 16, words: int = 256, beam: int = 4, train_rows: int = 6144, rerank: float = 0.06, block: int = 8192, group: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance on the original vectors): k found for each query.

    The codebooks of each vector length are fitted on at most ``train_rows`` of its rows (smallest id hash); every row is
    indexed. ``rerank`` is the share of a block whose exact distance is taken, at least 24 k rows.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "ann")

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`")
        return df.where(usable(v, allow_zero=False) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("vector"))

    rows, asked = clean(vectors), clean(queries)
    # vectors of each length that occurs anywhere have an index of their own
    lengths = sorted(r.d for r in rows.select(F.size("vector").alias("d")).distinct().collect())
    found = None
    for d in lengths:
        mine = rows.where(F.size("vector") == d)
        sample = mine.orderBy(F.xxhash64("id"), "id").limit(train_rows).toArrow().column("vector").combine_chunks()
        model = train(matrix(sample), books, words, beam)
        indexed = work.table(mine.mapInArrow(_encode(model, beam), "id long, vector array<double>, codes binary, norm double"), f"index-{d}")
        part = search(asked.where(F.size("vector") == d).select("id", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm")), indexed, _cell(model, k, rerank), "query_id long, vec_id long, score double", [F.asc("score"), F.asc("vec_id")], k, block, group, work)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
