"""Vector tables for the search operators: validity, and the grid of query groups and candidate blocks.

A stated query set meets all candidates in blocks: a cell of the grid holds at most ``block`` candidates and ``group``
queries, candidates are copied once per query group and queries once per block. A cell reports its best k per query, so
what is shuffled afterwards is k rows per query and block. Rows are dealt by id and content, so repeated ids spread, too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestwright.llm.work import Workspace, shuffle_width


def usable(vector: Column, allow_zero: bool = True) -> Column:
    """Not null, not empty, and every component finite (and some not zero)."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ok = vector.isNotNull() & (F.size(vector) > 0) & finite
    return ok if allow_zero else ok & F.exists(vector, lambda x: x != 0)


def matrix(vectors: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0), kind)


def search(queries: DataFrame, candidates: DataFrame, cell: Callable[[pa.Table, pa.Table], tuple], columns: str, order: list[Column], k: int, block: int, group: int, work: Workspace) -> DataFrame:
    """Runs ``cell(queries, candidates)`` on each cell of the grid and keeps each query's first k rows in ``order``.

    Both inputs have ``id``, ``vector`` and the same further columns; vectors of different lengths never meet. ``cell``
    returns columns (query_id, vec_id, score); ``columns`` is their schema.
    """
    spark = queries.sparkSession
    n, q = candidates.count(), queries.count()
    blocks, groups = max(1, -(-n // block)), max(1, -(-q // group))
    spread = lambda m, salt: F.pmod(F.xxhash64("id", "vector", F.lit(salt)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.select(each(blocks).alias("b"), spread(groups, 1).alias("g"), F.size("vector").alias("d"), F.lit(0).alias("side"), *queries.columns)
    right = candidates.select(spread(blocks, 2).alias("b"), each(groups).alias("g"), F.size("vector").alias("d"), F.lit(1).alias("side"), *queries.columns)
    cells = left.unionByName(right).repartition(max(shuffle_width(spark), min(blocks * groups, 4 * shuffle_width(spark))), "b", "g", "d").sortWithinPartitions("b", "g", "d", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def done():
            table = pa.Table.from_batches(held)
            side = table.column("side").to_numpy()
            cut = int(np.searchsorted(side, 1))
            if 0 < cut < len(side):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cell(table.slice(0, cut), table.slice(cut))], ["query_id", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and tuple(keys[a]) != now:
                    yield from done()
                    held = []
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    found = cells.mapInArrow(run, columns)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
