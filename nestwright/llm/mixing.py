"""Interleaving sources at target weights by Pfair scheduling.

Documents of a source are dealt in a seeded random order into blocks of ``block`` documents. Block k (from 0) of a
source with weight w may be released at slot floor(k / w) and must run before slot ceil((k + 1) / w). Each slot runs
the released block of earliest deadline. On one processor that schedule always exists and keeps every source less than
one block from weight * slots at every moment, in both directions.

Weights are exact fractions, never rounded to a period, so the bound holds at any number of slots. One task works the
schedule out slot by slot and streams it to a table of (source, block, slot), one row for every ``block`` documents;
its memory grows with the number of sources alone. When a source runs out, a new phase begins with the rest at their
relative weights: every document is placed, none is repeated, and no slot stays empty.

A document's number in its source comes from counts by (source, bucket of its random key) and a rank inside the
bucket. A source has up to 32,768 buckets, so a bucket holds about ``bucket_rows`` rows, or a 32,768th of its source where
that is more. Null sources count as one source (written null); null and empty texts are rows like others. Rows with
equal ids are placed one by one, ties of their keys in any order. Columns of any name may be there. An empty table stays
empty.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestwright.llm.work import Workspace, shuffle_width


def whole_weights(weights: dict, period: int) -> dict:
    """Positive whole weights that sum to ``period``, by largest remainders; each source gets at least 1."""
    total = math.fsum(weights.values())
    if not weights or total <= 0 or any(w <= 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights are positive finite numbers")
    free = period - len(weights)
    if free < 0:
        raise ValueError("the period is shorter than the number of sources")
    exact = {s: free * w / total for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    short = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], str(s)))[:short]:
        out[s] += 1
    return out


def exact_weights(weights: dict) -> dict:
    """Whole weights in exactly the proportions of ``weights``."""
    if not weights or any(not math.isfinite(w) or w <= 0 for w in weights.values()):
        raise ValueError("weights are positive finite numbers")
    parts = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in parts.values()))
    return {s: int(w * scale) for s, w in parts.items()}


def pfair(whole: dict) -> Iterator:
    """Source of each slot, without end: among released blocks, the earliest deadline runs; ties by name."""
    period = sum(whole.values())
    names = sorted(whole, key=str)
    ready = [(-(-period // whole[s]), i, 0) for i, s in enumerate(names)]
    heapq.heapify(ready)
    later: list[tuple[int, int, int, int]] = []
    now = 0
    while True:
        while later and later[0][0] <= now:
            heapq.heappush(ready, heapq.heappop(later)[1:])
        deadline, i, k = heapq.heappop(ready)
        if deadline <= now:
            raise AssertionError("a deadline was missed")
        yield names[i]
        a = whole[names[i]]
        heapq.heappush(later, ((k + 1) * period // a, -(-(k + 2) * period // a), i, k + 1))
        now += 1


def pfair_period(whole: dict) -> list:
    """Source of each slot of one period."""
    return list(islice(pfair(whole), sum(whole.values())))


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block, slot) of all blocks; a phase ends where a source runs out."""
    done, slot = dict.fromkeys(blocks, 0), 0
    while active := {s: weights[s] for s in blocks if done[s] < blocks[s]}:
        for s in pfair(exact_weights(active)):
            yield s, done[s], slot
            done[s] += 1
            slot += 1
            if done[s] == blocks[s]:
                break


def mix(docs: DataFrame, source_col: str = "source", key_cols: tuple[str, ...] = ("doc_id",), weights: dict | None = None, exponent: float = 0.5, block: int = 16, period: int = 1024, seed: int = 7, bucket_rows: int = 256, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (or the columns ``keep``) with ``mix_block``, ``mix_slot`` and ``mix_position``.

    ``weights``: target weight by source, null's under None; without it a source's weight is its number of documents to
    the power ``exponent``, from counts over all rows. ``mix_slot`` orders the blocks and ``mix_position`` is
    slot * block + place in the block. ``period`` is the number of slots written at once; results do not depend on it.
    The driver holds one number a source, whatever the number of rows. Columns called like the new ones are left out.
    """
    columns = [c for c in keep or docs.columns if c.lower() not in _NEW]
    placed = _placed(docs, source_col, key_cols, weights, exponent, block, period, seed, bucket_rows, columns)
    return placed.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)), *_NEW)


def mixed_order(docs: DataFrame, source_col: str = "source", key_cols: tuple[str, ...] = ("doc_id",), weights: dict | None = None, exponent: float = 0.5, block: int = 16, period: int = 1024, seed: int = 7, bucket_rows: int = 256) -> DataFrame:
    """``docs`` in mixed order: its files and the rows in them follow ``mix_position``."""
    placed = _placed(docs, source_col, key_cols, weights, exponent, block, period, seed, bucket_rows, docs.columns)
    ordered = placed.repartitionByRange(shuffle_width(docs.sparkSession), "mix_position").sortWithinPartitions("mix_position")
    return ordered.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


_NEW = ("mix_block", "mix_slot", "mix_position")


def _placed(docs: DataFrame, source_col: str, key_cols: tuple[str, ...], weights: dict | None, exponent: float, block: int, period: int, seed: int, bucket_rows: int, columns: list[str]) -> DataFrame:
    """``row``, a struct of ``columns`` as c0, c1, ..., with the three new columns."""
    spark = docs.sparkSession
    key = F.xxhash64(*(F.col(f"`{c}`") for c in key_cols), F.lit(seed))
    source = F.col(f"`{source_col}`")
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).alias("row")
    totals = {r[0]: r[1] for r in docs.groupBy(source.alias("s")).agg(F.count(F.lit(1))).collect()}
    if not totals:
        return docs.select(row, *(F.lit(0).cast("long").alias(c) for c in _NEW))
    target = {s: n**exponent for s, n in totals.items()} if weights is None else weights
    if missing := [s for s in totals if s not in target]:
        raise ValueError(f"no weight for sources {missing[:5]}")
    buckets = max(1, min(1 << 15, -(-max(totals.values()) // bucket_rows)))
    called = {s: "-" if s is None else f"+{s}" for s in totals}
    blocks = {called[s]: -(-n // block) for s, n in totals.items()}
    weight = {called[s]: target[s] for s in totals}
    exact_weights(weight)  # bad weights are told here

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                rows = schedule(blocks, weight)
                while part := list(islice(rows, max(1, period))):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*part, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["s", "k", "slot"])

    table = Workspace(spark, "mix").table(spark.range(0, 1, 1, 1).mapInArrow(slots, "s string, k long, slot long"), "slots")

    name = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))
    bucket = F.floor(F.shiftrightunsigned(key, 32) * buckets / F.lit(1 << 32)).cast("long")
    rows = docs.select(row, name.alias("s"), key.alias("key"), bucket.alias("b"))
    counts = docs.select(name.alias("s"), bucket.alias("b")).groupBy("s", "b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("s", "b", "n", (F.sum("n").over(Window.partitionBy("s").orderBy("b")) - F.col("n")).alias("before"))
    # the blocks that a bucket's rows are in, with their slots
    first = F.floor(F.col("before") / block)
    spread = before.select("s", "b", "before", F.explode(F.sequence(first, F.floor((F.col("before") + F.col("n") - 1) / block))).alias("k"))
    before = spread.join(table, ["s", "k"]).groupBy("s", "b").agg(F.first("before").alias("before"), F.sort_array(F.collect_list(F.struct("k", "slot"))).alias("slots"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("s", "b").orderBy("key")) - 1)
    placed = ranked.join(before, ["s", "b"])
    number = F.col("before") + F.col("rank")
    placed = placed.withColumn("mix_block", F.floor(number / block).cast("long")).withColumn("place", F.pmod(number, F.lit(block)))
    inside = (F.col("mix_block") - F.get("slots", F.lit(0))["k"]).cast("int")
    placed = placed.withColumn("mix_slot", F.get("slots", inside)["slot"])
    return placed.select("row", "mix_block", "mix_slot", (F.col("mix_slot") * block + F.col("place")).cast("long").alias("mix_position"))
