"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Order MinHash (OMH) labels each k-mer (here: run of ``k`` words) with its occurrence number, so repeats count, takes
the ``ell`` smallest labelled k-mers under each of ``sketches`` hash functions and keeps them *in text order*. Two
texts that agree on such a tuple share rare content in the same order, which follows edit similarity where plain
MinHash only follows the set of k-mers.

Texts with the same words are one to begin with, so exact copies cost one row each. Texts of one bucket are then
aligned: longest common subsequence of words inside the diagonal band that the threshold leaves open, bit-parallel,
divided by the longer text's words. Pairs that are connected already are not aligned again, so a bucket of n copies
takes n-1 alignments. Classes are the connected components of the verified links.

Buckets of more than ``bucket`` texts are dealt out as several blocks that share two pivots, which makes one class of
most copies. Where such a bucket still holds several classes, a second pass compares every pair of its texts that is
in different classes: the bucket is cut into tiles of bounded size by length, and each two tiles whose lengths and
classes leave something to find meet in a group of their own. Two bounds, which no similar pair fails, come before the
alignment: common words, and common pairs of neighbouring words. So the size of a bucket decides the order of work only.

Rows with null ids take no part and get a null class. Null and empty texts and texts without a word are their own class;
rows with equal ids are taken as one document. Other columns are not looked at, whatever their names. An empty table
gives no row. Very long texts are compared word by word inside the band: time grows with words times the band's width.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nestwright.llm.components import connected_components
from nestwright.llm.text import U64, mix, shingles, slices, span_hashes, word_hashes
from nestwright.llm.work import Workspace, fresh, lean, shuffle_width

_BLOCK = 1 << 20
_TILE = 1 << 21  # words of a tile; a text counts for _HEAD more
_HEAD = 192
_BINS = 256, 512  # of words, of pairs of neighbouring words


def order_min_hash(words: np.ndarray, offs: np.ndarray, k: int, sketches: int, ell: int) -> np.ndarray:
    """Sketch keys, one row per text (zeros for texts without words)."""
    grams, at = shingles(words, offs, k)
    out = np.zeros((len(offs) - 1, sketches), U64)
    sizes = np.diff(at)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((grams, doc))  # stable: equal k-mers of a text stay in text order
    new = np.append(True, (grams[order][1:] != grams[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
    first = np.flatnonzero(new)
    place = np.arange(len(grams)) - np.repeat(first, np.diff(np.append(first, len(grams))))
    label = np.empty(len(grams), np.int64)
    label[order] = place
    labelled = mix(grams + label.astype(U64) * U64(0x9E3779B97F4A7C15))
    spot = (np.arange(len(grams)) - np.repeat(at[:-1], sizes)).astype(U64)
    starts = at[:-1][some]
    low = U64((1 << 24) - 1)
    for j in range(sketches):
        h = (mix(labelled ^ U64(0xA24BAED4963EE407 * (j + 1) % (1 << 64))) & ~low) | np.minimum(spot, low)
        picks = []
        for _ in range(ell):
            least = np.minimum.reduceat(h, starts)
            picks.append(least & low)
            h = np.where(h == np.repeat(least, sizes[some]), ~U64(0), h)
        picked = np.sort(np.stack(picks, 1), 1)  # text order
        picked = np.minimum(picked, (sizes[some, None] - 1).astype(U64))
        key = np.full(len(some), j + 1, U64)
        for i in range(ell):
            key = mix(key * U64(0x100000001B3) + grams[starts + picked[:, i].astype(np.int64)])
        out[some, j] = key
    return out


def _sketch(k: int, sketches: int, ell: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1), _BLOCK):
                words, offs = word_hashes(batch.column(1).slice(lo, hi - lo))
                fp1 = span_hashes(words, offs[:-1], offs[1:])
                fp2 = span_hashes(mix(words ^ U64(0x5851F42D4C957F2D)), offs[:-1], offs[1:])
                keys = order_min_hash(words, offs, k, sketches, ell)
                n = np.diff(offs)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * sketches, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                codes = (words >> U64(32)).astype("<u4").tobytes()
                codes = pa.array([codes[4 * a : 4 * b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), pa.array(n, pa.int64()), keys, codes], ["doc", "fp1", "fp2", "n_words", "keys", "words"])

    return lean(run)


def banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence whose matches lie within ``band`` of the diagonal.

    Bit-parallel: bit i of the state belongs to word i of ``a``; each word of ``b`` adds its matches, masked to the band.
    """
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state, window = full, (1 << (2 * band + 1)) - 1
    for j, x in enumerate(b):
        found = places.get(x)
        if found:
            found &= window << (j - band) if j >= band else window >> (band - j)
            u = state & found
            if u:
                state = ((state + u) | (state - u)) & full
    return len(a) - state.bit_count()


def similar(a: np.ndarray, b: np.ndarray, counts_a, counts_b, threshold: float) -> bool:
    """Whether common subsequence / longer text reaches the threshold; cheap bounds first, exact inside the band."""
    if len(a) > len(b):
        a, b, counts_a, counts_b = b, a, counts_b, counts_a
    need = threshold * len(b) - 1e-9
    if len(a) < need:
        return False
    _, ia, ib = np.intersect1d(counts_a[0], counts_b[0], assume_unique=True, return_indices=True)
    if np.minimum(counts_a[1][ia], counts_b[1][ib]).sum() < need:
        return False
    other = np.flatnonzero(a != b[: len(a)])
    head = int(other[0]) if len(other) else len(a)
    if head == len(a):
        return True
    other = np.flatnonzero(a[::-1] != b[len(b) - len(a) :][::-1])
    tail = min(int(other[0]) if len(other) else len(a), len(a) - head)
    band = len(b) - int(np.ceil(need)) + 1
    return head + tail + banded_lcs(a[head : len(a) - tail].tolist(), b[head : len(b) - tail].tolist(), band) >= need


def _verify(threshold: float):
    def links(rows: list[tuple[int, bytes]]):
        rows = sorted({r[0]: r for r in rows}.values())
        texts = [np.frombuffer(r[1], "<u4") for r in rows]
        counts = [np.unique(t, return_counts=True) for t in texts]
        root = list(range(len(rows)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i in range(1, len(rows)):
            for j in range(i):
                if (x := find(i)) != (y := find(j)) and similar(texts[i], texts[j], counts[i], counts[j], threshold):
                    root[max(x, y)] = min(x, y)
                    yield rows[j][0], rows[i][0]

    def stream(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, group in groupby(stream(batches), key=lambda r: r[:2]):
            out += links([r[2:] for r in group])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return lean(run)


def _binned(texts: list[np.ndarray], bins: int) -> np.ndarray:
    """Counts of the texts' items by bin."""
    kind = np.min_scalar_type(max((len(t) for t in texts), default=0))
    out = np.zeros((len(texts), bins), kind)
    for row, t in zip(out, texts, strict=True):
        row[:] = np.bincount(t % bins, minlength=bins)
    return out


def _pairs_of_words(t: np.ndarray) -> np.ndarray:
    return ((mix(t[:-1].astype(U64)) + t[1:]) * U64(0x9E3779B97F4A7C15)) >> U64(40)


def _common(bins: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """At least the number of items that text i has in common with each of the others."""
    out = [np.minimum(bins[others[k : k + 2048]], bins[i]).sum(1, dtype=np.int64) for k in range(0, len(others), 2048)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def links_between(rows: list[tuple[int, int, int, bytes]], threshold: float) -> Iterator[tuple[int, int]]:
    """Links that join the classes of two tiles, or of one: rows of (side, text, class, words).

    Every pair of different classes, from different sides if there are two, is aligned unless a bound rules it out. A
    common subsequence of c words leaves at least 3c - 1 - both lengths pairs of neighbouring words in common.
    """
    rows = sorted(rows, key=lambda r: (len(r[3]), r[1]))
    texts = [np.frombuffer(r[3], "<u4") for r in rows]
    sizes = np.array([len(t) for t in texts])
    side, root = np.array([r[0] for r in rows]), np.unique([r[2] for r in rows], return_inverse=True)[1]
    both = side.min() != side.max()
    words, pairs = _binned(texts, _BINS[0]), _binned([_pairs_of_words(t).astype(np.uint32) for t in texts], _BINS[1])
    for i in range(1, len(rows)):
        need = int(np.ceil(threshold * sizes[i] - 1e-9))
        other = np.arange(np.searchsorted(sizes[:i], need), i)
        other = other[root[other] != root[i]]
        if both:
            other = other[side[other] != side[i]]
        other = other[_common(words, i, other) >= need]
        other = other[_common(pairs, i, other) >= 3 * need - 1 - sizes[i] - sizes[other]]
        for j in other.tolist():
            if root[i] != root[j]:
                counts = [np.unique(texts[x], return_counts=True) for x in (i, j)]
                if similar(texts[i], texts[j], *counts, threshold):
                    root[root == root[i]] = root[j]
                    yield rows[j][1], rows[i][1]


def _meet(threshold: float):
    def stream(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(stream(batches), key=lambda r: r[0]):
            if out := list(links_between(list({r[2]: r[1:] for r in group}.values()), threshold)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return lean(run)


def tiles_that_meet(placed: DataFrame, work: Workspace, threshold: float, bucket: int, tile: int) -> DataFrame:
    """(pair, side, rep, class) from the (key, rep, class, n_words) of buckets: tiles of a bucket, two and two.

    Classes of more than ``bucket`` texts in a bucket have tiles of their own, which do not meet each other.
    """
    own = F.when(F.count(F.lit(1)).over(Window.partitionBy("key", "class")) > bucket, F.col("class").cast("string"))
    placed = placed.withColumn("own", F.coalesce(own, F.lit("-")))
    weight = F.col("n_words") + _HEAD
    before = F.sum(weight).over(Window.partitionBy("key", "own").orderBy("n_words", "rep")) - weight
    placed = work.table(placed.withColumn("number", F.floor(before / tile)), "tiled")
    tiles = placed.groupBy("key", "own", "number").agg(F.min("n_words").alias("shortest"), F.max("n_words").alias("longest"), F.min("class").alias("lo"), F.max("class").alias("hi"))
    tiles = work.table(tiles.withColumn("tile", F.monotonically_increasing_id()), "tiles")
    a, b = tiles.alias("a"), tiles.alias("b")
    once = F.struct("a.shortest", "a.tile") <= F.struct("b.shortest", "b.tile")
    near = F.col("a.longest") >= F.col("b.shortest") * threshold - 1e-9
    differ = F.least("a.lo", "b.lo") < F.greatest("a.hi", "b.hi")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & once & near & differ).select(F.col("a.tile").alias("t0"), F.col("b.tile").alias("t1"))
    pairs = work.table(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
    sides = pairs.select("pair", F.explode(F.array_distinct(F.array("t0", "t1"))).alias("tile"), "t1").select("pair", "tile", (F.col("tile") == F.col("t1")).cast("int").alias("side"))
    numbered = placed.join(tiles.select("key", "own", "number", "tile"), ["key", "own", "number"])
    return numbered.join(sides, "tile").select("pair", "side", "rep", "class")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, sketches: int = 20, ell: int = 2, bucket: int = 96, tile: int = _TILE) -> DataFrame:
    """One row per input row: the id, ``class_id`` (smallest id of its class) and ``copy_of`` (smallest id with the same words)."""
    spark = docs.sparkSession
    work = Workspace(spark, "omh")
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = work.table(source.mapInArrow(_sketch(k, sketches, ell), "doc long, fp1 long, fp2 long, n_words long, keys array<long>, words binary"), "sketches")
    taking_part = rows.where("n_words > 0 and doc is not null")
    reps = work.table(taking_part.groupBy("fp1", "fp2").agg(F.min_by("keys", "doc").alias("keys"), F.min("n_words").alias("n_words"), F.min("doc").alias("rep")), "representatives")

    entries = reps.select("rep", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot"), F.max("rep").alias("pivot2"), F.bit_xor(F.xxhash64("rep")).alias("members")).where("n > 1")
    # buckets with the same members, found by several sketches, are looked at once
    small = buckets.where(F.col("n") <= bucket).groupBy("members", "n").agg(F.min("key").alias("key"), F.min("pivot").alias("pivot"), F.min("pivot2").alias("pivot2"))
    columns = ["key", "n", "pivot", "pivot2", "members"]
    buckets = work.table(small.select(*columns).unionByName(buckets.where(F.col("n") > bucket).select(*columns)), "buckets")
    blocks = F.ceil(F.col("n") / bucket).cast("long")
    members = entries.join(buckets.drop("members"), "key").select("key", F.pmod(F.xxhash64("rep", "key"), blocks).alias("block"), "rep")
    pivots = buckets.where(F.col("n") > bucket).select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.explode(F.array("pivot", "pivot2")).alias("rep"))
    members = work.table(members.unionByName(pivots), "members")

    # the words of texts that share a bucket are all that the two passes read; members grow with the corpus, so no broadcast
    codes = work.table(rows.select(F.col("doc").alias("rep"), "words").join(members.select("rep").distinct().hint("merge"), "rep", "left_semi"), "codes")
    prints = work.table(rows.select("doc", "fp1", "fp2", "n_words"), "prints")
    work.drop("sketches")
    work.release()

    dealt = members.join(codes, "rep").select("key", "block", "rep", "words")
    links = dealt.repartition(shuffle_width(spark), "key", "block").sortWithinPartitions("key", "block").mapInArrow(_verify(threshold), "a long, b long")
    labels = connected_components(links, work)
    work.release()

    # classes that meet in a bucket which was dealt out; of buckets with the same members one is looked at
    large = buckets.where(F.col("n") > bucket).groupBy("members", "n").agg(F.min("key").alias("key"))
    placed = members.join(large.select("key"), "key").select("key", "rep").distinct().join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("label", "rep").alias("class"))
    placed = work.table(placed, "placed")
    several = placed.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    placed = placed.join(several, "key").join(reps.select("rep", "n_words"), "rep")
    meets = tiles_that_meet(placed, work, threshold, bucket, tile).join(codes, "rep").select("pair", "side", "rep", "class", "words")
    late = work.table(meets.repartition(shuffle_width(spark), "pair").sortWithinPartitions("pair").mapInArrow(_meet(threshold), "a long, b long"), "late-links")
    if late.limit(1).count():
        labels = connected_components(late.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))), work, "late")

    work.drop("codes", "members", "buckets", "placed", "tiled", "tiles", "pairs")
    classes = work.table(reps.join(labels, reps.rep == labels.node, "left").select("fp1", "fp2", "rep", F.coalesce("label", "rep").alias("class")), "classes")
    joined = prints.alias("r").join(classes.alias("c"), (F.col("r.fp1") == F.col("c.fp1")) & (F.col("r.fp2") == F.col("c.fp2")), "left")
    alone = (F.col("r.n_words") == 0) | F.col("c.rep").isNull()
    return joined.select(F.col("r.doc").alias(id_col), F.when(F.col("r.doc").isNotNull(), F.when(alone, F.col("r.doc")).otherwise(F.col("c.class"))).alias("class_id"), F.when(F.col("r.doc").isNotNull(), F.when(alone, F.col("r.doc")).otherwise(F.col("c.rep"))).alias("copy_of"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without the documents that a smaller id of their class stands for; null ids stay."""
    name = fresh(docs.columns, "gone")
    gone = near_duplicate_classes(docs, id_col, text_col, **parameters).where(f"`{id_col}` <> class_id").select(F.col(f"`{id_col}`").alias(name)).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone[name], "left_anti")
