"""Quality scores by hashed word n-gram logistic regression, trained with follow-the-regularised-leader (FTRL-proximal).

Words are runs of letters and digits, and runs of other characters between white space; letter case counts. Features are
the n-grams (n = 1, 2), hashed to ``2**bits`` weights; a word that repeats one of the two before it makes one and the
same bigram whatever the word, and a text's first word stands beside its beginning. A feature's value is its number in
the text over the text's words and ``SMOOTH`` more, so very short texts lean to the bias. A score is the logistic
function of the sparse dot product, a gather and a segment sum over whole texts.

The model is trained on the driver from at most ``train_rows`` labelled rows outside the held-out fold (the rows of
smallest id hash): a fixed amount of data whatever the corpus. Scoring is one scan without a shuffle.
Empty and null texts get the score of the bias alone. Rows are scored one by one, repeated or not; of several labels of
one id the largest counts. Without labelled rows every score is 0.5. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwright.llm.text import _TABLE, U64, buffers, mix, slices, span_hashes
from nestwright.llm.work import lean

BITS, TRAIN_ROWS, SMOOTH = 18, 6000, 4
_BLOCK = 1 << 20
_SPACE, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND = np.where(_SPACE, 0, np.where(_LETTER, 1, 2)).astype(np.uint8)
_REPEAT, _BEGIN = U64(0x51ED270B), U64(991)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature index, share) of all texts' n-grams in order, with repeats, and each text's offsets in them."""
    raw, offs = buffers(texts)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(len(offs), np.int64)
    kind = _KIND[raw]
    edge = np.ones(n + 1, bool)  # another kind of character, or another text, begins
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offs] = True
    starts = np.flatnonzero((kind > 0) & edge[:n])
    ends = np.flatnonzero((kind > 0) & edge[1:]) + 1
    at = np.searchsorted(starts, offs)
    words = span_hashes(_TABLE[raw], starts, ends)
    m = len(words)
    first = at[:-1][at[:-1] < at[1:]]
    place = np.arange(m) - np.repeat(at[:-1], np.diff(at))
    again = np.zeros(m, bool)
    again[1:] = (words[1:] == words[:-1]) & (place[1:] >= 1)
    again[2:] |= (words[2:] == words[:-2]) & (place[2:] >= 2)
    pair = np.empty(m, U64)
    pair[1:] = mix(words[:-1] * U64(3) + words[1:] + U64(77))
    pair[again] = _REPEAT
    pair[first] = _BEGIN
    shift = U64(64 - bits)
    index = np.stack([mix(words + U64(1)) >> shift, mix(pair) >> shift], 1).astype(np.int64).ravel()
    counts = np.diff(at)
    share = np.repeat(np.repeat(1.0 / (counts + SMOOTH), counts), 2).astype(np.float32)
    return index, share, at * 2


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = 8, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (index, value, label) examples; weights and bias."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            index, value, label = examples[k]
            index, value = np.append(index, 1 << bits), np.append(value, 1.0)
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[index] = zi + g - step * w
            n[index] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1].astype(np.float32), float(w[-1])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _examples(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                index, share, _ = features(batch.column(0).slice(i, 1), bits)
                used, where = np.unique(index, return_inverse=True)
                value = np.bincount(where, share, len(used)).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([used.astype("<i4").tobytes()]), pa.array([value.tobytes()]), batch.column(1).slice(i, 1)], ["index", "value", "label"])

    return lean(run)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows outside the held-out fold; without any, zeros."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text")).where(F.length("_text") > 0)
    rows = rows.join(F.broadcast(known), "_id").dropDuplicates(["_id"])  # at most train_rows ids are broadcast
    got = rows.select("_text", "_label").mapInArrow(_examples(bits), "index binary, value binary, label int").collect()
    examples = sorted((bytes(r["index"]), bytes(r["value"]), r["label"]) for r in got)
    return train([(np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64), y) for i, v, y in examples], bits) if examples else (np.zeros(1 << bits, np.float32), 0.0)


def _score(weights: np.ndarray, bias: float, bits: int):
    def scores(texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        for lo, hi in slices(texts, _BLOCK):
            index, share, at = features(texts.slice(lo, hi - lo), bits)
            sums = np.append(0.0, np.cumsum(weights[index].astype(np.float64) * share))
            out[lo:hi] = 1 / (1 + np.exp(-np.clip(sums[at[1:]] - sums[at[:-1]] + bias, -35, 35)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores(texts))], [*batch.schema.names[:-1], "score"])

    return lean(run)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), bits: int = BITS, name: str = "score") -> DataFrame:
    """The columns ``keep`` of each row and its score in (0, 1) as ``name``."""
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)), F.col(f"`{text_col}`").cast("string").alias("_text"))
    schema = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = rows.mapInArrow(_score(*model, bits), f"{schema}, score double")
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), F.col("score").alias(name))
