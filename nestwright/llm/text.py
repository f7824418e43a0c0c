"""Vectorised tokenising and hashing of Arrow string batches.

A word is a maximal run of ASCII letters, digits, ``_`` or non-ASCII characters of the lower-cased text. All hashes
are 64-bit and depend on content alone, so they agree between executors and runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; grown on demand and kept."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, U64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each span [start, end) of ``values`` (uint64)."""
    n = len(values)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * powers(_BASE, n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(U64))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of each text in them (nulls count as empty)."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()), b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(texts: pa.Array, limit: int):
    """(from, to) row ranges of at most ``limit`` bytes, a longer single text alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at, n = np.cumsum(sizes), 0, len(sizes)
    while at < n:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        to = max(to, at + 1)
        yield at, to
        at = to


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and offsets of each text's words in them."""
    raw, offs = buffers(pc.utf8_lower(texts))
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offs), np.int64)
    word = _WORD[raw]
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return span_hashes(_TABLE[raw], starts, ends), np.searchsorted(starts, offs)


def shingles(words: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of k words; a text of 1 to k-1 words has one run, an empty one none."""
    n = np.diff(offs)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    starts = np.arange(out[-1]) + np.repeat(offs[:-1] - out[:-1], count)
    ends = starts + np.repeat(np.minimum(n, k), count)
    return span_hashes(words, starts, ends), out
