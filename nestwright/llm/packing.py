"""Packing of tokenised documents into sequences of fixed capacity by harmonic classes.

A length in (C / (k + 1), C / k] belongs to class k, and a bin of class k takes k pieces: no search, no shuffle, and
each worker fills its own bins. Plain harmonic packing pads up to half a bin, so long documents give whole sequences
first, and a piece that would leave more than ``slack`` of its place empty is cut to the next class's full place, its
rest going on to a class of its own. Bins still open when a worker ends are joined: their pieces are cut once more to
fill whole sequences, and what remains is cut into sequences at powers of two, which need no padding.

Null texts count as empty; every document ends with ``end_id``, so an empty one has one token. The pieces of a
document keep its ids in order and hold each id once. A task holds one block's ids (a longer single text's, where there is
one) and at most k - 1 pieces of each class. Other columns are not looked at, whatever their names; an empty table gives
no row, and documents of equal length or content are packed one by one.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwright.llm.text import slices
from nestwright.llm.work import holds, lean

_BLOCK = 1 << 20
_kept: dict[str, _Ids] = {}
_MARK = re.compile(r"(?<=[a-zà-öø-ÿ])([.,;:!?])(?=[ \n])")


class _Ids:
    """Token ids of white-space-free chunks, as little-endian bytes.

    A tokenizer with word ends drops white space and never joins across it, so a text's ids are its chunks' ids. It
    lower-cases, and letters never join with other characters, so a word with marks behind it is its letters (lower case,
    if ASCII) and then the marks. Texts without ``<`` are put that way first, so fewer chunks differ. New words are
    encoded many at a time and told apart by their word ends, plain ones by the model itself. A chunk with ``<`` may
    hold a special token and goes to the tokenizer as it is, as do whole texts for tokenizers of other kinds.

    Two generations bound what is kept: past ``LIMIT`` bytes the present one becomes the old one, whose words come back
    as they are met again, and the one before is dropped. At most two limits and one block's new words are held.
    """

    LIMIT, ENTRY, MARKS = 112 << 20, 230, ".,;:!?#$%&*|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}  # a plain one: a set tells its difference from it without going over all of it
        self.old: dict[str, bytes] = {}
        self.held = 0
        # a lower-case ASCII word needs no normalising, so the model itself can take it; a few words tell whether that holds
        self.split = self.tokenizer.model.tokenize
        self.direct = array("I").itemsize == 4 and sys.byteorder == "little" and all(self.word(w) == self.encode(w) for w in ("a", "the", "tokenizer", "qzxjv", "internationalisation"))

    def word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.split(word)]).tobytes()

    def keep(self, chunk: str, ids: bytes) -> None:
        self.known[chunk] = ids
        self.held += self.ENTRY + len(chunk) + len(ids)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: set[str]) -> None:
        """Ids of chunks that are not kept yet; words that differ only in case or marks are encoded once."""
        if not new:
            return
        known = self.known
        if self.old:
            back = {c: ids for c in new if (ids := self.old.get(c)) is not None}
            known.update(back)
            self.held += self.ENTRY * len(back)
            new = new.difference(back)
        chunks = pa.array(new, pa.large_string())
        cores = pc.utf8_rtrim(chunks, self.MARKS)
        plain = pc.utf8_is_alpha(cores)
        for chunk in chunks.filter(pc.invert(plain)).to_pylist():
            self.keep(chunk, self.encode(chunk))
        chunks, cores = chunks.filter(plain), cores.filter(plain)
        low = pc.if_else(pc.string_is_ascii(cores), pc.ascii_lower(cores), cores)
        words = low.to_pylist()
        other = pc.not_equal(low, chunks)
        marked = list(zip(chunks.filter(other).to_pylist(), low.filter(other).to_pylist(), pc.utf8_length(cores.filter(other)).to_pylist(), strict=True))
        words = set(words).difference(known)
        if self.direct:
            plain = {w for w in words if w.isascii()}
            known.update({w: self.word(w) for w in plain})
            self.held += (self.ENTRY + 24) * len(plain)
            words -= plain
        words = list(words)
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            ids = self.encode(" ".join(part))
            stops = (4 * (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1)).tolist()
            if len(stops) == len(part):
                known.update(zip(part, map(ids.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
                self.held += (self.ENTRY + 8) * len(part) + len(ids)
            else:
                for word in part:
                    self.keep(word, self.encode(word))
        tails = {"": b""}
        for chunk, word, size in marked:
            marks = chunk[size:]
            if marks not in tails:
                tails[marks] = self.encode(marks)
            known[chunk] = known[word] + tails[marks]
        self.held += (self.ENTRY + 20) * len(marked)

    @staticmethod
    def plainer(text: str) -> str:
        """The text with ASCII letters in lower case and marks behind words apart, for which a tokenizer has the same ids."""
        return text if "<" in text else _MARK.sub(r" \1", text.encode().lower().decode())

    def texts(self, texts: list[str]) -> list[bytes]:
        if not self.ends.any():
            return [self.encode(t) for t in texts]
        parts = [chunks(self.plainer(t)) for t in texts]
        if self.held > self.LIMIT:
            self.old, self.known, self.held = self.known, {}, 0
        self.learn(set().union(*parts).difference(self.known))
        return [b"".join(map(self.known.__getitem__, p)) for p in parts]


def _lookup(path: str) -> _Ids:
    if path not in _kept:
        _kept.clear()
        _kept[path] = _Ids(path)
    holds("packing", _kept.clear)
    return _kept[path]


def chunks(text: str) -> list[str]:
    """The text at spaces, tabs and line ends; other white space stays inside a chunk for the tokenizer to drop."""
    return [c for c in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if c]


class _Bins:
    """Open bins of one worker."""

    def __init__(self, capacity: int, slack: float, first: int):
        self.capacity, self.slack, self.next = capacity, slack, first
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, at))
            at += n
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        c, n = self.capacity, len(ids) // 4
        while n:
            k = max(1, c // n)
            size = n
            if n > c:
                k, size = 1, c
            elif c - k * n > self.slack * c:  # too short for its place: cut it to the next class's
                k += 1
                size = c // k
            piece = (doc, start, ids[: 4 * size], total)
            ids, start, n = ids[4 * size :], start + size, n - size
            if k == 1:
                self.emit([piece])
                continue
            held = self.open.setdefault(k, [])
            held.append(piece)
            if len(held) == k:
                self.emit(held)
                del self.open[k]

    def close(self) -> None:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        room = sum(len(p[2]) // 4 for p in left)
        self.open = {}
        target, held, have = 0, [], 0
        for doc, start, ids, total in left:
            while ids:
                if not have:
                    target = self.capacity if room >= self.capacity else 1 << (room.bit_length() - 1)
                take = min(len(ids) // 4, target - have)
                held.append((doc, start, ids[: 4 * take], total))
                ids, start, have, room = ids[4 * take :], start + take, have + take, room - take
                if have == target:
                    self.emit(held)
                    held, have = [], 0


def _pack(path: str, capacity: int, slack: float, end_id: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end = _lookup(path), struct.pack("<I", end_id)
        bins = _Bins(capacity, slack, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for lo, hi in slices(batch.column(1), _BLOCK):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                for doc, ids in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), ids_of.texts(texts), strict=True):
                    bins.add(doc, 0, ids + end, len(ids) // 4 + 1)
                if len(bins.rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*bins.rows, strict=True)], names)
                    bins.rows = []
        bins.close()
        if bins.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*bins.rows, strict=True)], names)

    return lean(run, "packing")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, slack: float = 0.01) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a tokenizer file that every worker can open. Sequence ids are unique, not gapless: the worker's
    partition, then its count. Rows with equal ids are packed one by one.
    """
    if not 0 <= slack < 0.5 or capacity < 2 or capacity & (capacity - 1):
        raise ValueError("capacity is a power of two, slack in [0, 0.5)")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pack(tokenizer, capacity, slack, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
