"""Removal of repeated passages by longest previous factors.

A position's longest previous factor (LPF) is the longest string from there that also starts in an earlier document.
In suffix order it is the longer of the common prefixes with the previous and with the next suffix whose document is
smaller. Here a byte goes when it lies in a ``length``-byte string with such an earlier start, so suffixes need to be
ordered by their first ``length`` bytes only.

One global suffix array would shuffle every position of the corpus. Instead the array is cut into independent parts:
each window of ``length`` bytes is filed under the smallest hash among its k-grams. Equal windows share that k-gram,
hence equal suffixes always meet in one part. Neighbouring windows that share the same k-gram occurrence travel as one
run, and only k-grams found in more than one document are followed further:

1. *find*: every run reports its k-gram, a 64-bit hash of its bytes and 24-bit hashes of what it holds left and right of
   the k-gram (packed arrays, 24 bytes a run). Of runs with equal k-gram and hash all but those of the smallest document
   are removed right away, first within a block of text, then within a part: copies of whole runs, the bulk of what
   repeats, never reach the suffix order. This one step takes hashes for bytes. Equal windows also share the half of
   their other bytes on one side of the k-gram, so runs end here whose sides no other document's run of that k-gram has:
   k-grams alone meet by chance ever more often as a corpus grows, sides hardly do;
2. *cut*: the bytes of the runs that are left are cut from the texts and dealt to the parts;
3. *order*: each part sorts their suffixes, compares neighbours byte by byte and makes the LPF array from previous and
   next smaller documents; windows whose factor has the full length become removals;
4. *apply*: removals meet their texts.

Parts are slots of a bounded number of bytes of text, whatever the number of shuffle partitions; a task takes its slots
one after another.

A k-gram with very many contents (the edge of a line that a third of all documents holds) is *hot*: its windows are
dealt one by one by their own content after a local pass that keeps the smallest document of each. A block of text
reports at most ``LOCAL`` contents of a k-gram, so no task gets a hot group.
Documents with a null id have no order: they stay whole and remove nothing. Rows with equal ids never remove parts of
each other. Null and empty texts yield zeros and the digest of no bytes. Texts of any length are judged whole; above
2**24 bytes their runs are found in overlapping pieces. Columns of any name may be there, and an empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwright.llm.text import _TABLE, U64, buffers, mix, powers, slices, span_hashes
from nestwright.llm.work import Workspace, lean, shuffle_width

#: Bytes of text whose runs are reported together and looked for together; contents of one k-gram that such a block may report, beyond which the
#: k-gram is hot, as it is from HOT contents in all.
BLOCK, PIECE, LOCAL, HOT = 4 << 20, 1 << 20, 16, 256
#: Runs whose windows are sorted at a time; bytes of text for each slot and for each task.
CELL = 8_000
SLOT, TASK = 12 << 20, 192 << 20
_PACKED = T.StructType([T.StructField("dest", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])
_HEAD = np.dtype([("n", "<i8"), ("docs", "<i8")])


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses high zero bytes away."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(data: bytes, at: int, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, modulo the type's range: small where ``x`` is in order."""
    out = x.copy()
    out[1:] -= x[:-1]
    return out


def _pack(docs: np.ndarray, tags: np.ndarray, doc: np.ndarray, *columns: np.ndarray, raw: bytes = b"") -> bytes:
    """A blob of entries: the documents they name once, then each column."""
    used, index = np.unique(doc, return_inverse=True)
    small = index.astype(np.uint16 if len(used) < 65536 else np.uint32)
    return b"".join([np.array([(len(doc), len(used))], _HEAD).tobytes(), _planes(_steps(docs[used].astype("<i8").view("<u8"))), _planes(tags[used].astype("<i4")), _planes(small), *(_planes(np.ascontiguousarray(c)) for c in columns), raw])


def _unpack(blob: bytes, kinds: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(document id, tag, column, ...) of each entry, and the bytes that follow."""
    n, docs = (int(x) for x in np.frombuffer(blob, _HEAD, 1)[0])
    at = _HEAD.itemsize
    ids, tags = np.cumsum(_from_planes(blob, at, docs, "<u8"), dtype="<u8").view("<i8"), _from_planes(blob, at + 8 * docs, docs, "<i4")
    at += 12 * docs
    index = _from_planes(blob, at, n, "<u2" if docs < 65536 else "<u4")
    at += index.nbytes
    out = [ids[index], tags[index]]
    for kind in kinds:
        out.append(_from_planes(blob, at, n, kind))
        at += out[-1].nbytes
    return (*out, blob[at:])


def _unpack_all(blobs: list[bytes], kinds: tuple[str, ...]) -> tuple[list[np.ndarray], bytes]:
    parts = [_unpack(b, kinds) for b in blobs]
    empty = [np.zeros(0, k) for k in ("<i8", "<i4", *kinds)]
    return [np.concatenate([p[i] for p in parts]) if parts else empty[i] for i in range(len(kinds) + 2)], b"".join(p[-1] for p in parts)


def _rows(dest: list[int], kind: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(dest, pa.int32()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], ["dest", "kind", "blob"])


def _runs(raw: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that share the k-gram of smallest hash: document, first window in it, windows, k-gram's hash and place in the document."""
    n, w = len(raw), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U64), none
    h, size, step = _TABLE[raw], 1, _TABLE[7] | U64(1)
    grams = None  # k-gram hashes by doubling over the bits of k
    taken, power = 0, int(step)
    while size <= k:
        if k & size:
            if grams is None:
                grams, taken = h, size
            else:
                m = min(len(grams), len(h) - taken)
                grams = grams[:m] + h[taken : taken + m] * U64(pow(int(step), taken, 1 << 64))
                taken += size
        if size * 2 <= k:
            h = h[:-size] + h[size:] * U64(power)
        size, power = size * 2, power * power % (1 << 64)
    grams = mix(grams[: n - k + 1])
    ranked = (grams & ~U64(0xFFFFFF)) | np.arange(len(grams), dtype=U64)  # leftmost of equal ones; blocks are below 2**24 bytes
    least, have = ranked, 1
    while have * 2 <= w:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    if have < w:
        least = np.minimum(least[: n - length + 1], least[w - have : w - have + n - length + 1])
    sizes = np.diff(offs)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    inside = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0))
    least = least[offs[doc] + inside]
    if not len(least):
        return none, none, none, none.astype(U64), none
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    spot = (least[at] & U64(0xFFFFFF)).astype(np.int64)
    return doc[at], inside[at], np.diff(np.append(at, len(least))), grams[spot], spot - offs[doc[at]]


def _long_runs(raw: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """As _runs, for one text of any size: overlapping pieces below 2**24 bytes."""
    if len(raw) < (1 << 24):
        return _runs(raw, offs, length, k)
    found, step = [], (1 << 24) - length - 1
    for at in range(0, len(raw) - length + 1, step):
        piece = raw[at : at + step + length - 1]
        d, i, r, g, p = _runs(piece, np.array([0, len(piece)]), length, k)
        found.append((d, i + at, r, g, p + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sides(values: np.ndarray, length: int, k: int, first: np.ndarray, n: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """24-bit hashes of what a run's windows hold left and right of their k-gram, 0 for the side that no window has.

    With ``m`` half of the bytes beside the k-gram, a window begins ``m`` or more bytes before it and holds those ``m``,
    or it holds ``length - m + 1`` from the k-gram's start on. So equal windows are runs that share the k-gram and a side.
    """
    m = (length - k) // 2

    def side(there: np.ndarray, a: int, b: int) -> np.ndarray:
        out = np.zeros(len(spot), "<u4")
        out[there] = np.maximum(span_hashes(values, spot[there] + a, spot[there] + b) >> U64(40), U64(1))
        return out

    return side(spot - first >= m, -m, k), side(spot - (first + n - 1) < m, 0, length - m + 1)


def _report(docs, tags, doc, first, n, gram, content, many, left, right) -> bytes:
    """Runs of one block: its documents with their numbers of runs, then first window, windows, k-gram, content and sides."""
    by = np.lexsort((first, doc))
    doc, first, n, gram, content, many, left, right = (x[by] for x in (doc, first, n, gram, content, many, left, right))
    head, count = _heads(doc)
    used = doc[head]
    out = [np.array([(len(doc), len(used))], _HEAD).tobytes(), _planes(_steps(docs[used].astype("<i8").view("<u8"))), _planes(tags[used].astype("<i4")), _planes(count.astype("<u4")), _planes(first.astype("<i4"))]
    out += [(n.astype(np.uint8) | (many.astype(np.uint8) << 7)).tobytes(), (gram >> U64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), content.tobytes()]
    return b"".join([*out, *(x.view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for x in (left, right))])


def _reported(blob: bytes) -> tuple[np.ndarray, ...]:
    """(document id, tag, first window, windows, many, k-gram, content, left side, right side) of each run of a report."""
    n, docs = (int(x) for x in np.frombuffer(blob, _HEAD, 1)[0])
    at = _HEAD.itemsize
    ids, tags, count = np.cumsum(_from_planes(blob, at, docs, "<u8"), dtype="<u8").view("<i8"), _from_planes(blob, at + 8 * docs, docs, "<i4"), _from_planes(blob, at + 12 * docs, docs, "<u4")
    at += 16 * docs
    first, size = _from_planes(blob, at, n, "<i4"), np.frombuffer(blob, np.uint8, n, at + 4 * n)

    def narrow(at: int, size: int, kind: str) -> np.ndarray:
        out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
        out[:, :size] = np.frombuffer(blob, np.uint8, size * n, at).reshape(n, size)
        return out.view(kind).ravel()

    return np.repeat(ids, count), np.repeat(tags, count), first, size & 127, size > 127, narrow(at + 5 * n, 5, "<u8"), np.frombuffer(blob, "<u8", n, at + 10 * n), narrow(at + 18 * n, 3, "<u4"), narrow(at + 21 * n, 3, "<u4")


def _heads(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and size of each stretch of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(new)))


def _find(length: int, k: int, parts: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            tags = batch.column(2).to_numpy(zero_copy_only=False).astype("<i4")
            for lo, hi in slices(texts, BLOCK):
                docs, tag = ids.slice(lo, hi - lo).to_numpy(zero_copy_only=False), tags[lo:hi]
                found = []
                for a, b in slices(texts.slice(lo, hi - lo), PIECE):
                    raw, at = buffers(texts.slice(lo + a, b - a))
                    doc, first, n, gram, spot = _long_runs(raw, at, length, k)
                    if len(doc):
                        begin, values = at[doc] + first, _TABLE[raw]
                        found.append((doc + a, first.astype("<i4"), n, gram, span_hashes(values, begin, begin + n + length - 1), *_sides(values, length, k, begin, n, at[doc] + spot)))
                if not found:
                    continue
                doc, first, n, gram, content, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
                del found
                order = np.lexsort((docs[doc], content, gram))
                doc, first, n, gram, content, left, right = (x[order] for x in (doc, first, n, gram, content, left, right))
                owner = docs[doc]
                head, size = _heads(gram, content)
                later = owner > np.repeat(owner[head], size)  # the block holds an earlier equal run
                out = [(d, 2, blob) for d, _, blob in _by_document(groups, owner[later], tag[doc[later]], 2, first[later], n[later].astype("<i4"))]
                doc, first, n, gram, content, left, right = (x[~later] for x in (doc, first, n, gram, content, left, right))
                head, _ = _heads(gram, content)
                distinct = np.zeros(len(gram), np.int64)
                distinct[head] = 1
                rank = np.cumsum(distinct)
                head, size = _heads(gram)
                rank -= np.repeat(rank[head], size)  # number of the content among the k-gram's
                contents = np.repeat(rank[head + size - 1] + 1, size)
                many = contents > LOCAL
                told = ~many | (rank < LOCAL)
                # other runs of a k-gram that this block alone makes hot go straight to their texts
                rest = ~told
                out += [(d, 1, blob) for d, _, blob in _by_document(groups, docs[doc[rest]], tag[doc[rest]], 1, first[rest], n[rest].astype(np.uint8), np.zeros(int(rest.sum()), "<i4"), np.ones(int(rest.sum()), bool), np.zeros(int(rest.sum()), np.uint8))]
                doc, first, n, gram, content, many, left, right = (x[told] for x in (doc, first, n, gram, content, many, left, right))
                dest = (gram % U64(parts)).astype(np.int32)
                by = np.argsort(dest, kind="stable")
                head, size = _heads(dest[by])
                for a, b in zip(head, head + size, strict=True):
                    x = by[a:b]
                    out.append((int(dest[x[0]]), 0, _report(docs, tag, doc[x], first[x], n[x], gram[x], content[x], many[x], left[x], right[x])))
                for a in range(0, len(out), 256):
                    yield _rows(*map(list, zip(*out[a : a + 256], strict=True)))

    return lean(run)


def _by_document(parts: int, ids: np.ndarray, tags: np.ndarray, kind: int, *columns: np.ndarray):
    """Blobs of entries for the texts they belong to."""
    if not len(ids):
        return
    to = (ids % parts).astype(np.int32)
    by = np.lexsort((tags, ids, to))
    head, size = _heads(to[by])
    for a, b in zip(head, head + size, strict=True):
        x = by[a:b]
        start, count = _heads(ids[x], tags[x])
        yield int(to[x[0]]), kind, _pack(ids[x[start]], tags[x[start]], np.repeat(np.arange(len(start)), count), *(c[x] for c in columns))


def _by_slot(settle):
    """Runs ``settle(slot, blobs)`` for one slot after another; entries for texts (kind above 0) pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for dest, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    out.append((dest, kind, blob))
                    continue
                if dest != now:
                    if held:
                        yield from settle(now, held)
                    now, held = dest, []
                held.append(blob)
            if out:
                yield _rows(*map(list, zip(*out, strict=True)))
        if held:
            yield from settle(now, held)

    return lean(run)


def _met(group: np.ndarray, side: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a run of another document has the same side in the same group."""
    out = np.zeros(len(ids), bool)
    there = np.flatnonzero(side)
    key = group[there] | side[there]
    by = np.argsort(key)
    there = there[by]
    head, size = _heads(key[by])
    if len(head):
        own = ids[there]
        out[there] = np.repeat(np.minimum.reduceat(own, head) != np.maximum.reduceat(own, head), size)
    return out


def _match(groups: int):
    def settle(slot: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, tags, first, n, many, gram, content, left, right = (np.concatenate(x) for x in zip(*map(_reported, blobs), strict=True))
        blobs.clear()
        order = np.lexsort((ids, content, gram))
        ids, tags, first, n, many, gram, content, left, right = (x[order] for x in (ids, tags, first, n, many, gram, content, left, right))
        head, size = _heads(gram, content)
        later = ids > np.repeat(ids[head], size)
        yield from _packets(_by_document(groups, ids[later], tags[later], 2, first[later], n[later].astype("<i4")))
        ids, tags, first, n, many, gram, content, left, right = (x[~later] for x in (ids, tags, first, n, many, gram, content, left, right))
        head, size = _heads(gram)
        many = np.repeat(np.logical_or.reduceat(many, head), size)
        group = np.repeat(np.arange(len(head), dtype=U64) << U64(24), size)
        stays = many | _met(group, left, ids) | _met(group, right, ids)
        ids, tags, first, n, many, gram, content = (x[stays] for x in (ids, tags, first, n, many, gram, content))
        if not len(ids):
            return
        distinct = np.zeros(len(gram), np.int64)
        distinct[_heads(gram, content)[0]] = 1
        head, size = _heads(gram)
        hot = many | np.repeat(np.add.reduceat(distinct, head) > HOT, size)
        yield from _packets(_by_document(groups, ids, tags, 1, first, n.astype(np.uint8), np.full(len(ids), slot, "<i4"), hot, gram.astype(np.uint8)))

    return _by_slot(settle)


def _packets(rows) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for a in range(0, len(rows), 256):
        yield _rows(*map(list, zip(*rows[a : a + 256], strict=True)))


def _groups(batches: Iterator[pa.RecordBatch]):
    """(blobs, iterator over (id, tag, text bytes)) for each destination; blobs sort before texts."""
    now, blobs, texts = None, [], []
    for part in (batch.slice(a, 512) for batch in batches for a in range(0, batch.num_rows, 512)):
        for dest, kind, blob, doc, tag, text, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if dest != now:
                if now is not None:
                    yield blobs, texts
                now, blobs, texts = dest, [], []
            if kind < 3:
                blobs.append(blob)
            else:
                texts.append((doc, tag, text or b"", *row))
    if now is not None:
        yield blobs, texts


def _entries(blobs: list[bytes], kinds: tuple[str, ...]) -> tuple[dict, list[np.ndarray]]:
    """Entries sorted by document, and the range of each document in them."""
    (ids, tags, *columns), _ = _unpack_all(blobs, kinds)
    order = np.lexsort((tags, ids))
    ids, tags = ids[order], tags[order]
    cuts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(ids)) if len(ids) else cuts
    return {(int(ids[a]), int(tags[a])): (int(a), int(b)) for a, b in zip(cuts, ends, strict=True)}, [c[order] for c in columns]


def _cut(length: int, parts: int, groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs, texts in _groups(batches):
            if not blobs:
                continue
            where, (first, n, dest, hot, cell) = _entries(blobs, ("<i4", "u1", "<i4", "?", "u1"))
            seen, pieces, picked, owner = set(), [], [], []
            names = []
            for doc, tag, text, *_ in texts:
                if (doc, tag) in seen or (span := where.get((doc, tag))) is None:
                    continue  # identical rows are cut once
                seen.add((doc, tag))
                a, b = span
                starts, sizes = first[a:b].tolist(), n[a:b].tolist()
                pieces += [text[s : s + r + length - 1] for s, r in zip(starts, sizes, strict=True)]
                picked.append(np.arange(a, b))
                owner.append(np.full(b - a, len(names)))
                names.append((doc, tag))
            if not pieces:
                continue
            picked, owner = np.concatenate(picked), np.concatenate(owner)
            docs, tags = np.array([x[0] for x in names], "<i8"), np.array([x[1] for x in names], "<i4")
            first, n, dest, hot, cell = (x[picked] for x in (first, n, dest, hot, cell))
            raw = np.frombuffer(b"".join(pieces), np.uint8)
            sizes = n.astype(np.int64) + length - 1
            base = np.cumsum(sizes) - sizes
            gone, out = [], []
            if hot.any():
                rows = np.flatnonzero(hot)
                reps = n[rows].astype(np.int64)
                row = np.repeat(rows, reps)
                step = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
                at = base[row] + step
                key = span_hashes(_TABLE[raw], at, at + length)
                order = np.lexsort((docs[owner[row]], key))
                row, step, at, key = row[order], step[order], at[order], key[order]
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                size = np.diff(np.append(head, len(key)))
                lead = np.repeat(head, size)
                same = (sliding_window_view(raw, length)[at] == sliding_window_view(raw, length)[at[lead]]).all(1)
                later = same & (docs[owner[row]] > docs[owner[row[lead]]])  # this group alone holds an earlier start
                gone.append((owner[row[later]], (first[row[later]] + step[later]).astype("<i4")))
                left = ~later
                row, step, at, key = row[left], step[left], at[left], key[left]
                windows = sliding_window_view(raw, length)[at]
                out += _deal(docs, tags, owner[row], (first[row] + step).astype("<i4"), np.ones(len(row), np.uint8), (key >> U64(48)).astype(np.uint8), (key % U64(parts)).astype(np.int32), windows.ravel(), np.full(len(row), length))
            cold = np.flatnonzero(~hot)
            if len(cold):
                keep = np.repeat(~hot, sizes)
                out += _deal(docs, tags, owner[cold], first[cold], n[cold], cell[cold], dest[cold], raw[keep], sizes[cold])
            for own, at in gone:
                order = np.lexsort((at, own))
                own, at = own[order], at[order]
                new, count = _heads(own, at - np.arange(len(at)))
                out += _by_document(groups, docs[own[new]], tags[own[new]], 2, at[new].astype("<i4"), count.astype("<i4"))
            yield from _packets(out)

    return lean(run)


def _deal(docs, tags, own, first, n, cell, dest, raw, sizes) -> list[tuple[int, int, bytes]]:
    """Blobs of runs with their bytes, for the parts that order them."""
    by = np.argsort(dest, kind="stable")
    ends = np.cumsum(sizes)
    begins = ends - sizes
    cuts = np.flatnonzero(np.append(True, dest[by][1:] != dest[by][:-1]))
    out = []
    for a, b in zip(cuts, np.append(cuts[1:], len(by)), strict=True):
        x = by[a:b]
        span = np.repeat(begins[x] - (np.cumsum(sizes[x]) - sizes[x]), sizes[x]) + np.arange(int(sizes[x].sum()))
        out.append((int(dest[x[0]]), 0, _pack(docs, tags, own[x], first[x], n[x], cell[x], raw=raw[span].tobytes())))
    return out


def _smaller(docs: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it whose document is smaller, 0 without one.

    ``common[i]`` is the common prefix of suffixes i - 1 and i. All positions jump at once to the candidate of their
    candidate, which skips only documents that are no smaller, and the prefix shrinks with each jump. What has shrunk
    below ``least`` is not followed further.
    """
    at, low = np.arange(len(docs)) - 1, common.copy()
    low[:1] = 0
    going = np.flatnonzero(low >= least)
    going = going[docs[at[going]] >= docs[going]]
    while len(going):
        there = at[going]
        low[going] = np.minimum(low[going], low[there])
        at[going] = at[there]
        going = going[low[going] >= least]
        going = going[docs[at[going]] >= docs[going]]
    return low


def longest_previous_factors(windows: np.ndarray, docs: np.ndarray, least: int = 1) -> np.ndarray:
    """LPF array of suffixes given by their first bytes (a row each): the longest prefix that starts in a smaller document.

    Suffixes are put in order and their common prefixes compared byte by byte; of suffixes with a smaller document the
    nearest before and the nearest behind in that order (previous and next smaller values) have the longest one. Factors
    are cut at the width of a row, and those below ``least`` may be told too long, but below ``least`` still.
    """
    n, length = windows.shape
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = windows
    words = wide.view(">u8").astype(U64)
    order = np.lexsort((docs, *(words[:, i] for i in range(words.shape[1] - 1, -1, -1))))
    words, ranked_docs = words[order], docs[order]
    common = np.zeros(n + 1, np.int64)
    for a in range(1, n, 1 << 15):  # eight bytes at a time: the first word that differs, and its first byte that does
        b = min(n, a + (1 << 15))
        differ = words[a:b] ^ words[a - 1 : b - 1]
        at = (differ != 0).argmax(1)
        first = differ[np.arange(b - a), at]
        within = sum((first < U64(1 << shift)).astype(np.int64) for shift in range(56, 0, -8))
        common[a:b] = np.where(first == 0, length, np.minimum(8 * at + within, length))
    before = _smaller(ranked_docs, common[:n], least)
    behind = _smaller(ranked_docs[::-1], common[1:][::-1], least)[::-1]
    out = np.empty(n, np.int64)
    out[order] = np.maximum(before, behind)
    return out


def _earlier(length: int, ids: np.ndarray, n: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, window in it) of each window that a smaller document holds; a row of ``runs`` has a run's bytes, zero-padded.

    Of runs with equal bytes that of the smallest document stands in suffix order; the others' windows all start there.
    """
    words = runs.view("<u8")
    key = mix((words * powers(0xD6E8FEB86659FD93, words.shape[1])[1 : 1 + words.shape[1]]).sum(1, dtype=U64) + n.astype(U64))
    order = np.lexsort((ids, key))
    new = np.append(True, (key[order][1:] != key[order][:-1]) | (words[order[1:]] != words[order[:-1]]).any(1) | (n[order[1:]] != n[order[:-1]]))
    group = np.empty(len(n), np.int64)
    group[order] = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)]  # the smallest document of each distinct run
    base = np.cumsum(n[lead]) - n[lead]
    row = np.repeat(lead, n[lead])
    step = np.arange(len(row)) - np.repeat(base, n[lead])
    factors = longest_previous_factors(sliding_window_view(runs, length, axis=1)[row, step], ids[row], length)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    gone = (ids[lead][group[row]] < ids[row]) | (factors[base[group[row]] + step] >= length)
    return row[gone], step[gone]


def _order(length: int, k: int, groups: int):
    wide = -(-(2 * length - k) // 8) * 8

    def settle(slot: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        (ids, tags, first, n, cell), raw = _unpack_all(blobs, ("<i4", "u1", "u1"))
        blobs.clear()
        raw, n = np.frombuffer(raw, np.uint8), n.astype(np.int64)
        sizes = n + length - 1
        begins = np.cumsum(sizes) - sizes
        # equal windows have equal cells; a share of the cells at a time bounds memory
        shares = min(256, -(-len(n) // CELL))
        cell = cell % shares
        for share in range(shares):
            x = np.flatnonzero(cell == share)
            if not len(x):
                continue
            place = np.arange(int(sizes[x].sum())) - np.repeat(np.cumsum(sizes[x]) - sizes[x], sizes[x])
            runs = np.zeros((len(x), wide), np.uint8)
            runs[np.repeat(np.arange(len(x)), sizes[x]), place] = raw[np.repeat(begins[x], sizes[x]) + place]
            row, step = _earlier(length, ids[x], n[x], runs)
            if len(row):
                head, size = _heads(row, step - np.arange(len(step)))
                y = x[row[head]]
                yield from _packets(_by_document(groups, ids[y], tags[y], 2, (first[y] + step[head]).astype("<i4"), size.astype("<i4")))

    return _by_slot(settle)


def _merge(first: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Union of the byte ranges of removed windows."""
    order = np.argsort(first, kind="stable")
    a = first[order].astype(np.int64)
    b = np.maximum.accumulate(a + count[order] + length - 1)
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def _whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they cover in part."""
    out = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def _apply(length: int, text_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_type = None

        def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal row_type
            for batch in batches:
                row_type = batch.schema.field("row").type
                yield batch

        for blobs, texts in _groups(noted(batches)):
            where, columns = _entries(blobs, ("<i4", "<i4")) if blobs else ({}, None)
            for lo in range(0, len(texts), 1000):
                out: list[list] = [[] for _ in range(6)]
                for doc, tag, text, row in texts[lo : lo + 1000]:
                    spans = []
                    if doc is not None and (x := where.get((doc, tag))):
                        a, b = _merge(columns[0][x[0] : x[1]], columns[1][x[0] : x[1]], length)
                        spans = list(zip(a.tolist(), b.tolist(), strict=True))
                    if text_too:
                        spans = _whole_characters(text, spans)
                    edges = [0, *(e for s in spans for e in s), len(text)]
                    rest = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                    for column, value in zip(out, (doc, len(text), len(text) - len(rest), [{"from": a, "to": b} for a, b in spans], rest if text_too else hashlib.sha256(rest).hexdigest(), row), strict=True):
                        column.append(value)
                span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                types = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary() if text_too else pa.string(), row_type]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc", "n_bytes", "n_removed", "spans", "kept", "row"])

    return lean(run)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, k: int = 16, text_too: bool = False) -> DataFrame:
    """What earlier documents already hold of each text.

    One row per input row: ``doc``, ``n_bytes``, ``n_removed``, ``spans`` (array of struct<from, to>, maximal byte
    ranges), ``kept``: the hex SHA-256 of the remaining bytes, or the bytes themselves with ``text_too``, when
    characters that a span covers in part stay whole; and ``row``: a struct of the other columns as c0, c1, ... in their
    order, the text's place holding whether it was null.
    """
    if not 8 <= k < length <= 200 or length - k + 1 > 127:  # a run's windows are counted in seven bits
        raise ValueError("8 <= k < length <= 200, and length - k + 1 <= 127")
    spark = docs.sparkSession
    work = Workspace(spark, "lpf")
    row = F.struct(*((F.col(f"`{c}`").isNull() if c == text_col else F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(docs.columns)))
    number = F.col(id_col).cast("long")
    tag = F.shiftright(F.coalesce(F.xxhash64(F.col(text_col)), F.lit(0)), 32).cast("int")  # tells rows of one id apart
    if docs.select(number.alias("doc")).where("doc is not null").groupBy("doc").count().where("count > 1").isEmpty():
        tag = F.when(number.isNull(), tag).otherwise(0)  # nothing to tell apart, and zeros take no room
    source = docs.select(number.alias("doc"), F.col(text_col).cast("string").alias("text"), tag.alias("tag"), row.alias("row"))
    ordered = source.where(f"doc is not null and octet_length(text) >= {length}").drop("row")

    # slots bound what a task holds, by the bytes of text; a task takes one slot after another
    width, size = shuffle_width(spark), ordered.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    parts = groups = max(width, -(-size // SLOT))
    tasks = min(parts, max(width, -(-size // TASK)))

    def dealt(df: DataFrame) -> DataFrame:
        out = df.repartitionById(tasks, F.pmod("dest", F.lit(tasks)).cast("int"))
        return out if tasks == parts else out.sortWithinPartitions("dest")

    def beside(packed: DataFrame, rows: DataFrame) -> DataFrame:
        """Packed entries and texts of the same documents in one partition, entries first."""
        group = F.coalesce(F.pmod("doc", F.lit(groups)), F.pmod("tag", F.lit(groups))).cast("int").alias("dest")
        texts = rows.select(group, F.lit(3).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc", "tag", F.col("text").cast("binary").alias("text"), *(["row"] if "row" in rows.columns else []))
        return dealt(packed.unionByName(texts, allowMissingColumns=True)).sortWithinPartitions("dest", "kind")

    found = work.table(dealt(ordered.mapInArrow(_find(length, k, parts, groups), _PACKED)).mapInArrow(_match(groups), _PACKED), "found")
    work.release()
    cut = beside(found.where("kind = 1"), ordered).mapInArrow(_cut(length, parts, groups), _PACKED)
    spans = work.table(dealt(cut).mapInArrow(_order(length, k, groups), _PACKED), "spans")
    work.release()
    spans = spans.unionByName(found.where("kind = 2"))
    schema = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc", "n_bytes", "n_removed")), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))), T.StructField("kept", T.BinaryType() if text_too else T.StringType()), source.schema["row"]])
    return beside(spans, source).mapInArrow(_apply(length, text_too), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, n_chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text_col`` (null stays null); ``n_chars_col`` follows if there."""
    text = F.col("kept").cast("string")
    columns = []
    for i, c in enumerate(docs.columns):
        if c == text_col:
            columns.append(F.when(~F.col(f"row.c{i}"), text).alias(c))
        elif c == n_chars_col:
            columns.append(F.when(F.col(f"row.c{i}").isNotNull(), F.char_length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"row.c{i}").alias(c))
    return repeated_spans(docs, id_col, text_col, length, text_too=True).select(*columns)
