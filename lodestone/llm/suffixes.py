"""Removal of repeated passages by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of `LENGTH` bytes over it also starts in a document with a smaller id. Suffixes are sampled so that
equal strings are sampled alike: of the 44 pieces of seven bytes in a string the one of least hash, its place taken modulo
`STRIDE`, tells where in the string a suffix is kept, about one in fifteen. Its first `GRAM` bytes, which lie in the
string, are its initial bucket; equal strings have a suffix of one bucket at the same place.

1. Buckets are exchanged once, as hashes: of the `GRAM` bytes, and of all bytes that strings with this suffix can reach
   (`SIDE` to either side). A bucket that holds one document is final. Where a document with a smaller id reaches the same
   bytes, all strings around the suffix are repeated. Equal ones are told within a task before the exchange, so a
   passage that very many documents share is one entry a task.
2. What is left of buckets with several documents and several surroundings sends those bytes to its bucket, once a
   document, however often it repeats them. There positions get buckets of eight bytes, and buckets are refined by sorting
   on the pairs of their own number and that of a later offset, each round with the numbers of the round before: 8, 16, 32,
   `LENGTH` bytes. Positions whose bucket holds one document, or whose later offset has left, leave. Bytes are compared, not
   hashes. What stays is repeated in all but its smallest document.
3. A bucket that holds more than `BUSY` surroundings, or `HOT` in one task's turn, would be one task's load; each of its
   strings gets a bucket by itself there, a hash of 128 bits, of which tasks send the smallest document only.

Defined results: null text is empty and has the hash of nothing; texts of fewer than `LENGTH` bytes keep everything; rows
that repeat an id are compared with other ids only, never with each other; rows with a null id neither lose nor take
bytes; overlapping and touching repeats are one span; an empty table gives no rows; other columns are never read. Long texts are
read in chunks that overlap by a string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, mix64

LENGTH, GRAM, TINY = 50, 29, 7
STRIDE = LENGTH - GRAM + 1
SIDE = LENGTH - GRAM
#: Bytes of a suffix with what strings around it reach.
REACH = LENGTH + SIDE
ALL = (1 << STRIDE) - 1
PAD = b"\0" * 64
#: Window starts worked on at a time, bytes of texts read together, suffixes told apart together, and of a part; surroundings of a part.
CHUNK, BYTES, TOGETHER, PART, ASKED = 1 << 16, 1 << 20, 200_000, 400_000, 6_000
#: Rows of a batch whose texts are held as Python objects together.
ROWS = 500
HOT, BUSY = 100, 2000
_MODULO = (np.arange(256) % STRIDE).astype(np.int64)


@dataclass
class Suffixes:
    """Texts on end between zeros, and their sampled suffixes: place, text, bucket and surroundings as hashes, name."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray
    of: np.ndarray
    bucket: np.ndarray
    around: np.ndarray

    @property
    def name(self) -> np.ndarray:
        """Stands for bucket and surroundings within a document."""
        return named(self.bucket, self.around)

    def words(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from each place."""
        return np.ndarray((len(self.raw) - 7,), "<u8", self.raw, strides=(1,))[at]

    def first(self) -> np.ndarray:
        """The first start of a string that holds the suffix's bucket, for each suffix."""
        return np.maximum(self.at - SIDE, self.start[self.of])

    def last(self) -> np.ndarray:
        return np.minimum(self.at, self.end[self.of] - LENGTH)


def named(bucket: np.ndarray, around: np.ndarray) -> np.ndarray:
    return mix64((bucket << np.uint64(16)) ^ mix64(around.astype(np.uint64)))


def _sampled(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of sampled suffixes; `starts` marks where strings start."""
    mark, low = np.zeros(len(raw), dtype=bool), np.uint64((1 << 20) - 1)
    for s in range(0, len(raw) - LENGTH, CHUNK):
        n = min(CHUNK, len(raw) - LENGTH - s)
        good = starts[s : s + n]
        if not good.any():
            continue
        size = n + LENGTH - TINY
        x = (np.ndarray((size,), "<u8", raw, offset=s, strides=(1,)) << np.uint64(64 - 8 * TINY)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x &= ~low
        x |= np.arange(size, dtype=np.uint64)
        for k in (1, 2, 4, 8, 16):
            x = np.minimum(x[:-k], x[k:])
        rest = LENGTH - TINY + 1 - 32
        x = np.minimum(x[:n], x[rest : rest + n]) & low
        at = np.arange(n)
        mark[(s + at + _MODULO[(x.astype(np.int64) - at)])[good]] = True
    return np.flatnonzero(mark)


def suffixes(texts: list[bytes]) -> Suffixes:
    size = np.array([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(PAD + PAD.join(texts) + PAD, dtype=np.uint8)
    end = np.cumsum(size + len(PAD))
    start = end - size
    step = np.zeros(len(raw) + 1, dtype=np.int8)
    long = size >= LENGTH
    step[start[long]] = 1
    step[end[long] - LENGTH + 1] = -1
    at = _sampled(raw, np.cumsum(step[:-1], dtype=np.int8) > 0)
    of = np.searchsorted(start, at, side="right") - 1
    out = Suffixes(raw, start, end, at, of, at, at)
    h = np.full(len(at), 0x243F6A8885A308D3, dtype=np.uint64)
    for k in (0, 8, 16, GRAM - 8):
        h = mix64(h ^ out.words(at + k))
    left, right = np.minimum(SIDE, at - start[of]), np.minimum(SIDE, end[of] - at - GRAM)
    c = mix64(h ^ (left << 8 | right).astype(np.uint64))
    for k in (-SIDE, 8 - SIDE, -8, GRAM, GRAM + 8, LENGTH - 8):
        c = mix64(c ^ out.words(at + k))
    out.bucket, out.around = h >> np.uint64(16), (c >> np.uint64(32)).astype(np.uint32)
    return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches a few rows at a time, so that their values are never all copied out of Arrow at once."""
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            yield batch.slice(s, ROWS)
        del batch
        pa.default_memory_pool().release_unused()


def _together(ids: list[int], texts: list[bytes | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Rows a few at a time, up to BYTES or one long text."""
    s, size = 0, 0
    for i, text in enumerate(texts):
        if i > s and size + len(text or b"") > BYTES:
            yield ids[s:i], [t or b"" for t in texts[s:i]]
            s, size = i, 0
        size += len(text or b"")
    if s < len(texts):
        yield ids[s:], [t or b"" for t in texts[s:]]


#: What is sent: suffixes; names in documents that are repeated, that are asked for their bytes, or whose strings get buckets of
#: their own; buckets that are so; repeated strings of names in documents.
ENTRY, FOUND, ASKED_FOR, SINGLE, MARKED, MARK = range(6)
_COLUMNS = {ENTRY: ("<i8", "V6", "<u4"), FOUND: ("<i8", "<u8"), ASKED_FOR: ("<i8", "<u8"), SINGLE: ("<i8", "<u8"), MARKED: ("V6",), MARK: ("<i8", "<u8", "<u4")}
_PACKED = "part long, kind int, data binary"


def _six(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").ravel()


def _wide(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), dtype=np.uint8)
    out[:, :6] = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _packed(kind: int, part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Columns on end by part; ids, which come first, as steps from the one before."""
    order = np.lexsort((columns[0], part)) if kind != MARKED else np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
    data = []
    for i, j in zip(start, [*start[1:], len(part)], strict=False):
        own = [c[i:j] for c in columns]
        if kind != MARKED:
            own[0] = np.diff(own[0], prepend=0)
        data.append(b"".join(_six(c).tobytes() if t == "V6" else c.astype(t).tobytes() for c, t in zip(own, _COLUMNS[kind], strict=True)))
    return pa.record_batch({"part": pa.array(part[start], pa.int64()), "kind": pa.array([kind] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})


def _unpacked(kind: int, table: pa.Table) -> list[np.ndarray]:
    types = [np.dtype(t) for t in _COLUMNS[kind]]
    got: list[list[np.ndarray]] = [[np.zeros(0, dtype=t)] for t in types]
    for k, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        if k == kind:
            n, at = len(data) // sum(t.itemsize for t in types), 0
            for i, t in enumerate(types):
                own = np.frombuffer(data, dtype=t, count=n, offset=at)
                got[i].append(np.cumsum(own) if i == 0 and kind != MARKED else own)
                at += n * t.itemsize
    return [_wide(np.concatenate(x)) if t.kind == "V" else np.concatenate(x) for x, t in zip(got, types, strict=True)]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _part(x: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(x.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _told(doc: np.ndarray, bucket: np.ndarray, around: np.ndarray, busy: int) -> tuple[np.ndarray, ...]:
    """Of sorted entries (by bucket, surroundings, document), masks: the first of equal ones; repeated ones, once a document;
    and, of the first ones, those in buckets of several documents and surroundings, and in buckets of more than `busy` of them."""
    equal = _heads(bucket, around)
    size = np.diff(np.append(equal, len(doc)))
    first = np.zeros(len(doc), dtype=bool)
    first[equal] = True
    repeated = np.zeros(len(doc), dtype=bool)
    repeated[_heads(bucket, around, doc)] = True
    repeated &= doc > np.repeat(doc[equal], size)
    heads = _heads(bucket)
    size = np.diff(np.append(heads, len(doc)))
    some = len(heads) > 0
    low, high = (f.reduceat(doc, heads) if some else doc for f in (np.minimum, np.maximum))
    n = np.add.reduceat(first.astype(np.int64), heads) if some else size
    several = np.repeat((low < high) & (n > 1), size)
    crowded = np.repeat(n > busy, size)
    return first, repeated, first & several, first & several & crowded


def _send(parts: int, hot: int):
    def flush(doc: np.ndarray, bucket: np.ndarray, around: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, around, bucket))
        doc, bucket, around = doc[order], bucket[order], around[order]
        first, repeated, _, crowded = _told(doc, bucket, around, hot)
        name = named(bucket, around)
        yield _packed(ENTRY, _part(bucket[first & ~crowded], parts), [x[first & ~crowded] for x in (doc, bucket, around)])
        for kind, own in ((FOUND, repeated), (SINGLE, crowded)):
            yield _packed(kind, _part(doc[own], parts), [doc[own], name[own]])
        marked = np.unique(bucket[crowded])
        yield _packed(MARKED, _part(marked, parts), [marked])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[tuple[np.ndarray, ...]] = []
        for batch in _sliced(batches):
            for ids, texts in _together(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                s = suffixes(texts)
                got.append((np.array(ids, dtype=np.int64)[s.of], s.bucket, s.around))
                if sum(len(x[0]) for x in got) > TOGETHER:
                    yield from flush(*(np.concatenate(x) for x in zip(*got, strict=True)))
                    got = []
        if got:
            yield from flush(*(np.concatenate(x) for x in zip(*got, strict=True)))

    return run


def _by_document(columns: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """One row a document: under each name the values of its (document, value) pairs as bytes, null for none."""
    docs = np.unique(np.concatenate([d for d, _ in columns.values()]))
    out = {"doc_id": pa.array(docs, pa.int64())}
    for key, (doc, value) in columns.items():
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
        ends = np.searchsorted(doc, docs, side="right")
        offsets = np.concatenate([[0], ends]) * value.dtype.itemsize
        whole = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(offsets.astype("<i8").tobytes()), pa.py_buffer(value.tobytes())])
        out[key] = pa.array([x or None for x in whole.to_pylist()], pa.binary())
    return pa.table(out)


def _judge(busy: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        """A part's buckets: names that are repeated, asked for their bytes, or asked string by string, by parts of documents."""
        doc, bucket, around = _unpacked(ENTRY, table)
        order = np.lexsort((doc, around, bucket))
        doc, bucket, around = doc[order], bucket[order], around[order]
        first, repeated, several, crowded = _told(doc, bucket, around, busy)
        alone = crowded | (first & np.isin(bucket, _unpacked(MARKED, table)[0]))
        name = named(bucket, around)
        out = []
        for kind, own in ((FOUND, repeated), (ASKED_FOR, several & ~alone), (SINGLE, alone)):
            docs, names = (np.concatenate(x) for x in zip((doc[own], name[own]), _unpacked(kind, table), strict=True))
            out.append(_packed(kind, _part(docs, parts), [docs, names]))
        return pa.Table.from_batches(out)

    return run


def _gather(table: pa.Table) -> pa.Table:
    """A part's documents, with what was told of their names."""
    return _by_document({key: tuple(_unpacked(kind, table)) for key, kind in (("found", FOUND), ("asked", ASKED_FOR), ("single", SINGLE))})


def _once(doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Where names stand first in their documents: lines that a document repeats share theirs, and one of them tells all."""
    order = np.lexsort((name, doc))
    return order[_heads(doc[order], name[order])]


def _merged(doc: np.ndarray, name: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks by document and name, one of each, in this order."""
    order = np.lexsort((name, doc))
    doc, name, mask = doc[order], name[order], mask[order]
    heads = _heads(doc, name)
    return doc[heads], name[heads], np.bitwise_or.reduceat(mask, heads) if len(heads) else mask


def _gather_marks(table: pa.Table) -> pa.Table:
    """A part's documents, with the masks of their names, in the order of names."""
    doc, name, mask = _merged(*_unpacked(MARK, table))
    value = np.zeros(len(doc), dtype=_MARK)
    value["name"], value["mask"] = name, mask
    return _by_document({"marks": (doc, value)})


#: What is sent back: names' surroundings; strings; repeated strings of names.
CONTEXT, STRING, MARKS = range(3)
_SENT = {
    CONTEXT: np.dtype([("doc", "<i8"), ("name", "<u8"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", (REACH,))]),
    STRING: np.dtype([("doc", "<i8"), ("name", "<u8"), ("k", "<u8"), ("l", "<u8"), ("mask", "<u4")]),
    MARKS: np.dtype([("doc", "<i8"), ("name", "<u8"), ("mask", "<u4")]),
}
_MARK = np.dtype([("name", "<u8"), ("mask", "<u4")])


def _rows(kind: int, **columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns["doc"]), dtype=_SENT[kind])
    for key, value in columns.items():
        out[key] = value
    return out


def _chosen(s: Suffixes, names: np.ndarray, lists: list[bytes | None]) -> np.ndarray:
    """Suffixes whose names are in their text's list."""
    keep, at = np.zeros(len(names), dtype=bool), np.searchsorted(s.of, np.arange(len(lists) + 1))
    for i, own in enumerate(lists):
        if own and at[i] < at[i + 1]:
            keep[at[i] : at[i + 1]] = np.isin(names[at[i] : at[i + 1]], np.frombuffer(own, dtype="<u8"))
    return np.flatnonzero(keep)


def _told_strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of every string's first document, and those of others."""
    rows = rows[np.lexsort((rows["doc"], rows["l"], rows["k"]))]
    heads = _heads(rows["k"], rows["l"])
    later = rows["doc"] > np.repeat(rows["doc"][heads], np.diff(np.append(heads, len(rows))))
    return rows[~later], rows[later]


def _marks(rows: np.ndarray) -> np.ndarray:
    doc, name, mask = _merged(rows["doc"], rows["name"], rows["mask"])
    return _rows(MARKS, doc=doc, name=name, mask=mask)


def _ask(parts: int):
    """Surroundings and strings of what documents were asked for, once for each name. Columns: doc_id, text, asked, single."""

    def chosen(s: Suffixes, doc: np.ndarray, name: np.ndarray, lists: list[bytes | None]) -> np.ndarray:
        at = _chosen(s, name, lists)
        return at[_once(doc[at], name[at])]

    def dealt(kind: int, part: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(part, kind="stable")
        part, rows = part[order], rows[order]
        start = _heads(part)
        data = [rows[i:j].tobytes() for i, j in zip(start, [*start[1:], len(part)], strict=False)]
        return pa.record_batch({"part": pa.array(part[start], pa.int64()), "kind": pa.array([kind] * len(data), pa.int32()), "data": pa.array(data, pa.binary())})

    def contexts(s: Suffixes, at: np.ndarray, doc: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, start, end = s.at[at], s.start[s.of[at]], s.end[s.of[at]]
        around = np.lib.stride_tricks.sliding_window_view(s.raw, REACH)[place - SIDE]
        rows = _rows(CONTEXT, doc=doc[at], name=name[at], left=np.minimum(SIDE, place - start), right=np.minimum(SIDE, end - place - GRAM), bytes=around)
        return s.bucket[at], rows

    def strings(s: Suffixes, at: np.ndarray, doc: np.ndarray, name: np.ndarray) -> np.ndarray:
        first = s.first()[at]
        count = s.last()[at] - first + 1
        own = np.repeat(at, count)
        begins = np.repeat(first, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        k, j = np.full(len(own), 0x13198A2E03707344, dtype=np.uint64), np.full(len(own), 0xA4093822299F31D0, dtype=np.uint64)
        for d in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            word = s.words(begins + d)
            k, j = mix64(k ^ word), mix64(j + word) ^ word
        return _rows(STRING, doc=doc[own], name=name[own], k=k, l=mix64(j), mask=np.uint32(1) << (begins - s.at[own] + SIDE).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            batch = batch.filter(pc.or_(pc.is_valid(batch.column(2)), pc.is_valid(batch.column(3))))
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            asked, single, seen = batch.column(2).to_pylist(), batch.column(3).to_pylist(), 0
            every, where, alone = [], [], []
            for some, own in _together(ids, texts):
                s = suffixes(own)
                doc, name = np.array(some, dtype=np.int64)[s.of], s.name
                bucket, rows = contexts(s, chosen(s, doc, name, asked[seen : seen + len(some)]), doc, name)
                every.append(rows)
                where.append(bucket)
                alone.append(strings(s, chosen(s, doc, name, single[seen : seen + len(some)]), doc, name))
                seen += len(some)
                if seen == len(ids) or sum(map(len, every)) + sum(map(len, alone)) > 200_000:
                    yield dealt(CONTEXT, _part(np.concatenate(where), parts), np.concatenate(every))
                    first, later = _told_strings(np.concatenate(alone))
                    yield dealt(STRING, _part(first["k"], parts), first)
                    marks = _marks(later)
                    yield dealt(MARKS, _part(marks["doc"], parts), marks)
                    every, where, alone = [], [], []

    return run


def refined(bytes_: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row of REACH bytes, of which `left` before and `right` behind the middle count, the strings of LENGTH bytes
    that a smaller document's row has too, as bits by their starts."""
    n, wide = len(bytes_), REACH - 7
    assert n * wide < 1 << 31
    flat = np.ascontiguousarray(bytes_)
    place = np.arange(wide)
    inside = (place >= SIDE - left.astype(np.int64)[:, None]) & (place + 8 <= LENGTH + right.astype(np.int64)[:, None])
    pointer = np.full((n, REACH + 32), -1, dtype=np.int32)  # a position's bucket, -1 once it has left
    row, at = (x.astype(np.int32) for x in np.nonzero(inside))
    key = np.ndarray((n, wide), "<u8", flat, strides=(REACH, 1))[row, at]
    mask = np.zeros(n, dtype=np.uint32)
    for later in (8, 16, LENGTH - 32, None):
        order = np.argsort(key, kind="stable").astype(np.int32)
        row, at, key = row[order], at[order], key[order]
        del order
        heads = _heads(key)
        if not len(heads):
            return mask
        size, own = np.diff(np.append(heads, len(key))), doc[row]
        low, high = np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)
        pointer[row, at] = np.repeat(np.where(low < high, np.arange(len(heads)), -1).astype(np.int32), size)
        if later is None:
            repeated = own > np.repeat(low, size)
            np.bitwise_or.at(mask, row[repeated], np.uint32(1) << at[repeated].astype(np.uint32))
            return mask
        here, there = pointer[row, at], pointer[row, at + later]
        stay = (here >= 0) & (there >= 0)
        pointer[row[~stay], at[~stay]] = -1
        row, at, key = row[stay], at[stay], here[stay].astype(np.uint64) * np.uint64(len(heads)) + there[stay].astype(np.uint64)
    return mask


def _refine(parts: int):
    def run(table: pa.Table) -> pa.Table:
        """A part's repeated strings, as names and masks by parts of documents."""
        sent = list(zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True))
        got = {k: np.concatenate([np.zeros(0, dtype=t), *(np.frombuffer(d, dtype=t) for q, d in sent if q == k)]) for k, t in _SENT.items()}
        c = got[CONTEXT]
        mask = refined(c["bytes"], c["left"], c["right"], c["doc"])
        some = mask > 0
        marks = np.concatenate([got[MARKS], _marks(_told_strings(got[STRING])[1]), _rows(MARKS, doc=c["doc"][some], name=c["name"][some], mask=mask[some])])
        return pa.Table.from_batches([_packed(MARK, _part(marks["doc"], parts), [marks["doc"], marks["name"], marks["mask"]])])

    return run


def spans(texts: list[bytes], found: list[bytes | None], marks: list[bytes | None]) -> list[np.ndarray]:
    """For each text the maximal runs of removed bytes, as rows of (from, to). Marks stand once a name, in the order of names."""
    s = suffixes(texts)
    name, first, last = s.name, s.first(), s.last()
    step = np.zeros(len(s.raw) + 1, dtype=np.int32)
    own = _chosen(s, name, found)
    np.add.at(step, first[own], 1)
    np.add.at(step, last[own] + LENGTH, -1)
    at = np.searchsorted(s.of, np.arange(len(texts) + 1))
    places, masks = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]
    for i, lists in enumerate(marks):
        if lists and at[i] < at[i + 1]:
            mark, own = np.frombuffer(lists, dtype=_MARK), name[at[i] : at[i + 1]]
            where = np.minimum(np.searchsorted(mark["name"], own), len(mark) - 1)
            hit = mark["name"][where] == own
            places.append(s.at[at[i] : at[i + 1]][hit])
            masks.append(mark["mask"][where[hit]])
    place, mask = np.concatenate(places), np.concatenate(masks)
    for bit in range(STRIDE):
        begins = place[mask >> np.uint32(bit) & np.uint32(1) > 0] - SIDE + bit
        np.add.at(step, begins, 1)
        np.add.at(step, begins + LENGTH, -1)
    edge = np.diff((np.cumsum(step[:-1]) > 0).astype(np.int8), prepend=0, append=0)
    begin, stop = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    of = np.searchsorted(s.start, begin, side="right") - 1
    cutat = np.searchsorted(of, np.arange(len(texts) + 1))
    return [np.stack([begin[a:b], stop[a:b]], axis=1) - s.start[i] for i, (a, b) in enumerate(zip(cutat[:-1], cutat[1:], strict=True))]


def kept(text: bytes, removed: np.ndarray) -> bytes:
    """A text without the removed runs."""
    ends = [0, *removed.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def _judged(docs: DataFrame, each: Callable[[list[bytes], list[np.ndarray]], dict[str, pa.Array]], schema: str, hot: int = HOT, busy: int = BUSY, part: int = PART, asked: int = ASKED) -> DataFrame:
    """doc_id and what `each` makes of texts and their removed runs, for every row of `docs(doc_id, text)`."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("long").alias("_own"), "text")
    known = docs.where(f"_own is not null and octet_length(text) >= {LENGTH}")
    size = known.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(max(-(-size // (15 * part)), spark.sparkContext.defaultParallelism))
    sent = known.mapInArrow(_send(parts, hot), _PACKED).groupBy("part").applyInArrow(_judge(busy, parts), _PACKED)
    told = cut(sent.groupBy("part").applyInArrow(_gather, "doc_id long, found binary, asked binary, single binary").withColumnRenamed("doc_id", "_id"))
    sizes = F.coalesce(F.octet_length("asked"), F.lit(0)) + STRIDE * F.coalesce(F.octet_length("single"), F.lit(0)).cast("long")
    count = (told.agg(F.sum(sizes)).first()[0] or 0) // 8
    # texts are exchanged once: both uses of this join read the same exchange, the second without another for the marks
    met = docs.join(told, F.col("_own") == F.col("_id"), "left")
    back = met.select("_own", "text", "asked", "single").mapInArrow(_ask(int(max(1, -(-count // asked)))), _PACKED)
    marks = back.groupBy("part").applyInArrow(_refine(parts), _PACKED).groupBy("part").applyInArrow(_gather_marks, "doc_id long, marks binary").withColumnRenamed("doc_id", "_m")
    judged = met.join(marks, F.col("_own") == F.col("_m"), "left").select("_own", "text", "found", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            found, marked, done = batch.column(2).to_pylist(), batch.column(3).to_pylist(), 0
            for ids, own in _together(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                some = [i for i in range(len(own)) if found[done + i] or marked[done + i]]
                runs = dict(zip(some, spans([own[i] for i in some], [found[done + i] for i in some], [marked[done + i] for i in some]), strict=True)) if some else {}
                none = np.zeros((0, 2), dtype=np.int64)
                yield pa.record_batch({"doc_id": batch.column(0).slice(done, len(ids))} | each(own, [runs.get(i, none) for i in range(len(own))]))
                done += len(ids)

    return judged.mapInArrow(run, f"doc_id long, {schema}").withColumn("doc_id", F.col("doc_id").cast(kind))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) without its repeated passages, and removed, the (from, to) byte runs of them, of every row.

    What is left of a text need not be UTF-8 where a run ends within a character, so it is binary.
    """

    def each(texts: list[bytes], runs: list[np.ndarray]) -> dict[str, pa.Array]:
        return {"text": pa.array([kept(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary()), "removed": pa.array([r.tolist() for r in runs], pa.list_(pa.list_(pa.int64())))}

    return _judged(docs, each, "text binary, removed array<array<long>>")


def deduplicate(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""

    def each(texts: list[bytes], runs: list[np.ndarray]) -> dict[str, pa.Array]:
        numbers = {"n_bytes": [len(t) for t in texts], "n_removed": [int((r[:, 1] - r[:, 0]).sum()) for r in runs], "n_spans": [len(r) for r in runs]}
        return {k: pa.array(v, pa.int64()) for k, v in numbers.items()} | {"kept_sha256": pa.array([hashlib.sha256(kept(t, r)).hexdigest() for t, r in zip(texts, runs, strict=True)], pa.string())}

    return _judged(docs, each, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", **limits)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), w AS (
  SELECT r, doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT r, doc_id, x, unnest(range(n - 49)) AS p FROM d)
), low AS (
  SELECT s, min(doc_id) AS lo FROM w GROUP BY s
), hit AS (
  SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM w JOIN low ON w.s = low.s WHERE lo < doc_id
), numbered AS (
  SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM hit
), spans AS (
  SELECT r, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY r, k
), pieces AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM spans
), kept AS (
  SELECT d.r, sum(b - a) AS gone, count(*) AS n_spans, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS y
  FROM pieces p JOIN d ON d.r = p.r GROUP BY d.r
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(y, x))) AS kept_sha256
FROM d LEFT JOIN kept k ON k.r = d.r
"""
