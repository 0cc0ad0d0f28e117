"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant documents.

A byte-pair segmentation is the best path of a lattice: its nodes are vocabulary pieces at places of the text, an edge
between neighbours weighs 0 where the pair, encoded by itself, stays the same two pieces, and minus infinity where it
doesn't. A sequence of pieces is the encoding of its text exactly when every neighbouring pair is its own encoding, so
one path weighs 0 and it is the encoding. That makes it scannable:

1. A document of more than `CHUNK` characters is cut into chunks at any character. The state at a cut is the piece that
   covers it or ends at it. Each chunk gives a transfer matrix from the states at its start to those at its end.
2. Neighbouring matrices are multiplied (max over the states between them of sums), up to `FAN` at a time, level by
   level: the product is associative, so any grouping gives the document's matrix. Down the same tree, a node whose end
   states are known tells the states at the cuts between its children; no task sees more than `FAN` matrices.
3. Each chunk, given its two states, is backtraced by itself.

No piece goes on past a space after another character, so there the state is known and the matrix is 1 x 1: only the
text before the first and behind the last such place of a chunk needs the lattice, and a chunk without one needs it
throughout. Between such places the runs are encoded by the library, each distinct one once a task as far as its memory
of `MEMO` runs goes.

Decoding joins the pieces' bytes; it too works on any cut between ids.

Defined results: null text has null ids, an empty one none; U+2581 in a text is the space it stands for, so it decodes
to a space; repeated rows are each encoded; empty tables give no rows; other columns go along unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, shuffle_width

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, FAN, MEMO, LONGEST, ROWS = 1 << 16, 4, 100_000, 256, 500
SPACE = "▁"
_RUN = re.compile(r" *[^ ]+| +")


class Pieces:
    """A model's pieces and what follows from them; made once in each process."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.lead = self.sp.encode("")  # nothing; the call fails early on a model that can't encode
        n = self.sp.vocab_size()
        self.kind = ["byte" if self.sp.is_byte(i) else "none" if self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i) else "piece" for i in range(n)]
        self.text = [self.sp.id_to_piece(i) for i in range(n)]
        self.id_of = {p.replace(SPACE, " "): i for i, p in enumerate(self.text) if self.kind[i] == "piece"}
        self.byte_of = {int(self.text[i][3:5], 16): i for i in range(n) if self.kind[i] == "byte"}
        self.widest = max(map(len, self.id_of))
        self.raw = [bytes([int(self.text[i][3:5], 16)]) if k == "byte" else self.text[i].replace(SPACE, " ").encode() if k == "piece" else b"" for i, k in enumerate(self.kind)]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}
        # behind this no piece can start with a space, so what follows it is encoded without the library's own first space
        self.fence, self.fenced = "\n", len(self.sp.encode("\n"))

    def plain(self, text: str) -> list[int]:
        """Ids of a text without the space that the library puts first."""
        ids = self.sp.encode(self.fence + text)
        return ids[self.fenced :]

    def one(self, text: str) -> list[int]:
        """Ids of one lattice node: a piece, or the bytes of a character that is none."""
        i = self.id_of.get(text)
        return [i] if i is not None else [self.byte_of[b] for b in text.encode("utf-8", "replace")] if self.byte_of else [self.sp.unk_id()]

    def fits(self, a: str, b: str) -> bool:
        """Whether two neighbouring nodes are the encoding of their joined text."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.plain(a + b) == self.one(a) + self.one(b)
        return got

    def nodes_at(self, text: str, i: int) -> list[int]:
        """Ends of the nodes that start at i."""
        ends = [j for j in range(i + 1, min(len(text), i + self.widest) + 1) if text[i:j] in self.id_of]
        return ends if ends and ends[0] == i + 1 else [i + 1, *ends]

    def run(self, text: str) -> bytes:
        """Packed ids of a run of spaces and then other characters, by the library."""
        got = self.memo.get(text)
        if got is None:
            got = np.array(self.plain(text), dtype="<i4").tobytes()
            if len(text) <= LONGEST:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[text] = got
        return got

    def runs(self, text: str) -> bytes:
        return b"".join(map(self.run, _RUN.findall(text)))


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def surface(text: str) -> str:
    """The text that is segmented: with the first space that the model adds, and one sign for a space."""
    return " " + text.replace(SPACE, " ") if text else ""


def packed(p: Pieces, text: str) -> bytes:
    return p.runs(surface(text))


def decode(p: Pieces, ids: list[int]) -> str:
    out = b"".join([p.raw[i] for i in ids])
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


# the lattice of a chunk


def clean_cuts(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last place in (lo, hi] before a space that follows another character; None without one."""
    found = [m.start() + 1 for m in re.finditer(r"[^ ](?= )", text[lo - 1 : hi + 1])] if lo else [m.start() + 1 for m in re.finditer(r"[^ ](?= )", text[: hi + 1])]
    at = [x + (lo - 1 if lo else 0) for x in found]
    at = [x for x in at if lo < x <= hi]
    return (at[0], at[-1]) if at else None


State = tuple[int, int]


def states(p: Pieces, text: str, at: int) -> list[State]:
    """Nodes (start, end) that cover place `at` or end there."""
    return [(s, e) for s in range(max(0, at - p.widest), at) for e in p.nodes_at(text, s) if e >= at]


def spread(p: Pieces, text: str, entries: list[State | None], start: int, stop: int) -> dict[State, int]:
    """Nodes that end at or behind `stop` and start before it, with a bit for each entry that reaches them at weight 0.

    An entry is a node, or None for a path that begins at `start` itself.
    """
    reach: dict[int, dict[int, int]] = {}  # end: start: entries
    out: dict[State, int] = {}

    def put(s: int, e: int, bits: int) -> None:
        if e >= stop:
            out[s, e] = out.get((s, e), 0) | bits
        else:
            here = reach.setdefault(e, {})
            here[s] = here.get(s, 0) | bits

    for k, entry in enumerate(entries):
        if entry is None:
            for e in p.nodes_at(text, start):
                put(start, e, 1 << k)
        else:
            put(*entry, 1 << k)
    at = min(reach, default=stop)
    while at < stop:
        for e in p.nodes_at(text, at) if at in reach else ():
            piece = text[at:e]
            bits = 0
            for s, b in reach[at].items():
                if p.fits(text[s:at], piece):
                    bits |= b
            if bits:
                put(at, e, bits)
        at += 1
    return out


def trace(p: Pieces, text: str, entry: State | None, start: int, leave: State | None, stop: int) -> list[int]:
    """Ids of the path from an entry (not counted) to and with `leave`, or to the node that ends at `stop`."""
    back: dict[int, dict[int, int]] = {}  # end: start: start of the node before, or -1
    if entry is None:
        for e in p.nodes_at(text, start):
            back.setdefault(e, {})[start] = -1
        at = start + 1
    else:
        at = entry[1]
        back[at] = {entry[0]: -2}
    last = leave[1] if leave else stop
    while at < last:
        if at in back:
            for e in p.nodes_at(text, at):
                if e > last:
                    continue
                for s in back[at]:
                    if p.fits(text[s:at], text[at:e]):
                        back.setdefault(e, {}).setdefault(at, s)
                        break
        at += 1
    s, e = (leave if leave else (next(iter(back[stop])), stop))
    out: list[list[int]] = []
    while True:
        before = back[e][s]
        if before == -2:
            break
        out.append(p.one(text[s:e]))
        if before == -1:
            break
        s, e = before, s
    return [i for ids in reversed(out) for i in ids]


def matrix(p: Pieces, text: str, lo: int, hi: int, first: bool, last: bool) -> tuple[list[State | None], list[State | None], list[int]]:
    """Entry states, exit states and, for each exit, the bits of the entries that reach it. Places are those of `text`.

    The first chunk's entry and the last one's exit are None, the known state.
    """
    entries: list[State | None] = [None] if first else states(p, text, lo)
    exits: list[State | None] = [None] if last else states(p, text, hi)
    ends = clean_cuts(text, lo, hi)
    if ends is None and not last:
        got = spread(p, text, entries, lo, hi)
        return entries, exits, [got.get(x, 0) for x in exits]
    stop = ends[0] if ends else hi
    into = sum_bits(spread(p, text, entries, lo, stop), stop)
    if last:
        return entries, exits, [into]
    got = spread(p, text, [None], ends[1], hi) if ends[1] < hi else {s: 1 for s in exits if s[1] == hi and s in set(_ending(p, text, ends, hi))}
    return entries, exits, [into if got.get(x) else 0 for x in exits]


def sum_bits(reached: dict[State, int], stop: int) -> int:
    bits = 0
    for (_, e), b in reached.items():
        if e == stop:
            bits |= b
    return bits


def _ending(p: Pieces, text: str, ends: tuple[int, int], hi: int) -> list[State]:
    """The node that ends at a known place `hi`: the last one of the run before it."""
    start = text.rfind(" ", 0, hi)
    while start > 0 and text[start - 1] == " ":
        start -= 1
    start = max(start, 0, hi - 4 * p.widest) if start >= 0 else max(0, hi - 4 * p.widest)
    return [s for s in spread(p, text, [None], start, hi) if s[1] == hi] if start < hi else []


def backtrace(p: Pieces, text: str, lo: int, hi: int, entry: State | None, leave: State | None) -> bytes:
    """Packed ids of the nodes that start in the chunk, given the states at its ends."""
    pack = lambda ids: np.array(ids, dtype="<i4").tobytes()
    at = entry[1] if entry else lo
    to = leave[1] if leave else hi
    if at >= to and entry:
        return b""
    ends = clean_cuts(text, at - 1 if entry and at else lo, leave[0] if leave else hi)
    if ends is None or ends[0] < at:
        ends = None if ends is None or ends[1] < at else (next((x for x in range(at, ends[1] + 1) if x and text[x - 1] != " " and text[x : x + 1] == " "), ends[1]), ends[1])
    if ends is None:
        return pack(trace(p, text, entry, lo, leave, to))
    head = b"" if ends[0] <= at else pack(trace(p, text, entry, lo, None, ends[0])) if entry else p.runs(text[lo : ends[0]])
    middle = p.runs(text[ends[0] : ends[1]])
    tail = p.runs(text[ends[1] : hi]) if not leave else pack(trace(p, text, None, ends[1], leave, to)) if to > ends[1] else b""
    return head + middle + tail


Matrix = tuple[list[State | None], list[State | None], list[int]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: weights are 0 or minus infinity, so an exit's best weight is 0 for the entries that reach it by some state between."""
    reach = dict(zip(a[1], a[2], strict=True))
    through = [reach.get(s, 0) for s in b[0]]
    out = []
    for bits in b[2]:
        own = 0
        while bits:
            low = bits & -bits
            own |= through[low.bit_length() - 1]
            bits ^= low
        out.append(own)
    return a[0], b[1], out


def combine(rows: list[Matrix], entry: State | None = None, leave: State | None = None) -> list:
    """The states at the start, at each cut and at the end of neighbouring chunks or nodes, from their matrices and the two outer states.

    Prefixes say which states the entry reaches, suffixes which reach the end; one state is in both.
    """
    forward = [{entry}]
    for entries, exits, bits in rows:
        live = sum(1 << k for k, s in enumerate(entries) if s in forward[-1])
        forward.append({x for x, b in zip(exits, bits, strict=True) if b & live})
    out = [entry, *[None] * (len(rows) - 1), leave]
    wanted = {leave}
    for k in range(len(rows) - 1, 0, -1):
        entries, exits, bits = rows[k]
        reach = 0
        for x, b in zip(exits, bits, strict=True):
            if x in wanted:
                reach |= b
        wanted = {s for i, s in enumerate(entries) if reach >> i & 1 and s in forward[k]}
        if len(wanted) != 1:
            raise ValueError(f"{len(wanted)} states at a cut")
        out[k] = next(iter(wanted))
    return out


# Spark


def _windows(path: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = 2 * pieces(path).widest
        for batch in batches:
            for g, text in zip(batch.column("g").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole = surface(text)
                for k, lo in enumerate(range(0, len(whole), chunk)):
                    hi = min(lo + chunk, len(whole))
                    a, b = max(0, lo - 2 * side), min(len(whole), hi + side)
                    yield pa.record_batch({"g": [g], "k": pa.array([k], pa.int32()), "lo": pa.array([lo - a], pa.int32()), "hi": pa.array([hi - a], pa.int32()), "first": [lo == 0], "last": [hi == len(whole)], "base": pa.array([a], pa.int64()), "text": [whole[a:b]]})

    return run


_STATE = pa.list_(pa.int64())


def _pair(state: State | None, base: int) -> list[int]:
    return [-1, -1] if state is None else [state[0] + base, state[1] + base]


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for r in batch.to_pylist():
                entries, exits, bits = matrix(p, r["text"], r["lo"], r["hi"], r["first"], r["last"])
                flat = lambda own: [x for s in own for x in _pair(s, r["base"])]  # noqa: B023, E731
                yield pa.record_batch({"g": [r["g"]], "k": pa.array([r["k"]], pa.int32()), "entries": pa.array([flat(entries)], _STATE), "exits": pa.array([flat(exits)], _STATE), "bits": pa.array([[hex(b) for b in bits]], pa.list_(pa.string()))})

    return run


_MATRIX = "g string, k int, entries array<long>, exits array<long>, bits array<string>"


def _read(rows: list[dict]) -> list[Matrix]:
    states_of = lambda flat: [None if a < 0 else (a, b) for a, b in zip(flat[::2], flat[1::2], strict=True)]
    return [(states_of(r["entries"]), states_of(r["exits"]), [int(b, 16) for b in r["bits"]]) for r in rows]


def _multiplied(table: pa.Table) -> pa.Table:
    """One node of the level above from its children's matrices."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    entries, exits, bits = reduce(product, _read(rows))
    flat = lambda own: [x for s in own for x in _pair(s, 0)]
    return pa.table({"g": [rows[0]["g"]], "k": pa.array([rows[0]["k"] // FAN], pa.int32()), "entries": pa.array([flat(entries)], _STATE), "exits": pa.array([flat(exits)], _STATE), "bits": pa.array([[hex(b) for b in bits]], pa.list_(pa.string()))})


def _opened(table: pa.Table) -> pa.Table:
    """The end states of a node's children from its own."""
    rows = sorted(table.to_pylist(), key=lambda r: r["k"])
    outer = [None if s[0] < 0 else tuple(s) for s in (rows[0]["entry"], rows[0]["leave"])]
    at = combine(_read(rows), *outer)
    return pa.table({"g": [r["g"] for r in rows], "k": pa.array([r["k"] for r in rows], pa.int32()), "entry": pa.array([_pair(s, 0) for s in at[:-1]], _STATE), "leave": pa.array([_pair(s, 0) for s in at[1:]], _STATE)})


def _known(matrices: DataFrame) -> DataFrame:
    """(g, k, entry, leave) of every chunk: products up a tree over neighbouring chunks, states down again."""
    levels, last = [matrices], matrices.agg(F.max("k")).first()[0]
    above = lambda k: F.floor(k / FAN).cast("int")
    while last:
        levels.append(cut(levels[-1].groupBy("g", above(F.col("k")).alias("up")).applyInArrow(_multiplied, _MATRIX)))
        last //= FAN
    outside = F.array(F.lit(-1).cast("long"), F.lit(-1).cast("long"))
    known = levels[-1].select("g", "k", outside.alias("entry"), outside.alias("leave"))
    for level in reversed(levels[:-1]):
        node = known.select(F.col("g").alias("of"), F.col("k").alias("up"), "entry", "leave")
        met = level.join(node, (F.col("g") == F.col("of")) & (above(F.col("k")) == F.col("up"))).drop("of")
        known = met.groupBy("g", "up").applyInArrow(_opened, "g string, k int, entry array<long>, leave array<long>")
    return known


def _backtraced(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for batch in batches:
            for r in batch.to_pylist():
                local = lambda s: None if s[0] < 0 else (s[0] - r["base"], s[1] - r["base"])  # noqa: B023, E731
                ids = np.frombuffer(backtrace(p, r["text"], r["lo"], r["hi"], local(r["entry"]), local(r["leave"])), dtype="<i4")
                yield pa.record_batch({"g": [r["g"]], "k": pa.array([r["k"]], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return run


def scanned(giants: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(g, ids) of distinct documents `giants(g, text)`, by the scan."""
    width = shuffle_width(giants.sparkSession)
    chunks = cut(giants.mapInArrow(_windows(path, chunk), "g string, k int, lo int, hi int, first boolean, last boolean, base long, text string").repartition(width, "g", "k"))
    at = _known(cut(chunks.mapInArrow(_matrices(path), _MATRIX)))
    ids = chunks.join(at, ["g", "k"]).mapInArrow(_backtraced(path), "g string, k int, ids array<int>")
    return ids.groupBy("g").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def _listed(values: list[bytes | None]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(v or b"") // 4 for v in values)], dtype=np.int32)
    flat = pa.array(np.frombuffer(b"".join(v for v in values if v), dtype="<i4"))
    mask = pa.array([v is None for v in values])
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=mask)


def _encoder(path: str):
    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = pieces(path)
        for batch in batches:
            parts = [_listed([None if t is None else packed(p, t) for t in batch.slice(s, ROWS).to_pylist()]) for s in range(0, len(batch), ROWS)]
            yield pa.concat_arrays([*parts, pa.array([], pa.list_(pa.int32()))])

    return encoded


def decoder(path: str = MODEL):
    """A column function from ids to text."""

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = pieces(path)
        for batch in batches:
            flat, ends, ok = batch.values.to_numpy(), batch.offsets.to_numpy(), batch.is_valid().to_pylist()
            parts = [pa.array([decode(p, flat[ends[i] : ends[i + 1]].tolist()) if ok[i] else None for i in range(s, min(s + ROWS, len(batch)))], pa.string()) for s in range(0, len(batch), ROWS)]
            yield pa.concat_arrays([*parts, pa.array([], pa.string())])

    return decoded


def _checker(path: str):
    """Ids and whether they decode to the text again, in one pass over each text."""

    @F.arrow_udf("ids array<int>, intact boolean")
    def checked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = pieces(path)
        for batch in batches:
            parts, intact = [pa.array([], pa.list_(pa.int32()))], []
            for s in range(0, len(batch), ROWS):
                texts = batch.slice(s, ROWS).to_pylist()
                ids = [None if t is None else packed(p, t) for t in texts]
                intact += [None if t is None else decode(p, np.frombuffer(b, dtype="<i4").tolist()) == t.replace(SPACE, " ") for t, b in zip(texts, ids, strict=True)]
                parts.append(_listed(ids))
            yield pa.StructArray.from_arrays([pa.concat_arrays(parts), pa.array(intact, pa.bool_())], names=["ids", "intact"])
            pa.default_memory_pool().release_unused()

    return checked


def _giants(rows: DataFrame, path: str, chunk: int) -> DataFrame:
    """(row, ids) of giant texts in `rows(row)`, structs with a text; each distinct text is scanned once."""
    giant = rows.where(F.length("row.text") >= chunk).select("row", F.sha2(F.encode("row.text", "UTF-8"), 256).alias("at"))
    distinct = giant.groupBy(F.col("at").alias("g")).agg(F.first("row.text").alias("text"))
    return giant.join(scanned(distinct, path, chunk), F.col("at") == F.col("g")).select("row", "ids")


def encode(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """All rows and columns of `docs(text)` and `ids`, in place of a column of that name; giant texts by the scan."""
    rows = docs.drop("ids").select(F.struct("*").alias("row"))
    small = rows.where(F.col("row.text").isNull() | (F.length("row.text") < chunk)).select("row", _encoder(path)(F.col("row.text")).alias("ids"))
    return small.unionByName(_giants(rows, path, chunk)).select("row.*", "ids")


def round_trip(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, ids and intact (decoding gives the text again, U+2581 as a space) of every row."""
    docs = docs.select("doc_id", "text")
    small = docs.where(F.col("text").isNull() | (F.length("text") < chunk)).select("doc_id", _checker(path)(F.col("text")).alias("c")).select("doc_id", "c.ids", "c.intact")
    large = _giants(docs.select(F.struct("*").alias("row")), path, chunk).select("row.doc_id", "ids", (decoder(path)(F.col("ids")) == F.translate("row.text", SPACE, " ")).alias("intact"))
    return small.unionByName(large).select("doc_id", F.size("ids").alias("n_tokens"), "ids", "intact")
