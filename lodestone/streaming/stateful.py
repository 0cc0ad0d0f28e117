"""Streams whose state outlives a batch: frames out of bytes, stage-ups, the last ids, caches.

SRC-29, STR-06/08/10, DML-09. State lies in the RocksDB store of the query's checkpoint, so a restarted query goes on
where it was. Rows of a batch are taken in the order of their `seq` (or `ts`, `event_id`) within their key; a key's state is bounded: half
a line, one number, `LAST_IDS` ids, `MOST_ENTRIES` entries.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import pricing
from lodestone.operators import usage

#: Ids that are remembered; entries of a cache, and how long one without a time of its own counts.
LAST_IDS, MOST_ENTRIES, DAY_MS = 2000, 500, 86_400_000
_NO_ID = -(1 << 63)
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(rows: DataFrame, keys: tuple[str, ...], processor: StatefulProcessor, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")


class _InOrder(StatefulProcessor):
    """A processor of one state that folds a key's rows of a batch in the order of `by`."""

    by: tuple[str, ...] = ("seq",)
    columns: tuple[str, ...] = ()

    def load(self):
        raise NotImplementedError

    def fold(self, key: tuple, rows: list[dict], state) -> tuple[list[tuple], object]:
        raise NotImplementedError

    def save(self, state) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = [r for part in rows for r in part.astype(object).where(part.notna(), None).to_dict("records")]
        every.sort(key=lambda r: tuple(r[c] for c in self.by))
        out, state = self.fold(tuple(key), every, self.load())
        self.save(state)
        yield pd.DataFrame(out, columns=list(self.columns))

    def close(self) -> None:
        pass


# frames out of bytes

FRAME = "response_id long, seq long, dialect string, frame string"


def cut_lines(carry: bytes, data: bytes, last: bool) -> tuple[list[bytes], bytes]:
    """Whole lines of what was left over and new bytes, and what is left over now: half a line, perhaps half a sign."""
    *lines, rest = (carry + data).split(b"\n")
    if last and rest:
        lines, rest = [*lines, rest], b""
    return lines, rest


def frame_of(line: bytes, dialect: str) -> str | None:
    """SRC-29: a line's frame: any line that isn't blank, or in event streams what follows `data:`, but for the end's mark."""
    text = line.decode("utf-8", "replace").strip()
    if dialect != "lines":
        if not text.startswith("data:"):
            return None
        text = text[5:].strip()
    return text if text and text != "[DONE]" else None


def _framed(key: int, rows: list[dict], carry: bytes, n: int) -> tuple[list[tuple], bytes, int]:
    out = []
    for r in rows:
        lines, carry = cut_lines(carry, bytes(r["data"] or b""), bool(r["last"]))
        for line in lines:
            frame = frame_of(line, r["dialect"])
            if frame is not None:
                out.append((key, n, r["dialect"], frame))
                n += 1
    return out, carry, n


class _Frames(_InOrder):
    columns = ("response_id", "seq", "dialect", "frame")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("carry", "carry binary, n long")

    def load(self):
        return self.state.get() if self.state.exists() else (b"", 0)

    def fold(self, key, rows, state):
        out, carry, n = _framed(key[0], rows, bytes(state[0]), state[1])
        return out, (carry, n)

    def save(self, state) -> None:
        self.state.update(state)


def frames_stream(chunks: DataFrame) -> DataFrame:
    """SRC-29: frames of a stream of chunks (response_id, seq, dialect, data, last), wherever the chunks are cut."""
    return _with_state(chunks, ("response_id",), _Frames(), FRAME)


def frames_batch(chunks: DataFrame) -> DataFrame:
    """The same of finished replies: a fold of each reply's own chunks."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        return pd.DataFrame(_framed(int(rows.response_id.iloc[0]), rows.to_dict("records"), b"", 0)[0], columns=list(_Frames.columns))

    return chunks.groupBy("response_id").applyInPandas(fold, FRAME)


# stage-ups


class _StageUps(_InOrder):
    by = ("ts", "event_id")
    columns = ("provider", "event_id", "from_stage", "to_stage", "xp")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("xp", "xp long")

    def load(self) -> int:
        return self.state.get()[0] if self.state.exists() else 0

    def handleInputRows(self, key, rows, timerValues):
        """A provider's rows of a batch as three arrays of numbers: there are few providers, so a key has very many rows."""
        got = [(p["ts"].to_numpy("datetime64[us]").astype("i8"), p["event_id"].astype("Int64").to_numpy("i8", na_value=_NO_ID), p["total"].to_numpy("i8")) for p in rows]
        ts, event, total = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.lexsort((event, ts))
        xp = self.load()
        upto = total[order]
        np.cumsum(upto, out=upto)
        upto += xp
        names = [name for _, name in pricing.XP_STAGES]
        stage = np.searchsorted([least for least, _ in pricing.XP_STAGES], np.concatenate([[xp], upto]), side="right").astype(np.int8) - 1
        up = np.flatnonzero((stage[1:] > stage[:-1]) & (stage[1:] != names.index("hatchling")))
        self.save(int(upto[-1]) if len(upto) else xp)
        yield pd.DataFrame([(key[0], int(event[order[i]]) if event[order[i]] != _NO_ID else None, names[stage[i]], names[stage[i + 1]], int(upto[i])) for i in up], columns=list(self.columns))

    def save(self, xp) -> None:
        self.state.update((xp,))


def stage_ups_stream(events: DataFrame) -> DataFrame:
    """STR-08: a row where a provider's running total enters a later stage, once, whatever batch or restart it falls in."""
    e = usage.cleaned(events).select("provider", "ts", "event_id", "total")
    return _with_state(e, ("provider",), _StageUps(), "provider string, event_id long, from_stage string, to_stage string, xp long")


# the last ids


def recent_fold(rows: list[dict], last: list[str], most: int) -> tuple[list[dict], list[str]]:
    """Rows whose ids aren't among the `most` accepted last, and those ids; blank ids are accepted and not remembered."""
    ring, known, out = deque(last), set(last), []
    for r in rows:
        i = r["id"]
        if i is None or not str(i).strip():
            out.append(r)
            continue
        if i in known:
            continue
        out.append(r)
        ring.append(i)
        known.add(i)
        if len(ring) > most:
            known.discard(ring.popleft())
    return out, list(ring)


class _Recent(_InOrder):
    by = ("ts", "event_id")
    columns = ("store", "id", "event_id")

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getListState("ids", "id string")

    def load(self) -> list[str]:
        return [r[0] for r in self.state.get()] if self.state.exists() else []

    def fold(self, key, rows, last):
        out, ring = recent_fold(rows, last, self.most)
        return [(key[0], r["id"], r["event_id"]) for r in out], ring

    def save(self, ring) -> None:
        self.state.put([(i,) for i in ring])


def recent_stream(rows: DataFrame, most: int = LAST_IDS) -> DataFrame:
    """STR-06: (store, id, event_id) of rows (store, id, ts, event_id) whose id isn't among the store's last `most` ids."""
    return _with_state(rows, ("store",), _Recent(most), "store long, id string, event_id long")


# caches

ANSWER = "cache long, seq long, op string, hit boolean, value string, size int"


def cache_key(kind: str, key: str | None) -> str:
    """Searches are looked up in lower case; what is kept for an address is one entry, whatever its kind."""
    key = key or ""
    return (key.lower() if kind == "search" else key).strip()


def cache_fold(rows: list[dict], entries: dict[str, tuple], most: int = MOST_ENTRIES) -> tuple[list[tuple], dict[str, tuple]]:
    """(seq, op, hit, value, entries left) of each command, and the entries (kind, value, at, ttl) after them, oldest write first.

    `put` writes and moves to the front; `get` finds an entry of its kind that is no older than the command's `ttl`, else
    the entry's own, else a day, drops it if it is older, and moves nothing; `invalidate` and `clear` remove.
    """
    out = []
    for r in rows:
        op, key, hit, value = r["op"], cache_key(r["kind"], r["key"]), None, None
        if op == "put":
            entries.pop(key, None)
            entries[key] = (r["kind"], r["value"], int(r["at"]), None if r["ttl"] is None else int(r["ttl"]))
            while len(entries) > most:
                entries.pop(next(iter(entries)))
        elif op == "get":
            found, hit = entries.get(key), False
            if found and found[0] == r["kind"]:
                ttl = next(int(t) for t in (r["ttl"], found[3], DAY_MS) if t is not None)
                hit = int(r["at"]) - found[2] <= ttl
                value = found[1] if hit else None
                if not hit:
                    del entries[key]
        elif op == "invalidate":
            entries.pop(key, None)
        elif op == "clear":
            entries.clear()
        out.append((r["seq"], op, hit, value, len(entries)))
    return out, entries


class _Cache(_InOrder):
    columns = ("cache", "seq", "op", "hit", "value", "size")

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("entries", "key string", "kind string, value string, at long, ttl long, written long")

    def load(self) -> dict[str, tuple]:
        found = sorted(self.state.iterator(), key=lambda e: e[1][4]) if self.state.exists() else []
        self.before = {k[0]: tuple(v) for k, v in found}
        return {k: v[:4] for k, v in self.before.items()}

    def fold(self, key, rows, entries):
        out, entries = cache_fold(rows, entries, self.most)
        return [(key[0], *o) for o in out], entries

    def save(self, entries) -> None:
        for key in self.before.keys() - entries.keys():
            self.state.removeKey((key,))
        for n, (key, entry) in enumerate(entries.items()):
            if self.before.get(key) != (*entry, n):
                self.state.updateValue((key,), (*entry, n))


def cache_stream(commands: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """STR-10, DML-09, SRC-07: answers to commands (cache, seq, op, kind, key, value, at, ttl) put to caches that live in the stream's state."""
    return _with_state(commands, ("cache",), _Cache(most), ANSWER)


def replay(rows: DataFrame, through: Callable[[DataFrame], DataFrame], batches: int = 1, by: str = "seq") -> DataFrame:
    """Rows written to the shared folder in `batches` files by ranges of `by`, read as a stream one file a batch, and what comes out."""
    from lodestone.streaming.ledger import settle, shared_folder

    spark: SparkSession = rows.sparkSession
    folder = shared_folder(spark)
    if batches > 1:
        cuts = rows.stat.approxQuantile(by, [i / batches for i in range(1, batches)], 0.01)
        part = F.lit(0)
        for c in cuts:
            part = part + (F.col(by) > c).cast("int")
        for k in range(batches):  # in turn, so that files are read in this order
            rows.where(part == k).coalesce(1).write.mode("append").parquet(folder)
    else:
        rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 if batches > 1 else 1000).parquet(folder)
    return settle(through(stream), "append")
