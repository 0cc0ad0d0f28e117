"""A lexical index that is kept: postings in blocks with their best terms, delta folders, dirty collections, pruned searches.

STR-14 with TOP-02, JN-12, SCA-54. Postings lie in folders by collection and by a hash of the term, sorted by term; a row is
what a block of documents holds of the term, with the highest frequency and the least length among them. A block is up to
`BLOCK` documents of a collection that one task read one after the other, so its rows are made where the texts are read:
neither texts nor single postings cross a shuffle, but rows once on their way to folders. Ids and lengths stand once a block, in a row
without term in a folder of their own (`DOCS`); postings name their places there (`slots`). Blocks of all terms are cut alike, so bounds
of a query's terms add up by block. A search reads the bounds of the query's terms only, scores the blocks of the highest
bounds, and then those whose bound reaches the k-th best score; other blocks are never opened beyond their bounds. What a
search ranks equals `retrieval.lexical_topk` over the live chunks.

Inserting appends a folder and sums statistics; no text and no posting is read again. Deleting notes the ids and marks their collections
dirty; the next search rewrites those from their own postings: blocks stay as they were cut, documents that are gone leave a
null length in their place. All changes are versions of `VersionedTables`, so a crash leaves the one before.

Defined results: ids and collections may not be null; null content is a document without terms, which counts; inserting an
id that is there adds another document; a query without terms, or of unknown ones, finds nothing. Chunks that are inserted must come in the
same order when a task runs again, as rows of files do.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import tokens
from lodestone.operators import retrieval
from lodestone.operators.retrieval import EPSILON, K1, B
from lodestone.sources.versioned import Part, Version, VersionedTables, dropped

#: Folders by term, documents of a block.
TERM_PARTS, BLOCK = 8, 256
#: A block ends early once its documents have so many words; so many may wait in a task for their blocks to fill.
WORDS, WAITING = 1 << 20, 1 << 22
#: The folder of the rows that list the documents of blocks.
DOCS = -1
_BY = ("collection", "part")


def _term_part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    """What a term's frequency in a document of a length adds, times its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _row_type(id_type: T.DataType) -> T.StructType:
    """A block's row: of a term its `slots` and `tfs`, without term the documents' `ids` and `lens` by slot."""
    whole, few = T.ArrayType(T.IntegerType()), T.ArrayType(T.ShortType())
    kinds = {"collection": T.StringType(), "term": T.StringType(), "block": T.LongType(), "max_tf": T.IntegerType(), "min_len": T.IntegerType(), "slots": few, "tfs": whole, "ids": T.ArrayType(id_type), "lens": whole}
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _packer(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (collection, id, t) as rows of blocks. A block's number is its task's, with its place among the task's blocks."""

    def filled(docs: pa.Table) -> int:
        """How many documents the first block takes; 0 if it isn't full."""
        words = np.cumsum(pc.list_value_length(docs["t"]).to_numpy())
        n = min(block, int(np.searchsorted(words, WORDS)) + 1)
        return n if n <= len(words) else 0

    def rows(name: str, docs: pa.Table, number: int) -> Iterator[pa.RecordBatch]:
        lists, n = docs["t"].combine_chunks(), docs.num_rows
        lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int32)
        words = lists.flatten().dictionary_encode()
        # a term's code and a document's slot as one number: equal ones are the frequency
        pairs, tfs = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lens), return_counts=True)
        terms, slots = np.divmod(pairs, n)
        starts = np.searchsorted(terms, np.arange(len(words.dictionary)))

        def batch(size: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = {"collection": pa.string(), "term": pa.string(), "block": pa.int64(), "max_tf": pa.int32(), "min_len": pa.int32(), "slots": pa.list_(pa.int16()), "tfs": pa.list_(pa.int32()), "ids": pa.list_(docs["id"].type), "lens": pa.list_(pa.int32())}
            columns |= {"collection": pa.repeat(pa.scalar(name, pa.string()), size), "block": pa.repeat(pa.scalar(number, pa.int64()), size)}
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kind) for c, kind in kinds.items()], list(kinds))

        one = pa.array([0, n], pa.int32())
        yield batch(1, ids=pa.ListArray.from_arrays(one, docs["id"].combine_chunks()), lens=pa.ListArray.from_arrays(one, pa.array(lens)))
        if len(pairs):
            each = pa.array(np.append(starts, len(pairs)), pa.int32())
            best, least = np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lens[slots], starts)
            yield batch(
                len(starts), term=words.dictionary, max_tf=pa.array(best, pa.int32()), min_len=pa.array(least, pa.int32()),
                slots=pa.ListArray.from_arrays(each, pa.array(slots, pa.int16())), tfs=pa.ListArray.from_arrays(each, pa.array(tfs, pa.int32())),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting = TaskContext.get().partitionId() << 24, {}
        for batch in batches:
            names = np.array(batch.column("collection").to_pylist(), dtype=object)
            for name in dict.fromkeys(names):
                docs = pa.Table.from_batches([batch]).filter(pa.array(names == name))
                docs = pa.concat_tables([waiting[name], docs]) if name in waiting else docs
                while n := filled(docs):
                    yield from rows(name, docs.slice(0, n), number)
                    docs, number = docs.slice(n), number + 1
                waiting[name] = docs
            if sum(pc.sum(pc.list_value_length(docs["t"])).as_py() or 0 for docs in waiting.values()) > WAITING:
                for name, docs in waiting.items():
                    if docs.num_rows:
                        yield from rows(name, docs, number)
                        number += 1
                waiting = {}
        for name, docs in waiting.items():
            if docs.num_rows:
                yield from rows(name, docs, number)
                number += 1

    return run


class KeptIndex:
    def __init__(self, spark: SparkSession, root: str, parts: int = TERM_PARTS, block: int = BLOCK):
        if not 0 < block <= 1 << 15:
            raise ValueError("a block has 1 to 32768 documents")
        self.spark, self.tables, self.parts, self.block = spark, VersionedTables(spark, root), parts, block
        self.tables.recover()

    # what a folder holds

    def _statistics(self, lengths: DataFrame, terms: DataFrame) -> DataFrame:
        """(collection, n_docs, avg_len, mean): what scores need of a collection beside its query's terms."""
        docs = lengths.groupBy("collection").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        by_df = terms.groupBy("collection", "term").agg(F.sum("df").alias("df")).groupBy("collection", "df").agg(F.count("*").alias("terms"))
        raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = by_df.join(docs, "collection").groupBy("collection").agg((F.sum(raw * F.col("terms")) / F.sum("terms")).alias("mean"))
        return docs.join(mean, "collection", "left").select("collection", "n_docs", (F.col("n_tokens") / F.col("n_docs")).alias("avg_len"), "mean").coalesce(1)

    def _change(self, rows: DataFrame, base: Version, tables: dict[str, list[Part]], meta: dict) -> None:
        """One version more: these rows of blocks beside `tables`, their terms and lengths, and the statistics of all."""
        stage, tables = self.tables.stage, {t: list(ps) for t, ps in tables.items() if t != "statistics"}
        add = lambda name, part: tables.setdefault(name, []).append(part)
        rows = rows.withColumn("part", F.when(F.col("term").isNull(), DOCS).otherwise(_term_part(F.col("term"), self.parts)))
        # a folder's rows come to as many tasks as their bytes need, each of them sorted in memory
        add("postings", stage(rows.hint("rebalance", *_BY).sortWithinPartitions(*_BY, "term", "block"), _BY))
        new = self.tables.folder(tables["postings"][-1])
        live = F.filter("lens", lambda n: n.isNotNull())
        docs = new.where(F.col("part") == DOCS).select("collection", F.size(live).alias("n"), F.aggregate(live, F.lit(0).cast("long"), lambda s, n: s + n).alias("words"))
        add("lengths", stage(docs.groupBy("collection").agg(F.sum("n").alias("n_docs"), F.sum("words").alias("n_tokens")).coalesce(1), ("collection",)))
        terms = new.where(F.col("part") != DOCS).groupBy("collection", "part", "term").agg(F.sum(F.size("slots")).alias("df"))
        add("terms", stage(terms.repartition(F.col("collection"), F.col("part")).sortWithinPartitions("collection", "part", "term"), _BY))
        whole = Version(base.number, tables)
        add("statistics", stage(self._statistics(self.tables.read("lengths", whole), self.tables.read("terms", whole))))
        self.tables.commit({}, tables, meta, base=base)

    def _folders(self, version: Version) -> DataFrame:
        """All rows of blocks, with their `folder`."""
        rows = None
        for part in version.tables["postings"]:
            own = self.tables.read("postings", Version(tables={"postings": [part]})).withColumn("folder", F.lit(part.folder))
            rows = own if rows is None else rows.unionByName(own)
        return rows

    # changes

    def insert(self, chunks: DataFrame) -> None:
        """Chunks (collection, id, content) that weren't there; documents without terms count in the statistics."""
        version = self.tables.current()
        words = chunks.where("collection is not null").select("collection", "id", tokens(F.col("content")).alias("t"))
        self._change(words.mapInArrow(_packer(self.block), _row_type(chunks.schema["id"].dataType)), version, version.tables, version.meta)

    def delete(self, ids: DataFrame) -> None:
        """(collection, id) that go: noted, and their collections marked; the next search takes them out."""
        version = self.tables.current()
        gone = ids.select("collection", "id").distinct()
        dirty = [r[0] for r in gone.select("collection").distinct().collect()]
        self.tables.commit({"gone": gone}, meta=version.meta | {"dirty": sorted({*version.meta.get("dirty", []), *dirty})}, base=version)

    def freshen(self) -> list[str]:
        """Rewrite dirty collections from their postings, without what is gone; the others' folders stay. The names of those rewritten."""
        version = self.tables.current()
        dirty = version.meta.get("dirty", [])
        if not dirty or "postings" not in version.tables:
            return []
        mine = F.col("collection").isin(dirty)
        rows, gone = self._folders(version).where(mine), self.tables.read("gone", version).where(mine)
        # the folders become one: numbers of a folder's blocks go on behind those of the folders before it
        most, after, shift = dict(rows.where(F.col("part") == DOCS).groupBy("folder").agg(F.max("block")).collect()), 0, F.lit(0).cast("long")
        for folder, last in sorted(most.items()):
            shift, after = F.when(F.col("folder") == folder, F.lit(after).cast("long")).otherwise(shift), after + last + 1
        rows = rows.withColumn("block", F.col("block") + shift).drop("folder", "part")
        docs = rows.where("term is null")
        out = docs.select("collection", "block", F.posexplode("ids").alias("slot", "id")).join(gone, ["collection", "id"], "left_semi").groupBy("collection", "block").agg(F.collect_set("slot").alias("out"))
        left = F.transform("lens", lambda n, slot: F.when(~F.coalesce(F.array_contains("out", slot), F.lit(False)), n))
        docs = docs.join(out, ["collection", "block"], "left").withColumn("lens", left).where(F.exists("lens", lambda n: n.isNotNull()))
        kept = rows.where("term is not null").drop("ids", "lens").join(docs.select("collection", "block", "ids", "lens", F.col("out").isNotNull().alias("changed")).hint("shuffle_hash"), ["collection", "block"])
        stays = F.filter(F.arrays_zip("slots", "tfs"), lambda p: F.get("lens", p["slots"]).isNotNull())
        kept = kept.withColumn("p", F.when(F.col("changed"), stays).otherwise(F.arrays_zip("slots", "tfs"))).where(F.size("p") > 0)
        kept = kept.select("collection", "term", "block", F.array_max("p.tfs").alias("max_tf"), F.array_min(F.transform("p.slots", lambda s: F.get("lens", s))).alias("min_len"), F.col("p.slots").alias("slots"), F.col("p.tfs").alias("tfs"))
        tables = {t: dropped(ps, dirty) if t in ("postings", "terms", "lengths") else ps for t, ps in version.tables.items() if t != "gone"}
        self._change(docs.drop("out").unionByName(kept, allowMissingColumns=True), version, tables, version.meta | {"dirty": []})
        return dirty

    # searches

    def _asked(self, query: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """The postings of the query's terms with the block's `folder`, the blocks' documents, and (collection, term, avg_len, idf, qf); None where nothing can be found."""
        asked, version = Counter(re.findall(r"[a-z0-9]+", query.lower())), self.tables.current()
        if not asked or "postings" not in version.tables:
            return None
        terms, times = list(asked), F.lit(0)
        for t, n in asked.items():
            times = F.when(F.col("term") == t, n).otherwise(times)
        parts = self.spark.range(1).select(F.array(*[_term_part(F.lit(t), self.parts) for t in terms])).first()[0]
        where = F.col("part").isin(parts) & F.col("term").isin(terms)
        df = self.tables.read("terms", version).where(where).groupBy("collection", "term").agg(F.sum("df").alias("df"))
        raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        known = df.join(self.tables.read("statistics", version), "collection").select("collection", "term", "avg_len", F.when(raw < 0, F.col("mean") * EPSILON).otherwise(raw).alias("idf"), times.alias("qf"))
        rows = self._folders(version)
        return rows.where(where).drop("ids", "lens"), rows.where(F.col("part") == DOCS), known

    def plan(self, query: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """(collection, folder, block, bound) of all blocks that hold a term; those that a search opens; and the scores in them."""
        found = self._asked(query)
        if found is None:
            return None
        rows, docs, known = found
        at = ["collection", "folder", "block"]
        best = F.greatest(F.lit(0.0), F.col("qf") * F.col("idf") * _weight(F.col("max_tf"), F.col("min_len"), F.col("avg_len")))
        bounds = rows.join(known, ["collection", "term"]).groupBy(*at).agg(F.sum(best).alias("bound"))

        def scored(blocks: DataFrame) -> DataFrame:
            each = rows.join(blocks.select(*at), at, "left_semi").join(known, ["collection", "term"]).join(docs.select(*at, "ids", "lens"), at)
            held = F.transform(F.arrays_zip("slots", "tfs"), lambda p: F.struct(p["slots"].alias("slot"), F.get("ids", p["slots"]).alias("id"), p["tfs"].alias("tf"), F.get("lens", p["slots"]).alias("len")))
            each = each.select(*at, "qf", "idf", "avg_len", F.explode(held).alias("d"))
            score = F.col("qf") * F.col("idf") * _weight(F.col("d.tf"), F.col("d.len"), F.col("avg_len"))
            whole = each.groupBy(*at, F.col("d.slot").alias("slot"), F.col("d.id").alias("id")).agg(F.sum(score).alias("score")).where("score > 0")
            return whole.select("collection", "id", F.round("score", 9).alias("score"))

        order = Window.partitionBy("collection").orderBy(F.desc("bound"), "folder", "block")
        first = bounds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)  # the k best may lie in as many blocks
        least = retrieval.ranked(scored(first), "score", k).where(F.col("rank0") == k - 1).select("collection", F.col("score").alias("least"))
        opened = bounds.join(least, "collection", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - 1e-8).select("collection", "folder", "block", "bound")
        return bounds, opened, scored(opened)

    def search(self, query: str, k: int) -> DataFrame:
        """TOP-02/03: (collection, id, score, rank0, normalized): the k best chunks of each collection."""
        self.freshen()
        found = self.plan(query, k)
        if found is None:
            return self.spark.createDataFrame([], "collection string, id long, score double, rank0 int, normalized double")
        top = retrieval.ranked(found[2], "score", k)
        return top.withColumn("normalized", F.least(F.col("score") / F.max("score").over(Window.partitionBy("collection")), F.lit(1.0)))
