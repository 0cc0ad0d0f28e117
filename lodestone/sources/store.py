"""A store of chunks that is read by id or by source without reading the rest, and filled by a queue of files.

SRC-02/03, SNK-09, STR-13, DML-01. Chunks lie in buckets by a hash of their id, with Bloom filters on it; a small table says
which buckets hold a source. A lookup opens the buckets that it needs. Files that are laid in an inbox are taken by a
stream whose batches are versions of the store, each with its number, so a batch that runs again after a crash changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.versioned import Part, VersionedTables

BUCKETS = 16
_BLOOM = {"parquet.bloom.filter.enabled#id": "true"}
CHUNK = "id string, source_id string, content string"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class ChunkStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.tables, self.buckets = spark, VersionedTables(spark, root), buckets
        self.tables.recover()

    def upsert(self, chunks: DataFrame, batch: int | None = None) -> bool:
        """Chunks in place of those with their ids; of repeated ids the greatest row counts. Only buckets that are met are
        rewritten. False if `batch` was there already."""
        version = self.tables.current()
        if batch is not None and version.meta.get("batch", -1) >= batch:
            return False
        new = chunks.where("id is not null").groupBy("id").agg(F.max(F.struct("source_id", "content")).alias("c")).select(_bucket(F.col("id"), self.buckets).alias("bucket"), "id", "c.source_id", "c.content")
        fresh = self.tables.stage(self._dealt(new), ("bucket",), _BLOOM)
        met = [str(r[0]) for r in self.tables.folder(fresh).select("bucket").distinct().collect()]  # at most one a bucket
        have = self._rows(version.tables.get("chunks", []), met)
        parts = [fresh]
        if have is not None:
            kept = have.join(self.tables.folder(fresh).select("id"), "id", "left_anti").select("bucket", "id", "source_id", "content")
            parts.append(self.tables.stage(self._dealt(kept), ("bucket",), _BLOOM))
        old = [Part(p.folder, p.rows, p.schema, p.by, sorted({*p.without, *met})) for p in version.tables.get("chunks", [])]
        old = [p for p in old if len(p.without) < self.buckets]
        now = None
        for p in parts:
            rows = self.tables.folder(p).select("source_id", "bucket").distinct()
            now = rows if now is None else now.unionByName(rows)
        clean = self.tables.read("sources", version)
        listed = now if clean is None else now.unionByName(clean.where(~F.col("bucket").cast("string").isin(met)))
        where = self.tables.stage(listed.distinct().coalesce(1))
        self.tables.commit({}, {"chunks": [*old, *parts], "sources": [where]}, version.meta | ({} if batch is None else {"batch": batch}), base=version)
        return True

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows by bucket; a bucket is several tasks' work where the session has more of them than there are buckets."""
        some = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        return rows.repartition("bucket", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(some))).sortWithinPartitions("bucket", "id")

    def _rows(self, parts: list[Part], buckets: list[str]) -> DataFrame | None:
        """Rows of these buckets: only their folders are listed and opened."""
        out = None
        for p in parts:
            root = f"{self.tables.root}/data/{p.folder}"
            held = {n.removeprefix("bucket=") for n in self.tables._names("data", p.folder)}
            paths = [f"{root}/bucket={b}" for b in buckets if b in held and b not in p.without]
            if paths:
                rows = self.spark.read.option("basePath", root).parquet(*paths)
                out = rows if out is None else out.unionByName(rows)
        return out

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], CHUNK)

    def get(self, ids: list[str]) -> DataFrame:
        """SRC-02: the chunks with these ids."""
        if not ids:
            return self._empty()
        keys = self.spark.createDataFrame([(i,) for i in ids], "id string").select(_bucket(F.col("id"), self.buckets).cast("string").alias("b")).distinct().collect()
        rows = self._rows(self.tables.current().tables.get("chunks", []), [r.b for r in keys])
        return self._empty() if rows is None else rows.where(F.col("id").isin(ids)).select("id", "source_id", "content")

    def of_sources(self, sources: list[str]) -> DataFrame:
        """SRC-03: the chunks of these sources, from the buckets that hold any."""
        version = self.tables.current()
        known = self.tables.read("sources", version)
        if known is None:
            return self._empty()
        keys = known.where(F.col("source_id").isin(sources)).select(F.col("bucket").cast("string").alias("b")).distinct().collect()
        rows = self._rows(version.tables.get("chunks", []), [r.b for r in keys])
        return self._empty() if rows is None else rows.where(F.col("source_id").isin(sources)).select("id", "source_id", "content")

    def all(self) -> DataFrame:
        rows = self.tables.read("chunks")
        return self._empty() if rows is None else rows.select("id", "source_id", "content")


def take_in(store: ChunkStore, inbox: str, checkpoint: str, archive: str | None = None, files: int = 100) -> None:
    """SNK-09, STR-13: everything that lies in the inbox as JSON lines of chunks, a version a batch, and then stop.

    With `archive` a file that was taken in moves there once a later batch is done. A run after a crash goes on with the batch at hand.
    """
    rows = store.spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files)
    if archive:
        rows = rows.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    put = lambda batch, number: store.upsert(batch, number)
    rows.json(inbox).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
