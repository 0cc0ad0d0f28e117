"""What the corpus operators share: checkpoints, hash mixing and the hold-out rule."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; a temporary folder only in local mode, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there: a lost executor costs a read, not a rerun."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions for an exchange that is dealt by hand; it follows the session's setting, so it grows with the cluster."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32(doc_id as text) mod 3 is 1 are never learnt from; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that sums and xors of mixed values behave like random ones."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def lowest_hashes(rows: DataFrame, group: str, key: str, most: dict, seed: int) -> DataFrame:
    """The rows of each group with the lowest hashes of their keys, up to `most[group]` of them; other groups have none.

    Groups are counted first, and only hashes below four times the share that is wanted reach the ranking, so it sorts a few
    rows, not each task's lot. Where so few pass that a group falls short, which hashing makes all but impossible, it is
    ranked whole.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(group).isin(list(most))).groupBy(group).count().collect()}
    h = F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))
    hashed = rows.withColumn("_h", h)
    order = Window.partitionBy(group).orderBy("_h", key)

    def ranked(share: float) -> DataFrame:
        keep = limit = F.lit(None)
        for g, n in counts.items():
            bar = min(1.0, share * most[g] / n)
            keep = F.when(F.col(group) == g, F.col("_h") <= int(bar * (1 << 62))).otherwise(keep)
            limit = F.when(F.col(group) == g, most[g]).otherwise(limit)
        return hashed.where(keep).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_h", "_r")

    if not counts:
        return rows.limit(0)
    few = ranked(4.0)
    return few if few.count() >= sum(min(n, most[g]) for g, n in counts.items()) else ranked(float("inf"))


def sampled_texts(docs: DataFrame, chosen: DataFrame, group: str, longest: int, most: int) -> DataFrame:
    """(id, group, text) of the ids in `chosen(id, group)`, a sample of bounded rows: texts up to `longest` characters, by
    hash of the id until a group has `most` of them. Of rows that repeat an id it is the smallest text, whatever their order.
    """
    met = docs.where("text is not null").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id")
    texts = met.where(F.length("text") <= longest).groupBy("id", group).agg(F.min("text").alias("text"))
    before = Window.partitionBy(group).orderBy(F.xxhash64("id", F.lit(29)), "id").rowsBetween(Window.unboundedPreceding, 0)
    return texts.withColumn("_upto", F.sum(F.length("text").cast("long")).over(before)).where(F.col("_upto") <= most).drop("_upto")


def fit_in_task(sample: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """What `fit` makes of the rows of a bounded sample, or None of none: one task's work, of which only the result comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        yield pa.record_batch({"model": pa.array([pickle.dumps(fit(rows) if rows else None)], pa.binary())})

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else None
