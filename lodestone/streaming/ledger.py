"""Structured Streaming twins of the ledger: rollups, de-duplication and event-time windows.

STR-06/07/08/09. Sources are folders of Parquet files; timestamps without zone are cast, for watermarks need instants.
Sinks are Parquet tables in the shared checkpoint folder, written by `foreachBatch`, so executors may come and go.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import usage


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the session's checkpoint folder; a temporary one only in local mode."""
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    base = own.get() if own.isDefined() else sc.getConf().get("spark.checkpoint.dir")
    if not base and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="lodestone-stream-")
    return f"{base}/stream-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    df = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    for field in schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def settle(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return its result table: the last one in complete mode, all rows in append mode."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    out = f"{folder}/table"

    def put(batch: DataFrame, number: int) -> None:
        # one folder a batch: a batch that is run again replaces its own rows
        batch.write.mode("overwrite").parquet(f"{out}/batch={number if mode != 'complete' else 0}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/batch=*")


def daily_rollup(events: DataFrame) -> DataFrame:
    """STR-07: totals by event day and provider; complete mode."""
    e = usage.cleaned(usage.from_events(events))
    return e.groupBy("day", "provider").agg(F.sum("total").alias("total"), F.count("*").alias("events"))


def deduplicated(events: DataFrame, key: str = "event_id", within: str = "1 day") -> DataFrame:
    """STR-06: the first event of each id while the watermark remembers it; append mode."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events and values by event-time window, tumbling or sliding, late ones within the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by user session: a session ends after `gap` without an event; append mode."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
