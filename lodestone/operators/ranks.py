"""Places of rows in one order over all of them, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.streaming.ledger import shared_folder


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """`rows` with their places from 0 in `order`, which must tell all rows apart.

    Rows are dealt by ranges of the order and written once, so that ranges stay as they are; places within a range get the
    number of rows in the ranges before. The one window over all counts has a row for each range.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranges.write.parquet(folder)
    dealt = spark.read.schema(ranges.schema).parquet(folder)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy("_range").orderBy(*order)
    return dealt.withColumn("_inside", F.row_number().over(inside) - 1).join(counts, "_range").withColumn(name, (F.col("_from") + F.col("_inside")).cast("long")).drop("_range", "_inside", "_from")
