"""Places in an order over a whole table, without one task for all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.shared import settled


def blocked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows as a table sorted over ranges, ``_block`` numbering the ranges in order."""
    keys = {f"_key{k}": c for k, c in enumerate(order)}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumns(keys).repartitionByRange(parts, *keys)
    return settled(ranged.withColumn("_block", F.spark_partition_id()), name)


def before(sums: DataFrame, block: str, value: str) -> DataFrame:
    """``block, _before``: the sum of a value over the blocks before. One row
    a block goes in, of which there are as many as shuffle partitions."""
    return sums.select(
        F.col(block).alias("_of"),
        (F.sum(value).over(Window.orderBy(block)) - F.col(value)).alias("_before"))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Each row's place in an order, from 0, as column ``name``."""
    ranges = blocked(rows, order, "ranked")
    keys = [c for c in ranges.columns if c.startswith("_key")]
    counts = before(ranges.groupBy("_block").agg(F.count("*").alias("_n")), "_block", "_n")
    within = F.row_number().over(Window.partitionBy("_block").orderBy(*keys)) - 1
    return (
        ranges.withColumn("_within", within)
        .join(counts, F.col("_block") == F.col("_of"))
        .withColumn(name, F.col("_within") + F.col("_before"))
        .drop("_block", "_of", "_within", "_before", *keys)
    )
