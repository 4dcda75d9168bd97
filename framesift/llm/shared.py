"""Tables written once in the folder all executors share, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame

from framesift.sources.shared import folder


def settled(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the folder ``spark.checkpoint.dir`` names.

    What comes after reads that table: costly work is done once, and losing an
    executor costs no more than the tasks it held.
    """
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
