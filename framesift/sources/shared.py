"""The folder all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# What a local session uses where no folder is named, by application.
_OWN: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session may do without."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder every executor can reach")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        root = _OWN[context.applicationId]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, with no plan behind them."""
    path = folder(rows.sparkSession, "settled")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
