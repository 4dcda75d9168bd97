"""The decision log as JSON lines, read and appended to."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift import schema as S
from framesift.operators import journal


# Besides a mark's own fields a row tells which append wrote it, by the clock
# then, and where it stood in that one's order.
_PLACE = ("batch", "line")
_WRITTEN = S.DECISIONS
for _name in _PLACE:
    _WRITTEN = T.StructType([*_WRITTEN.fields, T.StructField(_name, T.LongType())])


def _usable() -> Column:
    """A row that lacks what every row has isn't malformed to the reader; its
    fields are null, and it's skipped here."""
    measures = F.col("signals")
    whole = F.col("signals").isNull() | (
        measures["highlights"].isNotNull()
        & measures["shadows"].isNotNull()
        & measures["faces"].isNotNull()
        & measures["face"].isNotNull()
    )
    stands = F.col("standing").isNull() | F.col("standing.of").isNotNull()
    return F.col("file.path").isNotNull() & F.col("rating").isNotNull() & whole & stands


def read(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows, those that can't be read left out, with ``seq``: when
    each was made, which append wrote it and where it stood there. Rows that
    don't tell come before those that do, by their place in their file."""
    rows = spark.read.schema(_WRITTEN).option("mode", "DROPMALFORMED").json(path)
    seq = F.struct(
        *_placed(),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.select(*S.DECISIONS.names, seq.alias("seq")).where(_usable())


def _placed() -> list[Column]:
    return [F.coalesce(name, F.lit(0)).alias(name) for name in ("at", *_PLACE)]


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The log as it grows, a file a sitting, with ``ts`` for event time and
    ``seq``, the order in which it was written."""
    rows = (
        spark.readStream.schema(_WRITTEN)
        .option("mode", "DROPMALFORMED")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(path)
    )
    placed = rows.where(_usable()).withColumn("seq", F.struct(*_placed()))
    return placed.drop(*_PLACE).withColumn("ts", F.timestamp_millis("at"))


def append(marks: DataFrame, path: str, failed: DataFrame | None = None, order: str = "at") -> None:
    """Append the marks that get a row, in the order they were made. Ranges of
    time are what's shuffled by, so that no sitting is one task's.

    Marks of one millisecond in two appends stand in the order of the appending
    drivers' clocks: two drivers at once need clocks that agree."""
    rows = journal.loggable(marks, failed)
    ordered = rows.repartitionByRange("at", order).sortWithinPartitions("at", order)
    lines = ordered.select(
        F.lit(S.LOG_VERSION).alias("v"), *(c for c in S.DECISIONS.names if c != "v"),
        F.lit(time.time_ns()).alias("batch"), F.monotonically_increasing_id().alias("line"),
    )
    lines.write.mode("append").option("ignoreNullFields", False).json(path)
