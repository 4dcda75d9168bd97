"""What was measured of frames, kept between runs and by version."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift import schema as S
from framesift.functions import scalars
from framesift.sources.shared import settled


def _by_file(spark: SparkSession, root: str, schema) -> DataFrame:
    name = F.regexp_replace("_metadata.file_name", r"\.json$", "")
    rows = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .option("mode", "DROPMALFORMED")
        .json(root)
    )
    return rows.select(name.alias("key"), *schema.names)


def read_signals(spark: SparkSession, root: str) -> DataFrame:
    """One small JSON object a frame, ``(key, signals…)``."""
    return _by_file(spark, root, S.SIGNALS).where(
        F.col("highlights").isNotNull() & F.col("faces").isNotNull()
    )


def read_faces(spark: SparkSession, root: str) -> DataFrame:
    """One small JSON array a frame, a row a face, ``(key, faces…)``."""
    return _by_file(spark, root, S.FACE).where(F.col("bounds").isNotNull())


def keyed(frames: DataFrame, version: int) -> DataFrame:
    """Attach the ``key`` a frame's measures are kept under."""
    return frames.withColumn("key", scalars.cache_key("path", "length", "modified", version))


def store(measures: DataFrame, root: str, version: int) -> None:
    """Keep measures under their version, in place of what it had."""
    tagged = measures.withColumn("version", F.lit(version))
    (
        tagged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("version")
        .parquet(root)
    )


def load(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The measures of one version; others' files aren't opened."""
    return spark.read.parquet(root).where(F.col("version") == version).drop("version")


def _held(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The cache's part for a version, also where nothing was put in yet."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.SIGNALS)
    schema = f"key bigint, {fields}"
    try:
        return spark.read.schema(f"{schema}, version int").parquet(root).where(F.col("version") == version).drop("version")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def missing(frames: DataFrame, spark: SparkSession, root: str, version: int) -> DataFrame:
    """The frames with a ``key`` that the cache has no measures under."""
    return frames.join(_held(spark, root, version).select("key"), "key", "left_anti")


def merge(new: DataFrame, root: str, version: int) -> DataFrame:
    """Add measures ``(key, signals…)`` that the cache doesn't have, and nothing
    else: what's there isn't read but for its keys, nor written again. Of equal keys
    one stays. Returns what was added."""
    spark = new.sparkSession
    fields = [f.name for f in S.SIGNALS]
    once = new.groupBy("key").agg(F.max(F.struct(*fields)).alias("_s")).select("key", "_s.*")
    added = settled(missing(once, spark, root, version))
    added.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(root)
    return added


def attach(frames: DataFrame, spark: SparkSession, root: str, version: int) -> DataFrame:
    """Attach the measures kept under each frame's ``key`` as ``signals``; null
    where there are none."""
    fields = [f.name for f in S.SIGNALS]
    kept = _held(spark, root, version).select("key", F.struct(*fields).alias("signals"))
    return frames.drop("signals").join(kept, "key", "left")
