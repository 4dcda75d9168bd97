"""What to copy out, and what to delete: lists, not deeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift import scale
from framesift import schema as S
from framesift.functions import scalars


def copies(shown: DataFrame, files: DataFrame, naming: str = "darktable") -> DataFrame:
    """Where each picture shown ``(path, to)`` is to be copied: ``(path, to,
    copy, status, sidecar, sidecar_copy)``.

    ``files`` ``(path)`` is everything there is, both where pictures are and
    where they go. Nothing there is replaced: a picture whose name is taken is
    ``there``, and so is every later one of a name. A sidecar goes along if
    there is one and none is waiting.
    """
    to = shown.withColumn("copy", F.concat_ws("/", "to", scalars.base_name("path")))
    there = files.select(F.col("path").alias("copy"), F.lit(True).alias("_there")).distinct()
    named = scale.lookup(to, there, ["copy"])
    first = scale.lookup(named, to.groupBy("copy").agg(F.min("path").alias("_first")), ["copy"])
    new = F.col("_there").isNull() & (F.col("path") == F.col("_first"))
    marked = first.withColumns(
        {
            "status": F.when(new, "copy").otherwise("there"),
            "_from": scalars.sidecar_path("path", naming),
            "_to": scalars.sidecar_path("copy", naming),
        }
    ).drop("_there", "_first")
    have = files.select(F.col("path").alias("_from"), F.lit(True).alias("_has")).distinct()
    wait = files.select(F.col("path").alias("_to"), F.lit(True).alias("_waits")).distinct()
    beside = scale.lookup(scale.lookup(marked, have, ["_from"]), wait, ["_to"])
    goes = (F.col("status") == "copy") & F.col("_has") & F.col("_waits").isNull()
    return beside.select(
        "path", "to", "copy", "status",
        F.when(goes, F.col("_from")).alias("sidecar"),
        F.when(goes, F.col("_to")).alias("sidecar_copy"),
    )


def tallies(results: DataFrame) -> DataFrame:
    """How copying ``(to, path, status, problem)`` went, a row a destination:
    statuses are ``copy`` (done), ``there`` and ``failed``, whose reasons
    :func:`failures` lists."""
    failed = F.col("status") == "failed"
    return results.groupBy("to").agg(
        F.count_if(F.col("status") == "copy").alias("copied"),
        F.count_if(F.col("status") == "there").alias("there"),
        F.count_if(failed).alias("failed"),
    )


def failures(results: DataFrame) -> DataFrame:
    """Every copy that failed and why, ``(to, path, problem)``: rows of their
    own, as a destination may have any number."""
    return results.where(F.col("status") == "failed").select("to", "path", "problem")


def deletions(frames: DataFrame, files: DataFrame) -> DataFrame:
    """Every reject, on show or not, and its sidecars named either way that
    exist: ``(picture, path, what)``."""
    rejects = frames.where(F.col("rating") == S.REJECT).select(F.col("path").alias("picture"))
    namings = F.array_distinct(
        F.array(*(scalars.sidecar_path("picture", naming) for naming in ("darktable", "adobe")))
    )
    beside = rejects.select("picture", F.explode(namings).alias("path"))
    exist = beside.join(files.select("path"), "path", "left_semi")
    pictures = rejects.select("picture", F.col("picture").alias("path"), F.lit("picture").alias("what"))
    return pictures.unionByName(exist.select("picture", "path", F.lit("sidecar").alias("what")))
