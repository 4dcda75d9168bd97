"""Many saved searches over many folders at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift import scale
from framesift.functions import predicates


def bad_terms(terms: DataFrame) -> DataFrame:
    """The terms that can't be read, and why."""
    return terms.withColumn("problem", predicates.bad_term("field", "op", "value")).where(
        F.col("problem").isNotNull()
    )


def readable(terms: DataFrame) -> DataFrame:
    """The searches, one row each: ``(search_id, dir, terms)``. One with any
    term that can't be read is dropped whole. A search is as long as someone
    wrote it, so its terms are an array."""
    wrong = predicates.bad_term("field", "op", "value").isNotNull()
    return (
        terms.groupBy("dir", "search_id")
        .agg(
            F.bool_or(wrong).alias("_wrong"),
            F.array_sort(F.collect_set(predicates.read_term("field", "op", "value"))).alias("terms"),
        )
        .where(~F.col("_wrong"))
        .drop("_wrong")
    )


def matches(frames: DataFrame, terms: DataFrame) -> DataFrame:
    """The frames each folder's saved searches let through, as ``(search_id,
    dir, path)``: every term of the search must match."""
    # Tested as they're joined: what doesn't match goes no further.
    joined = scale.lookup(frames, readable(terms), ["dir"], "inner")
    hit = F.forall("terms", predicates.test_term)
    return joined.where(hit).select("search_id", "dir", "path")


def hand_off(frames: DataFrame, condition) -> DataFrame:
    """The pictures handed to a developer that takes pictures: what's shown,
    in order."""
    return frames.where(condition).select("dir", "path").orderBy("path")


def folders_shown(frames: DataFrame) -> DataFrame:
    """The folders handed to a developer that takes folders."""
    return frames.select("dir").distinct()
