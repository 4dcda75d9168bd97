"""The decision log reduced: last states, comparisons, outcomes, passes.

Rows carry ``seq``, what orders them: the log is read for what came last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift import scale
from framesift import schema as S
from framesift.functions import features, scalars


def is_logged() -> Column:
    """Which marks get a row: those that change one, and passes."""
    return (F.col("was") != F.col("rating")) | (F.col("how") == "pass")


def loggable(marks: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """The rows to append: none for a mark that didn't reach its sidecar."""
    rows = marks.where(is_logged())
    if failed is None:
        return rows
    named = failed.select(F.col("path").alias("_failed")).distinct()
    missed = (F.col("file.path") == F.col("_failed")) & (F.col("how") != "pass")
    return rows.join(named, missed, "left_anti")


def last_marks(log: DataFrame) -> DataFrame:
    """Each file's rating as it stands, by path."""
    return log.groupBy(F.col("file.path").alias("path")).agg(
        F.max_by("rating", "seq").alias("rating"), F.max("seq").alias("seq")
    )


def final_states(log: DataFrame) -> DataFrame:
    """What each frame ended as and was last measured as: ``(path, captured,
    rating, features)``. Frames never measured aren't here."""
    vector = features.vector("signals", "standing")
    captured = F.coalesce(F.col("file.captured"), F.lit(""))
    return (
        log.select(
            F.col("file.path").alias("path"), captured.alias("captured"), "rating", "seq", vector.alias("_seen")
        )
        .groupBy("path", "captured")
        .agg(
            F.max_by("rating", "seq").alias("rating"),
            F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("seq"))).alias("features"),
        )
        .where(F.col("features").isNotNull())
    )


def compared_pairs(log: DataFrame) -> DataFrame:
    """Marks made with other frames on screen, weighed against where those
    ended: per pair ``(path, other)`` how often the marked frame came out
    above it (``wins``), below (``losses``) and level (``ties``)."""
    seen = log.select(
        F.col("file.path").alias("path"), "rating", F.explode("compared.path").alias("other")
    ).where(F.col("path") != F.col("other"))
    # Combined before they're joined: a pair and mark once, with its count.
    pairs = seen.groupBy("path", "other", "rating").agg(F.count(F.lit(1)).alias("n"))
    ended = last_marks(log).select(F.col("path").alias("other"), F.col("rating").alias("_ended"))
    against = scale.lookup(pairs, ended, ["other"])
    against = against.withColumn("_ended", F.coalesce("_ended", F.lit(S.UNDECIDED)))

    def times(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return against.groupBy("path", "other").agg(
        times(F.col("rating") > F.col("_ended")).alias("wins"),
        times(F.col("rating") < F.col("_ended")).alias("losses"),
        times(F.col("rating") == F.col("_ended")).alias("ties"),
    )


def outcomes(log: DataFrame) -> DataFrame:
    """How often what was suggested was taken or overridden, by who suggested
    it. What's undone was no answer to a suggestion."""
    answered = log.where(F.col("suggested").isNotNull() & F.col("how").isin("mark", "pass"))
    took = F.col("rating") == F.col("suggested.rating")
    return answered.groupBy(F.col("suggested.by").alias("by")).agg(
        F.count(F.lit(1)).alias("answered"),
        F.count_if(took).alias("taken"),
        F.count_if(~took).alias("overridden"),
    )


def passed(views: DataFrame, log: DataFrame, ratings: DataFrame | None = None) -> DataFrame:
    """``(session, dir, path)`` of the views whose frame had no rating when
    the sitting's last mark in that folder was made; sittings without a mark
    in a folder give no rows for it.

    A frame's rating then is that of its last mark in the log so far,
    whichever sitting made it, or else the one in ``ratings`` ``(path,
    rating)``, what frames held before the log began. Views are put in the order of
    their frame's marks, at their sitting's end, so a frame with many marks and
    many sittings has as many rows as both together.
    """
    marked = log.where(F.col("how") != "pass").withColumns(
        {"path": F.col("file.path"), "dir": scalars.parent("file.path")}
    )
    seen = views.select("session", "dir", "path").distinct()
    sittings = marked.groupBy("session", "dir").agg(F.max("seq").alias("_end"))
    busy = scale.lookup(seen, sittings, ["session", "dir"], "inner")
    nothing = F.lit(None).cast("string")
    marks = marked.select("path", F.struct(F.col("seq").alias("seq"), F.lit(0).alias("view"), F.lit(None).cast("bigint").alias("session")).alias("_at"),
                          "rating", nothing.alias("dir"))
    ends = busy.select("path", F.struct(F.col("_end").alias("seq"), F.lit(1).alias("view"), F.col("session").cast("bigint").alias("session")).alias("_at"),
                       F.lit(None).cast("int").alias("rating"), "dir")
    both = scale.laid(marks.unionByName(ends), ["path"], "_at")
    left = scale.carry(both, ["path"], "_at", {"_last": F.col("rating")}).where("_at.view = 1")
    left = left.select(F.col("_at.session").cast(views.schema["session"].dataType).alias("session"), "dir", "path", "_last")
    held = F.col("_last")
    if ratings is not None:
        before = ratings.select("path", F.col("rating").alias("_held"))
        left = scale.lookup(left, before, ["path"])
        held = F.coalesce("_last", "_held")
    return left.where(F.coalesce(held, F.lit(S.UNDECIDED)) == S.UNDECIDED).select("session", "dir", "path")


def dwell(views: DataFrame, marks: DataFrame) -> DataFrame:
    """Attach to each mark ``(session, path, at)`` the milliseconds its frame
    had been on screen, ``dwell_ms``.

    ``views`` is ``(session, path, at)``, a row when a frame is on screen; one
    seen again with no other between has been there all along.
    """
    both = views.select("session", "path", "at", F.lit(0).alias("_marks")).unionByName(
        marks.select("session", "path", "at", F.lit(1).alias("_marks"))
    ).withColumn("_order", F.struct("at", "_marks", "path"))
    both = scale.laid(both, ["session"], "_order")
    before = scale.previous(both, ["session"], "_order", {"_was": F.col("path")})
    arrived = F.when(~F.col("path").eqNullSafe(F.col("_was")), F.col("at"))
    since = scale.carry(before.withColumn("_arrived", arrived), ["session"], "_order", {"_since": F.col("_arrived")})
    return since.where(F.col("_marks") == 1).select(
        "session", "path", "at", (F.col("at") - F.col("_since")).alias("dwell_ms")
    )


def dwell_rollup(log: DataFrame) -> DataFrame:
    """How long frames were looked at, by view and what became of them."""
    return log.where(F.col("how") != "pass").groupBy("view", "rating").agg(
        F.count(F.lit(1)).alias("marks"),
        F.sum("dwell_ms").alias("total_ms"),
        F.avg("dwell_ms").alias("mean_ms"),
    )
