"""The frame table put together from a listing and what lies beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift import scale
from framesift import schema as S
from framesift.functions import scalars, xmp


def pictures(listing: DataFrame) -> DataFrame:
    """The pictures among listed files, as ``(dir, path, name, kind, length,
    modified)``: not folders, nor hidden, nor of other kinds."""
    return (
        listing.where(~F.col("is_dir") & ~scalars.hidden("name"))
        .select(F.col("parent").alias("dir"), "path", "name", scalars.kind("name").alias("kind"), "length", "modified")
        .where(F.col("kind").isNotNull())
    )


def of_format(frames: DataFrame, formats: str) -> DataFrame:
    """Only the pictures of one kind (``raw``, ``jpeg``, ``png``); all of a
    folder's where it has none of that kind, or for ``all``."""
    if formats == "all":
        return frames
    folders = frames.groupBy("dir").agg(F.bool_or(F.col("kind") == formats).alias("_held"))
    held = scale.lookup(frames, folders, ["dir"])
    return held.where((F.col("kind") == formats) | ~F.col("_held")).drop("_held")


def with_ratings(frames: DataFrame, sidecars: DataFrame, naming: str = "darktable") -> DataFrame:
    """Attach each picture's ``rating`` from its sidecar's text, and the
    ``problem`` where that can't be read (which counts as unmarked)."""
    read = sidecars.select("sidecar_path", xmp.rating("xmp").alias("_read"))
    beside = frames.drop("rating", "problem").withColumn(
        "sidecar_path", scalars.sidecar_path("path", naming)
    )
    joined = scale.lookup(beside, read, ["sidecar_path"])
    return joined.withColumns(
        {"rating": scalars.clamp_rating(F.col("_read.rating")), "problem": F.col("_read.problem")}
    ).drop("_read", "sidecar_path")


def problems(frames: DataFrame, naming: str = "darktable") -> DataFrame:
    """The sidecars that couldn't be read, and why."""
    return frames.where(F.col("problem").isNotNull()).select(
        scalars.sidecar_path("path", naming).alias("sidecar_path"), "problem"
    )


def with_captures(frames: DataFrame, captures: DataFrame) -> DataFrame:
    """Attach capture times in seconds and shooting settings, by path."""
    own = captures.select(
        "path", scalars.exif_seconds("captured").alias("captured"), *([F.col("exif")] if "exif" in captures.columns else [])
    )
    return scale.lookup(frames.drop(*(set(own.columns) - {"path"})), own, ["path"])


def with_signals(frames: DataFrame, signals: DataFrame) -> DataFrame:
    """Attach what was measured of each frame, by path, as one struct; null
    where it wasn't."""
    one = signals.select("path", F.struct(*(F.col(f.name) for f in S.SIGNALS)).alias("signals"))
    return scale.lookup(frames.drop("signals"), one, ["path"])


def with_suggestions(frames: DataFrame, suggested: DataFrame) -> DataFrame:
    """Attach the suggested rating of ``(path, suggestion)``, for the frames
    still undecided: these and no others."""
    own = suggested.select("path", F.col("suggestion.rating").alias("_suggested"))
    joined = scale.lookup(frames.drop("suggested"), own, ["path"])
    return joined.withColumn(
        "suggested", F.when(F.col("rating") == S.UNDECIDED, F.col("_suggested")).cast("int")
    ).drop("_suggested")


def unmeasured(frames: DataFrame, signals: DataFrame) -> DataFrame:
    """The frames there is nothing measured of yet."""
    return frames.join(signals.select("path"), "path", "left_anti")


def restored(frames: DataFrame, failures: DataFrame) -> DataFrame:
    """Put back what sidecars hold where writing a mark failed
    (``(path, on_disk)``)."""
    joined = scale.lookup(frames, failures.select("path", "on_disk"), ["path"])
    return joined.withColumn("rating", F.coalesce("on_disk", "rating")).drop("on_disk")


def write_back(marks: DataFrame, sidecars: DataFrame, naming: str = "darktable") -> DataFrame:
    """The sidecars that marks ``(path, rating)`` come to, one mark a path:
    ``(sidecar_path, path, xmp, problem)``.

    Only texts that change are here. A picture with no sidecar gets a fresh
    one, unless its mark is 0. Where ``problem`` is set nothing can be written.
    """
    beside = marks.withColumn("sidecar_path", scalars.sidecar_path("path", naming))
    # Placed before they're joined: once a text, whatever is asked of it after.
    old = sidecars.select("sidecar_path", F.col("xmp").alias("_old"), xmp.place("xmp").alias("_place"))
    joined = scale.lookup(beside, old, ["sidecar_path"])
    there = F.col("_old").isNotNull()
    bad = ~F.col("rating").between(S.REJECT, S.STARS)
    problem = F.when(bad, "there is no such mark").when(
        there & ~F.col("_place.writable"), F.col("_place.problem")
    )
    new = F.when(there, xmp.with_rating_at("_old", "_place", "rating")).otherwise(xmp.fresh("rating"))
    writes = F.when(there, xmp.changes("_place", "rating")).otherwise(F.col("rating") != S.UNDECIDED)
    return joined.where(problem.isNotNull() | writes).select(
        "sidecar_path", "path", F.when(~bad, new).alias("xmp"), problem.alias("problem")
    )


def failures(written: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``(path, on_disk, problem)`` of the marks :func:`write_back` couldn't
    place: what the sidecar holds, 0 if that can't be read either."""
    failed = written.where(F.col("problem").isNotNull()).select("path", "sidecar_path", "problem")
    read = sidecars.select("sidecar_path", xmp.rating("xmp")["rating"].alias("on_disk"))
    joined = scale.lookup(failed, read, ["sidecar_path"])
    return joined.select("path", F.coalesce("on_disk", F.lit(0)).alias("on_disk"), "problem")


def reidentified(log: DataFrame, files: DataFrame) -> DataFrame:
    """Attach ``now_path``, where the file of each log row is today: at its
    path, or else wherever the file of that name, size and capture time has
    gone (the first such). ``files`` is ``(path, size, captured)``."""
    here = files.select("path", "size", "captured", scalars.base_name("path").alias("name"))
    moved = here.groupBy("name", "size", "captured").agg(F.min("path").alias("_moved"))
    rows = log.withColumns(
        {
            "_path": F.col("file.path"),
            "_name": scalars.base_name("file.path"),
            "_size": F.col("file.size"),
            "_captured": F.col("file.captured"),
        }
    )
    still = here.select(F.col("path").alias("_path"), F.lit(True).alias("_still"))
    exact = scale.lookup(rows, still, ["_path"])
    keys = moved.select(*(F.col(c).alias(f"_{c}") for c in ("name", "size", "captured")), "_moved")
    both = scale.lookup(exact, keys, ["_name", "_size", "_captured"])
    found = both.withColumn("now_path", F.when(F.col("_still"), F.col("_path")).otherwise(F.col("_moved")))
    return found.drop("_path", "_name", "_size", "_captured", "_still", "_moved")
