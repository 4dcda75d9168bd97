"""Frames shot together: bursts, stacks, and what a folded stack shows.

Runs follow the order of names within a folder, not of time, so everything
here is keyed by ``dir`` and ordered by ``path``; frames of folders that may be
big come laid out so (:func:`framesift.scale.laid`). A stack is called by the path
of its first frame.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift import scale
from framesift.functions import scalars, vision

# The gaps in seconds, and how near looks are to be alike.
GAP = 2.0
SIMILAR_GAP = 30.0
ALIKE = 18.0
MODES = ("off", "manual", "time", "similar")


def _runs(frames: DataFrame, joined: Column, before: dict[str, Column], into: str) -> DataFrame:
    """Number the runs of frames ``joined`` to the one before, where there are
    two or more; ``before`` is what of the row before ``joined`` needs."""
    keep = frames.columns
    seen = scale.previous(frames, ["dir"], "path", before)
    starts = F.when(~F.coalesce(joined, F.lit(False)), F.col("path"))
    named = scale.carry(seen.withColumn("_start", starts), ["dir"], "path", {"_run": F.col("_start")})
    counted = scale.attach(named, ["dir", "_run"], {"_size": F.count(F.lit(1))})
    return counted.select(*keep, F.when(F.col("_size") > 1, F.col("_run")).alias(into))


def by_time(frames: DataFrame, gap: float = GAP, into: str = "stack") -> DataFrame:
    """Runs whose capture times are at most ``gap`` apart. A frame whose time
    isn't known is in none, and ends the run before it."""
    near = F.abs(F.col("captured") - F.col("_captured")) <= gap
    return _runs(frames, near, {"_captured": F.col("captured")}, into)


def by_look(
    frames: DataFrame,
    gap: float = GAP,
    similar_gap: float = SIMILAR_GAP,
    alike: float = ALIKE,
    into: str = "stack",
) -> DataFrame:
    """Runs a little further apart in time that look alike; where a look is
    missing, by time alone."""
    apart = F.abs(F.col("captured") - F.col("_captured"))
    distance = vision.signature_distance("signature", "_signature")
    both = F.col("signature").isNotNull() & F.col("_signature").isNotNull()
    joined = (apart <= similar_gap) & F.when(both, distance < alike).otherwise(apart <= gap)
    before = {"_captured": F.col("captured"), "_signature": F.col("signature")}
    return _runs(frames, joined, before, into)


def bursts(frames: DataFrame, gap: float = GAP) -> DataFrame:
    """Runs by time whatever the stacking, as ``burst``."""
    return by_time(frames, gap, "burst")


def by_hand(frames: DataFrame, hand_stacks: DataFrame) -> DataFrame:
    """Stacks made by hand, from ``(dir, stack, name, at)``: each frame is in
    the last stack it was put in.

    A name no longer in the folder stands for the first frame named like it
    but for the extension; what's still unknown is left out, as are stacks
    with fewer than two frames left. Such stacks aren't stretches of a folder,
    so frames laid out by name aren't any more; lay them out by stack.
    """
    last = hand_stacks.groupBy("dir", "name").agg(
        F.max_by("stack", F.struct("at", "stack")).alias("_stack"), F.max("at").alias("_at")
    )
    names = frames.select("dir", "path", F.col("name").alias("_name"))
    stems = names.groupBy("dir", scalars.stem("_name").alias("_stem")).agg(F.min("path").alias("_like"))
    exact = scale.lookup(
        last, names.select("dir", F.col("_name").alias("name"), F.col("path").alias("_exact")),
        ["dir", "name"],
    )
    found = scale.lookup(exact.withColumn("_stem", scalars.stem("name")), stems, ["dir", "_stem"]).withColumn("path", F.coalesce("_exact", "_like"))
    # Two names may come to the same frame: the later assignment has it.
    member = (
        found.where(F.col("path").isNotNull())
        .groupBy("dir", "path")
        .agg(F.max_by("_stack", F.struct("_at", "_stack")).alias("_stack"))
    )
    sizes = member.groupBy("dir", "_stack").agg(F.count(F.lit(1)).alias("_size"), F.min("path").alias("_first"))
    sized = scale.lookup(member, sizes.where(F.col("_size") > 1), ["dir", "_stack"], "inner")
    kept = sized.select("path", F.col("_first").alias("stack"))
    return scale.lookup(frames.drop("stack", scale.BLOCK), kept, ["path"])


def stack(
    frames: DataFrame,
    mode: str,
    *,
    hand_stacks: DataFrame | None = None,
    gap: float = GAP,
    similar_gap: float = SIMILAR_GAP,
    alike: float = ALIKE,
) -> DataFrame:
    """Give every frame its ``stack`` (null if in none), one way or another."""
    frames = frames.drop("stack")
    if mode == "off":
        return frames.withColumn("stack", F.lit(None).cast("string"))
    if mode == "manual":
        return by_hand(frames, hand_stacks)
    if mode == "time":
        return by_time(frames, gap)
    if mode == "similar":
        return by_look(frames, gap, similar_gap, alike)
    raise ValueError(f"no stacking called {mode!r} (there are {', '.join(MODES)})")


def group() -> Column:
    """What a frame was shot with: its stack, else its burst, else itself."""
    return F.coalesce(F.col("stack"), F.col("burst"), F.col("path"))


def shown(
    frames: DataFrame, matches: Column, expanded: Iterable[str] | Column = ()
) -> DataFrame:
    """Mark the frames on show: ``matching`` what the filters let through,
    ``representative`` the one that stands for its stack when folded, and
    ``visible`` what is on show with all stacks folded but those
    ``expanded``.

    A stack is stood for by its best-rated frame let through; of equals the
    one suggested for keeping, else the first.
    """
    if not isinstance(expanded, Column):
        expanded = F.col("stack").isin(*expanded)
    marked = frames.withColumn("matching", matches)
    keeps = F.coalesce(F.col("suggested") > 0, F.lit(False))
    best_first = F.struct(-F.col("rating"), ~keeps, F.col("path"))
    stood = scale.attach(
        marked.withColumn("_unit", F.coalesce("stack", "path")),
        ["dir", "_unit"],
        {"_stands": F.min_by("path", F.when(F.col("matching"), best_first))},
    )
    stands = F.col("stack").isNotNull() & F.coalesce(F.col("path") == F.col("_stands"), F.lit(False))
    alone = F.col("stack").isNull() | F.coalesce(expanded, F.lit(False))
    return stood.withColumns(
        {"representative": stands, "visible": F.col("matching") & (alone | stands)}
    ).drop("_unit", "_stands")


def neighbours(frames: DataFrame) -> DataFrame:
    """The nearest visible frame either side of each, as ``previous`` and
    ``next``; and ``settled``, where a cursor on it goes: it stays if the frame
    matches, else goes on, else back, else stays."""
    seen = {"_seen": F.when(F.col("visible"), F.col("path"))}
    ahead = scale.carry(frames, ["dir"], "path", {"next": seen["_seen"]}, inclusive=False, backward=True)
    both = scale.carry(ahead, ["dir"], "path", {"previous": seen["_seen"]}, inclusive=False)
    moved = F.when(F.col("matching"), F.col("path")).otherwise(F.coalesce("next", "previous", "path"))
    return both.withColumn("settled", moved)
