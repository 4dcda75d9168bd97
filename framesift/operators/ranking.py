"""Frames weighed against the ones they were shot with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift import scale
from framesift import schema as S
from framesift.functions import vision

# How much of a score is sharpness whatever the eyes.
_WHATEVER, _OPEN = 0.4, 0.6


def _weighed(frames: DataFrame, keys: list[str], counted: Column, over: DataFrame | None | str) -> DataFrame:
    """Attach ``_of``, ``_sharp`` and ``_open`` among the frames ``counted``.

    Sharpness is at the eyes if all of them have that, else at the focus point
    if all have that, else whichever each has.
    """
    eyes, focus = F.col("signals.eyes"), F.col("signals.focus")
    among = scale.attach(
        frames.withColumn("_in", F.coalesce(counted, F.lit(False))),
        keys,
        {
            "_of": F.count_if(F.col("_in")),
            "_all_eyes": F.bool_and(F.when(F.col("_in"), eyes.isNotNull())),
            "_all_focus": F.bool_and(F.when(F.col("_in"), focus.isNotNull())),
            "_most_open": F.max(F.when(F.col("_in"), F.col("signals.open"))),
            "_best_eyes": F.max(F.when(F.col("_in"), eyes)),
            "_best_focus": F.max(F.when(F.col("_in"), focus)),
            "_best_either": F.max(F.when(F.col("_in"), F.coalesce(eyes, focus))),
        },
        over,
    )

    def chosen(by_eyes: Column, by_focus: Column, either: Column) -> Column:
        return F.when(F.col("_all_eyes"), by_eyes).when(F.col("_all_focus"), by_focus).otherwise(either)

    def share(value: Column, best: Column) -> Column:
        return F.when(value.isNotNull(), F.when(best > 0, value / best).otherwise(1.0))

    sharp = share(
        chosen(eyes, focus, F.coalesce(eyes, focus)),
        chosen(F.col("_best_eyes"), F.col("_best_focus"), F.col("_best_either")),
    )
    opened = share(F.col("signals.open"), F.col("_most_open"))
    return among.withColumns(
        {"_sharp": F.when(F.col("_in"), sharp), "_open": F.when(F.col("_in"), opened)}
    ).drop("_all_eyes", "_all_focus", "_most_open", "_best_eyes", "_best_focus", "_best_either")


def standings(frames: DataFrame, group: str = "group") -> DataFrame:
    """Attach each measured frame's ``standing`` among the measured frames of
    its group; null where the frame itself wasn't measured."""
    weighed = _weighed(frames, ["dir", group], F.col("signals").isNotNull(), "find")
    standing = F.struct(
        F.col("_of").cast("bigint").alias("of"), F.col("_sharp").alias("sharp"), F.col("_open").alias("open")
    )
    return weighed.withColumn("standing", F.when(F.col("_in"), standing)).drop("_in", "_of", "_sharp", "_open")


def alone() -> Column:
    """The standing of a frame that was in no group."""
    return F.struct(
        F.lit(1).cast("bigint").alias("of"),
        F.lit(None).cast("double").alias("sharp"),
        F.lit(None).cast("double").alias("open"),
    )


def evidence(frames: DataFrame) -> DataFrame:
    """Attach ``standing`` from a table with ``stack`` and ``burst``: a frame
    in neither stands alone, with nothing to be a share of."""
    grouped = frames.withColumn("group", F.coalesce("stack", "burst", "path"))
    stood = standings(grouped, "group")
    lone = F.coalesce(F.col("stack"), F.col("burst")).isNull()
    standing = F.when(lone & F.col("signals").isNotNull(), alone()).otherwise(F.col("standing"))
    return stood.withColumn("standing", standing).drop("group")


def _best(weighed: DataFrame, keys: list[str], over: DataFrame | None) -> DataFrame:
    """Attach ``winner`` and ``margin`` of the frames that are ``_in``."""
    score = (
        F.coalesce("_sharp", F.lit(1.0)) * (_WHATEVER + _OPEN * F.coalesce("_open", F.lit(1.0)))
        - F.col("signals.highlights")
    )
    scored = weighed.withColumn("score", F.when(F.col("_in"), score))
    best_first = F.when(F.col("_in"), F.struct(-F.col("score"), F.col("path")))
    won = scale.attach(scored, keys, {"winner": F.min_by("path", best_first), "_top": F.max("score")}, over)
    rest = F.when(F.col("path") != F.col("winner"), F.col("score"))
    run = scale.attach(won, keys, {"_next": F.max(rest)}, over)
    # Alone it wins by 1.
    lead = F.coalesce(F.col("_top") - F.col("_next"), F.lit(1.0))
    margin = F.greatest(F.least(lead, F.lit(1.0)), F.lit(0.0))
    return run.withColumn("margin", F.when(F.col("winner").isNotNull(), margin)).drop("_top", "_next")


def winners(frames: DataFrame, group: str = "group") -> DataFrame:
    """Attach each group's ``winner`` by its measured frames, the ``margin``
    it wins by (0 to 1; 1 alone), and each frame's ``score``."""
    keys = ["dir", group]
    over = scale.spans(frames, keys)
    weighed = _weighed(frames, keys, F.col("signals").isNotNull(), over)
    return _best(weighed, keys, over).drop("_in", "_of", "_sharp", "_open")


def suggestions(frames: DataFrame, pick: int = S.PICK) -> DataFrame:
    """The marks suggested for stacks, as ``(dir, stack, path, suggestion)``.

    A stack gets them when nothing in it is kept yet and two or more of its
    frames are undecided, all of them measured: the winner among those is to
    be picked and the rest rejected.
    """
    keys = ["dir", "stack"]
    stacked = frames.where(F.col("stack").isNotNull())
    over = scale.spans(stacked, keys)
    undecided = F.col("rating") == S.UNDECIDED
    counted = scale.attach(
        stacked,
        keys,
        {
            "_kept": F.count_if(F.col("rating") > 0),
            "_open_count": F.count_if(undecided),
            "_measured": F.count_if(undecided & F.col("signals").isNotNull()),
        },
        over,
    )
    ready = counted.where(
        undecided
        & (F.col("_kept") == 0)
        & (F.col("_open_count") >= 2)
        & (F.col("_measured") == F.col("_open_count"))
    )
    weighed = _weighed(ready, keys, F.lit(True), over)
    won = _best(weighed, keys, over)
    suggestion = F.struct(
        F.when(F.col("path") == F.col("winner"), pick).otherwise(S.REJECT).cast("int").alias("rating"),
        F.lit("signals").alias("by"),
        F.col("margin").alias("confidence"),
    )
    return won.select("dir", "stack", "path", suggestion.alias("suggestion"))


def accepted(suggested: DataFrame, current: DataFrame) -> DataFrame:
    """The marks that taking the suggestion on each ``current (path)`` frame
    comes to, as ``(path, rating)``: the model's one, or all of its stack's,
    the frames kept first.

    ``suggested`` is ``(dir, stack, path, suggestion)``, stack null for none.
    """
    chosen = scale.lookup(suggested, current.select("path", F.lit(True).alias("_chosen")).distinct(), ["path"])
    by_stack = F.col("suggestion.by") == "signals"
    opened = chosen.where(by_stack & F.col("_chosen")).select("dir", "stack", F.lit(True).alias("_any")).distinct()
    found = scale.lookup(chosen, opened, ["dir", "stack"])
    taken = F.when(by_stack, F.col("_any")).otherwise(F.col("_chosen"))
    return found.where(taken).select("dir", "path", F.col("suggestion.rating").alias("rating"))


def accepting_order() -> list[Column]:
    """How accepted marks are made, one after another."""
    return [F.col("dir"), F.desc("rating"), F.col("path")]


def chosen_winners(frames: DataFrame, choices: DataFrame, pick: int = S.PICK) -> DataFrame:
    """The marks that choosing ``choices (path)`` as their stacks' winners
    comes to, ``(dir, path, was, now)``: the winner keeps its stars or is
    picked, the rest of its stack is rejected. Only what changes."""
    stacked = frames.where(F.col("stack").isNotNull())
    chosen = scale.lookup(stacked, choices.select("path", F.lit(True).alias("_chosen")).distinct(), ["path"])
    opened = chosen.where("_chosen").select("dir", "stack").distinct()
    named = scale.lookup(chosen, opened, ["dir", "stack"], "inner")
    now = F.when(F.col("_chosen"), F.when(F.col("rating") > 0, F.col("rating")).otherwise(pick))
    marks = named.select(
        "dir", "path", F.col("rating").alias("was"), F.coalesce(now, F.lit(S.REJECT)).cast("int").alias("now")
    )
    return marks.where(F.col("was") != F.col("now"))


def soft() -> Column:
    """Less sharp than most of what it was shot with."""
    return F.coalesce(F.col("standing.sharp") < vision.SOFT, F.lit(False))
