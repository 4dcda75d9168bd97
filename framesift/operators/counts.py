"""Where a cull stands: counts, shares and profiles, per folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift import scale
from framesift import schema as S
from framesift.functions import scalars


COUNTED = ["picks", "rejects", "undecided", *(f"stars_{n}" for n in range(1, S.STARS + 1)), "total"]


def _count(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def counts(frames: DataFrame, *by: str) -> DataFrame:
    """Picks (1 and up), rejects, undecided, and each number of stars."""
    rating = F.col("rating")
    return frames.groupBy(*by).agg(
        _count(rating >= S.PICK).alias("picks"),
        _count(rating == S.REJECT).alias("rejects"),
        _count(rating == S.UNDECIDED).alias("undecided"),
        *(_count(rating == n).alias(f"stars_{n}") for n in range(1, S.STARS + 1)),
        F.count(F.lit(1)).alias("total"),
    )


def summary(frames: DataFrame, *by: str) -> DataFrame:
    """The counts as rows ``(by…, line, label, n, percent)``, in the order
    they're shown."""
    labels = ["picks", *(f"stars_{n}" for n in range(S.STARS, 0, -1)), "rejects", "undecided", "total"]
    lines = F.array(
        *(
            F.struct(F.lit(i).alias("line"), F.lit(label).alias("label"), F.col(label).alias("n"))
            for i, label in enumerate(labels)
        )
    )
    rows = counts(frames, *by).select(*by, "total", F.inline(lines))
    return rows.select(*by, "line", "label", "n", scalars.percent("n", "total").alias("percent"))


def kinds_held(frames: DataFrame, formats: str = "all") -> DataFrame:
    """Per folder, how many of each kind it holds, the ``choices`` of format
    there are (none where it holds one kind), and how many pictures asking for
    ``formats`` leaves out."""
    held = frames.groupBy("dir").agg(
        *(_count(F.col("kind") == k).alias(k) for k in S.KINDS), F.count(F.lit(1)).alias("total")
    )
    offered = F.array_compact(F.array(F.lit("all"), *(F.when(F.col(k) > 0, k) for k in S.KINDS)))
    choices = F.when(F.size(offered) > 2, offered).otherwise(F.array().cast("array<string>"))
    left_out = F.lit(0).cast("bigint")
    if formats != "all":
        left_out = F.when(F.col(formats) > 0, F.col("total") - F.col(formats)).otherwise(left_out)
    return held.select("dir", *S.KINDS, choices.alias("choices"), left_out.alias("left_out"))


def folders(listing: DataFrame) -> DataFrame:
    """Each folder listed (hidden ones left out) with the pictures directly in
    it and whether it has folders of its own: ``(parent, path, name, pictures,
    nested)``."""
    shown = ~scalars.hidden("name")
    inside = listing.groupBy(F.col("parent").alias("_inside")).agg(
        _count(~F.col("is_dir") & shown & scalars.kind("name").isNotNull()).alias("pictures"),
        F.bool_or(F.col("is_dir") & shown).alias("nested"),
    )
    own = listing.where(F.col("is_dir") & shown).select("parent", "path", "name")
    joined = scale.lookup(own, inside.withColumnRenamed("_inside", "path"), ["path"])
    return joined.select(
        "parent", "path", "name",
        F.coalesce("pictures", F.lit(0)).cast("bigint").alias("pictures"),
        F.coalesce("nested", F.lit(False)).alias("nested"),
    )


def matching(frames: DataFrame, condition: Column, measuring: bool, *by: str) -> DataFrame:
    """How many frames a search lets through, of how many, and how many it
    can't be answered for yet (if it asks about what's ``measured``)."""
    waiting = _count(F.col("signals").isNull()) if measuring else F.lit(0).cast("bigint")
    return frames.groupBy(*by).agg(
        _count(condition).alias("matching"), F.count(F.lit(1)).alias("total"), waiting.alias("unmeasured")
    )


def first_undecided(frames: DataFrame, *by: str) -> DataFrame:
    undecided = F.when(F.col("rating") == S.UNDECIDED, F.col("path"))
    return frames.groupBy(*by).agg(F.min(undecided).alias("first_undecided"))


def shoot_profile(captures: DataFrame, *by: str) -> DataFrame:
    """Frames by the sizes of what they embed, with how many recorded where
    they focused, how many are Adobe RGB, and their mean embedded bytes."""
    sizes = F.array_join(
        F.transform("embedded", lambda e: F.concat_ws("x", e["w"].cast("string"), e["h"].cast("string"))), ", "
    )
    largest = F.aggregate("embedded", F.lit(0).cast("bigint"), lambda m, e: F.greatest(m, e["len"]))
    focused = (F.col("focus.w") > 0) & (F.col("focus.h") > 0)
    return captures.groupBy(*by, sizes.alias("sizes")).agg(
        F.count(F.lit(1)).alias("frames"),
        _count(focused).alias("focused"),
        _count(scalars.adobe_rgb("color_space", "interop")).alias("adobe_rgb"),
        F.avg(largest).alias("mean_bytes"),
    )
