"""Sources mixed to target weights, each document whole and a fixed number of times."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.ranges import ranked
from framesift.llm.shared import settled
from framesift.llm.words import word_count


@dataclass(frozen=True)
class Mix:
    """Sources in order weigh ``weights``, repeating, and share ``share``
    (hundredths) of all words; none gets over ``most`` times its own."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: int = 150
    most: int = 2
    # Seeds a source's draw is chosen from.
    seeds: int = 32


RANGE = 2**32
STEP = 2654435769  # odd, so that every seed turns a hash to another place


def draw(doc_id: Column, seed: Column) -> Column:
    """A number under 2^32 that doc_id's hash and a seed give, uniform over documents for each seed."""
    first = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10)
    return F.pmod(first.cast("long") + seed.cast("long") * STEP, F.lit(RANGE))


def targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``source, source_size`` with each source's ``target``.

    Sources are ordered by code point with null last. Every source gets its
    weight times one level, or its most if that is less; the level starts
    where nothing is held back and rises while sources reach their most, each
    round a sum over the sources that gives three whole numbers. There are no
    more rounds than sources, as each but the last adds one that's full.
    """
    order = [F.col("source").isNull().cast("int"), F.col("source")]
    weight = F.element_at(
        F.array(*[F.lit(w) for w in mix.weights]), (F.pmod("_rank", F.lit(len(mix.weights))) + 1).cast("int"))
    weighed = settled(ranked(sources, order, "_rank").select(
        "source", "source_size", weight.cast("long").alias("_weight")), "weights")
    most = (F.lit(mix.most) * F.col("source_size")).cast("double")
    level = 0.0
    while True:
        full = most <= F.col("_weight") * F.lit(level) if level else F.lit(False)
        total, held, free = weighed.agg(
            F.sum("source_size"), F.sum(F.when(full, F.lit(mix.most) * F.col("source_size")).otherwise(0)),
            F.sum(F.when(~full, F.col("_weight")).otherwise(0))).first()
        if not free:
            break
        raised = (total * mix.share / 100 - held) / free
        if raised == level:
            break
        level = raised
    return weighed.select("source", "source_size", F.least(most, F.col("_weight") * F.lit(level)).alias("target"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
          mix: Mix = Mix(), drawn_by: str | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken``, a row for each document.

    A document is taken floor(rate) times, the rate being its source's target
    by size, and once more where its draw is under the rest of the rate. Each
    source draws with that one of ``mix.seeds`` seeds whose taken words come
    nearest to its target: all seeds' words are added up in the same pass.
    Draws depend on the id alone (or the column ``drawn_by``), so reruns agree.

    A null or empty text has size 0; sources of size 0 have target 0 and no
    copies. A null source is one of its own, last in order. Rows repeated or
    without an id are mixed each by itself (equal ids draw alike). Other
    columns are left out whatever they're called; an empty table gives none.

    Sizes are written once without texts; sums by source are combined before
    the shuffle, so a hot source costs no more, and sources come back to
    documents by an equi-join that adaptive execution splits.
    """
    sized = settled(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.col(drawn_by or doc_id).alias("_by")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rated = targets(sources, mix).withColumn(
        "_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rated = rated.select(
        F.col("source").alias("_source"), "source_size", "target", F.floor("_rate").alias("_whole"),
        F.floor((F.col("_rate") - F.floor("_rate")) * RANGE).alias("_part"))
    rated = settled(rated, "rates")
    joined = sized.join(rated, F.col("source").eqNullSafe(F.col("_source")))
    once = [
        F.sum(F.when(draw(F.col("_by"), F.lit(s)) < F.col("_part"), F.col("size")).otherwise(0)).alias(f"s{s}")
        for s in range(mix.seeds)
    ]
    drawn = joined.groupBy("_source").agg(
        F.first("_whole").alias("_w"), F.first("source_size").alias("_n"), F.first("target").alias("_t"), *once)
    away = F.array(*[
        F.struct(F.abs(F.col("_w") * F.col("_n") + F.col(f"s{s}") - F.col("_t")).alias("away"), F.lit(s).alias("seed"))
        for s in range(mix.seeds)])
    seeds = drawn.select(F.col("_source").alias("_of"), F.array_min(away)["seed"].alias("_seed"))
    copies = F.col("_whole") + (draw(F.col("_by"), F.col("_seed")) < F.col("_part")).cast("long")
    return (
        sized.join(rated.join(seeds, F.col("_source").eqNullSafe(F.col("_of"))),
                   F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                (copies * F.col("size")).alias("taken"))
    )
