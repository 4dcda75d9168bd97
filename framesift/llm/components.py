"""Connected components by alternating stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.shared import settled


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links`` (columns ``a``, ``b``, whole
    numbers): the smallest node that links reach.

    Each round ties every node's larger neighbours to its smallest one and then
    its smaller ones, so paths shrink to stars in rounds that grow with the
    logarithm of their length. Rounds' links are tables in the shared folder;
    what ends them are two sums. A node with most links is a grouped minimum,
    combined before the shuffle, and an equi-join that adaptive execution splits.
    """
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    pairs, seen = settled(pairs, "links"), None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["u"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = settled(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "links")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
