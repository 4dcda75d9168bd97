"""A manifest of a table as Merkle trees whose nodes are found by their digests.

Rows' digests are the leaves. Each part of the table (rows that agree in one
column) is a tree of its own, and the parts' roots are the leaves of the tree
that gives the table's root. Of a node only its children's digests are stored,
under its own digest; where a row lies is told by its rank alone, whose digits
in the trees' width say which child to take on the way down from the root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.ranges import before
from framesift.llm.shared import settled
from framesift.sources.shared import folder

SEGMENT = "array<struct<digit: int, others: array<binary>>>"
RECORD = "digest binary, children array<binary>"


def hashed(*values: Column) -> Column:
    """The SHA-256 of strings put one after another, as bytes."""
    return F.unhex(F.sha2(F.concat(*values), 256))


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def listed(digests: Column) -> Column:
    return F.array_join(F.transform(digests, shown), "")


def row_digest(*values: Column) -> Column:
    """The digest of a row: each value as its length in bytes, ``:`` and itself, ``-`` if it is null."""
    texts = [v.cast("string") for v in values]
    return hashed(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def numbered(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """The rows with ``part_number``, ``rank`` (in the part, from 0) and ``part_rows``.

    Parts come in the order of column ``part``, nulls first, and so do rows by
    ``order``. Rows are sorted over ranges, so a part with most rows lies in
    many tasks; ranks are places in a range plus what the ranges before hold.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (part, *order)]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(
        rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
        .withColumns({"_block": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranged")
    # A row for each part in each range: few, whatever the rows.
    found = settled(ranged.groupBy("_block", F.col(part).alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")), "parts")
    same = Window.partitionBy("_part")
    found = found.withColumns({
        "_before": F.sum("_n").over(same.orderBy("_block")) - F.col("_n"), "part_rows": F.sum("_n").over(same),
        "_new": (F.col("_block") == F.min("_block").over(same)).cast("long")})
    starts = before(found.groupBy("_block").agg(F.sum("_new").alias("_new")), "_block", "_new").withColumnRenamed("_before", "_parts")
    found = found.join(starts, F.col("_block") == F.col("_of")).withColumn(
        "part_number", F.sum("_new").over(Window.partitionBy("_block").orderBy("_first")) - 1 + F.col("_parts"))
    found = found.select(F.col("_block").alias("_of"), "_part", "_first", "_before", "part_rows", "part_number")
    return (
        ranged.join(found, (F.col("_block") == F.col("_of")) & F.col(part).eqNullSafe(F.col("_part")))
        .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_block", "_of", "_at", "_part", "_first", "_before"))


@dataclass(frozen=True)
class Trees:
    """Trees whose records lie in a folder by level, the first over the leaves."""

    records: str
    height: int
    roots: DataFrame  # part_number, part_rows, height, digest

    def level(self, k: int) -> DataFrame:
        """``digest, children`` of a level's nodes, equal ones once."""
        return self.roots.sparkSession.read.schema(RECORD).parquet(f"{self.records}/level={k}").dropDuplicates(["digest"])


def grown(leaves: DataFrame, width: int) -> Trees:
    """The trees over ``part_number, part_rows, rank, digest``: every ``width``
    consecutive nodes of a part, the last ones maybe fewer, have one parent,
    until one is left. A level is one grouping of at most ``width`` rows a
    group, and a table."""
    spark, path = leaves.sparkSession, folder(leaves.sparkSession, "records")
    nodes, height = leaves.select("part_number", "part_rows", "rank", "digest"), 0
    # Nodes a part has on a level; a part with one is done.
    roots = nodes.where("part_rows = 1").withColumn("height", F.lit(0))
    nodes, most = nodes.where("part_rows > 1"), leaves.agg(F.max("part_rows")).first()[0] or 0
    while most > 1:
        height, most = height + 1, -(-most // width)
        nodes.groupBy("part_number", "part_rows", F.expr(f"rank div {width}").alias("rank")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("children")
        ).withColumn("digest", hashed(listed(F.col("children")))).write.parquet(f"{path}/level={height}")
        made = spark.read.schema("part_number long, part_rows long, rank long, digest binary").parquet(f"{path}/level={height}")
        one = F.col("part_rows") <= width**height
        roots = roots.union(made.where(one).withColumn("height", F.lit(height)))
        nodes = made.where(~one)
    return Trees(path, height, settled(roots.select("part_number", "part_rows", "height", "digest"), "roots"))


def met(rows: DataFrame, others: DataFrame, on: str | list[str]) -> DataFrame:
    """The join of tables that grow with the leaves. Spark takes paths for much
    smaller than they are (siblings are one digest long to it), and would send
    them to all tasks by way of the driver; merged, neither side is held whole."""
    return rows.join(others.hint("merge"), on)


def below(frontier: DataFrame, records: DataFrame, width: int) -> DataFrame:
    """The children of nodes ``part_number, rank, digest, path``, each with its siblings on its path."""
    return met(frontier, records, "digest").select(
        "part_number", "rank", "path", "subroot", "children", F.posexplode("children").alias("digit", "digest")
    ).select("part_number", (F.col("rank") * width + F.col("digit")).alias("rank"), "digest", "subroot", path_with("digit").alias("path"))


def path_with(digit: str) -> Column:
    others = F.filter("children", lambda _, at: at != F.col(digit))
    return F.concat("path", F.array(F.struct(F.col(digit).cast("int").alias("digit"), others.alias("others"))))


@dataclass(frozen=True)
class Manifest:
    """A table's leaves, numbered, and the trees over them."""

    leaves: DataFrame
    parts: Trees
    top: Trees
    width: int
    root: bytes | None

    def proofs(self, requests: DataFrame | None = None) -> DataFrame:
        """The leaves with ``subroot`` and ``path``: for each level from the leaf
        to the root ``digit`` (the place among its siblings) and ``others`` (their digests).

        ``requests`` has the rows wanted, as ``part_number, rank``; every leaf
        without it. Only nodes above wanted leaves are gone down to. Way down,
        a node is one row however many leaves below are wanted, and leaves meet
        the paths of their parents in the last join, after which nothing is
        shuffled.
        """
        wanted = self.leaves if requests is None else self.leaves.join(
            requests.select("part_number", "rank").distinct(), ["part_number", "rank"], "left_semi").select(self.leaves.columns)
        spark, width = self.leaves.sparkSession, self.width
        at = spark.range(1 if self.root is not None else 0).select(
            F.lit(0).cast("long").alias("part_number"), F.lit(0).cast("long").alias("rank"), F.lit(self.root).cast("binary").alias("digest"),
            F.lit(None).cast("binary").alias("subroot"), F.array().cast(SEGMENT).alias("path"))
        for k in range(self.top.height, 0, -1):
            at = below(at, self.top.level(k), width)
            if requests is not None:
                at = at.join(wanted.select(F.expr(f"part_number div {width ** (k - 1)}").alias("rank")).distinct(), "rank", "left_semi")
        starts = settled(met(
            at.select(F.col("rank").alias("part_number"), F.lit(0).cast("long").alias("rank"), "digest", F.col("digest").alias("subroot"), "path"),
            self.parts.roots.select("part_number", "height"), "part_number"), "starts")
        at = starts.where(f"height = {self.parts.height}").drop("height")
        for k in range(self.parts.height, 1, -1):
            at = below(at, self.parts.level(k), width)
            if requests is not None:
                above = wanted.select("part_number", F.expr(f"rank div {width ** (k - 1)}").alias("rank")).distinct()
                at = at.join(above, ["part_number", "rank"], "left_semi")
            at = at.unionByName(starts.where(f"height = {k - 1}").drop("height"))
        alone = starts.where("height = 0").select("part_number", "subroot", "path")
        out = met(wanted.where("part_rows = 1"), alone, "part_number")
        if self.parts.height:
            parents = met(at, self.parts.level(1), "digest").select(
                "part_number", F.col("rank").alias("_parent"), "subroot", "path", "children")
            found = wanted.where("part_rows > 1").withColumns({"_parent": F.expr(f"rank div {width}"), "_digit": F.col("rank") % width})
            found = met(found, parents, ["part_number", "_parent"]).withColumn("path", path_with("_digit"))
            out = out.unionByName(found.select(out.columns))
        return out.withColumn("path", F.reverse("path"))


def manifest(leaves: DataFrame, part: str, order: list[str], width: int = 8) -> Manifest:
    """The manifest of ``leaves``: rows with their digest as ``digest`` (bytes).

    Rows with null in ``part`` are a part, the first; nulls in ``order`` come
    first. Rows that tie in ``order`` are put by digest, and equal rows are
    leaves of their own. Other columns are kept; they mustn't be called
    ``part_number``, ``part_rows``, ``rank``, ``subroot``, ``path`` or begin
    with ``_``. Long texts are hashed where they lie; an empty table has no
    root and no proofs.
    """
    known = settled(numbered(settled(leaves, "digests"), part, [*order, "digest"]), "leaves")
    parts = grown(known, width)
    count = parts.roots.count()
    top = grown(parts.roots.select(
        F.lit(0).cast("long").alias("part_number"), F.lit(count).cast("long").alias("part_rows"), F.col("part_number").alias("rank"), "digest"), width)
    root = top.roots.first()
    return Manifest(known, parts, top, width, bytes(root.digest) if root else None)


def siblings(path: Column) -> Column:
    """The siblings on a path, level by level, as one string."""
    return F.array_join(F.transform(path, lambda s: listed(s["others"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, digest, lambda d, s: hashed(
        listed(F.slice(s["others"], F.lit(1), s["digit"])), shown(d),
        listed(F.slice(s["others"], s["digit"] + 1, F.size(s["others"])))))
