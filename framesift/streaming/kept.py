"""A table kept up to date batch by batch, of which a batch reads and writes its own parts alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Kept:
    """Rows in ``parts`` parts by a hash, so that those of a folder are together.

    A batch writes the parts it touches anew under its own number, and which
    batch wrote each part last: at most ``parts`` rows. Nothing is changed in
    place, so a batch delivered again starts from what the one before left,
    and replaces itself. Give as many parts as make one a task's work.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, parts: int = 64):
        self.spark, self.root, self.schema, self.parts = spark, root.rstrip("/"), schema, parts

    def part_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def versions(self, batch_id: int) -> dict[int, int]:
        """Which batch wrote each part last, as of a batch (before the first: none)."""
        if batch_id < 0:
            return {}
        rows = self.spark.read.schema("part int, batch int").parquet(f"{self.root}/versions/{batch_id}").collect()
        return {r.part: r.batch for r in rows}

    def read(self, batch_id: int, parts: Sequence[int] | None = None) -> DataFrame:
        """The rows as they stood after a batch, of all parts or some."""
        held = {p: b for p, b in self.versions(batch_id).items() if parts is None or p in set(parts)}
        if not held:
            return self.spark.createDataFrame([], f"{self.schema}, part int")
        rows = self.spark.read.schema(f"{self.schema}, part int")
        # By batch, each with the parts that it still is the last to have written.
        found = None
        for batch in sorted(set(held.values())):
            mine = rows.parquet(f"{self.root}/rows/{batch}").where(F.col("part").isin([p for p, b in held.items() if b == batch]))
            found = mine if found is None else found.unionByName(mine)
        return found

    def write(self, rows: DataFrame, batch_id: int, touched: Sequence[int]) -> None:
        """The rows (with ``part``) of the parts that a batch touched."""
        rows.hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/rows/{batch_id}")
        versions = {**self.versions(batch_id - 1), **{p: batch_id for p in touched}}
        self.spark.createDataFrame(sorted(versions.items()), "part int, batch int").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/versions/{batch_id}")
