"""The decision log as it grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from framesift.functions import scalars
from framesift.functions.scalars import bind
from framesift.operators import counts
from framesift.sources.shared import settled
from framesift.streaming.kept import Kept


def deduplicated(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """A row a mark, however often it is delivered. ``log`` has ``ts``."""
    named = log.withColumn("path", F.col("file.path"))
    return named.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "path", "at"])


def live_marks(log: DataFrame) -> DataFrame:
    """Each file's mark as it stands, ``(path, rating, at)``, for update mode.
    ``log`` has ``seq``, or rows made in the same millisecond are told apart by
    their rating alone."""
    seq = F.col("seq") if "seq" in log.columns else F.struct("at", "rating")
    return log.groupBy(F.col("file.path").alias("path")).agg(
        F.max_by("rating", seq).alias("rating"), F.max("at").alias("at")
    )


class LiveCounts:
    """Each file's last mark and each folder's counts, kept batch by batch.

    A batch takes the marks it replaces out of its folders' counts and puts its
    own in. It reads and writes the parts that its folders are in, and no
    others: at most ``parts`` of each table, however long the log.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        self.marks = Kept(spark, f"{root}/marks", "path string, dir string, rating int, seq struct<at: bigint, batch: int, made: struct<at: bigint, batch: bigint, line: bigint>>", parts)
        self.counts = Kept(spark, f"{root}/counts", f"dir string, {', '.join(f'{c} bigint' for c in counts.COUNTED)}", parts)

    def read(self, batch_id: int) -> DataFrame:
        """Every folder's counts after a batch."""
        return self.counts.read(batch_id).drop("part")

    def take(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Take in a batch; the counts of the folders it changed. One delivered
        again replaces itself."""
        made = "seq" if "seq" in batch.columns else "at"
        if not isinstance(batch.schema[made].dataType, StructType):  # a number orders as the log's own order does
            batch = batch.withColumn("seq", F.struct("at", F.lit(0).cast("bigint"), F.col(made).cast("bigint")))
        named = batch.select(
            F.col("file.path").alias("path"), scalars.parent("file.path").alias("dir"), F.col("rating").cast("int").alias("rating"),
            F.struct("at", F.lit(batch_id).alias("batch"), F.col("seq").cast("struct<at: bigint, batch: bigint, line: bigint>").alias("made")).alias("seq"))
        new = named.groupBy("path", "dir").agg(F.max_by("rating", "seq").alias("rating"), F.max("seq").alias("seq"))
        new = settled(new.withColumn("part", self.marks.part_of(F.col("dir"))))
        touched = sorted(r.part for r in new.select("part").distinct().collect())  # at most so many as there are parts
        old = self.marks.read(batch_id - 1, touched)
        before = old.select("path", F.col("rating").alias("_rating"), F.col("seq").alias("_seq"))
        changed = new.join(before, "path", "left").where("_seq IS NULL OR seq > _seq")
        changed = settled(changed.select("path", "dir", "rating", "seq", "part", "_rating", F.col("_seq").isNull().alias("_fresh")))
        in_, out = counts.counts(changed, "dir"), counts.counts(changed.where("NOT _fresh").withColumn("rating", F.col("_rating")), "dir")
        moved = in_.unionByName(out.select("dir", *((-F.col(c)).alias(c) for c in counts.COUNTED)))
        held = self.counts.read(batch_id - 1, touched)
        kept = held.drop("part").unionByName(moved).groupBy("dir").agg(*(F.sum(c).cast("bigint").alias(c) for c in counts.COUNTED))
        self.counts.write(kept.withColumn("part", self.counts.part_of(F.col("dir"))), batch_id, touched)
        rest = old.join(changed.select("path"), "path", "left_anti")
        self.marks.write(rest.unionByName(changed.select("path", "dir", "rating", "seq", "part")), batch_id, touched)
        return self.counts.read(batch_id, touched).drop("part").join(changed.select("dir").distinct(), "dir", "left_semi")


def live_counts(
    log: DataFrame, table: LiveCounts, checkpoint: str, publish: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Keep the counts current and publish, after every batch, those of the folders it changed."""

    def each(batch: DataFrame, batch_id: int) -> None:
        publish(table.take(batch, batch_id), batch_id)

    return (
        log.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def passed(
    views: DataFrame, log: DataFrame, idle: str = "30 minutes", late: str = "5 minutes", ratings: DataFrame | None = None
) -> DataFrame:
    """The frames passed over, given out when their folder is left: when
    nothing has been seen or marked in it for ``idle``.

    ``views`` is ``(session, dir, path, ts)``; ``log`` has ``ts``. What frames
    held before the stream began is in ``ratings`` ``(path, rating)``, a table
    that's joined to each batch: a frame with a rating isn't passed over. Only
    what the watermark has closed comes out; the sittings still open at the
    end are those the batch operator gives besides. Kept of a folder until then are
    its frames seen and its marks.
    """
    # Marks of one time stand in the log's order, if it tells.
    seq = F.col("seq") if "seq" in log.columns else F.unix_millis("ts")
    marked = log.where(F.col("how") != "pass").select(
        "session", scalars.parent("file.path").alias("dir"), F.col("file.path").alias("path"), seq.alias("made"),
        F.col("rating").cast("int").alias("rating"), "ts",
    )
    if ratings is None:
        views = views.withColumn("rating", F.lit(0))
    else:
        held = ratings.select("path", F.coalesce(F.col("rating").cast("int"), F.lit(0)).alias("rating"))
        views = views.join(held, "path", "left").withColumn("rating", F.coalesce("rating", F.lit(0)))
    seen = views.select("session", "dir", "path", F.lit(None).cast(marked.schema["made"].dataType).alias("made"), "rating", "ts")
    both = seen.unionByName(marked).withWatermark("ts", late)
    visits = both.groupBy("session", "dir", F.session_window("ts", idle).alias("_visit")).agg(
        F.max(F.col("made").isNotNull()).alias("_marked"), F.collect_set(F.struct("path", "made", "rating")).alias("_frames"))
    # What was only seen sorts before marks: the last of a path tells what it came to.
    left = bind(F.array_sort("_frames"), lambda frames: F.filter(
        frames, lambda f, i: (f["rating"] == 0) & ~F.get(frames, i + 1)["path"].eqNullSafe(f["path"])))
    return visits.where("_marked").select("session", "dir", F.explode(left).alias("_f")).select("session", "dir", "_f.path")
