"""Frames as they arrive: folders filling up, measures coming in, bursts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from framesift.functions import predicates, scalars
from framesift.operators import assemble, counts
from framesift.operators.stacks import GAP
from framesift.sources import listing, shared
from framesift.sources.shared import settled
from framesift.streaming.kept import Kept


@contextmanager
def named_only(spark: SparkSession) -> Iterator[None]:
    """The session's settings while a stream runs that reads files' names alone.
    The names known are kept on disk. Where Spark lists the files (see
    :func:`arriving`), it lists a batch's once more with a task a file, and reads
    them with a task for every few, as if each were opened; here the one takes as
    many tasks as a shuffle has, the other one for some two thousand files."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": spark.conf.get("spark.sql.shuffle.partitions"),
        "spark.sql.files.openCostInBytes": "64k",
    }
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _mounted(spark: SparkSession, root: str) -> str | None:
    """The path of a folder that tasks can list; None for one in a store that only Spark reaches."""
    scheme, found, _ = root.partition(":/")
    if not found or "/" in scheme:
        home = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:"
        return root if home.startswith("file:") else None
    return "/" + root[len("file:") :].lstrip("/") if scheme == "file" else None


def arriving(spark: SparkSession, root: str, files_per_batch: int = 10_000, kept: str | None = None) -> DataFrame:
    """The pictures under a path as they appear, ``(dir, path, name, kind,
    length, modified)``, each path once. Only their names are read, so run it in
    :func:`named_only` where they are many. Names that start with ``_`` aren't
    seen, as by Spark's file source.

    A folder mounted on every machine is listed by tasks with every batch, and
    names known from before left out by a stream's state, which lies on the
    executors; the driver holds no names. So give the stream an interval to be
    triggered at. A batch has all that is new. ``kept`` is a mounted folder of
    this stream's own where a batch's names stay until it's done; a stream that
    goes on from its checkpoint in another session names the same one again.

    Other stores, and patterns of paths, are listed by Spark's file source,
    ``files_per_batch`` at once, which keeps all names it has seen in the driver.
    """
    folder = None if any(c in root for c in "*?[{") else _mounted(spark, root)
    if folder is not None:
        kept = _mounted(spark, kept or shared.folder(spark, "arrivals"))
        if kept is None:
            raise ValueError("kept must name a folder mounted on every machine")
        return assemble.pictures(listing.arrivals(spark, folder, kept)).dropDuplicates(["path"])
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(root)
    )
    path = F.regexp_replace("path", "^file:(//)?", "")
    named = files.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"))
    return assemble.pictures(
        named.withColumns(
            {"parent": scalars.parent("path"), "name": scalars.base_name("path"), "is_dir": F.lit(False)}
        )
    )


def bursts(captures: DataFrame, gap: float = GAP, late: str = "1 minute", *keys: str) -> DataFrame:
    """Bursts of captures ``(dir, ts)`` as they close, ``(dir, start, end,
    frames)``. By time, not by name; a frame later than ``late`` is dropped."""
    keys = keys or ("dir",)
    session = F.session_window("ts", f"{gap} seconds")
    grouped = captures.withWatermark("ts", late).groupBy(*keys, session.alias("_burst"))
    return (
        grouped.agg(F.count(F.lit(1)).alias("frames"), F.min("ts").alias("start"), F.max("ts").alias("end"))
        .where(F.col("frames") > 1)
        .select(*keys, "start", "end", "frames")
    )


class LiveSearch:
    """How many frames a search lets through, kept as measures come in.

    Frames are kept in parts by folder with whether the search lets them
    through; a batch of measures looks at the frames it measures, in their
    parts, and changes the counters by what became of them.
    """

    def __init__(self, frames: DataFrame, terms: Sequence[tuple], root: str, parts: int = 64):
        """``frames`` as they were before the first measure; they're written in parts once."""
        self.spark, self.root = frames.sparkSession, root.rstrip("/")
        self.condition, self.measuring = predicates.search(terms), predicates.needs_measuring(terms)
        self.fields = [c for c in frames.columns if c != "signals"]
        self.frames = Kept(self.spark, f"{self.root}/frames", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema), parts)
        self.base = frames.withColumn("part", self.frames.part_of(F.col("dir")))

    def counters(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/counters/{batch_id}")

    def _begin(self) -> None:
        """What there is before the first batch, as batch 0."""
        self.frames.write(self.base, 0, range(self.frames.parts))
        counts.matching(self.frames.read(0), self.condition, self.measuring).write.mode("overwrite").parquet(f"{self.root}/counters/0")

    def take(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Take in measures ``(path, signals)``; the counters after them. A batch delivered again replaces itself."""
        at = batch_id + 1  # 0 is what there was before
        if batch_id == 0:
            self._begin()
        last = batch.withColumn("_order", F.monotonically_increasing_id()).groupBy("path").agg(F.max_by("signals", "_order").alias("_new"))
        last = settled(last.withColumn("part", self.frames.part_of(scalars.parent("path"))))
        touched = sorted(r.part for r in last.select("part").distinct().collect())  # at most so many as there are parts
        held = self.frames.read(at - 1, touched)
        both = settled(held.join(last.drop("part"), "path", "left").withColumn("_hit", F.col("_new").isNotNull()))
        was = both.where("_hit").drop("_new", "_hit")
        now = both.where("_hit").withColumn("signals", F.col("_new")).drop("_new", "_hit")
        names = ["matching", "total", "unmeasured"]
        moved = counts.matching(now, self.condition, self.measuring).unionByName(
            counts.matching(was, self.condition, self.measuring).select(*((-F.col(c)).alias(c) for c in names)))
        self.counters(at - 1).unionByName(moved).agg(*(F.sum(c).cast("bigint").alias(c) for c in names)).write.mode("overwrite").parquet(
            f"{self.root}/counters/{at}")
        self.frames.write(both.withColumn("signals", F.coalesce("_new", "signals")).select(*held.columns), at, touched)
        return self.counters(at)


def search_filling_in(
    signals: DataFrame, search: LiveSearch, checkpoint: str, publish: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """As measures ``(path, signals)`` stream in, publish how many frames a
    search lets through so far, and how many it can't be answered for yet."""

    def each(batch: DataFrame, batch_id: int) -> None:
        publish(search.take(batch, batch_id), batch_id)

    return (
        signals.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
