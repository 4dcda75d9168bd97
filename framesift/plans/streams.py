"""Streams run to their end over the tables, against the batch answer; and
files written from the tables and read again."""

from __future__ import annotations

import os
import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import scalars
from framesift.operators import assemble, counts
from framesift.plans import adapters as A
from framesift.plans.registry import query
from framesift.sources import journal as log_files
from framesift.sources import listing, pictures
from framesift.streaming import folders
from framesift.streaming import journal as live

LOG = f"WITH {A.DECISIONS_SQL}"


def _log_folder(spark: SparkSession, sf: str) -> str:
    """The log as files of JSON lines."""
    folder = A.scratch(spark, "log")
    log_files.append(A.decisions(spark, sf), folder, order="seq")
    return folder


def _drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A stream's whole output, by way of files in the shared folder."""
    spark = stream.sparkSession
    out = A.scratch(spark, name)
    query_ = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", A.scratch(spark, f"{name}-state"))
        .trigger(availableNow=True)
        .start(out)
    )
    query_.awaitTermination()
    if query_.exception():
        raise query_.exception()
    return spark.read.schema(stream.schema).parquet(out)


@query(
    "stream_deduplicated",
    f"""{LOG} SELECT DISTINCT session, path, made AS "at" FROM decisions WHERE was <> rating OR how = 'pass'""",
)
def stream_deduplicated(spark, sf):
    # The log delivered twice over.
    folder = _log_folder(spark, sf)
    log_files.append(A.decisions(spark, sf), folder, order="seq")
    rows = live.deduplicated(log_files.read_stream(spark, folder), "60 days")
    return _drained(rows.select("session", "path", "at"), "dedup")


@query(
    "stream_last_marks",
    f"""{LOG} SELECT path, arg_max(rating, (made, seq)) AS rating, max(made) AS "at" FROM decisions
    WHERE was <> rating OR how = 'pass' GROUP BY path""",
)
def stream_last_marks(spark, sf):
    marks = live.live_marks(log_files.read_stream(spark, _log_folder(spark, sf), 2))
    out = A.scratch(spark, "marks")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query_ = (
        marks.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", A.scratch(spark, "marks-state")).trigger(availableNow=True).start()
    )
    query_.awaitTermination()
    return spark.read.parquet(out).groupBy("path").agg(F.max_by("rating", "batch").alias("rating"), F.max("at").alias("at"))


@query(
    "stream_counts",
    f"""{LOG}, last AS (
      SELECT dir, path, arg_max(rating, (made, seq)) AS rating FROM decisions WHERE was <> rating OR how = 'pass' GROUP BY ALL
    ) SELECT dir, count(*) FILTER (rating >= 1) AS picks, count(*) FILTER (rating = -1) AS rejects,
      count(*) FILTER (rating = 0) AS undecided, count(*) AS total FROM last GROUP BY dir""",
)
def stream_counts(spark, sf):
    last: list[int] = []
    table = live.LiveCounts(spark, A.scratch(spark, "live-counts"), parts=8)
    stream = log_files.read_stream(spark, _log_folder(spark, sf), 2)
    live.live_counts(stream, table, A.scratch(spark, "counts-state"), lambda _, batch_id: last.append(batch_id)).awaitTermination()
    return table.read(last[-1]).select("dir", "picks", "rejects", "undecided", "total")


@query(
    "stream_search",
    f"""WITH {A.FRAMES_SQL} SELECT count(*) FILTER (coalesce(focus > 100 AND open >= 0.3, false)) AS matching,
      count(*) AS total, count(*) FILTER (NOT measured) AS unmeasured FROM frames""",
)
def stream_search(spark, sf):
    frames = A.frames(spark, sf).withColumn("stack", F.lit(None).cast("string"))
    source = A.scratch(spark, "measured")
    measured = frames.where(F.col("signals").isNotNull()).select("path", "signals")
    measured.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(measured.schema).option("maxFilesPerTrigger", 2).parquet(source)
    last: list[DataFrame] = []
    before = frames.withColumn("signals", F.lit(None).cast(measured.schema["signals"].dataType))
    search = folders.LiveSearch(before, [("focus", ">", 100), ("shut", None, "no")], A.scratch(spark, "live-search"), parts=8)
    folders.search_filling_in(stream, search, A.scratch(spark, "search-state"), lambda found, _: last.append(found)).awaitTermination()
    return last[-1]


_BURST_FOLDERS = """WITH gaps AS (
  SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 7200000000, true) AS starts
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), runs AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM gaps)"""


@query(
    "stream_bursts",
    f"""{_BURST_FOLDERS}, bursts AS (
      SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS frames FROM runs GROUP BY user_id, run
    ) SELECT user_id, start_us, end_us, frames FROM bursts
    WHERE frames > 1 AND end_us + 7200000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 60000000""",
)
def stream_bursts(spark, sf):
    events = A.table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    captures = stream.select("user_id", A.utc("ts").alias("ts"))
    bursts = folders.bursts(captures, A.GAP, "1 minute", "user_id")
    closed = _drained(bursts, "bursts")
    return closed.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "frames")


@query(
    "stream_passed",
    f"""{LOG}, marked AS (SELECT * FROM decisions WHERE how <> 'pass' AND was <> rating),
    last AS (SELECT session, path, arg_max(rating, (made, seq)) AS rating FROM marked GROUP BY ALL),
    ends AS (SELECT session, dir, max(made) AS made FROM decisions GROUP BY ALL)
    SELECT DISTINCT d.session, d.dir, d.path FROM decisions d SEMI JOIN marked m ON m.session = d.session AND m.dir = d.dir
      LEFT JOIN last l ON l.session = d.session AND l.path = d.path JOIN ends e ON e.session = d.session AND e.dir = d.dir
    WHERE coalesce(l.rating, CASE WHEN d.path LIKE '%7.%' THEN 5 END, 0) = 0 AND e.made + 172800000 <= (SELECT max(made) FROM decisions) - 300000""",
)
def stream_passed(spark, sf):
    # A sitting is a day here, and its folder left after two.
    log = log_files.read_stream(spark, _log_folder(spark, sf))
    source = A.scratch(spark, "views")
    views = A.views(spark, sf)
    views.write.parquet(source)
    seen = spark.readStream.schema(views.schema).parquet(source)
    # Open sittings are kept on disk.
    key, held = "spark.sql.streaming.stateStore.providerClass", "RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, f"org.apache.spark.sql.execution.streaming.state.{held}")
    try:
        # Frames whose number ends in 7 had five stars from an earlier day.
        held = views.where(F.col("path").like("%7.%")).select("path", F.lit(5).alias("rating")).distinct()
        return _drained(live.passed(seen, log, "2 days", ratings=held), "passed")
    finally:
        spark.conf.set(key, before)


# -- files ---------------------------------------------------------------------


def _write_files(batches):
    """One small file a row of ``(path, data)``, in its own folder."""
    import pyarrow as pa

    made = set()
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (folder := os.path.dirname(path)) not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(folder)
            with open(path, "wb") as file:
                file.write(data)
        yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})


def _written(files: DataFrame) -> None:
    """Every ``(path, data)`` written, dealt over tasks: a table's few splits may
    hold a great many rows."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files.repartition(parts, "path").mapInArrow(_write_files, "n long").agg(F.sum("n")).collect()


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    suffix = F.when(key % 3 == 0, ".ARW").when(key % 3 == 1, ".jpeg").otherwise(".txt")
    hidden = F.when(key % 10 == 0, ".").otherwise(F.when(key % 10 == 1, "_").otherwise(""))
    name = F.concat(hidden, F.lit("DSC"), key.cast("string"), suffix)
    return A.table(spark, sf, "customer").select(
        F.col("c_nationkey").cast("string").alias("folder"), name.alias("name"), (key % 6 - 1).cast("int").alias("rating")
    )


@query(
    "opened_folders",
    """WITH named AS (
      SELECT c_nationkey, CASE c_custkey % 10 WHEN 0 THEN '.' WHEN 1 THEN '_' ELSE '' END || 'DSC' || c_custkey
        || CASE c_custkey % 3 WHEN 0 THEN '.ARW' WHEN 1 THEN '.jpeg' ELSE '.txt' END AS name, c_custkey % 6 - 1 AS rating FROM customer
    ) SELECT CAST(c_nationkey AS VARCHAR) AS folder, name, CASE WHEN name LIKE '%.ARW' THEN 'raw' ELSE 'jpeg' END AS kind,
      CAST(rating AS INTEGER) AS rating FROM named WHERE name NOT LIKE '.%' AND name NOT LIKE '%.txt'""",
)
def opened_folders(spark, sf):
    """Pictures and sidecars written, then their folders listed and read."""
    from framesift.functions import xmp

    root = A.mounted(spark, "shoot")
    customers = _customers(spark, sf)
    path = F.concat(F.lit(f"{root}/"), "folder", F.lit("/"), "name")
    files = customers.select(
        F.explode(
            F.array(
                F.struct(path.alias("path"), F.encode(F.lit("x"), "UTF-8").alias("data")),
                F.struct(
                    F.when(F.col("rating") != 0, scalars.sidecar_path(path)).alias("path"),
                    F.encode(xmp.fresh("rating"), "UTF-8").alias("data"),
                ),
            )
        ).alias("_")
    ).select("_.path", "_.data").where(F.col("path").isNotNull())
    _written(files)
    dirs = customers.select(F.concat(F.lit(f"{root}/"), "folder").alias("dir")).distinct()
    listed = listing.listed_all(dirs)
    frames = assemble.with_ratings(assemble.pictures(listed), listing.sidecars(listed))
    return frames.select(scalars.base_name("dir").alias("folder"), "name", "kind", "rating")


def _png(rows: list[bytes], width: int) -> bytes:
    """A picture of 8-bit red, green and blue, as a PNG."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, len(rows), 8, 2, 0, 0, 0)
    body = zlib.compress(b"".join(b"\0" + row for row in rows))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


@query("picture_pixels", f"WITH {A.PIXELS_SQL} SELECT path, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, r, g, b FROM pixels")
def picture_pixels(spark, sf):
    """The small pictures written as PNGs, and decoded again."""
    root = A.mounted(spark, "pictures")
    cell = F.struct("y", "x", F.array("r", "g", "b").alias("rgb"))
    whole = A.pixels(spark, sf).groupBy("path").agg(F.array_sort(F.collect_list(cell)).alias("_cells"))
    # A picture is one binary by the time Python has it: as hex, two digits a level.
    digits = F.transform(F.flatten(F.transform("_cells", lambda c: c["rgb"])), lambda v: F.lpad(F.hex(v), 2, "0"))
    files = whole.select(F.concat(F.lit(f"{root}/"), "path", F.lit(".png")).alias("path"), F.unhex(F.array_join(digits, "")).alias("data"))

    def packed(batches):
        import pyarrow as pa

        across = 3 * A.SIDE
        for batch in batches:
            flat = batch.column(1).to_pylist()
            pngs = [_png([levels[i : i + across] for i in range(0, len(levels), across)], A.SIDE) for levels in flat]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pngs, pa.binary())], ["path", "data"])

    _written(files.mapInArrow(packed, "path string, data binary"))
    return pictures.read(spark, root).withColumn("path", scalars.stem(scalars.base_name("path")))


@query(
    "arriving_pictures",
    """SELECT CAST(c_nationkey AS VARCHAR) AS folder, count(*) FILTER (c_custkey % 3 = 0) AS raw,
      count(*) FILTER (c_custkey % 3 = 1) AS jpeg, 0::BIGINT AS png, count(*) AS total
    FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 10 > 1 GROUP BY ALL""",
)
def arriving_pictures(spark, sf):
    root = A.mounted(spark, "arriving")
    path = F.concat(F.lit(f"{root}/"), "folder", F.lit("/"), "name")
    files = _customers(spark, sf).select(path.alias("path"), F.encode(F.lit("x"), "UTF-8").alias("data"))
    _written(files)
    with folders.named_only(spark):
        found = _drained(folders.arriving(spark, root, files_per_batch=100_000, kept=A.mounted(spark, "names")), "arrived")
    held = counts.kinds_held(found.withColumn("dir", scalars.base_name("dir")))
    return held.select(F.col("dir").alias("folder"), "raw", "jpeg", "png", (F.col("raw") + F.col("jpeg") + F.col("png")).alias("total"))
