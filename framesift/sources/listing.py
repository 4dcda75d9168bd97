"""Directory listings, a partition a folder.

Spark's own file sources skip names that start with ``_``, and some cameras'
do; so folders are listed here, each in the task that has it.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from itertools import batched, chain
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from framesift.operators import assemble
from framesift.schema import LISTING


# Files a batch is made of: what is told of them, and what is in them.
_AT_ONCE, _TEXTS_AT_ONCE = 10_000, 100
# Folders of one folder that are named to tasks.
_NAMED = 1_000


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """A few short rows can be hours of work, so their size doesn't tell how many tasks they need.
    By a hash of the key: by the key itself a shuffle before would be taken for this one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))


def _entries(dir_: str, wanted: Callable[[str], bool] | None = None) -> Iterator[tuple]:
    with os.scandir(dir_) as entries:
        for entry in entries:
            if wanted and not wanted(entry.name):
                continue
            try:
                is_dir, stat = entry.is_dir(), entry.stat()
            except OSError:
                continue
            modified = datetime.fromtimestamp(stat.st_mtime, timezone.utc)
            yield entry.path, dir_, entry.name, is_dir, stat.st_size, modified


def _arrow():
    import pyarrow as pa

    types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC")]
    return pa.schema(list(zip(LISTING.names, types)))


def _batches(entries: Iterator[tuple]) -> Iterator:
    import pyarrow as pa

    arrow = _arrow()
    for some in batched(entries, _AT_ONCE):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), arrow.types)], schema=arrow)


class _Reader(DataSourceReader):
    def __init__(self, dirs: list[str]):
        self.dirs = dirs

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(dir_) for dir_ in self.dirs]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from _entries(partition.value)


class FolderListing(DataSource):
    """``spark.read.format("folder_listing").option("dirs", "/a\\n/b")``."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> StructType:
        return LISTING

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["dirs"].split("\n"))


def _shown(name: str) -> bool:
    """Whether Spark's file sources look at a file or a folder of that name."""
    if name.startswith(("_metadata", "_common_metadata")):
        return True
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _taken(row: tuple) -> bool:
    """Whether an entry is a file that they read."""
    return not row[3] and (not row[2].startswith("_") or "=" in row[2])


def _inside(dir_: str, wanted: Callable[[str], bool] = _shown) -> Iterator[tuple]:
    """What :func:`_entries` gives; nothing if the folder has gone since it was found."""
    try:
        yield from _entries(dir_, wanted)
    except (FileNotFoundError, NotADirectoryError):
        return


def _folders(dir_: str) -> tuple[list[str] | None, int]:
    """The folders in one, None if they're too many to be named, and how many other names are in it."""
    found, others = [], 0
    try:
        with os.scandir(dir_) as entries:
            for entry in entries:
                if not (_shown(entry.name) and entry.is_dir()):
                    others += 1
                elif found is not None:
                    found.append(entry.path)
                    if len(found) > _NAMED:
                        found = None
    except (FileNotFoundError, NotADirectoryError):
        pass
    return found, others


def _walked(dir_: str) -> Iterator[tuple]:
    """The files in a folder and all folders under it."""
    left = [dir_]
    while left:
        for row in _inside(left.pop()):
            if row[3]:
                left.append(row[0])
            elif _taken(row):
                yield row


def _share_of(dir_: str, share: int, of: int, deep: bool) -> Iterator[tuple]:
    """Of the files directly in a folder, and if ``deep`` of the folders with all under them, the share that has their names."""
    for row in _inside(dir_, lambda name: _shown(name) and zlib.crc32(os.fsencode(name)) % of == share):
        if _taken(row):
            yield row
        elif deep and row[3]:
            yield from _walked(row[0])


def _once(path: str, write: Callable[[str], None]) -> None:
    """A file written whole or not at all, and never twice."""
    if os.path.exists(path):
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    made = f"{path}.{uuid.uuid4().hex}"
    write(made)
    try:
        os.link(made, path)
    except FileExistsError:
        pass
    os.unlink(made)


class _ArrivalReader(DataSourceStreamReader):
    """Each pass lists all there is. What a pass found is kept under its number
    until it's done, so that a batch run again has the same rows; offsets are
    passes' numbers, and the driver knows some folders but no files."""

    def __init__(self, root: str, kept: str, tasks: int, least: int):
        self.root, self.kept, self.tasks, self.least = root, kept, tasks, least

    def initialOffset(self) -> dict:
        return {"pass": 0}

    def latestOffset(self) -> dict:
        return {"pass": time.time_ns()}

    def _places(self) -> list[tuple]:
        """What to list: folders with all under them, ``(dir,)``, and shares of one
        folder, ``(dir, share, of, deep)``; folders that hold very many aren't named."""
        whole, own = [self.root], []
        while whole and len(whole) + len(own) < self.least:
            below = []
            for dir_ in whole:
                found, others = _folders(dir_)
                below += found or []
                of = self.tasks if found is None else min(self.tasks, -(-others // _AT_ONCE))
                own += [(dir_, share, of, found is None) for share in range(of)]
            whole = below
        return [*((dir_,) for dir_ in whole), *own]

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        path = f"{self.kept}/{end['pass']}/places"

        def write(made: str) -> None:
            if not os.path.isdir(self.root):
                raise FileNotFoundError(self.root)
            places = self._places()
            with open(made, "w") as file:
                json.dump([places[k :: self.tasks] for k in range(min(self.tasks, len(places)))], file)

        _once(path, write)
        with open(path) as file:
            return [InputPartition((end["pass"], k, places)) for k, places in enumerate(json.load(file))]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        number, k, places = partition.value
        path = f"{self.kept}/{number}/{k}.arrow"

        def write(made: str) -> None:
            rows = chain.from_iterable(_walked(*p) if len(p) == 1 else _share_of(*p) for p in places)
            with pa.OSFile(made, "wb") as file, pa.ipc.new_file(file, _arrow(), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in _batches(rows):
                    out.write_batch(batch)

        _once(path, write)
        with pa.OSFile(path) as file:
            found = pa.ipc.open_file(file)
            for k in range(found.num_record_batches):
                yield found.get_batch(k)

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.kept) if os.path.isdir(self.kept) else []:
            if name.isdigit() and int(name) <= end["pass"]:
                shutil.rmtree(f"{self.kept}/{name}", ignore_errors=True)


class FolderArrivals(DataSource):
    """``spark.readStream.format("folder_arrivals").option("root", "/a").option("kept", "/b")``:
    with every batch all files under a mounted folder that Spark's file sources
    would see; ``kept`` is a folder for what batches found, for this stream alone."""

    @classmethod
    def name(cls) -> str:
        return "folder_arrivals"

    def schema(self) -> StructType:
        return LISTING

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _ArrivalReader(self.options["root"], self.options["kept"], int(self.options["tasks"]), int(self.options["least"]))


def arrivals(spark: SparkSession, root: str, kept: str) -> DataFrame:
    """A stream of all files under a mounted folder, again with every batch, by
    as many tasks at most as a shuffle has."""
    spark.dataSource.register(FolderArrivals)
    return (
        spark.readStream.format("folder_arrivals")
        .option("root", root.rstrip("/") or "/")
        .option("kept", kept)
        .option("tasks", spark.conf.get("spark.sql.shuffle.partitions"))
        .option("least", spark.sparkContext.defaultParallelism)
        .load()
    )


def listed(spark: SparkSession, *dirs: str) -> DataFrame:
    """What's directly in the folders named, a partition a folder."""
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").option("dirs", "\n".join(d.rstrip("/") for d in dirs)).load()


def listed_all(dirs: DataFrame) -> DataFrame:
    """What's directly in each folder of a table ``(dir)``, for more folders
    than a plan can name."""

    def entries(batches):
        for batch in batches:
            for dir_ in batch.column(0).to_pylist():
                yield from _batches(_entries(dir_.rstrip("/")))

    return _dealt(dirs.select("dir"), "dir").mapInArrow(entries, LISTING)


def opened(spark: SparkSession, *dirs: str, formats: str = "all") -> DataFrame:
    """The pictures of folders; an error where there are none."""
    pictures = assemble.pictures(listed(spark, *dirs))
    empty = [d for d in dirs if pictures.where(F.col("dir") == d.rstrip("/")).isEmpty()]
    if empty:
        raise FileNotFoundError(f"nothing of a kind that can be shown is in {', '.join(empty)}")
    return assemble.of_format(pictures, formats)


def sidecars(listing: DataFrame) -> DataFrame:
    """The text of the sidecars among listed files, ``(sidecar_path, xmp)``,
    dealt over tasks whichever folder they're in."""
    files = listing.where(~F.col("is_dir") & F.lower("name").endswith(".xmp")).select("path")

    def texts(batches):
        import pyarrow as pa

        for batch in batches:
            for paths in batched(batch.column(0).to_pylist(), _TEXTS_AT_ONCE):
                found = []
                for path in paths:
                    try:
                        with open(path, encoding="utf-8", newline="") as file:
                            found.append(file.read())
                    except (OSError, UnicodeDecodeError):
                        # There, but not to be read: it has no description.
                        found.append("")
                yield pa.RecordBatch.from_pydict({"sidecar_path": list(paths), "xmp": found})

    return _dealt(files, "path").mapInArrow(texts, "sidecar_path string, xmp string")


def sidecars_under(spark: SparkSession, root: str) -> DataFrame:
    """The same by Spark's text source, from any file system it reads; names
    that start with ``_`` aren't seen."""
    texts = (
        spark.read.option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.xmp")
        .text(root)
    )
    path = F.url_decode(F.replace(F.regexp_replace("_metadata.file_path", "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))
    return texts.select(path.alias("sidecar_path"), F.col("value").alias("xmp"))
