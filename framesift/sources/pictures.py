"""Pixel tables from picture files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.schema import PIXELS

# Rows of a picture given at a time, so a task never holds its whole table.
_PIXELS_AT_ONCE = 1 << 18


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            # A picture's bytes are looked at where they are, one after another.
            path, h, w, channels = (batch.column(c)[k].as_py() for c in range(4))
            levels = np.frombuffer(batch.column(4)[k].as_buffer(), np.uint8).reshape(h, w, channels)
            step = max(1, _PIXELS_AT_ONCE // max(w, 1))
            for top in range(0, h, step):
                part = levels[top : top + step]
                y, x = np.mgrid[top : top + part.shape[0], 0:w].reshape(2, -1)
                flat = part.reshape(-1, channels).astype(np.int32)
                # Stored blue first; grey is all three.
                b, g, r = (flat[:, min(i, channels - 1)] for i in range(3))
                columns = [pa.repeat(path, len(x)), *(pa.array(v.astype(np.int32)) for v in (x, y, r, g, b))]
                held.append(pa.RecordBatch.from_arrays(columns, PIXELS.names))
                rows += len(x)
                if rows >= _PIXELS_AT_ONCE:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read(spark: SparkSession, path: str, format: str = "image") -> DataFrame:
    """The pixels ``(path, x, y, r, g, b)`` of the JPEGs and PNGs under a path.
    Files that can't be decoded have none."""
    images = (
        spark.read.format(format).option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    )
    origin = F.regexp_replace("origin", "^file:(//)?", "")
    packed = images.select(origin.alias("path"), "height", "width", "nChannels", "data")
    return packed.mapInArrow(_unpacked, PIXELS)
