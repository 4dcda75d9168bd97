"""Strings of bytes that come again anywhere in a table of texts, by sorting suffixes.

Two equal strings have the same least phrase (of ``k`` bytes, by hash). So each
place of a text is filed under the least phrase of the string that begins
there, neighbours with the same one together as a cut, and only cuts filed
alike can hold equal strings. Cuts with the same bytes are counted, not
compared; a file with different ones is put in one task, where the places'
suffixes are sorted: those smaller than their successors directly, the others
as these induce them bucket by bucket. Equal strings then are neighbours. A
file with too many cuts is filed again by longer phrases, in the end by whole
strings.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift.llm.batches import pieces
from framesift.llm.shared import settled
from framesift.llm.shingles import mixed
from framesift.sources.shared import folder

U = np.uint64
_BYTES = np.random.Generator(np.random.PCG64(20250113)).integers(0, 2**64, 256, U, endpoint=False)
_STEP = U(0x9E3779B97F4A7C15)
# A text's key is 120 bits of its SHA-256, a cut's content 128 bits of its bytes' hash.
KEY, CONTENT = ["k1", "k2"], ["c1", "c2"]
CUT = "file long, c1 long, c2 long, k1 long, k2 long, at long, n long, inner long"


@dataclass(frozen=True)
class Repeats:
    """``length``: bytes of a string. ``phrases``: lengths of the phrases that
    strings are filed by, the next where a file has over ``most`` different
    cuts; the last is the string itself. ``pack``: bytes sorted at once, but for
    a single file."""

    length: int = 400
    phrases: tuple[int, ...] = (32, 200, 320, 384, 400)
    most: int = 2048
    pack: int = 1 << 20


def gram_hashes(seen: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each place on, by doubling."""
    h, size, out, done = _BYTES[seen], 1, None, 0
    while True:
        if k & size:
            out = h if out is None else out[: len(h) - done] * _STEP + mixed(h[done:])
            done += size
        if 2 * size > k:
            return out[: len(seen) - k + 1]
        h = mixed(h[: len(h) - size] * _STEP + h[size:])
        size *= 2


def least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least of each ``wide`` consecutive values."""
    size = 1
    while 2 * size <= wide:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (wide - size)], values[wide - size :])


def cuts(text: bytes, first: int, count: int, k: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cuts of the ``count`` strings from ``first`` on: files, first places,
    numbers of places, and whether the phrase comes more than once in the cut
    (1 or 0), as it must where a cut holds equal strings itself."""
    seen = np.frombuffer(text, np.uint8, count + length - 1, first)
    wide, grams = length - k + 1, gram_hashes(seen, k)
    file = least(grams, wide)
    begins = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
    ends = np.append(begins[1:], count)
    # The same phrase may be least for long, in a text that repeats itself.
    more = (ends - begins - 1) // wide
    if more.any():
        begins = np.concatenate([np.arange(a, b, wide) for a, b in zip(begins, ends)])
        ends = np.append(begins[1:], count)
    inner = [np.count_nonzero(grams[a : b + wide - 1] == file[a]) > 1 for a, b in zip(begins.tolist(), ends.tolist())]
    return file[begins].view(np.int64), begins + first, ends - begins, np.array(inner, np.int64)


def induced(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places ``wanted`` (a mask; what a wanted place's order hangs on is added)
    in the order of their suffixes, which beyond ``depth`` bytes may tie.

    Two stages: suffixes smaller than their successors are sorted directly,
    bucket by first byte; going through the buckets in order, each suffix
    larger than its successor falls to its own bucket's front when its successor
    is passed. ``data`` ends in a 0, which is less than all bytes of texts.
    """
    n = len(data)
    # Whether a suffix is smaller than its successor: as at the end of its stretch of equal bytes.
    change = np.flatnonzero(data[1:] != data[:-1])
    up = np.ones(n, bool)
    runs = np.diff(np.concatenate(([-1], change)))
    up[: change[-1] + 1 if len(change) else 0] = np.repeat(data[change] < data[change + 1], runs)
    # The order of a suffix hangs on those up to the next smaller one.
    smaller = np.flatnonzero(up)
    after = smaller[np.searchsorted(smaller, np.flatnonzero(wanted))]
    reach = np.zeros(n + 1, np.int32)
    np.add.at(reach, np.flatnonzero(wanted), 1)
    np.add.at(reach, after + 1, -1)
    needed = np.cumsum(reach[:-1]) > 0
    raw = data.tobytes() + bytes(depth)
    direct = np.flatnonzero(needed & up)
    direct = direct[np.argsort(data[direct], kind="stable")]
    bounds = np.searchsorted(data[direct], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def passed(order: np.ndarray) -> None:
        """Suffixes before those in ``order`` that these induce go to their buckets."""
        before = order[order > 0] - 1
        before = before[needed[before] & ~up[before]]
        if len(before):
            bytes_ = data[before]
            by = np.argsort(bytes_, kind="stable")
            before, bytes_ = before[by], bytes_[by]
            begins = np.flatnonzero(np.concatenate(([True], bytes_[1:] != bytes_[:-1])))
            for a, b in zip(begins, np.append(begins[1:], len(before))):
                fronts[bytes_[a]].append(before[a:b])

    for byte in range(256):
        while fronts[byte]:
            # Suffixes of the same first byte fall in while those before are passed.
            for order in (waiting := fronts[byte]):
                out.append(order)
            fronts[byte] = []
            passed(np.concatenate(waiting))
        some = direct[bounds[byte] : bounds[byte + 1]].tolist()
        if some:
            some.sort(key=lambda p: raw[p : p + depth])
            order = np.array(some)
            out.append(order)
            passed(order)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether suffixes ``a`` and ``b`` share their first ``depth`` bytes, eight at a time."""
    words = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8).copy().view(U)[:, 0]
    same, left = np.ones(len(a), bool), np.arange(len(a))
    for at in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        agree = words[a[left] + at] == words[b[left] + at]
        same[left[~agree]] = False
        left = left[agree]
        if not len(left):
            break
    return same


def repeated(texts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each of several texts which of its first ``counts`` places begin a
    string that begins at another such place too, of any."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8) + np.uint8(1)  # a text's end becomes 0
    wanted = np.zeros(len(data), bool)
    for s, c in zip(starts, counts):
        wanted[s : s + c] = True
    order = induced(data, wanted, length)
    order = order[wanted[order]]
    again = np.zeros(len(data), bool)
    equal = common(data, order[:-1], order[1:], length)
    again[order[:-1][equal]] = True
    again[order[1:][equal]] = True
    return [again[s : s + c] for s, c in zip(starts, counts)]


def stretches(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where to where (not included) a mask is set."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], marks, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def key(text: str) -> dict[str, Column]:
    digest = F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)
    return {k: F.conv(F.substring(digest, 1 + 15 * j, 15), 16, 10).cast("long") for j, k in enumerate(KEY)}


def known(docs: DataFrame, text: str) -> DataFrame:
    """``k1, k2, text, copies``: each text once, filed in the shared folder by
    a hash of its key, so that joining by key doesn't move texts again."""
    spark = docs.sparkSession
    once = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumns(key("text"))
    once = once.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name, parts = f"texts_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    once.write.bucketBy(parts, *KEY).sortBy(*KEY).option("path", folder(spark, "texts")).saveAsTable(name)
    return spark.table(name)


def listed(piece: pa.RecordBatch) -> Iterator[tuple[int, bytes, list | None]]:
    """Each text's place in the batch, its bytes, and its row's list if it has one."""
    texts = piece.column("text").cast(pa.binary()).to_pylist()
    lists = piece.column("cuts").to_pylist() if "cuts" in piece.schema.names else [None] * len(texts)
    return zip(range(len(texts)), texts, lists)


def arrow(schema: list[tuple[str, list]]) -> pa.RecordBatch:
    """A batch of whole numbers, each column from arrays put one after another."""
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(found) if found else [], pa.int64()) for _, found in schema], [name for name, _ in schema])


def filed(texts: DataFrame, places: DataFrame | None, phrase: int, how: Repeats) -> DataFrame:
    """The cuts (``CUT``) of texts by phrases of so many bytes: of all places, or of
    those that ``places`` has (a text's key, and ``cuts`` with ``at, n``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            rows, files, contents, ats, ns, inners = [], [], [], [], [], []
            for row, t, only in listed(piece):
                if only is None:
                    only = [{"at": 0, "n": len(t) - how.length + 1}] if len(t) >= how.length else []
                for some in only:
                    file, at, n, inner = cuts(t, some["at"], some["n"], phrase, how.length)
                    rows.append(np.full(len(file), row))
                    files.append(file)
                    ats.append(at)
                    ns.append(n)
                    inners.append(inner)
                    contents += [hashlib.blake2b(t[a:b], digest_size=16).digest() for a, b in zip(at.tolist(), (at + n + how.length - 1).tolist())]
            content = np.frombuffer(b"".join(contents), np.int64).reshape(-1, 2)
            of = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            k1, k2 = (piece.column(k).to_numpy()[of] for k in KEY)
            yield arrow([("file", files), ("c1", [content[:, 0]]), ("c2", [content[:, 1]]), ("k1", [k1]), ("k2", [k2]),
                         ("at", ats), ("n", ns), ("inner", inners)])

    rows = texts.select(*KEY, "text")
    return (rows if places is None else rows.join(places, KEY)).mapInArrow(run, CUT)


def sorted_files(texts: DataFrame, chosen: DataFrame, how: Repeats) -> DataFrame:
    """``k1, k2, first, last``: stretches of places that begin repeated strings, in
    the cuts that have no equal. ``chosen`` has files' different cuts."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            k1, k2 = (piece.column(k).to_pylist() for k in KEY)
            rows = [(c["file"], c["single"], k1[row], k2[row], c["at"], c["n"], t[c["at"] : c["at"] + c["n"] + how.length - 1])
                    for row, t, some in listed(piece) for c in some]
            for a in range(0, len(rows), 4096):
                columns = zip(*rows[a : a + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary()])],
                    ["file", "single", *KEY, "at", "n", "bytes"])

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        out = [(name, []) for name in (*KEY, "first", "last")]
        for (_, single, k1, k2, at, _, _), mark in zip(rows, repeated([r[6] for r in rows], [r[5] for r in rows], how.length)):
            if single and mark.any():
                a, b = stretches(mark)
                for (_, found), values in zip(out, (np.full(len(a), k1), np.full(len(a), k2), a + at, b + at - 1)):
                    found.append(values)
        return arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "single", *KEY, "at", "n", "bytes"))):
                if size >= how.pack and row[0] != held[-1][0]:
                    yield sort(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield sort(held)

    grouped = chosen.groupBy(*KEY).agg(F.collect_list(F.struct("file", "single", "at", "n")).alias("cuts"))
    found = texts.select(*KEY, "text").join(grouped, KEY).mapInArrow(
        sliced, "file long, single boolean, k1 long, k2 long, at long, n long, bytes binary")
    return found.repartition("file").sortWithinPartitions("file").mapInArrow(run, "k1 long, k2 long, first long, last long")


def among(rows: DataFrame, counts: DataFrame, keys: list[str], all_rows: int) -> DataFrame:
    """The rows whose keys ``counts`` has, with ``_n`` rows each. Keys of over a
    thousandth of all rows, of which there are fewer than a thousand, are
    broadcast, so that their rows stay in the tasks that hold them."""
    often = F.col("_n") > all_rows // 1000
    hot = F.broadcast(counts.where(often).select(*keys))
    return rows.join(hot, keys, "left_anti").join(counts.where(~often).select(*keys), keys, "left_semi").unionByName(
        rows.join(hot, keys, "left_semi"))


def marked(texts: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """``k1, k2, first, last``: stretches of places in different texts that begin repeated strings."""
    found, places = [], None
    for phrase in how.phrases:
        rows = settled(filed(texts, places, phrase, how), "cuts")
        total = rows.count()
        # Files of one cut hold nothing repeated, but for what repeats in itself; the others' cuts once each.
        counts = settled(rows.groupBy("file").agg(F.count("*").alias("_n"), F.max("inner").alias("_inner")).where("_n > 1 OR _inner = 1"), "files")
        rows = settled(among(rows, counts, ["file"], total), "met")
        contents = settled(rows.groupBy("file", *CONTENT).agg(
            F.count("*").alias("_n"), *(F.first(c).alias(c) for c in (*KEY, "at", "n", "inner"))), "contents")
        found.append(among(rows, contents.where("_n > 1"), ["file", *CONTENT], total).select(
            *KEY, F.col("at").alias("first"), (F.col("at") + F.col("n") - 1).alias("last")))
        files = settled(contents.groupBy("file").agg(F.count("*").alias("_n"), F.max("inner").alias("_inner")).where("_n > 1 OR _inner = 1"), "mixed")
        single = contents.withColumn("single", F.col("_n") == 1).drop("_n")
        few, many = files.where(f"_n <= {how.most}"), files.where(f"_n > {how.most}")
        found.append(sorted_files(texts, single.join(few.select("file"), "file", "left_semi"), how))
        if phrase == how.phrases[-1] or many.isEmpty():
            break
        places = among(single, many, ["file"], total).groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("cuts"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@dataclass(frozen=True)
class Deduplicated:
    """``rows``: each row's columns with its text's key; ``texts``: for each different
    text its key, ``n_bytes, spans`` (what goes, from where to where, the end not
    included) and ``kept`` (the bytes that stay)."""

    rows: DataFrame
    texts: DataFrame

    def joined(self, values: DataFrame) -> DataFrame:
        """The rows with their text's values (``k1, k2`` and more). Texts of over a thousandth
        of all rows, fewer than a thousand, are joined without moving their rows."""
        counts = self.rows.groupBy(*KEY).agg(F.count("*").alias("_n"))
        hot = F.broadcast(counts.where(F.col("_n") > max(1, self.rows.count() // 1000)).select(*KEY))
        few = self.rows.join(hot, KEY, "left_anti").join(values, KEY)
        return few.unionByName(self.rows.join(F.broadcast(values.join(hot, KEY, "left_semi")), KEY))


def deduplicated(docs: DataFrame, columns: list[str], text: str = "text", how: Repeats = Repeats()) -> Deduplicated:
    """Each row's text without the bytes that some string of ``how.length`` bytes
    covers which begins anywhere else too, in the same text or another row's.

    Texts count as UTF-8, null as empty. Strings never go over a text's end,
    and are judged on the texts given, so all occurrences go, also where they
    overlap. Rows with equal texts are occurrences of each other, whatever
    their ids: texts as long as a string lose everything then, shorter ones
    nothing. ``columns`` (none called ``k1`` or ``k2``) are kept, others are left
    out whatever they're called; an empty table gives empty ones. Long texts
    are cut like others; one text, or one file of cuts, is what a task holds.
    """
    texts = known(docs, text)
    marks = marked(texts, how).groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("cuts"))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", 1 << 20):
            sizes, spans, kept = [], [], []
            copies = piece.column("copies").to_pylist()
            for row, t, found in listed(piece):
                sizes.append(len(t))
                if copies[row] > 1 and len(t) >= how.length:
                    found = [{"first": 0, "last": len(t) - how.length}]
                if not found:
                    spans.append([])
                    kept.append(t)
                    continue
                over = np.zeros(len(t) + 1, np.int64)
                np.add.at(over, [m["first"] for m in found], 1)
                np.add.at(over, [m["last"] + how.length for m in found], -1)
                a, b = (x.tolist() for x in stretches(np.cumsum(over)[:-1] > 0))
                spans.append([{"start": x, "end": y} for x, y in zip(a, b)])
                kept.append(b"".join(t[x:y] for x, y in zip([0, *b], [*a, len(t)])))
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(k) for k in KEY), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())],
                [*KEY, "n_bytes", "spans", "kept"])

    cut = texts.join(marks, KEY, "left").select(*KEY, "text", "copies", "cuts").mapInArrow(
        run, "k1 long, k2 long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return Deduplicated(settled(docs.select(*columns, *(c.alias(k) for k, c in key(text).items())), "rows"), cut)
