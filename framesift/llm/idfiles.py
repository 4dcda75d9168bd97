"""Documents' token ids in binary files, in order, each block packed and checked by itself.

A file is a row of frames. A frame holds whole documents: a header with their
ids and lengths, a CRC-32 of the header, and blocks of 512 token ids (the last
filled up with 0) that the range coder packed each from a fresh start, each
with a CRC-32 of the ids it stands for.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.llm.batches import pieces
from framesift.llm.ranges import before
from framesift.llm.rangecoder import BLOCK, I, decode, encode

MAGIC = b"FSIDS1\n\0"
# magic, length of header and blocks, partition, frame in it, documents, ids, blocks
HEAD = "<8sQIIIQI"
# Ids after which a frame is closed, words a worker remembers, and words coded in one go.
FRAME, WORDS, GO = 4_000_000, 1_000_000, 2048
# Bytes of texts whose words are told apart together: the more, the fewer are looked up again.
TEXTS = 16 << 20


def letters(word: bytes) -> bool:
    """Whether a word is letters alone, and so one run to the tokenizer's pattern."""
    return word.isalpha() or not word.isascii() and word.decode().isalpha()


class WordCoder:
    """A tokenizer applied word by word: this one's normalizer, pattern and
    special tokens never look across white space, so words seen before needn't be coded
    again, and letters before a last sign are coded as without it, if the last
    is still a letter once normalized (the pattern joins marks with signs). ASCII
    letters are coded as small ones if the normalizer makes them so."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) > 65535:
            raise ValueError("ids have to fit 16 bits")
        self.last = np.zeros(65536, bool)  # whether an id ends a run of letters
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        normalizer = self.tokenizer.normalizer
        # Whether ASCII letters are coded as small ones.
        self.folds = normalizer is not None and normalizer.normalize_str(string.ascii_uppercase) == string.ascii_lowercase
        self.known: dict[bytes, bytes] = {}
        self.alone: dict[str, bool] = {}  # whether signs after a letter are coded by themselves

    def apart(self, core: bytes) -> bool:
        """Whether a sign after letters is a run of its own: none joins with ASCII
        letters; of others, the last decides, and a joined one has no end of run before the sign."""
        if core.isascii():
            return True
        letter = core.decode()[-1]
        if letter not in self.alone:
            whole, one, sign = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in (letter + ".", letter, "."))
            self.alone[letter] = whole == one + sign
        return self.alone[letter]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian 16-bit numbers. Arrow tells words apart
        and lays their ids out, so that Python looks up different words only."""
        if not texts:
            return []
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        places = split.values.dictionary_encode()
        words = places.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        new = {w for w, ids in zip(words, found) if ids is None}
        if new:
            if len(self.known) + len(new) > WORDS:
                self.known.clear()
            self.add(new)
            found = [self.known[w] if ids is None else ids for w, ids in zip(words, found)]
        laid = pa.array(found, pa.large_binary()).take(places.indices)
        ends = np.frombuffer(laid.buffers()[1], I, len(laid) + 1)[split.offsets.to_numpy()].tolist()
        data = memoryview(laid.buffers()[2] or b"")
        return [bytes(data[start:end]) for start, end in zip(ends, ends[1:])]

    def add(self, new: set[bytes]) -> None:
        plain, large, rest = set(), [], set()
        for w in new:
            if not w.isalpha():  # ASCII letters
                rest.add(w)
            elif self.folds and not w.islower():
                large.append(w)
            else:
                plain.add(w)
        signed = [w for w in rest if w[-1:] in b".,!?;:" and letters(w[:-1]) and self.apart(w[:-1])]
        cores = {w[:-1] for w in signed}.union({w[-1:] for w in signed}).difference(self.known, new)
        rest = rest.difference(signed).union(cores)
        small = [w for w in rest if w.isalpha()]
        if self.folds:
            large += [w for w in small if not w.islower()]
            small = [w.lower() for w in small]
        more = [w for w in rest if not w.isalpha() and letters(w)]
        others = [w for w in rest.difference(more) if not w.isalpha()]
        plain.update(small, [w.lower() for w in large])
        plain = list(plain.difference(self.known)) + more
        for start in range(0, len(plain), GO):
            some = plain[start : start + GO]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u2")
            ends = np.flatnonzero(self.last[ids]) + 1
            packed = ids.tobytes()
            if len(ends) != len(some):  # a letter that isn't one once normalized
                others += some
                continue
            begin = 0
            for w, end in zip(some, (2 * ends).tolist()):
                self.known[w] = packed[begin:end]
                begin = end
        for start in range(0, len(others), GO):
            some = others[start : start + GO]
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.known.update(zip(some, (struct.pack(f"<{len(c.ids)}H", *c.ids) for c in coded)))
        for w in large:
            self.known[w] = self.known[w.lower()]
        for w in signed:
            self.known[w] = self.known[w[:-1]] + self.known[w[-1:]]


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def frame(part: int, seq: int, docs: list[tuple[int | None, bytes]]) -> bytes:
    ids = np.frombuffer(b"".join(d for _, d in docs), "<u2")
    blocks = np.zeros((-(-len(ids) // BLOCK), BLOCK), "<u2")
    blocks.reshape(-1)[: len(ids)] = ids
    words, used = encode(blocks)
    names = np.array([d or 0 for d, _ in docs], "<i8")
    named = np.array([d is not None for d, _ in docs], np.uint8)
    sizes = np.array([len(d) // 2 for _, d in docs], "<i8")
    checks = np.array([zlib.crc32(b) for b in blocks], "<u4")
    table = names.tobytes() + named.tobytes() + sizes.tobytes() + used.astype("<u4").tobytes() + checks.tobytes()
    body = words.astype("<u4").tobytes()
    head = struct.pack(HEAD, MAGIC, struct.calcsize(HEAD) + len(table) + 4 + len(body), part, seq, len(docs), len(ids), len(blocks))
    return head + table + struct.pack("<I", zlib.crc32(head + table)) + body


def unframed(data: bytes) -> tuple[int, int, list[int | None], list[np.ndarray]]:
    """A frame's place, documents and their token ids; ValueError where a check fails."""
    _, _, part, seq, docs, count, lanes = struct.unpack_from(HEAD, data)
    end = struct.calcsize(HEAD) + docs * 17 + lanes * 8
    if zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"the header of frame {part}/{seq} is damaged")
    at = struct.calcsize(HEAD)
    names, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
    named, at = np.frombuffer(data, np.uint8, docs, at), at + docs
    sizes, at = np.frombuffer(data, "<i8", docs, at), at + 8 * docs
    used, at = np.frombuffer(data, "<u4", lanes, at).astype(np.int64), at + 4 * lanes
    checks = np.frombuffer(data, "<u4", lanes, at)
    blocks = decode(np.frombuffer(data, "<u4", int(used.sum()), end + 4), used) if lanes else np.zeros((0, BLOCK), np.uint16)
    for k, (block, check) in enumerate(zip(blocks, checks)):
        if zlib.crc32(np.ascontiguousarray(block, "<u2")) != check:
            raise ValueError(f"block {k} of frame {part}/{seq} is damaged")
    ids = blocks.reshape(-1)[:count]
    return part, seq, [int(n) if k else None for n, k in zip(names, named)], np.split(ids, np.cumsum(sizes)[:-1])


def written(docs: DataFrame, path: str, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text",
            partitions: int | None = None) -> None:
    """Write every document's token ids, each with ``end`` after them, to files under ``path``.

    Documents are in ascending order of ``doc_id``, rows without one first;
    equal ids go by their text's hash, so that rows may repeat and one id may
    have any number of rows. A null or empty text has the end id alone. Other
    columns are left out whatever they're called. ``tokenizer`` is a file
    every executor has.

    Texts are shuffled once, by ranges of the order; a task holds a frame of
    about four million ids, or one document that is longer. Frames are rows
    that Spark's text writer puts into files of a few frames each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seq, part = [], 0, 0, 0
        tail = struct.pack("<H", end)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([frame(part, seq, held)], pa.binary())], ["frame"])

        for piece in pieces(batches, "text", TEXTS):
            part = piece.column("part")[0].as_py()
            texts = [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]
            for name, ids in zip(piece.column("doc_id").to_pylist(), coder(tokenizer).encode(texts)):
                held.append((name, ids + tail))
                size += len(ids) // 2 + 1
                if size >= FRAME:
                    yield row()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield row()

    given = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("_hash"), F.col(text).cast("string").alias("text"))
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = given.repartitionByRange(partitions, "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    frames = ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", 4).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``part, seq, at, doc_id, ids`` of all documents in the files: ids as
    little-endian unsigned 32-bit numbers, order by the first three. A file
    that is damaged fails the job and says where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "content", 1):
            for data in piece.column("content").to_pylist():
                at = 0
                while at < len(data):
                    magic, length = struct.unpack_from("<8sQ", data, at)
                    if magic != MAGIC:
                        raise ValueError(f"no frame starts at byte {at}")
                    part, seq, names, ids = unframed(data[at : at + length])
                    at += length + 1  # the writer's line end
                    n = len(names)
                    for k in range(0, n, 512):
                        some = [i.astype("<u4").tobytes() for i in ids[k : k + 512]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([part] * len(some), pa.int32()), pa.array([seq] * len(some), pa.int32()),
                             pa.array(range(k, k + len(some)), pa.int32()), pa.array(names[k : k + 512], pa.int64()),
                             pa.array(some, pa.binary())], ["part", "seq", "at", "doc_id", "ids"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "part int, seq int, at int, doc_id long, ids binary")


def started(rows: DataFrame) -> DataFrame:
    """Rows ``part, seq, at, n_tokens`` with ``start``: the ids of all documents
    before. Sums run within a frame, over a part's frames, and over the parts,
    of which there are as many as files were written in one go."""
    frames = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("_n"))
    parts = before(frames.groupBy("part").agg(F.sum("_n").alias("_sum")), "part", "_sum")
    over = Window.partitionBy("part").orderBy("seq")
    frames = frames.withColumn("_frames", F.sum("_n").over(over) - F.col("_n")).join(parts, F.col("part") == F.col("_of"))
    frames = frames.select(F.col("part").alias("_p"), F.col("seq").alias("_s"), (F.col("_frames") + F.col("_before")).alias("_base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part", "seq").orderBy("at")) - F.col("n_tokens")
    return rows.withColumn("_within", within).join(frames, (F.col("part") == F.col("_p")) & (F.col("seq") == F.col("_s"))).withColumn(
        "start", F.col("_base") + F.col("_within")).drop("_p", "_s", "_base", "_within")
