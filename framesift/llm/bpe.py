"""Byte-level BPE by longest matches and backtracking, in time linear in the text.

The bytes of a piece are read as Latin-1, so that an Aho-Corasick automaton
over text finds every token in them. From the longest token at each place on,
tokens are taken while each goes with the one before: two tokens go together
if merging their joined bytes gives just these two. Where none of a place's
tokens does, the one before is given up for a shorter one and the place is not
tried again. What comes out is what the merges give, as a sequence is theirs
exactly if every two neighbours are.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched
from operator import methodcaller

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.batches import pieces

# How many pieces and pairs a worker remembers before it starts anew; none longer than these bytes.
PIECES, PAIRS, LONGEST = 300_000, 250_000, 64
BLOCK = 1 << 16


class Vocabulary:
    """Ranks of a file that has a token (base 64) and its rank on each line."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.found.add_word(token, (rank, len(token)))
        self.found.make_automaton()
        self.piece = methodcaller("group")
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.together: dict[int, bool] = {}
        self.sizes = [0] * (max(self.tokens) + 1)
        # The longest token that a token starts with, itself apart; -1 if none.
        self.shorter = [-1] * len(self.sizes)
        for text, rank in self.ranks.items():
            self.sizes[rank] = len(text)
            self.shorter[rank] = next(
                (self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)

    def merged(self, text: str) -> list[int]:
        """A few bytes merged step by step, the lowest rank first."""
        parts = list(text)
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[part] for part in parts]

    def goes(self, before: int, token: int) -> bool:
        """Whether a token may follow another (-1: none, at the start); remembered."""
        if len(self.together) >= PAIRS:
            self.together.clear()
        both = [token] if before < 0 else [before, token]
        known = self.merged("".join(self.tokens[t] for t in both)) == both
        self.together[(before << 32) + token] = known
        return known

    def backtracked(self, text: str) -> list[int]:
        together, sizes, shorter = self.together.get, self.sizes, self.shorter
        longest = [-1] * (len(text) + 1)
        for end, (rank, length) in self.found.iter(text):
            longest[end - length + 1] = rank  # longer ones end later
        open_ = bytearray(b"\x01") * (len(text) + 1)
        taken: list[int] = []
        place, token, before = 0, longest[0], -1
        while place < len(text):
            pair = before << 32
            while token >= 0:
                end = place + sizes[token]
                if open_[end]:
                    goes = together(pair + token)
                    if goes or goes is None and self.goes(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                place, before, token = end, token, longest[end]
            else:
                open_[place] = 0
                token = taken.pop()
                place -= sizes[token]
                before = taken[-1] if taken else -1
        return taken

    def packed(self, piece: str) -> bytes:
        """One piece's ids as little-endian unsigned 32-bit numbers."""
        text = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.ranks.get(text)
        ids = [whole] if whole is not None else self.backtracked(text)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= LONGEST:
            if len(self.known) >= PIECES:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        known, packed = self.known.get, self.packed
        return b"".join(
            b"".join([known(p) or packed(p) for p in block])
            for block in batched(map(self.piece, self.pattern.finditer(text)), BLOCK))

    def decode(self, ids: bytes) -> bytes:
        token, step = self.bytes.__getitem__, 4 * BLOCK
        return b"".join(
            b"".join(map(token, memoryview(ids[k : k + step]).cast("I"))) for k in range(0, len(ids), step))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read once a worker."""
    return Vocabulary(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
            decode: bool = False) -> DataFrame:
    """``doc_id, ids, n_tokens``, a row for each row given; with ``decode`` also
    ``decoded``, the bytes the ids stand for, made by the same worker: another
    step for it (:func:`decoded`) has a worker and a vocabulary of its own for each task.

    ``ids`` are little-endian unsigned 32-bit numbers; none for a null or empty
    text. Each match of the pattern is encoded by itself, without special
    tokens. Equal texts have equal ids; rows without an id are encoded too;
    other columns are left out whatever they're called. ``path`` is a file
    every executor has. A task holds a few megabytes of texts at a time, or
    one text that is longer; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(path, pattern)
        for piece in pieces(batches, "text"):
            ids = [of.encode(t) if t else b"" for t in piece.column("text").to_pylist()]
            made = [piece.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
            if decode:
                made.append(pa.array([of.decode(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "ids", "n_tokens", "decoded"][: len(made)])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens long" + ", decoded binary" * decode)


def decoded(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded``'s rows with ``decoded``, the bytes their ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(path, pattern).decode
        for piece in pieces(batches, "ids"):
            texts = [decode(i) if i else b"" for i in piece.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.array(texts, pa.binary())], [*piece.schema.names, "decoded"])

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", decoded binary")
