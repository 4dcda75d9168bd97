"""Runs of repeated words: stretches that a phrase fills at least four times over.

A text's words are numbers, and its repetitions come from two suffix trees,
one of the words and one of the words backwards: by the lowest node between
two leaves each tells how far two places agree, in constant time. Where a
repetition's last word breaks its period, one of the two orders of the words
makes its roots Lyndon words, the longest that begin where they do; so two
candidates a place, each extended both ways, are all there is to try.

Trees are built over those stretches alone whose phrases of five words come
again in the same stretch, which every repetition's do; a text without any has
no tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.batches import pieces

WORDS = re.compile(rb"[^ \t-\r]+")
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
FEWEST, TIMES, PHRASE = 6, 4, 5
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Tree:
    """A suffix tree of numbers, the last of which comes nowhere else, for the
    longest common extensions of its suffixes and their order."""

    def __init__(self, text: list[int]):
        self._grow(text)
        self._tour(len(text))

    def _grow(self, text: list[int]) -> None:
        """Ukkonen's construction: a symbol at a time, going on along suffix links
        from where the last symbol left off. Node 0 is the root; the leaf of
        suffix ``k`` is the ``k``-th leaf made."""
        n, wide = len(text), max(text) + 1
        begin, end, link, leaves, edges = [0], [0], [0], [], {}
        node = edge = held = open_ = 0
        for i, c in enumerate(text):
            open_ += 1
            last = 0
            while open_:
                if not held:
                    edge = i
                key = node * wide + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(begin)
                    leaves.append(len(begin))
                    begin.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    span = min(end[child], i + 1) - begin[child]
                    if held >= span:
                        edge, held, node = edge + span, held - span, child
                        continue
                    at = begin[child]
                    if text[at + held] == c:
                        if last:
                            link[last] = node
                        held += 1
                        break
                    middle = len(begin)
                    edges[key] = middle
                    begin += (at, i)
                    end += (at + held, n)
                    link += (0, 0)
                    leaves.append(middle + 1)
                    edges[middle * wide + c] = middle + 1
                    begin[child] = at + held
                    edges[middle * wide + text[at + held]] = child
                    if last:
                        link[last] = middle
                    last = middle
                open_ -= 1
                if node:
                    node = link[node]
                elif held:
                    held -= 1
                    edge = i - open_ + 1
        self._begin, self._end, self._leaves, self._wide = begin, end, leaves, wide
        self._keys = np.fromiter(edges.keys(), np.int64, len(edges))
        self._nodes = np.fromiter(edges.values(), np.int64, len(edges))

    def _tour(self, n: int) -> None:
        """The tour round the tree, kept as the leaves in order and the depth of
        the lowest node passed from each leaf to the next."""
        order = np.argsort(self._keys)
        parents = self._keys[order] // self._wide
        children = self._nodes[order].tolist()
        firsts = np.searchsorted(parents, np.arange(len(self._begin) + 1)).tolist()
        parent = np.zeros(len(self._begin), np.int64)
        parent[self._nodes] = self._keys // self._wide
        parent, spans = parent.tolist(), (np.array(self._end) - np.array(self._begin)).tolist()
        depth, stack, low, line, lows = [0] * len(parent), [0], n, [], []
        while stack:
            v = stack.pop()
            up = depth[parent[v]]
            if up < low:
                low = up
            a, b = firsts[v], firsts[v + 1]
            if a == b:
                line.append(v)
                lows.append(low)
                low = n
            else:
                depth[v] = up + spans[v] if v else 0
                stack += children[a:b][::-1]
        place = np.zeros(len(parent), np.int64)
        place[line] = np.arange(n)
        self.rank = place[self._leaves]
        self._table = [np.array(lows, np.int32)]
        while 2 << (len(self._table) - 1) <= n:
            last, step = self._table[-1], 1 << (len(self._table) - 1)
            self._table.append(np.minimum(last[:-step], last[step:]))
        del self._begin, self._end, self._leaves, self._keys, self._nodes

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at ``a`` and ``b`` (never the same) share."""
        x, y = self.rank[a], self.rank[b]
        x, y = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(y - x)[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level):
            some = level == k
            out[some] = np.minimum(self._table[k][x[some]], self._table[k][y[some] - (1 << int(k))])
        return out


def lyndon(rank: list[int]) -> list[int]:
    """For each suffix how far on the next one of lower rank begins: the length of
    the longest Lyndon word there."""
    n = len(rank)
    out, stack = [n - i for i in range(n)], []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            j = stack.pop()
            out[j] = i - j
        stack.append(i)
    return out


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """From where to where a text's repetitions can lie: each place begins a
    phrase that comes again in the stretch, or belongs to one."""
    n = len(ids) - PHRASE + 1
    if n < 2:
        return []
    phrase = np.zeros(n, np.uint64)
    for k in range(PHRASE):
        phrase = (phrase ^ (phrase >> np.uint64(29))) * _FACTOR + ids[k : k + n]
    places, seen = np.arange(n), -1
    while len(places) != seen:
        seen = len(places)
        fresh = np.diff(places, prepend=-2) != 1
        key = phrase[places] + np.cumsum(fresh).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        order = np.sort(key)
        again = order[1:][order[1:] == order[:-1]]
        if not len(again):
            return []
        at = np.minimum(np.searchsorted(again, key), len(again) - 1)
        places = places[again[at] == key]
    begins = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    ends = np.append(begins[1:], len(places)) - 1
    return [(int(places[a]), int(places[b]) + PHRASE) for a, b in zip(begins, ends) if b > a]


def runs(ids: np.ndarray) -> np.ndarray:
    """The runs of a text as rows ``start, length, period``, by start, then period."""
    found = stretches(ids)
    if not found:
        return np.zeros((0, 3), np.int64)
    top = int(ids.max()) + 1
    parts, places = [], []
    for k, (a, b) in enumerate(found):
        parts += (ids[a:b], [top + k])
        places.append(np.arange(a, b + 1))
    whole, place = np.concatenate(parts).astype(np.int64), np.concatenate(places)
    n = len(whole)
    ahead = Tree(whole.tolist())
    back = Tree([*whole[::-1].tolist(), top + len(found)])
    rank = ahead.rank
    first = np.tile(np.arange(n), 2)
    period = np.array(lyndon(rank.tolist()) + lyndon((n - rank).tolist()))
    fits = first + period < n
    first, period = first[fits], period[fits]
    end = first + period + ahead.common(first, first + period)
    start = first.copy()
    some = first > 0
    start[some] -= back.common(n - first[some], n - first[some] - period[some])
    length = end - start
    keep = length >= np.maximum(FEWEST, TIMES * period)
    rows = np.unique(np.stack((place[start[keep]], length[keep], period[keep]), axis=1), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def examined(text: bytes) -> tuple[np.ndarray, bytes]:
    """A text's runs, and the text without what comes after each run's first period."""
    words = WORDS.findall(text)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    found = runs(ids)
    if not len(found):
        return found, b" ".join(words)
    over = np.zeros(len(words) + 1, np.int64)
    np.add.at(over, found[:, 0] + found[:, 2], 1)
    np.add.at(over, found[:, 0] + found[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(over)[:-1] == 0)
    return found, b" ".join([words[k] for k in kept])


def detected(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed``: each text's runs, and its words but for what repeats.

    A run is a stretch of words with smallest period ``q`` (words ``q`` apart
    are the same) and at least ``4 * q`` and six words long, that neither
    neighbour continues; ``runs`` has them by start (the first word is 0), then
    period. ``collapsed`` keeps the words that no run holds after its first
    ``q``, one space between them. Words are what ASCII white space parts.

    A null or empty text has no runs and an empty ``collapsed``. Rows are taken
    each by itself, where they lie: equal rows and ids, and nulls in ids, give
    rows alike. Other columns are left out whatever they're called; an empty
    table gives an empty one. Texts are held whole, and for each word in a
    stretch that may hold runs some 750 bytes of trees.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            lists, texts = [], []
            for t in piece.column("text").cast(pa.binary()).to_pylist():
                found, rest = examined(t or b"")
                lists.append(found)
                texts.append(rest)
            offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.concatenate(lists)
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), rows), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, runs {RUNS}, collapsed string")
