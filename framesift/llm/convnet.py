"""A small convolutional network over bytes that scores whole texts, in numpy.

Filters see ``WIDTH`` bytes each and slide over a whole text. Overlapping
chunks keep each filter's highest response; the mean, highest and lowest of
these over a text's chunks are weighed into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.batches import pieces

WIDTH, FILTERS = 6, 16
# Chunks are two halves long and start at every half.
HALF = 256
# Halves looked at in one go, so that memory doesn't grow with a text.
HALVES = 96


@dataclass(frozen=True)
class Fit:
    """What a fit may look at and how long it takes: at most ``sample`` labelled
    documents of each kind, of longer ones ``spans`` spread pieces of ``span``
    characters."""

    sample: int = 1000
    spans: int = 4
    span: int = 2048
    rounds: int = 14
    batch: int = 16
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


class Network:
    def __init__(self, filters: np.ndarray, bias: np.ndarray, weights: np.ndarray, offset: float):
        self.filters, self.bias, self.weights, self.offset = filters, bias, weights, offset
        self.pairs: list[np.ndarray] | None = None

    @staticmethod
    def fresh(random: np.random.Generator) -> Network:
        return Network(
            random.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
            random.normal(0, 0.1, 3 * FILTERS + 2).astype(np.float32), 0.0)

    def __reduce__(self):
        return Network, (self.filters, self.bias, self.weights, self.offset)

    def ready(self) -> None:
        """Two neighbouring bytes' parts added up beforehand, for scoring."""
        if self.pairs is None:
            f = self.filters
            self.pairs = [
                np.ascontiguousarray((f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS))
                for k in range(0, WIDTH, 2)]
            self.pairs[0] = self.pairs[0] + self.bias

    def halves(self, text: bytes) -> np.ndarray:
        """Each filter's highest response in each half chunk."""
        seen = np.frombuffer(text + bytes(max(0, WIDTH - len(text))), np.uint8)
        both = seen[:-1].astype(np.intp) * 256 + seen[1:]
        places = len(seen) - WIDTH + 1
        found = []
        for start in range(0, places, HALF * HALVES):
            end = min(places, start + HALF * HALVES)
            response = self.pairs[0].take(both[start:end], 0)
            for k, table in enumerate(self.pairs[1:], 1):
                response += table.take(both[start + 2 * k : end + 2 * k], 0)
            found.append(np.maximum.reduceat(response, np.arange(0, end - start, HALF), 0))
        return np.maximum(np.concatenate(found), 0)

    def score(self, text: bytes) -> float:
        self.ready()
        pooled, _ = chunks(self.halves(text))
        return float(1 / (1 + np.exp(-np.clip(self.summed(pooled, len(text)) @ self.weights + self.offset, -50, 50))))

    @staticmethod
    def summed(pooled: np.ndarray, length: int) -> np.ndarray:
        """A text's chunks in one row, with how full the first is: a short text
        can't wake many filters."""
        empty = 1 - min(length, 2 * HALF) / (2 * HALF)
        return np.concatenate([pooled.mean(0), pooled.max(0), pooled.min(0), [empty, empty**8]])

    def learn(self, text: bytes, label: int, steps: dict[str, np.ndarray]) -> None:
        """Add one text's part of the gradient to ``steps``."""
        seen = np.frombuffer(text + bytes(max(0, WIDTH - len(text))), np.uint8)
        places = len(seen) - WIDTH + 1
        response = self.filters[0][seen[:places]] + self.bias
        for k in range(1, WIDTH):
            response += self.filters[k][seen[k : k + places]]
        padded = np.full((-(-places // HALF) * HALF, FILTERS), -1e9, np.float32)
        padded[:places] = response
        padded = padded.reshape(-1, HALF, FILTERS)
        best = padded.argmax(1)
        highest = np.take_along_axis(padded, best[:, None, :], 1)[:, 0]
        best += np.arange(len(padded))[:, None] * HALF
        pooled, second = chunks(np.maximum(highest, 0))
        rows = np.arange(len(pooled))[:, None] + second
        columns = np.broadcast_to(np.arange(FILTERS), rows.shape)
        z = self.summed(pooled, len(text))
        away = 1 / (1 + np.exp(-np.clip(z @ self.weights + self.offset, -50, 50))) - label
        steps["weights"] += away * z
        steps["offset"] += away
        g = (away * self.weights[: 3 * FILTERS]).reshape(3, FILTERS)
        back = np.repeat(g[:1] / len(pooled), len(pooled), 0)
        back[pooled.argmax(0), np.arange(FILTERS)] += g[1]
        back[pooled.argmin(0), np.arange(FILTERS)] += g[2]
        back *= pooled > 0
        at = best[rows, columns]
        steps["bias"] += back.sum(0)
        for k in range(WIDTH):
            np.add.at(steps["filters"][k], (seen[at + k], columns), back)


def chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of two neighbouring halves, and which of the two had the higher response."""
    if len(halves) == 1:
        return halves, np.zeros(halves.shape, np.intp)
    second = halves[1:] > halves[:-1]
    return np.where(second, halves[1:], halves[:-1]), second.astype(np.intp)


def fitted(examples: list[tuple[bytes, int]], good: float, fit: Fit = Fit()) -> Network:
    """A network learned from texts marked 1 or 0, where ``good`` is the share
    of 1 among all labels: kinds may be sampled at other rates than they have."""
    random = np.random.default_rng(fit.seed)
    net = Network.fresh(random)
    ones = sum(label for _, label in examples)
    if not 0 < ones < len(examples) or not 0 < good < 1:
        # Nothing to tell apart: every text gets the labels' share.
        share = min(max(good, 1e-6), 1 - 1e-6)
        return Network(np.zeros_like(net.filters), net.bias, np.zeros_like(net.weights), float(np.log(share / (1 - share))))
    names = ("filters", "bias", "weights", "offset")
    first = {n: np.zeros_like(np.asarray(getattr(net, n), np.float32)) for n in names}
    second = {n: np.zeros_like(v) for n, v in first.items()}
    turn = 0
    kinds = [[e for e in examples if e[1] == label] for label in (0, 1)]
    for round_ in range(fit.rounds):
        # Every batch has as many of either kind; the rarer one's texts come round again.
        size = max(map(len, kinds))
        orders = [np.resize(random.permutation(len(k)), size) for k in kinds]
        for start in range(0, size, fit.batch // 2):
            steps = {n: np.zeros_like(v) for n, v in first.items()}
            picked = [kinds[label][k] for label in (0, 1) for k in orders[label][start : start + fit.batch // 2]]
            for text, label in picked:
                net.learn(text, label, steps)
            turn += 1
            rate = fit.rate * (1 - round_ / fit.rounds)
            for n in names:
                g = steps[n] / len(picked) + fit.decay * np.asarray(getattr(net, n), np.float32)
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.99 * second[n] + 0.01 * g * g
                step = rate * (first[n] / (1 - 0.9**turn)) / (np.sqrt(second[n] / (1 - 0.99**turn)) + 1e-6)
                setattr(net, n, getattr(net, n) - step.astype(np.float32))
    net.offset = float(net.offset) + float(np.log(good / (1 - good)))
    return net


def learned(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), doc_id: str = "doc_id", text: str = "text",
            label: str = "quality") -> Network:
    """A network fitted on this process to a bounded sample of labelled texts.

    The sample is the ``fit.sample`` documents of each kind that come first by
    the hash of their id; documents with both labels, without an id or whose
    label is neither 0 nor 1 aren't learned from. Texts are cut to their spans
    before they leave the executors, so what comes here has a fixed bound.
    """
    marked = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_least"), F.max(label).alias("label"))
        .where("_least = label").select("_id", "label"))
    by_hash = [F.xxhash64("_id"), F.col("_id")]
    picked = [marked.where(F.col("label") == k).orderBy(*by_hash).limit(fit.sample) for k in (0, 1)]
    t, length = F.coalesce(F.col(text), F.lit("")), F.length(text)
    apart = (length - fit.span) / (fit.spans - 1)
    spans = F.concat(*[t.substr((F.floor(apart * k) + 1).cast("int"), F.lit(fit.span)) for k in range(fit.spans)])
    cut = F.when(length > fit.spans * fit.span, spans).otherwise(t)
    # Never more than two times the sample's ids.
    rows = (
        docs.select(F.col(doc_id).alias("_id"), text)
        .join(F.broadcast(picked[0].union(picked[1])), "_id")
        .groupBy("_id").agg(F.min(cut).alias("text"), F.first("label").alias("label"))
        .collect())
    rows.sort(key=lambda r: r["_id"])
    good = marked.agg(F.avg("label")).first()[0]
    return fitted([(r["text"].encode(), int(r["label"])) for r in rows], 0.5 if good is None else good, fit)


def scored(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score``, a row for each row given: the whole text's probability of label 1.

    A null text is scored as an empty one, which is ``WIDTH`` zero bytes; equal
    texts have equal scores; ids may be null or repeated; other columns are
    left out whatever they're called. Memory is that of one piece of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            scores = pa.array([net.score(t or b"") for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), scores], ["doc_id", "score"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, score double")
