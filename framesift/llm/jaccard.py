"""Texts alike by the Jaccard similarity of their word shingles, by parity sketches.

A text's set is sketched by XOR: its shingles fall into the segments of a long
sparse row of bits, each turning over one bit, and a segment is known by the
XOR of its set bits' numbers. A shingle that only one of two texts has spoils
one segment, so the segments in which two texts differ are no more than their
symmetric difference; two texts that link differ in at most a seventh of their
sizes' sum, hence a third of the smaller. Of any one more segments than that,
one is equal: texts that share none can't link. A dense sketch of the same
kind then bounds the difference of those that do, and sets decide.

Segments are compared in a fixed order, those with rarer shingles first, and a
text offers only its first third plus one: if two texts share a segment, then
their first shared one is among these of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.batches import pieces
from framesift.llm.components import components
from framesift.llm.shared import settled
from framesift.llm.shingles import mixed, shingles

U = np.uint64
SKETCH = 8  # words of 64 bits in the dense sketch
# Sets of more shingles have one of so many words besides, which folds to the short one.
WIDE, LARGE = 64, 512
BAND = 16  # sizes in a band differ by less than this factor
# Keys a task holds before it sends them on.
HELD = 1 << 20


@dataclass(frozen=True)
class Alike:
    """Texts link where 100 * |A and B| >= ``percent`` * |A or B|, over
    shingles of ``words`` words. Shingles are counted in ``slots`` counters."""

    words: int = 5
    percent: int = 75
    slots: int = 1 << 22


def most_apart(sizes: int, percent: int) -> int:
    """The symmetric difference of linked sets can't be larger, given their sizes' sum."""
    return (100 - percent) * sizes // (100 + percent)


def bands(size: int, percent: int) -> range:
    """The bands a set is offered in: its own, and the next if a larger partner may be there."""
    def band(n: int) -> int:
        b = 0
        while n >= BAND ** (b + 1):
            b += 1
        return b

    return range(band(size), band(100 * size // percent) + 1)


def digest(found: np.ndarray) -> int:
    """A set's own number: equal sets have equal ones, others by a chance of 2^-64."""
    if not len(found):
        return 0
    return int(mixed(np.bitwise_xor.reduce(mixed(found + U(1)), keepdims=True) + U(len(found))).view(np.int64)[0])


def keys(found: np.ndarray, levels: np.ndarray, alike: Alike) -> np.ndarray:
    """The keys under which a set is offered: texts that link share one."""
    size, out = len(found), []
    level = levels[(found & U(len(levels) - 1)).astype(np.intp)].astype(U)
    # A partner is at most 100 / percent times as large.
    first = most_apart(size + 100 * size // alike.percent, alike.percent) + 1
    for band in bands(size, alike.percent):
        # About two shingles a segment in the band's largest sets, and less in others.
        segments = max(64, BAND ** (band + 1) // 2)
        segment = (found >> U(32)) * U(segments) >> U(32)  # sets are sorted, so segments come in order
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        salt = U((band + 1) * 0x9E3779B97F4A7C15 % 2**64)
        names = mixed(np.bitwise_xor.reduceat(mixed(found ^ salt), starts) + mixed(segment[starts] + salt))
        rare = np.minimum.reduceat(level, starts)
        order = np.lexsort((names, rare))
        out.append(names[order[:first]])
        if len(names) < first:
            # Too few segments to be sure that one is equal: such sets also meet by every shingle.
            out.append(mixed(found + salt))
    return np.concatenate(out)


def described(docs: DataFrame, alike: Alike, doc_id: str, text: str) -> DataFrame:
    """A row per document: ``doc_id, n, node, s0.., wide`` (its set's size, number
    and dense sketches), and rows ``slot, count`` of what each task counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(alike.slots, np.int64), 0
        for piece in pieces(batches, "text"):
            n, nodes, sketches, wide, slots = [], [], [], [], []
            for t in piece.column("text").cast(pa.binary()).to_pylist():
                found = shingles(t or b"", alike.words)
                n.append(len(found))
                nodes.append(digest(found) if len(found) else None)
                bits = np.bincount((found >> U(7)).astype(np.intp) & (64 * WIDE - 1), minlength=64 * WIDE) & 1
                sketch = np.packbits(bits.astype(np.uint8)).view(np.int64)
                sketches.append(np.bitwise_xor.reduce(sketch.reshape(-1, SKETCH), 0))
                wide.append(sketch if len(found) > LARGE else None)
                slots.append((found & U(alike.slots - 1)).astype(np.intp))
            slots = np.concatenate(slots)
            total += len(slots)
            counts += np.bincount(slots, minlength=alike.slots)
            columns = np.stack(sketches)
            nothing = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()),
                 *[pa.array(columns[:, k]) for k in range(SKETCH)], pa.array(wide, pa.list_(pa.int64())), nothing, nothing], names)
        # Slots that stand out here; the others are what rare shingles make.
        often = np.flatnonzero(counts >= max(5, 4 * total / alike.slots))
        nothing = pa.nulls(len(often), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [nothing, nothing, nothing, *[nothing] * SKETCH, pa.nulls(len(often), pa.list_(pa.int64())),
             pa.array(often), pa.array(counts[often])], names)

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    names = ["doc_id", "n", "node", *sketch_columns(), "wide", "slot", "count"]
    return given.mapInArrow(run, ", ".join(f"{name} {'array<long>' if name == 'wide' else 'long'}" for name in names))


def sketch_columns() -> list[str]:
    return [f"s{k}" for k in range(SKETCH)]


def levels_of(counted: DataFrame, alike: Alike) -> np.ndarray:
    """How common each slot's shingles are, as a power of two: one number a slot."""
    levels = np.zeros(alike.slots, np.uint8)
    often = counted.groupBy("slot").agg(F.sum("count").alias("count")).select(
        "slot", F.floor(F.log2("count")).cast("int").alias("level"))
    rows = often.toArrow()  # no more than slots
    levels[rows.column("slot").to_numpy()] = rows.column("level").to_numpy()
    return levels


def offered(docs: DataFrame, levels: np.ndarray, alike: Alike, text: str) -> DataFrame:
    """``key, node, hub``: what documents are offered under. Where more than one
    set has a key within what a task holds, one is the others' hub and stands
    for them outside (its own row names itself), so that a key has no more
    rows to be shuffled than there are such parts."""

    def flush(parts: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
        key = np.concatenate([k for k, _ in parts]).view(np.int64)
        node = np.repeat(np.array([n for _, n in parts], np.int64), [len(k) for k, _ in parts])
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        keep = first | np.concatenate(([True], node[1:] != node[:-1]))
        key, node, first = key[keep], node[keep], first[keep]
        group = np.cumsum(first) - 1
        size = np.bincount(group)
        hub = node[np.flatnonzero(first)][group]
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(node), pa.array(hub, mask=size[group] == 1)], ["key", "node", "hub"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for piece in pieces(batches, "text"):
            for t in piece.column("text").cast(pa.binary()).to_pylist():
                found = shingles(t or b"", alike.words)
                if len(found):
                    parts.append((keys(found, levels, alike), digest(found)))
                    held += len(parts[-1][0])
                if held >= HELD:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, node long, hub long")


def met(rows: DataFrame) -> DataFrame:
    """``key, node, hub`` of the keys that more than one set has, with a hub for
    all of a key's rows that stand for a part, and the part's hub for the others."""
    # Rows that a hub stands for are spread; only hubs and lone rows of a key come together.
    lone = F.col("hub").isNull() | (F.col("hub") == F.col("node"))
    spread = rows.withColumn("_salt", F.when(lone, 0).otherwise(F.pmod("node", F.lit(1021)) + 1))
    window = Window.partitionBy("key", "_salt")
    sized = spread.withColumns({"_least": F.min("node").over(window), "_most": F.max("node").over(window)})
    return sized.where("hub IS NOT NULL OR _least < _most").select(
        "key", "node", F.when(F.col("_salt") == 0, F.col("_least")).otherwise(F.col("hub")).alias("hub"))


def apart(x: str, y: str) -> Column:
    """In how many bits the short sketches of two columns of structs differ."""
    return sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in sketch_columns()), F.lit(0))


def apart_wide(x: str, y: str) -> Column:
    """The same of wide sketches; null if one has none."""
    return F.aggregate(
        F.zip_with(F.col(f"{x}.wide"), F.col(f"{y}.wide"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)


def could_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes and sketches allow two sets (structs ``n, s0.., wide``) to link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = (100 - percent) * (n + m)
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & ((100 + percent) * apart(x, y) <= most)
        & ((100 + percent) * F.coalesce(apart_wide(x, y), F.lit(0)) <= most))


def sketched(nodes: DataFrame, node: str, sketch: str) -> DataFrame:
    """Each node with its size and sketches as one column."""
    return nodes.select(F.col("node").alias(node), F.struct("n", *sketch_columns(), "wide").alias(sketch))


def plausible(pairs: DataFrame, nodes: DataFrame, alike: Alike) -> DataFrame:
    """The pairs ``a, b`` that all sketches allow to link."""
    return pairs.join(sketched(nodes, "a", "x"), "a").join(sketched(nodes, "b", "y"), "b").where(
        could_link("x", "y", alike.percent)).select("a", "b")


def sets(docs: DataFrame, wanted: DataFrame, alike: Alike, doc_id: str, text: str) -> DataFrame:
    """``node, hashes`` of the nodes in ``wanted`` (``node, doc_id``: one document each).

    Texts are read where they lie and only those hashed whose ids fall in the
    same slots as wanted ones: a bitmap of fixed size, however many there are.
    Rows that repeat an id may give a node more than once.
    """
    slots = 1 << 22
    marked = np.zeros(slots // 64, np.uint64)
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("slot")
    rows = wanted.where("doc_id IS NOT NULL").select(slot).groupBy(
        F.floor(F.col("slot") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 AS int))")).alias("bits"))
    found = rows.toArrow()  # slots / 64 rows at most
    marked[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            nodes, hashes = [], []
            for at, t in zip(piece.column("slot").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist()):
                if t and (at is None or int(marked[at >> 6]) >> (at & 63) & 1):
                    found = shingles(t, alike.words)
                    if len(found):
                        nodes.append(digest(found))
                        hashes.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes, pa.binary())], ["node", "hashes"])

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.select(F.when(F.col("doc_id").isNotNull(), slot).alias("slot"), "text").mapInArrow(run, "node long, hashes binary")


def verified(pairs: DataFrame, known: DataFrame, alike: Alike) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                links = []
                for left, right in zip(piece.column("left").to_pylist(), piece.column("right").to_pylist()):
                    x, y = np.frombuffer(left, U), np.frombuffer(right, U)
                    both = np.sort(np.concatenate((x, y)))
                    shared = int((both[1:] == both[:-1]).sum())
                    links.append(100 * shared >= alike.percent * (len(both) - shared))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("a"), piece.column("b")], ["a", "b"]).filter(pa.array(links, pa.bool_()))

    joined = (
        pairs.join(known.select(F.col("node").alias("b"), F.col("hashes").alias("right")), "b")
        .join(known.select(F.col("node").alias("a"), F.col("hashes").alias("left")), "a"))
    return joined.mapInArrow(run, "a long, b long")


def joined(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alike: Alike = Alike()) -> DataFrame:
    """``doc_id, n_shingles, component_id``, a row for each row given.

    ``component_id`` is the smallest id that links reach, rows' own included.
    A text without words (null or empty) has no shingles and is linked with
    nothing; one with fewer words than a shingle is one shingle. Rows with
    equal texts link, also where they repeat an id; rows without an id link
    like others but don't name a component, whose id is null if no row of it
    has one. Other columns are left out whatever they're called; an empty
    table gives an empty one.

    Sets are numbered by their contents, so copies are one node from the start
    and never paired. Keys of a node meet in one shuffle in which a key that
    many nodes have has one row a part of the input; each key's nodes are
    first compared with one of them. Nodes that came together so need no more
    comparing. Of keys that still hold more than one component, those with
    the same nodes are one, and those with mostly the same are put together; in
    them components are compared by bounds for all their nodes, then nodes with
    components, and pairs are made only of nodes that sketches leave, so no
    link that joins components is lost. Sketches
    tell sets of up to some 8,000 shingles apart; larger ones that share an
    offered segment and don't link are paired within their key.
    """
    about = settled(described(docs, alike, doc_id, text), "sets")
    levels = levels_of(about.where("slot IS NOT NULL"), alike)
    rows = about.where("slot IS NULL").drop("slot", "count")
    nodes = settled(rows.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in ("n", *sketch_columns(), "wide")]), "nodes")
    groups = settled(met(offered(docs, levels, alike, text)), "met")
    pairs = settled(plausible(star(groups), nodes, alike), "pairs")
    links = settled(linked(docs, pairs, nodes, alike, doc_id, text), "links")
    roots = settled(components(links), "roots")
    open_ = settled(gathered(settled(still_open(groups, roots), "open")), "gathered")
    more = across(open_, nodes, alike).join(pairs, ["a", "b"], "left_anti")
    more = settled(plausible(more, nodes, alike), "pairs")
    if not more.isEmpty():
        links = linked(docs, more, nodes, alike, doc_id, text).union(
            roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = settled(components(settled(links, "links")), "roots")
    named = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows"))
    least = least.where("_rows > 1").drop("_rows")
    return named.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_least", "doc_id").alias("component_id"))


def star(groups: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of a node and a hub."""
    return groups.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def linked(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, alike: Alike, doc_id: str, text: str) -> DataFrame:
    """Those of the pairs whose sets link."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = settled(nodes.join(wanted, "node", "left_semi").select("node", "doc_id"), "wanted")
    return verified(pairs, settled(sets(docs, wanted, alike, doc_id, text), "hashes"), alike)


def still_open(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, root, node`` of the keys whose nodes lie in more than one
    component. A part's own hub stands in the key's rows too, so the key's
    nodes are all there. Of keys that the very same nodes have (two texts with
    a page in common share a key for every few words of it) only one stays;
    sets of nodes are known by two 64-bit hashes and their size."""
    members = groups.select("key", "node").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = members.groupBy("key").agg(
        F.min("root").alias("_l"), F.max("root").alias("_m"), F.count("*").alias("_rows"),
        *[F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_h{k}") for k in range(2)]).where("_l < _m")
    split = split.groupBy("_h0", "_h1", "_rows").agg(F.min("key").alias("key")).select("key")
    return members.join(split, "key", "left_semi").select("key", "root", "node")


def gathered(open_: DataFrame) -> DataFrame:
    """The rows ``key, root, node`` with keys put together that mostly the same nodes have.

    Texts of one origin share many keys, each had by most of them, and a pair
    would be met under every one. Keys are put together by the node that
    comes first by hash, or by those that do by two hashes: keys with a share s
    of their nodes in common have the same with a chance of s, or its square.
    No pair that shared a key is lost by that, and only groups are put together
    in which there are no more pairs to compare than under their keys
    one by one; so nothing grows where nodes have little in common.
    """
    keys = settled(open_.groupBy("key").agg(
        F.count("*").alias("_n"), *[F.min(F.xxhash64("node", F.lit(k))).alias(f"_f{k}") for k in range(2)]), "keys")

    def together(*firsts: str) -> DataFrame:
        placed = keys.select("key", "_n", F.xxhash64(*firsts).alias("_group"))
        nodes = open_.join(placed, "key").select("_group", "node").distinct().groupBy("_group").agg(F.count("*").alias("_nodes"))
        pairs = placed.groupBy("_group").agg(F.sum(F.col("_n") * F.col("_n")).alias("_pairs"), F.count("*").alias("_keys"))
        fit = pairs.where("_keys > 1").join(nodes, "_group").where("_nodes * _nodes <= _pairs")
        return placed.join(fit, "_group", "left_semi").select("key", F.col("_group").alias(f"_by{len(firsts)}"))

    named = keys.join(together("_f0"), "key", "left").join(together("_f0", "_f1"), "key", "left").select(
        "key", F.coalesce("_by1", "_by2", "key").alias("_group"))
    return open_.join(named, "key").select(F.col("_group").alias("key"), "root", "node").distinct()


def cells(open_: DataFrame, nodes: DataFrame, alike: Alike) -> tuple[DataFrame, DataFrame]:
    """An open key's nodes of one component are a cell: ``key, root, node, x``
    (the node's sketches) and ``key, root, c`` of cells.

    Sketches' distance keeps to the triangle inequality, so a cell's first node
    bounds the others': with r and q the first nodes of two cells, x and y
    nodes of them, d(r, q) <= d(r, x) + d(x, y) + d(y, q), and d(x, y) is at
    most ``percent``'s share of n(x) + n(y) if they link. ``c.reach`` is the most
    that a cell's nodes add to the right side, in units of 1 / (100 + percent).
    """
    known = open_.join(sketched(nodes, "node", "x"), "node")
    firsts = open_.groupBy("key", "root").agg(F.min("node").alias("_first")).join(sketched(nodes, "_first", "first"), "_first")
    placed = known.join(firsts.drop("_first"), ["key", "root"])
    whole, left = 100 + alike.percent, (100 - alike.percent) * F.col("x.n")
    reach = placed.groupBy("key", "root").agg(
        F.max(whole * apart("x", "first") + left).alias("reach"),
        F.when(F.every(F.col("x.wide").isNotNull()), F.max(whole * apart_wide("x", "first") + left)).alias("far"),
        F.min("x.n").alias("least"), F.max("x.n").alias("most"))
    found = firsts.join(reach, ["key", "root"]).select("key", "root", F.struct("first.*", "reach", "far", "least", "most").alias("c"))
    return known, found


def near(x: str, y: str, reach: str, far: str, percent: int) -> Column:
    """Whether sketches are as near as both sides' reach allows."""
    whole = 100 + percent
    return (whole * apart(x, y) <= F.expr(reach)) & F.coalesce(whole * apart_wide(x, y) <= F.expr(far), F.lit(True))


def across(open_: DataFrame, nodes: DataFrame, alike: Alike) -> DataFrame:
    """The pairs ``a, b`` of an open key's nodes in two components that sketches allow.

    Cells are compared first, then each node with the other's cell, and only
    nodes that may have a partner there with each other.
    """
    percent, left = alike.percent, 100 - alike.percent
    known, found = cells(open_, nodes, alike)
    known, found = settled(known, "members"), settled(found, "cells")
    p = found.select("key", F.col("root").alias("p"), F.col("c").alias("u"))
    q = found.select("key", F.col("root").alias("q"), F.col("c").alias("v"))
    sides = settled(p.join(q, "key").where(
        (F.col("p") < F.col("q"))
        & (100 * F.col("u.most") >= percent * F.col("v.least")) & (100 * F.col("v.most") >= percent * F.col("u.least"))
        & near("u", "v", "u.reach + v.reach", "u.far + v.far", percent)), "sides")

    def side(own: str, other: str, node: str, sketch: str) -> DataFrame:
        mine = known.select("key", F.col("root").alias(own), F.col("node").alias(node), F.col("x").alias(sketch))
        return mine.join(sides.select("key", "p", "q", F.col(other).alias("o")), ["key", own]).where(
            near(sketch, "o", f"{left} * {sketch}.n + o.reach", f"{left} * {sketch}.n + o.far", percent)).select(
            "key", "p", "q", node, sketch)

    pairs = side("p", "v", "a", "x").join(side("q", "u", "b", "y"), ["key", "p", "q"]).where(could_link("x", "y", percent))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
