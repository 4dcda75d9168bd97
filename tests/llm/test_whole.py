"""Operators on whole tables of texts: repeated words, manifests, repeated passages."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framesift.llm import merkle, periodic, suffixes

SCHEMA = "doc_id long, text string, lang string, n_chars long, k1 string, file string, rank string"


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and long texts, repeated rows and ids, ties."""
    r = random.Random(11)

    def prose(n, words=400):
        return " ".join(f"w{r.randrange(words)}é" if r.random() < 0.1 else f"v{r.randrange(words)}" for _ in range(n))

    passage, line = prose(110), prose(12) + "\n"
    rows = [(k, prose(r.choice([1, 5, 30, 150, 400]))) for k in range(30)]
    rows += [(100, None), (101, ""), (102, " \n "), (103, prose(4000)), (104, line * 90), (105, "a " * 900), (106, "é" * 900), (107, "=" * 4000)]
    rows += [(110 + k, prose(r.randint(0, 200)) + passage + prose(r.randint(0, 200))) for k in range(12)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[9][1]), (None, None), (130, rows[33][1]), (131, rows[33][1] + "!"), (132, "x" + line * 8)]
    rows += [(140 + k, (prose(9) + " ") * k + prose(4)) for k in range(2, 9)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(d, t, None if k % 5 == 1 else "hot" if k % 3 else f"l{k % 4}", k, "x", "y", "z") for k, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def repetitions(w):
    """Every run, by comparing the words with themselves at each distance."""
    numbers, found = {}, []
    ids = np.array([numbers.setdefault(x, len(numbers)) for x in w])
    for q in range(1, len(w) // 4 + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids[q:] == ids[:-q], [False])).astype(int)))
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist()):
            length, part = end - start + q, w[start : end + q]
            if length >= max(6, 4 * q) and not any(q % d == 0 and part[d:] == part[:-d] for d in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_periodic(spark, docs, texts):
    def expected(t):
        w = re.findall(r"[^ \t-\r]+", t or "")
        found = repetitions(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        return found, " ".join(x for k, x in enumerate(w) if k not in gone)

    rows = periodic.detected(docs).collect()
    same([(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in rows], [(d, *expected(t)) for d, t in texts])
    assert sum(len(r.runs) > 0 for r in rows) > 6
    assert periodic.detected(docs.where("false")).count() == 0


def test_periodic_of_small_texts():
    """All kinds of overlapping, nested and touching runs."""
    r = random.Random(1)
    for _ in range(2500):
        kinds, n = r.choice([1, 2, 3, 5, 30]), r.randint(0, 60)
        w = [r.randrange(kinds) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            at, period = r.randint(0, n), [r.randrange(kinds) for _ in range(r.randint(1, 6))]
            w[at:at] = (period * r.randint(2, 8))[: r.randint(1, 40)]
        found, _ = periodic.examined(" ".join(map(str, w)).encode())
        assert list(map(tuple, found.tolist())) == repetitions(w), w


def test_suffix_tree():
    r = random.Random(4)
    for n in (1, 2, 3, 10, 50, 300):
        for kinds in (1, 2, 4, 40):
            text = [r.randrange(kinds) for _ in range(n)] + [kinds]
            tree = periodic.Tree(text)
            assert np.argsort(tree.rank).tolist() == sorted(range(n + 1), key=lambda k: text[k:])
            pairs = [(a, b) for a in range(n + 1) for b in range(n + 1) if a != b][:: max(1, n * n // 500)]
            a, b = map(np.array, zip(*pairs))
            shared = [next(k for k in range(n + 1) if text[x + k : x + k + 1] != text[y + k : y + k + 1]) for x, y in pairs]
            assert tree.common(a, b).tolist() == shared


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climbed(level, width):
    """The levels of a tree, leaves first."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + width]) for k in range(0, len(levels[-1]), width)])
    return levels


@pytest.mark.parametrize("width,copies", [(8, 1), (2, 1), (3, 4)])
def test_manifest(spark, docs, width, copies):
    docs = docs.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")) if copies > 1 else docs
    names = ["doc_id", "lang", "n_chars", "text"]
    leaves = docs.select("doc_id", "lang", "n_chars", merkle.row_digest(*map(F.col, names)).alias("digest"))
    made = merkle.manifest(leaves, "lang", ["doc_id"], width)
    rows = made.proofs().collect()

    def leaf(row):
        return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in names))

    expected, parts = [], {}
    for row in docs.collect():
        parts.setdefault(row.lang, []).append((row.doc_id is not None, row.doc_id or 0, leaf(row), row))
    order = sorted(parts, key=lambda x: (x is not None, x or ""))
    trees = {lang: climbed([x[2] for x in sorted(parts[lang], key=lambda x: x[:3])], width) for lang in order}
    top = climbed([trees[lang][-1][0] for lang in order], width)

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            first = k - k % width
            run = level[first : first + width]
            out.append((k - first, run[: k - first] + run[k - first + 1 :]))
            k //= width
        return out

    for at, lang in enumerate(order):
        for k, digest in enumerate(trees[lang][0]):
            expected.append((lang, k, digest, trees[lang][-1][0], path(trees[lang], k) + path(top, at)))
    assert made.root.hex() == top[-1][0]
    same([(r.lang, r["rank"], r.digest.hex(), r.subroot.hex(), [(s.digit, [o.hex() for o in s.others]) for s in r.path]) for r in rows], expected)
    # Some leaves alone: the same proofs, by fewer nodes.
    some = spark.createDataFrame([(r.part_number, r["rank"]) for r in rows if r["rank"] % 7 == 3], "part_number long, rank long")
    found = made.proofs(some.union(some)).collect()
    same(map(tuple, found), [tuple(r) for r in rows if r["rank"] % 7 == 3])
    assert made.proofs(some.limit(0)).count() == 0
    # Each path leads to the root, and to no other from another leaf.
    checked = made.proofs().select(
        (merkle.folded(F.col("digest"), F.col("path")) == F.lit(made.root)).alias("right"),
        (merkle.folded(merkle.hashed(F.lit("other")), F.col("path")) == F.lit(made.root)).alias("wrong")).distinct().collect()
    assert [(r.right, r.wrong) for r in checked] == [(True, False)]


def test_small_manifests(spark):
    leaves = spark.createDataFrame([(1, "a")], "doc_id long, lang string").withColumn("digest", merkle.row_digest(F.col("doc_id")))
    none = merkle.manifest(leaves.limit(0), "lang", ["doc_id"])
    assert none.root is None and none.proofs().count() == 0
    one = merkle.manifest(leaves, "lang", ["doc_id"])
    row = one.proofs().first()
    assert one.root.hex() == h("1:1") == row.subroot.hex() and row.path == []


def test_paths_are_never_broadcast(spark):
    """Paths grow with the table, and Spark's estimates take them for small."""
    leaves = spark.range(300).select("id", F.when(F.col("id") > 250, F.col("id")).alias("part"), merkle.row_digest(F.col("id")).alias("digest"))
    found = merkle.manifest(leaves, "part", ["id"]).proofs()
    assert len(found.collect()) == 300
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def without(texts, length):
    """Each text's number of bytes, spans and rest, by counting all strings."""
    given = [(t or "").encode() for t in texts]
    counts = Counter(t[k : k + length] for t in given for k in range(len(t) - length + 1))
    out = []
    for t in given:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(t), spans, bytes(x for x, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("how", [
    suffixes.Repeats(),
    # Few cuts a file and small packs: files are filed anew up to whole strings.
    suffixes.Repeats(length=60, phrases=(4, 30, 60), most=3, pack=2000),
    suffixes.Repeats(length=33, phrases=(8, 33), most=1, pack=1)], ids=["whole", "filed anew", "each alone"])
def test_repeated_passages(spark, docs, texts, how):
    found = suffixes.deduplicated(docs.select("doc_id", "text"), ["doc_id"], how=how)
    rows = found.joined(found.texts).collect()
    expected = without([t for _, t in texts], how.length)
    same([(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows],
         [(d, *e) for (d, _), e in zip(texts, expected)])
    assert sum(bool(e[1]) for e in expected) > 10
    none = suffixes.deduplicated(docs.where("false"), ["doc_id"], how=how)
    assert none.joined(none.texts).count() == 0


def test_suffix_order():
    """Places in the order of their suffixes, and those that share their first bytes."""
    r = random.Random(3)
    for _ in range(1500):
        kinds, length = r.choice([1, 2, 3, 20]), 10
        made = [bytes(r.randrange(kinds) + 97 for _ in range(r.randint(12, 60))) for _ in range(r.randint(1, 6))]
        if r.random() < 0.6:
            passage = bytes(r.randrange(kinds) + 97 for _ in range(20))
            made = [t[: r.randint(0, len(t))] + passage + t for t in made]
        counts = [r.randint(1, len(t) - length + 1) for t in made]
        seen = Counter(t[k : k + length] for t, n in zip(made, counts) for k in range(n))
        assert [m.tolist() for m in suffixes.repeated(made, counts, length)] == [
            [seen[t[k : k + length]] > 1 for k in range(n)] for t, n in zip(made, counts)]
        data = np.frombuffer(b"\0".join(made) + b"\0", np.uint8)
        wanted = np.array([r.random() < 0.5 for _ in data])
        order = suffixes.induced(data, wanted, len(data))
        whole = data.tobytes()
        assert order.tolist() == sorted(order.tolist(), key=lambda k: whole[k:]) and set(np.flatnonzero(wanted)) <= set(order.tolist())


def test_cuts():
    """Strings' cuts are told by their bytes alone, and cover each place once."""
    r = random.Random(8)
    for kinds in (1, 2, 60):
        text = bytes(r.randrange(kinds) + 40 for _ in range(2500))
        for k in (32, 200, 400):
            file, at, n, _ = suffixes.cuts(text, 0, len(text) - 399, k, 400)
            assert at[0] == 0 and (at[1:] == (at + n)[:-1]).all() and (at + n)[-1] == len(text) - 399 and n.max() <= 401 - k
            where = {p: f for f, a, m in zip(file, at, n) for p in range(a, a + m)}
            part, ats, ns, _ = suffixes.cuts(text, 700, 500, k, 400)
            assert all(where[p] == f for f, a, m in zip(part, ats, ns) for p in range(a, a + m))
