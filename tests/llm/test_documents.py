"""Operators on documents: rules, classifier, tokens, mixing, token files, near duplicates."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from framesift.llm import bpe, convnet, idfiles, jaccard, mixing, rangecoder, rules, shingles

SCHEMA = "doc_id long, text string, source string, n_words string, slot int, ids string, host string"
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def listed(text):
    return re.findall(r"[^ \t-\r]+", text or "")


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and long texts, repeated rows and ids, ties, near copies."""
    r = random.Random(5)
    vocabulary = ["the", "Thing", "of", "ein", "été", "a", "#tag", "日本", "one-two", "x" * 40, "Σ", "'s", "!!", "1234"]

    def text(n):
        return "".join(r.choice(vocabulary) + r.choice([" ", " ", "\n", "\t", "  ", "\x0b"]) for _ in range(n))

    long = text(20000)
    base = [f"w{r.randint(0, 900)}" for _ in range(120)]
    near = [" ".join(w if r.random() > p else "z" for w in base) for p in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.3)]
    rows = [(k, text(r.choice([1, 3, 4, 5, 60, 200]))) for k in range(40)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, long), (104, long), (105, long + " end"), (7, rows[7][1]), (7, rows[7][1])]
    rows += [(None, rows[3][1]), (None, None), (None, long), (110, rows[3][1].upper()), (111, "the the the"), (112, "The THE the")]
    rows += [(120 + k, t) for k, t in enumerate(near)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    """With columns whose names the operators use themselves."""
    rows = [(d, t, None if k % 7 == 3 else "hot" if k % 3 else f"s{k % 5}", "x", 1, "y", "z") for k, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


def counted(text):
    w = listed(text)
    windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if listed(line)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rules(docs, none):
    rows = rules.judged(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    expected = [(r.doc_id, *(c := counted(r.text)), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in docs.collect()]
    same([(r.doc_id, *(r[n] for n in names), r.base_failed) for r in rows], expected)
    assert rules.judged(none).count() == 0


def test_host_rates(spark):
    """A host with one document is drawn to the others more than one with many."""
    bad, good = "word " * 10, " ".join(f"w{k}" for k in range(60))
    rows = [("bad", bad)] * 40 + [("bad", good)] * 2 + [(f"h{k}", good) for k in range(20) for _ in range(20)] + [("one", bad)]
    rows += [("h1", bad)] * 3 + [(None, good)] * 5
    docs = spark.createDataFrame([(k, t, h) for k, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    hosts = {r.host: r for r in rules.judged(docs).select("host", "host_rate", "host_documents").distinct().collect()}
    assert hosts["bad"].host_rate > 0.75 and hosts["one"].host_rate < hosts["bad"].host_rate and hosts[None].host_documents == 5
    n = {h: sum(x == h for x, _ in rows) for h in hosts}
    f = {h: sum(x == h and t == bad for x, t in rows) for h in hosts}
    total = sum(n.values())
    p = sum(f.values()) / total
    between = (sum(f[h] ** 2 / n[h] for h in n) - sum(f.values()) * p - (len(n) - 1) * p * (1 - p)) / (total - sum(v * v for v in n.values()) / total)
    weight = min(1000, max(0, p * (1 - p) / between - 1))
    for h, r in hosts.items():
        assert r.host_rate == pytest.approx((f[h] + p * weight) / (n[h] + weight), rel=1e-4)
    kept = {(r.host, r.kept) for r in rules.judged(docs).where("n_words = 60").select("host", "kept").collect()}
    assert kept == {("bad", False), (None, True)} | {(f"h{k}", True) for k in range(20)}
    single = docs.where("source = 'h2'")
    assert rules.judged(single).where("kept").count() == 20


def test_network(spark, docs, none):
    r = random.Random(2)

    def word():
        return "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))

    marked = [(k, " ".join(word() + ("###" if k % 2 else "") for _ in range(r.randint(20, 400)))) for k in range(120)]
    table = spark.createDataFrame(marked, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(80)] + [(1, 0), (81, 0), (81, 1), (None, 1), (500, 0)], "doc_id long, quality int")
    fit = convnet.Fit(rounds=6)
    net = convnet.learned(table, labels, fit)
    scores = {x.doc_id: x.score for x in convnet.scored(table, net).collect()}
    assert all((scores[k] >= 0.5) == (k % 2 == 0) for k in range(80, 120))
    assert scores == {x.doc_id: x.score for x in convnet.scored(table, convnet.learned(table, labels, fit)).collect()}
    rows = convnet.scored(docs, net).collect()
    same([x.doc_id for x in rows], [x.doc_id for x in docs.collect()])
    assert all(0 <= x.score <= 1 for x in rows)
    assert convnet.scored(none, net).count() == 0
    assert convnet.learned(none, labels).score(b"") == pytest.approx(0.5, abs=0.2)
    one = convnet.learned(table, labels.where("quality = 1"))
    assert one.score(b"a") == one.score(b"") > 0.99


def test_network_sees_all_of_a_text():
    """Slices and halves don't matter: responses are those of every place of the whole text."""
    net = convnet.Network.fresh(np.random.default_rng(1))
    net.ready()
    for size in (0, 1, 5, 6, 255, 261, 262, 5000, convnet.HALF * convnet.HALVES + 3):
        text = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
        seen = np.frombuffer(text + bytes(max(0, 6 - size)), np.uint8)
        places = len(seen) - 5
        every = sum(net.filters[k][seen[k : k + places]] for k in range(6)) + net.bias
        halves = [np.maximum(every[k : k + 256].max(0), 0) for k in range(0, places, 256)]
        assert np.allclose(net.halves(text), halves, atol=1e-4)


def test_gradient():
    """Steps agree with differences of the loss."""
    net = convnet.Network.fresh(np.random.default_rng(3))
    net.filters = net.filters.astype(np.float64)
    text, label = bytes(np.random.default_rng(4).integers(97, 110, 900, np.uint8)), 1
    steps = {n: np.zeros_like(np.asarray(getattr(net, n), np.float64)) for n in ("filters", "bias", "weights", "offset")}
    net.learn(text, label, steps)

    def loss():
        net.pairs = None
        return -np.log(net.score(text))

    for at in [(0, 100, 3), (2, 105, 7), (5, 98, 1)]:
        before = net.filters[at]
        net.filters[at] = before + 1e-3
        up = loss()
        net.filters[at] = before - 1e-3
        down = loss()
        net.filters[at] = before
        assert (up - down) / 2e-3 == pytest.approx(steps["filters"][at], abs=2e-3)


def test_bpe(docs, none):
    ranks = {k: v for k, v in ((bytes(t), r) for t, r in _ranks())}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.encoded(docs, BPE, public_tokenizers.PATTERN)
    rows = bpe.decoded(ids, BPE, public_tokenizers.PATTERN).collect()
    expected = []
    for r in docs.collect():
        e = known.encode_ordinary(r.text or "")
        expected.append((r.doc_id, struct.pack(f"<{len(e)}I", *e), len(e), (r.text or "").encode()))
    same([(r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded)) for r in rows], expected)
    assert bpe.decoded(bpe.encoded(none, BPE, public_tokenizers.PATTERN), BPE, public_tokenizers.PATTERN).count() == 0


def _ranks():
    import base64

    with open(BPE, "rb") as lines:
        for token, rank in map(bytes.split, lines):
            yield base64.b64decode(token), int(rank)


def test_bpe_on_any_text():
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(_ranks()), special_tokens={})
    v = bpe.Vocabulary(BPE, public_tokenizers.PATTERN)
    r = random.Random(1)
    parts = ["a", "e", "th", "in", "  ", "\n", "é", "ß", "日本", "😀", "0", "12", "!!", "'s", " ", "\x00", "ing", "<|endoftext|>"]
    for k in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 60))) if k % 2 else "".join(chr(r.randint(1, 0x2FF)) for _ in range(r.randint(0, 30)))
        e = known.encode_ordinary(text)
        assert v.encode(text) == struct.pack(f"<{len(e)}I", *e)
        assert v.decode(v.encode(text)) == text.encode()


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(listed(r.text))
    same([(r.doc_id, r.source, r.size) for r in rows], [(r.doc_id, r.source, len(listed(r.text))) for r in docs.collect()])
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, total = {}, 1.5 * sum(sizes.values())
    while True:  # what is over a source's most is shared anew until none is
        free = [s for s in order if s not in target]
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * level >= 2 * sizes[s]]
        if not over:
            target |= {s: weights[s] * level for s in free}
            break
        target |= {s: 2 * sizes[s] for s in over}
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r.size <= 2 * r.size
        assert r.copies - r.target / max(1, r.source_size) < 1 and r.target / max(1, r.source_size) - r.copies < 1
    same(rows, mixing.mixed(docs.repartition(3)).collect())
    assert mixing.mixed(none).count() == 0
    assert {r.taken for r in mixing.mixed(docs.where("text IS NULL")).collect()} == {0}


def test_mixing_comes_near(spark):
    r = random.Random(3)
    rows = [(k, "w " * int(r.paretovariate(1.2) * 10), f"s{k % 4}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = mixing.mixed(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(s["sum(taken)"] / s["max(target)"] - 1) < 0.05 for s in sums)


def test_coder_round_trips():
    r = np.random.default_rng(1)
    size = rangecoder.BLOCK
    for blocks in (
        r.integers(0, 65536, (37, size)), np.zeros((3, size)), np.full((2, size), 65535), np.tile(np.arange(size), (4, 1)),
        r.integers(0, 3, (50, size)), np.where(r.random((9, size)) < 0.9, 7, r.integers(0, 65536, (9, size))),
        np.minimum(r.zipf(1.3, (20, size)), 65535)):
        blocks = blocks.astype(np.uint16)
        words, used = rangecoder.encode(blocks)
        assert (rangecoder.decode(words, used) == blocks).all()


def test_token_files(spark, docs, none, tmp_path, monkeypatch):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    expected, at = [], 0

    def order(r):
        return (r.doc_id is not None, r.doc_id or 0)

    every = docs.collect()
    coded = {r.text: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in every}
    for path, frame in (("a", idfiles.FRAME), ("b", 700)):
        idfiles.written(docs, str(tmp_path / path), WORDS, 1, partitions=3)
        rows = idfiles.read(spark, str(tmp_path / path)).selectExpr("*", "cast(octet_length(ids) / 4 AS long) AS n_tokens")
        rows = sorted(idfiles.started(rows).collect(), key=lambda r: r.start)
        assert [order(r) for r in rows] == sorted(order(r) for r in every)
        at = 0
        for r in rows:
            assert r.start == at
            at += r.n_tokens
        packed = [(r.doc_id, struct.pack(f"<{len(coded[r.text])}I", *coded[r.text])) for r in every]
        same([(r.doc_id, bytes(r.ids)) for r in rows], packed)
    idfiles.written(none, str(tmp_path / "none"), WORDS, 1)
    assert idfiles.started(idfiles.read(spark, str(tmp_path / "none")).selectExpr("*", "1L AS n_tokens")).count() == 0


def test_signs_after_letters_that_end_in_marks():
    """Every letter before a sign as the library codes it in a whole text."""
    tokenizer = Tokenizer.from_file(WORDS)
    every = [c for c in map(chr, range(0x110000)) if c.isalpha() and not 0x3400 <= ord(c) <= 0xD7A3 and not 0x17000 <= ord(c) <= 0x18CFF]
    words = [c + ".,!?;:"[k % 6] for k, c in enumerate(every)] + [c + s for c in "İक़ড়שׁé" for s in ".,!?;:"] + ["İ.", "क़.", "ড়.", "שׁ.", "ΑΣ.", "İa.", "été,"]
    found = idfiles.WordCoder(WORDS).encode([w.encode() for w in words])
    expected = [struct.pack(f"<{len(e.ids)}H", *e.ids) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    assert [w for w, x, y in zip(words, found, expected) if x != y] == []
    text = " ".join(words[::7])
    assert idfiles.WordCoder(WORDS).encode([text.encode()]) == [
        struct.pack(f"<{len(i)}H", *i) for i in [tokenizer.encode(text, add_special_tokens=False).ids]]


def test_names_of_special_tokens_are_their_ids():
    """As the library codes them without any setting, also amid words, signs and spaces of all kinds."""
    tokenizer = Tokenizer.from_file(WORDS)
    texts = ["x <|endoftext|> y", "a<|endoftext|>b <|startoftext|>, é.<|endoftext|>.", "<|endoftext|><|endoftext|>", "<|EndOfText|> <|end oftext|>",
             "a\xa0<|endoftext|>\u3000b\x1c<|startoftext|>\x0bc"]
    found = idfiles.WordCoder(WORDS).encode([t.encode() for t in texts])
    assert [list(struct.unpack(f"<{len(i) // 2}H", i)) for i in found] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert found[0] == struct.pack("<3H", 343, 49407, 344)


def test_words_are_looked_up_once_a_batch(monkeypatch):
    """However often a word comes; and ids are the library's, also where words are forgotten between batches."""

    class Counting(dict):
        n = 0

        def get(self, w, default=None):
            self.n += 1
            return dict.get(self, w, default)

        def __getitem__(self, w):
            self.n += 1
            return dict.__getitem__(self, w)

    coder = idfiles.WordCoder(WORDS)
    coder.known = Counting()
    found = coder.encode([b"two words " * 1000, b" two\t", b""])
    assert coder.known.n <= 12
    assert [len(i) for i in found] == [4000, 2, 0] and found[0][:4] * 1000 == found[0]
    tokenizer, r = Tokenizer.from_file(WORDS), random.Random(5)
    monkeypatch.setattr(idfiles, "WORDS", 40)
    coder = idfiles.WordCoder(WORDS)
    for _ in range(60):
        texts = ["".join(r.choice(["a", "B", "the", "É", "e\u0301", "İ", ".", ",", "'s", "7", "##", " ", "\t", "\n", "\x0b", "\x1c", "\x85", "\u3000", "你", "<|endoftext|>"])
                         for _ in range(r.randint(0, 40))) for _ in range(6)]
        expected = [struct.pack(f"<{len(e.ids)}H", *e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert coder.encode([t.encode() for t in texts]) == expected
    assert idfiles.WordCoder(WORDS).encode([]) == []


def test_frames_are_checked():
    docs = [(5, struct.pack("<600H", *range(600))), (None, b"\x01\x00"), (7, struct.pack("<3H", 9, 8, 1))]
    whole = idfiles.frame(2, 3, docs)
    part, seq, names, ids = idfiles.unframed(whole)
    assert (part, seq, names) == (2, 3, [5, None, 7]) and [i.astype("<u2").tobytes() for i in ids] == [d for _, d in docs]
    for at in (20, 60, len(whole) - 9):
        broken = bytearray(whole)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            idfiles.unframed(bytes(broken))


def shingled(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in listed(text)]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingled(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(d, least.get(root(k), d))
    return [(d, len(sets[k]), least.get(root(k), d) if sets[k] else d) for k, (d, _) in enumerate(rows)]


def test_jaccard(docs, texts, none):
    rows = jaccard.joined(docs).collect()
    same([tuple(r) for r in rows], brute(texts))
    assert jaccard.joined(none).count() == 0


def test_jaccard_chains_and_thresholds(spark):
    """Chains of copies that drift, many near copies of one text, and pairs at the very threshold."""
    r = random.Random(9)
    rows, words = [], [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    for k in range(40):
        rows.append((k, " ".join(words)))
        for at in r.sample(range(150), 2):
            words[at] = f"v{r.randint(0, 10**6)}"
    base = [f"b{r.randint(0, 10**6)}" for _ in range(100)]
    for k in range(80):
        rows.append((1000 + k, " ".join(w if r.random() > 0.03 else f"c{r.randint(0, 10**6)}" for w in base)))
    for k, n in enumerate((3, 4, 7, 8, 12, 28, 56)):  # n of n + n / 3 shingles shared, or one less
        some = [f"t{k}_{j}" for j in range(n + n // 3 + 4)]
        rows += [(2000 + 3 * k, " ".join(some)), (2001 + 3 * k, " ".join(some[: n + 4])), (2002 + 3 * k, " ".join(some[: n + 3]))]
    passage = " ".join(f"p{j}" for j in range(60))
    rows += [(3000 + k, passage + " " + " ".join(f"q{r.randint(0, 10**6)}" for _ in range(30))) for k in range(60)]
    found = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    same([tuple(x) for x in found], brute(rows))


def near_groups(r, words, groups, copies, shared):
    """Groups of near copies of texts that all begin alike, drifting by more and more words."""
    opening, out = [f"o{j}" for j in range(words * shared // 100)], []
    for g in range(groups):
        own = opening + [f"g{words}_{g}_{j}" for j in range(words - len(opening))]
        for k in range(copies):
            text = list(own)
            for at in r.sample(range(words), words * k // (20 * copies)):
                text[at] = f"x{r.randint(0, 10**9)}"
            out.append(" ".join(text))
    return out


def test_jaccard_groups_that_share_passages(spark):
    r = random.Random(4)
    texts = near_groups(r, 60, 5, 9, 60) + near_groups(r, 500, 4, 8, 70) + near_groups(r, 1200, 4, 6, 80)
    rows = [(k, t) for k, t in enumerate(texts)] + [(900 + k, t) for k, t in enumerate(texts[::5])]
    r.shuffle(rows)
    found = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    same([tuple(x) for x in found], brute(rows))


def test_no_pair_across_components_is_lost(spark):
    """Cells' bounds leave every pair that sketches leave, whatever the components; keys with the same nodes are one."""
    r = random.Random(8)
    texts = near_groups(r, 90, 3, 10, 75) + near_groups(r, 505, 3, 6, 75) + near_groups(r, 1100, 2, 6, 85)
    alike, docs = jaccard.Alike(slots=1 << 10), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = jaccard.described(docs, alike, "doc_id", "text").where("node IS NOT NULL").drop("slot", "count", "doc_id").distinct()
    known = {x["node"]: x for x in nodes.collect()}
    names = sorted(known)
    roots = {n: names[r.randrange(12)] for n in names}
    held = {1: names, 2: names, 3: r.sample(names, 30), 4: names[:1], 5: [n for n in names if roots[n] == roots[names[0]]]}
    groups = spark.createDataFrame([(k, n, n) for k, ns in held.items() for n in ns + ns[:3]], "key long, node long, hub long")
    open_ = jaccard.still_open(groups, spark.createDataFrame(list(roots.items()), "node long, root long"))
    assert sorted({x["key"] for x in open_.collect()}) == [1, 3]

    def bits(a, b):
        return sum(((x ^ y) & 2**64 - 1).bit_count() for x, y in zip(a, b))

    def may(a, b):
        most = 25 * (a["n"] + b["n"])
        short = 175 * bits([a[c] for c in jaccard.sketch_columns()], [b[c] for c in jaccard.sketch_columns()]) <= most
        wide = not (a["wide"] and b["wide"]) or 175 * bits(a["wide"], b["wide"]) <= most
        return 100 * min(a["n"], b["n"]) >= 75 * max(a["n"], b["n"]) and short and wide

    expected = {(a, b) for a in names for b in names if a < b and roots[a] != roots[b] and may(known[a], known[b])}
    assert expected
    assert {(x["a"], x["b"]) for x in jaccard.across(open_, nodes, alike).collect()} == expected


def test_keys_of_mostly_the_same_nodes_are_put_together(spark):
    """A pair of a group of near copies was met under each of the keys that both have; now under a few. Keys with little in common stay alone."""
    r = random.Random(9)
    held = {k: r.sample(range(100, 160), 52) for k in range(70)}
    held |= {k: [10_000 + k, 20_000 + k, 30_000] for k in range(200, 260)}
    rows = [(k, n, n) for k, ns in held.items() for n in ns]
    open_ = jaccard.gathered(spark.createDataFrame(rows, "key long, root long, node long")).collect()
    assert len(open_) == len({(x["key"], x["node"]) for x in open_}) and all(x["root"] == x["node"] for x in open_)
    now = {}
    for x in open_:
        now.setdefault(x["key"], set()).add(x["node"])

    def pairs(nodes):
        return {(a, b) for a in nodes for b in nodes if a < b}

    before, after = [p for ns in held.values() for p in pairs(ns)], [p for ns in now.values() for p in pairs(ns)]
    assert set(before) <= set(after), "no pair that shared a key is lost"
    assert len(after) < len(before) / 5
    assert all(len(ns) == 3 for ns in now.values() if 30_000 in ns), "one node in common is not enough"


def test_linked_sets_share_a_key():
    r = np.random.default_rng(3)
    alike, levels = jaccard.Alike(), r.integers(0, 9, 1 << 20).astype(np.uint8)
    for n in [1, 2, 3, 4, 5, 9, 12, 15, 16, 17, 40, 200, 255, 256, 300, 3000, 4100]:
        for _ in range(60 if n < 1000 else 4):
            a = np.unique(r.integers(0, 2**64, n, np.uint64, endpoint=False))
            apart = (2 * n) // 7 if n > 3 else n // 3
            drop = int(r.integers(0, apart + 1))
            b = np.unique(np.concatenate((a[r.permutation(n)[: n - drop // 2]], r.integers(0, 2**64, drop - drop // 2, np.uint64, endpoint=False))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.keys(a, levels, alike), jaccard.keys(b, levels, alike)))


def test_shingles(texts, monkeypatch):
    whole = [shingles.word_hashes((t or "").encode()) for _, t in texts]
    assert [len(w) for w in whole] == [len(listed(t)) for _, t in texts]
    assert [len(shingles.shingles((t or "").encode())) for _, t in texts] == [len(shingled(t)) for _, t in texts]
    monkeypatch.setattr(shingles, "SLICE", 50)
    assert all((shingles.word_hashes((t or "").encode()) == w).all() for (_, t), w in zip(texts, whole))


def test_digests_are_those_of_the_ids(docs):
    """What the query tells are the hashes of what the operator returns."""
    from pyspark.sql import functions as F

    rows = bpe.encoded(docs, BPE, public_tokenizers.PATTERN).select("ids", F.sha2("ids", 256).alias("s"), F.crc32("ids").alias("c")).collect()
    assert all(hashlib.sha256(r.ids).hexdigest() == r.s and zlib.crc32(r.ids) == r.c for r in rows)
