"""The pipeline's stages against brute force, each on what the one before kept."""

import random
import struct
from collections import Counter

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F
from test_documents import _ranks, brute, counted, listed

import corpus_pipeline
from framesift.llm import batches, bpe, convnet
from framesift.llm.queries import held_out
from framesift.llm.shared import settled


def word(r):
    return "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8)))


def made(spark, folder):
    r = random.Random(6)
    rows = []
    for k in range(160):
        words = [word(r) for _ in range(r.randint(30, 300))]
        rows.append((k, " ".join(w + "###" * (k % 5 == 0) for w in words)))
    rows += [(200 + k, rows[k][1] + " and more") for k in range(1, 40, 3)] + [(2, rows[2][1]), (None, rows[3][1]), (None, None), (300, ""), (301, "a b " * 90)]
    docs = spark.createDataFrame([(d, t, "en", f"s{(d or 0) % 3}" if d != 7 else None, len(t or "")) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(0, 160)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    made(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    given = {}
    for name, stage in stages.items():
        given[name] = docs
        docs = settled(stage(spark, docs, folder), "stage")
    texts = {name: Counter((r.doc_id, r.text) for r in d.collect()) for name, d in given.items()}
    assert all(d.columns == columns for d in given.values())
    names = list(stages)

    def fails(text):
        n = counted(text)
        return n[0] < 50 or 100 * n[4] > 50 * n[0]

    assert texts[names[1]] == Counter((r.doc_id, r.text) for r in before if not fails(r.text))
    net = convnet.learned(given[names[1]], spark.read.parquet(f"{folder}/labels.parquet").where(~held_out()))
    kept = Counter({k: n for k, n in texts[names[1]].items() if net.score(k[1].encode()) >= 0.7})
    assert texts[names[2]] == kept and 60 < len(kept) < 140
    assert not any("###" in t for _, t in kept)
    rows = list(kept.elements())
    groups, order = {}, sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    numbers = {k: n for n, k in enumerate(order)}
    for k, (_, _, root) in enumerate(brute([(numbers[k], t) for k, (_, t) in enumerate(rows)])):
        groups.setdefault(root, []).append(k)
    firsts = Counter(rows[min(members, key=numbers.get)] for members in groups.values())
    assert texts[names[3]] == firsts and len(firsts) < len(rows)
    sizes, taken = Counter(), Counter()
    for r in given[names[3]].collect():
        sizes[r.source] += len(listed(r.text))
    for r in given[names[4]].collect():
        taken[r.source] += len(listed(r.text))
    assert all(n <= 2 * texts[names[3]][k] for k, n in texts[names[4]].items()) and set(texts[names[4]]) <= set(texts[names[3]])
    assert abs(sum(taken.values()) / (1.5 * sum(sizes.values())) - 1) < 0.1
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(_ranks()), special_tokens={})
    ids = Counter((r.doc_id, bytes(r.ids)) for r in docs.collect())
    expected = Counter()
    for (d, t), n in texts[names[4]].items():
        e = known.encode_ordinary(t)
        expected[d, struct.pack(f"<{len(e)}I", *e)] += n
    assert ids == expected


def test_run_is_its_stages_and_takes_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    made(spark, folder)
    assert corpus_pipeline.run(spark, folder).count() > 50
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_row_numbers_stay_whatever_the_splits(spark, tmp_path):
    """Two readings of the same files number rows alike, however they're cut and whatever columns are read."""
    path = str(tmp_path / "documents")
    rows = [(None if k % 9 == 0 else k % 400, f"text {k} " * 50, k) for k in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(5).write.option("parquet.block.size", 65536).parquet(path)
    before = {r.n_chars: r["_row"] for r in corpus_pipeline.numbered(spark.read.parquet(path)).collect()}
    assert len(set(before.values())) == 3000
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        docs = spark.read.parquet(path)
        assert docs.rdd.getNumPartitions() > 5
        assert {r.n_chars: r["_row"] for r in corpus_pipeline.numbered(docs).select("n_chars", "_row").collect()} == before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    # What isn't a table is written once.
    made = corpus_pipeline.numbered(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("_row")))
    assert made.select("_row").distinct().count() == 50 and made.columns == ["doc_id", "text", "_row"]


def test_ids_are_decoded_where_they_are_made(spark):
    """One worker a task in the last stage: a second one for decoding, which the stages before found no room beside, doubled their number."""
    rows = [(1, "Two  words\n"), (None, "naïve ##"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = corpus_pipeline.token_ids(spark, docs, "")
    assert found._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 1
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    two = bpe.decoded(bpe.encoded(docs, path, pattern), path, pattern).select(
        "doc_id", "ids", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    assert found.columns == two.columns and Counter(map(tuple, found.collect())) == Counter(map(tuple, two.collect()))
    assert [r[0] for r in bpe.encoded(docs, path, pattern, decode=True).select("decoded").collect()] == [(t or "").encode() for _, t in rows]


def test_pieces_give_back_what_arrow_holds(monkeypatch):
    released = []

    class Pool:
        def release_unused(self):
            released.append(1)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", "cd", None, "efghi", "j"])], ["text"])
    assert [p.column("text").to_pylist() for p in batches.pieces([batch], "text", 4)] == [["ab", "cd", None], ["efghi"], ["j"]]
    assert len(released) == 3
