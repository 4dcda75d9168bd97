"""Tables kept batch by batch, against everything counted anew."""

import os
import random

from pyspark.sql import functions as F

from framesift.functions import predicates
from framesift.operators import counts
from framesift.streaming import folders, journal

LOG = "file struct<path: string>, rating int, at long, seq long"
SIGNALS = "struct<focus: double, eyes: double, open: double, highlights: double, shadows: double, faces: bigint, face: double>"


def parts_written(root, batch):
    return sorted(int(d.split("=")[1]) for d in os.listdir(f"{root}/rows/{batch}") if d.startswith("part="))


def test_live_counts(spark, tmp_path):
    """Marks in any order, late ones, repeated ones, one hot folder; batches delivered again."""
    r = random.Random(2)
    live = journal.LiveCounts(spark, str(tmp_path / "live"), parts=8)
    made, sizes = [], []
    for batch_id in range(8):
        rows = []
        for _ in range(120 if batch_id else 1500):
            dir_ = "/hot" if r.random() < 0.5 else f"/d{r.randint(0, 30)}"
            if batch_id == 5:
                dir_ = "/d3"
            at = r.randint(0, 50) + 10 * batch_id
            rows.append(((f"{dir_}/{r.randint(0, 60)}.jpg",), r.randint(-1, 5), at, at * 10_000 + r.randint(0, 9999)))
        rows += rows[:5]
        made += [(*row, batch_id) for row in rows]
        batch = spark.createDataFrame(rows, LOG)
        changed = live.take(batch, batch_id)
        if batch_id in (0, 4):
            changed = live.take(batch, batch_id)
        sizes.append(len(parts_written(live.marks.root, batch_id)))
        log = spark.createDataFrame(made, f"{LOG}, batch int")
        last = log.groupBy(F.col("file.path").alias("path")).agg(F.max_by("rating", F.struct("at", "batch", "seq")).alias("rating"))
        expected = counts.counts(last.withColumn("dir", F.regexp_extract("path", "^(.*)/", 1)), "dir").collect()
        assert {tuple(x) for x in live.read(batch_id).collect()} == {tuple(x) for x in expected}
        of = {x.dir: tuple(x) for x in expected}
        found = {x.dir: tuple(x) for x in changed.collect()}
        assert found.items() <= of.items() and set(found) <= {row[0][0].rsplit("/", 1)[0] for row in rows}
    assert sizes[5] == 1 and sizes[0] == 8, "a batch writes its folders' parts alone"
    assert not live.take(spark.createDataFrame([], LOG), 8).collect()
    assert live.read(8).count() == live.read(7).count()


def test_live_search(spark, tmp_path):
    r = random.Random(3)
    frames = [(f"/d{k % 9}", f"/d{k % 9}/{k}.jpg", k % 7 - 1) for k in range(300)]
    base = spark.createDataFrame(frames, "dir string, path string, rating int").withColumns(
        {"signals": F.lit(None).cast(SIGNALS), "stack": F.lit(None).cast("string")})
    terms = [("focus", ">", 100), ("shut", None, "no")]
    search = folders.LiveSearch(base, terms, str(tmp_path / "search"), parts=4)
    known = {}
    for batch_id in range(5):
        some = r.sample(frames, 60) if batch_id != 3 else [f for f in frames if f[0] == "/d2"]
        new = {path: (r.uniform(0, 200), None, r.choice([None, 0.1, 0.9]), 0.0, 0.0, 1, 0.1) for _, path, _ in some}
        known |= new
        batch = spark.createDataFrame([*new.items(), ("/elsewhere/1.jpg", (1.0,) * 5 + (1, 1.0))], f"path string, signals {SIGNALS}")
        found = search.take(batch, batch_id)
        if batch_id in (0, 2):
            found = search.take(batch, batch_id)
        table = spark.createDataFrame([(d, p, m, known.get(p), None) for d, p, m in frames], f"dir string, path string, rating int, signals {SIGNALS}, stack string")
        expected = counts.matching(table, predicates.search(terms), True).first()
        assert tuple(found.first()) == tuple(expected) and expected.matching
    assert parts_written(search.frames.root, 4) != [] and len(parts_written(search.frames.root, 4)) <= 4


def test_what_a_batch_reads(spark, tmp_path):
    """As many parts as the batch's folders are in, after five batches as after one."""
    live = journal.LiveCounts(spark, str(tmp_path / "live"), parts=16)
    everywhere = [((f"/d{k}/a.jpg",), 1, 1, k) for k in range(200)]
    live.take(spark.createDataFrame(everywhere, LOG), 0)
    for batch_id in range(1, 6):
        live.take(spark.createDataFrame([(("/d7/b.jpg",), batch_id, batch_id, batch_id)], LOG), batch_id)
        assert len(parts_written(live.marks.root, batch_id)) == len(parts_written(live.counts.root, batch_id)) == 1
        assert live.read(batch_id).where("dir = '/d7'").select("picks", "total").first() == (2, 2)


def test_passed_by_visits(spark, tmp_path):
    """A folder left and come back to in one batch is left twice; marks of one time go by the log's order."""
    minute = 60_000
    views = [("/d", n, at) for n, at in (("a", 0), ("b", 1), ("kept", 1), ("b", 2), ("a", 600))] + [("/looked", "a", 0), ("/late", "z", 9000)]
    marks = [("/d", "b", 3, 1, 5, 0), ("/d", "c", 1, 2, 5, 1), ("/d", "c", 0, 2, 5, 2), ("/d", "a", 1, 601, 5, 0)]
    spark.createDataFrame([(7, d, f"{d}/{n}", at * minute) for d, n, at in views], "session long, dir string, path string, at long").withColumn(
        "ts", F.timestamp_millis("at")).drop("at").write.parquet(str(tmp_path / "views"))
    log = [(7, (f"{d}/{n}",), rating, "mark", at * minute, (at * minute, batch, line)) for d, n, rating, at, batch, line in marks]
    spark.createDataFrame(log, "session long, file struct<path: string>, rating int, how string, at long, seq struct<at: long, batch: long, line: long>").withColumn(
        "ts", F.timestamp_millis("at")).write.parquet(str(tmp_path / "log"))
    streams = [spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n)) for n in ("views", "log")]
    held = spark.createDataFrame([("/d/kept", 3), ("/d/b", None)], "path string, rating int")
    found = journal.passed(*streams, "30 minutes", ratings=held)
    assert "Pandas" not in found._jdf.queryExecution().analyzed().toString()
    query = found.writeStream.format("memory").queryName("visits").trigger(availableNow=True).start()
    query.awaitTermination()
    # In the first visit nothing became of a and c; in the second a was marked.
    assert sorted(tuple(r) for r in spark.table("visits").collect()) == [(7, "/d", "/d/a"), (7, "/d", "/d/c")]
