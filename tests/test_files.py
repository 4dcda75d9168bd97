"""What is read from files and written to them."""

import json
import os
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framesift.functions import xmp
from framesift.operators import assemble, pixels
from framesift.plans.streams import _png
from framesift.sources import journal, listing, measures, pictures, shared
from framesift.streaming import folders


@pytest.fixture
def shoot(tmp_path):
    for name in ("_DSC1.ARW", "DSC2.jpg", ".hidden.ARW", "notes.txt", "DSC3.NEF"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "x.jpg").mkdir()
    return tmp_path


def test_listing_sees_what_spark_hides(spark, shoot):
    found = listing.opened(spark, str(shoot)).orderBy("path").collect()
    assert [(r.name, r.kind) for r in found] == [("DSC2.jpg", "jpeg"), ("DSC3.NEF", "raw"), ("_DSC1.ARW", "raw")]
    assert listing.opened(spark, str(shoot), formats="jpeg").count() == 1
    dirs = spark.createDataFrame([(str(shoot),)], "dir string")
    assert listing.listed_all(dirs).count() == listing.listed(spark, str(shoot)).count() == 6
    with pytest.raises(FileNotFoundError):
        listing.opened(spark, str(shoot / "x.jpg"))


def test_sidecars_beside_pictures(spark, shoot):
    text = spark.range(1).select(xmp.fresh(F.lit(9))).first()[0]
    (shoot / "_DSC1.ARW.xmp").write_text(text)
    (shoot / "DSC3.NEF.xmp").write_bytes(b"\xff\xfe junk")
    listed = listing.listed(spark, str(shoot))
    frames = assemble.with_ratings(assemble.pictures(listed), listing.sidecars(listed))
    assert {r.name: r.rating for r in frames.collect()} == {"DSC2.jpg": 0, "DSC3.NEF": 0, "_DSC1.ARW": 5}
    assert [r.sidecar_path for r in assemble.problems(frames).collect()] == [str(shoot / "DSC3.NEF.xmp")]
    (shoot / "a b+c.ARW.xmp").write_text(text)
    assert str(shoot / "a b+c.ARW.xmp") in [r.sidecar_path for r in listing.sidecars_under(spark, str(shoot)).collect()]


def test_a_log_with_junk_in_it(spark, tmp_path):
    file = {"path": "/s/1.ARW", "size": 1, "modified": 1, "captured": None}
    signals = {"focus": 1.0, "eyes": None, "open": None, "highlights": 0.0, "shadows": 0.0, "faces": 0, "face": 0.0}
    rows = [
        {"v": 1, "at": 5, "session": 1, "file": file, "rating": 3, "was": 0, "how": "mark", "filter": {"at_least": 2}, "signals": signals},
        {"at": 5, "file": file, "rating": 1, "new_field": [1]},
        {"at": 5, "rating": 1}, {"at": 5, "file": file}, {"at": 5, "file": file, "rating": 2, "signals": {"focus": 1.0}},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot a row\n")
    log = journal.read(spark, str(tmp_path))
    found = log.orderBy("seq").collect()
    assert [r.rating for r in found] == [3, 1], "in the order they stand in, though made at once"
    assert json.loads(found[0]["filter"]) == {"at_least": 2} and found[0].signals.focus == 1.0


def test_what_is_appended(spark, tmp_path):
    from framesift.plans import adapters as A

    marks = A.decisions(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "log")
    journal.append(marks, path, order="seq")
    lines = [json.loads(line) for f in sorted((tmp_path / "log").glob("*.json")) for line in f.read_text().splitlines()]
    assert len(lines) == marks.where("was <> rating or how = 'pass'").count()
    assert list(lines[0]) == ["v", "at", "session", "file", "rating", "was", "how", "view", "compared", "filter", "dwell_ms", "signals", "standing", "suggested", "batch", "line"]
    assert [line["at"] for line in lines] == sorted(line["at"] for line in lines)


def test_measures_are_kept_by_version(spark, tmp_path):
    root = str(tmp_path / "signals")
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, focus double")
    measures.store(one, root, 1)
    measures.store(one.where("path = 'a'"), root, 2)
    assert measures.load(spark, root, 1).count() == 2
    measures.store(one.where("path = 'b'"), root, 1)
    assert [r.path for r in measures.load(spark, root, 1).collect()] == ["b"] and measures.load(spark, root, 2).count() == 1
    frames = spark.createDataFrame([("a",), ("c",)], "path string")
    assert [r.path for r in assemble.unmeasured(frames, measures.load(spark, root, 2)).collect()] == ["c"]


def test_small_files_by_key(spark, tmp_path):
    (tmp_path / "s").mkdir(), (tmp_path / "f").mkdir()
    (tmp_path / "s" / "k1.json").write_text('{"focus": 31.5, "eyes": null, "open": 0.75, "highlights": 0, "shadows": 0, "faces": 0, "face": 0}')
    face = '{"score": 0.9, "bounds": [0.1, 0.1, 0.2, 0.2], "eyes": [[0.1, 0.1], [0.2, 0.1]]}'
    (tmp_path / "f" / "k1.json").write_text(f"[{face}, {face}]")
    (tmp_path / "f" / "k2.json").write_text("[]")
    row = measures.read_signals(spark, str(tmp_path / "s")).first()
    assert (row.key, row.focus, row.eyes, row.open) == ("k1", 31.5, None, 0.75)
    assert [r.key for r in measures.read_faces(spark, str(tmp_path / "f")).collect()] == ["k1", "k1"]


def test_folders_and_sidecars_are_dealt_over_tasks(spark, tmp_path):
    """Two folders in one partition, and all sidecars in one folder, are several tasks' work."""
    for n in ("a", "b"):
        (tmp_path / n).mkdir()
    for k in range(250):
        (tmp_path / "a" / f"{k}.xmp").write_text(str(k))
    dirs = spark.createDataFrame([(str(tmp_path / n),) for n in ("a", "b")], "dir string").distinct()
    listed = listing.listed_all(dirs)
    assert listed.rdd.getNumPartitions() == 4 and listed.count() == 250
    texts = listing.sidecars(listed)
    assert texts.groupBy(F.spark_partition_id()).count().count() == 4
    assert sorted(int(r.xmp) for r in texts.collect()) == list(range(250))


def test_pictures_are_unpacked(spark, tmp_path):
    rows = [bytes(v for x in range(5) for v in (x, y, 200)) for y in range(3)]
    (tmp_path / "a.png").write_bytes(_png(rows, 5))
    (tmp_path / "b.png").write_bytes(b"not a picture")
    table = pictures.read(spark, str(tmp_path))
    assert {(r.x, r.y, r.r, r.g, r.b) for r in table.collect()} == {(x, y, x, y, 200) for x in range(5) for y in range(3)}
    assert (pixels.sizes(table).first().w, pixels.sizes(table).first().h) == (5, 3)


def test_pictures_are_unpacked_a_few_at_a_time():
    """Small pictures share a batch, and none is larger than it has to be."""
    n, side = 3000, 16
    data = [bytes([k % 256]) * (3 * side * side) for k in range(n)]
    whole = pa.RecordBatch.from_pydict({"path": [str(k) for k in range(n)], "h": [side] * n, "w": [side] * n, "c": [3] * n, "data": data})
    found = list(pictures._unpacked(iter([whole])))
    assert len(found) < 5 and max(b.num_rows for b in found) <= (1 << 18) + side * side
    assert sum(b.num_rows for b in found) == n * side * side
    assert [(b.column(0)[-1].as_py(), b.column(3)[-1].as_py()) for b in found][-1] == (str(n - 1), (n - 1) % 256)


def test_folders_fill_up(spark, shoot, tmp_path):
    query = folders.arriving(spark, str(shoot)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.name for r in spark.table("arrived").collect()) == ["DSC2.jpg", "DSC3.NEF"]


def test_a_batch_of_names_takes_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}.jpg").write_bytes(b"x")
    with folders.named_only(spark):
        query = folders.arriving(spark, str(tmp_path)).writeStream.format("memory").queryName("few").trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("few").count() == 300
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= 4
    assert spark.conf.get("spark.sql.files.openCostInBytes") == "4194304b"


def test_arrivals_come_once_and_the_driver_keeps_no_names(spark, tmp_path):
    """A later file comes however old it says it is, and what's known isn't in the source's log."""
    root, state = tmp_path / "root", tmp_path / "state"
    (root / "a").mkdir(parents=True)
    (root / "a" / "1.jpg").write_bytes(b"x")

    def run():
        with folders.named_only(spark):
            stream = folders.arriving(spark, str(root), kept=str(tmp_path / "kept")).writeStream.format("parquet")
            query = stream.option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(tmp_path / "out"))
            query.awaitTermination()
        return sorted(r.name for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["1.jpg"] == run()
    (root / "a" / "2.jpg").write_bytes(b"x")
    os.utime(root / "a" / "2.jpg", (1e9, 1e9))
    assert run() == ["1.jpg", "2.jpg"]
    (root / "b c" / "d").mkdir(parents=True)
    (root / "b c" / "d" / "3.ARW").write_bytes(b"x")
    assert run() == ["1.jpg", "2.jpg", "3.ARW"]
    for log in ("sources", "offsets"):
        assert not [f for f in (state / log).rglob("*") if f.is_file() and b".jpg" in f.read_bytes()]


@pytest.mark.parametrize("tasks,least,named", [(1, 1, 9), (3, 2, 9), (4, 100, 9), (4, 100, 1)])
def test_arrivals_are_what_spark_would_list(spark, tmp_path, monkeypatch, tasks, least, named):
    monkeypatch.setattr(listing, "_AT_ONCE", 3)  # so that folders are shared out, and names come in several batches
    monkeypatch.setattr(listing, "_NAMED", named)
    names = ["a b+%20.jpg", "_x.jpg", "_x=y.jpg", ".h.jpg", "_metadata.jpg", "z._COPYING_", "é.ARW", *(f"{k}.jpg" for k in range(20))]
    root = tmp_path / "root"
    for dir_ in ("", "one", "one/two/three", "_off", ".off", "_k=v", "_metadata", "empty/empty"):
        (root / dir_).mkdir(parents=True, exist_ok=True)
        for name in names if "empty" not in dir_ else ():
            (root / dir_ / name).write_bytes(b"x" * len(name))
    reader = listing._ArrivalReader(str(root), str(tmp_path / "kept"), tasks, least)

    def read(end):
        parts = reader.partitions({"pass": 0}, end)
        assert len(parts) <= tasks
        return sorted((r["path"], r["length"]) for p in parts for b in reader.read(p) for r in b.to_pylist())

    spark_s = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root)).select("path", "length").collect()
    first = reader.latestOffset()
    expected = sorted((r.path.removeprefix("file:"), r.length) for r in spark_s)
    assert read(first) == expected and len(expected) == 23 * 5
    # A batch run again has the rows it had; the next one has all that came.
    (root / "new").mkdir()
    (root / "new" / "late.jpg").write_bytes(b"x")
    (root / "1.jpg").unlink()
    again = listing._ArrivalReader(str(root), str(tmp_path / "kept"), tasks, least)
    second = again.latestOffset()
    assert read(first) == expected and len(read(second)) == len(expected)
    again.commit(first)
    assert [f.name for f in (tmp_path / "kept").iterdir()] == [str(second["pass"])]


def test_arrivals_of_a_pattern_s_folders(spark, tmp_path):
    for dir_ in ("a1", "a2", "b"):
        (tmp_path / dir_).mkdir()
        (tmp_path / dir_ / f"{dir_}.jpg").write_bytes(b"x")
    query = folders.arriving(spark, f"{tmp_path}/a*").writeStream.format("memory").queryName("some").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.path for r in spark.table("some").collect()) == [f"{tmp_path}/a1/a1.jpg", f"{tmp_path}/a2/a2.jpg"]


def test_the_shared_folder_is_the_cluster_s(spark):
    class Cluster:
        conf = {"spark.checkpoint.dir": "/shared/"}
        sparkContext = SimpleNamespace(master="spark://host", applicationId="a")

    assert shared.folder(Cluster, "x").startswith("/shared/x-")
    Cluster.conf = {}
    with pytest.raises(RuntimeError, match="every executor"):
        shared.folder(Cluster, "x")
    assert shared.folder(spark, "x") != shared.folder(spark, "x")


def test_later_append_wins_a_millisecond(spark, tmp_path):
    """Of marks made in the same millisecond the one appended last stands, whatever files are called."""
    path = str(tmp_path / "log")
    from framesift import schema as S
    from framesift.operators import journal as reduced

    empty = {f.name: None for f in S.DECISIONS.fields}
    for k, rating in enumerate((3, 5, 1, 4, 2)):
        row = empty | {"at": 7, "session": 1, "file": ("/a/1.ARW", 1, 1, None), "rating": rating, "was": 0, "how": "mark"}
        journal.append(spark.createDataFrame([row], S.DECISIONS), path)
        assert reduced.last_marks(journal.read(spark, path)).first().rating == rating


def test_descriptions_out_of_entities(spark):
    """They have no place in the text: nothing is found there, and nothing crashes."""
    named = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:xmp="http://ns.adobe.com/xap/1.0/"'
    inner = "<rdf:Description xmp:Rating='3'/>"
    alone = f'<!DOCTYPE x [<!ENTITY d "{inner}">]><rdf:RDF {named}>&d;</rdf:RDF>'
    beside = alone.replace("&d;", f"&d;{inner.replace('3', '4')}")
    texts = spark.createDataFrame([(0, alone), (1, beside)], "id int, xmp string").orderBy("id")
    rows = texts.select(xmp.rating("xmp").alias("r"), xmp.with_rating("xmp", F.lit(5)).alias("w")).collect()
    assert rows[0].r.rating is None and rows[0].r.problem and rows[0].w is None
    assert rows[1].r.rating == 4 and rows[1].w == beside.replace("'4'", "'5'")
