"""Hot keys cut into blocks give the same results as windows, in even tasks."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from framesift import scale
from framesift.functions import predicates
from framesift.operators import assemble, journal, manifest, ranking, stacks
from framesift.plans import adapters as A


@pytest.fixture(scope="module")
def frames(spark):
    # Four folders, one with more than half of everything, and a few frames without one.
    few = A.frames(spark, SF).withColumn(
        "dir", F.when(F.xxhash64("path") % 5 < 3, "/shoots/hot").otherwise(F.concat(F.lit("/shoots/"), (F.xxhash64("path") % 3).cast("string")))
    )
    few = few.withColumn("dir", F.when(F.xxhash64("path") % 50 != 49, F.col("dir")))
    return few.withColumn("path", F.concat(F.coalesce("dir", F.lit("")), F.lit("/"), "name")).persist()


@pytest.fixture(scope="module")
def cut(frames):
    return scale.laid(frames, ["dir"], "path")


def same(one, other):
    columns = [c for c in one.columns if c != scale.BLOCK]
    assert columns == [c for c in other.columns if c != scale.BLOCK]
    a, b = one.select(columns).collect(), other.select(columns).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    return a


def test_only_hot_keys_are_cut(frames, cut):
    found = cut.groupBy("dir", scale.BLOCK).agg(F.min("path").alias("a"), F.max("path").alias("b"), F.count("*").alias("n"))
    rows = found.orderBy("dir", scale.BLOCK).collect()
    hot = [r for r in rows if r.dir == "/shoots/hot"]
    assert all(r[scale.BLOCK] == 0 for r in rows if r.dir != "/shoots/hot")
    assert [r[scale.BLOCK] for r in hot] == list(range(1, len(hot) + 1)) and len(hot) >= 7
    assert all(before.b < after.a for before, after in zip(hot, hot[1:]))
    same(frames, cut)
    assert scale.laid(frames.where("dir <> '/shoots/hot'").withColumn("dir", F.col("name")), ["dir"], "path").columns == frames.columns
    assert scale.laid(frames.where("false"), ["dir"], "path").count() == 0


@pytest.mark.parametrize("share", [0.4, 0.9, 1.0])
def test_no_task_has_more_than_its_share(spark, share):
    """Whatever a folder's part of everything."""
    n, parts = 40_000, int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(n).select(
        F.when(F.pmod(F.xxhash64("id"), F.lit(1000)) < int(share * 1000), "hot").otherwise((F.col("id") % 500).cast("string")).alias("dir"),
        F.lpad(F.col("id").cast("string"), 9, "0").alias("path"))
    found = scale.laid(rows, ["dir"], "path").groupBy("dir", scale.BLOCK).count()
    assert found.agg(F.max("count")).first()[0] < n / parts * 0.6


def test_previous_and_carried(frames, cut):
    values = {"was": F.col("rating"), "at": F.col("captured")}
    same(*(scale.previous(rows, ["dir"], "path", values) for rows in (frames, cut)))
    # Most blocks hold no such frame at all.
    for every in (2, 90):
        picks = {"pick": F.when(F.crc32("path") % every == 0, F.col("path")), "last": F.when(F.col("rating") > 1, F.col("rating"))}
        for inclusive in (True, False):
            for backward in (True, False):
                how = {"inclusive": inclusive, "backward": backward}
                found = [scale.carry(rows, ["dir"], "path", picks, **how).select("path", "pick", "last") for rows in (frames, cut)]
                assert len(same(*found)) == 1000


def test_no_write_and_one_shuffle_without_hot_keys(spark):
    """Frames in small folders keep the plan of plain windows."""
    frames = A.frames(spark, SF).withColumn("dir", (F.xxhash64("path") % 40).cast("string"))
    found = scale.laid(frames.select("dir", "path", "captured"), ["dir"], "path")
    assert not scale.is_laid(found)
    plan = stacks.by_time(found, A.GAP)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_lookups_with_null_keys(spark, frames):
    table = spark.createDataFrame([("/shoots/hot", 1), (None, 2)], "dir string, n int")
    found = scale.lookup(frames, table, ["dir"]).groupBy("dir", "n").count().collect()
    assert {(r.dir, r.n) for r in found} >= {("/shoots/hot", 1), (None, 2), ("/shoots/1", None)}
    assert scale.lookup(frames, table, ["dir"], "inner").count() == frames.where("dir IS NULL OR dir = '/shoots/hot'").count()


def test_stacks(frames, cut):
    for gap in (A.GAP, 40 * A.GAP, 1e9):
        found = same(*(stacks.by_time(rows, gap).select("path", "stack") for rows in (frames, cut)))
        assert any(r.stack for r in found)
    assert not all(r.stack for r in same(*(stacks.by_time(rows, A.GAP).select("path", "stack") for rows in (frames, cut))))


def test_looks(spark):
    looks = A.looks(spark, SF).withColumn("dir", F.lit("one"))
    cut = scale.laid(looks, ["dir"], "path")
    assert scale.is_laid(cut)
    assert any(r.stack for r in same(*(stacks.by_look(rows, 60, 300, 35).select("path", "stack") for rows in (looks, cut))))


@pytest.fixture(scope="module")
def stacked(frames, cut):
    """Stacks of all sizes, some over many blocks."""
    return [stacks.by_time(rows, 40 * A.GAP).persist() for rows in (frames, cut)]


def test_shown_and_neighbours(stacked):
    matches = predicates.search([("iso", ">", 1000)])
    some = F.col("stack").endswith("2.ARW")
    shown = [stacks.shown(rows, matches, some) for rows in stacked]
    same(*(s.drop("exif", "signals") for s in shown))
    same(*(stacks.neighbours(s).select("path", "previous", "next", "settled") for s in shown))


def test_ranking(stacked):
    same(*(ranking.evidence(rows.withColumn("burst", F.col("stack"))).select("path", "standing") for rows in stacked))
    in_stacks = [rows.where(F.col("stack").isNotNull()) for rows in stacked]
    assert scale.spans(in_stacks[1], ["dir", "stack"]).count() >= 1
    same(*(ranking.winners(rows, "stack").select("path", "score", "winner", "margin") for rows in in_stacks))
    undecided = [
        rows.withColumn("rating", F.when(F.col("rating") > 0, 0).otherwise(F.col("rating"))).where(F.col("signals").isNotNull()) for rows in stacked]
    suggested = [ranking.suggestions(rows) for rows in undecided]
    assert len(same(*suggested)) > 100
    current = undecided[0].where(F.col("kind") == "png").select("path")
    assert same(*(ranking.accepted(s, current) for s in suggested))
    assert same(*(ranking.chosen_winners(rows, current) for rows in stacked))


def test_a_stack_that_is_hot_itself(frames):
    """Stacks made by hand aren't stretches of a folder, so rows are laid out by stack."""
    by_hand = frames.withColumn("stack", F.when(F.xxhash64("name") % 3 != 0, F.lit("big")).otherwise(F.col("name")))
    cut = scale.laid(by_hand, ["dir", "stack"], "path")
    assert scale.is_laid(cut)
    same(*(ranking.winners(rows, "stack").select("path", "score", "winner", "margin") for rows in (by_hand, cut)))
    same(*(ranking.suggestions(rows) for rows in (by_hand, cut)))


def test_the_log(spark):
    log, views = A.decisions(spark, SF), A.views(spark, SF)
    one = [d.withColumn("session", F.lit(1).cast("bigint")) for d in (log, views)]
    marks = one[0].select("session", F.col("file.path").alias("path"), (F.col("at") + 7).alias("at"))
    found = {(r.path, r.at): r.dwell_ms for r in journal.dwell(one[1], marks).collect()}
    both = sorted([(r.at, 0, r.path) for r in one[1].collect()] + [(r.at, 1, r.path) for r in marks.collect()])
    expected, was, since = {}, None, None
    for at, mark, path in both:
        was, since = path, at if path != was else since
        if mark:
            expected[path, at] = at - since
    assert found == expected and 7 in expected.values()


def test_passed(spark):
    """As the log stood when each sitting's last mark in the folder was made, by going through it."""
    log = A.decisions(spark, SF).withColumn("session", F.col("seq") % 3)
    views = log.select("session", F.element_at(F.split("file.path", "/DSC"), 1).alias("dir"), F.col("file.path").alias("path"), "at")
    views = views.unionByName(views.withColumn("session", F.pmod(F.col("session") + 1, F.lit(3)))).unionByName(views)
    ratings = log.select("file.path").distinct().select("path", (F.crc32("path") % 3 - 1).cast("int").alias("rating"))
    held = {r.path: r.rating for r in ratings.collect()}
    marks = sorted((r.seq, r.session, r.file.path, r.rating) for r in log.where("how <> 'pass'").collect())
    for given, before in ((None, {}), (ratings, held)):
        expected = set()
        for r in views.collect():
            ends = [seq for seq, session, path, _ in marks if session == r.session and path.rsplit("/", 1)[0] == r.dir]
            if ends:
                last = [rating for seq, _, path, rating in marks if path == r.path and seq <= max(ends)]
                if (last[-1] if last else before.get(r.path, 0)) == 0:
                    expected.add((r.session, r.dir, r.path))
        found = journal.passed(views, log, given).collect()
        assert {tuple(r) for r in found} == expected and len(found) == len(expected) and expected


def test_copies(frames):
    """Of pictures that would go to one name the first goes, wherever they are."""
    shown = frames.select("path", F.lit("/to").alias("to")).unionByName(
        frames.select(F.concat(F.lit("/x"), "path").alias("path"), F.lit("/to").alias("to")))
    found = manifest.copies(shown, frames.select("path")).collect()
    assert sum(r.status == "there" for r in found) == 1000 and len(found) == 2000
    first = {}
    for r in sorted(found):
        assert (r.status == "copy") == (r.copy not in first)
        first[r.copy] = r.path


def test_formats(frames):
    rows = frames.collect()
    held = {r.dir for r in rows if r.kind == "png"}
    found = assemble.of_format(frames, "png").select("path").collect()
    assert {r.path for r in found} == {r.path for r in rows if r.kind == "png" or r.dir not in held}


def test_rows_to_sort_are_dealt_by_number(spark, monkeypatch):
    """As many partitions as the rows need, and adaptive execution leaves them."""
    from framesift.operators import pixels

    monkeypatch.setattr(scale, "MOST", 100)
    table = spark.range(900).select(
        F.floor(F.col("id") / 9).cast("string").alias("path"), (F.col("id") % 3).cast("int").alias("x"), F.floor(F.col("id") % 9 / 3).cast("int").alias("y"),
        *(F.lit(7).alias(c) for c in "rgb"))
    steep = pixels.steepness(table)
    assert steep.rdd.getNumPartitions() == 9
    assert steep.count() == 100 and {r.gradient for r in steep.collect()} == {0}
    marks = pixels.peaking(table)
    assert "ShuffledHashJoin" in marks._jdf.queryExecution().sparkPlan().toString()
    assert marks.count() == 900


def test_files_keys_are_made_once(spark):
    """Both runs of measured_once, the folders' counts and the result read tables; the events were projected and joined again for each."""
    from framesift.plans import catalog

    found = catalog.QUERIES["measured_once"](spark, "/root/testdata/sf0.001")
    read = found.inputFiles()
    assert read and not any("events" in path for path in read)
