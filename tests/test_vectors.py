"""The small cases with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from framesift import schema as S
from framesift.functions import features, predicates, scalars, vision, xmp
from framesift.operators import assemble, counts, faces, journal, manifest, pixels, ranking, searches, stacks

SIGNALS = "struct<focus:double,eyes:double,open:double,highlights:double,shadows:double,faces:bigint,face:double>"
EXIF = "struct<model:string,lens:string,exposure:struct<n:bigint,d:bigint>,f_number:double,iso:bigint,focal_length:double>"
FRAME = f"i int, dir string, path string, name string, kind string, rating int, captured double, suggested int, exif {EXIF}, signals {SIGNALS}, stack string"


def frame(i, rating=0, captured=None, suggested=None, exif=None, signals=None, stack=None, dir_="/d", name=None):
    name = name or f"DSC{i:05}.ARW"
    return (i, dir_, f"{dir_}/{name}", name, "raw", rating, captured, suggested, exif, signals, stack)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# -- stacks


def joined(mode, before, after):
    """Whether a frame goes on with the one before it; frames are (time, look)."""
    if mode == "off" or before[0] is None or after[0] is None:
        return False
    gap = abs(after[0] - before[0])
    if mode == "time" or before[1] is None or after[1] is None:
        return gap <= stacks.GAP
    shift = sum(x - y for x, y in zip(before[1], after[1])) / len(after[1])
    apart = sum(abs(x - y - shift) for x, y in zip(before[1], after[1])) / len(after[1])
    return gap <= stacks.SIMILAR_GAP and apart < stacks.ALIKE


@pytest.mark.parametrize("mode", ["time", "similar", "off"])
def test_runs(spark, mode):
    r = random.Random(12)
    faces = [[r.randint(0, 255) for _ in range(12)] for _ in range(3)]
    shots, at = [], 0.0
    for k in range(240):
        at += r.choice([0.0, 0.5, 1.5, 2.5, 12.0, 45.0])
        look = [v + r.choice([0, 3]) for v in faces[k // 9 % 3]]
        shots.append((None if k % 17 == 5 else at, None if k % 13 == 7 else look))
    expected = [[0]]
    for k in range(1, len(shots)):
        expected.append([k]) if not joined(mode, shots[k - 1], shots[k]) else expected[-1].append(k)
    rows = [("/d", k, f"{k:04}", t, look) for k, (t, look) in enumerate(shots)]
    frames = spark.createDataFrame(rows, "dir string, i int, path string, captured double, signature array<int>")
    found = stacks.stack(frames, mode).where("stack is not null").groupBy("stack").agg(F.sort_array(F.collect_list("i")).alias("m"))
    assert sorted(r.m for r in found.collect()) == [m for m in expected if len(m) > 1]
    assert (mode == "off") == (max(map(len, expected)) == 1)


def test_without_looks_a_burst_is_still_one(spark):
    rows = [("/d", f"{i}", t, None) for i, t in enumerate([0.0, 1.0, 20.0])]
    frames = spark.createDataFrame(rows, "dir string, path string, captured double, signature array<int>")
    assert [r.stack for r in stacks.stack(frames, "similar").orderBy("path").collect()] == ["0", "0", None]


def test_hand_stacks(spark):
    frames = spark.createDataFrame([frame(i) for i in range(6)] + [frame(9, name="DSC00003.JPG")], FRAME)
    name = "DSC{:05}.ARW".format
    hand = [("/d", s, n, at) for s, n, at in [
        (1, name(5), 1), (1, name(2), 1), (1, name(2), 1), (2, "IMG9.ARW", 1), (2, name(3), 1), (3, name(1), 1),
        # Taken from the first stack for another later on.
        (4, name(5), 2), (4, name(4), 2), (4, "DSC00000.PNG", 2),
    ]]
    hands = spark.createDataFrame(hand, "dir string, stack int, name string, at int")
    found = stacks.by_hand(frames, hands).where("stack is not null").orderBy("path").collect()
    assert [(r.i, r.stack) for r in found] == [(0, "/d/DSC00000.ARW"), (4, "/d/DSC00000.ARW"), (5, "/d/DSC00000.ARW")]
    first = hands.where("at = 1")
    assert [r.i for r in stacks.by_hand(frames, first).where("stack is not null").orderBy("path").collect()] == [2, 5]


def test_representatives(spark):
    # Two stacks and a frame alone.
    rows = [
        frame(0, 0, stack="a"), frame(1, 3, stack="a"), frame(2, 3, stack="a"),
        frame(3, 0, stack="b"), frame(4, 0, suggested=1, stack="b"), frame(5, 0, suggested=-1, stack="b"),
        frame(6, -1),
    ]
    frames = spark.createDataFrame(rows, FRAME)

    def visible(condition, expanded=()):
        return [r.i for r in stacks.shown(frames, condition, expanded).where("visible").orderBy("i").collect()]

    assert visible(predicates.mark_filter("all")) == [1, 4, 6]
    assert visible(predicates.mark_filter("undecided")) == [0, 4]
    assert visible(predicates.mark_filter("all"), ["b"]) == [1, 3, 4, 5, 6]
    assert visible(predicates.mark_filter("rejects")) == [6]


def test_nearest_match(spark):
    isos = [100, 800, 3200, 6400]
    rows = [frame(i, 1 if i == 3 else 0, exif=(None, None, None, None, iso, None)) for i, iso in enumerate(isos)]
    frames = spark.createDataFrame(rows, FRAME)

    def settled(at, *terms):
        found = stacks.neighbours(stacks.shown(frames, predicates.search(terms)))
        to = found.where(F.col("i") == at).first().settled
        return int(to[-9:-4])

    assert settled(0, ("iso", ">=", 3200)) == 2
    assert settled(2, ("flag", None, "pick")) == 3
    assert settled(3, ("iso", "<=", 800)) == 1
    assert settled(1, ("iso", ">", 9999)) == 1


# -- ranking


def signals(eyes=None, focus=None, open=None, highlights=0.0):
    return (focus, eyes, open, highlights, 0.0, 0, 0.0)


def weighed(group):
    """Each frame's shares, and which wins by how much; frames are (eyes, focus, open, highlights)."""
    by = [e if all(f[0] is not None for f in group) else None for e, *_ in group]
    if by[0] is None:
        by = [f[1] for f in group]
        if any(v is None for v in by):
            by = [f[0] if f[0] is not None else f[1] for f in group]
    best, wide = max((v for v in by if v is not None), default=None), max((f[2] for f in group if f[2] is not None), default=None)

    def share(v, most):
        return None if v is None else v / most if most > 0 else 1.0

    sharp, opened = [share(v, best) for v in by], [share(f[2], wide) for f in group]
    scores = [(1 if s is None else s) * (0.4 + 0.6 * (1 if o is None else o)) - f[3] for s, o, f in zip(sharp, opened, group)]
    order = sorted(range(len(group)), key=lambda k: (-scores[k], k))
    lead = scores[order[0]] - scores[order[1]] if len(group) > 1 else 1
    return sharp, opened, order[0], min(max(lead, 0), 1)


def test_winners(spark):
    r = random.Random(9)

    def measure():
        return r.choice([None, r.uniform(0, 80), r.uniform(0, 80), 0.0])

    groups = [[(measure() if k % 3 else r.uniform(1, 90), measure() if k % 2 else r.uniform(1, 90), r.choice([None, r.random()]), r.choice([0.0, 0.1, 0.4]))
               for _ in range(1 + k % 5)] for k in range(60)]
    groups += [[(5.0, 6.0, 0.7, 0.0)] * 2, [(None, None, None, 0.0)] * 2]
    rows = [("/d", f"{k:03}/{i}", f"{k:03}", signals(*f)) for k, group in enumerate(groups) for i, f in enumerate(group)]
    frames = spark.createDataFrame(rows, f"dir string, path string, group string, signals {SIGNALS}")
    found = {}
    for row in ranking.winners(ranking.standings(frames)).orderBy("path").collect():
        found.setdefault(row.group, []).append(row)
    for k, group in enumerate(groups):
        sharp, opened, best, lead = weighed(group)
        seen = found[f"{k:03}"]
        assert {x.winner for x in seen} == {f"{k:03}/{best}"} and seen[0].margin == pytest.approx(lead)
        assert [x.standing.of for x in seen] == [len(group)] * len(group)
        assert [x.standing.sharp for x in seen] == [None if v is None else pytest.approx(v) for v in sharp]
        assert [x.standing.open for x in seen] == [None if v is None else pytest.approx(v) for v in opened]


def test_suggested_accepted_and_chosen(spark):
    measured = [signals(5.0), signals(50.0), signals(6.0)]
    rows = [frame(i, signals=s, stack="s") for i, s in enumerate(measured)] + [frame(3), frame(4, signals=measured[0])]
    frames = spark.createDataFrame(rows, FRAME)
    suggested = ranking.suggestions(frames)
    assert [(r.path[-9:-4], r.suggestion.rating) for r in suggested.orderBy("path").collect()] == [
        ("00000", -1), ("00001", 1), ("00002", -1),
    ]
    taken = ranking.accepted(suggested, suggested.where("suggestion.rating < 0").limit(1).select("path"))
    assert [r.rating for r in taken.orderBy(*ranking.accepting_order()).collect()] == [1, -1, -1]
    # One kept already, or one not measured: nothing is suggested.
    kept = frames.withColumn("rating", F.when(F.col("i") == 1, 2).otherwise(F.col("rating")))
    assert ranking.suggestions(kept).count() == 0
    unseen = frames.withColumn("signals", F.when(F.col("i") != 2, F.col("signals")))
    assert ranking.suggestions(unseen).count() == 0
    choice = frames.where("i = 1").select("path")
    marks = ranking.chosen_winners(kept, choice).orderBy("path").collect()
    assert [(r.path[-9:-4], r.was, r.now) for r in marks] == [("00000", 0, -1), ("00002", 0, -1)]
    assert [r.now for r in ranking.chosen_winners(frames, choice, pick=2).orderBy("path").collect()] == [-1, 2, -1]


def test_a_frame_in_no_group_stands_alone(spark):
    rows = [frame(0, signals=signals(5.0)), frame(1), frame(2, signals=signals(5.0), stack="s"), frame(3, stack="s")]
    frames = spark.createDataFrame(rows, FRAME).withColumn("burst", F.lit(None).cast("string"))
    found = [r.standing for r in ranking.evidence(frames).orderBy("i").collect()]
    assert (found[0].of, found[0].sharp, found[1], found[3]) == (1, None, None, None)
    assert (found[2].of, found[2].sharp) == (1, 1.0), "the others of its stack aren't measured"


# -- search


SHOT = ("ILCE-7M3", "FE 85mm F1.8", (1, 250), 2.8, 3200, 85.0)
SHARP = (40.0, 30.0, 0.9, 0.02, 0.1, 2, 0.1)


@pytest.fixture(scope="module")
def searched(spark):
    blink = (8.0, 30.0, 0.1, 0.02, 0.1, 2, 0.1)
    bare = (None, None, None, None, None, None)
    rows = [
        frame(0, 3, exif=SHOT), frame(1, exif=bare), frame(2, exif=SHOT, signals=SHARP), frame(3, exif=SHOT, signals=blink),
        frame(4, exif=bare, suggested=1, stack="s"), frame(5, 2, exif=bare, suggested=1), frame(6, -1, exif=bare),
    ]
    return spark.createDataFrame(rows, FRAME).persist()


@pytest.mark.parametrize(
    "i, term, yes",
    [
        (0, ("iso", ">=", "3200"), True), (0, ("iso", ">", 3200), False), (0, ("iso", None, 3200), True),
        (0, ("f", "=", 2.8), True), (0, ("aperture", "<", 2), False), (0, ("focal", ">=", 85), True),
        (0, ("rating", ">=", 3), True), (0, ("rating", "=", 4), False), (0, ("shutter", "=", "1/250"), True),
        (0, ("shutter", "<", "1/125"), True), (0, ("shutter", "<", "1/500"), False), (0, ("shutter", ">", "0.003"), True),
        (0, ("lens", None, "fe 85MM"), True), (0, ("camera", None, "7m3"), True), (0, (None, None, "dsc0000"), True),
        (0, (None, None, "nikon"), False), (0, ("name", None, ".arw"), True),
        *((1, t, False) for t in [("iso", ">", 0), ("iso", "<", 99999), ("f", ">", 0), ("shutter", ">", 0), ("focus", ">", 0), ("faces", ">=", 0), ("blown", "<", 1)]),
        (0, ("shut", None, "no"), False), (0, ("shut", None, "yes"), False),
        (2, ("focus", "<", 12), False), (3, ("sharp", "<", 12), True), (2, ("shut", None, "no"), True), (3, ("shut", None, True), True),
        (2, ("open", ">", 0.5), True), (3, ("open", ">", 0.5), False), (2, ("blown", "<", "5%"), True), (2, ("highlights", ">", "5%"), False),
        (2, ("black", ">=", "10%"), True), (2, ("faces", ">=", 2), True), (2, ("eyes", ">", 20), True),
        (4, ("suggested", None, "yes"), True), (4, ("stack", None, "yes"), True), (5, ("suggested", None, "no"), True),
        (5, ("flag", None, "pick"), True), (5, ("flag", None, "reject"), False), (6, ("flag", None, "rejected"), True), (1, ("flag", None, "undecided"), True),
    ],
)
def test_terms(spark, searched, i, term, yes):
    row = searched.where(F.col("i") == i)
    assert row.where(predicates.search([term])).count() == yes
    assert row.where(~predicates.search([term])).count() == (not yes), "never null"
    # And the same from a table of terms.
    field, op, v = term
    said = {True: "yes", False: "no"}.get(v, str(v)) if isinstance(v, bool) else str(v)
    terms = spark.createDataFrame([(1, "/d", field, op, said)], S.TERMS)
    assert searches.matches(row, terms).count() == yes


def test_bad_terms(spark):
    cases = [
        ("iso", "=", "fast", "iso takes a number"), ("iso", ">", "", "iso takes a number"), ("iso", "=", "nan", "iso takes a number"),
        ("shutter", "=", "1/0", "shutter takes a number"), ("shut", None, "maybe", "shut is asked for with yes or no"),
        ("flag", None, "starred", "flag is one of"), ("lens", None, "", "lens takes a piece of text"), ("colour", None, "red", '"colour" can\'t be searched'),
    ]
    rows = [(i, "/d", f, op, v) for i, (f, op, v, _) in enumerate(cases)] + [(7, "/d", "iso", None, "100"), (9, "/d", "iso", ">=", "1/2")]
    terms = spark.createDataFrame(rows, S.TERMS)
    found = {r.search_id: r.problem for r in searches.bad_terms(terms).collect()}
    assert sorted(found) == list(range(8))
    for i, (field, op, v, says) in enumerate(cases):
        assert says in found[i]
        with pytest.raises(ValueError, match=says.split(" (")[0].replace("?", "\\?")):
            predicates.search([(field, op, v)])
    assert [r.search_id for r in searches.readable(terms).collect()] == [9], "a search with a bad term is dropped whole"


def test_needs_measuring():
    assert predicates.needs_measuring([("focus", "<", 12)]) and predicates.needs_measuring([("shut", None, "yes")])
    assert not predicates.needs_measuring([("iso", ">", 100), ("stacked", None, "yes"), (None, None, "dsc")])


# -- counts and manifests


def test_counts_and_summary(spark):
    frames = spark.createDataFrame([frame(i, r) for i, r in enumerate([0, 0, 4, -1])], FRAME)
    row = counts.counts(frames, "dir").first()
    assert (row.picks, row.rejects, row.undecided, row.stars_4, row.total) == (1, 1, 2, 1, 4)
    lines = counts.summary(frames, "dir").orderBy("line").collect()
    assert [(r.label, r.n, r.percent) for r in lines][:2] == [("picks", 1, 25), ("stars_5", 0, 0)]
    assert counts.first_undecided(frames).first()[0] == "/d/DSC00000.ARW"


def listing(spark, *paths, dirs=()):
    rows = [(p, p.rsplit("/", 1)[0], p.rsplit("/", 1)[1], False, 1, None) for p in paths]
    rows += [(p, p.rsplit("/", 1)[0], p.rsplit("/", 1)[1], True, 0, None) for p in dirs]
    return spark.createDataFrame(rows, S.LISTING)


def test_formats(spark):
    names = ["a.ARW", "b.arw", "a.JPG", "b.jpg", "c.jpeg", ".d.JPG", "e.tif"]
    files = listing(spark, *(f"/s/{n}" for n in names), dirs=["/s/x.jpg"])
    frames = assemble.pictures(files)
    held = counts.kinds_held(frames, "raw").first()
    assert (held.raw, held.jpeg, held.png, held.choices, held.left_out) == (2, 3, 0, ["all", "raw", "jpeg"], 3)
    assert assemble.of_format(frames, "raw").count() == 2
    assert assemble.of_format(frames, "png").count() == 5, "none of the kind: all"


def test_folders(spark):
    shoot = "/r/2026-10-04 wedding"
    files = [f"{shoot}/DSC0000{i}.ARW" for i in (1, 2, 3)] + [f"{shoot}/DSC00001.ARW.xmp", f"{shoot}/DSC00001.JPG", "/r/notes.txt"]
    table = listing(spark, *files, dirs=[shoot, f"{shoot}/selects", "/r/2026-09-01 empty", "/r/.thumbnails"])
    found = counts.folders(table).where("parent = '/r'").orderBy("name").collect()
    assert [(r.name, r.pictures, r.nested) for r in found] == [("2026-09-01 empty", 0, False), ("2026-10-04 wedding", 4, True)]


def test_deletions(spark):
    names = ["1.ARW", "1.ARW.xmp", "1.xmp", "1.JPG", "1.JPG.xmp", "2.ARW", "2.ARW.xmp"]
    files = listing(spark, *(f"/s/{n}" for n in names))
    rejects = spark.createDataFrame([("/s/1.ARW", -1), ("/s/2.ARW", 1)], "path string, rating int")
    assert sorted(r.path for r in manifest.deletions(rejects, files).collect()) == ["/s/1.ARW", "/s/1.ARW.xmp", "/s/1.xmp"]


def test_copies(spark):
    files = listing(spark, "/s/1.ARW", "/s/1.ARW.xmp", "/s/2.ARW", "/s/3.ARW", "/s/3.ARW.xmp", "/to/2.ARW", "/to/3.ARW.xmp")
    shown = spark.createDataFrame([(f"/s/{i}.ARW", "/to") for i in (1, 2, 3)], "path string, to string")
    found = manifest.copies(shown, files).orderBy("path").collect()
    assert [(r.status, r.sidecar) for r in found] == [("copy", "/s/1.ARW.xmp"), ("there", None), ("copy", None)]
    results = spark.createDataFrame([("/to", "a", "copy", None), ("/to", "c", "failed", "c: full"), ("/to", "b", "failed", "b: full")], "to string, path string, status string, problem string")
    row = manifest.tallies(results).first()
    assert (row.copied, row.there, row.failed) == (1, 0, 2)
    assert sorted(r.problem for r in manifest.failures(results).collect()) == ["b: full", "c: full"]


# -- names, times, keys


def test_sidecar_names(spark):
    for naming, raw in (("darktable", "/s.x/DSC1.ARW.xmp"), ("adobe", "/s.x/DSC1.xmp")):
        assert value(spark, scalars.sidecar_path(F.lit("/s.x/DSC1.ARW"), naming)) == raw
        assert value(spark, scalars.sidecar_path(F.lit("/s/DSC1.JPG"), naming)) == "/s/DSC1.JPG.xmp"
        assert value(spark, scalars.sidecar_path(F.lit("/s/DSC1.png"), naming)) == "/s/DSC1.png.xmp"
    assert value(spark, scalars.kind(F.lit(".arw"))) is None and value(spark, scalars.kind(F.lit("arw"))) is None
    assert value(spark, scalars.kind(F.lit("a.b.CR3"))) == "raw"


def test_exif_times(spark):
    def t(text):
        return value(spark, scalars.exif_seconds(F.lit(text)))

    assert t("2026:10:04 15:43:17") - t("2026:10:04 15:43:16.5") == 0.5
    assert t("2026:10:05 00:00:00") - t("2026:10:04 23:59:59") == 1.0
    assert t("2026:03:01 00:00:00") - t("2026:02:28 00:00:00") == 86_400
    assert t("2024:03:01 00:00:00") - t("2024:02:28 00:00:00") == 2 * 86_400
    assert t("2026:13:01 00:00:00") == t("2027:01:01 00:00:00"), "months run over"
    assert t("2026:1:1 0:0:1") == t("2026:01:01 00:00:01")
    for text in ("    :  :     :  :  ", "2026:10:04", "2026:10:04 15:43", ""):
        assert t(text) is None
    assert value(spark, scalars.capture_text(F.lit("    :  :"), F.lit("12"))) is None
    assert value(spark, scalars.capture_text(F.lit("2026:10:04 12:00:00"), F.lit("123"))) == "2026:10:04 12:00:00.123"
    assert value(spark, scalars.capture_text(F.lit("2026"), F.lit(""))) == "2026"


def test_quantities_and_marks(spark):
    for text, number in (("3", 3.0), ("1/250", 0.004), ("5%", 0.05), (".5", 0.5), ("nan", None), ("inf", None), ("1e999", None), ("1/0", None), ("", None), ("%", None), ("1d", None)):
        assert value(spark, scalars.quantity(F.lit(text))) == number, text
    for rating, clamped in ((9, 5), (-7, -1), (None, 0), (2, 2)):
        assert value(spark, scalars.clamp_rating(F.lit(rating).cast("int"))) == clamped


def test_upright(spark):
    at = [(0.2, 0.3), (0.2, 0.3), (0.8, 0.3), (0.8, 0.7), (0.2, 0.7), (0.3, 0.2), (0.7, 0.2), (0.7, 0.8), (0.3, 0.8)]
    for orientation, (x, y) in enumerate(at):
        found = value(spark, scalars.upright(F.lit(orientation), F.lit(0.2), F.lit(0.3)))
        assert (found.x, found.y) == pytest.approx((x, y)), orientation


def test_fnv(spark):
    for text in ("", "a", "/shoot/é.ARW|2026"):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        key = scalars.fnv(F.lit(text))
        assert value(spark, scalars.fnv_hex(key)) == f"{h:016x}"


# -- sidecars


RDF = 'xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'
XMP = "http://ns.adobe.com/xap/1.0/"


def wrapped(inner):
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF {RDF}>{inner}</rdf:RDF></x:xmpmeta>'


@pytest.mark.parametrize(
    "text, rating, problem, changed",
    [
        (wrapped(f'<rdf:Description rdf:about="" a="x>y" xmlns:xmp="{XMP}" xmp:Rating="0" b="1"/>'), 0, None, ('Rating="0"', 'Rating="4"')),
        (wrapped(f'<rdf:Description rdf:about="" xmlns:xap="{XMP}"><xap:Rating>2</xap:Rating></rdf:Description>'), 2, None, (">2<", ">4<")),
        (wrapped('<rdf:Description rdf:about=""/>'), None, None, ("Description rdf", f'Description xmlns:xmp="{XMP}" xmp:Rating="4" rdf')),
        (wrapped(f'<rdf:Description rdf:about="" xmlns:xmp="{XMP}"/>'), None, None, ("Description rdf", 'Description xmp:Rating="4" rdf')),
        (wrapped('<rdf:Description xmlns:xmp="urn:other"/>'), None, "bound to another namespace", None),
        (wrapped(f'<rdf:Description xmlns:q="{XMP}" q:Rating=\'-1\'/>'), -1, None, ("'-1'", "'4'")),
        (wrapped(f'<!-- <rdf:Description xmp:Rating="1"/> --><rdf:Description xmlns:xmp="{XMP}" xmp:Rating="3"/>'), 3, None, ('Rating="3"', 'Rating="4"')),
        (wrapped(f'<rdf:Description xmlns:xmp="{XMP}"><xmp:Rating/></rdf:Description>'), None, "holds nothing", None),
        (wrapped(f'<rdf:Description xmlns:xmp="{XMP}"><xmp:Rating></xmp:Rating></rdf:Description>'), None, "no whole number", None),
        (wrapped(f'<rdf:Description xmlns:xmp="{XMP}" xmp:Rating="high"/>'), None, "no whole number", ("high", "4")),
        ("not xml at all", None, "well-formed", None),
        ("<a><b></a>", None, "well-formed", None),
        ("<a/>", None, "describes", None),
        (wrapped('<rdf:Description><b></rdf:Description>'), None, "well-formed", None),
        (wrapped(f'<rdf:Description xmlns:xmp="{XMP}"><![CDATA[<xmp:Rating>5</xmp:Rating>]]></rdf:Description>'), None, None, ("Description xmlns", 'Description xmp:Rating="4" xmlns')),
        (wrapped(f'<rdf:Description xmlns:q="urn:other" q:Rating="4"/><rdf:Description xmlns:q="{XMP}" q:Rating="2"/>'), 2, None, ('q:Rating="2"', 'q:Rating="4"')),
        (wrapped(f'<rdf:Description><Rating xmlns="{XMP}">3</Rating></rdf:Description>'), 3, None, (">3<", ">4<")),
        (wrapped(f'<rdf:Description xmlns:xmp="{XMP}"><xmp:Rating><![CDATA[5]]></xmp:Rating></rdf:Description>'), None, "no whole number", None),
        (wrapped(f'<!-- é日 --><rdf:Description xmlns:xmp="{XMP}" a="ü" xmp:Rating = "3"/>'), 3, None, ('"3"', '"4"')),
        (f'<?xml version="1.0" encoding="UTF-8"?><?x Rating="1"?>' + wrapped(f'<rdf:Description xmlns:xmp="{XMP}" xmp:Rating="3"/>'), 3, None, ('xmp:Rating="3"', 'xmp:Rating="4"')),
    ],
)
def test_sidecar_text(spark, text, rating, problem, changed):
    row = spark.createDataFrame([(text,)], "xmp string").select(
        xmp.rating("xmp").alias("r"), xmp.with_rating("xmp", F.lit(4)).alias("w")
    ).first()
    assert row.r.rating == rating
    assert problem in row.r.problem if problem else row.r.problem is None
    assert row.w == (text.replace(*changed) if changed else None)


def test_fresh_sidecars(spark):
    rows = spark.range(-1, 6).select("id", xmp.fresh("id").alias("x")).select("id", xmp.rating("x").alias("r")).collect()
    assert all(r.r.rating == r.id and r.r.problem is None for r in rows)


def test_write_back(spark):
    held = wrapped(f'<rdf:Description xmlns:xmp="{XMP}" xmp:Rating="2"/>')
    sidecars = spark.createDataFrame([("/s/1.ARW.xmp", held), ("/s/2.ARW.xmp", held), ("/s/3.ARW.xmp", "junk")], S.SIDECARS)
    marks = spark.createDataFrame(
        [("/s/1.ARW", 2), ("/s/2.ARW", -1), ("/s/3.ARW", 5), ("/s/4.ARW", 0), ("/s/5.ARW", 3), ("/s/6.ARW", 6)], "path string, rating int"
    )
    written = assemble.write_back(marks, sidecars)
    found = {r.path[3]: r for r in written.collect()}
    assert sorted(found) == ["2", "3", "5", "6"], "the same mark, and none where there's no sidecar, change nothing"
    assert found["2"].xmp == held.replace('"2"', '"-1"') and "well-formed" in found["3"].problem
    assert 'Rating="3"' in found["5"].xmp and found["6"].problem == "there is no such mark"
    failed = assemble.failures(written, sidecars)
    assert {r.path[3]: r.on_disk for r in failed.collect()} == {"3": 0, "6": 0}
    restored = assemble.restored(marks, failed).orderBy("path").collect()
    assert [r.rating for r in restored] == [2, -1, 0, 0, 3, 0]


# -- pixels and faces


def picture(spark, w, h, paint, path="p"):
    levels = [(path, x, y, *([paint(x, y)] * 3)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(levels, S.PIXELS)


def stripes(soft):
    """Bars four pixels wide, averaged over ``soft`` more."""
    bars = [28] * 4 + [228] * 4
    spread = [sum(bars[(x + i) % 8] for i in range(soft + 1)) // (soft + 1) for x in range(8)]
    return lambda x, _: spread[x % 8]


def sobel(paint, w, h):
    def g(x, y):
        at = lambda dx, dy: paint(x + dx, y + dy)
        gx = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
        gy = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
        return abs(gx) + abs(gy)

    return {(x, y): g(x, y) for y in range(1, h - 1) for x in range(1, w - 1)}


def test_steepness_across_tiles(spark):
    w, h = 150, 70

    def paint(x, y):
        return (x * x * 7 + y * 31 + x * y) % 256

    found = {(r.x, r.y): r.gradient for r in pixels.steepness(picture(spark, w, h, paint)).collect()}
    assert found == sobel(paint, w, h)


def test_sharpness(spark):
    focus = spark.createDataFrame([("p", 0.5, 0.5)], "path string, u double, v double")

    def measured(paint):
        table = picture(spark, 160, 120, paint)
        return pixels.measured(table, focus).first()

    crisp, soft = measured(stripes(0)), measured(stripes(3))
    assert crisp.focus > 150 and soft.focus < crisp.focus * 0.6
    # A square of an eighth of 160 round the middle, [70, 90) by [50, 70).
    inside = sorted((g for (x, y), g in sobel(stripes(3), 160, 120).items() if 70 <= x < 90 and 50 <= y < 70), reverse=True)
    assert soft.focus == pytest.approx(sum(inside[:40]) / 40 / 4)
    flat = measured(lambda x, y: 128)
    assert (flat.focus, flat.eyes, flat.open, flat.faces) == (0.0, None, None, 0)
    small = picture(spark, 40, 30, stripes(0))
    assert pixels.measured(small, focus).first().focus is None, "five pixels across is too small to say"


def test_clipping_and_marks(spark):
    table = picture(spark, 40, 20, lambda x, _: 255 if x < 4 else 0 if x < 14 else 128)
    row = pixels.clipping(table).first()
    assert (row.highlights, row.shadows) == pytest.approx((0.10, 0.25))
    marks = {(r.x, r.y): r.mark for r in pixels.peaking(table).collect()}
    assert len(marks) == 800
    assert marks[2, 5] == 2 and marks[4, 5] == 1 | 4 and marks[3, 5] == 2 | 4 and marks[20, 5] == 0
    assert marks[13, 5] == 1, "steep, but not of the picture's steepest"
    assert marks[3, 0] == 2, "nothing at the edge is sharp"
    shares = pixels.peaking_shares(pixels.peaking(table)).first()
    assert shares.sharp == pytest.approx(2 * 18 / 800)


def test_signatures(spark):
    def grid(paint, w=64, h=48):
        return spark.createDataFrame([("p", x, y, *([paint(x, y)] * 3)) for y in range(h) for x in range(w)], S.PIXELS)

    def signature(paint, *size):
        return pixels.signatures(grid(paint, *size)).first().signature

    scene, brighter = signature(lambda x, y: x * 3 + y), signature(lambda x, y: (x * 3 + y + 20) % 256)
    other = signature(lambda x, _: 230 if x < 32 else 10)
    assert len(scene) == 192 and scene[0] == (sum(x * 3 + y for x in range(4) for y in range(4)) + 8) // 16
    table = spark.createDataFrame([(scene, brighter, other)], "a array<int>, b array<int>, c array<int>")
    row = table.select(vision.signature_distance("a", "b").alias("near"), vision.signature_distance("a", "c").alias("far")).first()
    assert row.near < 1 and row.far > stacks.ALIKE
    # Nothing is enlarged: a small one is read where it is.
    tiny = signature(lambda x, y: 10 * x + 100 * y, 4, 2)
    assert tiny[:16] == [0] * 4 + [10] * 4 + [20] * 4 + [30] * 4 and tiny[-1] == 130


def test_tone_curves(spark):
    import random

    random.seed(7)
    have = [random.randint(0, 5) for _ in range(64)]
    want = [random.choice([0, 0, 3, 9]) for _ in range(256)]
    rows = [[("p", "r", i, n) for i, n in enumerate(side)] for side in (have, want)]
    tables = [spark.createDataFrame(r, "path string, channel string, level int, n long") for r in rows]
    found = {r.level: r.to for r in pixels.tone_curves(*tables, levels=64).collect()}
    seen, total = 0, sum(have)
    for i, n in enumerate(have):
        share = (seen + n / 2) / total
        seen += n
        below, expected = 0, 255
        for level, m in enumerate(want):
            below += m
            if below / sum(want) >= share:
                expected = level
                break
        assert found[i] == expected, i
    empty = tables[1].withColumn("n", F.lit(0).cast("long"))
    assert {r.level: r.to for r in pixels.tone_curves(tables[0], empty, levels=64).collect()}[63] == 255


FACES = "path string, score double, bounds array<double>, eyes array<array<double>>, open double"


def test_bystanders(spark):
    def face(path, left, size, open):
        return (path, 0.9, [left, 0.2, left + size, 0.2 + size], [[left + size * 0.3, 0.3], [left + size * 0.7, 0.3]], open)

    rows = [face("two", 0.1, 0.3, 0.9), face("two", 0.5, 0.4, 0.1), face("one", 0.1, 0.4, 0.9), face("one", 0.6, 0.1, 0.0), face("none", 0.1, 0.4, None)]
    found = {r.path: r for r in faces.per_frame(spark.createDataFrame(rows, FACES)).collect()}
    assert (found["two"].open, found["two"].faces) == (0.1, 2) and found["two"].face == pytest.approx(0.16)
    assert found["one"].open == 0.9 and found["none"].open is None


def test_suppressed(spark):
    rows = [("p", s, b, [[0.0, 0.0], [0.0, 0.0]], None) for s, b in [(0.7, [0.1, 0.1, 0.3, 0.3]), (0.9, [0.11, 0.1, 0.31, 0.3]), (0.8, [0.6, 0.6, 0.7, 0.7])]]
    kept = faces.suppressed(spark.createDataFrame(rows, FACES))
    assert [r.score for r in kept.orderBy(F.desc("score")).collect()] == [0.9, 0.8]


def test_eyelids(spark):
    def face(name, gaps):
        points = []
        for at, eye, gap in zip((100.0, 200.0), vision.EYES, gaps):
            outer, inner = eye["corners"]
            points += [(name, 0, outer, at, 50.0), (name, 0, inner, at + 30, 50.0)]
            for upper, lower in eye["lids"]:
                points += [(name, 0, upper, at + 15, 50 - gap / 2), (name, 0, lower, at + 15, 50 + gap / 2)]
        return points

    lost = [p for p in face("lost", (10, 10)) if p[2] != 33]
    rows = face("wide", (10, 10)) + face("shut", (1, 1)) + face("half", (6, 6)) + face("wink", (3, 9)) + lost
    table = spark.createDataFrame(rows, "path string, face int, point int, x double, y double")
    found = {r.path: r.open for r in faces.eyelids(table).collect()}
    assert found["wide"] == 1 and found["shut"] == 0 and 0.3 < found["half"] < 0.7 and 0.4 < found["wink"] < 0.6
    assert found["lost"] is None


# -- the log


def test_features(spark):
    row = spark.createDataFrame([((0.0, None, 0.2, 0.25, 0.04, 9, 0.09), (20, None, 0.5))], f"s {SIGNALS}, t struct<of:bigint,sharp:double,open:double>")
    found = row.select(features.vector("s", "t").alias("v")).first().v
    assert found == pytest.approx([0, 1, 0, 0, 0.2, 1, 1, 0.5, 0.2, 1, 0.3, 1, 0.5, 1])
    lone = row.select(features.vector("s", F.lit(None).cast("struct<of:bigint,sharp:double,open:double>")).alias("v")).first().v
    assert lone[-3:] == [1, 1, 0]


def test_last_states(spark):
    seen = (54.0, 72.0, 0.9, 0.0, 0.0, 0, 0.0)
    file = lambda i: (f"/s/{i}.ARW", 1, 1, None)
    rows = [(1, file(1), 1, seen), (2, file(1), -1, None), (3, file(2), 0, seen), (4, file(3), 4, None)]
    log = spark.createDataFrame(rows, f"seq int, file struct<path:string,size:bigint,modified:bigint,captured:string>, rating int, signals {SIGNALS}")
    log = log.withColumn("standing", F.lit(None).cast("struct<of:bigint,sharp:double,open:double>"))
    found = journal.final_states(log).orderBy("path").collect()
    assert [r.rating for r in found] == [-1, 0] and found[0].features[4] == 0.9


def test_corrupt_dates_are_read_or_null(spark):
    rows = ["999999999:01:01 00:00:00", "2147483647:12:31 00:00:00", "99999999999:01:01 00:00:00", "2024:14:00 00:00:00", "2024:02:30 25:00:00",
            "0000:00:00 00:00:00", "-5:03:01 00:00:00", "1970:01:01 00:00:00", "2000:03:01 12:00:00"]
    found = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, t string").select("k", scalars.exif_seconds("t").alias("s")).collect()
    s = {r.k: r.s for r in found}
    import datetime as dt

    def day(*ymd):
        return (dt.date(*ymd) - dt.date(1970, 1, 1)).days * 86400.0

    assert s[0] > 3e16 and s[1] > s[0] and s[2] is None
    assert s[3] == day(2025, 1, 31) and s[4] == day(2024, 3, 1) + 90000 and s[7] == 0 and s[8] == day(2000, 3, 1) + 43200


def test_quantities_are_read_alike(spark):
    said = ["3", "1/250", "5%", "1_000", " 3 ", "1/2%", "1/0", "nan", "inf", "1e400", ".5", "5.", "-2", "+1e-3", "", "/", "1/", "%", "1/2/3"]
    found = spark.createDataFrame([(t,) for t in said], "t string").select("t", scalars.quantity("t").alias("q")).collect()
    assert {r.t: r.q for r in found} == {t: scalars.quantity_of(t) for t in said}


def test_tones_are_matched_by_channel(spark):
    import random

    r = random.Random(8)
    curves = {(p, c, level): r.randint(0, 255) for p in "ab" for c in "rgb" for level in r.sample(range(4096), 900)}
    rows = [(p, x, y, *(r.random() for _ in range(3))) for p in "abz" for x in range(12) for y in range(9)]
    developed = spark.createDataFrame(rows, "path string, x int, y int, r double, g double, b double")
    table = spark.createDataFrame([(*k, v) for k, v in curves.items()], "path string, channel string, level int, to int")
    found = {(t.path, t.x, t.y): (t.r, t.g, t.b) for t in pixels.tone_matched(developed, table).collect()}
    assert len(found) == len(rows)
    for p, x, y, *levels in rows:
        assert found[p, x, y] == tuple(curves.get((p, c, int(v * 4095 + 0.5))) for c, v in zip("rgb", levels))
