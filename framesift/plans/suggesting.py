"""Frames put together from end to end, and what a model suggests for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import predicates
from framesift.operators import assemble, learn, ranking, stacks
from framesift.plans import adapters as A
from framesift.plans import culling, marks
from framesift.plans.registry import query
from framesift.scale import laid
from framesift.sources import measures
from framesift.sources.shared import settled

FRAMES = f"WITH {A.FRAMES_SQL}"


# -- what a frame was shot with -------------------------------------------------


@query(
    "frame_groups",
    f"""{FRAMES}, hand AS (
      SELECT dir, path, min(path) OVER (PARTITION BY dir, k) AS first, count(*) OVER (PARTITION BY dir, k) AS n
      FROM (SELECT dir, path, event_id % 4 AS k FROM named JOIN frames USING (dir, name) WHERE event_id % 7 < 3)
    ), {A.runs_sql(into="burst", name="bursts")}, both_ AS (
      SELECT b.*, CASE WHEN n > 1 THEN first END AS stack FROM bursts b LEFT JOIN hand h ON h.path = b.path
    ), grouped AS (SELECT *, coalesce(stack, burst, path) AS grp FROM both_), {culling.standing_sql('grouped', 'grp', 'measured')}
    SELECT g.path, g.stack, g.burst, g.grp AS "group", CASE WHEN g.stack IS NULL AND g.burst IS NULL THEN s.of_n * 0 + 1 ELSE s.of_n END AS of_n,
      round(CASE WHEN g.stack IS NOT NULL OR g.burst IS NOT NULL THEN s.sharp END, 9) AS sharp
    FROM grouped g LEFT JOIN stood s ON s.path = g.path""",
)
def frame_groups(spark, sf):
    """Frames weighed in the stack they were put in by hand, else in their burst, else alone."""
    event = F.regexp_extract("name", "([0-9]+)", 1).cast("bigint")
    frames = A.frames(spark, sf)
    hand = frames.where(event % 7 < 3).select("dir", (event % 4).alias("stack"), "name", event.alias("at"))
    bursts = stacks.bursts(laid(frames.select("dir", "path", "name", "captured", "signals"), ["dir"], "path"), A.GAP)
    both = stacks.stack(bursts, "manual", hand_stacks=hand)
    # A stack by hand isn't a stretch of names, so frames are laid out by group.
    grouped = laid(both.withColumn("group", stacks.group()), ["dir", "group"], "path")
    return ranking.evidence(grouped).select(
        "path", "stack", "burst", stacks.group().alias("group"), F.col("standing.of").alias("of_n"), F.round("standing.sharp", 9).alias("sharp"))


# -- what a model suggests ------------------------------------------------------

_SEEN_SQL = ", ".join(f'{sql} AS "{name}"' for name, sql in A.FEATURES_SQL.items())
_MODEL_SQL = f"""{culling._SUGGESTED_SQL}, weighed AS (SELECT *, coalesce(stack, path) AS grp FROM stacked),
{culling.standing_sql('weighed', 'grp', 'measured', 'known')}, alone AS (
  SELECT * EXCLUDE (of_n, sharp, open_share), CASE WHEN stack IS NULL THEN 1 ELSE of_n END AS of_n,
    CASE WHEN stack IS NOT NULL THEN sharp END AS sharp_share, CASE WHEN stack IS NOT NULL THEN open_share END AS open_share
  FROM known
), vectors AS (
  SELECT dir, path, kind, {_SEEN_SQL} FROM alone WHERE rating = 0 AND path NOT IN (SELECT path FROM suggested)
), lines AS (
  SELECT dir, path, kind, {", ".join(f"{marks._line_sql(w)} AS s{k}" for k, w in enumerate(marks._FIXED.weights))}, {marks._line_sql(marks._FIXED.stars)} AS stars
  FROM vectors
), raised AS (
  SELECT *, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1, exp(s2 - greatest(s0, s1, s2)) AS e2 FROM lines
), modelled AS (
  SELECT dir, path, kind, CASE WHEN e0 / (e0 + e1 + e2) >= 0.8 THEN -1 ELSE CAST(least(greatest(round(stars), 1), 5) AS INTEGER) END AS suggestion,
    CASE WHEN e0 / (e0 + e1 + e2) >= 0.8 THEN e0 ELSE e2 END / (e0 + e1 + e2) AS confidence
  FROM raised WHERE greatest(e0, e2) / (e0 + e1 + e2) >= 0.8
)"""


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames with their stacks, what stacks suggest, and what the model does besides."""
    stacked = culling._stacked(spark, sf, "rating", "signals", "kind")
    by_stack = ranking.suggestions(stacked)
    seen = ranking.evidence(stacked.withColumn("burst", F.col("stack")))
    return stacked, by_stack, learn.suggestions(seen, marks._FIXED, by_stack)


@query(
    "folded_stacks",
    f"""{culling._SUGGESTED_SQL}, both_ AS (
      SELECT s.*, s.kind <> 'png' AS matching, CASE WHEN s.rating = 0 THEN g.suggestion END AS mark
      FROM (SELECT * EXCLUDE (kind), kind FROM stacked) s LEFT JOIN suggested g ON g.path = s.path
    ), ranked AS (
      SELECT *, row_number() OVER (
        PARTITION BY dir, coalesce(stack, path), matching ORDER BY rating DESC, coalesce(mark > 0, false) DESC, path) AS best FROM both_
    ) SELECT path, mark AS suggested, mark IS NOT NULL AS is_suggested, mark IS NULL AS isnt_suggested,
      stack IS NOT NULL AND matching AND best = 1 AS representative,
      matching AND (stack IS NULL OR stack LIKE '%3.___' OR best = 1) AS visible FROM ranked""",
)
def folded_stacks(spark, sf):
    """What is on show with some stacks unfolded, those suggested standing for equals."""
    stacked = culling._stacked(spark, sf, "rating", "signals", "kind")
    seen = assemble.with_suggestions(stacked, ranking.suggestions(stacked))
    shown = stacks.shown(seen, F.col("kind") != "png", F.col("stack").like("%3.___"))
    return shown.select(
        "path", "suggested", predicates.mark_filter("suggested").alias("is_suggested"),
        predicates.flag_term("suggested", False).alias("isnt_suggested"), "representative", "visible")


@query("model_suggestions", f"{_MODEL_SQL} SELECT dir, path, suggestion, round(confidence, 7) AS confidence FROM modelled")
def model_suggestions(spark, sf):
    """The model's marks for undecided frames that stacks say nothing of."""
    *_, by_model = _both(spark, sf)
    return by_model.select(
        "dir", "path", F.col("suggestion.rating").alias("suggestion"), F.round("suggestion.confidence", 7).alias("confidence"))


@query(
    "accepted_marks",
    f"""{_MODEL_SQL}, current AS (SELECT path, dir, stack FROM stacked WHERE kind <> 'jpeg')
    SELECT dir, path, suggestion AS rating, 'model' AS "by" FROM modelled WHERE kind <> 'jpeg'
    UNION ALL SELECT g.dir, g.path, g.suggestion, 'signals' FROM suggested g
      WHERE EXISTS (SELECT 1 FROM suggested s JOIN current c ON c.path = s.path WHERE s.dir = g.dir AND s.stack = g.stack)""",
)
def accepted_marks(spark, sf):
    """The marks that taking what is suggested for some frames comes to: the
    model's for each, or those of a frame's whole stack."""
    stacked, by_stack, by_model = _both(spark, sf)
    suggested = by_stack.unionByName(by_model)
    taken = ranking.accepted(suggested, stacked.where(F.col("kind") != "jpeg").select("path"))
    return taken.join(suggested.select("path", F.col("suggestion.by").alias("by")), "path").select("dir", "path", "rating", "by")


@query(
    "model_evaluation",
    f"""WITH {marks.FINAL_SQL}, keyed AS (SELECT *, {marks._FNV_SQL} AS key FROM last), lines AS (
      SELECT rating, {", ".join(f"{marks._line_sql(w)} AS s{k}" for k, w in enumerate(marks._FIXED.weights))}
      FROM keyed WHERE key % 5 = 0
    ), raised AS (
      SELECT *, exp(s0 - greatest(s0, s1, s2)) AS e0, exp(s1 - greatest(s0, s1, s2)) AS e1, exp(s2 - greatest(s0, s1, s2)) AS e2 FROM lines
    ), guesses AS (
      SELECT rating, CASE WHEN e0 / (e0 + e1 + e2) >= 0.8 THEN 0 WHEN e2 / (e0 + e1 + e2) >= 0.8 THEN 2 END AS guess,
        CASE WHEN rating < 0 THEN 0 WHEN rating = 0 THEN 1 ELSE 2 END AS kind FROM raised
    ) SELECT count(*) AS held, count(guess) AS sure, count(*) FILTER (guess = kind) AS right FROM guesses""",
)
def model_evaluation(spark, sf):
    """On how many frames held back a model is sure, and on how many right."""
    held = learn.examples(A.decisions(spark, sf)).where(learn.held_back())
    return learn.evaluation(held, marks._FIXED)


@query(
    "training_due",
    f"""WITH {marks.FINAL_SQL}, kinds AS (SELECT CASE WHEN rating < 0 THEN 0 WHEN rating = 0 THEN 1 ELSE 2 END AS kind, count(*) AS n FROM last GROUP BY ALL)
    SELECT learned_rows, (SELECT count(*) FROM decisions) > learned_rows AS due,
      (SELECT sum(n) FROM kinds) >= 100 AND (SELECT count(*) FROM kinds WHERE n >= 10) >= 2 AS enough
    FROM (SELECT unnest([0, (SELECT count(*) - 1 FROM decisions), (SELECT count(*) FROM decisions)]) AS learned_rows)""",
)
def training_due(spark, sf):
    """Whether a model that learned from so many rows of the log is to be
    trained again, and whether there is enough to learn from."""
    log = A.decisions(spark, sf)
    rows = log.count()
    found = {r.kind: r.n for r in learn.learned(learn.examples(log)).collect()}
    enough = learn.enough([found.get(k, 0) for k in range(len(learn.KINDS))]) is None
    held = [(n, learn.due(rows, learn.Model([], [], [], [], log_rows=n)), enough) for n in (0, rows - 1, rows)]
    return spark.createDataFrame(held, "learned_rows bigint, due boolean, enough boolean")


_N = len(A.FEATURES_SQL)
_EVENED = [f'("{n}" - m{i}) / s{i}' for i, n in enumerate(A.FEATURES_SQL)] + ["1.0::DOUBLE"]


@query(
    "star_weights",
    f"""WITH RECURSIVE {marks.FINAL_SQL}, evening AS (
      SELECT {", ".join(f'avg("{n}") AS m{i}, CASE WHEN var_pop("{n}") > 1e-12 THEN sqrt(var_pop("{n}")) ELSE 1 END AS s{i}' for i, n in enumerate(A.FEATURES_SQL))} FROM last
    ), kept AS (SELECT rating, {", ".join(f"{x} AS x{i}" for i, x in enumerate(_EVENED))} FROM last CROSS JOIN evening WHERE rating > 0
    ), sums AS (
      SELECT count(*) AS n, [{", ".join("[" + ", ".join(f"sum(x{i} * x{j})" for j in range(_N + 1)) + "]" for i in range(_N + 1))}] AS a,
        [{", ".join(f"sum(x{i} * rating)" for i in range(_N + 1))}] AS b FROM kept
    ), steps (k, w) AS (
      SELECT 0, [{", ".join(["0.0::DOUBLE"] * (_N + 1))}] UNION ALL
      SELECT k + 1, list_transform(range(1, {_N + 2}), lambda i: w[i] - 0.5::DOUBLE * ((list_inner_product(a[i], w) - b[i]) / (2 * n)
        + CASE WHEN i <= {_N} THEN 0.001::DOUBLE ELSE 0 END * w[i])) FROM steps CROSS JOIN sums WHERE k < 300
    ) SELECT i::INT AS feature, round(w[i + 1], 6) AS weight FROM steps, (SELECT unnest(range({_N + 1})) AS i) WHERE k = 300""",
)
def star_weights(spark, sf):
    """What a kept frame's stars go by, learned from the log in one pass."""
    weights = learn.star_weights(learn.examples(A.decisions(spark, sf)))
    return spark.createDataFrame(list(enumerate(weights)), "feature int, weight double").withColumn("weight", F.round("weight", 6))


# -- from files to stacks, measured once ----------------------------------------


@query(
    "measured_once",
    f"""{FRAMES}, shot AS (SELECT f.*, epoch_us(n.ts) // 1000000 AS second FROM frames f JOIN named n USING (dir, name)),
    {A.runs_sql(source="(SELECT * REPLACE (second::DOUBLE AS captured) FROM shot)")}
    SELECT s.path, s.captured, s.stack, round(s.focus, 9) AS focus, s.faces AS faces, CASE WHEN measured THEN 1 ELSE 0 END AS runs_measured_in
    FROM stacked s""",
)
def measured_once(spark, sf):
    """Pictures with their capture times and measures, twice: what the first
    run measured the second finds by the files' keys, and measures nothing."""
    shots = A.table(spark, sf, "events").select(
        F.concat(F.lit("DSC"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("_stem"),
        F.date_format(A.utc("ts"), "yyyy:MM:dd HH:mm:ss").alias("captured"))
    # Files, captures and measures are all read off these; their columns are made once.
    given = settled(A.frames(spark, sf).select("dir", "path", "name", "signals"))
    listed = given.select(
        F.col("dir").alias("parent"), "path", "name", F.lit(False).alias("is_dir"), F.xxhash64("path").alias("length"),
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("modified"))
    captures = given.select("path", "name").withColumn("_stem", F.substring("name", 1, 15)).join(shots, "_stem").select("path", "captured")
    root = A.scratch(spark, "measures")
    # Read by both runs and what comes after them.
    keyed = measures.keyed(assemble.with_captures(assemble.pictures(listed), captures), 1)
    frames = settled(keyed.select("dir", "path", "key", "captured"))

    def run() -> DataFrame:
        # What can't be measured is looked at each time.
        fresh = measures.missing(frames, spark, root, 1).select("path", "key").join(
            given.where(F.col("signals").isNotNull()).select("path", "signals.*"), "path")
        return measures.merge(fresh.drop("path"), root, 1)

    first, second = run(), run()
    times = first.select("key").unionAll(second.select("key")).groupBy("key").agg(F.count("*").cast("int").alias("n"))
    found = settled(measures.attach(frames, spark, root, 1).join(times, "key", "left"))
    return stacks.by_time(laid(found, ["dir"], "path"), A.GAP).select(
        "path", "captured", "stack", F.round("signals.focus", 9).alias("focus"), F.col("signals.faces").cast("int").alias("faces"),
        F.coalesce("n", F.lit(0)).alias("runs_measured_in"))
