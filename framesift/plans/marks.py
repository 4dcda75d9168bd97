"""The decision log, the sidecars it goes to, and what is learned from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import features, scalars, xmp
from framesift.operators import assemble, journal, learn
from framesift.plans import adapters as A
from framesift.plans.registry import query
from framesift.sources import journal as log_files
from framesift.sources import measures, models

LOG = f"WITH {A.DECISIONS_SQL}"

_FEATURES = ", ".join(f"round({sql}, 9) AS {name}" for name, sql in A.FEATURES_SQL.items())
_SEEN = ", ".join(f'{sql} AS "f_{name}"' for name, sql in A.FEATURES_SQL.items())
FINAL_SQL = f"""{A.DECISIONS_SQL}, seen AS (
  SELECT *, {_SEEN} FROM decisions
), last AS (
  SELECT path, coalesce(captured, '') AS captured, arg_max(rating, seq) AS rating,
    {", ".join(f'arg_max(f_{n}, seq) FILTER (measured) AS "{n}"' for n in A.FEATURES_SQL)}
  FROM seen GROUP BY ALL HAVING count(*) FILTER (measured) > 0
)"""
_ROUNDED = ", ".join(f'round("{n}", 9) AS "{n}"' for n in A.FEATURES_SQL)


def _unpacked(vector: str = "features") -> list[Column]:
    return [F.round(F.get(vector, F.lit(i)), 9).alias(name) for i, name in enumerate(features.NAMES)]


# -- reductions ----------------------------------------------------------------


@query("final_states", f"WITH {FINAL_SQL} SELECT path, captured, rating, {_ROUNDED} FROM last")
def final_states(spark, sf):
    return journal.final_states(A.decisions(spark, sf)).select("path", "captured", "rating", *_unpacked())


@query(
    "last_marks",
    f"{LOG} SELECT path, arg_max(rating, seq) AS rating, max(seq) AS seq FROM decisions GROUP BY path",
)
def last_marks(spark, sf):
    return journal.last_marks(A.decisions(spark, sf))


@query(
    "loggable_marks",
    f"""{LOG}, failed AS (SELECT DISTINCT path FROM decisions WHERE dwell_ms % 10 = 0)
    SELECT seq, path, rating, was, how FROM decisions d WHERE (was <> rating OR how = 'pass')
      AND (how = 'pass' OR NOT EXISTS (SELECT 1 FROM failed f WHERE f.path = d.path))""",
)
def loggable_marks(spark, sf):
    marks = A.decisions(spark, sf)
    failed = marks.where(F.col("dwell_ms") % 10 == 0).select("file.path")
    return journal.loggable(marks, failed).select("seq", F.col("file.path").alias("path"), "rating", "was", "how")


@query(
    "log_round_trip",
    f"""{LOG} SELECT path, arg_max(rating, (made, seq)) AS rating, count(*) AS rows_read,
      count(*) FILTER (measured) AS measured FROM decisions WHERE was <> rating OR how = 'pass' GROUP BY path""",
)
def log_round_trip(spark, sf):
    folder = A.scratch(spark, "log")
    log_files.append(A.decisions(spark, sf), folder, order="seq")
    log = log_files.read(spark, folder)
    return log.groupBy(F.col("file.path").alias("path")).agg(
        F.max_by("rating", "seq").alias("rating"), F.count(F.lit(1)).alias("rows_read"),
        F.count_if(F.col("signals").isNotNull()).alias("measured"),
    )


@query(
    "compared_pairs",
    f"""{LOG}, pairs AS (
      SELECT path, dir || '/DSC' || lpad(CAST(unnest(compared) AS VARCHAR), 5, '0') || '.ARW' AS other, rating FROM decisions
    ), ended AS (SELECT path, arg_max(rating, seq) AS rating FROM decisions GROUP BY path)
    SELECT p.path, p.other, count(*) FILTER (p.rating > coalesce(e.rating, 0)) AS wins,
      count(*) FILTER (p.rating < coalesce(e.rating, 0)) AS losses, count(*) FILTER (p.rating = coalesce(e.rating, 0)) AS ties
    FROM pairs p LEFT JOIN ended e ON e.path = p.other GROUP BY p.path, p.other""",
)
def compared_pairs(spark, sf):
    return journal.compared_pairs(A.decisions(spark, sf))


@query(
    "suggestion_outcomes",
    f"""{LOG} SELECT "by", count(*) AS answered, count(*) FILTER (rating = suggested) AS taken,
      count(*) FILTER (rating <> suggested) AS overridden
    FROM decisions WHERE has_suggestion AND how IN ('mark', 'pass') GROUP BY ALL""",
)
def suggestion_outcomes(spark, sf):
    return journal.outcomes(A.decisions(spark, sf))


@query(
    "passed_frames",
    f"""{LOG}, marked AS (SELECT * FROM decisions WHERE how <> 'pass'),
    ends AS (SELECT session, dir, max(seq) AS seq FROM marked GROUP BY ALL),
    last AS (SELECT e.session, m.path, arg_max(m.rating, m.seq) AS rating FROM ends e JOIN marked m ON m.dir = e.dir AND m.seq <= e.seq GROUP BY ALL)
    SELECT DISTINCT d.session, d.dir, d.path FROM decisions d SEMI JOIN marked m ON m.session = d.session AND m.dir = d.dir
      LEFT JOIN last l ON l.session = d.session AND l.path = d.path WHERE coalesce(l.rating, 0) = 0""",
)
def passed_frames(spark, sf):
    return journal.passed(A.views(spark, sf), A.decisions(spark, sf))


@query(
    "dwell_times",
    f"""{LOG}, both_ AS (
      SELECT session, path, made, 0 AS is_mark FROM decisions UNION ALL
      SELECT session, path, made + 1500, 1 FROM decisions WHERE how = 'mark'
    ), before AS (SELECT *, lag(path) OVER w AS was FROM both_ WINDOW w AS (PARTITION BY session ORDER BY made, is_mark, path)),
    since AS (SELECT *, max(CASE WHEN was IS NULL OR was <> path THEN made END)
      OVER (PARTITION BY session ORDER BY made, is_mark, path) AS arrived FROM before)
    SELECT session, path, made AS "at", made - arrived AS dwell_ms FROM since WHERE is_mark = 1""",
)
def dwell_times(spark, sf):
    views = A.views(spark, sf)
    marks = A.decisions(spark, sf).where(F.col("how") == "mark").select(
        "session", F.col("file.path").alias("path"), (F.col("at") + 1500).alias("at")
    )
    return journal.dwell(views, marks)


@query(
    "dwell_rollup",
    f"""{LOG} SELECT view, rating, count(*) AS marks, CAST(sum(dwell_ms) AS BIGINT) AS total_ms, round(avg(dwell_ms), 6) AS mean_ms
    FROM decisions WHERE how <> 'pass' GROUP BY ALL""",
)
def dwell_rollup(spark, sf):
    rolled = journal.dwell_rollup(A.decisions(spark, sf))
    return rolled.withColumn("mean_ms", F.round("mean_ms", 6))


@query(
    "moved_files",
    f"""{LOG}, here AS (
      SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN path ELSE '/moved/' || (user_id % 5) || right(path, 13) END AS path,
        right(path, 12) AS name, size, captured FROM decisions WHERE user_id % 2 = 0 OR size % 3000 <> 500
    ), gone AS (SELECT name, size, captured, min(path) AS path FROM here GROUP BY ALL)
    SELECT d.seq, d.path, coalesce(h.path, g.path) AS now_path FROM decisions d LEFT JOIN here h ON h.path = d.path
      LEFT JOIN gone g ON g.name = right(d.path, 12) AND g.size = d.size AND g.captured IS NOT DISTINCT FROM d.captured""",
)
def moved_files(spark, sf):
    log = A.decisions(spark, sf)
    user = scalars.base_name(scalars.parent("file.path")).cast("int")
    moved = F.concat(F.lit("/moved/"), (user % 5).cast("string"), F.lit("/"), scalars.base_name("file.path"))
    files = (
        log.where((user % 2 == 0) | (F.col("file.size") % 3000 != 500))
        .select(F.when(user % 2 == 0, F.col("file.path")).otherwise(moved).alias("path"), "file.size", "file.captured")
        .distinct()
    )
    return assemble.reidentified(log, files).select("seq", F.col("file.path").alias("path"), "now_path")


# -- sidecars ------------------------------------------------------------------

_HEAD = '<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'
_TAIL = "</rdf:RDF></x:xmpmeta>"
_NS = "http://ns.adobe.com/xap/1.0/"


def _sidecar_text(k: Column, rating: Column) -> Column:
    r = rating.cast("string")
    forms = [
        F.concat(F.lit(f'{_HEAD}<rdf:Description rdf:about="" xmlns:xmp="{_NS}" xmp:Rating="'), r, F.lit(f'" a="b"/>{_TAIL}')),
        F.concat(F.lit(f'{_HEAD}<rdf:Description rdf:about="" xmlns:xap="{_NS}"><xap:Rating> '), r, F.lit(f" </xap:Rating></rdf:Description>{_TAIL}")),
        F.lit(f'{_HEAD}<rdf:Description rdf:about=""/>{_TAIL}'),
        F.lit("not xml at all"),
        F.concat(F.lit(f'{_HEAD}<!-- <rdf:Description xmp:Rating="4"/> --><rdf:Description xmlns:xmp="{_NS}" xmp:Rating="'), r, F.lit(f'x"/>{_TAIL}')),
    ]
    text = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        text = F.when(k % 6 == i, form).otherwise(text)
    return text


def _sidecars(spark: SparkSession, sf: str) -> DataFrame:
    """One for five pictures in six, in five spellings."""
    k = F.col("event_id") % 6
    events = A.table(spark, sf, "events").withColumn("_rating", A._rating())
    path = F.concat(F.lit("/p/"), F.col("event_id").cast("string"), F.lit(".NEF"))
    return events.select(
        F.concat(path, F.lit(".xmp")).alias("sidecar_path"), _sidecar_text(k, F.col("_rating")).alias("xmp")
    ).where(F.col("xmp").isNotNull())


def _pictures(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("/p/"), F.col("event_id").cast("string"), F.lit(".NEF"))
    return A.table(spark, sf, "events").select(
        F.lit("/p").alias("dir"), path.alias("path"), F.col("event_id").alias("n"), A._rating().alias("_marked")
    )


@query(
    "sidecar_ratings",
    f"""{LOG} SELECT '/p/' || seq || '.NEF' AS path, CASE WHEN seq % 6 < 2 THEN rating ELSE 0 END AS rating,
      CASE seq % 6 WHEN 3 THEN 'the text isn''t well-formed XML' WHEN 4 THEN 'the rating is no whole number' END AS problem
    FROM decisions""",
)
def sidecar_ratings(spark, sf):
    frames = _pictures(spark, sf).select("dir", "path")
    return assemble.with_ratings(frames, _sidecars(spark, sf)).select("path", "rating", "problem")


@query(
    "sidecar_writes",
    f"""{LOG}, marks AS (SELECT seq, rating AS held, CAST(seq % 7 - 1 AS VARCHAR) AS r FROM decisions)
    SELECT '/p/' || seq || '.NEF' AS path, CASE seq % 6
      WHEN 0 THEN '{_HEAD}<rdf:Description rdf:about="" xmlns:xmp="{_NS}" xmp:Rating="' || r || '" a="b"/>{_TAIL}'
      WHEN 1 THEN '{_HEAD}<rdf:Description rdf:about="" xmlns:xap="{_NS}"><xap:Rating>' || r || '</xap:Rating></rdf:Description>{_TAIL}'
      WHEN 2 THEN '{_HEAD}<rdf:Description xmlns:xmp="{_NS}" xmp:Rating="' || r || '" rdf:about=""/>{_TAIL}'
      WHEN 4 THEN '{_HEAD}<!-- <rdf:Description xmp:Rating="4"/> --><rdf:Description xmlns:xmp="{_NS}" xmp:Rating="' || r || '"/>{_TAIL}'
      WHEN 5 THEN '<?xml version="1.0" encoding="UTF-8"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="framesift">\n <rdf:RDF xmlns:rdf="{xmp.RDF_NAMESPACE}">\n'
        || '  <rdf:Description rdf:about="" xmlns:xmp="{_NS}" xmp:Rating="' || r || '"/>\n </rdf:RDF>\n</x:xmpmeta>\n' END AS xmp,
      CASE WHEN seq % 6 = 3 THEN 'the text isn''t well-formed XML' END AS problem
    FROM marks WHERE CASE seq % 6 WHEN 0 THEN held <> seq % 7 - 1 WHEN 1 THEN true WHEN 5 THEN seq % 7 <> 1 ELSE true END""",
)
def sidecar_writes(spark, sf):
    marks = _pictures(spark, sf).select("path", (F.col("n") % 7 - 1).cast("int").alias("rating"))
    # A value with blanks round it never is the same text again.
    return assemble.write_back(marks, _sidecars(spark, sf)).select("path", "xmp", "problem")


@query(
    "restored_marks",
    f"""{LOG} SELECT '/p/' || seq || '.NEF' AS path, CASE WHEN seq % 6 = 3 THEN 0 ELSE rating END AS rating FROM decisions""",
)
def restored_marks(spark, sf):
    frames = _pictures(spark, sf).select("path", F.col("_marked").alias("rating"))
    sidecars = _sidecars(spark, sf)
    failed = assemble.failures(assemble.write_back(frames, sidecars), sidecars)
    return assemble.restored(frames, failed)


@query(
    "measure_cache",
    f"""WITH {A.FRAMES_SQL} SELECT path, round(focus, 9) AS focus, faces FROM frames WHERE measured""",
)
def measure_cache(spark, sf):
    folder = A.scratch(spark, "signals")
    measured = A.frames(spark, sf).where(F.col("signals").isNotNull()).select("path", "signals.*")
    measures.store(measured.limit(0), folder, 0)
    measures.store(measured, folder, 1)
    return measures.load(spark, folder, 1).select("path", F.round("focus", 9).alias("focus"), F.col("faces").cast("int").alias("faces"))


# -- learning ------------------------------------------------------------------

_FNV_SQL = """list_reduce(list_transform(range(1, length(path || '|' || captured) + 1),
    lambda i: CAST(ascii(substr(path || '|' || captured, CAST(i AS BIGINT), 1)) AS HUGEINT)),
    lambda h, b: xor(h, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT)"""


@query(
    "training_set",
    f"""WITH {FINAL_SQL}, keyed AS (SELECT path, captured, rating, {_FNV_SQL} AS key FROM last)
    SELECT path, captured, rating, lpad(lower(hex(key)), 16, '0') AS key, key % 5 = 0 AS held,
      CASE WHEN rating < 0 THEN 0 WHEN rating = 0 THEN 1 ELSE 2 END AS kind FROM keyed""",
)
def training_set(spark, sf):
    rows = learn.examples(A.decisions(spark, sf))
    return rows.select(
        "path", "captured", "rating", scalars.fnv_hex("key").alias("key"), learn.held_back().alias("held"), "kind"
    )


@query(
    "learned_kinds",
    f"""WITH {FINAL_SQL} SELECT CASE WHEN rating < 0 THEN 0 WHEN rating = 0 THEN 1 ELSE 2 END AS kind, count(*) AS n
    FROM last GROUP BY ALL""",
)
def learned_kinds(spark, sf):
    return learn.learned(learn.examples(A.decisions(spark, sf)))


@query(
    "feature_spreads",
    "WITH "
    + FINAL_SQL
    + ", flat AS ("
    + " UNION ALL ".join(f'SELECT {i} AS feature, CAST("{n}" AS DOUBLE) AS v FROM last' for i, n in enumerate(A.FEATURES_SQL))
    + """) SELECT feature, round(avg(v), 8) AS middle, round(CASE WHEN var_pop(v) > 1e-12 THEN sqrt(var_pop(v)) ELSE 1 END, 8) AS spread
    FROM flat GROUP BY feature""",
)
def feature_spreads(spark, sf):
    spreads = learn.spreads(learn.examples(A.decisions(spark, sf)))
    return spreads.select("feature", F.round("middle", 8).alias("middle"), F.round("spread", 8).alias("spread"))


# Made by rule, to check scoring by: what a model holds, whatever it learned.
_WIDTH = len(features.NAMES)
_FIXED = learn.Model(
    middle=[i / 20 for i in range(_WIDTH)],
    spread=[0.5 + i / 10 for i in range(_WIDTH)],
    weights=[[(k * 5 + i * 3) % 7 - 3.0 for i in range(_WIDTH + 1)] for k in range(3)],
    stars=[(i * 2) % 5 / 4 for i in range(_WIDTH)] + [2.5],
)


def _line_sql(weights: list[float]) -> str:
    terms = [
        f'{w!r}::DOUBLE * ("{n}" - {m!r}::DOUBLE) / {s!r}::DOUBLE'
        for n, w, m, s in zip(features.NAMES, weights, _FIXED.middle, _FIXED.spread)
    ]
    return " + ".join([f"{weights[-1]!r}::DOUBLE", *terms])


@query(
    "model_marks",
    f"""WITH {FINAL_SQL}, scores AS (
      SELECT path, captured, {", ".join(f"{_line_sql(w)} AS s{k}" for k, w in enumerate(_FIXED.weights))}, {_line_sql(_FIXED.stars)} AS stars
      FROM last
    ), chances AS (
      SELECT *, exp(s0 - greatest(s0, s1, s2)) / (exp(s0 - greatest(s0, s1, s2)) + exp(s1 - greatest(s0, s1, s2)) + exp(s2 - greatest(s0, s1, s2))) AS reject,
        exp(s2 - greatest(s0, s1, s2)) / (exp(s0 - greatest(s0, s1, s2)) + exp(s1 - greatest(s0, s1, s2)) + exp(s2 - greatest(s0, s1, s2))) AS keep FROM scores
    ) SELECT path, captured, CASE WHEN reject >= 0.8 THEN -1 ELSE CAST(least(greatest(round(stars), 1), 5) AS INTEGER) END AS suggestion,
      round(CASE WHEN reject >= 0.8 THEN reject ELSE keep END, 7) AS confidence
    FROM chances WHERE reject >= 0.8 OR keep >= 0.8""",
)
def model_marks(spark, sf):
    rows = learn.examples(A.decisions(spark, sf)).withColumn("suggestion", learn.suggest(_FIXED))
    return rows.where(F.col("suggestion").isNotNull()).select(
        "path", "captured", F.col("suggestion.rating").alias("suggestion"),
        F.round("suggestion.confidence", 7).alias("confidence"),
    )


def _document_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as frames: toxic ones rejected, good ones kept."""
    rows = A.table(spark, sf, "labels").join(A.table(spark, sf, "documents"), "doc_id")
    n = F.col("n_chars")
    signals = F.struct(
        (n % 200).cast("double").alias("focus"),
        F.when(F.col("lang") == "en", (n % 97).cast("double")).alias("eyes"),
        (n % 11 / 10).alias("open"), (n % 7 / 20).alias("highlights"), (n % 5 / 20).alias("shadows"),
        (n % 4).cast("bigint").alias("faces"), (n % 3 / 10).alias("face"),
    )
    standing = F.struct((1 + n % 5).cast("bigint").alias("of"), (n % 13 / 12).alias("sharp"), (n % 17 / 16).alias("open"))
    rating = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1 + n % 5).otherwise(0).cast("int")
    return rows.select(
        features.vector(signals, standing).alias("features"), rating.alias("rating"),
        scalars.decision_kind(rating).alias("kind"),
        scalars.fnv(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit("|"))).alias("key"),
    )


@query(
    "learned_model",
    """WITH t AS (SELECT CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS kind FROM labels JOIN documents USING (doc_id))
    SELECT count(*) FILTER (kind = 0) AS rejected, count(*) FILTER (kind = 1) AS left_, count(*) FILTER (kind = 2) AS kept,
      15 AS weights_each, true AS kept_and_read FROM t""",
)
def learned_model(spark, sf):
    """Trained, kept and read back: only what can be said in SQL of it."""
    model = learn.train(_document_examples(spark, sf), method="solver")
    folder = A.scratch(spark, "model")
    models.save(spark, model, folder)
    kept = models.load(spark, folder)
    row = kept.frame(spark)
    learned = F.col("learned")
    return row.select(
        F.get(learned, F.lit(0)).alias("rejected"), F.get(learned, F.lit(1)).alias("left_"), F.get(learned, F.lit(2)).alias("kept"),
        F.size(F.get("weights", F.lit(0))).alias("weights_each"), F.lit(kept == model).alias("kept_and_read"),
    )
