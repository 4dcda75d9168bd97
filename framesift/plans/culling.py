"""Searching, counting, stacking and ranking, over events as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift import scale
from framesift.functions import predicates, scalars, vision
from framesift.operators import assemble, counts, manifest, ranking, searches, stacks
from framesift.plans import adapters as A
from framesift.plans.registry import query

FRAMES = f"WITH {A.FRAMES_SQL}"
STACKED = f"{FRAMES}, {A.runs_sql()}"


def _laid(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The frames in the order of their folders and names, with what else is needed."""
    return scale.laid(A.frames(spark, sf).select("dir", "path", *columns), ["dir"], "path")


def _stacked(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return stacks.by_time(_laid(spark, sf, "captured", *columns), A.GAP)


# -- names and settings ----------------------------------------------------------


@query(
    "picture_names",
    f"""{FRAMES} SELECT path, kind, path || '.xmp' AS darktable,
      CASE WHEN kind = 'raw' THEN left(path, length(path) - 4) ELSE path END || '.xmp' AS adobe,
      left(name, length(name) - 4) AS stem FROM frames""",
)
def picture_names(spark, sf):
    return A.frames(spark, sf).select(
        "path", "kind", scalars.sidecar_path("path").alias("darktable"),
        scalars.sidecar_path("path", "adobe").alias("adobe"), scalars.stem("name").alias("stem"),
    )


@query(
    "settings_read",
    f"""WITH {A._EVENTS_SQL} SELECT event_id,
      CASE WHEN k % 9 <> 0 THEN 1 / (k % 9 * 125) END AS shutter,
      CASE k % 4 WHEN 0 THEN k / 100 WHEN 1 THEN 1 / (k + 1) WHEN 2 THEN CAST(k AS DOUBLE) END AS quantity,
      epoch_us(ts) / 1e6 AS seconds,
      CAST(greatest(least(k - 10, 5), -1) AS INTEGER) AS clamped,
      k % 3 = 0 AND k % 2 = 0 AS adobe_rgb
    FROM events_k""",
)
def settings_read(spark, sf):
    events = A.table(spark, sf, "events").withColumn("k", A._k())
    k = F.col("k")
    written = (
        F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit("%")))
        .when(k % 4 == 1, F.concat(F.lit("1/"), (k + 1).cast("string")))
        .when(k % 4 == 2, k.cast("string"))
        .otherwise("fast")
    )
    exposure = F.struct(F.lit(1).alias("n"), (k % 9 * 125).alias("d"))
    date = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    captured = scalars.capture_text(date, F.date_format("ts", "SSSSSS"))
    interop = F.when(k % 2 == 0, "R03").otherwise("R98")
    return events.select(
        "event_id",
        scalars.shutter(exposure).alias("shutter"),
        scalars.quantity(written).alias("quantity"),
        scalars.exif_seconds(captured).alias("seconds"),
        scalars.clamp_rating(k - 10).alias("clamped"),
        scalars.adobe_rgb(F.when(k % 3 == 0, 0xFFFF).otherwise(1), interop).alias("adobe_rgb"),
    )


@query(
    "focus_points",
    """WITH t AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 10 AS o,
        CASE WHEN l_suppkey % 7 <> 0 THEN l_quantity / 60 END AS u, (l_partkey % 100) / 120 AS v FROM lineitem
    ) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(CASE o WHEN 2 THEN 1 - u WHEN 3 THEN 1 - u WHEN 5 THEN v WHEN 6 THEN 1 - v WHEN 7 THEN 1 - v
        WHEN 8 THEN v ELSE u END, 9) AS x,
      round(CASE WHEN u IS NULL THEN NULL WHEN o = 3 OR o = 4 THEN 1 - v WHEN o = 5 OR o = 6 THEN u WHEN o = 7 OR o = 8 THEN 1 - u
        ELSE v END, 9) AS y,
      CASE WHEN o >= 5 THEN 480 ELSE 640 END AS w
    FROM t WHERE u IS NOT NULL OR true""".replace(
        "round(CASE o WHEN 2", "round(CASE WHEN u IS NULL THEN NULL ELSE CASE o WHEN 2"
    ).replace("WHEN 8 THEN v ELSE u END, 9) AS x", "WHEN 8 THEN v ELSE u END END, 9) AS x"),
)
def focus_points(spark, sf):
    line = A.table(spark, sf, "lineitem")
    part = F.col("l_partkey")
    focus = F.struct(
        F.when(F.col("l_suppkey") % 7 != 0, 60).otherwise(0).alias("w"), F.lit(120).alias("h"),
        F.col("l_quantity").alias("x"), (part % 100).alias("y"),
    )
    size = F.struct(F.lit(640).alias("w"), F.lit(480).alias("h"))
    at = scalars.focus_point(part % 10, focus)
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(at["x"], 9).alias("x"), F.round(at["y"], 9).alias("y"),
        scalars.upright_size(part % 10, size)["w"].alias("w"),
    )


# -- search --------------------------------------------------------------------


@query(
    "field_search",
    f"""{FRAMES} SELECT path, rating, iso FROM frames
    WHERE iso >= 3200 AND shutter < 1 / 200 AND focus > 50 AND lower(coalesce(lens, '')) LIKE '%fe 85mm%'
      AND open >= 0.3""",
)
def field_search(spark, sf):
    terms = [("iso", ">=", 3200), ("shutter", "<", "1/200"), ("sharp", ">", "50"), ("lens", None, "FE 85mm"), ("shut", None, "no")]
    return A.frames(spark, sf).where(predicates.search(terms)).select("path", "rating", F.col("exif.iso").cast("int").alias("iso"))


@query(
    "word_search",
    f"""{FRAMES} SELECT path FROM frames
    WHERE (lower(name) LIKE '%7m%' OR lower(coalesce(model, '')) LIKE '%ilce-3%' OR lower(coalesce(lens, '')) LIKE '%135mm%')
      AND lower(name) LIKE '%.jpg%' AND abs(f_number - 2.1) < 1e-4 * 2.1 AND rating >= 1""",
)
def word_search(spark, sf):
    # A word is one text, in the name, the camera or the lens.
    words = predicates.word("7m") | predicates.word("ILCE-3") | predicates.word("135mm")
    rest = predicates.search([("name", None, ".jpg"), ("f", "=", "2.1"), ("flag", None, "pick")])
    return A.frames(spark, sf).where(words & rest).select("path")


@query(
    "mark_filters",
    f"""{STACKED} SELECT dir, count(*) AS total, count(*) FILTER (rating = 0) AS undecided,
      count(*) FILTER (rating = -1) AS rejects, count(*) FILTER (rating >= 3) AS three_up,
      count(*) FILTER (open < 0.3) AS shut, count(*) FILTER (open >= 0.3) AS not_shut,
      count(*) FILTER (stack IS NOT NULL) AS stacked
    FROM stacked GROUP BY dir""",
)
def mark_filters(spark, sf):
    stacked = _stacked(spark, sf, "rating", "signals", "suggested", "name", "exif")
    kept = {
        "undecided": predicates.mark_filter("undecided"),
        "rejects": predicates.mark_filter("rejects"),
        "three_up": predicates.mark_filter("at_least", 3),
        "shut": predicates.flag_term("shut", True),
        "not_shut": predicates.flag_term("shut", False),
        "stacked": predicates.flag_term("stacked", True),
    }
    return stacked.groupBy("dir").agg(
        F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in kept.items())
    )


@query(
    "format_filter",
    f"""{FRAMES}, asked AS (SELECT *, bool_or(kind = 'png') OVER (PARTITION BY dir) AS held FROM frames)
    SELECT path, kind FROM asked WHERE kind = 'png' OR NOT held""",
)
def format_filter(spark, sf):
    return assemble.of_format(A.frames(spark, sf), "png").select("path", "kind")


_TERMS_SQL = """terms AS (
  SELECT user_id AS search_id, '/shoots/' || user_id AS dir, 'iso' AS field, '>=' AS op,
    CAST(max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)) * 50 AS VARCHAR) AS value
  FROM events GROUP BY user_id
  UNION ALL SELECT DISTINCT user_id, '/shoots/' || user_id, CASE user_id % 3 WHEN 0 THEN 'shut' WHEN 1 THEN 'camera' ELSE 'flag' END, NULL,
    CASE user_id % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'ILCE-2' ELSE 'picked' END FROM events
  UNION ALL SELECT DISTINCT user_id, '/shoots/' || user_id, CASE user_id % 10 WHEN 0 THEN 'colour' ELSE 'focus' END, '<',
    CASE user_id % 7 WHEN 0 THEN 'fast' ELSE '300' END FROM events
)"""


def _terms(spark, sf) -> DataFrame:
    events = A.table(spark, sf, "events").withColumn("k", A._k())
    user = F.col("user_id")
    dir_ = F.concat(F.lit("/shoots/"), user.cast("string")).alias("dir")
    first = events.groupBy("user_id").agg((F.max("k") * 50).cast("string").alias("value"))
    users = first.select("user_id")
    by_iso = first.select(user.alias("search_id"), dir_, F.lit("iso").alias("field"), F.lit(">=").alias("op"), "value")
    field = F.when(user % 3 == 0, "shut").when(user % 3 == 1, "camera").otherwise("flag")
    value = F.when(user % 3 == 0, "no").when(user % 3 == 1, "ILCE-2").otherwise("picked")
    by_flag = users.select(user.alias("search_id"), dir_, field.alias("field"), F.lit(None).cast("string").alias("op"), value.alias("value"))
    by_focus = users.select(
        user.alias("search_id"), dir_, F.when(user % 10 == 0, "colour").otherwise("focus").alias("field"),
        F.lit("<").alias("op"), F.when(user % 7 == 0, "fast").otherwise("300").alias("value"),
    )
    return by_iso.unionByName(by_flag).unionByName(by_focus)


@query(
    "saved_searches",
    f"""{FRAMES}, {_TERMS_SQL}, good AS (
      SELECT search_id, dir FROM terms GROUP BY ALL
      HAVING count(*) FILTER (field = 'colour' OR (field = 'focus' AND value = 'fast')) = 0
    ), least_iso AS (SELECT search_id, CAST(value AS INTEGER) AS iso FROM terms WHERE field = 'iso')
    SELECT g.search_id, f.dir, f.path FROM frames f JOIN good g ON g.dir = f.dir JOIN least_iso i ON i.search_id = g.search_id
    WHERE f.iso >= i.iso AND f.focus < 300 AND CASE g.search_id % 3 WHEN 0 THEN coalesce(open >= 0.3, false)
      WHEN 1 THEN lower(coalesce(model, '')) LIKE '%ilce-2%' ELSE rating >= 1 END""",
)
def saved_searches(spark, sf):
    with_stack = A.frames(spark, sf).withColumn("stack", F.lit(None).cast("string"))
    return searches.matches(with_stack, _terms(spark, sf))


@query(
    "bad_terms",
    f"""WITH {_TERMS_SQL} SELECT search_id, field, CASE field WHEN 'colour'
      THEN '"colour" can''t be searched, but these can: {", ".join(predicates.FIELDS)}'
      ELSE 'focus takes a number, fraction or percentage; given was "fast"' END AS problem
    FROM terms WHERE field = 'colour' OR (field = 'focus' AND value = 'fast')""",
)
def bad_terms(spark, sf):
    return searches.bad_terms(_terms(spark, sf)).select("search_id", "field", "problem")


# -- counts --------------------------------------------------------------------


@query(
    "mark_counts",
    f"""{FRAMES} SELECT dir, count(*) FILTER (rating >= 1) AS picks, count(*) FILTER (rating = -1) AS rejects,
      count(*) FILTER (rating = 0) AS undecided, count(*) FILTER (rating = 1) AS stars_1,
      count(*) FILTER (rating = 2) AS stars_2, count(*) FILTER (rating = 3) AS stars_3,
      count(*) FILTER (rating = 4) AS stars_4, count(*) FILTER (rating = 5) AS stars_5, count(*) AS total
    FROM frames GROUP BY dir""",
)
def mark_counts(spark, sf):
    return counts.counts(A.frames(spark, sf), "dir")


@query(
    "cull_summary",
    f"""{FRAMES}, c AS (
      SELECT dir, count(*) AS total, count(*) FILTER (rating >= 1) AS p, count(*) FILTER (rating = -1) AS r,
        count(*) FILTER (rating = 0) AS u, count(*) FILTER (rating = 1) AS s1, count(*) FILTER (rating = 2) AS s2,
        count(*) FILTER (rating = 3) AS s3, count(*) FILTER (rating = 4) AS s4, count(*) FILTER (rating = 5) AS s5
      FROM frames GROUP BY dir
    ), lines AS (
      SELECT dir, total, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS line,
        unnest(['picks', 'stars_5', 'stars_4', 'stars_3', 'stars_2', 'stars_1', 'rejects', 'undecided', 'total']) AS label,
        unnest([p, s5, s4, s3, s2, s1, r, u, total]) AS n FROM c
    ) SELECT dir, line, label, n, CAST(round(100.0::DOUBLE * n / greatest(total, 1)) AS BIGINT) AS percent FROM lines""",
)
def cull_summary(spark, sf):
    return counts.summary(A.frames(spark, sf), "dir")


@query(
    "kinds_held",
    f"""{FRAMES}, h AS (
      SELECT dir, count(*) FILTER (kind = 'raw') AS raw, count(*) FILTER (kind = 'jpeg') AS jpeg,
        count(*) FILTER (kind = 'png') AS png, count(*) AS total FROM frames GROUP BY dir
    ) SELECT dir, raw, jpeg, png,
      CASE WHEN (raw > 0)::INT + (jpeg > 0)::INT + (png > 0)::INT > 1 THEN 'all'
        || CASE WHEN raw > 0 THEN ',raw' ELSE '' END || CASE WHEN jpeg > 0 THEN ',jpeg' ELSE '' END
        || CASE WHEN png > 0 THEN ',png' ELSE '' END ELSE '' END AS choices,
      CASE WHEN png > 0 THEN total - png ELSE 0 END AS left_out FROM h""",
)
def kinds_held(spark, sf):
    held = counts.kinds_held(A.frames(spark, sf), "png")
    return held.withColumn("choices", F.array_join("choices", ","))


@query(
    "matching_counts",
    f"""{FRAMES} SELECT dir, count(*) FILTER (coalesce(focus > 100 AND rating = 0, false)) AS matching, count(*) AS total,
      count(*) FILTER (NOT measured) AS unmeasured FROM frames GROUP BY dir""",
)
def matching_counts(spark, sf):
    terms = [("focus", ">", 100), ("flag", None, "undecided")]
    return counts.matching(
        A.frames(spark, sf), predicates.search(terms), predicates.needs_measuring(terms), "dir"
    )


@query(
    "first_undecided",
    f"{FRAMES} SELECT dir, min(path) FILTER (rating = 0) AS first_undecided FROM frames GROUP BY dir",
)
def first_undecided(spark, sf):
    return counts.first_undecided(A.frames(spark, sf), "dir")


_LISTING_SQL = r"""listing AS (
  SELECT DISTINCT '/' || host AS path, '' AS parent, host AS name, true AS is_dir FROM hosts
  UNION ALL SELECT DISTINCT '/' || host || '/' || lang, '/' || host, lang, true FROM hosts
  UNION ALL SELECT '/' || host || '/' || CASE WHEN page_id % 3 = 0 THEN '' ELSE lang || '/' END || file,
    '/' || host || CASE WHEN page_id % 3 = 0 THEN '' ELSE '/' || lang END, file, false FROM hosts
), hosts AS (
  SELECT page_id, CASE WHEN page_id % 13 = 0 THEN '.' ELSE '' END || regexp_extract(url, '^https?://([^/]+)', 1) AS host,
    regexp_extract(url, '^https?://[^/]+/([a-z]+)', 1) AS lang,
    CASE WHEN page_id % 11 = 0 THEN '.' ELSE '' END || page_id
      || CASE page_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.ARW' WHEN 2 THEN '.png' ELSE '.xmp' END AS file FROM pages
)"""


def _listing(spark, sf) -> DataFrame:
    pages = A.table(spark, sf, "pages")
    page = F.col("page_id")
    host = F.concat(F.when(page % 13 == 0, ".").otherwise(""), F.regexp_extract("url", "^https?://([^/]+)", 1))
    suffix = F.when(page % 4 == 0, ".jpg").when(page % 4 == 1, ".ARW").when(page % 4 == 2, ".png").otherwise(".xmp")
    hosts = pages.select(
        "page_id", host.alias("host"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)", 1).alias("lang"),
        F.concat(F.when(page % 11 == 0, ".").otherwise(""), page.cast("string"), suffix).alias("file"),
    )
    slash = F.lit("/")
    top = hosts.select(F.concat(slash, "host").alias("path"), F.lit("").alias("parent"), F.col("host").alias("name"), F.lit(True).alias("is_dir"))
    sub = hosts.select(F.concat(slash, "host", slash, "lang").alias("path"), F.concat(slash, "host").alias("parent"), F.col("lang").alias("name"), F.lit(True).alias("is_dir"))
    within = F.when(page % 3 == 0, F.concat(slash, "host")).otherwise(F.concat(slash, "host", slash, "lang"))
    files = hosts.select(F.concat(within, slash, "file").alias("path"), within.alias("parent"), F.col("file").alias("name"), F.lit(False).alias("is_dir"))
    return top.distinct().unionByName(sub.distinct()).unionByName(files)


@query(
    "folder_rollup",
    f"""WITH {_LISTING_SQL}, shown AS (SELECT * FROM listing WHERE name NOT LIKE '.%')
    SELECT d.parent, d.path, d.name, count(*) FILTER (NOT s.is_dir AND s.name NOT LIKE '%.xmp') AS pictures,
      coalesce(bool_or(s.is_dir), false) AS nested
    FROM shown d LEFT JOIN shown s ON s.parent = d.path WHERE d.is_dir GROUP BY d.parent, d.path, d.name""".replace(
        f"WITH {_LISTING_SQL}",
        "WITH " + _LISTING_SQL[_LISTING_SQL.index("hosts AS (\n"):] + ", " + _LISTING_SQL[: _LISTING_SQL.index(", hosts AS (\n")],
    ),
)
def folder_rollup(spark, sf):
    return counts.folders(_listing(spark, sf))


@query(
    "shoot_profile",
    f"""WITH {A._EVENTS_SQL} SELECT '/shoots/' || user_id AS dir,
      CASE WHEN k % 3 = 0 THEN '160x120' ELSE '160x120, 1616x1080' END AS sizes, count(*) AS frames,
      count(*) FILTER (k % 7 <> 0) AS focused, count(*) FILTER (k % 2 = 0) AS adobe_rgb,
      avg(CASE WHEN k % 3 = 0 THEN 9000 ELSE 800000 + k END) AS mean_bytes FROM events_k GROUP BY ALL""",
)
def shoot_profile(spark, sf):
    k = F.col("k")

    def embedded(length, w, h):
        return F.struct(F.lit(0).cast("bigint").alias("offset"), length.cast("bigint").alias("len"), F.lit(w).alias("w"), F.lit(h).alias("h"))

    thumb, preview = embedded(F.lit(9000), 160, 120), embedded(800_000 + k, 1616, 1080)
    captures = A.table(spark, sf, "events").withColumn("k", A._k()).select(
        F.concat(F.lit("/shoots/"), F.col("user_id").cast("string")).alias("dir"),
        F.when(k % 3 == 0, F.array(thumb)).otherwise(F.array(thumb, preview)).alias("embedded"),
        F.struct(F.when(k % 7 != 0, 640).otherwise(0).alias("w"), F.lit(480).alias("h"), k.alias("x"), k.alias("y")).alias("focus"),
        F.when(k % 2 == 0, 0xFFFF).otherwise(1).alias("color_space"),
        F.lit("R03").alias("interop"),
    )
    return counts.shoot_profile(captures, "dir")


# -- stacks --------------------------------------------------------------------


@query("time_stacks", f"{STACKED} SELECT path, stack FROM stacked")
def time_stacks(spark, sf):
    return _stacked(spark, sf).select("path", "stack")


@query(
    "similar_stacks",
    f"""WITH {A.LOOKS_SQL}, before AS (
      SELECT *, lag(captured) OVER w AS c, lag(signature) OVER w AS s FROM looks WINDOW w AS (PARTITION BY dir ORDER BY path)
    ), apart AS (
      SELECT *, abs(captured - c) AS gap, list_avg(signature) - list_avg(s) AS shift FROM before
    ), far AS (
      SELECT *, list_avg(list_transform(range(1, 65), lambda i: abs(signature[i] - s[i] - shift))) AS distance FROM apart
    ), starts AS (
      SELECT *, CASE WHEN coalesce(gap <= 300 AND CASE WHEN signature IS NOT NULL AND s IS NOT NULL
        THEN distance < 35 ELSE gap <= 60 END, false) THEN 0 ELSE 1 END AS starts FROM far
    ), runs AS (SELECT *, sum(starts) OVER (PARTITION BY dir ORDER BY path) AS run FROM starts)
    SELECT path, CASE WHEN count(*) OVER (PARTITION BY dir, run) > 1 THEN min(path) OVER (PARTITION BY dir, run) END AS stack
    FROM runs""",
)
def similar_stacks(spark, sf):
    looks = scale.laid(A.looks(spark, sf).select("dir", "path", "captured", "signature"), ["dir"], "path")
    return stacks.stack(looks, "similar", gap=60, similar_gap=300, alike=35).select("path", "stack")


_HAND_SQL = """hand AS (
  SELECT '/shoots/' || user_id AS dir, event_id % 5 AS stack, event_id AS made,
    'DSC' || lpad(CAST(CASE WHEN event_id % 4 = 0 THEN event_id // 2 ELSE event_id END AS VARCHAR), 12, '0')
      || CASE WHEN event_id % 3 = 0 THEN '.JPG' ELSE '.ARW' END AS name FROM events
)"""


@query(
    "hand_stacks",
    f"""{FRAMES}, {_HAND_SQL}, last AS (
      SELECT dir, name, arg_max(stack, made) AS stack, max(made) AS made FROM hand GROUP BY ALL
    ), stems AS (SELECT dir, left(name, length(name) - 4) AS stem, min(path) AS path FROM frames GROUP BY ALL
    ), found AS (
      SELECT l.dir, coalesce(f.path, s.path) AS path, l.stack, l.made FROM last l
        LEFT JOIN frames f ON f.dir = l.dir AND f.name = l.name
        LEFT JOIN stems s ON s.dir = l.dir AND s.stem = left(l.name, length(l.name) - 4)
    ), member AS (
      SELECT dir, path, arg_max(stack, made) AS stack FROM found WHERE path IS NOT NULL GROUP BY ALL
    ), sized AS (
      SELECT path, count(*) OVER (PARTITION BY dir, stack) AS n, min(path) OVER (PARTITION BY dir, stack) AS first FROM member
    ) SELECT f.path, CASE WHEN n > 1 THEN first END AS stack FROM frames f LEFT JOIN sized s ON s.path = f.path""",
)
def hand_stacks(spark, sf):
    event = F.col("event_id")
    number = F.when(event % 4 == 0, F.floor(event / 2)).otherwise(event).cast("string")
    name = F.concat(F.lit("DSC"), F.lpad(number, 12, "0"), F.when(event % 3 == 0, ".JPG").otherwise(".ARW"))
    hand = A.table(spark, sf, "events").select(
        F.concat(F.lit("/shoots/"), F.col("user_id").cast("string")).alias("dir"),
        (event % 5).alias("stack"), name.alias("name"), event.alias("at"),
    )
    return stacks.stack(A.frames(spark, sf), "manual", hand_stacks=hand).select("path", "stack")


_SHOWN_SQL = f"""{STACKED}, marked AS (
  SELECT *, rating <> 0 AND coalesce(iso > 1000, false) AS matching FROM stacked
), shown AS (
  SELECT *, CASE WHEN matching THEN row_number() OVER (
    PARTITION BY dir, coalesce(stack, path), matching ORDER BY rating DESC, path) END AS best FROM marked
), seen AS (
  SELECT dir, path, matching, stack IS NOT NULL AND coalesce(best = 1, false) AS representative,
    matching AND (stack IS NULL OR best = 1) AS visible FROM shown
)"""


def _shown(spark, sf) -> DataFrame:
    stacked = _stacked(spark, sf, "rating", "exif", "suggested")
    let_through = (F.col("rating") != 0) & predicates.number_term("iso", ">", 1000)
    return stacks.shown(stacked, let_through)


@query("visible_frames", f"{_SHOWN_SQL} SELECT path, matching, representative, visible FROM seen")
def visible_frames(spark, sf):
    return _shown(spark, sf).select("path", "matching", "representative", "visible")


@query(
    "neighbours",
    f"""{_SHOWN_SQL}, near AS (SELECT *,
      min(CASE WHEN visible THEN path END) OVER (PARTITION BY dir ORDER BY path ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next,
      max(CASE WHEN visible THEN path END) OVER (PARTITION BY dir ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
      FROM seen)
    SELECT path, previous, next, CASE WHEN matching THEN path ELSE coalesce(next, previous, path) END AS settled FROM near""",
)
def neighbours(spark, sf):
    return stacks.neighbours(_shown(spark, sf)).select("path", "previous", "next", "settled")


# -- ranking -------------------------------------------------------------------


def standing_sql(source: str, group: str, condition: str, name: str = "stood") -> str:
    return f"""{name}_flags AS (
  SELECT *, count(*) OVER g AS of_n, bool_and(eyes IS NOT NULL) OVER g AS all_eyes,
    bool_and(focus IS NOT NULL) OVER g AS all_focus, max(open) OVER g AS most_open
  FROM {source} WHERE {condition} WINDOW g AS (PARTITION BY dir, {group})
), {name}_values AS (
  SELECT *, CASE WHEN all_eyes THEN eyes WHEN all_focus THEN focus ELSE coalesce(eyes, focus) END AS v FROM {name}_flags
), {name} AS (
  SELECT *, CASE WHEN v IS NULL THEN NULL WHEN max(v) OVER g > 0 THEN v / max(v) OVER g ELSE 1 END AS sharp,
    CASE WHEN open IS NULL THEN NULL WHEN most_open > 0 THEN open / most_open ELSE 1 END AS open_share
  FROM {name}_values WINDOW g AS (PARTITION BY dir, {group})
)"""


def winner_sql(source: str, group: str, name: str = "won") -> str:
    return f"""{name}_scored AS (
  SELECT *, coalesce(sharp, 1) * (0.4::DOUBLE + 0.6::DOUBLE * coalesce(open_share, 1)) - highlights AS score FROM {source}
), {name}_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dir, {group} ORDER BY score DESC, path) AS place FROM {name}_scored
), {name} AS (
  SELECT *, min(CASE WHEN place = 1 THEN path END) OVER g AS winner,
    coalesce(greatest(least(max(CASE WHEN place = 1 THEN score END) OVER g - max(CASE WHEN place = 2 THEN score END) OVER g, 1), 0), 1) AS margin
  FROM {name}_ranked WINDOW g AS (PARTITION BY dir, {group})
)"""


_GROUPED_SQL = f"""{STACKED}, grouped AS (SELECT *, coalesce(stack, path) AS grp FROM stacked)"""


@query(
    "standings",
    f"""{_GROUPED_SQL}, {standing_sql('grouped', 'grp', 'measured')}
    SELECT path, CASE WHEN stack IS NULL THEN 1 ELSE of_n END AS of_n,
      round(CASE WHEN stack IS NOT NULL THEN sharp END, 9) AS sharp,
      round(CASE WHEN stack IS NOT NULL THEN open_share END, 9) AS open_share,
      coalesce(CASE WHEN stack IS NOT NULL THEN sharp END < 0.8, false) AS soft,
      concat_ws(',', CASE WHEN of_n > 1 AND stack IS NOT NULL AND sharp < 0.8 THEN 'soft' END,
        CASE WHEN of_n > 1 AND stack IS NOT NULL AND sharp >= 0.995 THEN 'sharpest' END,
        CASE WHEN open < 0.3 THEN 'shut' END, CASE WHEN highlights >= 0.03 THEN 'blown' END,
        CASE WHEN shadows >= 0.1 THEN 'black' END) AS flags FROM stood""",
)
def standings(spark, sf):
    stacked = _stacked(spark, sf, "signals").withColumn("burst", F.col("stack"))
    seen = ranking.evidence(stacked).where(F.col("standing").isNotNull())
    return seen.select(
        "path", F.col("standing.of").alias("of_n"), F.round("standing.sharp", 9).alias("sharp"),
        F.round("standing.open", 9).alias("open_share"), ranking.soft().alias("soft"),
        F.array_join(vision.quality_flags("signals", "standing"), ",").alias("flags"),
    )


def burst_winners(spark: SparkSession, sf: str) -> DataFrame:
    stacked = _stacked(spark, sf, "signals")
    won = ranking.winners(stacked.where(F.col("stack").isNotNull()), "stack")
    return won.where(F.col("winner").isNotNull()).select(
        "dir", "stack", "path", F.round("score", 9).alias("score"), "winner", F.round("margin", 9).alias("margin")
    )


@query(
    "burst_winners",
    f"""{STACKED}, {standing_sql('stacked', 'stack', 'measured AND stack IS NOT NULL')}, {winner_sql('stood', 'stack')},
    results AS (SELECT DISTINCT dir, stack, winner, margin FROM won)
    SELECT s.dir, s.stack, s.path, round(w.score, 9) AS score, r.winner, round(r.margin, 9) AS margin FROM stacked s
      JOIN results r ON r.dir = s.dir AND r.stack = s.stack LEFT JOIN won w ON w.path = s.path""",
)
def _burst_winners(spark, sf):
    return burst_winners(spark, sf)


@query(
    "order_winners",
    f"""WITH {A.ORDER_FRAMES_SQL}, measured AS (SELECT *, NULL::DOUBLE AS eyes, NULL::DOUBLE AS open, dir AS grp FROM frames),
    {standing_sql('measured', 'grp', 'true')}, {winner_sql('stood', 'grp')}
    SELECT dir, path, round(score, 9) AS score, winner, round(margin, 9) AS margin FROM won""",
)
def order_winners(spark, sf):
    frames = scale.laid(A.order_frames(spark, sf), ["dir", "group"], "path")
    won = ranking.winners(frames, "group")
    return won.select("dir", "path", F.round("score", 9).alias("score"), "winner", F.round("margin", 9).alias("margin"))


_SUGGESTED_SQL = f"""{STACKED}, ready AS (
  SELECT *, count(*) FILTER (rating > 0) OVER g AS kept, count(*) FILTER (rating = 0) OVER g AS undecided,
    count(*) FILTER (rating = 0 AND measured) OVER g AS looked
  FROM stacked WHERE stack IS NOT NULL WINDOW g AS (PARTITION BY dir, stack)
), {standing_sql('ready', 'stack', 'rating = 0 AND kept = 0 AND undecided >= 2 AND looked = undecided')},
{winner_sql('stood', 'stack')}, suggested AS (
  SELECT dir, stack, path, CASE WHEN path = winner THEN 1 ELSE -1 END AS suggestion, margin FROM won
)"""


def _suggested(spark, sf) -> tuple[DataFrame, DataFrame]:
    stacked = _stacked(spark, sf, "rating", "signals")
    return stacked, ranking.suggestions(stacked)


@query("stack_suggestions", f"{_SUGGESTED_SQL} SELECT stack, path, suggestion, round(margin, 9) AS margin FROM suggested")
def stack_suggestions(spark, sf):
    _, suggested = _suggested(spark, sf)
    return suggested.select(
        "stack", "path", F.col("suggestion.rating").alias("suggestion"), F.round("suggestion.confidence", 9).alias("margin")
    )


@query(
    "suggested_frames",
    f"""{_SUGGESTED_SQL} SELECT s.path, s.rating, g.suggestion AS suggested FROM stacked s
    LEFT JOIN suggested g ON g.path = s.path WHERE s.rating = 0""",
)
def suggested_frames(spark, sf):
    stacked, suggested = _suggested(spark, sf)
    return (
        assemble.with_suggestions(stacked, suggested)
        .where(predicates.mark_filter("undecided"))
        .select("path", "rating", "suggested")
    )


@query(
    "accepted_suggestions",
    f"""{_SUGGESTED_SQL}, chosen AS (SELECT DISTINCT dir, stack FROM suggested WHERE suggestion = 1)
    SELECT g.dir, g.path, g.suggestion AS rating FROM suggested g SEMI JOIN chosen c ON c.dir = g.dir AND c.stack = g.stack""",
)
def accepted_suggestions(spark, sf):
    _, suggested = _suggested(spark, sf)
    current = suggested.where(F.col("suggestion.rating") > 0).select("path")
    return ranking.accepted(suggested, current)


@query(
    "chosen_winners",
    f"""{STACKED}, chosen AS (
      SELECT path, dir, stack FROM stacked WHERE stack IS NOT NULL AND kind = 'png'
    ), marks AS (
      SELECT s.dir, s.path, s.rating AS was, CASE WHEN c.path IS NULL THEN -1 WHEN s.rating > 0 THEN s.rating ELSE 1 END AS now
      FROM stacked s LEFT JOIN chosen c ON c.path = s.path
      WHERE EXISTS (SELECT 1 FROM chosen d WHERE d.dir = s.dir AND d.stack = s.stack)
    ) SELECT dir, path, was, now FROM marks WHERE was <> now""",
)
def chosen_winners(spark, sf):
    stacked = _stacked(spark, sf, "rating", "kind")
    choices = stacked.where(F.col("kind") == "png").select("path")
    return ranking.chosen_winners(stacked, choices)


# -- lists to act on -----------------------------------------------------------


@query(
    "hand_off",
    f"{FRAMES} SELECT dir, path FROM frames WHERE rating >= 3 AND coalesce(lower(model), '') LIKE '%ilce%'",
)
def hand_off(spark, sf):
    shown = predicates.mark_filter("at_least", 3) & predicates.text_term("camera", "ilce")
    return searches.hand_off(A.frames(spark, sf), shown)


_FILES_SQL = """files AS (
  SELECT path FROM frames
  UNION SELECT path || '.xmp' FROM frames WHERE rating <> 0
  UNION SELECT left(path, length(path) - 4) || '.xmp' FROM frames WHERE rating = -1 AND kind = 'raw'
  UNION SELECT '/selects/' || name FROM frames WHERE rating = 5
  UNION SELECT '/selects/' || name || '.xmp' FROM frames WHERE rating = 3 AND kind = 'png'
)"""


def _files(spark, sf) -> DataFrame:
    frames = A.frames(spark, sf)
    rating, xmp = F.col("rating"), F.lit(".xmp")
    there = F.concat(F.lit("/selects/"), "name")
    return (
        frames.select("path")
        .unionByName(frames.where(rating != 0).select(F.concat("path", xmp).alias("path")))
        .unionByName(frames.where((rating == -1) & (F.col("kind") == "raw")).select(scalars.sidecar_path("path", "adobe").alias("path")))
        .unionByName(frames.where(rating == 5).select(there.alias("path")))
        .unionByName(frames.where((rating == 3) & (F.col("kind") == "png")).select(F.concat(there, xmp).alias("path")))
        .distinct()
    )


@query(
    "copy_manifest",
    f"""{FRAMES}, {_FILES_SQL}, shown AS (SELECT path, '/selects/' || name AS copy, kind FROM frames WHERE rating >= 1)
    SELECT s.path, s.copy, CASE WHEN f.path IS NULL THEN 'copy' ELSE 'there' END AS status,
      CASE WHEN f.path IS NULL AND b.path IS NOT NULL AND w.path IS NULL THEN b.path END AS sidecar,
      CASE WHEN f.path IS NULL AND b.path IS NOT NULL AND w.path IS NULL THEN s.copy || '.xmp' END AS sidecar_copy
    FROM shown s LEFT JOIN files f ON f.path = s.copy LEFT JOIN files b ON b.path = s.path || '.xmp'
      LEFT JOIN files w ON w.path = s.copy || '.xmp'""",
)
def copy_manifest(spark, sf):
    shown = A.frames(spark, sf).where(predicates.mark_filter("at_least", 1)).select("path", F.lit("/selects").alias("to"))
    return manifest.copies(shown, _files(spark, sf)).drop("to")


@query(
    "document_copies",
    """SELECT 'doc/' || d.doc_id AS path, 'out/' || d.doc_id AS copy,
      CASE WHEN l.doc_id IS NULL THEN 'copy' ELSE 'there' END AS status
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def document_copies(spark, sf):
    documents = A.table(spark, sf, "documents")
    shown = documents.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.lit("out").alias("to"))
    files = A.table(spark, sf, "labels").select(F.concat(F.lit("out/"), F.col("doc_id").cast("string")).alias("path"))
    return manifest.copies(shown, files).select("path", "copy", "status")


@query(
    "copy_tallies",
    f"""{FRAMES}, results AS (
      SELECT dir AS "to", path, CASE WHEN rating = 5 THEN 'there' WHEN kind = 'png' THEN 'failed' ELSE 'copy' END AS status
      FROM frames WHERE rating >= 1)
    SELECT "to", count(*) FILTER (status = 'copy') AS copied, count(*) FILTER (status = 'there') AS there,
      count(*) FILTER (status = 'failed') AS failed
    FROM results GROUP BY "to" """,
)
def copy_tallies(spark, sf):
    return manifest.tallies(_copied(spark, sf))


@query(
    "copy_failures",
    f"""{FRAMES} SELECT dir AS "to", path, path || ': full' AS problem FROM frames WHERE rating BETWEEN 1 AND 4 AND kind = 'png'""",
)
def copy_failures(spark, sf):
    return manifest.failures(_copied(spark, sf))


def _copied(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("rating") == 5, "there").when(F.col("kind") == "png", "failed").otherwise("copy")
    return A.frames(spark, sf).where(F.col("rating") >= 1).select(
        F.col("dir").alias("to"), "path", status.alias("status"), F.concat("path", F.lit(": full")).alias("problem")
    )


@query(
    "delete_manifest",
    f"""{FRAMES}, {_FILES_SQL}, rejects AS (SELECT path, kind FROM frames WHERE rating = -1)
    SELECT path AS picture, path, 'picture' AS what FROM rejects
    UNION ALL SELECT r.path, f.path, 'sidecar' FROM rejects r JOIN files f ON f.path = r.path || '.xmp'
    UNION ALL SELECT r.path, f.path, 'sidecar' FROM rejects r JOIN files f
      ON f.path = left(r.path, length(r.path) - 4) || '.xmp' WHERE r.kind = 'raw'""",
)
def delete_manifest(spark, sf):
    return manifest.deletions(A.frames(spark, sf), _files(spark, sf))
