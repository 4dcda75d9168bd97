"""The benchmark tables seen as frames, logs, pixels and the rest.

Every projection is given twice, as a DataFrame and as the SQL of a common
table expression, so that a query can be checked against SQL over the tables
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift import schema as S
from framesift.functions import scalars
from framesift.sources import shared

# How far apart events are for a burst: they come minutes apart, not tenths of
# a second.
GAP = 7200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp that has no zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, F.col(ts))


def utc(ts: str) -> Column:
    return F.timestamp_micros(micros(ts))


# -- frames: an event is a picture, a user's events a folder -------------------


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _rating() -> Column:
    marks = {"error": -1, "view": 0, "click": 1, "signup": 3, "purchase": 5}
    chosen = F.lit(0)
    for event_type, rating in marks.items():
        chosen = F.when(F.col("event_type") == event_type, rating).otherwise(chosen)
    return chosen


def _signals(k: Column) -> Column:
    measures = F.struct(
        F.col("value").alias("focus"),
        F.when(k % 3 != 0, F.col("value") * (50 + k % 50) / 100).alias("eyes"),
        F.when(k % 5 != 0, k / 99).alias("open"),
        (k % 10 / 100).alias("highlights"),
        (k % 13 / 100).alias("shadows"),
        (k % 4).cast("bigint").alias("faces"),
        (k % 4 / 20).alias("face"),
    )
    return F.when(k % 7 != 0, measures)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    suffix = F.when(k % 10 < 6, ".ARW").when(k % 10 < 9, ".jpg").otherwise(".PNG")
    name = F.concat(F.lit("DSC"), F.lpad(F.col("event_id").cast("string"), 12, "0"), suffix)
    exif = F.struct(
        F.when(k % 5 != 0, F.concat(F.lit("ILCE-"), (k % 4).cast("string"))).alias("model"),
        F.when(k % 7 != 0, F.concat(F.lit("FE "), (35 + k % 3 * 50).cast("string"), F.lit("mm F1.8"))).alias("lens"),
        F.when(
            k % 11 != 0, F.struct(F.lit(1).cast("bigint").alias("n"), (k % 9 * 125).cast("bigint").alias("d"))
        ).alias("exposure"),
        ((14 + k % 6 * 7) / 10).alias("f_number"),
        F.when(k % 11 != 0, k * 100).cast("bigint").alias("iso"),
        (24 + k).cast("double").alias("focal_length"),
    )
    dir_ = F.concat(F.lit("/shoots/"), F.col("user_id").cast("string"))
    events = table(spark, sf_dir, "events").withColumns({"k": _k(), "name": F.lit("")})
    return events.withColumn("name", name).select(
        dir_.alias("dir"),
        F.concat(dir_, F.lit("/"), F.col("name")).alias("path"),
        "name",
        scalars.kind("name").alias("kind"),
        _rating().alias("rating"),
        (micros("ts") / 1e6).alias("captured"),
        F.lit(None).cast("int").alias("suggested"),
        exif.alias("exif"),
        _signals(k).alias("signals"),
    )


_EVENTS_SQL = """events_k AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
)"""

FRAMES_SQL = f"""{_EVENTS_SQL}, named AS (
  SELECT *, '/shoots/' || user_id AS dir,
    'DSC' || lpad(CAST(event_id AS VARCHAR), 12, '0')
      || CASE WHEN k % 10 < 6 THEN '.ARW' WHEN k % 10 < 9 THEN '.jpg' ELSE '.PNG' END AS name
  FROM events_k
), frames AS (
  SELECT dir, dir || '/' || name AS path, name,
    CASE WHEN k % 10 < 6 THEN 'raw' WHEN k % 10 < 9 THEN 'jpeg' ELSE 'png' END AS kind,
    CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 WHEN 'click' THEN 1
      WHEN 'signup' THEN 3 ELSE 5 END AS rating,
    epoch_us(ts) / 1e6 AS captured,
    CASE WHEN k % 5 <> 0 THEN 'ILCE-' || (k % 4) END AS model,
    CASE WHEN k % 7 <> 0 THEN 'FE ' || (35 + k % 3 * 50) || 'mm F1.8' END AS lens,
    CASE WHEN k % 11 <> 0 AND k % 9 <> 0 THEN 1 / (k % 9 * 125) END AS shutter,
    (14 + k % 6 * 7) / 10 AS f_number,
    CASE WHEN k % 11 <> 0 THEN k * 100 END AS iso,
    CAST(24 + k AS DOUBLE) AS focal,
    k % 7 <> 0 AS measured,
    CASE WHEN k % 7 <> 0 THEN value END AS focus,
    CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN value * (50 + k % 50) / 100 END AS eyes,
    CASE WHEN k % 7 <> 0 AND k % 5 <> 0 THEN k / 99 END AS open,
    CASE WHEN k % 7 <> 0 THEN k % 10 / 100 END AS highlights,
    CASE WHEN k % 7 <> 0 THEN k % 13 / 100 END AS shadows,
    CASE WHEN k % 7 <> 0 THEN k % 4 END AS faces,
    CASE WHEN k % 7 <> 0 THEN k % 4 / 20 END AS face
  FROM named
)"""


def runs_sql(gap: float = GAP, source: str = "frames", name: str = "stacked", into: str = "stack") -> str:
    """Runs by time of ``source``, as a table with a stack's first path."""
    return f"""{name}_gaps AS (
  SELECT *, captured - lag(captured) OVER (PARTITION BY dir ORDER BY path) AS gap_before FROM {source}
), {name}_starts AS (
  SELECT *, CASE WHEN gap_before IS NULL OR abs(gap_before) > {gap} THEN 1 ELSE 0 END AS starts
  FROM {name}_gaps
), {name}_runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY dir ORDER BY path) AS run FROM {name}_starts
), {name} AS (
  SELECT * EXCLUDE (gap_before, starts, run),
    CASE WHEN count(*) OVER (PARTITION BY dir, run) > 1
      THEN min(path) OVER (PARTITION BY dir, run) END AS {into}
  FROM {name}_runs
)"""


# -- groups given by a key: a line item is a frame, its order the group --------


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Big groups' worth of frames with nothing but the focus measured."""
    line = table(spark, sf_dir, "lineitem")
    path = F.concat_ws(
        "/", F.col("l_orderkey").cast("string"),
        *(F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("l_linenumber", 2), ("l_partkey", 9), ("l_suppkey", 9))),
        F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string"),
    )
    signals = F.struct(
        F.col("l_quantity").alias("focus"),
        F.lit(None).cast("double").alias("eyes"),
        F.lit(None).cast("double").alias("open"),
        F.col("l_discount").alias("highlights"),
        F.col("l_tax").alias("shadows"),
        F.lit(0).cast("bigint").alias("faces"),
        F.lit(0.0).alias("face"),
    )
    return line.select(
        F.col("l_orderkey").cast("string").alias("dir"), path.alias("path"),
        F.col("l_orderkey").cast("string").alias("group"), signals.alias("signals"),
    )


ORDER_FRAMES_SQL = """frames AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS dir,
    l_orderkey || '/' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '/' || lpad(CAST(l_partkey AS VARCHAR), 9, '0')
      || '/' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') || '/' || strftime(l_shipdate, '%Y%m%d')
      || '/' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS path,
    l_quantity AS focus, l_discount AS highlights, l_tax AS shadows
  FROM lineitem
)"""


# -- the decision log: an event is a mark --------------------------------------


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks on twenty pictures a folder, many more than once."""
    k, n = F.col("k"), F.col("event_id")
    dir_ = F.concat(F.lit("/shoots/"), F.col("user_id").cast("string"))

    def file(i: Column) -> Column:
        name = F.concat(F.lit("/DSC"), F.lpad(i.cast("string"), 5, "0"), F.lit(".ARW"))
        return F.struct(
            F.concat(dir_, name).alias("path"),
            (i * 1000 + 500).cast("bigint").alias("size"),
            F.lit(1_700_000_000).cast("bigint").alias("modified"),
            F.when(i % 4 != 0, F.concat(F.lit("2026:10:04 12:00:"), F.lpad(i.cast("string"), 2, "0"))).alias("captured"),
        )

    how = F.when(F.col("event_type") == "view", "pass").when(k % 10 == 9, "undo").when(k % 10 == 8, "redo").otherwise("mark")
    standing = F.struct(
        (1 + k % 6).cast("bigint").alias("of"),
        F.when(k % 2 == 0, k / 99).alias("sharp"),
        F.when(k % 3 == 0, k / 99).alias("open"),
    )
    suggested = F.struct(
        F.when(F.col("value") > 250, 1).otherwise(-1).alias("rating"),
        F.when(k % 8 == 0, "model").otherwise("signals").alias("by"),
        (k / 99).alias("confidence"),
    )
    events = table(spark, sf_dir, "events").withColumn("k", _k())
    return events.select(
        F.lit(S.LOG_VERSION).alias("v"),
        F.floor(micros("ts") / 1000).alias("at"),
        (F.floor(micros("ts") / 86_400_000_000) * 86_400_000).cast("bigint").alias("session"),
        file(k % 20).alias("file"),
        _rating().alias("rating"),
        (n % 7 - 1).cast("int").alias("was"),
        how.alias("how"),
        F.when(k % 3 == 0, "survey").when(k % 3 == 1, "compare").otherwise("loupe").alias("view"),
        F.when(k % 2 == 0, F.array(file((k + 1) % 20), file((k + 2) % 20)))
        .otherwise(F.array().cast(S.DECISIONS["compared"].dataType)).alias("compared"),
        F.lit("all").alias("filter"),
        (F.col("value") * 100).cast("bigint").alias("dwell_ms"),
        _signals(k).alias("signals"),
        F.when(k % 5 != 0, standing).alias("standing"),
        F.when(k % 4 == 0, suggested).alias("suggested"),
        n.alias("seq"),
    )


DECISIONS_SQL = f"""{_EVENTS_SQL}, decisions AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS made,
    epoch_us(ts) // 86400000000 * 86400000 AS session,
    '/shoots/' || user_id AS dir,
    '/shoots/' || user_id || '/DSC' || lpad(CAST(k % 20 AS VARCHAR), 5, '0') || '.ARW' AS path,
    k % 20 * 1000 + 500 AS size,
    CASE WHEN k % 20 % 4 <> 0 THEN '2026:10:04 12:00:' || lpad(CAST(k % 20 AS VARCHAR), 2, '0') END AS captured,
    CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 WHEN 'click' THEN 1
      WHEN 'signup' THEN 3 ELSE 5 END AS rating,
    event_id % 7 - 1 AS was,
    CASE WHEN event_type = 'view' THEN 'pass' WHEN k % 10 = 9 THEN 'undo' WHEN k % 10 = 8 THEN 'redo'
      ELSE 'mark' END AS how,
    CASE k % 3 WHEN 0 THEN 'survey' WHEN 1 THEN 'compare' ELSE 'loupe' END AS view,
    CASE WHEN k % 2 = 0 THEN [(k + 1) % 20, (k + 2) % 20] ELSE [] END AS compared,
    CAST(trunc(value * 100) AS BIGINT) AS dwell_ms,
    k % 7 <> 0 AS measured,
    value AS focus,
    CASE WHEN k % 3 <> 0 THEN value * (50 + k % 50) / 100 END AS eyes,
    CASE WHEN k % 5 <> 0 THEN k / 99 END AS open,
    k % 10 / 100 AS highlights, k % 13 / 100 AS shadows, k % 4 AS faces, k % 4 / 20 AS face,
    CASE WHEN k % 5 <> 0 THEN 1 + k % 6 END AS of_n,
    CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN k / 99 END AS sharp_share,
    CASE WHEN k % 5 <> 0 AND k % 3 = 0 THEN k / 99 END AS open_share,
    k % 4 = 0 AS has_suggestion,
    CASE WHEN value > 250 THEN 1 ELSE -1 END AS suggested,
    CASE WHEN k % 8 = 0 THEN 'model' ELSE 'signals' END AS "by",
    user_id
  FROM events_k
)"""

# The features of a row of the log, in order.
FEATURES_SQL = {
    "focus": "ln(1 + greatest(focus, 0)) / ln(256)",
    "focus_known": "CAST(focus IS NOT NULL AS DOUBLE)",
    "eyes": "coalesce(ln(1 + greatest(eyes, 0)) / ln(256), 0)",
    "eyes_known": "CAST(eyes IS NOT NULL AS DOUBLE)",
    "open": "coalesce(open, 0)",
    "open_known": "CAST(open IS NOT NULL AS DOUBLE)",
    "shut": "CAST(coalesce(open < 0.3, false) AS DOUBLE)",
    "highlights": "sqrt(highlights)",
    "shadows": "sqrt(shadows)",
    "faces": "least(faces, 5) / 5",
    "face": "sqrt(face)",
    "sharp_share": "coalesce(sharp_share, 1)",
    "open_share": "coalesce(open_share, 1)",
    "group": "least(ln(coalesce(of_n, 1)) / ln(20), 1)",
}


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a look at a picture; a third of them at the one the mark
    is on."""
    log = decisions(spark, sf_dir)
    return log.select(
        "session", scalars.parent("file.path").alias("dir"), F.col("file.path").alias("path"), "at",
        F.timestamp_millis("at").alias("ts"),
    )


# -- looks and pixels: an embedding is a small picture -------------------------


def level(v: Column) -> Column:
    """A component as a level from 0 to 255."""
    return F.greatest(F.least(F.round(128 + 256 * v.cast("double")), F.lit(255.0)), F.lit(0.0)).cast("int")


LEVEL_SQL = "CAST(greatest(least(round(128 + 256 * CAST({v} AS DOUBLE)), 255), 0) AS INTEGER)"


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as looks, ten seconds apart, a folder a label."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("label").cast("string").alias("dir"),
        F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("path"),
        F.when(F.col("vec_id") % 11 != 0, F.col("vec_id") * 10.0).alias("captured"),
        F.when(F.col("vec_id") % 9 != 0, F.transform("embedding", level)).alias("signature"),
    )


LOOKS_SQL = f"""looks AS (
  SELECT CAST(label AS VARCHAR) AS dir, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS path,
    CASE WHEN vec_id % 11 <> 0 THEN vec_id * 10.0::DOUBLE END AS captured,
    CASE WHEN vec_id % 9 <> 0 THEN list_transform(embedding, lambda v: {LEVEL_SQL.format(v='v')}) END AS signature
  FROM embeddings
)"""

# How wide the small pictures are. Each is an embedding's components in rows,
# repeated to and fro to be large enough to measure.
SIDE = 16


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a picture of 16 by 16: its 64 components in rows, and
    again below; green the other way round, blue shifted."""
    vectors = table(spark, sf_dir, "embeddings")
    at = F.posexplode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i", "_i")
    spread = vectors.select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("path"), "embedding", at)

    def component(i: Column) -> Column:
        return level(F.get("embedding", i))

    i = F.col("i")
    return spread.select(
        "path",
        (i % SIDE).cast("int").alias("x"),
        F.floor(i / SIDE).cast("int").alias("y"),
        component(i % 64).alias("r"),
        component(63 - i % 64).alias("g"),
        component((i + 17) % 64).alias("b"),
    )


def _component_sql(i: str) -> str:
    return LEVEL_SQL.format(v=f"embedding[{i} + 1]")


PIXELS_SQL = f"""pixels AS (
  SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS path, i % {SIDE} AS x, i // {SIDE} AS y,
    {_component_sql('i % 64')} AS r, {_component_sql('(63 - i % 64)')} AS g, {_component_sql('(i + 17) % 64')} AS b
  FROM embeddings, (SELECT unnest(range({SIDE * SIDE})) AS i)
), lit AS (
  SELECT *, (54 * r + 183 * g + 19 * b) >> 8 AS l FROM pixels
), rows_ AS (
  SELECT path, x, y, l, lag(l) OVER c + 2 * l + lead(l) OVER c AS smooth, lead(l) OVER c - lag(l) OVER c AS fall
  FROM lit WINDOW c AS (PARTITION BY path, x ORDER BY y)
), edges AS (
  SELECT path, x, y, abs(lead(smooth) OVER w - lag(smooth) OVER w)
    + abs(lag(fall) OVER w + 2 * fall + lead(fall) OVER w) AS g
  FROM rows_ WINDOW w AS (PARTITION BY path, y ORDER BY x)
), gradients AS (
  SELECT * FROM edges WHERE g IS NOT NULL
)"""


# -- faces: a line item is a detection, its order the picture ------------------


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw detections of two or more a picture, many overlapping."""
    line = table(spark, sf_dir, "lineitem")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    quantity = F.col("l_quantity")

    def components(n: int) -> Column:
        return F.array(*(((part + i * supp) % (11 + i) / 10).cast("double") for i in range(n)))

    return line.select(
        F.col("l_orderkey").cast("string").alias("path"),
        F.when(part % 3 == 0, 8).when(part % 3 == 1, 16).otherwise(32).alias("stride"),
        (part * 7 + F.col("l_linenumber")).cast("int").alias("cell"),
        (quantity / 50 + 0.3).alias("cls"),
        (1.1 - F.col("l_discount") * 5).alias("obj"),
        components(4).alias("bbox"),
        components(10).alias("kps"),
        F.lit(640.0).alias("w"),
        F.lit(480.0).alias("h"),
        F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey"))).alias("line"),
    ).withColumn("i", F.col("cell") % F.floor(F.lit(640 * 640) / (F.col("stride") * F.col("stride"))).cast("int"))


DETECTIONS_SQL = """detections AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS path, l_partkey AS p, l_suppkey AS s,
    CASE l_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS stride,
    l_partkey * 7 + l_linenumber AS cell,
    l_quantity / 50 + 0.3::DOUBLE AS cls, 1.1::DOUBLE - l_discount * 5 AS obj,
    list_transform(range(10), lambda i: (l_partkey + i * l_suppkey) % (11 + i) / 10) AS parts
  FROM lineitem
), scored AS (
  SELECT *, sqrt(least(greatest(cls, 0), 1) * least(greatest(obj, 0), 1)) AS score,
    cell % (640 * 640 // (stride * stride)) AS i, 640 // stride AS across
  FROM detections
), faces AS (
  SELECT path, score,
    (i % across + parts[1]) * stride AS cx, (i // across + parts[2]) * stride AS cy,
    exp(parts[3]) * stride AS bw, exp(parts[4]) * stride AS bh, i % across AS col, i // across AS row, stride, parts
  FROM scored WHERE score >= 0.6
), boxed AS (
  SELECT path, score, (cx - bw / 2) / 640 AS l, (cy - bh / 2) / 480 AS t, (cx + bw / 2) / 640 AS r,
    (cy + bh / 2) / 480 AS b,
    (parts[1] + col) * stride / 640 AS ex, (parts[2] + row) * stride / 480 AS ey,
    (parts[3] + col) * stride / 640 AS fx, (parts[4] + row) * stride / 480 AS fy
  FROM faces
)"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new shared folder, for Spark to write to."""
    return shared.folder(spark, name)


def mounted(spark: SparkSession, name: str) -> str:
    """A new shared folder for tasks to write single files to: the shared
    folder must be mounted on every machine."""
    return shared.folder(spark, name).removeprefix("file://").removeprefix("file:")
