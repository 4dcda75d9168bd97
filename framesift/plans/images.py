"""Pixels and faces, over embeddings as pictures and line items as faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift import scale
from framesift.functions import vision
from framesift.operators import faces, pixels
from framesift.plans import adapters as A
from framesift.plans.registry import query

PIXELS = f"WITH {A.PIXELS_SQL}"


@query(
    "look_distances",
    f"""WITH {A.LOOKS_SQL}, before AS (
      SELECT dir, path, signature AS a, lag(signature) OVER (PARTITION BY dir ORDER BY path) AS b FROM looks
    ), shifted AS (SELECT *, list_avg(a) - list_avg(b) AS shift FROM before WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT path, round(list_avg(list_transform(range(1, 65), lambda i: abs(a[i] - b[i] - shift))), 9) AS distance FROM shifted""",
)
def look_distances(spark, sf):
    looks = scale.laid(A.looks(spark, sf).select("dir", "path", "signature"), ["dir"], "path")
    seen = scale.previous(looks, ["dir"], "path", {"_before": F.col("signature")})
    distance = vision.signature_distance("signature", "_before")
    return seen.where(F.col("signature").isNotNull() & F.col("_before").isNotNull()).select(
        "path", F.round(distance, 9).alias("distance")
    )


@query(
    "histograms",
    f"""{PIXELS}, flat AS (
      SELECT path, 'r' AS channel, r AS level FROM pixels UNION ALL SELECT path, 'g', g FROM pixels UNION ALL SELECT path, 'b', b FROM pixels
    ), every_ AS (SELECT path, channel, CAST(unnest(range(256)) AS INTEGER) AS level FROM (SELECT DISTINCT path, channel FROM flat))
    SELECT e.path, e.channel, e.level, count(f.path) AS n FROM every_ e LEFT JOIN flat f
      ON f.path = e.path AND f.channel = e.channel AND f.level = e.level GROUP BY ALL""",
)
def histograms(spark, sf):
    return pixels.histogram(A.pixels(spark, sf))


@query(
    "clipping",
    """SELECT CAST(vec_id AS VARCHAR) AS path, avg(CAST(greatest(v1, v2, v3) >= 254 AS INT)) AS highlights,
      avg(CAST(greatest(v1, v2, v3) <= 2 AS INT)) AS shadows
    FROM (SELECT vec_id, i, CAST(greatest(least(round(128 + 1024 * CAST(embedding[i + 1] AS DOUBLE)), 255), 0) AS INTEGER) AS v1,
      CAST(greatest(least(round(128 + 1024 * CAST(embedding[i + 1] AS DOUBLE)), 255), 0) AS INTEGER) AS v2,
      CAST(greatest(least(round(128 + 1024 * CAST(embedding[i + 1] AS DOUBLE)), 255), 0) AS INTEGER) AS v3
      FROM embeddings, (SELECT unnest(range(64)) AS i)) GROUP BY ALL""",
)
def clipping(spark, sf):
    # Four times the contrast, or nothing is blown or black.
    flat = A.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.posexplode("embedding").alias("i", "v"))
    v = F.greatest(F.least(F.round(128 + 1024 * F.col("v").cast("double")), F.lit(255.0)), F.lit(0.0)).cast("int")
    return pixels.clipping(flat.select("path", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), v.alias("r"), v.alias("g"), v.alias("b")))


@query(
    "steepness",
    f"{PIXELS} SELECT path, x, y, g AS gradient FROM gradients",
)
def steepness(spark, sf):
    return pixels.steepness(A.pixels(spark, sf)).select(
        "path", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), "gradient"
    )


def _focus(spark, sf):
    number = F.col("path").cast("int")
    paths = A.table(spark, sf, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("path"))
    return paths.select("path", F.when(number % 5 != 0, number % 10 / 10 + 0.05).alias("u"), F.lit(0.5).alias("v"))


def _faces(spark, sf):
    number = F.col("vec_id") % 4
    face = F.array(F.lit(0.1), F.lit(0.1), 0.4 + number / 10, F.lit(0.6))
    eyes = F.array(F.array(F.lit(0.3), F.lit(0.5)), F.array(0.6 + number / 20, F.lit(0.55)))
    return A.table(spark, sf, "embeddings").where(F.col("vec_id") % 3 != 0).select(
        F.lpad(F.col("vec_id").cast("string"), 9, "0").alias("path"),
        F.lit(0.9).alias("score"), face.alias("bounds"), eyes.alias("eyes"), (number / 5).alias("open"),
    )


_SMALLEST = 2
_SHARP_SQL = f"""{PIXELS}, numbered AS (
  SELECT DISTINCT path, CAST(path AS INTEGER) AS n FROM pixels
), wanted AS (
  SELECT path, 'focus' AS what, (n % 10 / 10 + 0.05::DOUBLE) * 16 - 1 AS l, 7.0::DOUBLE AS t, (n % 10 / 10 + 0.05::DOUBLE) * 16 + 1 AS r, 9.0::DOUBLE AS b
    FROM numbered WHERE n % 5 <> 0
  UNION ALL SELECT path, 'eyes', (x0 + x1) / 2 - apart, (y0 + y1) / 2 - apart / 2, (x0 + x1) / 2 + apart, (y0 + y1) / 2 + apart / 2
  FROM (SELECT *, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS apart FROM (
    SELECT path, 0.3::DOUBLE * 16 AS x0, 0.5::DOUBLE * 16 AS y0, (0.6::DOUBLE + n % 4 / 20) * 16 AS x1, 0.55::DOUBLE * 16 AS y1
    FROM numbered WHERE n % 3 <> 0))
), boxes AS (
  SELECT path, what, least(greatest(round(l), 1), 15) AS l, least(greatest(round(t), 1), 15) AS t,
    least(greatest(round(r), 1), 15) AS r, least(greatest(round(b), 1), 15) AS b FROM wanted
), big AS (SELECT * FROM boxes WHERE r >= l + {_SMALLEST} AND b >= t + {_SMALLEST}),
ranked AS (
  SELECT path, what, g, row_number() OVER (PARTITION BY path, what ORDER BY g DESC) AS place,
    count(*) OVER (PARTITION BY path, what) AS n
  FROM big JOIN gradients USING (path) WHERE x >= l AND x < r AND y >= t AND y < b
), sharp AS (
  SELECT path, what, avg(g) / 4 AS sharpness FROM ranked WHERE place <= greatest(n // 10, 1) GROUP BY ALL
)"""


@query("sharpness", f"{_SHARP_SQL} SELECT path, what, round(sharpness, 9) AS sharpness FROM sharp")
def sharpness(spark, sf):
    table = A.pixels(spark, sf)
    boxes = pixels.boxes(pixels.sizes(table), _focus(spark, sf), _faces(spark, sf))
    return pixels.sharpness(table, boxes, _SMALLEST).withColumn("sharpness", F.round("sharpness", 9))


@query(
    "measured_signals",
    f"""{_SHARP_SQL}, clipped AS (
      SELECT path, CAST(path AS INTEGER) AS n, avg(CAST(greatest(r, g, b) >= 254 AS INT)) AS highlights,
        avg(CAST(greatest(r, g, b) <= 2 AS INT)) AS shadows FROM pixels GROUP BY ALL
    ) SELECT c.path, round(f.sharpness, 9) AS focus, round(e.sharpness, 9) AS eyes, CASE WHEN n % 3 <> 0 THEN n % 4 / 5 END AS open,
      highlights, shadows, CAST(n % 3 <> 0 AS BIGINT) AS faces,
      round(CASE WHEN n % 3 <> 0 THEN (0.4::DOUBLE + n % 4 / 10 - 0.1::DOUBLE) * 0.5::DOUBLE ELSE 0 END, 9) AS face
    FROM clipped c LEFT JOIN sharp f ON f.path = c.path AND f.what = 'focus' LEFT JOIN sharp e ON e.path = c.path AND e.what = 'eyes'""",
)
def measured_signals(spark, sf):
    found = pixels.measured(A.pixels(spark, sf), _focus(spark, sf), _faces(spark, sf), _SMALLEST)
    return found.withColumns({c: F.round(c, 9) for c in ("focus", "eyes", "face")})


_PEAK_SQL = f"""{PIXELS}, counted AS (SELECT path, g, count(*) AS n FROM gradients WHERE y % 4 = 1 GROUP BY ALL),
down_to AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY g DESC) AS above, sum(n) OVER (PARTITION BY path) AS total FROM counted),
thresholds AS (SELECT path, greatest(coalesce(max(CASE WHEN above > total * 0.015::DOUBLE THEN g END), 0), 160) AS threshold FROM down_to GROUP BY path),
marks AS (
  SELECT p.path, p.x, p.y, (CASE WHEN greatest(p.r, p.g, p.b) >= 254 THEN 2 WHEN greatest(p.r, p.g, p.b) <= 2 THEN 1 ELSE 0 END)
    + CASE WHEN coalesce(d.g >= t.threshold, false) THEN 4 ELSE 0 END AS mark
  FROM pixels p JOIN thresholds t USING (path) LEFT JOIN gradients d ON d.path = p.path AND d.x = p.x AND d.y = p.y
)"""


@query("peaking", f"{_PEAK_SQL} SELECT path, x, y, mark FROM marks")
def peaking(spark, sf):
    return pixels.peaking(A.pixels(spark, sf))


@query(
    "peaking_shares",
    f"""{_PEAK_SQL} SELECT path, avg(CAST(mark & 4 <> 0 AS INT)) AS sharp, avg(CAST(mark & 2 <> 0 AS INT)) AS highlights,
      avg(CAST(mark & 1 <> 0 AS INT)) AS shadows FROM marks GROUP BY path""",
)
def peaking_shares(spark, sf):
    return pixels.peaking_shares(pixels.peaking(A.pixels(spark, sf)))


@query(
    "signatures",
    f"""{PIXELS}, small AS (
      SELECT path, x // 2 AS ox, y // 2 AS oy, (sum(r) + 2) // 4 AS r, (sum(g) + 2) // 4 AS g, (sum(b) + 2) // 4 AS b
      FROM (SELECT path, x, y, r, g, b FROM pixels UNION ALL SELECT path, x + 16, y, g, b, r FROM pixels
        UNION ALL SELECT path, x, y + 16, b, r, g FROM pixels UNION ALL SELECT path, x + 16, y + 16, r, g, b FROM pixels) GROUP BY ALL
    ) SELECT path, y * 16 + x AS cell, CAST((54 * r + 183 * g + 19 * b) >> 8 AS INTEGER) AS level
    FROM small, (SELECT unnest(range(16)) AS x), (SELECT unnest(range(12)) AS y) WHERE ox = x AND oy = y * 16 // 12""",
)
def signatures(spark, sf):
    # Four copies, their channels turned, make a picture worth shrinking.
    one = A.pixels(spark, sf)

    def moved(dx, dy, r, g, b):
        return one.select("path", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col(r).alias("r"), F.col(g).alias("g"), F.col(b).alias("b"))

    whole = one.unionByName(moved(16, 0, "g", "b", "r")).unionByName(moved(0, 16, "b", "r", "g")).unionByName(moved(16, 16, "r", "g", "b"))
    found = pixels.signatures(whole)
    return found.select("path", F.posexplode("signature").alias("cell", "level")).withColumn("cell", F.col("cell").cast("bigint"))


@query(
    "tone_curves",
    f"""{PIXELS}, tones AS (
      SELECT path, 'r' AS channel, CAST(round(r / 255 * 4095) AS INTEGER) AS level FROM pixels WHERE (y * 16 + x) % 4 = 0
      UNION ALL SELECT path, 'g', CAST(round(g / 255 * 4095) AS INTEGER) FROM pixels WHERE (y * 16 + x) % 4 = 0
      UNION ALL SELECT path, 'b', CAST(round(b / 255 * 4095) AS INTEGER) FROM pixels WHERE (y * 16 + x) % 4 = 0
    ), have AS (SELECT path, channel, level, count(*) AS n FROM tones GROUP BY ALL),
    shares AS (
      SELECT *, (sum(n) OVER (PARTITION BY path, channel ORDER BY level) - n / 2) / sum(n) OVER (PARTITION BY path, channel) AS share FROM have
    ), wanted AS (
      SELECT path, channel, level, count(*) AS n FROM (
        SELECT path, 'r' AS channel, g AS level FROM pixels UNION ALL SELECT path, 'g', b FROM pixels UNION ALL SELECT path, 'b', r FROM pixels) GROUP BY ALL
    ), below AS (
      SELECT *, sum(n) OVER (PARTITION BY path, channel ORDER BY level) / sum(n) OVER (PARTITION BY path, channel) AS below FROM wanted
    ) SELECT s.path, s.channel, s.level, min(b.level) AS "to" FROM shares s JOIN below b ON b.path = s.path AND b.channel = s.channel
      AND b.below >= s.share GROUP BY ALL""",
)
def tone_curves(spark, sf):
    # Each channel is matched to another's levels.
    table = A.pixels(spark, sf)
    developed = table.select("path", "x", "y", *((F.col(c) / 255).alias(c) for c in "rgb"))
    have = pixels.tone_counts(developed, pixels.sizes(table))
    want = pixels.histogram(table.select("path", "x", "y", F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b")))
    return pixels.tone_curves(have, want)


# -- faces ---------------------------------------------------------------------

_BOX = ", ".join(f"round({c}, 7) AS {c}" for c in ("l", "t", "r", "b"))


@query(
    "decoded_faces",
    f"""WITH {A.DETECTIONS_SQL} SELECT path, round(score, 9) AS score, {_BOX}, round(ex, 7) AS ex, round(ey, 7) AS ey,
      round(fx, 7) AS fx, round(fy, 7) AS fy FROM boxed""",
)
def decoded_faces(spark, sf):
    found = faces.decoded(A.detections(spark, sf))
    box = [F.round(F.get("bounds", F.lit(i)), 7).alias(c) for i, c in enumerate("ltrb")]
    eyes = [F.round(F.get(F.get("eyes", F.lit(i)), F.lit(j)), 7).alias(e + a) for i, e in enumerate("ef") for j, a in enumerate("xy")]
    return found.select("path", F.round("score", 9).alias("score"), *box, *eyes)


@query(
    "suppressed_faces",
    f"""WITH RECURSIVE {A.DETECTIONS_SQL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY path ORDER BY -score, l, t, r, b, ex, ey) AS place FROM boxed
    ), kept AS (
      SELECT path, 1 AS place, [ROW(l, t, r, b)] AS boxes, true AS taken FROM ranked WHERE place = 1
      UNION ALL SELECT k.path, k.place + 1,
        CASE WHEN clear THEN list_append(k.boxes, ROW(n.l, n.t, n.r, n.b)) ELSE k.boxes END, clear
      FROM (SELECT k.path, k.place, k.boxes, n.l, n.t, n.r, n.b, len(list_filter(k.boxes, lambda o:
          greatest(least(o[3], n.r) - greatest(o[1], n.l), 0) * greatest(least(o[4], n.b) - greatest(o[2], n.t), 0)
          / ((o[3] - o[1]) * (o[4] - o[2]) + (n.r - n.l) * (n.b - n.t)
            - greatest(least(o[3], n.r) - greatest(o[1], n.l), 0) * greatest(least(o[4], n.b) - greatest(o[2], n.t), 0)) >= 0.3)) = 0 AS clear
        FROM kept k JOIN ranked n ON n.path = k.path AND n.place = k.place + 1) n, LATERAL (SELECT n.path, n.place, n.boxes) k
    ) SELECT r.path, round(r.score, 9) AS score, {_BOX} FROM kept k JOIN ranked r USING (path, place) WHERE k.taken""",
)
def suppressed_faces(spark, sf):
    found = faces.suppressed(faces.decoded(A.detections(spark, sf)))
    box = [F.round(F.get("bounds", F.lit(i)), 7).alias(c) for i, c in enumerate("ltrb")]
    return found.select("path", F.round("score", 9).alias("score"), *box)


@query(
    "faces_per_frame",
    f"""WITH {A.DETECTIONS_SQL}, sized AS (
      SELECT path, greatest(r - l, 0) * greatest(b - t, 0) AS area, CASE WHEN i % 3 <> 0 THEN i % 10 / 10 END AS open,
        max(greatest(r - l, 0) * greatest(b - t, 0)) OVER (PARTITION BY path) AS largest
      FROM (SELECT path, i, (cx - bw / 2) / 640 AS l, (cy - bh / 2) / 480 AS t, (cx + bw / 2) / 640 + stride * stride / 1000000 AS r, (cy + bh / 2) / 480 AS b
        FROM (SELECT path, i, stride, (i % across + parts[1]) * stride AS cx, (i // across + parts[2]) * stride AS cy,
          exp(parts[3]) * stride AS bw, exp(parts[4]) * stride AS bh FROM scored))
    ) SELECT path, count(*) AS faces, round(max(area), 7) AS face, min(open) FILTER (area >= largest * 0.25) AS open FROM sized GROUP BY path""",
)
def faces_per_frame(spark, sf):
    raw = A.detections(spark, sf)
    decoded = vision.decoded_face("stride", "i", "bbox", "kps", "w", "h")
    # A little wider, or sizes would be exact quarters of each other.
    bounds = F.transform(
        decoded["bounds"], lambda v, i: F.when(i == 2, v + F.col("stride") * F.col("stride") / 1e6).otherwise(v)
    )
    found = raw.select("path", bounds.alias("bounds"), F.when(F.col("i") % 3 != 0, F.col("i") % 10 / 10).alias("open"))
    return faces.per_frame(found).withColumn("face", F.round("face", 7))


_POINTS = sorted({p for eye in vision.EYES for p in (*eye["corners"], *sum(eye["lids"], ()))})


def _apart_sql(a: int, b: int) -> str:
    i, j = _POINTS.index(a), _POINTS.index(b)
    return (
        f"sqrt((CAST(embedding[{2 * i + 1}] AS DOUBLE) - CAST(embedding[{2 * j + 1}] AS DOUBLE)) ** 2"
        f" + (CAST(embedding[{2 * i + 2}] AS DOUBLE) - CAST(embedding[{2 * j + 2}] AS DOUBLE)) ** 2)"
    )


def _gap_sql(eye: dict) -> str:
    lids = " + ".join(_apart_sql(*pair) for pair in eye["lids"])
    return f"({lids}) / 3 / greatest({_apart_sql(*eye['corners'])} * 5, 1e-6)"


@query(
    "eyelids",
    f"""SELECT CAST(vec_id AS VARCHAR) AS path, vec_id % 2 AS face, round(greatest(least((({" + ".join(_gap_sql(e) for e in vision.EYES)}) / 2
      - 0.12::DOUBLE) / (0.28::DOUBLE - 0.12::DOUBLE), 1), 0), 7) AS open FROM embeddings""",
)
def eyelids(spark, sf):
    # Pairs of components as points; the corners drawn apart to open the eyes
    # less than all the way.
    vectors = A.table(spark, sf, "embeddings")
    corners = [p for eye in vision.EYES for p in eye["corners"]]
    points = F.array(
        *(
            F.struct(
                F.lit(p).alias("point"),
                *((F.get("embedding", F.lit(2 * i + j)).cast("double") * (5.0 if p in corners else 1.0)).alias(a) for j, a in enumerate("xy")),
            )
            for i, p in enumerate(_POINTS)
        )
    )
    landmarks = vectors.select(F.col("vec_id").cast("string").alias("path"), (F.col("vec_id") % 2).alias("face"), F.inline(points))
    found = faces.eyelids(landmarks)
    return found.withColumn("open", F.round("open", 7))
