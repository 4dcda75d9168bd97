"""Detections to faces, and faces to what a frame is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framesift import scale
from framesift.functions import vision

# How much boxes overlap to be of one face; how small a face is
# against the largest to be a bystander's.
SAME_FACE = 0.3
BYSTANDER = 0.25


def decoded(detections: DataFrame, sure: float = vision.SURE) -> DataFrame:
    """Raw detections ``(path, stride, i, cls, obj, bbox, kps, w, h)`` as faces
    ``(path, score, bounds, eyes, open)``; ``w`` and ``h`` are of the frame as
    fitted in the detector's square."""
    scored = detections.withColumn("score", vision.detection_score("cls", "obj")).where(F.col("score") >= sure)
    face = vision.decoded_face("stride", "i", "bbox", "kps", "w", "h")
    return scored.withColumn("_face", face).select(
        "path", "score", "_face.bounds", "_face.eyes", F.lit(None).cast("double").alias("open")
    )


def suppressed(faces: DataFrame, overlapping: float = SAME_FACE) -> DataFrame:
    """The surest of each cluster of overlapping detections. A detector has a
    fixed grid of places to find a face, so a frame's detections are few."""
    columns = [c for c in faces.columns if c not in ("path", "score")]
    # Surest first; of equals in the order of their boxes.
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_unsure"), *columns, "score")))
    ordered = faces.groupBy("path").agg(sorted_.alias("_found"))
    kept = F.aggregate(
        "_found",
        F.filter("_found", lambda _: F.lit(False)),
        lambda kept, face: F.when(
            F.exists(kept, lambda k: vision.overlap(k["bounds"], face["bounds"]) >= overlapping), kept
        ).otherwise(F.concat(kept, F.array(face))),
    )
    return ordered.select("path", F.inline(kept)).select(faces.columns)


def eyelids(landmarks: DataFrame) -> DataFrame:
    """How open each face's eyes are, ``(path, face, open)``, from its points
    ``(path, face, point, x, y)``."""
    needed = sorted({p for eye in vision.EYES for p in (*eye["corners"], *sum(eye["lids"], ()))})
    points = landmarks.where(F.col("point").isin(*needed)).groupBy("path", "face").agg(
        *(F.max(F.when(F.col("point") == p, F.struct("x", "y"))).alias(f"_{p}") for p in needed)
    )

    def apart(a: int, b: int) -> Column:
        return F.hypot(F.col(f"_{a}.x") - F.col(f"_{b}.x"), F.col(f"_{a}.y") - F.col(f"_{b}.y"))

    def gap(eye: dict) -> Column:
        lids = [apart(*pair) for pair in eye["lids"]]
        width = apart(*eye["corners"])
        across = F.when(width.isNotNull(), F.greatest(width, F.lit(1e-6)))
        return (lids[0] + lids[1] + lids[2]) / 3.0 / across

    return points.select("path", "face", vision.openness(*(gap(eye) for eye in vision.EYES)).alias("open"))


def per_frame(faces: DataFrame) -> DataFrame:
    """How many faces a frame has, how much of it the largest takes up, and
    the least open eyes of those it is of: ``(path, faces, face, open)``."""
    sized = faces.select("path", vision.face_area("bounds").alias("_area"), "open")
    known = scale.lookup(sized, sized.groupBy("path").agg(F.max("_area").alias("_largest")), ["path"])
    subject = F.col("_area") >= F.col("_largest") * BYSTANDER
    return known.groupBy("path").agg(
        F.count(F.lit(1)).alias("faces"),
        F.max("_area").alias("face"),
        F.min(F.when(subject, F.col("open"))).alias("open"),
    )
