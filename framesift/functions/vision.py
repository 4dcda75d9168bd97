"""Pixels, looks, faces and detections, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions.scalars import bind, col

# How much red, green and blue make up brightness, of 256.
LUMA = (54, 183, 19)
# The face detector's input size, and what it must be sure of.
DETECTOR_SIZE = 640
SURE = 0.6
# The landmark points of each eye's corners, and of its lids in
# pairs (upper, lower).
EYES = (
    {"corners": (33, 133), "lids": ((160, 144), (159, 145), (158, 153))},
    {"corners": (263, 362), "lids": ((387, 373), (386, 374), (385, 380))},
)
# The lids' distance against the eye's width, shut and wide open.
LIDS_SHUT, LIDS_OPEN = 0.12, 0.28
# Eyes less open than this look shut; a frame less sharp than
# this share of its group's sharpest is soft, and from this share on it is the
# sharpest; this much blown or black is worth telling.
EYES_SHUT = 0.3
SOFT, SHARPEST = 0.8, 0.995
BLOWN, BLACK = 0.03, 0.1


def luma(r: Column | str, g: Column | str, b: Column | str) -> Column:
    parts = [col(c).cast("int") * share for c, share in zip((r, g, b), LUMA)]
    return F.shiftright(parts[0] + parts[1] + parts[2], 8)


def signature_distance(a: Column | str, b: Column | str) -> Column:
    """How different two looks are: the mean difference in level, once overall
    brightness is evened out."""
    apart = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        return F.try_divide(total, F.size(values).cast("double"))

    def spread(of: Column) -> Column:
        return mean(F.transform(of["apart"], lambda d: F.abs(d - of["shift"])))

    shifted = bind(apart, lambda d: F.struct(d.alias("apart"), mean(d).alias("shift")))
    return bind(shifted, spread)


def face_area(bounds: Column | str) -> Column:
    left, top, right, bottom = (F.get(col(bounds), F.lit(i)) for i in range(4))
    return F.greatest(right - left, F.lit(0.0)) * F.greatest(bottom - top, F.lit(0.0))


def between_eyes(eyes: Column | str) -> Column:
    eyes = col(eyes)
    one, other = F.get(eyes, F.lit(0)), F.get(eyes, F.lit(1))
    return F.struct(
        *(((F.get(one, F.lit(i)) + F.get(other, F.lit(i))) / 2.0).alias(n) for i, n in enumerate("xy"))
    )


def overlap(a: Column | str, b: Column | str) -> Column:
    """Two boxes' intersection over their union."""
    a, b = ([F.get(col(box), F.lit(i)) for i in range(4)] for box in (a, b))

    def side(axis: int) -> Column:
        return F.greatest(F.least(a[axis + 2], b[axis + 2]) - F.greatest(a[axis], b[axis]), F.lit(0.0))

    both = side(0) * side(1)
    areas = [(box[2] - box[0]) * (box[3] - box[1]) for box in (a, b)]
    return F.try_divide(both, areas[0] + areas[1] - both)


def shut(eyes_open: Column | str) -> Column:
    """Null where it couldn't be told."""
    return col(eyes_open) < EYES_SHUT


def quality_flags(signals: Column | str, standing: Column | str) -> Column:
    """What's worth telling of a frame, as an array of words."""
    signals, standing = col(signals), col(standing)
    sharp = F.when(F.coalesce(signals["eyes"], signals["focus"]).isNotNull() & (standing["of"] > 1), standing["sharp"])
    words = {
        "soft": sharp < SOFT,
        "sharpest": sharp >= SHARPEST,
        "shut": shut(signals["open"]),
        "blown": signals["highlights"] >= BLOWN,
        "black": signals["shadows"] >= BLACK,
    }
    return F.array_compact(F.array(*(F.when(is_so, word) for word, is_so in words.items())))


def detection_score(cls: Column | str, obj: Column | str) -> Column:
    parts = [F.greatest(F.least(col(c), F.lit(1.0)), F.lit(0.0)) for c in (cls, obj)]
    return F.sqrt(parts[0] * parts[1])


def decoded_face(
    stride: Column | str, cell: Column | str, bbox: Column | str, kps: Column | str,
    width: Column | str, height: Column | str,
) -> Column:
    """``struct<bounds, eyes>`` of a raw detection, as fractions of the frame
    as it was fitted in the detector's square."""
    stride, cell, bbox, kps = col(stride), col(cell), col(bbox), col(kps)
    across = F.floor(F.lit(DETECTOR_SIZE) / stride)
    at = {"x": cell % across, "y": F.floor(cell / across)}
    size = {"x": col(width), "y": col(height)}

    def edges(axis: str, i: int) -> list[Column]:
        middle = (at[axis] + F.get(bbox, F.lit(i))) * stride
        half = F.exp(F.get(bbox, F.lit(i + 2))) * stride / 2.0
        return [(middle - half) / size[axis], (middle + half) / size[axis]]

    (left, right), (top, bottom) = edges("x", 0), edges("y", 1)

    def point(p: int) -> Column:
        return F.array(
            *((F.get(kps, F.lit(2 * p + i)) + at[a]) * stride / size[a] for i, a in enumerate("xy"))
        )

    return F.struct(
        F.array(left, top, right, bottom).alias("bounds"), F.array(point(0), point(1)).alias("eyes")
    )


def openness(lids_left: Column | str, lids_right: Column | str) -> Column:
    """0 (shut) to 1 from the two eyes' lid distances; a wink is half open."""
    both = (col(lids_left) + col(lids_right)) / 2.0
    share = (both - LIDS_SHUT) / (LIDS_OPEN - LIDS_SHUT)
    # Not known stays not known, where the least of nothing would be 1.
    return F.when(both.isNotNull(), F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0)))
