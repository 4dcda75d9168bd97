"""Table schemas and the fixed values the rest of the package shares."""

from __future__ import annotations

from pyspark.sql import types as T

# Marks as sidecars hold them.
REJECT = -1
UNDECIDED = 0
PICK = 1
STARS = 5

# Schema versions of what is stored.
LOG_VERSION = 1
SIGNALS_VERSION = 1
FACES_VERSION = 2
MODEL_VERSION = 1

# Which file extensions are pictures, by kind.
KINDS = {
    "raw": ("arw", "nef", "cr3", "raf"),
    "jpeg": ("jpg", "jpeg"),
    "png": ("png",),
}


_STRING, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
_BOOLEAN, _TIMESTAMP = T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, type_) for name, type_ in fields.items()])


EXIF = _struct(
    model=_STRING, lens=_STRING, exposure=_struct(n=_LONG, d=_LONG), f_number=_DOUBLE, iso=_LONG,
    focal_length=_DOUBLE,
)
SIGNALS = _struct(
    focus=_DOUBLE, eyes=_DOUBLE, open=_DOUBLE, highlights=_DOUBLE, shadows=_DOUBLE, faces=_LONG,
    face=_DOUBLE,
)
STANDING = _struct(of=_LONG, sharp=_DOUBLE, open=_DOUBLE)
SUGGESTION = _struct(rating=_INT, by=_STRING, confidence=_DOUBLE)
FILE_ID = _struct(path=_STRING, size=_LONG, modified=_LONG, captured=_STRING)
FACE = _struct(
    score=_DOUBLE, bounds=T.ArrayType(_DOUBLE), eyes=T.ArrayType(T.ArrayType(_DOUBLE)), open=_DOUBLE
)

FRAMES = _struct(
    dir=_STRING, path=_STRING, name=_STRING, kind=_STRING, rating=_INT, captured=_DOUBLE,
    suggested=_INT, exif=EXIF, signals=SIGNALS,
)

DECISIONS = _struct(
    v=_INT, at=_LONG, session=_LONG, file=FILE_ID, rating=_INT, was=_INT, how=_STRING, view=_STRING,
    compared=T.ArrayType(FILE_ID), filter=_STRING, dwell_ms=_LONG, signals=SIGNALS,
    standing=STANDING, suggested=SUGGESTION,
)

LISTING = _struct(
    path=_STRING, parent=_STRING, name=_STRING, is_dir=_BOOLEAN, length=_LONG, modified=_TIMESTAMP
)
SIDECARS = _struct(sidecar_path=_STRING, xmp=_STRING)
PIXELS = _struct(path=_STRING, x=_INT, y=_INT, r=_INT, g=_INT, b=_INT)
TERMS = _struct(search_id=_LONG, dir=_STRING, field=_STRING, op=_STRING, value=_STRING)
MODEL = _struct(
    v=_INT, trained=_LONG, log_rows=_LONG, learned=T.ArrayType(_LONG), held=_LONG, sure=_LONG,
    right=_LONG, middle=T.ArrayType(_DOUBLE), spread=T.ArrayType(_DOUBLE),
    weights=T.ArrayType(T.ArrayType(_DOUBLE)), stars=T.ArrayType(_DOUBLE),
)
