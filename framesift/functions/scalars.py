"""Names, sidecar paths, capture times, settings, keys."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift import schema as S

# A number as people write one; what Spark's cast takes besides (blanks,
# suffixes, NaN) is not one.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_WHOLE = r"^[+-]?[0-9]+$"

# 64-bit FNV-1a's start and prime, in 32-bit halves.
_FNV_START = (0xCBF29CE4, 0x84222325)
_FNV_PRIME_LOW = 435
_FNV_PRIME_SHIFT = 8
_LOW = 0xFFFFFFFF


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once, however often it's used: columns
    are trees, and a subtree used twice is there twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number(text: Column) -> Column:
    """Text as a double, or null."""
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def quantity_of(text: str) -> float | None:
    """:func:`quantity` of one text here, by the same pattern."""

    def plain(part: str) -> float | None:
        return float(part) if re.fullmatch(_NUMBER.strip("^$"), part) else None

    if text.endswith("%"):
        share = plain(text[:-1])
        value = None if share is None else share / 100.0
    else:
        over, slash, under = (plain(p) if k != 1 else p for k, p in enumerate(text.partition("/")))
        value = over if not slash else over / under if over is not None and under else None
    return value if value is not None and abs(value) < float("inf") else None


def quantity(text: Column | str) -> Column:
    """A written quantity: ``3``, ``1/250`` or ``5%``; null if it isn't one."""
    text = col(text)
    slash = F.instr(text, "/")
    over, under = F.substring_index(text, "/", 1), F.substr(text, slash + 1)
    fraction = F.try_divide(number(over), number(under))
    share = number(F.substr(text, F.lit(1), F.length(text) - 1)) / 100.0
    value = F.when(text.endswith("%"), share).when(slash > 0, fraction).otherwise(number(text))
    return F.nullif(F.nullif(value, F.lit(float("inf"))), F.lit(float("-inf")))


# -- names -------------------------------------------------------------------


def _after_dot(name: Column) -> Column:
    """How many characters follow the last dot of a name; null without one. A
    leading dot doesn't count."""
    after = F.length(F.substring_index(name, ".", -1))
    return F.when(F.length(name) - after > 1, after)


def extension(name: Column | str) -> Column:
    """What follows the last dot, lower-cased."""
    name = col(name)
    return F.when(_after_dot(name).isNotNull(), F.lower(F.substring_index(name, ".", -1)))


def kind(name: Column | str) -> Column:
    """``raw``, ``jpeg`` or ``png`` by extension, else null."""
    kinds = [F.lit(text) for which, exts in S.KINDS.items() for ext in exts for text in (ext, which)]
    return F.try_element_at(F.create_map(*kinds), extension(name))


def hidden(name: Column | str) -> Column:
    return col(name).startswith(".")


def base_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent(path: Column | str) -> Column:
    path = col(path)
    return F.substr(path, F.lit(1), F.length(path) - F.length(base_name(path)) - 1)


def stem(name: Column | str) -> Column:
    """A file's name without its extension."""
    name = col(name)
    return F.coalesce(F.substr(name, F.lit(1), F.length(name) - _after_dot(name) - 1), name)


def sidecar_path(path: Column | str, naming: str = "darktable") -> Column:
    """Where a picture's sidecar is: ``<path>.xmp``, or for a raw named the
    other way (``adobe``), the path with ``.xmp`` for its extension."""
    path = col(path)
    appended = F.concat(path, F.lit(".xmp"))
    if naming == "darktable":
        return appended
    if naming != "adobe":
        raise ValueError(f"no sidecar naming called {naming!r}")
    name = base_name(path)
    cut = F.substr(path, F.lit(1), F.length(path) - _after_dot(name) - 1)
    replaced = F.concat(F.coalesce(cut, path), F.lit(".xmp"))
    return F.when(kind(name).isin("jpeg", "png"), appended).otherwise(replaced)


# -- marks -------------------------------------------------------------------


def clamp_rating(rating: Column | str) -> Column:
    known = F.coalesce(col(rating), F.lit(S.UNDECIDED))
    return F.greatest(F.least(known, F.lit(S.STARS)), F.lit(S.REJECT)).cast("int")


def decision_kind(rating: Column | str) -> Column:
    """What a frame ended as: 0 rejected, 1 left, 2 kept."""
    return (F.signum(col(rating).cast("double")) + 1).cast("int")


def percent(n: Column | str, total: Column | str) -> Column:
    return F.round(100.0 * col(n) / F.greatest(col(total), F.lit(1))).cast("bigint")


# -- capture -----------------------------------------------------------------


def exif_seconds(captured: Column | str) -> Column:
    """``yyyy:MM:dd HH:mm:ss[.fff]`` in seconds since 1970, for gaps between
    frames. Months, days and hours out of range run over into the next."""
    captured = col(captured)

    def part(at: int, length: int) -> Column:
        return F.substr(captured, F.lit(at), F.lit(length))

    date = F.replace(part(1, 10), F.lit(":"), F.lit("-")).try_cast("date")
    clock = part(12, 2).try_cast("int") * 3600.0 + part(15, 2).try_cast("int") * 60.0
    usual = F.unix_date(date) * 86400.0 + clock + part(18, 20).try_cast("double")
    as_usual = captured.rlike(r"^[0-9]{4}:[0-9]{2}:[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,17})?$")
    return F.coalesce(F.when(as_usual, usual), _unusual_seconds(captured))


def _unusual_seconds(captured: Column) -> Column:
    space = F.instr(captured, " ")
    date = F.split(F.substr(captured, F.lit(1), space - 1), ":")
    clock = F.split(F.substr(captured, space + 1), ":")

    def whole(i: int) -> Column:
        part = F.get(date, F.lit(i))
        return F.when(part.rlike(_WHOLE), part.try_cast("int"))

    year, month, day = whole(0), whole(1), whole(2)
    days = _days(year.cast("long"), month.cast("long") - 1) + day - 1
    hour, minute, second = (number(F.get(clock, F.lit(i))) for i in range(3))
    return F.when(space > 0, days * 86400.0 + hour * 3600.0 + minute * 60.0 + second)


def _days(year: Column, month: Column) -> Column:
    """Days from 1970 to the first of a month counted from 0, any year and
    any month: whole numbers wide enough for all that a text can hold."""
    year, month = year + F.floor(month / 12), F.pmod(month, F.lit(12))
    # Years begin in March here, so that a leap day comes last.
    start = F.when(month < 2, year - 1).otherwise(year)
    leaps = F.floor(start / 4) - F.floor(start / 100) + F.floor(start / 400)
    return start * 365 + leaps + F.floor((F.pmod(month + 10, F.lit(12)) * 153 + 2) / 5) - 719468


def capture_text(date: Column | str, fraction: Column | str) -> Column:
    """A capture date with its fraction of a second; null for the blanks a
    camera with no clock set writes."""
    date, fraction = col(date), F.nullif(col(fraction), F.lit(""))
    return F.when(date.rlike("^[0-9]"), F.concat_ws(".", date, fraction))


def rational(n: Column | str, d: Column | str) -> Column:
    """n/d, null where d is 0."""
    return F.try_divide(col(n).cast("double"), F.nullif(col(d), F.lit(0)).cast("double"))


def shutter(exposure: Column | str) -> Column:
    """Exposure time in seconds of a ``struct<n,d>``."""
    exposure = col(exposure)
    return rational(exposure["n"], exposure["d"])


def upright(orientation: Column | str, u: Column | str, v: Column | str) -> Column:
    """Where a point (fractions of width and height) ends up once a frame
    stored with this orientation (1 to 8) is turned upright."""
    orientation, u, v = col(orientation), col(u), col(v)
    # From 5 up width and height change places; then each axis may flip.
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    x, y = F.when(turned, v).otherwise(u), F.when(turned, u).otherwise(v)
    return F.struct(
        F.when(orientation.isin(2, 3, 6, 7), 1.0 - x).otherwise(x).alias("x"),
        F.when(orientation.isin(3, 4, 7, 8), 1.0 - y).otherwise(y).alias("y"),
    )


def upright_size(orientation: Column | str, size: Column | str) -> Column:
    size, turned = col(size), F.coalesce(col(orientation), F.lit(1)) >= 5
    return F.struct(
        F.when(turned, size["h"]).otherwise(size["w"]).alias("w"),
        F.when(turned, size["w"]).otherwise(size["h"]).alias("h"),
    )


def focus_point(
    orientation: Column | str, focus: Column | str, manual: Column | None = None
) -> Column:
    """Where the camera focused, as fractions of the upright frame; null where
    it recorded no place (zeros) or the lens was focused by hand."""
    focus = col(focus)
    known = (focus["w"] > 0) & (focus["h"] > 0)
    if manual is not None:
        known = known & ~F.coalesce(manual, F.lit(False))
    at = upright(
        F.coalesce(col(orientation), F.lit(1)),
        rational(focus["x"], focus["w"]),
        rational(focus["y"], focus["h"]),
    )
    return F.when(known, at)


def adobe_rgb(color_space: Column | str, interop: Column | str) -> Column:
    """Exif's "uncalibrated", unless the interop index says sRGB."""
    uncalibrated = F.coalesce(col(color_space) == 0xFFFF, F.lit(False))
    return uncalibrated & ~F.coalesce(col(interop) == "R98", F.lit(False))


# -- keys --------------------------------------------------------------------


def fnv(text: Column | str) -> Column:
    """64-bit FNV-1a of text's UTF-8, as ``struct<hi,lo>`` of 32 bits each."""
    # A character a byte, and each by itself.
    bytes_ = F.split(F.decode(F.encode(col(text), "UTF-8"), "ISO-8859-1"), "")
    start = F.struct(*(F.lit(v).cast("bigint").alias(n) for n, v in zip(("hi", "lo"), _FNV_START)))

    def step(state: Column, byte: Column) -> Column:
        # A struct of the two halves, carried over where the low one is full.
        mixed = state["lo"].bitwiseXOR(F.ascii(byte).cast("bigint"))
        low = mixed * _FNV_PRIME_LOW
        high = (
            state["hi"] * _FNV_PRIME_LOW
            + F.shiftright(low, 32)
            + F.shiftleft(mixed, _FNV_PRIME_SHIFT)
        )
        return F.struct(high.bitwiseAND(_LOW).alias("hi"), low.bitwiseAND(_LOW).alias("lo"))

    return F.aggregate(F.filter(bytes_, lambda byte: byte != ""), start, step)


def fnv_hex(key: Column | str) -> Column:
    key = col(key)
    half = [F.lpad(F.lower(F.hex(key[part])), 8, "0") for part in ("hi", "lo")]
    return F.concat(*half)


def frame_key(path: Column | str, captured: Column | str) -> Column:
    """A frame's identity as one text: its path with its capture time, as
    paths alone are used again."""
    return F.concat(col(path), F.lit("|"), F.coalesce(col(captured), F.lit("")))


def cache_key(path: Column | str, size: Column | str, modified: Column | str, version: int) -> Column:
    """Changes when the file does, or how it's measured."""
    return F.xxhash64(col(path), col(size), col(modified), F.lit(version))


def portable_key(name: Column | str, size: Column | str, captured: Column | str) -> Column:
    """A file wherever it has been moved to."""
    return F.struct(col(name).alias("name"), col(size).alias("size"), col(captured).alias("captured"))
