"""Ratings in XMP sidecar text: found, read, and changed in place.

A sidecar holds a whole edit, so only the characters of the rating's value are
ever replaced. Where they are is told by a parser that reads each text to its
end, batch by batch in Python: namespaces are those in scope, what comments
and CDATA sections hold doesn't count, and a text that isn't well-formed is
left alone.
"""

from __future__ import annotations

import re
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from framesift.functions.scalars import bind, col

# The namespaces.
XMP_NAMESPACE = "http://ns.adobe.com/xap/1.0/"
RDF_NAMESPACE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_WHOLE = r"^[ \t-\r]*[+-]?[0-9]+[ \t-\r]*$"
_NAME = re.compile(rb"<[^\s/>]+")
_ATTRIBUTE = re.compile(rb"""\s+([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*')""")
_PLACE = T.StructType([
    T.StructField("writable", T.BooleanType()), T.StructField("at", T.IntegerType()), T.StructField("length", T.IntegerType()),
    T.StructField("value", T.StringType()), T.StructField("declared", T.BooleanType()), T.StructField("problem", T.StringType()),
])


def _whole(value: Column) -> Column:
    digits = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.when(digits.rlike(r"^[+-]?[0-9]+$"), digits.try_cast("int"))


class _Reader:
    """The first rating of a text and its first description, as byte offsets."""

    def __init__(self, data: bytes):
        self.data = data
        self.prefixes: dict[str | None, list[str | None]] = {}
        self.description: tuple[int, str | None] | None = None  # where its name ends, what xmp: means there
        self.found: tuple[int, int, str] | None = None  # start, end, attribute or element
        self.within: int | None = None  # where the open rating element's content starts
        self.parser = expat.ParserCreate(encoding="utf-8", namespace_separator=" ")
        self.parser.StartNamespaceDeclHandler = lambda prefix, uri: self.prefixes.setdefault(prefix, []).append(uri)
        self.parser.EndNamespaceDeclHandler = lambda prefix: self.prefixes[prefix].pop()
        self.parser.StartElementHandler = self.start
        self.parser.EndElementHandler = self.end
        self.parser.Parse(data, True)

    def meaning(self, prefix: str | None) -> str | None:
        bound = self.prefixes.get(prefix)
        return bound[-1] if bound else None

    def start(self, name: str, _: dict) -> None:
        if name not in (f"{RDF_NAMESPACE} Description", f"{XMP_NAMESPACE} Rating"):
            return
        tag = _NAME.match(self.data, self.parser.CurrentByteIndex)
        if tag is None:  # it comes out of an entity, and has no place in the text
            return
        at = tag.end()
        ours = name.startswith(XMP_NAMESPACE)
        if not ours and self.description is None:
            self.description = (at, self.meaning("xmp"))
        while found := _ATTRIBUTE.match(self.data, at):
            prefix, colon, local = found[1].decode().partition(":")
            if not ours and self.found is None and colon and local == "Rating" and self.meaning(prefix) == XMP_NAMESPACE:
                self.found = (found.start(2) + 1, found.end(2) - 1, "attribute")
            at = found.end()
        if ours and self.found is None:
            end = self.data.index(b">", at) + 1
            if self.data[end - 2 : end] == b"/>":
                self.found = (end, end, "empty")
            else:
                self.within = end

    def end(self, name: str) -> None:
        if self.within is not None and name == f"{XMP_NAMESPACE} Rating":
            self.found = self.found or (self.within, self.parser.CurrentByteIndex, "element")
            self.within = None


def _read(text: str) -> dict:
    """One text's place; see :func:`place`."""
    data = text.encode("utf-8", "surrogatepass")
    mark = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    out = dict.fromkeys(("at", "value", "problem")) | {"writable": False, "length": 0, "declared": False}
    try:
        reader = _Reader(data[mark:])
    except expat.ExpatError:
        return out | {"problem": "the text isn't well-formed XML"}

    def chars(at: int) -> int:
        return len(data[: mark + at].decode()) + 1

    if reader.description is not None:
        out["declared"] = reader.description[1] == XMP_NAMESPACE
    if reader.found is not None:
        start, end, kind = reader.found
        value = data[mark + start : mark + end].decode()
        out |= {"at": chars(start), "value": value, "length": len(value)}
        # A value can be replaced whatever it is, but an element must hold one, and nothing else.
        out["writable"] = kind == "attribute" or value != "" and "<" not in value
        if kind == "empty":
            out["problem"] = "the rating element holds nothing"
        elif not re.search(_WHOLE, value):
            out["problem"] = "the rating is no whole number"
    elif reader.description is None:
        out["problem"] = "nothing in the text describes a resource"
    else:
        at, meaning = reader.description
        out |= {"at": chars(at), "writable": meaning in (None, XMP_NAMESPACE)}
        if not out["writable"]:
            out["problem"] = "the prefix xmp is bound to another namespace"
    return out


@F.arrow_udf(_PLACE)
def _places(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else _read(t) for t in texts.to_pylist()], to_arrow_type(_PLACE))


def place(xmp: Column | str) -> Column:
    """Where the rating is, or would go: ``struct<writable, at, length, value,
    declared, problem>``. ``value`` is null where there is no rating yet, and
    then ``declared`` says whether ``xmp:`` means XMP already."""
    return _places(col(xmp))


def rating_at(found: Column | str) -> Column:
    """The rating at a :func:`place`, ``struct<rating, problem>``: rating is
    null where there's none or it can't be read, and problem says which."""
    found = col(found)
    value = F.when(found["problem"].isNull(), _whole(found["value"]))
    return F.struct(value.alias("rating"), found["problem"].alias("problem"))


def rating(xmp: Column | str) -> Column:
    return bind(place(xmp), rating_at)


def changes(found: Column | str, mark: Column | str) -> Column:
    """Whether writing a mark at a :func:`place` makes another text."""
    return ~col(found)["value"].eqNullSafe(col(mark).cast("string"))


def with_rating_at(xmp: Column | str, found: Column | str, mark: Column | str) -> Column:
    """The text with its rating changed and everything else as it was; null
    where there's no telling where it goes. A value that isn't a number can
    still be replaced."""
    xmp, found, mark = col(xmp), col(found), col(mark).cast("string")
    declaration = F.when(found["declared"], "").otherwise(f' xmlns:xmp="{XMP_NAMESPACE}"')
    added = F.concat(declaration, F.lit(' xmp:Rating="'), mark, F.lit('"'))
    new = F.when(found["value"].isNull(), added).otherwise(mark)
    head = F.substr(xmp, F.lit(1), found["at"] - 1)
    tail = F.substr(xmp, found["at"] + found["length"])
    return F.when(found["writable"], F.concat(head, new, tail))


def with_rating(xmp: Column | str, mark: Column | str) -> Column:
    return bind(place(xmp), lambda found: with_rating_at(xmp, found, mark))


def fresh(mark: Column | str) -> Column:
    """A sidecar that holds a rating and nothing else."""
    return F.concat(
        F.lit(
            '<?xml version="1.0" encoding="UTF-8"?>\n'
            '<x:xmpmeta xmlns:x="adobe:ns:meta/" x:xmptk="framesift">\n'
            f' <rdf:RDF xmlns:rdf="{RDF_NAMESPACE}">\n'
            f'  <rdf:Description rdf:about="" xmlns:xmp="{XMP_NAMESPACE}" xmp:Rating="'
        ),
        col(mark).cast("string"),
        F.lit('"/>\n </rdf:RDF>\n</x:xmpmeta>\n'),
    )
