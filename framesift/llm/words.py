"""Words as every operator here counts them: runs of anything but ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[ \t-\r]+"
WORD = r"[^ \t-\r]+"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.filter(F.split(text_or_empty(text), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many words a text has, without making them all."""
    return F.size(words(text)).cast("long")
