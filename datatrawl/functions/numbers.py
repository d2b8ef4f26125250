"""Coordinates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datatrawl import fixed

_NUMBER = r"^-?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?[fFdD]?\z"
_BLANKS = "".join(chr(c) for c in range(33))


def trimmed(text: Column) -> Column:
    """Without control characters and blanks at both ends."""
    return F.btrim(text, F.lit(_BLANKS))


def coordinate(text: Column) -> Column:
    """The 32-bit number that the trimmed text spells, null if it is none or out of range."""
    bare = trimmed(text)
    value = F.regexp_replace(bare, "[fFdD]$", "").try_cast("float")
    limit = F.lit(fixed.COORDINATE_LIMIT).cast("float")
    return F.when(bare.rlike(_NUMBER) & value.between(-limit, limit), value)
