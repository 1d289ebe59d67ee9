"""Column functions on parameter texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sampleloom.functions.values import col

# Unit words that may follow a number.
UNITS = ["x", "%", "*", ",", ".", "hz", "ms", "db", "sec", "dbtp", "seconds"]
#: A number as a float parser takes it; Java's own also takes a type letter at the end.
_NUMBER = r"^[+-]?(?:(?:\d+(?:_?\d+)*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|inf|infinity|nan)$"


def _strip_units(c: Column) -> Column:
    """All trailing unit words, any case, with the white space between them."""
    words = "|".join("".join("\\" + x if not x.isalnum() else x for x in u) for u in sorted(UNITS, key=len, reverse=True))
    return F.regexp_replace(F.trim(c), f"(?i)(?:\\s*(?:{words}))+$", "")


def _is_number(c: Column) -> Column:
    return c.rlike("(?i)" + _NUMBER)


def parse_unit_number(text: Column | str) -> Column:
    """`12 Hz` -> `12`, `1.5 kHz` -> `1500.0`; a kHz text without a number stays as it is."""
    c = F.trim(col(text))
    head = F.trim(F.regexp_replace(c, "(?i)khz$", ""))
    thousand = F.when(_is_number(head), (head.try_cast("double") * 1000).cast("string")).otherwise(c)
    return F.when(c.rlike("(?i)khz$"), thousand).otherwise(_strip_units(c))


def looks_like_number(text: Column | str) -> Column:
    return F.coalesce(_is_number(F.trim(parse_unit_number(text))), F.lit(False))


def number_of(text: Column | str) -> Column:
    """The number in a text with units, or null."""
    c = parse_unit_number(text)
    return F.when(_is_number(c), c.try_cast("double"))


def normalize_name(text: Column | str) -> Column:
    """A parameter's name as an identifier: sharps and flats spelt out, all else that is no ASCII letter or digit an underscore."""
    c = F.lower(F.trim(col(text)))
    for sign, word in (("#", "_sharp"), ("♯", "_sharp"), ("♭", "_flat")):
        c = F.replace(c, F.lit(sign), F.lit(word))
    return F.btrim(F.regexp_replace(c, "[^a-z0-9]+", "_"), F.lit("_"))
