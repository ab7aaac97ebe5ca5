"""Text functions. A null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring(c: Column, start: int, end: int | None = None) -> Column:
    """From start (0 is the first), up to but without end; negative numbers count from the end."""
    n = F.length(c)
    place = lambda x: F.greatest(F.lit(0), n + x) if x < 0 else F.least(F.lit(x), n)
    lo, hi = place(start), n if end is None else place(end)
    return F.substring(c, lo + 1, F.greatest(F.lit(0), hi - lo))


def concat(c: Column, *others: Column | str) -> Column:
    """Nulls count as nothing, unless all are null."""
    parts = [c, *(F.lit(o) if isinstance(o, str) else o for o in others)]
    some = parts[0].isNotNull()
    for p in parts[1:]:
        some = some | p.isNotNull()
    return F.when(some, F.concat_ws("", *parts))


def length(c: Column) -> Column:
    return F.length(c)


def to_upper(c: Column) -> Column:
    return F.upper(c)


def to_lower(c: Column) -> Column:
    return F.lower(c)


def trim(c: Column) -> Column:
    return F.trim(c)


def l_trim(c: Column) -> Column:
    return F.ltrim(c)


def r_trim(c: Column) -> Column:
    return F.rtrim(c)


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def split(c: Column, separator: str) -> Column:
    """The parts between occurrences of a plain text."""
    return F.split(c, "\\Q" + separator + "\\E")


def reverse(c: Column) -> Column:
    return F.reverse(c)


def as_string(c: Column) -> Column:
    return c.cast("string")


def format_(template: str, **columns: Column) -> Column:
    """`%{name}` replaced by the columns; null if one is null."""
    import re

    parts = [F.lit(x) if i % 2 == 0 else columns[x].cast("string") for i, x in enumerate(re.split(r"%\{(\w+)\}", template))]
    return F.concat(*parts)


def local(f, c: Column) -> Column:
    """The function for each item of a list."""
    return F.transform(c, f)
