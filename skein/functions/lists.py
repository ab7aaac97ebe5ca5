"""Functions of lists. A null list gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def combine(a: Column, b: Column) -> Column:
    """One after the other, repeats kept."""
    return F.concat(a, b)


def merge(a: Column, b: Column) -> Column:
    """The set of both."""
    return F.array_union(a, b)


def intersect(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def disjunct(a: Column, b: Column) -> Column:
    """What only one of them holds."""
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def product(a: Column, b: Column) -> Column:
    """All pairs."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array(x, y))))


def conjoin(a: Column, separator: str) -> Column:
    return F.array_join(a, separator)


def reverse(a: Column) -> Column:
    return F.reverse(a)
