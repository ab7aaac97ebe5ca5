"""Predicates over columns. A null never satisfies one, nor its negation."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class P:
    """A test of a column; combine with &, | and ~."""

    test: Callable[[Column], Column]
    #: Of a comparison: the operator and what it compares with, which `where` takes as a mark.
    pair: tuple[Callable[[Any, Any], Column], Any] | None = None

    def __call__(self, c: Column) -> Column:
        """Null for a null, which a filter takes as false: so it can be pushed into a scan."""
        return self.test(c)

    def __and__(self, other: P) -> P:
        return P(lambda c: self(c) & other(c))

    def __or__(self, other: P) -> P:
        return P(lambda c: self(c) | other(c))

    def __invert__(self) -> P:
        return P(lambda c: c.isNotNull() & ~self(c))

    negate = __invert__

    @staticmethod
    def eq(x) -> P:
        return P(lambda c: c == x, (operator.eq, x))

    @staticmethod
    def neq(x) -> P:
        return P(lambda c: c != x, (operator.ne, x))

    @staticmethod
    def lt(x) -> P:
        return P(lambda c: c < x, (operator.lt, x))

    @staticmethod
    def lte(x) -> P:
        return P(lambda c: c <= x, (operator.le, x))

    @staticmethod
    def gt(x) -> P:
        return P(lambda c: c > x, (operator.gt, x))

    @staticmethod
    def gte(x) -> P:
        return P(lambda c: c >= x, (operator.ge, x))

    @staticmethod
    def between(lo, hi) -> P:
        """From lo, up to but without hi."""
        return P(lambda c: (c >= lo) & (c < hi))

    @staticmethod
    def inside(lo, hi) -> P:
        return P(lambda c: (c > lo) & (c < hi))

    @staticmethod
    def outside(lo, hi) -> P:
        return P(lambda c: (c < lo) | (c > hi))

    @staticmethod
    def within(*xs) -> P:
        return P(lambda c: c.isin(*xs) if xs else F.lit(False))

    @staticmethod
    def without(*xs) -> P:
        return P(lambda c: c.isNotNull() & ~c.isin(*xs) if xs else c.isNotNull())


class TextP:
    """Predicates over texts."""

    @staticmethod
    def starting_with(x: str) -> P:
        return P(lambda c: c.startswith(x))

    @staticmethod
    def not_starting_with(x: str) -> P:
        return ~TextP.starting_with(x)

    @staticmethod
    def ending_with(x: str) -> P:
        return P(lambda c: c.endswith(x))

    @staticmethod
    def not_ending_with(x: str) -> P:
        return ~TextP.ending_with(x)

    @staticmethod
    def containing(x: str) -> P:
        return P(lambda c: c.contains(x))

    @staticmethod
    def not_containing(x: str) -> P:
        return ~TextP.containing(x)

    @staticmethod
    def regex(x: str) -> P:
        return P(lambda c: c.rlike(x))

    @staticmethod
    def not_regex(x: str) -> P:
        return ~TextP.regex(x)


def as_predicate(x) -> P:
    return x if isinstance(x, P) else P.eq(x)
