"""Predicates over declared fields, as a tree that turns into one Column."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of comparisons and their SQL operators, both ways.
OPERATORS = {"eq": "=", "ne": "<>", "lt": "<", "gt": ">", "lte": "<=", "gte": ">="}
NAMES = {sql: name for name, sql in OPERATORS.items()}

#: Turns a field into a column of the plan it is used in.
Resolve = Callable[["Operand"], Column]


class Expression:
    def __init__(self, build: Callable[[Resolve], Column], members: tuple = ()):
        self.build = build
        #: (operand, subquery) pairs, which the plan turns into semi joins.
        self.members = members

    def __and__(self, other: Expression) -> Expression:
        return Expression(lambda r: self.build(r) & other.build(r), self.members + other.members)

    def __or__(self, other: Expression) -> Expression:
        if self.members or other.members:
            raise ValueError("membership in a query can only be combined with &")
        return Expression(lambda r: self.build(r) | other.build(r))


class Operand:
    """What comparisons start from: a field, or a field of an alias."""

    def check(self, value) -> None: ...

    def _wrap(self, value) -> Callable[[Resolve], Column]:
        if isinstance(value, Operand):
            return lambda r: r(value)
        self.check(value)
        return lambda r: F.lit(value)

    def _compare(self, other, op) -> Expression:
        right = self._wrap(other)
        return Expression(lambda r: op(r(self), right(r)))

    __hash__ = object.__hash__

    def __eq__(self, other):
        return self._compare(other, operator.eq)

    def __ne__(self, other):
        return self._compare(other, operator.ne)

    def __gt__(self, other):
        return self._compare(other, operator.gt)

    def __lt__(self, other):
        return self._compare(other, operator.lt)

    def __ge__(self, other):
        return self._compare(other, operator.ge)

    def __le__(self, other):
        return self._compare(other, operator.le)

    def between(self, low, high) -> Expression:
        """Inclusive at both ends."""
        a, b = self._wrap(low), self._wrap(high)
        return Expression(lambda r: r(self).between(a(r), b(r)))

    def found_in(self, values) -> Expression:
        """Membership in a collection, or in the first column of a query or DataFrame."""
        if isinstance(values, DataFrame) or hasattr(values, "df"):
            return Expression(lambda r: F.lit(True), ((self, values),))
        values = list(values)
        for v in values:
            self.check(v)
        return Expression(lambda r: r(self).isin(values) if values else F.lit(False))
