"""The dialect's scalar operators as Column expressions, and its type families.

Everything stays in built-in expressions, so it is pushed down and compiled like any other.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of values; the numeric ones are of one family.
INT, FLOAT, STRING, BOOLEAN, TEMPORAL, NULL, OTHER = "int", "float", "string", "boolean", "temporal", "null", "other"


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.IntegralType):
        return INT
    if isinstance(data_type, T.NumericType):
        return FLOAT
    if isinstance(data_type, T.StringType):
        return STRING
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    return NULL if isinstance(data_type, T.NullType) else OTHER


def family(kind: str) -> str:
    return "numeric" if kind in (INT, FLOAT) else kind


def int_divide(a: Column, b: Column, result: str | None = None) -> Column:
    """Division that truncates toward zero; dividing by zero is an error. ``result``: the type to give back."""
    q = F.call_function("div", a, b)
    return q.cast(result) if result else q


def int_modulo(a: Column, b: Column) -> Column:
    """The remainder with the dividend's sign; by zero is an error."""
    return a % b


COMPARISONS: dict[str, Callable] = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(op: str, a: Column, b: Column) -> Column:
    """Null if either side is; false before true; strings by bytes."""
    return COMPARISONS[op](a, b)


def negate(a: Column) -> Column:
    return -a


def null_safe_predicate(p: Column) -> Column:
    """Null counts as false, also under a negation around it."""
    return F.coalesce(p, F.lit(False))


def avg_truncated(a: Column) -> Column:
    """Mean of integers, truncated toward zero; null without a value."""
    return F.call_function("div", F.sum(a), F.nullif(F.count(a), F.lit(0)))
