"""The pixel expression language: each operation makes a Column, and Spark runs the whole expression at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldmark.functions.text import _col


def _value(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def add(*xs) -> Column:
    return reduce(lambda a, b: a + b, map(_value, xs))


def sub(*xs) -> Column:
    return reduce(lambda a, b: a - b, map(_value, xs))


def mul(*xs) -> Column:
    return reduce(lambda a, b: a * b, map(_value, xs))


def div(*xs) -> Column:
    """Null where a divisor is 0."""
    return reduce(F.try_divide, map(_value, xs))


def maximum(*xs) -> Column:
    return F.greatest(*map(_value, xs))


def minimum(*xs) -> Column:
    return F.least(*map(_value, xs))


def power(a, b) -> Column:
    return F.pow(_value(a), _value(b))


def log(a) -> Column:
    return F.ln(_value(a))


def exp(a) -> Column:
    return F.exp(_value(a))


def when(condition, then, otherwise) -> Column:
    """IF, THEN, ELSE; a number counts as true unless 0."""
    return F.when(_truth(condition), _value(then)).otherwise(_value(otherwise))


def equal(a, b) -> Column:
    return _value(a) == _value(b)


def less(a, b) -> Column:
    return _value(a) < _value(b)


def greater(a, b) -> Column:
    return _value(a) > _value(b)


def _truth(x) -> Column:
    x = _value(x)
    return F.coalesce(x.cast("boolean"), F.lit(False))


def both(*xs) -> Column:
    return reduce(lambda a, b: a & b, map(_truth, xs))


def either(*xs) -> Column:
    return reduce(lambda a, b: a | b, map(_truth, xs))


def one_of(*xs) -> Column:
    """Exclusive or."""
    return reduce(lambda a, b: a != b, map(_truth, xs))


def negated(x) -> Column:
    return ~_truth(x)


def let(bindings: dict[str, object], body: Callable[..., Column]) -> Callable[[DataFrame, str], DataFrame]:
    """Named subexpressions, each computed once: let(...)(df, name) adds the body's value as a column."""

    def into(df: DataFrame, name: str) -> DataFrame:
        held = {}
        for key, value in bindings.items():
            df = df.withColumn(f"_{key}", value(**held) if callable(value) and not isinstance(value, Column) else _value(value))
            held[key] = F.col(f"_{key}")
        return df.withColumn(name, body(**held)).drop(*[f"_{k}" for k in held])

    return into


def compute(df: DataFrame, name: str, value: Column, kind: str = "double") -> DataFrame:
    """df with the value of an expression in a column."""
    return df.withColumn(name, _col(value).cast(kind))


def hierarchy(df: DataFrame) -> str:
    """The plan that Spark makes of the expressions."""
    return df._jdf.queryExecution().toString()
