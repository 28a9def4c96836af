"""Scalar functions of the expression language."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExpressionError

Scalar = Callable[..., Column]

#: Parts of a date that Spark counts or names otherwise.
_PARTS: dict[str, Callable[[Column], Column]] = {
    "epoch": F.unix_timestamp,
    "milliseconds": lambda c: F.unix_millis(c.cast("timestamp")) % 60_000,
    "microseconds": lambda c: F.unix_micros(c.cast("timestamp")) % 60_000_000,
    "dow": lambda c: F.dayofweek(c) - 1,
    "isodow": lambda c: F.weekday(c) + 1,
    "doy": F.dayofyear,
    "decade": lambda c: F.floor(F.year(c) / 10),
    "century": lambda c: F.ceil(F.year(c) / 100),
    "millennium": lambda c: F.ceil(F.year(c) / 1000),
    "isoyear": lambda c: F.extract(F.lit("yearofweek"), c),
}
_SPARK_PARTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def extract(part: str, column: Column) -> Column:
    """A part of a date or time as a whole number; Sunday is 0 as ``dow`` and 7 as ``isodow``."""
    make = _SPARK_PARTS.get(part.lower()) or _PARTS.get(part.lower())
    if make is None:
        raise ExpressionError(f"unknown part of a date '{part}'")
    return make(column)


def _trunc(x: Column, digits: Column | None = None) -> Column:
    scale = F.pow(F.lit(10.0), digits) if digits is not None else F.lit(1.0)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def _round(x: Column, digits: Column | None = None) -> Column:
    return F.round(x, digits) if digits is not None else F.round(x)


def _case(*args: Column) -> Column:
    """Conditions and values in turn, then what holds otherwise."""
    if len(args) < 2:
        raise ExpressionError("case needs a condition and a value")
    chain = None
    for condition, value in zip(args[0 : len(args) - 1 : 2], args[1::2], strict=False):
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(args[-1]) if len(args) % 2 else chain


SCALARS: dict[str, Scalar] = {
    "lower": F.lower, "upper": F.upper, "left": F.left, "right": F.right,
    "substr": lambda s, i, n=None: F.substr(s, i, n) if n is not None else F.substr(s, i),
    "lpad": lambda s, n, p=None: F.lpad(s, n, p if p is not None else F.lit(" ")),
    "rpad": lambda s, n, p=None: F.rpad(s, n, p if p is not None else F.lit(" ")),
    "replace": F.replace, "concat": lambda *a: F.concat_ws("", *a), "repeat": F.repeat, "position": F.position,
    "round": _round, "trunc": _trunc, "floor": F.floor, "ceil": F.ceil, "mod": lambda a, b: a % F.nullif(b, F.lit(0)),
    "remainder": lambda a, b: a - b * F.rint(F.try_divide(a, b)), "sign": F.signum, "min": F.least, "max": F.greatest,
    "pow": F.pow, "exp": F.exp, "log": F.log10, "log10": F.log10, "ln": F.log, "sqrt": F.sqrt, "cos": F.cos, "sin": F.sin, "tan": F.tan, "abs": F.abs,
    "coalesce": F.coalesce, "nullif": F.nullif, "case": _case, "if": lambda c, a, b: F.when(c, a).otherwise(b),
    "length": F.length, "trim": F.trim,
}

#: Names that stand for a value without being called.
VARIABLES: dict[str, Callable[[], Column]] = {
    "current_date": F.current_date,
    "local_date": F.current_date,
    "current_time": lambda: F.expr("current_time()"),
    "local_time": lambda: F.expr("current_time()"),
    "current_timestamp": F.current_timestamp,
}


def call(name: str, args: list[Column]) -> Column:
    make = SCALARS.get(name.lower())
    if make is None:
        raise ExpressionError(f"unknown function '{name}'")
    try:
        return make(*args)
    except TypeError as e:
        raise ExpressionError(f"{name} does not take {len(args)} values") from e


def mapped_function(name: str, column: Column) -> Column:
    """A function of one column that a mapping names: one of this module, a part of a date, or one that Spark has."""
    low = name.lower()
    if low in SCALARS:
        return SCALARS[low](column)
    if low in _SPARK_PARTS or low in _PARTS:
        return extract(low, column)
    return F.call_function(name, column)
