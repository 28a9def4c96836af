"""Moving calculations over the cells of a result.

Each looks at the last N values that are not null, in the order of the result,
per partition. Rows whose own value is null repeat what was there before. All
work is a bounded frame over the (already aggregated) cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import ArgumentError, ModelError


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _mean(x: Column) -> Column:
    return _sum(x) / F.size(x)


def _variance(x: Column) -> Column:
    """Of a sample; 0 for a single value."""
    squares = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - _mean(x)) * (v - _mean(x)))
    return F.when(F.size(x) > 1, squares / (F.size(x) - 1)).otherwise(0.0)


def _weighted(x: Column) -> Column:
    """The oldest value weighs 1, the next 2 and so on."""
    n = F.size(x)
    return _sum(F.transform(x, lambda v, i: v * (i + 1))) / (n * (n + 1) / 2)


#: values of the window, oldest first -> result
WINDOWS: dict[str, Callable[[Column], Column]] = {
    "wma": lambda x: F.bround(_weighted(x), 4),
    "sma": lambda x: F.bround(_mean(x), 2),
    "sms": _sum,
    "smvar": lambda x: F.bround(_variance(x), 2),
    "smstd": lambda x: F.bround(F.sqrt(_variance(x)), 2),
    "smrsd": lambda x: F.bround(F.when(_mean(x) > 0, F.sqrt(_variance(x)) / _mean(x)).otherwise(0.0), 4),
}
LABELS = {
    "wma": "Weighted moving average of {}", "sma": "Simple moving average of {}", "sms": "Simple moving sum of {}", "smvar": "Simple moving variance of {}",
    "smstd": "Simple moving standard deviation of {}", "smrsd": "Simple moving relative standard deviation of {}",
}


def known(name: str | None) -> bool:
    return bool(name) and name.lower() in WINDOWS


def window_size(size) -> int:
    if size is None:
        return 1
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise ModelError(f"a window's size is a whole number from 1: {size!r}")
    return size


def moving(name: str, value: Column, size: int, partition: list[Column], order: list[Column]) -> Column:
    if not known(name):
        raise ArgumentError(f"unknown moving function '{name}'")
    keys = partition or [F.lit(1)]
    given = Window.partitionBy(*keys, value.isNull()).orderBy(*order).rowsBetween(1 - size, 0)
    return F.when(value.isNotNull(), WINDOWS[name.lower()](F.collect_list(value.cast("double")).over(given)))


def carried(value: Column, partition: list[Column], order: list[Column]) -> Column:
    """The value, or where it is null the last one before."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*(partition or [F.lit(1)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
