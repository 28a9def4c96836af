"""Aggregate functions.

With ``coalesce`` (the default of requests) nulls count as zero: sums of nothing
are 0, and minimum, maximum, average and deviation take null values as 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArgumentError, ModelError

#: (measure, fact key, coalesce) -> aggregate
Aggregate = Callable[[Column | None, Column, bool], Column]


def _zero(make: Callable[[Column], Column]) -> Aggregate:
    return lambda m, key, coalesce: make(F.coalesce(m, F.lit(0)) if coalesce else m)


AGGREGATES: dict[str, Aggregate] = {
    "sum": lambda m, key, coalesce: F.coalesce(F.sum(m), F.lit(0)) if coalesce else F.sum(m),
    "count": lambda m, key, coalesce: F.count(key),
    "count_nonempty": lambda m, key, coalesce: F.count(m),
    "count_distinct": lambda m, key, coalesce: F.count_distinct(m),
    "min": _zero(F.min),
    "max": _zero(F.max),
    "avg": _zero(F.avg),
    "stddev": _zero(F.stddev_samp),
    "variance": _zero(F.var_samp),
    # Beyond the usual: bounded-memory answers for very many values.
    "approx_count_distinct": lambda m, key, coalesce: F.approx_count_distinct(m),
    "approx_median": lambda m, key, coalesce: F.percentile_approx(m, 0.5),
}
ALIASES = {"average": "avg", "mean": "avg"}

#: Can be computed from finer values of themselves: how.
REAGGREGATED: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "count": F.sum, "count_nonempty": F.sum, "min": F.min, "max": F.max}


def register(name: str, build: Aggregate) -> None:
    """Adds a function, for instance a grouped Pandas UDF."""
    AGGREGATES[name.lower()] = build


def known(name: str) -> bool:
    return canonical(name) in AGGREGATES


def canonical(name: str) -> str:
    return ALIASES.get(name.lower(), name.lower())


def aggregate(name: str, measure: Column | None, key: Column, coalesce: bool = True) -> Column:
    low = canonical(name)
    if low not in AGGREGATES:
        raise ArgumentError(f"unknown aggregate function '{name}'")
    if measure is None and low != "count":
        raise ModelError(f"aggregate function '{name}' needs a measure")
    return AGGREGATES[low](measure, key, coalesce)
