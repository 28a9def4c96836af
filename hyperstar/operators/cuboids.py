"""Combinations of dimensions and levels, and aggregates made ahead."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError
from ..functions.aggregates import REAGGREGATED, canonical
from ..model import Cube, Dimension
from ..plans.cells import Cell
from ..plans.drilldown import Drilldown
from .browser import Browser


def combined_cuboids(dimensions: Iterable, required: Iterable = ()) -> list[tuple]:
    """All sets of dimensions, but the empty one, that hold the required ones; larger sets last."""
    every, must = list(dimensions), list(required)
    if missing := [d for d in must if d not in every]:
        raise ArgumentError(f"required but not among the dimensions: {missing}")
    rest = [d for d in every if d not in must]
    sets = [(*must, *extra) for n in range(len(rest) + 1) for extra in combinations(rest, n)]
    return [tuple(d for d in every if d in s) for s in sets if s]


def combined_levels(dimensions: Iterable[Dimension], default_only: bool = False) -> list[tuple]:
    """For each dimension every (dimension, hierarchy, level), combined with those of all others."""
    each = []
    for d in dimensions:
        hierarchies = [d.hierarchy()] if default_only else d.hierarchies.values()
        each.append([(d.name, h.name, level.name) for h in hierarchies for level in h.levels])
    return list(product(*each))


def hierarchical_cuboids(dimensions: Iterable[Dimension], required: Iterable[Dimension] = (), default_only: bool = False) -> list[tuple]:
    """Every combination of levels of every set of dimensions."""
    every = list(dimensions)
    by_name = {d.name: d for d in every}
    return [levels for s in combined_cuboids([d.name for d in every], [d.name for d in required]) for levels in combined_levels([by_name[n] for n in s], default_only)]


def grouping_sets(browser: Browser, cell, aggregates, drilldowns: list[list]) -> DataFrame:
    """Several drilldowns of one cell from a single pass over the star, told apart by ``__set__``; attributes that a drilldown does not have are null in its rows."""
    cell = browser.cell(cell)
    chosen = browser.prepare_aggregates(aggregates)
    drills = [Drilldown(d, cell) for d in drilldowns]
    attributes = list({a.ref: a for d in drills for a in d.attributes}.values())
    needed = [*attributes, *browser.star.cell_attributes(cell), *browser._aggregate_inputs(chosen)]
    df = browser.star.frame(needed)
    condition = browser.star.condition(cell)
    df = df.where(condition) if condition is not None else df
    keys = {a.ref: f"k{i}" for i, a in enumerate(attributes)}
    named = df.withColumns({keys[a.ref]: browser.star.column(a) for a in attributes})
    sets = [[F.col(keys[a.ref]) for a in d.attributes] for d in drills]
    made = [c.alias(n) for n, c in browser.aggregate_columns(chosen).items()]
    out = named.groupingSets(sets, *map(F.col, keys.values())).agg(F.grouping_id().alias("__grouping__"), *made)
    ids = [sum(1 << (len(keys) - 1 - i) for i, ref in enumerate(keys) if ref not in {a.ref for a in d.attributes}) for d in drills]
    which = F.array_position(F.array(*map(F.lit, ids)), F.col("__grouping__").cast("int")) - 1
    return out.select(which.cast("int").alias("__set__"), *(F.col(k).alias(ref) for ref, k in keys.items()), *(F.col(f"`{a.name}`") for a in chosen))


def can_reaggregate(cube: Cube, names: Iterable[str]) -> bool:
    """Whether coarser values of these aggregates follow from finer ones."""
    return all((a := cube.aggregate(n)).function and canonical(a.function) in REAGGREGATED for n in names)


def cuboid(browser: Browser, dimensions: Iterable[str] | None = None, aggregates=None) -> DataFrame:
    """All aggregates at the deepest level of each dimension, columns named by reference; what a pre-aggregated table holds."""
    names = list(dimensions or browser.cube.dimensions)
    cell = Cell(browser.cube)
    drill = Drilldown([browser.cube.dimension(n) for n in names], cell)
    return browser.grouped(cell, browser.prepare_aggregates(aggregates), drill)


class CuboidRewriter:
    """Answers aggregations from a pre-aggregated table where it can: its columns have every attribute that is asked for or cut, and the aggregates follow from finer ones."""

    def __init__(self, browser: Browser, table: DataFrame):
        self.browser, self.table = browser, table

    def covers(self, cell: Cell, drilldown: Drilldown, aggregates: list[str]) -> bool:
        needed = {a.ref for a in (*drilldown.attributes, *self.browser.star.cell_attributes(cell))} | set(aggregates)
        return needed <= set(self.table.columns) and can_reaggregate(self.browser.cube, aggregates)

    def grouped(self, cell=None, drilldown=None, aggregates=None) -> DataFrame:
        """The cells, from the table if it covers them, else from the star."""
        b = self.browser
        cell = b.cell(cell)
        drill = Drilldown(drilldown, cell)
        chosen = b.prepare_aggregates(aggregates)
        if not self.covers(cell, drill, [a.name for a in chosen]):
            return b.grouped(cell, chosen, drill)
        wide = Browser(b.cube, lambda name, schema: self.table, mapper=_wide(b), **b.options)
        condition = wide.star.condition(cell)
        df = self.table.alias(wide.star.fact_name)
        df = df.where(condition) if condition is not None else df
        made: list[Column] = [REAGGREGATED[canonical(a.function)](F.col(f"`{a.name}`")).alias(a.name) for a in chosen]
        keys = [F.col(f"`{a.ref}`") for a in drill.attributes]
        return df.groupBy(*keys).agg(*made) if keys else df.agg(*made)


def _wide(browser: Browser):
    from ..plans.mapping import WideMapper

    return WideMapper(browser.cube, browser.mapper.naming, browser.locale)
