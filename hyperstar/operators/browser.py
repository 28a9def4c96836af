"""The browser: aggregates, facts, members, details and reports of one cube."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ArgumentError, HierarchyError, NoSuchAttributeError
from ..functions import aggregates as functions
from ..functions import windows
from ..model import Attribute, Cube, MeasureAggregate
from ..model.attributes import in_order_of_dependency
from ..model.cube import check_direction
from ..plans.calendar import Calendar
from ..plans.cells import Cell, Cut, PointCut, RangeCut, SetCut, cut_from_dict, cuts_from_string
from ..plans.drilldown import Drilldown
from ..plans.expressions import names, to_column
from ..plans.mapping import Mapper, Naming
from ..plans.star import FACT_KEY, SPLIT, Star, Tables
from .result import AggregationResult


_PAGE = {"order", "page", "page_size"}
#: What the queries of a report take.
REPORT_ARGUMENTS = {
    "aggregate": {"aggregates", "drilldown", "split", "measures"} | _PAGE,
    "facts": {"fields", "fact_list"} | _PAGE,
    "fact": {"key", "fields"},
    "members": {"dimension", "depth", "level", "hierarchy", "attributes"} | _PAGE,
    "values": {"dimension", "depth", "level", "hierarchy", "attributes"} | _PAGE,
    "details": {"dimension"},
    "cell": set(),
}


class Browser:
    """Queries one cube. Plans are built on the driver from Columns; nothing runs before a result is fetched.

    Options: ``coalesce`` (nulls count as zero in aggregates, by default),
    ``include_summary``, ``include_cell_count``, ``exclude_null_aggregates``,
    ``safe_labels`` (facts with columns a0, a1 ...).
    """

    #: The cell that details of members are looked up in; None for all members.
    visible: Cell | None = None

    def __init__(self, cube: Cube, tables: Tables, *, statements: dict[str, DataFrame] | None = None, locale: str | None = None, calendar: Calendar | None = None, mapper: Mapper | None = None, naming: Naming | None = None, **options):
        self.cube, self.locale, self.calendar, self.options = cube, locale, calendar or Calendar(), options
        self.mapper = mapper or Mapper(cube, naming or Naming.from_options(options), locale)
        self.star = Star(cube, self.mapper, tables, statements)
        self.coalesce = options.get("coalesce", True)
        self.include_summary = options.get("include_summary", True)
        self.include_cell_count = options.get("include_cell_count", True)
        self.exclude_null_aggregates = options.get("exclude_null_aggregates", False)

    def features(self) -> dict:
        return {"actions": ["aggregate", "facts", "fact", "members", "cell", "report"], "aggregate_functions": sorted(functions.AGGREGATES), "post_aggregate_functions": sorted(windows.WINDOWS)}

    # Arguments

    def cell(self, cell: Cell | str | Iterable | None = None) -> Cell:
        """A cell from a text of cuts, cuts or dictionaries of cuts. Words of relative time become paths."""
        if isinstance(cell, Cell):
            return Cell(self.cube, cell.cuts)
        if isinstance(cell, str):
            roles = {r: self.calendar.convert for r in ("time", "date")}
            return Cell(self.cube, cuts_from_string(cell, self.cube, role_converters=roles))
        return Cell(self.cube, [c if isinstance(c, Cut) else cut_from_dict(c, self.cube) for c in cell or ()])

    def prepare_aggregates(self, aggregates=None, measures=None) -> list[MeasureAggregate]:
        """The aggregates asked for, by name or by measure, all by default; with those that they build on, which come first."""
        if aggregates and measures:
            raise ArgumentError("both aggregates and measures are given")
        if isinstance(aggregates, str):
            aggregates = aggregates.split("|")
        if measures:
            chosen = self.cube.aggregates_of(self.cube.measure(m).name for m in ([measures] if isinstance(measures, str) else measures))
        else:
            chosen = [self.cube.aggregate(a) for a in aggregates] if aggregates else list(self.cube.aggregates)
        return self._with_sources(chosen)

    def _sources(self, a: MeasureAggregate) -> set[str]:
        known = {x.name for x in self.cube.aggregates}
        if a.function and windows.known(a.function):
            if a.measure not in known:
                raise NoSuchAttributeError(a.measure, f"aggregate under '{a.name}'")
            return {a.measure}
        return (names(a.expression) & known) - {a.name} if a.expression else set()

    def _with_sources(self, chosen: list[MeasureAggregate]) -> list[MeasureAggregate]:
        found = {a.name: a for a in chosen}
        queue = list(chosen)
        while queue:
            for n in self._sources(queue.pop()):
                if n not in found:
                    found[n] = self.cube.aggregate(n)
                    queue.append(found[n])
        return in_order_of_dependency(found.values(), self._sources)

    def prepare_order(self, order, is_aggregate: bool = False) -> list[tuple[Attribute, str]]:
        """(attribute, direction) from names, ``name:direction`` or pairs. A moving calculation sorts by what it is of."""
        found = []
        for item in [order] if isinstance(order, str) else order or ():
            name, _, direction = item.partition(":") if isinstance(item, str) else (item[0], "", item[1])
            attribute = None
            if is_aggregate and isinstance(name, str):
                attribute = next((a for a in self.cube.aggregates if a.name == name), None)
                if attribute is not None and windows.known(attribute.function):
                    attribute = self.cube.aggregate(attribute.measure)
            attribute = attribute or self.cube.attribute(name)
            found.append((attribute, check_direction(direction or attribute.order)))
        return found

    @staticmethod
    def _sorted(df: DataFrame, order: list[tuple[str, str]]) -> DataFrame:
        """Nulls go last either way."""
        columns, seen = [], set()
        for name, direction in order:
            if name not in seen and name in df.columns:
                seen.add(name)
                c = F.col(f"`{name}`")
                columns.append(c.asc_nulls_last() if direction == "asc" else c.desc_nulls_last())
        return df.orderBy(*columns) if columns else df

    @staticmethod
    def _paged(df: DataFrame, page: int | None, page_size: int | None) -> DataFrame:
        if page is None or page_size is None:
            return df
        if int(page) < 0 or int(page_size) < 1:
            raise ArgumentError(f"no page {page} of size {page_size}")
        return df.offset(int(page) * int(page_size)).limit(int(page_size)) if int(page) else df.limit(int(page_size))

    # Aggregation

    def aggregate_columns(self, aggregates: list[MeasureAggregate]) -> dict[str, Column]:
        """Columns of the aggregates that the grouping computes, that is, all but moving calculations."""
        made: dict[str, Column] = {}
        key = self.star.key_column()
        for a in aggregates:
            if windows.known(a.function):
                continue
            if a.expression:
                made[a.name] = to_column(a.expression, lambda n: self._of_aggregate(n, made), lambda n: self.star.column(self.star.row_attribute(n)))
            elif a.function:
                measure = self.star.column(self.star.row_attribute(a.measure)) if a.measure else None
                made[a.name] = functions.aggregate(a.function, measure, key, self.coalesce)
            else:  # a column that is aggregated already; its table has one row per cell
                made[a.name] = F.first(self.star.column(a), ignorenulls=True)
        return made

    @staticmethod
    def _of_aggregate(name: str, made: dict[str, Column]) -> Column:
        if name not in made:
            raise NoSuchAttributeError(name, "outside of an aggregate function")
        return made[name]

    def _aggregate_inputs(self, aggregates: list[MeasureAggregate]) -> list[Attribute]:
        found = []
        known = {x.name for x in self.cube.aggregates}
        for a in aggregates:
            if windows.known(a.function):
                continue
            if a.expression:
                found += [self.star.row_attribute(n) for n in names(a.expression) - known]
            elif a.function:
                found += [self.star.row_attribute(a.measure)] if a.measure else []
            else:
                found.append(a)
        return found

    def grouped(self, cell: Cell, aggregates: list[MeasureAggregate], drilldown: Drilldown, split: Cell | None = None, joined: list[Attribute] | None = None) -> DataFrame:
        """One plan: the pruned star, its rows in the cell, grouped by every attribute down to the drilled levels. The tables of ``joined`` are joined, too."""
        needed = [*drilldown.attributes, *self.star.cell_attributes(cell), *self.star.cell_attributes(split), *self._aggregate_inputs(aggregates), *(joined or [])]
        df = self.star.frame(needed)
        condition = self.star.condition(cell)
        if condition is not None:
            df = df.where(condition)
        keys = [self.star.split_column(split)] if split is not None else []
        keys += [self.star.column(a).alias(a.ref) for a in drilldown.attributes]
        made = [c.alias(n) for n, c in self.aggregate_columns(aggregates).items()] or [F.count(self.star.key_column()).alias("__count__")]
        out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
        return out.drop("__count__")

    def _moving(self, cells: DataFrame, aggregates: list[MeasureAggregate], drilldown: Drilldown, split: Cell | None) -> DataFrame:
        """Adds moving calculations, in natural order, over cells of one split side and, but for the deepest dimension, of one member each."""
        wanted = [a for a in aggregates if windows.known(a.function)]
        if not wanted:
            return cells
        order = [F.col(f"`{a.ref}`").asc_nulls_last() if d == "asc" else F.col(f"`{a.ref}`").desc_nulls_last() for a, d in drilldown.natural_order()] or [F.lit(1)]
        partition = [F.col(SPLIT)] if split is not None else []
        for item in drilldown:
            if not item.levels[-1].info.get("aggregation_units") and len(drilldown) > 1 and any(x.levels[-1].info.get("aggregation_units") for x in drilldown):
                partition += [F.col(f"`{k}`") for k in item.keys]
        for a in wanted:
            value = F.col(f"`{a.measure}`")
            size = windows.window_size(a.window_size)
            cells = cells.withColumn(a.name, windows.moving(a.function, value, size, partition, order))
            if self._nullable(a.measure):
                cells = cells.withColumn(a.name, windows.carried(F.col(f"`{a.name}`"), partition, order))
        return cells

    def _nullable(self, name: str) -> bool:
        a = self.cube.aggregate(name)
        return not (self.coalesce and a.function and functions.canonical(a.function) in ("sum", "count", "count_nonempty", "count_distinct"))

    def aggregate(self, cell=None, aggregates=None, drilldown=None, split=None, order=None, page=None, page_size=None, measures=None) -> AggregationResult:
        cell = self.cell(cell)
        split = self.cell(split) if split is not None and (not isinstance(split, str) or split) else None
        chosen = self.prepare_aggregates(aggregates, measures)
        drill = Drilldown(drilldown, cell)
        orders = self.prepare_order(order, is_aggregate=True)
        if (page is None or page_size is None) and (high := drill.high_cardinality(cell)):
            raise ArgumentError(f"{', '.join(high)} have many members: ask for a page, or cut them to points or sets")
        shown = [a.name for a in chosen]
        result = AggregationResult(cell, shown, drill, has_split=split is not None, attributes=[a.ref for a in drill.attributes], levels=drill.result_levels())
        if self.include_summary or not (len(drill) or split is not None):
            # Inner joins drop rows, so the summary has the joins of the cells that it sums up.
            summary = self.grouped(cell, chosen, Drilldown([], cell), joined=[*drill.attributes, *self.star.cell_attributes(split)])
            result.summary_frame = summary.select(*(F.col(f"`{n}`") for n in shown if n in summary.columns))
        if len(drill) or split is not None:
            cells = self._moving(self.grouped(cell, chosen, drill, split), chosen, drill, split)
            if self.exclude_null_aggregates:
                cells = cells.dropna(how="any", subset=[f"`{n}`" for n in shown])
            if self.include_cell_count:
                result.all_cells_frame = cells
            by = [(SPLIT, "asc")] if split is not None else []
            by += [(a.name if isinstance(a, MeasureAggregate) else a.ref, d) for a, d in orders] + [(a.ref, d) for a, d in drill.natural_order()]
            cells = self._paged(self._sorted(cells, by), page, page_size)
            result.cells_frame = cells.select(*(F.col(f"`{n}`") for n in result.labels))
        return result

    # Rows

    def _selected(self, fields) -> list[Attribute]:
        if isinstance(fields, str):
            fields = fields.split(",")
        return [self.cube.attribute(f) for f in fields] if fields else [a for a in self.cube.row_attributes]

    def facts(self, cell=None, fields=None, order=None, page=None, page_size=None, fact_list=None) -> DataFrame:
        """A row per fact: its key and the fields, all by default."""
        cell = self.cell(cell)
        chosen = self._selected(fields)
        orders = self.prepare_order(order)
        df = self.star.frame([*chosen, *self.star.cell_attributes(cell), *(a for a, _ in orders)])
        condition = self.star.condition(cell)
        if condition is not None:
            df = df.where(condition)
        if fact_list is not None:
            df = df.where(self.star.key_column().isin(list(fact_list)))
        if orders:
            by = [self.star.column(a) for a, _ in orders]
            df = df.orderBy(*(c.asc_nulls_last() if d == "asc" else c.desc_nulls_last() for c, (_, d) in zip(by, orders, strict=True)))
        out = self._paged(df.select(self.star.key_column().alias(FACT_KEY), *(self.star.column(a).alias(a.ref) for a in chosen)), page, page_size)
        return out.toDF(FACT_KEY, *(f"a{i}" for i in range(len(chosen)))) if self.options.get("safe_labels") else out

    def fact(self, key: Any, fields=None) -> dict | None:
        found = self.facts(fields=fields, fact_list=[key]).limit(1).collect()
        return found[0].asDict() if found else None

    def members(self, cell=None, dimension=None, depth: int | None = None, level: str | None = None, hierarchy: str | None = None, attributes=None, page=None, page_size=None, order=None) -> DataFrame:
        """The distinct members of a dimension that facts in the cell have, down to ``level`` or ``depth``, by default all levels."""
        cell = self.cell(cell)
        d = self.cube.dimension(dimension)
        h = d.hierarchy(hierarchy)
        if depth and level:
            raise ArgumentError("both depth and level are given")
        levels = h.levels_for_depth(depth) if depth else h.levels[: h.level_index(level) + 1] if level else h.levels
        chosen = [d.attribute(a) if isinstance(a, str) else a for a in attributes] if attributes else [a for x in levels for a in x.attributes]
        df = self.star.frame([*chosen, *self.star.cell_attributes(cell)])
        condition = self.star.condition(cell)
        if condition is not None:
            df = df.where(condition)
        out = df.select(*(self.star.column(a).alias(a.ref) for a in chosen)).distinct()
        by = [(a.ref, x) for a, x in self.prepare_order(order)] + [(x.order_attribute.ref, x.order or x.order_attribute.order or "asc") for x in levels]
        return self._paged(self._sorted(out, by), page, page_size)

    def path_details(self, dimension, path, hierarchy=None) -> dict | None:
        """The attributes of the member that a path leads to, None if there is none or it is not visible."""
        d = self.cube.dimension(dimension)
        return self._details(PointCut(d.name, path, d.hierarchy(hierarchy).name), [path])[0]

    def members_of_paths(self, cut: Cut, paths: list) -> DataFrame:
        """A row per visible member that one of ``paths``, all of one length, leads to, with all its attributes."""
        levels = self.cube.dimension(cut.dimension).hierarchy(cut.hierarchy).levels_for_path(paths[0])
        keys = [x.key for x in levels]
        rest = [a for x in levels for a in x.attributes if a not in keys]
        df = self.star.frame([*keys, *rest, *self.star.cell_attributes(self.visible)]).where(self.star.cut_condition(SetCut(cut.dimension, paths, cut.hierarchy)))
        condition = self.star.condition(self.visible)
        df = df if condition is None else df.where(condition)
        by = [self.star.column(k).alias(k.ref) for k in keys]
        return df.groupBy(*by).agg(*(F.first(self.star.column(a)).alias(a.ref) for a in rest)) if rest else df.select(*by).distinct()

    def _details(self, cut: Cut, paths: list) -> list[dict | None]:
        """The attributes of the members of ``paths``, with one job for all paths of one length."""
        found: dict[tuple, dict] = {}
        for depth in sorted({len(p) for p in paths}):
            own = [p for p in paths if len(p) == depth]
            refs = [x.key.ref for x in self.cube.dimension(cut.dimension).hierarchy(cut.hierarchy).levels_for_path(own[0])]
            found |= {tuple(r[k] for k in refs): r.asDict() for r in self.members_of_paths(cut, own).collect()}  # as many rows as paths, at most
        return [found.get(self.star.typed_path(cut, p)) for p in paths]

    def cut_details(self, cut: Cut):
        """For a point a list with a dictionary per level, for a set a list of those, for a range those of its ends."""
        if isinstance(cut, PointCut):
            return self._level_details(cut, [cut.path])[0]
        if isinstance(cut, SetCut):
            return self._level_details(cut, list(cut.paths))
        if isinstance(cut, RangeCut):
            ends = self._level_details(cut, [cut.from_path, cut.to_path])
            return {"from": ends[0], "to": ends[1]}
        raise ArgumentError(f"unknown kind of cut: {cut!r}")

    def _level_details(self, cut: Cut, paths: list) -> list[list[dict] | None]:
        h = self.cube.dimension(cut.dimension).hierarchy(cut.hierarchy)
        there = [p for p in paths if p]
        found = dict(zip(map(tuple, there), self._details(cut, there), strict=True))
        shown = lambda p, r: [{a.ref: r[a.ref] for a in x.attributes} | {"_key": r[x.key.ref], "_label": r[x.label_attribute.ref]} for x in h.levels_for_path(p)]
        return [shown(p, r) if p and (r := found[tuple(p)]) is not None else None for p in paths]

    def cell_details(self, cell, dimension=None) -> list:
        cell = self.cell(cell)
        name = self.cube.dimension(dimension).name if dimension else None
        return [self.cut_details(c) for c in cell.cuts if name in (None, c.dimension)]

    def report(self, cell, queries: dict[str, dict]) -> dict:
        """Results of named queries over one cell. A query has ``query`` (aggregate, facts, fact, members or values, details, cell), its arguments, and ``rollup``, which rolls up its cell first."""
        cell = self.cell(cell)
        out: dict[str, Any] = {}
        for name, spec in queries.items():
            args = dict(spec)
            kind, rollup = args.pop("query", None), args.pop("rollup", None)
            if odd := sorted(args.keys() - REPORT_ARGUMENTS.get(kind, args.keys())):
                raise ArgumentError(f"unknown arguments in report '{name}': {', '.join(odd)}")
            here = cell.rollup(rollup) if rollup else cell
            if kind == "aggregate":
                out[name] = self.aggregate(here, **args)
            elif kind == "facts":
                out[name] = self.facts(here, **args)
            elif kind == "fact":
                out[name] = self.fact(args.get("key"), args.get("fields"))
            elif kind in ("members", "values"):
                out[name] = self.members(here, **args)
            elif kind == "details":
                out[name] = self.cell_details(here, **args)
            elif kind == "cell":
                out[name] = {"cell": here.to_dict(), "details": self.cell_details(here)}
            else:
                raise ArgumentError(f"unknown kind of query '{kind}' in report '{name}'")
        return out

    def test(self, aggregate: bool = False) -> None:
        """Fetches one fact with all its attributes and, if asked to, a summary."""
        self.facts().limit(1).collect()
        if aggregate:
            self.aggregate().summary  # noqa: B018

    def is_builtin_function(self, name: str) -> bool:
        return functions.known(name)


def check_paths(cube: Cube, cell: Cell) -> None:
    """Paths that are longer than their hierarchies are errors."""
    for c in cell.cuts:
        h = cube.dimension(c.dimension).hierarchy(c.hierarchy)
        if c.level_depth() > len(h):
            raise HierarchyError(f"the path of '{c}' is too long for hierarchy '{h.name}'")
