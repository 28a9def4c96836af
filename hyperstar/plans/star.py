"""Stars: a fact table and only those details that a request needs.

Catalyst does not drop joins whose columns go unused, so the planner never
makes them: it joins the tables of the requested attributes and their masters,
in the order in which the model lists them. How each is joined is left to
Catalyst and adaptive execution, which know sizes; no side is forced to be
broadcast.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Callable, Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, HierarchyError, ModelError, NoSuchAttributeError
from ..functions import scalars
from ..model import Attribute, Cube
from ..model.attributes import in_order_of_dependency
from .cells import Cell, Cut, PointCut, RangeCut, SetCut
from .expressions import names, to_column
from .mapping import METHODS, ColumnRef, Join, Mapper

FACT_KEY = "__fact_key__"
SPLIT = "__within_split__"

#: (table, schema) -> DataFrame
Tables = Callable[[str, str | None], DataFrame]


class Star:
    """The tables of a cube. ``tables`` finds physical tables; ``statements`` are DataFrames that stand for tables by name."""

    def __init__(self, cube: Cube, mapper: Mapper, tables: Tables, statements: dict[str, DataFrame] | None = None):
        self.cube, self.mapper, self._tables, self._statements = cube, mapper, tables, statements or {}
        self.fact_name = mapper.fact_name
        self.joins: list[Join] = mapper.joins
        self._by_name: dict[str, Join] = {}
        for j in self.joins:
            if j.name in self._by_name or j.name == self.fact_name:
                raise ModelError(f"detail '{j.name}' is joined twice; give one of the joins an alias")
            self._by_name[j.name] = j
        self._frames: dict[str, DataFrame] = {}
        self._columns: dict[str, Column] = {}

    # Tables

    def table(self, name: str) -> DataFrame:
        """The table that mappings and joins call ``name``."""
        if name not in self._frames:
            j = self._by_name.get(name)
            physical, schema = (j.detail.table, j.detail.schema) if j else (self.fact_name, self.mapper.fact_schema)
            if j is None and name != self.fact_name:
                raise ModelError(f"table '{name}' is not joined in cube '{self.cube.name}'")
            df = self._statements.get(name)
            if df is None:
                df = self._statements.get(physical)
            self._frames[name] = df if df is not None else self._tables(physical, schema)
        return self._frames[name]

    @property
    def fact_key(self) -> str:
        """The column that tells facts apart: the cube's key, else ``id``, else the first one."""
        columns = self.table(self.fact_name).columns
        if self.cube.key:
            if self.cube.key not in columns:
                raise ModelError(f"fact table '{self.fact_name}' has no key column '{self.cube.key}'")
            return self.cube.key
        return self.mapper.naming.fact_key if self.mapper.naming.fact_key in columns else columns[0]

    def _at(self, table: str, column: str) -> Column:
        if column not in self.table(table).columns:
            raise NoSuchAttributeError(column, f"not a column of table '{table}'")
        return F.col(f"`{table}`.`{column}`")

    def required_joins(self, tables: Iterable[str]) -> list[Join]:
        """The joins that reach ``tables``, masters before their details, else in the model's order."""
        needed: set[str] = set()

        def need(name: str, trail: tuple[str, ...] = ()) -> None:
            if name in (None, self.fact_name) or name in needed:
                return
            if name in trail:
                raise ModelError("joins go in a circle: " + " -> ".join((*trail, name)))
            j = self._by_name.get(name)
            if j is None:
                raise ModelError(f"table '{name}' is not joined in cube '{self.cube.name}'")
            need(j.master.table, (*trail, name))
            needed.add(name)

        for t in tables:
            need(t)
        ordered: list[Join] = []
        waiting = [j for j in self.joins if j.name in needed]
        there = {self.fact_name, None}
        while waiting:
            j = next(j for j in waiting if j.master.table in there)
            ordered.append(j)
            there.add(j.name)
            waiting.remove(j)
        return ordered

    def frame(self, attributes: Iterable[Attribute]) -> DataFrame:
        """The joined tables that have ``attributes``."""
        tables = {ref.table for a in self.with_needed(attributes) if (ref := self.mapper.physical(a)) is not None}
        df = self.table(self.fact_name).alias(self.fact_name)
        for j in self.required_joins(tables):
            on = reduce(lambda a, b: a & b, (self._at(j.master.table or self.fact_name, m) == self._at(j.name, d) for m, d in zip(j.master.columns, j.detail.columns, strict=True)))
            df = df.join(self.table(j.name).alias(j.name), on, METHODS[j.method])
        return df

    # Columns

    def with_needed(self, attributes: Iterable[Attribute]) -> list[Attribute]:
        """The attributes and those that their expressions use, the latter first."""
        found: dict[str, Attribute] = {}

        def add(a: Attribute) -> None:
            if a.ref not in found:
                found[a.ref] = a
                for n in sorted(names(a.expression)) if a.expression else ():
                    add(self.row_attribute(n))

        for a in attributes:
            add(a)
        return in_order_of_dependency(found.values(), lambda a: {self.row_attribute(n).ref for n in names(a.expression)} if a.expression else ())

    def row_attribute(self, name: str) -> Attribute:
        for a in self.cube.row_attributes:
            if a.ref == name:
                return a
        if name in self.cube.dimensions and self.cube.dimensions[name].is_flat:
            return self.cube.dimensions[name].levels[0].key
        # Columns of the fact table may be used without being declared.
        if name in self.table(self.fact_name).columns:
            return Attribute(name)
        raise NoSuchAttributeError(name, f"in cube '{self.cube.name}'")

    def column(self, attribute: Attribute) -> Column:
        """A row's value of the attribute."""
        if attribute.ref not in self._columns:
            if attribute.expression:
                self.with_needed([attribute])  # circles are errors
                made = to_column(attribute.expression, lambda n: self.column(self.row_attribute(n)))
            else:
                ref = self.mapper.physical(attribute)
                made = self._at(ref.table or self.fact_name, ref.column)
                made = scalars.extract(ref.extract, made) if ref.extract else made
                made = scalars.mapped_function(ref.function, made) if ref.function else made
            self._columns[attribute.ref] = made
        return self._columns[attribute.ref]

    def key_column(self) -> Column:
        return self._at(self.fact_name, self.fact_key)

    def type_of(self, attribute: Attribute) -> T.DataType | None:
        ref = None if attribute.expression else self.mapper.physical(attribute)
        if ref is not None and not ref.extract and not ref.function:
            return self.table(ref.table or self.fact_name).schema[ref.column].dataType
        if isinstance(ref, ColumnRef) and ref.extract:
            return T.LongType()
        return self.frame([attribute]).select(self.column(attribute)).schema[0].dataType

    # Conditions

    def condition(self, cell: Cell | None) -> Column | None:
        """All cuts of the cell; None if it has none."""
        parts = [self.cut_condition(c) for c in cell.cuts] if cell is not None else []
        return reduce(lambda a, b: a & b, parts) if parts else None

    def cell_attributes(self, cell: Cell | None) -> list[Attribute]:
        """The keys that the cell's cuts compare."""
        return [level.key for c in (cell.cuts if cell is not None else ()) for level in self._levels(c, c.level_depth())]

    def _levels(self, cut: Cut, depth: int):
        h = self.cube.dimension(cut.dimension).hierarchy(cut.hierarchy)
        if depth > len(h):
            raise HierarchyError(f"a path of {depth} elements is too long for hierarchy '{h.name}' of dimension '{cut.dimension}'")
        return h.levels[:depth]

    def cut_condition(self, cut: Cut) -> Column:
        """Comparisons of keys. An inverted cut is their negation, so null keys are in neither."""
        if isinstance(cut, PointCut):
            made = self._point(cut, cut.path)
        elif isinstance(cut, SetCut):
            made = self._set(cut)
        elif isinstance(cut, RangeCut):
            ends = [self._bound(cut, path, strict, last) for path, strict, last in ((cut.from_path, ">", ">="), (cut.to_path, "<", "<=")) if path]
            made = reduce(lambda a, b: a & b, ends) if ends else F.lit(True)
        else:
            raise ArgumentError(f"unknown kind of cut: {cut!r}")
        return ~made if cut.invert else made

    def typed_path(self, cut: Cut, path) -> tuple:
        """The elements of a path as values of their columns."""
        return tuple(_typed(v, self.type_of(x.key)) for x, v in zip(self._levels(cut, len(path)), path, strict=True))

    def _period(self, cut: Cut, path) -> tuple[Column, Column, Column] | None:
        """Where the first levels of a path are parts of one date or time column: that column, the start of the
        period that they name, and its end. A comparison with these follows from one of the parts, and it is one
        that files, row groups and partitions can be pruned by, which extracted parts are not."""
        values: dict[str, int] = {}
        base = None
        for level, value in zip(self._levels(cut, len(path)), path, strict=True):
            ref = None if level.key.expression else self.mapper.physical(level.key)
            part = str(ref.extract).lower() if ref is not None and ref.extract and not ref.function else None
            if part not in _PERIODS or (base is None and part != "year") or (base is not None and (ref.table, ref.column) != (base.table, base.column)):
                break
            whole = _typed(value, T.LongType())
            if not isinstance(whole, int) or not _PERIODS[part][0] <= whole <= _PERIODS[part][1]:
                return None
            values[part], base = whole, ref
        kind = self.table(base.table or self.fact_name).schema[base.column].dataType if base is not None else None
        if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return None
        start, end = _span(values)
        if start is None:
            return None
        if isinstance(kind, T.TimestampType):  # a day more on each side, as clocks of a zone may be set back over midnight
            start, end = start - datetime.timedelta(days=1), end + datetime.timedelta(days=1)
        made = lambda d: F.lit(d.isoformat()).cast(kind)
        return self._at(base.table or self.fact_name, base.column), made(start), made(end)

    def _keys(self, cut: Cut, path) -> list[tuple[Column, Any]]:
        return [(self.column(x.key), _typed(v, self.type_of(x.key))) for x, v in zip(self._levels(cut, len(path)), path, strict=True)]

    def _point(self, cut: Cut, path) -> Column:
        parts = [_compared(k, "=", v) for k, v in self._keys(cut, path)]
        if period := self._period(cut, path):
            parts = [period[0] >= period[1], period[0] < period[2], *parts]
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)

    def _set(self, cut: SetCut) -> Column:
        flat = [p for p in cut.paths if len(p) == 1]
        if len(flat) == len(cut.paths) and flat and all(p[0] is not None for p in flat):
            key = self._levels(cut, 1)[0].key
            values = [v for p in flat if (v := _typed(p[0], self.type_of(key))) is not _NO_VALUE]
            made = self.column(key).isin(values) if values else _nothing(self.column(key))
            periods = [self._period(cut, p) for p in flat if _typed(p[0], self.type_of(key)) is not _NO_VALUE]
            if periods and all(periods):
                base = periods[0][0]
                made = (base >= F.least(*(p[1] for p in periods), periods[0][1])) & (base < F.greatest(*(p[2] for p in periods), periods[0][2])) & made
            return made
        parts = [self._point(cut, p) for p in cut.paths]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)

    def _bound(self, cut: Cut, path, strict: str, last: str) -> Column:
        """Keys in lexicographic order beyond ``path``, or on it: the last key may be equal, those before it must be beyond or equal with the rest beyond."""
        *outer, (key, value) = self._keys(cut, path)
        made = _compared(key, last, value)
        for k, v in reversed(outer):
            made = _compared(k, strict, v) | (_compared(k, "=", v) & made)
        if period := self._period(cut, path):
            made = (period[0] >= period[1] if strict == ">" else period[0] < period[2]) & made
        return made

    def split_column(self, split: Cell) -> Column:
        condition = self.condition(split)
        return (F.when(condition, True).otherwise(False) if condition is not None else F.lit(True)).alias(SPLIT)


_NO_VALUE = object()


def _typed(value: Any, kind: T.DataType | None) -> Any:
    """A path element, which may be text, as a value of the column's type; _NO_VALUE if it cannot be one, which then equals nothing."""
    if value is None or kind is None:
        return value
    try:
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False, "1": True, "0": False}.get(str(value).lower(), _NO_VALUE)
        if isinstance(kind, T.IntegralType):
            return int(value)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
        if isinstance(kind, T.DecimalType):
            return decimal.Decimal(str(value))
        if isinstance(kind, T.StringType):
            return str(value)
        if isinstance(kind, T.DateType):
            return value if isinstance(value, datetime.date) else datetime.date.fromisoformat(str(value))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value))
    except (ValueError, TypeError, decimal.InvalidOperation):
        return _NO_VALUE
    return value


#: Parts of a date that name a period, with their least and greatest values.
_PERIODS = {"year": (1, 9998), "quarter": (1, 4), "month": (1, 12), "day": (1, 31)}


def _span(values: dict[str, int]) -> tuple[datetime.date | None, datetime.date | None]:
    """The first day of the period that the parts name, and the day after its last; None if there is no such period."""
    year, quarter, month, day = (values.get(k) for k in ("year", "quarter", "month", "day"))
    if month is None and quarter is None:
        return datetime.date(year, 1, 1), datetime.date(year + 1, 1, 1)
    first, n = (month, 1) if month is not None else (3 * quarter - 2, 3)
    start, after = datetime.date(year, first, 1), datetime.date(year + (first + n > 12), (first + n - 1) % 12 + 1, 1)
    if day is None or month is None:
        return start, after
    if day > (after - start).days:
        return None, None
    return start.replace(day=day), start.replace(day=day) + datetime.timedelta(days=1)


def _nothing(key: Column) -> Column:
    """False, and null for a null key: equals nothing, and so does its negation for nulls."""
    return F.when(key.isNotNull(), F.lit(False))


def _compared(key: Column, op: str, value: Any) -> Column:
    if value is _NO_VALUE:
        return _nothing(key)
    if value is None:
        return key.isNull() if op in ("=", ">=", "<=") else F.lit(False)
    return {"=": key == value, ">": key > value, ">=": key >= value, "<": key < value, "<=": key <= value}[op]
