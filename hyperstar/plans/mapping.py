"""From logical attributes to physical columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields
from typing import Any

from ..errors import ArgumentError, ModelError
from ..model import Attribute, Cube


@dataclass(frozen=True)
class ColumnRef:
    """A column, or with ``extract`` a part of its date, or with ``function`` a function of it."""

    schema: str | None
    table: str | None
    column: str
    extract: str | None = None
    function: str | None = None

    @classmethod
    def parse(cls, ref: Any, table: str | None = None, schema: str | None = None) -> ColumnRef:
        """From ``column``, ``table.column``, ``schema.table.column``, a list of those parts, a dictionary or an object with these attributes."""
        if isinstance(ref, cls):
            return ref
        if isinstance(ref, str):
            ref = ref.split(".")
        if isinstance(ref, (list, tuple)):
            if not 1 <= len(ref) <= 3:
                raise ArgumentError(f"a column has one to three parts: {list(ref)}")
            given = (None,) * (3 - len(ref)) + tuple(ref)
            return cls(given[0] or schema, given[1] or table, given[2])
        get = ref.get if isinstance(ref, dict) else lambda k: getattr(ref, k, None)
        if not get("column"):
            raise ArgumentError(f"no column in {ref!r}")
        return cls(get("schema") or schema, get("table") or table, get("column"), get("extract"), get("function"))


@dataclass
class Naming:
    """How tables and keys are named where the model does not say."""

    fact_prefix: str = ""
    fact_suffix: str = ""
    dimension_prefix: str = ""
    dimension_suffix: str = ""
    schema: str | None = None
    fact_schema: str | None = None
    dimension_schema: str | None = None
    denormalized_prefix: str = ""
    denormalized_suffix: str = ""
    denormalized_schema: str | None = None
    aggregate_prefix: str = ""
    aggregate_suffix: str = ""
    aggregate_schema: str | None = None
    fact_key: str = "id"
    dimension_key: str = "id"
    dimension_key_prefix: str = ""
    dimension_key_suffix: str = ""
    explicit_dimension_primary: bool = False

    @classmethod
    def from_options(cls, options: dict | None) -> Naming:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (options or {}).items() if k in known and v is not None})

    def fact_table(self, name: str) -> str:
        return f"{self.fact_prefix}{name}{self.fact_suffix}"

    def dimension_table(self, name: str) -> str:
        return f"{self.dimension_prefix}{name}{self.dimension_suffix}"

    def denormalized_table(self, name: str) -> str:
        return f"{self.denormalized_prefix}{name}{self.denormalized_suffix}"

    def aggregated_table(self, name: str) -> str:
        return f"{self.aggregate_prefix}{name}{self.aggregate_suffix}"

    def dimension_primary_key(self, name: str) -> str:
        return f"{self.dimension_key_prefix}{name}{self.dimension_key_suffix}" if self.explicit_dimension_primary else self.dimension_key

    @staticmethod
    def _stripped(prefix: str, suffix: str, tables) -> list[str]:
        if not prefix and not suffix:
            return []
        pattern = re.compile(re.escape(prefix) + r"(.+)" + re.escape(suffix) + r"\Z")
        return [m[1] for t in tables if (m := pattern.match(t))]

    def facts(self, tables) -> list[str]:
        """Names of facts among ``tables``, by their prefix or suffix."""
        return self._stripped(self.fact_prefix, self.fact_suffix, tables)

    def dimensions(self, tables) -> list[str]:
        return self._stripped(self.dimension_prefix, self.dimension_suffix, tables)


class Mapper:
    """Explicit mappings of the cube first, keyed ``attribute`` or ``attribute.locale``; else the naming conventions."""

    def __init__(self, cube: Cube, naming: Naming | None = None, locale: str | None = None):
        self.cube, self.naming, self.locale = cube, naming or Naming(), locale
        self.fact_name = cube.fact or self.naming.fact_table(cube.name)
        self.joins = [Join.parse(j, self.fact_name, self.naming.schema) for j in cube.joins]
        self.join_names = {j.name for j in self.joins}

    @property
    def fact_schema(self) -> str | None:
        return self.naming.fact_schema or self.naming.schema

    def locale_of(self, attribute: Attribute) -> str | None:
        if not attribute.locales:
            return None
        return self.locale if self.locale in attribute.locales else attribute.locales[0]

    def physical(self, attribute: Attribute) -> ColumnRef | None:
        """None for what an expression makes."""
        if attribute.expression:
            return None
        locale = self.locale_of(attribute)
        for key in ([f"{attribute.ref}.{locale}"] if locale else []) + [attribute.ref]:
            if key in self.cube.mappings:
                return ColumnRef.parse(self.cube.mappings[key], self.fact_name, self.fact_schema)
        column = f"{attribute.name}_{locale}" if locale else attribute.name
        d = self.cube.dimensions.get(attribute.dimension) if attribute.dimension else None
        if d is not None and not (d.is_flat and not d.has_details):
            table = self.naming.dimension_table(d.name)
            if table not in self.join_names and d.master:
                table = self.naming.dimension_table(d.master)
            return ColumnRef(self.naming.dimension_schema or self.naming.schema, table, column)
        return ColumnRef(self.fact_schema, self.fact_name, column)


class WideMapper(Mapper):
    """For a denormalized table: every attribute is the column named by its reference."""

    def __init__(self, cube: Cube, naming: Naming | None = None, locale: str | None = None, table: str | None = None):
        super().__init__(cube, naming, locale)
        self.joins = []
        self.fact_name = table or self.naming.denormalized_table(cube.name)

    @property
    def fact_schema(self) -> str | None:
        return self.naming.denormalized_schema or self.naming.schema

    def physical(self, attribute: Attribute) -> ColumnRef | None:
        if attribute.expression:
            return None
        return ColumnRef(self.fact_schema, self.fact_name, attribute.ref)


@dataclass(frozen=True)
class JoinKey:
    schema: str | None
    table: str | None
    columns: tuple[str, ...]

    @classmethod
    def parse(cls, key: Any, table: str | None = None, schema: str | None = None) -> JoinKey:
        if isinstance(key, dict):
            if not key.get("column"):
                raise ModelError(f"join key without a column: {key}")
            columns = key["column"]
            return cls(key.get("schema") or schema, key.get("table") or table, tuple(columns) if isinstance(columns, (list, tuple)) else (columns,))
        ref = ColumnRef.parse(key, table, schema)
        return cls(ref.schema, ref.table, (ref.column,))


METHODS = {"match": "inner", "master": "left", "detail": "right"}


@dataclass(frozen=True)
class Join:
    """``detail`` is joined to ``master``: ``match`` keeps facts with a detail, ``master`` all facts, ``detail`` all details."""

    master: JoinKey
    detail: JoinKey
    alias: str | None = None
    method: str = "match"

    @classmethod
    def parse(cls, join: Any, fact: str, schema: str | None = None) -> Join:
        if isinstance(join, cls):
            return join
        if isinstance(join, (list, tuple)):
            if not 2 <= len(join) <= 4:
                raise ModelError(f"a join has two to four parts: {join}")
            join = dict(zip(("master", "detail", "alias", "method"), join, strict=False))
        if not join.get("master") or not join.get("detail"):
            raise ModelError(f"a join needs a master and a detail: {join}")
        method = (join.get("method") or "match").lower()
        if method not in METHODS:
            raise ModelError(f"unknown join method '{method}'")
        master, detail = JoinKey.parse(join["master"], fact, schema), JoinKey.parse(join["detail"], None, schema)
        if not detail.table:
            raise ModelError(f"the detail of a join has no table: {join}")
        if len(master.columns) != len(detail.columns):
            raise ModelError(f"master and detail have keys of {len(master.columns)} and {len(detail.columns)} columns")
        return cls(master, detail, join.get("alias"), method)

    @property
    def name(self) -> str:
        """What mappings and further joins call the detail."""
        return self.alias or self.detail.table
