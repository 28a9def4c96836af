"""Stores of physical tables, and what is made of marts in them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ArgumentError, HyperstarError, NoSuchTableError, StoreError
from ..model import Attribute, Cube
from ..operators import cuboids
from ..operators.browser import Browser
from ..plans.mapping import Mapper, Naming, WideMapper


class SparkStore:
    """Tables by name: given DataFrames first, then files below ``path`` (``name`` or ``name.format``), then a database by JDBC (``url``), then the catalog."""

    def __init__(self, spark: SparkSession, path: str | None = None, tables: dict[str, DataFrame] | None = None, url: str | None = None, format: str = "parquet", schema: str | None = None, properties: dict | None = None, **options):
        self.spark, self.path, self.tables, self.url, self.format, self.schema = spark, path.rstrip("/") if path else None, dict(tables or {}), url, format, schema
        self.properties, self.options = properties or {}, options
        self.naming = Naming.from_options({"schema": schema} | options)

    def table(self, name: str, schema: str | None = None) -> DataFrame:
        full = f"{schema or self.schema}.{name}" if schema or self.schema else name
        for key in (full, name):
            if key in self.tables:
                return self.tables[key]
        if self.path:
            folder = f"{self.path}/{schema}" if schema else self.path
            for file in (f"{folder}/{name}.{self.format}", f"{folder}/{name}"):
                try:
                    return self.spark.read.format(self.format).option("header", True).load(file)
                except AnalysisException:
                    continue
        if self.url:
            return self.spark.read.jdbc(self.url, full, properties=self.properties)
        try:
            return self.spark.table(full)
        except AnalysisException as e:
            raise NoSuchTableError(full) from e

    def table_names(self) -> list[str]:
        names = set(self.tables)
        if self.path:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            names |= {f.getPath().getName().removesuffix(f".{self.format}") for f in fs.listStatus(path)} if fs.exists(path) else set()
        elif not self.url:
            names |= {t.name for t in (self.spark.catalog.listTables(self.schema) if self.schema else self.spark.catalog.listTables())}
        return sorted(n for n in names if not n.startswith((".", "_")))

    def browser(self, cube: Cube, locale: str | None = None, **options) -> Browser:
        return Browser(cube, self.table, locale=locale, naming=self.naming, **{**self.options, **options})

    def wide_browser(self, cube: Cube, table: str | None = None, locale: str | None = None, **options) -> Browser:
        """Over the cube's denormalized table."""
        return Browser(cube, self.table, locale=locale, mapper=WideMapper(cube, self.naming, locale, table), **{**self.options, **options})

    # Discovery

    def discover_facts(self) -> list[str]:
        """Names of marts whose fact tables the naming conventions tell."""
        return self.naming.facts(self.table_names())

    def discover_dimensions(self) -> list[str]:
        return self.naming.dimensions(self.table_names())

    def discovered_model(self, fact: str) -> dict:
        """A first model of a fact table: numbers but keys are measures, texts and dates flat dimensions."""
        table = self.naming.fact_table(fact)
        fields = [f for f in self.table(table, self.naming.fact_schema).schema.fields if f.name != self.naming.fact_key and not f.name.endswith(("_key", "_id"))]
        measures = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
        dimensions = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.DateType, T.BooleanType))]
        return {"marts": [{"name": fact, "fact": table, "measures": measures, "dimensions": dimensions, "implicit_aggregates": True}], "dimensions": dimensions}

    def validate(self, cube: Cube, locale: str | None = None) -> list[tuple[str, str, str]]:
        """(kind, where, what): joins and attributes that the physical tables do not have."""
        issues = []
        try:
            star = self.browser(cube, locale).star
        except HyperstarError as e:
            return [("join", cube.name, str(e))]

        def columns(name: str | None) -> list[str] | None:
            try:
                return star.table(name or star.fact_name).columns
            except (HyperstarError, AnalysisException) as e:
                issues.append(("table", str(name or star.fact_name), str(e)))
                return None

        for j in star.joins:
            for name, keys in ((j.master.table, j.master.columns), (j.name, j.detail.columns)):
                there = columns(name)
                issues += [("join", f"{name or star.fact_name}.{k}", "no such column") for k in keys if there is not None and k not in there]
        for a in cube.row_attributes:
            try:
                star.column(a)
            except (HyperstarError, AnalysisException) as e:
                issues.append(("attribute", a.ref, str(e)))
        return list(dict.fromkeys(issues))

    # Sinks

    def _save(self, df: DataFrame, name: str, replace: bool, partition_by: Iterable[str] = (), sort_by: Iterable[str] = (), schema: str | None = None) -> DataFrame:
        """As a table below ``path`` or in the catalog; sorted within files, so row groups can be skipped by ``sort_by``."""
        df = df.sortWithinPartitions(*(F.col(f"`{c}`") for c in sort_by)) if sort_by else df
        writer = df.write.mode("overwrite" if replace else "errorifexists")
        writer = writer.partitionBy(*partition_by) if partition_by else writer
        try:
            if self.path:
                writer.format(self.format).save(f"{self.path}/{schema + '/' if schema else ''}{name}.{self.format}")
            else:
                writer.saveAsTable(f"{schema}.{name}" if schema else name)
        except AnalysisException as e:
            raise StoreError(f"table '{name}' cannot be written: {e}") from e
        return self.table(name, schema)

    def create_table_from_statement(self, df: DataFrame, name: str, replace: bool = False, schema: str | None = None, **layout) -> DataFrame:
        return self._save(df, name, replace, schema=schema, **layout)

    def denormalized(self, cube: Cube, locale: str | None = None, keys_only: bool = False) -> DataFrame:
        """The whole star in one row per fact, its columns named by references. ``keys_only`` leaves out labels and details of levels."""
        browser = self.browser(cube, locale)
        keys = {a.ref for d in cube.dimensions.values() for a in d.key_attributes}
        fields = [a for a in cube.row_attributes if not (keys_only and a.dimension and a.ref not in keys)]
        facts = browser.facts(fields=[a.ref for a in fields])
        return facts.withColumnRenamed(facts.columns[0], self.naming.fact_key)

    def create_denormalized_view(self, cube: Cube, view_name: str | None = None, materialize: bool = False, replace: bool = False, create_index: bool = False, keys_only: bool = False, schema: str | None = None, locale: str | None = None) -> DataFrame:
        """A view of the denormalized cube, or a table, whose index is a sort by the dimensions' keys."""
        name = view_name or self.naming.denormalized_table(cube.name)
        if name == Mapper(cube, self.naming).fact_name:
            raise StoreError(f"'{name}' is the fact table")
        df = self.denormalized(cube, locale, keys_only)
        if materialize:
            keys = [a.ref for d in cube.dimensions.values() for a in d.key_attributes if a.ref in df.columns]
            return self._save(df, name, replace, sort_by=keys if create_index else (), schema=schema)
        if not replace and name in [t.name for t in self.spark.catalog.listTables() if t.isTemporary]:
            raise StoreError(f"view '{name}' exists")
        df.createOrReplaceTempView(name)
        self.tables[name] = df
        return df

    def create_cube_aggregate(self, cube: Cube, table_name: str | None = None, dimensions: Iterable[str] | None = None, replace: bool = False, aggregates=None, schema: str | None = None) -> DataFrame:
        """A table of all aggregates at the deepest level of each dimension."""
        name = table_name or self.naming.aggregated_table(cube.name)
        if name == Mapper(cube, self.naming).fact_name:
            raise StoreError(f"'{name}' is the fact table")
        return self._save(cuboids.cuboid(self.browser(cube), dimensions, aggregates), name, replace, schema=schema or self.naming.aggregate_schema)

    def conformed_rollup(self, cube: Cube, dimension: str, level: str | None = None, hierarchy: str | None = None) -> DataFrame:
        """The distinct members of a dimension at a level, with their attributes."""
        d = cube.dimension(dimension)
        h = d.hierarchy(hierarchy)
        depth = h.level_index(level) + 1 if level else len(h)
        chosen: list[Attribute] = [a for x in h.levels[:depth] for a in x.attributes]
        star = self.browser(cube).star
        tables = {ref.table for a in chosen if (ref := star.mapper.physical(a)) is not None}
        if len(tables) == 1 and not any(a.expression for a in chosen):  # all members, also those without facts
            name = next(iter(tables))
            df = star.table(name).alias(name)
        else:
            df = star.frame(chosen)
        return df.select(*(star.column(a).alias(a.name) for a in chosen)).distinct()

    def create_conformed_rollup(self, cube: Cube, dimension: str, level: str | None = None, hierarchy: str | None = None, replace: bool = False, schema: str | None = None) -> DataFrame:
        d = cube.dimension(dimension)
        level = level or d.hierarchy(hierarchy).levels[-1].name
        return self._save(self.conformed_rollup(cube, dimension, level, hierarchy), f"{self.naming.dimension_table(dimension)}_{level}", replace, schema=schema)

    def create_conformed_rollups(self, cube: Cube, dimensions: Iterable[str] | None = None, replace: bool = False) -> dict[str, DataFrame]:
        """A table for every level of the dimensions' default hierarchies."""
        out = {}
        for name in dimensions or cube.dimensions:
            for level in cube.dimension(name).hierarchy().levels:
                out[f"{name}_{level.name}"] = self.create_conformed_rollup(cube, name, level.name, replace=replace)
        return out


_CSV_TYPES = {"integer": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "text": T.StringType(), "date": T.DateType(), "boolean": T.BooleanType()}


def read_csv(spark: SparkSession, path: str, fields: list, create_id: bool = False, id_column: str = "id", **options) -> DataFrame:
    """A CSV file with a heading as a table. A field is a name or (name, type); types are integer, float, string, text, date and boolean. ``create_id`` adds distinct, growing numbers, without a shuffle and thus with gaps between the file's splits."""
    schema = T.StructType()
    for f in fields:
        name, kind = (f, "string") if isinstance(f, str) else f
        if kind.lower() not in _CSV_TYPES:
            raise ArgumentError(f"unknown type '{kind}' of field '{name}'")
        schema.add(name, _CSV_TYPES[kind.lower()])
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", True).options(**options).csv(path)
    return df.select((F.monotonically_increasing_id() + 1).alias(id_column), "*") if create_id else df
