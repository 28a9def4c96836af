"""Models over the benchmark tables, and a query with its SQL for each operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .auth import SimpleAuthorizer
from .functions import scalars
from .model import Cube, ModelProvider
from .namespace import Namespace
from .operators import cuboids
from .operators.browser import Browser
from .operators.crosstab import pivoted
from .plans.calendar import Calendar
from .plans.cells import PointCut
from .plans.expressions import to_column
from .sources.store import SparkStore
from .workspace import Workspace


def _date(name: str, column: str) -> dict:
    parts = ("year", "quarter", "month", "day")
    return {f"{name}.{p}": {"table": column.split(".")[0], "column": column.split(".")[1], "extract": p} for p in parts}


def _geo(name: str, nation: str, region: str) -> dict:
    return {f"{name}.region_key": f"{region}.r_regionkey", f"{name}.region_name": f"{region}.r_name", f"{name}.nation_key": f"{nation}.n_nationkey", f"{name}.nation_name": f"{nation}.n_name"}


_FUNCTIONS = ("sum", "count_nonempty", "count_distinct", "min", "max", "avg", "stddev", "variance")
_WINDOWS = ("wma", "sma", "sms", "smvar", "smstd", "smrsd")

MODEL = {
    "name": "benchmark",
    "dimensions": [
        {"name": "date", "role": "time", "levels": ["year", "quarter", "month", "day"], "hierarchies": [{"name": "ymd", "levels": ["year", "month", "day"]}, {"name": "yqmd", "levels": ["year", "quarter", "month", "day"]}], "default_hierarchy_name": "ymd"},
        {"name": "geo", "levels": [{"name": "region", "attributes": ["region_key", "region_name"]}, {"name": "nation", "attributes": ["nation_key", "nation_name"]}]},
        {"name": "part", "levels": [{"name": "brand", "attributes": ["brand"]}, {"name": "type", "attributes": ["type"]}]},
        {"name": "user", "levels": [{"name": "user", "cardinality": "high"}]},
        "segment", "returnflag", "status", "priority", "event_type", "shipyear",
    ],
    "marts": [
        {
            "name": "sales", "fact": "lineitem",
            "dimensions": ["date", {"name": "date", "alias": "ship_date"}, "geo", {"name": "geo", "alias": "supplier_geo"}, "part", "segment", "returnflag", "status", "shipyear"],
            "measures": [{"name": "quantity"}, {"name": "price"}, {"name": "discount"}, {"name": "revenue", "expression": "price * (1 - discount)"}, {"name": "returned", "expression": "if(returnflag = 'R', quantity, null)"}],
            "details": [{"name": "linenumber"}],
            "aggregates": [
                {"name": "fact_count", "function": "count"}, {"name": "revenue_sum", "measure": "revenue", "function": "sum"}, {"name": "quantity_sum", "measure": "quantity", "function": "sum"},
                *({"name": f"returned_{f}", "measure": "returned", "function": f} for f in _FUNCTIONS), {"name": "price_avg", "measure": "price", "function": "average"},
                {"name": "charge", "expression": "sum(price) - sum(price * discount)"}, {"name": "unit_price", "expression": "revenue_sum / quantity_sum"},
                *({"name": f"quantity_{w}", "measure": "quantity_sum", "function": w, "window_size": 3} for w in _WINDOWS),
            ],
            "joins": [
                {"master": "l_orderkey", "detail": "orders.o_orderkey"}, {"master": "orders.o_custkey", "detail": "customer.c_custkey"}, {"master": "customer.c_nationkey", "detail": "nation.n_nationkey", "alias": "n_c"},
                {"master": "n_c.n_regionkey", "detail": "region.r_regionkey", "alias": "r_c"}, {"master": "l_partkey", "detail": "part.p_partkey"}, {"master": "l_suppkey", "detail": "supplier.s_suppkey"},
                {"master": "supplier.s_nationkey", "detail": "nation.n_nationkey", "alias": "n_s"}, {"master": "n_s.n_regionkey", "detail": "region.r_regionkey", "alias": "r_s"},
            ],
            "mappings": {
                **_date("date", "orders.o_orderdate"), **_date("ship_date", "lineitem.l_shipdate"), **_geo("geo", "n_c", "r_c"), **_geo("supplier_geo", "n_s", "r_s"),
                "part.brand": "part.p_brand", "part.type": "part.p_type", "segment.segment": "customer.c_mktsegment", "returnflag.returnflag": "l_returnflag", "status.status": "orders.o_orderstatus",
                "shipyear.shipyear": {"column": "l_shipdate", "function": "year"}, "quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "linenumber": "l_linenumber",
            },
        },
        {
            "name": "orders", "fact": "orders", "key": "o_orderkey", "dimensions": ["date", "geo", "segment", "status", "priority"],
            "measures": [{"name": "total"}, {"name": "big", "expression": "if(total > 200000, 1, 0)"}], "details": [{"name": "label"}],
            "aggregates": [{"name": "fact_count", "function": "count"}, {"name": "total_sum", "measure": "total", "function": "sum"}, {"name": "big_sum", "measure": "big", "function": "sum"}],
            "joins": [{"master": "o_custkey", "detail": "customer.c_custkey"}, {"master": "customer.c_nationkey", "detail": "nation.n_nationkey"}, {"master": "nation.n_regionkey", "detail": "region.r_regionkey"}],
            "mappings": {**_date("date", "orders.o_orderdate"), **_geo("geo", "nation", "region"), "segment.segment": "customer.c_mktsegment", "status.status": "o_orderstatus", "priority.priority": "o_orderpriority", "total": "o_totalprice", "label": "o_orderstatus"},
        },
        {
            "name": "events", "fact": "events", "key": "event_id", "dimensions": ["date", "event_type", "user"], "measures": ["value"],
            "aggregates": [{"name": "fact_count", "function": "count"}, {"name": "value_sum", "measure": "value", "function": "sum"}],
            "mappings": {**_date("date", "events.ts"), "event_type.event_type": "event_type", "user.user": "user_id"},
        },
    ],
}


def browser(spark: SparkSession, sf_dir: str, cube: str = "sales", statements: dict[str, DataFrame] | None = None, change: dict | None = None, **options) -> Browser:
    provider = ModelProvider(MODEL | ({"marts": [(c | change if c["name"] == cube else c) for c in MODEL["marts"]]} if change else {}))
    space = Namespace()
    space.add_provider(provider)
    made: Cube = space.cube(cube)
    return Browser(made, SparkStore(spark, sf_dir).table, statements=statements, **options)


def plain(df: DataFrame, digits: int = 4) -> DataFrame:
    """Names without dots, whole numbers as 64-bit ones, and others rounded: what compares across engines."""
    made = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegralType):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        made.append(c.alias(f.name.replace(".", "_")))
    return df.select(*made)


def cells(**args) -> Callable[[SparkSession, str], DataFrame]:
    """A query of the cells of an aggregation, or its summary where nothing is drilled down."""
    of = {k: args.pop(k) for k in ("cube", "change", "calendar", "coalesce", "exclude_null_aggregates") if k in args}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = browser(spark, sf_dir, **of).aggregate(**args)
        return plain(result.cells_frame if result.cells_frame is not None else result.summary_frame)

    return run


# Parts of the SQL

_L = "FROM lineitem"
_O = " JOIN orders ON l_orderkey = o_orderkey"
_C = _O + " JOIN customer ON o_custkey = c_custkey"
_G = _C + " JOIN nation n_c ON c_nationkey = n_c.n_nationkey JOIN region r_c ON n_c.n_regionkey = r_c.r_regionkey"
_S = " JOIN supplier ON l_suppkey = s_suppkey JOIN nation n_s ON s_nationkey = n_s.n_nationkey JOIN region r_s ON n_s.n_regionkey = r_s.r_regionkey"
_OG = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _part(p: str, column: str = "o_orderdate", name: str = "date") -> str:
    return f"CAST({p}({column}) AS BIGINT) AS {name}_{p}"


def _sel(keys: list[str], aggregates: list[str], rest: str) -> str:
    group = f" GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))}" if keys else ""
    return f"SELECT {', '.join([*keys, *aggregates])} {rest}{group}"


_COUNT, _QTY, _REV = "CAST(count(*) AS BIGINT) AS fact_count", "round(sum(l_quantity), 4) AS quantity_sum", "round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue_sum"
_Y, _M, _D, _Q = (_part(p) for p in ("year", "month", "day", "quarter"))
_REGION = ["CAST(r_c.r_regionkey AS BIGINT) AS geo_region_key", "r_c.r_name AS geo_region_name"]
_NATION = ["CAST(n_c.n_nationkey AS BIGINT) AS geo_nation_key", "n_c.n_name AS geo_nation_name"]
_BASE = ["fact_count", "quantity_sum"]
_YM = f"SELECT * FROM ({_sel([_Y, _M], [_COUNT, _QTY], _L + _O)})"

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    _QUERIES[name] = (run, sql)


# Group-by shapes

_add("flagship", cells(cell="date:1996-1997|geo:1;2;3", aggregates=["revenue_sum", "quantity_sum", "fact_count"], drilldown=["geo:nation", "date:year"]),
     _sel([*_REGION, *_NATION, _Y], [_REV, _QTY, _COUNT], _L + _G + " WHERE year(o_orderdate) BETWEEN 1996 AND 1997 AND r_c.r_regionkey IN (1, 2, 3)"))
_add("summary", cells(aggregates=["fact_count", "quantity_sum", "revenue_sum"]), _sel([], [_COUNT, _QTY, _REV], _L))
_add("drilldown_1_level", cells(aggregates=_BASE, drilldown=["date"]), _sel([_Y], [_COUNT, _QTY], _L + _O))
_add("drilldown_2_levels", cells(aggregates=_BASE, drilldown=["date:month"]), _sel([_Y, _M], [_COUNT, _QTY], _L + _O))
_add("drilldown_3_levels", cells(aggregates=_BASE, drilldown=["date:day"]), _sel([_Y, _M, _D], [_COUNT, _QTY], _L + _O))
_add("drilldown_alt_hierarchy", cells(aggregates=_BASE, drilldown=["date@yqmd:month"]), _sel([_Y, _Q, _M], [_COUNT, _QTY], _L + _O))
_add("drilldown_two_dims", cells(aggregates=_BASE, drilldown=["segment", "returnflag"]), _sel(["c_mktsegment AS segment_segment", "l_returnflag AS returnflag_returnflag"], [_COUNT, _QTY], _L + _C))
_add("drilldown_labels", cells(aggregates=_BASE, drilldown=["geo:nation"]), _sel([*_REGION, *_NATION], [_COUNT, _QTY], _L + _G))
_add("drilldown_next_level", cells(cell="date:1996", aggregates=_BASE, drilldown=["date"]), _sel([_Y, _M], [_COUNT, _QTY], _L + _O + " WHERE year(o_orderdate) = 1996"))

# Cuts

_CUTS = {
    "cut_point": ("date:1996", "year(o_orderdate) = 1996"),
    "cut_point_deep": ("date:1996,3,15", "year(o_orderdate) = 1996 AND month(o_orderdate) = 3 AND day(o_orderdate) = 15"),
    "cut_point_inverted": ("!date:1996", "NOT year(o_orderdate) = 1996"),
    "cut_set": ("date:1995;1997;1999", "year(o_orderdate) IN (1995, 1997, 1999)"),
    "cut_set_uneven": ("date:1995;1996,2;1997,3,4", "(year(o_orderdate) = 1995 OR (year(o_orderdate) = 1996 AND month(o_orderdate) = 2) OR (year(o_orderdate) = 1997 AND month(o_orderdate) = 3 AND day(o_orderdate) = 4))"),
    "cut_set_inverted": ("!date:1995;1996,2", "NOT (year(o_orderdate) = 1995 OR (year(o_orderdate) = 1996 AND month(o_orderdate) = 2))"),
    "cut_range": ("date:1996,3-1997,2", "year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199603 AND 199702"),
    "cut_range_uneven": ("date:1996,3,15-1998", "(year(o_orderdate) * 100 + month(o_orderdate)) * 100 + day(o_orderdate) >= 19960315 AND year(o_orderdate) <= 1998"),
    "cut_range_open_low": ("date:-1996,6", "year(o_orderdate) * 100 + month(o_orderdate) <= 199606"),
    "cut_range_open_high": ("date:1999,6-", "year(o_orderdate) * 100 + month(o_orderdate) >= 199906"),
    "cut_range_inverted": ("!date:1996,3-1997,2", "NOT (year(o_orderdate) * 100 + month(o_orderdate) BETWEEN 199603 AND 199702)"),
    "cut_alt_hierarchy": ("date@yqmd:1996,2", "year(o_orderdate) = 1996 AND quarter(o_orderdate) = 2"),
    "cut_multi": ("date:1996-1998|returnflag:R;A|!status:P", "year(o_orderdate) BETWEEN 1996 AND 1998 AND l_returnflag IN ('R', 'A') AND NOT o_orderstatus = 'P'"),
    "cut_unconvertible": ("date:1996;nonsense", "year(o_orderdate) = 1996"),
}
for _name, (_cut, _where) in _CUTS.items():
    _add(_name, cells(cell=_cut, aggregates=_BASE, drilldown=["returnflag"]), _sel(["l_returnflag AS returnflag_returnflag"], [_COUNT, _QTY], f"{_L}{_O} WHERE {_where}"))


def _null_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = SparkStore(spark, sf_dir).table("orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    b = browser(spark, sf_dir, "orders", statements={"orders": orders})
    parts = [b.aggregate(cell, ["fact_count"]).summary_frame.select(F.lit(name).alias("which"), "fact_count") for name, cell in (("null", [PointCut("status", [None])]), ("not_null", [PointCut("status", [None], invert=True)]), ("not_f", "!status:F"))]
    return plain(reduce(DataFrame.unionByName, parts))


_add("cut_null_path", _null_path, "SELECT 'null' AS which, CAST(count(*) AS BIGINT) AS fact_count FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'not_null', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'not_f', CAST(count(*) AS BIGINT) FROM orders WHERE o_orderstatus NOT IN ('P', 'F')")
_add("cut_calendar", cells(cell="date:last3months-", aggregates=_BASE, calendar=Calendar(now=datetime(1999, 6, 15))), _sel([], [_COUNT, _QTY], _L + _O + " WHERE o_orderdate >= TIMESTAMP '1999-03-01'"))
_add("split", cells(aggregates=_BASE, split="date:1996-1997"), _sel(["year(o_orderdate) BETWEEN 1996 AND 1997 AS __within_split__"], [_COUNT, _QTY], _L + _O))
_add("split_drilldown", cells(aggregates=_BASE, split="returnflag:R", drilldown=["geo"]), _sel(["l_returnflag = 'R' AS __within_split__", *_REGION], [_COUNT, _QTY], _L + _G))

# Aggregates; "returned" is null for most facts

_RET = "CASE WHEN l_returnflag = 'R' THEN l_quantity END"
_AGGREGATES = {
    "sum": (f"coalesce(sum({_RET}), 0)", f"sum({_RET})"), "count_nonempty": (f"CAST(count({_RET}) AS BIGINT)",) * 2, "count_distinct": (f"CAST(count(DISTINCT {_RET}) AS BIGINT)",) * 2,
    "min": (f"min(coalesce({_RET}, 0))", f"min({_RET})"), "max": (f"max(coalesce({_RET}, 0))", f"max({_RET})"), "avg": (f"avg(coalesce({_RET}, 0))", f"avg({_RET})"),
    "stddev": (f"stddev_samp(coalesce({_RET}, 0))", f"stddev_samp({_RET})"), "variance": (f"var_samp(coalesce({_RET}, 0))", f"var_samp({_RET})"),
}
for _name, (_filled, _bare) in _AGGREGATES.items():
    _whole = _name.startswith("count")
    for _suffix, _expr, _on in (("", _filled, True), ("_plain", _bare, False)):
        _add(f"agg_{_name}{_suffix}", cells(aggregates=[f"returned_{_name}"], drilldown=["segment"], coalesce=_on), _sel(["c_mktsegment AS segment_segment"], [f"{_expr if _whole else f'round({_expr}, 4)'} AS returned_{_name}"], _L + _C))
_add("agg_count", cells(aggregates=["fact_count"], drilldown=["segment"]), _sel(["c_mktsegment AS segment_segment"], [_COUNT], _L + _C))
_add("agg_average_alias", cells(aggregates=["price_avg"], drilldown=["returnflag"]), _sel(["l_returnflag AS returnflag_returnflag"], ["round(avg(l_extendedprice), 4) AS price_avg"], _L))
_add("agg_expression", cells(aggregates=["charge"], drilldown=["returnflag"]), _sel(["l_returnflag AS returnflag_returnflag"], ["round(sum(l_extendedprice) - sum(l_extendedprice * l_discount), 4) AS charge"], _L))
_add("agg_expression_of_aggregates", cells(aggregates=["unit_price"], drilldown=["returnflag"]), _sel(["l_returnflag AS returnflag_returnflag"], [_REV, _QTY, "round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 4) AS unit_price"], _L))
_add("measure_expression", cells(aggregates=["revenue_sum"], drilldown=["returnflag"]), _sel(["l_returnflag AS returnflag_returnflag"], [_REV], _L))
_add("measure_expression_if", cells(cube="orders", aggregates=["big_sum"], drilldown=["status"]), "SELECT o_orderstatus AS status_status, CAST(count(*) FILTER (WHERE o_totalprice > 200000) AS BIGINT) AS big_sum FROM orders GROUP BY 1")
_add("agg_exclude_null", cells(aggregates=["returned_min"], drilldown=["returnflag"], coalesce=False, exclude_null_aggregates=True), "SELECT 'R' AS returnflag_returnflag, round(min(l_quantity), 4) AS returned_min FROM lineitem WHERE l_returnflag = 'R'")


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = browser(spark, sf_dir).aggregate(aggregates=["quantity_sum"], drilldown=["returnflag"]).cells_frame.toDF("flag", "quantity_sum")
    provider = ModelProvider({"marts": [{"name": "ready", "dimensions": ["flag"], "aggregates": [{"name": "quantity_sum"}], "mappings": {"flag.flag": "flag"}}], "dimensions": ["flag"]})
    cube = provider.cube("ready").link(lambda n: provider.dimension(n))
    return plain(Browser(cube, lambda name, schema: made).aggregate(drilldown=["flag"]).cells_frame)


_add("agg_native_column", _native, "SELECT l_returnflag AS flag_flag, round(sum(l_quantity), 4) AS quantity_sum FROM lineitem GROUP BY 1")
_add("mapping_extract", cells(aggregates=_BASE, drilldown=["ship_date:month"]), _sel([_part("year", "l_shipdate", "ship_date"), _part("month", "l_shipdate", "ship_date")], [_COUNT, _QTY], _L))
_add("mapping_function", cells(aggregates=_BASE, drilldown=["shipyear"]), _sel(["CAST(year(l_shipdate) AS BIGINT) AS shipyear_shipyear"], [_COUNT, _QTY], _L))

# Joins


def _outer(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Both whole tables, with keys that have no match on either side.
        store = SparkStore(spark, sf_dir)
        orders = store.table("orders").withColumn("o_custkey", F.expr("CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END"))
        customers = store.table("customer").withColumn("c_custkey", F.expr("CASE WHEN c_acctbal < 1000 THEN -c_custkey - 1000000000 ELSE c_custkey END"))
        joins = [{"master": "o_custkey", "detail": "customer.c_custkey", "method": method}]
        return plain(browser(spark, sf_dir, "orders", {"orders": orders, "customer": customers}, {"joins": joins, "dimensions": ["segment"]}).aggregate(aggregates=["fact_count", "total_sum"], drilldown=["segment"]).cells_frame)

    return run


for _method, _kind in (("match", "INNER"), ("master", "LEFT"), ("detail", "RIGHT")):
    _add(f"join_{_method}", _outer(_method), f"SELECT c_mktsegment AS segment_segment, CAST(count(o_orderkey) AS BIGINT) AS fact_count, round(coalesce(sum(o_totalprice), 0), 4) AS total_sum FROM (SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS o_custkey) FROM orders) {_kind} JOIN (SELECT * REPLACE (CASE WHEN c_acctbal < 1000 THEN -c_custkey - 1000000000 ELSE c_custkey END AS c_custkey) FROM customer) ON o_custkey = c_custkey GROUP BY 1")


def _summary_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary over customers of five nations only, which just the drilldown joins."""
    customers = SparkStore(spark, sf_dir).table("customer").where("c_nationkey < 5")
    return plain(browser(spark, sf_dir, "orders", {"customer": customers}).aggregate(aggregates=["fact_count", "total_sum"], drilldown=["segment"]).summary_frame)


_add("summary_inner_join", _summary_inner, "SELECT CAST(count(*) AS BIGINT) AS fact_count, round(sum(o_totalprice), 4) AS total_sum FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 5")


def _inverted_nonsense(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = SparkStore(spark, sf_dir).table("orders").withColumn("o_orderdate", F.expr("CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END"))
    return plain(browser(spark, sf_dir, "orders", {"orders": orders}).aggregate("!date:nonsense", ["fact_count"], ["status"]).cells_frame)


_add("cut_inverted_unconvertible", _inverted_nonsense, "SELECT o_orderstatus AS status_status, CAST(count(*) AS BIGINT) AS fact_count FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
_add("join_alias_roleplay", cells(aggregates=_BASE, drilldown=["geo", "supplier_geo"]), _sel([*_REGION, "CAST(r_s.r_regionkey AS BIGINT) AS supplier_geo_region_key", "r_s.r_name AS supplier_geo_region_name"], [_COUNT, _QTY], _L + _G + _S))


def _compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = SparkStore(spark, sf_dir).table("lineitem")
    detail = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    change = {"dimensions": ["returnflag"], "joins": [{"master": {"column": ["l_orderkey", "l_linenumber"]}, "detail": {"table": "flags", "column": ["l_orderkey", "l_linenumber"]}}], "mappings": {**MODEL["marts"][0]["mappings"], "returnflag.returnflag": "flags.flag"}, "aggregates": [{"name": "fact_count", "function": "count"}, {"name": "quantity_sum", "measure": "quantity", "function": "sum"}], "measures": ["quantity"]}
    return plain(browser(spark, sf_dir, "sales", {"flags": detail}, change).aggregate(drilldown=["returnflag"]).cells_frame)


_add("join_compound", _compound, f"SELECT f.flag AS returnflag_returnflag, {_COUNT}, {_QTY} FROM lineitem l JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL) f ON l.l_orderkey = f.l_orderkey AND l.l_linenumber = f.l_linenumber GROUP BY 1")
_add("join_snowflake", cells(cube="orders", aggregates=["fact_count", "total_sum"], drilldown=["geo:nation"]), f"SELECT CAST(r_regionkey AS BIGINT) AS geo_region_key, r_name AS geo_region_name, CAST(n_nationkey AS BIGINT) AS geo_nation_key, n_name AS geo_nation_name, CAST(count(*) AS BIGINT) AS fact_count, round(sum(o_totalprice), 4) AS total_sum {_OG} GROUP BY ALL")
_add("join_pruned", cells(aggregates=_BASE, drilldown=["part:brand"]), _sel(["p_brand AS part_brand"], [_COUNT, _QTY], _L + " JOIN part ON l_partkey = p_partkey"))

# Order and pages

_add("order_explicit", cells(aggregates=_BASE, drilldown=["date:month"], order=["quantity_sum:desc"]), _YM)
_add("order_natural_page", cells(aggregates=_BASE, drilldown=["date:month"], page=1, page_size=10), _YM + " ORDER BY date_year, date_month LIMIT 10 OFFSET 10")
_add("page", cells(aggregates=_BASE, drilldown=["date:month"], order=["quantity_sum:desc"], page=2, page_size=7), _YM + " ORDER BY quantity_sum DESC, date_year, date_month LIMIT 7 OFFSET 14")
_add("topk", cells(aggregates=_BASE, drilldown=["part:type"], order=["quantity_sum:desc"], page=0, page_size=10), f"SELECT * FROM ({_sel(['p_brand AS part_brand', 'p_type AS part_type'], [_COUNT, _QTY], _L + ' JOIN part ON l_partkey = p_partkey')}) ORDER BY quantity_sum DESC, part_brand, part_type LIMIT 10")
_add("order_post_aggregate", cells(aggregates=["quantity_sum", "quantity_sma"], drilldown=["date"], order=["quantity_sma:desc"], page=0, page_size=3), f"SELECT * FROM (SELECT date_year, quantity_sum, round_even(avg(quantity_sum) OVER (ORDER BY date_year ROWS 2 PRECEDING), 2) AS quantity_sma FROM ({_sel([_Y], [_QTY], _L + _O)})) ORDER BY quantity_sum DESC LIMIT 3")
_add("total_cell_count", lambda spark, sf_dir: plain(browser(spark, sf_dir).aggregate(aggregates=["fact_count"], drilldown=["date:month"], page=0, page_size=5).all_cells_frame.agg(F.count(F.lit(1)).alias("total_cell_count"))), f"SELECT CAST(count(*) AS BIGINT) AS total_cell_count FROM ({_YM})")
_add("high_cardinality_page", cells(cube="events", aggregates=["fact_count"], drilldown=["user"], page=0, page_size=20), "SELECT user_id AS user_user, CAST(count(*) AS BIGINT) AS fact_count FROM events GROUP BY 1 ORDER BY 1 LIMIT 20")

# Facts and members


def _facts(cube: str = "orders", **args) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(browser(spark, sf_dir, cube).facts(**args))


_FACT = "SELECT o_orderkey AS __fact_key__, c_mktsegment AS segment_segment, round(o_totalprice, 4) AS total FROM orders JOIN customer ON o_custkey = c_custkey"
_FIELDS = ["segment", "total"]
_add("facts", _facts(cell="date:1996,3|status:F", fields=_FIELDS), _FACT + " WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 3 AND o_orderstatus = 'F'")
_add("facts_all_fields", _facts(cell="date:1996,3,1-1996,3,3"), f"SELECT o_orderkey AS __fact_key__, {_Y}, {_Q}, {_M}, {_D}, CAST(r_regionkey AS BIGINT) AS geo_region_key, r_name AS geo_region_name, CAST(n_nationkey AS BIGINT) AS geo_nation_key, n_name AS geo_nation_name, c_mktsegment AS segment_segment, o_orderstatus AS status_status, o_orderpriority AS priority_priority, round(o_totalprice, 4) AS total, CAST(o_totalprice > 200000 AS BIGINT) AS big, o_orderstatus AS label {_OG} WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-03-04'")
_add("facts_page", _facts(fields=_FIELDS, order=["total:desc"], page=1, page_size=20), _FACT + " ORDER BY o_totalprice DESC LIMIT 20 OFFSET 20")
_add("facts_list", _facts(fields=_FIELDS, fact_list=[1, 2, 3, 5, 8]), _FACT + " WHERE o_orderkey IN (1, 2, 3, 5, 8)")
_add("fact", _facts(fields=_FIELDS, fact_list=[7]), _FACT + " WHERE o_orderkey = 7")


def _members(cube: str = "orders", **args) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(browser(spark, sf_dir, cube).members(**args))


_GEO = "CAST(r_regionkey AS BIGINT) AS geo_region_key, r_name AS geo_region_name"
_GEO2 = _GEO + ", CAST(n_nationkey AS BIGINT) AS geo_nation_key, n_name AS geo_nation_name"
_add("members", _members(dimension="geo"), f"SELECT DISTINCT {_GEO2} {_OG}")
_add("members_depth", _members(dimension="geo", depth=1), f"SELECT DISTINCT {_GEO} {_OG}")
_add("members_level", _members(dimension="date", level="month"), f"SELECT DISTINCT {_Y}, {_M} FROM orders")
_add("members_in_cell", _members(cell="geo:1|date:1996", dimension="geo"), f"SELECT DISTINCT {_GEO2} {_OG} WHERE r_regionkey = 1 AND year(o_orderdate) = 1996")
_add("members_page", _members(dimension="date", page=1, page_size=15, order=["date.year:desc"]), f"SELECT DISTINCT {_Y}, {_M}, {_D} FROM orders ORDER BY 1 DESC, 2, 3 LIMIT 15 OFFSET 15")


def _members_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = browser(spark, sf_dir, "orders")
    cut = b.cell("geo:1,1;2,8;2,9;3,99").cuts[0]
    return plain(b.members_of_paths(cut, list(cut.paths)))


_add("set_details", _members_of_paths, f"SELECT DISTINCT {_GEO2} {_OG} WHERE (r_regionkey = 1 AND n_nationkey = 1) OR (r_regionkey = 2 AND n_nationkey IN (8, 9))")


def _path_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = browser(spark, sf_dir, "orders").path_details("geo", [1, 1])
    schema = T.StructType([T.StructField(k, T.LongType() if isinstance(v, int) else T.StringType()) for k, v in found.items()])
    return plain(spark.createDataFrame([tuple(found.values())], schema))


_add("path_details", _path_details, f"SELECT DISTINCT {_GEO2} FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 1 AND n_nationkey = 1")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = browser(spark, sf_dir, "orders")
    found = b.report("date:1996,3", {"by_status": {"query": "aggregate", "drilldown": ["status"], "aggregates": ["fact_count"]}, "year": {"query": "aggregate", "rollup": "date", "aggregates": ["fact_count"]}})
    parts = [found["by_status"].cells_frame.select(F.lit("by_status").alias("query"), F.col("`status.status`").alias("status"), "fact_count"), found["year"].summary_frame.select(F.lit("year").alias("query"), F.lit(None).cast("string").alias("status"), "fact_count")]
    return plain(parts[0].unionByName(parts[1]))


_add("report", _report, "SELECT 'by_status' AS query, o_orderstatus AS status, CAST(count(*) AS BIGINT) AS fact_count FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 3 GROUP BY 2 UNION ALL SELECT 'year', NULL, CAST(count(*) AS BIGINT) FROM orders WHERE year(o_orderdate) = 1996")
_add("rollup_cell", lambda spark, sf_dir: plain((b := browser(spark, sf_dir)).aggregate(b.cell("date:1996,3,15|returnflag:R").rollup({"date": "year"}), _BASE).summary_frame), _sel([], [_COUNT, _QTY], _L + _O + " WHERE year(o_orderdate) = 1996 AND l_returnflag = 'R'"))

# Moving windows over months

_W = "OVER (ORDER BY date_year, date_month ROWS 2 PRECEDING)"
_VAR = f"coalesce(var_samp(quantity_sum) {_W}, 0)"
_WINDOW_SQL = {
    "sma": f"round_even(avg(quantity_sum) {_W}, 2)", "sms": f"sum(quantity_sum) {_W}", "smvar": f"round_even({_VAR}, 2)", "smstd": f"round_even(sqrt({_VAR}), 2)",
    "smrsd": f"round_even(CASE WHEN avg(quantity_sum) {_W} > 0 THEN sqrt({_VAR}) / avg(quantity_sum) {_W} ELSE 0 END, 4)",
    "wma": "round_even(CASE WHEN b IS NULL THEN quantity_sum WHEN c IS NULL THEN (b + 2 * quantity_sum) / 3 ELSE (c + 2 * b + 3 * quantity_sum) / 6 END, 4)",
}
_MONTHS = f"SELECT *, lag(quantity_sum) OVER (ORDER BY date_year, date_month) AS b, lag(quantity_sum, 2) OVER (ORDER BY date_year, date_month) AS c FROM ({_sel([_Y, _M], [_QTY], _L + _O)})"
for _name, _expr in _WINDOW_SQL.items():
    _add(f"window_{_name}", cells(aggregates=[f"quantity_{_name}"], drilldown=["date:month"]), f"SELECT date_year, date_month, quantity_sum, round({_expr}, 4) AS quantity_{_name} FROM ({_MONTHS})")
_add("window_split", cells(aggregates=["quantity_sma"], drilldown=["date"], split="returnflag:R"), f"SELECT __within_split__, date_year, quantity_sum, round_even(avg(quantity_sum) OVER (PARTITION BY __within_split__ ORDER BY date_year ROWS 2 PRECEDING), 2) AS quantity_sma FROM ({_sel(['l_returnflag = ' + chr(39) + 'R' + chr(39) + ' AS __within_split__', _Y], [_QTY], _L + _O)})")

# Cross tables, grouping sets and cuboids


def _cross(place: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = browser(spark, sf_dir).aggregate(aggregates=["fact_count", "quantity_sum"], drilldown=["returnflag", "geo"]).cells_frame
        if place == "columns":
            return plain(pivoted(found, ["geo.region_name"], "returnflag.returnflag", ["A", "N", "R"], _BASE))
        if place == "cells":
            return plain(pivoted(found.withColumn("both", F.concat_ws("/", F.col("fact_count"), F.col("quantity_sum").cast("long"))), ["geo.region_name"], "returnflag.returnflag", ["A", "N", "R"], ["both"]))
        long = found.select("`geo.region_name`", "`returnflag.returnflag`", F.explode(F.array(*(F.struct(F.lit(a).alias("aggregate"), F.col(a).cast("double").alias("value")) for a in _BASE))).alias("x")).select("`geo.region_name`", "`returnflag.returnflag`", "x.*")
        return plain(pivoted(long, ["geo.region_name", "aggregate"], "returnflag.returnflag", ["A", "N", "R"], ["value"]))

    return run


def _filtered(e: str, flag: str) -> str:
    return f"{e} FILTER (WHERE l_returnflag = '{flag}')"


_add("cross_table_columns", _cross("columns"), "SELECT r_c.r_name AS geo_region_name, " + ", ".join(f"CAST(nullif({_filtered('count(*)', f)}, 0) AS BIGINT) AS {f}_fact_count, round({_filtered('sum(l_quantity)', f)}, 4) AS {f}_quantity_sum" for f in "ANR") + f" {_L}{_G} GROUP BY 1")
_add("cross_table_rows", _cross("rows"), " UNION ALL ".join("SELECT r_c.r_name AS geo_region_name, '" + a + "' AS aggregate, " + ", ".join(f"round(CAST({_filtered(e, f)} AS DOUBLE), 4) AS {f}_value" for f in "ANR") + f" {_L}{_G} GROUP BY 1" for a, e in (("fact_count", "count(*)"), ("quantity_sum", "sum(l_quantity)"))))
_add("cross_table_cells", _cross("cells"), "SELECT r_c.r_name AS geo_region_name, " + ", ".join(f"{_filtered('count(*)', f)} || '/' || CAST({_filtered('sum(l_quantity)', f)} AS BIGINT) AS {f}_both" for f in "ANR") + f" {_L}{_G} GROUP BY 1")
_add("grouping_sets", lambda spark, sf_dir: plain(cuboids.grouping_sets(browser(spark, sf_dir), "date:1996-1998", _BASE, [[], ["returnflag"], ["returnflag", "date"]])), f"SELECT CASE grouping_id(l_returnflag, year(o_orderdate)) WHEN 3 THEN 0 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS __set__, l_returnflag AS returnflag_returnflag, CAST(year(o_orderdate) AS BIGINT) AS date_year, {_COUNT}, {_QTY} {_L}{_O} WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, year(o_orderdate)))")


def _cuboid_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = [browser(spark, sf_dir).cube.dimension(n) for n in ("date", "geo", "returnflag")]
    found = cuboids.hierarchical_cuboids(dims, default_only=True)
    return spark.createDataFrame([("/".join(f"{d}:{x}" for d, _, x in c),) for c in found], "cuboid string")


_add("cuboid_enumeration", _cuboid_enumeration, "WITH d AS (SELECT unnest(['', 'date:year', 'date:month', 'date:day']) AS a), g AS (SELECT unnest(['', 'geo:region', 'geo:nation']) AS b), r AS (SELECT unnest(['', 'returnflag:returnflag']) AS c) SELECT concat_ws('/', nullif(a, ''), nullif(b, ''), nullif(c, '')) AS cuboid FROM d, g, r WHERE a <> '' OR b <> '' OR c <> ''")


def _rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = browser(spark, sf_dir)
    made = cuboids.cuboid(b, ["date", "returnflag"], _BASE)
    return plain(cuboids.CuboidRewriter(b, made).grouped("date:1996-1998", ["date:month"], _BASE))


_add("cuboid_rewrite", _rewrite, _sel([_Y, _M], [_COUNT, _QTY], _L + _O + " WHERE year(o_orderdate) BETWEEN 1996 AND 1998"))


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = SparkStore(spark, sf_dir)
    cube = browser(spark, sf_dir, "orders").cube
    wide = store.denormalized(cube)
    return plain(SparkStore(spark, tables={"wide": wide}).wide_browser(cube.__class__(**{**cube.__dict__, "key": None}), "wide").aggregate("geo:1;2", ["fact_count", "total_sum"], ["date"]).cells_frame)


_add("denormalized", _wide, f"SELECT {_Y}, CAST(count(*) AS BIGINT) AS fact_count, round(sum(o_totalprice), 4) AS total_sum {_OG} WHERE r_regionkey IN (1, 2) GROUP BY 1")
_add("conformed_rollup", lambda spark, sf_dir: plain(SparkStore(spark, sf_dir).conformed_rollup(browser(spark, sf_dir).cube, "part", "type")), "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")

# Languages and rights


def _authorized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = {"ann": {"allowed_marts": ["orders"], "cell_restrictions": {"orders": ["geo:1"]}}}
    w = Workspace(spark, {"store": {"path": sf_dir}}, SimpleAuthorizer(rights))
    w.import_model(MODEL)
    return plain(w.browser("orders", identity="ann").aggregate("date:1996", ["fact_count"], ["geo:nation"]).cells_frame)


def _authorized_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the members that a cell names, those that the identity may see."""
    rights = {"ann": {"allowed_marts": ["orders"], "cell_restrictions": {"orders": ["geo:1"]}}}
    w = Workspace(spark, {"store": {"path": sf_dir}}, SimpleAuthorizer(rights))
    w.import_model(MODEL)
    b = w.browser("orders", identity="ann")
    cut = b.cell("geo:1;2;3").cuts[0]
    return plain(b.members_of_paths(cut, list(cut.paths)))


_add("authorized_details", _authorized_details, f"SELECT DISTINCT {_GEO} {_OG} WHERE r_regionkey = 1")
_add("authorized_cell", _authorized, f"SELECT {_GEO2}, CAST(count(*) AS BIGINT) AS fact_count {_OG} WHERE r_regionkey = 1 AND year(o_orderdate) = 1996 GROUP BY ALL")


def _localized(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = SparkStore(spark, sf_dir).table("part").select("p_partkey", F.col("p_brand").alias("brand_en"), F.concat(F.lit("Marke "), F.substring("p_brand", 7, 10)).alias("brand_de"))
    model = {"marts": [{"name": "parts", "fact": "part", "key": "p_partkey", "dimensions": ["brand"]}], "dimensions": [{"name": "brand", "levels": [{"name": "brand", "attributes": [{"name": "brand", "locales": ["en", "de"]}]}]}]}
    provider = ModelProvider(model)
    cube = provider.cube("parts").link(lambda n: provider.dimension(n))
    return plain(Browser(cube, lambda name, schema: parts, locale="de").aggregate(drilldown=["brand"]).cells_frame)


_add("localized_column", _localized, "SELECT 'Marke ' || substr(p_brand, 7, 10) AS brand_brand, CAST(count(*) AS BIGINT) AS fact_count FROM part GROUP BY 1")

# Scalar functions and expressions, over parts

_SCALARS = {
    "lower": ("lower(p_brand)", "lower(p_brand)"), "upper": ("upper(p_name)", "upper(p_name)"), "left": ("left(p_brand, 3)", "left(p_brand, 3)"), "right": ("right(p_brand, 2)", "right(p_brand, 2)"),
    "substr": ("substr(p_brand, 2, 3)", "substr(p_brand, 2, 3)"), "lpad": ("lpad(p_brand, 12, '*')", "lpad(p_brand, 12, '*')"), "rpad": ("rpad(p_brand, 12, '*')", "rpad(p_brand, 12, '*')"),
    "replace": ("replace(p_brand, 'Brand', 'B')", "replace(p_brand, 'Brand', 'B')"), "concat": ("concat(p_brand, '-', p_type)", "concat(p_brand, '-', p_type)"), "repeat": ("repeat(p_brand, 2)", "repeat(p_brand, 2)"),
    "position": ("position('d', p_brand)", "CAST(position('d' IN p_brand) AS BIGINT)"), "round": ("round(p_retailprice / 7, 2)", "round(p_retailprice / 7, 2)"), "trunc": ("trunc(-p_retailprice)", "CAST(trunc(-p_retailprice) AS DOUBLE)"),
    "floor": ("floor(p_retailprice)", "CAST(floor(p_retailprice) AS BIGINT)"), "ceil": ("ceil(p_retailprice)", "CAST(ceil(p_retailprice) AS BIGINT)"), "mod": ("mod(p_size, 7)", "CAST(p_size % 7 AS BIGINT)"),
    "remainder": ("remainder(p_size, 7)", "CAST(p_size - 7 * round_even(p_size / 7.0, 0) AS DOUBLE)"), "sign": ("sign(p_size - 20)", "CAST(sign(p_size - 20) AS DOUBLE)"), "least": ("min(p_size, 20)", "CAST(least(p_size, 20) AS BIGINT)"),
    "greatest": ("max(p_size, 20)", "CAST(greatest(p_size, 20) AS BIGINT)"), "pow": ("pow(p_size, 2)", "round(CAST(pow(p_size, 2) AS DOUBLE), 4)"), "exp": ("exp(p_size / 50)", "round(exp(p_size / 50.0), 4)"),
    "log": ("log(p_size + 1)", "round(log10(p_size + 1), 4)"), "log10": ("log10(p_size + 1)", "round(log10(p_size + 1), 4)"), "sqrt": ("sqrt(p_size)", "round(sqrt(p_size), 4)"), "cos": ("cos(p_size)", "round(cos(p_size), 4)"),
    "sin": ("sin(p_size)", "round(sin(p_size), 4)"), "tan": ("tan(p_size)", "round(tan(p_size), 4)"), "coalesce": ("coalesce(nullif(p_size, 7), 0)", "CAST(coalesce(nullif(p_size, 7), 0) AS BIGINT)"),
    "case": ("case(p_size < 10, 'small', p_size < 30, 'medium', 'large')", "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END"), "if": ("if(p_size > 25, 1, 0)", "CAST(CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS BIGINT)"),
    "arithmetic": ("-p_size * 3 + p_size % 4 - 2", "CAST(-p_size * 3 + p_size % 4 - 2 AS BIGINT)"), "division": ("p_size / 4", "round(p_size / 4.0, 4)"), "bitwise": ("(p_size & 6) | 8", "CAST((p_size & 6) | 8 AS BIGINT)"), "inversion": ("~p_size", "CAST(~p_size AS BIGINT)"),
    "logic": ("not (p_size < 10 or p_size >= 40) and p_brand != 'Brand#11'", "NOT (p_size < 10 OR p_size >= 40) AND p_brand <> 'Brand#11'"),
}
_add("scalar_functions", lambda spark, sf_dir: plain(SparkStore(spark, sf_dir).table("part").select("p_partkey", *(to_column(e, F.col).alias(f"f_{n}") for n, (e, _) in _SCALARS.items()))), "SELECT p_partkey, " + ", ".join(f"{s} AS f_{n}" for n, (_, s) in _SCALARS.items()) + " FROM part")
_PARTS = ("year", "quarter", "month", "week", "day", "hour", "minute", "doy", "dow", "epoch")
_add("date_parts", lambda spark, sf_dir: plain(SparkStore(spark, sf_dir).table("events").select("event_id", *(scalars.extract(p, F.col("ts")).alias(f"part_{p}") for p in _PARTS))), "SELECT event_id, " + ", ".join(f"CAST(floor(extract('{p}' FROM ts)) AS BIGINT) AS part_{p}" for p in _PARTS) + " FROM events")
_DERIVED = {"dimensions": ["date", {"name": "status"}, "priority"], "details": [{"name": "code", "expression": "concat(left(label, 1), '-', left(priority.priority, 1))"}, {"name": "label"}]}
_add("derived_attribute", lambda spark, sf_dir: plain(browser(spark, sf_dir, "orders", change=_DERIVED).facts("date:1996,5", ["code"])), f"SELECT o_orderkey AS __fact_key__, left(o_orderstatus, 1) || '-' || left(o_orderpriority, 1) AS code FROM orders WHERE year(o_orderdate) = 1996 AND month(o_orderdate) = 5")
_add("approx_distinct", lambda spark, sf_dir: plain(browser(spark, sf_dir, change={"aggregates": [{"name": "flags", "measure": "linenumber", "function": "approx_count_distinct"}]}).aggregate(aggregates=["flags"], drilldown=["returnflag"]).cells_frame), "SELECT l_returnflag AS returnflag_returnflag, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS flags FROM lineitem GROUP BY 1")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: run for n, (run, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _QUERIES.items() if sql}

