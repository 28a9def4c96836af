"""Stars, expressions and browsers over small tables."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from hyperstar.errors import ArgumentError, ExpressionError, HierarchyError, ModelError, NoSuchAttributeError
from hyperstar.functions import aggregates, windows
from hyperstar.model import ModelProvider
from hyperstar.operators.browser import Browser
from hyperstar.operators.crosstab import cross_table, of_result
from hyperstar.operators.cuboids import combined_cuboids, combined_levels, hierarchical_cuboids
from hyperstar.plans.expressions import names, parse, to_column
from hyperstar.plans.mapping import ColumnRef, Join, JoinKey, Mapper, Naming
from hyperstar.plans.star import Star


def make(model, cube, tables, **options):
    p = ModelProvider(model)
    c = p.cube(cube).link(p.dimension)
    return Browser(c, lambda name, schema: tables[name], **options)


@pytest.fixture(scope="module")
def small(spark):
    day = lambda m: datetime.date(2014, m, 1)
    return {
        "stays": spark.createDataFrame([(1, day(5), "R101", 3), (2, day(6), "R102", 5), (3, day(7), "R201", 7), (4, day(8), "R202", 11)], "id int, date date, category string, amount int"),
        "rooms": spark.createDataFrame([(1, "R101", "garden", 30), (2, "R102", "street", 20), (3, "R201", "tower", 60), (4, "R202", "court", 20), (5, "R301", "attic", 10)], "id int, category string, label string, size int"),
        "sizes": spark.createDataFrame([(1, 10, "cell"), (2, 20, "single"), (3, 30, "double"), (4, 60, "suite"), (5, 90, "hall")], "id int, size int, label string"),
    }


STAR = {
    "marts": [{
        "name": "stays", "dimensions": ["category", "size"], "measures": ["amount"],
        "aggregates": [{"name": "n", "function": "count"}, {"name": "amount_sum", "measure": "amount", "function": "sum"}],
        "joins": [["stays.category", "rooms.category"], ["rooms.size", "sizes.size"]],
        "mappings": {"category.category": "stays.category", "category.label": "rooms.label", "size.size": "sizes.size", "size.label": "sizes.label"},
    }],
    "dimensions": [{"name": "category", "attributes": ["category", "label"]}, {"name": "size", "attributes": ["size", "label"]}],
}


def test_snowflake_rows(small):
    b = make(STAR, "stays", small)
    assert [r["size.label"] for r in b.facts(fields=["size.label"], order=["category.category"]).collect()] == ["double", "single", "suite", "single"]
    assert [r["size.size"] for r in b.facts(fields=["size.size"], order=["category.category"]).collect()] == [30, 20, 60, 20]


def test_statements_as_tables(small):
    p = ModelProvider(STAR)
    c = p.cube("stays").link(p.dimension)
    b = Browser(c, lambda name, schema: small[name], statements={"stays": small["stays"].where("category = 'R101'")})
    assert [r["size.size"] for r in b.facts(fields=["size.size"]).collect()] == [30]


def test_only_needed_joins(small):
    star = make(STAR, "stays", small).star
    assert [j.name for j in star.required_joins(["sizes"])] == ["rooms", "sizes"]
    assert star.required_joins(["stays"]) == []
    with pytest.raises(ModelError):
        star.required_joins(["elsewhere"])


def test_join_errors(small):
    def star(joins):
        p = ModelProvider({"marts": [{"name": "stays", "joins": joins}]})
        c = p.cube("stays")
        return Star(c, Mapper(c), lambda n, s: small[n])

    with pytest.raises(ModelError, match="twice"):
        star([["stays.category", "rooms.category"]] * 2)
    with pytest.raises(ModelError, match="no table"):
        star([["stays.category", "category"]])
    with pytest.raises(ModelError, match="columns"):
        star([{"master": {"column": ["a", "b"]}, "detail": {"table": "d", "column": ["a"]}}])
    with pytest.raises(ModelError, match="method"):
        star([{"master": "a", "detail": "d.a", "method": "sideways"}])
    with pytest.raises(ModelError, match="circle"):
        star([["x.a", "y.a"], ["y.a", "x.a"]]).required_joins(["x"])


def test_references():
    assert ColumnRef.parse("c") == ColumnRef(None, None, "c")
    assert ColumnRef.parse("t.c", "d", "s") == ColumnRef("s", "t", "c")
    assert ColumnRef.parse({"table": "t", "column": "c", "extract": "year"}) == ColumnRef(None, "t", "c", "year")
    assert JoinKey.parse({"table": "t", "column": ["a", "b"]}).columns == ("a", "b")
    assert Join.parse(("a", "d.b", "x", "detail"), "f").name == "x"
    with pytest.raises(ArgumentError):
        ColumnRef.parse("a.b.c.d")


def test_naming():
    n = Naming(fact_prefix="ft_", dimension_prefix="dm_", dimension_suffix="_x")
    p = ModelProvider({"marts": [{"name": "sales", "dimensions": ["flag", "place"], "measures": ["amount"]}], "dimensions": ["flag", {"name": "place", "attributes": ["code", {"name": "name", "locales": ["en", "sk"]}]}]})
    m = Mapper(p.cube("sales").link(p.dimension), n, "sk")
    get = lambda r: m.physical(m.cube.attribute(r))
    assert (get("flag").table, get("amount").table) == ("ft_sales", "ft_sales")
    assert get("place.code") == ColumnRef(None, "dm_place_x", "code")
    assert get("place.name").column == "name_sk"
    assert n.facts(["ft_a", "b"]) == ["a"] and n.dimensions(["dm_c_x", "dm_d"]) == ["c"]


FACTS = {
    "marts": [{
        "name": "facts", "dimensions": ["date", "kind"], "measures": ["amount"], "mappings": {"date.year": "year", "date.month": "month", "kind.kind": "kind"},
        "aggregates": [{"name": "count", "function": "count"}, {"name": "amount_sum", "measure": "amount", "function": "sum"}, {"name": "amount_min", "measure": "amount", "function": "min"}, {"name": "amount_sma", "measure": "amount_sum", "function": "sma", "window_size": 2}, {"name": "min_sms", "measure": "amount_min", "function": "sms", "window_size": 2}],
    }],
    "dimensions": [{"name": "date", "levels": ["year", "month"]}, {"name": "kind", "levels": [{"name": "kind", "cardinality": "high"}]}],
}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [(1, 2010, 1, "a", 1), (2, 2010, 2, "b", 2), (3, 2011, 1, None, 4), (4, 2011, 3, "a", None), (5, None, 1, "b", 16)]
    return {"facts": spark.createDataFrame(rows, "id int, year int, month int, kind string, amount int")}


def test_nulls_and_cuts(facts):
    b = make(FACTS, "facts", facts)
    n = lambda cell: b.aggregate(cell, ["count"]).summary["count"]
    assert n("date:2010") == 2 and n("!date:2010") == 2 and n("date:__null__") == 1
    assert n("kind:a;__null__") == 3 and n("date:2010,2-2011,1") == 2 and n("date:2010,2-") == 3
    assert n("date:words") == 0 and n([]) == 5
    with pytest.raises(HierarchyError):
        n("date:2010,1,1")


def test_coalescing(facts):
    cells = lambda on: {r["date.year"]: r for r in make(FACTS, "facts", facts, coalesce=on).aggregate("date:2011", ["amount_sum", "amount_min"], ["date:year"]).cells}
    assert cells(True)[2011]["amount_min"] == 0 and cells(False)[2011]["amount_min"] == 4


def test_summary_equals_cells(facts):
    r = make(FACTS, "facts", facts).aggregate(drilldown=["date"], aggregates=["amount_sum"])
    assert r.summary["amount_sum"] == sum(c["amount_sum"] for c in r.cells) == 23
    assert [c["date.year"] for c in r.cells] == [2010, 2011, None] and r.total_cell_count == 3
    assert [(x.key, x.path, x.is_base) for x in r.table_rows("date")][0] == (2010, [2010], False)
    assert r.levels == {"date": ["year"]}


def test_empty_table(facts):
    b = make(FACTS, "facts", {"facts": facts["facts"].limit(0)})
    assert b.aggregate(aggregates=["count", "amount_sum"]).summary == {"count": 0, "amount_sum": 0}
    assert b.aggregate(drilldown=["date"], aggregates=["count"]).cells == []


def test_windows_skip_nulls(facts):
    b = make(FACTS, "facts", facts, coalesce=False)
    cells = b.aggregate("date:2010-2011", ["min_sms", "amount_sma"], ["date:month"]).cells
    assert [c["amount_min"] for c in cells] == [1, 2, 4, None]
    assert [c["min_sms"] for c in cells] == [1, 3, 6, 6] and [c["amount_sma"] for c in cells][:3] == [1, 1.5, 3]


def test_window_values(spark):
    values = [3.0, 5.0, 10.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = {f: [r[0] for r in df.select(windows.moving(f, F.col("v"), 3, [], [F.col("i")])).collect()] for f in windows.WINDOWS}
    mean, var = 16 / 3, sum((x - 16 / 3) ** 2 for x in values[1:]) / 2
    expected = {"sma": round(mean, 2), "sms": 16, "wma": round((5 + 20 + 3) / 6, 4), "smvar": round(var, 2), "smstd": round(math.sqrt(var), 2), "smrsd": round(math.sqrt(var) / mean, 4)}
    assert {f: v[-1] for f, v in got.items()} == pytest.approx(expected)
    assert got["smvar"][0] == 0
    with pytest.raises(ModelError):
        windows.window_size(0)


def test_arguments(facts):
    b = make(FACTS, "facts", facts)
    with pytest.raises(ArgumentError, match="many members"):
        b.aggregate(drilldown=["kind"])
    assert len(b.aggregate(drilldown=["kind"], page=0, page_size=2).cells) == 2
    assert len(b.aggregate("kind:a;b", drilldown=["kind"]).cells) == 2
    with pytest.raises(NoSuchAttributeError):
        b.aggregate(aggregates=["nope"])
    with pytest.raises(ArgumentError):
        b.members(dimension="date", depth=1, level="year")
    with pytest.raises(ArgumentError):
        b.report(None, {"x": {"query": "guess"}})
    assert b.fact(2, ["amount"]) == {"__fact_key__": 2, "amount": 2} and b.fact(99) is None
    assert [a.name for a in b.prepare_aggregates(measures=["amount"])] == ["amount_sum", "amount_min"]
    assert b.facts(fields=["amount"]).columns == ["__fact_key__", "amount"]
    b.test(aggregate=True)


def test_details(small):
    b = make(STAR, "stays", small)
    assert b.cell_details("category:R101") == [[{"category.category": "R101", "category.label": "garden", "_key": "R101", "_label": "garden"}]]
    assert b.cell_details("category:Z") == [None]
    assert b.cell_details("category:R101;R102")[0][1][0]["_label"] == "street"
    assert b.cell_details("category:R101-") == [{"from": b.cell_details("category:R101")[0], "to": None}]


def test_unknown_aggregate_function(facts):
    model = {"marts": [{"name": "facts", "measures": ["amount"], "aggregates": [{"name": "x", "measure": "amount", "function": "unheard"}]}]}
    with pytest.raises(ArgumentError):
        make(model, "facts", facts).aggregate().summary  # noqa: B018
    with pytest.raises(ModelError):
        aggregates.aggregate("sum", None, F.lit(1))


@pytest.mark.parametrize(
    ("text", "value"),
    [("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-2 * -3", 6), ("10 - 4 - 3", 3), ("7 % 4", 3), ("1 < 2 and not 2 < 1", True), ("6 & 3 | 8", 10), ("min(3, 2)", 2), ("'it''s'", "it's"), ("if(1 > 2, 'a', 'b')", "b"), ("case(false, 1, true, 2, 3)", 2), ("1 / 0", None), ("null", None), ("1.5e2", 150.0)],
)
def test_expressions(spark, text, value):
    assert spark.range(1).select(to_column(text, F.col)).first()[0] == value


def test_expression_errors():
    assert names("a.b + f(c) - extract(year, d) * current_date") == {"a.b", "c", "d"}
    for bad in ("1 +", "(1", "a b", "1 $ 2", "f(1,", ""):
        with pytest.raises(ExpressionError):
            parse(bad)
    for bad in ("unheard(1)", "sum(1)", "extract(era, x)", "lower()"):
        with pytest.raises(ExpressionError):
            to_column(bad, F.col)


def test_derived_attributes(spark):
    data = spark.createDataFrame([(1, 10, 1), (2, 20, 1), (3, 40, 2), (4, 80, 3)], "id int, price int, quantity int")
    details = [{"name": "total", "expression": "price * quantity"}, {"name": "more", "expression": "total + 1"}, {"name": "low", "expression": "min(price, 15)"}]
    b = make({"marts": [{"name": "data", "measures": ["price"], "details": details}]}, "data", {"data": data})
    assert [tuple(r)[1:] for r in b.facts(fields=["more", "low"], order=["price"]).collect()] == [(11, 10), (21, 15), (81, 15), (241, 15)]
    loop = make({"marts": [{"name": "data", "measures": ["price"], "details": [{"name": "a", "expression": "b"}, {"name": "b", "expression": "a"}]}]}, "data", {"data": data})
    with pytest.raises(ExpressionError):
        loop.facts(fields=["a"])


def test_cross_tables(facts):
    r = make(FACTS, "facts", facts).aggregate("date:2010-2011", ["count"], ["date", "kind"], page=0, page_size=10)
    t = of_result(r, ["date.year"], ["kind.kind"])
    assert t.rows == [(2010,), (2011,)] and t.columns == [("a", "count"), ("b", "count"), (None, "count")]
    assert t.data == [[1, 1, None], [1, None, 1]]
    cells = [{"r": 1, "c": 1, "x": 5, "y": 6}]
    assert cross_table(cells, ["r"], ["c"], ["x", "y"], "rows").rows == [(1, "x"), (1, "y")]
    assert cross_table(cells, ["r"], ["c"], ["x", "y"], "cells").data == [[(5, 6)]]
    with pytest.raises(ArgumentError):
        cross_table(cells, ["r"], ["c"], ["x"], "elsewhere")


def test_cuboids():
    assert combined_cuboids("abc", "b") == [("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")]
    assert len(combined_cuboids("abcd")) == 15
    with pytest.raises(ArgumentError):
        combined_cuboids("ab", "z")
    p = ModelProvider(FACTS)
    dims = [p.dimension("date"), p.dimension("kind")]
    assert combined_levels(dims) == [(("date", "default", "year"), ("kind", "default", "kind")), (("date", "default", "month"), ("kind", "default", "kind"))]
    assert len(hierarchical_cuboids(dims)) == 5


def test_summary_has_the_joins_of_its_cells(spark):
    """Inner joins of the drilldown drop facts; the summary is that of the cells."""
    tables = {"orders": spark.createDataFrame([(i, i % 4, 10) for i in range(12)], "id int, who int, amount int"), "people": spark.createDataFrame([(0, "x"), (1, "y")], "who int, side string")}
    model = {"marts": [{"name": "orders", "dimensions": ["side"], "measures": ["amount"], "aggregates": [{"name": "n", "function": "count"}], "joins": [["orders.who", "people.who"]], "mappings": {"side.side": "people.side"}}], "dimensions": ["side"]}
    b = make(model, "orders", tables)
    r = b.aggregate(drilldown=["side"])
    assert r.summary == {"n": 6} and sum(c["n"] for c in r.cells) == 6 and b.aggregate().summary == {"n": 12}
    assert b.aggregate(split="side:x").summary == {"n": 6}


@pytest.fixture(scope="module")
def dated(spark):
    days = [None if i % 2 else datetime.date(1995, 1, 1) + datetime.timedelta(days=13 * i) for i in range(200)]
    rows = [(i, d, None if d is None else datetime.datetime(d.year, d.month, d.day, 23, 59)) for i, d in enumerate(days)]
    table = spark.createDataFrame(rows, "id int, d date, t timestamp")
    parts = ("year", "quarter", "month", "day")
    model = {
        "marts": [{"name": "log", "dimensions": ["d", "t"], "aggregates": [{"name": "n", "function": "count"}], "mappings": {f"{c}.{p}": {"table": "log", "column": c, "extract": p} for c in "dt" for p in parts}}],
        "dimensions": [{"name": c, "levels": list(parts), "hierarchies": [{"name": "ymd", "levels": ["year", "month", "day"]}, {"name": "yqmd", "levels": list(parts)}]} for c in "dt"],
    }
    return make(model, "log", {"log": table}), [(i, d) for i, d in enumerate(days) if d is not None]


@pytest.mark.parametrize(
    ("cut", "holds"),
    [
        ("1996", lambda d: d.year == 1996), ("1996,12", lambda d: (d.year, d.month) == (1996, 12)), ("1996,2,29", lambda d: d == datetime.date(1996, 2, 29)), ("1997,2,29", lambda d: False), ("1996,13", lambda d: False),
        ("1995;1997;x", lambda d: d.year in (1995, 1997)), ("1995,3;1997", lambda d: d.year == 1997 or (d.year, d.month) == (1995, 3)), ("1995,11,20-1997,2", lambda d: datetime.date(1995, 11, 20) <= d < datetime.date(1997, 3, 1)),
        ("-1996,6", lambda d: d < datetime.date(1996, 7, 1)), ("1998-", lambda d: d.year >= 1998), ("y", lambda d: False),
    ],
)
def test_time_cuts(dated, cut, holds):
    """Ranges of the column beside the extracted parts change no result, inverted or not."""
    b, known = dated
    for c in "dt":
        assert b.aggregate(f"{c}:{cut}").summary["n"] == sum(holds(d) for _, d in known)
        assert b.aggregate(f"!{c}:{cut}").summary["n"] == sum(not holds(d) for _, d in known)


def test_time_cuts_by_quarters(dated):
    b, known = dated
    assert b.aggregate("d@yqmd:1996,2").summary["n"] == sum(d.year == 1996 and d.month in (4, 5, 6) for _, d in known)
    assert b.aggregate("d@yqmd:1996,4,12").summary["n"] == sum(d.year == 1996 and d.month == 12 for _, d in known)


def test_time_cuts_reach_the_scan(spark, tmp_path, dated):
    path = str(tmp_path / "log")
    dated[0].star.table("log").write.parquet(path)
    b = Browser(dated[0].cube, lambda name, schema: spark.read.parquet(path))
    plan = b.aggregate("d:1996,3-1997").summary_frame._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(d,1996-03-01)" in plan and "LessThan(d,1998-01-01)" in plan
