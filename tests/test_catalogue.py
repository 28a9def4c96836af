"""Every query of the catalogue against its SQL in DuckDB."""

import decimal
import math

import duckdb
import pytest

from hyperstar import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return float(v) if isinstance(v, decimal.Decimal) else v


def rows(found, columns):
    return sorted(([plain(r[c]) for c in sorted(columns)] for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    relation = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    expected = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    assert rows([r.asDict() for r in df.collect()], df.columns) == rows(expected, df.columns)


def test_pruned_join_reads_two_tables(spark):
    plan = catalogue.queries()["join_pruned"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_filters_and_columns_reach_the_scan(spark):
    df = catalogue.browser(spark, SF).aggregate("returnflag:R", ["quantity_sum"], ["status"]).cells_frame
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    assert "l_tax" not in plan and "l_partkey" not in plan
