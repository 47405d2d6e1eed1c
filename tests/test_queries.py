"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sluice.queries import CASES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def normal(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", CASES)
def test_query(spark, db, name):
    case = CASES[name]
    got = case.run(spark, DATA)
    wanted = db.sql(case.sql)
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(wanted.columns, wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_id", "user_id", "value", "band"]
    found, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(found) and set(CASES) <= set(found)


def test_whole_tables(spark, db):
    """Joins, functions and expansions run over whole tables: no row is dropped before them."""
    run = lambda name: CASES[name].run(spark, DATA)
    orders, customers, matched = (db.sql(x).fetchall()[0][0] for x in ("select count(*) from orders", "select count(*) from customer", "select count(*) from orders where o_custkey in (select c_custkey from customer)"))
    held = db.sql("select count(*) from customer where c_custkey in (select o_custkey from orders)").fetchall()[0][0]
    wanted = {"inner": matched, "leftouter": orders, "rightouter": matched + customers - held, "fullouter": orders + customers - held, "leftsemi": matched, "leftanti": orders - matched, "rightsemi": held, "rightanti": customers - held}
    assert {k: run(f"join_{k}").count() for k in wanted} == wanted
    assert run("math_fns").count() == db.sql("select count(*) from lineitem").fetchall()[0][0]
    assert run("mv_expand").count() == db.sql("select sum(len(string_split(text, ' '))) from documents").fetchall()[0][0]
