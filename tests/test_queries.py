"""Every registered query of the relational part against DuckDB on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from lodestone import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def same(rows):
    return sorted([tuple(plain(v) for v in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(name, spark, duck):
    df = plans.queries()[name](spark, SF)
    want = duck.execute(plans.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert same(df.select(*names).collect()) == same(want.fetchall())


def test_outer_joins_and_filter_reach_whole_tables(spark, duck):
    customers, orders = ({r[0] for r in duck.execute(f"SELECT {k} FROM {t}").fetchall()} for k, t in (("c_custkey", "customer"), ("o_orderkey", "orders")))
    for name, left in (("join_right", set()), ("join_full", customers)):
        rows = plans.queries()[name](spark, SF).collect()
        assert {r.o_orderkey for r in rows} - {None} == orders and {r.l_key for r in rows} >= left
        assert any(r.l_key is None for r in rows) and any(None not in r for r in rows)
        assert any(r.o_orderkey is None for r in rows) == (name == "join_full")
    want = {r[0] for r in duck.execute("SELECT o_orderkey FROM orders WHERE o_custkey <> 5 AND o_totalprice > 1000 AND o_totalprice < 200000 AND o_orderstatus = 'O'").fetchall()}
    assert {r.o_orderkey for r in plans.queries()["filter_comparison_ops"](spark, SF).collect()} == want


@pytest.mark.parametrize(("name", "table"), [("order_by_asc", "customer"), ("order_by_desc", "customer"), ("order_by_multi_expr", "lineitem"), ("order_nulls_last", "nation")])
def test_sorts_return_whole_tables(name, table, spark, duck):
    rows = plans.queries()[name](spark, SF).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0] + 1))
    if name == "order_nulls_last":
        assert [r.k is None for r in sorted(rows, key=lambda r: r["rank"])] == [False] * 20 + [True] * 5
