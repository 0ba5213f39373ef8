"""Every query of the core that has SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from shelfmark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    r = duck.execute(registry.SQL[name])
    want = table([c[0] for c in r.description], r.fetchall())
    assert table(df.columns, [tuple(x) for x in df.collect()]) == want and (want[1] or name == "rerank_ratios")


def test_nested_children_of_the_whole_table(spark):
    df = registry.QUERIES["p2_found"](spark, SF)
    assert df.columns == ["record_id", "kind", "seq", "parent_kind", "parent_seq", "name"] and df.count() > 500
    assert df.groupBy("record_id", "kind", "seq").count().where("count > 1").count() == 0
    parents = df.selectExpr("record_id", "kind as parent_kind", "seq as parent_seq")
    assert df.where("parent_kind <> 'record'").join(parents, ["record_id", "parent_kind", "parent_seq"], "left_anti").count() == 0
