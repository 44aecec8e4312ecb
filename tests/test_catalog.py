"""Every query of the catalogue against its SQL, and the plans that matter."""

import os

import duckdb
import pytest

from trailweave.plans import catalog
from trailweave.session import Session, query
from trailweave.sources.testdata import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {quoted} FROM ({catalog.SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    df = query(load(spark, SF), "MATCH (c:Customer) WHERE c.acctbal > 5000 RETURN c.name AS name")
    plan = plan_of(df)
    assert "GreaterThan(c_acctbal,5000.0)" in plan and "ReadSchema: struct<c_name:string,c_acctbal:double>" in plan


def test_a_step_over_a_foreign_key_is_one_join(spark):
    df = query(load(spark, SF), "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 1000 RETURN o.orderkey AS o, c.name AS n")
    assert plan_of(df).count("Join") == 1
    inline = query(load(spark, SF), "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN o.orderkey AS o, o.totalprice AS p")
    assert plan_of(inline).count("Join") == 0


def test_top_is_not_a_sort(spark):
    df = query(load(spark, SF), "MATCH (o:Order) RETURN o.orderkey AS o ORDER BY o LIMIT 3")
    assert "TakeOrderedAndProject" in plan_of(df)


def test_read_only(spark):
    from trailweave.plans.errors import Unsupported

    with pytest.raises(Unsupported):
        Session(load(spark, SF)).execute("INSERT (:X)")


def scans(df) -> int:
    return plan_of(df).split("== Initial Plan ==")[0].count("FileScan")


@pytest.mark.parametrize("text, join", [
    ("MATCH (c:Customer) WHERE (c)-[:PLACED]->(:Order {status: 'F'}) RETURN c.custkey AS k", "LeftSemi"),
    ("MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {status: 'F'}) RETURN c.custkey AS k", "LeftAnti"),
    ("MATCH (d:Document) OPTIONAL MATCH (d)-[:HAS_LABEL]->(l) WHERE l.quality = 0 RETURN d.doc_id AS k, l.toxic AS t", "LeftOuter"),
])
def test_a_part_tied_by_one_node_is_one_join(spark, text, join):
    df = query(load(spark, SF), text)
    assert scans(df) == 2 and plan_of(df).count("Join") == 1 and join in plan_of(df)


def test_repetition_reads_the_edges_once_a_depth(spark):
    for high in (2, 4):
        df = query(load(spark, SF), f"MATCH (a:Order)-[:CONTAINS]->{{1,{high}}}(b) RETURN COUNT(*) AS n")
        assert scans(df) == 1 + high and plan_of(df).count("Union") == 0


def test_a_place_beyond_32_bits_is_null(spark):
    df = query(load(spark, SF), "MATCH (n:Nation {nationkey: 1}) RETURN $l[4294967297] AS far, $l[1] AS near", {"l": [1, 2]})
    assert [tuple(r) for r in df.collect()] == [(None, 2)]
