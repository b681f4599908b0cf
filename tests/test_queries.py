"""Every registered query of the library against its SQL, on the small tables."""

import os

import duckdb
import pytest

from quirekit.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    mine = sorted(repr(tuple(r)) for r in frame.select(*columns).collect())
    other = duck.sql(registry.ORACLES[name])
    assert sorted(other.columns) == columns
    theirs = other.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()
    assert mine == sorted(repr(r) for r in theirs)


def test_scalar_policies_on_odd_values(spark, tmp_path):
    """Quantities that are no whole numbers, line numbers below one, nulls, and a midnight that the session's zone lacks."""
    con = duckdb.connect()
    con.sql(
        f"""copy (SELECT i AS l_orderkey, CASE WHEN i % 9 < 8 THEN (i % 9 - 1)::INT END AS l_linenumber, CASE WHEN i % 17 > 0 THEN (i - 40) / 4 END AS l_quantity, CASE WHEN i % 5 > 0 THEN i / 1000 END AS l_discount,
 CASE i % 4 WHEN 0 THEN TIMESTAMP '2018-11-04 00:00:00' WHEN 1 THEN TIMESTAMP '2001-02-03 04:05:06.07' WHEN 2 THEN TIMESTAMP '0099-01-02 23:59:59.999999' END AS l_shipdate FROM range(300) r(i)) to '{tmp_path}/lineitem.parquet'"""
    )
    con.sql(f"create view lineitem as from '{tmp_path}/lineitem.parquet'")
    want = sorted(map(repr, con.sql(registry.ORACLES["scalar_policies"]).fetchall()))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        assert sorted(repr(tuple(r)) for r in registry.QUERIES["scalar_policies"](spark, str(tmp_path)).collect()) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_runs(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
