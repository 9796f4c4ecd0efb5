"""Every registered query against its SQL on the smallest tables, and some on larger ones, where texts
hold more odd cases."""

import os

import pytest

import __spark_entry__
from sievemark.plans.oracle import ORACLE_SQL
from sievemark.plans.queries import QUERIES

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ON_LARGER = ("q_quote_verify", "q_report", "q_policy_sweep", "q_extractors", "q_modal_rollup", "q_incremental_regions")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tables_of(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def duck():
    return tables_of(SF)


@pytest.fixture(scope="module")
def larger():
    return tables_of(LARGER)


def canonical(df):
    columns = sorted(df.columns)
    out = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(tuple("-" if x is None else str(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in row) for row in out.itertuples(index=False))


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
@pytest.mark.parametrize("name", ON_LARGER)
def test_query_on_larger_tables(spark, larger, name):
    assert canonical(QUERIES[name](spark, LARGER).toPandas()) == canonical(larger.sql(ORACLE_SQL[name]).df())


def test_value_status_of_very_small_balances(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("create table customer as select i as c_custkey, 10 as c_nationkey, s as c_mktsegment, b / 100 as c_acctbal from range(-12, 13) r(b), (values (1, 'BUILDING'), (2, 'MACHINERY')) v(i, s)")
    con.sql(f"copy customer to '{tmp_path}/customer.parquet' (format parquet)")
    assert canonical(QUERIES["q_value_status"](spark, str(tmp_path)).toPandas()) == canonical(con.sql(ORACLE_SQL["q_value_status"]).df())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
