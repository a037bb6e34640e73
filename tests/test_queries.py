"""Every registered query against its oracle, and its plan against the scale rules."""

import duckdb
import pytest
from conftest import plan_of

from __spark_entry__ import entry
from check_queries import connect, rows_of
from limitloom.queries.catalogue import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    plan = plan_of(df)
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert costly not in plan
    got = rows_of(df.columns, df.collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, result.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_entry_is_the_flagship(spark):
    df = entry(spark)
    assert df.columns == ["stmt_mth", "brand", "offer_rows", "guco_sum", "raim_sum"] and df.count() > 0


def test_oracles_parse():
    con = duckdb.connect()
    for name, sql in ORACLES.items():
        assert con.extract_statements(sql), name
