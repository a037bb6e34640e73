"""Registered queries on a few rows of their own: what the whole job has to list."""

import datetime as dt

import duckdb
import pytest

from check_queries import rows_of
from limitloom.plans import request_funnel
from limitloom.queries.catalogue import ORACLES, QUERIES

COLUMNS = {
    "customer": "c_custkey bigint, c_name varchar, c_nationkey integer, c_acctbal double, c_mktsegment varchar",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus varchar, o_totalprice double, o_orderdate timestamp, o_orderpriority varchar",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber integer, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag varchar, l_linestatus varchar, l_shipdate timestamp",
}


def customer(key):
    return key, f"c{key}", 1, 0.0, "BUILDING"


def order(key, account, day, status="F", price=1000.0):
    return key, account, status, price, day, "1-URGENT"


def shipped(key, day, price, line=1):
    return key, 1, 1, line, 1.0, price, 0.0, 0.0, "N", "F", day


@pytest.fixture
def run(spark, tmp_path):
    """``run(name, customers, orders, lines)``: the query's rows by its columns' names, equal to its oracle's."""

    def make(name, *tables):
        con = duckdb.connect()
        for (table, columns), rows in zip(COLUMNS.items(), tables, strict=True):
            con.execute(f"create table {table} ({columns})")
            con.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
            con.execute(f"copy {table} to '{tmp_path}/{table}.parquet' (format parquet)")
        df = QUERIES[name](spark, str(tmp_path))
        result = con.execute(ORACLES[name])
        got = rows_of(df.columns, df.collect())
        assert got == rows_of([d[0] for d in result.description], result.fetchall())
        return [dict(zip(sorted(df.columns), row, strict=True)) for row in got]

    return make


@pytest.mark.parametrize("name", ["backtest_all_months", "backtest_after_offer"])
def test_back_test_scores_months_without_an_offer(run, name):
    months = [shipped(1, "2000-02-05", 105.0), shipped(1, "2000-03-05", 50.0, 2), shipped(1, "2000-04-05", 50.0, 3)]
    got = run(name, [customer(3)], [order(1, 3, "2000-01-10")], months)
    assert [(r["risk_stmt"], r["n"], r["raim"]) for r in got] == [(1, 1, 50.0), (2, 1, 50.0)]


# An account whose approved request of the month meets a limit of 1,000 and an increase of 5,000; see the stand-in of offers.
ASKED = order(2, 3, "2000-03-10", price=5000.0)


def test_decrease_free_history_lists_every_accepted_offer(run):
    past = [order(1, 3, "2000-01-10", price=700.0), order(4, 3, "2000-02-10", price=900.0)]
    got = run("decrease_free_history", [customer(3)], [ASKED, *past], [shipped(2, "2000-03-20", 10.0)])
    assert sorted((r["request_id"], r["offer_mth"], r["new_cl"]) for r in got) == [(2, "2000-01", 700.0), (2, "2000-02", 900.0), (2, "2000-03", 5000.0)]
    assert {(r["accepted_offers"], r["first_offer_mth"], r["last_offer_mth"], r["highest_cl"]) for r in got} == {(3, "2000-01", "2000-03", 5000.0)}


def test_restored_above_decrease_lists_every_exceeded_limit(run):
    # strategies go by the id's remainder of three; the new limit is 6,000
    cuts = [order(1, 3, "2000-01-10", "O", 400.0), order(4, 3, "2000-02-10", "O", 5500.0), order(13, 3, "2000-02-20", "O", 7000.0), order(5, 3, "2000-02-25", "O", 300.0)]
    got = run("restored_above_decrease", [customer(3)], [ASKED, *cuts], [shipped(2, "2000-03-20", 10.0)])
    assert sorted((r["request_id"], r["initiated_on"], r["cld_prev_cl"], r["decreases"]) for r in got) == [(2, "2000-01-10", 400.0, 2), (2, "2000-02-10", 5500.0, 2)]


def test_restored_pairs_keep_requests_without_a_user_and_repeated_ones(frame):
    schema = "request_id bigint, user_id bigint, account_id bigint, offer_id bigint, stmt_mth string, icl bigint, cli_offer bigint"
    rows = frame(schema, *[(1, None, 3, 1, "2000-03", 1000, 5000)] * 2)
    cut = "account_id bigint, initiated_at timestamp, previous_limit_cents bigint, new_limit_cents bigint"
    decreases = frame(cut, *[(3, dt.datetime(2000, 1, day), limit, 0) for day, limit in ((1, 40_000), (2, 50_000), (3, 900_000))])
    got = request_funnel.restored_pairs(rows, decreases).collect()
    assert sorted((float(r["prev_cl"]), r["decreases"]) for r in got) == [(400.0, 4), (400.0, 4), (500.0, 4), (500.0, 4)]
