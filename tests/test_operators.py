import datetime as dt
import random

import pytest
from conftest import listed
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from limitloom import operators as op
from limitloom.operators import scan, split
from limitloom.operators.star import gather, newest
from limitloom.sources import append_audience, conform, load, nested, replace_table, run_sql, session_view, stitch_history, to_records

D, T = dt.date, dt.datetime


def test_latest_first_worst_and_ties(frame):
    df = frame("k string, d int, v string", ("a", 1, "x"), ("a", 3, "y"), ("a", 3, "w"), ("b", None, "z"), ("b", 0, "q"), (None, 5, "n"))
    assert listed(op.latest_per_key(df, "k", "d")) == [("a", 3, "w"), ("b", 0, "q"), (None, 5, "n")]
    assert listed(op.first_per_key(df, "k", "d")) == [("a", 1, "x"), ("b", 0, "q"), (None, 5, "n")]
    assert listed(op.worst_per_key(df, "k", "d", [F.col("v").desc()])) == [("a", 3, "y"), ("b", 0, "q"), (None, 5, "n")]
    assert op.dedupe(df, "k").count() == 3
    assert listed(op.top_per_key(df, "k", [F.col("d").desc_nulls_last()], n=2)).count(("b", None, "z")) == 1


def test_attach_keeps_rows_and_flags(frame):
    left = frame("k string, limit int", ("a", 1), ("b", 2), (None, 3))
    right = frame("k string, v int", ("a", 10), ("a", 11), (None, 12))
    assert listed(op.attach(left, right, "k")) == [("a", 1, 10), ("a", 1, 11), ("b", 2, None), (None, 3, None)]
    assert listed(op.attach(left, right, "k", flag="hit"), "k", "hit") == [("a", 1), ("a", 1), ("b", 0), (None, 0)]
    # A residual test on the left side removes the match, not the row.
    assert listed(op.attach(left, right, "k", extra=F.col("limit") > 5)) == [("a", 1, None), ("b", 2, None), (None, 3, None)]
    with pytest.raises(ValueError):
        op.attach(left, right.withColumnRenamed("v", "LIMIT"), "k")


def test_attach_by_calendar(frame):
    offers = frame("k string, d date", ("a", D(2024, 3, 1)), ("a", D(2024, 1, 31)))
    scores = frame("k string, ts timestamp, s int", ("a", T(2024, 3, 1, 23, 59), 1), ("a", T(2024, 2, 29, 0, 0), 2), ("a", T(2023, 12, 1, 1, 1), 3))
    day = op.attach_on_day(offers, scores, "k", "d", "ts")
    assert listed(day, "d", "s") == [(D(2024, 1, 31), None), (D(2024, 3, 1), 1)]
    month = op.attach_on_month(offers, scores, "k", "d", "ts")
    assert listed(month, "d", "s") == [(D(2024, 1, 31), None), (D(2024, 3, 1), 1)]
    previous = op.attach_prev_month(offers, scores, "k", "d", "ts")
    assert listed(previous, "d", "s") == [(D(2024, 1, 31), 3), (D(2024, 3, 1), 2)]


def test_attach_history_equals_left_join(frame):
    left = frame("k string, a int", ("x", 1), ("y", 2), (None, 3))
    right = frame("k string, b int", ("x", 1), ("x", 2), ("z", 3), (None, 4))
    assert listed(op.attach_history(left, right, "k"), "k", "a", "b") == listed(op.attach(left, right, "k"), "k", "a", "b")


def test_member_flag_and_exclude(frame):
    df = frame("k string, t int", ("a", 5), ("b", 5), ("c", 5), (None, 5))
    other = frame("k string, u int", ("a", 6), ("a", 1), ("b", 5), ("b", None))
    assert listed(op.member_flag(df, other, "k", "m"), "k", "m") == [("a", 1), ("b", 1), ("c", 0), (None, 0)]
    assert listed(op.exclude(df, other, "k"), "k") == [("c",), (None,)]
    # Only a partner strictly after the row's own time counts.
    assert listed(op.exclude(df, other, "k", later_than=("u", "t")), "k") == [("b",), ("c",), (None,)]


def brute_next(left, right, strict):
    out = []
    for lid, k, t in left:
        later = [(u, rid) for rid, kk, u in right if kk == k and k is not None and t is not None and u is not None and (u > t if strict else u >= t)]
        out.append((lid, min(later)[1] if later else None))
    return sorted(out)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("piece_rows", [1 << 20, 3])
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(seed=st.integers(0, 10_000))
def test_asof_forward_equals_brute_force(spark, strict, piece_rows, seed):
    rng = random.Random(seed)
    at = lambda: None if rng.random() < 0.05 else T(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 6) // 3 * 3)
    # One key holds about half of the rows, and times repeat on both sides.
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    left = [(i, key(), at()) for i in range(40)]
    right = [(i, key(), at()) for i in range(30)]
    l = spark.createDataFrame(left, "lid int, k string, t timestamp")
    r = spark.createDataFrame(right, "rid int, k string, u timestamp")
    got = op.asof_forward(l, r, "k", "t", "u", strict=strict, tiebreak=["rid"], piece_rows=piece_rows)
    assert sorted((x["lid"], x["rid"]) for x in got.collect()) == brute_next(left, right, strict)


def test_lookback_max_only_sees_the_worst(frame):
    anchors = frame("k string, d date", ("a", D(2024, 5, 31)), ("b", D(2024, 5, 31)))
    events = frame("k string, dpd int, f date", ("a", 40, D(2024, 2, 28)), ("a", 10, D(2024, 5, 1)), ("b", 9, D(2024, 2, 29)))
    got = op.lookback_max(anchors, events, "k", "dpd", "f", "d", 3, "worst")
    # add_months clamps 31 May to 29 February; a's worst began a day earlier and hides the later 10.
    assert listed(got, "k", "worst") == [("a", None), ("b", 9)]


def test_fallback_fill_follows_lead_column(frame):
    df = frame("k string, score int, pulled string", ("a", None, "2024-01"), ("b", 700, None), ("c", None, None))
    snap = frame("k string, score int, pulled string", ("a", 650, "2023-05"), ("b", 1, "2020-01"))
    got = op.fallback_fill(df, snap, "k", ["score"], follows={"pulled": "score"})
    assert listed(got) == [("a", 650, "2023-05"), ("b", 700, None), ("c", None, None)]


def test_compare_groups(frame):
    df = frame("k string, g int, m double", ("a", 0, 1.0), ("a", 1, 3.0), ("b", 1, 5.0), (None, 1, 9.0))
    inner = op.compare_groups(df, "k", "g", ["m"], {0: "_n", 1: "_r"})
    left = op.compare_groups(df, "k", "g", ["m"], {1: "_r", 0: "_n"}, how="left")
    assert listed(inner, "k", "m_n", "m_r") == [("a", 1.0, 3.0)]
    assert listed(left, "k", "m_r", "m_n") == [("a", 3.0, 1.0), ("b", 5.0, None)]


def test_narrowing_first_changes_nothing(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, 1, 2, 3]), rng.randrange(5)) for _ in range(80)] + [("void", None, 2), ("void", None, 1)]
    df = spark.createDataFrame(rows, "k string, t int, x int")
    assert listed(op.latest_per_key(df, "k", "t")) == listed(op.latest_per_key(df, "k", "t", narrow=True))
    assert listed(op.latest_per_key(df, "k", ["t", "x"], [])) == listed(op.latest_per_key(df, "k", ["t", "x"], [], narrow=True))
    one = op.dedupe(df, "k", hashed=True)
    assert one.count() == 5 and set(listed(one)) <= set(listed(df)) and listed(one) == listed(op.dedupe(df.repartition(5), "k", hashed=True))


def test_gather_equals_joins(frame):
    offers = frame("k string, at date, x int", ("a", D(2024, 1, 1), 1), ("a", D(2024, 2, 1), 2), ("a", D(2024, 2, 1), 1), ("b", None, 5), (None, D(2024, 2, 1), 1))
    marks = frame("k string, kind string", ("a", "m"), ("c", "m"), ("c", "n"))
    out = gather("k", [(offers, {"last": (newest(offers, ["at"], ["x"], x=F.col("x")), F.min), "n": (F.lit(1), F.sum)}), (marks, {"m": ((F.col("kind") == "m").cast("int"), F.max)})])
    assert listed(out.select("k", "last.x", "n", "m")) == [("a", 1, 3, 1), ("b", 5, 1, None), ("c", None, None, 1)]


def test_newest_keeps_ties_under_their_names(frame):
    rows = frame("k string, at date, x int, y string", ("a", D(2025, 1, 1), None, "b"), ("a", D(2025, 1, 1), 3, "a"), ("a", D(2024, 1, 1), 1, "c"))
    out = gather("k", [(rows, {"last": (newest(rows, ["at"], ["x", "y"], kept=["x", "y"]), F.min)})])
    assert listed(out.select("k", "last.x", "last.y")) == [("a", 3, "a")]
    assert out.schema["last"].dataType.names == ["__none0", "__by0", "__void0", "x", "__void1", "y"]


@pytest.mark.parametrize("piece_rows", [1, 5, 70, 1 << 20])
def test_running_ordinal_in_pieces_equals_plain(spark, piece_rows):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, D(2024, 1, 1), D(2024, 1, 1) + dt.timedelta(days=rng.randrange(90))])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, d date")
    plain = op.running_ordinal(df, "k", "d", "n", tiebreak=["id"])
    cut = op.running_ordinal(df, "k", "d", "n", piece_rows, ["id"])
    assert listed(plain, "id", "n") == listed(cut, "id", "n") and cut.dtypes == plain.dtypes


def test_running_ordinal_keeps_null_keys(frame):
    df = frame("k string, d date", (None, D(2024, 1, 1)), (None, D(2024, 3, 1)), ("a", None))
    for piece_rows in (1, 1 << 20):
        got = op.running_ordinal(df, "k", "d", "n", piece_rows)
        assert listed(got, "k", "d", "n") == [("a", None, 1), (None, D(2024, 1, 1), 1), (None, D(2024, 3, 1), 2)]


def test_cuts_are_looked_up_over_several_shelves(spark):
    df = spark.range(3000).select(F.lit("a").alias("k"), F.col("id").alias("t"))
    cut = scan.cut(df, ["k"], ["t"], 10)
    pieces = cut.groupBy("__piece.at").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).orderBy("at").collect()
    assert len(pieces) == 300 and [p.at for p in pieces] == list(range(300))
    assert all(p.n == 10 and p.lo == 10 * p.at and p.hi == p.lo + 9 for p in pieces)


def test_cumulative_skips_missing(frame):
    df = frame("g string, m int, x double", ("a", 1, 1.0), ("a", 2, None), ("a", 3, 4.0))
    assert listed(op.cumulative(df, "g", "m", "x", "c"), "m", "c") == [(1, 1.0), (2, None), (3, 5.0)]


def test_group_total_and_first_event(frame):
    df = frame("g string, m string, x int", ("a", "2024-01", 1), ("a", "2024-03", 5), (None, "2024-02", 7))
    assert listed(op.group_total(df, "g", "x", "t"), "x", "t") == [(1, 6), (5, 6), (7, 7)]
    for bounded in (True, False):
        marked = op.first_event_month(df, "g", F.col("x") > 2, "m", "first", one_per_month=bounded)
        assert listed(marked, "m", "first") == [("2024-01", "2024-03"), ("2024-02", "2024-02"), ("2024-03", "2024-03")]
    since = op.since_event(op.first_event_month(df, "g", F.col("x") > 0, "m", "first"), "m", "first", "age")
    assert listed(since, "m", "age") == [("2024-03", 2)]


def test_lags_leave_gaps_empty(frame):
    df = frame("k string, o int, v int", ("a", 1, 10), ("a", 2, 20), ("a", 4, 40), ("a", 5, 50))
    got = op.lags(df, "k", "o", ["v"], n=3)
    assert listed(got) == [
        ("a", 1, 10, None, None, None),
        ("a", 2, 20, 10, None, None),
        ("a", 4, 40, None, 20, 10),
        ("a", 5, 50, 40, None, 20),
    ]


def test_pivot_and_thresholds(frame):
    df = frame("k string, m string, x int", ("a", "2024-01", 1), ("a", "2024-01", 2), ("b", "2024-09", 4))
    assert listed(op.pivot_months(df, "k", "m", "x", ["2024-01", "2024-02"], "s")) == [("a", 3, 0), ("b", 0, 0)]
    flags = op.ever_flags(df, "k", "x", {"any": (">", 2), "most": (">=", 2)})
    assert listed(flags, "k", "any", "most") == [("a", 0, 1), ("b", 1, 1)]
    both = op.any_and_any(df, "k", F.col("x") == 1, F.col("x") == 2, "both")
    assert listed(both) == [("a", 1), ("b", 0)]


def test_mean_then_sum_is_not_one_mean(frame):
    df = frame("g string, m int, x double", ("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 10.0), (None, 1, 9.0), ("b", 1, None))
    got = op.mean_then_sum(df, "g", "m", "x", "s", counted="x")
    assert listed(got) == [("a", 12.0, 2), ("b", 0.0, 0)]


def test_count_of_counts(frame):
    df = frame("k string", ("a",), ("a",), ("b",), ("c",))
    assert listed(op.count_of_counts(df, "k", "n", "keys")) == [(1, 2), (2, 1)]


def test_cut_points_and_empty_class(frame):
    df = frame("id int, s double, risk boolean", (1, 0.1, False), (2, 0.7, True), (3, None, True), (4, 0.7, None))
    got = {r["cut_level"]: r for r in op.cut_points(df, "s", F.col("risk"), "id", [0.1, 0.7]).collect()}
    assert (got[0.1]["hram_cut_volume"], got[0.1]["non_hram_cut_volume"]) == (1, 2)
    assert (got[0.7]["hram_cut_percentage"], got[0.7]["non_hram_cut_percentage"]) == (0.5, 0.5)
    empty = op.cut_points(df.filter("risk"), "s", F.col("risk"), "id", [0.1]).first()
    assert empty["non_hram_cut_percentage"] is None


def test_flow_edges_conserve_the_population(frame):
    df = frame("a string, b string, c string, v int", ("x", "y", "z", 1), ("x", "y", "w", 2), ("x", None, "z", 3))
    edges = {(r["step"], r["source"], r["target"]): r["value"] for r in op.flow_edges(df, ["a", "b", "c"]).collect()}
    assert edges == {(1, "x", "y"): 2, (2, "y", "z"): 1, (2, "y", "w"): 1}
    weighted = {(r["source"], r["target"]): r["value"] for r in op.flow_edges(df, ["a", "c"], "v").collect()}
    assert weighted == {("x", "z"): 4, ("x", "w"): 2}


@pytest.mark.parametrize("rows, n", [(0, 2), (1, 2), (7, 2), (8, 2), (10, 3), (100, 7), (3, 5)])
def test_ntile_global_equals_ntile(spark, rows, n):
    df = spark.range(rows).select((F.col("id") * 37 % 1009).alias("k"))
    df.createOrReplaceTempView("ntile_rows")
    want = spark.sql(f"select k, ntile({n}) over (order by k) t from ntile_rows").collect()
    got = op.ntile_global(df, "k", n, "t").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("few", [1, 1024])
def test_ntile_of_wide_ranges_negatives_and_a_missing_id(spark, monkeypatch, few):
    monkeypatch.setattr(split, "FEW", few)
    rng = random.Random(5)
    values = {rng.randrange(-(2**63), 2**63) for _ in range(300)} | {rng.randrange(-500, 500) for _ in range(300)} | {-(2**63), 2**63 - 1, 0, -1}
    for schema, ids in (
        ("k bigint", [*values, None]), ("k bigint", [v for v in values if v >= 0]), ("k bigint", range(7000, 7700)),
        ("k date", [D(2020, 1, 1) + dt.timedelta(days=i * i % 4001) for i in range(60)]),
        ("k string", ["", "a", *[f"a{'é' * (i % 7)}{i}" for i in range(200)], None]), ("k string", [f"acc-{i:05d}" for i in range(300)]),
    ):
        df = spark.createDataFrame([(v,) for v in dict.fromkeys(ids)], schema)
        df.createOrReplaceTempView("ntile_wide")
        want = spark.sql("select k, ntile(5) over (order by k nulls first) t from ntile_wide").collect()
        assert listed(op.ntile_global(df, "k", 5, "t")) == sorted(map(tuple, want), key=repr)


def test_ntile_reads_as_much_whatever_the_partitions(spark, monkeypatch):
    read = []
    counts = split._counts
    monkeypatch.setattr(split, "_counts", lambda *a: (read.append(len(out := counts(*a))), out)[1])
    for n in (2, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            split.tile_starts(spark.range(0, 3_000_000, 7).repartition(n), "id", 4)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
        read.append(-1)
    first, second = read[: read.index(-1)], read[read.index(-1) + 1 : -1]
    assert first == second and max(first) <= 257 * 3 and len(first) <= 3


def test_rows_without_a_key_pass_by_the_join(frame):
    left = frame("id int, k string, j string", *[(i, None if i % 10 else "a", "x" if i % 3 else None) for i in range(60)])
    right = frame("rk string, rj string, v int", ("a", "x", 1), (None, "x", 2), ("a", None, 3))
    for extra in (None, F.col("id") > 20):
        plain = op.attach(left, right, [("k", "rk"), ("j", "rj")], extra=extra, flag="hit")
        apart = op.attach(left, right, [("k", "rk"), ("j", "rj")], extra=extra, flag="hit", keyless_apart=True)
        assert apart.columns == plain.columns and listed(apart) == listed(plain)
    with pytest.raises(ValueError, match="left join"):
        op.attach(left, right, [("k", "rk")], "inner", keyless_apart=True)


def test_ntile_global_on_text_ids(spark):
    df = spark.range(501).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    df.createOrReplaceTempView("ntile_text")
    want = spark.sql("select k, ntile(2) over (order by k) t from ntile_text").collect()
    assert sorted(map(tuple, op.ntile_global(df, "k", 2, "t").collect())) == sorted(map(tuple, want))


def test_union_distinct_matches_by_name(frame):
    a = frame("x int, y int", (1, 2), (1, 2))
    b = frame("y int, x int", (2, 1), (9, 9))
    assert listed(op.union_distinct(a, b)) == [(1, 2), (9, 9)]


def test_stitch_history_is_disjoint(frame):
    history = frame("d date, s string", (D(2025, 1, 1), "x"), (D(2025, 1, 2), "y"))
    got = stitch_history(history, history, "d", D(2025, 1, 1))
    assert listed(got) == [(D(2025, 1, 1), "x"), (D(2025, 1, 2), "y")]


def test_conform_casts_and_reports_missing(frame):
    df = frame("A int, b string, extra int", (1, "x", 2))
    assert [(f.name, f.dataType.simpleString()) for f in conform(df, "a bigint, b string").schema.fields] == [("a", "bigint"), ("b", "string")]
    with pytest.raises(ValueError):
        conform(df, "a bigint, z string")


def test_load_reads_declared_columns(spark, tmp_path):
    spark.range(3).withColumn("x", F.lit("1")).write.parquet(str(tmp_path / "t.parquet"))
    assert load(spark, str(tmp_path), "t", "id int, x string").schema["id"].dataType.simpleString() == "int"


def test_nested_documents(one):
    doc = F.lit('{"summary": {"account": {"cents": 5}}}')
    assert one(nested(doc, "summary struct<account: struct<cents: bigint>>")["summary"]["account"]["cents"]) == 5
    assert one(nested(F.lit('{"a": "x"}'), "map<string, string>")["b"]) is None


def test_run_sql_binds_values(spark, frame):
    df = frame("m string", ("2023-07",), ("2024-06",), ("2024-07",))
    got = run_sql(spark, "select m from {rows} where m between :a and :b", {"rows": df}, a="2023-07", b="2024-06")
    assert listed(got) == [("2023-07",), ("2024-06",)]
    hostile = run_sql(spark, "select count(*) as n from {rows} where m = :a", {"rows": df}, a="x' or '1'='1")
    assert hostile.first()["n"] == 0


def test_audience_log_appends_and_prunes(spark, frame, tmp_path):
    path = str(tmp_path / "log")
    df = frame("account_id string", ("acc-001",))
    append_audience(df, T(2024, 1, 1, 6), path=path)
    append_audience(df, T(2024, 1, 2, 6), path=path)
    log = spark.read.parquet(path)
    assert log.count() == 2
    late = log.filter(F.col("adjudicated_date") > D(2024, 1, 1))
    assert late.count() == 1 and "PartitionFilters: [isnotnull(adjudicated_date" in late._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        append_audience(df, T(2024, 1, 1), path=path, table="t")


def test_tables_views_and_records(spark, frame):
    df = frame("a int, b string", (1, "x"))
    replace_table(df, "limitloom_demo")
    replace_table(df.withColumn("a", F.lit(2)), "limitloom_demo")
    assert listed(spark.table("limitloom_demo")) == [(2, "x")]
    session_view(df, "limitloom_view")
    assert spark.sql("select a from limitloom_view").first()["a"] == 1
    assert to_records(df).first()["record"] == '{"a":1,"b":"x"}'
    spark.sql("drop table limitloom_demo")
