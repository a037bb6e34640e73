import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from limitloom import functions as fn

D = dt.date


@pytest.mark.parametrize(
    "a, b, months",
    [
        (D(2024, 1, 31), D(2024, 2, 1), 1),
        (D(2024, 1, 1), D(2024, 1, 31), 0),
        (D(2024, 1, 15), D(2024, 3, 14), 2),
        (D(2024, 3, 1), D(2024, 2, 29), -1),
        (D(2023, 12, 31), D(2025, 1, 1), 13),
    ],
)
def test_month_diff_counts_boundaries(one, a, b, months):
    assert one(fn.month_diff(a, b)) == months


def test_completed_months_differ_from_boundaries(one):
    assert one(fn.completed_months(D(2024, 1, 31), D(2024, 2, 1))) == 0
    assert one(fn.completed_months(D(2024, 1, 15), D(2024, 3, 15))) == 2


def test_month_keys(one):
    assert one(fn.month_key(D(2024, 2, 29))) == "2024-02"
    assert one(fn.month_start(F.lit("2024-02"))) == D(2024, 2, 1)
    assert one(fn.month_floor(D(2024, 2, 29))) == D(2024, 2, 1)


def test_months_on_book(one):
    assert one(fn.mob(D(2024, 1, 31), D(2024, 2, 29))) == 1.0  # both last days
    assert one(fn.mob(D(2024, 1, 15), D(2024, 2, 1))) == pytest.approx(1 - 14 / 31)
    assert one(fn.mob_rounded(D(2024, 1, 1), D(2024, 2, 17))) == 2.0  # 1.516 rounds up


@pytest.mark.parametrize("n", [30, 90, 180])
def test_within_days_ends(one, n):
    as_of = D(2024, 7, 31)
    edge = as_of - dt.timedelta(days=n)
    assert one(fn.within_days(edge, as_of, n)) is False
    assert one(fn.within_days(edge, as_of, n, inclusive=True)) is True
    assert one(fn.within_days(as_of + dt.timedelta(days=1), as_of, n)) is False


def test_money(one):
    assert one(fn.dollars(F.lit(12345))) == Decimal("123.45")
    assert one(fn.safe_ratio(F.lit(1), F.lit(0))) is None
    assert one(fn.safe_ratio(F.lit(0), F.lit(0), default=1)) == 1.0
    assert one(fn.safe_ratio(F.lit(-1), F.lit(4), default=1)) == -0.25
    assert one(fn.ceil_to(F.lit(1201.0), 100)) == 1300
    assert one(fn.ceil_to(F.lit(1200.0), 100)) == 1200
    assert one(fn.round_to(F.lit(1250.0), 100)) == 1300
    assert one(fn.clamp(F.lit(None).cast("int"), 1, 5)) is None
    assert [one(fn.clamp(F.lit(x), 1, 5)) for x in (0, 3, 9)] == [1, 3, 5]


def test_scores(one):
    assert one(fn.clean_score(F.lit(float("nan")))) is None
    assert one(fn.floor_at_zero(F.lit(None).cast("int"))) == 0
    assert one(fn.floor_at_zero(F.lit(-4))) == 0
    assert one(fn.score_bucket(F.lit(0.7))) == "Bucket7"
    assert one(fn.score_bucket(F.lit(1.0))) == "Bucket10"
    assert one(fn.score_bucket(F.lit(None).cast("double"))) is None


def test_band_edges(one):
    right = lambda x: one(fn.band(F.lit(x), [100, 500], ["low", "mid", "high"], "none"))
    left = lambda x: one(fn.band(F.lit(x), [100, 500], ["low", "mid", "high"], "none", closed="left"))
    assert [right(x) for x in (100, 101, 500, 501)] == ["low", "mid", "mid", "high"]
    assert [left(x) for x in (99, 100, 499, 500)] == ["low", "mid", "mid", "high"]
    assert one(fn.band(F.lit(None).cast("int"), [1], ["a", "b"], "none")) == "none"
    assert one(fn.band(F.lit(None).cast("int"), [1], ["a", "b"])) is None
    with pytest.raises(ValueError):
        fn.band(F.lit(1), [1, 2], ["a"])


def test_first_match_skips_unknown_predicates(one):
    unknown = F.lit(None).cast("int") != 1
    assert one(fn.first_match([(unknown, "a"), (F.lit(True), "b")], "c")) == "b"
    assert one(fn.first_match([(unknown, "a")], "c")) == "c"
    assert one(fn.first_match([(unknown, "a")])) is None
    with pytest.raises(ValueError):
        fn.first_match([])


def test_conditional_aggregates(frame):
    df = frame("k string, x int", ("a", 1), ("a", 5), ("b", 1), ("c", None))
    got = df.groupBy("k").agg(
        fn.cond_sum(F.col("x") > 3, empty=None).alias("n"),
        fn.cond_sum(F.col("x") > 3).alias("z"),
        fn.cond_count(F.col("x") >= 1, "x").alias("c"),
    )
    assert {r["k"]: (r["n"], r["z"], r["c"]) for r in got.collect()} == {"a": (1, 1, 2), "b": (None, 0, 1), "c": (None, 0, 0)}


def test_ladder(one):
    rungs = [fn.Rung("add", 500, above=100, up_to=500), fn.Rung("times", 2, up_to=1500, guard_below=800), fn.Rung("times", 3, up_to=1500, guard_from=800)]
    move = lambda limit, score: one(fn.first_match(fn.ladder(F.lit(limit), F.lit(score), rungs)))
    assert [move(100, 700), move(101, 700), move(500, 900), move(501, 799), move(1500, 800), move(1501, 800)] == [200.0, 601.0, 1000.0, 1002.0, 4500.0, None]
    with pytest.raises(ValueError):
        fn.ladder(F.lit(1), F.lit(1), [fn.Rung("minus", 1, up_to=3)])
