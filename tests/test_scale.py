"""Plans and skew: what must hold when a key owns a third of the rows."""

import datetime as dt
import re

import pytest
from conftest import listed, plan_of
from pyspark.sql import functions as F

from limitloom import operators as op
from limitloom.operators import scan
from limitloom.operators.star import gather
from limitloom.plans import early_campaign, reactive_eligibility, score_studies, vintage_tracker
from limitloom.queries.catalogue import QUERIES
from limitloom.queries.registry import AS_OF
from limitloom.session import build_session, durable, run_folder, shared_folder, sized_for
from limitloom.sources import append_audience, replace_table
from limitloom.sources.portfolio_standins import campaign_frames, portfolio

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def hot(spark):
    """60,000 event rows over 30 days, a third of them on one account."""
    account = F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 997)
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("id") * 7919) % 2592000)
    return spark.range(60_000).repartition(8).select("id", account.alias("account_id"), at.alias("ts"))


def task_rows(df, keys):
    """Largest number of rows one group of the keys holds."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0]


def test_top_per_key_limits_before_the_shuffle(hot):
    plan = plan_of(op.latest_per_key(hot, "account_id", "ts"))
    # Printed top down: below the exchange by account the rows are cut to one per key and task.
    below = plan[plan.index("Exchange hashpartitioning(account_id") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_hot_key_join_is_split(spark, hot):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        accounts = hot.select("account_id").distinct().withColumn("brand", F.col("account_id") % 5)
        accounts = durable(accounts)
        out = op.attach(durable(hot.withColumn("pad", F.sha2(F.col("id").cast("string"), 256))), accounts, "account_id")
        out = out.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.max("pad"))
        assert sum(r["n"] for r in out.collect()) == 60_000
        assert "skew=true" in plan_of(out)
    finally:
        for k in settings:
            spark.conf.unset(k)


@pytest.fixture
def crowded(spark):
    """60,000 event rows, a third of them on one account and one day, a tenth of all at a single instant of it."""
    account = F.when(F.col("id") % 3 == 0, 0).otherwise(1 + F.col("id") % 997)
    second = F.when(F.col("id") % 3 == 0, F.when(F.col("id") % 10 < 3, 500).otherwise((F.col("id") * 7919) % 86400)).otherwise((F.col("id") * 7919) % 2592000)
    return spark.range(60_000).repartition(8).select("id", account.alias("account_id"), F.timestamp_seconds(F.lit(1704067200) + second).alias("ts"))


def test_pieces_of_a_crowded_key_are_even(no_broadcast, crowded):
    cut = scan.cut(crowded, ["account_id"], ["ts", "id"], 1000)
    held = cut.filter("__split").groupBy("__piece").count()
    most, pieces = held.agg(F.max("count"), F.count("*")).first()
    assert most < 3000 and pieces >= 10 and held.filter("__piece.k0 <> 0").count() == 0
    assert cut.count() == 60_000


def test_asof_spreads_a_crowded_key(no_broadcast, crowded):
    left = crowded.filter("id % 2 = 0").withColumnRenamed("id", "lid")
    right = crowded.filter("id % 2 = 1").select(F.col("id").alias("rid"), "account_id", F.col("ts").alias("rts"))
    out = op.asof_forward(left, right, "account_id", "ts", "rts", tiebreak=["rid"], own=["lid"], piece_rows=1000)
    plan = plan_of(out)
    windows = re.findall(r"windowspecdefinition\(([^)]*?)(?: ASC| DESC)", re.sub(r"#\d+L?", "", plan))
    # Raw rows are read by piece; the other window reads one row per piece of the keys that were cut.
    assert len(windows) >= 2 and all(re.match(r"__piece|__at|_w\d", w) for w in windows)
    # Against the per-account answer: the minimum later time, and the smallest id at it.
    brute = left.join(right, "account_id").filter("rts > ts").groupBy("lid").agg(F.min(F.struct("rts", "rid")).alias("want"))
    wrong = out.join(brute, "lid", "full").filter(~(F.col("rts").eqNullSafe(F.col("want.rts")) & F.col("rid").eqNullSafe(F.col("want.rid"))))
    assert out.count() == 30_000 and wrong.count() == 0


def test_running_ordinal_of_a_crowded_key(no_broadcast, crowded):
    out = op.running_ordinal(crowded, "account_id", "ts", "n", 1000, ["id"])
    ranks = re.findall(r"row_number\(\) windowspecdefinition\(([^)]*?) ASC", re.sub(r"#\d+L?", "", plan_of(out)))
    assert ranks and all("__piece" in r for r in ranks)
    checks = out.groupBy("account_id").agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("rows"), F.countDistinct("n").alias("kinds"))
    assert checks.filter("top <> rows or kinds <> rows").count() == 0
    plain = op.running_ordinal(crowded, "account_id", "ts", "n", tiebreak=["id"])
    assert out.exceptAll(plain).count() == 0


def test_group_total_has_partial_sums(no_broadcast, hot):
    plan = plan_of(op.group_total(hot, "account_id", "id", "t"))
    assert "Window" not in plan and "partial_sum" in plan


def test_exclusions_are_anti_joins(no_broadcast, hot):
    other = hot.select("account_id", F.col("ts").alias("later"))
    for out in (op.exclude(hot, other, "account_id"), op.exclude(hot, other, "account_id", later_than=("later", "ts"))):
        plan = plan_of(out)
        assert "LeftAnti" in plan and "LeftOuter" not in plan
        # The other side is reduced to one row per key before the join.
        assert plan.count("HashAggregate(keys=[account_id") == 2 or plan.count("HashAggregate(keys=[__key0") == 2


def test_split_never_sorts_in_one_partition(no_broadcast, hot):
    plan = plan_of(op.ntile_global(hot, "id", 2))
    assert "Window" not in plan and "SinglePartition" not in plan and "Exchange hash" not in plan


def test_panel_joins_counted_offers(no_broadcast, spark):
    """However many offers an account has, the join sees one row per vintage."""
    offers = spark.range(30_000).select(F.lit(1).alias("account_id"), F.expr("date_add(date '2024-01-01', cast(id % 60 as int))").alias("offer_date"))
    perf = spark.createDataFrame([(1, dt.date(2024, m, 1), m) for m in range(1, 7)], "account_id int, stmt_date date, raim int")
    panel = vintage_tracker.vintage_panel(offers, perf, span=(1, 2))
    assert panel.count() == 4 and panel.agg(F.sum("n_offers")).first()[0] == 60_000
    listed_ = vintage_tracker.track(offers, perf).filter("cli_stmt between 1 and 2")
    assert listed(panel.groupBy("cli_stmt").agg(vintage_tracker.weighted_sum("raim"))) == listed(listed_.groupBy("cli_stmt").agg(F.sum("raim")))


def test_unfolded_months_are_not_broadcast(spark):
    """Twelve months of an offer are twelve rows, which the size Spark derives does not show."""
    offers = spark.range(100).select(F.col("id").alias("account_id"), F.lit(dt.date(2024, 1, 5)).alias("offer_date"))
    perf = spark.createDataFrame([(1, dt.date(2024, 3, 1), 4)], "account_id long, stmt_date date, raim int")
    panel = vintage_tracker.vintage_panel(offers, perf, span=(1, 12))
    plan = plan_of(panel)
    assert "Generate explode" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [(r.account_id, r.cli_stmt, r.n_offers) for r in panel.collect()] == [(1, 2, 1)]


def test_campaign_joins_line_items_once(no_broadcast):
    frames = campaign_frames(no_broadcast, DIR)
    for name in ("account_daily", "transactions", "statements", "junior_scores", "behaviour_scores"):
        assert "lineitem.parquet" not in plan_of(frames[name]), name


def test_campaign_sends_outcomes_of_inputs(no_broadcast):
    frames = {"redecision_inputs": durable(campaign_frames(no_broadcast, DIR)["redecision_inputs"])}
    daily = no_broadcast.createDataFrame([([1000002],)], "open_before array<long>")
    plan = plan_of(early_campaign.redecision(frames, daily, ["input_id"]))
    # The side of the inputs is cut to user, outcome and order before its exchange.
    sent = plan[plan.rindex("Exchange hashpartitioning") :]
    assert re.search(r"Project \[[^\n]*AS approves#\d+, [^\n]*AS __order0#\d+", sent)


def test_old_reports_share_a_row(spark):
    names = [f for f in reactive_eligibility.BUREAU_COLUMNS if f != "segment_indicator"]
    schema = "user_id int, credit_report_date string, created_at timestamp, segment int, " + ", ".join(f"{x} int" for x in names)
    days = [dt.datetime(2024, m, 5) for m in range(1, 13)]
    bureau = spark.createDataFrame([(1, d.strftime("%Y%m%d"), d, d.month, *[d.month] * len(names)) for d in days], schema)
    rows = lambda *since: gather(["user_id", "pull_mth"], [reactive_eligibility.bureau_side(bureau, *since)])
    assert rows().count() == 12
    kept = rows("2024-11").select("pull_mth", "report.score", "report.segment_indicator").collect()
    assert sorted(map(tuple, kept), key=str) == [("2024-11", 11, 11), ("2024-12", 12, 12), (None, 10, 10)]


def test_entry_scan_is_pruned_and_filtered(no_broadcast):
    df = QUERIES["vintage_margin_by_month"](no_broadcast, DIR)
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)" in plan
    for unread in ("l_partkey", "l_suppkey", "l_linenumber", "c_acctbal", "o_totalprice"):
        assert unread not in plan


def test_shared_folder_follows_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_folder(spark) == configured
    assert run_folder(spark, "x").startswith(configured) and run_folder(spark, "x") != run_folder(spark, "x")
    assert build_session("local[8]") is not None


def test_durable_cuts_lineage_and_keeps_rows(spark):
    df = spark.range(10).withColumn("s", F.struct("id"))
    stored = durable(df)
    assert "Scan parquet" in plan_of(stored) and "Range" not in plan_of(stored)
    assert listed(stored) == listed(df)


def test_no_machine_local_state_in_the_library():
    import pathlib

    sources = "\n".join(p.read_text() for p in pathlib.Path(__file__).resolve().parent.parent.joinpath("limitloom").rglob("*.py"))
    for word in ("localCheckpoint", "crossJoin", "toPandas", ".rdd", "udf("):
        assert word not in sources


def test_tables_bucketed_alike_join_without_a_shuffle(no_broadcast, hot):
    spark = no_broadcast
    accounts = hot.select("account_id").distinct().withColumn("brand", F.col("account_id") % 5)
    replace_table(hot, "limitloom_hot", bucket_by=(8, "account_id"))
    replace_table(accounts, "limitloom_accounts", bucket_by=(8, "account_id"))
    try:
        joined = op.attach(spark.table("limitloom_hot"), spark.table("limitloom_accounts"), "account_id")
        assert "Exchange" not in plan_of(joined) and joined.filter("brand is not null").count() == 60_000
    finally:
        spark.sql("drop table limitloom_hot")
        spark.sql("drop table limitloom_accounts")


def test_sizing_follows_the_data():
    big = sized_for(100 << 40, cores=4000)
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (128 << 20)
    assert sized_for(1, cores=8)["spark.sql.shuffle.partitions"] == "24"


@pytest.mark.parametrize("name", ["backtest_all_months", "backtest_after_offer"])
def test_back_test_never_joins_on_the_account_alone(no_broadcast, name):
    plan = re.sub(r"#\d+L?", "", plan_of(QUERIES[name](no_broadcast, DIR)))
    joins = re.findall(r"(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)[^\[]*\[([^\]]*)\]", plan)
    assert len(joins) == 2 and all(len(keys.split(", ")) == 2 for keys in joins), joins


def test_a_hot_account_in_the_back_test(no_broadcast):
    """20,000 offer days of one account: each meets the months after its risk month only."""
    spark = no_broadcast
    perf = spark.range(48).select(F.lit(1).alias("account_id"), F.date_format(F.add_months(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")), "yyyy-MM").alias("stmt_mth"),
        F.lit("CORE").alias("brand"), F.lit("WORLD_ELITE").alias("card_type"), F.lit("3. PRIME").alias("tu_band"), F.lit(3).alias("bfc"), F.lit(1).alias("cof"), F.lit(1).alias("guco"), F.lit("UNSECURED").alias("secure_type"))
    scores = perf.select("account_id", F.to_timestamp(F.concat("stmt_mth", F.lit("-01"))).alias("reference_date"), F.when(F.col("stmt_mth").isin("2021-03", "2022-12"), 1.0).otherwise(0.0).alias("prediction"))
    offers = spark.range(20_000).select(F.lit(1).alias("account_id"), F.expr("date_add(date '2019-06-01', cast(id % 1600 as int))").alias("offer_date"), F.lit(1).alias("accepted_flag"), F.lit("UNSECURED").alias("sub_product"), F.lit(12).alias("cli_mob"))
    number = lambda m: int(m[:4]) * 12 + int(m[5:7])
    months, days = [r[0] for r in perf.select("stmt_mth").collect()], offers.groupBy("offer_date").count().collect()
    for after in (False, True):
        out = score_studies.backtest(offers, perf, scores, scores, dt.datetime(2021, 1, 1), ["CORE"], after)
        got = {(r.offer_date, r.stmt_mth): (r.risk_mth, r.risk_stmt, r.n_offers, r.cli_stmt) for r in out.collect()}
        want = {}
        for day, n in days:
            risks = [m for m in ("2021-03", "2022-12") if not after or m > f"{day:%Y-%m}"]
            for mth in months if risks else ():
                if mth > risks[0]:
                    want[day, mth] = (risks[0], number(mth) - number(risks[0]), n, number(mth) - day.year * 12 - day.month)
        assert got == want


def test_eligibility_attaches_side_tables_once_per_key(no_broadcast):
    """29 exchanges, 17 joins and 40 sorts stood in the plan with a join per side table."""
    frames = {k: durable(v, k) for k, v in portfolio(no_broadcast, DIR).items()}
    plan = plan_of(reactive_eligibility.eligibility_inputs(frames, AS_OF))
    assert len(re.findall(r"\bExchange ", plan)) <= 29 // 3 and len(re.findall(r"Join ", plan)) <= 6
    daily = plan_of(reactive_eligibility.daily_summary(frames["account_daily"], AS_OF))
    assert "SortAggregate" not in daily and "Sort [" not in daily
    assert "customer_id" not in daily and "product_type" not in daily


def test_latest_row_is_found_by_hash_first(no_broadcast, hot):
    stored = durable(hot.withColumn("pad", F.lit("x")))
    plan = plan_of(op.latest_per_key(stored, "account_id", "ts", [F.col("id")], narrow=True))
    assert "SortAggregate" not in plan and "LeftSemi" in plan and "partial_max(ts" in plan
    for name in ("latest_per_key",):
        assert "SortAggregate" not in plan_of(QUERIES[name](no_broadcast, DIR))


def test_requests_without_an_offer_are_not_shuffled(no_broadcast):
    spark = no_broadcast
    requests = durable(spark.range(10_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("offer_id")))
    offers = durable(spark.range(0, 10_000, 10).select(F.col("id").alias("key"), F.lit(1).alias("x")))
    out = op.attach(requests, offers, [("offer_id", "key")], keyless_apart=True)
    assert out.count() == 10_000 and out.filter("x = 1").count() == 1000
    exchanged = out._jdf.queryExecution().executedPlan()
    out.collect()
    plan = plan_of(out)
    joined, passed = plan.split("== Initial Plan ==")[0].split("SortMergeJoin", 1) if "SortMergeJoin" in plan else ("", plan)
    assert "Union" in plan and exchanged is not None
    # the scan that feeds the join reads keyed rows only, and the other branch has no exchange
    assert "isnotnull(offer_id" in passed and plan.count("Exchange hashpartitioning(offer_id") <= 2


def test_audience_log_replaces_a_repeated_run(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit("a").alias("name"))
    at, later = dt.datetime(2024, 5, 1, 6), dt.datetime(2024, 5, 1, 18)
    path = str(tmp_path / "log")
    for run, when in ((rows, at), (rows.limit(3), later), (rows, at), (rows.filter("id < 4"), at)):
        append_audience(run, when, path=path)
        append_audience(run, when, table="limitloom_log")
    try:
        for log in (spark.read.parquet(path), spark.table("limitloom_log")):
            assert {(r[0], r[1]) for r in log.groupBy("adjudicated_at").count().collect()} == {(at, 4), (later, 3)}
        append_audience(rows.limit(0), at, path=path)
        append_audience(rows.limit(0), at, table="limitloom_log")
        for log in (spark.read.parquet(path), spark.table("limitloom_log")):
            assert log.count() == 3
    finally:
        spark.sql("drop table limitloom_log")
