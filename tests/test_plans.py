"""Pipelines on small domain tables: single-account traces and population checks."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import listed
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limitloom.plans import early_campaign, population, reactive_eligibility, request_funnel, score_studies, vintage_tracker
from limitloom.rulesets import reactive
from limitloom.rulesets.brands import Brands
from limitloom.sources import DOMAIN, append_audience

D, TS = dt.date, dt.datetime
BRANDS = Brands(core="CORE", partner="PART", cut_group={"PART": "partner", "CORE": "core"})


# Members of the studied population unless a row says otherwise.
DEFAULTS = {"offers_view": {"sub_product": "UNSECURED", "cli_mob": 12}, "performance": {"secure_type": "UNSECURED"}}


@pytest.fixture
def domain(spark):
    """``domain("statements", {..}, ..)``: rows of a domain table, unnamed columns missing."""

    def make(name, *rows):
        schema = T._parse_datatype_string(DOMAIN[name])
        known = {f.name for f in schema.fields}
        rows = [{**DEFAULTS.get(name, {}), **r} for r in rows]
        for row in rows:
            assert set(row) <= known, set(row) - known
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    return make


@pytest.fixture
def monthly(domain):
    """Monthly performance of an account from (month, raim) pairs."""

    def make(*rows):
        base = {"brand": "CORE", "card_type": "STANDARD", "tu_band": "1. SUBPRIME"}
        df = domain("performance", *[{**base, **r} for r in rows])
        return df.withColumns({"stmt_date": F.to_date(F.concat("stmt_mth", F.lit("-01"))), "raim": F.col("bfc") - F.col("cof") - F.col("guco")})

    return make


def month(account, mth, bfc=10, guco=0, **more):
    return {"account_id": account, "stmt_mth": mth, "bfc": Decimal(bfc), "cof": Decimal(1), "guco": Decimal(guco), "adb": Decimal(100), **more}


# ---- vintage tracking --------------------------------------------------------------------


def test_panel_weighs_what_track_lists(domain, monthly):
    offers = domain(
        "offers_view",
        *[{"account_id": "acc-001", "offer_date": D(2024, 1, d), "accepted_flag": 1} for d in (5, 5, 31)],
        {"account_id": "acc-001", "offer_date": D(2024, 2, 1), "accepted_flag": 0},
        {"account_id": "acc-002", "offer_date": D(2024, 1, 1), "accepted_flag": 1},
    )
    months = monthly(month("acc-001", "2024-01", 5), month("acc-001", "2024-02", 7, 2), month("acc-001", "2024-04", 9))
    perf = months.select("account_id", "stmt_mth", "stmt_date", "brand", "raim", "guco")
    tracked = vintage_tracker.track(offers.filter("accepted_flag = 1"), perf)
    assert listed(tracked, "account_id", "stmt_mth", "cli_stmt").count(("acc-001", "2024-02", 1)) == 3
    assert ("acc-002", None, None) in listed(tracked, "account_id", "stmt_mth", "cli_stmt")
    by_month = vintage_tracker.margin_by_month(offers, months)
    expanded = tracked.groupBy("stmt_mth", "brand").agg(F.count(F.lit(1)), F.sum("guco"), F.sum("raim"))
    assert listed(by_month) == listed(expanded)


def test_panel_span_and_means(domain, monthly):
    offers = domain("offers_view", *[{"account_id": "acc-001", "offer_date": D(2024, 1, d), "accepted_flag": 1} for d in (1, 31)])
    perf = monthly(*[month("acc-001", m, 11) for m in ("2024-01", "2024-02", "2025-01", "2025-02")]).select("account_id", "stmt_mth", "stmt_date", "raim")
    panel = vintage_tracker.vintage_panel(offers, perf, span=(1, 12))
    assert listed(panel, "cli_stmt", "n_offers") == [(1, 2), (12, 2)]
    assert panel.agg(vintage_tracker.weighted_mean("raim", "m")).first()["m"] == 10.0


def test_balance_by_bucket(domain, monthly):
    offers = domain("offers_view", {"account_id": "acc-001", "offer_date": D(2024, 1, 1), "accepted_flag": 1})
    rows = [month("acc-001", "2024-03", dpd_bucket=b) for b in ("B0", "B1", "B2", "B7", None)]
    got = vintage_tracker.balance_by_bucket(offers, monthly(*rows), "CORE", "2023-12", "2024-03")
    # B7 and an unknown bucket count nowhere.
    assert listed(got, "early_balance", "late_balance") == [(Decimal("200.00"), Decimal("100.00"))]


def test_population_gates(domain):
    gates = [("UNSECURED", 7), ("UNSECURED", 6), ("UNSECURED", None), ("SECURED", 12), (None, 12)]
    offers = domain("offers_view", *[{"account_id": f"a{i}", "sub_product": s, "cli_mob": m} for i, (s, m) in enumerate(gates)])
    assert listed(population.unsecured_offers(offers), "account_id") == [("a0",), ("a1",), ("a2",)]
    assert listed(population.unsecured_offers(offers, population.LATER_TENURE), "account_id") == [("a0",)]
    rows = [month("a", "2024-02", 9, 2), {**month("b", "2024-02"), "guco": None}, {**month("c", "2024-02"), "secure_type": "SECURED"}, {**month("d", "2024-02"), "secure_type": None}]
    assert listed(population.monthly_margin(domain("performance", *rows)), "account_id", "stmt_date", "raim") == [("a", D(2024, 2, 1), Decimal("6.00")), ("b", D(2024, 2, 1), None)]


def test_every_monthly_pipeline_leaves_secured_rows_out(domain, monthly):
    """A secured account beside an unsecured one, and an early offer, change no result."""
    own = {"account_id": "acc-001", "offer_date": D(2024, 1, 5), "accepted_flag": 1}
    early, secured = {**own, "offer_date": D(2024, 1, 6), "cli_mob": 6}, {**own, "account_id": "acc-009", "sub_product": "SECURED"}
    months = ["2024-01", "2024-02", "2024-03"]
    perf = [month("acc-001", m, 11, dpd_bucket="B0") for m in months]
    other = [{**month("acc-009", m, 11, dpd_bucket="B0"), "secure_type": "SECURED"} for m in months]
    marks = scores(domain, *[(a, TS(2024, k, d), 0.9) for a in ("acc-001", "acc-009") for k, d in ((1, 5), (1, 6), (1, 1), (2, 1), (3, 1))])
    requests = [{"request_id": f"r-{a}", "user_id": "u", "account_id": a, "offer_id": None, "created_at": TS(2024, 2, 5)} for a in ("acc-001", "acc-009")]
    behaviour, book, bankruptcy = domain("behaviour_scores"), domain("limit_offers"), domain("bankruptcy_scores")
    risky = domain("risk_accounts")

    def results(offers, tracked, rows):
        offers, tracked, rows = domain("offers_view", *offers), domain("offers_view", *tracked), monthly(*rows)
        requested = request_funnel.requests_with_offers(domain("change_requests", *requests), book, D(2024, 5, 1))
        study = score_studies.CutStudy(offers, marks, rows, risky, "2024-01", "2024-06")
        out = [
            vintage_tracker.margin_by_month(tracked, rows), vintage_tracker.charge_offs_by_vintage(tracked, rows, "CORE", months),
            vintage_tracker.balance_by_bucket(tracked, rows, "CORE", "2023-12", "2024-03"), request_funnel.approval_grid(request_funnel.funnel(requested, rows, span=(0, 0))),
            score_studies.average_scores(score_studies.multi_score(offers, marks, rows, behaviour, book, bankruptcy, BRANDS)),
            score_studies.backtest(offers, rows, marks, marks, TS(2024, 1, 1), ["CORE"]).drop("n_offers"),
            score_studies.tranche_risk_mix(offers, rows, marks, marks, TS(2024, 1, 1), "CORE"), study.margin_curves(), study.increment("CORE"), study.repeat_margin("CORE"),
        ]
        return [listed(x) for x in out]

    assert results([own], [own], perf) == results([own, early, secured], [own, secured], perf + other)


# ---- request funnel --------------------------------------------------------------------------


@pytest.fixture
def requested(domain, monthly):
    requests = domain(
        "change_requests",
        *[{"request_id": f"r{i}", "user_id": "u1", "account_id": "acc-001", "offer_id": f"o{i}", "created_at": TS(2025, 3, 5)} for i in range(4)],
        {"request_id": "r9", "user_id": "u2", "account_id": "acc-002", "created_at": TS(2025, 3, 6)},
        {"request_id": "late", "user_id": "u2", "account_id": "acc-002", "created_at": TS(2025, 8, 1)},
    )
    base = {"account_id": "acc-001", "strategy": "STD", "created_at": TS(2025, 3, 5), "limit_cents_at_offer": 100_000, "offered_limit_cents": 600_000}
    offers = domain(
        "limit_offers",
        {**base, "offer_id": "o0", "accepted_at": TS(2025, 4, 2)},
        {**base, "offer_id": "o1", "declined_at": TS(2025, 3, 9)},
        {**base, "offer_id": "o2"},
        {**base, "offer_id": "o3", "strategy": "PRTV-1"},
    )
    perf = monthly(
        *[month("acc-001", m, cl=Decimal(1000), booking_date=D(2023, 3, 1)) for m in ("2025-03", "2025-04")],
        month("acc-002", "2025-03", cl=Decimal(2000), booking_date=D(2020, 1, 1)),
    )
    rows = request_funnel.requests_with_offers(requests, offers, D(2025, 9, 1), before=D(2025, 8, 1))
    return rows, perf


def test_funnel_statuses_and_partitions(requested):
    rows, perf = requested
    status = {r["request_id"]: r["accept_status"] for r in rows.collect()}
    assert status == {"r0": "Accepted", "r1": "Declined", "r2": "Expired", "r3": "not in V2 strategy", "r9": "Not Approved"}
    decision_month = request_funnel.funnel(rows, perf, span=(0, 0))
    everything = request_funnel.funnel(rows, perf)
    assert listed(decision_month, "request_id", "stmt_mth", "icl_adj", "mob") == listed(everything.filter("cli_stmt = 0"), "request_id", "stmt_mth", "icl_adj", "mob")
    # An accepted offer is dated by its acceptance.
    assert ("r0", "2025-04") in listed(decision_month, "request_id", "stmt_mth")
    grid = request_funnel.approval_grid(decision_month)
    assert grid.agg(F.sum("total_count"), F.sum("approved_count")).first()[:] == (5, 4)
    expired = request_funnel.expired_by_limit(decision_month)
    assert listed(expired) == [("2, 100-1500", 1, 4)]


def test_decreases_history_and_restored(requested, domain):
    rows, perf = requested
    large = request_funnel.large_low_limit(request_funnel.funnel(rows, perf, span=(0, 0)))
    assert large.count() == 4
    cut = {"account_id": "acc-001", "initiated_at": TS(2025, 1, 1), "new_limit_cents": 100_000}
    decreases = domain("limit_decreases", {**cut, "previous_limit_cents": 300_000, "strategy": "X"}, {**cut, "previous_limit_cents": 900_000})
    marked = domain("risk_accounts", {"account_id": "acc-777"})
    assert request_funnel.without_decrease(large, decreases, marked).count() == 0
    assert request_funnel.without_decrease(large, decreases.filter("strategy is null"), marked).count() == 4
    restored = request_funnel.restored_above_decrease(large, decreases)
    # the new limit of 6,000 or so exceeds one of the two earlier limits
    assert set(listed(restored, "decreases", "lowest_prev_cl", "highest_prev_cl")) == {(1, Decimal("3000.00"), Decimal("3000.00"))} and restored.count() == 4
    pairs = request_funnel.restored_listing(large, decreases)
    assert set(listed(pairs, "prev_cl", "decreased_cl")) == {(Decimal("3000.00"), Decimal("1000.00"))} and pairs.count() == 4
    view = domain("offers_view", *[{"account_id": "acc-001", "accepted_flag": 1, "offer_mth": m, "new_cl": Decimal(5)} for m in ("2024-01", "2024-05")])
    assert request_funnel.accepted_history(large, view).count() == 8
    assert set(listed(request_funnel.accepted_summary(large, view), "accepted_offers", "last_offer_mth")) == {(2, "2024-05")}


def test_reasons_come_from_the_next_adjudication(requested, spark):
    rows, perf = requested
    base = {name: value for name, value in reactive.SHARED_GATES}
    base |= {"score_flag": 1, "sub_prime_flag": 0, "bureau_score_clean": 750, "mob_rounded": 9, "day_end_limit": 2000, "brand": "CORE", "segment": None, "province_group": "Other"}
    log = spark.createDataFrame([("acc-002", TS(2025, 3, 5)), ("acc-002", TS(2025, 3, 6)), ("acc-002", TS(2025, 3, 20)), ("acc-002", TS(2025, 4, 20))], "account_id string, adjudicated_at timestamp")
    log = log.withColumns({k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in base.items() if k != "inquiry_flag"})
    log = log.withColumn("inquiry_flag", (F.col("adjudicated_at") == F.lit(TS(2025, 3, 20))).cast("int"))
    decided = request_funnel.with_eligibility(request_funnel.funnel(rows, perf, span=(0, 0)), log, D(2024, 12, 31))
    assert decided.count() == 5
    assert listed(request_funnel.reject_reason_counts(decided, BRANDS, "2024-12")) == [("06", 1)]
    assert listed(request_funnel.reject_bucket_counts(decided, "2024-12"), "reject_bucket", "n") == [("04, Inquiry record", 1)]


# ---- score studies ---------------------------------------------------------------------------


def scores(domain, *rows):
    return domain("scores", *[{"account_id": a, "reference_date": t, "prediction": p} for a, t, p in rows])


def test_backtest_first_month_depends_on_the_reading(domain, monthly):
    offers = domain("offers_view", {"account_id": "acc-001", "offer_date": D(2024, 3, 10), "accepted_flag": 1})
    months = ["2024-01", "2024-04", "2024-05", "2024-06"]
    perf = monthly(*[month("acc-001", m) for m in months])
    history = scores(domain, *[("acc-001", TS(2024, int(m[-2:]), 1), p) for m, p in zip(months, [0.9, 0.2, 0.7, 0.1])], ("acc-001", TS(2024, 6, 2), 0.9))
    run = lambda flag: listed(score_studies.backtest(offers, perf, history, history, TS(2024, 4, 30), ["CORE"], flag), "stmt_mth", "risk_mth", "risk_stmt")
    assert run(False) == [("2024-04", "2024-01", 3), ("2024-05", "2024-01", 4), ("2024-06", "2024-01", 5)]
    assert run(True) == [("2024-06", "2024-05", 1)]


def test_tranche_mix_and_missing_scores(domain, monthly):
    offers = domain("offers_view", *[{"account_id": a, "offer_date": D(2024, 1, 31), "accepted_flag": 1} for a in ("acc-001", "acc-002", "acc-003")])
    perf = monthly(*[month(a, "2024-02") for a in ("acc-001", "acc-002", "acc-003")])
    day = TS(2024, 1, 31, 7)
    live = scores(domain, ("acc-001", day, 0.7), ("acc-002", day, 0.69), ("acc-003", day, float("nan")))
    got = score_studies.tranche_risk_mix(offers, perf, live, live, TS(2024, 1, 1), "CORE")
    assert listed(got) == [("2024-01", 1, 1, 0.5)]


def test_multi_score_cuts(domain, monthly):
    offers = domain("offers_view", {"account_id": "acc-001", "offer_date": D(2024, 3, 31), "accepted_flag": 1})
    senior = scores(domain, ("acc-001", TS(2024, 3, 31, 5), 0.8))
    behaviour = domain("behaviour_scores", {"account_id": "acc-001", "reference_date": TS(2024, 2, 29), "model_score": 621.0}, {"account_id": "acc-001", "reference_date": TS(2024, 3, 2), "model_score": 1.0})
    book = domain("limit_offers", *[{"account_id": "acc-001", "user_id": "u1", "strategy": s} for s in ("A", "A", "B")])
    bankruptcy = domain("bankruptcy_scores", {"user_id": "u1", "reference_date": TS(2024, 3, 1), "score": 680.0})
    perf = monthly(month("acc-001", "2024-04"), month("acc-001", "2025-04"))
    got = score_studies.multi_score(offers, senior, perf, behaviour, book, bankruptcy, BRANDS)
    # One line per strategy, month 13 left out.
    assert listed(got, "strategy", "cli_stmt", "beh_cut", "bko_cut") == [("A", 1, "Pass", "Fail"), ("B", 1, "Pass", "Fail")]
    assert listed(score_studies.average_scores(got)) == [("2024-03", "high risk", 621.0, 680.0)]


def test_cut_study_tables(domain, monthly):
    days = {"acc-001": [D(2024, 1, 5), D(2024, 3, 5)], "acc-002": [D(2024, 1, 5)], "acc-003": [D(2024, 1, 6)]}
    offers = domain("offers_view", *[{"account_id": a, "offer_date": d, "accepted_flag": int(a != "acc-003")} for a, ds in days.items() for d in ds])
    marks = scores(domain, *[(a, TS(d.year, d.month, d.day), 0.75) for a, ds in days.items() for d in ds])
    perf = monthly(*[month(a, m, 11) for a in days for m in ("2024-02", "2024-03", "2024-04")])
    risky = domain("risk_accounts", {"account_id": "acc-002"}, {"account_id": "acc-002"})
    study = score_studies.CutStudy(offers, marks, perf, risky, "2024-01", "2024-06")
    curves = listed(study.margin_curves(), "cli_stmt", "raim", "raim_cuml")
    assert [(int(s), float(r), float(k)) for s, r, k in curves] == [(1, 30.0, 30.0), (2, 20.0, 50.0), (3, 20.0, 70.0)]
    increment = study.increment("CORE").first()
    assert (increment["raim_responder"], increment["raim_nonresponder"], increment["accounts_responder"], increment["diff"]) == (30.0, 30.0, 3, 0.0)
    cut = {r["cut_level"]: r for r in study.cut_points("CORE", [0.7, 0.8]).collect()}
    assert (cut[0.7]["hram_cut_volume"], cut[0.7]["non_hram_cut_volume"], cut[0.8]["hram_cut_volume"]) == (1, 2, 0)
    assert listed(study.distribution("CORE"), "risk", "n") == [(0, 2), (1, 1)]
    assert listed(study.offers_per_account("CORE")) == [(1, 1), (2, 1)]
    assert listed(study.repeat_scores("CORE")) == [("2024-03", 0.75, None)]
    assert listed(study.repeat_margin("CORE")) == [("2024-03", 10.0, None)]
    assert {r["accepted_flag"] for r in study.response_curves("CORE").collect()} == {0, 1}


# ---- early-tenure campaign -------------------------------------------------------------------------

AS_OF = D(2025, 9, 5)


def campaign_frames(domain, accounts):
    daily = {
        "sub_product": "UNSECURED", "card_type": "WORLD", "product_type": "P", "account_status": "OPEN", "day_on_book": 120, "month_on_book": 4,
        "province": "ON", "latest_score": 730, "latest_score_band": "d. Prime (720 to 759)", "original_score": 725,
        "original_score_band": "d. Prime (720 to 759)", "credit_limit": Decimal(1000), "days_past_due": 0,
    }
    buy = {"category": "PURCHASE", "status": "CONFIRMED", "account_status": "OPEN", "card_type": "WORLD", "authorized_at": TS(2025, 6, 1), "amount": Decimal(9)}
    pay = {**buy, "category": "PAYMENT", "trusted_payment": "true", "amount": Decimal(100)}
    strong = {
        "segment": "THICK", "cvsc100": 700, "am41": 0, "am42": 0, "am43": 0, "am84": 0, "go11": 99, "re34": 10.0, "dti": 10.0, "pr51": 0, "bko": 720.0,
        "thick": 530.0, "go91": "N",
    }
    frames = {k: [] for k in ("users", "applications", "accounts", "account_daily", "junior_scores", "transactions", "bureau", "statements", "limit_offers", "behaviour_scores", "redecision_inputs")}
    for name, change in accounts.items():
        user = f"u-{name}"
        get = lambda table: change.get(table, {})
        frames["users"].append({"user_id": user, "type": "CUSTOMER", **get("users")})
        frames["applications"].append({"application_id": f"app-{name}", "user_id": user, "brand": "CORE", "type": "STANDARD", "status": "COMPLETED", "decision": "APPROVED", "created_at": TS(2025, 5, 1), "credit_card_report": {"AM41": "1"}, **get("applications")})
        frames["accounts"].append({"account_id": name, "application_id": f"app-{name}"})
        for day in (AS_OF, AS_OF - dt.timedelta(days=1)):
            frames["account_daily"].append({"account_id": name, "user_id": user, "reference_date": day, **daily, **get("account_daily")})
        frames["transactions"] += [{"account_id": name, **buy, **get("purchase")}, {"account_id": name, **pay, **get("payment")}]
        frames["bureau"].append({"user_id": user, "credit_report_date": "20250801", "am41": 1, "go26": "H", "go91": "N", **get("bureau")})
        frames["redecision_inputs"].append({"user_id": user, **strong, **get("redecision")})
        frames["junior_scores"].append({"account_id": name, "reference_date": TS(2025, 8, 20), "prediction": 0.05, "model_version": "2.1", **get("junior")})
        if "offer" in change:
            frames["limit_offers"].append({"account_id": name, "offer_id": "o"})
    names = {"junior_scores": "scores"}
    return {k: domain(names.get(k, k), *rows) for k, rows in frames.items()}


def test_campaign_traces(domain):
    accounts = {
        "ok": {},
        "test-user": {"users": {"type": "TEST"}},
        "untyped": {"users": {"type": None}},
        "early": {"account_daily": {"day_on_book": 90}},
        "offered": {"offer": True},
        "junior": {"junior": {"prediction": 0.1}},
        "old-junior": {"junior": {"prediction": 0.1, "reference_date": TS(2025, 8, 6)}},
        "fraud": {"purchase": {"decline_reason": "CARD_FROZEN"}},
        "no-funds": {"purchase": {"decline_reason": "NO_FUNDS"}},
        "untrusted": {"payment": {"trusted_payment": "false", "amount": Decimal(2500)}},
        "untrusted-small": {"payment": {"trusted_payment": "false", "amount": Decimal("2499.99")}},
        "late": {"account_daily": {"days_past_due": 1}},
        "trades": {"bureau": {"am41": 2}},
        "record": {"bureau": {"pr74": 1}},
        "no-hit": {"bureau": {"pr74": 1, "go26": "N"}},
        "rejected": {"redecision": {"thick": 400.0}},
        "frozen": {"account_daily": {"frozen_reason": "X"}},
        "unconfirmed": {"purchase": {"status": "PENDING"}},
    }
    rows = early_campaign.candidates(campaign_frames(domain, accounts), AS_OF, "CORE", "WORLD", "P", D(2025, 2, 1))
    got = {r["account_id"]: r["final_waterfall"] for r in rows.collect()}
    assert "test-user" not in got and "untyped" not in got
    want = {
        "junior": "1. Fraud Junior Exclusion", "fraud": "2. Fraud Checks Failed", "untrusted": "3. Fraud Non Trusted Payment",
        "late": "8. Credit Delinquency", "trades": "10. Credit AM41 Increase", "record": "5. Credit Policy Exclusion", "rejected": "0. Current Strategy",
        "frozen": "14. User Frozen", "unconfirmed": "7. Credit Confirmed Purchase",
    }
    for name in got:
        assert got[name] == want.get(name, "15. Criteria Pass"), name
    audience = early_campaign.audience(rows, "Core_P")
    assert [r[0] for r in listed(audience, "account_id")] == ["no-funds", "no-hit", "ok", "old-junior", "untrusted-small"]
    assert set(listed(audience, "line_amount", "brand_product")) == {(1500, "Core_P")}


# ---- reactive eligibility -----------------------------------------------------------------------------

RUN = D(2025, 6, 15)


def portfolio(domain, accounts):
    money = {"paymentsCents": 20_000, "paymentsAndCreditsCents": 0, "purchasesCents": 5_000, "previousBalanceCents": 40_000, "creditLimitCents": 200_000, "newBalanceCents": 30_000, "generalInterestCents": 0}
    frames = {k: [] for k in ("statements", "statement_adb", "accounts", "bureau", "users", "account_daily", "limit_offers", "limit_decreases", "cards", "facility_accounts", "facilities", "balances", "control_group", "limit_adjustments", "id_documents")}
    frames["facilities"].append({"facility_id": "f1", "name": "Facility"})
    for name, change in accounts.items():
        get = lambda table: change.get(table, {})
        user = change.get("user", f"u-{name}")
        for i, closing in enumerate(["2025-03-20", "2025-04-20", "2025-05-20"]):
            account = {**money, **get("summary"), **(get("last_summary") if i == 2 else {})}
            frames["statements"].append({"statement_id": f"{name}-{i}", "account_id": name, "user_id": user, "opening_date": closing, "closing_date": closing, "summary": {"account": account, "cardholder": None}, **get("statements")})
        frames["accounts"].append({"account_id": name, "user_id": user, "status": "OPEN", "tier": "STD", "created_at": TS(2024, 1, 1), **get("accounts")})
        frames["bureau"].append({"user_id": user, "credit_report_date": "20250110", "created_at": TS(2025, 1, 10), "score": 750, "segment": 9, "go06": 0, "go26": "H", "go91": "N", **get("bureau")})
        frames["users"].append({"user_id": user, "type": "CUSTOMER", "status": "ACTIVE", "tenant_id": "t-0", "created_at": TS(2024, 1, 1), "emails": [("a@example.org",)], "physicalAddress": ("ON",), **get("users")})
        frames["account_daily"].append({"account_id": name, "reference_date": RUN, "sub_product": "UNSECURED", "account_status": "OPEN", "charged_off_reason": "N/A", "credit_limit": Decimal(2000), **get("account_daily")})
        frames["account_daily"] += [{"account_id": name, "sub_product": "UNSECURED", **r} for r in change.get("past", [])]
        frames["cards"].append({"account_id": name, "brand": "CORE", "created_at": TS(2024, 1, 1), **get("cards")})
        for table in ("limit_offers", "limit_decreases", "control_group", "limit_adjustments"):
            frames[table] += [{"account_id": name, **r} for r in change.get(table, [])]
        frames["id_documents"] += [{"user_id": user, "completed_at": TS(2024, 1, 1), **r} for r in change.get("id_documents", [])]
    frames["facility_accounts"].append({"account_id": "plain", "facility_id": "f1"})
    frames["balances"] += [{"account_id": "plain", "total_balance_cents": c, "created_at": t} for c, t in ((1, TS(2025, 1, 1)), (250_000, TS(2025, 5, 1)))]
    return {k: domain(k, *rows) for k, rows in frames.items()}


def decrease(strategy, day, previous=150_000):
    return {"strategy": strategy, "initiated_at": TS(*day), "applied_at": TS(*day), "previous_limit_cents": previous}


CASES = {
    "plain": {},
    "revolver": {"summary": {"generalInterestCents": 10}},
    "sub-prime": {"bureau": {"score": 650}},
    "frozen": {"users": {"status": "FROZEN"}},
    "late-now": {"past": [{"reference_date": D(2025, 6, 1), "days_past_due": 5}]},
    "late-before": {"past": [{"reference_date": D(2025, 5, 19), "days_past_due": 45}]},
    "weak-file": {"bureau": {"segment": 3}},
    "recent-offer": {"limit_offers": [{"offer_id": "o", "initiated_at": TS(2025, 3, 15)}]},
    "older-offer": {"limit_offers": [{"offer_id": "o", "initiated_at": TS(2025, 3, 14)}]},
    "blocked": {"limit_decreases": [decrease("CLD_HIGH_RISK", (2025, 1, 1))]},
    "unblocked": {"limit_decreases": [decrease("CLD_HIGH_RISK", (2024, 12, 1))]},
    "inactive-cut": {"limit_decreases": [decrease("INACTIVE_CLD", (2024, 1, 1), 430_050)]},
    "inactive-kept": {"limit_decreases": [decrease("INACTIVE_CLD", (2024, 1, 1), 430_050)], "limit_offers": [{"offer_id": "o", "initiated_at": TS(2024, 2, 1), "accepted_at": TS(2024, 2, 2)}]},
    "low-use": {"limit_decreases": [decrease("LOW-UTIL", (2025, 6, 1), 125_000)]},
    "low-use-old": {"limit_decreases": [decrease("LOW-UTIL", (2025, 5, 1), 125_000)]},
    "restricted": {"limit_adjustments": [{"type": "CREDIT_LIMIT", "reason": "CREDIT_LIMIT_RESTRICTION", "as_of_ts": TS(2025, 1, 1)}]},
    "partner": {"cards": {"brand": "PART"}},
    "foreign": {"id_documents": [{"id_issuer": "US"}]},
    "home": {"id_documents": [{"issuing_country": "CA", "id_issuer": "US"}]},
    "two-a": {"user": "u-two"},
    "tenant-1": {"users": {"tenant_id": "t-1"}},
    "stale": {"statements": {"closing_date": "2025-04-20"}},
    "zero-dpd": {"account_daily": {"days_past_due": 0}},
    "test": {"users": {"type": "TEST"}},
    "quebec": {"users": {"physicalAddress": ("QC",)}},
}


@pytest.fixture(scope="module")
def run_result(spark):
    def make(name, *rows):
        schema = T._parse_datatype_string(DOMAIN[name])
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)

    frames = portfolio(make, CASES)
    extra = make("accounts", {"account_id": "two-b", "user_id": "u-two", "status": "OPEN"})
    frames["accounts"] = frames["accounts"].unionByName(extra)
    result = reactive_eligibility.eligibility(frames, RUN, BRANDS)
    return frames, {r["account_id"]: r for r in result.collect()}, result


def test_reactive_segments(run_result):
    _, rows, _ = run_result
    transactors = ["plain", "older-offer", "unblocked", "inactive-cut", "inactive-kept", "low-use-old", "home", "test", "quebec", "tenant-1"]
    assert {n: rows[n]["segment"] for n in transactors} == {n: reactive.TRANSACTOR for n in transactors}
    assert rows["revolver"]["segment"] == reactive.REVOLVER and rows["sub-prime"]["segment"] == reactive.SUB_PRIME
    refused = ["frozen", "late-now", "late-before", "weak-file", "recent-offer", "blocked", "restricted", "zero-dpd"]
    assert {n: (rows[n]["segment"], rows[n]["eligible"], rows[n]["new_limit_cents"]) for n in refused} == {n: (None, 0, 0) for n in refused}
    assert "stale" not in rows


def test_reactive_overrides_and_codes(run_result):
    _, rows, _ = run_result
    taken = {"partner": "PART", "foreign": "International", "two-a": "MultiCredit"}
    for name, label in taken.items():
        assert (rows[name]["segment"], rows[name]["eligible"], rows[name]["new_limit_cents"], rows[name]["offer_code"]) == (label, 0, 0, None)
    assert rows["plain"]["offer_code"] == "CORE-ROC-TRNS-RCTV" and rows["quebec"]["offer_code"] == "CORE-QC-TRNS-RCTV"
    assert (rows["tenant-1"]["eligible"], rows["tenant-1"]["new_limit_cents"]) == (0, 0)
    low = rows["low-use"]
    assert (low["segment"], low["strategy_type"], low["eligible"], low["new_limit_cents"], low["offer_code"]) == ("Active CLD", "Active CLD", 1, 130_000, "CORE-ROC-ACLD-RCTV")


def test_reactive_limits_follow_the_split(run_result):
    _, rows, _ = run_result
    # 2,000 dollars below 800 points: times 1.5, or times 2 on the aggressive half.
    want = {"Conservative": 300_000, "Aggressive": 400_000}
    for name in ("plain", "revolver", "quebec"):
        assert rows[name]["new_limit_cents"] == want[rows[name]["strategy_type"]]
    assert rows["inactive-cut"]["new_limit_cents"] == 430_000
    split = [r["strategy_type"] for r in rows.values() if r["segment"] != "Active CLD"]
    assert abs(split.count("Aggressive") - split.count("Conservative")) <= 1


def test_reactive_snapshot_columns(run_result):
    _, rows, _ = run_result
    plain = rows["plain"]
    assert (plain["facility"], plain["latest_balance"], plain["over_limit"], plain["over_limit_20"]) == ("Facility", Decimal("2500.00"), 1, 1)
    assert plain["mob_rounded"] == 17.0 and plain["score"] == 750
    assert (rows["late-before"]["currently_delinquent"], rows["late-before"]["delinquent_3m"], rows["late-before"]["delinquent_100_days"]) == (0, 1, 1)


def test_reactive_one_row_per_account_and_log(run_result, spark, tmp_path):
    frames, rows, result = run_result
    assert result.count() == len(rows) == frames["accounts"].join(frames["statements"].filter("closing_date = '2025-05-20'"), "account_id").count()
    append_audience(result, TS(2025, 6, 15, 6), path=str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == len(rows)


def test_reactive_can_drop_test_users(run_result):
    frames, _, _ = run_result
    kept = reactive_eligibility.eligibility_inputs(frames, RUN, drop_test_users=True)
    assert "test" not in {r["account_id"] for r in kept.select("account_id").collect()}


def test_statement_ordinals_survive_repeated_months(domain):
    base = {"paymentsCents": 0, "purchasesCents": 1, "newBalanceCents": 1, "creditLimitCents": 100}
    rows = [("s1", "2025-01-10", 1), ("s2", "2025-01-20", 2), ("s3", "2025-02-10", 3), ("s4", "2025-03-10", 4)]
    statements = domain("statements", *[{"statement_id": s, "account_id": "a", "closing_date": d, "opening_date": d, "summary": {"account": {**base, "paymentsCents": p * 100}, "cardholder": None}} for s, d, p in rows])
    features = reactive_eligibility.statement_features(reactive_eligibility.statement_base(statements))
    # January keeps its later statement, number 2; number 1 is gone, so nothing is two back of February.
    assert listed(features, "closing_mth", "active_order", "payment_1m_prior", "payment_2m_prior") == [
        ("2025-01", 2, None, None),
        ("2025-02", 3, Decimal("2.00"), None),
        ("2025-03", 4, Decimal("3.00"), Decimal("2.00")),
    ]
