import datetime as dt

import pytest
from pyspark.sql import functions as F

from limitloom.rulesets import campaign, cuts, offers, reactive
from limitloom.rulesets.brands import Brands

BRANDS = Brands(core="CORE", partner="PART", cut_group={"PART": "partner", "CORE": "core"})


@pytest.fixture
def apply(spark):
    """Evaluate a rule on rows of one column: ``apply(rule, "x", "int", [1, 2])``."""

    def run(rule, name, kind, values):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, {name} {kind}")
        return [r["v"] for r in df.select("i", rule.alias("v")).orderBy("i").collect()]

    return run


@pytest.fixture
def judge(spark):
    """Evaluate a rule on one row given as keywords; unnamed columns come from defaults."""

    def run(rule, defaults, **changes):
        row = {**defaults, **changes}
        df = spark.range(1)
        for name, value in row.items():
            df = df.withColumn(name, value if not isinstance(value, (int, float, str, type(None))) else F.lit(value))
        return df.select(rule.alias("v")).first()["v"]

    return run


def test_limit_bands(apply):
    limits = [None, 0, 100, 101, 500, 1500, 2500, 5000, 7500, 10000, 10001]
    got = apply(reactive.limit_band(), "credit_limit", "int", limits)
    assert [g[0] for g in got] == ["M", "0", "1", "2", "2", "3", "4", "5", "6", "7", "8"]
    assert apply(offers.limit_bucket(), "icl", "int", [1500, 1501, None]) == ["1, <=1.5k ICL", "2,>1.5k ICL", "2,>1.5k ICL"]
    fine = apply(offers.limit_bucket_fine(), "icl", "int", [100, 101, 1501, 3001, 7001, None])
    assert [f[0] for f in fine] == ["1", "2", "3", "4", "5", "5"]


def test_tenure_bands(apply):
    got = apply(reactive.tenure_band(), "mob_rounded", "double", [None, 0.0, 1.0, 3.0, 4.0, 6.0, 7.0, 12.0, 13.0, 24.0, 25.0])
    assert [g[0] for g in got] == list("ABCCDDEEFFG")
    assert [x[0] for x in apply(offers.tenure_bucket(), "mob", "int", [12, 13, 25, None])] == ["1", "2", "3", "3"]
    assert [x[0] for x in apply(offers.tenure_bucket_fine(), "mob", "int", [3, 4, 7, 13, 25, 37])] == list("123456")


def test_score_band_keeps_its_gap(apply):
    got = apply(reactive.score_band(), "bureau_score_clean", "double", [None, 599.0, 600.0, 638.9, 639.5, 640.0, 800.0])
    assert [g and g[0] for g in got] == ["A", "B", "C", "D", None, "E", "I"]


def test_pay_ratio_band(apply):
    got = apply(reactive.pay_ratio_band(), "pay_bal_3m", "double", [None, 0.0, -1.0, 0.05, 0.10, 0.25, 0.5, 0.75, 0.9])
    assert [g[0] for g in got] == ["1", "2", "3", "3", "4", "5", "6", "7", "8"]


def test_segments_categories_and_flags(apply):
    got = apply(reactive.bureau_segment_category(), "segment_indicator", "int", [1, 7, 10, 11, None])
    assert got == ["A. No Trades", "F. Missing Payment", "F. Thin File", None, None]
    assert apply(reactive.revolver_flag(), "general_interest", "double", [0.01, 0.0, -1.0, None]) == ["Revolver"] + ["Transactor"] * 3
    assert apply(reactive.utilisation_flag(), "utilisation", "double", [0.9, 0.89, None]) == ["High Util", "Low Util", None]
    assert apply(reactive.province_group(), "province", "string", ["QC", "ON", None]) == ["Quebec", "Other", "Other"]


STANDING = {"day_end_status": "OPEN", "day_end_frozen_reason": None, "day_end_dpd": None, "day_end_charge_off": "N/A"}


@pytest.mark.parametrize("change, good", [({}, True), ({"day_end_dpd": 0}, False), ({"day_end_charge_off": None}, False), ({"day_end_frozen_reason": "X"}, False)])
def test_standing_wants_missing_dpd(judge, change, good):
    assert (judge(reactive.standing(), STANDING, **change) == reactive.GOOD_STANDING) is good


RECORDS = {"go26": "H", "go91": "N", "bureau_score_clean": 700, **{a: 0 for _, attrs in reactive.EXCLUSION_RECORDS for a in attrs}}


@pytest.mark.parametrize(
    "change, label",
    [
        ({}, None),
        ({"go26": "N", "go91": "Y"}, "1. No-Hit"),
        ({"go26": None}, None),  # unknown is not "different from H"
        ({"bureau_score_clean": 0}, "1. No-Hit"),
        ({"go91": "Y", "pr44": 1}, "2. Deceased"),
        ({"pr124": 1, "go81": 1}, "3. Undischarged/Discharged Bankruptcies"),
        ({"pr120": 2}, "07. Unpaid Collections"),
        ({"go81": 1}, "8. Chargeoffs"),
    ],
)
def test_policy_exclusion_order(judge, change, label):
    assert judge(reactive.policy_exclusion(), RECORDS, **change) == label


def test_no_hit_is_not_in_the_exclusion_flag(apply):
    assert apply(reactive.policy_exclusion_flag(), "policy_exclusion", "string", ["1. No-Hit", "2. Deceased", None]) == [0, 1, 0]


PAY = {"pay_bal_3m": 0.0, "paid_3m": 0, "owed_3m": 0}


@pytest.mark.parametrize("change, flag", [({}, 0), ({"pay_bal_3m": 0.05}, 1), ({"pay_bal_3m": -0.1}, 1), ({"owed_3m": -5}, 1), ({"paid_3m": 1, "owed_3m": -5}, 0)])
def test_payment_flag(judge, change, flag):
    assert judge(reactive.payment_flag(), PAY, **change) == flag


RESTRICTION = dict(n_restricted=0, n_reversed=0, n_risk_restricted=0, n_risk_reversed=0, last_reversed_at=None, last_risk_reversed_at=None)


def test_restriction_flag(judge):
    as_of = F.lit(dt.datetime(2024, 7, 31, 8)).cast("timestamp")
    day = lambda d: F.lit(d).cast("timestamp")
    rule = reactive.restriction_flag(as_of)
    assert judge(rule, {k: None for k in RESTRICTION}) == 0
    assert judge(rule, RESTRICTION, n_risk_restricted=1) == 1
    base = {**RESTRICTION, "last_reversed_at": day(dt.datetime(2024, 2, 2, 8)), "last_risk_reversed_at": F.lit(None).cast("timestamp")}
    assert judge(rule, base) == 2  # exactly 180 days
    assert judge(rule, base, last_reversed_at=day(dt.datetime(2024, 2, 1, 7))) == 0


GATES = {name: value for name, value in reactive.SHARED_GATES}
ACCOUNT = {**GATES, "user_type": "Revolver", "statement_age_months": 0.5, "bureau_score_clean": 750, "score_flag": 1, "sub_prime_flag": 0, "mob_rounded": 12, "credit_limit": 2000}


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, reactive.REVOLVER),
        ({"user_type": "Transactor"}, reactive.TRANSACTOR),
        ({"bureau_score_clean": 650}, reactive.SUB_PRIME),
        ({"bureau_score_clean": 650, "mob_rounded": 5}, None),
        ({"bureau_score_clean": 650, "credit_limit": 3001}, None),
        ({"bureau_score_clean": 699}, reactive.SUB_PRIME),
        ({"bureau_score_clean": 700, "mob_rounded": 3, "credit_limit": 9000}, reactive.REVOLVER),
        ({"bureau_score_clean": 900}, reactive.REVOLVER),
        ({"bureau_score_clean": 901}, None),
        ({"credit_limit": 100}, None),
        ({"statement_age_months": 2.0}, None),
        ({"restriction": 2}, None),
        ({"go26": None}, None),
    ],
)
def test_segment(judge, change, want):
    assert judge(reactive.segment(), ACCOUNT, **change) == want


REQUEST = {**ACCOUNT, "day_end_limit": 2000, "brand": "CORE", "segment": None, "province_group": "Other"}


@pytest.mark.parametrize(
    "change, code, bucket",
    [
        ({}, "other", "other"),
        ({"not_frozen": 0, "policy_exclusion_flag": 1}, "01", "01, Policy exclusion"),
        ({"not_frozen": None}, "other", "other"),  # unknown falls through
        ({"score_flag": 0}, "07", "05, Bureau score flag"),
        ({"bureau_score_clean": 699}, "08", "other"),
        ({"sub_prime_flag": 1, "bureau_score_clean": 599}, "08", "other"),
        ({"mob_rounded": 2}, "09", "other"),
        ({"sub_prime_flag": 1, "mob_rounded": 5}, "09", "other"),
        ({"day_end_limit": None}, "12", "08, ICL restriction"),
        ({"day_end_limit": 100}, "12", "08, ICL restriction"),
        ({"day_end_limit": 9000}, "other", "other"),
        ({"day_end_limit": 9001}, "12", "08, ICL restriction"),
        ({"sub_prime_flag": 1, "day_end_limit": 3001}, "12", "08, ICL restriction"),
        ({"go26": "N"}, "17", "other"),
        ({"brand": "ELSE"}, "19, brand", "other"),
        ({"segment": "MultiCredit"}, "20, Inter, w/we, multi", "09, Inter, w/we, multi"),
        ({"brand": "PART", "segment": "PART"}, "21, recent PART", "other"),
        ({"province_group": "Quebec"}, "22,QC", "other"),
    ],
)
def test_reject_reasons(judge, change, code, bucket):
    assert judge(reactive.reject_reason(BRANDS), REQUEST, **change) == code
    assert judge(reactive.reject_bucket(), REQUEST, **change) == bucket


LADDER = {"segment": reactive.TRANSACTOR, "cld_population": 0, "credit_limit": 400.0, "bureau_score_clean": 700, "old_limit": 800}


@pytest.mark.parametrize(
    "change, conservative, aggressive",
    [
        ({}, 900.0, 900.0),
        ({"credit_limit": 500.0}, 1000.0, 1000.0),
        ({"credit_limit": 1000.0}, 2000.0, 2500.0),
        ({"credit_limit": 1500.0, "bureau_score_clean": 800}, 4500.0, 5250.0),
        ({"credit_limit": 5000.0}, 7500.0, 10000.0),
        ({"credit_limit": 5000.0, "bureau_score_clean": 800}, 10000.0, 12500.0),
        ({"credit_limit": 7500.0}, 9375.0, 9375.0),
        ({"credit_limit": 7500.0, "bureau_score_clean": 800}, 11250.0, 11250.0),
        ({"credit_limit": 7501.0}, 8501.0, 8501.0),
        ({"cld_population": 1}, 800.0, 800.0),
        ({"segment": reactive.REVOLVER, "credit_limit": 2000.0}, 3000.0, 4000.0),
        ({"segment": reactive.SUB_PRIME, "credit_limit": 500.0}, 1000.0, 1000.0),
        ({"segment": reactive.SUB_PRIME, "credit_limit": 1000.0}, 2000.0, 2500.0),
        ({"segment": reactive.SUB_PRIME, "credit_limit": 2000.0}, 3500.0, 4000.0),
        ({"segment": reactive.SUB_PRIME, "credit_limit": 3000.0}, 5000.0, 5500.0),
        ({"segment": reactive.SUB_PRIME, "credit_limit": 3001.0}, None, 0.0),
        ({"segment": None}, None, 0.0),
    ],
)
def test_ladders(judge, change, conservative, aggressive):
    assert judge(reactive.conservative_limit(), LADDER, **change) == conservative
    assert judge(reactive.aggressive_limit(), LADDER, **change) == aggressive


def test_limit_in_cents(judge):
    pick = {"tile": 1, "agg_limit": 1234.5, "cons_limit": 1000.0}
    assert judge(reactive.new_limit_cents(), pick) == 130000
    assert judge(reactive.new_limit_cents(), pick, tile=2) == 100000
    cap = {"new_limit_cents": 1_000_100, "eligible": 1}
    assert judge(reactive.capped_limit_cents(), cap) == 1_000_000
    assert judge(reactive.capped_limit_cents(), cap, eligible=0) == 0
    assert judge(reactive.capped_limit_cents(), {"new_limit_cents": F.lit(None).cast("bigint"), "eligible": 1}) == 0
    assert judge(reactive.restored_limit_cents(), {"previous_limit_cents": 125_000}) == 130_000
    assert judge(reactive.restored_limit_cents(), {"previous_limit_cents": 4_999}) == 50_000
    assert judge(reactive.restored_limit_cents(), {"previous_limit_cents": F.lit(None).cast("bigint")}) is None


def test_offer_code_and_overrides(judge):
    row = {"brand": "CORE", "province_group": "Other", "segment": reactive.REVOLVER}
    code = reactive.offer_code(BRANDS, reactive.segment_code())
    assert judge(code, row) == "CORE-ROC-RVLV-RCTV"
    assert judge(code, row, brand="PART", province_group="Quebec", segment=reactive.SUB_PRIME) == "PART-QC-LWGR-RCTV"
    assert judge(code, row, brand="ELSE") is None and judge(code, row, segment=None) is None
    taken = {"brand": "CORE", "n_unsecured": 1, "n_world": 0, "issued_by": "CA-ON"}
    rule = reactive.override(BRANDS)
    assert judge(rule, taken) is None
    assert judge(rule, taken, issued_by=None) is None
    assert judge(rule, taken, issued_by="US") == "International"
    assert judge(rule, taken, n_world=1, issued_by="US") == "World / World Elite"
    assert judge(rule, taken, n_unsecured=2, n_world=1) == "MultiCredit"
    assert judge(rule, taken, brand="PART", n_unsecured=2) == "PART"
    assert judge(reactive.eligible(), {"segment": "s", "tenant_id": "t-11"}) == 0
    assert judge(reactive.eligible(), {"segment": "s", "tenant_id": None}) == 1


def test_cuts(apply, judge):
    assert apply(cuts.bankruptcy_cut(), "bko_score", "double", [680.0, 680.5, None]) == ["Fail", "Pass", "Fail"]
    row = {"brand": "PART", "beh_score": 595.0}
    rule = cuts.behaviour_cut(BRANDS)
    assert judge(rule, row) == "Pass"
    assert judge(rule, row, brand="CORE") == "Fail" and judge(rule, row, brand="ELSE", beh_score=900.0) == "Fail"
    assert apply(cuts.high_risk(), "senior_score", "double", [0.7, 0.69, None]) == ["high risk", "low risk", "low risk"]
    card = {"card_type": "STANDARD", "tu_band": "1. SUBPRIME", "senior_score": 0.7}
    flag = cuts.backtest_flag()
    assert judge(flag, card) is True
    assert judge(flag, card, tu_band="3. PRIME") is False
    assert judge(flag, card, card_type="WORLD") is False and judge(flag, card, card_type="WORLD", senior_score=0.9) is True
    assert judge(flag, card, card_type="WORLD_ELITE", senior_score=1.0) is True
    assert judge(flag, card, senior_score=F.lit(None).cast("double")) is False


def test_offer_status(judge):
    day = dt.date(2024, 7, 31)
    row = {
        "approve_status": "Approved", "strategy": "STD", "declined_at": F.lit(None).cast("timestamp"),
        "accepted_at": F.lit(None).cast("timestamp"), "offer_created_at": F.lit(dt.datetime(2024, 7, 1)),
    }
    rule = offers.offer_status(day)
    stamp = F.lit(dt.datetime(2024, 7, 2))
    assert judge(rule, row) == "In progress"
    assert judge(rule, row, offer_created_at=F.lit(dt.datetime(2024, 6, 30))) == "Expired"
    assert judge(rule, row, accepted_at=stamp) == "Accepted"
    assert judge(rule, row, accepted_at=stamp, declined_at=stamp) == "Declined"
    assert judge(rule, row, strategy="A-QC-1", accepted_at=stamp) == "not in V2 strategy"
    assert judge(rule, row, strategy=None, accepted_at=stamp) == "Accepted"
    assert judge(rule, row, approve_status="Not Approved", accepted_at=stamp) == "Not Approved"


CANDIDATE = {
    "junior_10": 0, "fraud_checks_passed": 1, "has_untrusted_payment": None, "policy_fail": None, "cash_advance": 0, "confirmed_purchase": 1,
    "ever_late": 0, "original_above_sub_prime": 1, "latest_above_sub_prime": 1, "trades_increased": 0, "score_movement": "1. TU Score Same",
    "target_segment": 1, "current_strategy_approves": 1, "behaviour_score": None, "payment_amount": 10, "user_frozen": 0,
}


@pytest.mark.parametrize(
    "change, first, final",
    [
        ({}, "16. Criteria Pass", "15. Criteria Pass"),
        ({"current_strategy_approves": 0, "junior_10": 1}, "1. Fraud Junior Exclusion", "0. Current Strategy"),
        ({"has_untrusted_payment": 1, "policy_fail": 1}, "3. Fraud Non Trusted Payment", "3. Fraud Non Trusted Payment"),
        ({"policy_fail": 1}, "4. Credit Policy Exclusion", "5. Credit Policy Exclusion"),
        ({"ever_late": 1}, "7. Credit Delinquency", "8. Credit Delinquency"),
        ({"latest_above_sub_prime": 0}, "7. Credit Score Sub Prime", "9. Credit Score Sub Prime"),
        ({"target_segment": 0}, "15. Not Target Segment CL Accounts", "15. Criteria Pass"),
        ({"behaviour_score": 599}, "16. Criteria Pass", "12. High Risk Behavior Score"),
        ({"behaviour_score": 600}, "16. Criteria Pass", "15. Criteria Pass"),
        ({"behaviour_score": -1}, "16. Criteria Pass", "15. Criteria Pass"),
        ({"payment_amount": None}, "16. Criteria Pass", "13. No Payment Amount"),
        ({"user_frozen": 1}, "16. Criteria Pass", "14. User Frozen"),
    ],
)
def test_campaign_waterfalls(judge, change, first, final):
    assert judge(campaign.first_waterfall(), CANDIDATE, **change) == first
    assert judge(campaign.final_waterfall(), CANDIDATE, **change) == final


def test_campaign_flags(apply, judge):
    assert [x[0] for x in apply(campaign.score_movement(F.col("d")), "d", "int", [0, 1, -20, -21, -50, -51, None])] == list("1234456")
    target = {"original_score_band": campaign.NEAR_PRIME_BAND, "credit_limit": 2000}
    assert judge(campaign.target_segment(), target) == 1
    assert judge(campaign.target_segment(), target, original_score_band=campaign.SUPER_PRIME_BAND, credit_limit=1000) == 2
    assert judge(campaign.target_segment(), target, credit_limit=1000) == 0
    amount = campaign.line_amount()
    lines = [(campaign.NEAR_PRIME_BAND, 700, 1000), (campaign.NEAR_PRIME_BAND, 701, 1200), (campaign.PRIME_BAND, 999, 1200), (campaign.PRIME_BAND, 1000, 1500)]
    lines += [(campaign.PRIME_BAND, 1800, 2000), (campaign.PRIME_PLUS_BAND, None, 2000), (campaign.SUPER_PRIME_BAND, 1, 2500), (campaign.SUB_PRIME_BAND, 1, 0)]
    lines += [(campaign.PRIME_BAND, None, 0)]
    for band, limit, want in lines:
        assert judge(amount, {"original_score_band": band, "credit_limit": F.lit(limit).cast("int")}) == want
    more = {"am41_at_onboarding": "9", "latest_am41": 10}
    assert judge(campaign.trades_increased(), more) == 1  # as text, "9" would exceed "10"
    assert judge(campaign.trades_increased(), more, am41_at_onboarding="n/a") == 0
    assert apply(campaign.campaign_window(), "day_on_book", "int", [90, 91, 178, 179]) == [False, True, True, False]


STRONG = {
    "segment": "THICK", "cvsc100": 700, "am41": 0, "am42": 0, "am43": 0, "am84": 0, "go11": 99, "re34": 10.0, "dti": 10.0, "pr51": 0, "at01": 3,
    "bc147": 10, "go06": 0, "go149": 0, "go14": 5, "go141": 0, "pr11": 0, "am02": 1, "bko": 720.0, "thick": 500.0, "thin": 700.0, "subprime": 600.0,
    "go91": "N", **{a: 0 for a in campaign.POLICY_ATTRIBUTES},
}


@pytest.mark.parametrize(
    "change, record, strategy, bankruptcy, tree",
    [
        ({}, 0, 0, 0, 0),
        ({"go91": "Y"}, 1, 0, 0, 0),
        ({"pr74": 1}, 1, 0, 0, 0),
        ({"am41": 2}, 0, 1, 0, 0),
        ({"segment": "THIN"}, 0, 0, 0, 0),
        ({"segment": "THIN", "am41": 1}, 0, 1, 0, 0),
        ({"segment": "THIN", "bko": 714.0}, 0, 0, 1, 0),
        ({"bko": 669.0}, 0, 0, 1, 0),
        ({"thick": 488.0}, 0, 0, 0, 0),  # 475 route: score from 690
        ({"thick": 488.0, "cvsc100": 689}, 0, 0, 0, 1),
        ({"thick": 489.0, "cvsc100": 669}, 0, 0, 0, 0),
        ({"thick": 600.0, "cvsc100": 639}, 0, 0, 0, 1),
        ({"segment": "SUBPRIME", "cvsc100": 640}, 0, 0, 0, 0),
        ({"segment": "SUBPRIME", "cvsc100": 641}, 0, 0, 0, 1),
        ({"segment": "OTHER"}, 0, 0, 0, 1),
    ],
)
def test_redecision(judge, change, record, strategy, bankruptcy, tree):
    got = [judge(rule, STRONG, **change) for rule in (campaign.public_record_reject(), campaign.strategy_reject(), campaign.bankruptcy_reject(), campaign.tree_reject())]
    assert got == [record, strategy, bankruptcy, tree]


def test_redecision_on_missing_inputs(judge):
    missing = {"bko": F.lit(None).cast("double"), "thick": F.lit(None).cast("double"), "am41": F.lit(None).cast("int")}
    assert judge(campaign.bankruptcy_reject(), STRONG, **missing) == 0
    assert judge(campaign.strategy_reject(), STRONG, **missing) == 0
    assert judge(campaign.tree_reject(), STRONG, **missing) == 1
