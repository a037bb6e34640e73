"""Rules of the reactive (customer-requested) eligibility table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from limitloom.functions import Rung, all_of, any_of, band, ceil_to, clamp, first_match, flag, ladder, round_to, safe_ratio
from limitloom.rulesets.brands import Brands

c = F.col

# ---- fixed values: bands and categories ----------------------------------------------

TENURE_BAND = ([1, 4, 7, 13, 25], ["B. LT 1", "C. 1 - 3", "D. 4 - 6", "E. 7 - 12", "F. 13 - 24", "G. GT 24"], "A. Missing")

BUREAU_SEGMENTS = {
    1: "A. No Trades",
    2: "B. Recent BK/90+ DPD",
    3: "C. Past BK/90+ DPD",
    4: "D. Recent Delinquency",
    5: "E. New to Credit",
    6: "F. No CC/Inactive",
    7: "F. Missing Payment",
    8: "F. Transactor",
    9: "F. Revolver",
    10: "F. Thin File",
}
WEAK_SEGMENTS = (2, 3, 4)

LIMIT_BAND = (
    [0, 100, 500, 1500, 2500, 5000, 7500, 10000],
    [
        "0. Less Than Equal To Zero",
        "1. 1 - 100",
        "2. 101 - 500",
        "3. 501 - 1500",
        "4. 1501 - 2500",
        "5. 2501 - 5000",
        "6. 5001 - 7500",
        "7. 7501 - 10000",
        "8. GT 10K",
    ],
    "Missing Credit Limit",
)

PAY_RATIO_BAND = (
    [0.10, 0.25, 0.50, 0.75, 0.90],
    ["3. LT 10%", "4. 10 - 25%", "5. 25 - 50%", "6. 50 - 75%", "7. 75 - 90", "8. GT 90"],
    "1. Missing",
)

# The band ends at 639, the next starts at 640: scores between them have no band.
SCORE_BAND = (
    ("B. LT 600", None, 600),
    ("C. 600 - 619", 600, 620),
    ("D. 620 - 639", 620, 639),
    ("E. 640 - 659", 640, 660),
    ("F. 660 - 689", 660, 690),
    ("G. 690 - 739", 690, 740),
    ("H. 740 - 799", 740, 800),
    ("I. 800+", 800, None),
)

# Label and the public-record attributes that earn it with a count of 1 or more.
EXCLUSION_RECORDS = (
    ("3. Undischarged/Discharged Bankruptcies", ("pr44", "pr45", "pr124")),
    ("4. Consumer Proposals", ("pr116",)),
    ("5. Foreclosures", ("pr15", "pr50")),
    ("6. Unsatisfied Judgements", ("pr74",)),
    ("07. Unpaid Collections", ("pr75", "pr120", "pr97")),
    ("8. Chargeoffs", ("go81",)),
)
NO_HIT, DECEASED = "1. No-Hit", "2. Deceased"

# Kinds of decreases that block an increase for 180 days; a portfolio adds its campaigns' codes (`Brands.blocking_decreases`).
BLOCKING_DECREASES = ("DELINQUENT_CLD", "CLD_HIGH_RISK", "CLD_DELINQUENCY")
INACTIVE_DECREASE, LOW_USE_DECREASE = "INACTIVE_CLD", "LOW-UTIL"
COOL_OFF_DAYS = 180

STUDENT_FIELDS = ("Hospitality, Food and Tourism", "Trades, Construction and Manufacturing")

GOOD_STANDING, BAD_STANDING = "Account_OPEN_Not_Frozen", "Account_Not_In_Good_Standing"

SUB_PRIME, TRANSACTOR, REVOLVER = "Sub_Prime_Segement", "Transactor_Segement", "Revolver_Segment"
SEGMENT_CODES = {SUB_PRIME: "LWGR", TRANSACTOR: "TRNS", REVOLVER: "RVLV"}
PASS_THROUGH_CODE, OFFER_SUFFIX = "ACLD", "RCTV"
REGION_CODES = {"Other": "ROC", "Quebec": "QC"}

MAX_LIMIT_CENTS, MIN_PASS_THROUGH_CENTS = 1_000_000, 50_000


# ---- bands and flags ----------------------------------------------------------------------


def tenure_band(x="mob_rounded") -> Column:
    edges, labels, missing = TENURE_BAND
    return band(x, edges, labels, missing, closed="left")


def bureau_segment_category(x="segment_indicator") -> Column:
    lookup = F.create_map(*[F.lit(v) for v in chain.from_iterable(BUREAU_SEGMENTS.items())])
    return F.try_element_at(lookup, c(x).cast("int"))


def limit_band(x="credit_limit") -> Column:
    edges, labels, missing = LIMIT_BAND
    return band(x, edges, labels, missing)


def pay_ratio_band(x="pay_bal_3m") -> Column:
    edges, labels, missing = PAY_RATIO_BAND
    return F.when(c(x) == 0, "2. Zero").otherwise(band(x, edges, labels, missing, closed="left"))


def score_band(x="bureau_score_clean") -> Column:
    rules = [(c(x).isNull(), "A. Missing")]
    for label, lo, hi in SCORE_BAND:
        tests = ([c(x) >= lo] if lo is not None else []) + ([c(x) < hi] if hi is not None else [])
        rules.append((all_of(tests), label))
    return first_match(rules)


def revolver_flag(interest="general_interest") -> Column:
    """Interest charged makes a revolver; none, or an unknown amount, a transactor."""
    return F.when(c(interest) > 0, "Revolver").otherwise("Transactor")


def utilisation_flag(x="utilisation") -> Column:
    return first_match([(c(x) >= 0.90, "High Util"), (c(x) < 0.90, "Low Util")])


def active_status(previous="previous_balance", new="new_balance", purchase="purchase") -> Column:
    """0 for a statement with nothing on it, else 1."""
    return F.when(all_of([c(previous) == 0, c(new) == 0, c(purchase) == 0]), 0).otherwise(1)


def consistent_type(flags: Sequence[str] = ("revolver_flag", "revolver_flag_1m_prior", "revolver_flag_2m_prior")) -> Column:
    return first_match([(all_of([c(f) == kind for f in flags]), f"Consistent {kind}") for kind in ("Transactor", "Revolver")])


def user_type(x="consistent_type") -> Column:
    return F.when(c(x) == "Consistent Transactor", "Transactor").otherwise("Revolver")


def pay_balance_ratio(payments: Sequence[str], owed: Sequence[str]) -> Column:
    """Three months of payments over three months of balances owed; 1 when undefined."""
    total = lambda cols: sum((c(x) for x in cols[1:]), c(cols[0]))
    return safe_ratio(total(payments), total(owed), default=1)


def payment_flag(ratio="pay_bal_3m", paid="paid_3m", owed="owed_3m") -> Column:
    return flag(any_of([c(ratio) >= 0.05, c(ratio) < 0, (c(paid) == 0) & (c(owed) < 0)]))


def policy_exclusion(score="bureau_score_clean") -> Column:
    rules = [((c("go26") != "H") | c(score).isNull() | (c(score) <= 0), NO_HIT), (c("go91") == "Y", DECEASED)]
    rules += [(any_of([c(a) >= 1 for a in attrs]), label) for label, attrs in EXCLUSION_RECORDS]
    return first_match(rules)


def policy_exclusion_flag(x="policy_exclusion") -> Column:
    """Every exclusion but a bureau no-hit."""
    return flag(c(x).isin(DECEASED, *[label for label, _ in EXCLUSION_RECORDS]))


def standing(status="day_end_status", frozen="day_end_frozen_reason", dpd="day_end_dpd", charge_off="day_end_charge_off") -> Column:
    """Good only when days past due is missing: a recorded 0 counts against the account."""
    good = all_of([c(status) == "OPEN", c(frozen).isNull(), c(dpd).isNull(), c(charge_off) == "N/A"])
    return F.when(good, GOOD_STANDING).otherwise(BAD_STANDING)


def charge_off_flag(closed="closed_on", statement="close_date") -> Column:
    return flag(c(closed).isNotNull() & (c(closed) > c(statement)))


def restriction_flag(as_of_ts: Column) -> Column:
    """1 restricted now, 2 a restriction lifted within 180 days, else 0.

    Reads ``restricted``/``reversed`` counts and last reversal times, plain and high-risk.
    """
    recent = lambda ts: F.timestamp_diff("DAY", c(ts), as_of_ts) <= COOL_OFF_DAYS
    return first_match(
        [
            ((c("n_restricted") > c("n_reversed")) | (c("n_risk_restricted") > c("n_risk_reversed")), 1),
            (recent("last_risk_reversed_at") | recent("last_reversed_at"), 2),
        ],
        0,
    )


def over_limit(balance="latest_balance", limit="credit_limit", share: float = 1.0) -> Column:
    return flag(c(balance) > c(limit) * share)


def province_group(x="province") -> Column:
    return F.when(c(x) == "QC", "Quebec").otherwise("Other")


def student_field_flag(status: Column, field: Column) -> Column:
    return flag((status == "STUDENT") & field.isin(*STUDENT_FIELDS))


# ---- gates: one table behind segments and reject reasons -----------------------------------


@dataclass(frozen=True)
class SegmentPolicy:
    """Score range (from, to, whether the end belongs to it), tenure and limit range."""

    score_from: int
    score_to: int
    score_to_included: bool
    min_tenure: int
    limit_above: int
    limit_up_to: int


SUB_PRIME_POLICY = SegmentPolicy(600, 700, False, 6, 100, 3000)
PRIME_POLICY = SegmentPolicy(700, 900, True, 3, 100, 9000)

# Column, required value: the requirements all segments share.
SHARED_GATES = (
    ("not_frozen", 1),
    ("policy_exclusion_flag", 0),
    ("currently_delinquent", 0),
    ("delinquent_3m", 0),
    ("payment_flag", 1),
    ("inquiry_flag", 0),
    ("recent_cli", 0),
    ("bureau_segment_flag", 0),
    ("am36_flag", 1),
    ("cld_block", 1),
    ("account_type", "UNSECURED"),
    ("restriction", 0),
    ("go26", "H"),
    ("standing", GOOD_STANDING),
)


def _fits(policy: SegmentPolicy, score="bureau_score_clean", tenure="mob_rounded", limit="credit_limit") -> Column:
    top = (c(score) <= policy.score_to) if policy.score_to_included else (c(score) < policy.score_to)
    return all_of(
        [
            c(score) >= policy.score_from,
            top,
            c(tenure) >= policy.min_tenure,
            c(limit) > policy.limit_above,
            c(limit) <= policy.limit_up_to,
        ]
    )


def segment(statement_age="statement_age_months") -> Column:
    """Sub-prime, transactor or revolver segment of an account that passes every gate."""
    shared = all_of([*[c(name) == value for name, value in SHARED_GATES], c(statement_age) < 2])
    prime = shared & (c("score_flag") == 1) & _fits(PRIME_POLICY)
    return first_match(
        [
            (c("user_type").isin("Revolver", "Transactor") & shared & _fits(SUB_PRIME_POLICY), SUB_PRIME),
            ((c("user_type") == "Transactor") & prime, TRANSACTOR),
            ((c("user_type") == "Revolver") & prime, REVOLVER),
        ]
    )


def _fails(name: str) -> Column:
    return c(name) != dict(SHARED_GATES)[name]


def _either(test) -> Column:
    """A policy test taken per family: ``test(policy)`` where the account belongs to it."""
    return any_of([(c("sub_prime_flag") == key) & test(p) for key, p in ((0, PRIME_POLICY), (1, SUB_PRIME_POLICY))])


def _limit_fails(limit: str) -> Column:
    low = PRIME_POLICY.limit_above
    return c(limit).isNull() | (c(limit) <= low) | _either(lambda p: c(limit) > p.limit_up_to)


def _score_flag_fails() -> Column:
    return (c("sub_prime_flag") == 0) & (c("score_flag") != 1)


_OVERRIDDEN = ("International", "World / World Elite", "MultiCredit")


def reject_reason(brands: Brands, limit="day_end_limit") -> Column:
    """First failed requirement of a request that got no offer."""
    return first_match(
        [
            (_fails("not_frozen"), "01"),
            (_fails("policy_exclusion_flag"), "02"),
            (_fails("currently_delinquent"), "03"),
            (_fails("delinquent_3m"), "04"),
            (_fails("payment_flag"), "05"),
            (_fails("inquiry_flag"), "06"),
            (_score_flag_fails(), "07"),
            (_either(lambda p: c("bureau_score_clean") < p.score_from), "08"),
            (_either(lambda p: c("mob_rounded") < p.min_tenure), "09"),
            (_fails("recent_cli"), "10"),
            (_fails("bureau_segment_flag"), "11"),
            (_limit_fails(limit), "12"),
            (_fails("am36_flag"), "13"),
            (_fails("cld_block"), "14"),
            (_fails("account_type"), "15"),
            (_fails("restriction"), "16"),
            (_fails("go26"), "17"),
            (_fails("standing"), "18"),
            (~c("brand").isin(*brands.offered), "19, brand"),
            (c("segment").isin(*_OVERRIDDEN), "20, Inter, w/we, multi"),
            (c("segment") == brands.partner, f"21, recent {brands.partner}"),
            (c("province_group") == "Quebec", "22,QC"),
        ],
        "other",
    )


def reject_bucket(limit="day_end_limit") -> Column:
    """The coarser reading of the same failures, for reporting."""
    return first_match(
        [
            (_fails("policy_exclusion_flag"), "01, Policy exclusion"),
            (_fails("currently_delinquent"), "02, Delinquency status"),
            (_fails("payment_flag"), "03, Payment Balance"),
            (_fails("inquiry_flag"), "04, Inquiry record"),
            (_score_flag_fails(), "05, Bureau score flag"),
            (_fails("recent_cli"), "06, Received CLI in last 3m"),
            (_fails("bureau_segment_flag"), "07, Bureau Segment flag"),
            (_limit_fails(limit), "08, ICL restriction"),
            (c("segment").isin(*_OVERRIDDEN), "09, Inter, w/we, multi"),
        ],
        "other",
    )


# ---- ladders ------------------------------------------------------------------------------


def _prime_rungs(low: tuple, mid: tuple, high: tuple) -> list[Rung]:
    """Each pair is the multiple below a score of 800 and from 800."""
    pair = lambda amounts, **r: [
        Rung("times", amounts[0], guard_below=800, **r),
        Rung("times", amounts[1], guard_from=800, **r),
    ]
    return [
        Rung("add", 500, above=100, up_to=500),
        *pair(low, up_to=1500),
        *pair(mid, above=1500, up_to=5000),
        *pair(high, above=5000, up_to=7500),
        Rung("add", 1000, above=7500),
    ]


def _sub_prime_rungs(*adds: int) -> list[Rung]:
    edges = [100, 500, 1000, 2000, 3000]
    return [Rung("add", a, above=lo, up_to=hi) for a, lo, hi in zip(adds, edges, edges[1:])]


# Steps per strategy.
CONSERVATIVE = {"prime": _prime_rungs((2, 3), (1.5, 2), (1.25, 1.5)), "sub_prime": _sub_prime_rungs(500, 1000, 1500, 2000)}
AGGRESSIVE = {"prime": _prime_rungs((2.5, 3.5), (2, 2.5), (1.25, 1.5)), "sub_prime": _sub_prime_rungs(500, 1500, 2000, 2500)}


def assigned_limit(steps: dict, default=None, limit="credit_limit", score="bureau_score_clean") -> Column:
    """New limit by segment; accounts of an inactivity decrease go back to their old limit."""
    rules = []
    for name, family in ((TRANSACTOR, "prime"), (SUB_PRIME, "sub_prime"), (REVOLVER, "prime")):
        member = c("segment") == name
        rules += ladder(limit, score, steps[family], when=member & (c("cld_population") == 0))
        rules.append((member & (c("cld_population") == 1), c("old_limit").cast("double")))
    return first_match(rules, default)


def conservative_limit() -> Column:
    return assigned_limit(CONSERVATIVE)


def aggressive_limit() -> Column:
    return assigned_limit(AGGRESSIVE, default=0.0)


def strategy_type(tile="tile") -> Column:
    return first_match([(c(tile) == 1, "Aggressive"), (c(tile) == 2, "Conservative")])


def new_limit_cents(tile="tile", aggressive="agg_limit", conservative="cons_limit") -> Column:
    picked = F.when(c(tile) == 1, c(aggressive)).when(c(tile) == 2, c(conservative))
    return (ceil_to(picked, 100) * 100).cast("bigint")


def capped_limit_cents(cents="new_limit_cents", eligible="eligible") -> Column:
    """At most 1,000,000 cents for an eligible account, 0 for any other."""
    return F.coalesce(F.when(c(eligible) == 1, clamp(cents, hi=MAX_LIMIT_CENTS)), F.lit(0)).cast("bigint")


def restored_limit_cents(previous="previous_limit_cents") -> Column:
    """The limit before a decrease, to the nearest 100 dollars and at least 500 dollars."""
    dollars = c(previous).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")
    return clamp((round_to(dollars, 100) * 100).cast("bigint"), lo=MIN_PASS_THROUGH_CENTS)


# ---- offer code and final overrides -----------------------------------------------------------


def offer_code(brands: Brands, segment_code: Column, brand="brand", region="province_group") -> Column:
    """brand-region-segment code, or NULL when one of the three has none."""
    regions = F.create_map(*[F.lit(v) for v in chain.from_iterable(REGION_CODES.items())])
    part = F.when(c(brand).isin(*brands.offered), c(brand))
    code = F.concat(part, F.lit("-"), F.try_element_at(regions, c(region)), F.lit("-"), segment_code, F.lit(f"-{OFFER_SUFFIX}"))
    return code


def segment_code(x="segment") -> Column:
    codes = F.create_map(*[F.lit(v) for v in chain.from_iterable(SEGMENT_CODES.items())])
    return F.try_element_at(codes, c(x))


def eligible(segment_col="segment", tenant="tenant_id") -> Column:
    """0 without a segment or for tenants whose id ends in 1."""
    barred = c(segment_col).isNull() | (F.substring(c(tenant), -1, 1) == "1")
    return F.when(barred, 0).otherwise(1)


def override(brands: Brands, brand="brand", accounts="n_unsecured", world="n_world", issuer="issued_by") -> Column:
    """Label of the rule that takes an account out, NULL when none does.

    An unknown identity-document issuer does not count as foreign.
    """
    return first_match(
        [
            (c(brand) == brands.partner, brands.partner),
            (c(accounts) > 1, "MultiCredit"),
            (c(world) > 0, "World / World Elite"),
            (~c(issuer).like("CA%"), "International"),
        ]
    )
