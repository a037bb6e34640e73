"""Rules of the early-tenure campaign: waterfalls, re-decision, line amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limitloom.functions import all_of, any_of, band, first_match, flag

c = F.col

# ---- fixed values -----------------------------------------------------------------------

SUB_PRIME_BAND = "b. Sub Prime (300 to 639)"
NEAR_PRIME_BAND = "c. Near-Prime (640 to 719)"
PRIME_BAND = "d. Prime (720 to 759)"
PRIME_PLUS_BAND = "e. Prime+ (760 to 799)"
SUPER_PRIME_BAND = "f. Super Prime (800+)"
ABOVE_SUB_PRIME = (NEAR_PRIME_BAND, PRIME_BAND, PRIME_PLUS_BAND, SUPER_PRIME_BAND)

FRAUD_DECLINES = ("ACCOUNT_SUSPENDED", "CARD_FROZEN", "FRAUD_SUSPECTED", "CARD_BLOCKED")
JUNIOR_CUTS = {"junior_10": 0.1, "junior_15": 0.15, "junior_20": 0.2}
LARGE_PAYMENT = 2500

POLICY_ATTRIBUTES = ("pr44", "pr45", "pr124", "pr116", "pr15", "pr50", "pr74", "pr75", "pr120", "pr97", "go81")

# Bureau-attribute rejects of the current strategy, per file segment.
STRATEGY_REJECTS = {
    "THICK": ("am41 > 1", "am42 > 0", "am43 > 0", "am84 > 0", "go11 <= 50", "re34 >= 100", "dti > 200", "pr51 > 0"),
    "THIN": (
        "am41 > 0", "am42 > 0", "am43 > 0", "at01 <= 0", "at01 > 5", "am84 > 0", "bc147 >= 90",
        "go06 > 4", "go11 <= 95", "go149 > 1", "go14 <= 2", "re34 >= 90", "pr51 > 0", "dti > 200",
    ),
    "SUBPRIME": (
        "am41 > 1", "am42 > 0", "am43 > 0", "go141 > 4", "pr11 > 500", "am02 <= 0",
        "am84 > 0", "pr51 > 0", "re34 > 95", "go14 < 3", "dti > 100",
    ),
}
BANKRUPTCY_FLOORS = {"THICK": 670, "THIN": 715, "SUBPRIME": 670}
# Segment: bureau score range, model, then (model floor, bureau score floor) alternatives.
TREE_PASSES = {
    "THICK": ((640, None), "thick", ((521, None), (489, 669), (475, 690))),
    "THIN": ((640, None), "thin", ((641, 680), (656, 669))),
    "SUBPRIME": ((600, 640), "subprime", ((575, None),)),
}

DROPPED_MOST = "5. Dropped More Than 50 Points"


# ---- component flags -------------------------------------------------------------------------


def score_movement(change: Column) -> Column:
    return first_match(
        [
            (change == 0, "1. TU Score Same"),
            (change > 0, "2. TU Score Better Now"),
            (change >= -20, "3. Dropped Upto 20 Points"),
            (change >= -50, "4. Dropped Between 20 to 50 Points"),
            (change < -50, DROPPED_MOST),
        ],
        "6. Unknown",
    )


def target_segment(score_band="original_score_band", limit="credit_limit") -> Column:
    return first_match(
        [
            ((c(score_band) == NEAR_PRIME_BAND) & (c(limit) == 2000), 1),
            (c(score_band).isin(PRIME_PLUS_BAND, SUPER_PRIME_BAND) & (c(limit) == 1000), 2),
        ],
        0,
    )


def above_sub_prime(score_band: str) -> Column:
    return flag(c(score_band).isin(*ABOVE_SUB_PRIME))


def band_group(score_band="original_score_band") -> Column:
    return first_match(
        [
            (c(score_band) == SUB_PRIME_BAND, "1. Subprime"),
            (c(score_band) == NEAR_PRIME_BAND, "2. Near Prime"),
            (c(score_band) == PRIME_BAND, "3. Prime"),
            (c(score_band).isin(PRIME_PLUS_BAND, SUPER_PRIME_BAND), "4. >= Prime Plus"),
        ]
    )


def untrusted_payment(x="trusted_payment") -> Column:
    return flag(c(x) == "false")


def large_payment(x="amount") -> Column:
    return flag(c(x) >= LARGE_PAYMENT)


def trades_increased(before="am41_at_onboarding", now="latest_am41") -> Column:
    """Compared as numbers: the onboarding report holds text."""
    return flag(c(before).try_cast("int") < c(now))


def policy_fail() -> Column:
    return flag(any_of([c("go91") == "Y", *[c(a) >= 1 for a in POLICY_ATTRIBUTES]]))


# ---- waterfalls --------------------------------------------------------------------------------


def _components(score_name: str) -> dict[str, tuple[Column, str]]:
    """Exclusions both waterfalls share: predicate and the text after the number."""
    weak = (c("original_above_sub_prime") == 0) | (c("latest_above_sub_prime") == 0)
    return {
        "junior": (c("junior_10") == 1, f"Fraud {score_name} Exclusion"),
        "fraud": (c("fraud_checks_passed") == 0, "Fraud Checks Failed"),
        "payment": (c("has_untrusted_payment") == 1, "Fraud Non Trusted Payment"),
        "policy": (c("policy_fail") == 1, "Credit Policy Exclusion"),
        "cash": (c("cash_advance") == 1, "Credit Cash Advance"),
        "purchase": (c("confirmed_purchase") == 0, "Credit Confirmed Purchase"),
        "late": (c("ever_late") == 1, "Credit Delinquency"),
        "weak": (weak, "Credit Score Sub Prime"),
        "trades": (c("trades_increased") == 1, "Credit AM41 Increase"),
        "dropped": (c("score_movement") == DROPPED_MOST, "Credit Score Dropped More Than 50 Points"),
        "untargeted": (c("target_segment") == 0, "Not Target Segment CL Accounts"),
        "redecision": (c("current_strategy_approves") == 0, "Current Strategy"),
        # A missing behaviour score passes.
        "behaviour": ((c("behaviour_score") >= 0) & (c("behaviour_score") < 600), "High Risk Behavior Score"),
        "unpaid": (c("payment_amount").isNull(), "No Payment Amount"),
        "frozen": (c("user_frozen") == 1, "User Frozen"),
    }


# Number and component, in order; two of the first list share a 7, the second skips 4.
FIRST_WATERFALL = (
    (1, "junior"), (2, "fraud"), (3, "payment"), (4, "policy"), (5, "cash"), (6, "purchase"),
    (7, "late"), (7, "weak"), (8, "trades"), (9, "dropped"), (15, "untargeted"),
)
FINAL_WATERFALL = (
    (0, "redecision"), (1, "junior"), (2, "fraud"), (3, "payment"), (5, "policy"), (6, "cash"), (7, "purchase"),
    (8, "late"), (9, "weak"), (10, "trades"), (11, "dropped"), (12, "behaviour"), (13, "unpaid"), (14, "frozen"),
)
FIRST_PASS, FINAL_PASS = "16. Criteria Pass", "15. Criteria Pass"


def _waterfall(order, passed: str, score_name: str) -> Column:
    parts = _components(score_name)
    return first_match([(parts[k][0], f"{number}. {parts[k][1]}") for number, k in order], passed)


def first_waterfall(score_name: str = "Junior") -> Column:
    return _waterfall(FIRST_WATERFALL, FIRST_PASS, score_name)


def final_waterfall(score_name: str = "Junior") -> Column:
    return _waterfall(FINAL_WATERFALL, FINAL_PASS, score_name)


# ---- re-decision under the current strategy -------------------------------------------------------


def public_record_reject() -> Column:
    return flag(any_of([c("go91") == "Y", *[c(a) > 0 for a in POLICY_ATTRIBUTES]]))


def strategy_reject() -> Column:
    return flag(any_of([(c("segment") == s) & any_of([F.expr(t) for t in tests]) for s, tests in STRATEGY_REJECTS.items()]))


def bankruptcy_reject(score="bko") -> Column:
    return flag(any_of([(c("segment") == s) & (c(score) < floor) for s, floor in BANKRUPTCY_FLOORS.items()]))


def tree_reject(score="cvsc100") -> Column:
    """Rejects unless the segment's model passes; an unknown segment is rejected."""
    passes = []
    for name, ((lo, hi), model, routes) in TREE_PASSES.items():
        in_range = (c(score) >= lo) if hi is None else c(score).between(lo, hi)
        ways = [(c(model) >= m) if s is None else (c(model) >= m) & (c(score) >= s) for m, s in routes]
        passes.append((c("segment") == name) & in_range & any_of(ways))
    return F.when(any_of(passes), 0).otherwise(1)


def approves(rejects=("public_record_reject", "strategy_reject", "bankruptcy_reject", "tree_reject")) -> Column:
    return flag(all_of([c(r) == 0 for r in rejects]))


# ---- line amount and gate ----------------------------------------------------------------------------


def line_amount(score_band="original_score_band", limit="credit_limit") -> Column:
    # A missing limit earns nothing in the bands that depend on it.
    by_limit = lambda edges, amounts: F.coalesce(band(limit, edges, amounts, closed="left"), F.lit(0))
    return first_match(
        [
            (c(score_band) == NEAR_PRIME_BAND, by_limit([701], [1000, 1200])),
            (c(score_band) == PRIME_BAND, by_limit([1000, 1800], [1200, 1500, 2000])),
            (c(score_band) == PRIME_PLUS_BAND, 2000),
            (c(score_band) == SUPER_PRIME_BAND, 2500),
        ],
        0,
    )


def campaign_window(day_on_book="day_on_book") -> Column:
    return (c(day_on_book) > 90) & (c(day_on_book) < 179)
