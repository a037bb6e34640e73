"""Score cuts: bankruptcy, behaviour and the high-risk back-test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limitloom.functions import any_of, first_match
from limitloom.rulesets.brands import Brands

# A score must exceed the cut to pass.
BANKRUPTCY_CUT = 680
BEHAVIOUR_CUTS = {"partner": 594, "core": 620, "affiliate": 620, "community": 680}
HIGH_RISK = 0.7
# (card type, score band or None for any, score at or above)
BACKTEST = (
    ("WORLD_ELITE", None, 1.0),
    ("WORLD", None, 0.9),
    ("STANDARD", "1. SUBPRIME", 0.7),
)


def bankruptcy_cut(score="bko_score") -> Column:
    return first_match([(F.col(score) > BANKRUPTCY_CUT, "Pass")], "Fail")


def behaviour_cut(brands: Brands, score="beh_score", brand="brand") -> Column:
    """Pass above the cut of the brand's group; an unlisted brand or missing score fails."""
    return first_match(
        [((F.col(brand) == code) & (F.col(score) > BEHAVIOUR_CUTS[group]), "Pass") for code, group in brands.cut_group.items()],
        "Fail",
    )


def high_risk(score="senior_score") -> Column:
    """'high risk' from 0.7; a missing score counts as low risk."""
    return first_match([(F.col(score) >= HIGH_RISK, "high risk")], "low risk")


def backtest_flag(score="senior_score", card_type="card_type", tu_band="tu_band") -> Column:
    rules = []
    for card, tu, floor in BACKTEST:
        test = (F.col(card_type) == card) & (F.col(score) >= floor)
        rules.append(test if tu is None else test & (F.col(tu_band) == tu))
    return F.coalesce(any_of(rules), F.lit(False))
