"""Offer status and the limit, score-band and tenure buckets of the request funnel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from limitloom.functions import any_of, as_date, band, first_match

# Labels, strategy patterns, days an offer stays open.
OTHER_STRATEGIES = ("%QC%", "%PRTV%")
OPEN_DAYS = 31
LOW_SCORE_BANDS = ("1. SUBPRIME", "2. NEAR_PRIME", "3. PRIME")
HIGH_SCORE_BANDS = ("4. PRIME_PLUS", "5. SUPER_PRIME")
LIMIT_TWO = ([1500], ["1, <=1.5k ICL", "2,>1.5k ICL"])
LIMIT_FIVE = ([100, 1500, 3000, 7000], ["1, <=100", "2, 100-1500", "3,1500-3000", "4,3000-7000", "5,>7000"])
TENURE_THREE = ([12, 24], ["1, <= 1yr MOB", "2, <= 2yr MOB", "3, >2yr MOB"])
TENURE_SIX = ([3, 6, 12, 24, 36], ["1,0-3", "2,4-6", "3,7-12", "4,13-24", "5,25-36", "6,>36"])


def approve_status(offer_id: str = "offer_id") -> Column:
    return F.when(F.col(offer_id).isNotNull(), "Approved").otherwise("Not Approved")


def offer_status(
    as_of,
    approved: str = "approve_status",
    strategy: str = "strategy",
    declined: str = "declined_at",
    accepted: str = "accepted_at",
    created: str = "offer_created_at",
) -> Column:
    """Where a request stands on ``as_of``; an untouched offer expires after 31 days."""
    age = F.datediff(as_date(as_of), as_date(created))
    return first_match(
        [
            (F.col(approved) == "Not Approved", "Not Approved"),
            (any_of([F.col(strategy).like(p) for p in OTHER_STRATEGIES]), "not in V2 strategy"),
            (F.col(declined).isNotNull(), "Declined"),
            (F.col(accepted).isNotNull(), "Accepted"),
            (age < OPEN_DAYS, "In progress"),
        ],
        "Expired",
    )


def _open_ended(x, edges, labels) -> Column:
    # The last bucket is the ELSE branch here, so a missing value lands in it.
    return band(x, edges, labels, missing=labels[-1])


def limit_bucket(x="icl") -> Column:
    return _open_ended(x, *LIMIT_TWO)


def limit_bucket_fine(x="icl") -> Column:
    return _open_ended(x, *LIMIT_FIVE)


def tenure_bucket(x="mob") -> Column:
    return _open_ended(x, *TENURE_THREE)


def tenure_bucket_fine(x="mob") -> Column:
    return _open_ended(x, *TENURE_SIX)


def score_band_bucket(x="tu_band") -> Column:
    return first_match([(F.col(x).isin(*LOW_SCORE_BANDS), "1, Low TU"), (F.col(x).isin(*HIGH_SCORE_BANDS), "2, High TU")])
