"""Customer-requested increases: status, buckets, exclusions, eligibility reasons."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitloom.functions import all_of, cond_count, dollars, month_diff, month_key
from limitloom.operators import asof_forward, attach, attach_history, exclude
from limitloom.plans.population import monthly_margin
from limitloom.rulesets import offers as rules
from limitloom.rulesets import reactive
from limitloom.rulesets.brands import Brands

c = F.col


def requests_with_offers(requests: DataFrame, limit_offers: DataFrame, as_of: dt.date, before: dt.date | None = None) -> DataFrame:
    """Each request with its offer, if any, and where it stands on ``as_of``."""
    if before is not None:
        requests = requests.filter(c("created_at") < F.lit(before))
    offered = limit_offers.select(
        c("offer_id").alias("matched_offer_id"),
        "strategy",
        "actioned_by",
        "accepted_at",
        "declined_at",
        c("created_at").alias("offer_created_at"),
        dollars("limit_cents_at_offer").alias("icl"),
        dollars(c("offered_limit_cents") - c("limit_cents_at_offer")).alias("cli_offer"),
    ).withColumn("offer_key", c("matched_offer_id"))
    # most requests may have no offer
    out = attach(requests, offered, [("offer_id", "offer_key")], keyless_apart=True)
    out = out.withColumns({"approve_status": rules.approve_status("matched_offer_id"), "cli_vintage": month_key("created_at")})
    return out.withColumn("accept_status", rules.offer_status(as_of))


def funnel(requested: DataFrame, performance: DataFrame, span: tuple[int, int] | None = None) -> DataFrame:
    """Requests with the account's unsecured monthly rows, months since decision, tenure and buckets.

    ``span=(0, 0)`` keeps the decision month only, as every report below does; the month
    then sits in the join condition and a request meets one monthly row, not its history.
    """
    monthly = monthly_margin(performance).select("account_id", "stmt_mth", "stmt_date", "tu_band", "cl", "booking_date", "dpd_bucket")
    decided = requested.withColumn("decided_on", F.to_date(F.coalesce("accepted_at", "declined_at", "created_at")))
    age = month_diff("decided_on", "stmt_date")
    if span is not None and span[0] == span[1]:
        month = F.add_months(F.trunc("decided_on", "month"), span[0])
        out = attach(decided.withColumn("__month", month), monthly.withColumn("__month", F.trunc("stmt_date", "month")), ["account_id", "__month"], "inner")
        out = out.drop("__month")
    else:
        out = attach(decided, monthly, "account_id", "left" if span is None else "inner", extra=None if span is None else age.between(*span))
    out = out.withColumns({"icl_adj": F.coalesce("icl", "cl"), "cli_stmt": age, "mob": month_diff("booking_date", "stmt_date")})
    return out.withColumns({"icl_bucket": rules.limit_bucket("icl_adj"), "tu_bucket": rules.score_band_bucket("tu_band")})


def expired_by_limit(funnelled: DataFrame) -> DataFrame:
    """Approved requests by limit bucket, buckets with an expired offer only."""
    approved = funnelled.filter((c("cli_stmt") == 0) & (c("approve_status") == "Approved"))
    grid = approved.groupBy(rules.limit_bucket_fine("icl_adj").alias("limit_bucket")).agg(
        cond_count(c("accept_status") == "Expired", "request_id").alias("expired_count"), F.count("request_id").alias("total_count")
    )
    return grid.filter(c("expired_count") > 0)


def approval_grid(funnelled: DataFrame) -> DataFrame:
    """Approvals by limit, score band and tenure buckets."""
    return (
        funnelled.filter(c("cli_stmt") == 0)
        .groupBy("icl_bucket", "tu_bucket", rules.tenure_bucket("mob").alias("mob_bucket"))
        .agg(cond_count(c("approve_status") == "Approved", "request_id").alias("approved_count"), F.count("request_id").alias("total_count"))
    )


def large_low_limit(funnelled: DataFrame, limit: int = 1500, increase: int = 4000) -> DataFrame:
    """Approved requests of low-limit accounts that were offered a large increase."""
    tests = (c("cli_stmt") == 0) & (c("icl") <= limit) & (c("cli_offer") > increase) & (c("approve_status") == "Approved")
    return funnelled.filter(tests)


def without_decrease(rows: DataFrame, decreases: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of accounts with neither a decrease of a known strategy nor an inactivity mark."""
    kept = exclude(rows, decreases.filter(c("strategy").isNotNull()), "account_id")
    return exclude(kept, marked, "account_id")


_REQUEST = ("request_id", "user_id", "account_id", "offer_id", "request_mth", "icl", "cli_offer")


def accepted_history(rows: DataFrame, offers_view: DataFrame) -> DataFrame:
    """Every accepted offer of each row's account, one line per request and offer."""
    past = offers_view.filter(c("accepted_flag") == 1).select("account_id", "offer_mth", "current_cl", "new_cl", "inc_exposure", "program")
    return attach_history(rows.withColumn("request_mth", c("stmt_mth")).select(*_REQUEST), past, "account_id")


def accepted_summary(rows: DataFrame, offers_view: DataFrame) -> DataFrame:
    """The same history as counts and extremes: one line per request.

    An account with many requests and many offers would list their product; its offers are
    summed up first.
    """
    past = offers_view.filter(c("accepted_flag") == 1).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("accepted_offers"),
        F.min("offer_mth").alias("first_offer_mth"),
        F.max("offer_mth").alias("last_offer_mth"),
        F.max("new_cl").alias("highest_cl"),
    )
    return attach(rows.withColumn("request_mth", c("stmt_mth")).select(*_REQUEST), past, "account_id")


def accepted_listing(rows: DataFrame, offers_view: DataFrame) -> DataFrame:
    """One line per request and accepted offer, each with the counts and extremes of its account."""
    past = offers_view.filter(c("accepted_flag") == 1).select("account_id", "offer_mth", "new_cl")
    return attach_history(accepted_summary(rows, offers_view), past, "account_id")


def restored_above_decrease(rows: DataFrame, decreases: DataFrame) -> DataFrame:
    """Requests whose new limit exceeds a limit the account had before a decrease, one line each.

    Counts and extremes cover the exceeded limits only. Decreases from the same limit are
    counted first, so a request meets the distinct earlier limits of its account.
    """
    earlier = decreases.filter(c("initiated_at").isNotNull()).groupBy("account_id", "previous_limit_cents").agg(
        F.count(F.lit(1)).alias("n"), F.max("initiated_at").alias("at"), F.min("new_limit_cents").alias("lowest")
    )
    met = attach(_restored(rows), earlier, "account_id", "inner", extra=c("request_new_cl") > dollars("previous_limit_cents"))
    return met.groupBy(*_REQUEST, "request_new_cl").agg(
        F.sum("n").alias("decreases"),
        F.max("at").alias("last_decrease_at"),
        dollars(F.min("previous_limit_cents")).alias("lowest_prev_cl"),
        dollars(F.max("previous_limit_cents")).alias("highest_prev_cl"),
        dollars(F.min("lowest")).alias("lowest_new_cl"),
    )


def restored_listing(rows: DataFrame, decreases: DataFrame) -> DataFrame:
    """The same matches one by one: a line per request and decrease from a limit it exceeds."""
    earlier = decreases.filter(c("initiated_at").isNotNull()).select(
        "account_id", "initiated_at", dollars("previous_limit_cents").alias("prev_cl"), dollars("new_limit_cents").alias("decreased_cl")
    )
    return attach(_restored(rows), earlier, "account_id", "inner", extra=c("request_new_cl") > c("prev_cl"))


def restored_pairs(rows: DataFrame, decreases: DataFrame) -> DataFrame:
    """One line per request and decrease from a limit it exceeds, with the request's count of them. ``rows`` is read twice."""
    lines = restored_listing(rows, decreases)
    counted = restored_above_decrease(rows, decreases).select(*[c(x).alias(f"__{x}") for x in _REQUEST], "decreases")
    # a request may lack a user
    same = all_of([c(x).eqNullSafe(c(f"__{x}")) for x in _REQUEST])
    return lines.join(counted, same, "left").select(*lines.columns, "decreases")


def _restored(rows: DataFrame) -> DataFrame:
    return rows.withColumn("request_mth", c("stmt_mth")).select(*_REQUEST).withColumn("request_new_cl", c("icl") + c("cli_offer"))


def with_eligibility(funnelled: DataFrame, eligibility: DataFrame, created_after: dt.date, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """Requests in their decision month with the first adjudication after the request.

    ``tiebreak`` orders adjudications of an account that carry the same time.
    """
    cols = ["request_id", "account_id", "created_at", "approve_status", "cli_vintage", "accept_status", "icl_adj", "mob", "icl_bucket", "tu_bucket"]
    recent = funnelled.filter((c("cli_stmt") == 0) & (c("created_at") > F.lit(created_after))).select(*cols)
    return asof_forward(recent, eligibility, "account_id", "created_at", "adjudicated_at", tiebreak=tiebreak, own=["request_id"])


def reject_reason_counts(adjudicated: DataFrame, brands: Brands, after_vintage: str) -> DataFrame:
    declined = adjudicated.filter((c("cli_vintage") > after_vintage) & (c("approve_status") == "Not Approved"))
    return declined.groupBy(reactive.reject_reason(brands).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))


def reject_bucket_counts(adjudicated: DataFrame, after_vintage: str) -> DataFrame:
    declined = adjudicated.filter((c("cli_vintage") > after_vintage) & (c("approve_status") == "Not Approved"))
    return declined.groupBy("icl_bucket", "tu_bucket", reactive.reject_bucket().alias("reject_bucket")).agg(F.count(F.lit(1)).alias("n"))
