"""Score studies: several scores on one offer, the high-risk back-test, the cut study."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitloom.functions import clean_score, cond_count, month_diff, month_key, month_start, safe_ratio, score_bucket
from limitloom.operators import (
    CUT_LEVELS,
    attach,
    attach_on_day,
    attach_on_month,
    attach_prev_month,
    bucket_histogram,
    compare_groups,
    count_of_counts,
    cumulative,
    cut_points,
    mean_then_sum,
    member_flag,
    month_index,
    month_number,
)
from limitloom.plans.population import LATER_TENURE, monthly_margin, unsecured_offers
from limitloom.plans.vintage_tracker import attach_months, vintage_panel, weighted_mean, weighted_sum
from limitloom.rulesets import cuts
from limitloom.rulesets.brands import Brands
from limitloom.session import durable
from limitloom.sources import stitch_history

c = F.col


def _senior(scores: DataFrame) -> DataFrame:
    return scores.select("account_id", "reference_date", clean_score("prediction").alias("senior_score"))


def offers_with_score(offers: DataFrame, scores: DataFrame) -> DataFrame:
    """Offers with the senior score of the offer day and its bucket."""
    out = attach_on_day(offers, _senior(scores), "account_id", "offer_date", "reference_date").drop("reference_date")
    return out.withColumn("score_bucket", score_bucket("senior_score"))


def multi_score(
    offers: DataFrame,
    scores: DataFrame,
    performance: DataFrame,
    behaviour: DataFrame,
    limit_offers: DataFrame,
    bankruptcy: DataFrame,
    brands: Brands,
    span: tuple[int, int] = (0, 12),
) -> DataFrame:
    """Offers with senior, behaviour and bankruptcy scores and monthly rows ``span`` after them.

    The scores are attached to offers, before the months multiply them. The bankruptcy
    score hangs on a user found through the account's offers: one row per distinct
    (account, user, strategy), so an account with several strategies repeats.
    """
    out = offers_with_score(unsecured_offers(offers, LATER_TENURE), scores)
    beh = behaviour.select("account_id", "reference_date", clean_score("model_score").alias("beh_score"))
    out = attach_prev_month(out, beh, "account_id", "offer_date", "reference_date").drop("reference_date")
    users = limit_offers.select("account_id", c("user_id").alias("offer_user_id"), "strategy").distinct()
    out = attach(out, users, "account_id")
    bko = bankruptcy.select("user_id", "reference_date", clean_score("score").alias("bko_score"))
    out = attach_on_month(out, bko, [("offer_user_id", "user_id")], "offer_date", "reference_date").drop("reference_date")
    monthly = monthly_margin(performance).select("account_id", "stmt_mth", "stmt_date", "brand", "tu_band", "raim")
    out = attach_months(out, monthly, span, "offer_date", "stmt_date").withColumn("cli_stmt", month_diff("offer_date", "stmt_date"))
    return out.withColumns({"bko_cut": cuts.bankruptcy_cut(), "beh_cut": cuts.behaviour_cut(brands)})


def average_scores(scored: DataFrame) -> DataFrame:
    """Mean behaviour and bankruptcy score of accepted high-risk offers by vintage."""
    rows = scored.filter(c("senior_score").isNotNull() & (c("cli_stmt") == 1) & (c("accepted_flag") == 1))
    rows = rows.withColumn("high_risk_flag", cuts.high_risk()).filter(c("high_risk_flag") == "high risk")
    keys = [month_key("offer_date").alias("offer_vintage"), "high_risk_flag"]
    return rows.groupBy(*keys).agg(F.avg("beh_score").alias("avg_beh"), F.avg("bko_score").alias("avg_bko"))


def backtest(
    offers: DataFrame,
    performance: DataFrame,
    backfill: DataFrame,
    live: DataFrame,
    cutoff: dt.datetime,
    brand_codes: Sequence[str],
    only_after_offer: bool = False,
) -> DataFrame:
    """Months after an offer first meets the high-risk back-test.

    The score of each statement month is the one dated its first day, from the backfill
    up to ``cutoff`` and the live feed after it. ``only_after_offer`` looks for the first
    qualifying month among months after the offer; both readings are in use and they
    differ when an account qualified before its offer. Offers of one account and day are
    counted in ``n_offers`` and followed once.

    Offers look the month up in an index by account and year, and only the months after it are unfolded
    and met, so no offer meets its account's whole history.
    """
    offers = unsecured_offers(offers, LATER_TENURE)
    monthly = monthly_margin(performance).filter(c("brand").isin(*brand_codes)).select("account_id", "stmt_mth", "brand", "card_type", "tu_band", "raim")
    history = _senior(stitch_history(backfill, live, "reference_date", cutoff))
    monthly = attach_on_day(monthly.withColumn("__first", month_start("stmt_mth")), history, "account_id", "__first", "reference_date", "inner")
    # both the index and the months after it are read from here
    monthly = durable(monthly.filter(c("senior_score").isNotNull()).withColumn("backtest_flag", cuts.backtest_flag()).drop("reference_date"), "scored-months")
    followed = offers.groupBy("account_id", "offer_date", "accepted_flag").agg(F.count(F.lit(1)).alias("n_offers"))
    low, high = offers.agg(F.min(F.year("offer_date")), F.max(F.year("offer_date"))).first()
    low, high = (0, 0) if low is None else (low, high)
    index = month_index(monthly, "account_id", c("backtest_flag"), "__first", (low, high))
    followed = followed.withColumn("__year", F.coalesce(F.year("offer_date"), F.lit(low)))
    # the unfolded index and the packed months are far larger than Spark sizes them: the hints keep both from being broadcast
    rows = attach(followed.hint("merge"), index, ["account_id", ("__year", "year")], "inner")
    risk = F.get("following", F.month("offer_date") - 1) if only_after_offer else c("first")
    rows = rows.withColumn("__risk", risk).filter(c("__risk") < c("last")).withColumn("__m", F.explode(F.sequence(c("__risk") + 1, c("last"))))
    rows = attach(rows.hint("merge"), monthly.withColumn("__at", month_number("__first")), ["account_id", ("__m", "__at")], "inner")
    day = F.make_date(F.floor(c("__risk") / 12).cast("int"), c("__risk") % 12 + 1, F.lit(1))
    rows = rows.withColumns({"cli_stmt": month_diff("offer_date", "__first"), "risk_mth": month_key(day), "risk_stmt": c("__m") - c("__risk")})
    return rows.drop("__year", "first", "following", "last", "__risk", "__m", "__first")


def tranche_risk_mix(offers: DataFrame, performance: DataFrame, backfill: DataFrame, live: DataFrame, cutoff: dt.datetime, brand: str) -> DataFrame:
    """Share of high-risk accounts among accepted offers, per vintage, in the month after."""
    offers = unsecured_offers(offers, LATER_TENURE)
    scored = offers_with_score(offers.filter(c("accepted_flag") == 1), stitch_history(backfill, live, "reference_date", cutoff))
    scored = scored.filter(c("senior_score").isNotNull())
    monthly = monthly_margin(performance).filter(c("brand") == brand).select("account_id", F.trunc("stmt_date", "month").alias("__month"))
    next_month = F.add_months(F.trunc("offer_date", "month"), 1)
    rows = attach(scored.withColumn("__month", next_month), monthly, ["account_id", "__month"], "inner")
    grid = rows.groupBy(month_key("offer_date").alias("offer_vintage")).agg(
        cond_count(c("senior_score") < cuts.HIGH_RISK, "account_id").alias("low_risk_accts"),
        cond_count(c("senior_score") >= cuts.HIGH_RISK, "account_id").alias("high_risk_accts"),
    )
    return grid.withColumn("high_risk_ratio", safe_ratio("high_risk_accts", c("high_risk_accts") + c("low_risk_accts")))


class CutStudy:
    """The score-cut study on offers scored on their day, one vintage range at a time.

    Every result is a small grouped frame; the offer-by-month frame behind it is never
    built, because offers alike in all labels are counted first and weighed.
    """

    def __init__(self, offers: DataFrame, scores: DataFrame, performance: DataFrame, risk_accounts: DataFrame, first: str, last: str):
        kept = unsecured_offers(offers, LATER_TENURE).filter(month_key("offer_date").between(first, last))
        scored = offers_with_score(kept, scores).filter(c("senior_score").isNotNull())
        # Risk rows may repeat an account; here the mark is what counts, so no offer is repeated.
        self.offers = member_flag(scored, risk_accounts, "account_id", "risk")
        self.performance = monthly_margin(performance).select("account_id", "stmt_mth", "stmt_date", "brand", "raim")

    def _panel(self, labels, **span) -> DataFrame:
        return vintage_panel(self.offers, self.performance, labels, **span)

    def margin_curves(self, mean: bool = False) -> DataFrame:
        """Cumulative margin of responders by brand and score bucket over 12 months."""
        panel = self._panel(["accepted_flag", "score_bucket"], span=(1, 12)).filter(c("accepted_flag") == 1)
        keys = ["brand", "score_bucket"]
        value = weighted_mean("raim", "raim") if mean else F.coalesce(weighted_sum("raim", "raim"), F.lit(0)).alias("raim")
        monthly = panel.dropna(subset=keys).groupBy(*keys, "cli_stmt").agg(value)
        return cumulative(monthly, keys, "cli_stmt", "raim", "raim_cuml")

    def _by_response(self, brand: str) -> DataFrame:
        panel = self._panel(["accepted_flag", "score_bucket"], span=(1, 12)).filter(c("brand") == brand)
        panel = panel.dropna(subset=["score_bucket", "accepted_flag"])
        return panel.groupBy("accepted_flag", "score_bucket", "cli_stmt").agg(
            weighted_mean("raim", "raim"), F.sum("n_offers").alias("accounts")
        )

    def increment(self, brand: str) -> DataFrame:
        """Responder minus non-responder margin per bucket: monthly means, summed."""
        names = {0: "_nonresponder", 1: "_responder"}
        paired = compare_groups(self._by_response(brand), ["score_bucket", "cli_stmt"], "accepted_flag", ["raim", "accounts"], names)
        sums = [F.sum(f"raim{s}").alias(f"raim{s}") for s in names.values()]
        peaks = [F.max(f"accounts{s}").alias(f"accounts{s}") for s in names.values()]
        out = paired.groupBy("score_bucket").agg(*sums, *peaks)
        return out.withColumn("diff", c("raim_responder") - c("raim_nonresponder"))

    def response_curves(self, brand: str) -> DataFrame:
        return cumulative(self._by_response(brand), ["accepted_flag", "score_bucket"], "cli_stmt", "raim", "raim_cuml")

    def _month_after(self, brand: str) -> DataFrame:
        """Accepted offers whose account has a row of the brand in the month after."""
        monthly = self.performance.filter(c("brand") == brand).select("account_id", F.trunc("stmt_date", "month").alias("__month"))
        accepted = self.offers.filter(c("accepted_flag") == 1)
        accepted = accepted.withColumn("__month", F.add_months(F.trunc("offer_date", "month"), 1))
        return attach(accepted, monthly, ["account_id", "__month"], "inner").drop("__month")

    def cut_points(self, brand: str, levels: Sequence[float] = CUT_LEVELS) -> DataFrame:
        return cut_points(self._month_after(brand), "senior_score", c("risk") == 1, "account_id", levels)

    def distribution(self, brand: str) -> DataFrame:
        return bucket_histogram(self._month_after(brand), "score_bucket", "risk")

    def _numbered(self, brand: str) -> DataFrame:
        """Accepted offers with a month 1..12 of the brand, and whether an earlier one exists."""
        active = self._panel(["offer_date", "accepted_flag"], span=(1, 12)).filter((c("brand") == brand) & (c("accepted_flag") == 1))
        days = active.groupBy("account_id", "offer_date").agg(F.avg("accepted_flag").alias("accepted"))
        days = cumulative(days, "account_id", "offer_date", "accepted", "nth")
        return days.select("account_id", "offer_date", "nth", (c("nth") > 1).cast("int").alias("multi"))

    def offers_per_account(self, brand: str) -> DataFrame:
        return count_of_counts(self._numbered(brand), "account_id", "n_offers", "n_accounts")

    def repeat_scores(self, brand: str) -> DataFrame:
        """Mean score of repeat and first offers by vintage."""
        rows = attach(self._month_after(brand), self._numbered(brand).drop("nth"), ["account_id", "offer_date"])
        means = rows.groupBy(month_key("offer_date").alias("offer_vintage"), "multi").agg(F.avg("senior_score").alias("score"))
        return compare_groups(means, "offer_vintage", "multi", ["score"], {1: "_multi", 0: "_single"}, how="left")

    def repeat_margin(self, brand: str) -> DataFrame:
        """One-year margin (sum of monthly means) of repeat and first offers by vintage."""
        accepted = self.offers.filter(c("accepted_flag") == 1)
        flagged = attach(accepted, self._numbered(brand).drop("nth"), ["account_id", "offer_date"], "inner")
        panel = vintage_panel(flagged, self.performance.filter(c("brand") == brand), ["multi"], span=(1, 12))
        monthly = panel.groupBy("offer_vintage", "multi", "cli_stmt").agg(weighted_mean("raim", "raim"))
        sums = mean_then_sum(monthly, ["offer_vintage", "multi"], "cli_stmt", "raim", "raim")
        return compare_groups(sums, "offer_vintage", "multi", ["raim"], {1: "_multi", 0: "_single"}, how="left")
