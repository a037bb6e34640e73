"""Audience of the early-tenure campaign.

Every input is brought to one row per account (or user) before it is attached, so the attach
steps are joins of one-row-per-key frames and nothing multiplies. Each input is read once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitloom.functions import as_date, cond_sum, dollars, flag, month_key
from limitloom.operators import attach, dedupe, latest_per_key, member_flag
from limitloom.operators.dedupe import sortable_columns
from limitloom.operators.star import gather, newest
from limitloom.rulesets import campaign as rules
from limitloom.session import durable

c = F.col


def transaction_flags(transactions: DataFrame, as_of: dt.date, card_type: str) -> DataFrame:
    """Fraud declines, cash advances, purchases and payments of open accounts, per account."""
    open_cards = transactions.filter((c("account_status") == "OPEN") & (c("card_type") == card_type))
    happened = as_date("authorized_at") <= F.lit(as_of)
    payment = c("category") == "PAYMENT"
    counts = open_cards.groupBy("account_id").agg(
        # NULL, not 0, when nothing was declined for fraud: the pass rule reads the NULL.
        cond_sum(happened & c("decline_reason").isin(*rules.FRAUD_DECLINES), empty=None).alias("fraud_remove"),
        cond_sum(happened & (c("category") == "CASH_ADVANCE")).alias("cash_advances"),
        cond_sum(happened & (c("category") == "PURCHASE") & (c("status") == "CONFIRMED")).alias("purchases"),
        F.max(F.when(payment, rules.untrusted_payment())).alias("any_untrusted"),
        F.max(F.when(payment, rules.large_payment())).alias("any_large"),
        F.sum(F.when(payment, c("amount"))).alias("payment_amount"),
    )
    untrusted = F.when(c("any_untrusted").isNotNull(), flag((c("any_untrusted") > 0) & (c("any_large") > 0)))
    return counts.withColumn("has_untrusted_payment", untrusted).drop("any_untrusted", "any_large")


def junior_flags(scores: DataFrame, as_of: dt.date, model_version: str = "2.1") -> DataFrame:
    """Highest junior score of the last 30 days against the three cuts."""
    recent = scores.filter((c("model_version") == model_version) & (as_date("reference_date") > F.date_sub(F.lit(as_of), 30)))
    peak = recent.groupBy("account_id").agg(F.max("prediction").alias("peak"))
    return peak.select("account_id", *[flag(c("peak") >= cut).alias(name) for name, cut in rules.JUNIOR_CUTS.items()])


def approved_accounts(frames: Mapping[str, DataFrame], brand: str, since: dt.date) -> DataFrame:
    """Accounts opened through approved standard applications, with onboarding attributes."""
    # A user without a type is dropped too: the comparison with 'TEST' is then unknown.
    known = frames["users"].filter(c("type") != "TEST").select("user_id").distinct()
    applied = frames["applications"].filter(
        (c("brand") == brand)
        & (c("type") == "STANDARD")
        & (c("status") == "COMPLETED")
        & (c("decision") == "APPROVED")
        & (as_date("created_at") >= F.lit(since))
    )
    applied = applied.join(known, "user_id", "left_semi")
    applied = applied.select(
        "application_id",
        c("credit_card_report")["AM41"].alias("am41_at_onboarding"),
        c("credit_card_report")["strategyName"].alias("strategy_name"),
    )
    opened = frames["accounts"].filter(c("application_id").isNotNull()).select("account_id", c("application_id").alias("application"))
    return attach(applied, opened, [("application_id", "application")], "inner").distinct()


def latest_statement(statements: DataFrame) -> DataFrame:
    """The account's last statement in dollars."""
    last = latest_per_key(statements, "account_id", "closing_date", [c("statement_id")])
    money = lambda field: F.coalesce(dollars(f"summary.account.{field}"), F.lit(0))
    return last.select(
        "account_id",
        F.to_date("closing_date").alias("statement_close"),
        F.to_date("payment_due_date").alias("payment_due"),
        month_key("closing_date").alias("statement_month"),
        money("purchasesCents").alias("statement_purchase"),
        money("previousBalanceCents").alias("statement_previous"),
        money("paymentsCents").alias("statement_payment"),
        money("creditLimitCents").alias("statement_limit"),
        money("newBalanceCents").alias("statement_balance"),
    )


TODAY = (
    "customer_id", "user_id", "product_type", "day_on_book", "month_on_book", "province", "facility", "frozen_reason",
    "latest_score", "latest_score_band", "original_score", "original_score_band", "credit_limit",
)


def daily_state(account_daily: DataFrame, as_of: dt.date, card_type: str, product: str) -> DataFrame:
    """What the campaign needs of the daily table, one row per account from one read: the states that qualify on
    the day, the worst days past due so far, and users with an open unsecured card the day before. Stored."""
    is_open = c("account_status") == "OPEN"
    today = (c("reference_date") == F.lit(as_of)) & is_open & (c("card_type") == card_type) & (c("product_type") == product) & (c("month_on_book") > 0)
    before = (c("reference_date") == F.date_sub(F.lit(as_of), 1)) & (c("sub_product") == "UNSECURED") & c("card_type").isNotNull() & is_open
    past = account_daily.filter(c("reference_date") <= F.lit(as_of))
    # Days apart from these two share one row of their account, in hash aggregates, before anything is collected.
    marks = past.groupBy("account_id", F.when(today, F.struct(*TODAY)).alias("state"), F.when(before, c("user_id")).alias("user"))
    rows = marks.agg(F.max("days_past_due").alias("worst_dpd")).groupBy("account_id").agg(
        F.collect_set("state").alias("today"), F.max("worst_dpd").alias("worst_dpd"), F.collect_set("user").alias("open_before")
    )
    return durable(rows.filter((F.size("today") > 0) | (F.size("open_before") > 0)), "daily-state")


def _base(frames, daily: DataFrame, as_of: dt.date, brand: str, card_type: str, since: dt.date, thin_strategies) -> DataFrame:
    accounts = daily.select("account_id", "worst_dpd", F.explode("today").alias("state")).select("account_id", "worst_dpd", "state.*")
    rows = attach(accounts, approved_accounts(frames, brand, since), "account_id", "inner")
    for side in (junior_flags(frames["junior_scores"], as_of), transaction_flags(frames["transactions"], as_of, card_type)):
        rows = attach(rows, side, "account_id")
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    change = c("latest_score") - c("original_score")
    return rows.withColumns(
        {
            "confirmed_purchase": flag(c("purchases") > 0),
            "cash_advance": flag(c("cash_advances") >= 1),
            "ever_late": flag(c("worst_dpd") > 0),
            "ever_late_5": flag(c("worst_dpd") > 5),
            "quebec": flag(c("province") == "QC"),
            "latest_above_sub_prime": rules.above_sub_prime("latest_score_band"),
            "original_above_sub_prime": rules.above_sub_prime("original_score_band"),
            "fraud_checks_passed": flag(c("fraud_remove").isNull()),
            "thin_file": flag(c("strategy_name").isin(*thin_strategies)),
            **{name: zero(name) for name in rules.JUNIOR_CUTS},
            "score_movement": rules.score_movement(change),
            "score_change": change,
            "target_segment": rules.target_segment(),
            "two_months_on_book": flag(c("month_on_book") >= 2),
            "band_group": rules.band_group(),
            "user_frozen": flag(c("frozen_reason").isNotNull()),
        }
    )


def redecision(frames, daily: DataFrame, input_order: Sequence[str] = ()) -> DataFrame:
    """Whether today's strategy would approve each user again.

    Of several inputs of a user any one may speak; the choice is repeatable and does not look at
    the outcome: the first by ``input_order``, by default the smallest digest of the input row.
    """
    users = daily.select(F.explode("open_before").alias("user_id")).distinct()
    inputs = frames["redecision_inputs"].filter(c("cvsc100").between(300, 900))
    rejects = {
        "public_record_reject": rules.public_record_reject(),
        "strategy_reject": rules.strategy_reject(),
        "bankruptcy_reject": rules.bankruptcy_reject(),
        "tree_reject": rules.tree_reject(),
    }
    order = [c(x) for x in input_order] or [F.unhex(F.md5(F.to_json(F.struct(*inputs.columns))))]
    # judged where they are read, so that only the outcome and the order travel
    judged = inputs.withColumns(rejects).withColumn("approves", rules.approves())
    judged = judged.select("user_id", "approves", *[x.alias(f"__order{i}") for i, x in enumerate(order)])
    rows = attach(users, judged, "user_id", "inner")
    return dedupe(rows, "user_id", [c(f"__order{i}") for i in range(len(order))]).select("user_id", "approves")


def candidates(
    frames: Mapping[str, DataFrame],
    as_of: dt.date,
    brand: str,
    card_type: str,
    product: str,
    since: dt.date,
    thin_strategies: tuple[str, ...] = (),
    score_name: str = "Junior",
    input_order: Sequence[str] = (),
) -> DataFrame:
    """All candidates with component flags and both waterfalls.

    ``frames`` holds users, applications, accounts, account_daily, junior_scores,
    transactions, bureau, statements, limit_offers, behaviour_scores, redecision_inputs.
    """
    daily = daily_state(frames["account_daily"], as_of, card_type, product)
    rows = _base(frames, daily, as_of, brand, card_type, since, thin_strategies)
    bureau = frames["bureau"].withColumn("__day", F.to_date("credit_report_date", "yyyyMMdd"))
    ties = sortable_columns(frames["bureau"], ["user_id"])
    report = newest(bureau, ["__day", "created_at"], ties, latest_am41=c("am41"), policy_fail=rules.policy_fail())
    # reports are read once: the latest of all, and the latest of those with a file found
    reports = gather("user_id", [(bureau, {"latest": (report, F.min), "hit": (F.when(c("go26") == "H", report), F.min)})])
    rows = attach(rows, reports.select("user_id", "latest.latest_am41", "hit.policy_fail"), "user_id")
    rows = attach(rows, latest_statement(frames["statements"]), "account_id")
    behaviour = latest_per_key(frames["behaviour_scores"], "account_id", "reference_date")
    rows = attach(rows, behaviour.select("account_id", c("model_score").alias("behaviour_score")), "account_id")
    rows = member_flag(rows, frames["limit_offers"], "account_id", "had_cli")
    rows = attach(rows, redecision(frames, daily, input_order), "user_id")
    rows = rows.withColumns(
        {"trades_increased": rules.trades_increased(), "current_strategy_approves": flag(c("approves") == 1), "line_amount": rules.line_amount()}
    ).drop("approves")
    return rows.withColumns({"waterfall": rules.first_waterfall(score_name), "final_waterfall": rules.final_waterfall(score_name)})


def audience(rows: DataFrame, product_label: str) -> DataFrame:
    """Accounts 91 to 178 days on book, never offered before, that pass every exclusion."""
    kept = rows.filter(rules.campaign_window() & (c("had_cli") == 0) & (c("final_waterfall") == rules.FINAL_PASS))
    cols = ["account_id", "month_on_book", "original_score_band", "credit_limit", "line_amount"]
    return kept.select(*cols, F.lit(product_label).alias("brand_product"))


