"""The reactive eligibility table: one adjudicated row per account with a recent statement.

History is needed only for ordinals and lags. Those run on the statement table, then the
frame is cut to the latest statement of each account. The side tables are laid out as one tall
frame per key (account, user), aggregated once and attached once. The daily table, which several
rules read, is reduced to one row per account in a single pass.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.functions import as_date, dollars, flag, floor_at_zero, mob, month_key, safe_ratio
from limitloom.operators import attach, dedupe, lags, latest_per_key, ntile_global, running_ordinal, scan
from limitloom.operators.dedupe import sortable_columns
from limitloom.operators.star import Side, gather, newest
from limitloom.rulesets import reactive as rules
from limitloom.rulesets.brands import Brands
from limitloom.session import durable

c = F.col

# Bureau attributes carried from the month's report, or the latest one where missing.
BUREAU_COLUMNS = (
    "score", "segment_indicator", "go06", "go26", "go91", "pr44", "pr45", "pr124", "pr116", "pr15", "pr50",
    "pr74", "pr75", "pr120", "pr97", "go81", "am36", "bc33", "re33", "re34", "bc34", "bc91",
)


def statement_base(statements: DataFrame) -> DataFrame:
    """Statements in dollars with activity, utilisation and the ordinal among like statements.

    A month with several statements keeps its last; its ordinals are taken before that.
    """
    money = lambda field: F.coalesce(dollars(f"summary.account.{field}"), F.lit(0).cast("decimal(18,2)"))
    rows = statements.select(
        *["statement_id", "account_id", "user_id"],
        F.to_date("opening_date").alias("open_date"),
        F.to_date("closing_date").alias("close_date"),
        (money("paymentsCents") + money("paymentsAndCreditsCents")).alias("payment"),
        money("purchasesCents").alias("purchase"),
        money("previousBalanceCents").alias("previous_balance"),
        money("creditLimitCents").alias("credit_limit"),
        money("generalInterestCents").alias("general_interest"),
        dollars("summary.account.newBalanceCents").alias("new_balance"),
    )
    # One exchange by account serves the ordinals, the months, the lags, the latest statement and the joins by account
    # that follow. Corrected statements may repeat a month many times: a long account is numbered in pieces, before it.
    whole = not scan.long_keys(rows, ["account_id"], ["close_date", "statement_id"])
    rows = rows.repartition("account_id") if whole else rows
    rows = rows.withColumns({"closing_mth": month_key("close_date"), "active_status": rules.active_status()})
    rows = running_ordinal(rows, ["account_id", "active_status"], "close_date", "active_order", None if whole else scan.PIECE_ROWS, ["statement_id"])
    rows = dedupe(rows, ["account_id", "closing_mth"], [c("close_date").desc(), c("statement_id")])
    rows = rows if whole else rows.repartition("account_id")
    return rows.withColumns(
        {
            "open_to_buy": c("credit_limit") - c("new_balance"),
            "utilisation": safe_ratio("new_balance", "credit_limit", default=0),
            "previous_utilisation": safe_ratio("previous_balance", "credit_limit", default=0),
            "revolver_flag": rules.revolver_flag(),
        }
    )


def statement_features(base: DataFrame) -> DataFrame:
    """Three months of lagged balances, payments and flags; account type; payment ratio."""
    rows = base.withColumn("util_flag", rules.utilisation_flag())
    cols = ["revolver_flag", "util_flag", "new_balance", "payment", "previous_balance"]
    rows = lags(rows, ["account_id", "active_status"], "active_order", cols)
    rows = rows.withColumn("consistent_type", rules.consistent_type())
    zero = lambda name: F.coalesce(c(name), F.lit(0))
    rows = rows.withColumns(
        {
            "paid_3m": zero("payment") + zero("payment_1m_prior") + zero("payment_2m_prior"),
            "owed_3m": zero("previous_balance") + zero("previous_balance_1m_prior") + zero("previous_balance_2m_prior"),
            "avg_util_3m": safe_ratio(
                c("new_balance") + c("new_balance_1m_prior") + c("new_balance_2m_prior"), c("credit_limit") * 3
            ),
        }
    )
    return rows.withColumns({"pay_bal_3m": safe_ratio("paid_3m", "owed_3m", default=1), "user_type": rules.user_type()})


def latest_statements(features: DataFrame) -> DataFrame:
    return latest_per_key(features, "account_id", "closing_mth", [])


def _ties(df: DataFrame, *keys: str) -> list[str]:
    return sortable_columns(df, keys)


def bureau_side(bureau: DataFrame, since: str | None = None) -> Side:
    """Reports with the month they were pulled for (missing before the month ``since``); the latest counts, equal ones by their values."""
    pulls = bureau.withColumns(
        {"segment_indicator": c("segment"), "bc34": c("bc34") / 100, "pulled": F.to_date("credit_report_date", "yyyyMMdd")}
    ).withColumn("pull_mth", month_key("pulled"))
    pulls = pulls if since is None else pulls.withColumn("pull_mth", F.when(c("pull_mth") >= since, c("pull_mth")))
    values = ["credit_report_date", *BUREAU_COLUMNS]
    return pulls, {"report": (newest(pulls, ["created_at", "pulled"], values, kept=values), F.min)}


def user_sides(frames: Mapping[str, DataFrame]) -> list[Side]:
    """The latest user record and identity document, and what the user holds open without a deposit."""
    users, accounts, documents = frames["users"], frames["accounts"], frames["id_documents"]
    user = newest(
        users, ["created_at"], ["status", "frozen_reason", "tenant_id"],
        user_status=c("status"), day_end_frozen_reason=c("frozen_reason"), tenant_id=c("tenant_id"), province=c("physicalAddress.province"),
        field_of_study=rules.student_field_flag(c("employmentInfo.employmentStatus"), c("employmentInfo.fieldOfStudy")),
        cardmember_type=F.when(c("type") != "TEST", c("type")), email_id=F.when(c("type") != "TEST", F.concat_ws('"', "emails.email")),
    )
    unsecured = (c("status") == "OPEN") & c("secured_deposit_id").isNull()
    document = newest(documents, ["completed_at"], _ties(documents, "user_id", "completed_at"), issued_by=F.coalesce("issuing_country", "id_issuer"))
    return [
        (users, {"user": (user, F.min)}),
        (accounts.filter(unsecured), {"n_unsecured": (F.lit(1), F.sum), "n_world": (flag(c("tier").like("WORLD%")), F.sum)}),
        (documents, {"document": (document, F.min)}),
    ]


def with_user(rows: DataFrame, frames: Mapping[str, DataFrame], since: str | None = None) -> DataFrame:
    """What is known of the user, and bureau attributes of the statement's month, column by column from the latest report where missing.

    ``since`` is a month ('2025-01') no row's statement closed before: earlier reports can then only be the latest one, and share a row.
    """
    # a row per user and report month first, then one per user with the months as a map
    monthly = gather(["user_id", "pull_mth"], [bureau_side(frames["bureau"], since), *user_sides(frames)])
    by_month = F.map_from_entries(F.collect_list(F.when(c("pull_mth").isNotNull() & c("report").isNotNull(), F.struct("pull_mth", "report"))))
    users = monthly.groupBy("user_id").agg(
        F.min("report").alias("latest"), by_month.alias("reports"), F.min("user").alias("user"), F.min("document").alias("document"),
        F.sum("n_unsecured").alias("n_unsecured"), F.sum("n_world").alias("n_world"),
    )
    rows = attach(rows, users, "user_id").withColumn("report", F.try_element_at("reports", c("closing_mth")))
    filled = [F.coalesce(c("report")[x], c("latest")[x]).alias(x) for x in BUREAU_COLUMNS]
    # a pull date travels with the score it dates
    pulled = F.when(c("report.score").isNull(), c("latest.credit_report_date")).otherwise(c("report.credit_report_date"))
    user = ("user_status", "day_end_frozen_reason", "tenant_id", "province", "field_of_study", "cardmember_type", "email_id")
    known = [*[c("user")[x].alias(x) for x in user], c("document.issued_by").alias("issued_by"), pulled.alias("credit_report_date"), *filled]
    return rows.select("*", *known).drop("report", "reports", "latest", "user", "document")


# Pairs of a status and a charge-off reason that are broadcast at most; there are a handful.
STATUS_PAIRS = 10_000


def daily_summary(account_daily: DataFrame, as_of: dt.date) -> DataFrame:
    """What the rules need of the daily table, per unsecured account, in one pass of hash aggregates.

    Everything compared or carried is a number of fixed width: a day and a count share a long, and texts
    travel as the hash of their pair, which a small table of the pairs that occur turns back. Records of
    one day are told apart by days past due, then by a hash of their values.
    """
    rows = account_daily.filter(c("sub_product") == "UNSECURED")
    late, late_days = c("days_past_due") > 0, c("days_past_due")
    pack = lambda high, low: F.shiftleft(high.cast("long"), 32) + low.cast("long")
    high = lambda name: F.shiftright(name, 32).cast("int")
    low = lambda name: c(name).bitwiseAND(0xFFFFFFFF).cast("int")
    day, pair = F.unix_date("reference_date"), F.xxhash64("account_status", "charged_off_reason")
    # day (from 1970), days past due up to 2**14 (missing lowest), and 31 bits of the record's hash
    told = F.shiftleft(day.cast("long"), 45) + F.shiftleft(F.least(F.coalesce(late_days + 1, F.lit(0)), F.lit(16383)).cast("long"), 31)
    order = told + F.xxhash64("credit_limit", "account_status", "charged_off_reason").bitwiseAND(0x7FFFFFFF)
    window = (c("reference_date") <= F.lit(as_of)) & (c("reference_date") > F.date_sub(F.lit(as_of), 100))
    out = rows.groupBy("account_id").agg(
        F.max_by("credit_limit", order).alias("day_end_limit"),
        F.max_by(late_days, order).alias("day_end_dpd"),
        F.max_by(pair, order).alias("pair"),
        F.max(F.when(late, pack(day, late_days))).alias("last_late"),
        F.max(F.when(late, pack(late_days, day))).alias("worst"),
        F.max(F.when(window, late_days)).alias("dpd_100_days"),
    )
    pairs = rows.groupBy(c("account_status").alias("day_end_status"), c("charged_off_reason").alias("day_end_charge_off")).count().drop("count")
    pairs = durable(pairs.withColumn("known_pair", F.xxhash64("day_end_status", "day_end_charge_off")), "status-pairs")
    out = attach(out, F.broadcast(pairs) if pairs.limit(STATUS_PAIRS + 1).count() <= STATUS_PAIRS else pairs, [("pair", "known_pair")])
    return out.select(
        "account_id", "day_end_limit", "day_end_status", "day_end_dpd", "day_end_charge_off",
        F.date_from_unix_date(high("last_late")).alias("late_until"),
        low("last_late").alias("late_dpd"),
        high("worst").alias("worst_dpd"),
        F.date_sub(F.date_from_unix_date(low("worst")), high("worst")).alias("worst_from"),
        "dpd_100_days",
        F.lit("UNSECURED").alias("account_type"),
    )


def restriction_side(adjustments: DataFrame) -> Side:
    """Restrictions and reversals, plain and high-risk; a restricted kind an account lacks counts 0 if it has any."""
    kinds = {"restricted": "CREDIT_LIMIT_RESTRICTION", "risk_restricted": "HRAM_CREDIT_LIMIT_RESTRICTION"}
    values = {}
    for name, reason in kinds.items():
        undone, reversed_name = c("reason") == f"{reason}_REVERSED", name.replace("restricted", "reversed")
        values |= {
            f"n_{name}": (flag(c("reason") == reason), F.sum),
            f"n_{reversed_name}": (flag(undone), F.sum),
            f"last_{reversed_name}_at": (F.when(undone, c("as_of_ts")), F.max),
        }
    return adjustments.filter(c("type") == "CREDIT_LIMIT"), values


# Facilities that are broadcast at most; more are joined by shuffle.
FACILITIES = 1_000_000


def account_sides(frames: Mapping[str, DataFrame], as_of_ts: Column, blocking: Sequence[str]) -> list[Side]:
    accounts, decreases, cards, balances = (frames[x] for x in ("accounts", "limit_decreases", "cards", "balances"))
    facilities = frames["facilities"]
    facilities = F.broadcast(facilities) if facilities.limit(FACILITIES + 1).count() <= FACILITIES else facilities
    facility = attach(frames["facility_accounts"], facilities, "facility_id", "inner")
    recent = F.timestamp_diff("DAY", c("applied_at"), as_of_ts) <= rules.COOL_OFF_DAYS
    ties = _ties(decreases, "account_id", "initiated_at")
    cut = newest(decreases, ["initiated_at"], ties, at=c("initiated_at"), cents=c("previous_limit_cents"), dollars=F.expr("previous_limit_cents div 100"))
    of = lambda strategy, dated: F.when((c("strategy") == strategy) & (c("initiated_at").isNotNull() if dated else c("initiated_at").isNull()), cut)
    opened = newest(accounts, [], _ties(accounts, "account_id"), opened_on=F.to_date("created_at"), closed_on=F.to_date("close_date"))
    return [
        (accounts, {"opened": (opened, F.min)}),
        (
            decreases,
            {
                "cld_blocked": (flag(c("strategy").isin(*blocking) & recent), F.max),
                "inactive": (of(rules.INACTIVE_DECREASE, True), F.min),
                "inactive_undated": (of(rules.INACTIVE_DECREASE, False), F.min),
                "low_use": (of(rules.LOW_USE_DECREASE, True), F.min),
            },
        ),
        (frames["limit_offers"], {"last_offer_on": (F.to_date("initiated_at"), F.max), "last_accepted": (c("accepted_at"), F.max)}),
        (cards, {"card": (newest(cards, ["created_at"], _ties(cards, "account_id"), brand=c("brand")), F.min)}),
        (facility, {"place": (newest(facility, [], _ties(facility, "account_id"), facility=c("name")), F.min)}),
        (balances, {"balance": (newest(balances, ["created_at"], _ties(balances, "account_id"), cents=c("total_balance_cents")), F.min)}),
        restriction_side(frames["limit_adjustments"]),
        (frames["control_group"].filter(c("type") == "CONTROL"), {"prior_control_group": (F.lit(1), F.max)}),
    ]


def with_account(rows: DataFrame, frames: Mapping[str, DataFrame], as_of: dt.date, as_of_ts: Column, blocking: Sequence[str]) -> DataFrame:
    """Snapshots of the account. A decrease counts while no offer was accepted after it; if the latest is undone, so are the earlier ones."""
    rows = attach(rows, gather("account_id", account_sides(frames, as_of_ts, blocking)), "account_id")
    stands = lambda name: c(f"{name}.at").isNotNull() & ~F.coalesce(c("last_accepted") > c(f"{name}.at"), F.lit(False))
    inactive = F.coalesce(F.when(stands("inactive"), c("inactive.dollars")), c("inactive_undated.dollars"))
    undone = stands("low_use") & (as_date("low_use.at") >= F.date_sub(F.lit(as_of), 30))
    return rows.withColumns(
        {
            "opened_on": c("opened.opened_on"),
            "closed_on": c("opened.closed_on"),
            "brand": c("card.brand"),
            "facility": c("place.facility"),
            "latest_balance": dollars("balance.cents"),
            "old_limit": inactive,
            "cld_population": flag(stands("inactive") | c("inactive_undated").isNotNull()),
            "undone_cents": F.when(undone, c("low_use.cents")),
            "has_undone": flag(undone),
            "cld_blocked": F.coalesce("cld_blocked", F.lit(0)),
            "prior_control_group": F.coalesce("prior_control_group", F.lit(0)),
            # the log marks the statement it speaks of, and holds no other
            "account_latest_entry": F.lit(1),
        }
    ).drop("opened", "card", "place", "balance", "inactive", "inactive_undated", "low_use", "last_accepted")


def eligibility_inputs(frames: Mapping[str, DataFrame], as_of: dt.date, drop_test_users: bool = False, blocking: Sequence[str] = rules.BLOCKING_DECREASES) -> DataFrame:
    """One row per account with a statement closed within a month, with every flag.

    ``frames`` holds statements, statement_adb, accounts, bureau, users, account_daily,
    limit_offers, limit_decreases, cards, facility_accounts, facilities, balances,
    control_group, limit_adjustments, id_documents. Test users stay in, as in the eligibility log;
    ``drop_test_users`` takes them out. ``blocking`` names the decrease strategies that block an increase.

    Snapshots are attached once by account, once by statement and once by user.
    """
    # Days are counted from 8:00 on the run date, where the log's clock stands.
    as_of_ts = F.lit(dt.datetime.combine(as_of, dt.time(8))).cast("timestamp")
    rows = latest_statements(statement_features(statement_base(frames["statements"])))
    rows = rows.withColumn("statement_age_months", mob("close_date", as_of)).filter(c("statement_age_months") <= 1)
    # Days on the daily table: the account must be unsecured.
    rows = attach(rows, daily_summary(frames["account_daily"], as_of), "account_id", "inner")
    rows = with_account(rows, frames, as_of, as_of_ts, blocking)
    rows = attach(rows, frames["statement_adb"].select("statement_id", dollars("adb").alias("adb")), "statement_id")
    # A statement at most a month old closed in the month before the run's or later; one more to be safe.
    months = as_of.year * 12 + as_of.month - 3
    rows = with_user(rows, frames, f"{months // 12:04d}-{months % 12 + 1:02d}")
    if drop_test_users:
        rows = rows.filter(c("cardmember_type").isNotNull())

    rows = rows.withColumns(
        {
            "mob_rounded": F.round(mob("opened_on", "close_date"), 0),
            "bureau_score_clean": floor_at_zero("score"),
            "days_past_due": F.when((c("close_date") < c("late_until")) | c("late_until").isNull(), c("late_dpd")),
            "max_dpd_3m": F.when(c("worst_from") >= F.add_months("close_date", -3), c("worst_dpd")),
            "last_cli_months": mob("last_offer_on", as_of),
            "cld_block": 1 - c("cld_blocked"),
            "charged_off": rules.charge_off_flag(),
            "province_group": rules.province_group(),
            "standing": rules.standing(),
            "restriction": rules.restriction_flag(as_of_ts),
        }
    ).withColumn("policy_exclusion", rules.policy_exclusion())
    score, months = c("bureau_score_clean"), c("last_cli_months")
    balances = [c("new_balance") > 0, c("new_balance_1m_prior") > 0, c("new_balance_2m_prior") > 0]
    consistent = c("consistent_type") == "Consistent Transactor"
    return rows.withColumns(
        {
            # Elapsed months are fractional, so this holds on exact months only; kept as the log has it.
            "cli_offered_3m": flag(months.isin(0.0, 1.0, 2.0, 3.0)),
            "transactor_flag": flag(consistent & balances[0] & balances[1] & balances[2]),
            "sub_prime_flag": flag((score >= 600) & (score < 700)),
            "not_frozen": flag(c("user_status") == "ACTIVE"),
            "policy_exclusion_flag": rules.policy_exclusion_flag(),
            "currently_delinquent": flag(c("days_past_due") > 0),
            "delinquent_3m": flag(c("max_dpd_3m") >= 30),
            "payment_flag": rules.payment_flag(),
            "inquiry_flag": flag(c("go06") >= 3),
            "am36_flag": flag((c("am36") >= 12) | c("am36").isNull()),
            "sp_limit_flag": 1 - flag((score < 700) & (c("credit_limit") > 3000)),
            "score_flag": flag((score >= 600) & (score <= 900)),
            "bureau_segment_flag": flag(c("segment_indicator").isin(*rules.WEAK_SEGMENTS)),
            "recent_cli": flag(months <= 3),
            "over_limit": rules.over_limit(),
            "over_limit_20": rules.over_limit(share=1.2),
            "delinquent_100_days": flag(c("dpd_100_days") >= 30),
        }
    )


def pass_through(inputs: DataFrame, brands: Brands) -> tuple[DataFrame, DataFrame]:
    """Accounts whose low-use decrease of the last 30 days may be undone, with their offer, and the others."""
    gates = (
        (c("not_frozen") == 1)
        & (c("policy_exclusion_flag") == 0)
        & (c("currently_delinquent") == 0)
        & (c("bureau_score_clean") >= 600)
        & (c("go26") == "H")
        & (c("standing") == rules.GOOD_STANDING)
        & (c("last_cli_months").isNull() | (c("last_cli_months") >= 3))
    )
    passes = F.coalesce(gates & (c("has_undone") == 1), F.lit(False))
    rows = inputs.filter(passes).withColumn("previous_limit_cents", c("undone_cents")).withColumns(
        {
            "segment": F.lit("Active CLD"),
            "strategy_type": F.lit("Active CLD"),
            "eligible": F.lit(1),
            "new_limit_cents": rules.restored_limit_cents(),
            "offer_code": rules.offer_code(brands, F.lit(rules.PASS_THROUGH_CODE)),
        }
    )
    return rows, inputs.filter(~passes)


def standard(rows: DataFrame, brands: Brands) -> DataFrame:
    """The other accounts: segment, both ladders, an even split between them, offer code."""
    rows = rows.withColumn("segment", rules.segment())
    rows = rows.withColumns({"cons_limit": rules.conservative_limit(), "agg_limit": rules.aggressive_limit()})
    rows = ntile_global(rows, "account_id", 2)
    rows = rows.withColumns({"new_limit_cents": rules.new_limit_cents(), "eligible": rules.eligible()})
    return rows.withColumns(
        {
            "strategy_type": rules.strategy_type(),
            "new_limit_cents": rules.capped_limit_cents(),
            "offer_code": rules.offer_code(brands, rules.segment_code()),
        }
    )


OUTPUT = (
    "account_id", "user_id", "last_cli_months", "cli_offered_3m", "transactor_flag", "user_type", "sub_prime_flag", "not_frozen",
    "policy_exclusion_flag", "currently_delinquent", "delinquent_3m", "payment_flag", "inquiry_flag", "am36_flag", "sp_limit_flag",
    "score_flag", "bureau_segment_flag", "recent_cli", "account_type", "day_end_limit", "score", "day_end_status", "day_end_frozen_reason",
    "day_end_dpd", "day_end_charge_off", "standing", "brand", "facility", "latest_balance", "over_limit", "over_limit_20",
    "delinquent_100_days", "prior_control_group", "go26", "field_of_study", "province_group", "restriction", "active_status", "segment",
    "strategy_type", "eligible", "new_limit_cents", "offer_code", "mob_rounded", "credit_limit", "cld_block", "bureau_score_clean",
    "account_latest_entry",
)


def final_overrides(rows: DataFrame, brands: Brands) -> DataFrame:
    """Partner-brand, multi-account, world-tier and foreign-document accounts lose their offer."""
    rows = rows.withColumn("override", rules.override(brands))
    kept = c("override").isNull()
    return rows.withColumns(
        {
            "segment": F.coalesce("override", "segment"),
            "eligible": F.when(kept, c("eligible")).otherwise(0),
            "new_limit_cents": F.when(kept, c("new_limit_cents")).otherwise(F.lit(0).cast("bigint")),
            "offer_code": F.when(kept, c("offer_code")),
        }
    )


def eligibility(frames: Mapping[str, DataFrame], as_of: dt.date, brands: Brands, drop_test_users: bool = False) -> DataFrame:
    """The eligibility rows of one run, ready for the audience log.

    The inputs hold all that the later steps need and are stored once: the pass-through, the split and the
    result are filters and columns over one row per account.
    """
    blocking = (*rules.BLOCKING_DECREASES, *brands.blocking_decreases)
    inputs = durable(eligibility_inputs(frames, as_of, drop_test_users, blocking), "eligibility-inputs")
    passed, others = pass_through(inputs, brands)
    columns = [*OUTPUT, "n_unsecured", "n_world", "issued_by"]
    # one row per account on either side and no account on both, so the union has no duplicates
    both = standard(others, brands).select(*columns).unionByName(passed.select(*columns))
    return final_overrides(both, brands).select(*OUTPUT)
