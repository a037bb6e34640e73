"""Whole-portfolio stand-ins: the source tables of the ready pipelines.

Same idea as `limitloom.sources.standins`: every table is derived from whole driver tables
by SQL both engines read. Attributes the driver tables lack are spread by remainders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limitloom.session import durable
from limitloom.sources.standins import add_views, standin

_USER = "1000000 + case when mod({0}, 20) = 1 then {0} - 1 else {0} end"
_COUNTS = {"pr44": 103, "pr45": 107, "pr124": 109, "pr116": 113, "pr15": 127, "pr50": 131, "pr74": 137, "pr75": 139, "pr120": 149, "pr97": 151, "go81": 157}
_RECORDS = ", ".join(f"case when mod(d, {m}) = 0 then 1 else 0 end as {name}" for name, m in _COUNTS.items())

add_views(
    {
        "flat_statements": f"""
select cast(account_id as string) || '/' || stmt_mth as statement_id, account_id, {_USER.format("account_id")} as user_id,
       cast(stmt_date - 6 as string) as opening_date, cast(stmt_date + 24 as string) as closing_date,
       mod(v, 500) * 100 as payments_cents, mod(v, 7) * 100 as credits_cents, mod(v, 3) * mod(v, 800) * 100 as purchases_cents,
       mod(v, 5) * mod(v, 900) * 100 as previous_cents, (200 + mod(account_id * 37, 9500)) * 100 as limit_cents,
       mod(v, 4) * mod(v, 1200) * 100 as balance_cents, case when mod(account_id, 3) = 0 then mod(v, 2) * 100 else 0 end as interest_cents,
       case when mod(v, 10) <> 0 then mod(v, 1000) * 100 end as adb_cents
from (select account_id, stmt_date, stmt_mth, cast(floor(bfc) as bigint) as v from {{performance}}) where stmt_date < date '2001-08-01'""",
        "credit_accounts": f"""
select account_id, {_USER.format("account_id")} as user_id, case when mod(account_id, 17) = 0 then 'CLOSED' else 'OPEN' end as status,
       case when mod(account_id, 29) = 0 then 'WORLD_ELITE' else 'STANDARD' end as tier,
       case when mod(account_id, 31) = 0 then 'deposit' end as secured_deposit_id,
       cast(date '1995-01-01' + cast(mod(account_id * 13, 2380) as int) as timestamp) as created_at,
       case when mod(account_id, 41) = 0 then cast(date '2001-07-01' + cast(mod(account_id, 60) as int) as timestamp) end as close_date
from {{accounts}}""",
        "bureau_reports": f"""
select {_USER.format("account_id")} as user_id, replace(cast(offer_date as string), '-', '') as credit_report_date,
       cast(offer_date as timestamp) as created_at, cast(case when mod(d, 43) = 0 then null else 590 + mod(d, 311) end as int) as score,
       cast(1 + mod(d, 37) as int) as segment, cast(case when mod(offer_id, 17) = 0 then 3 else 1 end as int) as go06,
       case when mod(offer_id, 31) = 0 then 'N' when mod(offer_id, 47) = 0 then null else 'H' end as go26,
       case when mod(offer_id, 101) = 0 then 'Y' else 'N' end as go91,
       cast(case when mod(d, 59) < 3 then 6 when mod(d, 59) = 4 then null else 24 end as int) as am36,
       cast(mod(d, 9) as int) as bc33, cast(mod(d, 90) as int) as re33, cast(mod(d, 110) as int) as re34, cast(mod(d, 130) as int) as bc34,
       cast(mod(d, 4) as int) as bc91, cast(mod(d, 3) as int) as am41, {_RECORDS}
from (select *, cast(floor(offer_limit) as bigint) as d from {{offers}})""",
        "portfolio_users": """
select user_id, case when mod(account_id, 50) = 0 then 'TEST' when mod(account_id, 51) = 0 then null else 'CUSTOMER' end as type,
       case when mod(account_id, 23) = 0 then 'FROZEN' else 'ACTIVE' end as status,
       case when mod(account_id, 37) = 0 then 'FRAUD' end as frozen_reason, 't-' || cast(mod(account_id, 10) as string) as tenant_id,
       created_at, case when mod(account_id, 4) = 0 then 'QC' else 'ON' end as province,
       case when mod(account_id, 6) = 0 then 'STUDENT' else 'EMPLOYED' end as employment,
       case when mod(account_id, 12) = 0 then 'Hospitality, Food and Tourism' else 'Arts' end as field
from {credit_accounts} where user_id = 1000000 + account_id""",
        "daily_accounts": """
select account_id, reference_date, case when mod(account_id, 47) = 0 then 'SECURED' else 'UNSECURED' end as sub_product,
       case when mod(mark, 40) = 0 then least(dpd, 90) when mod(mark, 3) = 0 and mod(account_id, 4) = 0 then 0 end as days_past_due,
       cast(200 + mod(account_id * 37, 9500) as decimal(18,2)) as credit_limit,
       case when mod(mark, 61) = 0 then 'CLOSED' else 'OPEN' end as account_status,
       case when mod(mark, 67) = 0 then 'BANKRUPT' else 'N/A' end as charged_off_reason
from (select account_id, reference_date, max(part_key) as mark, max(dpd) as dpd from {daily} group by account_id, reference_date)""",
        "sent_offers": f"""
select offer_id, account_id, {_USER.format("account_id")} as user_id, cast(offer_date as timestamp) as initiated_at,
       case when status = 'F' then cast(offer_date + 2 as timestamp) end as accepted_at,
       case mod(offer_id, 9) when 0 then 'QC-RPL' when 1 then 'HIGH-PRTV' else 'STD' end as strategy
from {{offers}} where status <> 'O'""",
        "sent_decreases": """
select account_id, case mod(offer_id, 3) when 0 then 'INACTIVE_CLD' when 1 then 'LOW-UTIL' else 'CLD_HIGH_RISK' end as strategy,
       cast(offer_date as timestamp) as initiated_at, cast(offer_date + 1 as timestamp) as applied_at,
       mod(cast(floor(offer_limit) as bigint), 9000) * 100 as previous_limit_cents, offer_id
from {offers} where status = 'O'""",
        "account_cards": """
select account_id, case brand when 'BUILDING' then 'PARTNER' when 'MACHINERY' then 'OTHER' else 'CORE' end as brand, nation_key,
       cast(date '1995-01-01' as timestamp) as created_at from {accounts}""",
        "account_balances": """
select account_id, mod(cast(floor(cof * 100) as bigint), 1200000) as total_balance_cents, cast(stmt_date as timestamp) as created_at
from {performance}""",
        "adjustments": """
select account_id, 'CREDIT_LIMIT' as type, cast(offer_date as timestamp) as as_of_ts,
       case mod(offer_id, 20) when 0 then 'CREDIT_LIMIT_RESTRICTION' when 5 then 'CREDIT_LIMIT_RESTRICTION_REVERSED'
            when 10 then 'HRAM_CREDIT_LIMIT_RESTRICTION' when 15 then 'HRAM_CREDIT_LIMIT_RESTRICTION_REVERSED' else 'INCREASE' end as reason
from {offers}""",
        "documents_seen": """
select user_id, account_id, case when mod(account_id, 21) = 0 then 'US' when mod(account_id, 5) = 0 then null else 'CA' end as issuing_country,
       case when mod(account_id, 35) = 0 then null else 'CA-ON' end as id_issuer, created_at as completed_at from {credit_accounts}""",
    }
)

# Requests, their offers, and the score histories of the studies.
add_views(
    {
        "requests": f"""
select offer_id as request_id, {_USER.format("account_id")} as user_id, account_id, case when mod(offer_id, 7) <> 0 then offer_id end as offer_id,
       cast(offer_date as timestamp) as created_at from {{offers}}""",
        "offer_book": """
select offer_id, case mod(offer_id, 9) when 0 then 'QC-RPL' when 1 then 'HIGH-PRTV' when 2 then null else 'STD' end as strategy,
       case mod(offer_id, 2) when 0 then 'user' else 'agent' end as actioned_by, cast(offer_date as timestamp) as created_at,
       case when status = 'F' then cast(offer_date + 3 as timestamp) end as accepted_at,
       case when status = 'O' and mod(d, 2) = 0 then cast(offer_date + 5 as timestamp) end as declined_at,
       mod(d, 4000) * 100 as limit_cents_at_offer, (mod(d, 4000) + mod(d, 9001)) * 100 as offered_limit_cents
from (select *, cast(floor(offer_limit) as bigint) as d from {offers})""",
        "wide_performance": """
select p.account_id, p.stmt_mth, p.stmt_date, p.raim, p.bfc, p.cof, p.guco, p.secure_type, a.brand,
       case mod(p.account_id, 3) when 0 then 'WORLD_ELITE' when 1 then 'WORLD' else 'STANDARD' end as card_type,
       case mod(p.account_id, 5) when 0 then '1. SUBPRIME' when 1 then '2. NEAR_PRIME' when 2 then '3. PRIME' when 3 then '4. PRIME_PLUS'
            else '5. SUPER_PRIME' end as tu_band,
       cast(mod(p.account_id * 37, 9000) as decimal(12,2)) as cl, date '1994-01-01' + cast(mod(p.account_id * 7, 900) as int) as booking_date,
       'B' || cast(least(p.late_lines, 7) as string) as dpd_bucket
from {performance} p join {accounts} a on a.account_id = p.account_id""",
        "month_scores": """
select account_id, cast(stmt_date as timestamp) as reference_date, cast(mod(cast(floor(bfc) as bigint), 111) as double) / 100 as prediction
from {performance}""",
        "offer_scores": """
select account_id, cast(offer_date as timestamp) as reference_date,
       cast(max(case when mod(offer_id, 9) <> 0 then mod(cast(floor(offer_limit) as bigint), 101) end) as double) / 100 as prediction
from {offers} group by account_id, offer_date""",
        "behaviour_history": """
select account_id, cast(stmt_date + 14 as timestamp) as reference_date, cast(500 + mod(cast(floor(cof) as bigint), 300) as double) as model_score
from {performance}""",
        "bankruptcy_history": f"""
select {_USER.format("account_id")} as user_id, cast(make_date(year(offer_date), month(offer_date), 9) as timestamp) as reference_date,
       cast(600 + max(mod(cast(floor(offer_limit) as bigint), 160)) as double) as score
from {{offers}} group by {_USER.format("account_id")}, make_date(year(offer_date), month(offer_date), 9)""",
        "marked_accounts": "select account_id from {accounts} where mod(account_id, 13) = 0",
    }
)

# What strong files hold instead of a candidate's own values.
_STRONG = {"segment": "'THICK'", "cvsc100": "700", "am41": "0", "am42": "0", "am43": "0", "am84": "0", "go11": "99", "re34": "10", "dti": "10", "pr51": "0", "bko": "720", "thick": "530"}
_REDECISION = ["segment", "cvsc100", "go14", "at01", "am41", "am42", "am43", "am84", "go11", "pr51", "bc147", "go06", "go149", "go141", "pr11", "am02"]
_REDECISION += ["re34", "dti", "bko", "thick", "thin", "subprime", "go91", *_COUNTS]
_STRATEGY_INPUTS = ", ".join(f"case when mod(account_id, 4) <> 0 then {_STRONG[x]} else {x} end as {x}" if x in _STRONG else x for x in _REDECISION)

# The early-tenure campaign: a snapshot for the run day and the day before it on top of the
# past daily rows, card transactions, applications and re-decision inputs.
_BANDS = """case when {0} < 640 then 'b. Sub Prime (300 to 639)' when {0} < 720 then 'c. Near-Prime (640 to 719)'
       when {0} < 760 then 'd. Prime (720 to 759)' when {0} < 800 then 'e. Prime+ (760 to 799)' else 'f. Super Prime (800+)' end"""

add_views(
    {
        "campaign_daily": f"""
select account_id, reference_date, user_id, account_id + 5000000 as customer_id,
       case when mod(account_id, 19) = 0 then 'SECURED CREDIT' else 'WORLD CREDIT' end as product_type, 'UNSECURED' as sub_product,
       case when mod(account_id, 37) = 0 then 'STANDARD' else 'WORLD' end as card_type,
       case when mod(account_id, 43) = 0 then 'CLOSED' else 'OPEN' end as account_status,
       cast(mod(account_id * 11, 140) as int) + 60 as day_on_book, cast(floor(mod(account_id * 11, 140) / 30) as int) + 1 as month_on_book,
       case when mod(account_id, 4) = 0 then 'QC' else 'ON' end as province, 'F' || cast(mod(account_id, 3) as string) as facility,
       case when mod(account_id, 47) = 0 then 'FRAUD' end as frozen_reason, cast(score1 as int) as latest_score,
       {_BANDS.format("score1")} as latest_score_band, cast(score0 as int) as original_score, {_BANDS.format("score0")} as original_score_band,
       cast(500 + mod(account_id * 37, 2500) as decimal(18,2)) as credit_limit, days_past_due
from (select d.account_id, d.reference_date, d.days_past_due, {_USER.format("d.account_id")} as user_id,
             640 + mod(d.account_id * 7, 230) as score0, 640 + mod(d.account_id * 7, 230) + mod(d.account_id, 91) - 30 as score1
      from (select account_id, date '2001-08-01' as reference_date, cast(null as int) as days_past_due from {{accounts}}
            union all select account_id, date '2001-07-31', cast(null as int) from {{accounts}}
            union all select account_id, reference_date, cast(case when mod(mark, 300) = 0 then least(dpd, 90) end as int)
            from (select account_id, reference_date, max(part_key) as mark, max(dpd) as dpd from {{daily}}
                  where reference_date < date '2001-07-31' group by account_id, reference_date)) d)""",
        "card_transactions": """
select account_id, case when mod(part_key, 97) = 0 then 'CASH_ADVANCE' when return_flag = 'N' then 'PURCHASE' else 'PAYMENT' end as category,
       case when mod(part_key, 5) = 0 then 'PENDING' else 'CONFIRMED' end as status, case when mod(part_key, 89) = 0 then 'FRAUD_SUSPECTED'
       when mod(part_key, 88) = 0 then 'NO_FUNDS' end as decline_reason, 'OPEN' as account_status, 'WORLD' as card_type,
       case when mod(part_key, 37) = 0 then 'false' else 'true' end as trusted_payment, cast(ship_date as timestamp) as authorized_at,
       cast(price * 0.05 as decimal(18,2)) as amount from {lines}""",
        "card_applications": f"""
select account_id, 'app-' || cast(account_id as string) as application_id, {_USER.format("account_id")} as user_id,
       case when mod(account_id, 7) = 0 then 'PARTNER' else 'CORE' end as brand, 'STANDARD' as type, 'COMPLETED' as status,
       case when mod(account_id, 53) = 0 then 'DECLINED' else 'APPROVED' end as decision,
       cast(date '2001-01-15' + cast(mod(account_id, 100) as int) as timestamp) as created_at,
       cast(cast(mod(account_id, 3) as int) as string) as am41, case when mod(account_id, 10) = 0 then 'thin-baseline' else 'thick' end as strategy_name
from {{accounts}}""",
        "junior_history": """
select account_id, cast(stmt_date + 14 as timestamp) as reference_date, '2.1' as model_version,
       cast(mod(cast(floor(bfc) as bigint), 25) as double) / 200 as prediction from {performance}""",
        # one account in 20 has inputs of nobody; several offers of an account are several inputs; three in four are strong
        "strategy_inputs": f"""
select case when mod(account_id, 20) <> 1 then {_USER.format("account_id")} end as user_id, account_id, offer_id, {_STRATEGY_INPUTS} from {{candidates}}""",
        # offers from before an account was opened are nobody's
        "account_offers": """
select offer_id, case when offer_date >= date '2001-08-01' - (cast(mod(account_id * 11, 140) as int) + 60) then account_id end as account_id,
       cast(offer_date as timestamp) as initiated_at from {offers}""",
    }
)


def campaign_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The input frames of `limitloom.plans.early_campaign`."""
    known = _with_stored_lines(spark, sf_dir)
    get = lambda name: standin(spark, sf_dir, name, known)
    applications = get("card_applications")
    report = F.create_map(F.lit("AM41"), F.col("am41"), F.lit("strategyName"), F.col("strategy_name")).alias("credit_card_report")
    return {
        "users": get("portfolio_users").select("user_id", "type"),
        "applications": applications.select("application_id", "user_id", "brand", "type", "status", "decision", "created_at", report),
        "accounts": applications.select("account_id", "application_id"),
        "account_daily": get("campaign_daily"),
        "junior_scores": get("junior_history"),
        "transactions": get("card_transactions"),
        "bureau": get("bureau_reports"),
        "statements": statement_documents(get("flat_statements")).withColumn("payment_due_date", F.col("closing_date")),
        "limit_offers": get("account_offers"),
        "behaviour_scores": get("behaviour_history"),
        "redecision_inputs": get("strategy_inputs").select("user_id", *_REDECISION, F.col("offer_id").alias("input_id")),
    }


def _with_stored_lines(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Known frames holding the line items with their account as a stored table.

    Daily rows, transactions and monthly performance derive from it, and each would otherwise
    send all line items through a join of its own.
    """
    return {"lines": durable(standin(spark, sf_dir, "lines"), "lines")}


# What statements, balances and scores read of the monthly performance.
_MARGIN_PARTS = ("account_id", "stmt_date", "stmt_mth", "bfc", "cof")


def _with_stored_performance(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Known frames holding the monthly performance as a stored table of the columns read from it.

    A portfolio keeps it as one; statements, balances and scores derive from it here, and
    each would otherwise repeat the join and aggregation over all line items.
    """
    return {"performance": durable(standin(spark, sf_dir, "performance").select(*_MARGIN_PARTS), "performance")}


def statement_documents(flat: DataFrame) -> DataFrame:
    """The flat statements as nested documents, the shape the pipelines read."""
    fields = {
        "paymentsCents": "payments_cents",
        "paymentsAndCreditsCents": "credits_cents",
        "purchasesCents": "purchases_cents",
        "previousBalanceCents": "previous_cents",
        "creditLimitCents": "limit_cents",
        "newBalanceCents": "balance_cents",
        "generalInterestCents": "interest_cents",
    }
    account = F.struct(*[F.col(flat_name).alias(name) for name, flat_name in fields.items()])
    return flat.select("statement_id", "account_id", "user_id", "opening_date", "closing_date", F.struct(account.alias("account")).alias("summary"))


def portfolio(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The input frames of `limitloom.plans.reactive_eligibility`."""
    known = _with_stored_performance(spark, sf_dir)
    known["daily_accounts"] = durable(standin(spark, sf_dir, "daily_accounts", known), "daily")
    get = lambda name: standin(spark, sf_dir, name, known)
    users = get("portfolio_users")
    users = users.select(
        *["user_id", "type", "status", "frozen_reason", "tenant_id", "created_at"],
        F.array(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"))).alias("emails"),
        F.struct("province").alias("physicalAddress"),
        F.struct(F.col("employment").alias("employmentStatus"), F.col("field").alias("fieldOfStudy")).alias("employmentInfo"),
    )
    cards = get("account_cards")
    return {
        "statements": statement_documents(get("flat_statements")),
        "statement_adb": get("flat_statements").select("statement_id", F.col("adb_cents").alias("adb")),
        "accounts": get("credit_accounts"),
        "bureau": get("bureau_reports"),
        "users": users,
        "account_daily": get("daily_accounts"),
        "limit_offers": get("sent_offers"),
        "limit_decreases": get("sent_decreases"),
        "cards": cards.select("account_id", "brand", "created_at"),
        "facility_accounts": cards.select("account_id", F.col("nation_key").alias("facility_id")),
        "facilities": get("nation").select(F.col("n_nationkey").alias("facility_id"), F.col("n_name").alias("name")),
        "balances": get("account_balances"),
        "control_group": cards.filter(F.col("account_id") % 45 == 0).select("account_id", F.lit("CONTROL").alias("type")),
        "limit_adjustments": get("adjustments"),
        "id_documents": get("documents_seen").drop("account_id"),
    }
