"""The reactive eligibility table over the stand-in portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F

from limitloom.plans import reactive_eligibility as plan
from limitloom.queries.registry import AS_OF, query
from limitloom.queries.rules import BRANDS, OVERRIDE_SQL, _ladder_sql
from limitloom.queries.shape import plain
from limitloom.sources.portfolio_standins import portfolio
from limitloom.sources.standins import cte

VIEWS = (
    "flat_statements", "credit_accounts", "bureau_reports", "portfolio_users", "daily_accounts", "sent_offers", "sent_decreases",
    "account_cards", "account_balances", "adjustments", "documents_seen",
)

MONTHS_TO_AS_OF = "(2001 - year({0})) * 12 + 8 - month({0}) + (1 - day({0})) / 31.0"
BUREAU = [x for x in plan.BUREAU_COLUMNS if x not in ("score", "segment_indicator", "bc34")]

FEATURES = (
    cte(*VIEWS)
    + f""",
stmt0 as (
  select s.*, cast(closing_date as date) as close_date, cast(opening_date as date) as open_date, left(closing_date, 7) as closing_mth,
         (payments_cents + credits_cents) / 100.0 as payment, previous_cents / 100.0 as previous_balance, limit_cents / 100.0 as credit_limit,
         balance_cents / 100.0 as new_balance, interest_cents / 100.0 as general_interest,
         case when interest_cents > 0 then 'Revolver' else 'Transactor' end as rf,
         case when previous_cents = 0 and balance_cents = 0 and purchases_cents = 0 then 0 else 1 end as active_status
  from flat_statements s),
stmt1 as (select *, row_number() over (partition by account_id, active_status order by close_date, statement_id) as active_order from stmt0),
feat as (
  select t.*, a.rf as rf1, b.rf as rf2, a.new_balance as bal1, b.new_balance as bal2,
         t.payment + coalesce(a.payment, 0) + coalesce(b.payment, 0) as paid_3m,
         t.previous_balance + coalesce(a.previous_balance, 0) + coalesce(b.previous_balance, 0) as owed_3m
  from stmt1 t
  left join stmt1 a on a.account_id = t.account_id and a.active_status = t.active_status and a.active_order = t.active_order - 1
  left join stmt1 b on b.account_id = t.account_id and b.active_status = t.active_status and b.active_order = t.active_order - 2),
latest as (
  select *, {MONTHS_TO_AS_OF.format("close_date")} as statement_age,
         case when rf = 'Transactor' and rf1 = 'Transactor' and rf2 = 'Transactor' then 'Transactor' else 'Revolver' end as user_type,
         coalesce(cast(paid_3m as double) / nullif(owed_3m, 0), 1) as pay_bal_3m
  from feat qualify row_number() over (partition by account_id order by closing_mth desc) = 1),
pulls as (select *, left(cast(created_at as varchar), 7) as pull_mth from bureau_reports),
-- Reports of one user and day are ordered by their values, the smallest first.
pm as (select * from pulls qualify row_number() over (partition by user_id, pull_mth order by created_at desc, credit_report_date desc,
        score nulls last, segment nulls last, go06, go26 nulls last, go91, pr44, pr45, pr124, pr116, pr15, pr50, pr74, pr75, pr120, pr97, go81,
        am36 nulls last, bc33, re33, re34, bc34, bc91) = 1),
pl as (select * from pm qualify row_number() over (partition by user_id order by created_at desc, credit_report_date desc) = 1),
day_end as (
  select account_id, arg_max(credit_limit, reference_date) as day_end_limit, arg_max(account_status, reference_date) as day_end_status,
         arg_max_null(days_past_due, reference_date) as day_end_dpd, arg_max(charged_off_reason, reference_date) as day_end_charge_off,
         max(reference_date) filter (where days_past_due > 0) as late_until,
         arg_max(days_past_due, reference_date) filter (where days_past_due > 0) as late_dpd, max(days_past_due) filter (where days_past_due > 0) as worst_dpd,
         max(days_past_due) filter (where reference_date <= date '2001-08-01' and reference_date > date '2001-08-01' - 100) as dpd_100
  from daily_accounts where sub_product = 'UNSECURED' group by account_id),
worst as (
  select d.account_id, max(d.reference_date) - cast(any_value(d.days_past_due) as integer) as worst_from
  from daily_accounts d join day_end e on e.account_id = d.account_id and e.worst_dpd = d.days_past_due group by d.account_id),
inactive as (
  select account_id, previous_limit_cents // 100 as old_limit from sent_decreases d
  where strategy = 'INACTIVE_CLD' and not exists (select 1 from sent_offers o where o.account_id = d.account_id and o.accepted_at > d.initiated_at)
  qualify row_number() over (partition by account_id order by initiated_at desc, applied_at, previous_limit_cents, offer_id) = 1),
undone as (
  select account_id, previous_limit_cents from sent_decreases d
  where strategy = 'LOW-UTIL' and initiated_at >= timestamp '2001-07-02 00:00:00'
    and not exists (select 1 from sent_offers o where o.account_id = d.account_id and o.accepted_at > d.initiated_at)
  qualify row_number() over (partition by account_id order by initiated_at desc, applied_at, previous_limit_cents, offer_id) = 1),
adj as (
  select account_id, count(*) filter (where reason = 'CREDIT_LIMIT_RESTRICTION') as a, count(*) filter (where reason = 'CREDIT_LIMIT_RESTRICTION_REVERSED') as b,
         count(*) filter (where reason = 'HRAM_CREDIT_LIMIT_RESTRICTION') as c, count(*) filter (where reason = 'HRAM_CREDIT_LIMIT_RESTRICTION_REVERSED') as d,
         max(as_of_ts) filter (where reason = 'CREDIT_LIMIT_RESTRICTION_REVERSED') as b_at,
         max(as_of_ts) filter (where reason = 'HRAM_CREDIT_LIMIT_RESTRICTION_REVERSED') as d_at
  from adjustments group by account_id),
joined as (
  select l.account_id, l.user_id, l.close_date, l.statement_age, l.user_type, l.pay_bal_3m, l.paid_3m, l.owed_3m, l.credit_limit, l.active_status,
         l.new_balance, l.bal1, l.bal2, l.rf, l.rf1, l.rf2,
         e.*  exclude (account_id), w.worst_from, ca.created_at as opened_on, ca.close_date as closed_on,
         coalesce(pm.score, pl.score) as score, coalesce(pm.segment, pl.segment) as segment_indicator,
         {", ".join(f"coalesce(pm.{x}, pl.{x}) as {x}" for x in BUREAU)},
         u.status as user_status, u.frozen_reason, u.tenant_id, u.province, u.employment, u.field,
         case when l.account_id in (select account_id from sent_decreases where strategy = 'CLD_HIGH_RISK'
              and date_sub('day', applied_at, timestamp '2001-08-01 08:00:00') <= 180) then 0 else 1 end as cld_block,
         i.old_limit, case when i.account_id is null then 0 else 1 end as cld_population, lo.last_offer_on,
         k.brand, n.n_name as facility, bal.total_balance_cents / 100.0 as latest_balance,
         case when mod(l.account_id, 45) = 0 then 1 else 0 end as prior_control_group, x.previous_limit_cents as undone_cents,
         case when x.account_id is null then 0 else 1 end as has_undone,
         case when adj.a > adj.b or adj.c > adj.d then 1 when date_sub('day', adj.d_at, timestamp '2001-08-01 08:00:00') <= 180
              or date_sub('day', adj.b_at, timestamp '2001-08-01 08:00:00') <= 180 then 2 else 0 end as restriction
  from latest l join day_end e on e.account_id = l.account_id
  left join worst w on w.account_id = l.account_id left join credit_accounts ca on ca.account_id = l.account_id
  left join pm on pm.user_id = l.user_id and pm.pull_mth = l.closing_mth left join pl on pl.user_id = l.user_id
  left join portfolio_users u on u.user_id = l.user_id left join inactive i on i.account_id = l.account_id
  left join undone x on x.account_id = l.account_id
  left join (select account_id, max(cast(initiated_at as date)) as last_offer_on from sent_offers group by 1) lo on lo.account_id = l.account_id
  left join account_cards k on k.account_id = l.account_id left join nation n on n.n_nationkey = k.nation_key
  left join (select * from account_balances qualify row_number() over (partition by account_id order by created_at desc) = 1) bal
    on bal.account_id = l.account_id
  left join adj on adj.account_id = l.account_id
  where l.statement_age <= 1),
flagged as (
  select *, greatest(coalesce(score, 0), 0) as clean, {MONTHS_TO_AS_OF.format("last_offer_on")} as cli_months,
    case when close_date < late_until then late_dpd end as dpd_now,
    case when worst_from >= close_date - interval 3 month then worst_dpd end as dpd_3m,
    case when go26 <> 'H' or coalesce(score, 0) <= 0 then '1' when go91 = 'Y' then '2'
         when pr44 + pr45 + pr124 + pr116 + pr15 + pr50 + pr74 + pr75 + pr120 + pr97 + go81 > 0 then '3' end as exclusion,
    case when day_end_status = 'OPEN' and frozen_reason is null and day_end_dpd is null and day_end_charge_off = 'N/A'
         then 'Account_OPEN_Not_Frozen' else 'Account_Not_In_Good_Standing' end as standing,
    -- whole months, plus 31sts of the day difference where the days differ
    round((year(close_date) - year(opened_on)) * 12 + month(close_date) - month(opened_on)
          + case when day(close_date) = day(opened_on) then 0 else (day(close_date) - day(opened_on)) / 31.0 end) as mob_rounded
  from joined),
flags as (
  select *, case when user_status = 'ACTIVE' then 1 else 0 end as not_frozen, case when exclusion in ('2', '3') then 1 else 0 end as policy_exclusion_flag,
    case when dpd_now > 0 then 1 else 0 end as currently_delinquent, case when dpd_3m >= 30 then 1 else 0 end as delinquent_3m,
    case when pay_bal_3m >= 0.05 or pay_bal_3m < 0 or (paid_3m = 0 and owed_3m < 0) then 1 else 0 end as payment_flag,
    case when go06 >= 3 then 1 else 0 end as inquiry_flag, case when am36 >= 12 or am36 is null then 1 else 0 end as am36_flag,
    case when clean between 600 and 900 then 1 else 0 end as score_flag, case when clean >= 600 and clean < 700 then 1 else 0 end as sub_prime_flag,
    case when segment_indicator in (2, 3, 4) then 1 else 0 end as bureau_segment_flag, case when cli_months <= 3 then 1 else 0 end as recent_cli,
    case when province = 'QC' then 'Quebec' else 'Other' end as province_group
  from flagged),
gated as (
  select *, not_frozen = 1 and policy_exclusion_flag = 0 and currently_delinquent = 0 and clean >= 600 and go26 = 'H'
            and standing = 'Account_OPEN_Not_Frozen' and (cli_months is null or cli_months >= 3) and has_undone = 1 as passes,
         not_frozen = 1 and policy_exclusion_flag = 0 and currently_delinquent = 0 and delinquent_3m = 0 and payment_flag = 1 and inquiry_flag = 0
            and recent_cli = 0 and bureau_segment_flag = 0 and am36_flag = 1 and cld_block = 1 and restriction = 0 and go26 = 'H'
            and standing = 'Account_OPEN_Not_Frozen' and statement_age < 2 and credit_limit > 100 as gate
  from flags)
"""
)


@query(
    "reactive_inputs",
    FEATURES.replace("arg_max_null(days_past_due, reference_date)", "arg_max(struct_pack(v := days_past_due), reference_date).v")
    + """select account_id, user_type, round(pay_bal_3m, 6) as pay_bal_3m, cast(score as bigint) as score, cast(mob_rounded as bigint) as mob_rounded,
                cast(dpd_now as bigint) as days_past_due, cast(dpd_3m as bigint) as max_dpd_3m, round(cli_months, 5) as last_cli_months,
                standing, restriction, cld_block, cld_population, cast(old_limit as bigint) as old_limit, facility, cast(latest_balance as double) as latest_balance
         from flags""",
)
def reactive_inputs(spark, sf_dir):
    rows = plan.eligibility_inputs(portfolio(spark, sf_dir), AS_OF)
    longs = ["score", "mob_rounded", "days_past_due", "max_dpd_3m", "old_limit"]
    rows = rows.withColumns({x: F.col(x).cast("bigint") for x in longs})
    rows = rows.withColumns({"pay_bal_3m": F.round("pay_bal_3m", 6), "last_cli_months": F.round("last_cli_months", 5)})
    cols = ["account_id", "user_type", "pay_bal_3m", "last_cli_months", *longs, "standing", "restriction", "cld_block", "cld_population", "facility", "latest_balance"]
    return plain(rows.select(*cols))


ELIGIBILITY = (
    FEATURES.replace("arg_max_null(days_past_due, reference_date)", "arg_max(struct_pack(v := days_past_due), reference_date).v")
    + f""", held as (select user_id, count(*) as n_unsecured, count(*) filter (where tier like 'WORLD%') as n_world from credit_accounts
                     where status = 'OPEN' and secured_deposit_id is null group by user_id),
          docs as (select user_id, coalesce(issuing_country, id_issuer) as issued_by from documents_seen
                   qualify row_number() over (partition by user_id order by completed_at desc, issuing_country nulls last, id_issuer nulls last) = 1),
          std0 as (select *, cast(credit_limit as double) as lim,
                     case when gate and clean >= 600 and clean < 700 and mob_rounded >= 6 and credit_limit <= 3000 then 'Sub_Prime_Segement'
                          when gate and clean >= 700 and clean <= 900 and mob_rounded >= 3 and credit_limit <= 9000
                            then case when user_type = 'Transactor' then 'Transactor_Segement' else 'Revolver_Segment' end end as segment
                   from gated where not coalesce(passes, false)),
          std1 as (select *, ntile(2) over (order by account_id) as tile, {_ladder_sql((2, 3, 1.5, 2), (1000, 1500, 2000), "null")} as cons_limit,
                     {_ladder_sql((2.5, 3.5, 2, 2.5), (1500, 2000, 2500), "0")} as agg_limit,
                     case when segment is null or right(tenant_id, 1) = '1' then 0 else 1 end as elig from std0),
          both_kinds as (
            select account_id, user_id, brand, province_group, segment, case tile when 1 then 'Aggressive' else 'Conservative' end as strategy_type, elig,
                   cast(case when elig = 1 then coalesce(least(cast(ceil(case tile when 1 then agg_limit else cons_limit end / 100) * 10000 as bigint), 1000000), 0)
                        else 0 end as bigint) as cents,
                   case segment when 'Sub_Prime_Segement' then 'LWGR' when 'Transactor_Segement' then 'TRNS' when 'Revolver_Segment' then 'RVLV' end as seg_code
            from std1
            union all
            select account_id, user_id, brand, province_group, 'Active CLD', 'Active CLD', 1, greatest(cast(round(undone_cents / 10000.0) * 10000 as bigint), 50000), 'ACLD'
            from gated where passes),
          finals as (
            select b.*, case when brand in ('PARTNER', 'CORE') then brand || case province_group when 'Other' then '-ROC-' else '-QC-' end || seg_code || '-RCTV' end as code,
                   {OVERRIDE_SQL} as override
            from both_kinds b left join held h on h.user_id = b.user_id left join docs d on d.user_id = b.user_id)
          select account_id, user_id, coalesce(override, segment) as segment, strategy_type, case when override is null then elig else 0 end as eligible,
                 cast(case when override is null then cents else 0 end as bigint) as new_limit_cents, case when override is null then code end as offer_code
          from finals"""
)


@query("reactive_eligibility", ELIGIBILITY)
def reactive_eligibility(spark, sf_dir):
    rows = plan.eligibility(portfolio(spark, sf_dir), AS_OF, BRANDS)
    return plain(rows.select("account_id", "user_id", "segment", "strategy_type", "eligible", "new_limit_cents", "offer_code"))


# Columns of the log beside the seven above; the flags come from the same features.
_LOG = {
    "last_cli_months": "round(f.cli_months, 5)", "cli_offered_3m": "case when f.cli_months in (0, 1, 2, 3) then 1 else 0 end",
    "transactor_flag": "case when f.user_type = 'Transactor' and f.new_balance > 0 and f.bal1 > 0 and f.bal2 > 0 then 1 else 0 end",
    "user_type": "f.user_type", "sub_prime_flag": "f.sub_prime_flag", "not_frozen": "f.not_frozen", "policy_exclusion_flag": "f.policy_exclusion_flag",
    "currently_delinquent": "f.currently_delinquent", "delinquent_3m": "f.delinquent_3m", "payment_flag": "f.payment_flag", "inquiry_flag": "f.inquiry_flag",
    "am36_flag": "f.am36_flag", "sp_limit_flag": "case when f.clean < 700 and f.credit_limit > 3000 then 0 else 1 end", "score_flag": "f.score_flag",
    "bureau_segment_flag": "f.bureau_segment_flag", "recent_cli": "f.recent_cli", "account_type": "'UNSECURED'", "day_end_limit": "cast(f.day_end_limit as double)",
    "score": "cast(f.score as bigint)", "day_end_status": "f.day_end_status", "day_end_frozen_reason": "f.frozen_reason", "day_end_dpd": "cast(f.day_end_dpd as bigint)",
    "day_end_charge_off": "f.day_end_charge_off", "standing": "f.standing", "brand": "f.brand", "facility": "f.facility", "latest_balance": "cast(f.latest_balance as double)",
    "over_limit": "case when f.latest_balance > f.credit_limit then 1 else 0 end", "over_limit_20": "case when f.latest_balance > f.credit_limit * 1.2 then 1 else 0 end",
    "delinquent_100_days": "case when f.dpd_100 >= 30 then 1 else 0 end", "prior_control_group": "f.prior_control_group", "go26": "f.go26",
    "field_of_study": "case when f.employment = 'STUDENT' and f.field in ('Hospitality, Food and Tourism', 'Trades, Construction and Manufacturing') then 1 else 0 end",
    "province_group": "f.province_group", "restriction": "f.restriction", "active_status": "f.active_status", "mob_rounded": "cast(f.mob_rounded as bigint)",
    "credit_limit": "cast(f.credit_limit as double)", "cld_block": "f.cld_block", "bureau_score_clean": "cast(f.clean as bigint)", "account_latest_entry": "1",
}


@query(
    "eligibility_log",
    ELIGIBILITY.replace("          select account_id, user_id, coalesce(override, segment) as segment, strategy_type,", "          , log as (select account_id, user_id, coalesce(override, segment) as segment, strategy_type,", 1)
    + ") select l.*, " + ", ".join(f"{sql} as {name}" for name, sql in _LOG.items()) + " from log l join flags f on f.account_id = l.account_id",
)
def eligibility_log(spark, sf_dir):
    """Every column of the log."""
    rows = plan.eligibility(portfolio(spark, sf_dir), AS_OF, BRANDS)
    longs = {x: F.col(x).cast("bigint") for x in ("score", "day_end_dpd", "mob_rounded", "bureau_score_clean")}
    return plain(rows.withColumns({**longs, "last_cli_months": F.round("last_cli_months", 5)}))
