"""The early-tenure campaign over the stand-in portfolio."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from limitloom.plans import early_campaign as plan
from limitloom.queries.registry import AS_OF, query
from limitloom.queries.shape import plain
from limitloom.sources.portfolio_standins import campaign_frames
from limitloom.sources.standins import cte

VIEWS = (
    "campaign_daily", "card_transactions", "card_applications", "junior_history", "strategy_inputs", "bureau_reports", "flat_statements",
    "account_offers", "behaviour_history", "portfolio_users",
)
_RECORDS = ("pr44", "pr45", "pr124", "pr116", "pr15", "pr50", "pr74", "pr75", "pr120", "pr97", "go81")

# Reports of one user and moment are ordered by their values, as the plan's tie-break does.
_NEWEST = (
    "partition by user_id order by credit_report_date desc, created_at desc, score nulls last, segment, go06, go26 nulls last, go91, "
    "am36 nulls last, bc33, re33, re34, bc34, bc91, am41, " + ", ".join(_RECORDS)
)

CANDIDATES = (
    cte(*VIEWS)
    + f""",
opened as (
  select distinct a.account_id, a.am41, a.strategy_name from card_applications a left join portfolio_users u on u.user_id = a.user_id
  where u.type <> 'TEST' and a.brand = 'CORE' and a.type = 'STANDARD' and a.status = 'COMPLETED' and a.decision = 'APPROVED'
    and cast(a.created_at as date) >= date '2001-02-01'),
declined as (
  select account_id, sum(case when decline_reason in ('ACCOUNT_SUSPENDED', 'CARD_FROZEN', 'FRAUD_SUSPECTED', 'CARD_BLOCKED') then 1 end) as fraud_remove
  from card_transactions where decline_reason is not null and authorized_at <= timestamp '2001-08-01 23:59:59' and account_status = 'OPEN' and card_type = 'WORLD'
  group by all),
used as (
  select account_id, sum(case when category = 'CASH_ADVANCE' then 1 else 0 end) as cash,
         sum(case when category = 'PURCHASE' and status = 'CONFIRMED' then 1 else 0 end) as bought
  from card_transactions where cast(authorized_at as date) <= date '2001-08-01' and account_status = 'OPEN' and card_type = 'WORLD' group by 1),
paid as (
  select account_id, sum(amount) as payment_amount,
         case when sum(case when trusted_payment = 'false' then 1 else 0 end) > 0 and sum(case when amount >= 2500 then 1 else 0 end) > 0 then 1 else 0 end as untrusted
  from card_transactions where category = 'PAYMENT' and account_status = 'OPEN' and card_type = 'WORLD' group by 1),
late as (select account_id, max(days_past_due) as worst from campaign_daily where reference_date <= date '2001-08-01' group by 1),
junior as (select account_id, max(prediction) as peak from junior_history
           where model_version = '2.1' and cast(reference_date as date) > date '2001-08-01' - 30 group by 1),
rep as (select user_id, am41 from bureau_reports
        qualify row_number() over ({_NEWEST}) = 1),
pol as (select user_id, case when go91 = 'Y' or {" + ".join(_RECORDS)} > 0 then 1 else 0 end as policy_fail from bureau_reports where go26 = 'H'
        qualify row_number() over ({_NEWEST}) = 1),
beh as (select account_id, model_score from behaviour_history qualify row_number() over (partition by account_id order by reference_date desc) = 1),
stm as (select account_id, closing_date, balance_cents from flat_statements qualify row_number() over (partition by account_id order by closing_date desc) = 1),
again as (
  select s.user_id, case when s.go91 <> 'Y' and {" + ".join("s." + r for r in _RECORDS)} = 0
    and not coalesce(case segment
      when 'THICK' then s.am41 > 1 or am42 > 0 or am43 > 0 or am84 > 0 or go11 <= 50 or re34 >= 100 or dti > 200 or pr51 > 0
      when 'THIN' then s.am41 > 0 or am42 > 0 or am43 > 0 or at01 not between 1 and 5 or am84 > 0 or bc147 >= 90 or go06 > 4 or go11 <= 95
                       or go149 > 1 or go14 <= 2 or re34 >= 90 or pr51 > 0 or dti > 200
      when 'SUBPRIME' then s.am41 > 1 or am42 > 0 or am43 > 0 or go141 > 4 or pr11 > 500 or am02 <= 0 or am84 > 0 or pr51 > 0 or re34 > 95
                           or go14 < 3 or dti > 100 end, false)
    and bko >= case segment when 'THIN' then 715 else 670 end
    and case segment when 'THICK' then cvsc100 >= 640 and (thick >= 521 or (thick >= 489 and cvsc100 >= 669) or (thick >= 475 and cvsc100 >= 690))
                     when 'THIN' then cvsc100 >= 640 and ((thin >= 641 and cvsc100 >= 680) or (thin >= 656 and cvsc100 >= 669))
                     else cvsc100 between 600 and 640 and subprime >= 575 end then 1 else 0 end as approves
  from strategy_inputs s where cvsc100 between 300 and 900 and user_id in (
    select user_id from campaign_daily where reference_date = date '2001-07-31' and sub_product = 'UNSECURED' and account_status = 'OPEN' and card_type is not null)
  qualify row_number() over (partition by user_id order by offer_id) = 1),
rows0 as (
  select d.*, o.am41 as am41_then, o.strategy_name, rep.am41 as am41_now, coalesce(pol.policy_fail, -1) as policy_fail, beh.model_score, used.cash, used.bought,
         declined.fraud_remove, paid.payment_amount, paid.untrusted, late.worst, junior.peak, coalesce(again.approves, 0) as approves,
         d.latest_score - d.original_score as change, stm.closing_date, stm.balance_cents,
         case when d.account_id in (select account_id from account_offers where account_id is not null) then 1 else 0 end as had_cli
  from campaign_daily d join opened o on o.account_id = d.account_id
  left join declined on declined.account_id = d.account_id left join used on used.account_id = d.account_id left join paid on paid.account_id = d.account_id
  left join late on late.account_id = d.account_id left join junior on junior.account_id = d.account_id left join rep on rep.user_id = d.user_id
  left join pol on pol.user_id = d.user_id left join beh on beh.account_id = d.account_id left join again on again.user_id = d.user_id
  left join stm on stm.account_id = d.account_id
  where d.reference_date = date '2001-08-01' and d.account_status = 'OPEN' and d.card_type = 'WORLD' and d.product_type = 'WORLD CREDIT' and d.month_on_book > 0),
final as (
  select *,
    case when approves = 0 then '0. Current Strategy' when peak >= 0.1 then '1. Fraud Junior Exclusion' when fraud_remove is not null then '2. Fraud Checks Failed'
         when untrusted = 1 then '3. Fraud Non Trusted Payment' when policy_fail = 1 then '5. Credit Policy Exclusion' when cash >= 1 then '6. Credit Cash Advance'
         when coalesce(bought, 0) = 0 then '7. Credit Confirmed Purchase' when worst > 0 then '8. Credit Delinquency'
         when original_score_band like 'b.%' or latest_score_band like 'b.%' then '9. Credit Score Sub Prime'
         when cast(am41_then as integer) < am41_now then '10. Credit AM41 Increase' when change < -50 then '11. Credit Score Dropped More Than 50 Points'
         when model_score >= 0 and model_score < 600 then '12. High Risk Behavior Score' when payment_amount is null then '13. No Payment Amount'
         when frozen_reason is not null then '14. User Frozen' else '15. Criteria Pass' end as final_waterfall,
    case when original_score_band like 'c.%' then case when credit_limit < 701 then 1000 else 1200 end
         when original_score_band like 'd.%' then case when credit_limit < 1000 then 1200 when credit_limit < 1800 then 1500 else 2000 end
         when original_score_band like 'e.%' then 2000 when original_score_band like 'f.%' then 2500 else 0 end as line_amount
  from rows0)
"""
)


def candidates(spark, sf_dir):
    return plan.candidates(
        campaign_frames(spark, sf_dir), AS_OF, "CORE", "WORLD", "WORLD CREDIT", dt.date(2001, 2, 1), thin_strategies=("thin-baseline",), input_order=("input_id",)
    )


@query(
    "early_candidates",
    CANDIDATES
    + """select account_id, final_waterfall, cast(line_amount as integer) as line_amount, had_cli, case when strategy_name = 'thin-baseline' then 1 else 0 end as thin_file,
                case when worst > 5 then 1 else 0 end as ever_late_5, cast(payment_amount as double) as payment_amount, closing_date as statement_close,
                cast(balance_cents / 100.0 as double) as statement_balance, case when peak >= 0.15 then 1 else 0 end as junior_15
         from final""",
)
def early_candidates(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    cols = ["account_id", "final_waterfall", "line_amount", "had_cli", "thin_file", "ever_late_5", "payment_amount", "statement_close", "statement_balance", "junior_15"]
    return plain(rows.select(*cols))


@query(
    "early_campaign",
    CANDIDATES
    + """select account_id, month_on_book, original_score_band, cast(credit_limit as double) as credit_limit, cast(line_amount as integer) as line_amount,
                'Core_World' as brand_product
         from final where day_on_book > 90 and day_on_book < 179 and had_cli = 0 and final_waterfall = '15. Criteria Pass'""",
)
def early_campaign(spark, sf_dir):
    return plain(plan.audience(candidates(spark, sf_dir), "Core_World"))


@query(
    "campaign_waterfall_counts",
    CANDIDATES + "select final_waterfall, cast(count(*) as bigint) as n from final group by 1",
)
def campaign_waterfall_counts(spark, sf_dir):
    return plain(candidates(spark, sf_dir).groupBy("final_waterfall").agg(F.count(F.lit(1)).alias("n")))
