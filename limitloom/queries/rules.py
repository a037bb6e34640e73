"""Rulesets over applicants, campaign candidates and scored offers."""

from __future__ import annotations

from pyspark.sql import functions as F

from limitloom.functions import flag, floor_at_zero, mob, safe_ratio
from limitloom.operators import attach, flow_edges, ntile_global
from limitloom.queries.grouping import SCORED, scored_offers
from limitloom.queries.registry import AS_OF, query
from limitloom.queries.shape import plain
from limitloom.rulesets import campaign, cuts, offers, reactive
from limitloom.rulesets.brands import Brands
from limitloom.sources.standins import cte, standin

c = F.col

# Brand codes of the stand-in applicants, and the cut group of each stand-in market segment.
BRANDS = Brands(
    core="CORE",
    partner="PARTNER",
    cut_group={"BUILDING": "partner", "FURNITURE": "core", "MACHINERY": "affiliate", "HOUSEHOLD": "community"},
)


def n_rows():
    return F.count(F.lit(1))


@query(
    "band_suite",
    cte("applicants")
    + """, base as (select *, greatest(coalesce(score, 0), 0) as clean, cast(credit_limit as double) as lim from applicants)
         select offer_id,
           case when lim <= 1500 then '1, <=1.5k ICL' else '2,>1.5k ICL' end as icl_bucket,
           case when lim <= 100 then '1, <=100' when lim <= 1500 then '2, 100-1500' when lim <= 3000 then '3,1500-3000'
                when lim <= 7000 then '4,3000-7000' else '5,>7000' end as icl_bucket_fine,
           case when mob_rounded <= 12 then '1, <= 1yr MOB' when mob_rounded <= 24 then '2, <= 2yr MOB' else '3, >2yr MOB' end as mob_bucket,
           case when mob_rounded <= 3 then '1,0-3' when mob_rounded <= 6 then '2,4-6' when mob_rounded <= 12 then '3,7-12'
                when mob_rounded <= 24 then '4,13-24' when mob_rounded <= 36 then '5,25-36' else '6,>36' end as mob_bucket_fine,
           case when mob_rounded is null then 'A. Missing' when mob_rounded < 1 then 'B. LT 1' when mob_rounded < 4 then 'C. 1 - 3'
                when mob_rounded < 7 then 'D. 4 - 6' when mob_rounded < 13 then 'E. 7 - 12' when mob_rounded < 25 then 'F. 13 - 24'
                else 'G. GT 24' end as mob_band,
           case segment_indicator when 1 then 'A. No Trades' when 2 then 'B. Recent BK/90+ DPD' when 3 then 'C. Past BK/90+ DPD'
                when 4 then 'D. Recent Delinquency' when 5 then 'E. New to Credit' when 6 then 'F. No CC/Inactive'
                when 7 then 'F. Missing Payment' when 8 then 'F. Transactor' when 9 then 'F. Revolver' when 10 then 'F. Thin File' end as bureau_category,
           case when lim is null then 'Missing Credit Limit' when lim <= 0 then '0. Less Than Equal To Zero' when lim <= 100 then '1. 1 - 100'
                when lim <= 500 then '2. 101 - 500' when lim <= 1500 then '3. 501 - 1500' when lim <= 2500 then '4. 1501 - 2500'
                when lim <= 5000 then '5. 2501 - 5000' when lim <= 7500 then '6. 5001 - 7500' when lim <= 10000 then '7. 7501 - 10000'
                else '8. GT 10K' end as limit_band,
           cast(clean as integer) as bureau_score_clean,
           case when clean < 600 then 'B. LT 600' when clean < 620 then 'C. 600 - 619' when clean < 639 then 'D. 620 - 639'
                when clean >= 640 and clean < 660 then 'E. 640 - 659' when clean >= 660 and clean < 690 then 'F. 660 - 689'
                when clean >= 690 and clean < 740 then 'G. 690 - 739' when clean >= 740 and clean < 800 then 'H. 740 - 799'
                when clean >= 800 then 'I. 800+' end as score_band,
           case when clean - 700 = 0 then '1. TU Score Same' when clean > 700 then '2. TU Score Better Now'
                when clean >= 680 then '3. Dropped Upto 20 Points' when clean >= 650 then '4. Dropped Between 20 to 50 Points'
                else '5. Dropped More Than 50 Points' end as score_movement
         from base""",
)
def band_suite(spark, sf_dir):
    rows = standin(spark, sf_dir, "applicants").withColumn("bureau_score_clean", floor_at_zero("score"))
    return plain(
        rows.select(
            "offer_id",
            offers.limit_bucket("credit_limit").alias("icl_bucket"),
            offers.limit_bucket_fine("credit_limit").alias("icl_bucket_fine"),
            offers.tenure_bucket("mob_rounded").alias("mob_bucket"),
            offers.tenure_bucket_fine("mob_rounded").alias("mob_bucket_fine"),
            reactive.tenure_band().alias("mob_band"),
            reactive.bureau_segment_category().alias("bureau_category"),
            reactive.limit_band().alias("limit_band"),
            "bureau_score_clean",
            reactive.score_band().alias("score_band"),
            campaign.score_movement(c("bureau_score_clean") - 700).alias("score_movement"),
        )
    )


@query(
    "tu_bucket_counts",
    cte("candidates")
    + """, named as (select case original_score_band when 'b. Sub Prime (300 to 639)' then '1. SUBPRIME' when 'c. Near-Prime (640 to 719)' then '2. NEAR_PRIME'
                       when 'd. Prime (720 to 759)' then '3. PRIME' when 'e. Prime+ (760 to 799)' then '4. PRIME_PLUS' end as tu_band, original_score_band from candidates)
         select case when tu_band in ('1. SUBPRIME', '2. NEAR_PRIME', '3. PRIME') then '1, Low TU'
                     when tu_band in ('4. PRIME_PLUS', '5. SUPER_PRIME') then '2, High TU' end as tu_bucket,
                case when original_score_band like 'b.%' then '1. Subprime' when original_score_band like 'c.%' then '2. Near Prime'
                     when original_score_band like 'd.%' then '3. Prime' else '4. >= Prime Plus' end as band_group, cast(count(*) as bigint) as n
         from named group by 1, 2""",
)
def tu_bucket_counts(spark, sf_dir):
    rows = standin(spark, sf_dir, "candidates")
    names = {campaign.SUB_PRIME_BAND: "1. SUBPRIME", campaign.NEAR_PRIME_BAND: "2. NEAR_PRIME", campaign.PRIME_BAND: "3. PRIME", campaign.PRIME_PLUS_BAND: "4. PRIME_PLUS"}
    band = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rows = rows.withColumn("tu_band", F.try_element_at(band, c("original_score_band")))
    grid = rows.groupBy(offers.score_band_bucket().alias("tu_bucket"), campaign.band_group().alias("band_group"))
    return plain(grid.agg(n_rows().alias("n")))


def judged(spark, sf_dir):
    """Applicants with every flag the segments and reject reasons read."""
    rows = standin(spark, sf_dir, "applicants").withColumn("bureau_score_clean", floor_at_zero("score"))
    rows = rows.withColumns(
        {
            "pay_bal_3m": safe_ratio("paid_3m", "owed_3m", default=1),
            "policy_exclusion": reactive.policy_exclusion(),
            "revolver_flag": reactive.revolver_flag("interest"),
            "revolver_flag_1m_prior": reactive.revolver_flag("interest_1m"),
            "revolver_flag_2m_prior": reactive.revolver_flag("interest_2m"),
            "statement_age_months": mob("close_date", AS_OF),
        }
    )
    rows = rows.withColumn("consistent_type", reactive.consistent_type())
    score = c("bureau_score_clean")
    return rows.withColumns(
        {
            "not_frozen": flag(c("user_status") == "ACTIVE"),
            "policy_exclusion_flag": reactive.policy_exclusion_flag(),
            "currently_delinquent": flag(c("days_past_due") > 0),
            "delinquent_3m": flag(c("max_dpd_3m") >= 30),
            "payment_flag": reactive.payment_flag(),
            "inquiry_flag": flag(c("go06") >= 3),
            "recent_cli": flag(c("last_cli_months") <= 3),
            "bureau_segment_flag": flag(c("segment_indicator").isin(*reactive.WEAK_SEGMENTS)),
            "am36_flag": flag((c("am36") >= 12) | c("am36").isNull()),
            "standing": reactive.standing(),
            "score_flag": flag((score >= 600) & (score <= 900)),
            "sub_prime_flag": flag((score >= 600) & (score < 700)),
            "user_type": reactive.user_type(),
            "province_group": reactive.province_group(),
        }
    ).withColumn("segment", reactive.segment())


JUDGED = (
    cte("applicants")
    + """,
base as (
  select *, greatest(coalesce(score, 0), 0) as clean, coalesce(cast(paid_3m as double) / nullif(owed_3m, 0), 1) as pay_bal_3m,
         case when interest > 0 then 'Revolver' else 'Transactor' end as r0, case when interest_1m > 0 then 'Revolver' else 'Transactor' end as r1,
         case when interest_2m > 0 then 'Revolver' else 'Transactor' end as r2
  from applicants),
flags as (
  select *,
    case when go26 <> 'H' or clean is null or clean <= 0 then '1. No-Hit' when go91 = 'Y' then '2. Deceased'
         when pr44 >= 1 or pr45 >= 1 or pr124 >= 1 then '3. Undischarged/Discharged Bankruptcies' when pr116 >= 1 then '4. Consumer Proposals'
         when pr15 >= 1 or pr50 >= 1 then '5. Foreclosures' when pr74 >= 1 then '6. Unsatisfied Judgements'
         when pr75 >= 1 or pr120 >= 1 or pr97 >= 1 then '07. Unpaid Collections' when go81 >= 1 then '8. Chargeoffs' end as policy_exclusion,
    case when r0 = r1 and r1 = r2 and r0 = 'Transactor' then 'Transactor' else 'Revolver' end as user_type,
    case when user_status = 'ACTIVE' then 1 else 0 end as not_frozen,
    case when days_past_due > 0 then 1 else 0 end as currently_delinquent, case when max_dpd_3m >= 30 then 1 else 0 end as delinquent_3m,
    case when pay_bal_3m >= 0.05 or pay_bal_3m < 0 or (paid_3m = 0 and owed_3m < 0) then 1 else 0 end as payment_flag,
    case when go06 >= 3 then 1 else 0 end as inquiry_flag, case when last_cli_months <= 3 then 1 else 0 end as recent_cli,
    case when segment_indicator in (2, 3, 4) then 1 else 0 end as bureau_segment_flag,
    case when am36 >= 12 or am36 is null then 1 else 0 end as am36_flag,
    case when day_end_status = 'OPEN' and day_end_frozen_reason is null and day_end_dpd is null and day_end_charge_off = 'N/A'
         then 'Account_OPEN_Not_Frozen' else 'Account_Not_In_Good_Standing' end as standing,
    case when clean between 600 and 900 then 1 else 0 end as score_flag, case when clean >= 600 and clean < 700 then 1 else 0 end as sub_prime_flag,
    case when province = 'QC' then 'Quebec' else 'Other' end as province_group,
    (2001 - year(close_date)) * 12 + 8 - month(close_date) + (1 - day(close_date)) / 31.0 as statement_age
  from base),
excluded as (select *, case when policy_exclusion is not null and policy_exclusion <> '1. No-Hit' then 1 else 0 end as policy_exclusion_flag from flags),
gated as (
  select *, not_frozen = 1 and policy_exclusion_flag = 0 and currently_delinquent = 0 and delinquent_3m = 0 and payment_flag = 1 and inquiry_flag = 0
            and recent_cli = 0 and bureau_segment_flag = 0 and am36_flag = 1 and cld_block = 1 and account_type = 'UNSECURED' and restriction = 0
            and go26 = 'H' and standing = 'Account_OPEN_Not_Frozen' and statement_age < 2 and credit_limit > 100 as gate
  from excluded),
judged as (
  select *, case when gate and clean >= 600 and clean < 700 and mob_rounded >= 6 and credit_limit <= 3000 then 'Sub_Prime_Segement'
                 when gate and score_flag = 1 and clean >= 700 and clean <= 900 and mob_rounded >= 3 and credit_limit <= 9000
                   then case when user_type = 'Transactor' then 'Transactor_Segement' else 'Revolver_Segment' end end as segment
  from gated)
"""
)


@query(
    "status_suite",
    JUDGED
    + """select offer_id, case when matched_offer_id is not null then 'Approved' else 'Not Approved' end as approval,
                case when matched_offer_id is null then 'Not Approved' when strategy like '%QC%' or strategy like '%PRTV%' then 'not in V2 strategy'
                     when declined_at is not null then 'Declined' when accepted_at is not null then 'Accepted'
                     when datediff('day', offer_date, date '2001-08-01') < 31 then 'In progress' else 'Expired' end as offer_status,
                case when previous_balance = 0 and new_balance = 0 and purchase = 0 then 0 else 1 end as active_status,
                policy_exclusion, policy_exclusion_flag,
                case when pay_bal_3m = 0 then '2. Zero' when pay_bal_3m < 0.10 then '3. LT 10%' when pay_bal_3m < 0.25 then '4. 10 - 25%'
                     when pay_bal_3m < 0.50 then '5. 25 - 50%' when pay_bal_3m < 0.75 then '6. 50 - 75%' when pay_bal_3m < 0.90 then '7. 75 - 90'
                     else '8. GT 90' end as pay_band,
                payment_flag, user_type, not_frozen, currently_delinquent, delinquent_3m, inquiry_flag, recent_cli, bureau_segment_flag, am36_flag,
                standing, case when closed_on > close_date then 1 else 0 end as charged_off,
                case when latest_balance > credit_limit then 1 else 0 end as over_limit,
                case when latest_balance > credit_limit * 1.2 then 1 else 0 end as over_limit_20, province_group
         from judged""",
)
def status_suite(spark, sf_dir):
    rows = judged(spark, sf_dir)
    rows = rows.withColumn("approval", offers.approve_status("matched_offer_id"))
    return plain(
        rows.select(
            "offer_id",
            "approval",
            offers.offer_status(AS_OF, "approval", "strategy", "declined_at", "accepted_at", "offer_date").alias("offer_status"),
            reactive.active_status().alias("active_status"),
            "policy_exclusion",
            "policy_exclusion_flag",
            reactive.pay_ratio_band().alias("pay_band"),
            *["payment_flag", "user_type", "not_frozen", "currently_delinquent", "delinquent_3m", "inquiry_flag", "recent_cli"],
            *["bureau_segment_flag", "am36_flag", "standing"],
            reactive.charge_off_flag().alias("charged_off"),
            reactive.over_limit().alias("over_limit"),
            reactive.over_limit(share=1.2).alias("over_limit_20"),
            "province_group",
        )
    )


OVERRIDE_SQL = """case when brand = 'PARTNER' then 'PARTNER' when n_unsecured > 1 then 'MultiCredit' when n_world > 0 then 'World / World Elite'
                       when issued_by not like 'CA%' then 'International' end"""


def overridden(spark, sf_dir):
    """Judged applicants whose segment shows the override that took them out."""
    rows = judged(spark, sf_dir).withColumn("override", reactive.override(BRANDS))
    return rows.withColumn("segment", F.coalesce("override", "segment"))


@query(
    "reject_reasons",
    JUDGED
    + f""", overridden as (select * exclude (segment), coalesce({OVERRIDE_SQL}, segment) as segment from judged),
          reasons as (select
            case when not_frozen <> 1 then '01' when policy_exclusion_flag <> 0 then '02' when currently_delinquent <> 0 then '03'
                 when delinquent_3m <> 0 then '04' when payment_flag <> 1 then '05' when inquiry_flag <> 0 then '06'
                 when sub_prime_flag = 0 and score_flag <> 1 then '07' when clean < case sub_prime_flag when 0 then 700 else 600 end then '08'
                 when mob_rounded < case sub_prime_flag when 0 then 3 else 6 end then '09' when recent_cli <> 0 then '10'
                 when bureau_segment_flag <> 0 then '11'
                 when day_end_limit is null or day_end_limit <= 100 or day_end_limit > case sub_prime_flag when 0 then 9000 else 3000 end then '12'
                 when am36_flag <> 1 then '13' when cld_block <> 1 then '14' when account_type <> 'UNSECURED' then '15' when restriction <> 0 then '16'
                 when go26 <> 'H' then '17' when standing <> 'Account_OPEN_Not_Frozen' then '18' when brand not in ('PARTNER', 'CORE') then '19, brand'
                 when segment in ('International', 'World / World Elite', 'MultiCredit') then '20, Inter, w/we, multi'
                 when segment = 'PARTNER' then '21, recent PARTNER' when province_group = 'Quebec' then '22,QC' else 'other' end as reject_reason,
            case when policy_exclusion_flag <> 0 then '01, Policy exclusion' when currently_delinquent <> 0 then '02, Delinquency status'
                 when payment_flag <> 1 then '03, Payment Balance' when inquiry_flag <> 0 then '04, Inquiry record'
                 when sub_prime_flag = 0 and score_flag <> 1 then '05, Bureau score flag' when recent_cli <> 0 then '06, Received CLI in last 3m'
                 when bureau_segment_flag <> 0 then '07, Bureau Segment flag'
                 when day_end_limit is null or day_end_limit <= 100 or day_end_limit > case sub_prime_flag when 0 then 9000 else 3000 end then '08, ICL restriction'
                 when segment in ('International', 'World / World Elite', 'MultiCredit') then '09, Inter, w/we, multi' else 'other' end as reject_bucket
            from overridden)
          select reject_reason, reject_bucket, cast(count(*) as bigint) as n from reasons group by 1, 2""",
)
def reject_reasons(spark, sf_dir):
    rows = overridden(spark, sf_dir)
    grid = rows.groupBy(reactive.reject_reason(BRANDS).alias("reject_reason"), reactive.reject_bucket().alias("reject_bucket"))
    return plain(grid.agg(n_rows().alias("n")))


PRIME_STEPS = """when lim > 100 and lim <= 500 then lim + 500 when lim <= 1500 and clean < 800 then lim * {0} when lim <= 1500 and clean >= 800 then lim * {1}
   when lim > 1500 and lim <= 5000 and clean < 800 then lim * {2} when lim > 1500 and lim <= 5000 and clean >= 800 then lim * {3}
   when lim > 5000 and lim <= 7500 and clean < 800 then lim * 1.25 when lim > 5000 and lim <= 7500 and clean >= 800 then lim * 1.5
   when lim > 7500 then lim + 1000"""
SUB_STEPS = """when lim > 100 and lim <= 500 then lim + 500 when lim > 500 and lim <= 1000 then lim + {0}
   when lim > 1000 and lim <= 2000 then lim + {1} when lim > 2000 and lim <= 3000 then lim + {2}"""


def _ladder_sql(prime, sub, default):
    return f"""case when segment is null then {default} when cld_population = 1 then cast(old_limit as double)
        when segment = 'Sub_Prime_Segement' then case {SUB_STEPS.format(*sub)} else {default} end
        else case {PRIME_STEPS.format(*prime)} else {default} end end"""


@query(
    "segment_and_ladder",
    JUDGED
    + f""", limits as (select *, cast(credit_limit as double) as lim from judged),
          laddered as (
            select *, ntile(2) over (order by offer_id) as tile,
                   {_ladder_sql((2, 3, 1.5, 2), (1000, 1500, 2000), 'null')} as cons_limit,
                   {_ladder_sql((2.5, 3.5, 2, 2.5), (1500, 2000, 2500), '0')} as agg_limit,
                   case when segment is null or right(tenant_id, 1) = '1' then 0 else 1 end as eligible0, {OVERRIDE_SQL} as override
            from limits),
          priced as (
            select *, cast(ceil(case tile when 1 then agg_limit else cons_limit end / 100) * 10000 as bigint) as cents,
                   case when brand in ('PARTNER', 'CORE') then brand || '-' || case province_group when 'Other' then 'ROC' else 'QC' end || '-' ||
                     case segment when 'Sub_Prime_Segement' then 'LWGR' when 'Transactor_Segement' then 'TRNS' when 'Revolver_Segment' then 'RVLV' end || '-RCTV' end as code
            from laddered)
          select offer_id, case tile when 1 then 'Aggressive' else 'Conservative' end as strategy_type, cons_limit, agg_limit,
                 coalesce(override, segment) as segment, case when override is not null then 0 else eligible0 end as eligible,
                 cast(case when override is not null or eligible0 = 0 then 0 else coalesce(least(cents, 1000000), 0) end as bigint) as new_limit_cents,
                 case when override is null then code end as offer_code
          from priced""",
)
def segment_and_ladder(spark, sf_dir):
    rows = judged(spark, sf_dir)
    rows = rows.withColumns({"cons_limit": reactive.conservative_limit(), "agg_limit": reactive.aggressive_limit()})
    rows = ntile_global(rows, "offer_id", 2)
    rows = rows.withColumns({"new_limit_cents": reactive.new_limit_cents(), "eligible": reactive.eligible()})
    rows = rows.withColumns(
        {
            "new_limit_cents": reactive.capped_limit_cents(),
            "offer_code": reactive.offer_code(BRANDS, reactive.segment_code()),
            "override": reactive.override(BRANDS),
        }
    )
    kept = c("override").isNull()
    return plain(
        rows.select(
            "offer_id",
            reactive.strategy_type().alias("strategy_type"),
            "cons_limit",
            "agg_limit",
            F.coalesce("override", "segment").alias("segment"),
            F.when(kept, c("eligible")).otherwise(0).alias("eligible"),
            F.when(kept, c("new_limit_cents")).otherwise(0).cast("bigint").alias("new_limit_cents"),
            F.when(kept, c("offer_code")).alias("offer_code"),
        )
    )


def screened(spark, sf_dir):
    """Campaign candidates with component flags, re-decision and both waterfalls."""
    rows = standin(spark, sf_dir, "candidates")
    rows = rows.withColumns(
        {
            "score_movement": campaign.score_movement(c("latest_score") - c("original_score")),
            "target_segment": campaign.target_segment(),
            "original_above_sub_prime": campaign.above_sub_prime("original_score_band"),
            "latest_above_sub_prime": campaign.above_sub_prime("latest_score_band"),
            "fraud_checks_passed": flag(c("fraud_remove").isNull()),
            "has_untrusted_payment": flag((campaign.untrusted_payment() == 1) & (campaign.large_payment() == 1)),
            "trades_increased": campaign.trades_increased(),
            "policy_fail": campaign.policy_fail(),
            "public_record_reject": campaign.public_record_reject(),
            "strategy_reject": campaign.strategy_reject(),
            "bankruptcy_reject": campaign.bankruptcy_reject(),
            "tree_reject": campaign.tree_reject(),
            "user_frozen": flag(c("frozen_reason").isNotNull()),
            "had_cli": flag(c("cli_flag") == 1),
        }
    )
    rows = rows.withColumn("current_strategy_approves", campaign.approves())
    return rows.withColumns(
        {"waterfall": campaign.first_waterfall(), "final_waterfall": campaign.final_waterfall(), "line_amount": campaign.line_amount()}
    )


SCREENED = (
    cte("candidates")
    + """,
parts as (
  select *, latest_score - original_score as change,
    case when original_score_band like 'c.%' and credit_limit = 2000 then 1
         when (original_score_band like 'e.%' or original_score_band like 'f.%') and credit_limit = 1000 then 2 else 0 end as target_segment,
    case when original_score_band like 'b.%' then 0 else 1 end as original_ok, case when latest_score_band like 'b.%' then 0 else 1 end as latest_ok,
    case when trusted_payment = 'false' and amount >= 2500 then 1 else 0 end as has_untrusted_payment,
    case when cast(am41_at_onboarding as integer) < latest_am41 then 1 else 0 end as trades_increased,
    case when go91 = 'Y' or pr44 + pr45 + pr124 + pr116 + pr15 + pr50 + pr74 + pr75 + pr120 + pr97 + go81 > 0 then 1 else 0 end as policy_fail,
    case segment
      when 'THICK' then am41 > 1 or am42 > 0 or am43 > 0 or am84 > 0 or go11 <= 50 or re34 >= 100 or dti > 200 or pr51 > 0
      when 'THIN' then am41 > 0 or am42 > 0 or am43 > 0 or at01 not between 1 and 5 or am84 > 0 or bc147 >= 90 or go06 > 4 or go11 <= 95
                       or go149 > 1 or go14 <= 2 or re34 >= 90 or pr51 > 0 or dti > 200
      when 'SUBPRIME' then am41 > 1 or am42 > 0 or am43 > 0 or go141 > 4 or pr11 > 500 or am02 <= 0 or am84 > 0 or pr51 > 0 or re34 > 95
                           or go14 < 3 or dti > 100 else false end as weak_file,
    bko < case segment when 'THIN' then 715 else 670 end as weak_bko,
    case segment when 'THICK' then cvsc100 >= 640 and (thick >= 521 or (thick >= 489 and cvsc100 >= 669) or (thick >= 475 and cvsc100 >= 690))
                 when 'THIN' then cvsc100 >= 640 and ((thin >= 641 and cvsc100 >= 680) or (thin >= 656 and cvsc100 >= 669))
                 when 'SUBPRIME' then cvsc100 between 600 and 640 and subprime >= 575 else false end as tree_pass
  from candidates),
decided as (
  select *, case when change = 0 then '1. TU Score Same' when change > 0 then '2. TU Score Better Now' when change >= -20 then '3. Dropped Upto 20 Points'
                 when change >= -50 then '4. Dropped Between 20 to 50 Points' when change < -50 then '5. Dropped More Than 50 Points'
                 else '6. Unknown' end as score_movement,
         case when policy_fail = 0 and not weak_file and not weak_bko and tree_pass then 1 else 0 end as approves
  from parts),
screened as (
  select *,
    case when junior_10 = 1 then '1. Fraud Junior Exclusion' when fraud_remove is not null then '2. Fraud Checks Failed'
         when has_untrusted_payment = 1 then '3. Fraud Non Trusted Payment' when policy_fail = 1 then '4. Credit Policy Exclusion'
         when cash_advance = 1 then '5. Credit Cash Advance' when confirmed_purchase = 0 then '6. Credit Confirmed Purchase'
         when ever_late = 1 then '7. Credit Delinquency' when original_ok = 0 or latest_ok = 0 then '7. Credit Score Sub Prime'
         when trades_increased = 1 then '8. Credit AM41 Increase' when change < -50 then '9. Credit Score Dropped More Than 50 Points'
         when target_segment = 0 then '15. Not Target Segment CL Accounts' else '16. Criteria Pass' end as waterfall,
    case when approves = 0 then '0. Current Strategy' when junior_10 = 1 then '1. Fraud Junior Exclusion' when fraud_remove is not null then '2. Fraud Checks Failed'
         when has_untrusted_payment = 1 then '3. Fraud Non Trusted Payment' when policy_fail = 1 then '5. Credit Policy Exclusion'
         when cash_advance = 1 then '6. Credit Cash Advance' when confirmed_purchase = 0 then '7. Credit Confirmed Purchase'
         when ever_late = 1 then '8. Credit Delinquency' when original_ok = 0 or latest_ok = 0 then '9. Credit Score Sub Prime'
         when trades_increased = 1 then '10. Credit AM41 Increase' when change < -50 then '11. Credit Score Dropped More Than 50 Points'
         when behaviour_score >= 0 and behaviour_score < 600 then '12. High Risk Behavior Score' when payment_amount is null then '13. No Payment Amount'
         when frozen_reason is not null then '14. User Frozen' else '15. Criteria Pass' end as final_waterfall,
    case when original_score_band like 'c.%' then case when credit_limit < 701 then 1000 when credit_limit >= 701 then 1200 else 0 end
         when original_score_band like 'd.%' then case when credit_limit < 1000 then 1200 when credit_limit < 1800 then 1500 when credit_limit >= 1800 then 2000 else 0 end
         when original_score_band like 'e.%' then 2000 when original_score_band like 'f.%' then 2500 else 0 end as line_amount
  from decided)
"""
)


@query(
    "waterfall_flow",
    SCREENED
    + """, links as (
           select 1 as step, score_movement as source, waterfall as target from screened
           union all select 2, waterfall, final_waterfall from screened)
         select step, source, target, cast(count(*) as bigint) as value from links group by 1, 2, 3""",
)
def waterfall_flow(spark, sf_dir):
    return plain(flow_edges(screened(spark, sf_dir), ["score_movement", "waterfall", "final_waterfall"]))


@query(
    "campaign_audience",
    SCREENED
    + """select offer_id, account_id, original_score_band, cast(credit_limit as integer) as credit_limit, cast(line_amount as integer) as line_amount,
                case when brand in ('BUILDING', 'FURNITURE', 'AUTOMOBILE') then 'Home_World' end as brand_product
         from screened where day_on_book > 90 and day_on_book < 179 and coalesce(cli_flag, 0) = 0 and final_waterfall = '15. Criteria Pass'
           and brand in ('BUILDING', 'FURNITURE', 'AUTOMOBILE')""",
)
def campaign_audience(spark, sf_dir):
    products = c("brand").isin("BUILDING", "FURNITURE", "AUTOMOBILE")
    passed = (c("had_cli") == 0) & (c("final_waterfall") == campaign.FINAL_PASS)
    rows = screened(spark, sf_dir).filter(campaign.campaign_window() & passed & products)
    product = F.when(products, "Home_World").alias("brand_product")
    return plain(rows.select("offer_id", "account_id", "original_score_band", "credit_limit", "line_amount", product))


@query(
    "redecision",
    SCREENED
    + """select segment, policy_fail as public_record_reject, case when weak_file then 1 else 0 end as strategy_reject,
                case when weak_bko then 1 else 0 end as bankruptcy_reject, case when tree_pass then 0 else 1 end as tree_reject,
                approves as current_strategy_approves, cast(count(*) as bigint) as n
         from screened group by all""",
)
def redecision(spark, sf_dir):
    keys = ["segment", "public_record_reject", "strategy_reject", "bankruptcy_reject", "tree_reject", "current_strategy_approves"]
    return plain(screened(spark, sf_dir).groupBy(*keys).agg(n_rows().alias("n")))


@query(
    "score_cuts",
    SCORED
    + """, graded as (
           select s.*, c.c_mktsegment as brand, case mod(c.c_nationkey, 3) when 0 then 'WORLD_ELITE' when 1 then 'WORLD' else 'STANDARD' end as card_type,
                  case mod(c.c_custkey, 2) when 0 then '1. SUBPRIME' else '3. PRIME' end as tu_band,
                  500 + cast(prediction * 100 as decimal(6,2)) * 2 as beh_score, 600 + cast(prediction * 100 as decimal(6,2)) as bko_score
           from scored s left join customer c on c.c_custkey = s.account_id)
         select request_id, case when bko_score > 680 then 'Pass' else 'Fail' end as bko_cut,
                case when brand = 'BUILDING' and beh_score > 594 then 'Pass' when brand in ('FURNITURE', 'MACHINERY') and beh_score > 620 then 'Pass'
                     when brand = 'HOUSEHOLD' and beh_score > 680 then 'Pass' else 'Fail' end as beh_cut,
                case when prediction >= 0.7 then 'high risk' else 'low risk' end as risk_label,
                case when card_type = 'WORLD_ELITE' and prediction >= 1 then 1 when card_type = 'WORLD' and prediction >= 0.9 then 1
                     when card_type = 'STANDARD' and tu_band = '1. SUBPRIME' and prediction >= 0.7 then 1 else 0 end as backtest_flag
         from graded""",
)
def score_cuts(spark, sf_dir):
    customers = standin(spark, sf_dir, "customer").select("c_custkey", c("c_mktsegment").alias("brand"), "c_nationkey")
    rows = attach(scored_offers(spark, sf_dir), customers, [("account_id", "c_custkey")])
    points = (c("prediction") * 100).cast("decimal(6,2)")
    rows = rows.withColumns(
        {
            "card_type": F.when(c("c_nationkey") % 3 == 0, "WORLD_ELITE").when(c("c_nationkey") % 3 == 1, "WORLD").otherwise("STANDARD"),
            "tu_band": F.when(c("account_id") % 2 == 0, "1. SUBPRIME").otherwise("3. PRIME"),
            "beh_score": points * 2 + 500,
            "bko_score": points + 600,
        }
    )
    return plain(
        rows.select(
            "request_id",
            cuts.bankruptcy_cut().alias("bko_cut"),
            cuts.behaviour_cut(BRANDS).alias("beh_cut"),
            cuts.high_risk("prediction").alias("risk_label"),
            cuts.backtest_flag("prediction").alias("backtest_flag"),
        )
    )

