"""The request funnel and the score studies over the stand-in portfolio."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from limitloom.functions import cond_count, zero_if_null
from limitloom.operators import member_flag
from limitloom.plans import request_funnel as funnel
from limitloom.plans import score_studies as studies
from limitloom.plans import vintage_tracker as vt
from limitloom.plans.population import monthly_margin, unsecured_offers
from limitloom.queries.registry import AS_OF, query
from limitloom.queries.rules import BRANDS, JUDGED, OVERRIDE_SQL, overridden
from limitloom.queries.shape import plain, steady_sql
from limitloom.queries.vintage import GATED, branded_performance
from limitloom.session import durable
from limitloom.sources.standins import cte, standin

c = F.col
CUTOFF = dt.datetime(1999, 6, 30)


def funnelled(spark, sf_dir):
    known = {}
    get = lambda name: standin(spark, sf_dir, name, known)
    requested = funnel.requests_with_offers(get("requests"), get("offer_book"), AS_OF, before=dt.date(2001, 7, 1))
    return funnel.funnel(requested, get("wide_performance"), span=(0, 0)), get


FUNNEL = """
funnelled as (
  select r.request_id, r.user_id, r.account_id, r.offer_id, r.created_at, left(cast(r.created_at as varchar), 7) as cli_vintage,
         case when b.offer_id is null then 'Not Approved' else 'Approved' end as approve_status,
         case when b.offer_id is null then 'Not Approved' when b.strategy like '%QC%' or b.strategy like '%PRTV%' then 'not in V2 strategy'
              when b.declined_at is not null then 'Declined' when b.accepted_at is not null then 'Accepted'
              when datediff('day', b.created_at, date '2001-08-01') < 31 then 'In progress' else 'Expired' end as accept_status,
         b.limit_cents_at_offer / 100.0 as icl, (b.offered_limit_cents - b.limit_cents_at_offer) / 100.0 as cli_offer,
         p.stmt_mth, coalesce(b.limit_cents_at_offer / 100.0, p.cl) as icl_adj, datediff('month', p.booking_date, p.stmt_date) as mob,
         case when coalesce(b.limit_cents_at_offer / 100.0, p.cl) <= 1500 then '1, <=1.5k ICL' else '2,>1.5k ICL' end as icl_bucket,
         case when p.tu_band in ('1. SUBPRIME', '2. NEAR_PRIME', '3. PRIME') then '1, Low TU' else '2, High TU' end as tu_bucket
  from requests r left join offer_book b on b.offer_id = r.offer_id
  join wide_performance p on p.account_id = r.account_id and p.secure_type = 'UNSECURED'
    and datediff('month', cast(coalesce(b.accepted_at, b.declined_at, r.created_at) as date), p.stmt_date) = 0
  where r.created_at < timestamp '2001-07-01 00:00:00')"""
FUNNEL_VIEWS = ("requests", "offer_book", "wide_performance")


@query(
    "expired_by_limit",
    cte(*FUNNEL_VIEWS)
    + ","
    + FUNNEL
    + """select case when icl_adj <= 100 then '1, <=100' when icl_adj <= 1500 then '2, 100-1500' when icl_adj <= 3000 then '3,1500-3000'
                     when icl_adj <= 7000 then '4,3000-7000' else '5,>7000' end as limit_bucket,
                cast(count(*) filter (where accept_status = 'Expired') as bigint) as expired_count, cast(count(*) as bigint) as total_count
         from funnelled where approve_status = 'Approved' group by 1 having expired_count > 0""",
)
def expired_by_limit(spark, sf_dir):
    return plain(funnel.expired_by_limit(funnelled(spark, sf_dir)[0]))


@query(
    "approval_grid",
    cte(*FUNNEL_VIEWS)
    + ","
    + FUNNEL
    + """select icl_bucket, tu_bucket, case when mob <= 12 then '1, <= 1yr MOB' when mob <= 24 then '2, <= 2yr MOB' else '3, >2yr MOB' end as mob_bucket,
                cast(count(*) filter (where approve_status = 'Approved') as bigint) as approved_count, cast(count(*) as bigint) as total_count
         from funnelled group by 1, 2, 3""",
)
def approval_grid(spark, sf_dir):
    return plain(funnel.approval_grid(funnelled(spark, sf_dir)[0]))


LARGE = ", large as (select * from funnelled where icl <= 1500 and cli_offer > 4000 and approve_status = 'Approved')"


@query(
    "decrease_free_history",
    cte(*FUNNEL_VIEWS, "sent_decreases", "marked_accounts", "offers")
    + ","
    + FUNNEL
    + LARGE
    + """, kept as (select l.* from large l
           left join (select distinct account_id from sent_decreases where strategy <> 'LOW-UTIL') d on d.account_id = l.account_id
           left join marked_accounts m on m.account_id = l.account_id where d.account_id is null and m.account_id is null),
         past as (select account_id, count(*) as n, min(offer_mth) as first_offer_mth, max(offer_mth) as last_offer_mth, max(offer_limit) as highest_cl
                  from offers where accepted_flag = 1 group by account_id)
         select k.request_id, k.account_id, k.stmt_mth as request_mth, cast(k.icl as double) as icl, cast(k.cli_offer as double) as cli_offer,
                cast(coalesce(t.n, 0) as bigint) as accepted_offers, t.first_offer_mth, t.last_offer_mth, cast(t.highest_cl as double) as highest_cl,
                o.offer_mth, cast(o.offer_limit as double) as new_cl
         from kept k left join past t on t.account_id = k.account_id
         left join offers o on o.account_id = k.account_id and o.accepted_flag = 1""",
)
def decrease_free_history(spark, sf_dir):
    rows, get = funnelled(spark, sf_dir)
    decreases = get("sent_decreases").filter(c("strategy") != "LOW-UTIL")
    kept = funnel.without_decrease(funnel.large_low_limit(rows), decreases, get("marked_accounts"))
    out = funnel.accepted_listing(kept, get("offers").withColumn("new_cl", c("offer_limit")))
    out = out.withColumn("accepted_offers", zero_if_null("accepted_offers"))
    cols = ["request_id", "account_id", "request_mth", "icl", "cli_offer", "accepted_offers", "first_offer_mth", "last_offer_mth", "highest_cl"]
    return plain(out.select(*cols, "offer_mth", "new_cl"))


@query(
    "accepted_history",
    cte(*FUNNEL_VIEWS, "sent_decreases", "marked_accounts", "offers")
    + ","
    + FUNNEL
    + LARGE
    + """, kept as (select l.* from large l
           left join (select distinct account_id from sent_decreases where strategy <> 'LOW-UTIL') d on d.account_id = l.account_id
           left join marked_accounts m on m.account_id = l.account_id where d.account_id is null and m.account_id is null)
         select k.request_id, k.account_id, k.stmt_mth as request_mth, cast(k.icl as double) as icl, o.offer_mth, cast(o.offer_limit as double) as new_cl,
                cast(o.offer_limit - o.cli_mob as double) as current_cl, cast(o.cli_mob as double) as inc_exposure, o.tu_band as program
         from kept k left join offers o on o.account_id = k.account_id and o.accepted_flag = 1""",
)
def accepted_history(spark, sf_dir):
    rows, get = funnelled(spark, sf_dir)
    decreases = get("sent_decreases").filter(c("strategy") != "LOW-UTIL")
    kept = funnel.without_decrease(funnel.large_low_limit(rows), decreases, get("marked_accounts"))
    view = get("offers").select("account_id", "accepted_flag", "offer_mth", c("offer_limit").alias("new_cl"), (c("offer_limit") - c("cli_mob")).alias("current_cl"), c("cli_mob").alias("inc_exposure"), c("tu_band").alias("program"))
    out = funnel.accepted_history(kept, view).withColumn("inc_exposure", c("inc_exposure").cast("double"))
    return plain(out.select("request_id", "account_id", "request_mth", "icl", "offer_mth", "new_cl", "current_cl", "inc_exposure", "program"))


@query(
    "restored_above_decrease",
    cte(*FUNNEL_VIEWS, "sent_decreases")
    + ","
    + FUNNEL
    + LARGE
    + """select l.request_id, l.stmt_mth as request_mth, cast(l.icl + l.cli_offer as double) as request_new_cl,
                cast(count(*) over (partition by l.request_id, l.stmt_mth, l.icl, l.cli_offer) as bigint) as decreases,
                left(cast(d.initiated_at as varchar), 10) as initiated_on, cast(d.previous_limit_cents / 100.0 as double) as cld_prev_cl
         from large l join sent_decreases d on d.account_id = l.account_id
         where d.strategy = 'LOW-UTIL' and l.icl + l.cli_offer > d.previous_limit_cents / 100.0""",
)
def restored_above_decrease(spark, sf_dir):
    rows, get = funnelled(spark, sf_dir)
    decreases = get("sent_decreases").filter(c("strategy") == "LOW-UTIL").withColumn("new_limit_cents", F.lit(0).cast("bigint"))
    out = funnel.restored_pairs(durable(funnel.large_low_limit(rows), "large"), decreases)
    cols = ["request_id", "request_mth", "request_new_cl", "decreases"]
    return plain(out.select(*cols, F.to_date("initiated_at").alias("initiated_on"), c("prev_cl").alias("cld_prev_cl")))


@query(
    "restored_listing",
    cte(*FUNNEL_VIEWS, "sent_decreases")
    + ","
    + FUNNEL
    + LARGE
    + """select l.request_id, l.account_id, l.stmt_mth as request_mth, cast(l.icl + l.cli_offer as double) as request_new_cl,
                strftime(d.initiated_at, '%Y-%m-%d') as decreased_on, cast(d.previous_limit_cents / 100.0 as double) as prev_cl,
                cast(floor(d.previous_limit_cents / 2) / 100.0 as double) as decreased_cl
         from large l join sent_decreases d on d.account_id = l.account_id
         where d.initiated_at is not null and l.icl + l.cli_offer > d.previous_limit_cents / 100.0""",
)
def restored_listing(spark, sf_dir):
    rows, get = funnelled(spark, sf_dir)
    decreases = get("sent_decreases").withColumn("new_limit_cents", F.floor(c("previous_limit_cents") / 2))
    out = funnel.restored_listing(funnel.large_low_limit(rows), decreases)
    out = out.withColumn("decreased_on", F.date_format("initiated_at", "yyyy-MM-dd"))
    return plain(out.select("request_id", "account_id", "request_mth", "request_new_cl", "decreased_on", "prev_cl", "decreased_cl"))


@query(
    "request_reconciliation",
    cte(*FUNNEL_VIEWS, "sent_decreases")
    + ","
    + FUNNEL
    + """select accept_status, cast(count(*) as bigint) as n,
                cast(count(*) filter (where account_id in (select account_id from sent_decreases)) as bigint) as with_decrease,
                cast(count(*) filter (where account_id not in (select account_id from sent_decreases)) as bigint) as without_decrease
         from funnelled group by accept_status""",
)
def request_reconciliation(spark, sf_dir):
    rows, get = funnelled(spark, sf_dir)
    flagged = member_flag(rows.select("account_id", "accept_status"), get("sent_decreases"), "account_id", "decreased")
    return plain(
        flagged.groupBy("accept_status").agg(
            F.count(F.lit(1)).alias("n"),
            cond_count(c("decreased") == 1).alias("with_decrease"),
            cond_count(c("decreased") == 0).alias("without_decrease"),
        )
    )


GATE_COLUMNS = [
    "offer_id", "account_id", "not_frozen", "policy_exclusion_flag", "currently_delinquent", "delinquent_3m", "payment_flag", "inquiry_flag",
    "recent_cli", "bureau_segment_flag", "am36_flag", "cld_block", "account_type", "restriction", "go26", "standing", "score_flag",
    "sub_prime_flag", "bureau_score_clean", "mob_rounded", "day_end_limit", "brand", "segment", "province_group",
]


@query(
    "eligibility_reasons",
    JUDGED.rstrip()
    + ",\n"
    + cte(*FUNNEL_VIEWS).removeprefix("with ").replace("offers as (", "offers_again as (", 1).replace("accounts as (", "accounts_again as (", 1)
    + ","
    + FUNNEL
    + f""", log as (
           select account_id, cast(offer_date + cast(mod(offer_id, 60) as integer) as timestamp) as adjudicated_at, offer_id as log_id,
                  * exclude (segment, account_id, offer_id, mob_rounded, credit_limit, strategy, accepted_at, declined_at),
                  coalesce({OVERRIDE_SQL}, segment) as segment_now
           from judged),
         picked as (
           select f.cli_vintage, f.approve_status, f.icl_bucket, f.tu_bucket, g.*
           from (select * from funnelled where created_at > timestamp '1999-12-31 00:00:00') f
           left join log g on g.account_id = f.account_id and g.adjudicated_at > f.created_at
           qualify row_number() over (partition by f.request_id order by g.adjudicated_at nulls last, g.log_id) = 1)
         select icl_bucket, tu_bucket,
                case when policy_exclusion_flag <> 0 then '01, Policy exclusion' when currently_delinquent <> 0 then '02, Delinquency status'
                 when payment_flag <> 1 then '03, Payment Balance' when inquiry_flag <> 0 then '04, Inquiry record'
                 when sub_prime_flag = 0 and score_flag <> 1 then '05, Bureau score flag' when recent_cli <> 0 then '06, Received CLI in last 3m'
                 when bureau_segment_flag <> 0 then '07, Bureau Segment flag'
                 when day_end_limit is null or day_end_limit <= 100 or day_end_limit > case sub_prime_flag when 0 then 9000 else 3000 end then '08, ICL restriction'
                 when segment_now in ('International', 'World / World Elite', 'MultiCredit') then '09, Inter, w/we, multi' else 'other' end as reject_bucket,
                cast(count(*) as bigint) as n
         from picked where cli_vintage > '2000-03' and approve_status = 'Not Approved' group by 1, 2, 3""",
)
def eligibility_reasons(spark, sf_dir):
    rows, _ = funnelled(spark, sf_dir)
    judged = overridden(spark, sf_dir)
    stamp = F.date_add("offer_date", (c("offer_id") % 60).cast("int")).cast("timestamp")
    log = judged.select(*[x for x in GATE_COLUMNS if x != "offer_id"], c("offer_id").alias("log_id"), stamp.alias("adjudicated_at"))
    adjudicated = funnel.with_eligibility(rows, log, dt.date(1999, 12, 31), tiebreak=("log_id",))
    return plain(funnel.reject_bucket_counts(adjudicated, "2000-03"))


@query(
    "vintage_drilldown",
    GATED
    + """select account_id, offer_id, cast(offer_date as varchar) as offer_date, stmt_mth, cast(guco as double) as guco from tracked
         where accepted_flag = 1 and brand = 'BUILDING' and offer_vintage = '2000-04' and stmt_mth = '2000-08' and guco > 0""",
)
def vintage_drilldown(spark, sf_dir):
    offers = unsecured_offers(standin(spark, sf_dir, "offers")).filter((c("accepted_flag") == 1) & (c("offer_mth") == "2000-04"))
    perf = monthly_margin(branded_performance(spark, sf_dir)).filter((c("brand") == "BUILDING") & (c("stmt_mth") == "2000-08") & (c("guco") > 0))
    tracked = vt.track(offers.select("account_id", "offer_id", "offer_date"), perf, how="inner")
    return plain(tracked.select("account_id", "offer_id", "offer_date", "stmt_mth", "guco").orderBy("offer_date"))


@query(
    "multi_score_averages",
    cte("offers", "offer_scores", "wide_performance", "behaviour_history", "sent_offers", "bankruptcy_history")
    + """, users as (select distinct account_id, user_id, strategy from sent_offers),
         scored as (
           select o.account_id, o.offer_mth, s.prediction, b.model_score, k.score
           from offers o
           join offer_scores s on s.account_id = o.account_id and cast(s.reference_date as date) = o.offer_date
           left join behaviour_history b on b.account_id = o.account_id
             and date_trunc('month', b.reference_date) = date_trunc('month', o.offer_date - interval 1 month)
           left join users u on u.account_id = o.account_id
           left join bankruptcy_history k on k.user_id = u.user_id and left(cast(k.reference_date as varchar), 7) = o.offer_mth
           join wide_performance p on p.account_id = o.account_id and datediff('month', o.offer_date, p.stmt_date) = 1
           where o.accepted_flag = 1 and s.prediction >= 0.7 and o.sub_product = 'UNSECURED' and o.cli_mob > 6 and p.secure_type = 'UNSECURED')
         select offer_mth as offer_vintage, 'high risk' as high_risk_flag, avg(model_score) as avg_beh, avg(score) as avg_bko
         from scored group by offer_mth""",
)
def multi_score_averages(spark, sf_dir):
    known = {}
    get = lambda name: standin(spark, sf_dir, name, known)
    offers = get("offers").select("account_id", "offer_date", "accepted_flag", "sub_product", "cli_mob")
    args = [get(n) for n in ("offer_scores", "wide_performance", "behaviour_history", "sent_offers", "bankruptcy_history")]
    return plain(studies.average_scores(studies.multi_score(offers, *args, BRANDS, span=(1, 1))))


def _backtest(spark, sf_dir, only_after_offer):
    known = {}
    get = lambda name: standin(spark, sf_dir, name, known)
    scores = get("month_scores")
    # the backfill covers the live months too, with other values, so that either side's rows show
    backfill = scores.withColumn("prediction", c("prediction") / 2)
    brands = ["BUILDING", "FURNITURE"]
    rows = studies.backtest(get("offers"), get("wide_performance"), backfill, scores, CUTOFF, brands, only_after_offer)
    grid = rows.groupBy("brand", c("risk_stmt").cast("bigint").alias("risk_stmt"))
    return plain(grid.agg(F.sum("n_offers").alias("n"), vt.weighted_sum("raim", "raim")))


BACKTEST = (
    cte("offers", "wide_performance", "month_scores")
    + """, rows0 as (
           select o.offer_id, o.account_id, o.offer_date, p.stmt_date, p.brand, p.raim, datediff('month', o.offer_date, p.stmt_date) as cli_stmt,
                  (p.card_type = 'WORLD_ELITE' and s.prediction >= 1) or (p.card_type = 'WORLD' and s.prediction >= 0.9)
                  or (p.card_type = 'STANDARD' and p.tu_band = '1. SUBPRIME' and s.prediction >= 0.7) as hit
           from offers o join wide_performance p on p.account_id = o.account_id
           join (select account_id, reference_date, case when reference_date <= timestamp '1999-06-30 00:00:00' then prediction / 2 else prediction end as prediction
                 from month_scores) s on s.account_id = p.account_id and cast(s.reference_date as date) = cast(p.stmt_mth || '-01' as date)
           where p.brand in ('BUILDING', 'FURNITURE') and o.sub_product = 'UNSECURED' and o.cli_mob > 6 and p.secure_type = 'UNSECURED' and {0}),
         marked as (select *, min(case when hit then stmt_date end) over (partition by account_id, offer_date) as risk_date from rows0)
         select brand, cast(datediff('month', risk_date, stmt_date) as bigint) as risk_stmt, cast(count(*) as bigint) as n, cast(sum(raim) as double) as raim
         from marked where datediff('month', risk_date, stmt_date) > 0 group by 1, 2"""
)


@query("backtest_all_months", BACKTEST.replace("{0}", "true"))
def backtest_all_months(spark, sf_dir):
    return _backtest(spark, sf_dir, False)


@query("backtest_after_offer", BACKTEST.replace("{0}", "datediff('month', o.offer_date, p.stmt_date) > 0"))
def backtest_after_offer(spark, sf_dir):
    return _backtest(spark, sf_dir, True)


@query(
    "tranche_risk_mix",
    cte("offers", "offer_scores", "wide_performance")
    + """select o.offer_mth as offer_vintage, cast(count(*) filter (where s.prediction < 0.7) as bigint) as low_risk_accts,
                cast(count(*) filter (where s.prediction >= 0.7) as bigint) as high_risk_accts,
                cast(high_risk_accts as double) / nullif(high_risk_accts + low_risk_accts, 0) as high_risk_ratio
         from offers o
         join (select account_id, reference_date, case when reference_date <= timestamp '1999-06-30 00:00:00' then prediction / 2 else prediction end as prediction
               from offer_scores) s on s.account_id = o.account_id and cast(s.reference_date as date) = o.offer_date
         join wide_performance p on p.account_id = o.account_id and datediff('month', o.offer_date, p.stmt_date) = 1
         where o.accepted_flag = 1 and p.brand = 'BUILDING' and s.prediction is not null and o.sub_product = 'UNSECURED' and o.cli_mob > 6 and p.secure_type = 'UNSECURED' group by o.offer_mth""",
)
def tranche_risk_mix(spark, sf_dir):
    known = {}
    get = lambda name: standin(spark, sf_dir, name, known)
    scores = get("offer_scores")
    backfill = scores.withColumn("prediction", c("prediction") / 2)
    return plain(studies.tranche_risk_mix(get("offers"), get("wide_performance"), backfill, scores, CUTOFF, "BUILDING"))


def study(spark, sf_dir):
    known = {}
    get = lambda name: standin(spark, sf_dir, name, known)
    offers = get("offers").select("account_id", "offer_id", "offer_date", "accepted_flag", "sub_product", "cli_mob")
    return studies.CutStudy(offers, get("offer_scores"), get("wide_performance"), get("marked_accounts"), "1997-07", "2000-06")


STUDY = (
    cte("offers", "offer_scores", "wide_performance", "marked_accounts")
    + """, study as (
           select o.account_id, o.offer_id, o.offer_date, o.offer_mth, o.accepted_flag, s.prediction, p.brand, p.raim,
                  'Bucket' || cast(cast(floor(s.prediction * 10) as bigint) as varchar) as score_bucket,
                  datediff('month', o.offer_date, p.stmt_date) as cli_stmt,
                  case when o.account_id in (select account_id from marked_accounts) then 1 else 0 end as risk
           from offers o join offer_scores s on s.account_id = o.account_id and cast(s.reference_date as date) = o.offer_date
           join wide_performance p on p.account_id = o.account_id where o.offer_mth between '1997-07' and '2000-06' and s.prediction is not null and o.sub_product = 'UNSECURED' and o.cli_mob > 6 and p.secure_type = 'UNSECURED')"""
)


@query(
    "study_margin_curves",
    STUDY
    + """, monthly as (select brand, score_bucket, cli_stmt, sum(raim) as raim from study
                       where accepted_flag = 1 and cli_stmt between 1 and 12 group by 1, 2, 3)
         select brand, score_bucket, cast(cli_stmt as bigint) as cli_stmt, cast(raim as double) as raim,
                cast(sum(raim) over (partition by brand, score_bucket order by cli_stmt) as double) as raim_cuml from monthly""",
)
def study_margin_curves(spark, sf_dir):
    out = study(spark, sf_dir).margin_curves()
    return plain(out.withColumn("cli_stmt", c("cli_stmt").cast("bigint")))


@query(
    "study_increment",
    STUDY
    + f""", monthly as (select accepted_flag, score_bucket, cli_stmt, cast(sum(raim) as double) / count(raim) as raim, count(*) as n from study
                       where brand = 'BUILDING' and cli_stmt between 1 and 12 group by 1, 2, 3)
         select score_bucket, {steady_sql('sum(a.raim)', 3)} as raim_nonresponder, {steady_sql('sum(b.raim)', 3)} as raim_responder,
                cast(max(a.n) as bigint) as accounts_nonresponder, cast(max(b.n) as bigint) as accounts_responder, {steady_sql('sum(b.raim) - sum(a.raim)', 3)} as diff
         from (select * from monthly where accepted_flag = 0) a join (select * from monthly where accepted_flag = 1) b using (score_bucket, cli_stmt)
         group by score_bucket""",
)
def study_increment(spark, sf_dir):
    return plain(study(spark, sf_dir).increment("BUILDING"), places=3)


@query(
    "study_cut_points",
    STUDY
    + """, base as (select * from study where accepted_flag = 1 and cli_stmt = 1 and brand = 'BUILDING'),
         cuts as (select cast(unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as double) as cut)
         select cut as cut_level,
                cast(count(*) filter (where risk = 0 and prediction >= cut) as double) / nullif(count(*) filter (where risk = 0), 0) as non_hram_cut_percentage,
                cast(count(*) filter (where risk = 0 and prediction >= cut) as bigint) as non_hram_cut_volume,
                cast(count(*) filter (where risk = 1 and prediction >= cut) as double) / nullif(count(*) filter (where risk = 1), 0) as hram_cut_percentage,
                cast(count(*) filter (where risk = 1 and prediction >= cut) as bigint) as hram_cut_volume
         from base cross join cuts group by cut""",
)
def study_cut_points(spark, sf_dir):
    return plain(study(spark, sf_dir).cut_points("BUILDING"))


@query(
    "study_repeat_scores",
    STUDY
    + f""", active as (select * from study where accepted_flag = 1 and brand = 'BUILDING' and cli_stmt between 1 and 12),
         days as (select distinct account_id, offer_date from active),
         numbered as (select *, row_number() over (partition by account_id order by offer_date) > 1 as multi from days),
         means as (select offer_mth, multi, sum(cast(prediction as decimal(12,4))) / count(*) as score
                   from active join numbered using (account_id, offer_date) where cli_stmt = 1 group by 1, 2)
         select m.offer_mth as offer_vintage, {steady_sql('m.score', 6)} as score_multi, {steady_sql('s.score', 6)} as score_single
         from (select * from means where multi) m left join (select * from means where not multi) s using (offer_mth)""",
)
def study_repeat_scores(spark, sf_dir):
    return plain(study(spark, sf_dir).repeat_scores("BUILDING"), places=6)


@query(
    "study_repeat_margin",
    STUDY
    + f""", active as (select * from study where accepted_flag = 1 and brand = 'BUILDING' and cli_stmt between 1 and 12),
         days as (select distinct account_id, offer_date from active),
         numbered as (select *, row_number() over (partition by account_id order by offer_date) > 1 as multi from days),
         monthly as (select offer_mth, multi, cli_stmt, cast(sum(raim) as double) / count(raim) as raim
                     from active join numbered using (account_id, offer_date) group by 1, 2, 3),
         sums as (select offer_mth, multi, sum(raim) as raim from monthly group by 1, 2)
         select m.offer_mth as offer_vintage, {steady_sql('m.raim', 3)} as raim_multi, {steady_sql('s.raim', 3)} as raim_single
         from (select * from sums where multi) m left join (select * from sums where not multi) s using (offer_mth)""",
)
def study_repeat_margin(spark, sf_dir):
    return plain(study(spark, sf_dir).repeat_margin("BUILDING"), places=3)
