"""Grouped tables: conditional counts, ratios, thresholds, cut points, distributions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from limitloom.functions import band, cond_count, cond_sum, first_match, safe_ratio, score_bucket, within_days, zero_if_null
from limitloom.operators import (
    any_and_any,
    attach,
    attach_on_day,
    bucket_histogram,
    count_of_counts,
    cut_points,
    distinct_values,
    ever_flags,
    latest_per_key,
    member_flag,
)
from limitloom.queries.attach import DAILY_SCORES, daily_scores
from limitloom.queries.registry import EVENTS_AS_OF, query
from limitloom.queries.shape import plain
from limitloom.rulesets.campaign import JUNIOR_CUTS
from limitloom.rulesets.cuts import high_risk
from limitloom.rulesets.reactive import restriction_flag
from limitloom.sources import run_sql
from limitloom.sources.standins import cte, standin

c = F.col

LIMIT_EDGES = [50000, 150000, 300000, 450000]
LIMIT_LABELS = ["1, <=50k", "2, 50k-150k", "3, 150k-300k", "4, 300k-450k", "5, >450k"]


def n_rows():
    return F.count(F.lit(1))


@query(
    "bucket_rates",
    cte("offers")
    + """select case when offer_limit <= 50000 then '1, <=50k' when offer_limit <= 150000 then '2, 50k-150k'
                     when offer_limit <= 300000 then '3, 150k-300k' when offer_limit <= 450000 then '4, 300k-450k'
                     else '5, >450k' end as limit_bucket, tu_band,
                cast(count(case when status = 'P' then offer_id else null end) as bigint) as expired_count,
                cast(count(offer_id) as bigint) as total_count
         from offers group by 1, 2 having expired_count > 0""",
)
def bucket_rates(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers")
    bucket = band("offer_limit", LIMIT_EDGES, LIMIT_LABELS, missing=LIMIT_LABELS[-1]).alias("limit_bucket")
    grid = offers.groupBy(bucket, "tu_band").agg(
        cond_count(c("status") == "P", "offer_id").alias("expired_count"), F.count("offer_id").alias("total_count")
    )
    return plain(grid.filter(c("expired_count") > 0))


def scored_offers(spark, sf_dir):
    """Offers with the score of their day and the account's risk mark."""
    offers = standin(spark, sf_dir, "event_offers")
    scores = daily_scores(spark, sf_dir).select("account_id", "reference_date", "prediction")
    scored = attach_on_day(offers, scores, "account_id", "offer_date", "reference_date", how="inner")
    errors = standin(spark, sf_dir, "events").filter((c("event_type") == "error") & (c("value") >= 150))
    return member_flag(scored, errors.select(c("user_id").alias("account_id")), "account_id", "risk")


SCORED = (
    cte("event_offers", "event_scores")
    + ","
    + DAILY_SCORES
    + """,
scored as (
  select o.*, s.prediction,
         case when o.account_id in (select user_id from events where event_type = 'error' and value >= 150) then 1 else 0 end as risk
  from event_offers o join daily_scores s on s.account_id = o.account_id and s.reference_date = o.offer_date)
"""
)


@query(
    "risk_ratio",
    SCORED
    + """select cast(offer_date as varchar) as offer_date,
                cast(count(case when prediction < 0.7 then account_id end) as bigint) as low_risk_accts,
                cast(count(case when prediction >= 0.7 then account_id end) as bigint) as high_risk_accts,
                cast(high_risk_accts as double) / nullif(high_risk_accts + low_risk_accts, 0) as high_risk_ratio
         from scored group by offer_date""",
)
def risk_ratio(spark, sf_dir):
    grid = scored_offers(spark, sf_dir).groupBy("offer_date").agg(
        cond_count(c("prediction") < 0.7, "account_id").alias("low_risk_accts"),
        cond_count(c("prediction") >= 0.7, "account_id").alias("high_risk_accts"),
    )
    total = c("high_risk_accts") + c("low_risk_accts")
    return plain(grid.withColumn("high_risk_ratio", safe_ratio("high_risk_accts", total)))


@query(
    "vintage_avg",
    SCORED
    + """select cast(offer_date as varchar) as offer_date,
                case when prediction >= 0.7 then 'high risk' else 'low risk' end as high_risk_flag,
                cast(sum(cast(prediction as decimal(12,4))) as double) / count(prediction) as avg_score
         from scored group by 1, 2""",
)
def vintage_avg(spark, sf_dir):
    exact = F.sum(c("prediction").cast("decimal(12,4)")).cast("double")
    grid = scored_offers(spark, sf_dir).groupBy("offer_date", high_risk("prediction").alias("high_risk_flag"))
    return plain(grid.agg((exact / F.count("prediction")).alias("avg_score")))


@query(
    "reason_counts",
    cte("daily")
    + """select case when dpd > 1500 then '01' when return_flag = 'R' and dpd > 0 then '02' when status <> 'F' then '03'
                     when discount_like > 25 then '04' else 'other' end as reason, cast(count(*) as bigint) as n
         from (select *, quantity as discount_like from daily) group by 1""",
)
def reason_counts(spark, sf_dir):
    reason = first_match(
        [
            (c("dpd") > 1500, "01"),
            ((c("return_flag") == "R") & (c("dpd") > 0), "02"),
            (c("status") != "F", "03"),
            (c("quantity") > 25, "04"),
        ],
        "other",
    )
    return plain(standin(spark, sf_dir, "daily").groupBy(reason.alias("reason")).agg(n_rows().alias("n")))


@query(
    "ever_dpd_flags",
    cte("daily")
    + """select account_id, cast(max(dpd) as bigint) as max_dpd, case when max(dpd) > 0 then 1 else 0 end as ever_late,
                case when max(dpd) > 1000 then 1 else 0 end as ever_very_late
         from daily group by account_id""",
)
def ever_dpd_flags(spark, sf_dir):
    daily = standin(spark, sf_dir, "daily").withColumn("dpd", c("dpd").cast("bigint"))
    return plain(ever_flags(daily, "account_id", "dpd", {"ever_late": (">", 0), "ever_very_late": (">", 1000)}))


@query(
    "trailing_max_score",
    cte("event_scores")
    + """select account_id, max(prediction) as max_prediction,
                case when max(prediction) >= 0.1 then 1 else 0 end as junior_10,
                case when max(prediction) >= 0.15 then 1 else 0 end as junior_15,
                case when max(prediction) >= 0.2 then 1 else 0 end as junior_20
         from event_scores where reference_date > date '2024-01-31' - 30 and reference_date <= date '2024-01-31'
         group by account_id""",
)
def trailing_max_score(spark, sf_dir):
    recent = standin(spark, sf_dir, "event_scores").filter(within_days("reference_date", EVENTS_AS_OF, 30))
    return plain(ever_flags(recent, "account_id", "prediction", {n: (">=", cut) for n, cut in JUNIOR_CUTS.items()}))


@query(
    "null_vs_zero_flags",
    """select o_custkey as account_id,
              cast(sum(case when o_orderstatus = 'F' and o_totalprice > 400000 then 1 else null end) as bigint) as flagged_or_null,
              cast(sum(case when o_orderstatus = 'F' and o_totalprice > 400000 then 1 else 0 end) as bigint) as flagged_or_zero,
              case when sum(case when o_orderstatus = 'F' and o_totalprice > 400000 then 1 else null end) is null then 1 else 0 end as passed
       from orders group by o_custkey""",
)
def null_vs_zero_flags(spark, sf_dir):
    hit = (c("o_orderstatus") == "F") & (c("o_totalprice") > 400000)
    counts = standin(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("account_id")).agg(
        cond_sum(hit, empty=None).alias("flagged_or_null"), cond_sum(hit).alias("flagged_or_zero")
    )
    return plain(counts.withColumn("passed", c("flagged_or_null").isNull()))


@query(
    "any_any_flag",
    cte("lines")
    + """select account_id, case when sum(case when return_flag = 'R' then 1 else 0 end) > 0
                                  and sum(case when price >= 100000 then 1 else 0 end) > 0 then 1 else 0 end as flagged
         from lines group by account_id""",
)
def any_any_flag(spark, sf_dir):
    lines = standin(spark, sf_dir, "lines")
    return plain(any_and_any(lines, "account_id", c("return_flag") == "R", c("price") >= 100000, "flagged"))


@query(
    "payment_totals",
    cte("accounts", "lines")
    + """select a.account_id, cast(sum(l.price) as double) as payment_amount
         from accounts a left join lines l on l.account_id = a.account_id and l.return_flag = 'N' and l.price > 90000
         group by a.account_id""",
)
def payment_totals(spark, sf_dir):
    paid = standin(spark, sf_dir, "lines").filter((c("return_flag") == "N") & (c("price") > 90000))
    totals = paid.groupBy("account_id").agg(F.sum("price").alias("payment_amount"))
    return plain(attach(standin(spark, sf_dir, "accounts").select("account_id"), totals, "account_id"))


@query(
    "filtered_counts",
    cte("offers")
    + """, counts as (
           select account_id,
                  count(*) filter (where status = 'O' and tu_band < '3') as n_restricted,
                  count(*) filter (where status = 'F' and tu_band < '3') as n_reversed,
                  max(offer_date) filter (where status = 'F' and tu_band < '3') as last_reversed_at,
                  count(*) filter (where status = 'O' and tu_band >= '5') as n_risk_restricted,
                  count(*) filter (where status = 'F' and tu_band >= '5') as n_risk_reversed,
                  max(offer_date) filter (where status = 'F' and tu_band >= '5') as last_risk_reversed_at
           from offers group by all)
         select account_id, cast(n_restricted as bigint) as n_restricted, cast(n_reversed as bigint) as n_reversed,
                cast(n_risk_restricted as bigint) as n_risk_restricted, cast(n_risk_reversed as bigint) as n_risk_reversed,
                case when n_restricted > n_reversed or n_risk_restricted > n_risk_reversed then 1
                     when date_sub('day', cast(last_risk_reversed_at as timestamp), timestamp '2001-08-01 08:00:00') <= 180
                       or date_sub('day', cast(last_reversed_at as timestamp), timestamp '2001-08-01 08:00:00') <= 180 then 2
                     else 0 end as restriction
         from counts""",
)
def filtered_counts(spark, sf_dir):
    plain_kind, risk_kind = c("tu_band") < "3", c("tu_band") >= "5"
    counts = standin(spark, sf_dir, "offers").groupBy("account_id").agg(
        cond_count((c("status") == "O") & plain_kind).alias("n_restricted"),
        cond_count((c("status") == "F") & plain_kind).alias("n_reversed"),
        F.max(F.when((c("status") == "F") & plain_kind, c("offer_date"))).alias("last_reversed_at"),
        cond_count((c("status") == "O") & risk_kind).alias("n_risk_restricted"),
        cond_count((c("status") == "F") & risk_kind).alias("n_risk_reversed"),
        F.max(F.when((c("status") == "F") & risk_kind, c("offer_date"))).alias("last_risk_reversed_at"),
    )
    out = counts.withColumn("restriction", restriction_flag(F.lit(dt.datetime(2001, 8, 1, 8)).cast("timestamp")))
    return plain(out.drop("last_reversed_at", "last_risk_reversed_at"))


@query("distinct_domain", "select distinct o_orderstatus as status, o_orderpriority as tu_band from orders")
def distinct_domain(spark, sf_dir):
    return distinct_values(standin(spark, sf_dir, "offers"), "status", "tu_band")


@query(
    "latest_coverage",
    """select strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as latest, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as earliest,
              cast(count(*) as bigint) as n from events where event_type = 'view'""",
)
def latest_coverage(spark, sf_dir):
    views = standin(spark, sf_dir, "events").filter(c("event_type") == "view")
    return plain(views.agg(F.max("ts").alias("latest"), F.min("ts").alias("earliest"), n_rows().alias("n")))


@query(
    "group_all",
    """select o_orderstatus as status, o_orderpriority as tu_band, cast(count(*) as bigint) as n,
              cast(sum(cast(o_totalprice as decimal(12,2))) as double) as limit_sum
       from orders group by all""",
)
def group_all(spark, sf_dir):
    text = "select status, tu_band, count(*) as n, sum(offer_limit) as limit_sum from {offers} group by all"
    return plain(run_sql(spark, text, {"offers": standin(spark, sf_dir, "offers")}))


@query(
    "cut_point_table",
    SCORED
    + """, cuts as (select unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as cut),
         sizes as (select sum(1 - risk) as non_risk, sum(risk) as risk from scored)
         select cast(cut as double) as cut_level,
                cast(count(*) filter (where risk = 0 and prediction >= cut) as double) / (select nullif(non_risk, 0) from sizes) as non_hram_cut_percentage,
                cast(count(*) filter (where risk = 0 and prediction >= cut) as bigint) as non_hram_cut_volume,
                cast(count(*) filter (where risk = 1 and prediction >= cut) as double) / (select nullif(risk, 0) from sizes) as hram_cut_percentage,
                cast(count(*) filter (where risk = 1 and prediction >= cut) as bigint) as hram_cut_volume
         from scored cross join (select cast(cut as double) as cut from cuts) group by cut""",
)
def cut_point_table(spark, sf_dir):
    return plain(cut_points(scored_offers(spark, sf_dir), "prediction", c("risk") == 1, "account_id"))


@query(
    "bucket_histogram",
    SCORED
    + """select risk, 'Bucket' || cast(cast(floor(prediction * 10) as bigint) as varchar) as score_bucket, cast(count(*) as bigint) as n
         from scored group by 1, 2""",
)
def bucket_histogram_query(spark, sf_dir):
    scored = scored_offers(spark, sf_dir).withColumn("score_bucket", score_bucket("prediction"))
    return plain(bucket_histogram(scored, "score_bucket", "risk"))


@query(
    "user_account_counts",
    cte("accounts")
    + """, counts as (
           select nation_key, count(*) as n_accounts, count(*) filter (where brand like 'B%') as n_world
           from accounts where balance > 0 group by all),
         docs as (select nation_key, coalesce(nullif(brand, 'BUILDING'), 'CA') as issued_by from accounts
                  qualify row_number() over (partition by nation_key order by balance desc, account_id desc) = 1)
         select a.account_id, cast(coalesce(n.n_accounts, 0) as bigint) as n_accounts, cast(coalesce(n.n_world, 0) as bigint) as n_world,
                d.issued_by
         from accounts a left join counts n on n.nation_key = a.nation_key left join docs d on d.nation_key = a.nation_key""",
)
def user_account_counts(spark, sf_dir):
    accounts = standin(spark, sf_dir, "accounts")
    counts = accounts.filter(c("balance") > 0).groupBy("nation_key").agg(
        n_rows().alias("n_accounts"), cond_count(c("brand").like("B%")).alias("n_world")
    )
    docs = latest_per_key(accounts, "nation_key", ["balance", "account_id"], [])
    docs = docs.select("nation_key", F.coalesce(F.nullif(c("brand"), F.lit("BUILDING")), F.lit("CA")).alias("issued_by"))
    out = attach(accounts.select("account_id", "nation_key"), counts, "nation_key")
    out = attach(out, docs, "nation_key").drop("nation_key")
    return plain(out.withColumns({n: zero_if_null(n) for n in ("n_accounts", "n_world")}))


@query(
    "count_of_counts",
    cte("offers")
    + """select n_offers, cast(count(*) as bigint) as n_accounts from (
           select account_id, cast(count(*) as bigint) as n_offers from offers where accepted_flag = 1 group by account_id)
         group by n_offers""",
)
def count_of_counts_query(spark, sf_dir):
    accepted = standin(spark, sf_dir, "offers").filter(c("accepted_flag") == 1)
    return plain(count_of_counts(accepted, "account_id", "n_offers", "n_accounts"))


@query(
    "month_brand_counts",
    cte("offers", "accounts")
    + """select o.offer_mth, a.brand, cast(count(*) as bigint) as n,
                cast(sum(o.offer_limit) as double) / count(o.offer_limit) as avg_limit
         from offers o join accounts a on a.account_id = o.account_id
         where o.accepted_flag = 1 and a.balance is not null group by 1, 2""",
)
def month_brand_counts(spark, sf_dir):
    accepted = standin(spark, sf_dir, "offers").filter(c("accepted_flag") == 1)
    per_account = accepted.groupBy("account_id", "offer_mth").agg(n_rows().alias("n"), F.sum("offer_limit").alias("total"))
    accounts = standin(spark, sf_dir, "accounts").filter(c("balance").isNotNull()).select("account_id", "brand")
    out = attach(per_account, accounts, "account_id", "inner")
    grid = out.groupBy("offer_mth", "brand").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return plain(grid.select("offer_mth", "brand", "n", (c("total").cast("double") / c("n")).alias("avg_limit")))
