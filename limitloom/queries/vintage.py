"""Vintage tracking: attach performance, sum by month, pivot, cumulate, compare."""

from __future__ import annotations

from pyspark.sql import functions as F

from limitloom.functions import safe_ratio
from limitloom.operators import attach, attach_on_month, attach_prev_month, compare_groups, cumulative, group_total, mean_then_sum
from limitloom.plans import vintage_tracker as vt
from limitloom.queries.registry import query
from limitloom.queries.shape import plain, steady, steady_sql
from limitloom.sources.standins import cte, standin

c = F.col


def branded_performance(spark, sf_dir):
    """Monthly performance with the account's brand and a delinquency bucket label."""
    perf = standin(spark, sf_dir, "performance")
    accounts = standin(spark, sf_dir, "accounts").select("account_id", "brand")
    perf = perf.withColumn("dpd_bucket", F.concat(F.lit("B"), F.least(c("late_lines"), F.lit(7)).cast("string")))
    return attach(perf, accounts, "account_id")


TRACKED = (
    cte("offers", "performance", "accounts")
    + """,
tracked as (
  select o.account_id, o.offer_id, o.offer_date, o.offer_mth as offer_vintage, o.accepted_flag, o.tu_band, o.offer_limit,
         p.stmt_mth, p.stmt_date, p.guco, p.raim, p.adb, a.brand,
         'B' || cast(least(p.late_lines, 7) as varchar) as dpd_bucket,
         datediff('month', o.offer_date, p.stmt_date) as cli_stmt
  from offers o left join (performance p join accounts a on a.account_id = p.account_id) on p.account_id = o.account_id)
"""
)

# The same over unsecured offers and months only, as the tracker has it.
GATED = TRACKED.replace("from offers o left", "from (select * from offers where sub_product = 'UNSECURED') o left").replace(
    "p.account_id = o.account_id)", "p.account_id = o.account_id and p.secure_type = 'UNSECURED')"
)


@query(
    "vintage_margin_by_month",
    GATED
    + """select stmt_mth, brand, cast(count(*) as bigint) as offer_rows, cast(sum(guco) as double) as guco_sum,
                cast(sum(raim) as double) as raim_sum
         from tracked where accepted_flag = 1 group by stmt_mth, brand""",
)
def vintage_margin_by_month(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers")
    return plain(vt.margin_by_month(offers, branded_performance(spark, sf_dir)))


@query(
    "month_pivot",
    GATED
    + """select offer_vintage,
                cast(sum(case when stmt_mth = '2000-06' then guco else 0 end) as double) as guco_sum_200006,
                cast(sum(case when stmt_mth = '2000-07' then guco else 0 end) as double) as guco_sum_200007,
                cast(sum(case when stmt_mth = '2000-08' then guco else 0 end) as double) as guco_sum_200008
         from tracked where accepted_flag = 1 and brand = 'BUILDING' group by offer_vintage""",
)
def month_pivot(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers")
    months = ["2000-06", "2000-07", "2000-08"]
    return plain(vt.charge_offs_by_vintage(offers, branded_performance(spark, sf_dir), "BUILDING", months))


@query(
    "bucket_balance",
    GATED
    + """select stmt_mth, offer_vintage,
                cast(sum(case when brand = 'BUILDING' and (dpd_bucket like '%B0%' or dpd_bucket like '%B1%')
                              then adb else 0 end) as bigint) as early_balance,
                cast(sum(case when brand = 'BUILDING' and dpd_bucket not like '%B0%' and dpd_bucket not like '%B1%'
                              and dpd_bucket not like '%B7%' then adb else 0 end) as bigint) as late_balance
         from tracked
         where accepted_flag = 1 and stmt_mth > '1996-12' and stmt_mth = '2000-08' and cli_stmt >= 0
         group by stmt_mth, offer_vintage""",
)
def bucket_balance(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers")
    out = vt.balance_by_bucket(offers, branded_performance(spark, sf_dir), "BUILDING", "1996-12", "2000-08")
    return plain(out)


def yearly_panel(spark, sf_dir, labels=()):
    """Months 1..12 after each offer, weighted."""
    offers = standin(spark, sf_dir, "offers")
    return vt.vintage_panel(offers, branded_performance(spark, sf_dir), labels=labels, span=(1, 12))


@query(
    "cumulative_margin",
    TRACKED
    + """, monthly as (
           select brand, tu_band, cli_stmt, sum(raim) as raim from tracked
           where accepted_flag = 1 and cli_stmt between 1 and 12 group by brand, tu_band, cli_stmt)
         select brand, tu_band, cast(cli_stmt as bigint) as cli_stmt, cast(raim as double) as raim,
                cast(sum(raim) over (partition by brand, tu_band order by cli_stmt) as double) as raim_cuml
         from monthly""",
)
def cumulative_margin(spark, sf_dir):
    panel = yearly_panel(spark, sf_dir, ["tu_band", "accepted_flag"]).filter(c("accepted_flag") == 1)
    monthly = panel.dropna(subset=["brand", "tu_band"]).groupBy("brand", "tu_band", "cli_stmt").agg(vt.weighted_sum("raim", "raim"))
    out = cumulative(monthly, ["brand", "tu_band"], "cli_stmt", "raim", "raim_cuml")
    return plain(out.withColumn("cli_stmt", c("cli_stmt").cast("bigint")))


@query(
    "mean_then_cumulative",
    TRACKED
    + f""", monthly as (
           select brand, tu_band, cli_stmt, cast(sum(raim) as double) / count(raim) as raim from tracked
           where accepted_flag = 1 and cli_stmt between 1 and 12 group by brand, tu_band, cli_stmt)
         select brand, tu_band, cast(cli_stmt as bigint) as cli_stmt, raim,
                {steady_sql('sum(raim) over (partition by brand, tu_band order by cli_stmt)', 3)} as raim_cuml
         from monthly""",
)
def mean_then_cumulative(spark, sf_dir):
    panel = yearly_panel(spark, sf_dir, ["tu_band", "accepted_flag"]).filter(c("accepted_flag") == 1)
    monthly = panel.dropna(subset=["brand", "tu_band"]).groupBy("brand", "tu_band", "cli_stmt").agg(vt.weighted_mean("raim", "raim"))
    out = cumulative(monthly, ["brand", "tu_band"], "cli_stmt", "raim", "raim_cuml")
    return plain(out.withColumns({"cli_stmt": c("cli_stmt").cast("bigint"), "raim_cuml": steady(c("raim_cuml"), 3)}))


@query(
    "responder_increment",
    TRACKED
    + f""", monthly as (
           select accepted_flag, tu_band, cli_stmt, cast(sum(raim) as double) / count(raim) as raim,
                  count(account_id) as n
           from tracked where brand = 'BUILDING' and cli_stmt between 1 and 12
           group by accepted_flag, tu_band, cli_stmt),
         paired as (
           select tu_band, cli_stmt, r.raim as raim_r, n.raim as raim_n, r.n as n_r, n.n as n_n
           from (select * from monthly where accepted_flag = 0) n
           join (select * from monthly where accepted_flag = 1) r using (tu_band, cli_stmt))
         select tu_band, {steady_sql('sum(raim_n)', 4)} as raim_nonresponder, cast(max(n_n) as bigint) as n_nonresponder,
                {steady_sql('sum(raim_r)', 4)} as raim_responder, cast(max(n_r) as bigint) as n_responder,
                {steady_sql('sum(raim_r) - sum(raim_n)', 4)} as diff
         from paired group by tu_band""",
)
def responder_increment(spark, sf_dir):
    panel = yearly_panel(spark, sf_dir, ["tu_band", "accepted_flag"]).filter(c("brand") == "BUILDING")
    monthly = panel.groupBy("accepted_flag", "tu_band", "cli_stmt").agg(
        vt.weighted_mean("raim", "raim"), F.sum("n_offers").alias("n")
    )
    paired = compare_groups(monthly, ["tu_band", "cli_stmt"], "accepted_flag", ["raim", "n"], {0: "_nonresponder", 1: "_responder"})
    out = paired.groupBy("tu_band").agg(
        *[F.sum(f"raim{s}").alias(f"raim{s}") for s in ("_nonresponder", "_responder")],
        *[F.max(f"n{s}").alias(f"n{s}") for s in ("_nonresponder", "_responder")],
    )
    return plain(out.withColumn("diff", c("raim_responder") - c("raim_nonresponder")), places=4)


@query(
    "group_total_share",
    cte("performance")
    + """, monthly as (select stmt_mth, adb >= 60 as big, sum(raim) as raim from performance
                       where raim is not null group by stmt_mth, adb >= 60)
         select stmt_mth, cast(big as int) as big, cast(raim as double) as raim,
                cast(sum(raim) over (partition by stmt_mth) as double) as month_total,
                cast(raim as double) / nullif(cast(sum(raim) over (partition by stmt_mth) as double), 0) as share
         from monthly""",
)
def group_total_share(spark, sf_dir):
    perf = standin(spark, sf_dir, "performance").filter(c("raim").isNotNull())
    monthly = perf.groupBy("stmt_mth", (c("adb") >= 60).cast("int").alias("big")).agg(F.sum("raim").alias("raim"))
    out = group_total(monthly, "stmt_mth", "raim", "month_total")
    return plain(out.withColumn("share", safe_ratio("raim", "month_total")))


@query(
    "prev_month_attach",
    cte("performance")
    + """select p.stmt_mth, cast(count(*) as bigint) as n, cast(count(q.raim) as bigint) as matched,
                cast(sum(p.raim) as double) as raim, cast(coalesce(sum(q.raim), 0) as double) as prev_raim
         from performance p
         left join performance q on q.account_id = p.account_id
           and date_trunc('month', q.stmt_date) = date_trunc('month', p.stmt_date - interval 1 month)
         group by p.stmt_mth""",
)
def prev_month_attach(spark, sf_dir):
    perf = standin(spark, sf_dir, "performance")
    left = perf.select("account_id", "stmt_date", "stmt_mth", "raim")
    right = perf.select("account_id", c("stmt_date").alias("prev_date"), c("raim").alias("prev"))
    out = attach_prev_month(left, right, "account_id", "stmt_date", "prev_date")
    return plain(
        out.groupBy("stmt_mth").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("prev").alias("matched"),
            F.sum("raim").alias("raim"),
            F.coalesce(F.sum("prev"), F.lit(0)).alias("prev_raim"),
        )
    )


@query(
    "same_month_attach",
    cte("performance", "offers")
    + """select o.offer_mth, cast(count(*) as bigint) as n, cast(count(p.raim) as bigint) as matched,
                cast(coalesce(sum(p.raim), 0) as double) as raim, cast(count(y.raim) as bigint) as matched_by_parts
         from offers o
         left join performance p on p.account_id = o.account_id and p.stmt_mth = left(cast(o.offer_date as varchar), 7)
         left join performance y on y.account_id = o.account_id
           and substr(cast(y.stmt_date as varchar), 1, 4) = substr(cast(o.offer_date as varchar), 1, 4)
           and substr(cast(y.stmt_date as varchar), 6, 2) = substr(cast(o.offer_date as varchar), 6, 2)
         group by o.offer_mth""",
)
def same_month_attach(spark, sf_dir):
    perf = standin(spark, sf_dir, "performance")
    offers = standin(spark, sf_dir, "offers").select("account_id", "offer_date", "offer_mth")
    out = attach_on_month(offers, perf.select("account_id", "stmt_date", "raim"), "account_id", "offer_date", "stmt_date")
    # The same match on separate year and month text, as statement documents store them.
    year = lambda d: F.substring(c(d).cast("string"), 1, 4)
    month = lambda d: F.substring(c(d).cast("string"), 6, 2)
    parts = perf.select("account_id", year("stmt_date").alias("y"), month("stmt_date").alias("m"), c("raim").alias("raim_by_parts"))
    out = out.withColumns({"y": year("offer_date"), "m": month("offer_date")})
    out = attach(out, parts, ["account_id", "y", "m"])
    return plain(
        out.groupBy("offer_mth").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("raim").alias("matched"),
            F.coalesce(F.sum("raim"), F.lit(0)).alias("raim"),
            F.count("raim_by_parts").alias("matched_by_parts"),
        )
    )


@query(
    "vintage_step_means",
    TRACKED
    + f""", monthly as (
           select tu_band, cli_stmt, cast(sum(raim) as double) / count(raim) as raim, count(offer_id) as n
           from tracked where accepted_flag = 1 and cli_stmt between 1 and 12 and brand = 'BUILDING'
           group by tu_band, cli_stmt)
         select tu_band, {steady_sql('sum(raim)', 4)} as raim_1yr, cast(max(n) as bigint) as n_largest
         from monthly group by tu_band""",
)
def vintage_step_means(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers").filter(c("accepted_flag") == 1)
    perf = branded_performance(spark, sf_dir).filter(c("brand") == "BUILDING")
    panel = vt.vintage_panel(offers, perf, labels=["tu_band"], span=(1, 12))
    # Means per month over offers, then their sum: not one mean over all offer-months.
    monthly = panel.groupBy("tu_band", "cli_stmt").agg(vt.weighted_mean("raim", "raim"), F.sum("n_offers").alias("n"))
    return plain(mean_then_sum(monthly, ["tu_band"], "cli_stmt", "raim", "raim_1yr", largest="n"), places=4)
