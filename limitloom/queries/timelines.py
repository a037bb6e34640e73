"""Ranks, lags, running values and splits along a key's time line."""

from __future__ import annotations

from pyspark.sql import functions as F

from limitloom.operators import (
    attach,
    compare_groups,
    count_of_counts,
    cumulative,
    dedupe,
    first_event_month,
    lags,
    latest_per_key,
    ntile_global,
    running_ordinal,
    since_event,
)
from limitloom.operators.scan import PIECE_ROWS
from limitloom.plans import vintage_tracker as vt
from limitloom.queries.registry import query
from limitloom.queries.shape import plain, steady_sql
from limitloom.queries.vintage import TRACKED, branded_performance
from limitloom.rulesets import reactive
from limitloom.sources.standins import cte, standin

c = F.col

ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
ITEM_SQL = ", ".join(ITEM)


@query(
    "latest_per_key",
    f"""select {ITEM_SQL}, strftime(l_shipdate, '%Y-%m-%d') as ship_date from lineitem
        qualify row_number() over (partition by l_partkey order by l_shipdate desc, {ITEM_SQL}) = 1""",
)
def latest_per_key_query(spark, sf_dir):
    items = standin(spark, sf_dir, "lineitem").select(*ITEM, "l_shipdate")
    latest = latest_per_key(items, "l_partkey", "l_shipdate", [c(x) for x in ITEM], narrow=True)
    return plain(latest.select(*ITEM, F.to_date("l_shipdate").alias("ship_date")))


@query(
    "dedupe_any",
    f"""select {ITEM_SQL}, strftime(l_shipdate, '%Y-%m-%d') as ship_date from lineitem
        qualify row_number() over (partition by l_orderkey, l_linenumber order by {ITEM_SQL}, l_shipdate) = 1""",
)
def dedupe_any(spark, sf_dir):
    items = standin(spark, sf_dir, "lineitem").select(*ITEM, "l_shipdate")
    one = dedupe(items, ["l_orderkey", "l_linenumber"], [*[c(x) for x in ITEM], c("l_shipdate")])
    return plain(one.select(*ITEM, F.to_date("l_shipdate").alias("ship_date")))


@query(
    "latest_per_period",
    cte("daily")
    + """select account_id, cast(reference_date - cast(dpd as integer) as varchar) as late_from, cast(max(reference_date) as varchar) as reference_date,
                cast(arg_max(dpd, (reference_date, dpd)) as bigint) as dpd
         from daily where dpd > 0 group by account_id, reference_date - cast(dpd as integer)""",
)
def latest_per_period(spark, sf_dir):
    late = standin(spark, sf_dir, "daily").filter(c("dpd") > 0)
    late = late.select("account_id", F.date_sub("reference_date", c("dpd")).alias("late_from"), "reference_date", c("dpd").cast("bigint").alias("dpd"))
    return plain(latest_per_key(late, ["account_id", "late_from"], ["reference_date", "dpd"], []))


@query(
    "drilldown_topk",
    """select o_orderkey as offer_id, o_custkey as account_id, cast(o_totalprice as double) as offer_limit,
              strftime(o_orderdate, '%Y-%m-%d') as offer_date
       from orders order by o_totalprice desc, o_orderkey limit 100""",
)
def drilldown_topk(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers").select("offer_id", "account_id", "offer_limit", "offer_date")
    return plain(offers.orderBy(c("offer_limit").desc(), "offer_id").limit(100))


@query(
    "account_history",
    cte("offers")
    + """select account_id, offer_id, cast(offer_date as varchar) as offer_date, cast(offer_limit as double) as offer_limit from offers""",
)
def account_history(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers").select("account_id", "offer_id", "offer_date", "offer_limit")
    return plain(offers.orderBy("account_id", c("offer_date").desc(), c("offer_id").desc()))


@query(
    "running_ordinal",
    """select event_id, user_id, event_type, cast(row_number() over (partition by user_id, event_type order by ts, event_id) as bigint) as ordinal
       from events""",
)
def running_ordinal_query(spark, sf_dir):
    events = standin(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    out = running_ordinal(events, ["user_id", "event_type"], "ts", "ordinal", PIECE_ROWS, ["event_id"])
    return plain(out.drop("ts").withColumn("ordinal", c("ordinal").cast("bigint")))


@query(
    "lagged_features",
    cte("performance")
    + """, base as (
           select account_id, stmt_mth, stmt_date, raim, case when lines_in_month > 1 then 1 else 0 end as active_status,
                  case when guco > 0 then 'Revolver' else 'Transactor' end as revolver_flag from performance),
         numbered as (
           select *, row_number() over (partition by account_id, active_status order by stmt_date) as active_order from base)
         select t.account_id, t.stmt_mth, t.active_status, cast(t.active_order as bigint) as active_order,
                cast(a.raim as double) as raim_1m_prior, cast(b.raim as double) as raim_2m_prior, cast(d.raim as double) as raim_3m_prior,
                a.revolver_flag as revolver_flag_1m_prior, b.revolver_flag as revolver_flag_2m_prior, d.revolver_flag as revolver_flag_3m_prior,
                case when t.revolver_flag = 'Transactor' and a.revolver_flag = 'Transactor' and b.revolver_flag = 'Transactor' then 'Consistent Transactor'
                     when t.revolver_flag = 'Revolver' and a.revolver_flag = 'Revolver' and b.revolver_flag = 'Revolver' then 'Consistent Revolver' end as consistent_type
         from numbered t
         left join numbered a on a.account_id = t.account_id and a.active_status = t.active_status and a.active_order = t.active_order - 1
         left join numbered b on b.account_id = t.account_id and b.active_status = t.active_status and b.active_order = t.active_order - 2
         left join numbered d on d.account_id = t.account_id and d.active_status = t.active_status and d.active_order = t.active_order - 3""",
)
def lagged_features(spark, sf_dir):
    perf = standin(spark, sf_dir, "performance")
    base = perf.select(
        "account_id",
        "stmt_mth",
        "stmt_date",
        "raim",
        F.when(c("lines_in_month") > 1, 1).otherwise(0).alias("active_status"),
        reactive.revolver_flag("guco").alias("revolver_flag"),
    )
    keys = ["account_id", "active_status"]
    out = lags(running_ordinal(base, keys, "stmt_date", "active_order"), keys, "active_order", ["raim", "revolver_flag"])
    out = out.withColumns({"consistent_type": reactive.consistent_type(), "active_order": c("active_order").cast("bigint")})
    return plain(out.drop("stmt_date", "raim", "revolver_flag"))


@query(
    "utilisation_flags",
    cte("performance")
    + """, base as (select account_id, stmt_mth, row_number() over (partition by account_id order by stmt_mth) as place,
                           case when cast(cof as double) / nullif(cast(guco as double), 0) >= 0.9 then 'High Util'
                                when cast(cof as double) / nullif(cast(guco as double), 0) < 0.9 then 'Low Util' end as util_flag from performance)
         select b.account_id, b.stmt_mth, b.util_flag, x.util_flag as util_flag_1m_prior, y.util_flag as util_flag_2m_prior, z.util_flag as util_flag_3m_prior
         from base b left join base x on x.account_id = b.account_id and x.place = b.place - 1
         left join base y on y.account_id = b.account_id and y.place = b.place - 2 left join base z on z.account_id = b.account_id and z.place = b.place - 3""",
)
def utilisation_flags(spark, sf_dir):
    perf = standin(spark, sf_dir, "performance").withColumn("utilisation", F.try_divide(c("cof").cast("double"), c("guco").cast("double")))
    rows = perf.select("account_id", "stmt_mth", reactive.utilisation_flag().alias("util_flag"))
    out = lags(running_ordinal(rows, "account_id", "stmt_mth", "place"), "account_id", "place", ["util_flag"])
    return plain(out.drop("place"))


@query(
    "first_qualifying_month",
    cte("performance")
    + """, marked as (
           select account_id, stmt_mth, stmt_date, min(case when adb >= 90 then stmt_date end) over (partition by account_id) as first_date from performance)
         select account_id, stmt_mth, left(cast(first_date as varchar), 7) as first_mth, cast(datediff('month', first_date, stmt_date) as bigint) as months_since
         from marked where datediff('month', first_date, stmt_date) > 0""",
)
def first_qualifying_month(spark, sf_dir):
    perf = standin(spark, sf_dir, "performance").select("account_id", "stmt_mth", "adb")
    marked = first_event_month(perf, "account_id", c("adb") >= 90, "stmt_mth", "first_mth", one_per_month=True)
    out = since_event(marked, "stmt_mth", "first_mth", "months_since")
    return plain(out.drop("adb").withColumn("months_since", c("months_since").cast("bigint")))


def numbered_offers(spark, sf_dir):
    """Accepted offers with the running number of their offer day and the repeat flag."""
    accepted = standin(spark, sf_dir, "offers").filter(c("accepted_flag") == 1)
    # One row per account and offer day; the mean of a constant flag is the flag.
    days = accepted.groupBy("account_id", "offer_date").agg(F.avg("accepted_flag").alias("accepted"))
    days = cumulative(days, "account_id", "offer_date", "accepted", "nth")
    days = days.select("account_id", "offer_date", c("nth").cast("bigint").alias("nth"), (c("nth") > 1).cast("int").alias("multi"))
    return accepted, days


NUMBERED = (
    cte("offers")
    + """, days as (select account_id, offer_date, avg(accepted_flag) as accepted from offers where accepted_flag = 1 group by 1, 2),
     numbered as (select *, sum(accepted) over (partition by account_id order by offer_date) as nth from days),
     flagged as (select o.*, n.nth, case when n.nth > 1 then 1 else 0 end as multi from offers o join numbered n using (account_id, offer_date)
                 where o.accepted_flag = 1)
"""
)


@query(
    "multi_vs_single",
    NUMBERED
    + """, means as (select offer_mth, multi, cast(sum(offer_limit) as double) / count(offer_limit) as mean_limit from flagged group by 1, 2)
         select m.offer_mth, m.mean_limit as mean_limit_multi, s.mean_limit as mean_limit_single
         from (select * from means where multi = 1) m left join (select * from means where multi = 0) s using (offer_mth)""",
)
def multi_vs_single(spark, sf_dir):
    accepted, days = numbered_offers(spark, sf_dir)
    flagged = attach(accepted, days, ["account_id", "offer_date"])
    mean = F.sum("offer_limit").cast("double") / F.count("offer_limit")
    means = flagged.groupBy("offer_mth", "multi").agg(mean.alias("mean_limit"))
    return plain(compare_groups(means, "offer_mth", "multi", ["mean_limit"], {1: "_multi", 0: "_single"}, how="left"))


@query(
    "multi_offer_counts",
    NUMBERED
    + """select n_offer_days, cast(count(*) as bigint) as n_accounts from (
           select account_id, cast(count(*) as bigint) as n_offer_days from days group by account_id) group by 1""",
)
def multi_offer_counts(spark, sf_dir):
    _, days = numbered_offers(spark, sf_dir)
    return plain(count_of_counts(days, "account_id", "n_offer_days", "n_accounts"))


@query(
    "multi_margin",
    TRACKED
    + f""", days as (select distinct account_id, offer_date from offers where accepted_flag = 1),
         numbered as (select *, row_number() over (partition by account_id order by offer_date) > 1 as multi from days),
         monthly as (
           select offer_vintage, multi, cli_stmt, cast(sum(raim) as double) / count(raim) as raim
           from tracked join numbered using (account_id, offer_date) where accepted_flag = 1 and cli_stmt between 1 and 12 group by 1, 2, 3),
         sums as (select offer_vintage, multi, sum(raim) as raim from monthly group by 1, 2)
         select m.offer_vintage, {steady_sql('m.raim', 3)} as raim_multi, {steady_sql('s.raim', 3)} as raim_single
         from (select * from sums where multi) m left join (select * from sums where not multi) s using (offer_vintage)""",
)
def multi_margin(spark, sf_dir):
    accepted, days = numbered_offers(spark, sf_dir)
    flagged = attach(accepted.select("account_id", "offer_date"), days.drop("nth"), ["account_id", "offer_date"])
    panel = vt.vintage_panel(flagged, branded_performance(spark, sf_dir), labels=["multi"], span=(1, 12))
    monthly = panel.groupBy("offer_vintage", "multi", "cli_stmt").agg(vt.weighted_mean("raim", "raim"))
    sums = monthly.groupBy("offer_vintage", "multi").agg(F.sum("raim").alias("raim"))
    return plain(compare_groups(sums, "offer_vintage", "multi", ["raim"], {1: "_multi", 0: "_single"}, how="left"), places=3)


@query(
    "ntile_split",
    cte("accounts")
    + """, tiles as (select *, ntile(2) over (order by account_id) as tile from accounts)
         select account_id, cast(tile as integer) as tile, case when tile = 1 then 'Aggressive' else 'Conservative' end as strategy_type,
                cast(case when tile = 1 then ceil(cast(balance * 2 as double) / 100) * 100 * 100
                          else ceil(cast(balance * 1.5 as double) / 100) * 100 * 100 end as bigint) as new_limit_cents
         from tiles""",
)
def ntile_split(spark, sf_dir):
    accounts = standin(spark, sf_dir, "accounts")
    split = ntile_global(accounts, "account_id", 2)
    split = split.withColumns({"agg_limit": (c("balance") * 2).cast("double"), "cons_limit": (c("balance") * F.lit(1.5).cast("decimal(2,1)")).cast("double")})
    return plain(
        split.select("account_id", "tile", reactive.strategy_type().alias("strategy_type"), reactive.new_limit_cents().alias("new_limit_cents"))
    )


