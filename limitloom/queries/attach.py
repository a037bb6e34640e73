"""Joins: by day, by month, by next event, with fallback, with exclusions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from limitloom.functions import month_start, score_bucket, within_days, zero_if_null
from limitloom.operators import (
    asof_forward,
    attach,
    attach_history,
    attach_on_day,
    exclude,
    fallback_fill,
    latest_per_key,
    lookback_max,
    member_flag,
    worst_per_key,
)
from limitloom.queries.registry import AS_OF, query
from limitloom.queries.shape import plain
from limitloom.sources import stitch_history
from limitloom.sources.standins import cte, standin

c = F.col
def n_rows():
    return F.count(F.lit(1))



def daily_scores(spark, sf_dir):
    """The score snapshot: the last score of each account and day."""
    return latest_per_key(standin(spark, sf_dir, "event_scores"), ["account_id", "reference_date"], "scored_at", [c("score_id").desc()])


DAILY_SCORES = """
daily_scores as (
  select * from event_scores
  qualify row_number() over (partition by account_id, reference_date order by scored_at desc, score_id desc) = 1)"""


@query(
    "stitched_scores",
    cte("event_scores")
    + """, stitched as (select account_id, prediction / 2 as prediction, scored_at from event_scores where scored_at <= timestamp '2024-01-15 00:00:00'
           union all select account_id, prediction, scored_at from event_scores where scored_at > timestamp '2024-01-15 00:00:00')
         select account_id, cast(count(*) as bigint) as n, min(prediction) as lowest, max(prediction) as highest,
                strftime(max(scored_at), '%Y-%m-%d %H:%M:%S.%f') as last_scored_at
         from stitched group by account_id""",
)
def stitched_scores(spark, sf_dir):
    scores = standin(spark, sf_dir, "event_scores")
    cutoff = dt.datetime(2024, 1, 15)
    # the backfill covers the live days too, with other values, so that either side's rows show
    backfill = scores.withColumn("prediction", c("prediction") / 2)
    history = stitch_history(backfill, scores, "scored_at", cutoff)
    return plain(
        history.groupBy("account_id").agg(
            n_rows().alias("n"),
            F.min("prediction").alias("lowest"),
            F.max("prediction").alias("highest"),
            F.max("scored_at").alias("last_scored_at"),
        )
    )


@query(
    "score_on_offer_day",
    cte("event_offers", "event_scores")
    + ","
    + DAILY_SCORES
    + """select o.request_id, o.account_id, cast(o.offer_date as varchar) as offer_date, s.prediction,
                'Bucket' || cast(cast(floor(s.prediction * 10) as bigint) as varchar) as score_bucket
         from event_offers o
         left join daily_scores s on s.account_id = o.account_id and s.reference_date = cast(o.requested_at as date)""",
)
def score_on_offer_day(spark, sf_dir):
    offers = standin(spark, sf_dir, "event_offers")
    scores = daily_scores(spark, sf_dir).select("account_id", "reference_date", "prediction")
    out = attach_on_day(offers, scores, "account_id", "requested_at", "reference_date")
    out = out.withColumn("score_bucket", score_bucket("prediction"))
    return plain(out.select("request_id", "account_id", "offer_date", "prediction", "score_bucket"))


@query(
    "score_on_month_start",
    cte("performance", "offers")
    + """, first_day as (select account_id, offer_date, max(offer_limit) as snapshot_limit from offers group by account_id, offer_date)
         select p.stmt_mth, cast(count(*) as bigint) as n, cast(count(s.snapshot_limit) as bigint) as matched,
                cast(coalesce(sum(s.snapshot_limit), 0) as double) as limit_sum
         from performance p
         left join first_day s on s.account_id = p.account_id and s.offer_date = cast(p.stmt_mth || '-01' as date)
         group by p.stmt_mth""",
)
def score_on_month_start(spark, sf_dir):
    perf = standin(spark, sf_dir, "performance").select("account_id", "stmt_mth")
    snapshots = standin(spark, sf_dir, "offers").groupBy("account_id", "offer_date").agg(F.max("offer_limit").alias("snapshot_limit"))
    perf = perf.withColumn("first_day", month_start("stmt_mth"))
    out = attach_on_day(perf, snapshots, "account_id", "first_day", "offer_date")
    return plain(
        out.groupBy("stmt_mth").agg(
            n_rows().alias("n"),
            F.count("snapshot_limit").alias("matched"),
            zero_if_null(F.sum("snapshot_limit")).alias("limit_sum"),
        )
    )


@query(
    "chained_attach",
    cte("offers", "accounts")
    + """select r.r_name as region, a.brand, cast(count(*) as bigint) as n, cast(sum(o.offer_limit) as double) as limit_sum
         from offers o
         left join accounts a on a.account_id = o.account_id
         left join nation n on n.n_nationkey = a.nation_key
         left join region r on r.r_regionkey = n.n_regionkey
         group by r.r_name, a.brand""",
)
def chained_attach(spark, sf_dir):
    # Offers are summed per account before anything is attached to them.
    offers = standin(spark, sf_dir, "offers").groupBy("account_id").agg(n_rows().alias("n"), F.sum("offer_limit").alias("limit_sum"))
    out = attach(offers, standin(spark, sf_dir, "accounts").drop("balance"), "account_id")
    out = attach(out, standin(spark, sf_dir, "nation").drop("n_name"), [("nation_key", "n_nationkey")])
    out = attach(out, standin(spark, sf_dir, "region").withColumnRenamed("r_name", "region"), [("n_regionkey", "r_regionkey")])
    return plain(out.groupBy("region", "brand").agg(F.sum("n").alias("n"), F.sum("limit_sum").alias("limit_sum")))


@query(
    "open_range_join",
    cte("daily", "performance")
    + """, latest as (
           select account_id, reference_date as late_until, dpd from daily where dpd > 0 and status = 'O'
           qualify row_number() over (partition by account_id order by reference_date desc, dpd desc) = 1)
         select p.account_id, p.stmt_mth, cast(l.dpd as bigint) as dpd
         from performance p join latest l
           on l.account_id = p.account_id and (p.stmt_date < l.late_until or l.late_until is null)""",
)
def open_range_join(spark, sf_dir):
    late = standin(spark, sf_dir, "daily").filter((c("dpd") > 0) & (c("status") == "O"))
    late = latest_per_key(late.select("account_id", c("reference_date").alias("late_until"), "dpd"), "account_id", ["late_until", "dpd"], [])
    statements = standin(spark, sf_dir, "performance").select("account_id", "stmt_mth", "stmt_date")
    still_open = (c("stmt_date") < c("late_until")) | c("late_until").isNull()
    out = attach(statements, late, "account_id", "inner", extra=still_open)
    return plain(out.select("account_id", "stmt_mth", c("dpd").cast("bigint").alias("dpd")))


@query(
    "lookback_max_dpd",
    cte("daily", "performance")
    + """, worst as (
           select account_id, dpd, reference_date - cast(dpd as integer) as late_from from daily where dpd > 0
           qualify row_number() over (partition by account_id order by dpd desc, reference_date desc) = 1)
         select p.account_id, p.stmt_mth, cast(w.dpd as bigint) as max_dpd_3m
         from performance p left join worst w
           on w.account_id = p.account_id and w.late_from >= p.stmt_date - interval 3 month""",
)
def lookback_max_dpd(spark, sf_dir):
    late = standin(spark, sf_dir, "daily").filter(c("dpd") > 0)
    late = late.withColumn("late_from", F.date_sub("reference_date", c("dpd")))
    statements = standin(spark, sf_dir, "performance").select("account_id", "stmt_mth", "stmt_date")
    out = lookback_max(statements, late, "account_id", "dpd", "late_from", "stmt_date", 3, "max_dpd_3m")
    return plain(out.select("account_id", "stmt_mth", c("max_dpd_3m").cast("bigint").alias("max_dpd_3m")))


@query(
    "asof_next_event",
    cte("event_offers", "event_decisions")
    + """select o.request_id, o.account_id, strftime(o.requested_at, '%Y-%m-%d %H:%M:%S.%f') as requested_at, d.decision_id,
                strftime(d.adjudicated_at, '%Y-%m-%d %H:%M:%S.%f') as adjudicated_at, cast(d.amount as double) as amount
         from event_offers o asof left join event_decisions d
           on o.account_id = d.account_id and d.adjudicated_at > o.requested_at""",
)
def asof_next_event(spark, sf_dir):
    requests = standin(spark, sf_dir, "event_offers").select("request_id", "account_id", "requested_at")
    decisions = standin(spark, sf_dir, "event_decisions")
    return plain(asof_forward(requests, decisions, "account_id", "requested_at", "adjudicated_at", tiebreak=["decision_id"], own=["request_id"]))


@query(
    "score_fallback",
    cte("performance", "offers")
    + """, monthly as (
           select account_id, offer_mth, offer_limit, offer_date from offers
           qualify row_number() over (partition by account_id, offer_mth order by offer_date desc, offer_id desc) = 1),
         latest as (
           select account_id, offer_limit, offer_date from offers
           qualify row_number() over (partition by account_id order by offer_date desc, offer_id desc) = 1)
         select p.account_id, p.stmt_mth, cast(coalesce(m.offer_limit, l.offer_limit) as double) as score,
                cast(case when m.offer_limit is null then l.offer_date else m.offer_date end as varchar) as pull_date
         from performance p
         left join monthly m on m.account_id = p.account_id and m.offer_mth = p.stmt_mth
         left join latest l on l.account_id = p.account_id""",
)
def score_fallback(spark, sf_dir):
    pulls = standin(spark, sf_dir, "offers").select("account_id", "offer_id", "offer_mth", c("offer_limit").alias("score"), c("offer_date").alias("pull_date"))
    newest = [c("offer_id").desc()]
    monthly = latest_per_key(pulls, ["account_id", "offer_mth"], "pull_date", newest)
    # The latest pull is the latest of the monthly ones: a much smaller frame.
    latest = latest_per_key(monthly, "account_id", "pull_date", newest)
    statements = standin(spark, sf_dir, "performance").select("account_id", "stmt_mth")
    out = attach(statements, monthly.drop("offer_id"), ["account_id", ("stmt_mth", "offer_mth")])
    out = fallback_fill(out, latest.select("account_id", "score", "pull_date"), "account_id", ["score"], follows={"pull_date": "score"})
    return plain(out)


@query(
    "on_clause_filter",
    cte("accounts", "offers")
    + """select a.account_id, a.brand, case when o.account_id is null then 0 else 1 end as has_open_offer
         from accounts a left join (select distinct account_id from offers where status = 'P') o
           on o.account_id = a.account_id and a.brand not in ('BUILDING', 'MACHINERY')""",
)
def on_clause_filter(spark, sf_dir):
    accounts = standin(spark, sf_dir, "accounts").select("account_id", "brand")
    members = standin(spark, sf_dir, "offers").filter(c("status") == "P").select("account_id").distinct()
    return plain(attach(accounts, members, "account_id", extra=~c("brand").isin("BUILDING", "MACHINERY"), flag="has_open_offer"))


@query(
    "membership_flag",
    cte("accounts", "offers")
    + """select a.account_id, case when a.account_id in (select account_id from offers where offer_limit > 400000) then 1 else 0 end as large_offer,
                case when a.account_id in (select account_id from offers where status = 'O' and offer_date > date '2001-01-31') then 0 else 1 end as not_blocked
         from accounts a""",
)
def membership_flag(spark, sf_dir):
    accounts = standin(spark, sf_dir, "accounts").select("account_id")
    offers = standin(spark, sf_dir, "offers")
    out = member_flag(accounts, offers.filter(c("offer_limit") > 400000), "account_id", "large_offer")
    out = member_flag(out, offers.filter((c("status") == "O") & (c("offer_date") > dt.date(2001, 1, 31))), "account_id", "blocked")
    return plain(out.select("account_id", "large_offer", (1 - c("blocked")).alias("not_blocked")))


@query(
    "filtered_right_join",
    cte("accounts", "offers")
    + """select a.account_id, a.brand, cast(count(*) as bigint) as n
         from accounts a right join offers o on o.account_id = a.account_id
         where a.balance > 0 and a.brand in ('BUILDING', 'FURNITURE') and o.status <> 'P'
           and o.offer_date >= date '1998-02-01' and a.account_id is not null
         group by a.account_id, a.brand""",
)
def filtered_right_join(spark, sf_dir):
    # A right join whose left columns are then filtered keeps matches only: an inner join.
    gates = (c("balance") > 0) & c("brand").isin("BUILDING", "FURNITURE")
    offers = standin(spark, sf_dir, "offers").filter((c("status") != "P") & (c("offer_date") >= dt.date(1998, 2, 1)))
    counted = offers.groupBy("account_id").agg(n_rows().alias("n"))
    out = attach(standin(spark, sf_dir, "accounts").filter(gates), counted, "account_id", "inner")
    return plain(out.select("account_id", "brand", "n"))


@query(
    "anti_left_null",
    cte("accounts", "offers")
    + """select a.account_id, a.brand from accounts a
         left join offers o on o.account_id = a.account_id and o.accepted_flag = 1 and o.offer_date >= date '2000-08-01'
         where o.account_id is null""",
)
def anti_left_null(spark, sf_dir):
    recent = standin(spark, sf_dir, "offers").filter((c("accepted_flag") == 1) & (c("offer_date") >= dt.date(2000, 8, 1)))
    return plain(exclude(standin(spark, sf_dir, "accounts").select("account_id", "brand"), recent, "account_id"))


@query(
    "anti_not_exists_later",
    cte("offers")
    + """select d.offer_id, d.account_id, cast(d.offer_date as varchar) as offer_date from offers d
         where d.status = 'O' and not exists (
           select 1 from offers a where a.account_id = d.account_id and a.accepted_flag = 1 and a.offer_date > d.offer_date)""",
)
def anti_not_exists_later(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers")
    accepted = offers.filter(c("accepted_flag") == 1).select("account_id", c("offer_date").alias("accepted_on"))
    decreases = offers.filter(c("status") == "O").select("offer_id", "account_id", "offer_date")
    return plain(exclude(decreases, accepted, "account_id", later_than=("accepted_on", "offer_date")))


@query(
    "bridge_lookup",
    cte("accounts")
    + """select a.account_id, b.facility from accounts a
         left join (select n.n_nationkey, r.r_name as facility from nation n join region r on r.r_regionkey = n.n_regionkey) b
           on b.n_nationkey = a.nation_key""",
)
def bridge_lookup(spark, sf_dir):
    bridge = attach(
        standin(spark, sf_dir, "nation").drop("n_name"),
        standin(spark, sf_dir, "region").withColumnRenamed("r_name", "facility"),
        [("n_regionkey", "r_regionkey")],
        "inner",
    ).drop("n_regionkey")
    accounts = standin(spark, sf_dir, "accounts").select("account_id", "nation_key")
    return plain(attach(accounts, bridge, [("nation_key", "n_nationkey")]).drop("nation_key"))


@query(
    "enrichment_chain",
    cte("accounts", "offers", "daily", "performance")
    + """, card as (select account_id, tu_band, offer_limit from offers
                    qualify row_number() over (partition by account_id order by offer_date desc, offer_id desc) = 1),
           stmt as (select account_id, stmt_mth, raim from performance
                    qualify row_number() over (partition by account_id order by stmt_date desc) = 1),
           worst as (select account_id, max(dpd) as worst_dpd, max(reference_date) as last_seen from daily group by account_id)
         select a.account_id, n.n_name as province, card.tu_band, cast(card.offer_limit as double) as offer_limit,
                stmt.stmt_mth, cast(stmt.raim as double) as raim, cast(worst.worst_dpd as bigint) as worst_dpd,
                cast(worst.last_seen as varchar) as last_seen
         from accounts a left join nation n on n.n_nationkey = a.nation_key
         left join card on card.account_id = a.account_id left join stmt on stmt.account_id = a.account_id
         left join worst on worst.account_id = a.account_id""",
)
def enrichment_chain(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers").select("account_id", "tu_band", "offer_limit", "offer_date", "offer_id")
    card = latest_per_key(offers, "account_id", ["offer_date", "offer_id"], []).drop("offer_date", "offer_id")
    perf = standin(spark, sf_dir, "performance").select("account_id", "stmt_date", "stmt_mth", "raim")
    stmt = latest_per_key(perf, "account_id", "stmt_date", []).drop("stmt_date")
    worst = standin(spark, sf_dir, "daily").groupBy("account_id").agg(
        F.max("dpd").cast("bigint").alias("worst_dpd"), F.max("reference_date").alias("last_seen")
    )
    out = standin(spark, sf_dir, "accounts").select("account_id", "nation_key")
    out = attach(out, standin(spark, sf_dir, "nation").select("n_nationkey", c("n_name").alias("province")), [("nation_key", "n_nationkey")])
    for snapshot in (card, stmt, worst):
        out = attach(out, snapshot, "account_id")
    return plain(out.drop("nation_key"))


@query(
    "recent_passthrough",
    cte("accounts", "offers")
    + """select a.account_id, o.offer_id, cast(round(o.offer_limit / 100, 0) * 10000 as bigint) as limit_cents
         from accounts a join offers o on o.account_id = a.account_id
           and o.offer_date >= date '2001-08-01' - 30 and o.offer_date <= date '2001-08-01'
         where o.status = 'P' and a.balance > 0 and a.brand <> 'MACHINERY'""",
)
def recent_passthrough(spark, sf_dir):
    recent = standin(spark, sf_dir, "offers").filter((c("status") == "P") & within_days("offer_date", AS_OF, 30, inclusive=True))
    accounts = standin(spark, sf_dir, "accounts").filter((c("balance") > 0) & (c("brand") != "MACHINERY"))
    out = attach(recent.select("offer_id", "account_id", "offer_limit"), accounts.select("account_id"), "account_id", "inner")
    cents = (F.round(c("offer_limit") / 100, 0) * 10000).cast("bigint")
    return plain(out.select("account_id", "offer_id", cents.alias("limit_cents")))


@query(
    "history_fanout",
    cte("accounts", "offers")
    + """, seen as (select distinct account_id, status, tu_band from offers where status = 'O')
         select a.account_id, a.brand, o.offer_id, o.offer_mth, cast(o.offer_limit as double) as offer_limit,
                (select cast(count(*) as bigint) from seen s where s.account_id = a.account_id) as n_seen
         from accounts a left join offers o on o.account_id = a.account_id and o.accepted_flag = 1""",
)
def history_fanout(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers")
    seen = offers.filter(c("status") == "O").select("account_id", "status", "tu_band").distinct()
    per_account = seen.groupBy("account_id").agg(n_rows().alias("n_seen"))
    accounts = attach(standin(spark, sf_dir, "accounts").select("account_id", "brand"), per_account, "account_id")
    accounts = accounts.withColumn("n_seen", zero_if_null("n_seen"))
    accepted = offers.filter(c("accepted_flag") == 1).select("account_id", "offer_id", "offer_mth", "offer_limit")
    return plain(attach_history(accounts, accepted, "account_id"))


@query(
    "score_coverage",
    cte("event_offers", "event_scores")
    + ","
    + DAILY_SCORES
    + """select cast(o.offer_date as varchar) as offer_date, cast(count(*) as bigint) as offers,
                cast(sum(case when s.account_id is null then 1 else 0 end) as bigint) as without_score
         from event_offers o left join daily_scores s on s.account_id = o.account_id and s.reference_date = o.offer_date
         group by o.offer_date""",
)
def score_coverage(spark, sf_dir):
    offers = standin(spark, sf_dir, "event_offers")
    scores = daily_scores(spark, sf_dir).select("account_id", "reference_date")
    out = attach_on_day(offers, scores, "account_id", "offer_date", "reference_date", flag="scored")
    return plain(out.groupBy("offer_date").agg(n_rows().alias("offers"), F.sum(1 - c("scored")).alias("without_score")))


@query(
    "worst_record",
    cte("daily")
    + """select account_id, cast(dpd as bigint) as dpd, cast(reference_date as varchar) as reference_date from daily
         qualify row_number() over (partition by account_id order by dpd desc, reference_date desc) = 1""",
)
def worst_record(spark, sf_dir):
    daily = standin(spark, sf_dir, "daily").select("account_id", c("dpd").cast("bigint").alias("dpd"), "reference_date")
    return plain(worst_per_key(daily, "account_id", ["dpd", "reference_date"], []))


