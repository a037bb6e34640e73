"""Row-wise functions, predicates, nested paths and bound parameters."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from limitloom.functions import (
    at_path,
    ceil_to,
    clamp,
    completed_months,
    document,
    dollars,
    mob,
    mob_rounded,
    month_diff,
    month_floor,
    month_key,
    month_start,
    round_to,
    safe_ratio,
    within_days,
    within_months,
    zero_if_null,
)
from limitloom.operators import attach, union_distinct
from limitloom.queries.registry import AS_OF, query
from limitloom.queries.shape import plain
from limitloom.session import run_folder
from limitloom.sources import append_audience, nested, replace_table, run_sql, session_view, to_records
from limitloom.sources.standins import cte, standin

c = F.col


@query(
    "date_functions",
    """select o_orderkey as offer_id, left(cast(o_orderdate as varchar), 7) as mth,
              cast(date_trunc('month', o_orderdate) as varchar)[1:10] as mth_start,
              cast(datediff('month', o_orderdate, timestamp '2001-08-01') as bigint) as calendar_months,
              cast(date_sub('month', o_orderdate, timestamp '2001-08-01') as bigint) as whole_months,
              round((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) + (1 - day(o_orderdate)) / 31.0, 5) as mob,
              cast(round((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate) + (1 - day(o_orderdate)) / 31.0) as bigint) as mob_rounded,
              cast(cast(o_orderdate as date) - interval 3 month as varchar)[1:10] as three_months_before,
              cast(cast(o_orderdate as date) - 45 as varchar) as day_before,
              cast(datediff('day', cast(o_orderdate as date), date '2001-08-01') as bigint) as age_days,
              case when o_orderdate > timestamp '2001-08-01' - interval 100 day then 1 else 0 end as last_100_days,
              case when o_orderdate >= timestamp '2001-08-01' - interval 1 month then 1 else 0 end as last_month,
              strftime(o_orderdate, '%Y%m%d') as compact, strftime(o_orderdate, '%m') as mm
       from orders""",
)
def date_functions(spark, sf_dir):
    d = "d"
    orders = standin(spark, sf_dir, "orders").select(c("o_orderkey").alias("offer_id"), F.to_date("o_orderdate").alias(d))
    compact = F.date_format(d, "yyyyMMdd")
    return plain(
        orders.select(
            "offer_id",
            month_key(d).alias("mth"),
            month_start(month_key(d)).alias("mth_start"),
            month_diff(d, AS_OF).cast("bigint").alias("calendar_months"),
            completed_months(d, AS_OF).cast("bigint").alias("whole_months"),
            F.round(mob(d, AS_OF), 5).alias("mob"),
            mob_rounded(d, AS_OF).cast("bigint").alias("mob_rounded"),
            F.add_months(d, -3).alias("three_months_before"),
            F.date_sub(d, 45).alias("day_before"),
            F.datediff(F.lit(AS_OF), F.to_date(compact, "yyyyMMdd")).cast("bigint").alias("age_days"),
            within_days(d, AS_OF, 100).alias("last_100_days"),
            within_months(d, AS_OF, 1).alias("last_month"),
            compact.alias("compact"),
            F.substring(compact, 5, 2).alias("mm"),
        )
    )


@query(
    "money_functions",
    cte("offers", "accounts")
    + """select o.offer_id, cast(cast(o.offer_limit * 100 as bigint) as double) / 100 as limit_dollars,
                cast(ceil(cast(o.offer_limit as double) / 100) * 100 as bigint) as next_hundred,
                cast(round(cast(o.offer_limit as double) / 100) * 100 as bigint) as nearest_hundred,
                cast(o.offer_limit * 100 as bigint) // 100 as whole_dollars,
                cast(least(greatest(o.offer_limit, 50000), 400000) as double) as clamped,
                cast(a.balance as double) / nullif(cast(nullif(o.status, 'P') = 'F' as integer), 0) as balance_if_accepted,
                coalesce(cast(a.balance as double) / nullif(cast(nullif(o.status, 'P') = 'F' as integer), 0), 1) as ratio_or_one,
                cast(o.offer_limit - a.balance as double) as increment,
                cast(coalesce(case when o.status <> 'P' then a.balance end, 0) as double) as balance_or_zero
         from offers o join accounts a on a.account_id = o.account_id""",
)
def money_functions(spark, sf_dir):
    offers = standin(spark, sf_dir, "offers").select("offer_id", "account_id", "offer_limit", "status")
    rows = attach(offers, standin(spark, sf_dir, "accounts").select("account_id", "balance"), "account_id", "inner")
    cents = (c("offer_limit") * 100).cast("bigint")
    accepted = (F.nullif(c("status"), F.lit("P")) == "F").cast("int")
    as_double = c("offer_limit").cast("double")
    return plain(
        rows.select(
            "offer_id",
            dollars(cents).alias("limit_dollars"),
            ceil_to(as_double, 100).cast("bigint").alias("next_hundred"),
            round_to(as_double, 100).cast("bigint").alias("nearest_hundred"),
            F.expr("cast(offer_limit * 100 as bigint) div 100").alias("whole_dollars"),
            clamp("offer_limit", 50000, 400000).alias("clamped"),
            safe_ratio("balance", accepted).alias("balance_if_accepted"),
            safe_ratio("balance", accepted, default=1).alias("ratio_or_one"),
            (c("offer_limit") - c("balance")).alias("increment"),
            zero_if_null(F.when(c("status") != "P", c("balance"))).alias("balance_or_zero"),
        )
    )


@query(
    "string_functions",
    """select c_custkey as account_id, left(c_name, 8) as head, right(c_name, 1) as last_digit,
              case when right(c_name, 1) = '1' then 1 else 0 end as ends_in_one,
              c_mktsegment || '-' || lpad(cast(c_nationkey as varchar), 3, '0') as code,
              case when c_mktsegment like '%ING%' or c_mktsegment like 'AUTO%' then 1 else 0 end as matches,
              case when nullif(c_mktsegment, 'FURNITURE') not like 'B%' then 1 else 0 end as not_like_b,
              case when try_cast(right(c_name, 4) as integer) > 700 then 1 else 0 end as high_number,
              case when try_cast(c_mktsegment as integer) is null then 1 else 0 end as not_a_number_flag
       from customer""",
)
def string_functions(spark, sf_dir):
    customer = standin(spark, sf_dir, "customer")
    last = F.substring("c_name", -1, 1)
    as_flag = lambda cond: F.when(cond, 1).otherwise(0)
    return plain(
        customer.select(
            c("c_custkey").alias("account_id"),
            F.substring("c_name", 1, 8).alias("head"),
            last.alias("last_digit"),
            as_flag(last == "1").alias("ends_in_one"),
            F.concat("c_mktsegment", F.lit("-"), F.lpad(c("c_nationkey").cast("string"), 3, "0")).alias("code"),
            as_flag(c("c_mktsegment").like("%ING%") | c("c_mktsegment").like("AUTO%")).alias("matches"),
            # A missing value is neither like nor not like.
            as_flag(~F.nullif(c("c_mktsegment"), F.lit("FURNITURE")).like("B%")).alias("not_like_b"),
            as_flag(F.substring("c_name", -4, 4).try_cast("int") > 700).alias("high_number"),
            c("c_mktsegment").try_cast("int").isNull().alias("not_a_number_flag"),
        )
    )


@query(
    "struct_and_map_paths",
    """select event_id, cast(props ->> '$.k' as bigint) as k, cast(props ->> '$.k' as bigint) / 100.0 as k_dollars,
              cast(props ->> '$.missing' as bigint) as absent_key, coalesce(cast(props ->> '$.missing' as bigint), 0) as absent_or_zero,
              event_type || '"' || cast(user_id as varchar) as emails
       from events""",
)
def struct_and_map_paths(spark, sf_dir):
    events = standin(spark, sf_dir, "events").select(
        "event_id",
        nested("props", "struct<k: bigint>").alias("doc"),
        nested("props", "map<string, bigint>").alias("attrs"),
        F.array(F.struct(c("event_type").alias("email")), F.struct(c("user_id").cast("string").alias("email"))).alias("contacts"),
    )
    return plain(
        events.select(
            "event_id",
            c("doc.k").alias("k"),
            (c("attrs")["k"].cast("decimal(18,2)") / 100).cast("double").alias("k_dollars"),
            c("attrs")["missing"].alias("absent_key"),
            zero_if_null(c("attrs")["missing"]).alias("absent_or_zero"),
            F.concat_ws('"', "contacts.email").alias("emails"),
        )
    )


_AT = "case when json_valid(document) then try_cast(json_extract_string(document, '{0}') as {1}) end"


@query(
    "variant_paths",
    cte("event_documents")
    + f"""select event_id, {_AT.format("$.account.id", "bigint")} as account_id, {_AT.format("$.account.limit", "bigint")} as credit_limit,
                {_AT.format("$.account.status", "varchar")} as status, {_AT.format("$.account.status", "bigint")} as status_as_number,
                {_AT.format("$.contacts[1].email", "varchar")} as second_contact, cast(json_valid(document) as integer) as is_document
         from event_documents""",
)
def variant_paths(spark, sf_dir):
    rows = standin(spark, sf_dir, "event_documents").withColumn("doc", document("document"))
    return plain(
        rows.select(
            "event_id",
            at_path("doc", "$.account.id", "bigint").alias("account_id"),
            at_path("doc", "$.account.limit", "bigint").alias("credit_limit"),
            at_path("doc", "$.account.status", "string").alias("status"),
            at_path("doc", "$.account.status", "bigint").alias("status_as_number"),
            at_path("doc", "$.contacts[1].email", "string").alias("second_contact"),
            c("doc").isNotNull().alias("is_document"),
        )
    )


@query(
    "derive_and_reuse",
    cte("offers", "accounts")
    + """select distinct o.account_id, o.offer_limit_d as offer_limit, a.brand, o.offer_limit_d - cast(a.balance as double) as headroom,
                cast(a.balance as double) / nullif(o.offer_limit_d, 0) as utilisation,
                case when headroom > 200000 then 'wide' else 'narrow' end as room
         from (select account_id, cast(offer_limit as double) as offer_limit_d from offers) o
         join accounts a on a.account_id = o.account_id""",
)
def derive_and_reuse(spark, sf_dir):
    text = """
        select distinct o.account_id, cast(o.offer_limit as double) as offer_limit, a.brand,
               cast(o.offer_limit as double) - cast(a.balance as double) as headroom,
               try_divide(cast(a.balance as double), cast(o.offer_limit as double)) as utilisation,
               case when headroom > 200000 then 'wide' else 'narrow' end as room
        from {offers} o join {accounts} a on a.account_id = o.account_id"""
    frames = {n: standin(spark, sf_dir, n) for n in ("offers", "accounts")}
    return plain(run_sql(spark, text, frames))


@query(
    "marker_lookup",
    cte("accounts", "offers")
    + """select a.account_id, coalesce(m.marked, 0) as marked, case when m.account_id is null then 1 else 0 end as unmatched
         from accounts a left join (select distinct account_id, 1 as marked from offers where offer_date >= date '2001-06-01') m
           on m.account_id = a.account_id""",
)
def marker_lookup(spark, sf_dir):
    marked = standin(spark, sf_dir, "offers").filter(c("offer_date") >= dt.date(2001, 6, 1)).select("account_id").distinct()
    out = attach(standin(spark, sf_dir, "accounts").select("account_id"), marked, "account_id", flag="marked")
    return plain(out.withColumn("unmatched", 1 - c("marked")))


@query(
    "predicate_suite",
    """select o_orderpriority as tu_band,
              cast(count(*) filter (where 1 = 1 and o_orderstatus = 'F' and o_totalprice >= 250000) as bigint) as equal_and_at_least,
              cast(count(*) filter (where o_orderstatus in ('F', 'O')) as bigint) as in_list,
              cast(count(*) filter (where nullif(o_orderstatus, 'P') not in ('F')) as bigint) as not_in_list,
              cast(count(*) filter (where o_totalprice between 100000 and 200000) as bigint) as in_range,
              cast(count(*) filter (where nullif(o_orderstatus, 'P') is null) as bigint) as missing,
              cast(count(*) filter (where nullif(o_orderstatus, 'P') <> 'F' or o_totalprice > 450000) as bigint) as either,
              cast(sum(case when nullif(o_orderstatus, 'P') <> 'F' then 1 when nullif(o_orderstatus, 'P') is null then 10 else 100 end) as bigint) as null_falls_through
       from orders group by o_orderpriority""",
)
def predicate_suite(spark, sf_dir):
    status, price = F.nullif(c("o_orderstatus"), F.lit("P")), c("o_totalprice")
    tests = {
        "equal_and_at_least": (F.lit(1) == 1) & (status == "F") & (price >= 250000),
        "in_list": c("o_orderstatus").isin("F", "O"),
        "not_in_list": ~status.isin("F"),
        "in_range": price.between(100000, 200000),
        "missing": status.isNull(),
        "either": (status != "F") | (price > 450000),
    }
    arms = F.when(status != "F", 1).when(status.isNull(), 10).otherwise(100)
    orders = standin(spark, sf_dir, "orders").groupBy(c("o_orderpriority").alias("tu_band"))
    return plain(orders.agg(*[F.count_if(t).alias(n) for n, t in tests.items()], F.sum(arms).alias("null_falls_through")))


@query(
    "vintage_range",
    cte("offers")
    + """select offer_mth, cast(count(*) as bigint) as n, cast(sum(offer_limit) as double) as limit_sum from offers
         where offer_mth >= '1998-07' and offer_mth <= '1999-06' and accepted_flag = 1 group by offer_mth""",
)
def vintage_range(spark, sf_dir):
    text = """
        select offer_mth, count(*) as n, sum(offer_limit) as limit_sum from {offers}
        where offer_mth >= :first and offer_mth <= :last and accepted_flag = :accepted group by offer_mth"""
    return plain(run_sql(spark, text, {"offers": standin(spark, sf_dir, "offers")}, first="1998-07", last="1999-06", accepted=1))


@query(
    "vintage_floor",
    """select strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as vintage, cast(count(*) as bigint) as n from orders group by 1""",
)
def vintage_floor(spark, sf_dir):
    return plain(standin(spark, sf_dir, "orders").groupBy(month_floor("o_orderdate").alias("vintage")).agg(F.count(F.lit(1)).alias("n")))


AUDIENCE_SQL = (
    cte("accounts", "offers")
    + """, standard as (
           select account_id, brand, 'Standard' as segment, cast(1 as integer) as eligible,
                  cast(least(cast(balance * 100 as bigint), 500000) as bigint) as new_limit_cents from accounts where balance > 0),
         passed as (
           select o.account_id, a.brand, 'Active' as segment, cast(1 as integer) as eligible,
                  cast(greatest(cast(round(o.offer_limit / 100, 0) * 10000 as bigint), 20000000) as bigint) as new_limit_cents
           from offers o join accounts a on a.account_id = o.account_id where o.status = 'P')
         select * from standard union select * from passed"""
)


def audience(spark, sf_dir):
    accounts = standin(spark, sf_dir, "accounts")
    columns = ["account_id", "brand", "segment", "eligible", "new_limit_cents"]
    standard = accounts.filter(c("balance") > 0).select(
        "account_id",
        "brand",
        F.lit("Standard").alias("segment"),
        F.lit(1).alias("eligible"),
        clamp((c("balance") * 100).cast("bigint"), hi=500000).cast("bigint").alias("new_limit_cents"),
    )
    pending = standin(spark, sf_dir, "offers").filter(c("status") == "P").select("account_id", "offer_limit")
    passed = attach(pending, accounts.select("account_id", "brand"), "account_id", "inner").select(
        "account_id",
        "brand",
        F.lit("Active").alias("segment"),
        F.lit(1).alias("eligible"),
        clamp((F.round(c("offer_limit") / 100, 0) * 10000).cast("bigint"), lo=20000000).cast("bigint").alias("new_limit_cents"),
    )
    return union_distinct(standard.select(*columns), passed.select(*columns))


@query("audience_union", AUDIENCE_SQL)
def audience_union(spark, sf_dir):
    return plain(audience(spark, sf_dir))


@query(
    "append_then_read",
    AUDIENCE_SQL.replace(
        "select * from standard union select * from passed",
        "select *, '2001-08-01' as adjudicated_date from (select * from standard union select * from passed)",
    ),
)
def append_then_read(spark, sf_dir):
    """The audience appended to the log in the shared folder, then read back by its day."""
    path = run_folder(spark, "audience")
    append_audience(audience(spark, sf_dir), dt.datetime(2001, 8, 1, 6), path=path)
    log = spark.read.parquet(path).filter(c("adjudicated_date") == AS_OF)
    return plain(log.drop("adjudicated_at", "adjudicated_run"))


@query(
    "audience_log",
    AUDIENCE_SQL.replace(
        "select * from standard union select * from passed",
        """, runs as (select * from standard union select * from passed)
         select *, '2001-08-01' as adjudicated_date, 6 as hour from runs union all
         select *, '2001-08-01', 18 from runs where segment = 'Active' union all select *, '2001-08-02', 6 from runs where brand = 'BUILDING'""",
    ),
)
def audience_log(spark, sf_dir):
    """Three runs in the log, one of them written twice: a run that is repeated replaces itself."""
    path, rows = run_folder(spark, "audience"), audience(spark, sf_dir)
    for at, run in (
        (dt.datetime(2001, 8, 1, 6), rows.filter(c("segment") == "Active")),
        (dt.datetime(2001, 8, 1, 18), rows.filter(c("segment") == "Active")),
        (dt.datetime(2001, 8, 1, 6), rows),
        (dt.datetime(2001, 8, 2, 6), rows.filter(c("brand") == "BUILDING")),
    ):
        append_audience(run, at, path=path)
    log = spark.read.parquet(path)
    return plain(log.withColumn("hour", F.hour("adjudicated_at")).drop("adjudicated_at", "adjudicated_run"))


BRAND_TOTALS = "select brand, cast(count(*) as bigint) as n, cast(sum(balance) as double) as balance from accounts group by brand"


@query("session_table", cte("accounts") + BRAND_TOTALS)
def session_table(spark, sf_dir):
    """A view of the session, replaced once, read by SQL text."""
    accounts = standin(spark, sf_dir, "accounts")
    session_view(accounts.filter(c("balance") > 0), "limitloom_accounts_view")
    session_view(accounts, "limitloom_accounts_view")
    return plain(run_sql(spark, BRAND_TOTALS.replace("from accounts", "from limitloom_accounts_view")))


@query("replaced_table", cte("accounts") + BRAND_TOTALS)
def replaced_table(spark, sf_dir):
    """A stored table, replaced once by other rows, bucketed by its key."""
    accounts, name = standin(spark, sf_dir, "accounts"), f"limitloom_accounts_{uuid.uuid4().hex}"
    path = run_folder(spark, "accounts")
    replace_table(accounts.filter(c("balance") > 0), name, path=path)
    replace_table(accounts, name, path=path, bucket_by=(8, "account_id"))
    return plain(spark.table(name).groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.sum("balance").alias("balance")))


@query(
    "chart_records",
    cte("accounts") + "select to_json(struct_pack(brand := brand, n := n)) as record from (select brand, count(*) as n from accounts group by brand)",
)
def chart_records(spark, sf_dir):
    counts = standin(spark, sf_dir, "accounts").groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    return to_records(counts)
