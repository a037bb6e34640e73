"""Credit tables derived from the synthetic driver tables.

The driver tables hold no credit data, so each registered query works on a stand-in: a
SQL view over whole driver tables, written in the subset that Spark and DuckDB share.
`standin` builds it in Spark, `cte` renders it for the oracle, so both sides start from
the same rows and differ only in the operator under test.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from limitloom.sources.tables import DRIVER, load

_VIEWS: dict[str, str] = {}

# Accounts and their limit offers.
_VIEWS["accounts"] = """
select c_custkey as account_id, c_mktsegment as brand, c_nationkey as nation_key,
       cast(c_acctbal as decimal(12,2)) as balance
from {customer}"""

_VIEWS["offers"] = """
select o_orderkey as offer_id, o_custkey as account_id, cast(o_orderdate as date) as offer_date,
       left(cast(cast(o_orderdate as date) as string), 7) as offer_mth, o_orderstatus as status,
       cast(o_orderstatus = 'F' as int) as accepted_flag,
       cast(o_totalprice as decimal(12,2)) as offer_limit, o_orderpriority as tu_band,
       case when mod(o_custkey, 23) = 0 or mod(o_orderkey, 29) = 0 then 'SECURED' else 'UNSECURED' end as sub_product,
       cast(mod(o_orderkey * 7 + o_custkey, 48) as int) as cli_mob
from {orders}"""

# Line items with their account: the base of monthly performance and daily snapshots.
_VIEWS["lines"] = """
select o_custkey as account_id, o_orderkey as offer_id, cast(o_orderdate as date) as order_date,
       cast(l_shipdate as date) as ship_date, l_linenumber as line_number, l_partkey as part_key,
       l_suppkey as supp_key, l_returnflag as return_flag, l_linestatus as line_status,
       cast(l_extendedprice as decimal(12,2)) as price, cast(l_tax as decimal(4,2)) as tax,
       cast(l_discount as decimal(4,2)) as discount, cast(l_quantity as bigint) as quantity
from {lineitem} join {orders} on l_orderkey = o_orderkey"""

# Monthly performance: one row per account and month, margin parts in exact decimals.
_VIEWS["performance"] = """
select account_id, stmt_date, left(cast(stmt_date as string), 7) as stmt_mth, bfc, cof, guco,
       bfc - cof - guco as raim, adb, late_lines, lines_in_month,
       case when mod(account_id + month(stmt_date), 31) = 0 then 'SECURED' else 'UNSECURED' end as secure_type
from (
  select account_id, make_date(year(ship_date), month(ship_date), 1) as stmt_date,
         cast(sum(price) as decimal(22,4)) as bfc, cast(sum(price * tax) as decimal(22,4)) as cof,
         cast(sum(case when return_flag = 'R' then price * discount else 0 end) as decimal(22,4)) as guco,
         cast(sum(quantity) as bigint) as adb,
         cast(sum(case when line_status = 'O' then 1 else 0 end) as bigint) as late_lines,
         cast(count(*) as bigint) as lines_in_month
  from {lines} group by account_id, make_date(year(ship_date), month(ship_date), 1)
)"""

# Daily snapshot rows; days past due run from the order to the shipment.
_VIEWS["daily"] = """
select account_id, offer_id, ship_date as reference_date, order_date,
       greatest(datediff_days(order_date, ship_date), 0) as dpd, line_status as status, return_flag,
       line_number, part_key, supp_key, price, quantity
from {lines}"""

# Event stand-ins: purchases play offers, views play model scores.
_VIEWS["event_offers"] = """
select event_id as request_id, user_id as account_id, ts as requested_at, cast(ts as date) as offer_date
from {events} where event_type = 'purchase'"""

_VIEWS["event_scores"] = """
select event_id as score_id, user_id as account_id, ts as scored_at, cast(ts as date) as reference_date,
       least(value, cast(100 as double)) / 100 as prediction
from {events} where event_type = 'view'"""

_VIEWS["event_decisions"] = """
select event_id as decision_id, user_id as account_id, ts as adjudicated_at, cast(value as decimal(12,2)) as amount
from {events} where event_type = 'click'"""

# Documents with a path absent in some rows, a list of one or two, and texts that are no document.
# chr(123) and chr(125) are braces, which name tables here.
_VIEWS["event_documents"] = """
select event_id, case when mod(event_id, 41) = 0 then 'no document'
  else chr(123) || '"account": ' || chr(123) || '"id": ' || cast(user_id as string)
    || case when event_type = 'view' then '' else ', "limit": ' || cast(mod(event_id, 9000) as string) end
    || ', "status": "' || event_type || '"' || chr(125) || ', "contacts": [' || chr(123) || '"email": "a' || cast(event_id as string) || '"' || chr(125)
    || case when mod(event_id, 3) = 0 then ', ' || chr(123) || '"email": "b' || cast(event_id as string) || '"' || chr(125) else '' end || ']' || chr(125) end as document
from {events}"""

# One applicant per offer. The driver tables have no bureau or status attributes, so these
# are spread over the offers by remainders of the limit and the offer id, with some missing.
_VIEWS["applicants"] = """
select offer_id, account_id, offer_date,
       case brand when 'BUILDING' then 'PARTNER' when 'MACHINERY' then 'OTHER' else 'CORE' end as brand,
       case when mod(nation_key, 5) = 0 then 'QC' else 'ON' end as province,
       cast(nullif(550 + mod(d, 351), 613) as int) as score,
       cast(nullif(mod(offer_id, 40), 39) as int) as mob_rounded,
       cast(mod(d, 11000) as decimal(12,2)) as credit_limit,
       case when mod(offer_id, 53) <> 0 then cast(mod(d, 11000) as decimal(12,2)) end as day_end_limit,
       case when mod(offer_id, 29) = 0 then 'FROZEN' else 'ACTIVE' end as user_status,
       case when mod(offer_id, 31) = 0 then 'N' when mod(offer_id, 97) = 0 then null else 'H' end as go26,
       case when mod(offer_id, 101) = 0 then 'Y' else 'N' end as go91,
       case when mod(d, 103) = 0 then 1 else 0 end as pr44, case when mod(d, 107) = 0 then 1 else 0 end as pr45,
       case when mod(d, 109) = 0 then 1 else 0 end as pr124, case when mod(d, 113) = 0 then 1 else 0 end as pr116,
       case when mod(d, 127) = 0 then 1 else 0 end as pr15, case when mod(d, 131) = 0 then 1 else 0 end as pr50,
       case when mod(d, 137) = 0 then 1 else 0 end as pr74, case when mod(d, 139) = 0 then 1 else 0 end as pr75,
       case when mod(d, 149) = 0 then 1 else 0 end as pr120, case when mod(d, 151) = 0 then 1 else 0 end as pr97,
       case when mod(d, 157) = 0 then 1 else 0 end as go81,
       case when mod(d, 37) = 0 then 12 when mod(d, 38) = 0 then 0 end as days_past_due,
       case when mod(d, 41) = 0 then 45 when mod(d, 43) = 0 then 10 end as max_dpd_3m,
       cast(mod(d, 700) - 10 as int) as paid_3m, cast(mod(d, 900) - 5 as int) as owed_3m,
       case when mod(offer_id, 17) = 0 then 3 when mod(offer_id, 18) = 0 then null else 1 end as go06,
       case when mod(d, 59) < 3 then 6 when mod(d, 59) = 4 then null else 24 end as am36,
       cast(1 + mod(d, 23) as int) as segment_indicator,
       case when mod(d, 47) = 0 then cast(2 as double) when mod(d, 5) = 0 then cast(14 as double) end as last_cli_months,
       case when mod(d, 53) = 0 then 0 else 1 end as cld_block, case when mod(d, 19) = 0 then 1 else 0 end as cld_population,
       mod(d, 19000) as old_limit,
       case when mod(d, 61) = 0 then 1 when mod(d, 67) = 0 then 2 else 0 end as restriction,
       case when mod(d, 71) = 0 then 'SECURED' else 'UNSECURED' end as account_type,
       case when mod(d, 73) = 0 then 'CLOSED' else 'OPEN' end as day_end_status,
       case when mod(d, 79) = 0 then 'FRAUD' end as day_end_frozen_reason,
       case when mod(d, 83) = 0 then 0 end as day_end_dpd,
       case when mod(d, 89) = 0 then 'BANKRUPT' else 'N/A' end as day_end_charge_off,
       date '2001-08-01' - cast(mod(d, 70) as int) as close_date,
       case when mod(offer_id, 6) = 0 then date '2001-08-01' - cast(mod(d, 50) as int) end as closed_on,
       cast(mod(d, 3) as int) as interest, cast(mod(offer_id, 3) as int) as interest_1m, cast(mod(offer_id, 4) as int) as interest_2m,
       cast(mod(d, 2) * mod(d, 900) as int) as previous_balance, cast(mod(d, 4) * mod(d, 1100) as int) as new_balance,
       cast(mod(offer_id, 2) * mod(d, 300) as int) as purchase,
       cast(mod(d, 13000) as decimal(12,2)) as latest_balance,
       't-' || cast(mod(d, 10) as string) as tenant_id,
       case when mod(d, 31) = 0 then 2 when mod(d, 32) = 0 then null else 1 end as n_unsecured,
       case when mod(d, 33) = 0 then 1 else 0 end as n_world,
       case when mod(d, 35) = 0 then 'US' when mod(d, 36) = 0 then null else 'CA-ON' end as issued_by,
       case mod(offer_id, 9) when 0 then 'QC-RPL' when 1 then 'HIGH-PRTV' when 2 then null else 'STD' end as strategy,
       case when mod(offer_id, 7) <> 0 then offer_id end as matched_offer_id,
       case when mod(d, 4) = 0 then offer_date end as declined_at, case when mod(d, 3) = 0 then offer_date end as accepted_at
from (select o.offer_id, o.account_id, o.offer_date, cast(floor(o.offer_limit) as bigint) as d, a.brand, a.nation_key
      from {offers} o join {accounts} a on a.account_id = o.account_id)"""

# One candidate of the early-tenure campaign per offer, spread the same way.
_VIEWS["candidates"] = """
select offer_id, account_id, brand,
       case when score0 < 640 then 'b. Sub Prime (300 to 639)' when score0 < 720 then 'c. Near-Prime (640 to 719)'
            when score0 < 760 then 'd. Prime (720 to 759)' when score0 < 800 then 'e. Prime+ (760 to 799)'
            else 'f. Super Prime (800+)' end as original_score_band,
       case when score1 < 640 then 'b. Sub Prime (300 to 639)' when score1 < 720 then 'c. Near-Prime (640 to 719)'
            when score1 < 760 then 'd. Prime (720 to 759)' when score1 < 800 then 'e. Prime+ (760 to 799)'
            else 'f. Super Prime (800+)' end as latest_score_band,
       score0 as original_score, nullif(score1, 700) as latest_score,
       case mod(d, 6) when 0 then 2000 when 1 then 1000 when 2 then 650 when 3 then 1500 when 4 then 1800 end as credit_limit,
       cast(mod(d, 120) as int) + 80 as day_on_book,
       case when mod(d, 41) = 0 then 1 else 0 end as junior_10,
       case when mod(d, 43) = 0 then null when mod(d, 44) = 0 then 2 else null end as fraud_remove,
       case when mod(d, 47) = 0 then 'false' when mod(d, 2) = 0 then 'true' end as trusted_payment,
       cast(mod(d, 3100) as decimal(12,2)) as amount,
       case when mod(d, 53) = 0 then 1 else 0 end as cash_advance, case when mod(d, 59) = 0 then 0 else 1 end as confirmed_purchase,
       case when mod(d, 61) = 0 then 1 else 0 end as ever_late,
       cast(cast(mod(d, 3) as int) as string) as am41_at_onboarding, cast(mod(offer_id, 3) as int) as latest_am41,
       case when mod(d, 67) = 0 then null else cast(mod(d, 90) as int) + 560 end as behaviour_score,
       case when mod(d, 71) <> 0 then cast(mod(d, 500) as decimal(12,2)) end as payment_amount,
       case when mod(d, 73) = 0 then 'FRAUD' end as frozen_reason, case when mod(d, 79) = 0 then 1 end as cli_flag,
       case mod(d, 4) when 0 then 'THICK' when 1 then 'THIN' when 2 then 'SUBPRIME' when 3 then 'THICK' end as segment,
       cast(590 + mod(d, 311) as int) as cvsc100, cast(floor(mod(d, 29) / 14) as int) as am41,
       case when mod(d, 83) = 0 then 1 else 0 end as am42, case when mod(d, 89) = 0 then 1 else 0 end as am43,
       case when mod(d, 97) = 0 then 1 else 0 end as am84, cast(40 + mod(d, 160) as int) as go11, cast(mod(d, 110) as double) as re34,
       cast(mod(offer_id, 230) as double) as dti, case when mod(d, 101) = 0 then 1 else 0 end as pr51,
       cast(mod(offer_id, 6) as int) as at01, cast(mod(d, 95) as int) as bc147, cast(mod(offer_id, 5) as int) as go06,
       cast(mod(d, 2) as int) as go149, cast(1 + mod(d, 9) as int) as go14, cast(mod(d, 5) as int) as go141,
       cast(mod(d, 520) as int) as pr11, cast(mod(offer_id, 11) as int) as am02,
       cast(640 + mod(d, 160) as double) as bko, cast(440 + mod(offer_id, 240) as double) as thick,
       cast(600 + mod(offer_id, 120) as double) as thin, cast(540 + mod(offer_id, 120) as double) as subprime,
       case when mod(offer_id, 101) = 0 then 'Y' else 'N' end as go91,
       case when mod(d, 103) = 0 then 1 else 0 end as pr44, case when mod(d, 107) = 0 then 1 else 0 end as pr45,
       case when mod(d, 109) = 0 then 1 else 0 end as pr124, case when mod(d, 113) = 0 then 1 else 0 end as pr116,
       case when mod(d, 127) = 0 then 1 else 0 end as pr15, case when mod(d, 131) = 0 then 1 else 0 end as pr50,
       case when mod(d, 137) = 0 then 1 else 0 end as pr74, case when mod(d, 139) = 0 then 1 else 0 end as pr75,
       case when mod(d, 149) = 0 then 1 else 0 end as pr120, case when mod(d, 151) = 0 then 1 else 0 end as pr97,
       case when mod(d, 157) = 0 then 1 else 0 end as go81
from (select o.offer_id, o.account_id, cast(floor(o.offer_limit) as bigint) as d, a.brand,
             cast(600 + mod(cast(floor(o.offer_limit) as bigint), 280) as int) as score0,
             cast(600 + mod(cast(floor(o.offer_limit) as bigint), 280) + mod(o.offer_id, 130) - 65 as int) as score1
      from {offers} o join {accounts} a on a.account_id = o.account_id)"""

# Days between two dates, spelled per engine.
_DAYS = re.compile(r"datediff_days\((\w+), (\w+)\)")


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def standin(spark: SparkSession, directory: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A stand-in (or a driver table) as a DataFrame.

    ``known`` holds frames already built for the same query; new ones are added to it.
    """
    known = {} if known is None else known
    if name not in known:
        if name in DRIVER:
            known[name] = load(spark, directory, name)
        else:
            sql = _VIEWS[name]
            frames = {n: standin(spark, directory, n, known) for n in _needs(sql)}
            known[name] = spark.sql(_DAYS.sub(r"datediff(\2, \1)", sql), **frames)
    return known[name]


def cte(*names: str) -> str:
    """``WITH`` clause that defines the named stand-ins for DuckDB."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in DRIVER or name in ordered:
            return
        for need in _needs(_VIEWS[name]):
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in ordered:
        sql = _DAYS.sub(r"datediff('day', \1, \2)", _VIEWS[name])
        parts.append(f"{name} as ({re.sub(r'{(\w+)}', r'\1', sql)})")
    return "with " + ",\n".join(parts)


def add_views(views: dict[str, str]) -> None:
    """Register further stand-ins; their SQL may use the ones already known."""
    clash = set(views) & (set(_VIEWS) | set(DRIVER))
    if clash:
        raise ValueError(f"stand-ins defined twice: {sorted(clash)}")
    _VIEWS.update(views)
