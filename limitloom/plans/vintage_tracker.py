"""Offer vintages followed month by month.

Two grains. `track` keeps one row per offer and month, for drill-down. `vintage_panel`
serves every aggregate: offers that share an account, a vintage and the grouping labels
behave alike month by month, so they are counted first and the count weighs the monthly
row. The join then meets at most one row per (account, vintage, labels) with one row per
(account, month), however many offers an account has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.functions import cond_sum, month_diff, month_floor, month_key
from limitloom.operators import attach, pivot_months
from limitloom.plans.population import monthly_margin, unsecured_offers


def track(offers: DataFrame, performance: DataFrame, offer_date="offer_date", month="stmt_date", how="left") -> DataFrame:
    """Every offer with each monthly row of its account."""
    out = attach(offers, performance, "account_id", how)
    return out.withColumns({"cli_stmt": month_diff(offer_date, month), "offer_vintage": month_key(offer_date)})


def attach_months(rows: DataFrame, monthly: DataFrame, span: tuple[int, int], since, month) -> DataFrame:
    """Inner join of rows to the monthly rows ``span`` months after ``since``, first to last.

    The wanted months are unfolded on the left, so the month is a join key and no row meets its whole history.
    Spark sizes unfolded rows as if they were not, so a side of ten times that would be broadcast: the hint has both sides shuffled.
    """
    wanted = F.array(*[F.add_months(month_floor(since), k) for k in range(span[0], span[1] + 1)])
    left, right = rows.withColumn("__month", F.explode(wanted)), monthly.withColumn("__month", month_floor(month))
    return attach(left.hint("merge"), right, ["account_id", "__month"], "inner").drop("__month")


def vintage_panel(
    offers: DataFrame,
    performance: DataFrame,
    labels: Sequence[str] = (),
    span: tuple[int, int | None] | None = None,
    offer_date="offer_date",
    month="stmt_date",
    how="left",
) -> DataFrame:
    """Monthly rows weighted by ``n_offers``, with ``cli_stmt`` and ``offer_vintage``.

    ``span`` keeps months first..last after the offer (inclusive, an open end with None) and, being
    a filter on the monthly side, makes the join inner.
    """
    counted = (
        offers.withColumn("vintage_date", month_floor(offer_date))
        .groupBy("account_id", "vintage_date", *labels)
        .agg(F.count(F.lit(1)).alias("n_offers"))
    )
    age = month_diff("vintage_date", month)
    if span is not None and span[1] is not None:
        out = attach_months(counted, performance, span, "vintage_date", month)
    else:
        out = attach(counted, performance, "account_id", how if span is None else "inner", extra=None if span is None else age >= span[0])
    return out.withColumns({"cli_stmt": age, "offer_vintage": month_key("vintage_date")})


def weighted_sum(x: str, name: str | None = None) -> Column:
    return F.sum(F.col(x) * F.col("n_offers")).alias(name or f"{x}_sum")


def weighted_mean(x: str, name: str) -> Column:
    """Mean over offer-months; missing values are left out of both sums."""
    weight = F.sum(F.when(F.col(x).isNotNull(), F.col("n_offers")))
    return F.try_divide(F.sum(F.col(x) * F.col("n_offers")).cast("double"), weight.cast("double")).alias(name)


def margin_by_month(offers: DataFrame, performance: DataFrame) -> DataFrame:
    """Charge-offs and margin of accepted offers by statement month and brand."""
    # No vintage in the result, so offers are counted per account: one exchange less.
    accepted = unsecured_offers(offers).filter(F.col("accepted_flag") == 1)
    counted = accepted.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_offers"))
    panel = attach(counted, monthly_margin(performance), "account_id")
    return panel.groupBy("stmt_mth", "brand").agg(
        F.sum("n_offers").alias("offer_rows"), weighted_sum("guco", "guco_sum"), weighted_sum("raim", "raim_sum")
    )


def charge_offs_by_vintage(offers: DataFrame, performance: DataFrame, brand: str, months: Sequence[str]) -> DataFrame:
    """One row per vintage of a brand, one charge-off column per listed month."""
    accepted = unsecured_offers(offers).filter(F.col("accepted_flag") == 1)
    panel = vintage_panel(accepted, monthly_margin(performance)).filter(F.col("brand") == brand)
    weighted = panel.withColumn("weighted", F.col("guco") * F.col("n_offers"))
    return pivot_months(weighted, "offer_vintage", "stmt_mth", "weighted", months, "guco_sum")


def balance_by_bucket(offers: DataFrame, performance: DataFrame, brand: str, after: str, month: str) -> DataFrame:
    """Balances of a brand in early (B0, B1) and later delinquency buckets, B7 left out."""
    accepted = unsecured_offers(offers).filter(F.col("accepted_flag") == 1)
    panel = vintage_panel(accepted, monthly_margin(performance), span=(0, None))
    panel = panel.filter((F.col("stmt_mth") > after) & (F.col("stmt_mth") == month))
    bucket, own = F.col("dpd_bucket"), F.col("brand") == brand
    early = bucket.like("%B0%") | bucket.like("%B1%")
    late = ~bucket.like("%B0%") & ~bucket.like("%B1%") & ~bucket.like("%B7%")
    held = F.col("adb") * F.col("n_offers")
    return panel.groupBy("stmt_mth", "offer_vintage").agg(
        cond_sum(own & early, held).alias("early_balance"), cond_sum(own & late, held).alias("late_balance")
    )
