"""Who is studied: unsecured products and, where asked for, accounts past their first months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitloom.functions import month_start

c = F.col

UNSECURED = "UNSECURED"
# Later-tenure studies look at offers made after this many months on book.
LATER_TENURE = 6


def unsecured_offers(offers: DataFrame, min_tenure: int | None = None) -> DataFrame:
    """Offers on unsecured products, ``min_tenure`` asks for more months on book than that; a missing value is out."""
    kept = offers.filter(c("sub_product") == UNSECURED)
    kept = kept if min_tenure is None else kept.filter(c("cli_mob") > min_tenure)
    return kept.drop("sub_product", "cli_mob")


def monthly_margin(performance: DataFrame) -> DataFrame:
    """Unsecured monthly rows with the day of their month and the risk-adjusted margin, missing if any part is."""
    kept = performance.filter(c("secure_type") == UNSECURED).drop("secure_type")
    return kept.withColumns({"stmt_date": month_start("stmt_mth"), "raim": c("bfc") - c("cof") - c("guco")})
