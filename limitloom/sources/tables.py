"""Reading tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the synthetic driver tables that the queries use.
DRIVER = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_STATEMENT_SUMMARY = (
    "struct<account: struct<paymentsCents: bigint, paymentsAndCreditsCents: bigint, purchasesCents: bigint, "
    "previousBalanceCents: bigint, creditLimitCents: bigint, newBalanceCents: bigint, generalInterestCents: bigint>, "
    "cardholder: struct<physicalAddress: struct<province: string>>>"
)
_BUREAU_COUNTS = ["pr15", "pr44", "pr45", "pr50", "pr74", "pr75", "pr97", "pr116", "pr120", "pr124", "go81"]

# Source shapes of the ready pipelines in `limitloom.plans`.
DOMAIN = {
    "offers_view": "account_id string, offer_date date, accepted_flag int, sub_product string, cli_mob int, "
    "offer_mth string, current_cl decimal(18,2), new_cl decimal(18,2), inc_exposure decimal(18,2), program string, score_band string",
    "performance": "account_id string, vintage string, stmt_num int, stmt_mth string, accepted_flag int, brand string, "
    "card_type string, tu_band string, tu_score int, am_tu_band string, app_seg string, secure_type string, dpd_bucket string, "
    "bfc decimal(18,2), cof decimal(18,2), guco decimal(18,2), adb decimal(18,2), icl decimal(18,2), prev_cl decimal(18,2), "
    "cl decimal(18,2), booking_date date",
    "change_requests": "request_id string, user_id string, account_id string, offer_id string, created_at timestamp",
    "limit_offers": "offer_id string, account_id string, user_id string, strategy string, actioned_by string, created_at timestamp, "
    "initiated_at timestamp, accepted_at timestamp, declined_at timestamp, limit_cents_at_offer bigint, offered_limit_cents bigint",
    "limit_decreases": "account_id string, strategy string, initiated_at timestamp, applied_at timestamp, "
    "previous_limit_cents bigint, new_limit_cents bigint",
    "limit_adjustments": "account_id string, type string, reason string, as_of_ts timestamp",
    "scores": "account_id string, reference_date timestamp, prediction double, model_version string",
    "behaviour_scores": "account_id string, reference_date timestamp, model_score double",
    "bankruptcy_scores": "user_id string, reference_date timestamp, score double",
    "risk_accounts": "account_id string, id_date date, type string",
    "account_daily": "account_id string, reference_date date, user_id string, customer_id string, brand string, sub_product string, "
    "card_type string, product_type string, account_status string, facility string, frozen_reason string, charged_off_reason string, "
    "province string, latest_score_band string, original_score_band string, days_past_due int, day_on_book int, month_on_book int, "
    "latest_score int, original_score int, is_credit_active boolean, credit_limit decimal(18,2)",
    "transactions": "account_id string, category string, status string, decline_reason string, account_status string, "
    "card_type string, trusted_payment string, authorized_at timestamp, completed_at timestamp, amount decimal(18,2)",
    "statements": "statement_id string, account_id string, user_id string, opening_date string, closing_date string, "
    f"payment_due_date string, summary {_STATEMENT_SUMMARY}",
    "statement_adb": "statement_id string, adb bigint",
    "bureau": "user_id string, credit_report_date string, created_at timestamp, score int, segment int, go06 int, go26 string, "
    "go91 string, am36 int, am41 int, bc33 int, re33 int, re34 int, bc34 int, bc91 int, " + ", ".join(f"{c} int" for c in _BUREAU_COUNTS),
    "redecision_inputs": "user_id string, segment string, cvsc100 int, go14 int, at01 int, am42 int, am43 int, am84 int, go11 int, "
    "pr51 int, bc147 int, go06 int, go149 int, go141 int, pr11 int, am02 int, am41 int, re34 double, dti double, bko double, "
    "thick double, thin double, subprime double, go91 string, " + ", ".join(f"{c} int" for c in _BUREAU_COUNTS),
    "users": "user_id string, type string, status string, frozen_reason string, tenant_id string, created_at timestamp, "
    "emails array<struct<email: string>>, physicalAddress struct<province: string>, "
    "employmentInfo struct<employmentStatus: string, fieldOfStudy: string>",
    "applications": "application_id string, user_id string, report_snapshot_id string, brand string, type string, status string, "
    "decision string, created_at timestamp, credit_card_report map<string, string>",
    "accounts": "account_id string, user_id string, application_id string, status string, tier string, secured_deposit_id string, "
    "created_at timestamp, close_date timestamp",
    "cards": "account_id string, brand string, created_at timestamp",
    "facility_accounts": "account_id string, facility_id string",
    "facilities": "facility_id string, name string",
    "balances": "account_id string, total_balance_cents bigint, created_at timestamp",
    "id_documents": "user_id string, issuing_country string, id_issuer string, completed_at timestamp",
    "control_group": "account_id string, type string",
}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the declared columns in the declared types; what agrees is left alone."""
    declared = {f.name.lower(): f for f in T.StructType.fromDDL(schema).fields}
    present = {f.name.lower(): f for f in df.schema.fields}
    missing = [f.name for key, f in declared.items() if key not in present]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    casts = {f.name: F.col(f.name).cast(f.dataType) for key, f in declared.items() if present[key].dataType != f.dataType}
    if casts:
        df = df.withColumns(casts)
    return df if len(present) == len(declared) else df.select(*[f.name for f in declared.values()])


# File schemas already looked up, per application and path. Only types are remembered;
# files are listed anew on every read.
_FILE_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def load(spark: SparkSession, directory: str, name: str, schema: str | None = None) -> DataFrame:
    """``directory/name.parquet`` with its declared schema."""
    path = f"{directory}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _FILE_SCHEMAS:
        _FILE_SCHEMAS[key] = spark.read.parquet(path).schema
    return conform(spark.read.schema(_FILE_SCHEMAS[key]).parquet(path), schema or DRIVER[name])


def nested(document: Column | str, schema: str) -> Column:
    """A JSON document as a struct or map, to be read by dotted path or key."""
    return F.from_json(F.col(document) if isinstance(document, str) else document, schema)


def run_sql(spark: SparkSession, text: str, frames: dict[str, DataFrame] | None = None, **args) -> DataFrame:
    """A SQL text with bound values (``:name``) and frames (``{name}``).

    Values travel as typed parameters, never as text pasted into the statement.
    """
    return spark.sql(text, args=args or None, **(frames or {}))
