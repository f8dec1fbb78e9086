"""The queries of problems 1 to 5: pN_..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.functions.text import day, key_form
from paritas.operators.changes import current_state
from paritas.operators.differences import Field, differences
from paritas.operators.orphans import orphan_counts, orphans
from paritas.operators.quality import LEGACY, counted_cells, findings, profiles, two_sample_test, value_counts
from paritas.operators.schema_drift import Drift
from paritas.sources.tables import table

ACCOUNT_FIELDS = [
    Field("customer_id", "customer_ref", "customer_id", "key"),
    Field("balance", "acct_bal", "balance", "amount"),
    Field("currency", "currency", "currency", "key"),
    Field("status", "status", "status", "status"),
    *(Field(c, c, c, "amount") for c in ("opening_balance", "credits", "debits", "adjustments", "closing_balance")),
]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = differences(
        table(spark, d, "legacy_accounts"),
        table(spark, d, "accounts"),
        "acct_no",
        "account_id",
        ACCOUNT_FIELDS,
        missing_right="missing_in_accounts",
        missing_left="missing_in_legacy",
    )
    return found.withColumnRenamed("key", "account_key")


def _each_load(spark: SparkSession, d: str, f) -> DataFrame:
    out = None
    for spec in LEGACY:
        part = f(table(spark, d, spec.name), spec).withColumn("table_name", F.lit(spec.name))
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    recorded = table(spark, d, "column_profiles")
    found = _each_load(spark, d, lambda df, spec: findings(df, recorded.where(F.col("table_name") == spec.name), spec))
    return found.select("table_name", "load_id", "column_name", "finding")


def p2_profiles(spark: SparkSession, d: str) -> DataFrame:
    found = _each_load(spark, d, lambda df, spec: profiles(value_counts(df, spec), spec))
    top = F.to_json("top_values").alias("top_values")
    columns = ["table_name", "load_id", "column_name", "row_count", "null_count", "distinct_count", "malformed"]
    return found.select(*columns, "min_value", "max_value", top)


def p2_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _each_load(spark, d, lambda df, spec: two_sample_test(counted_cells(df, spec), spec))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return current_state(table(spark, d, "cdc_events"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    customers, accounts, transactions = (
        table(spark, d, f"legacy_{x}") for x in ("customers", "accounts", "transactions")
    )
    since, until = day(F.col("loaded_at"), False), day(F.col("deleted_at"), False)
    to_accounts = orphans(
        transactions,
        key_form(F.col("txn_id")),
        key_form(F.col("acct_ref")),
        day(F.col("ingest_date"), True),
        accounts,
        key_form(F.col("acct_no")),
        since,
        until,
    )
    to_customers = orphans(
        accounts,
        key_form(F.col("acct_no")),
        key_form(F.col("customer_ref")),
        since,
        customers,
        key_form(F.col("customer_no")),
        since,
        until,
    )
    name = lambda t: F.lit(t).alias("table_name")
    return to_accounts.select(name("legacy_transactions"), "*").unionByName(
        to_customers.select(name("legacy_accounts"), "*")
    )


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p4_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return Drift(table(spark, d, "raw_records")).changes()


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    unified = Drift(table(spark, d, "raw_records")).unified()
    return unified.select("table_name", "source_id", "file_no", "record_key", F.to_json("columns").alias("columns"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_profiles, p2_evidence, p3_found, p4_found, p4_counts, p5_found, p5_unified)}
