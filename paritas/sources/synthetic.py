"""A synthetic legacy bank with planted defects, generated in parallel from row numbers.

Defects come at fixed steps of a customer's number: a padded name every 11th, an impossible birthday every 17th, a bad
phone every 13th, a repeated row every 23rd, a negative first amount every 19th, a risk row every 7th, and one
transaction of an unknown account. Other values are drawn by hashing row number and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values drawn from (fixed values).
STATUSES = ("Y", "Yes", "1", "ACTIVE", "A", "N", "0", "CLOSED", "X")
CURRENCIES, COUNTRIES = ("USD", "EUR", "GBP", "INR"), ("US", "GB", "IN", "DE")
TYPES = ("CREDIT", "DEBIT", "REVERSAL", "CHARGEBACK")


def _draw(seed: int, what: str, *of: Column) -> Column:
    return F.pmod(F.xxhash64(*of, F.lit(seed), F.lit(what)), F.lit(1 << 40))


def _one_of(values: tuple[str, ...], draw: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (draw % len(values)).cast("int"))


def _money(draw: Column, low: int, high: int) -> Column:
    return F.round(low + draw % ((high - low) * 100) / 100, 2)


def legacy_bank(spark: SparkSession, seed: int = 42, customers: int = 25, accounts: int = 2, transactions: int = 6) -> dict[str, DataFrame]:
    """The five tables, by name; accounts a customer, transactions an account."""
    i = F.col("i")
    draw = lambda what, *of: _draw(seed, what, *(of or (i,)))
    day = lambda what, start, days, *of: F.date_add(F.lit(start).cast("date"), (draw(what, *of) % days).cast("int")).cast("string")
    number = F.format_string("C%07d", i)
    people = spark.range(1, customers + 1).select(F.col("id").alias("i"))
    name = F.format_string("Customer %04d", i)
    rows = people.select(
        number.alias("customer_no"),
        F.when(i % 11 == 0, F.concat(F.lit("  "), name, F.lit("  "))).otherwise(name).alias("full_name"),
        F.when(i % 17 == 0, "31/02/1988").otherwise(day("dob", "1950-01-01", 18000)).alias("dob"),
        _one_of(("M", "F", "U"), draw("sex")).alias("sex"),
        _one_of(STATUSES, draw("status")).alias("status"),
        F.when(i % 13 == 0, "INVALID").otherwise(F.format_string("+1-555-%07d", 1_000_000 + draw("phone") % 9_000_000)).alias("phone"),
        _one_of(COUNTRIES, draw("country")).alias("country_code"),
        day("updated", "2020-01-01", 2200).alias("updated_at"),
        F.explode(F.sequence(F.lit(0), F.when(i % 23 == 0, 1).otherwise(0))).alias("copy"),
    ).drop("copy")
    a = F.col("a")
    owned = people.select(i, F.explode(F.sequence(F.lit(0), F.lit(accounts - 1))).alias("a"))
    account = F.format_string("A%07d%02d", i, a)
    held = owned.select(
        i, a, account.alias("acct_no"), number.alias("customer_ref"),
        _one_of(CURRENCIES, draw("currency", i, a)).alias("currency"), _one_of(STATUSES, draw("state", i, a)).alias("status"),
        _money(draw("opening", i, a), 100, 10000).alias("opening_balance"), _money(draw("credits", i, a), 0, 2000).alias("credits"),
        _money(draw("debits", i, a), 0, 2000).alias("debits"), _money(draw("adjustments", i, a), -10, 10).alias("adjustments"),
    ).withColumn("closing_balance", F.round(F.expr("opening_balance + credits - debits + adjustments"), 2))
    t = F.col("t")
    amount = _money(draw("amount", i, a, t), 1, 500)
    moved = held.select(i, a, "acct_no", "currency", F.explode(F.sequence(F.lit(0), F.lit(transactions - 1))).alias("t")).select(
        F.format_string("T%07d%02d%03d", i, a, t).alias("txn_id"), F.col("acct_no").alias("acct_ref"),
        F.when((t == 0) & (i % 19 == 0), -amount).otherwise(amount).cast("decimal(18,2)").cast("string").alias("amount"), "currency",
        _one_of(TYPES, draw("type", i, a, t)).alias("txn_type"), day("event", "2021-01-01", 1600, i, a, t).alias("event_date"),
        day("ingest", "2021-01-01", 1600, i, a, t).alias("ingest_date"),
    )
    stray = spark.createDataFrame([("T-ORPHAN", "A-MISSING", "10.00", "USD", "DEBIT", "2024-01-01", "2024-01-01")], moved.schema)
    paid = owned.select(
        F.format_string("B%07d%02d", i, a).alias("beneficiary_id"), account.alias("acct_ref"),
        F.format_string("Beneficiary %d-%d", i, a).alias("name"), _one_of(COUNTRIES[:3], draw("to", i, a)).alias("country_code"),
    )
    risky = people.where(i % 7 == 0).select(
        F.format_string("R%07d", i).alias("risk_id"), number.alias("customer_ref"),
        _one_of(("LOW", "MEDIUM", "HIGH"), draw("risk")).alias("risk_code"), day("risk day", "2021-01-01", 1600).alias("event_date"),
    )
    balance = F.col("closing_balance").cast("decimal(18,2)").cast("string").alias("acct_bal")
    return {
        "legacy_customers": rows,
        "legacy_accounts": held.select("acct_no", "customer_ref", balance, "currency", "status", "opening_balance", "credits", "debits", "adjustments", "closing_balance"),
        "legacy_transactions": moved.unionByName(stray),
        "legacy_beneficiaries": paid,
        "legacy_risk_events": risky,
    }


def counted_rows(spark: SparkSession, n: int) -> DataFrame:
    """Rows (id, amount = id mod 97) to measure with."""
    return spark.range(n).select("id", (F.col("id") % 97).alias("amount"))
