"""The legacy bank's tables in the shape of the modern one: every row is kept, repeated and orphan rows too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions.semantic import strip
from paritas.functions.text import normalize_status

#: New names of columns, by table (fixed values).
RENAMED = {
    "customers": {"customer_no": "customer_id", "full_name": "full_name", "dob": "date_of_birth", "status": "status", "phone": "phone", "country_code": "country_code"},
    "accounts": {"acct_no": "account_id", "customer_ref": "customer_id", "acct_bal": "balance", "currency": "currency", "status": "status", "opening_balance": "opening_balance", "credits": "credits", "debits": "debits", "adjustments": "adjustments", "closing_balance": "closing_balance"},
    "transactions": {"txn_id": "transaction_id", "acct_ref": "account_id", "amount": "amount", "currency": "currency", "txn_type": "type", "event_date": "event_time", "ingest_date": "ingestion_time"},
    "beneficiaries": {"beneficiary_id": "beneficiary_id", "acct_ref": "account_id", "name": "name", "country_code": "country_code"},
    "risk_events": {"risk_id": "risk_event_id", "customer_ref": "customer_id", "risk_code": "risk_code", "event_date": "event_time"},
}


def modernize(df: DataFrame, table: str) -> DataFrame:
    """A legacy table as the modern `table`: renamed, customers' names trimmed, statuses normalised."""
    shaped = {"full_name": strip, "status": normalize_status}
    return df.select(*[shaped.get(old, lambda c: c)(F.col(old)).alias(new) for old, new in RENAMED[table].items()])
