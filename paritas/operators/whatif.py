"""What would be without a transaction, and what a state probably was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.operators.reconcile import key_and_row_hash


def remove_transaction(transactions: DataFrame, key: str, transaction_id, account: str = "account_id", amount: str = "amount") -> DataFrame:
    """One row for a removed transaction: removed, account, delta (minus its amount, 0 when that is no number), touched
    (how many other transactions share the account). No row when it isn't there; of repeated rows the least stands."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    is_it = text(key).eqNullSafe(F.lit(str(transaction_id)))
    removed = (
        transactions.where(is_it)
        .agg(F.min(F.struct(F.coalesce(text(account), F.lit("unknown")).alias("account"), F.coalesce(F.col(f"`{amount}`").try_cast("double"), F.lit(0.0)).alias("amount"))).alias("r"))
        .where("r is not null")
    )
    others = transactions.where(~is_it).select(F.coalesce(text(account), F.lit("unknown")).alias("account")).groupBy("account").agg(F.count(F.lit(1)).alias("touched"))
    return (
        F.broadcast(removed.select(F.lit(str(transaction_id)).alias("removed"), "r.account", (-F.col("r.amount")).alias("delta")))  # one row
        .join(others, "account", "left")
        .select("removed", "account", "delta", F.coalesce("touched", F.lit(0)).alias("touched"))
    )


def touched_transactions(transactions: DataFrame, key: str, transaction_id, account: str = "account_id") -> DataFrame:
    """k: the other transactions of the account of a removed one, which remove_transaction counts; none when it isn't there."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    is_it = text(key).eqNullSafe(F.lit(str(transaction_id)))
    of = F.coalesce(text(account), F.lit("unknown")).alias("account")
    one = transactions.where(is_it).agg(F.min(of).alias("account"))  # of repeated rows the least stands, as there
    return transactions.where(~is_it).select(text(key).alias("k"), of).join(F.broadcast(one), "account").select("k")


def fingerprints_without(transactions: DataFrame, key: str, transaction_id) -> DataFrame:
    """One row: before and after, the digests of all rows with and without a transaction; the same when it isn't there."""
    rest = transactions.where(~F.col(f"`{key}`").cast("string").eqNullSafe(F.lit(str(transaction_id))))
    one = lambda df, name: key_and_row_hash(df, key, df.columns).select(F.col("row_hash").alias(name))
    return one(transactions, "before").crossJoin(F.broadcast(one(rest, "after")))  # one row each


def reconstruct_state(snapshots: DataFrame, later: DataFrame | None = None, invariants: list[str] = ()) -> DataFrame:
    """entity, state (JSON text), confidence from snapshots (entity, position, state) and a later state if there is one.

    The later state, else the last snapshot, stands. confidence = 0.55 + 0.1 a snapshot - 0.15 an invariant the state
    lacks, within 0 and 1. An entity with a later state only has no snapshots to count.
    """
    latest = snapshots.groupBy("entity").agg(F.max_by("state", "position").alias("last"), F.count(F.lit(1)).alias("n"))
    if later is not None:
        latest = latest.join(later.groupBy("entity").agg(F.max("state").alias("later")), "entity", "full")
    else:
        latest = latest.withColumn("later", F.lit(None).cast("string"))
    state = F.coalesce("later", "last")
    lacking = sum((F.when(F.array_contains(F.json_object_keys(state), i), 0).otherwise(1) for i in invariants), F.lit(0))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 + 0.1 * F.coalesce("n", F.lit(0)) - 0.15 * lacking))
    return latest.select("entity", state.alias("state"), F.when(state.isNull(), 0.0).otherwise(confidence).alias("confidence"))
