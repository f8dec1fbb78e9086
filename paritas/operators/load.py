"""Loading: idempotent upserts, batches in a given order, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.operators.reconcile import text_key


def last_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key (as text, a null key being None): the last by order, ties broken by the whole row. The last row is
    a maximum and combined on the map side, so a key that repeats without end is no large group."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.xxhash64(F.to_json(whole)).alias("tie"))
    return rows.groupBy(text_key(key).alias("_k")).agg(F.max_by(whole, rank).alias("_row")).select("_row.*")


def upsert(target: DataFrame, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The target with the batch's rows in place of those of the same key, and new ones added; loading twice changes
    nothing. Columns of either side that the other lacks are null there."""
    rows = last_wins(batch, key, order)
    keys = rows.select(text_key(key).alias("_k"))
    kept = target.join(keys, text_key(key) == F.col("_k"), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def batches(rows: DataFrame, order: list[str], size: int, parts: int = 64) -> DataFrame:
    """rows with batch: 0 for the first `size` rows in the order, and so on; ties keep any order among themselves.

    Numbers are counted in ranges of the order: a row's place in its range, and how many rows stand in ranges before.
    The ranges are those of one range partitioning, written once, so that both countings see the same rows.
    """
    from paritas.session import written

    ranged = written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "batches")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # at most `parts` rows
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = ranged.withColumn("_place", place).join(F.broadcast(offsets), "_part")
    return numbered.withColumn("batch", F.floor((F.col("_place") + F.col("_before")) / size)).drop("_part", "_place", "_before")


def latest_checkpoint(checkpoints: DataFrame, by: list[str] = ("migration_id", "table_name")) -> DataFrame:
    """The checkpoint appended last (append_no), not that of the greatest batch, of each table of a migration."""
    whole = F.struct(*checkpoints.columns)
    return checkpoints.groupBy(*by).agg(F.max_by(whole, "append_no").alias("c")).select("c.*")


def audit_balance(good: DataFrame, bad: DataFrame) -> DataFrame:
    """reason, rows: how many rows were loaded and why the others weren't."""
    return good.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("loaded").alias("reason"), "rows").unionByName(
        bad.groupBy(F.concat_ws(": ", "failed_field", F.split("failure_reason", ":")[0]).alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    )
