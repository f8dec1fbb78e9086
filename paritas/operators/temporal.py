"""Records with three times: when it happened, when it was recorded, when it was known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_of(records: DataFrame, cutoff: str) -> DataFrame:
    """Records known at the cutoff (ISO, UTC where no zone is given)."""
    return records.where(F.col("knowledge_time").cast("timestamp") <= F.lit(cutoff).cast("timestamp"))


def temporal_order(records: DataFrame) -> DataFrame:
    return records.orderBy("event_time", "data_time", "knowledge_time", "record_id")


def knowledge_delta(current: DataFrame, historical: DataFrame) -> DataFrame:
    """record_id, change (newly_known or not_yet_known) of distinct ids known on one side only."""
    now, then = current.select("record_id").distinct(), historical.select("record_id").distinct()
    new = now.subtract(then).select("record_id", F.lit("newly_known").alias("change"))
    return new.unionAll(then.subtract(now).select("record_id", F.lit("not_yet_known").alias("change")))


def known_counts(current: DataFrame, historical: DataFrame) -> DataFrame:
    """One row: known_count_then, known_count_now (distinct ids)."""
    count = lambda df, name: df.agg(F.count_distinct("record_id").alias(name))
    return count(historical, "known_count_then").crossJoin(count(current, "known_count_now"))
