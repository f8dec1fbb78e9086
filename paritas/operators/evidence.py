"""Evidence, its decay and conflicts, assumptions and what depends on them, and a chained ledger: all as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.hashing import canonical_json


def decayed(confidence: Column, since: Column, at: Column, half_life_days: float) -> Column:
    """Confidence halved every half-life since a moment, never by a moment in the future; 0 for no half-life."""
    if half_life_days <= 0:
        return F.lit(0.0)
    days = F.greatest(F.lit(0.0), (F.unix_micros(at) - F.unix_micros(since)) / 86_400e6)
    return confidence * F.pow(F.lit(0.5), days / half_life_days)


def refreshed(records: DataFrame, at: str, half_life_days: float = 30.0) -> DataFrame:
    """records (evidence_id, subject, confidence, created_at, last_verified_at, ...) with decayed_confidence."""
    since = F.coalesce("last_verified_at", "created_at")
    return records.withColumn("decayed_confidence", decayed(F.col("confidence"), since, F.lit(at).cast("timestamp"), half_life_days))


def by_confidence(records: DataFrame, at: str, half_life_days: float = 30.0) -> DataFrame:
    """refreshed records, the most trusted first; of equal ones the least evidence_id."""
    return refreshed(records, at, half_life_days).orderBy(F.col("decayed_confidence").desc_nulls_last(), "evidence_id")


def of_subjects(records: DataFrame, subjects: DataFrame) -> DataFrame:
    """The records of subjects (subject); those without a subject belong to none."""
    return records.join(subjects.select("subject").distinct(), "subject", "left_semi")


def verified(records: DataFrame, checks: DataFrame) -> DataFrame:
    """records after checks (evidence_id, verified_at, confidence): the latest check of a record sets last_verified_at and,
    if it has one, confidence (of checks at one moment the greatest). Unknown ids change nothing."""
    last = checks.groupBy("evidence_id").agg(F.max(F.struct("verified_at", "confidence")).alias("_check"))
    return records.join(last, "evidence_id", "left").withColumns(
        {"last_verified_at": F.coalesce("_check.verified_at", "last_verified_at"), "confidence": F.coalesce("_check.confidence", "confidence")}
    ).drop("_check")


def superseded(records: DataFrame, successors: DataFrame) -> DataFrame:
    """records with superseded_at, the first moment at which successors (evidence_id, at) replace them, else as it was."""
    first = successors.groupBy("evidence_id").agg(F.min("at").alias("_at"))
    had = F.col("superseded_at") if "superseded_at" in records.columns else F.lit(None).cast("timestamp")
    return records.join(first, "evidence_id", "left").withColumn("superseded_at", F.coalesce(had, "_at")).drop("_at")


def conflict(records: DataFrame, claims: DataFrame, resolution: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(conflict, records): the claims (evidence_id) that are known, as one row with unresolved, and the records with
    those claims CONTRADICTED; unknown ids are dropped."""
    known = claims.select("evidence_id").distinct().withColumn("claimed", F.lit(True))
    marked = records.join(known, "evidence_id", "left")
    status = F.when(F.col("claimed"), "CONTRADICTED").otherwise(F.col("status"))
    row = marked.where("claimed").agg(F.count(F.lit(1)).alias("claims")).select("claims", F.lit(resolution is None).alias("unresolved"), F.lit(resolution).cast("string").alias("resolution"))
    return row, marked.withColumn("status", status).drop("claimed")


CHAINED = ("action", "actor", "at", "entry_no", "evidence_hash", "migration_id", "new_state", "old_state", "previous_hash", "reason")


def entry_hash() -> Column:
    """Digest of an entry: everything but itself, time and number included."""
    return F.sha2(canonical_json(list(CHAINED)), 256)


def verify_chain(entries: DataFrame) -> DataFrame:
    """entry_no, fault of each break of the chain: an entry whose previous_hash isn't the entry_hash of the one before
    (of the first: the empty text), or whose entry_hash isn't that of its content. A ledger is one chain a migration."""
    order = Window.partitionBy("migration_id").orderBy("entry_no")
    before = F.coalesce(F.lag("entry_hash").over(order), F.lit(""))
    faults = F.array(
        F.when(~F.col("previous_hash").eqNullSafe(before), "previous hash mismatch"),
        F.when(~F.col("entry_hash").eqNullSafe(entry_hash()), "entry hash mismatch"),
    )
    found = entries.select("migration_id", "entry_no", faults.alias("faults"))
    return found.select("migration_id", "entry_no", F.explode(F.filter("faults", lambda x: x.isNotNull())).alias("fault"))


def chained(before: str, entry: dict, spark) -> DataFrame:
    """A new entry of a ledger (CHAINED without previous_hash, as texts) behind the one whose entry_hash is `before`."""
    fields = {**{c: None for c in CHAINED}, **entry, "previous_hash": before}
    schema = ", ".join(f"{c} {'long' if c == 'entry_no' else 'string'}" for c in CHAINED)
    return spark.createDataFrame([tuple(fields[c] for c in CHAINED)], schema).withColumn("entry_hash", entry_hash())


#: How much a check that holds adds to the confidence in an assumption.
GAIN = 0.05


def assumption_states(assumptions: DataFrame, events: DataFrame) -> DataFrame:
    """assumptions (assumption_id, confidence, status) after events (assumption_id, event_no, kind): with confidence and
    status as they are now.

    Each `validated` adds GAIN to the confidence, up to 1, and each `contradicted` takes all of it; the last of them gives
    the status (VALIDATED, INVALIDATED). So only what followed the last contradiction counts, and no event is replayed one
    by one. Other kinds and unknown ids change nothing. A confidence outside 0 to 1 is null.
    """
    told = events.where(F.col("kind").isin("validated", "contradicted"))
    fall = F.max(F.when(F.col("kind") == "contradicted", F.col("event_no"))).over(Window.partitionBy("assumption_id"))
    sums = (
        told.withColumn("_fall", fall)
        .groupBy("assumption_id")
        .agg(
            F.count(F.when((F.col("kind") == "validated") & (F.col("_fall").isNull() | (F.col("event_no") > F.col("_fall"))), 1)).alias("_gains"),
            F.max("_fall").alias("_fell"),
            F.max_by("kind", F.struct("event_no", "kind")).alias("_last"),
        )
    )
    start = F.when(F.col("_fell").isNotNull(), 0.0).when(F.col("confidence").between(0, 1), F.col("confidence"))
    status = F.when(F.col("_last") == "validated", "VALIDATED").when(F.col("_last") == "contradicted", "INVALIDATED").otherwise(F.col("status"))
    joined = assumptions.join(sums, "assumption_id", "left")
    return joined.withColumns({"confidence": F.when(start.isNotNull(), F.least(F.lit(1.0), start + GAIN * F.coalesce("_gains", F.lit(0)))), "status": status}).drop("_gains", "_fell", "_last")


def affected_results(states: DataFrame, dependents: DataFrame) -> DataFrame:
    """assumption_id, result_id, once each: the dependents (assumption_id, result_id) of assumptions that don't hold."""
    return dependents.join(states.where("status = 'INVALIDATED'").select("assumption_id"), "assumption_id", "left_semi").select("assumption_id", "result_id").distinct()
