"""Scores and gates over small inputs: risk and certification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the risk factors (fixed values).
WEIGHTS = {
    "schema_complexity": 0.15, "volume": 0.12, "pii_exposure": 0.16, "transformation_count": 0.10,
    "inferred_mapping_confidence": 0.15, "cdc_lag": 0.10, "reconciliation_failures": 0.14, "source_instability": 0.08,
}
#: A factor that lowers the risk, counted the other way round; where it isn't given, the risk is full.
INVERTED = "inferred_mapping_confidence"
BANDS = ((0.75, "CRITICAL"), (0.5, "HIGH"), (0.25, "MEDIUM"))


def risk(factors: DataFrame) -> DataFrame:
    """factors (subject, factor, value) -> subject, score, level, reasons (factors of 0.7 or more). Unknown factors count
    for nothing, those not given are 0; of repeated rows the greatest value stands."""
    given = factors.groupBy("subject").agg(
        *[F.coalesce(F.max(F.when(F.col("factor") == f, F.col("value"))), F.lit(0.0)).alias(f) for f in WEIGHTS]
    )
    shown = {f: 1 - F.col(f) if f == INVERTED else F.col(f) for f in WEIGHTS}
    score = sum((F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * WEIGHTS[f] for f, x in shown.items()), F.lit(0.0))
    level = F.lit("LOW")
    for bound, name in reversed(BANDS):
        level = F.when(F.col("raw") >= bound, name).otherwise(level)
    reasons = F.filter(F.array(*[F.when(x >= 0.7, f) for f, x in shown.items()]), lambda x: x.isNotNull())
    return given.select("subject", score.alias("raw"), reasons.alias("reasons")).select("subject", F.round("raw", 4).alias("score"), level.alias("level"), "reasons")


def certify(gates: DataFrame) -> DataFrame:
    """gates (migration_id, name, passed, required) -> migration_id, status: CERTIFIED when there is a required gate and
    all of them passed; a gate with a null result didn't."""
    required = F.col("required")
    ok = F.coalesce(F.bool_and(F.when(required, F.coalesce("passed", F.lit(False)))), F.lit(False))
    return gates.groupBy("migration_id").agg(F.when(ok, "CERTIFIED").otherwise("NOT_CERTIFIED").alias("status"))


def run_status(byte_equal: Column, semantic_equal: Column, invariants_hold: Column, counts_equal: Column) -> Column:
    """PASSED when all hold, else INCONCLUSIVE; null is no yes."""
    return F.when(byte_equal & semantic_equal & invariants_hold & counts_equal, "PASSED").otherwise("INCONCLUSIVE")
