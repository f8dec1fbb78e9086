"""Differences between two copies of a table, key by key and field by field.

Both copies are brought into one canonical shape, one row a key and side, and range-partitioned together, so that they
share their split points; within a partition the rows are sorted by key and side, and one pass merges the two sorted runs:
a row meets the row of the other side that stands at the same key, or none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.text import amount, key_form, normalize_status, unparsed


@dataclass(frozen=True)
class Field:
    """A compared field: its name in the report, its column in either copy, and how it compares: `key` (trimmed, upper
    case), `status` (normalised spelling, null is UNKNOWN), `amount` (differs by `tolerance` or more) or `exact`."""

    name: str
    left: str
    right: str
    kind: str = "exact"


def _canonical(df: DataFrame, key: str, columns: list[tuple[Field, str]], side: int) -> DataFrame:
    types = dict(df.dtypes)
    picked: list[Column] = [key_form(F.col(f"`{key}`")).alias("k"), F.lit(side).cast("byte").alias("side")]
    for i, (field, column) in enumerate(columns):
        c, is_text = F.col(f"`{column}`"), types[column] == "string"
        if field.kind == "amount":
            picked += [amount(c, is_text).alias(f"v{i}"), unparsed(c, is_text).alias(f"u{i}")]
        else:
            shaped = {"key": key_form, "status": normalize_status}.get(field.kind, lambda x: x.cast("string"))(c)
            picked.append(shaped.alias(f"v{i}"))
    return df.select(*picked).where(F.col("k").isNotNull())


def differences(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    fields: list[Field],
    missing_right: str = "missing_in_right",
    missing_left: str = "missing_in_left",
    tolerance: str = "0.005",
) -> DataFrame:
    """(account-like) rows of two copies compared: columns `key`, `finding`.

    A finding is `missing_right` (a key only on the left), `missing_left`, or the name of a field that differs.

    Nulls: rows whose key is null or blank are ignored; a null field equals null and differs from any value, 0
    included; for `status` null is UNKNOWN. A value that is present but is no amount equals only the same text.
    Repeated rows of a key on one side count once; where they disagree, the least row in column order stands for the
    key. Empty copies: every key of the other one is missing. Extra columns, whatever their names, play no part.
    """
    both = _canonical(left, left_key, [(f, f.left) for f in fields], 0).unionByName(
        _canonical(right, right_key, [(f, f.right) for f in fields], 1)
    )
    values = [c for c in both.columns if c not in ("k", "side")]
    # The least row of a key is found on the map side first, so a key that holds a third of the rows, equal or not, is a
    # row a task before it moves, and two rows at most where ranges are cut. The window below needs no further exchange.
    runs = (
        both.groupBy("k", "side")
        .agg(F.min(F.struct(*values)).alias("row"))
        .repartitionByRange("k")
        .sortWithinPartitions("k", "side")
    )
    walk = Window.partitionBy("k").orderBy("side")
    merged = runs.withColumn("other", F.lead(F.struct("side", "row")).over(walk)).withColumn(
        "before", F.lag("side").over(walk)
    )
    found = [
        F.when((F.col("side") == 0) & F.col("other").isNull(), F.lit(missing_right)),
        F.when((F.col("side") == 1) & F.col("before").isNull(), F.lit(missing_left)),
    ]
    for i, field in enumerate(fields):
        a, b = F.col(f"row.v{i}"), F.col(f"other.row.v{i}")
        if field.kind == "amount":
            apart = F.abs(a - b) >= F.lit(tolerance).cast("decimal(30,6)")
            same = F.when(a.isNotNull() & b.isNotNull(), ~apart).otherwise(
                a.eqNullSafe(b) & F.col(f"row.u{i}").eqNullSafe(F.col(f"other.row.u{i}"))
            )
        else:
            same = a.eqNullSafe(b)
        found.append(F.when(F.col("other").isNotNull() & ~same, F.lit(field.name)))
    findings = F.filter(F.array(*found), lambda x: x.isNotNull())
    return merged.select(F.col("k").alias("key"), F.explode(findings).alias("finding"))
