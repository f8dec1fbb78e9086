"""References to records that do not exist, or did not exist on the day of the reference.

The distinct (reference, day) pairs of the child table are anti-joined with the days on which each parent key existed;
what is left is joined back to the child rows. Pairs are made distinct on the map side, so a hot reference moves once
a day, and the joining back is salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of one (reference, day) pair when orphans are joined back to the child rows.
SALTS = 8

FOREVER = "9999-12-31"


def existence(parents: DataFrame, key: Column, first: Column, last: Column) -> DataFrame:
    """Disjoint day ranges on which each key existed: k, since, until. Rows without a key or first day count for
    nothing; a null last day is open; touching and overlapping stretches are merged. Of a key no more rows reach its
    group than there are first days."""
    spans = (
        parents.select(key.alias("k"), first.alias("since"), F.coalesce(last, F.to_date(F.lit(FOREVER))).alias("until"))
        .where(F.col("k").isNotNull() & F.col("since").isNotNull() & (F.col("until") >= F.col("since")))
        .groupBy("k", "since")
        .agg(F.max("until").alias("until"))
    )
    order = Window.partitionBy("k").orderBy("since")
    reach = F.max("until").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("reach").isNull() | (F.datediff("since", "reach") > 1), 1).otherwise(0)
    return (
        spans.withColumn("reach", reach)
        .withColumn("stretch", F.sum(opens).over(order))
        .groupBy("k", "stretch")
        .agg(F.min("since").alias("since"), F.max("until").alias("until"))
        .drop("stretch")
    )


def orphans(
    child: DataFrame,
    child_key: Column,
    reference: Column,
    on_day: Column,
    parents: DataFrame,
    parent_key: Column,
    first: Column,
    last: Column,
    salts: int = SALTS,
) -> DataFrame:
    """Child rows whose parent did not exist on the row's day: child_key, period (`YYYY-MM`), reason; equal rows once.

    reason: `missing` if no parent row has the key; else `deleted` if one was deleted before the day; else `late`.
    A null reference or a null day is no case; a null child key is reported as null. Empty parents: every reference is
    missing. Repeated parent rows make no difference. Only the given columns are read, whatever else the tables hold.
    """
    rows = child.select(child_key.alias("child_key"), reference.alias("k"), on_day.alias("day")).where(
        F.col("k").isNotNull() & F.col("day").isNotNull()
    )
    spans = existence(parents, parent_key, first, last)
    refs = rows.select("k", "day").distinct()
    lost = refs.join(
        spans, (refs["k"] == spans["k"]) & (refs["day"] >= spans["since"]) & (refs["day"] <= spans["until"]), "left_anti"
    )
    ends = (
        parents.select(parent_key.alias("k"), last.alias("gone"))
        .where(F.col("k").isNotNull())
        .groupBy("k")
        .agg(F.min("gone").alias("first_gone"), F.lit(True).alias("known"))
    )
    reason = (
        F.when(F.col("known").isNull(), "missing").when(F.col("first_gone") < F.col("day"), "deleted").otherwise("late")
    )
    salt = F.explode(F.array(*[F.lit(i) for i in range(salts)]))
    cases = lost.join(ends, "k", "left").select("k", "day", reason.alias("reason")).withColumn("salt", salt)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("child_key"), F.lit(salts)).cast("int"))
    return (
        salted.join(cases, ["k", "day", "salt"])
        .select("child_key", F.date_format("day", "yyyy-MM").alias("period"), "reason")
        .distinct()
    )


def orphan_counts(cases: DataFrame) -> DataFrame:
    """Cases per table and period: table_name, period, reason, n."""
    return cases.groupBy("table_name", "period", "reason").agg(F.count(F.lit(1)).alias("n"))
