"""Change events: making, reading, deduplicating, finding gaps and replaying.

Events have event_id, source_position, table_name, primary_key, operation, before, after (JSON text), timestamp,
schema_version, sequence. Everything is kept per table; legacy=True gives the older reading that ignores tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.hashing import canonical_json
from paritas.operators.changes import deduplicated_changes

OPERATIONS = ("INSERT", "UPDATE", "DELETE")
EVENT = (
    "event_id string, source_position string, table_name string, primary_key string, operation string, before string, "
    "after string, timestamp string, schema_version string, sequence long"
)
#: Sequences in one range when gaps are sought.
RANGE = 1 << 20


def event_id(df: DataFrame) -> Column:
    """Digest of after, operation, primary_key, sequence and table_name; before and timestamp play no part."""
    return F.sha2(canonical_json(["after", "operation", "primary_key", "sequence", "table_name"]), 256)


def make_events(df: DataFrame) -> DataFrame:
    """df (table_name, primary_key, operation, before, after, sequence[, timestamp, schema_version]) as events."""
    given = set(df.columns)
    out = df.withColumn("event_id", event_id(df)).withColumn("source_position", F.col("sequence").cast("string"))
    for name, default in (("timestamp", ""), ("schema_version", "v1"), ("before", None), ("after", None)):
        if name not in given:
            out = out.withColumn(name, F.lit(default).cast("string"))
    return out.select(*[x.strip().split()[0] for x in EVENT.split(",")])


def normalize_events(raw: DataFrame, strict: bool = True) -> DataFrame:
    """Typed events of a table of texts or of JSON records in a column `json`. An operation that is none of OPERATIONS
    fails the job, or with strict=False the event is left out."""
    if raw.columns == ["json"]:
        raw = raw.select(F.from_json("json", EVENT.replace("table_name", "`table`")).alias("e")).select("e.*").withColumnRenamed("table", "table_name")
    types = dict(x.strip().split() for x in EVENT.split(","))
    out = raw.select(*[F.col(c).try_cast(t).alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()])
    known = F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False))
    if strict:
        return out.withColumn("operation", F.when(known, F.col("operation")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce("operation", F.lit("null"))))))
    return out.where(known)


def deduplicate(events: DataFrame) -> DataFrame:
    """The first event, by sequence, of each event_id."""
    return deduplicated_changes(events, events.columns).select(*events.columns)


def after_offset(events: DataFrame, sequence: int) -> DataFrame:
    return events.where(F.col("sequence") > sequence)


def gaps(events: DataFrame, legacy: bool = False, width: int = RANGE) -> DataFrame:
    """table_name, first, last of each run of sequences missing between two that are there (legacy: over all tables).

    Distinct sequences are looked at in ranges of `width`; gaps within ranges come from lead in the range, gaps between
    from the ranges' own ends, so no single group has all sequences of a table.
    """
    table = F.lit("*") if legacy else F.col("table_name")
    seen = events.where("sequence is not null").select(table.alias("table_name"), "sequence").distinct()
    ranged = seen.withColumn("range", F.floor(F.col("sequence") / width))
    inner = Window.partitionBy("table_name", "range").orderBy("sequence")
    within = ranged.withColumn("next", F.lead("sequence").over(inner)).where("next > sequence + 1").select("table_name", "sequence", "next")
    ends = ranged.groupBy("table_name", "range").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"))
    outer = Window.partitionBy("table_name").orderBy("range")
    between = ends.withColumn("next", F.lead("lo").over(outer)).where("next > hi + 1").select("table_name", F.col("hi").alias("sequence"), "next")
    return within.unionByName(between).select("table_name", (F.col("sequence") + 1).alias("first"), (F.col("next") - 1).alias("last"))


def lag(captured: Column, applied: Column) -> Column:
    """How many changes the applied sequence is behind."""
    return F.greatest(F.lit(0), captured - applied)


def replay(initial: DataFrame | None, events: DataFrame, strict: bool = True, legacy: bool = False) -> DataFrame:
    """The state after the events: table_name, primary_key, row (JSON text). initial has the same columns.

    The last change of a key by (sequence, event_id) stands; INSERT and UPDATE replace the whole row, DELETE removes it.
    A set without an after image fails the job, or with strict=False is skipped. Replaying twice changes nothing. The
    last change is a maximum, which is combined on the map side, so a hot key is no large group.
    """
    key = ["primary_key"] if legacy else ["table_name", "primary_key"]
    sets = F.col("operation").isin("INSERT", "UPDATE")
    first = deduplicate(events)
    if strict:
        first = first.withColumn("after", F.when(sets & F.col("after").isNull(), F.raise_error(F.concat(F.lit("no after image in "), "event_id"))).otherwise(F.col("after")))
    else:
        first = first.where(~sets | F.col("after").isNotNull())
    changes = first.select(*key, F.lit(1).alias("later"), "sequence", "event_id", F.when(sets, F.col("after")).alias("row"))
    if initial is not None:
        base = initial.select(*key, F.lit(0).alias("later"), F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("string").alias("event_id"), "row")
        changes = changes.unionByName(base)
    last = F.max(F.struct("later", "sequence", "event_id", "row")).alias("last")
    return changes.groupBy(*key).agg(last).where("last.row is not null").select(*key, "last.row")
