"""Applying a feed of inserts, updates and deletes: the state of a table as a signed multiset.

Every change takes away the version it says it found (multiplicity -1, its before-image) and adds the version it leaves
(multiplicity +1, its after-image; of a deletion the absence of the row, a version like any other). Versions are summed
with those of the base by key and image, and the one with a positive sum is the state.

Before-images may be absent or stale. Where the recorded one isn't what the change before left, the sum gets a
correcting pair: what was taken away wrongly comes back, and what stood there is taken away instead.

A run of changes is itself a change, with the before-image of its first and the after-image of its last. So a key's
changes are summed within blocks of sequence numbers first, then over the blocks, and a key with a third of all changes
is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.text import BLANKS

#: Sequence numbers in a block.
BLOCK = 1 << 16

KEY = ["table_name", "primary_key"]


def deduplicated_changes(events: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each event_id, at the lowest sequence it carries: event_id, sequence, columns.

    Where copies of one event differ in another column, the least values among the copies of the lowest sequence
    stand. Rows with a null event_id are one change together, like any other repeated id. A null sequence sorts first.
    """
    rest = [c for c in columns if c not in ("event_id", "sequence")]
    packed = F.min(F.struct("sequence", *rest)).alias("e")
    return events.groupBy("event_id").agg(packed).select("event_id", "e.sequence", *[F.col(f"e.{c}") for c in rest])


def _absent() -> Column:
    """The version of a row that isn't there: no digest is empty."""
    return F.unhex(F.lit(""))


def image(text: Column) -> Column:
    """What stands for an image in the sums, where only equality counts: the digest of its text, 32 bytes; null stays null."""
    return F.unhex(F.sha2(text, 256))


def _summed(changes: DataFrame, by: list[str]) -> DataFrame:
    """Changes (by, fed, sequence, event_id, before, after) to one change for each group: the version with a positive sum,
    with the event that left it, and the before-image of the group's first change."""
    order = Window.partitionBy(*by).orderBy("fed", "sequence", "event_id")
    at = F.struct("fed", "sequence", "event_id")
    found, stood = F.coalesce("before", _absent()), F.col("stood.after")
    signed = lambda m, version, own=False: F.struct(F.lit(m).alias("m"), version.alias("version"), F.when(F.lit(own), at).alias("at"))
    # What a group's first change took away is told apart where groups are summed together.
    later, wrong = F.col("stood").isNotNull(), F.col("stood").isNotNull() & (found != stood)
    rows = F.array(signed(1, F.col("after"), True), F.when(later, signed(-1, found)), F.when(wrong, signed(1, found)), F.when(wrong, signed(-1, stood)))
    return (
        changes.withColumn("stood", F.lag(F.struct("after")).over(order))
        .withColumn("opening", F.first("before").over(order))
        .select(*by, "opening", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("s"))
        # All signed rows of a group lie where the window put them, so the sum needs no further exchange.
        .groupBy(*by, "s.version")
        .agg(F.sum("s.m").alias("m"), F.max("s.at").alias("at"), F.first("opening").alias("before"))
        .where("m > 0")
        .select(*by, "at.fed", "at.sequence", "at.event_id", "before", F.col("version").alias("after"))
    )


def current_state(events: DataFrame, base: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """The rows alive after all changes: table_name, primary_key, event_id of the change that made the present state.

    events has event_id, table_name, primary_key, operation, before_image, after_image, sequence. Changes apply by
    sequence, then event_id as text. operation is read trimmed and in upper case; INSERT and UPDATE set the row, and are
    ignored when after_image is null; DELETE removes it; any other operation, null included, is ignored. Keys are exact; a
    null table_name or primary_key is a key of its own. Repeated and out-of-order rows make no difference, nor do absent
    or stale before-images. Extra columns play no part. An empty feed yields no rows but those of the base.

    base: the rows alive before the feed (table_name, primary_key, event_id of the change that made them and, if at hand,
    after_image, the row itself), each +1 below every sequence, a null one too. An event_id of the base may come again in the feed,
    where it is a change of its own. Of several base rows with a key, the one of the greatest event_id stands.

    block: sequence numbers that are summed together first; it makes no difference to the result. The changes of a key
    within a block are one group, so numbers far apart want wide blocks.
    """
    shaped = events.select(
        "event_id",
        F.col("sequence").cast("long").alias("sequence"),
        *KEY,
        F.upper(F.btrim("operation", F.lit(BLANKS))).alias("op"),
        image(F.col("after_image")).alias("after"),
        image(F.col("before_image")).alias("before"),
    )
    sets = F.col("op").isin("INSERT", "UPDATE")
    changes = (
        deduplicated_changes(shaped, [*KEY, "op", "after", "before"])
        .where((sets & F.col("after").isNotNull()) | (F.col("op") == "DELETE"))
        .select(*KEY, F.lit(1).alias("fed"), "sequence", "event_id", "before", F.when(sets, F.col("after")).otherwise(_absent()).alias("after"))
    )
    if base is not None:
        none = lambda kind, name: F.lit(None).cast(kind).alias(name)
        unknown = F.unhex(F.lit("00"))
        stands = F.coalesce(image(F.col("after_image")), unknown) if "after_image" in base.columns else unknown
        changes = changes.unionByName(base.select(*KEY, F.lit(0).alias("fed"), none("long", "sequence"), "event_id", none("binary", "before"), stands.alias("after")))
    blocks = changes.withColumn("block", F.floor(F.col("sequence") / block))
    return _summed(_summed(blocks, [*KEY, "block"]).drop("block"), KEY).where(F.col("after") != _absent()).select(*KEY, "event_id")
