"""Change events as a stream: deduplication, gaps and a state kept up to date.

Streams differ from the batch operators in one way: deduplication remembers an event_id for as long as the watermark
says, while the batch remembers all of them. Replay is exact all the same, since it is idempotent. No event is lost: those
that come too late to be told from repeats are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paritas.sources.sinks import committed, remove


def deduplicated_stream(events: DataFrame, time: str, within: str = "1 day") -> DataFrame:
    """The first of events with one event_id that arrive within the time; later ones than the watermark are dropped, so
    where they are wanted take deduplicate_to."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(["event_id"])


def deduplicate_to(events: DataFrame, path: str, checkpoint: str, time: str, within: str = "1 day", trigger: dict | None = None):
    """Starts a query that writes the first of events with one event_id to path/accepted, and events later than `within`
    before the newest one seen to path/quarantine, where they wait for a decision. Both have a folder for each
    micro-batch, which a batch that is run again replaces. An event without a time is never late. Only what was accepted
    since the watermark is read again, so the memory of ids is as long as that time."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = [f"{path}/accepted/batch-{n}" for n in committed(spark, f"{path}/accepted", "batch") if n < batch_id]
        before = spark.read.schema(batch.schema).parquet(*known) if known else batch.limit(0)
        mark = before.agg(F.max(time).cast("timestamp") - F.expr(f"interval {within}")).collect()[0][0]
        late = F.coalesce(F.col(time) < F.lit(mark), F.lit(False)) if mark is not None else F.lit(False)
        batch.where(late).write.mode("overwrite").parquet(f"{path}/quarantine/batch-{batch_id}")
        recent = (before.where(F.col(time).isNull() | (F.col(time) >= F.lit(mark))) if mark is not None else before).select("event_id")
        whole = F.struct(*batch.columns)
        first = batch.where(~late).join(recent, "event_id", "left_anti").groupBy("event_id").agg(F.min(whole).alias("e"))
        first.select("e.*").write.mode("overwrite").parquet(f"{path}/accepted/batch-{batch_id}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


STATE = "table_name string, primary_key string, sequence long, event_id string, row string"


def _last(changes: DataFrame) -> DataFrame:
    """The last change of each key; deletions stay, with a null row."""
    last = F.max(F.struct("sequence", "event_id", "row")).alias("x")
    return changes.groupBy("table_name", "primary_key").agg(last).select("table_name", "primary_key", "x.*")


def apply_changes(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts a query that keeps the table at `path` up to date with a stream of events (event_id, table_name,
    primary_key, operation, after, sequence).

    A micro-batch writes the last of its own changes of each key, no more, to a folder of its number; a batch that is run
    again overwrites its folder. Readers take the last change of a key over all folders, so late changes find their
    place and repeated ones change nothing. compact() folds the folders into one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sets = F.col("operation").isin("INSERT", "UPDATE")
        changes = batch.where((sets & F.col("after").isNotNull()) | (F.col("operation") == "DELETE")).select(
            "table_name", "primary_key", "sequence", "event_id", F.when(sets, F.col("after")).alias("row")
        )
        _last(changes).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _folders(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The folders that make the state, committed ones only, and the number of the last batch in them."""
    found = {kind: committed(spark, path, kind) for kind in ("base", "batch")}
    base = max(found["base"], default=-1)
    batches = [n for n in found["batch"] if n > base]
    return [f"{path}/base-{base}"] * (base >= 0) + [f"{path}/batch-{n}" for n in batches], max([base, *batches])


def state(spark: SparkSession, path: str) -> DataFrame:
    """The last change of each key (STATE) of a table kept by apply_changes."""
    folders, _ = _folders(spark, path)
    if not folders:
        return spark.createDataFrame([], STATE)
    return _last(spark.read.schema(STATE).parquet(*folders).select(*[x.split()[0] for x in STATE.split(", ")]))


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """table_name, primary_key, row of the rows alive."""
    return state(spark, path).where("row is not null").select("table_name", "primary_key", "row")


def compact(spark: SparkSession, path: str) -> None:
    """Folds all committed folders into one, then removes them. Readers see either; no query may write meanwhile."""
    folders, last = _folders(spark, path)
    if len(folders) > 1:
        state(spark, path).write.mode("overwrite").parquet(f"{path}/base-{last}")
        for folder in folders:
            if not folder.endswith(f"/base-{last}"):
                remove(spark, folder)


GAPS = "table_name string, first long, last long, state string"


def gap_stream(events: DataFrame) -> DataFrame:
    """table_name, first, last, state: `open` for each run of sequences that are missing once a later one came, `closed`
    when some of it arrives after all (rest of it is open again). A table's state is its open runs and last sequence, so it grows with what is missing."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, flat = state.get if state.exists else (None, [])
        runs = [(flat[i], flat[i + 1]) for i in range(0, len(flat), 2)]
        out = []
        for s in sorted({int(x) for b in batches for x in b["sequence"].dropna()}):
            if last is None or s == last + 1:
                last = s
            elif s > last:
                runs.append((last + 1, s - 1))
                out.append((key[0], last + 1, s - 1, "open"))
                last = s
            else:
                for run in [r for r in runs if r[0] <= s <= r[1]]:
                    runs.remove(run)
                    out.append((key[0], *run, "closed"))
                    for a, b in ((run[0], s - 1), (s + 1, run[1])):
                        if a <= b:
                            runs.append((a, b))
                            out.append((key[0], a, b, "open"))
        state.update((last, [x for r in sorted(runs) for x in r]))
        yield pd.DataFrame(out, columns=["table_name", "first", "last", "state"])

    return events.groupBy("table_name").applyInPandasWithState(
        follow, GAPS, "last long, runs array<long>", "append", GroupStateTimeout.NoTimeout
    )
