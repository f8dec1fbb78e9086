"""Filling containers of fixed capacity with items of varying length.

Only the histogram of lengths is planned: best fit, longest first, over counts. The plan is a list of runs, each of which
places so many items of one length into a range of containers alike. Documents then find their slot by joining on their
rank within their length, which is counted in parts of about PART items, so that a common length is no single group.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paritas.session import written

CAPACITY = 4096
PART = 250_000

PLAN = "length int, first long, last long, container long, each long, start int"


def plan(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, last, container, each, start): the item of a length with rank r, first <= r < last, lies in
    container + (r - first) // each, at start + (r - first) % each * length.

    histogram: (length, count), lengths from 1 to capacity. Every item goes to the open container with the least room
    that holds it, longest items first; containers with equal room are handled together, so the work depends on the
    lengths, not on the counts.
    """
    rooms: list[int] = []  # sorted
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> ranges of containers (first, how many)
    runs, containers = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append((first, many))

    for length, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            left = count - rank
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, many = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
            else:
                room, first = capacity, containers
                many = -(-left // (capacity // length))
                containers += many
            each = room // length
            full = min(many, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                rank += full * each
            if full < many:
                rest = min(count - rank, each)
                if rest:
                    runs.append((length, rank, rank + rest, first + full, each, capacity - room))
                    put(room - rest * length, first + full, 1)
                    rank += rest
                    full += 1
                put(room, first + full, many - full)
    return runs


def pack(sizes: DataFrame, capacity: int = CAPACITY, part: int = PART) -> DataFrame:
    """sizes (doc_id, n_tokens) -> doc_id, piece_no, n_tokens, container_id, start_token.

    Every item lies whole in one container; only an item larger than the capacity is split, into pieces of the capacity
    and a rest, numbered from 0. Items of null, zero or negative size are left out. Repeated rows are items of their
    own; a null doc_id is kept. No containers come of no items. Other columns play no part. part: items of a length that are
    ranked together, which makes no difference to the containers' fill.
    """
    spark = sizes.sparkSession
    n = F.col("n_tokens").cast("long")
    items = (
        sizes.where(n > 0)
        .select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / capacity).cast("long"))).alias("piece_no"))
        .select("doc_id", F.col("piece_no").cast("int"), F.least(F.lit(capacity), F.col("n") - F.col("piece_no") * capacity).cast("int").alias("length"))
    )
    # The sizes are costly to count and read again; a written table of three numbers an item is not.
    items = written(items, "packing-items")
    # At most `capacity` lengths, whatever the corpus.
    histogram = [(r["length"], r["many"]) for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("many")).collect()]
    salts = spark.createDataFrame([(length, -(-many // part)) for length, many in histogram], "length int, salts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece_no"), F.col("salts")).alias("salt")
    items = items.join(F.broadcast(salts), "length").select("doc_id", "piece_no", "length", salt)
    parts = items.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("length", "salt", before.alias("before"))
    # About ten runs a length.
    runs = spark.createDataFrame(plan(histogram, capacity), PLAN)
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece_no")) - 1
    ranked = items.withColumn("rank", rank).join(offsets, ["length", "salt"])
    ranked = ranked.select("doc_id", "piece_no", "length", (F.col("rank") + F.col("before")).alias("rank"))
    at = F.col("rank") - F.col("first")
    return (
        ranked.join(F.broadcast(runs.withColumnRenamed("length", "l")), (F.col("length") == F.col("l")) & (at >= 0) & (F.col("rank") < F.col("last")))
        .select(
            "doc_id",
            "piece_no",
            F.col("length").alias("n_tokens"),
            (F.col("container") + F.floor(at / F.col("each"))).cast("long").alias("container_id"),
            (F.col("start") + at % F.col("each") * F.col("length")).cast("int").alias("start_token"),
        )
    )
