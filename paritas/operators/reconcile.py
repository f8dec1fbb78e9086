"""Reconciliation of a source with a target: keys, rows, aggregates, quantiles, references, invariants and a verdict.

Keys compare as text and a null key is the text None, so rows without a key meet each other; the report counts them.
One full outer join over one row a key gives missing, unexpected and differing keys in a single pass; each side is
brought to one row a key with map-side combining first. All rows are compared unless a sample is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.functions.hashing import bucket, merkle_root, row_fingerprint, sha256_text, strip_system
from paritas.operators.orphans import SALTS
from paritas.session import written

STATS = ("sum", "min", "max", "avg")
_STAT = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}
QUANTILES = (0.5, 0.95, 0.99)
#: Levels of a Merkle tree that are folded at once, and the leaves below them.
HEIGHT = 12
LEAVES = 1 << HEIGHT


def text_key(key: str) -> Column:
    return F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("None"))


def keyed(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """One row a key: k, n (rows with the key) and h (the digest of its row; of rows that differ, the least digest)."""
    plain = strip_system(df)
    h = row_fingerprint(columns or plain.columns)
    return plain.select(text_key(key).alias("k"), h.alias("h")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("h"))


def compare_keys(source: DataFrame, target: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """k, finding for each key that isn't the same on both sides: missing (not in the target), unexpected (not in the
    source), mismatch (rows differ), duplicate (several rows on a side, in addition)."""
    a, b = keyed(source, key, columns), keyed(target, key, columns)
    joined = a.withColumnsRenamed({"n": "n1", "h": "h1"}).join(b.withColumnsRenamed({"n": "n2", "h": "h2"}), "k", "full")
    findings = F.array(
        F.when(F.col("n2").isNull(), "missing"),
        F.when(F.col("n1").isNull(), "unexpected"),
        F.when(F.col("h1") != F.col("h2"), "mismatch"),
        F.when((F.col("n1") > 1) | (F.col("n2") > 1), "duplicate"),
    )
    return joined.select("k", F.explode(F.filter(findings, lambda x: x.isNotNull())).alias("finding"))


def sampled_keys(keys: DataFrame, size: int = 25, seed: int = 42) -> DataFrame:
    """A sample of keys by a seeded hash: the same keys in every run."""
    return keys.orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(size)


def _number(column: str) -> Column:
    return F.col(f"`{column}`").try_cast("double")


def aggregates(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: n and `field.stat` of each numeric field over its parsable values; null when there are none."""
    return df.agg(
        F.count(F.lit(1)).alias("n"), *[_STAT[s](_number(f)).alias(f"{f}.{s}") for f in fields for s in STATS]
    )


def _deltas(source: DataFrame, target: DataFrame, names: list[str], nought: bool) -> DataFrame:
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias(name)) for n in names])).alias("x")).select("x.*")

    both = long(source, "source_value").join(long(target, "target_value"), "name")
    other = F.coalesce("target_value", F.lit(0.0)) if nought else F.col("target_value")
    return both.where(F.col("source_value").isNotNull() & other.isNotNull()).withColumn("delta", other - F.col("source_value"))


def aggregate_deltas(source: DataFrame, target: DataFrame, fields: list[str]) -> DataFrame:
    """name, source_value, target_value, delta of each aggregate the source has; a missing target counts as 0."""
    return _deltas(aggregates(source, fields), aggregates(target, fields), [f"{f}.{s}" for f in fields for s in STATS], True)


def placed(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, before, total: each distinct non-null value of a group, how many rows have it, how many of the group
    have a smaller one, and how many there are in all. Values are counted on the map side and range-partitioned with
    their group, so a group of any size is dealt out; places are counted in partitions and offset by those before."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    # Written once, so that the numbers of partitions mean the same to both readings.
    ranged = written(counted.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()), "placed")
    parts = ranged.groupBy(*by, "part").agg(F.sum("n").alias("many"))
    group = Window.partitionBy(*by)
    offsets = parts.select(
        *by, "part",
        F.coalesce(F.sum("many").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("many").over(group).alias("total"),
    )
    running = F.sum("n").over(Window.partitionBy(*by, "part").orderBy(value)) - F.col("n")
    keys = [*by, "part"]
    return ranged.withColumn("running", running).join(offsets, keys).select(*by, value, "n", (F.col("running") + F.col("offset")).alias("before"), "total")


def _quantiles(df: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    numbers = df.select(*by, *[_number(f).alias(f) for f in fields]).unpivot(by, list(fields), "field", "v")
    stats = placed(numbers, [*by, "field"], "v")
    out = []
    for f in fields:
        for q in QUANTILES:
            at = (F.col("total") - 1) * F.lit(q)
            here = lambda p: F.max(F.when((F.col("field") == f) & (F.col("before") <= p) & (p < F.col("before") + F.col("n")), F.col("v")))  # noqa: B023, E731
            part = F.max(F.when(F.col("field") == f, at - F.floor(at)))
            lo, hi = here(F.floor(at)), here(F.ceil(at))
            out.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * part).alias(f"{f}.p{round(q * 100)}"))
    return stats.groupBy(*by).agg(*out)


def quantiles(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: `field.p50`, `.p95`, `.p99`, exact with linear interpolation; null for a field without numbers."""
    return _quantiles(df, list(fields), [])


def quantile_deltas(source: DataFrame, target: DataFrame, fields: list[str]) -> DataFrame:
    """name, source_value, target_value, delta of each quantile both sides have; both are read in one pass."""
    side = lambda df, name: df.select(F.lit(name).alias("_side"), *[F.col(f"`{f}`") for f in fields])
    both = written(_quantiles(side(source, "s").unionByName(side(target, "t")), list(fields), ["_side"]), "quantiles")  # two rows
    names = [f"{f}.p{round(q * 100)}" for f in fields for q in QUANTILES]
    return _deltas(both.where("_side = 's'"), both.where("_side = 't'"), names, False)


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """k, n of keys with several rows."""
    return df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def integrity_debt(df: DataFrame, key: Column) -> DataFrame:
    """One row: repeated_keys and rows_beyond, the rows that a load which keeps one a key collapses. A null key is a key."""
    n = F.col("n")
    found = duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("repeated_keys"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("rows_beyond"))
    return found.select("repeated_keys", "rows_beyond")


def referential_errors(child: DataFrame, key: Column, reference: Column, parents: DataFrame, parent_key: Column) -> DataFrame:
    """child_key, reference of child rows whose non-null reference, as text, is no parent key. The distinct references
    are anti-joined and joined back salted, so a hot reference is no single task."""
    rows = child.select(key.alias("child_key"), reference.cast("string").alias("reference")).where("reference is not null")
    known = parents.select(parent_key.cast("string").alias("reference")).distinct()
    lost = rows.select("reference").distinct().join(known, "reference", "left_anti")
    lost = lost.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("child_key"), F.lit(SALTS)).cast("int"))
    return salted.join(lost, ["reference", "salt"]).select("child_key", "reference")


BALANCE = ("opening_balance", "credits", "debits", "adjustments", "closing_balance")


def _balance(absolute: float, relative: float) -> tuple[Column, Column, Column]:
    """expected, actual and reason of the balance of a row; no reason where it holds."""
    o, c, d, a, closing = (_number(x) for x in BALANCE)
    expected = o + c - d + a
    bound = F.greatest(F.lit(absolute), relative * F.greatest(F.abs(expected), F.abs(closing)))
    apart = F.abs(expected - closing) > bound
    return expected, closing, F.when(expected.isNull() | closing.isNull(), "non-numeric balance fields").when(apart, "balance invariant")


def invariant_failures(df: DataFrame, key: str, absolute: float = 1e-4, relative: float = 1e-9) -> DataFrame:
    """key, expected, actual, reason of rows whose closing balance isn't opening + credits - debits + adjustments, within
    the larger of an absolute and a relative tolerance (relative=0: the absolute alone); a value that is no number is a
    failure of its own. Rows of tables that lack one of the five columns have none."""
    if not set(BALANCE) <= set(df.columns):
        return df.sparkSession.createDataFrame([], "k string, expected double, actual double, reason string")
    expected, actual, reason = _balance(absolute, relative)
    shaped = df.select(text_key(key).alias("k"), expected.alias("expected"), actual.alias("actual"), reason.alias("reason"))
    return shaped.where("reason is not null")


def key_and_row_hash(df: DataFrame, key: str, columns: list[str], buckets: int = 1) -> DataFrame:
    """One row: n, key_hash (over keys alone, so changed values leave it) and row_hash (over whole rows), both roots of
    the Merkle buckets below, so that no list of all rows is ever gathered."""
    plain = strip_system(df)
    keys = merkle_buckets(plain.select(F.col(f"`{key}`")), key, [key], buckets).agg(_root().alias("key_hash"))
    rows = merkle_buckets(plain, key, columns, buckets).agg(_root().alias("row_hash"), F.sum("n").alias("n"))
    return keys.crossJoin(F.broadcast(rows)).select("n", "key_hash", "row_hash")  # one row each


def _root() -> Column:
    """The root over bucket roots (at most one a bucket), in the order of bucket numbers as text."""
    listed = F.array_sort(F.collect_list(F.struct(F.col("bucket").cast("string").alias("b"), "root")))
    return merkle_root(F.transform(listed, lambda x: x["root"]))


def merkle_buckets(df: DataFrame, key: str, columns: list[str], buckets: int = 16, parts: int | None = None) -> DataFrame:
    """bucket, n, root for each of the buckets by digest of the key, empty ones included.

    Leaves are row digests in the order of key and digest; rows that are wholly equal are one leaf with their number.
    The root is that of all leaves of the bucket in one tree, at any size. Leaves are range-partitioned and written, so
    that each has its place, and the tree is folded in blocks of LEAVES neighbours, so no gathered list grows with the
    data, however often a key repeats. parts: how many range partitions, which makes no difference to the roots.
    """
    plain = strip_system(df)
    leaves = (
        plain.select(text_key(key).alias("k"), row_fingerprint(columns).alias("h"))
        .groupBy("k", "h")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            bucket(F.col("k"), buckets).alias("bucket"),
            "k",
            # Bytes are half of what hex digits are, and have the same order.
            F.unhex(F.when(F.col("n") == 1, F.col("h")).otherwise(sha256_text(F.concat("h", F.lit("*"), "n")))).alias("h"),
            "n",
        )
    )
    folded = _folded(*_places(leaves, parts))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(folded, "bucket", "left").select(
        "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.lower(F.hex("h")), sha256_text(F.lit(""))).alias("root")
    )


def _places(leaves: DataFrame, parts: int | None = None) -> tuple[DataFrame, int]:
    """The leaves with at, the place in the bucket from 0 by k and h, and size, the leaves of the bucket; and the largest
    size. Places are counted in range partitions and offset by those before."""
    order = ["bucket", "k", "h"]
    ranged = leaves.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    # Written once, so that the numbers mean the same to both readings: the partition in the upper bits, then the row.
    numbered = written(ranged.select("bucket", "h", "n", F.monotonically_increasing_id().alias("id")), "leaves")
    part = F.shiftright("id", 33).alias("part")
    runs = numbered.groupBy("bucket", part).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("many"))
    of = Window.partitionBy("bucket")
    before = F.coalesce(F.sum("many").over(of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = runs.select("bucket", "part", (before - F.col("first")).alias("offset"), F.sum("many").over(of).alias("size"))
    largest = offsets.agg(F.max("size")).collect()[0][0] or 0
    # At most as many rows as there are buckets and partitions together, as each partition is a range.
    placed_ = numbered.withColumn("part", part).join(F.broadcast(offsets), ["bucket", "part"])
    return placed_.select("bucket", "h", "n", (F.col("id") + F.col("offset")).alias("at"), "size"), largest


def _folded(nodes: DataFrame, largest: int, height: int = HEIGHT) -> DataFrame:
    """bucket, n, h: the roots of nodes (bucket, h, n, at, size) of which the largest bucket has so many. A round folds
    blocks of 2**height neighbours to a node each; in a bucket of several blocks all of them by `height` levels, so the
    root is that of one fold over the whole bucket."""
    block = 1 << height
    while True:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: F.lower(F.hex(x["h"])))
        root = F.unhex(merkle_root(listed, F.when(F.col("size") > block, height)))
        nodes = (
            nodes.groupBy("bucket", "size", F.shiftright("at", height).alias("place"))
            .agg(F.sum("n").alias("n"), root.alias("h"))
            .select("bucket", "h", "n", F.col("place").alias("at"), F.ceil(F.col("size") / block).alias("size"))
        )
        if largest <= block:
            return nodes.select("bucket", "n", "h")
        largest = -(-largest // block)


def differing_buckets(source: DataFrame, target: DataFrame, key: str, columns: list[str], buckets: int = 16) -> DataFrame:
    """bucket, source_root, target_root of buckets whose roots differ."""
    a = merkle_buckets(source, key, columns, buckets).select("bucket", F.col("root").alias("source_root"))
    b = merkle_buckets(target, key, columns, buckets).select("bucket", F.col("root").alias("target_root"))
    return a.join(b, "bucket").where("source_root <> target_root")


def rows_of_differing_buckets(source: DataFrame, target: DataFrame, key: str, columns: list[str], buckets: int = 16) -> DataFrame:
    """compare_keys over the rows of differing buckets only: k, finding."""
    differing = differing_buckets(source, target, key, columns, buckets).select("bucket")
    # At most `buckets` rows.
    cut = lambda df: df.withColumn("bucket", bucket(F.col(f"`{key}`"), buckets)).join(F.broadcast(differing), "bucket").drop("bucket")
    return compare_keys(cut(source), cut(target), key, columns)


@dataclass(frozen=True)
class Reference:
    """A reference of the target to check: its column, and the parents with their key."""

    column: str
    parents: DataFrame
    key: str


def reconcile(
    source: DataFrame,
    target: DataFrame,
    key: str,
    numeric_fields: list[str] = (),
    references: list[Reference] = (),
    columns: list[str] | None = None,
    sample_size: int | None = None,
    max_delta: float = 1e-4,
) -> DataFrame:
    """The report, one row: source_count, target_count, missing, unexpected, duplicates, mismatches, null_keys,
    referential_errors, invariant_errors, deltas (of aggregates, by name), earliest (the first missing key, else the
    first that differs) and passed.

    passed: nothing missing, unexpected, duplicate, different, unreferenced or off balance, and no delta of an aggregate
    above max_delta (a NaN delta fails). sample_size: rows of so many common keys are compared instead of all.
    """
    found = compare_keys(source, target, key, columns)
    if sample_size is not None:
        common = keyed(source, key).select("k").join(keyed(target, key).select("k"), "k", "left_semi")
        found = found.where("finding <> 'mismatch'").unionByName(
            found.where("finding = 'mismatch'").join(F.broadcast(sampled_keys(common, sample_size)), "k", "left_semi")
        )
    n = lambda what: F.count(F.when(F.col("finding") == what, 1)).alias(what)
    least = lambda what: F.min(F.when(F.col("finding") == what, F.col("k")))
    keys = found.agg(n("missing"), n("unexpected"), n("duplicate"), n("mismatch"), F.coalesce(least("missing"), least("mismatch")).alias("earliest"))
    # One pass a side gives its counts, statistics and broken invariants; what is compared are two rows.
    counts, names = F.count(F.lit(1)), [(f, x) for f in numeric_fields for x in STATS]
    stats = lambda side: [_STAT[x](_number(f)).alias(f"{side}{i}") for i, (f, x) in enumerate(names)]
    nulls = F.count(F.when(F.col(f"`{key}`").isNull(), 1)).alias("null_keys")
    off = F.count(_balance(1e-4, 1e-9)[2]) if set(BALANCE) <= set(target.columns) else F.lit(0).cast("long")
    mine = source.agg(counts.alias("source_count"), nulls, *stats("s"))
    theirs = target.agg(counts.alias("target_count"), off.alias("invariant_errors"), *stats("t"))
    delta = [F.when(F.col(f"s{i}").isNotNull(), F.struct(F.lit(f"{f}.{x}").alias("name"), (F.coalesce(f"t{i}", F.lit(0.0)) - F.col(f"s{i}")).alias("delta"))) for i, (f, x) in enumerate(names)]
    told = F.array_compact(F.array(*delta)) if delta else F.array().cast("array<struct<name:string,delta:double>>")
    worst = F.coalesce(F.array_max(F.transform(told, lambda x: F.abs(x["delta"]))), F.lit(0.0)).alias("worst")
    sides = mine.crossJoin(F.broadcast(theirs)).select("source_count", "target_count", "null_keys", "invariant_errors", F.map_from_entries(F.array_sort(told)).alias("deltas"), worst)
    report = sides.crossJoin(F.broadcast(keys))  # one row each
    broken = None
    for r in references:
        part = referential_errors(target, text_key(key), F.col(f"`{r.column}`"), r.parents, F.col(f"`{r.key}`")).agg(F.count(F.lit(1)).alias("n"))
        broken = part if broken is None else broken.unionByName(part)
    total = (broken if broken is not None else source.sparkSession.range(0).select(F.col("id").alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("referential_errors"))
    report = report.crossJoin(F.broadcast(total))
    faults = ("missing", "unexpected", "duplicate", "mismatch", "referential_errors", "invariant_errors")
    passed = F.col("worst") <= max_delta
    for fault in faults:
        passed = passed & (F.col(fault) == 0)
    return report.select(
        "source_count", "target_count", "missing", "unexpected", F.col("duplicate").alias("duplicates"),
        F.col("mismatch").alias("mismatches"), "null_keys", "referential_errors", "invariant_errors", "deltas", "earliest",
        passed.alias("passed"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = part if out is None else out.unionAll(part)
    return out


def upper_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, least, greatest, mean and p50, the value at place n // 2 counted from 0 in ascending order."""
    v, n, middle = F.col(value), F.col("n"), F.floor(F.col("total") / 2)
    return placed(df, by, value).groupBy(*by).agg(
        F.sum("n").alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.max(F.when((F.col("before") <= middle) & (middle < F.col("before") + n), v)).alias("p50"),
    )
