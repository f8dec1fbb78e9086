"""Column-level quality profile of the loads of a table, and a classifier two-sample test between neighbouring loads.

Base aggregates are exact: one pass counts every value of every column of a load; null and distinct counts, top values,
ranges and violations of form follow from these counts.

Changes of distribution are found by a classifier: for each load and the one numbered one lower, a logistic regression
over one-hot features of the rows (null or not, and values) is trained to tell the loads apart, and judged on rows that
it wasn't trained on. Per column it is ablated both ways: the column's terms are taken out of the joint model, and the
column is kept alone. Columns whose held-out figures tell the loads apart are proposed, and only those are held against
exact shares; ranges of numbers come from the exact base aggregates.

* The joint model is cross-fitted over two folds. Its rows are compressed to counted cells, and the cells of a pair of
  loads are dealt out in shards of a bounded size, so a load with a third of all rows is trained in many tasks. Every
  shard trains on its own cells and scores its own held-out ones; the scores are summed over the shards.
* A one-hot model of one column is saturated, so its training has a closed form: it tells a row by whether its value is
  commoner in this load or in the other, among the rows of the other folds. That is counted for whole loads by plain
  aggregates over exact values, cross-fitted over four folds. A value that no other fold has seen is told by no model, and
  few rows tell little: that share of rows and a standard error are left open and count as if they told the loads apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.session import written

DAY = "day"
_DAY_FORM = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


@dataclass(frozen=True)
class TableSpec:
    """The profiled columns of a table: the form of their values (a Java pattern, or DAY for an existing day; None for
    no form), those whose values are compared by share, and those compared by the range of their absolute values."""

    name: str
    forms: dict[str, str | None]
    by_share: tuple[str, ...] = ()
    by_range: tuple[str, ...] = ()


@dataclass(frozen=True)
class Limits:
    """What counts as a finding (see findings), and the share of it from which the classifier proposes a column."""

    pattern: float = 0.05
    rows: int = 200
    null_shift: float = 0.06
    value_shift: float = 0.15
    range_shift: int = 4
    propose: float = 0.5


LEGACY = (
    TableSpec(
        "legacy_transactions",
        {
            "txn_id": r"\AT[0-9]{11}\z",
            "acct_ref": r"\AA[0-9]{10}\z",
            "amount": r"\A-?[0-9]+\.[0-9]{2}\z",
            "currency": r"\A[A-Z]{3}\z",
            "txn_type": r"\A(CREDIT|DEBIT|REVERSAL|CHARGEBACK)\z",
            "event_date": DAY,
            "ingest_date": DAY,
        },
        ("currency", "txn_type"),
        ("amount",),
    ),
    TableSpec(
        "legacy_customers",
        {
            "customer_no": r"\AC[0-9]{8}\z",
            "full_name": None,
            "dob": DAY,
            "sex": r"\A[MFU]\z",
            "status": None,
            "phone": r"\A\+(?=(-?[0-9]){8,15}\z)[0-9]+(-[0-9]+)*\z",
            "country_code": r"\A[A-Z]{2}\z",
            "updated_at": None,
        },
        ("sex", "status", "country_code"),
    ),
)


def _has_form(form: str | None, value: Column) -> Column:
    if form is None:
        return F.lit(True)
    if form == DAY:
        return F.coalesce(value.rlike(_DAY_FORM) & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), F.lit(False))
    return value.rlike(form)


#: A column of a load has one number: the load's, and in so many lower bits the column's place in the spec.
_PLACES = 6


def _places(spec: TableSpec, names: Iterable[str]) -> Iterator[tuple[Column, Column]]:
    """The number within a load, and the text, of each of the named columns."""
    place = {c: i for i, c in enumerate(spec.forms)}
    assert len(place) <= 1 << _PLACES
    return ((F.lit(place[c]), F.col(f"`{c}`").cast("string")) for c in names)


def _named(spec: TableSpec, at: Column) -> list[Column]:
    names = F.array(*[F.lit(c) for c in spec.forms])
    return [F.shiftright(at, _PLACES).cast("int").alias("load_id"), F.get(names, at.bitwiseAND(F.lit((1 << _PLACES) - 1)).cast("int")).alias("column_name")]


def _at(place: Column) -> Column:
    return F.col("load_id").cast("int").cast("long") * F.lit(1 << _PLACES) + place


FOLDS = 4


def counted_cells(df: DataFrame, spec: TableSpec) -> DataFrame:
    """load_id, fold, nulls (a bit for each column that is null), v0, v1, ... (the values of columns compared by share), n:
    how many rows of a load are alike in these; rows with a null load_id are in no load. Rows are dealt to folds one by one,
    by a hash of the row and its number, as of a table of few different rows equal ones can't all be in one fold.
    Written once: all of the classifier reads it, and the profiles take the columns compared by share from it."""
    every = [F.col(f"`{c}`") for c in spec.forms]
    nulls = sum((F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(every)), F.lit(0).cast("long"))
    values = [F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(spec.by_share)]
    rows = df.where(F.col("load_id").isNotNull()).select(
        F.col("load_id").cast("int"),
        F.pmod(F.xxhash64(*every, F.monotonically_increasing_id()), F.lit(FOLDS)).cast("int").alias("fold"),
        nulls.alias("nulls"),
        *values,
    )
    return written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")), "cells")


def value_counts(df: DataFrame, spec: TableSpec, cells: DataFrame | None = None) -> DataFrame:
    """at, value, n: how often each value, null included, stands in each column of each load (see _named); rows with a
    null load_id are in no load. cells: the counted_cells of df, which spare counting columns compared by share anew."""
    one = lambda p, c: F.struct(_at(p).alias("at"), c.alias("value"))
    plain = [c for c in spec.forms if cells is None or c not in spec.by_share]
    long = df.where(F.col("load_id").isNotNull()).select(F.inline(F.array(*[one(p, c) for p, c in _places(spec, plain)])))
    long = long.withColumn("n", F.lit(1).cast("long"))
    if cells is not None and spec.by_share:
        shares = [one(p, F.col(f"v{i}")) for i, (p, _) in enumerate(_places(spec, spec.by_share))]
        long = long.unionByName(cells.select(F.inline(F.array(*shares)), "n"))
    return long.groupBy("at", "value").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, spec: TableSpec, extremes: bool = True) -> DataFrame:
    """The profile of each column of each load, from value_counts: load_id, column_name, row_count, null_count,
    distinct_count (of non-null values), malformed (rows whose value lacks the form), min_value, max_value, most_abs
    (largest absolute value of the form, of columns compared by range) and top_values (up to five, by count descending,
    then value ascending). extremes=False leaves out min_value and max_value, which as texts are
    aggregated by sorting. Only a null is null; blank is a value. A load without rows has no profile."""
    value, n = F.col("value"), F.col("n")
    place = {c: F.col("at").bitwiseAND(F.lit((1 << _PLACES) - 1)) == i for i, c in enumerate(spec.forms)}
    bad = F.lit(False)
    for column, form in spec.forms.items():
        if form is not None:
            bad = F.when(place[column], ~_has_form(form, value)).otherwise(bad)
    # The form is looked at once, for both of its uses.
    formed = counts.withColumn("bad", value.isNotNull() & bad)
    most = F.lit(None).cast("decimal(38,2)")
    for column in spec.by_range:
        most = F.when(place[column] & ~F.col("bad"), F.abs(value.try_cast("decimal(38,2)"))).otherwise(most)
    # Nulls aren't filtered before the limit, so that both readings of the counts share one exchange. One number for a
    # column of a load, and one for null and count, make the comparisons of the sort short.
    last = F.when(value.isNull(), F.lit(1).cast("long")).otherwise(-n)
    rank = F.row_number().over(Window.partitionBy("at").orderBy(last, value))
    top = (
        counts.withColumn("r", rank)
        .where(F.col("r") <= 5)
        .groupBy("at")
        .agg(F.collect_list(F.when(value.isNotNull(), F.struct("r", "value", "n"))).alias("top"))
        .select("at", F.transform(F.array_sort("top"), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_values"))
    )
    base = formed.groupBy("at").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("bad"), n)), F.lit(0)).alias("malformed"),
        *([F.min("value").alias("min_value"), F.max("value").alias("max_value")] if extremes else []),
        F.max(most).alias("most_abs"),
    )
    # Both have the same keys. A full join lets no filter on them sink into one side alone, which would part the exchange.
    both = base.join(top, "at", "full")
    return both.select(*_named(spec, F.col("at")), *[c for c in both.columns if c != "at"])


# --- the classifier -------------------------------------------------------------------------------------------------

WIDTH, ROUNDS, STEP, RIDGE = 256, 6, 0.4, 1.0

#: Cells of a shard, and cells that a task trains at a time.
SHARD, BATCH = 100_000, 200_000


def _hits(score: np.ndarray, y: np.ndarray, n: np.ndarray, group: np.ndarray, groups: int) -> list[np.ndarray]:
    """Of each group, the rows of the load and of the other one that the rule score > 0 takes for the load's."""
    yes = n * (score > 0)
    return [np.bincount(group, yes * y, groups), np.bincount(group, yes * (1 - y), groups)]


def _trained(cells: pd.DataFrame, columns: list[str], shares: list[str]) -> pd.DataFrame:
    """Trains and scores the joint model of each shard of cells (shard, y, fold, nulls, c0, c1, ..., n): shard, place of the
    column, and the rows taken for the load's, by the whole model (full1, full0) and without the column (less1, less0)."""
    shards, group = np.unique(cells["shard"].to_numpy(), return_inverse=True)
    groups = len(shards)
    y, n = cells["y"].to_numpy(float), cells["n"].to_numpy(float)
    fold, nulls = cells["fold"].to_numpy() & 1, cells["nulls"].to_numpy()
    of = np.stack([np.bincount(group, n * (y == k), groups) for k in (0, 1)], 1)
    weight = n / np.maximum(of[group, y.astype(int)], 1) * of.min(1)[group]  # both loads weigh the same
    # Of each column: the cells that have its feature, and where the weight of the feature stands.
    slots = []
    for i, c in enumerate(columns):
        if c in shares:
            slots.append((np.arange(len(n)), group * WIDTH + cells[f"c{shares.index(c)}"].to_numpy(), groups * WIDTH))
        else:
            rows = np.flatnonzero(nulls >> i & 1)
            slots.append((rows, group[rows], groups))

    terms, bias = np.zeros((len(slots), len(n))), np.zeros(len(n))
    for k in (0, 1):
        train = fold != k
        number = np.cumsum(train) - 1
        g, yt, wt = group[train], y[train], weight[train]
        mine = [(number[rows[train[rows]]], at[train[rows]]) for rows, at, _ in slots]
        ws, b = [np.zeros(size) for _, _, size in slots], np.zeros(groups)
        for _ in range(ROUNDS):
            eta = b[g]
            for (rows, at), w in zip(mine, ws, strict=True):
                eta[rows] += w[at]
            p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
            r, h = wt * (yt - p), wt * p * (1 - p)
            for (rows, at), w in zip(mine, ws, strict=True):
                if len(rows):
                    grad, curve = np.bincount(at, r[rows], len(w)), np.bincount(at, h[rows], len(w))
                    w += STEP * (grad - RIDGE * w) / (curve + RIDGE)
            b += STEP * np.bincount(g, r, groups) / (np.bincount(g, h, groups) + RIDGE)
        bias[~train] = b[group[~train]]
        for term, w, (rows, at, _) in zip(terms, ws, slots, strict=True):
            held = ~train[rows]
            term[rows[held]] = w[at[held]]
    full = bias + terms.sum(0)
    joint = _hits(full, y, n, group, groups)
    out = []
    for i, term in enumerate(terms):
        less = _hits(full - term, y, n, group, groups) if term.any() else joint
        out.append(pd.DataFrame(dict(zip(("shard", "place", "full1", "full0", "less1", "less0"), (shards, i, *joint, *less), strict=True))))
    return pd.concat(out)


def _whole_shards(columns: list[str], shares: list[str], batch: int):
    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells come sorted by shard; the last shard of what is at hand may go on."""
        held: list[pd.DataFrame] = []
        rows = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= batch:
                pdf = pd.concat(held)
                going = pdf["shard"] == pdf["shard"].iloc[-1]
                if not going.all():
                    yield _trained(pdf[~going], columns, shares)
                held = [pdf[going]]
                rows = len(held[0])
        if rows:
            yield _trained(pd.concat(held), columns, shares)

    return train


def _sided(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Each row twice: for its own load's pair (y = 1), and for that of the load numbered one higher (y = 0)."""
    pairs = F.array(F.struct("load_id", F.lit(1).alias("y")), F.struct(_next_load(), F.lit(0).alias("y")))
    return rows.select(F.explode(pairs).alias("p"), *columns).select("p.load_id", "p.y", *columns).where("load_id is not null")


def _next_load() -> Column:
    """The load numbered one higher; none after the greatest number there is."""
    return F.try_add("load_id", F.lit(1)).alias("load_id")


def _by_side_and_fold(name: str, value: str) -> list[Column]:
    """name1 and name0: arrays of the sums of value in each fold, of the load and of the other one."""
    of = lambda y, k: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("fold") == k), F.col(value))), F.lit(0))
    return [F.array(*[of(y, k) for k in range(FOLDS)]).alias(f"{name}{y}") for y in (1, 0)]


def _total(c: Column) -> Column:
    return sum((c[k] for k in range(1, FOLDS)), c[0])


def _folds(cells: DataFrame, spec: TableSpec) -> DataFrame:
    """load_id, place, r1, r0 (rows in each fold of the load and of the other one) and z1, z0 (those with a null), of each
    column of each pair of loads that both have rows."""
    bit = lambda i: F.sum(F.when(F.col("nulls").bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(0))
    small = cells.groupBy("load_id", "fold").agg(F.sum("n").alias("r"), *[bit(i).alias(f"z{i}") for i in range(len(spec.forms))])
    listed = F.array(*[F.struct(F.lit(i).alias("place"), F.col(f"z{i}").alias("z")) for i in range(len(spec.forms))])
    sides = _sided(small.select("load_id", "fold", "r", F.inline(listed)), ["fold", "place", "r", "z"])
    pairs = sides.groupBy("load_id", "place").agg(*_by_side_and_fold("r", "r"), *_by_side_and_fold("z", "z"))
    return pairs.where((_total(F.col("r1")) > 0) & (_total(F.col("r0")) > 0))


def _null_alone() -> tuple[Column, Column]:
    """Held-out discrimination of the saturated model of null or not; and the share of rows whose null no other fold has
    seen, of the load in which it is larger."""
    r1, r0, z1, z0 = (F.col(c) for c in ("r1", "r0", "z1", "z0"))
    j, unseen = F.lit(0.0), F.lit(0.0)
    for k in range(FOLDS):
        one, other = _total(z1) - z1[k], _total(z0) - z0[k]
        commoner = one.cast("double") * (_total(r0) - r0[k]) - other.cast("double") * (_total(r1) - r1[k])
        null = z1[k] / _total(r1) - z0[k] / _total(r0)
        rest = (r1[k] - z1[k]) / _total(r1) - (r0[k] - z0[k]) / _total(r0)
        j = j + F.when(commoner > 0, null).when(commoner < 0, rest).otherwise(0.0)
        unseen = unseen + F.when((one == 0) & (other == 0), F.greatest(z1[k] / _total(r1), z0[k] / _total(r0))).otherwise(0.0)
    return j.alias("null_alone"), unseen.alias("null_open")


def _values_alone(cells: DataFrame, folds: DataFrame, spec: TableSpec) -> DataFrame:
    """load_id, place of columns compared by share: value_alone (held-out discrimination of the saturated model of the
    values of non-null rows), value_open (what held-out rows can't
    settle: the share of the load's rows whose value no other fold has seen, and the largest standard error of a
    discrimination on so few rows) and apart (exactly: the
    sum of differences of shares, times both numbers of rows)."""
    place = {c: i for i, c in enumerate(spec.forms)}
    listed = F.array(*[F.struct(F.lit(place[c]).alias("place"), F.col(f"v{i}").alias("value")) for i, c in enumerate(spec.by_share)])
    long = cells.select("load_id", "fold", "n", F.inline(listed)).where(F.col("value").isNotNull())
    counted = _sided(long, ["fold", "n", "place", "value"]).groupBy("load_id", "place", "value").agg(*_by_side_and_fold("n", "n"))
    t = folds.select("load_id", "place", *[F.zip_with(f"r{y}", f"z{y}", lambda r, z: r - z).alias(f"t{y}") for y in (1, 0)])
    n1, n0, t1, t0 = (F.col(c) for c in ("n1", "n0", "t1", "t0"))
    alone, unseen = F.lit(0.0), F.lit(0).cast("long")
    for k in range(FOLDS):
        one, other = _total(n1) - n1[k], _total(n0) - n0[k]
        commoner = one.cast("double") * (_total(t0) - t0[k]) > other.cast("double") * (_total(t1) - t1[k])
        alone = alone + F.when(commoner, n1[k] / _total(t1) - n0[k] / _total(t0)).otherwise(0.0)
        unseen = unseen + F.when((one == 0) & (other == 0), n1[k]).otherwise(0)
    whole = lambda a, b: (_total(a).cast("decimal(19,0)") * _total(b).cast("decimal(19,0)")).cast("decimal(38,0)")
    return (
        counted.join(t.where((_total(t1) > 0) & (_total(t0) > 0)), ["load_id", "place"])
        .groupBy("load_id", "place")
        .agg(
            F.sum(alone).alias("value_alone"),
            (F.sum(unseen / _total(t1)) + F.max(F.sqrt(0.25 / _total(t1) + 0.25 / _total(t0)))).alias("value_open"),
            F.sum(F.abs(whole(n1, t0) - whole(n0, t1))).cast("decimal(38,0)").alias("apart"),
        )
    )


def two_sample_test(cells: DataFrame, spec: TableSpec, shard: int = SHARD, batch: int = BATCH) -> DataFrame:
    """The classifier's evidence, from counted_cells, for each load that has a load numbered one lower, and each column:

    discrimination (Youden's J of the joint model on held-out rows: the share of the load's rows told right, less that of
    the other's told wrong), ablated (how much of it goes with the column), null_alone and value_alone (held-out J of the
    column alone: of null or not, and of its values among non-null rows), null_open and value_open (shares of rows that no
    fold but their own has seen alike, see _null_alone and _values_alone) and apart (exact, see there). The last three are
    null for columns not compared by share and where a load has nulls only. shard, batch: how
    many cells are trained together, and at a time.
    """
    columns, shares = list(spec.forms), list(spec.by_share)
    folds = _folds(cells, spec)
    pairs = _sided(cells.groupBy("load_id").agg(F.count(F.lit(1)).alias("many")), ["many"]).groupBy("load_id")
    pairs = pairs.agg(F.ceil(F.sum("many") / shard).cast("int").alias("shards"), F.count(F.lit(1)).alias("loads")).where("loads = 2").select("load_id", "shards")
    codes = [F.when(F.col(f"v{i}").isNull(), 0).otherwise(F.pmod(F.xxhash64(f"v{i}"), F.lit(WIDTH - 1)).cast("int") + 1).alias(f"c{i}") for i in range(len(shares))]
    coded = _sided(cells.select("load_id", "fold", "nulls", *codes, "n"), ["fold", "nulls", *[f"c{i}" for i in range(len(shares))], "n"])
    part = F.pmod(F.xxhash64("fold", "nulls", *[f"c{i}" for i in range(len(shares))]), F.col("shards"))
    trained = (
        coded.join(pairs, "load_id")
        .select((F.col("load_id").cast("long") * F.lit(1 << 31) + part).alias("shard"), "y", "fold", "nulls", *[f"c{i}" for i in range(len(shares))], "n")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInPandas(_whole_shards(columns, shares, batch), "shard long, place int, full1 double, full0 double, less1 double, less0 double")
        .groupBy(F.shiftright("shard", 31).cast("int").alias("load_id"), "place")
        .agg(*[F.sum(c).alias(c) for c in ("full1", "full0", "less1", "less0")])
    )
    joint = F.col("full1") / _total(F.col("r1")) - F.col("full0") / _total(F.col("r0"))
    less = F.col("less1") / _total(F.col("r1")) - F.col("less0") / _total(F.col("r0"))
    found = folds.join(trained, ["load_id", "place"]).select("load_id", "place", joint.alias("discrimination"), (joint - less).alias("ablated"), *_null_alone())
    if shares:
        found = found.join(_values_alone(cells, folds, spec), ["load_id", "place"], "left")
    else:
        found = found.withColumns({c: F.lit(None).cast(t) for c, t in (("value_alone", "double"), ("value_open", "double"), ("apart", "decimal(38,0)"))})
    names = F.array(*[F.lit(c) for c in columns])
    return found.select("load_id", F.get(names, F.col("place")).alias("column_name"), "discrimination", "ablated", "null_alone", "null_open", "value_alone", "value_open", "apart")


def proposals(evidence: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Of the evidence, what the classifier proposes as changed: load_id, column_name, kind.

    A column is proposed by ablation either way: when taking it out costs the joint model, or keeping it alone still
    tells the loads apart, a share `propose` of the limit or more on held-out rows. What these leave open counts as told
    apart, so no shift of many rare values or of few rows is lost. An exact check decides in the end.
    """
    null = F.greatest(F.col("ablated"), F.col("null_alone") + F.col("null_open")) >= limits.null_shift * limits.propose
    value = F.greatest(F.col("ablated"), F.col("value_alone") + F.col("value_open")) >= limits.value_shift * limits.propose
    kinds = F.array(F.when(null, "null_shift"), F.when(F.col("value_alone").isNotNull() & value, "value_shift"))
    return evidence.select("load_id", "column_name", "apart", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def findings(df: DataFrame, recorded: DataFrame, spec: TableSpec, limits: Limits = Limits()) -> DataFrame:
    """Columns of loads whose recorded profile is wrong, whose values are malformed, or which changed: load_id,
    column_name, finding.

    recorded has load_id, column_name, null_count, distinct_count, top_values. null_count, distinct_count, top_values:
    the recorded value isn't that of the load's rows. pattern: more than limits.pattern of the non-null values lack the
    form. Against the load numbered one lower, both of limits.rows rows or more: null_shift, value_shift (half the sum
    of absolute differences of shares of non-null rows), range_shift (largest absolute value more than so many times
    the other's, either way). Only columns in recorded are reported; a recorded column of a load without rows has counts
    of nought. A recorded null equals nothing. Empty tables yield no shifts.
    """
    cells = counted_cells(df, spec)
    # Written once, a row for each column of each load: it is read for the record and for either load of a pair.
    found = written(profiles(value_counts(df, spec, cells), spec, extremes=False), "profiles")
    known = recorded.select(
        F.col("load_id").cast("int").alias("load_id"),
        "column_name",
        F.col("null_count").alias("r_nulls"),
        F.col("distinct_count").alias("r_distinct"),
        F.col("top_values").cast("array<struct<value:string,n:bigint>>").alias("r_top"),
    ).where(F.col("column_name").isin(*spec.forms))
    none = F.array().cast("array<struct<value:string,n:bigint>>")
    checked = known.join(found, ["load_id", "column_name"], "left")
    nulls, distinct = (F.coalesce(c, F.lit(0)) for c in ("null_count", "distinct_count"))
    present = F.col("row_count") - F.col("null_count")
    wrong = F.array(
        F.when(~F.col("r_nulls").eqNullSafe(nulls), "null_count"),
        F.when(~F.col("r_distinct").eqNullSafe(distinct), "distinct_count"),
        F.when(~F.col("r_top").eqNullSafe(F.coalesce("top_values", none)), "top_values"),
        F.when(F.col("malformed") > present * F.lit(str(limits.pattern)).cast("decimal(10,4)"), "pattern"),
    )
    base = checked.select("load_id", "column_name", F.explode(F.filter(wrong, lambda x: x.isNotNull())).alias("finding"))

    large = found.where(F.col("row_count") >= limits.rows)
    shape = ["row_count", "null_count", "most_abs"]
    this = large.select("load_id", "column_name", *shape)
    other = large.select(_next_load(), "column_name", *[F.col(c).alias(f"o_{c}") for c in shape])
    reported = known.select("load_id", "column_name").distinct()
    pairs = written(this.join(other, ["load_id", "column_name"]).join(reported, ["load_id", "column_name"]), "pairs")
    times = F.lit(limits.range_shift)
    far = (F.col("most_abs") > F.col("o_most_abs") * times) | (F.col("o_most_abs") > F.col("most_abs") * times)
    ranges = pairs.where(far).select("load_id", "column_name", F.lit("range_shift").alias("finding"))
    # Shares are compared crosswise in whole numbers, so a difference of exactly the limit is never lost to rounding.
    whole = lambda a, b: (a.cast("decimal(19,0)") * b.cast("decimal(19,0)")).cast("decimal(38,0)")
    limit = lambda x: F.lit(str(x)).cast("decimal(10,4)")
    rows, o_rows, nulls, o_nulls = (F.col(c) for c in ("row_count", "o_row_count", "null_count", "o_null_count"))
    apart = F.when(F.col("kind") == "null_shift", F.abs(whole(nulls, o_rows) - whole(o_nulls, rows)) > limit(limits.null_shift) * whole(rows, o_rows)).otherwise(
        F.col("apart") > limit(2 * limits.value_shift) * whole(rows - nulls, o_rows - o_nulls)
    )
    proposed = proposals(two_sample_test(cells, spec), limits)
    shifts = proposed.join(pairs, ["load_id", "column_name"]).where(apart).select("load_id", "column_name", F.col("kind").alias("finding"))
    return base.unionByName(ranges).unionByName(shifts)
