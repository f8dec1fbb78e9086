"""The operators of problems 1 to 4 on small hard tables, and against their SQL twins on the smallest test tables."""

import datetime as dt
from collections import Counter

import duckdb
import pytest
from paritas.functions.text import amount, key_form, normalize_status, trimmed
from paritas.operators.changes import _summed, current_state, image
from paritas.operators.differences import Field, differences
from paritas.operators.orphans import orphan_counts, orphans
from paritas.operators import quality
from paritas.operators.quality import Limits, TableSpec, counted_cells, findings, profiles, proposals, two_sample_test, value_counts
from paritas.queries import problems
from paritas.queries.problems_sql import SQL
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("legacy_accounts", "accounts", "legacy_customers", "legacy_transactions", "column_profiles", "cdc_events", "raw_records"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = problems.QUERIES[name](spark, small)
    columns = ", ".join(df.columns)
    expected = con.sql(f"SELECT {columns} FROM ({SQL[name]})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(expected)


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


# --- texts ------------------------------------------------------------------------------------------------------------


def test_text_forms(spark):
    df = spark.createDataFrame([(x,) for x in (" a\t\r\n", "", " \n", None, "(1,234.50)", "+7", "-.5", "1e5", "abc")], "x string")
    got = [tuple(r) for r in df.select(trimmed(F.col("x")), key_form(F.col("x")), amount(F.col("x"), True).cast("double")).collect()]
    assert got[:4] == [("a", "A", None), (None, None, None), (None, None, None), (None, None, None)]
    assert [g[2] for g in got[4:]] == [-1234.5, 7.0, -0.5, None, None]
    status = spark.createDataFrame([(x,) for x in (" yes ", "x", None, "", "other")], "x string")
    assert [r[0] for r in status.select(normalize_status(F.col("x"))).collect()] == ["ACTIVE", "CLOSED"] + ["UNKNOWN"] * 3


# --- problem 1 --------------------------------------------------------------------------------------------------------

FIELDS = [Field("m", "m", "m", "amount"), Field("d", "d", "n", "amount"), Field("s", "s", "s", "status"), Field("c", "c", "c", "key"), Field("e", "e", "e")]
LEFT, RIGHT = "k string, m string, d double, s string, c string, e string, side int", "k string, m string, n decimal(20,4), s string, c string, e string, row int, v0 string"


def test_differences_of_hard_rows(spark):
    left = [
        (" a ", "1.00", 0.1 + 0.2, "Y", "eur", "x", 1), ("A", "1.00", 0.3, "Y", "EUR", "x", 2), ("b", None, None, None, None, None, 1),
        ("c", "0", float("nan"), "N", "", "x ", 1), ("d", "n/a", 1.0, "A", "USD", None, 1), (None, "1", 1.0, "A", "A", "A", 1), (" ", "1", 1.0, "A", "A", "A", 1),
        ("only", "1", 1.0, "A", "A", "A", 1), ("e", "1.005", 100.0, "1", "x", "x", 1), ("f", "1.0049", 100.0, "1", "x", "x", 1),
    ]
    right = [
        ("a", "+1", "0.3", "ACTIVE", " EUR", "x", 1, ""), ("b", None, None, "UNKNOWN", None, None, 1, ""), ("C", None, None, "CLOSED", None, "x", 1, ""),
        ("d", " n/a", "1", "ACTIVE", "USD", "", 1, ""), ("new", "1", "1", "A", "A", "A", 1, None), ("e", "1", "100.005", "A", "x", "x", 1, ""), ("f", "1", "100.0049", "A", "x", "x", 1, ""),
    ]
    from decimal import Decimal

    right = [(k, m, None if n is None else Decimal(n), *rest) for k, m, n, *rest in right]
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    expected = {("C", "m"), ("C", "d"), ("C", "e"), ("D", "e"), ("ONLY", "missing_in_right"), ("NEW", "missing_in_left"), ("E", "m"), ("E", "d")}
    assert rows(differences(a, b, "k", "k", FIELDS)) == expected
    assert rows(differences(a.limit(0), b, "k", "k", FIELDS)) == {(k, "missing_in_left") for k in ("A", "B", "C", "D", "NEW", "E", "F")}
    assert rows(differences(a.limit(0), b.limit(0), "k", "k", FIELDS)) == set()


def test_differences_with_a_hot_key(spark):
    hot = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit("1").alias("e"))
    other = hot.withColumn("e", F.when(F.col("k") == "hot", "2").otherwise("1"))
    assert rows(differences(hot, other, "k", "k", [Field("e", "e", "e")])) == {("HOT", "e")}


def test_a_hot_key_of_unlike_rows_is_one_row_a_side_when_ranges_are_cut(spark):
    i = F.col("id")
    df = spark.range(30000).select(F.when(i % 3 == 0, "hot").otherwise(i.cast("string")).alias("k"), i.cast("string").alias("e"))
    found = differences(df, df.where("e <> '0'"), "k", "k", [Field("e", "e", "e")])
    assert rows(found) == {("HOT", "e")}
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "RepartitionByExpression":
        plan = plan.children().apply(0)
    assert plan.children().apply(0).nodeName() == "Aggregate"


def test_one_exchange_by_key_after_repeats_fall_together(spark):
    df = spark.createDataFrame([("a", "x")], "k string, e string")
    plan = differences(df, df, "k", "k", [Field("e", "e", "e")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange ") == 2


# --- problem 2 --------------------------------------------------------------------------------------------------------

SPEC = TableSpec("t", {"id": r"\AT[0-9]{2}\z", "amount": r"\A-?[0-9]+\.[0-9]{2}\z", "kind": None, "day": "day"}, ("kind",), ("amount",))


def loads(spark):
    out = []
    for load in (1, 2, 3, 5):
        for i in range(300):
            kind = ("x" if i % 2 else "y") if load < 3 else ("x" if i % 5 else "z")
            out.append((f"T{i % 100:02d}", f"{i}.50" if load != 2 or i else "9999.00", kind if i % 10 or load == 2 else None, "2024-02-30" if i < 16 and load == 5 else "2024-02-29", load, "extra"))
    out += [(None, None, None, None, 6, ""), (None, None, "x", None, None, "")]
    return spark.createDataFrame(out, "id string, amount string, kind string, day string, load_id int, n string")


def test_findings_of_loads(spark):
    df = loads(spark)
    right = profiles(value_counts(df, SPEC), SPEC).where("load_id is not null")
    assert rows(findings(df, right, SPEC)) == {
        (2, "kind", "null_shift"), (3, "kind", "null_shift"), (3, "kind", "value_shift"), (2, "amount", "range_shift"), (3, "amount", "range_shift"), (5, "day", "pattern"),
    }
    wrong = right.withColumns({"null_count": F.col("null_count") + 1, "distinct_count": F.lit(None).cast("long"), "top_values": F.reverse("top_values")}).where("load_id = 1 and column_name = 'kind'")
    assert rows(findings(df, wrong, SPEC)) == {(1, "kind", x) for x in ("null_count", "distinct_count", "top_values")}
    gone = right.where("load_id = 1 and column_name = 'kind'").withColumn("load_id", F.lit(77))
    assert rows(findings(df, gone, SPEC)) == {(77, "kind", x) for x in ("null_count", "distinct_count", "top_values")}
    assert rows(findings(df.limit(0), right.limit(0), SPEC)) == set()


def test_classifier_tells_changed_columns(spark):
    found = two_sample_test(counted_cells(loads(spark), SPEC), SPEC)
    evidence = {(r["load_id"], r["column_name"]): r for r in found.collect()}
    assert {k[0] for k in evidence} == {2, 3, 6}
    assert evidence[3, "kind"]["discrimination"] > 0.4 and evidence[3, "kind"]["ablated"] > 0.3 and evidence[3, "kind"]["value_alone"] > 0.3
    assert abs(evidence[3, "id"]["ablated"]) < 0.1 and evidence[3, "id"]["null_alone"] == 0 and evidence[3, "id"]["value_alone"] is None
    assert evidence[2, "kind"]["null_alone"] > 0.05 and abs(evidence[2, "kind"]["value_alone"]) < 0.1
    proposed = rows(proposals(found).drop("apart"))
    assert {(3, "kind", "value_shift"), (2, "kind", "null_shift"), (3, "kind", "null_shift")} <= proposed
    assert not {x for x in proposed if x[1] in ("id", "amount", "day") and x[0] < 6}


def test_loads_of_any_number(spark):
    """Negative numbers, the greatest and the least one, columns named like those the operator makes."""
    spec = TableSpec("t", {"n": None, "fold": None, "at": r"\A[0-9]+\z"}, ("fold", "n"), ())
    made = [(str(i % 5), "x" if load % 2 else "y", str(i), load, i) for load in (-3, -2, 2**31 - 2, 2**31 - 1, -(2**31)) for i in range(220)]
    df = spark.createDataFrame(made, "n string, fold string, at string, load_id int, value int")
    right = profiles(value_counts(df, spec), spec)
    assert rows(findings(df, right, spec)) == {(-2, "fold", "value_shift"), (2**31 - 1, "fold", "value_shift")}


def test_shards_of_one_pair_tell_as_much_as_the_whole(spark):
    """A pair dealt out in many shards, as that of a load with a third of all rows is."""
    cells = counted_cells(loads(spark).withColumn("kind", F.concat("kind", F.xxhash64("amount") % 3)), SPEC)
    whole, parts = (two_sample_test(cells, SPEC, shard=n, batch=30).where("load_id = 3").collect() for n in (10**6, 150))
    assert [r["column_name"] for r in whole] == [r["column_name"] for r in parts]
    kinds = [next(r for r in x if r["column_name"] == "kind") for x in (whole, parts)]
    assert all(k["ablated"] > 0.2 for k in kinds) and kinds[0]["value_alone"] == pytest.approx(kinds[1]["value_alone"])


def test_without_the_classifier_no_shift_is_found(spark, monkeypatch):
    """A blinded classifier, whose held-out figures are those of guessing, loses the shifts of nulls and values."""
    df = loads(spark)
    right = profiles(value_counts(df, SPEC), SPEC).where("load_id is not null")
    seen = {x for x in rows(findings(df, right, SPEC)) if x[2] in ("null_shift", "value_shift")}
    assert len(seen) == 3
    test = quality.two_sample_test
    blind = {c: F.lit(0.0) for c in ("discrimination", "ablated", "null_alone", "null_open", "value_alone", "value_open")}
    monkeypatch.setattr(quality, "two_sample_test", lambda *x: test(*x).withColumns(blind))
    assert not {x for x in rows(findings(df, right, SPEC)) if x[2] in ("null_shift", "value_shift")}


def test_classifier_proposes_every_shift_the_exact_check_finds(spark):
    """Random loads: what brute force finds is proposed, in small batches of cells too."""
    import random

    rng = random.Random(4)
    data, shares = [], {}
    for load in range(1, 25):
        weights = [rng.random() for _ in range(6)]
        nulls = rng.choice([0, 0.05, 0.1, 0.9])
        for _ in range(220):
            data.append((None, None, None if rng.random() < nulls else rng.choices("abcdef", weights)[0], None, load, ""))
        shares[load] = Counter(r[2] for r in data if r[4] == load)
    df = spark.createDataFrame(data, "id string, amount string, kind string, day string, load_id int, n string")
    proposed = rows(proposals(two_sample_test(counted_cells(df, SPEC), SPEC, shard=100, batch=50), Limits()).drop("apart"))
    for load in range(2, 25):
        a, b = shares[load], shares[load - 1]
        if abs(a[None] - b[None]) / 220 > 0.06:
            assert (load, "kind", "null_shift") in proposed
        n, m = 220 - a[None], 220 - b[None]
        if n and m and sum(abs(a[v] / n - b[v] / m) for v in "abcdef") / 2 > 0.15:
            assert (load, "kind", "value_shift") in proposed


def test_a_shift_of_more_values_than_cells_is_found(spark):
    """Wholly other values in the second load; in cells of so many values the classifier sees next to nothing."""
    kind = F.when(F.col("load_id") == 3, F.col("id") + 40000).otherwise(F.col("id")).cast("string").alias("kind")
    none = [F.lit(None).cast("string").alias(c) for c in ("amount", "day")]
    both = spark.range(60000).withColumn("load_id", (F.col("id") / 20000).cast("int") + 1)
    df = both.select(F.lit("T00").alias("id"), kind, *none, "load_id")
    right = profiles(value_counts(df, SPEC), SPEC)
    assert rows(findings(df, right, SPEC)) == {(2, "kind", "value_shift"), (3, "kind", "value_shift")}
    same = df.unionAll(df.where("load_id = 3").withColumn("load_id", F.lit(4)))
    assert rows(findings(same, right.where("load_id = 3").withColumn("load_id", F.lit(4)), SPEC)) == set()


# --- problem 3 --------------------------------------------------------------------------------------------------------

EVENTS = "event_id string, sequence long, table_name string, primary_key string, operation string, after_image string, before_image string, m int, stood string"


def test_state_of_hard_events(spark):
    e = [
        ("1", 1, "t", "a", "insert ", "{}"), ("2", 3, "t", "a", "DELETE", None), ("3", 2, "t", "a", "UPDATE", "{}"),
        ("4", 5, "t", "b", "UPDATE", "{}"), ("4", 1, "t", "b", "UPDATE", "{}"), ("5", 4, "t", "b", "UPDATE", None), ("6", 3, "t", "b", "INSERT", "{}"),
        ("8", 7, "t", "c", "INSERT", "{}"), ("7", 7, "t", "c", "DELETE", None), ("9", 9, "u", "a", "INSERT", "{}"), ("10", 9, "u", "a", "UPSERT", "{}"), ("11", 10, "u", "a", None, "{}"),
        ("12", 1, None, None, "INSERT", "{}"), ("13", 1, "t", "d", "INSERT", "{}"), ("14", 2, "t", "d", "DELETE", None), ("14", 2, "t", "d", "DELETE", None),
    ]
    df = spark.createDataFrame([(*x, None, 1, "") for x in e], EVENTS)
    expected = {("t", "b", "6"), ("t", "c", "8"), ("u", "a", "9"), (None, None, "12")}
    assert rows(current_state(df)) == expected
    assert rows(current_state(df, block=1)) == rows(current_state(df, block=2)) == expected
    assert rows(current_state(df.unionAll(df))) == expected
    assert rows(current_state(df.limit(0))) == set()


def test_state_over_a_base(spark):
    base = [("t", "kept", "b1"), ("t", "changed", "b2"), ("t", "gone", "b3"), ("u", "gone", "b4"), (None, None, "b5"), ("t", "nothing", "b6"), ("t", "early", "b7"), ("t", "kept", "b1")]
    feed = [
        ("1", 1, "t", "changed", "UPDATE", "{}"), ("2", 1, "t", "gone", "DELETE", None), ("3", 2, "t", "new", "INSERT", "{}"), ("4", 3, None, None, "UPDATE", "{}"),
        ("5", 4, "t", "nothing", "UPDATE", None), ("6", -9, "t", "early", "DELETE", None), ("b4", None, "u", "gone", "DELETE", None),
    ]
    df = spark.createDataFrame([(*x, None, 1, "") for x in feed], EVENTS)
    before = spark.createDataFrame(base, "table_name string, primary_key string, event_id string")
    expected = {("t", "kept", "b1"), ("t", "changed", "1"), ("t", "new", "3"), (None, None, "4"), ("t", "nothing", "b6")}
    assert rows(current_state(df, base=before)) == expected
    assert rows(current_state(df, block=1, base=before)) == expected
    assert rows(current_state(df.limit(0), base=before)) == {x for x in base}
    half = current_state(df.where("sequence <= 1 or sequence is null"), base=before)
    assert rows(current_state(df.where("sequence > 1"), base=half)) == expected


def test_state_of_a_hot_key(spark):
    i = F.col("id")
    df = spark.range(5000).select(
        i.cast("string").alias("event_id"), i.alias("sequence"), F.lit("t").alias("table_name"), F.when(i % 3 == 0, "hot").otherwise(i.cast("string")).alias("primary_key"),
        F.lit("UPDATE").alias("operation"), F.concat(F.lit("{"), i).alias("after_image"), F.when(i % 2 == 0, F.concat(F.lit("{"), i - 3)).alias("before_image"),
    )
    for block in (64, 1 << 16):
        out = rows(current_state(df, block=block))
        assert len(out) == 3334 and ("t", "hot", "4998") in out


def test_blocks_leave_one_change_of_a_hot_key_each(spark):
    i = F.col("id")
    df = spark.range(6400).select(F.lit("t").alias("table_name"), F.lit("hot").alias("primary_key"), F.lit(1).alias("fed"), i.alias("sequence"), i.cast("string").alias("event_id"), F.lit(None).cast("binary").alias("before"), image(i.cast("string")).alias("after"))
    first = _summed(df.withColumn("block", F.floor(F.col("sequence") / 64)), ["table_name", "primary_key", "block"])
    assert first.count() == 100


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_state_with_true_stale_and_absent_before_images(spark, seed):
    """Few images, so that rows come back to a state they had; before-images of all kinds; a base with its rows."""
    import random

    rng = random.Random(seed)
    base = [("t", str(k), f"b{k}", rng.choice(["A", "B", None])) for k in range(6) if rng.random() < 0.6]
    state = {(t, k): (e, x) for t, k, e, x in base}
    feed = []
    for n in range(300):
        key, op, after = ("t", str(rng.randrange(12))), rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), rng.choice("ABC")
        stood = state.get(key, (None, None))[1]
        before = rng.choice([stood, stood, None, rng.choice("ABC")])
        feed.append((f"{n}", n, *key, op, None if op == "DELETE" else after, before, 1, ""))
        if op == "DELETE":
            state.pop(key, None)
        else:
            state[key] = (f"{n}", after)
    rng.shuffle(feed)
    df, before = spark.createDataFrame(feed, EVENTS), spark.createDataFrame(base, "table_name string, primary_key string, event_id string, after_image string")
    expected = {(*k, e) for k, (e, _) in state.items()}
    assert rows(current_state(df, base=before)) == rows(current_state(df, base=before, block=7)) == expected


def test_the_sum_reads_before_images(spark):
    """A true before-image takes its version away without a correction; the plan reads the column."""
    plan = current_state(spark.createDataFrame([("1", 1, "t", "a", "INSERT", "{}", None, 1, "")], EVENTS))._jdf.queryExecution().optimizedPlan().toString()
    assert "before_image" in plan


# --- problem 4 --------------------------------------------------------------------------------------------------------


def day(x):
    return None if x is None else dt.date(2024, *map(int, x.split("-")))


def test_orphans_of_hard_rows(spark):
    parents = [("p", day("1-10"), day("1-20")), ("p", day("2-01"), None), ("p", day("2-01"), None), ("q", day("3-01"), None), (None, day("1-01"), None), ("r", None, None), ("s", day("1-01"), day("1-31")), ("s", day("1-05"), day("1-10"))]
    child = [
        ("1", "p", day("1-10")), ("2", "p", day("1-20")), ("3", "p", day("1-21")), ("3", "p", day("1-21")), ("4", "p", day("1-09")), ("5", "q", day("2-29")), ("6", "none", day("1-01")),
        (None, "none", day("1-01")), ("7", None, day("1-01")), ("8", "p", None), ("9", "r", day("5-05")), ("10", "p", day("12-31")), ("11", "s", day("1-20")), ("12", "s", day("2-01")),
    ]
    a = spark.createDataFrame(parents, "key string, since date, until date").selectExpr("*", "'x' as k", "1 as stretch")
    c = spark.createDataFrame(child, "id string, ref string, day date").selectExpr("*", "'x' as salt", "'y' as reason", "1 as k")

    def run(c, a):
        return orphans(c, F.col("id"), F.col("ref"), F.col("day"), a, F.col("key"), F.col("since"), F.col("until"))

    assert rows(run(c, a)) == {
        ("3", "2024-01", "deleted"), ("4", "2024-01", "late"), ("5", "2024-02", "late"), ("6", "2024-01", "missing"), (None, "2024-01", "missing"), ("9", "2024-05", "late"), ("12", "2024-02", "deleted"),
    }
    assert {r[2] for r in rows(run(c, a.limit(0)))} == {"missing"}
    assert rows(run(c.limit(0), a)) == set()
    counted = orphan_counts(run(c, a).withColumn("table_name", F.lit("t"))).where("reason = 'missing'").collect()
    assert [(r["period"], r["n"]) for r in counted] == [("2024-01", 2)]


def test_orphans_of_a_hot_reference(spark):
    i = F.col("id")
    child = spark.range(6000).select(i.cast("string").alias("c"), F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), i % 50)).alias("r"), F.lit("2024-05-05").cast("date").alias("d"))
    parents = spark.range(50).select(F.concat(F.lit("k"), "id").alias("k"), F.lit("2024-01-01").cast("date").alias("a"), F.lit(None).cast("date").alias("b"))
    out = orphans(child, F.col("c"), F.col("r"), F.col("d"), parents, F.col("k"), F.col("a"), F.col("b")).groupBy("reason").count().collect()
    assert [tuple(r) for r in out] == [("missing", 2000)]
