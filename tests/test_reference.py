"""The engine's own operators: small fixtures, hard rows, properties, and streams against batches."""

import json
import os
import random
import subprocess
import sys
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from paritas.functions.hashing import bucket, merkle_root, row_fingerprint, sha256_text
from paritas.functions.semantic import normalize_scalar
from paritas.operators import cdc, evidence, load, profile, reconcile, scores, temporal, whatif
from paritas.plans import dsl, governance, migration, registry
from paritas.sources import files, sinks, synthetic
from pyspark.sql import functions as F

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_every_query_is_the_same_as_its_sql_twin(spark, small):
    """Every query of the catalogue, rows and columns, on the smallest tables."""
    import duckdb
    from paritas.queries import catalogue, commands

    QUERIES, SQL = catalogue.QUERIES | commands.QUERIES, catalogue.SQL | commands.SQL
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    assert set(SQL) == set(QUERIES)
    differing = []
    for name, sql in SQL.items():
        df = QUERIES[name](spark, small)
        expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        clean = lambda r: tuple(round(float(x), 4) if type(x).__name__ in ("float", "Decimal") else x for x in r)
        if Counter(map(clean, df.collect())) != Counter(map(clean, expected)):
            differing.append(name)
    assert differing == []


def same_as_twin(spark, small, name):
    import duckdb
    from paritas.queries.catalogue import QUERIES, SQL

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    df = QUERIES[name](spark, small)
    found = rows(df)
    assert found == Counter(con.sql(f"SELECT {', '.join(df.columns)} FROM ({SQL[name]})").fetchall())
    return found


def test_genomes_of_whole_tables_with_relationships(spark, small):
    distance = dict(same_as_twin(spark, small, "prof_genome_distance_legacy").keys())
    assert len(distance) == 8 and all(0 < distance[m] < 1 for m in ("relationship", "temporal", "distribution", "invariant"))
    assert same_as_twin(spark, small, "prof_findings_relationships")


def test_genome_summary_counts_and_removed_transactions(spark, small):
    known = profile.genome({"t": spark.range(3)}, ["i"], {"t.id": 0.6, "t": 0.5, "a": 0.9}, ["e1", "e2"])
    s = profile.genome_summary(known).collect()[0]
    assert (s["invariant_count"], s["evidence_count"], s["uncertain_components"]) == (1, 2, ["a", "t.id"])
    assert s["fingerprint"] != profile.genome_summary(profile.genome({"t": spark.range(3)})).collect()[0]["fingerprint"]
    t = spark.createDataFrame([("1", "A", 5.0), ("2", "A", 1.0), ("3", "B", 2.0), ("4", None, 2.0), ("5", None, 2.0)], "id string, account_id string, amount double")
    assert [rows(whatif.touched_transactions(t, "id", i)) for i in ("1", "3", "4", "9")] == [Counter([("2",)]), Counter(), Counter([("5",)]), Counter()]
    same, other = (whatif.fingerprints_without(t, "id", i).collect()[0] for i in ("9", "1"))
    assert same["before"] == same["after"] == other["before"] != other["after"]
    assert other["after"] == whatif.fingerprints_without(t.where("id <> '1'"), "id", "1").collect()[0]["before"]


def test_all_orders_are_upserted(spark, small):
    found = same_as_twin(spark, small, "load_upsert_all")
    placed = {k for k, n, _ in found if n is not None}
    assert placed == {r[0] for r in spark.read.parquet(f"{small}/orders.parquet").select("o_custkey").collect()}
    assert any(n is None for _, n, _ in found)


# --- transformation language ------------------------------------------------------------------------------------------


def values(spark, expression, data, schema="x string"):
    df = spark.createDataFrame(data, schema)
    c = dsl.compile_expression(expression, dict(df.dtypes))
    return [tuple(r) for r in df.select(c.value.alias("v"), c.error.isNotNull().alias("e"), c.warning.alias("w")).collect()]


def test_dsl_values(spark):
    assert values(spark, "TRIM(source.x)", [("\t a b  ",), (None,)]) == [("a b", False, None), (None, False, "NULL_INPUT")]
    assert values(spark, "UPPER(source.x)", [(" straße ",)])[0][0] == "STRASSE"
    assert values(spark, "LOWER(source.nothing)", [("A",)]) == [(None, False, "NULL_INPUT")]
    dates = [("2020-12-31",), ("31/02/2020",), ("",), (None,), ("2020-1-2",)]
    assert values(spark, "PARSE_DATE(source.x)", dates) == [("2020-12-31", False, None), (None, True, None), (None, False, "NULL_INPUT"), (None, False, "NULL_INPUT"), ("2020-01-02", False, None)]
    assert values(spark, 'PARSE_DATE(source.x, "DD/MM/YYYY")', [("1/2/2020",), ("31/02/1988",)]) == [("2020-02-01", False, None), (None, True, None)]
    assert values(spark, 'PARSE_DATE(source.x, "%Y%m%d")', [("20200131",)])[0][1] in (True, False)
    numbers = [("12.3456",), ("2.345",), ("2.355",), ("x",), ("",), ("Infinity",), ("1e2",), ("9" * 30,)]
    got = values(spark, "DECIMAL(source.x, scale=2)", numbers)
    assert [g[0] for g in got] == ["12.35", "2.34", "2.36", None, None, None, "100.00", None]
    assert [g[1] for g in got] == [False, False, False, True, False, True, False, True]
    names = values(spark, "SPLIT_NAME(source.x)", [("Ann  Lee Jr",), (" ",), (None,), ("Cher",)])
    assert [tuple(v) for v, _, _ in names] == [("Ann", "Lee Jr"), ("", ""), ("", ""), ("Cher", "")]
    money = values(spark, 'NORMALIZE_CURRENCY(source.a, source.c, rates={"EUR": 1.1})', [("10", "eur"), ("10", "xxx"), ("bad", "EUR"), (None, "EUR"), ("1", "")], "a string, c string")
    assert [m[0] for m in money] == ["11.0000", "10.0000", None, None, None] and [m[1] for m in money] == [False, False, True, False, False]
    assert values(spark, 'COALESCE(source.a, source.b, "z")', [("", "b"), (None, "")], "a string, b string") == [("b", False, None), ("z", False, None)]
    assert values(spark, 'MAP_ENUM(source.x, {"1": "one"})', [("1",), ("2",), (None,)]) == [("one", False, None), (None, False, None), (None, False, None)]


@pytest.mark.parametrize("bad", ["", "DROP(source.x)", "TRIM(source.x", "TRIM(UPPER(source.x))", "TRIM(source.x) x", "TRIM()", "TRIM;source.x)", 'PARSE_DATE(source.x, "%Q")'])
def test_dsl_refuses(bad):
    with pytest.raises(dsl.DslError):
        dsl.compile_expression(bad, {"x": "string"})


def test_every_row_is_loaded_or_quarantined(spark):
    df = spark.createDataFrame([(1, "2020-01-01", "1"), (2, "bad", "x"), (3, None, "x"), (4, "2020-01-02", "2")], "id int, d string, m string")
    good, bad = dsl.transform(df, {"d": "PARSE_DATE(source.d)", "m2": "DECIMAL(source.m, scale=1)"})
    assert {r["id"]: (r["d"], r["m2"], r["m"]) for r in good.collect()} == {1: ("2020-01-01", "1.0", "1"), 4: ("2020-01-02", "2.0", "2")}
    assert {r["id"]: r["failed_field"] for r in bad.collect()} == {2: "d", 3: "m2"}
    lineage = good.where("id = 1").select("_par_lineage").collect()[0][0]
    assert [(x["field"], x["operation"], x["inputs"]) for x in lineage] == [("d", "PARSE_DATE", ["d"]), ("m2", "DECIMAL", ["m"])]


# --- digests and reconciliation ---------------------------------------------------------------------------------------


def sha(text):
    import hashlib

    return hashlib.sha256(json.dumps(text, ensure_ascii=False).encode()).hexdigest()


def root(leaves):
    nodes = list(leaves) or [sha("")]
    while len(nodes) > 1:
        nodes += nodes[-1:] * (len(nodes) % 2)
        nodes = [sha(a + b) for a, b in zip(nodes[::2], nodes[1::2], strict=True)]
    return nodes[0]


def test_digests(spark):
    texts = ["a", "", 'q"uo\\te', "ß\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    got = [tuple(r) for r in df.select(sha256_text(F.col("x")), bucket(F.col("x"), 16)).collect()]
    assert [g[0] for g in got] == [sha(t) if t is not None else None for t in texts]
    assert [g[1] for g in got] == [int(sha("None" if t is None else t)[:8], 16) % 16 for t in texts]
    lists = [[f"{i:x}" for i in range(n)] for n in (0, 1, 2, 3, 5, 8, 17)]
    made = spark.createDataFrame([(x,) for x in lists], "l array<string>").select(merkle_root(F.col("l"))).collect()
    assert [m[0] for m in made] == [root(x) for x in lists]


@FEW
@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["x", "y", None])), max_size=8), st.lists(st.tuples(st.integers(0, 5), st.sampled_from(["x", "y", None])), max_size=8))
def test_roots_are_equal_exactly_for_equal_rows(spark, a, b):
    left, right = (spark.createDataFrame(x, "id int, v string") for x in (a, b))
    for parts in (1, 3):
        m = [reconcile.merkle_buckets(df, "id", ["id", "v"], 4, parts).collect() for df in (left, right)]
        assert ({(r["bucket"], r["root"]) for r in m[0]} == {(r["bucket"], r["root"]) for r in m[1]}) == (Counter(a) == Counter(b))
        assert sum(r["n"] for r in m[0]) == len(a)


def test_a_root_is_that_of_one_tree_at_any_size(spark):
    df = spark.range(2 * reconcile.LEAVES + 3)
    digests = df.select(F.col("id").cast("string").alias("k"), row_fingerprint(["id"]).alias("h")).collect()
    expected = root([h for _, h in sorted(map(tuple, digests))])
    assert [reconcile.merkle_buckets(df, "id", ["id"], 1, parts).collect()[0]["root"] for parts in (None, 5)] == [expected] * 2
    sizes = (1, 2, 3, 4, 5, 15, 16, 17, 21, 65)
    digest = {n: [sha(f"{n}.{i}") for i in range(n)] for n in sizes}
    nodes = [(n, bytearray.fromhex(h), 1, i, n) for n in sizes for i, h in enumerate(digest[n])]
    folded = reconcile._folded(spark.createDataFrame(nodes, "bucket int, h binary, n long, at long, size long"), max(sizes), 2)
    assert {(r["bucket"], r["n"], bytes(r["h"]).hex()) for r in folded.collect()} == {(n, n, root(digest[n])) for n in sizes}


def test_reconcile(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).cast("double").alias("amount"), F.lit("s").alias("_par_x"))
    assert reconcile.reconcile(df, df.withColumn("_par_x", F.lit("t")), "id", ["amount"]).collect()[0]["passed"]
    r = reconcile.reconcile(df, df.where("id <> 2"), "id", ["amount"]).collect()[0]
    assert (r["passed"], r["missing"], r["earliest"], r["deltas"]["amount.sum"]) == (False, 1, "2", -2.0)
    assert not reconcile.reconcile(df.unionAll(df.limit(1)), df, "id").collect()[0]["passed"]
    nan = df.withColumn("amount", F.when(F.col("id") == 1, float("nan")).otherwise(F.col("amount")))
    assert not reconcile.reconcile(df, nan, "id", ["amount"]).collect()[0]["passed"]
    empty = reconcile.reconcile(df.limit(0), df.limit(0), "id", ["amount"]).collect()[0]
    assert empty["passed"] and empty["source_count"] == 0
    ref = reconcile.Reference("id", spark.range(49), "id")
    assert reconcile.reconcile(df, df, "id", references=[ref]).collect()[0]["referential_errors"] == 1
    changed = df.withColumn("amount", F.when(F.col("id") == 9, 1.5).otherwise(F.col("amount")))
    assert rows(reconcile.compare_keys(df, changed, "id")) == Counter([("9", "mismatch")])
    assert len(reconcile.differing_buckets(df, changed, "id", ["id", "amount"], 8).collect()) == 1
    keyless = spark.createDataFrame([(None, 1), (None, 2)], "id int, v int")
    assert rows(reconcile.compare_keys(keyless, keyless, "id")) == Counter([("None", "duplicate")])


def test_key_and_row_hash_tell_different_things(spark):
    df = spark.range(20).withColumn("v", F.lit(1))
    a = reconcile.key_and_row_hash(df, "id", ["id", "v"]).collect()[0]
    b = reconcile.key_and_row_hash(df.withColumn("v", F.lit(2)), "id", ["id", "v"]).collect()[0]
    assert a["n"] == 20 and a["key_hash"] == b["key_hash"] and a["row_hash"] != b["row_hash"]


def test_key_and_row_hash_is_a_query_without_a_list_of_all_rows(spark, small, monkeypatch):
    """The query is the operator's own path, in one bucket folded in blocks: with blocks of 16 leaves it is the same."""
    from paritas.queries.catalogue import QUERIES

    calls, operator, fold = [], reconcile.key_and_row_hash, reconcile._folded
    monkeypatch.setattr(reconcile, "key_and_row_hash", lambda *a: calls.append(a) or operator(*a))
    expected = rows(QUERIES["rec_key_and_row_hash"](spark, small))
    assert len(calls) == 2
    monkeypatch.setattr(reconcile, "_folded", lambda nodes, largest: fold(nodes, largest, 4))
    assert rows(QUERIES["rec_key_and_row_hash"](spark, small)) == expected


def test_invariants(spark):
    data = [(1, 10.0, 5.0, 3.0, 0.0, 12.0), (2, 10.0, 5.0, 3.0, 0.0, 12.1), (3, None, 5.0, 3.0, 0.0, 12.0), (4, 1e12, 0.0, 0.0, 0.0, 1e12 + 100)]
    df = spark.createDataFrame(data, "id int, opening_balance double, credits double, debits double, adjustments double, closing_balance double")
    assert {(r["k"], r["reason"]) for r in reconcile.invariant_failures(df, "id").collect()} == {("2", "balance invariant"), ("3", "non-numeric balance fields")}
    assert len(reconcile.invariant_failures(df, "id", relative=0.0).collect()) == 3
    assert reconcile.invariant_failures(df.drop("debits"), "id").collect() == []


def test_meanings(spark):
    pairs = [("2026-08-21 10:00:00", "2026-08-21T10:00:00Z"), ("10.0", " 10"), ("-0", "0.00"), ("A  b C", "a b c"), ("STRASSE", "straße"), (".5", "0.50")]
    df = spark.createDataFrame(pairs, "a string, b string").select(normalize_scalar(F.col("a"), "string").alias("a"), normalize_scalar(F.col("b"), "string").alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())
    number = spark.createDataFrame([(10,)], "n int").select(normalize_scalar(F.col("n"), "int")).collect()[0][0]
    assert number == "10"


# --- profiles ---------------------------------------------------------------------------------------------------------


def test_profile_of_hard_columns(spark):
    df = spark.createDataFrame([(9, "a", None, True), (10, "a", None, None), (None, "b", None, True)], "id int, value string, n double, column_name boolean")
    p = {r["column_name"]: r for r in profile.profile_table(df).collect()}
    assert (p["id"]["min_value"], p["id"]["max_value"], p["id"]["null_count"], p["id"]["data_type"]) == ("9", "10", 1, "integer")
    assert [tuple(x) for x in p["value"]["top_values"]] == [("a", 2), ("b", 1)]
    assert p["n"]["data_type"] == "unknown" and p["n"]["distinct_count"] == 0 and p["column_name"]["data_type"] == "boolean"
    assert all(r["row_count"] == 0 for r in profile.profile_table(df.limit(0)).collect())


def test_relationships_and_fingerprints(spark):
    c = spark.range(10).select(F.col("id").alias("customer_id"), F.lit("n").alias("name"))
    a = spark.range(20).select(F.col("id").alias("account_id"), (F.col("id") % 8).alias("customer_id"))
    found = {tuple(r)[:4]: r["confidence"] for r in profile.relationships({"customers": c, "accounts": a}).collect()}
    assert found[("accounts", "customer_id", "customers", "customer_id")] == pytest.approx(1.0)
    one, two = (profile.schema_fingerprint({"c": x}).collect()[0]["digest"] for x in (c, c.limit(9)))
    assert one != two
    a_ = profile.genome_summary(profile.genome({"c": c, "a": a})).collect()[0]
    b_ = profile.genome_summary(profile.genome({"c": c.unionAll(c), "a": a})).collect()[0]
    assert (a_["entity_count"], a_["column_count"], a_["row_count"], b_["row_count"]) == (2, 4, 30, 40) and a_["relationship_count"] >= 1
    assert a_["fingerprint"] == b_["fingerprint"]


# --- changes ----------------------------------------------------------------------------------------------------------

EVENT = "event_id string, table_name string, primary_key string, operation string, after string, sequence long"


def apply(events):
    state, seen = {}, set()
    for e in sorted(events, key=lambda e: (e[5], e[0])):
        if e[0] in seen:
            continue
        seen.add(e[0])
        if e[3] == "DELETE":
            state.pop((e[1], e[2]), None)
        elif e[4] is not None:
            state[e[1], e[2]] = e[4]
    return {(*k, v) for k, v in state.items()}


def some_events(seed, n=60):
    rng = random.Random(seed)
    out = [(str(i), rng.choice("tu"), rng.choice("abc"), rng.choice(cdc.OPERATIONS), rng.choice(['{"x":1}', '{"x":2}', None]), rng.randint(0, 40)) for i in range(n)]
    return out + rng.sample(out, 10)


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_is_the_fold_in_any_order_and_twice(spark, seed):
    events = some_events(seed)
    df = spark.createDataFrame(events, EVENT)
    state = cdc.replay(None, df, strict=False)
    assert set(map(tuple, state.collect())) == apply(events)
    again = cdc.replay(state, governance.reorder(df, seed), strict=False)
    assert set(map(tuple, again.collect())) == apply(events)
    seqs = {t: sorted({e[5] for e in events if e[1] == t}) for t in "tu"}
    gaps = {(t, a + 1, b - 1) for t, s in seqs.items() for a, b in zip(s, s[1:], strict=False) if b > a + 1}
    for width in (3, 1000):
        assert set(map(tuple, cdc.gaps(df, width=width).collect())) == gaps


def test_strict_replay_fails_without_an_image(spark):
    df = spark.createDataFrame([("1", "t", "a", "INSERT", None, 1)], EVENT)
    with pytest.raises(Exception, match="no after image"):
        cdc.replay(None, df).collect()
    with pytest.raises(Exception, match="unknown operation"):
        cdc.normalize_events(df.withColumn("operation", F.lit("UPSERT"))).collect()


def test_stream_keeps_the_state_of_the_batch(spark, tmp_path):
    from paritas.streaming.cdc import apply_changes, compact, current_rows, gap_stream

    events, at = some_events(5), str(tmp_path)
    for i in range(0, len(events), 25):  # three files, out of order and with repeats across them
        spark.createDataFrame(events[i : i + 25], EVENT).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{at}/in")
        apply_changes(stream, f"{at}/state", f"{at}/checkpoint").awaitTermination()
        if i == 25:
            compact(spark, f"{at}/state")
    assert set(map(tuple, current_rows(spark, f"{at}/state").collect())) == apply(events)
    compact(spark, f"{at}/state")
    assert set(map(tuple, current_rows(spark, f"{at}/state").collect())) == apply(events)
    assert [x for x in os.listdir(f"{at}/state")] == ["base-2"]
    assert current_rows(spark, f"{at}/none").count() == 0

    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    q = gap_stream(stream).writeStream.format("memory").queryName("gaps").option("checkpointLocation", f"{at}/g").trigger(availableNow=True).start()
    q.awaitTermination()
    log = spark.table("gaps").collect()
    left = Counter((r["table_name"], r["first"], r["last"]) for r in log if r["state"] == "open")
    left.subtract((r["table_name"], r["first"], r["last"]) for r in log if r["state"] == "closed")
    firsts = {t: next(e[5] for e in events[:25] if e[1] == t) for t in "tu"}
    assert all(n >= 0 for n in left.values()) and firsts
    present = {(e[1], e[5]) for e in events}
    assert all((t, s) not in present for (t, a, b), n in left.items() if n for s in range(a, b + 1))


def test_stream_deduplicates(spark, tmp_path):
    from paritas.streaming.cdc import deduplicated_stream

    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "event_id string, s long").withColumn("at", F.timestamp_seconds("s"))
    df.write.parquet(f"{tmp_path}/in")
    out = deduplicated_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "at")
    out.writeStream.format("memory").queryName("dedup").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("dedup").count() == 2


# --- loading ----------------------------------------------------------------------------------------------------------


def test_upsert_and_batches(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "id int, v string")
    batch = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1), (None, "m", 1)], "id int, v string, o int")
    one = load.upsert(target, batch, "id", [F.col("o")])
    assert {(r["id"], r["v"]) for r in one.collect()} == {(1, "a"), (2, "y"), (3, "z"), (None, "m")}
    assert rows(load.upsert(one, batch, "id", [F.col("o")])) == rows(one)
    numbered = load.batches(spark.range(1003), ["id"], 100).collect()
    assert all(r["batch"] == r["id"] // 100 for r in numbered) and len(numbered) == 1003


def test_engine_quarantines_and_resumes(spark, tmp_path):
    engine = migration.Engine(spark, str(tmp_path))
    df = spark.createDataFrame([(1, "2020-01-01"), (2, "bad"), (1, "2020-01-03")], "id int, d string")
    done = engine.migrate("m", "t", df, "id", [F.col("d")], {"d": "PARSE_DATE(source.d)"})
    assert (done["loaded"], done["failed"]) == (2, 1)
    assert [(r["id"], r["d"]) for r in engine.read("t").collect()] == [(1, "2020-01-03")]
    assert engine.migrate("m", "t", df, "id", [F.col("d")])["skipped"]
    engine.migrate("m2", "t", df.where("id = 2"), "id", [F.col("d")])
    assert engine.read("t").count() == 2 and spark.read.parquet(f"{tmp_path}/quarantine/t").count() == 1
    store = sinks.VersionedTable(spark, f"{tmp_path}/tables/t")
    store.rollback()
    assert engine.read("t").count() == 1


def test_engine_loads_in_batches_pauses_and_resumes(spark, tmp_path):
    """Five rows, two a batch: paused after one, then the rest; a finished run changes nothing."""
    engine = migration.Engine(spark, str(tmp_path))
    df = spark.createDataFrame([(str(i), f"{i}" if i != 3 else "bad") for i in range(5)], "id string, value string")
    load_ = lambda **x: engine.migrate("m", "t", df, "id", [F.col("value")], {"value": "DECIMAL(source.value, scale=0)"}, batch_size=2, **x)
    one = load_(stop_after=1)
    assert one == {"state": "PAUSED", "skipped": False, "loaded": 2, "failed": 0, "checkpoint": 0} and engine.read("t").count() == 2
    two = load_()
    assert two == {"state": "COMPLETE", "skipped": False, "loaded": 2, "failed": 1, "checkpoint": 2} and engine.read("t").count() == 4
    assert load_()["skipped"] and engine.read("t").count() == 4
    points = {r["batch"]: (r["loaded"], r["failed"], r["checksum"] is not None, r["append_no"]) for r in engine.checkpoints().collect()}
    assert points == {0: (2, 0, True, 0), 1: (1, 1, True, 1), 2: (1, 0, True, 2)}
    assert load.latest_checkpoint(engine.checkpoints()).collect()[0]["batch"] == 2
    moves = [r["new_state"] for r in engine.log().orderBy("entry_no").collect()]
    assert moves == ["VALIDATING", "PLANNED", "APPROVED", "RUNNING", "PAUSED", "RECOVERING", "RUNNING", "RECONCILING", "VERIFIED", "COMPLETE"]
    fresh = migration.Engine(spark, f"{tmp_path}/other")
    assert fresh.migrate("m", "t", df.limit(0), "id", [F.col("value")])["state"] == "COMPLETE"


def test_two_writers_take_two_versions(spark, tmp_path):
    store = sinks.VersionedTable(spark, f"{tmp_path}/v")
    assert store.write(spark.range(1)) == 0
    open(f"{tmp_path}/v/claim-1", "w").close()  # another writer is at work, or was lost
    assert store.write(spark.range(2)) == 2 and store.read().count() == 2


def test_meanings_of_numbers_and_letters(spark):
    from decimal import Decimal
    from paritas.functions.semantic import _foldings, casefold, plain_number

    texts = ["10", "10.0", "+1.0E1", "-0", "0e9", "1e-13", "0.0000000000001", "1.00000000000049", "-.50", "5.", "1e99", "1E-99", "12345678901234567890123456789012345678901234567890.5", "1e99999999999999999999", "x", "", None, "1e", "--1"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(plain_number(F.col("t"))).collect()]
    for t, g in zip(texts, got, strict=True):
        if t in ("x", "", None, "1e", "--1", "1e99999999999999999999"):
            assert g is None
        else:
            assert Decimal(g) == Decimal(t)
    assert got[0] == got[1] == got[2] == "10" and got[3] == got[4] == "0" and got[10] == "1E+99" and got[11] == "1E-99"
    one, _, several = _foldings()
    letters = [*one, *several, "Straße ΣΊΣΥΦΟΣ ﬃ İ", "plain", ""]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(letters)], "i int, x string").orderBy("i").select(casefold(F.col("x"))).collect()]
    assert got == [x.casefold() for x in letters]


def test_late_events_go_to_quarantine(spark, tmp_path):
    from paritas.streaming.cdc import deduplicate_to

    folder, schema = f"{tmp_path}/in", "event_id string, at timestamp, v int"
    feed = [[("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-03 00:00:00", 2)], [("c", "2024-01-01 00:00:00", 3), ("b", "2024-01-03 00:00:00", 2), ("d", None, 4), ("e", "2024-01-02 12:00:00", 5)]]
    for i, part in enumerate(feed):
        spark.createDataFrame(part, "event_id string, at string, v int").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(f"{folder}/f{i}")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/*")
        deduplicate_to(stream, f"{tmp_path}/out", f"{tmp_path}/check", "at").awaitTermination()
    read = lambda kind: sorted(r["event_id"] for r in spark.read.schema(schema).parquet(f"{tmp_path}/out/{kind}/*").collect())
    assert read("accepted") == ["a", "b", "d", "e"] and read("quarantine") == ["c"]


def test_plans(spark):
    p = migration.build_plan({"customers": 1, "accounts": 2, "transactions": 3001}, [("customers", "accounts"), ("accounts", "transactions")])
    assert p.nodes == ["customers", "accounts", "transactions"] and p.batches == 6 and p.bytes == 3004 * 180
    for bad in ([("a", "b"), ("b", "a")], [("a", "x")]):
        with pytest.raises(migration.PlanError):
            migration.table_order(["a", "b"], bad)
    m = migration.Mapping("s", "x", "t", "y", "UPPER(source.x)")
    ir = migration.compile_ir("v1", "v2", [m], risk=0.6)
    assert ir.approvals_required == ("cutover",)
    assert [tuple(r) for r in ir.select(spark.createDataFrame([("a",)], "x string"), "s", "t").collect()] == [("A",)]
    other = migration.compile_ir("v1", "v2", [migration.Mapping("s", "x", "t", "y", "TRIM(source.x)")])
    # The other form has another expression, and no risk that asks for an approval.
    assert rows(migration.diff_ir(spark, ir, other).select("part", "name")) == Counter([("mapping", "s.x"), ("form", "risk"), ("form", "approvals_required")])
    assert migration.diff_ir(spark, ir, ir).count() == 0
    limited = migration.compile_ir("v1", "v2", [m], risk=0.6, resource_limits={"workers": 2}, constraints=("x > 0",))
    assert rows(migration.diff_ir(spark, ir, limited).select("name")) == Counter([("resource_limits",), ("constraints",)])


# --- sources and sinks ------------------------------------------------------------------------------------------------


def test_file_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,\n2,x\n")
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n{"id": 2, "w": null}\n')
    (tmp_path / "c.json").write_text('[{"id": 1, "v": "x"}]')
    (tmp_path / "d.json").write_text('{"k1": {"id": 1}, "k2": {"id": 2}}')
    (tmp_path / "c.csv").write_text("other\n1\n")
    (tmp_path / "note.txt").write_text("no table")
    s = files.FileSource(spark, str(tmp_path))
    assert s.tables() == ["a", "b", "c", "d"]
    assert rows(s.read("a")) == Counter([("1", ""), ("2", "x")])
    assert [s.read(t).count() for t in "bcd"] == [2, 1, 2] and s.schema()["c"] == ["id", "v"]
    with pytest.raises(files.SourceError):
        s.read("z")
    options = files.database_options("jdbc:sqlserver://h", "t_1", "id", 0, 100)
    assert options["dbtable"] == "[t_1]" and options["numPartitions"] == "8"
    with pytest.raises(sinks.SinkError):
        files.database_options("jdbc:postgresql://h", "t; drop")
    assert "WHEN MATCHED" not in sinks.merge_statement("t", ["id"], "id") and "UPDATE SET" in sinks.merge_statement("t", ["id", "v"], "id")


def test_staged_upsert_statements():
    make, put, merge = sinks.staged_statements("t", ["v", "id"], "id")
    assert make == 'CREATE TEMPORARY TABLE "t_stage" AS SELECT "id", "v" FROM "t" WHERE 1 = 0;' and put == 'INSERT INTO "t_stage" ("id", "v") VALUES (%s, %s);'
    assert merge.startswith('MERGE INTO "t" AS t USING "t_stage" AS s ON t."id" = s."id" WHEN MATCHED THEN UPDATE SET "v" = s."v"')
    make, put, merge = sinks.staged_statements("t", ["v", "id"], "id", "sqlserver")
    assert "#t_stage" in make and "(?, ?)" in put and "USING #t_stage AS s" in merge
    with pytest.raises(sinks.SinkError):
        sinks.staged_statements("t; drop", ["id"], "id")


def test_upsert_into_a_database_merges_once_a_partition(spark, tmp_path):
    class Table:
        """A database of one table for one test, in files: what is executed, and what is put."""

        def __init__(self, folder):
            self.folder = folder

        def __call__(self):
            import uuid

            self.log = open(f"{self.folder}/{uuid.uuid4().hex}", "w")
            return self

        def cursor(self):
            return self

        def execute(self, statement):
            print(statement.split()[0], file=self.log)

        def executemany(self, statement, rows):
            print("ROWS", len(rows), file=self.log)

        def commit(self):
            print("COMMIT", file=self.log)

        def close(self):
            self.log.close()

    df = spark.range(250).withColumn("v", F.lit("x"))
    sinks.upsert_database(df, Table(str(tmp_path)), "t", "id", batch=40)
    logs = [p.read_text().split("\n") for p in tmp_path.iterdir()]
    assert logs and all(x[0] == "CREATE" and x[-3:-1] == ["MERGE", "COMMIT"] and x.count("MERGE") == 1 for x in logs)
    assert sum(int(line.split()[1]) for x in logs for line in x if line.startswith("ROWS")) == 250


def test_snapshots_and_logs(spark, tmp_path):
    root_ = f"{tmp_path}/s"
    one = sinks.put_snapshot(spark, root_, "p", {"b": 1, "a": 2})
    assert one == sinks.put_snapshot(spark, root_, "p", {"a": 2, "b": 1}) and sinks.list_snapshots(spark, root_) == [one]
    assert json.loads(sinks.get_snapshot(spark, root_, one).collect()[0]["payload"]) == {"a": 2, "b": 1}
    assert sinks.read_json_log(spark, f"{tmp_path}/none", "a int").count() == 0


def test_synthetic_bank(spark):
    bank = synthetic.legacy_bank(spark, customers=46, accounts=2, transactions=3)
    n = {t: df.count() for t, df in bank.items()}
    assert n == {"legacy_customers": 48, "legacy_accounts": 92, "legacy_transactions": 277, "legacy_beneficiaries": 92, "legacy_risk_events": 6}
    assert reconcile.invariant_failures(bank["legacy_accounts"], "acct_no").count() == 0
    orphans = reconcile.referential_errors(bank["legacy_transactions"], F.col("txn_id"), F.col("acct_ref"), bank["legacy_accounts"], F.col("acct_no"))
    assert [r["child_key"] for r in orphans.collect()] == ["T-ORPHAN"]
    assert rows(bank["legacy_customers"]) == rows(synthetic.legacy_bank(spark, customers=46)["legacy_customers"])


# --- the rest ---------------------------------------------------------------------------------------------------------


def test_times_evidence_and_what_if(spark):
    r = spark.createDataFrame([("a", "2024-01-01T00:00:00Z"), ("b", "2024-02-01"), ("a", "2024-03-01")], "record_id string, knowledge_time string")
    known = temporal.as_of(r, "2024-01-15")
    assert rows(known.select("record_id")) == Counter([("a",)])
    assert rows(temporal.knowledge_delta(r, known)) == Counter([("b", "newly_known")])
    e = spark.createDataFrame([("x", "OK", 0.9, "2020-01-01 00:00:00", None)], "evidence_id string, status string, confidence double, created_at string, last_verified_at string")
    e = e.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "last_verified_at")})
    assert evidence.refreshed(e, "2020-01-31 00:00:00").collect()[0]["decayed_confidence"] == pytest.approx(0.45)
    assert evidence.refreshed(e, "2019-01-01 00:00:00").collect()[0]["decayed_confidence"] == pytest.approx(0.9)
    row, marked = evidence.conflict(e, spark.createDataFrame([("x",), ("?",)], "evidence_id string"))
    assert row.collect()[0]["claims"] == 1 and marked.collect()[0]["status"] == "CONTRADICTED"
    t = spark.createDataFrame([("1", "A", "5"), ("2", "A", "7"), ("3", "B", "bad")], "id string, account_id string, amount string")
    assert [tuple(x) for x in whatif.remove_transaction(t, "id", 1).collect()] == [("1", "A", -5.0, 1)]
    assert [tuple(x) for x in whatif.remove_transaction(t, "id", "3").collect()] == [("3", "B", 0.0, 0)]
    assert whatif.remove_transaction(t, "id", "9").collect() == []


def test_evidence_is_checked_superseded_and_ranked(spark):
    r = spark.createDataFrame([("a", "s", 0.9, "2020-01-01", None), ("b", "t", 0.4, "2020-01-01", None), ("c", None, None, None, None)], "evidence_id string, subject string, confidence double, created_at string, last_verified_at string")
    r = r.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "last_verified_at")})
    checks = spark.createDataFrame([("b", "2020-01-31", 0.8), ("b", "2020-01-15", 0.1), ("b", "2020-01-31", None), ("?", "2020-01-31", 1.0)], "evidence_id string, verified_at string, confidence double").withColumn("verified_at", F.col("verified_at").cast("timestamp"))
    ranked = evidence.by_confidence(evidence.verified(r, checks), "2020-01-31 00:00:00").collect()
    assert [(x["evidence_id"], x["decayed_confidence"]) for x in ranked] == [("b", pytest.approx(0.8)), ("a", pytest.approx(0.45)), ("c", None)]
    assert [x["evidence_id"] for x in evidence.of_subjects(r, spark.createDataFrame([("s",), (None,)], "subject string")).collect()] == ["a"]
    out = evidence.superseded(r, checks.select("evidence_id", F.col("verified_at").alias("at"))).collect()
    assert {x["evidence_id"]: str(x["superseded_at"])[:10] for x in out} == {"a": "None", "b": "2020-01-15", "c": "None"}
    assert evidence.verified(r, checks.limit(0)).count() == 3


def test_assumptions_and_what_depends_on_them(spark):
    held = spark.createDataFrame([("a", 0.98, "INFERRED"), ("b", 0.5, "INFERRED"), ("c", 2.0, "INFERRED"), ("d", None, None)], "assumption_id string, confidence double, status string")
    told = [("a", 1, "validated"), ("b", 1, "validated"), ("b", 2, "contradicted"), ("b", 3, "validated"), ("a", 0, "contradicted"), ("d", 1, "contradicted"), ("x", 1, "validated"), ("c", 1, None)]
    states = evidence.assumption_states(held, spark.createDataFrame(told, "assumption_id string, event_no int, kind string"))
    got = {r["assumption_id"]: (r["confidence"], r["status"]) for r in states.collect()}
    assert got == {"a": (0.05, "VALIDATED"), "b": (0.05, "VALIDATED"), "c": (None, "INFERRED"), "d": (0.0, "INVALIDATED")}
    depends = spark.createDataFrame([("d", "r"), ("d", "r"), ("a", "q")], "assumption_id string, result_id string")
    assert rows(evidence.affected_results(states, depends)) == Counter([("d", "r")])


def test_a_chained_log_of_the_engine_is_verified(spark, tmp_path):
    engine = migration.Engine(spark, str(tmp_path))
    engine.migrate("m", "t", spark.range(5).withColumn("v", F.col("id")), "id", [F.col("id")])
    log = engine.log()
    assert log.count() == 7 and evidence.verify_chain(log).count() == 0
    assert governance.state_moves(log.select("migration_id", "entry_no", "new_state")).where("not allowed").count() == 0
    broken = log.withColumn("reason", F.when(F.col("entry_no") == 3, "other").otherwise(F.col("reason")))
    assert rows(evidence.verify_chain(broken).select("entry_no", "fault")) == Counter([(3, "entry hash mismatch")])


def test_scores_and_governance(spark):
    gates = spark.createDataFrame([("m", "g", True, False)], "migration_id string, name string, passed boolean, required boolean")
    assert scores.certify(gates).collect()[0]["status"] == "NOT_CERTIFIED"
    flags = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    assert [r[0] for r in flags.select(scores.run_status(F.col("a"), F.col("b"), F.lit(True), F.lit(True))).collect()] == ["PASSED", "INCONCLUSIVE", "INCONCLUSIVE"]
    log = spark.createDataFrame([("m", 0, "VALIDATING"), ("m", 1, "CUTOVER"), ("m", 2, None), ("n", 0, "ABORTED")], "migration_id string, entry_no int, new_state string")
    assert {(r["migration_id"], r["entry_no"]): r["allowed"] for r in governance.state_moves(log).collect()} == {("m", 0): True, ("m", 1): False, ("m", 2): False, ("n", 0): True}
    assert {r["migration_id"]: (r["state"], r["next_states"]) for r in governance.next_states(log).collect()} == {"m": (None, None), "n": ("ABORTED", [])}
    report = "reconciled boolean, cdc_lag long, max_lag long, breaking_change boolean, pii_logging boolean, risk_level string, approved_by string"
    gated = governance.gate(spark.createDataFrame([(False, 1, 0, True, True, "HIGH", None), (True, 0, 0, False, False, "HIGH", "x"), (None,) * 7], report)).collect()
    assert [len(r["reasons"]) for r in gated] == [5, 0, 1] and tuple(gated[1]["steps"]) == governance.CUTOVER and gated[0]["steps"] == []
    asked = spark.createDataFrame([("ADMIN", "anything"), ("READ_ONLY", "migrate"), ("READ_ONLY", "report"), ("NOBODY", "report"), (None, None), ("ADMIN", None)], "role string, action string")
    assert rows(governance.permitted(asked).where("allowed").select("role", "action")) == Counter([("ADMIN", "anything"), ("READ_ONLY", "report")])
    told = [("x", 1, "propose", "a"), ("x", 2, "approve", "me"), ("x", 3, "approve", "me"), ("x", 4, "propose", "a"), ("y", 1, "approve", "me"), ("y", 2, "propose", "a"), ("y", 3, "approve", "you"), ("z", 1, None, None)]
    told = spark.createDataFrame(told, "mapping_id string, event_no int, action string, actor string")
    found = {(r["mapping_id"], r["event_no"]): (r["version"], r["status"]) for r in registry.mapping_versions(told).collect()}
    assert found == {("x", 1): (1, "PROPOSED"), ("x", 2): (1, "APPROVED"), ("x", 3): (1, "REFUSED"), ("x", 4): (2, "PROPOSED"), ("y", 1): (0, "REFUSED"), ("y", 2): (1, "PROPOSED"), ("y", 3): (1, "APPROVED")}
    assert rows(registry.approved_mappings(told).select("mapping_id", "version", "approved_by")) == Counter([("y", 1, "you")])
    df = spark.range(1000)
    assert governance.drop_rows(df, "id", 10).count() < 1000 < governance.repeat_rows(df, "id", 10).count()
    assert governance.game_day(spark, 1) == governance.game_day(spark, 1) and governance.game_day(spark, 1)["approvals_required"] == 1
    assert governance.faults(spark).count() == 15 and governance.faults(spark, ("none",)).count() == 0
    assert len({tuple(governance.change_schema(df.withColumn("v", F.lit(1)), s).dtypes) for s in range(3)}) == 3
    m = spark.createDataFrame([("counter", "a", 1, 2.0), ("counter", "a", 2, 3.0), ("gauge", "g", 2, 7.0), ("gauge", "g", 1, 9.0), ("timer", "t", 1, 1.0), ("timer", "t", 2, 4.0), ("timer", "t", 3, None)], "kind string, name string, at int, value double")
    got = {r["kind"]: r for r in governance.measured(m).collect()}
    assert (got["counter"]["value"], got["gauge"]["value"], got["timer"]["n"], got["timer"]["p50"], got["timer"]["mean"]) == (5.0, 7.0, 2, 4.0, 2.5)


def test_command_line(spark, tmp_path, capsys):
    from paritas.cli import COMMANDS, main

    assert len(COMMANDS) == 27
    (tmp_path / "a.json").write_text('[{"id": "1", "amount": 2}, {"id": "2", "amount": 3}]')
    (tmp_path / "b.json").write_text('[{"id": "1", "amount": 2}]')
    a, b = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    assert main(["reconcile", a, a, "--fields", "amount"]) == 0
    assert main(["diagnose", a, b]) == 2
    capsys.readouterr()
    assert main(["plan", '{"x": 3, "y": 5}', "--mappings", '[["y", "x"]]']) == 0
    planned = capsys.readouterr().out
    assert json.loads(planned)["plan"]["nodes"] == ["y", "x"]
    assert main(["chaos", "cdc-gap"]) == 0 and main(["chaos", "none"]) == 2 and main(["incident", "i1", "late rows"]) == 0 and main(["gameday"]) == 0
    told = capsys.readouterr().out
    assert "gap detection and replay" in told and '"observed": "late rows"' in told and '"incidents": 5' in told
    assert main(["profile", str(tmp_path)]) == 0
    assert '"distinct_count": 2' in capsys.readouterr().out
    assert main(["cutover", "--lag", "1"]) == 2 and main(["cutover", "--passed"]) == 0


def test_command_line_prints_whole_tables(spark, tmp_path, capsys):
    from paritas.cli import main

    n = 1203
    (tmp_path / "a.json").write_text(json.dumps([{"id": str(i), "amount": 2} for i in range(n)]))
    (tmp_path / "b.json").write_text('[{"id": "x\\n", "amount": 2}]')
    assert main(["diagnose", str(tmp_path / "a.json"), str(tmp_path / "b.json")]) == 2
    printed = capsys.readouterr().out
    found = json.loads(printed)
    assert Counter(f["finding"] for f in found["findings"]) == {"missing": n, "unexpected": 1} and found["earliest"] == "0"
    assert printed == json.dumps(found, indent=2, ensure_ascii=False) + "\n"
    initial = json.dumps({f"k{i}": {"v": i} for i in range(n)})
    (tmp_path / "initial.json").write_text(initial)
    event = {"event_id": "e", "table": "t", "primary_key": "k1", "operation": "DELETE", "before": None, "after": None, "sequence": 1}
    (tmp_path / "log.json").write_text(json.dumps([event]))
    assert main(["replay", str(tmp_path / "initial.json"), str(tmp_path / "log.json")]) == 0
    printed = capsys.readouterr().out
    assert len(json.loads(printed)) == n - 1 and printed == json.dumps(json.loads(printed), indent=2, ensure_ascii=False) + "\n"
    times = {"event_time": "2024-01-01", "data_time": "2024-01-01"}
    (tmp_path / "r.json").write_text(json.dumps([{"record_id": i, **times, "knowledge_time": "2024-01-01" if i < n else "2024-03-01"} for i in range(2 * n)]))
    assert main(["asof", str(tmp_path / "r.json"), "--date", "2024-02-01"]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert [int(r["record_id"]) for r in shown["records"]] == list(range(n)) and len(shown["delta"]) == n
    (tmp_path / "empty.json").write_text('[{"id": "1", "amount": 2}]')
    assert main(["diagnose", str(tmp_path / "empty.json"), str(tmp_path / "empty.json")]) == 0
    assert json.loads(capsys.readouterr().out)["findings"] == []


def test_core_without_the_text_operators():
    """Nothing outside paritas/llm and its tests imports it."""
    code = "import sys; sys.modules['paritas.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p6_ids' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
