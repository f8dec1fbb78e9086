import json

import pytest
from brute import drift
from paritas.operators.schema_drift import Drift, file_fields, record_fields

SCHEMA = "source_id string, table_name string, file_no int, payload string, other string"


def changes(df):
    rows = [tuple(r) for r in df.select("source_id", "file_no", "change_kind", "old_name", "new_name").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_brute_force_on_test_tables(spark, small):
    df = spark.read.parquet(f"{small}/raw_records.parquet")
    rows = [tuple(r) for r in df.select("source_id", "table_name", "file_no", "payload").collect()]
    expected = drift(rows)
    assert expected
    assert changes(Drift(df).changes()) == expected


def feed(files):
    out = []
    for no, records in files.items():
        out += [("s", "legacy_accounts", no, json.dumps(r), "x") for r in records]
    return out


def test_rename_with_type_change_nulls_and_return(spark):
    n = range(6)
    rows = feed(
        {
            1: [{"acct_no": f"A{i}", "a": i, "gone": None} for i in n],
            3: [{"acct_no": f"A{i}", "b": str(i)} for i in n],  # a -> b, integer -> string; gone removed
            4: [{"acct_no": f"A{i}", "b": None, "c": True} for i in n],
            7: [{"acct_no": f"A{i}", "b": 1.5, "c": True, "gone": {"x": [1, 2]}} for i in n],
        }
    )
    rows += [rows[0], (None, None, None, None, None), ("s", "legacy_accounts", 7, "no json", None), ("s", "legacy_accounts", 7, "[1]", None), ("t", "unknown", 1, "{}", None)]
    found = changes(Drift(spark.createDataFrame(rows, SCHEMA)).changes())
    assert found == {
        ("s", 3, "renamed", "a", "b"),
        ("s", 3, "type_changed", "a", "b"),
        ("s", 3, "removed", "gone", ""),
        ("s", 4, "added", "", "c"),
        ("s", 7, "type_changed", "b", "b"),
        ("s", 7, "added", "", "gone"),
    }


def test_types_of_hard_payloads(spark):
    payloads = {
        1: ['{"acct_no":"A","a":12345678901234567890,"b":1e5,"c":1.0,"d":[1, 2.50],"e":null,"f":true,"g":-0}'],
        2: ['{"a":12345678901234567890.0,"b":123456789012345678901234567890123456789012345,"b2" : 12345678901234567890123456789012345678901.5}'],
        3: ['{"a":1,"a":2}', '["a"]', "1", "null", "", " {} ", '{"y":1} x', '{"w":1', None, '  {"Z":"\\u00fc 1.50"}'],
    }
    rows = [("s", "legacy_accounts", no, p, "") for no, ps in payloads.items() for p in ps]
    types = {(r["file_no"], r["field"]): r["type"] for r in file_fields(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert types == {
        (1, None): None, (1, "a"): "integer", (1, "b"): "number", (1, "c"): "number", (1, "d"): "string", (1, "e"): None, (1, "f"): "boolean", (1, "g"): "integer",
        (2, None): None, (2, "a"): "number", (2, "b"): "integer", (2, "b2"): "number", (3, None): None, (3, "Z"): "string", (3, "y"): "integer",
    } | {k: v for k, v in types.items() if k[1] is None}
    texts = {r["field"]: r["text"] for r in record_fields(spark.createDataFrame(rows, SCHEMA)).where("file_no <> 2").collect()}
    assert texts == {"a": "12345678901234567890", "b": "1e5", "c": "1.0", "d": "[1,2.5]", "e": None, "f": "true", "g": "-0", "y": "1", "Z": "\u00fc 1.50"}


def test_a_column_renamed_many_times_keeps_its_type_and_first_name(spark):
    """Ten names, one after another; the type changes only at the end."""
    rows = feed({n: [{"acct_no": f"A{i}", f"n{n}": i + (0.5 if n == 10 else 0)} for i in range(6)] for n in range(1, 10)})
    rows += feed({10: [{"acct_no": f"A{i}", "n9": i + 0.5} for i in range(6)]})
    drift_ = Drift(spark.createDataFrame(rows, SCHEMA))
    assert changes(drift_.changes()) == {("s", n, "renamed", f"n{n - 1}", f"n{n}") for n in range(2, 10)} | {("s", 10, "type_changed", "n9", "n9")}
    assert {r["column_name"] for r in drift_.aliases().collect()} == {"n1"}


def test_empty_and_unified(spark):
    assert changes(Drift(spark.createDataFrame([], SCHEMA)).changes()) == set()
    rows = feed({1: [{"acct_no": f"A{i}", "a": i} for i in range(5)], 2: [{"acct_no": f"A{i}", "b": i} for i in range(5)]})
    out = Drift(spark.createDataFrame(rows, SCHEMA)).unified().collect()
    assert len(out) == 10
    assert {tuple(r["columns"].items()) for r in out} == {(("a", str(i)),) for i in range(5)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_feeds(spark, seed):
    import random

    rng = random.Random(seed)
    rows = []
    for source in ("x", "y", "z"):
        for no in range(1, 8):
            fields = rng.sample("abcdef", rng.randint(0, 5))
            for i in range(8):
                p = {f: rng.choice([None, i, i, f"{i}", i + 0.5]) for f in fields if rng.random() < 0.9}
                rows.append((source, "legacy_accounts", no, json.dumps({"acct_no": f"A{i}", **p}), ""))
    found = changes(Drift(spark.createDataFrame(rows, SCHEMA)).changes())
    assert found == drift([r[:4] for r in rows])
