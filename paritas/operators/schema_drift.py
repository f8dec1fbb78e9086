"""Schemas that drift between the files of a producer: a catalogue of column lifespans.

The fields of every file are exploded with their types into a catalogue of (producer, file, field) rows. Islands of
consecutive files give each field's lifespans; their starts and endings are logged. A start and an ending at the same
file are one renaming when the records of both files agree. Renamed islands are linked to one column, whose types are
compared with lag over its files whatever its names; the same links are the alias table from which casts are made.

Payloads are parsed once for the catalogue, in the JVM, and once more only those of files in which some field leaves while
another comes, for the text of these fields.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritas.session import written

#: The key field of each table's records (fixed values).
KEYS = {
    "legacy_customers": "customer_no",
    "legacy_accounts": "acct_no",
    "legacy_transactions": "txn_id",
    "legacy_beneficiaries": "beneficiary_id",
    "legacy_risk_events": "risk_id",
}

#: A field is renamed when at least MATCHES records have both values and this share of them the same.
MATCHES, SHARE = 5, 0.8

def _parsed() -> Column:
    """The payload as a variant when it is a JSON object, else null."""
    return F.try_parse_json(F.when(F.col("payload").rlike(r"\A\s*\{"), F.col("payload")))


def _filed(records: DataFrame) -> DataFrame:
    """The records that belong to a file."""
    known = records.where(F.col("source_id").isNotNull() & F.col("file_no").isNotNull())
    return known.select("source_id", "table_name", F.col("file_no").cast("int").alias("file_no"), "payload")


def _kind() -> Column:
    """null, boolean, integer, decimal or string: the kind of a value in a payload (columns key, value, payload)."""
    schema = F.schema_of_variant("value")
    # A variant keeps no literal: of numbers that no long holds, a point or an exponent is looked for in the payload.
    literal = F.regexp_substr("payload", F.concat(F.lit('"\\Q'), "key", F.lit('\\E"\\s*:\\s*[-+.0-9eE]+')))
    literal = F.substring_index(literal, ":", -1)
    large = F.when(literal.rlike("[.eE]"), "decimal").otherwise("integer")
    return (
        F.when(schema == "BIGINT", "integer")
        .when(schema == "STRING", "string")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.rlike(r"\ADECIMAL\((19|[23][0-9]),0\)"), large)
        .when(schema.startswith("DECIMAL"), "decimal")
        .when(schema == "DOUBLE", large)
        .otherwise("string")
    )


KINDS = ("boolean", "integer", "decimal", "string")


def file_fields(records: DataFrame, keys: dict[str, str] = KEYS) -> DataFrame:
    """source_id, file_no, field, table_name and the type of each field of each file, the key field left out: the type of a
    file's non-null values, as a schema inference over all of them gives it; null when all are null. A file also has a row
    with a null field, so that one without fields is known. A payload that is null, malformed (the same key twice
    included) or no object has no fields; what follows an object plays no part."""
    key = F.lit(None).cast("string")
    for table, name in keys.items():
        key = F.when(F.col("table_name") == table, name).otherwise(key)
    cells = _filed(records).select("source_id", "table_name", "file_no", key.alias("key_field"), "payload", _parsed().alias("v"))
    cells = cells.lateralJoin(records.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    field = F.when(~F.col("key").eqNullSafe(F.col("key_field")), F.col("key")).alias("field")
    kinds = cells.select("source_id", "table_name", "file_no", field, _kind().alias("kind"))
    # Names of tables are grouped by, not aggregated: numbers alone are aggregated by hashing.
    counted = kinds.groupBy("source_id", "file_no", "table_name", "field").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in KINDS])
    every = counted.withColumn("field", F.explode(F.array_distinct(F.array("field", F.lit(None).cast("string")))))
    n = {k: F.sum(k) for k in KINDS}
    known = n["boolean"] + n["integer"] + n["decimal"] + n["string"]
    kind = (
        F.when(known == 0, F.lit(None).cast("string"))
        .when(n["boolean"] == known, "boolean")
        .when(n["integer"] == known, "integer")
        .when(n["integer"] + n["decimal"] == known, "number")
        .otherwise("string")
    )
    return every.groupBy("source_id", "file_no", "field").agg(kind.alias("type"), F.min("table_name").alias("table_name"))


def lifespans(columns: DataFrame) -> DataFrame:
    """The catalogue, from file_fields: source_id, table_name, file_no, ord, next_file, field, type, starts, ends, start.

    ord numbers the files of a source_id that exist from 1. starts and ends mark the first and last file of an island
    of consecutive files that have the field; start is the ord at which the row's island starts.
    """
    # Every file has a row with a null field; they are few, so all numbering is done over this small catalogue.
    by_file = Window.partitionBy("source_id").orderBy("file_no")
    files = columns.where(F.col("field").isNull()).select(
        "source_id",
        "file_no",
        F.row_number().over(by_file).alias("ord"),
        F.lead("file_no").over(by_file).alias("next_file"),
    )
    life = Window.partitionBy("source_id", "field").orderBy("ord")
    return (
        columns.where(F.col("field").isNotNull())
        .join(files, ["source_id", "file_no"])
        .withColumn("starts", F.coalesce(F.lag("ord").over(life) != F.col("ord") - 1, F.lit(True)))
        .withColumn("ends", F.coalesce(F.lead("ord").over(life) != F.col("ord") + 1, F.lit(True)))
        .withColumn("start", F.max(F.when(F.col("starts"), F.col("ord"))).over(life))
    )


def _literal(value: object, payload: str, name: str) -> str | None:
    """A value as text: a string's content, else the JSON literal, numbers as they stand (they are parsed as text)."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    return json.dumps(json.JSONDecoder().raw_decode(payload.lstrip())[0][name], ensure_ascii=False, separators=(",", ":"))


_DECODER = json.JSONDecoder(parse_int=str, parse_float=str)


def _record(payload: str, key_name: str | None) -> tuple[dict, str | None]:
    """The fields of a payload, and the text of its key field. What follows the object plays no part."""
    fields, _ = _DECODER.raw_decode(payload.lstrip())
    return fields, _literal(fields.pop(key_name, None), payload, key_name)


VALUES = "source_id string, ord int, record_key string, old boolean, field string, text string"


def _wanted_values(keys: dict[str, str]):
    schema = pa.schema([("source_id", pa.string()), ("ord", pa.int32()), ("record_key", pa.string()), ("old", pa.bool_()), ("field", pa.string()), ("text", pa.string())])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of records with the names of leaving and coming fields of their file: those fields that have a value."""
        for batch in batches:
            out = []
            for source, table, payload, ord_, leaving, coming in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields, key = _record(payload, keys.get(table))
                if key is None:
                    continue
                for names, old in ((leaving, True), (coming, False)):
                    for name in names:
                        text = _literal(fields.get(name), payload, name)
                        if text is not None:
                            out.append((source, ord_ + old, key, old, name, text))
            columns = zip(*out, strict=True) if out else ([] for _ in schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return values


FIELDS = "source_id string, table_name string, file_no int, record_key string, field string, text string"


def record_fields(records: DataFrame, keys: dict[str, str] = KEYS) -> DataFrame:
    """One row for each field of each record, the key field left out: source_id, table_name, file_no, record_key, field and
    text, which is a string's content, else the JSON literal. The literal is wanted as it stands, which Spark's own JSON
    reading doesn't keep (1.50 becomes 1.5), so payloads are parsed in Arrow batches. Payloads without fields: see
    file_fields."""
    schema = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.string()) for x in FIELDS.split(",")])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for source, table, file_no, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fields, key = _record(payload, keys.get(table))
                n = len(fields)
                texts = [_literal(v, payload, f) for f, v in fields.items()]
                for column, values in zip(out, ([source] * n, [table] * n, [file_no] * n, [key] * n, fields, texts), strict=True):
                    column += values
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return _filed(records).where(_parsed().isNotNull()).mapInArrow(explode, FIELDS)


def _renames(pairs: DataFrame, matches: int, share: float) -> DataFrame:
    """Of candidate pairs (source_id, ord, old_name, new_name, n, same) those that are renamings, one to one: by share
    of equal values, number of records and names. A file's candidates are at most its leavers times its comers."""
    good = pairs.where((F.col("n") >= matches) & (F.col("same") >= F.col("n") * share))
    best = F.array_sort(
        F.collect_list(F.struct((-F.col("same") / F.col("n")).alias("s"), (-F.col("n")).alias("m"), "old_name", "new_name"))
    )
    nothing = F.array().cast("array<struct<old_name:string,new_name:string>>")

    def take(chosen: Column, x: Column) -> Column:
        pair = F.struct(x["old_name"].alias("old_name"), x["new_name"].alias("new_name"))
        used = F.exists(chosen, lambda c: (c["old_name"] == x["old_name"]) | (c["new_name"] == x["new_name"]))
        return F.when(used, chosen).otherwise(F.concat(chosen, F.array(pair)))

    return (
        good.groupBy("source_id", "ord")
        .agg(best.alias("best"))
        .select("source_id", "ord", F.explode(F.aggregate("best", nothing, take)).alias("r"))
        .select("source_id", "ord", "r.old_name", "r.new_name")
    )


def _heads(links: DataFrame) -> DataFrame:
    """The first island of each renamed one: source_id, field, start, head_field, head_start, from links (source_id, field,
    start, head_field, head_start) that name the island before. Every round doubles the distance that is known, so a column
    renamed n times takes log2 n rounds; only renamings are joined."""
    while True:
        further = links.select("source_id", F.col("field").alias("head_field"), F.col("start").alias("head_start"), F.col("head_field").alias("f"), F.col("head_start").alias("s"))
        step = links.join(further, ["source_id", "head_field", "head_start"], "left").select(
            "source_id", "field", "start", F.coalesce("f", "head_field").alias("head_field"), F.coalesce("s", "head_start").alias("head_start"), F.col("f").isNotNull().alias("moved")
        )
        links = written(step, "links")
        if not links.agg(F.max("moved")).collect()[0][0]:
            return links.drop("moved")
        links = links.drop("moved")


class Drift:
    """The changes of schema in records (source_id, table_name, file_no, payload), and the one table they make.

    Nulls: records without a source_id or file_no are in no file. A field is in a file if some payload has it, even as
    null; a file with nulls only leaves the known type. Repeated records and files sent twice make no difference: of
    copies of a record key in one file that differ, the least text of a field counts. Empty input gives empty results.
    """

    def __init__(self, records: DataFrame, keys: dict[str, str] = KEYS, matches: int = MATCHES, share: float = SHARE):
        self._records, self._keys = records, keys
        # Written once, so that payloads are parsed once: a row for each field of each file. So is the small catalogue, which
        # feeds the log of starts, of endings and of types.
        self.catalogue = written(lifespans(written(file_fields(records, keys), "file-fields")), "lifespans")
        c = self.catalogue
        self._comers = c.where(F.col("starts") & (F.col("ord") > 1)).select(
            "source_id", "ord", "file_no", F.col("field").alias("new_name")
        )
        self._leavers = c.where(F.col("ends") & F.col("next_file").isNotNull()).select(
            "source_id",
            (F.col("ord") + 1).alias("ord"),
            F.col("next_file").alias("file_no"),
            F.col("file_no").alias("old_file"),
            F.col("field").alias("old_name"),
            "start",
        )
        self.renames = written(_renames(self._pairs(), matches, share), "renames")
        links = self._leavers.join(self.renames, ["source_id", "ord", "old_name"]).select(
            "source_id", F.col("new_name").alias("field"), F.col("ord").alias("start"), F.col("old_name").alias("head_field"), F.col("start").alias("head_start")
        )
        self._heads = _heads(links)

    def _pairs(self) -> DataFrame:
        """Leavers and comers of one file with the number of records that have both values, and the same."""
        # A file's fields, not its records, are listed: where some leave and others come, for the file and the one before.
        ends = F.when(F.col("ends") & F.col("next_file").isNotNull(), F.struct((F.col("ord") + 1).alias("at"), F.lit(True).alias("old"), "file_no", "field"))
        starts = F.when(F.col("starts") & (F.col("ord") > 1), F.struct(F.col("ord").alias("at"), F.lit(False).alias("old"), "file_no", "field"))
        named = lambda old: F.collect_set(F.when(F.col("old") == old, F.col("field")))
        of = lambda old: F.max(F.when(F.col("old") == old, F.col("file_no")))
        points = (
            self.catalogue.select("source_id", F.explode(F.array_compact(F.array(ends, starts))).alias("e"))
            .select("source_id", "e.*")
            .groupBy("source_id", "at")
            .agg(named(True).alias("leaving"), named(False).alias("coming"), of(True).alias("old_file"), of(False).alias("new_file"))
            .where((F.size("leaving") > 0) & (F.size("coming") > 0))
        )
        sides = F.array(
            F.struct(F.col("old_file").alias("file_no"), (F.col("at") - 1).alias("ord"), "leaving", F.array().cast("array<string>").alias("coming")),
            F.struct(F.col("new_file").alias("file_no"), F.col("at").alias("ord"), F.array().cast("array<string>").alias("leaving"), "coming"),
        )
        wanted = points.select("source_id", F.inline(sides)).groupBy("source_id", "file_no", "ord")
        wanted = wanted.agg(F.flatten(F.collect_list("leaving")).alias("leaving"), F.flatten(F.collect_list("coming")).alias("coming"))
        # Written, so that Spark knows how small it is before it is joined to the records.
        wanted = written(wanted, "wanted")
        values = (
            _filed(self._records)
            .join(wanted, ["source_id", "file_no"])
            .where(_parsed().isNotNull())
            .select("source_id", "table_name", "payload", "ord", "leaving", "coming")
            .mapInArrow(_wanted_values(self._keys), VALUES)
            .groupBy("source_id", "ord", "record_key", "old", "field")
            .agg(F.min("text").alias("text"))
        )
        # Of a record no more than the leaving and coming fields of its file meet here.
        met = values.groupBy("source_id", "ord", "record_key").agg(F.collect_list(F.struct("old", "field", "text")).alias("v"))
        olds, news = F.filter("v", lambda x: x["old"]), F.filter("v", lambda x: ~x["old"])
        pairs = F.flatten(
            F.transform(olds, lambda o: F.transform(news, lambda n: F.struct(o["field"].alias("old_name"), n["field"].alias("new_name"), (o["text"] == n["text"]).alias("same"))))
        )
        return (
            met.select("source_id", "ord", F.inline(pairs))
            .groupBy("source_id", "ord", "old_name", "new_name")
            .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("same"), 1)).alias("same"))
        )

    def columns(self) -> DataFrame:
        """The catalogue with head_field and head_start, the first island of the row's column, and old_name, the name in the
        file before where the column is renamed in this file."""
        renamed = self.renames.select("source_id", F.col("ord"), F.col("new_name").alias("field"), "old_name")
        return (
            self.catalogue.join(self._heads, ["source_id", "field", "start"], "left")
            .join(renamed, ["source_id", "ord", "field"], "left")
            .withColumns({"head_field": F.coalesce("head_field", "field"), "head_start": F.coalesce("head_start", "start")})
        )

    def changes(self) -> DataFrame:
        """source_id, file_no, change_kind (added, removed, renamed, type_changed), old_name, new_name."""
        change = lambda df, kind, old, new: df.select("source_id", "file_no", kind.alias("change_kind"), old.alias("old_name"), new.alias("new_name"))
        new = F.col("new_name")
        ends = self._leavers.drop("start").join(self.renames, ["source_id", "ord", "old_name"], "left")
        ends = change(ends, F.when(new.isNull(), "removed").otherwise("renamed"), F.col("old_name"), F.coalesce(new, F.lit("")))
        starts = self._comers.join(self.renames.drop("old_name"), ["source_id", "ord", "new_name"], "left_anti")
        starts = change(starts, F.lit("added"), F.lit(""), new)
        # One file has a column once, whatever its name, and stretches of one type are told apart over all of its files.
        column = Window.partitionBy("source_id", "head_field", "head_start").orderBy("ord")
        typed = self.columns().where(F.col("type").isNotNull()).withColumn("before", F.lag("type").over(column)).where(F.col("type") != F.col("before"))
        retyped = change(typed, F.lit("type_changed"), F.coalesce("old_name", "field"), F.col("field"))
        return ends.unionByName(starts).unionByName(retyped)

    def aliases(self) -> DataFrame:
        """The alias table: source_id, table_name, file_no, field, column_name (the field's first name), column_type (the
        narrowest type that holds all of the column's values in its table, over all sources)."""
        named = self.columns().withColumnRenamed("head_field", "column_name")
        n = lambda *kinds: F.count(F.when(F.col("type").isin(*kinds), 1))
        types = named.groupBy("table_name", "column_name").agg(
            F.when(n("string") + F.when(n("boolean") > 0, n("integer", "number")).otherwise(0) > 0, "string")
            .when(n("number") > 0, "number")
            .when(n("integer") > 0, "integer")
            .when(n("boolean") > 0, "boolean")
            .otherwise("string")
            .alias("column_type")
        )
        return named.join(types, ["table_name", "column_name"]).select("source_id", "table_name", "file_no", "field", "column_name", "column_type")

    def unified(self) -> DataFrame:
        """All records in one shape per table: table_name, source_id, file_no, record_key, columns (map of column name to
        value as text of the column's type; a value that doesn't fit a cast is null). Copies of a record count once."""
        cast = (
            F.when(F.col("column_type") == "integer", F.col("text").try_cast("decimal(38,0)").cast("string"))
            .when(F.col("column_type") == "number", F.col("text").try_cast("double").cast("string"))
            .when(F.col("column_type") == "boolean", F.col("text").try_cast("boolean").cast("string"))
            .otherwise(F.col("text"))
        )
        values = (
            record_fields(self._records, self._keys)
            .join(self.aliases().drop("table_name"), ["source_id", "file_no", "field"])
            .groupBy("table_name", "source_id", "file_no", "record_key", "column_name")
            .agg(F.min(cast).alias("value"))
        )
        # Of a record no more than its columns meet here.
        return values.groupBy("table_name", "source_id", "file_no", "record_key").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("column_name", "value")))).alias("columns")
        )
