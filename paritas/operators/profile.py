"""Profiles of tables and what follows from them: relationships, fingerprints, drift, findings, mappings, genomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.functions.hashing import sha256_text
from paritas.functions.names import is_kind, likeness, named_like, without_suffix

#: Kinds of type a profile tells apart.
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def kind_of(dtype: str) -> str:
    """boolean, integer, number, string or unknown, of a Spark type."""
    if dtype in ("boolean",):
        return "boolean"
    if dtype in _INTEGERS:
        return "integer"
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return "number"
    return "unknown" if dtype == "void" else "string"


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value, n: one pass over all columns, combined on the map side."""
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    long = df.select(*texts).unpivot([], columns, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_table(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """A row for each column: column_name, data_type, nullable, row_count, null_count, null_fraction, distinct_count (by
    text), min_value, max_value (least and greatest in the column's own order, as text), top_values (up to `top` values
    by count descending, then value), likely_pii, likely_identifier. A column without values is unknown."""
    columns = columns or df.columns
    types = dict(df.dtypes)
    counts = _values(df, columns)
    value, n = F.col("value"), F.col("n")
    number = F.when(F.col("column_name").isin(*[c for c in columns if kind_of(types[c]) in ("integer", "number")] or [""]), value.try_cast("double"))
    base = counts.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(value.isNull(), n)), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
        F.min(F.when(value.isNotNull(), F.struct(number.alias("d"), value.alias("v")))).alias("lo"),
        F.max(F.when(value.isNotNull(), F.struct(number.alias("d"), value.alias("v")))).alias("hi"),
    )
    best = Window.partitionBy("column_name").orderBy(value.isNull(), n.desc(), value)
    tops = (
        counts.withColumn("r", F.row_number().over(best))
        .where(F.col("r") <= top)
        .groupBy("column_name")
        .agg(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("r", "value", "n")))).alias("t"))
        .select("column_name", F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_values"))
    )
    kind = F.lit("string")
    for c in columns:
        kind = F.when(F.col("column_name") == c, kind_of(types[c])).otherwise(kind)
    # A table without rows has its columns all the same, unknown and without counts.
    every = F.broadcast(df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string"))
    n0 = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(base, "column_name", "left").join(tops, "column_name", "left").select(
        "column_name",
        F.when(F.coalesce("distinct_count", F.lit(0)) == 0, "unknown").otherwise(kind).alias("data_type"),
        F.coalesce(F.col("null_count") > 0, F.lit(False)).alias("nullable"),
        n0("row_count"),
        n0("null_count"),
        F.coalesce(F.try_divide(F.col("null_count"), F.col("row_count")), F.lit(0.0)).alias("null_fraction"),
        n0("distinct_count"),
        F.col("lo.v").alias("min_value"),
        F.col("hi.v").alias("max_value"),
        F.coalesce("top_values", F.array().cast("array<struct<value:string,n:bigint>>")).alias("top_values"),
        is_kind(F.col("column_name"), "profile_pii").alias("likely_pii"),
        is_kind(F.col("column_name"), "identifier").alias("likely_identifier"),
    )


def relationships(tables: dict[str, DataFrame], min_confidence: float = 0.75) -> DataFrame:
    """source_table, source_column, target_table, target_column, shared (distinct values of the source column that the
    target column has), coverage (of its distinct values), confidence = 0.45 like names + 0.20 like types + 0.35
    coverage, of each pair of columns of two tables with at least min_confidence.

    All columns become one list of distinct (column, value); instead of joining it with itself, which would emit all
    pairs of columns of a common value row by row, each value's set of columns (of the schema's size) is formed once and
    equal sets are counted before their pairs are.
    """
    long, kinds = None, []
    for t, df in tables.items():
        part = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "c", "value")
        part = part.where("value is not null").select(F.lit(t).alias("t"), "c", "value").distinct()
        long = part if long is None else long.unionAll(part)
        kinds += [(t, c, kind_of(d)) for c, d in df.dtypes]
    spark = next(iter(tables.values())).sparkSession
    sets = long.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("t", "c"))).alias("cs")).groupBy("cs").agg(F.count(F.lit(1)).alias("n"))
    one = sets.select(F.explode("cs").alias("a"), "cs", "n")
    sizes = one.groupBy("a").agg(F.sum("n").alias("size"))
    shared = one.select("a", F.explode("cs").alias("b"), "n").where("a.t <> b.t").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    types = spark.createDataFrame(kinds, "t string, c string, kind string").select(F.struct("t", "c").alias("x"), "kind")
    known = F.broadcast(sizes.join(types, sizes["a"] == types["x"]).select("x", "size", "kind"))  # a row for each column
    pairs = (
        known.select(F.col("x").alias("a"), F.col("size").alias("size"), F.col("kind").alias("ka"))
        .crossJoin(known.select(F.col("x").alias("b"), F.col("kind").alias("kb")))  # pairs of columns, not of rows
        .where("a.t <> b.t")
        .join(shared, ["a", "b"], "left")
    )
    name = (without_suffix(F.col("a.c")) == without_suffix(F.col("b.c"))).cast("double")
    kind = (F.col("ka") == F.col("kb")).cast("double")
    coverage = F.coalesce("shared", F.lit(0)) / F.col("size")
    return pairs.select(
        F.col("a.t").alias("source_table"), F.col("a.c").alias("source_column"), F.col("b.t").alias("target_table"), F.col("b.c").alias("target_column"),
        F.coalesce("shared", F.lit(0)).alias("shared"), coverage.alias("coverage"), (0.45 * name + 0.20 * kind + 0.35 * coverage).alias("confidence"),
    ).where(F.col("confidence") >= min_confidence)


def schema_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: columns (an array of table, column, type, nullable, distinct_count, likely_pii, row_count, of the
    schema's size) and digest. It changes with the volume too, as counts are part of it."""
    rows = None
    for t, df in tables.items():
        part = profile_table(df).select(
            F.lit(t).alias("table_name"), "column_name", "data_type", "nullable", "distinct_count", "likely_pii", "row_count"
        )
        rows = part if rows is None else rows.unionByName(part)
    listed = F.array_sort(F.collect_list(F.struct(*rows.columns)))
    return rows.agg(listed.alias("columns")).withColumn("digest", sha256_text(F.to_json("columns")))


def compare_schemas(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after: (table_name, column_name, data_type) -> table_name, column_name, kind, severity.

    TABLE_ADDED (SAFE), TABLE_REMOVED (CRITICAL), COLUMN_ADDED (SAFE), COLUMN_REMOVED (BREAKING), DATATYPE_CHANGED
    (CRITICAL between number and string, else WARNING). Columns of added or removed tables aren't listed.
    """
    t1, t2 = before.select("table_name").distinct(), after.select("table_name").distinct()
    whole = lambda a, b, kind, severity: a.join(b, "table_name", "left_anti").select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"))
    key = ["table_name", "column_name"]
    both = before.select(*key, F.col("data_type").alias("old")).join(after.select(*key, F.col("data_type").alias("new")), key, "full")
    both = both.join(t1.intersect(t2), "table_name", "left_semi")
    kind = F.when(F.col("old").isNull(), "COLUMN_ADDED").when(F.col("new").isNull(), "COLUMN_REMOVED").when(F.col("old") != F.col("new"), "DATATYPE_CHANGED")
    hard = F.array_sort(F.array("old", "new")) == F.array(F.lit("number"), F.lit("string"))
    severity = F.when(F.col("kind") == "COLUMN_ADDED", "SAFE").when(F.col("kind") == "COLUMN_REMOVED", "BREAKING").otherwise(F.when(hard, "CRITICAL").otherwise("WARNING"))
    columns = both.withColumn("kind", kind).where("kind is not null").select(*key, "kind", severity.alias("severity"))
    return columns.unionByName(whole(t2, t1, "TABLE_ADDED", "SAFE")).unionByName(whole(t1, t2, "TABLE_REMOVED", "CRITICAL"))


def semantic_diff(source: DataFrame, target: DataFrame, mappings: dict[str, str]) -> DataFrame:
    """source, target: (table_name, column_name) -> kind, source, target, semantic_loss. A source field without a target
    of its name is a REPRESENTATION_CHANGE when mapped, else a STRUCTURAL_CHANGE that loses it; a target field that is
    neither in the source nor mapped to is a STRUCTURAL_CHANGE (semantic_loss null)."""
    spark = source.sparkSession
    key = ["table_name", "column_name"]
    name = F.concat_ws(".", *key)
    mapped = spark.createDataFrame(list(mappings.items()), "source string, target string")  # given by hand
    gone = source.select(*key).distinct().join(target.select(*key), key, "left_anti").select(name.alias("source")).join(F.broadcast(mapped), "source", "left")
    gone = gone.select(
        F.when(F.col("target").isNull(), "STRUCTURAL_CHANGE").otherwise("REPRESENTATION_CHANGE").alias("kind"), "source", "target", F.col("target").isNull().alias("semantic_loss")
    )
    new = target.select(*key).distinct().join(source.select(*key), key, "left_anti").select(name.alias("target")).join(F.broadcast(mapped), "target", "left_anti")
    none = F.lit(None)
    return gone.unionByName(new.select(F.lit("STRUCTURAL_CHANGE").alias("kind"), none.cast("string").alias("source"), "target", none.cast("boolean").alias("semantic_loss")))


def findings(tables: dict[str, DataFrame], min_relationship: float = 0.6) -> DataFrame:
    """What can be dug out of tables: category, subject, status, confidence, detail.

    identifier (uniqueness as confidence; KNOWN from 0.99, else LIKELY), pii, temporal, monetary, categorical (with up
    to 12 values), relationship, business_rule (a state column with life-cycle values), and unknown types.
    """
    rules = [("pii", "LIKELY", 0.85), ("temporal", "LIKELY", 0.82), ("monetary", "LIKELY", 0.80)]
    out: DataFrame | None = None

    def add(part: DataFrame) -> None:
        nonlocal out
        out = part if out is None else out.unionByName(part)

    def finding(subject: Column, category: str, status, confidence, detail) -> list[Column]:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return [F.lit(category).alias("category"), subject.alias("subject"), lit(status).alias("status"), lit(confidence).cast("double").alias("confidence"), lit(detail).cast("string").alias("detail")]

    for t, df in tables.items():
        p = profile_table(df)
        subject = F.concat_ws(".", F.lit(t), "column_name")
        name = F.col("column_name")
        unique = F.coalesce(F.try_divide(F.col("distinct_count"), F.col("row_count")), F.lit(0.0))
        add(p.where("likely_identifier").select(*finding(subject, "identifier", F.when(unique >= 0.99, "KNOWN").otherwise("LIKELY"), unique, None)))
        for category, status, confidence in rules:
            has = is_kind(name, category) | F.col("likely_pii") if category == "pii" else is_kind(name, category)
            add(p.where(has).select(*finding(subject, category, status, confidence, None)))
        add(p.where("data_type = 'unknown'").select(*finding(subject, "unknown", "UNKNOWN", 0.0, "type unknown")))
        for c in [c for c in df.columns if named_like(c, "categorical")]:
            values = df.select(F.col(f"`{c}`").cast("string").alias("v")).where("v is not null").distinct()
            first = values.orderBy("v").limit(12).agg(F.to_json(F.array_sort(F.collect_list("v"))).alias("d"))
            add(first.select(*finding(F.lit(f"{t}.{c}"), "categorical", "OBSERVED", 0.95, F.col("d"))))
            states = values.where(F.upper("v").isin("CLOSED", "OPEN", "ACTIVE")).agg(F.count(F.lit(1)).alias("n"))
            add(states.where("n > 0").select(*finding(F.lit(f"{t}.{c}"), "business_rule", "INFERRED", 0.55, None)))
    if len(tables) > 1:
        r = relationships(tables, min_relationship)
        to = F.concat(F.lit("to "), "target_table", F.lit("."), "target_column")
        add(r.select(*finding(F.concat_ws(".", "source_table", "source_column"), "relationship", "INFERRED", F.col("confidence"), to)))
    return out


def propose_mappings(source: DataFrame, target: DataFrame) -> DataFrame:
    """source, target: (position, name, data_type) -> the best target of each source column: source_column,
    target_column, confidence = 0.7 like names + 0.3 like types, status (REVIEW_REQUIRED below 0.98, else PROPOSED). Of
    equals the first target wins. Pairs are of columns, not of rows."""
    s = source.select(F.col("name").alias("source_column"), F.col("data_type").alias("st"))
    t = F.broadcast(target.select(F.col("position").alias("p"), F.col("name").alias("target_column"), F.col("data_type").alias("tt")))
    confidence = 0.7 * likeness(F.col("source_column"), F.col("target_column")) + 0.3 * F.col("st").eqNullSafe(F.col("tt")).cast("double")
    best = F.max_by(F.struct("target_column", "confidence"), F.struct("confidence", -F.col("p"))).alias("b")
    return (
        s.crossJoin(t)
        .withColumn("confidence", confidence)
        .groupBy("source_column")
        .agg(best)
        .select("source_column", "b.target_column", F.round("b.confidence", 4).alias("confidence"), F.when(F.col("b.confidence") < 0.98, "REVIEW_REQUIRED").otherwise("PROPOSED").alias("status"))
    )


# --- genomes --------------------------------------------------------------------------------------------------------


def genome(tables: dict[str, DataFrame], invariants: list[str] = (), uncertainty: dict[str, float] | None = None, evidence: list[str] = ()) -> DataFrame:
    """The traits of a set of tables, one a row: trait (entity, column, relationship, semantic, velocity, temporal: columns
    so named, distribution: columns with values), name, value; and what is known beside the tables: names of invariants,
    the uncertainty of components and ids of evidence."""
    out = None
    for t, df in tables.items():
        p = profile_table(df)
        meaning = F.when(F.col("likely_pii"), "pii").when(F.col("likely_identifier"), "identifier").otherwise(F.col("data_type"))
        none = F.lit(None).cast("double").alias("value")
        parts = [
            p.agg(F.coalesce(F.max("row_count"), F.lit(0)).alias("n")).select(F.explode(F.array(F.lit("entity"), F.lit("velocity"))).alias("trait"), F.lit(t).alias("name"), F.col("n").cast("double").alias("value")),
            p.select(F.lit("column").alias("trait"), F.concat_ws(".", F.lit(t), "column_name").alias("name"), none),
            p.select(F.lit("semantic").alias("trait"), F.concat(F.lit(f"{t}."), "column_name", F.lit(":"), meaning).alias("name"), none),
        ]
        name = F.concat_ws(".", F.lit(t), "column_name").alias("name")
        parts += [
            p.where(is_kind(F.col("column_name"), "temporal")).select(F.lit("temporal").alias("trait"), name, none),
            p.where("distinct_count > 0").select(F.lit("distribution").alias("trait"), name, none),
        ]
        for part in parts:
            out = part if out is None else out.unionByName(part)
    given = [("invariant", x, None) for x in invariants] + [("uncertainty", k, float(v)) for k, v in (uncertainty or {}).items()] + [("evidence", x, None) for x in evidence]
    if given:
        out = out.unionByName(out.sparkSession.createDataFrame(given, "trait string, name string, value double"))
    if len(tables) > 1:
        arrow = F.concat("source_table", F.lit(":"), "source_column", F.lit("->"), "target_table", F.lit(":"), "target_column")
        out = out.unionByName(relationships(tables, 0.6).select(F.lit("relationship").alias("trait"), arrow.alias("name"), F.lit(None).cast("double").alias("value")))
    return out


def genome_summary(traits: DataFrame) -> DataFrame:
    """One row: entity_count, column_count, relationship_count, row_count, fingerprint, the digest of entities, columns,
    relationships, meanings and invariants (a list of the schema's size), invariant_count, evidence_count and
    uncertain_components, the names of those of an uncertainty above 0.5."""
    n = lambda trait: F.count(F.when(F.col("trait") == trait, 1)).alias(f"{trait}_count")
    lasting = F.when(F.col("trait").isin("entity", "column", "relationship", "semantic", "invariant"), F.struct("trait", "name"))
    uncertain = F.array_sort(F.collect_list(F.when((F.col("trait") == "uncertainty") & (F.col("value") > 0.5), F.col("name")))).alias("uncertain_components")
    rows_ = F.coalesce(F.sum(F.when(F.col("trait") == "velocity", F.col("value"))), F.lit(0.0)).cast("long").alias("row_count")
    return traits.agg(n("entity"), n("column"), n("relationship"), rows_, sha256_text(F.to_json(F.array_sort(F.collect_list(lasting)))).alias("fingerprint"), n("invariant"), n("evidence"), uncertain)


def genome_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """metric, distance between two genomes: schema (entities and columns), entity, relationship, temporal, distribution,
    semantic, invariant as shares of traits not in common (0 when neither has any), behavioral as the mean difference of
    velocities, each at most 1."""
    key = ["trait", "name"]
    both = left.select(*key, F.col("value").alias("a"), F.lit(1).alias("l")).join(right.select(*key, F.col("value").alias("b"), F.lit(1).alias("r")), key, "full")
    metrics = {"schema": ("entity", "column"), "entity": ("entity",), **{x: (x,) for x in ("relationship", "temporal", "distribution", "semantic", "invariant")}}
    out = []
    for metric, traits in metrics.items():
        mine = F.col("trait").isin(*traits)
        total, common = F.count(F.when(mine, 1)), F.count(F.when(mine & (F.col("l") + F.col("r") == 2), 1))
        out.append(F.struct(F.lit(metric).alias("metric"), F.when(total == 0, 0.0).otherwise(1 - common / total).alias("distance")))
    gap = F.least(F.lit(1.0), F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))
    out.append(F.struct(F.lit("behavioral").alias("metric"), F.coalesce(F.avg(F.when(F.col("trait") == "velocity", gap)), F.lit(0.0)).alias("distance")))
    return both.agg(F.array(*out).alias("m")).select(F.explode("m").alias("x")).select("x.*")


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, position, data_type of tables, from their schemas alone."""
    rows = [(t, c, i, kind_of(d)) for t, df in tables.items() for i, (c, d) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, data_type string")
