"""Sinks: versioned tables, JSON-lines logs, immutable snapshots, exports and database upserts."""

from __future__ import annotations

import hashlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SinkError(RuntimeError):
    """A sink that can't do what is asked."""


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def committed(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers n of folders kind-n under a path that are written to the end: those with Spark's _SUCCESS."""
    fs, p = filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.rsplit("-", 1)[1]) for n in names if n.startswith(f"{kind}-") and exists(spark, f"{path}/{n}/_SUCCESS"))


def remove(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)


class VersionedTable:
    """A table in numbered folders. Readers see the greatest version that is committed; a version is committed by the
    file _SUCCESS, which Spark writes last, so an interrupted write is never seen, and rolling back is removing the last
    version. Several statements in one transaction are several writes of one version by the caller."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return committed(self.spark, self.path, "v")

    def read(self, version: int | None = None) -> DataFrame | None:
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.path}/v-{known[-1] if version is None else version}")

    def write(self, df: DataFrame) -> int:
        """Writes the next version. Its number is claimed by a file that only one writer can create; of two writers at
        once the other one takes the number after, and neither overwrites. Numbers of writers that were lost stay unused."""
        fs, p = filesystem(self.spark, self.path)
        claims = [int(s.getPath().getName()[6:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("claim-")] if fs.exists(p) else []
        version = max([-1, *self.versions(), *claims]) + 1
        while True:
            try:
                fs.create(filesystem(self.spark, f"{self.path}/claim-{version}")[1], False).close()
                break
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception):
                    raise
                version += 1
        df.write.mode("errorifexists").parquet(f"{self.path}/v-{version}")
        return version

    def rollback(self) -> None:
        known = self.versions()
        if known:
            remove(self.spark, f"{self.path}/v-{known[-1]}")


def append_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to those in the folder."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log, none when it doesn't exist yet; a malformed line fails."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def put_snapshot(spark: SparkSession, root: str, provider: str, payload: dict) -> str:
    """Stores a payload under an id of its provider and content; the same content again changes nothing."""
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    snapshot_id = f"{provider}-{hashlib.sha256(text.encode()).hexdigest()[:16]}"
    if not exists(spark, f"{root}/{snapshot_id}"):
        spark.createDataFrame([(snapshot_id, provider, text)], "snapshot_id string, provider string, payload string").coalesce(1).write.mode("errorifexists").json(f"{root}/{snapshot_id}")
    return snapshot_id


def get_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    return spark.read.schema("snapshot_id string, provider string, payload string").json(f"{root}/{snapshot_id}")


def list_snapshots(spark: SparkSession, root: str) -> list[str]:
    fs, p = filesystem(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def export(tables: dict[str, DataFrame], path: str, form: str = "json") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}.{form}")


def quoted(name: str, dialect: str = "ansi") -> str:
    """An identifier of letters, digits and underscores, quoted for the dialect; others are refused."""
    if not name or not all(c.isalnum() or c == "_" for c in name):
        raise SinkError(f"unsafe identifier {name!r}")
    return {"ansi": f'"{name}"', "spark": f"`{name}`", "sqlserver": f"[{name}]", "postgres": f'"{name}"'}[dialect]


def merge_statement(table: str, columns: list[str], key: str, dialect: str = "ansi") -> str:
    """The MERGE of one parameter row into a database table: update else insert; insert alone if the key is all."""
    q = lambda c: quoted(c, dialect)
    names = sorted(columns)
    mark = "?" if dialect == "sqlserver" else "%s"
    sets = ", ".join(f"{q(c)} = s.{q(c)}" for c in names if c != key)
    source = f"(VALUES ({', '.join([mark] * len(names))})) AS s ({', '.join(map(q, names))})"
    update = f" WHEN MATCHED THEN UPDATE SET {sets}" if sets else ""
    insert = f" WHEN NOT MATCHED THEN INSERT ({', '.join(map(q, names))}) VALUES ({', '.join('s.' + q(c) for c in names)})"
    return f"MERGE INTO {q(table)} AS t USING {source} ON t.{q(key)} = s.{q(key)}{update}{insert};"


def staged_statements(table: str, columns: list[str], key: str, dialect: str = "ansi") -> tuple[str, str, str]:
    """Statements that make a temporary table of a table's shape, put a parameter row into it, and merge all of it into the
    table at once."""
    q = lambda c: quoted(c, dialect)
    names = sorted(columns)
    listed = ", ".join(map(q, names))
    stage = f"#{table}_stage" if dialect == "sqlserver" else q(f"{table}_stage")
    make = f"SELECT {listed} INTO {stage} FROM {q(table)} WHERE 1 = 0;" if dialect == "sqlserver" else f"CREATE TEMPORARY TABLE {stage} AS SELECT {listed} FROM {q(table)} WHERE 1 = 0;"
    put = f"INSERT INTO {stage} ({listed}) VALUES ({', '.join(['?' if dialect == 'sqlserver' else '%s'] * len(names))});"
    rows = f"(VALUES ({', '.join(['?' if dialect == 'sqlserver' else '%s'] * len(names))})) AS s ({listed})"
    return make, put, merge_statement(table, columns, key, dialect).replace(rows, f"{stage} AS s")


def upsert_database(df: DataFrame, connect, table: str, key: str, dialect: str = "ansi", batch: int = 1000) -> None:
    """Upserts rows into a database: each partition puts its rows into a temporary table, in batches, and merges that once;
    connect() opens a DB-API connection there. A key must come once (see load.last_wins); partitions are by key, so that
    no two of them merge the same row, and a partition that is run again changes nothing."""
    columns = sorted(df.columns)
    make, put, merge = staged_statements(table, columns, key, dialect)

    def send(rows) -> None:
        first = next(rows, None)
        if first is None:
            return
        connection = connect()
        try:
            cursor, held = connection.cursor(), [tuple(first[c] for c in columns)]
            cursor.execute(make)
            for row in rows:
                held.append(tuple(row[c] for c in columns))
                if len(held) == batch:
                    cursor.executemany(put, held)
                    held = []
            if held:
                cursor.executemany(put, held)
            cursor.execute(merge)
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    df.select(*columns).repartition(key).foreachPartition(send)


def write_report(path: str, certification: dict, technical: dict, executive: dict) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"certification": certification, "technical": technical, "executive": executive}, f, indent=2, sort_keys=True, default=str)


def row_count_and_columns(df: DataFrame) -> DataFrame:
    """rows, columns (sorted names) of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.array(*[F.lit(c) for c in sorted(df.columns)]).cast("array<string>").alias("columns"))
