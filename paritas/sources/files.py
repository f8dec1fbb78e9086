"""Tables in a folder of JSON, JSON-lines and CSV files, and in databases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritas.session import shared_folder
from paritas.sources.sinks import filesystem

#: Of files of one name, the first of these counts.
SUFFIXES = (".json", ".jsonl", ".csv")


class SourceError(RuntimeError):
    """A table that isn't there."""


class FileSource:
    """Each file of a folder is a table of its name, wherever Spark can read: a local disk, HDFS or an object store. A
    folder so named, of parts as Spark writes them, is a file too."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/") or "/"

    def _names(self) -> list[str]:
        fs, p = filesystem(self.spark, self.root)
        return [s.getPath().getName() for s in fs.listStatus(p)]

    def tables(self) -> list[str]:
        return sorted({n.rsplit(".", 1)[0] for n in self._names() if n.endswith(SUFFIXES)})

    def path(self, table: str) -> str:
        names = self._names()
        for suffix in SUFFIXES:
            if f"{table}{suffix}" in names:
                return f"{self.root}/{table}{suffix}"
        raise SourceError(f"no table {table!r} under {self.root}")

    def _first_character(self, path: str) -> str:
        """The first character of a file that isn't white space or a byte order mark, however many stand before it."""
        fs, p = filesystem(self.spark, path)
        if fs.getFileStatus(p).isDirectory():
            parts = [s.getPath() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")) and s.getLen()]
            if not parts:
                return ""
            p = min(parts, key=str)
        stream = fs.open(p)
        try:
            while (byte := stream.read()) in (0x20, 0x09, 0x0A, 0x0D, 0xEF, 0xBB, 0xBF):
                pass
            return chr(byte) if byte >= 0 else ""
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        """CSV has a header and texts only, an empty field being the empty text; JSON is a list of objects, or one object
        whose values are the rows; a malformed file fails. Lists and lines are read side by side, a list in parts when it
        is a folder of several files; one object is one value, so it is read by one task."""
        path = self.path(table)
        if path.endswith(".csv"):
            return self.spark.read.option("header", True).csv(path).na.fill("")
        if path.endswith(".jsonl"):
            return self.spark.read.option("mode", "FAILFAST").json(path)
        if self._first_character(path) == "[":
            return self.spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)
        text = self.spark.read.text(path, wholetext=True)
        rows = text.select(F.explode(F.map_values(F.from_json("value", "map<string,string>"))).alias("row"))
        folder = f"{shared_folder(self.spark)}/paritas/rows-{uuid.uuid4().hex}"
        rows.write.text(folder)
        return self.spark.read.option("mode", "FAILFAST").json(folder)

    def row_counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in self.tables()}

    def schema(self) -> dict[str, list[str]]:
        return {t: sorted(self.read(t).columns) for t in self.tables()}

    def all(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in self.tables()}


class MemorySource:
    """Tables at hand, by name."""

    def __init__(self, tables: dict[str, DataFrame]):
        self._tables = dict(tables)

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def read(self, table: str) -> DataFrame:
        if table not in self._tables:
            raise SourceError(f"no table {table!r}")
        return self._tables[table]


def database_options(url: str, table: str, key: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int = 8) -> dict[str, str]:
    """Options of a JDBC read; with a key and its range the read is split, so that executors read side by side."""
    from paritas.sources.sinks import quoted

    dialect = "sqlserver" if url.startswith("jdbc:sqlserver") else "postgres"
    out = {"url": url, "dbtable": quoted(table, dialect), "fetchsize": "10000"}
    if key is not None and lower is not None and upper is not None:
        out |= {"partitionColumn": key, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return out


def read_database(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**database_options(**options)).load()


def database_tables(spark: SparkSession, url: str) -> DataFrame:
    """Base tables of a database, by its information schema."""
    return spark.read.format("jdbc").options(url=url, dbtable="INFORMATION_SCHEMA.TABLES").load().where("upper(TABLE_TYPE) = 'BASE TABLE'").select("TABLE_NAME")


def database_columns(spark: SparkSession, url: str) -> DataFrame:
    return (
        spark.read.format("jdbc").options(url=url, dbtable="INFORMATION_SCHEMA.COLUMNS").load()
        .select("TABLE_NAME", "COLUMN_NAME", "DATA_TYPE", "IS_NULLABLE", "ORDINAL_POSITION")
    )
