"""Reading the tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of `directory`; pruning and pushdown are left to the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def catalog(spark: SparkSession, directory: str, names: list[str]) -> dict[str, DataFrame]:
    """Several tables, lazily, by name."""
    return {name: table(spark, directory, name) for name in names}
