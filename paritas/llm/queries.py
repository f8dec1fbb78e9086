"""The queries of problems 6 to 8: pN_... SQL can't tell tokens or find spans on whole tables, so these are tested by brute
force; what any packing of known sizes must hold is checked in SQL (p7_checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paritas.llm.bpe import token_counts, token_ids
from paritas.llm.packing import CAPACITY, pack
from paritas.llm.spans import shared_spans
from paritas.sources.tables import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans(table(spark, d, "documents"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of a packing, with sizes that SQL knows (five characters a token, rounded up): every piece once, all
    tokens, none above the capacity, no overlap, and hardly a container too many."""
    sizes = table(spark, d, "documents").select("doc_id", F.ceil(F.length("text") / 5).alias("n_tokens"))
    packed = pack(sizes)
    end = F.col("start_token") + F.col("n_tokens")
    free = Window.partitionBy("container_id").orderBy("start_token")
    placed = packed.withColumn("apart", F.coalesce(F.lag(end).over(free), F.lit(0)) <= F.col("start_token"))
    found = placed.agg(
        F.count(F.lit(1)).alias("pieces"), F.count_distinct("doc_id", "piece_no").alias("different"), F.sum("n_tokens").alias("tokens"), F.max(end).alias("fullest"), F.bool_and("apart").alias("apart"),
        F.count_distinct("container_id").alias("containers"),
    )
    least = F.ceil(F.col("tokens") / CAPACITY)
    return found.select("pieces", "different", "tokens", (F.col("fullest") <= CAPACITY).alias("fits"), "apart", (F.col("containers") <= least * 1.02 + 1).alias("tight"))


QUERIES = {f.__name__: f for f in (p6_ids, p7_containers, p7_checks, p8_found)}

SQL: dict[str, str] = {
    "p7_checks": """WITH s AS (SELECT CAST(ceil(length(text) / 5) AS bigint) AS n FROM documents WHERE length(text) > 0)
      SELECT CAST(sum((n + 4095) // 4096) AS bigint) AS pieces, CAST(sum((n + 4095) // 4096) AS bigint) AS different, CAST(sum(n) AS bigint) AS tokens, true AS fits, true AS apart, true AS tight FROM s"""
}
