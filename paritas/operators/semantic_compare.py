"""Rows compared by bytes and by meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.functions.hashing import row_fingerprint, strip_system
from paritas.functions.semantic import semantic_columns, semantic_fingerprint
from paritas.operators.reconcile import merkle_buckets, text_key


def compare_rows(source: DataFrame, target: DataFrame, key: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """k, byte_equivalent, semantic_equivalent and the digests they compare (source_byte_hash, target_byte_hash,
    source_semantic_hash, target_semantic_hash) of keys on both sides. Of repeated keys the least digests stand."""

    def side(df: DataFrame, b: str, s: str) -> DataFrame:
        plain = strip_system(df)
        hashed = plain.select(text_key(key).alias("k"), row_fingerprint(plain.columns).alias(b), semantic_fingerprint(plain, aliases).alias(s))
        return hashed.groupBy("k").agg(F.min(b).alias(b), F.min(s).alias(s))

    names = [(f"{x}_byte_hash", f"{x}_semantic_hash") for x in ("source", "target")]
    (b1, s1), (b2, s2) = names
    both = side(source, b1, s1).join(side(target, b2, s2), "k")
    return both.select("k", (F.col(b1) == F.col(b2)).alias("byte_equivalent"), (F.col(s1) == F.col(s2)).alias("semantic_equivalent"), b1, b2, s1, s2)


def semantic_buckets(df: DataFrame, key: str, aliases: dict[str, str] | None = None, buckets: int = 16, parts: int | None = None) -> DataFrame:
    """Merkle buckets over the meanings of rows: bucket, n, root."""
    meant = df.select(F.col(f"`{key}`").alias("_key"), *semantic_columns(df, aliases))
    return merkle_buckets(meant, "_key", [c for c in meant.columns if c != "_key"], buckets, parts)
