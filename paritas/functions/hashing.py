"""Canonical text and digests of values and rows.

A row's canonical text is JSON with sorted names and explicit nulls, so a number and its text differ. Digests are equal
exactly when canonical texts are; they are this engine's own and not meant to equal those of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns with this prefix describe a row and are no part of it.
SYSTEM_PREFIX = "_par_"


def strip_system(df: DataFrame, prefix: str = SYSTEM_PREFIX) -> DataFrame:
    """df without the columns that begin with the prefix."""
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def json_string(c: Column) -> Column:
    """A text as a JSON string, quoted and escaped; null stays null."""
    listed = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))


def canonical_json(columns: list[str]) -> Column:
    """The named columns as one JSON object, names sorted, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"})


def sha256_text(c: Column) -> Column:
    """Digest of a text's canonical form, which has its quotes."""
    return F.sha2(json_string(c), 256)


def row_fingerprint(columns: list[str]) -> Column:
    """Digest of the named columns."""
    return F.sha2(canonical_json(columns), 256)


def fast_fingerprint(*columns: Column) -> Column:
    """A 64-bit digest for partitioning and prefiltering, where equal digests needn't mean equal rows."""
    return F.xxhash64(*columns)


def labelled_fingerprint(columns: dict[str, Column]) -> Column:
    """The 64-bit digest of `name=value` texts joined by `|`, names in lower case and sorted; a null value is empty."""
    parts = [F.concat(F.lit(f"{k.lower()}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in sorted(columns.items())]
    return F.xxhash64(F.concat_ws("|", *parts))


def bucket(key: Column, buckets: int) -> Column:
    """The bucket of a key: the first 32 bits of its text's digest, modulo buckets. A null key is the text None."""
    digest = sha256_text(F.coalesce(key.cast("string"), F.lit("None")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def merkle_root(leaves: Column, height: Column | None = None) -> Column:
    """Root of an array of hex digests: neighbours are joined and digested level by level, the last of an odd level with
    itself; the root of one leaf is the leaf, of none the digest of the empty text. A height that isn't null is the number
    of levels, whatever the size: a node left alone is joined with itself up to there, as below the root of a larger tree."""
    size = F.size(leaves)
    top = F.when(size > 1, F.ceil(F.log2(size)).cast("int")).otherwise(0)
    top = top if height is None else F.coalesce(height, top)
    levels = F.when(top > 0, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>"))

    def level(nodes: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(nodes) / 2).cast("int") - 1, F.lit(0)))
        node = lambda i: F.get(nodes, F.least(i, F.size(nodes) - 1))
        return F.transform(pairs, lambda i: sha256_text(F.concat(node(2 * i), node(2 * i + 1))))

    return F.when(size > 0, F.get(F.aggregate(levels, leaves, level), F.lit(0))).otherwise(sha256_text(F.lit("")))
