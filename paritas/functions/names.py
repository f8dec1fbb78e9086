"""What the names of columns tell: tokens, likeness, suffixes and classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a class, between underscores or at the ends of a name (fixed values).
CLASSES = {
    "profile_pii": ("email", "phone", "address", "ssn", "tax", "gov", "passport", "card", "account", "customer", "dob"),
    "identifier": ("id", "no", "number", "code", "key", "ref"),
    "temporal": ("date", "time", "timestamp", "created", "updated", "closed", "opened", "effective", "event"),
    "monetary": ("amount", "balance", "price", "fee", "debit", "credit", "value", "revenue", "cost"),
    "pii": ("name", "email", "phone", "address", "ssn", "tax", "passport", "dob", "birth"),
    "categorical": ("status", "state", "type", "stage", "phase"),
}
#: Endings that mark a reference or key (fixed values).
SUFFIXES = ("_ref", "_id", "_no", "_number", "_key")


def pattern(kind: str) -> str:
    return rf"(?i)(^|_)({'|'.join(CLASSES[kind])})(_|$)"


def is_kind(name: Column, kind: str) -> Column:
    """Does a name have a word of the class?"""
    return name.rlike(pattern(kind))


def named_like(name: str, kind: str) -> bool:
    return re.search(pattern(kind), name) is not None


def without_suffix(name: Column) -> Column:
    """A name in lower case without one ending that marks a reference."""
    return F.regexp_replace(F.lower(name), rf"({'|'.join(SUFFIXES)})$", "")


def tokens(name: Column) -> Column:
    """The distinct words of a name, in lower case."""
    words = F.split(F.lower(name), r"[_\W]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def likeness(left: Column, right: Column) -> Column:
    """Words that two names share among all their words; 0 when either has none."""
    a, b = tokens(left), tokens(right)
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
