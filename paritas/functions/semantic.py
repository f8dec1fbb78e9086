"""Values in a form that is equal for equal meanings: moments, numbers and texts however written."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.hashing import SYSTEM_PREFIX

#: Forms of a moment (fixed values); all mean UTC.
MOMENTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd")
_NUMBER = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
#: Numbers whose point is farther than this from their digits are written with an exponent.
_FAR = 40
#: White space around and within a text, Unicode's included.
_EDGES, _RUN = r"(?U)\A\s+|\s+\z", r"(?U)\s+"


def strip(c: Column) -> Column:
    """A text without white space of any kind around it."""
    return F.regexp_replace(c.cast("string"), _EDGES, "")


def plain_number(c: Column) -> Column:
    """The number that a text writes, in the one form that all its notations share: 10.0, 10 and 1.0E1 alike are 10, minus
    nought is 0. It is worked out on the digits, so nothing is rounded, however long they are; very large and very small
    numbers are digits and an exponent, 7E+99. Null for what is no number, or one whose exponent no long holds."""
    text = F.when(c.rlike(_NUMBER), c)
    mantissa = F.regexp_extract(text, r"\A[+-]?([0-9.]+)", 1)
    whole, part = F.substring_index(mantissa, ".", 1), F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")
    exponent = F.when(text.rlike("[eE]"), F.regexp_extract(text, r"[eE]([+-]?[0-9]+)", 1).try_cast("long")).otherwise(F.lit(0).cast("long"))
    digits = F.concat(whole, part)
    led = F.regexp_replace(digits, r"\A0+", "")
    # Where the point stands, counted from the first digit that isn't nought.
    point = F.try_add(exponent, (F.length(whole) - F.length(digits) + F.length(led)).cast("long"))
    parts = F.array(F.struct(F.regexp_replace(led, r"0+\z", "").alias("d"), point.alias("at"), text.startswith("-").alias("minus")))

    def written(x: Column) -> Column:
        d, n, at = x["d"], F.length(x["d"]), x["at"]
        near = F.least(F.greatest(at, F.lit(-_FAR)), F.lit(_FAR)).cast("int")
        noughts = lambda many: F.repeat(F.lit("0"), many)
        form = (
            F.when((at > 0) & (at < n), F.concat(F.substring(d, F.lit(1), at.cast("int")), F.lit("."), F.substring(d, at.cast("int") + 1, n)))
            .when((at >= n) & (at <= _FAR), F.concat(d, noughts(near - n)))
            .when((at <= 0) & (at > -_FAR), F.concat(F.lit("0."), noughts(-near), d))
            .otherwise(F.concat(d, F.lit("E"), F.when(at - n >= 0, "+").otherwise(""), (at - n).cast("string")))
        )
        return F.when(d == "", "0").otherwise(F.concat(F.when(x["minus"], "-").otherwise(""), form))

    return F.when(point.isNotNull(), F.get(F.transform(parts, written), F.lit(0)))


@cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """Unicode's full case folding, by rule: characters folded to one, those, and characters folded to several."""
    folded = {chr(c): chr(c).casefold() for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000}
    one = {a: b for a, b in folded.items() if a != b and len(b) == 1}
    return "".join(one), "".join(one.values()), {a: b for a, b in folded.items() if len(b) > 1}


def casefold(c: Column) -> Column:
    """A text without differences of case: Unicode's full case folding, also of letters that fold to several."""
    one, to, several = _foldings()
    plain = F.translate(c, one, to)
    pairs = F.split(F.lit("\n".join(f"{a}\t{b}" for a, b in several.items())), "\n")
    unfolded = F.aggregate(pairs, plain, lambda text, p: F.replace(text, F.substring_index(p, "\t", 1), F.substring_index(p, "\t", -1)))
    ascii_only = F.octet_length(c) == F.char_length(c)
    return F.when(ascii_only, F.lower(c)).when(plain.rlike("[" + "".join(several) + "]"), unfolded).otherwise(plain)


def normalize_text(c: Column) -> Column:
    """A text's meaning: a moment as ISO in UTC, else a number in its one form, else folded with single spaces."""
    text = strip(c)
    moment = F.coalesce(*[F.try_to_timestamp(text, F.lit(m)) for m in MOMENTS])
    return F.coalesce(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        plain_number(text),
        casefold(F.regexp_replace(text, _RUN, " ")),
    )


def normalize_scalar(c: Column, kind: str) -> Column:
    """The meaning of a value of a Spark type; a number equals its text. Null and booleans stay as they are (as text)."""
    if kind == "string":
        return normalize_text(c)
    if kind in ("tinyint", "smallint", "int", "bigint") or kind.startswith("decimal"):
        return plain_number(c.cast("string"))
    if kind in ("double", "float"):
        return F.coalesce(plain_number(c.cast("string")), F.lower(c.cast("string")))
    return c.cast("string")


def semantic_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> list[Column]:
    """The meanings of a row's columns, renamed by aliases, sorted by name, system columns left out."""
    named = {(aliases or {}).get(c, c): (c, t) for c, t in df.dtypes if not c.startswith(SYSTEM_PREFIX)}
    return [normalize_scalar(F.col(f"`{c}`"), t).alias(name) for name, (c, t) in sorted(named.items())]


def semantic_fingerprint(df: DataFrame, aliases: dict[str, str] | None = None) -> Column:
    """Digest of a row's meaning."""
    return F.sha2(F.to_json(F.struct(*semantic_columns(df, aliases)), {"ignoreNullFields": "false"}), 256)


def normalize_number_text(c: Column) -> Column:
    """A number's text: whole numbers without a point, others with up to 12 places; what is no number, trimmed and in
    lower case."""
    text = F.trim(c.cast("string"))
    d = F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))
    places = F.format_string("%.12f", d)
    bare = F.regexp_replace(F.regexp_replace(places, r"0+\z", ""), r"\.\z", "")
    return F.when(d == F.floor(d), F.format_string("%.0f", d)).when(d.isNotNull(), bare).otherwise(F.lower(text))
