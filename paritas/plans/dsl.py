"""A small language of field transformations, compiled once to columns.

`OP(arg, ..., key=literal)`, one call without nesting. An argument is `source.field`, a number, a quoted text or a bare
word. Every expression gives four columns: its value, the error of a bad value (null when there is none), warnings, and
its inputs are known on the driver; so a row's bad fields and its lineage are plain columns as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritas.functions.hashing import SYSTEM_PREFIX, row_fingerprint
from paritas.functions.semantic import strip

OPERATIONS = (
    "IDENTITY", "TRIM", "UPPER", "LOWER", "PARSE_DATE", "DECIMAL", "MAP_ENUM", "SPLIT_NAME", "NORMALIZE_CURRENCY", "COALESCE",
)
DATE_FORMS = {"YYYY-MM-DD": "%Y-%m-%d", "DD/MM/YYYY": "%d/%m/%Y"}
#: What the directives of a date form are to Spark; unpadded numbers are read too.
_DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s", "%y": "yy", "%b": "MMM", "%B": "MMMM"}
_LEXEME = re.compile(r'\s*(?:(?P<word>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)|"(?P<text>(?:[^"\\]|\\.)*)"|(?P<number>-?\d+(?:\.\d+)?)|(?P<mark>[(),={}:]))')


class DslError(ValueError):
    """An expression that isn't of the language."""


@dataclass(frozen=True)
class Field:
    """A reference to a field of the source row."""

    name: str


@dataclass(frozen=True)
class Expression:
    operation: str
    arguments: tuple[Any, ...]
    options: tuple[tuple[str, Any], ...] = ()

    @property
    def inputs(self) -> tuple[str, ...]:
        return tuple(a.name for a in self.arguments if isinstance(a, Field))

    def option(self, name: str, default: Any = None) -> Any:
        return dict(self.options).get(name, default)


@dataclass(frozen=True)
class Compiled:
    value: Column
    error: Column
    warning: Column
    expression: Expression


class _Reader:
    def __init__(self, text: str):
        self.items: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = _LEXEME.match(text, at)
            if not m:
                raise DslError(f"unreadable at {at}: {text[at : at + 20]!r}")
            kind = m.lastgroup or "text"
            self.items.append((kind, m.group(kind)))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else ("end", "")

    def next(self) -> tuple[str, str]:
        item = self.peek()
        self.at += 1
        return item

    def mark(self, mark: str) -> None:
        if self.next() != ("mark", mark):
            raise DslError(f"{mark!r} expected")

    def literal(self) -> Any:
        kind, text = self.next()
        if kind == "number":
            return float(text) if "." in text else int(text)
        if kind == "text":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text)
        if kind == "word":
            return Field(text[7:]) if text.startswith("source.") else text
        if (kind, text) == ("mark", "{"):  # {"A": "x", ...}: an extension, for MAP_ENUM and rates
            out = {}
            while self.peek() != ("mark", "}"):
                key = self.literal()
                self.mark(":")
                out[str(key)] = self.literal()
                if self.peek() == ("mark", ","):
                    self.next()
            self.mark("}")
            return out
        raise DslError(f"a literal expected, not {text or kind!r}")


def parse(text: str) -> Expression:
    """The expression of a text; DslError when it isn't one."""
    reader = _Reader(text)
    kind, operation = reader.next()
    if kind != "word" or operation not in OPERATIONS:
        raise DslError(f"unknown operation {operation!r}")
    reader.mark("(")
    arguments, options = [], []
    while reader.peek() != ("mark", ")"):
        if reader.peek()[0] == "word" and reader.peek(1) == ("mark", "="):
            name = reader.next()[1]
            reader.mark("=")
            options.append((name, reader.literal()))
        else:
            arguments.append(reader.literal())
        if reader.peek() != ("mark", ")"):
            reader.mark(",")
    reader.mark(")")
    if reader.peek()[0] != "end":
        raise DslError("one call without nesting or anything after it")
    if not arguments:
        raise DslError(f"{operation} needs an argument")
    return Expression(operation, tuple(arguments), tuple(options))


def date_pattern(form: str) -> str:
    """A date form (an alias or %-directives) as Spark's pattern."""
    form = DATE_FORMS.get(form, form)
    parts = re.split(r"(%[A-Za-z])", form)
    if any(p.startswith("%") and p not in _DIRECTIVES for p in parts):
        raise DslError(f"unknown date form {form!r}")
    return "".join(_DIRECTIVES.get(p) or re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", p) for p in parts)


def _decimal(text: Column, scale: int) -> Column:
    """Half-even at the scale, as text; null when it is no number of at most 28 digits in all."""
    plain = F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,2})?\z"), text)
    value = plain.try_cast("decimal(38,18)")
    return F.when(F.abs(value) < F.lit(10).cast("decimal(38,0)") ** (28 - scale), F.bround(value, scale).cast(f"decimal(38,{scale})").cast("string"))


def compile_expression(expression: Expression | str, types: dict[str, str]) -> Compiled:
    """The columns of an expression over rows of the given types (name: Spark type).

    A field that the rows lack is null. Null and empty inputs give null with the warning NULL_INPUT; a value that can't
    be transformed gives null with an error, whatever its kind: no bad value fails the job.
    """
    e = parse(expression) if isinstance(expression, str) else expression

    def column(a: Any) -> Column:
        if isinstance(a, Field):
            return F.col(f"`{a.name}`") if a.name in types else F.lit(None).cast("string")
        return F.lit(a)

    args = [column(a) for a in e.arguments]
    text = args[0].cast("string") if e.operation != "IDENTITY" else args[0]
    none, given = F.lit(None).cast("string"), F.coalesce(text != "", F.lit(False)) if e.operation != "IDENTITY" else F.lit(True)
    error, warning = none, F.when(~given, "NULL_INPUT")
    if e.operation == "IDENTITY":
        value, warning = text, none
    elif e.operation in ("TRIM", "UPPER", "LOWER"):
        value = {"TRIM": lambda c: c, "UPPER": F.upper, "LOWER": F.lower}[e.operation](strip(text))
        warning = F.when(text.isNull(), "NULL_INPUT")
    elif e.operation == "PARSE_DATE":
        form = str(e.arguments[1]) if len(e.arguments) > 1 else "%Y-%m-%d"
        value = F.to_date(F.try_to_timestamp(strip(text), F.lit(date_pattern(form)))).cast("string")
        error = F.when(given & value.isNull(), F.concat(F.lit("invalid date: "), text))
    elif e.operation == "DECIMAL":
        value = _decimal(strip(text), int(e.option("scale", 4)))
        error = F.when(given & value.isNull(), F.concat(F.lit("invalid decimal: "), text))
    elif e.operation == "MAP_ENUM":
        names = e.arguments[1] if len(e.arguments) > 1 and isinstance(e.arguments[1], dict) else e.option("mapping", {})
        pairs = [F.lit(x) for k, v in names.items() for x in (str(k), str(v))]
        value = F.try_element_at(F.create_map(*pairs), F.coalesce(text, F.lit("None"))) if pairs else none
        warning = none
    elif e.operation == "SPLIT_NAME":
        parts = F.split(strip(text), r"(?U)\s+", 2)
        part = lambda i: F.when(given, F.coalesce(F.get(parts, F.lit(i)), F.lit(""))).otherwise("")
        value = F.struct(part(0).alias("first_name"), part(1).alias("last_name"))
    elif e.operation == "NORMALIZE_CURRENCY":
        if len(args) < 2:
            raise DslError("NORMALIZE_CURRENCY needs an amount and a currency")
        currency = args[1].cast("string")
        given = given & F.coalesce(currency != "", F.lit(False))
        pairs = [x for k, v in e.option("rates", {}).items() for x in (F.lit(str(k)), F.lit(str(v)).cast("decimal(18,9)"))]
        one = F.lit(1).cast("decimal(18,9)")
        rate = F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(currency)), one) if pairs else one
        amount = F.when(strip(text).rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\z"), strip(text).try_cast("decimal(19,9)"))
        value = F.when(given, F.bround(amount * rate, 4).cast("decimal(38,4)").cast("string"))
        error = F.when(given & amount.isNull(), F.concat(F.lit("invalid decimal: "), text))
        warning = F.when(~given, "NULL_INPUT")
    else:  # COALESCE: an empty text counts as null
        value = F.coalesce(*[F.nullif(a.cast("string"), F.lit("")) for a in args])
        warning = F.when(value.isNull(), "ALL_NULL")
    return Compiled(value, error, warning, e)


def transform(df: DataFrame, transformations: dict[str, str | Expression]) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows. Good rows keep their source columns, with the target fields added or replaced, the system
    columns lineage (what made each field, with warnings) and source_fingerprint. Bad rows keep their source columns,
    with failed_field and failure_reason of the first field that failed, and the fingerprint. Every row is in one."""
    types = dict(df.dtypes)
    compiled = {f: compile_expression(x, types) for f, x in transformations.items()}
    failed = [F.when(c.error.isNotNull(), F.struct(F.lit(f).alias("failed_field"), c.error.alias("failure_reason"))) for f, c in compiled.items()]
    first = F.coalesce(*failed) if failed else F.lit(None).cast("struct<failed_field:string,failure_reason:string>")
    lineage = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.lit(c.expression.operation).alias("operation"),
                F.array(*[F.lit(i) for i in c.expression.inputs]).cast("array<string>").alias("inputs"),
                c.warning.alias("warning"),
            )
            for f, c in compiled.items()
        ]
    )
    fingerprint = row_fingerprint([c for c in df.columns if not c.startswith(SYSTEM_PREFIX)]).alias(f"{SYSTEM_PREFIX}source_fingerprint")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in compiled]
    good = df.where(first.isNull()).select(
        *kept, *[c.value.alias(f) for f, c in compiled.items()], lineage.alias(f"{SYSTEM_PREFIX}lineage"), fingerprint
    )
    bad = df.select("*", first.alias(f"{SYSTEM_PREFIX}failure"), fingerprint).where(F.col(f"{SYSTEM_PREFIX}failure").isNotNull())
    return good, bad.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{SYSTEM_PREFIX}failure.*"), F.col(f"{SYSTEM_PREFIX}source_fingerprint"))
