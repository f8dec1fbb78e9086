"""Cleaning of text values: trimming, key form, status and amount notations, days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that surround a value without belonging to it.
BLANKS = " \t\r\n"

#: Spellings of a status (fixed values).
ACTIVE = ("Y", "YES", "1", "ACTIVE", "A")
CLOSED = ("N", "NO", "0", "CLOSED", "X")

AMOUNT_TYPE = "decimal(30,6)"


def trimmed(c: Column) -> Column:
    """Without surrounding spaces, tabs and line breaks; null when nothing is left."""
    return F.nullif(F.btrim(c.cast("string"), F.lit(BLANKS)), F.lit(""))


def key_form(c: Column) -> Column:
    """trimmed, in upper case: the form in which keys and references are compared."""
    return F.upper(trimmed(c))


def normalize_status(c: Column) -> Column:
    """ACTIVE, CLOSED or UNKNOWN; null and blank are UNKNOWN."""
    form = key_form(c)
    return F.when(form.isin(*ACTIVE), "ACTIVE").when(form.isin(*CLOSED), "CLOSED").otherwise("UNKNOWN")


def amount(c: Column, is_text: bool) -> Column:
    """A number as decimal(30,6), rounded half up, which absorbs float noise. Text may have thousands commas, a
    leading sign, or parentheses for a negative. Null when it isn't such a number (see unparsed)."""
    if not is_text:
        return c.try_cast(AMOUNT_TYPE)
    text = trimmed(c)
    negative = text.rlike(r"^\(.*\)$")
    digits = F.regexp_replace(text, r"[(),\s]", "")
    # A form check keeps out what a cast to decimal would also take, such as 1e5.
    value = F.when(digits.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), digits.try_cast(AMOUNT_TYPE))
    return F.when(negative, -value).otherwise(value)


def unparsed(c: Column, is_text: bool) -> Column:
    """What stands for a value that is present but is no amount: it is compared as text."""
    shown = trimmed(c) if is_text else c.cast("string")
    return F.when(amount(c, is_text).isNull(), shown)


def day(c: Column, is_text: bool) -> Column:
    """The calendar day of a timestamp, or of a `YYYY-MM-DD` text; null when there is none."""
    if is_text:
        return F.try_to_date(trimmed(c), "yyyy-MM-dd")
    return F.to_date(c)
