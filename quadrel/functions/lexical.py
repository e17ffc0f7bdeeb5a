"""Lexical forms of typed values as column tests and casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The lexical forms.
INTEGER = r"^[+-]?[0-9]+\z"
DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"


def cut(text: Column) -> Column:
    """Without outer spaces, tabs and line ends."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+\z", "")


def as_integer(text: Column) -> Column:
    return F.when(text.rlike(INTEGER), text.try_cast("decimal(38,0)"))


def as_double(text: Column) -> Column:
    return F.when(text.rlike(DOUBLE), text.try_cast("double"))


def as_date(text: Column) -> Column:
    return F.when(text.rlike(DATE), text.try_cast("date"))


def as_boolean(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin("true", "1"), F.lit(True)).when(low.isin("false", "0"), F.lit(False))


def typed(text: Column, kind: str) -> Column:
    """The value of a cut lexical form, null where it isn't valid: integer, double, date (a ``Z`` may follow),
    boolean (any case), string (not empty)."""
    if kind == "integer":
        return as_integer(text)
    if kind == "double":
        return as_double(text)
    if kind == "date":
        return as_date(F.regexp_replace(text, r"Z\z", ""))
    if kind == "boolean":
        return as_boolean(text)
    if kind == "string":
        return F.when(text != "", text)
    raise ValueError(f"unknown type {kind}")


def valid(text: Column, kind: str) -> Column:
    """Whether a cut lexical form is valid; integers of any length are."""
    return F.coalesce(text.rlike(INTEGER) if kind == "integer" else typed(text, kind).isNotNull(), F.lit(False))
