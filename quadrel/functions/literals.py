"""Typed literals: canonical forms, values, comparison and the order of terms."""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrel.functions.lexical import as_date
from quadrel.functions.text import fold
from quadrel.schema import BNODE, LITERAL, RDF, XSD

# The integer types of XML Schema and their limits.
INTEGER_LIMITS: dict[str, tuple[int | None, int | None]] = {
    "integer": (None, None), "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
}
FLOATS = ("double", "float")
_INT = [XSD + n for n in INTEGER_LIMITS]
# In Java "$" also stands before a last line end, so column patterns end in \z.
_NUMBER_FORM = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_NUMBER = rf"^{_NUMBER_FORM}\z"


#: Hooks that the user of the library sets. ``IN_GROUND_TYPE``: called with (value, type or None) before anything else, give (text, type, lang) or None.
#: ``OUT_TYPE``: datatype -> function from the text to a host value, used by ``host_value``.
IN_GROUND_TYPE: list[Callable[[object, str | None], tuple[str, str | None, str | None] | None]] = []
OUT_TYPE: dict[str, Callable[[str], object]] = {}


class LiteralError(ValueError):
    """A value that isn't in the value space of its type."""


def xsd_double(x: float) -> str:
    """The canonical form: one digit before the point, at least one behind, and an exponent."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "INF" if x > 0 else "-INF"
    mantissa, exponent = f"{Decimal(repr(x)):E}".split("E") if x else ("0.0", "0")
    mantissa = mantissa.rstrip("0").rstrip(".") if "." in mantissa else mantissa
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{int(exponent)}"


def canonical(value, type_: str | None = None, lang: str | None = None) -> tuple[str, str | None, str | None]:
    """Text, datatype and language of a host value or lexical form, in canonical form. Language tags are lower case; integers lose
    leading zeros and must be within their type's limits; booleans may be given as true, "true", 1 or 0."""
    if lang is not None:
        return str(value), None, lang.lower()
    for hook in IN_GROUND_TYPE:
        if (found := hook(value, type_)) is not None:
            return found
    if type_ is None:
        if isinstance(value, bool):
            return ("true" if value else "false"), XSD + "boolean", None
        if isinstance(value, int):
            return str(value), XSD + "integer", None
        if isinstance(value, (float, Decimal)):
            return xsd_double(float(value)), XSD + "double", None
        if isinstance(value, dt.datetime):
            return value.isoformat(), XSD + "dateTime", None
        if isinstance(value, dt.date):
            return value.isoformat(), XSD + "date", None
        if isinstance(value, dt.time):
            return value.isoformat(), XSD + "time", None
        return str(value), XSD + "string", None
    name = type_.removeprefix(XSD)
    if name in INTEGER_LIMITS and type_.startswith(XSD):
        if not isinstance(value, int) and not re.fullmatch(r"[+-]?[0-9]+", str(value)):
            raise LiteralError(f"not an integer: {value!r}")
        low, high = INTEGER_LIMITS[name]
        n = int(value)
        if (low is not None and n < low) or (high is not None and n > high):
            raise LiteralError(f"{n} is not of {name}")
        return str(n), type_, None
    if name in (*FLOATS, "decimal") and type_.startswith(XSD):
        text = str(value)
        if text in ("INF", "-INF", "NaN"):
            return text, type_, None
        if not re.fullmatch(_NUMBER_FORM, text):
            raise LiteralError(f"not a number: {value!r}")
        if name == "decimal":
            d = format(Decimal(text).normalize(), "f")
            return (d if "." in d else d + ".0"), type_, None
        return xsd_double(float(text)), type_, None
    if type_ == XSD + "boolean":
        found = {"true": "true", "1": "true", "false": "false", "0": "false"}.get(str(value).lower())
        if found is None:
            raise LiteralError(f"not a boolean: {value!r}")
        return found, type_, None
    if hasattr(value, "isoformat"):
        value = value.isoformat()
    if type_ == XSD + "date" and not re.fullmatch(r"-?[0-9]{4,}-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})?", str(value)):
        raise LiteralError(f"not a date: {value!r}")
    return str(value), type_, None


def host_value(text: str, type_: str | None) -> object:
    """The host value of a literal: by the hook of its type, else of numbers, booleans and dates; other texts and faulty forms stay texts."""
    if type_ in OUT_TYPE:
        return OUT_TYPE[type_](text)
    name = (type_ or "").removeprefix(XSD)
    try:
        if name in INTEGER_LIMITS:
            return int(text)
        if name in FLOATS:
            return float(text.replace("INF", "inf"))
        if name == "decimal":
            return Decimal(text)
        if name == "date":
            return dt.date.fromisoformat(text)
    except (ValueError, ArithmeticError):
        return text
    return {"true": True, "1": True, "false": False, "0": False}.get(text, text) if name == "boolean" else text


def is_numeric(o_dt: Column) -> Column:
    """Whether a datatype is numeric; float and nonNegativeInteger are."""
    return F.coalesce(o_dt.isin(*_INT, XSD + "decimal", *(XSD + f for f in FLOATS)), F.lit(False))


def numeric_value(o: Column, o_dt: Column) -> Column:
    """The value of a numeric literal as a double, null for all others and for faulty forms."""
    return F.when(is_numeric(o_dt) & o.rlike(_NUMBER), o.try_cast("double"))


def integer_value(o: Column, o_dt: Column) -> Column:
    """The value of an integer literal, exact up to 38 digits."""
    return F.when(o_dt.isin(_INT) & o.rlike(r"^[+-]?[0-9]+\z"), o.try_cast("decimal(38,0)"))


def integer_key(o: Column, o_dt: Column) -> Column:
    """A struct that orders integers of any length by value: signed number of digits, then the digits (of negative ones complemented). Null for others."""
    digits = F.regexp_extract(o, r"^[+-]?0*([0-9]+)\z", 1)
    minus = o.startswith("-") & (digits != "0")
    key = F.struct(
        F.when(digits == "0", 0).when(minus, -F.length(digits)).otherwise(F.length(digits)).alias("size"),
        F.when(minus, F.translate(digits, "0123456789", "9876543210")).otherwise(digits).alias("digits"))
    return F.when(o_dt.isin(_INT) & o.rlike(r"^[+-]?[0-9]+\z"), key)


def primitive(o_dt: Column) -> Column:
    """0 not numeric, 1 integer, 2 decimal, 3 double or float."""
    return F.when(o_dt.isin(_INT), 1).when(o_dt == XSD + "decimal", 2).when(o_dt.isin(*(XSD + f for f in FLOATS)), 3).otherwise(0)


def canonical_text(o: Column, o_dt: Column) -> Column:
    """The canonical lexical form of integers (no sign + or leading zeros) and booleans as a column; others stay."""
    number = F.regexp_replace(F.regexp_replace(o, r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
    low = F.lower(o)
    return (
        F.when(o_dt.isin(_INT) & o.rlike(r"^[+-]?[0-9]+\z"), F.when(number == "-0", "0").otherwise(number))
        .when((o_dt == XSD + "boolean") & low.isin("true", "1"), "true").when((o_dt == XSD + "boolean") & low.isin("false", "0"), "false").otherwise(o)
    )


def in_limits(o: Column, o_dt: Column) -> Column:
    """Whether an integer literal is within its type's limits; true for other types."""
    out, key = F.lit(True), integer_key(o, o_dt)
    of = lambda n: integer_key(F.lit(str(n)), F.lit(XSD + "integer"))
    for name, (low, high) in INTEGER_LIMITS.items():
        ok = key.isNotNull()
        if low is not None:
            ok = ok & (key >= of(low))
        if high is not None:
            ok = ok & (key <= of(high))
        out = F.when(o_dt == XSD + name, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def typed_values(o: Column, o_dt: Column) -> dict[str, Column]:
    """Values of the literal types that have one, each null for literals of other types or faulty form."""
    x = lambda n: o_dt == XSD + n
    stamp = F.regexp_extract(o, r"^(-?[0-9]{4,}-[0-9]{2}-[0-9]{2}T[0-9:.]+?)(Z|[+-][0-9]{2}:[0-9]{2})?\z", 1)
    zone = F.regexp_extract(o, r"T[0-9:.]+?(Z|[+-][0-9]{2}:[0-9]{2})\z", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(zone == "Z", 0).when(zone != "", sign * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 5, 2).try_cast("int") * 60))
    clock = F.regexp_extract(o, r"^([0-9]{2}):([0-9]{2}):([0-9.]+)", 1)
    return {
        "v_int": integer_value(o, o_dt), "v_double": numeric_value(o, o_dt), "v_boolean": F.when(x("boolean"), o.isin("true", "1")),
        "v_date": F.when(x("date"), as_date(F.regexp_replace(o, r"(Z|[+-][0-9]{2}:[0-9]{2})\z", ""))),
        "v_timestamp": F.when(x("dateTime") & (stamp != ""), stamp.try_cast("timestamp_ntz")), "v_tz_sec": F.when(x("dateTime"), offset),
        "v_seconds": F.when(x("time") & (clock != ""), clock.cast("int") * 3600 + F.substring(o, 4, 2).cast("int") * 60 + F.regexp_extract(o, r"^[0-9:]{6}([0-9.]+)", 1).try_cast("double")),
        "v_year": F.when(x("gYear") | x("gYearMonth"), F.regexp_extract(o, r"^(-?[0-9]{4,})", 1).try_cast("int")),
        "v_month": F.when(x("gMonth") | x("gMonthDay"), F.regexp_extract(o, r"^--([0-9]{2})", 1).try_cast("int")).when(x("gYearMonth"), F.regexp_extract(o, r"-([0-9]{2})", 1).try_cast("int")),
        "v_day": F.when(x("gDay"), F.regexp_extract(o, r"^---([0-9]{2})", 1).try_cast("int")).when(x("gMonthDay"), F.regexp_extract(o, r"^--[0-9]{2}-([0-9]{2})", 1).try_cast("int")),
    }


def order_key(o: str = "o", o_kind: str = "o_kind", o_dt: str = "o_dt", o_lang: str = "o_lang") -> list[Column]:
    """Columns to sort terms by: literals before blank nodes before IRIs; numbers by value (double, decimal, integer where equal; integers
    of any length exactly) before texts; texts folded, then as they are; then typed before language-tagged, then by type or tag."""
    text, kind, dtype = F.col(o), F.col(o_kind), F.col(o_dt)
    value = F.when(kind == LITERAL, numeric_value(text, dtype))
    # A number of an integer type in another form, as "8.", stands with the integer of its value.
    round_ = F.when((value == F.floor(value)) & (F.abs(value) < 2**53), integer_key(value.try_cast("bigint").cast("string"), dtype))
    return [
        F.when(kind == LITERAL, 0).when(kind == BNODE, 1).otherwise(2), F.when(value.isNotNull(), 0).otherwise(1), value,
        F.when(value.isNotNull(), -primitive(dtype)).otherwise(0), F.when(value.isNotNull(), F.coalesce(integer_key(text, dtype), round_)), F.upper(fold(text)), text,
        F.when(F.col(o_lang).isNotNull(), 1).otherwise(0), F.coalesce(dtype, F.lit("")), F.coalesce(F.col(o_lang), F.lit("")),
    ]


def compare(op: str, o: Column, o_dt: Column, o_lang: Column, value, type_: str | None = None, lang: str | None = None) -> Column:
    """``o op value``. A number compares with all numeric literals by value; with a type given only literals of that type do. Other
    values compare, in the order of literals, with literals of the same type or language; plain and xsd:string are one type."""
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    ops = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, ">=": lambda a, b: a >= b, ">": lambda a, b: a > b}
    if op not in ops:
        raise ValueError(f"unknown constraint {op!r}")
    if number:
        hit = ops[op](numeric_value(o, o_dt), F.lit(float(value)))
        if isinstance(value, int):
            exact = ops[op](integer_key(o, o_dt), integer_key(F.lit(str(value)), F.lit(XSD + "integer")))
            small = ops[op](integer_value(o, o_dt), F.lit(Decimal(value))) if abs(value) < 10**38 else F.lit(None)
            hit = F.coalesce(small, exact, hit)
        return F.coalesce(hit & ((o_dt == type_) if type_ else F.lit(True)), F.lit(False))
    text, dtype, tag = canonical(value, type_, lang)
    same = (F.lower(o_lang) == tag) if tag else o_lang.isNull() & (F.coalesce(o_dt, F.lit(XSD + "string")) == dtype)
    if op == "==":
        return F.coalesce(same & (o == text), F.lit(False))
    key, other = F.struct(F.upper(fold(o)).alias("f"), o.alias("t")), F.struct(F.upper(fold(F.lit(text))).alias("f"), F.lit(text).alias("t"))
    return F.coalesce(same & ops[op](key, other), F.lit(False))


def compare_terms(a: str, b: str) -> Column:
    """-1, 0 or 1: how the term in columns ``a``, ``a_kind``, ``a_dt``, ``a_lang`` stands to that of ``b`` in the order of terms."""
    out = F.lit(0)
    keys = zip(order_key(*(f"{a}{x}" for x in ("", "_kind", "_dt", "_lang"))), order_key(*(f"{b}{x}" for x in ("", "_kind", "_dt", "_lang"))))
    for x, y in reversed(list(keys)):
        less = F.when(x.isNull(), y.isNotNull()).when(y.isNull(), F.lit(False)).otherwise(x < y)
        out = F.when(x.eqNullSafe(y), out).when(less, -1).otherwise(1)
    return out


LANG_STRING = RDF + "langString"
