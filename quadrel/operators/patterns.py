"""Triple and quad patterns, their joins, constraints on terms, and enumeration of terms."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions import literals as lit
from quadrel.functions import terms
from quadrel.functions.text import fold, lang_matches, match_folded
from quadrel.schema import LITERAL, TRIPLE, XSD, visible

_LIMITS = ("lt", "le", "eq", "ge", "gt")
_SIGN = dict(zip(_LIMITS, ("<", "<=", "==", ">=", ">")))


@dataclass(frozen=True)
class Literal:
    """A literal sought exactly: text with type or language; without either, plain or xsd:string."""

    value: object
    type: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Match:
    """A search in literals. ``how``: plain, exact, icase, substring, word, prefix, like (``value``), lt, le, eq, ge, gt (``value`` with
    optional type or lang), between (``value`` and ``upper``, both included), lang (a language range), type (a datatype)."""

    how: str
    value: object
    upper: object = None
    type: str | None = None
    lang: str | None = None


def object_is(o: str | Literal | Match, alias: str = "", kept: bool = False) -> Column:
    """The test of a pattern's object. ``kept``: the quads keep ``o_fold``, the folded text of literals, and ``o_num``, the number of
    numeric ones (``with_keys``); texts are then compared by the one, and numbers bounded by the other before they are compared exactly, so that both tests reach the scan."""
    c = lambda n: F.col(alias + n)
    if isinstance(o, str):
        return (c("o") == o) & (c("o_kind") != LITERAL)
    literal = c("o_kind") == LITERAL
    if isinstance(o, Literal):
        if o.type is None and o.lang is None and isinstance(o.value, (bool, int, float)):
            text, dtype, tag = lit.canonical(o.value)
        else:
            text, dtype, tag = lit.canonical(o.value, o.type, o.lang)
        if tag:
            return literal & (c("o") == text) & (F.lower(c("o_lang")) == tag)
        return literal & (c("o") == text) & c("o_lang").isNull() & (F.coalesce(c("o_dt"), F.lit(XSD + "string")) == dtype)
    if o.how == "plain":
        return literal & (c("o") == o.value) & c("o_dt").isNull() & c("o_lang").isNull()
    if o.how == "lang":
        return literal & lang_matches(c("o_lang"), o.value)
    if o.how == "type":
        return literal & (F.coalesce(c("o_dt"), F.when(c("o_lang").isNull(), XSD + "string")) == o.value)
    if kept and o.how in (*_LIMITS, "between") and isinstance(o.value, (int, float)) and not isinstance(o.value, bool):
        literal = literal & _bounds(o, c("o_num"))
    if o.how in _LIMITS:
        return literal & lit.compare(_SIGN[o.how], c("o"), c("o_dt"), c("o_lang"), o.value, o.type, o.lang)
    if o.how == "between":
        return literal & lit.compare(">=", c("o"), c("o_dt"), c("o_lang"), o.value, o.type, o.lang) & lit.compare("<=", c("o"), c("o_dt"), c("o_lang"), o.upper, o.type, o.lang)
    return literal & match_folded(o.how, o.value, c("o_fold") if kept else fold(c("o")))


def _bounds(o: Match, number: Column) -> Column:
    """What the double of a number that matches is within; wide by one step, as integers beyond 53 bits are rounded."""
    low = math.nextafter(float(o.value), -math.inf) if o.how in ("eq", "ge", "gt", "between") else None
    high = math.nextafter(float(o.upper if o.how == "between" else o.value), math.inf) if o.how in ("eq", "le", "lt", "between") else None
    test = F.lit(True) if low is None else number >= low
    return test if high is None else test & (number <= high)


def with_keys(quads: DataFrame) -> DataFrame:
    """The quads with ``o_fold`` and ``o_num``, to be written and searched."""
    literal = F.col("o_kind") == LITERAL
    return quads.withColumn("o_fold", F.when(literal, fold(F.col("o")))).withColumn("o_num", F.when(literal, lit.numeric_value(F.col("o"), F.col("o_dt"))))


def _pattern(quads: DataFrame, s, p, o, same: str | None) -> DataFrame:
    if isinstance(s, (Literal, Match)) or isinstance(p, (Literal, Match)):
        return quads.limit(0)  # a literal is no subject or predicate
    out = quads
    if s is not None:
        out = out.where(F.col("s") == s)
    if p is not None:
        out = out.where(F.col("p") == p)
    if o is not None:
        out = out.where(object_is(o, kept={"o_fold", "o_num"} <= set(quads.columns)))
    for pair in (same or "").split():
        a, b = pair
        out = out.where(F.col(a) == F.col(b))
        if "o" in pair:
            out = out.where(F.col("o_kind") != LITERAL)
    return out


def triples(quads: DataFrame, s=None, p=None, o=None, same: str | None = None, generation: int | None = None) -> DataFrame:
    """The distinct visible triples that match; None is unbound. ``same`` names places that must be equal, as ``"so"`` or ``"sp po"``; a
    literal never equals a resource. Rows of several graphs or lines count once."""
    return _pattern(visible(quads, generation), s, p, o, same).select(*TRIPLE).distinct()


def statements(quads: DataFrame, s=None, p=None, o=None, g: str | None = None, line: int | None = None, same: str | None = None, generation: int | None = None) -> DataFrame:
    """The visible quads that match, with graph and line; nothing is removed."""
    out = _pattern(visible(quads, generation), s, p, o, same)
    if g is not None:
        out = out.where(F.col("g") == g)
    if line is not None:
        out = out.where(F.col("line") == line)
    return out.select(*TRIPLE, "g", "line")


def source_location(quads: DataFrame, s: str | None = None) -> DataFrame:
    """The distinct places (g, line) of a subject's statements."""
    return _pattern(visible(quads), s, None, None, None).select("s", "g", "line").distinct()


def estimate(quads: DataFrame, s=None, p=None, o=None) -> DataFrame:
    """One row ``n``: the visible rows that match, exactly; an unknown predicate gives 0."""
    return _pattern(visible(quads), s, p, o, None).agg(F.count(F.lit(1)).alias("n"))


# -- constraints ------------------------------------------------------------------------------------------------


def where(op: str, value, *more, term: str = "o", type: str | None = None, lang: str | None = None) -> Column:  # noqa: A002
    """A constraint on the object's columns, to be used in any ``filter``, before or after other steps alike: ``<``, ``<=``, ``==``, ``>=``,
    ``>`` (a number holds numbers only), ``prefix``, ``substring``, ``word``, ``like``, ``icase``, ``lang_matches``, ``between``."""
    kind, dt, lg = F.col(f"{term}_kind"), F.col(f"{term}_dt"), F.col(f"{term}_lang")
    literal = kind == LITERAL
    if op in ("<", "<=", "==", ">=", ">"):
        return literal & lit.compare(op, F.col(term), dt, lg, value, type, lang)
    if op == "between":
        return where(">=", value, term=term, type=type, lang=lang) & where("<=", more[0], term=term, type=type, lang=lang)
    if op in ("prefix", "substring", "word", "like", "icase"):
        text = F.coalesce(dt, F.lit(XSD + "string")) == XSD + "string"
        return literal & text & match_folded(op, value, fold(F.col(term)))
    if op == "lang_matches":
        return literal & lg.isNotNull() & lang_matches(lg, value)
    raise ValueError(f"unknown constraint {op!r}")


# -- joins of patterns ------------------------------------------------------------------------------------------


def bind(found: DataFrame, **names: str) -> DataFrame:
    """A pattern's columns under variable names: ``bind(t, s="person", o="city")``; an object brings its kind, type and language, as
    ``city_kind``, so that literals and resources don't meet in a join."""
    cols = []
    for place, name in names.items():
        cols.append(F.col(place).alias(name))
        if place == "o":
            cols += [F.col("o_kind").alias(f"{name}_kind"), F.col("o_dt").alias(f"{name}_dt"), F.col("o_lang").alias(f"{name}_lang")]
    return found.select(*cols)


def resources(bound: DataFrame, *names: str) -> DataFrame:
    """Only rows in which these object variables are resources; their qualifier columns are dropped, so they can be joined with subjects."""
    for n in names:
        bound = bound.where(F.col(f"{n}_kind") != LITERAL).drop(f"{n}_kind", f"{n}_dt", f"{n}_lang")
    return bound


def _natural(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join on all shared variables; a type or language that isn't there equals one that isn't there."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("patterns without a shared variable")
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) if c.endswith(("_dt", "_lang")) else F.col(c) == F.col(f"_r_{c}") for c in shared]
    return left.join(other, on, how).drop(*[f"_r_{c}" for c in shared])


def conjunction(*parts: DataFrame) -> DataFrame:
    """All patterns at once: natural inner joins on the variables shared; parts without a shared variable are refused."""
    out = parts[0]
    for p in parts[1:]:
        out = _natural(out, p, "inner")
    return out


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return _natural(left, right, "left")


def exists(left: DataFrame, right: DataFrame) -> DataFrame:
    return _natural(left, right, "left_semi")


def absent(left: DataFrame, right: DataFrame) -> DataFrame:
    return _natural(left, right, "left_anti")


def either(*parts: DataFrame) -> DataFrame:
    """Disjunction, each solution once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# -- enumeration ------------------------------------------------------------------------------------------------

_TERM = ["term", "kind", "dt", "lang"]


def _place(quads: DataFrame, place: str) -> DataFrame:
    if place == "o":
        return quads.select(F.col("o").alias("term"), F.col("o_kind").alias("kind"), F.col("o_dt").alias("dt"), F.col("o_lang").alias("lang"))
    none = F.lit(None).cast("string")
    kind = F.when(F.col(place).startswith("_:") | F.col(place).startswith("__"), 1).otherwise(0).cast("tinyint")
    return quads.select(F.col(place).alias("term"), kind.alias("kind"), none.alias("dt"), none.alias("lang"))


def enumerate_terms(quads: DataFrame, what: str) -> DataFrame:
    """The distinct terms of the visible statements: subject, predicate, object, node (subject or object), term, iri, bnode (subjects
    and objects only), literal, name (IRI or literal), resource (subject or object, no literal)."""
    places = {"subject": "s", "predicate": "p", "object": "o", "node": "so", "term": "spo", "iri": "spo", "bnode": "so", "literal": "o", "name": "spo", "resource": "so"}
    if what not in places:
        raise ValueError(f"unknown kind of term {what!r}")
    live, out = visible(quads), None
    for place in places[what]:
        part = _place(live, place)
        out = part if out is None else out.unionByName(part)
    test = {"iri": terms.is_iri, "bnode": terms.is_bnode, "literal": terms.is_literal, "name": terms.is_name, "resource": terms.is_resource}.get(what)
    return (out.where(test(F.col("kind"))) if test else out).select(*_TERM).distinct()


def ordered_literals(quads: DataFrame) -> DataFrame:
    """Each literal once, in the order of literals (a total sort by range partitioning)."""
    found = visible(quads).where(F.col("o_kind") == LITERAL).select("o", "o_kind", "o_dt", "o_lang").distinct()
    return found.orderBy(*lit.order_key())
