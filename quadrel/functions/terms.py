"""Tests on terms and small functions of names."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrel.schema import BNODE, IRI, LITERAL, RDF


def is_iri(kind: Column) -> Column:
    return kind == IRI


def is_bnode(kind: Column) -> Column:
    return kind == BNODE


def is_literal(kind: Column) -> Column:
    return kind == LITERAL


def is_name(kind: Column) -> Column:
    """IRI or literal."""
    return kind.isin(IRI, LITERAL)


def is_subject(kind: Column) -> Column:
    """What may stand as a subject: IRI or blank node."""
    return kind.isin(IRI, BNODE)


def is_predicate(kind: Column) -> Column:
    return kind == IRI


def is_object(kind: Column) -> Column:
    return kind.isin(IRI, BNODE, LITERAL)


is_term, is_resource = is_object, is_subject


def create_bnode(*key: Column, start: str = "_:genid") -> Column:
    """A blank node that is the same for equal keys, so a task that is run again gives the same name."""
    return F.concat(F.lit(start), F.hex(F.xxhash64(*key)))


def member_property(n: Column) -> Column:
    """rdf:_N of N."""
    return F.concat(F.lit(RDF + "_"), n.cast("string"))


def member_number(p: Column) -> Column:
    """N of rdf:_N (1 or more, no leading zeros), else null."""
    return F.regexp_extract(p, "^" + RDF.replace(".", r"\.") + r"_([1-9][0-9]*)\z", 1).try_cast("int")


def atom_md5(text: Column, times: int = 1) -> Column:
    """MD5 of the text, then of the digest in hexadecimal, ``times`` in all."""
    for _ in range(times):
        text = F.md5(text)
    return text


def text_md5(text: str, times: int = 1) -> str:
    for _ in range(times):
        text = hashlib.md5(text.encode()).hexdigest()
    return text
