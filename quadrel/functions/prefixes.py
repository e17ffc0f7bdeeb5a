"""Prefixes: a registry on the driver and expressions that expand and contract."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrel.schema import OWL, RDF, RDFS, XSD

# The prefixes known from the start.
BUILT_IN = {
    "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "dc": "http://purl.org/dc/elements/1.1/", "dcterms": "http://purl.org/dc/terms/",
    "eor": "http://dublincore.org/2000/03/13/eor#", "skos": "http://www.w3.org/2004/02/skos/core#", "foaf": "http://xmlns.com/foaf/0.1/",
    "void": "http://rdfs.org/ns/void#", "serql": "http://www.openrdf.org/schema/serql#",
}


class Prefixes:
    """Prefix -> namespace. Contraction takes the longest namespace that fits."""

    def __init__(self, known: dict[str, str] | None = None) -> None:
        self.known = dict(BUILT_IN if known is None else known)

    def register(self, prefix: str, iri: str, force: bool = False, keep: bool = False) -> None:
        """A prefix that stands for another namespace is kept as it is (``keep``), replaced (``force``), or an error."""
        old = self.known.get(prefix)
        if old is not None and old != iri:
            if keep:
                return
            if not force:
                raise ValueError(f"prefix {prefix} is {old}")
        self.known[prefix] = iri

    def unregister(self, prefix: str) -> None:
        self.known.pop(prefix, None)

    def items(self) -> list[tuple[str, str]]:
        return sorted(self.known.items(), key=lambda x: (-len(x[1]), x[0]))

    def expand(self, name: str) -> str:
        """``prefix:local`` as an IRI; other names stay; an unknown prefix is an error."""
        if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://", name) or name.startswith(("_:", "<")) or ":" not in name:
            return name
        prefix, local = name.split(":", 1)
        if prefix not in self.known:
            raise KeyError(f"unknown prefix {prefix}")
        return self.known[prefix] + local

    def contract(self, iri: str) -> str:
        for prefix, ns in self.items():
            if iri.startswith(ns):
                return f"{prefix}:{iri[len(ns):]}"
        return iri

    def equal(self, a: str, b: str) -> bool:
        return self.expand(a) == self.expand(b)

    def expand_column(self, name: Column) -> Column:
        """As ``expand``; an unknown prefix leaves the text as it is."""
        out = name
        for prefix, ns in self.known.items():
            out = F.when(name.startswith(prefix + ":") & ~name.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(F.lit(ns), F.substr(name, F.lit(len(prefix) + 2)))).otherwise(out)
        return out

    def prefix_of(self, iri: Column) -> Column:
        """The prefix whose namespace fits best, or null."""
        out = F.lit(None).cast("string")
        for prefix, ns in reversed(self.items()):
            out = F.when(iri.startswith(ns), prefix).otherwise(out)
        return out

    def contract_column(self, iri: Column) -> Column:
        out = iri
        for prefix, ns in reversed(self.items()):
            out = F.when(iri.startswith(ns), F.concat(F.lit(prefix + ":"), F.substr(iri, F.lit(len(ns) + 1)))).otherwise(out)
        return out


def split_url(iri: Column) -> tuple[Column, Column]:
    """Base and local name: behind the last ``#``, or else the last ``/``."""
    local = F.regexp_extract(iri, r"([^#/]*)$", 1)
    return F.substr(iri, F.lit(1), F.length(iri) - F.length(local)), local


def xml_namespace(iri: Column) -> tuple[Column, Column]:
    """Namespace and the longest local name that XML allows at the end of an IRI."""
    local = F.regexp_extract(iri, r"([\p{L}_][\p{L}\p{N}_.\-]*)$", 1)
    return F.substr(iri, F.lit(1), F.length(iri) - F.length(local)), local


def portray(iri: Column, prefixes: Prefixes, style: str = "prefix:id", label: Column | None = None) -> Column:
    """A resource for people: ``prefix:id``, ``prefix:label``, ``prefix:id=label`` or ``writeq`` (quoted)."""
    short = prefixes.contract_column(iri)
    if style == "writeq":
        return F.concat(F.lit("'"), iri, F.lit("'"))
    if style == "prefix:id" or label is None:
        return short
    if style == "prefix:label":
        return F.concat(F.coalesce(F.concat(prefixes.prefix_of(iri), F.lit(":")), F.lit("")), label)
    if style == "prefix:id=label":
        return F.concat(short, F.lit("="), label)
    raise ValueError(f"unknown style {style!r}")
