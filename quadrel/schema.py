"""The quads table and the vocabularies it uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Namespaces.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"

IRI, BNODE, LITERAL = 0, 1, 2
DEFAULT_GRAPH = "default"

#: o is the text of a resource or the lexical form of a literal; o_dt is null for plain and language-tagged literals; a row is
#: visible at generation x if born <= x and (died is null or x < died).
QUADS = "s string, p string, o string, o_kind tinyint, o_dt string, o_lang string, g string, line int, born bigint, died bigint"
TRIPLE = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]


def same_object(a: str, b: str) -> Column:
    """Whether two aliased quads have the same object, qualifiers included."""
    return (F.col(f"{a}.o") == F.col(f"{b}.o")) & (F.col(f"{a}.o_kind") == F.col(f"{b}.o_kind")) & F.col(f"{a}.o_dt").eqNullSafe(F.col(f"{b}.o_dt")) & F.col(f"{a}.o_lang").eqNullSafe(F.col(f"{b}.o_lang"))


def is_bnode_text(c: Column) -> Column:
    """Blank nodes are told by their name."""
    return c.startswith("_:") | c.startswith("__")


def quads_frame(spark, rows: list[tuple]) -> DataFrame:
    """Quads from (s, p, o[, g[, line]]) tuples; an object is a resource name or a literal: (text,), (text, {"type": iri}),
    (text, {"lang": tag}). For tests and for statements given by hand."""
    out = []
    for r in rows:
        s, p, o, g, line = (*r, *[None] * (5 - len(r)))
        dt = lang = None
        kind = IRI
        if isinstance(o, tuple):
            q = o[1] if len(o) > 1 else {}
            o, kind, dt, lang = o[0], LITERAL, q.get("type"), (q.get("lang") or "").lower() or None
        elif o.startswith(("_:", "__")):
            kind = BNODE
        out.append((s, p, o, kind, dt, lang, g or DEFAULT_GRAPH, line, 1, None))
    return spark.createDataFrame(out, QUADS)


def visible(quads: DataFrame, generation: int | None = None) -> DataFrame:
    """The quads alive now, or at a generation."""
    if generation is None:
        return quads.where("died is null")
    return quads.where((F.col("born") <= generation) & (F.col("died").isNull() | (F.col("died") > generation)))
