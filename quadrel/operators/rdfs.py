"""Classes, properties, labels and searches of the schema vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.functions.prefixes import Prefixes
from quadrel.functions.text import lang_matches, match_label
from quadrel.operators.closure import closure, has, subproperties
from quadrel.operators.lists import container_members, list_rows
from quadrel.schema import LITERAL, RDF, RDFS, visible
from quadrel.skew import lookup_join
from quadrel.storage import materialize


def subproperty_of(quads: DataFrame) -> DataFrame:
    """Pairs (sub, super), each property under itself too."""
    named = visible(quads).where(F.col("p") == RDFS + "subPropertyOf")
    own = named.select(F.col("s").alias("sub")).unionByName(named.select(F.col("o").alias("sub"))).distinct().select("sub", F.col("sub").alias("super"))
    return subproperties(quads).unionByName(own).distinct()


def classes(quads: DataFrame) -> DataFrame:
    """Everything used as a class: ends of subClassOf, objects of type."""
    live = visible(quads)
    sub = live.where(F.col("p") == RDFS + "subClassOf")
    return sub.select(F.col("s").alias("c")).unionByName(sub.select(F.col("o").alias("c"))).unionByName(live.where(F.col("p") == RDF + "type").select(F.col("o").alias("c"))).distinct()


def subclass_of(quads: DataFrame) -> DataFrame:
    """Pairs (sub, super): the closure of subClassOf, each class under itself and under rdfs:Resource, instances of rdfs:Datatype under
    rdfs:Literal."""
    links = has(quads, p=RDFS + "subClassOf").where(F.col("o_kind") != LITERAL).select(F.col("s").alias("sub"), F.col("o").alias("super"))
    own = classes(quads)
    datatypes = visible(quads).where((F.col("p") == RDF + "type") & (F.col("o") == RDFS + "Datatype"))
    parts = [own.select(F.col("c").alias("sub"), F.col("c").alias("super")), own.select(F.col("c").alias("sub"), F.lit(RDFS + "Resource").alias("super")), datatypes.select(F.col("s").alias("sub"), F.lit(RDFS + "Literal").alias("super"))]
    out = closure(links)
    for part in parts:
        out = out.unionByName(part)
    return out.distinct()


def individual_of(quads: DataFrame, c: str | None = None) -> DataFrame:
    """Pairs (r, c): r has the type c or a class under it, by rdf:type or a sub-property; every resource, subject or object, is an
    rdfs:Resource and every literal, by its text, an rdfs:Literal. A class with many individuals is split over tasks."""
    live = visible(quads)
    everything = [live.select(F.col("s").alias("r"), F.lit(RDFS + "Resource").alias("c"))]
    everything.append(live.select(F.col("o").alias("r"), F.when(F.col("o_kind") == LITERAL, RDFS + "Literal").otherwise(RDFS + "Resource").alias("c")))
    if c in (RDFS + "Resource", RDFS + "Literal"):
        out = [part.where(F.col("c") == c) for part in everything]
    else:
        types = materialize(has(quads, p=RDF + "type").select(F.col("s").alias("r"), F.col("o").alias("sub")))
        above = subclass_of(quads) if c is None else subclass_of(quads).where(F.col("super") == c)
        out = [lookup_join(types, above, "sub", "inner").select("r", F.col("super").alias("c")), *(everything if c is None else [])]
    return reduce(DataFrame.unionByName, out).distinct()


def class_property(quads: DataFrame) -> DataFrame:
    """Pairs (c, property): the property has a domain that is c or above it."""
    properties = individual_of(quads, RDF + "Property").select(F.col("r").alias("property"))
    domains = has(quads, p=RDFS + "domain").select(F.col("s").alias("property"), F.col("o").alias("super"))
    return domains.join(properties, "property").join(subclass_of(quads), "super").select(F.col("sub").alias("c"), "property").distinct()


def labels(quads: DataFrame, lang: str | None = None) -> DataFrame:
    """A label per label statement (r, label, o_lang, rank), rdfs:label first, then its sub-properties; resources without one get the part behind
    the last ``#``, else the last ``/``, else the name itself. With ``lang`` only labels in that range or without language."""
    found = has(quads, p=RDFS + "label", real=True).where(F.col("o_kind") == LITERAL)
    if lang:
        found = found.where(F.col("o_lang").isNull() | lang_matches(F.col("o_lang"), lang))
    found = found.select(F.col("s").alias("r"), F.col("o").alias("label"), "o_lang", F.when(F.col("real_p") == RDFS + "label", 0).otherwise(1).alias("rank"))
    rest = visible(quads).select(F.col("s").alias("r")).distinct().join(found.select("r").distinct(), "r", "left_anti")
    hash_part, slash_part = F.regexp_extract("r", "#([^#]*)$", 1), F.regexp_extract("r", "/([^/]*)$", 1)
    local = F.when(hash_part != "", hash_part).when(slash_part != "", slash_part).otherwise(F.col("r"))
    return found.unionByName(rest.select("r", local.alias("label"), F.lit(None).cast("string").alias("o_lang"), F.lit(2).alias("rank")))


def best_labels(quads: DataFrame, lang: str | None = None) -> DataFrame:
    """One label per resource: the first by rank, labels with a language before those without, then by text."""
    order = Window.partitionBy("r").orderBy("rank", F.col("o_lang").isNull(), "label")
    return labels(quads, lang).withColumn("k", F.row_number().over(order)).where("k = 1").select("r", "label")


def ns_labels(quads: DataFrame, prefixes: Prefixes, lang: str | None = None) -> DataFrame:
    """``prefix:label`` per label; without a known prefix the label alone."""
    prefix = prefixes.prefix_of(F.col("r"))
    return labels(quads, lang).select("r", F.when(prefix.isNotNull(), F.concat_ws(":", prefix, F.col("label"))).otherwise(F.col("label")).alias("ns_label"))


def members(quads: DataFrame) -> DataFrame:
    """Pairs (set, member): members of lists and of containers."""
    in_lists = list_rows(quads).select(F.col("list").alias("set"), F.col("member"))
    return in_lists.unionByName(container_members(quads).select(F.col("container").alias("set"), "member")).distinct()


# -- search -----------------------------------------------------------------------------------------------------


def find(quads: DataFrame, text: str, domain: tuple | None = None, properties: list[str] | None = None, how: str = "substring") -> DataFrame:
    """Subjects r with a literal that matches, on any of the properties (or their sub-properties; None = all), within a domain
    description."""
    if properties is None:
        rows = visible(quads).select("s", "o", "o_kind")
    else:
        rows = None
        for p in properties:
            part = has(quads, p=p).select("s", "o", "o_kind")
            rows = part if rows is None else rows.unionByName(part)
    hits = rows.where((F.col("o_kind") == LITERAL) & match_label(how, text, F.col("o"))).select(F.col("s").alias("r")).distinct()
    return hits if domain is None else in_domain(quads, hits, domain)


def in_domain(quads: DataFrame, rows: DataFrame, domain: tuple) -> DataFrame:
    """The rows (column r) within a description: ("class", c) - r is c or a class under it, ("union_of", d...), ("intersection_of", d...), ("complement_of", d),
    ("one_of", name...), ("all_values_from", c) - r is an individual of c, ("some_values_from", c) - always, ("has_value", p, v)."""
    kind, args = domain[0], domain[1:]
    if kind == "class":
        inside = subclass_of(quads).where(F.col("super") == args[0]).select(F.col("sub").alias("r"))
        return rows.join(inside, "r", "left_semi")
    if kind == "union_of":
        out = None
        for d in args:
            part = in_domain(quads, rows, d)
            out = part if out is None else out.unionByName(part)
        return out.distinct()
    if kind == "intersection_of":
        for d in args:
            rows = in_domain(quads, rows, d)
        return rows
    if kind == "complement_of":
        return rows.join(in_domain(quads, rows, args[0]), "r", "left_anti")
    if kind == "one_of":
        return rows.where(F.col("r").isin(list(args)))
    if kind == "all_values_from":
        return rows.join(individual_of(quads, args[0]).select("r"), "r", "left_semi")
    if kind == "some_values_from":
        return rows
    if kind == "has_value":
        return rows.join(has(quads, p=args[0], o=args[1]).select(F.col("s").alias("r")), "r", "left_semi")
    raise ValueError(f"unknown domain description {kind!r}")
