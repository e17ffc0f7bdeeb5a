"""A library of ontologies described by manifests: what there is, what imports what, and what to load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.operators.closure import has
from quadrel.schema import LITERAL, OWL, RDF, RDFS
from quadrel.storage import materialize

#: The namespace of the manifests' own vocabulary; manifests that use another are read by setting this before.
LIB = "urn:ontology-library:"
# Public vocabularies of manifests.
VOID, VANN, DCTERMS = "http://rdfs.org/ns/void#", "http://purl.org/vocab/vann/", "http://purl.org/dc/terms/"


def types() -> list[str]:
    return [*(LIB + n for n in ("Ontology", "Schema", "Instances")), VOID + "Dataset", VOID + "Linkset"]


def facet_properties() -> dict[str, list[str]]:
    return {
        "title": [DCTERMS + "title", RDFS + "label"], "comment": [RDFS + "comment", DCTERMS + "description"], "version": [OWL + "versionInfo"], "base_uri": [LIB + "baseURI"], "source": [LIB + "source", VOID + "dataDump"],
        "provides_ns": [LIB + "providesNamespace", VANN + "preferredNamespaceUri"], "uses_ns": [LIB + "usesNamespace", VOID + "vocabulary"], "blank_nodes": [LIB + "blankNodes"],
    }


def import_properties() -> dict[str, str]:
    return {"ontology": OWL + "imports", "schema": LIB + "schema", "instances": LIB + "instances", "subset": VOID + "subset", "data_dump": VOID + "dataDump"}


def ontologies(manifests: DataFrame) -> DataFrame:
    """Things of a library type: id, type."""
    return manifests.where((F.col("p") == RDF + "type") & F.col("o").isin(types())).select(F.col("s").alias("id"), F.col("o").alias("type")).distinct()


def facets(manifests: DataFrame) -> DataFrame:
    """id, facet, value of what manifests say."""
    named = F.create_map(*[F.lit(x) for f, ps in facet_properties().items() for p in ps for x in (p, f)])
    return manifests.withColumn("facet", named[F.col("p")]).where("facet is not null").select(F.col("s").alias("id"), "facet", F.col("o").alias("value")).distinct().join(ontologies(manifests).select("id"), "id", "left_semi")


def imports(manifests: DataFrame) -> DataFrame:
    """id, kind, target of the import links."""
    named = F.create_map(*[F.lit(x) for k, p in import_properties().items() for x in (p, k)])
    return manifests.where(F.col("o_kind") != LITERAL).withColumn("kind", named[F.col("p")]).where("kind is not null").select(F.col("s").alias("id"), "kind", F.col("o").alias("target")).distinct()


def to_load(manifests: DataFrame, start: str, import_: bool = True) -> DataFrame:
    """What loading ``start`` loads: id, level (0 itself, then by the fewest imports), each once; loops are no danger."""
    edges = imports(manifests).select("id", "target").distinct()
    found = materialize(manifests.sparkSession.createDataFrame([(start, 0)], "id string, level int"))
    level = 0
    while import_:
        level += 1
        last = found.where(F.col("level") == level - 1)
        new = materialize(last.join(edges, "id").select(F.col("target").alias("id")).distinct().join(found.select("id"), "id", "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty():
            break
        found = materialize(found.unionByName(new))
    return found


def conflicts(manifests: DataFrame) -> DataFrame:
    """Namespaces that several ontologies provide: ns, ids."""
    f = facets(manifests).where("facet = 'provides_ns'")
    return f.groupBy(F.col("value").alias("ns")).agg(F.sort_array(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)


def missing(manifests: DataFrame) -> DataFrame:
    """Imports of what no manifest knows."""
    return imports(manifests).join(ontologies(manifests).select(F.col("id").alias("target")), "target", "left_anti")


def titles(manifests: DataFrame) -> DataFrame:
    return has(manifests, p=DCTERMS + "title").select(F.col("s").alias("id"), F.col("o").alias("title"))
