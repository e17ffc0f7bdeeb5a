"""The quads that queries run over, made from the tables of a directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.operators.lists import assert_containers, assert_lists
from quadrel.operators.patterns import with_keys
from quadrel.operators.text_index import LiteralIndex
from quadrel.schema import QUADS, RDF, RDFS, XSD, quads_frame
from quadrel.storage import exists, materialize

EX, VOC = "http://example.org/", "http://voc.example/ns#"
COLUMNS = [c.strip().split()[0] for c in QUADS.split(",")]

#: Schema statements about the tables' vocabularies.
SCHEMA = [
    (VOC + "broader", RDFS + "subPropertyOf", VOC + "within"), (VOC + "partOf", RDFS + "subPropertyOf", VOC + "within"), (VOC + "within", RDFS + "subPropertyOf", VOC + "related"),
    (VOC + "linksTo", RDFS + "subPropertyOf", VOC + "related"), (VOC + "altLabel", RDFS + "subPropertyOf", RDFS + "label"),
    (VOC + "Bridge", RDFS + "subClassOf", VOC + "Structure"), (VOC + "Mill", RDFS + "subClassOf", VOC + "Structure"), (VOC + "Structure", RDFS + "subClassOf", VOC + "Thing"),
    (VOC + "heightM", RDFS + "domain", VOC + "Structure"), (VOC + "heightM", RDF + "type", RDF + "Property"), (VOC + "code", RDFS + "domain", VOC + "Thing"), (VOC + "code", RDF + "type", RDF + "Property"),
]
INVERSES = {VOC + "broader": VOC + "narrower"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of the quad store, literals with their language."""
    lang = table(spark, sf_dir, "rdf11").select("lit_id", F.nullif(F.lower("lang"), F.lit("")).alias("o_lang"))
    rows = table(spark, sf_dir, "rdf").where("object is not null and subject is not null and predicate is not null").join(lang, "lit_id", "left")
    return rows.select(
        F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"), F.col("o_kind").cast("tinyint").alias("o_kind"), F.when(F.col("o_lang").isNull(), F.col("o_dt")).alias("o_dt"),
        "o_lang", F.coalesce("graph", F.lit("default")).alias("g"), "line", "born", "died")


def schema(spark: SparkSession) -> DataFrame:
    return quads_frame(spark, [(s, p, o, EX + "schema") for s, p, o in SCHEMA])


def with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).unionByName(schema(spark))


def _iri(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{EX}{kind}/"), F.col(key).cast("string"))


def _rows(df: DataFrame, subject: Column, graph: str, links: dict[str, Column], texts: dict[str, Column], numbers: dict[str, Column]) -> DataFrame:
    """Direct mapping: a statement per column that isn't null."""
    none = F.lit(None).cast("string")
    parts = [F.struct(F.lit(EX + p).alias("p"), c.alias("o"), F.lit(0).cast("tinyint").alias("o_kind"), none.alias("o_dt")) for p, c in links.items()]
    parts += [F.struct(F.lit(EX + p).alias("p"), c.alias("o"), F.lit(2).cast("tinyint").alias("o_kind"), F.lit(XSD + "string").alias("o_dt")) for p, c in texts.items()]
    parts += [F.struct(F.lit(EX + p).alias("p"), c.cast("bigint").cast("string").alias("o"), F.lit(2).cast("tinyint").alias("o_kind"), F.lit(XSD + "integer").alias("o_dt")) for p, c in numbers.items()]
    out = df.select(subject.alias("s"), F.explode(F.array(*parts)).alias("t")).where("t.o is not null and s is not null")
    out = out.select("s", "t.*", none.alias("o_lang"), F.lit(EX + graph).alias("g"), F.lit(None).cast("int").alias("line"), F.lit(1).cast("bigint").alias("born"), F.lit(None).cast("bigint").alias("died"))
    return out.select(*COLUMNS)


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers, suppliers, parts and orders; amounts in cents; nations stand in a second graph too."""
    t = lambda n: table(spark, sf_dir, n)
    cents = lambda c: F.round(F.col(c) * 100)
    nation = _rows(t("nation"), _iri("nation", "n_nationkey"), "nation", {"inRegion": _iri("region", "n_regionkey")}, {"name": F.col("n_name")}, {})
    parts = [
        _rows(t("region"), _iri("region", "r_regionkey"), "region", {}, {"name": F.col("r_name")}, {}), nation, nation.withColumn("g", F.lit(EX + "copy")),
        _rows(t("customer"), _iri("customer", "c_custkey"), "customer", {"inNation": _iri("nation", "c_nationkey")}, {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}, {"balance": cents("c_acctbal")}),
        _rows(t("supplier"), _iri("supplier", "s_suppkey"), "supplier", {"inNation": _iri("nation", "s_nationkey")}, {"name": F.col("s_name")}, {"balance": cents("s_acctbal")}),
        _rows(t("part"), _iri("part", "p_partkey"), "part", {}, {"name": F.col("p_name"), "brand": F.col("p_brand"), "kind": F.col("p_type")}, {"size": F.col("p_size")}),
        _rows(t("orders"), _iri("order", "o_orderkey"), "orders", {"placedBy": _iri("customer", "o_custkey")}, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}, {"total": cents("o_totalprice")}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def line_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and members: an order and the parts on its lines, in their order; an order has few lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit(EX + "part/"), x["l_partkey"].cast("string"))).alias("members"))
    return lines.select(F.col("l_orderkey").cast("string").alias("k"), "members")


def as_lists(lines: DataFrame) -> DataFrame:
    return assert_lists(lines, "k", "members", EX + "lists")


def line_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list per order of the parts on its lines."""
    return as_lists(line_members(spark, sf_dir))


def region_bags(spark: SparkSession, sf_dir: str, kind: str = "Bag") -> DataFrame:
    """A container per region of its nations, by key."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    return assert_containers(rows.select(_iri("region", "n_regionkey").alias("c"), F.transform("k", lambda x: F.concat(F.lit(EX + "nation/"), x.cast("string"))).alias("m")), "c", "m", kind, EX + "bags")


_kept: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, build):
    """What ``build`` gives, made once an application: as a store does that keeps its statements and its index."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    there = lambda made: all(exists(spark, f._quadrel_path) for f in getattr(made, "parts", [made]))  # noqa: E731, SLF001
    if key not in _kept or not there(_kept[key]):
        _kept[key] = build()
    return _kept[key]


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stored`` as a store keeps it: written once with the keys that literals are searched by, in ranges of (p, s) that spread a hot predicate, so that
    filters skip files and row groups."""
    return _once(spark, sf_dir, "quads", lambda: materialize(with_keys(stored(spark, sf_dir)).repartitionByRange("p", "s").sortWithinPartitions("p", "s")))


def kept_index(spark: SparkSession, sf_dir: str) -> LiteralIndex:
    """The index of the stored literals' tokens, built once."""
    return _once(spark, sf_dir, "index", lambda: LiteralIndex(stored(spark, sf_dir)))
