"""Queries of the general data problems (2, 3, 4, 6, 7) over the tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.operators.hierarchy import descendants, hierarchy
from quadrel.operators.line_check import error_counts, read_loads
from quadrel.operators.replay import replay
from quadrel.operators.tree_aggregate import heavy_keys, tree_statistics
from quadrel.operators.wide import cells_of, wide_table

VOC = "http://voc.example/ns#"
KINDS = {"double": "heightM areaHa lat lon", "integer": "storeys ward rating", "date": "built closed", "boolean": "listed open", "string": "code"}
#: IRI of the attribute -> column and type.
ATTRIBUTES = {VOC + n: (n, kind) for kind, names in KINDS.items() for n in names.split()}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_statistics(table(spark, sf_dir, "rdf"), {"predicate": F.col("predicate"), "graph": F.col("graph")}, {"subjects": F.col("subject"), "objects": F.col("object")})


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicates and graphs that hold at least 5 percent of all rows."""
    return heavy_keys(_statistics(spark, sf_dir), 0.05, table(spark, sf_dir, "rdf").count()).select("field_name", "key_value")


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct subjects and distinct objects per predicate and per graph."""
    return _statistics(spark, sf_dir)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child and parent of the live link statements."""
    down = F.col("predicate") == VOC + "narrower"
    rows = table(spark, sf_dir, "rdf").where(F.col("died").isNull() & F.col("o_kind").isin(0, 1) & F.col("predicate").isin(VOC + "broader", VOC + "partOf", VOC + "narrower"))
    return rows.select(F.when(down, F.col("object")).otherwise(F.col("subject")).alias("child"), F.when(down, F.col("subject")).otherwise(F.col("object")).alias("parent"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every node."""
    return hierarchy(links(spark, sf_dir)).select("node", "root", "depth")


def p3_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path of every node that isn't caught in a loop, root first, joined by spaces."""
    return hierarchy(links(spark, sf_dir)).where("path is not null").select("node", F.array_join("path", " ").alias("path"))


def p3_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with each of its descendants."""
    return descendants(hierarchy(links(spark, sf_dir)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements there after the whole feed."""
    return replay(table(spark, sf_dir, "journal"), at_end=True)


def p4_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements that may be shown: up to the contiguous committed watermark of each graph."""
    return replay(table(spark, sf_dir, "journal"))


def _wide(spark: SparkSession, sf_dir: str, source: bool) -> DataFrame:
    rows = table(spark, sf_dir, "rdf").where("died is null and o_kind = 2").select("subject", "predicate", "object", "born", "stmt_id")
    return wide_table(rows, ATTRIBUTES, "subject", "predicate", "object", ["born", "stmt_id"], "stmt_id" if source else None, long_integers=not source)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the wide table and the statement behind each."""
    return cells_of(_wide(spark, sf_dir, True), ATTRIBUTES, "subject").select("subject", F.col("attribute").alias("predicate"), F.col("source").alias("stmt_id"))


def p6_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per subject with a typed column per attribute, integers of more than 38 digits in columns of their own."""
    return _wide(spark, sf_dir, False)


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_loads(table(spark, sf_dir, "nt_lines"), table(spark, sf_dir, "nt_state"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faulty lines that are read, each with its reason."""
    return _read(spark, sf_dir).where("reason is not null").select("load_id", "line_no", "reason")


def p7_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements loaded, as text columns."""
    return _read(spark, sf_dir).where("is_statement").select("load_id", "line_no", "s", "p", "o", F.coalesce("g", "load_graph").alias("g"))


def p7_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right error count of every load."""
    return error_counts(_read(spark, sf_dir), table(spark, sf_dir, "nt_state"))


QUERIES = {f.__name__: f for f in (p2_found, p2_statistics, p3_found, p3_paths, p3_descendants, p4_found, p4_committed, p6_found, p6_wide, p7_found, p7_statements, p7_error_counts)}
