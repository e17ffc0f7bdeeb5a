"""Equality of graphs up to the names of blank nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.schema import BNODE, TRIPLE, visible
from quadrel.storage import materialize, release


def coloured(quads: DataFrame, rounds: int | None = None) -> DataFrame:
    """Distinct triples with every blank node replaced by a colour that its surroundings determine: colours are refined round by round from
    the colours of neighbours until their number stays, so equal graphs get equal rows."""
    t = materialize(visible(quads).select(*TRIPLE).distinct())
    is_b = lambda c: F.col(c).startswith("_:")
    nodes = t.where(is_b("s")).select(F.col("s").alias("b")).unionByName(t.where(F.col("o_kind") == BNODE).select(F.col("o").alias("b"))).distinct()
    colours = materialize(nodes.select("b", F.lit("0").alias("c")))
    n, before, k = colours.count(), 0, 0
    while n and (rounds is None or k < rounds):
        k += 1
        named = _named(t, colours)
        out = named.where("s_b is not null").select(F.col("s_b").alias("b"), F.concat_ws("\u0001", F.lit("out"), "p", "o_c", "q").alias("x"))
        into = named.where("o_b is not null").select(F.col("o_b").alias("b"), F.concat_ws("\u0001", F.lit("in"), "p", "s_c").alias("x"))
        # A multiset hash: the neighbourhoods are summed, so a node with many neighbours is combined before the shuffle.
        halves = [F.sum(F.conv(F.substring(F.md5("x"), 1 + 15 * h, 15), 16, 10).cast("decimal(38,0)")).cast("string") for h in (0, 1)]
        sums = out.unionByName(into).groupBy("b").agg(F.concat_ws("_", *halves).alias("n"))
        fresh = materialize(colours.join(sums, "b", "left").select("b", F.md5(F.concat_ws("\u0001", "c", "n")).alias("c")))
        release(colours)
        colours = fresh
        size = colours.select("c").distinct().count()
        if size == before:
            break
        before = size
    named = _named(t, colours)
    return named.select(F.col("s_c").alias("s"), "p", F.col("o_c").alias("o"), "o_kind", "o_dt", "o_lang", F.col("s_b").alias("s_bnode"), F.col("o_b").alias("o_bnode"))


def _named(t: DataFrame, colours: DataFrame) -> DataFrame:
    left = t.join(colours.select(F.col("b").alias("s"), F.col("c").alias("sc")), "s", "left").join(colours.select(F.col("b").alias("o"), F.col("c").alias("oc"), F.lit(BNODE).cast("tinyint").alias("o_kind")), ["o", "o_kind"], "left")
    name = lambda text, c: F.when(F.col(c).isNotNull(), F.concat(F.lit("_:"), F.col(c))).otherwise(F.col(text))
    return left.select(name("s", "sc").alias("s_c"), "p", name("o", "oc").alias("o_c"), "o_kind", "o_dt", "o_lang", F.concat_ws("|", F.col("o_kind").cast("string"), "o_dt", "o_lang").alias("q"), F.when(F.col("sc").isNotNull(), F.col("s")).alias("s_b"), F.when(F.col("oc").isNotNull(), F.col("o")).alias("o_b"))


def same_ground(a: DataFrame, b: DataFrame) -> bool:
    """Whether the visible triples are the same, names of blank nodes included."""
    x, y = visible(a).select(*TRIPLE).distinct(), visible(b).select(*TRIPLE).distinct()
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def equal_graphs(a: DataFrame, b: DataFrame) -> tuple[bool, DataFrame | None]:
    """Whether two graphs are equal up to blank nodes, and if so a mapping (a_node, b_node). Where colours single out every blank node the
    mapping is forced. Blank nodes of the same colour are told apart by fixing one at a time; a graph of many such classes of
    different structure may need more than colours, and then a try of each in turn on the class, which is small by then."""
    x, y = coloured(a), coloured(b)
    keep = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
    if not (x.select(*keep).exceptAll(y.select(*keep)).isEmpty() and y.select(*keep).exceptAll(x.select(*keep)).isEmpty()):
        return False, None
    pick = lambda t, name: t.where("s_bnode is not null").select(F.col("s").alias("c"), F.col("s_bnode").alias(name)).unionByName(t.where("o_bnode is not null").select(F.col("o").alias("c"), F.col("o_bnode").alias(name))).distinct()
    ax, by = pick(x, "a_node"), pick(y, "b_node")
    pairs = ax.join(by, "c")
    ties = ax.groupBy("c").count().where("count > 1").orderBy("c").limit(1).collect()
    if not ties:
        return True, pairs.select("a_node", "b_node")
    # Fix the smallest node of the first tied class to each candidate of the other graph in turn.
    one = ax.where(F.col("c") == ties[0]["c"]).agg(F.min("a_node").alias("n")).collect()[0]["n"]
    mark = "urn:fixed:" + ties[0]["c"]
    for r in by.where(F.col("c") == ties[0]["c"]).orderBy("b_node").toLocalIterator():
        same, mapping = equal_graphs(_fixed(a, one, mark), _fixed(b, r["b_node"], mark))
        if same:
            extra = a.sparkSession.createDataFrame([(one, r["b_node"])], "a_node string, b_node string")
            return True, mapping.unionByName(extra)
    return False, None


def _fixed(quads: DataFrame, node: str, mark: str) -> DataFrame:
    o_hit = (F.col("o") == node) & (F.col("o_kind") == BNODE)
    return quads.withColumn("s", F.when(F.col("s") == node, mark).otherwise(F.col("s"))).withColumn("o_kind", F.when(o_hit, F.lit(0).cast("tinyint")).otherwise(F.col("o_kind"))).withColumn("o", F.when(o_hit, mark).otherwise(F.col("o")))
