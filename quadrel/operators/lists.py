"""RDF lists and containers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quadrel.functions.terms import create_bnode, member_number, member_property
from quadrel.schema import BNODE, DEFAULT_GRAPH, IRI, LITERAL, QUADS, RDF, RDFS, visible
from quadrel.storage import materialize, release

FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"


def _cells(quads: DataFrame) -> tuple[DataFrame, DataFrame]:
    live = visible(quads)
    first = live.where(F.col("p") == FIRST).select(F.col("s").alias("cell"), F.col("o").alias("member"), F.col("o_kind").alias("member_kind"), F.col("o_dt").alias("member_dt"), F.col("o_lang").alias("member_lang")).distinct()
    rest = live.where((F.col("p") == REST) & (F.col("o_kind") != LITERAL)).select(F.col("s").alias("cell"), F.col("o").alias("next")).distinct()
    return first, rest


def list_cells(quads: DataFrame, maximal: bool = True) -> DataFrame:
    """Every cell of every list with its place: list, cell, pos (from 0), done (the list ends properly in nil).

    ``maximal``: only lists whose head is no other cell's rest; else every cell heads a list. Places are found by doubling: spans
    of 1, 2, 4, ... cells are joined to longer ones, so a list of n cells takes log n rounds. Nil, the end of all lists, is no key of a join. A branch gives the cells of all
    its ways; a loop of cells has no end, is no proper list, and gives nothing."""
    first, rest = _cells(quads)
    heads = first.select("cell").distinct()
    if maximal:
        heads = heads.join(rest.select(F.col("next").alias("cell")), "cell", "left_anti")
    counted = Observation()
    hops = materialize(rest.select(F.col("cell").alias("a"), F.col("next").alias("b")).observe(counted, F.count(F.lit(1)).alias("n")))
    parts, width = [materialize(heads.select(F.col("cell").alias("list"), "cell", F.lit(0).alias("pos")))], 1
    cells = left = counted.get["n"]
    while left and width <= cells:
        # A round gives the places from width to twice the width, so what was found before is neither written nor compared again.
        found, seen = reduce(DataFrame.unionByName, parts).where(F.col("cell") != NIL), Observation()
        step = found.join(hops.select(F.col("a").alias("cell"), F.col("b")), "cell").select("list", F.col("b").alias("cell"), (F.col("pos") + width).alias("pos")).distinct()
        parts.append(materialize(step.observe(seen, F.count(F.lit(1)).alias("n"))))
        left, width = seen.get["n"], width * 2
        if left and width <= cells:
            further = hops.where(F.col("b") != NIL).join(hops.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
            old, hops = hops, materialize(further)
            release(old)
    found = reduce(DataFrame.unionByName, parts)
    ends = found.where(F.col("cell") == NIL).select("list").distinct().withColumn("done", F.lit(True))
    return found.where(F.col("cell") != NIL).join(ends, "list", "left").withColumn("done", F.coalesce("done", F.lit(False)))


def list_rows(quads: DataFrame, maximal: bool = True) -> DataFrame:
    """The members of all proper lists: list, pos (from 0), member, member_kind, member_dt, member_lang."""
    first, _ = _cells(quads)
    return list_cells(quads, maximal).where("done").join(first, "cell").select("list", "pos", "member", "member_kind", "member_dt", "member_lang")


def list_arrays(quads: DataFrame) -> DataFrame:
    """One row per list: list, members in order."""
    return list_rows(quads).groupBy("list").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "member"))), lambda x: x["member"]).alias("members"))


def list_length(quads: DataFrame) -> DataFrame:
    return list_cells(quads).where("done").groupBy("list").agg((F.max("pos") + 1).alias("length"))


def malformed_lists(quads: DataFrame) -> DataFrame:
    """Heads of lists that don't end in nil."""
    return list_cells(quads).where("not done").select("list").distinct()


def next_to(quads: DataFrame) -> DataFrame:
    """Pairs (x, y) where y follows x directly in some list, each once."""
    first, rest = _cells(quads)
    x = first.select("cell", F.col("member").alias("x"))
    y = first.select(F.col("cell").alias("next"), F.col("member").alias("y"))
    return x.join(rest, "cell").join(y, "next").select("x", "y").distinct()


def nth(quads: DataFrame, base: int = 0) -> DataFrame:
    """Members with their index, from ``base``: list, n, member."""
    return list_rows(quads).select("list", (F.col("pos") + base).alias("n"), "member")


def last(quads: DataFrame) -> DataFrame:
    """The last members: list, member; a last cell with several firsts gives several."""
    rows = list_rows(quads)
    return rows.join(rows.groupBy("list").agg(F.max("pos").alias("pos")), ["list", "pos"]).select("list", "member")


def assert_lists(rows: DataFrame, key: str, members: str, g: str = DEFAULT_GRAPH) -> DataFrame:
    """Quads of new lists from arrays of resources: cells are blank nodes made from key and place, each of type rdf:List. An empty
    or null array gives no rows; its list is rdf:nil (``list_head``)."""
    cells = rows.select(F.col(key).alias("k"), F.size(members).alias("n"), F.posexplode(members).alias("i", "m"))
    cell = lambda i: create_bnode(F.col("k"), i, start="_:list")
    stmt = F.array(
        F.struct(F.lit(RDF + "type").alias("p"), F.lit(RDF + "List").alias("o"), F.lit(IRI).alias("kind")),
        F.struct(F.lit(FIRST).alias("p"), F.col("m").alias("o"), F.when(F.col("m").startswith("_:"), BNODE).otherwise(IRI).alias("kind")),
        F.struct(F.lit(REST).alias("p"), F.when(F.col("i") == F.col("n") - 1, NIL).otherwise(cell(F.col("i") + 1)).alias("o"), F.when(F.col("i") == F.col("n") - 1, IRI).otherwise(BNODE).alias("kind")),
    )
    return _as_quads(cells.select(cell(F.col("i")).alias("s"), F.explode(stmt).alias("t")), g)


def list_head(key, members):
    """The head that ``assert_lists`` gives a list."""
    return F.when(F.coalesce(F.size(members), F.lit(0)) <= 0, NIL).otherwise(create_bnode(key, F.lit(0), start="_:list"))


def _as_quads(rows: DataFrame, g: str) -> DataFrame:
    none = F.lit(None)
    out = rows.select("s", F.col("t.p").alias("p"), F.col("t.o").alias("o"), F.col("t.kind").cast("tinyint").alias("o_kind"), none.cast("string").alias("o_dt"), none.cast("string").alias("o_lang"), F.lit(g).alias("g"), none.cast("int").alias("line"), F.lit(1).cast("bigint").alias("born"), none.cast("bigint").alias("died"))
    return out.select(*[c.strip().split()[0] for c in QUADS.split(",")])


def retract_list(quads: DataFrame, head: str) -> DataFrame:
    """The quads without the cells of the list at ``head``: their first, rest and type rdf:List; other statements stay. ``head`` may be an inner cell: its
    list is found among the whole lists, of which the cells from it on go."""
    cells = materialize(list_cells(quads))
    at = cells.where(F.col("cell") == head).select("list", F.col("pos").alias("_from"))
    cells = cells.join(at, "list").where(F.col("pos") >= F.col("_from")).select(F.col("cell").alias("s")).distinct()
    structural = F.col("p").isin(FIRST, REST) | ((F.col("p") == RDF + "type") & (F.col("o") == RDF + "List"))
    return quads.where(~structural).unionByName(quads.where(structural).join(cells, "s", "left_anti").select(*quads.columns))


# -- containers -------------------------------------------------------------------------------------------------


def container_members(quads: DataFrame) -> DataFrame:
    """Members of containers by rdf:_N: container, n, member, member_kind, member_dt, member_lang; also members by rdfs:member, n null."""
    live = visible(quads).withColumn("n", member_number(F.col("p"))).where(F.col("n").isNotNull() | (F.col("p") == RDFS + "member"))
    return live.select(F.col("s").alias("container"), "n", F.col("o").alias("member"), F.col("o_kind").alias("member_kind"), F.col("o_dt").alias("member_dt"), F.col("o_lang").alias("member_lang")).distinct()


def containers(quads: DataFrame, kind: str) -> DataFrame:
    """Bag, Seq or Alt: container and members in the order of their numbers; of a number given twice each member is kept, by text."""
    typed = visible(quads).where((F.col("p") == RDF + "type") & (F.col("o") == RDF + kind)).select(F.col("s").alias("container")).distinct()
    rows = typed.join(container_members(quads).where("n is not null"), "container", "left")
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "member")))), lambda x: x["member"])
    return rows.groupBy("container").agg(ordered.alias("members"))


def alternatives(quads: DataFrame) -> DataFrame:
    """Alt containers: container, default (the first), others."""
    c = containers(quads, "Alt")
    return c.select("container", F.get("members", F.lit(0)).alias("default"), F.slice("members", F.lit(2), F.size("members")).alias("others"))


def assert_containers(rows: DataFrame, container: str, members: str, kind: str, g: str = DEFAULT_GRAPH) -> DataFrame:
    """Quads of containers from arrays of resources, numbered from 1."""
    typed = rows.select(F.col(container).alias("s"), F.struct(F.lit(RDF + "type").alias("p"), F.lit(RDF + kind).alias("o"), F.lit(IRI).alias("kind")).alias("t"))
    each = rows.select(F.col(container).alias("s"), F.posexplode(members).alias("i", "m"))
    each = each.select("s", F.struct(member_property(F.col("i") + 1).alias("p"), F.col("m").alias("o"), F.when(F.col("m").startswith("_:"), BNODE).otherwise(IRI).alias("kind")).alias("t"))
    return _as_quads(reduce(DataFrame.unionByName, [typed, each]), g)
