"""Counts, branching factors, digests and prefix usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.prefixes import Prefixes, split_url
from quadrel.operators.closure import has
from quadrel.schema import BNODE, LITERAL, TRIPLE, visible


def by_graph(quads: DataFrame) -> DataFrame:
    return visible(quads).groupBy("g").agg(F.count(F.lit(1)).alias("triples"))


def by_predicate(quads: DataFrame) -> DataFrame:
    return visible(quads).groupBy("p").agg(F.count(F.lit(1)).alias("triples"))


def totals(quads: DataFrame) -> DataFrame:
    """One row: triples (all visible rows, duplicates too), duplicates, subjects, properties, objects, literals, resources, graphs.

    One scan: a row gives a tagged term for each thing counted; equal ones are counted together before the one shuffle, then per tag."""
    live, none = visible(quads), F.lit(None).cast("string")
    term = lambda tag, *cols: F.struct(F.lit(tag).alias("tag"), *[c.cast("string").alias(n) for n, c in zip("abcdef", [*cols, *[none] * (6 - len(cols))])])
    s, p, o, kind, dt, lang = (F.col(c) for c in TRIPLE)
    literal = kind == LITERAL
    each = F.explode(F.array(
        term("unique", s, p, o, kind, dt, lang), term("subject", s), term("property", p), term("object", o, kind, dt, lang),
        F.when(literal, term("literal", o, dt, lang)), term("resource", s), F.when(~literal, term("resource", o)), term("graph", F.col("g")))).alias("t")
    tagged = live.select(each).where("t is not null").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    of = lambda tag: F.count(F.when(F.col("t.tag") == tag, 1))
    rows = F.coalesce(F.sum(F.when(F.col("t.tag") == "unique", F.col("n"))), F.lit(0))
    names = {"subjects": "subject", "properties": "property", "objects": "object", "literals": "literal", "resources": "resource", "graphs": "graph"}
    return tagged.agg(rows.alias("triples"), *[of(tag).alias(name) for name, tag in names.items()], (rows - of("unique")).alias("duplicates"))


def branch_factors(quads: DataFrame) -> DataFrame:
    """Per predicate: triples per distinct subject and per distinct object, exactly. The distinct pairs are counted in two steps, so a hot
    predicate is spread by its subjects and objects."""
    live = visible(quads).select(*TRIPLE).distinct()
    kinds = F.explode(F.array(F.struct(F.lit("s").alias("k"), F.col("s").alias("v"), F.lit(0).cast("tinyint").alias("vk"), F.lit("").alias("q")), F.struct(F.lit("o").alias("k"), F.col("o").alias("v"), F.col("o_kind").alias("vk"), F.concat_ws("|", "o_dt", "o_lang").alias("q"))))
    pairs = live.select("p", kinds.alias("x")).groupBy("p", "x").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.groupBy("p").agg(F.sum(F.when(F.col("x.k") == "s", F.col("n"))).alias("n"), F.count(F.when(F.col("x.k") == "s", 1)).alias("ns"), F.count(F.when(F.col("x.k") == "o", 1)).alias("no"))
    return per.select("p", (F.col("n") / F.col("ns")).alias("subject_branch_factor"), (F.col("n") / F.col("no")).alias("object_branch_factor"))


def branch_factor_with_sub(quads: DataFrame, p: str) -> DataFrame:
    """The branching factors of a predicate with all under it; 0.0 where nothing holds."""
    rows = has(quads, p=p)
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("ns"), F.countDistinct("o", "o_kind", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit(""))).alias("no"))
    factor = lambda d: F.when(F.col(d) > 0, F.col("n") / F.col(d)).otherwise(0.0)
    return got.select(F.lit(p).alias("p"), factor("ns").alias("subject_branch_factor"), factor("no").alias("object_branch_factor"))


def graph_md5(quads: DataFrame) -> DataFrame:
    """Per graph the bytewise sum of the digests of its rows, duplicates included: independent of order, the same after unloading and
    loading again, and mergeable, so partial sums are made before the shuffle."""
    none = F.lit("")
    row = F.md5(F.concat_ws("\u0001", "s", "p", F.col("o_kind").cast("string"), "o", F.coalesce("o_dt", none), F.coalesce("o_lang", none), F.coalesce("g", none)))
    live = visible(quads).select("g", row.alias("h"))
    sums = live.groupBy("g").agg(*[F.sum(F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("bigint")).alias(f"b{i}") for i in range(16)])
    return sums.select("g", F.concat(*[F.lpad(F.lower(F.hex(F.col(f"b{i}") % 256)), 2, "0") for i in range(16)]).alias("md5"))


def graph_prefixes(quads: DataFrame, prefixes: Prefixes, min_count: int = 2, known_only: bool = False) -> DataFrame:
    """Namespaces in use: prefix (null if unknown), ns, contexts (distinct subjects, predicates per subject, objects and datatypes per
    triple). Known prefixes are kept whatever their count. Blank nodes are skipped."""
    live = visible(quads).select(*TRIPLE).distinct()
    use = lambda place, c, *ctx: F.struct(F.lit(place).alias("place"), c.alias("iri"), F.concat_ws("\u0001", *ctx).alias("ctx"))
    each = F.explode(F.array(
        F.when(~F.col("s").startswith("_:"), use("subject", F.col("s"), "s")), use("predicate", F.col("p"), "s", "p"),
        F.when(~F.col("o_kind").isin(LITERAL, BNODE), use("object", F.col("o"), "s", "p", "o")), F.when(F.col("o_dt").isNotNull(), use("type", F.col("o_dt"), "s", "p", "o", "o_dt")))).alias("u")
    used = live.select(each).where("u is not null").select("u.*").distinct()
    known = prefixes.prefix_of(F.col("iri"))
    ns = F.lit(None).cast("string")
    for prefix, iri in prefixes.known.items():
        ns = F.when(known == prefix, iri).otherwise(ns)
    counted = used.select(known.alias("prefix"), F.coalesce(ns, split_url(F.col("iri"))[0]).alias("ns")).groupBy("prefix", "ns").agg(F.count(F.lit(1)).alias("contexts"))
    out = counted.where(F.col("prefix").isNotNull() | (F.col("contexts") >= min_count))
    return out.where("prefix is not null") if known_only else out
