"""Sub-property and inverse matching, and reachability over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.operators.patterns import object_is
from quadrel.skew import hot_keys, lookup_join
from quadrel.schema import IRI, LITERAL, RDFS, TRIPLE, visible
from quadrel.storage import materialize, release

#: A predicate hierarchy of at most so many links is followed on the driver and becomes a filter; a larger one is joined.
SMALL = 100_000


def closure(edges: DataFrame, a: str = "sub", b: str = "super") -> DataFrame:
    """All pairs linked by one or more edges, each once. Path doubling: each round joins the pairs found with themselves, so the number
    of rounds is the logarithm of the longest path. Loops end when no pair is new. Null ends are left out."""
    pairs = materialize(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null").distinct())
    n = pairs.count()
    while True:
        more = lookup_join(pairs, pairs.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "inner", rows=n).select("x", F.col("z").alias("y"))
        wider = materialize(pairs.unionByName(more).distinct())
        size = wider.count()
        release(pairs)
        pairs = wider
        if size == n:
            return pairs.select(F.col("x").alias(a), F.col("y").alias(b))
        n = size


def subproperties(quads: DataFrame) -> DataFrame:
    """Pairs (sub, super) of the closure of rdfs:subPropertyOf."""
    return closure(_property_links(quads))


def _property_links(quads: DataFrame) -> DataFrame:
    return visible(quads).where((F.col("p") == RDFS + "subPropertyOf") & (F.col("o_kind") == IRI)).select(F.col("s").alias("sub"), F.col("o").alias("super")).distinct()


def _below(quads: DataFrame, p: str) -> set[str] | DataFrame:
    """``p`` and all predicates under it: as names where the hierarchy has at most ``SMALL`` links, else as a frame (column ``sub``)."""
    links = _property_links(quads)
    known = links.limit(SMALL + 1).collect()
    if len(known) > SMALL:
        return subproperties(quads).where(F.col("super") == p).select("sub").unionByName(quads.sparkSession.createDataFrame([(p,)], "sub string")).distinct()
    below: dict[str, list[str]] = {}
    for r in known:
        below.setdefault(r["super"], []).append(r["sub"])
    subs, last = {p}, [p]
    while last:
        last = [x for y in last for x in below.get(y, []) if x not in subs and not subs.add(x)]
    return subs


def _by(live: DataFrame, names: set[str] | DataFrame) -> DataFrame:
    """The rows whose predicate is one of the names: a filter that is pushed to the scan, or a semi join."""
    return live.where(F.col("p").isin(sorted(names))) if isinstance(names, set) else live.join(names.select(F.col("sub").alias("p")), "p", "left_semi")


def has(quads: DataFrame, s=None, p: str | None = None, o=None, inverses: dict[str, str] | None = None, real: bool = False) -> DataFrame:
    """Triples (s, o...) for which ``p``, a sub-property of it, or an inverse of one of these holds; for inverses (``inverses``: predicate -> inverse; a
    symmetric predicate is its own) subject and object are swapped and literals don't match. With ``real`` the predicate that holds too: ``real_p``,
    ``is_inverse``. With ``p`` unbound it is the plain pattern. The names of predicates become one filter that is pushed to the scan; of
    a hierarchy of more than ``SMALL`` links they are joined."""
    live = visible(quads)
    keep = ["s", "o", "o_kind", "o_dt", "o_lang"]
    if p is None:
        rows = live.select(*keep, F.col("p").alias("real_p"), F.lit(False).alias("is_inverse"))
    else:
        straight = _below(quads, p)
        both = (inverses or {}) | {b: a for a, b in (inverses or {}).items()}
        if isinstance(straight, set):
            swapped = {both[x] for x in straight if x in both}
        elif both:
            pairs = quads.sparkSession.createDataFrame(list(both.items()), "sub string, other string")
            swapped = straight.join(pairs, "sub").select(F.col("other").alias("sub"))
        else:
            swapped = set()
        rows = _by(live, straight).select(*keep, F.col("p").alias("real_p"), F.lit(False).alias("is_inverse"))
        if not isinstance(swapped, set) or swapped:
            kind = F.when(F.col("s").startswith("_:"), 1).otherwise(0).cast("tinyint")
            none = F.lit(None).cast("string")
            back = _by(live, swapped).where(F.col("o_kind") != LITERAL)
            rows = rows.unionByName(back.select(F.col("o").alias("s"), F.col("s").alias("o"), kind.alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"), F.col("p").alias("real_p"), F.lit(True).alias("is_inverse")))
    if s is not None:
        rows = rows.where(F.col("s") == s)
    if o is not None:
        rows = rows.where(object_is(o))
    return rows.select(*keep, *(["real_p", "is_inverse"] if real else [])).distinct()


def has_all(quads: DataFrame) -> DataFrame:
    """Every triple under its predicate and all predicates above it, as a join with the closure: s, p, o..., real_p."""
    live = visible(quads).select(*TRIPLE)
    subs = subproperties(quads)
    if subs.count() <= SMALL:  # a hot predicate stays where it is
        subs = F.broadcast(subs)
    up = live.join(subs, live["p"] == subs["sub"]).select("s", F.col("super").alias("p"), "o", "o_kind", "o_dt", "o_lang", F.col("sub").alias("real_p"))
    return live.withColumn("real_p", F.col("p")).unionByName(up).distinct()


def reachable(quads: DataFrame, start: str | None = None, p: str | None = None, target=None, max_depth: int | None = None, inverses: dict[str, str] | None = None) -> DataFrame:
    """Nodes reached from ``start`` over ``p`` as in ``has`` (or, with only ``target`` bound, nodes that reach it): s, o, o_kind, d - the fewest
    steps; the start itself with 0, even if the predicate is unknown. Literals are reached but not left. Both ends unbound is an error.

    A loop of joins, each step from the nodes found last to those not found before; it ends when none is new, so loops are no
    danger. Each step is written to the shared folder and reads only the edges of the predicate."""
    if start is None and target is None:
        raise ValueError("start or target must be bound")
    forward = start is not None
    origin = start if forward else target
    edges = has(quads, p=p, inverses=inverses).select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("o_kind").alias("b_kind"))
    if not forward:
        edges = edges.where(F.col("b_kind") != LITERAL).select(F.col("b").alias("a"), F.col("a").alias("b"), F.when(F.col("a").startswith("_:"), 1).otherwise(0).cast("tinyint").alias("b_kind"))
    edges = materialize(edges)
    hot = hot_keys(edges, "a")  # hubs
    seed = quads.sparkSession.createDataFrame([(origin, 1 if origin.startswith("_:") else IRI, 0)], "n string, n_kind tinyint, d int")
    seen, last, depth = [seed], seed, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        known = reduce(DataFrame.unionByName, seen).select(F.col("n").alias("b"), F.col("n_kind").alias("b_kind"))
        froms = last.where(F.col("n_kind") != LITERAL).select(F.col("n").alias("a"))
        step = lookup_join(edges, froms, "a", "inner", hot=hot).select("b", "b_kind").distinct().join(known, ["b", "b_kind"], "left_anti")
        last = materialize(step.select(F.col("b").alias("n"), F.col("b_kind").alias("n_kind"), F.lit(depth).alias("d")))
        if last.isEmpty():
            break
        seen.append(last)
        if target is not None and forward and not last.where(F.col("n") == target).isEmpty():
            break
    found = reduce(DataFrame.unionByName, seen)
    if forward:
        out = found.select(F.lit(origin).alias("s"), F.col("n").alias("o"), F.col("n_kind").alias("o_kind"), "d")
        return out if target is None else out.where(F.col("o") == target)
    return found.select(F.col("n").alias("s"), F.lit(origin).alias("o"), F.lit(IRI).cast("tinyint").alias("o_kind"), "d")
