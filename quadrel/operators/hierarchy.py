"""Parent-child links to full hierarchies by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quadrel.skew import lookup_join
from quadrel.storage import materialize, release

#: Rounds in which every node's segment doubles; after them it has ``SEGMENT`` nodes.
SHORT_ROUNDS = 4
SEGMENT = 1 << SHORT_ROUNDS
_LIVE, _DONE, _ASKED = 0, 1, 2


def _no_text() -> Column:
    return F.lit(None).cast("string")


def _no_path() -> Column:
    return F.lit(None).cast("array<string>")


def _round(live: DataFrame, targets: DataFrame, rows: int, paths: bool) -> tuple[DataFrame, dict]:
    """One doubling. ``live`` (node, ptr, dist, least, seg) meets ``targets`` (node, root, dist, seg), resolved nodes, and itself. Written, with a column
    ``kind``: live rows whose pointer jumps twice as far, rows resolved now, and the targets that were asked for; only
    nodes pointed at in one round can be pointed at in the next, so the others are left behind. With the counts of it."""
    as_target = lambda df, root, ptr, least: df.select(
        F.col("node").alias("ptr"), root.alias("t_root"), ptr.alias("t_ptr"), F.col("dist").alias("t_dist"), least.alias("t_least"), F.col("seg").alias("t_seg"))
    target = as_target(targets, F.col("root"), _no_text(), _no_text()).unionByName(as_target(live, _no_text(), F.col("ptr"), F.col("least")))
    if paths:  # paths are small in files and large in memory, so they aren't left to a broadcast
        target = target.hint("merge")
    seg = F.concat("t_seg", "seg") if paths else _no_path()
    step = lookup_join(live, target, "ptr", "inner", rows=rows).select(
        F.when(F.col("t_root").isNull(), _LIVE).otherwise(_DONE).alias("kind"), "node", F.col("t_root").alias("root"), F.col("t_ptr").alias("ptr"),
        (F.col("dist") + F.col("t_dist")).alias("dist"), F.least("least", "t_least").alias("least"), seg.alias("seg"), (F.col("t_least") < F.col("least")).alias("lower"))
    pointers = live.select(F.col("ptr").alias("node")).distinct()
    asked = targets.join(pointers, "node", "left_semi").select(F.lit(_ASKED).alias("kind"), "node", "root", _no_text().alias("ptr"), "dist", _no_text().alias("least"), F.col("seg"), F.lit(False).alias("lower"))
    seen = Observation()
    kind = lambda k: F.count(F.when(F.col("kind") == k, 1))
    out = materialize(step.unionByName(asked).observe(seen, kind(_LIVE).alias("live"), kind(_DONE).alias("done"), F.count(F.when(F.col("lower"), 1)).alias("lower")))
    return out, seen.get


def _of(frame: DataFrame, *kinds: int, seg: bool = True) -> DataFrame:
    part = frame.where(F.col("kind").isin(*kinds)).select("node", "root", "ptr", "dist", "least", "seg")
    return part if seg else part.withColumn("seg", _no_path())


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _result(frame: DataFrame, path: Column) -> DataFrame:
    return frame.select("node", "root", F.col("dist").cast("int").alias("depth"), path.alias("path"))


def hierarchy(links: DataFrame, child: str = "child", parent: str = "parent", with_path: bool = True) -> DataFrame:
    """One row per node of ``links``: node, root, depth INT and, with ``with_path``, path (root first, node last).

    Pointer doubling: every node points at its parent; each round replaces the pointer by the pointer's own, doubling the
    jump and adding up distances, until it reaches a resolved node. A round that resolves nothing leaves only nodes on a loop
    or leading into one: a resolvable node would have an ancestor that this round resolves. For these the doubling
    goes on until the number of distinct pointers stays, so that the jump permutes them and they are exactly the loops' nodes, and no
    smallest node on the way changes, so that the jump covers the loops. For a node on a loop root is the loop's smallest node and depth
    -1; for one leading into a loop root is that loop's smallest node and depth -2; both have a null path.

    Path segments are concatenated by the same doubling. For the first ``SHORT_ROUNDS`` rounds all nodes carry theirs, which then has
    ``SEGMENT`` nodes, and pointers go on without. In the segment of a deeper node stands its anchor, the nearest ancestor or self whose depth is
    a multiple of ``SEGMENT``; paths of anchors, few in a deep tree, double on by whole segments, and a deeper node's path is its
    anchor's and the rest of its segment, put together once, where it is read. Nodes caught in loops so never carry more than ``SEGMENT`` nodes, and
    the volume doubled is the nodes' plus a ``SEGMENT``-th of the paths'.

    Links with a null end are left out, equal links count once, extra columns are ignored. Of several parents of a
    child the smallest is taken, so the result doesn't depend on row order. An empty table gives no rows. The number
    of rounds is the logarithm of the greatest depth (or of the longest way into and around a loop) and two, for paths as many again less four.
    """
    edges = links.select(F.col(child).cast("string").alias("node"), F.col(parent).cast("string").alias("ptr")).where("node is not null and ptr is not null")
    ends = edges.unionByName(edges.select(F.col("ptr").alias("node"), _no_text().alias("ptr")))
    count = Observation()
    start = ends.groupBy("node").agg(F.min("ptr").alias("ptr"))
    nodes = materialize(start.observe(count, F.count("ptr").alias("live")))
    seg = F.array("node") if with_path else _no_path()
    first = nodes.select(
        F.when(F.col("ptr").isNull(), _DONE).otherwise(_LIVE).alias("kind"), "node", F.when(F.col("ptr").isNull(), F.col("node")).alias("root"), "ptr",
        F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("bigint").alias("dist"), F.when(F.col("ptr").isNotNull(), F.col("node")).alias("least"), seg.alias("seg"))
    result, deep, wide = [_result(_of(first, _DONE), F.col("seg"))], [], None
    live, targets, left, number = _of(first, _LIVE), _of(first, _DONE), count.get["live"], 0
    looping, before = False, None
    while left:
        number += 1
        paths = with_path and number <= SHORT_ROUNDS
        step, seen = _round(live, targets, left, paths)
        if seen["done"]:
            if number <= SHORT_ROUNDS or not with_path:
                result.append(_result(_of(step, _DONE), F.col("seg")))
            else:
                deep.append(_of(step, _DONE))
        if number == SHORT_ROUNDS:
            wide = _of(step, _LIVE).select("node", F.col("ptr").alias("above"), "seg")
        carries = paths and number < SHORT_ROUNDS
        live, targets, left = _of(step, _LIVE, seg=carries), _of(step, _DONE, _ASKED, seg=carries), seen["live"]
        looping = looping or not seen["done"]
        if looping and left:
            pointers = live.select("ptr").distinct().count()
            if before == pointers and not seen["lower"]:
                break
            before = pointers
    if deep:
        result.append(_deep_paths(_union(deep), wide))
    if left:
        loops = live.select(F.col("ptr").alias("node")).distinct()
        on = materialize(live.join(loops, "node", "left_semi").select("node", F.col("least").alias("root")))
        into = lookup_join(live.join(loops, "node", "left_anti").select("node", "ptr"), on.select(F.col("node").alias("ptr"), "root"), "ptr", "inner", rows=left)
        for part, depth in ((on, -1), (into, -2)):
            result.append(part.select("node", "root", F.lit(depth).alias("depth"), _no_path().alias("path")))
    out = _union(result)
    return out if with_path else out.drop("path")


def _deep_paths(deep: DataFrame, wide: DataFrame) -> DataFrame:
    """Rows of nodes at a depth of ``SEGMENT`` or more; ``wide`` has the ``SEGMENT`` nodes up to each (seg) and the one above them."""
    count = Observation()
    past = F.pmod("dist", F.lit(SEGMENT)).cast("int")
    is_anchor = past == 0
    known = deep.select("node", "root", "dist").join(wide, "node").select(
        "node", "root", "dist", F.element_at("seg", SEGMENT - past).alias("anchor"), F.slice("seg", SEGMENT + 1 - past, past).alias("rest"),
        F.when(is_anchor, F.col("above")).alias("above"), F.when(is_anchor, F.col("seg")).alias("seg"))
    known = materialize(known.observe(count, F.count(F.lit(1)).alias("nodes"), F.count(F.when(is_anchor & (F.col("dist") > SEGMENT), 1)).alias("live")))
    anchors = known.where("seg is not null")
    top = F.col("dist") == SEGMENT
    # An anchor of the least depth points at a root, so its path is whole.
    first = anchors.select(F.when(top, _DONE).otherwise(_LIVE).alias("kind"), "node", "root", F.when(~top, F.col("above")).alias("ptr"), "dist", _no_text().alias("least"), F.when(top, F.concat(F.array("above"), "seg")).otherwise(F.col("seg")).alias("seg"))
    done, live, targets, left = [_of(first, _DONE)], _of(first, _LIVE), _of(first, _DONE), count.get["live"]
    while left:
        step, seen = _round(live.withColumn("root", _no_text()), targets, left, True)
        done.append(_of(step, _DONE))
        live, targets, left = _of(step, _LIVE), _of(step, _DONE, _ASKED), seen["live"]
    paths = _union(done).select(F.col("node").alias("anchor"), F.col("seg").alias("head"))
    rows = lookup_join(known.select("node", "root", "dist", "anchor", "rest"), paths.hint("merge"), "anchor", "inner", rows=count.get["nodes"])
    return _result(rows, F.concat("head", "rest"))


def descendants(nodes: DataFrame) -> DataFrame:
    """Of ``hierarchy`` with paths: a row per node and each of its descendants: node, descendant, distance INT."""
    far = nodes.where(F.size("path") > 1).select(F.col("node").alias("descendant"), "depth", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("pos", "node"))
    return far.select("node", "descendant", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
