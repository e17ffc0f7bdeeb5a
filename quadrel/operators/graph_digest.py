"""Two graphs held against each other at size, up to the names of blank nodes: in how many statements they differ.

A blank node's colour is refined from the colours of its neighbours until its component, the blank nodes linked to it, splits no further; then the colours of the
whole component are mixed in. So a colour depends on the component alone, not on where its statements lie. Where a component lies within one piece of a
partition it is coloured there, in an Arrow batch, and nothing but the names of nodes is shuffled, to see that none stands in two pieces; if one does, the
graph is coloured by joins. Statements are counted and summed by bucket, and one by one only in the buckets that differ.

Terms, colours and statements are two hashes of 64 bits, made apart from each other (lanes 1 and 2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.schema import BNODE, is_bnode_text, visible
from quadrel.storage import materialize, scratch, ship

BUCKETS, LANES = 4096, (1, 2)
#: Statements coloured at once; those of a piece's last components go to the next piece, as long as they are no more than MOST.
PIECE, TAIL, MOST = 400_000, 64, 4_000_000
#: What is hashed.
OUT, INTO, START, ROUND, MEMBER, FINAL, ROW = range(1, 8)
NODE, BLANK, GROUND = 0, 1, 2
ROWS = "kind tinyint, a bigint, b bigint, n bigint"
_LOW = 0xFFFFFFFF


def _hash(what: int, lane: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(10 * what + lane).cast("bigint"), *cols)


def _terms(quads: DataFrame) -> DataFrame:
    """s1, s2, p1, p2, o1, o2, and whether subject (1) and object (2) are blank nodes."""
    s_blank, o_blank = F.coalesce(is_bnode_text(F.col("s")), F.lit(False)), F.col("o_kind") == BNODE
    whole = [F.col("o"), F.col("o_kind"), F.coalesce("o_dt", F.lit("\u0001")), F.coalesce("o_lang", F.lit("\u0001"))]
    cols = [c for k in LANES for c in (_hash(0, k, F.col("s")).alias(f"s{k}"), _hash(0, k, F.col("p")).alias(f"p{k}"), F.when(o_blank, _hash(0, k, F.col("o"))).otherwise(_hash(0, k, *whole)).alias(f"o{k}"))]
    return visible(quads).select(*cols, (s_blank.cast("tinyint") + F.when(o_blank, 2).otherwise(0)).cast("tinyint").alias("blank"))


# -- pieces of partitions -----------------------------------------------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _xx(what: int, lane: int, *cols: np.ndarray) -> np.ndarray:
    """As ``_hash``: Spark's xxhash64 of numbers."""
    with np.errstate(over="ignore"):
        h = np.full(1, 42, np.uint64)
        for v in (np.full(1, 10 * what + lane, np.uint64), *cols):
            h = (h + (_P5 + np.uint64(8))) ^ (_turn(v * _P2, 31) * _P1)
            h = _turn(h, 27) * _P1 + _P4
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            h = h ^ (h >> np.uint64(32))
        return h


def _sum_at(n: int, at: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, at, x)
    return out


def _distinct(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    with np.errstate(over="ignore"):
        key = np.sort(t["s1"] * _P1 + t["p1"] * _P2 + t["o1"] * _P3)
    if not (key[1:] == key[:-1]).any():
        return t
    names = [n for n in t if n != "blank"]
    order = np.lexsort([t[n] for n in names])
    new = np.ones(len(order), bool)
    new[1:] = np.any([t[n][order][1:] != t[n][order][:-1] for n in names], axis=0)
    keep = np.sort(order[new])
    return {n: x[keep] for n, x in t.items()}


def _components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while (label[x] != label[y]).any():
        least = np.minimum(label[x], label[y])
        for at in (label[x], label[y], x, y):
            np.minimum.at(label, at, least)
        while (label[label] != label).any():
            label = label[label]
    return label


def _piece(t: dict[str, np.ndarray], last: bool) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The nodes' names, the statements' hashes in two lanes, which of them have no blank node, and which rows are left to the next piece."""
    s_blank, o_blank = (t["blank"] & 1) > 0, (t["blank"] & 2) > 0
    m = int(s_blank.sum())
    ids = [np.concatenate([t[f"s{k}"][s_blank], t[f"o{k}"][o_blank]]) for k in LANES]
    _, first, at = np.unique(ids[0], return_index=True, return_inverse=True)
    if (ids[1][first][at] != ids[1]).any():  # names that one hash can't tell apart
        _, first, at = np.unique(np.stack(ids, 1), axis=0, return_index=True, return_inverse=True)
        at = at.reshape(-1)
    n, s, o = len(first), np.full(len(s_blank), -1), np.full(len(s_blank), -1)
    s[s_blank], o[o_blank] = at[:m], at[m:]
    both = s_blank & o_blank
    comp = _components(n, s[both], o[both])
    left = np.zeros(len(s), bool)
    if not last:
        touched = np.zeros(n, bool)
        for x in (s[-TAIL:], o[-TAIL:]):
            touched[comp[x[x >= 0]]] = True
        left = (s_blank & touched[comp[s]] if n else left) | (o_blank & touched[comp[o]] if n else left)
    go = np.ones(n, bool) if not left.any() else ~touched[comp]
    colours, names = _coloured(t, s, o, comp, go, ~left), ids[0][first][go]
    value = lambda side, node, blank, k: np.where(blank, colours[k][node], t[f"{side}{k}"]) if n else t[f"{side}{k}"]
    rows = {k: _xx(ROW, k, value("s", s, s_blank, k), t[f"p{k}"], value("o", o, o_blank, k))[~left] for k in LANES}
    return names, rows, ~(s_blank | o_blank)[~left], left


def _coloured(t: dict[str, np.ndarray], s: np.ndarray, o: np.ndarray, comp: np.ndarray, go: np.ndarray, use: np.ndarray) -> dict[int, np.ndarray]:
    n, s_blank, o_blank = len(comp), s >= 0, o >= 0
    out, into, both = use & s_blank & ~o_blank, use & o_blank & ~s_blank, np.flatnonzero(use & s_blank & o_blank)
    c = {k: _xx(START, k, _sum_at(n, s[out], _xx(OUT, k, t[f"p{k}"][out], t[f"o{k}"][out])) + _sum_at(n, o[into], _xx(INTO, k, t[f"p{k}"][into], t[f"s{k}"][into]))) for k in LANES}
    live = np.flatnonzero(go)

    def classes() -> np.ndarray:
        order = np.lexsort((c[1][live], comp[live]))
        x, y = comp[live][order], c[1][live][order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        return np.bincount(x[new], minlength=n)

    count = classes()
    while len(live):
        es, eo = s[both], o[both]
        fresh = {}
        for k in LANES:
            p = t[f"p{k}"][both]
            near = _sum_at(n, es, _xx(OUT, k, p, c[k][eo])) + _sum_at(n, eo, _xx(INTO, k, p, c[k][es]))
            fresh[k] = _xx(ROUND, k, c[k][live], near[live])
        for k in LANES:
            c[k][live] = fresh[k]
        now = classes()
        more = now != count
        live, both, count = live[more[comp[live]]], both[more[comp[es]]], now
    whole = np.flatnonzero(go)
    for k in LANES:
        total = _sum_at(n, comp[whole], _xx(MEMBER, k, c[k][whole]))
        c[k][whole] = _xx(FINAL, k, c[k][whole], total[comp[whole]])
    return c


def _batch(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.view(np.int64))], ["kind", "a", "b", "n"])


def _local(wanted: np.ndarray | None):
    """Rows of NODE (name, 0, 1), GROUND (hashes, 1), and BLANK: by bucket (bucket, part, sum), or of the wanted buckets (hashes, 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        sums = np.zeros((5, BUCKETS), np.uint64)
        size, due = 0, PIECE

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, due
            t = _distinct({n: np.concatenate([h[n] for h in held]) for n in held[0]})
            names, rows, ground, left = _piece(t, last)
            held, size = ([{n: x[left] for n, x in t.items()}], int(left.sum())) if left.any() else ([], 0)
            due = max(PIECE, 2 * size)
            bucket = (rows[1] & np.uint64(BUCKETS - 1)).astype(np.int64)
            if wanted is None:
                yield _batch(NODE, names, np.zeros(len(names), np.uint64), np.ones(len(names), np.uint64))
                for j, x in enumerate([np.ones(len(bucket), np.uint64), *[y for k in LANES for y in (rows[k] & np.uint64(_LOW), rows[k] >> np.uint64(32))]]):
                    np.add.at(sums[j], bucket[~ground], x[~ground])
            else:
                pick = ~ground & wanted[bucket]
                yield _batch(BLANK, rows[1][pick], rows[2][pick], np.ones(int(pick.sum()), np.uint64))
            pick = ground & (True if wanted is None else wanted[bucket])
            yield _batch(GROUND, rows[1][pick], rows[2][pick], np.ones(int(pick.sum()), np.uint64))

        for batch in batches:
            got = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            held.append({n: x if n == "blank" else x.view(np.uint64) for n, x in got.items()})
            size += batch.num_rows
            if size >= min(due, MOST):
                yield from work(size >= MOST)
        if size:
            yield from work(True)
        if wanted is None:
            for j in range(5):
                at = np.flatnonzero(sums[j]).astype(np.uint64)
                yield _batch(BLANK, at, np.full(len(at), j, np.uint64), sums[j][at.astype(np.int64)])

    return run


# -- components that lie apart: by joins --------------------------------------------------------------------------


def _total(c: Column) -> Column:
    """Sum modulo 2 to the 64."""
    low, high = F.sum(c.bitwiseAND(F.lit(_LOW))), F.sum(F.shiftrightunsigned(c, 32))
    return F.shiftleft((high + F.shiftrightunsigned(low, 32)).bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low.bitwiseAND(F.lit(_LOW)))


def _labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Every node b with the least node of its component, comp."""
    pairs = materialize(links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels, moved = materialize(nodes.select("b", F.col("b").alias("comp"), F.lit(True).alias("moved"))), True
    while moved:
        near = pairs.join(labels.select(F.col("b").alias("y"), "comp"), "y").groupBy(F.col("x").alias("b")).agg(F.min("comp").alias("near"))
        hooked = materialize(labels.select("b", "comp").join(near, "b", "left").select("b", F.least("comp", "near").alias("to"), "comp"))
        labels = materialize(hooked.join(hooked.select(F.col("b").alias("to"), F.col("to").alias("next")), "to").select("b", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")))
        moved = not labels.where("moved").isEmpty()
    return labels.select("b", "comp")


def _spread(terms: DataFrame) -> DataFrame:
    """The rows of GROUND and BLANK statements, (kind, a, b, n), coloured by joins."""
    t = materialize(terms.distinct().select("*", F.struct(F.col("s1").alias("x1"), F.col("s2").alias("x2")).alias("s"), F.struct(F.col("o1").alias("x1"), F.col("o2").alias("x2")).alias("o")))
    s_blank, o_blank = F.col("blank").isin(1, 3), F.col("blank").isin(2, 3)
    edges = t.where("blank = 3")
    out = t.where(s_blank).select(F.col("s").alias("b"), *[F.when(o_blank, F.lit(0)).otherwise(_hash(OUT, k, F.col(f"p{k}"), F.col(f"o{k}"))).cast("bigint").alias(f"g{k}") for k in LANES])
    into = t.where(o_blank).select(F.col("o").alias("b"), *[F.when(s_blank, F.lit(0)).otherwise(_hash(INTO, k, F.col(f"p{k}"), F.col(f"s{k}"))).cast("bigint").alias(f"g{k}") for k in LANES])
    starts = materialize(out.unionByName(into).groupBy("b").agg(*[_total(F.col(f"g{k}")).alias(f"g{k}") for k in LANES]).select("b", *[_hash(START, k, F.col(f"g{k}")).alias(f"c{k}") for k in LANES]))
    labels = _labels(starts, edges.select(F.col("s").alias("x"), F.col("o").alias("y")))

    def counted(nodes: DataFrame) -> DataFrame:
        return materialize(nodes.join(nodes.groupBy("comp").agg(F.countDistinct("c1").alias("now")), "comp"))

    live, done = counted(starts.join(labels, "b")).withColumn("count", F.lit(0)), []
    while not live.isEmpty():
        at = lambda side: live.select(F.col("b").alias(side), *[F.col(f"c{k}").alias(f"{side}_c{k}") for k in LANES])  # noqa: E731, B023
        named = edges.join(at("s"), "s").join(at("o"), "o")
        sent = named.select(F.col("s").alias("b"), *[_hash(OUT, k, F.col(f"p{k}"), F.col(f"o_c{k}")).alias(f"x{k}") for k in LANES]).unionByName(named.select(F.col("o").alias("b"), *[_hash(INTO, k, F.col(f"p{k}"), F.col(f"s_c{k}")).alias(f"x{k}") for k in LANES]))
        near = sent.groupBy("b").agg(*[_total(F.col(f"x{k}")).alias(f"n{k}") for k in LANES])
        fresh = materialize(live.join(near, "b", "left").select("b", "comp", F.col("now").alias("count"), *[_hash(ROUND, k, F.col(f"c{k}"), F.coalesce(f"n{k}", F.lit(0).cast("bigint"))).alias(f"c{k}") for k in LANES]))
        split = counted(fresh)
        done.append(split.where("now = count"))
        live = split.where("now != count")
    if done:
        found = reduce(DataFrame.unionByName, done)
        totals = found.groupBy("comp").agg(*[_total(_hash(MEMBER, k, F.col(f"c{k}"))).alias(f"d{k}") for k in LANES])
        colours = materialize(found.join(totals, "comp").select("b", *[_hash(FINAL, k, F.col(f"c{k}"), F.col(f"d{k}")).alias(f"c{k}") for k in LANES]))
    else:
        colours = starts
    side = lambda x: colours.select(F.col("b").alias(x), *[F.col(f"c{k}").alias(f"{x}_c{k}") for k in LANES])
    ground = t.where("blank = 0").select(F.lit(GROUND).alias("kind"), *[_hash(ROW, k, F.col(f"s{k}"), F.col(f"p{k}"), F.col(f"o{k}")).alias("ab"[k - 1]) for k in LANES])
    some = t.where("blank > 0")
    some = some.where(s_blank).join(side("s"), "s").unionByName(some.where(~s_blank).select("*", *[F.col(f"s{k}").alias(f"s_c{k}") for k in LANES]))
    some = some.where(o_blank).join(side("o"), "o").unionByName(some.where(~o_blank).select("*", *[F.col(f"o{k}").alias(f"o_c{k}") for k in LANES]))
    rows = some.select(F.lit(BLANK).alias("kind"), *[_hash(ROW, k, F.col(f"s_c{k}"), F.col(f"p{k}"), F.col(f"o_c{k}")).alias("ab"[k - 1]) for k in LANES])
    return materialize(ground.unionByName(rows).select(F.col("kind").cast("tinyint").alias("kind"), "a", "b", F.lit(1).cast("bigint").alias("n")))


# -- comparison ---------------------------------------------------------------------------------------------------


def _bucket() -> Column:
    return F.col("a").bitwiseAND(F.lit(BUCKETS - 1))


def _parts(rows: DataFrame) -> DataFrame:
    """Statements' hashes as (bucket, part, sum)."""
    parts = [F.col("n"), *[y * F.col("n") for x in "ab" for y in (F.col(x).bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(F.col(x), 32))]]
    return rows.select(_bucket().alias("a"), F.posexplode(F.array(*parts)).alias("b", "n")).select("a", F.col("b").cast("bigint").alias("b"), "n")


class _Graph:
    def __init__(self, quads: DataFrame) -> None:
        self.terms, self.rows = _terms(quads), None
        ship(quads.sparkSession)
        found = materialize(self.terms.mapInArrow(_local(None), ROWS).groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).where(f"kind != {NODE} or n > 1"))
        if found.where(f"kind = {NODE}").isEmpty():
            sums = found.where(f"kind = {BLANK}").select("a", "b", "n").unionByName(_parts(found.where(f"kind = {GROUND}").withColumn("n", F.lit(1).cast("bigint"))))
        else:
            self.rows = _spread(self.terms)
            sums = _parts(self.rows)
        self.sums = materialize(sums.groupBy("a", "b").agg(F.sum("n").alias("n")))

    def statements(self, buckets: list[int]) -> DataFrame:
        """(a, b, n) of the statements of some buckets."""
        if self.rows is not None:
            rows = self.rows.where(_bucket().isin(buckets))
        else:
            wanted = np.zeros(BUCKETS, bool)
            wanted[buckets] = True
            rows = self.terms.mapInArrow(_local(wanted), ROWS)
        return rows.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).select("a", "b", F.when(F.col("kind") == GROUND, 1).otherwise(F.col("n")).alias("n"))


def count_different(a: DataFrame, b: DataFrame) -> int:
    """How many statements of either graph have no like in the other, blank nodes replaced by their colours; a statement that stands n times more in one
    counts n times. Equal graphs give 0; so do graphs that colours can't tell apart (``compare.equal_graphs`` does)."""
    with scratch():
        x, y = _Graph(a), _Graph(b)
        signed = lambda p, q: p.unionByName(q.withColumn("n", -F.col("n"))).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n != 0")
        buckets = [r["a"] for r in signed(x.sums, y.sums).select("a").distinct().collect()]
        if not buckets:
            return 0
        return signed(x.statements(buckets), y.statements(buckets)).agg(F.sum(F.abs("n"))).collect()[0][0] or 0
