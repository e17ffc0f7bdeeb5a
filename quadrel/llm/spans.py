"""Long exact spans shared between records, found with a count-min prefilter."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.skew import counted_hot, lookup_join
from quadrel.storage import materialize, ship

#: Characters of a block that is hashed at once; bounds the memory of a task whatever the length of a text.
BLOCK = 1 << 20
#: Anchors a task holds before it sends them on.
CHUNK_KEYS = 1 << 20
#: Least number of cells of a row of a shard's sketch; the number grows with the anchors of a shard.
LEAST_CELLS = 1 << 12
ROWS = 2
#: An anchor with more distinct regions isn't compared within one task.
MANY_FORMS = 1 << 12
_MULT = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)  # odd, so powers can be inverted modulo 2**64


def _mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base, out = _MULT[which], []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, np.uint64(b))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class _Hashes:
    """Hashes of all stretches of a block of code points, by a polynomial modulo 2**64."""

    def __init__(self, points: np.ndarray, which: int) -> None:
        n = len(points) + 1
        self.up, self.down = (x[:n] for x in _powers(which, 1 << max(21, (n - 1).bit_length() + (n & (n - 1) != 0))))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_mixed(points.astype(np.uint64), 1 + which * 0x51ED2701) * self.up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        return _mixed((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def _points(pieces: list[str]) -> np.ndarray:
    return np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(ids: list, texts: list, length: int, block: int) -> Iterator[tuple[list, np.ndarray, list[str]]]:
    """Texts in blocks of about ``block`` characters: ids, the place of each piece in its text, pieces. A longer text is cut into
    pieces that overlap by a window less one, so every window lies whole in exactly one piece."""
    who, at, pieces, size = [], [], [], 0
    for i, text in zip(ids, texts):
        if text is None or len(text) < length or i is None:
            continue
        for a in range(0, len(text) - length + 1, block):
            piece = text[a : a + block + length - 1]
            if size and size + len(piece) > block + length:
                yield who, np.array(at), pieces
                who, at, pieces, size = [], [], [], 0
            who.append(i)
            at.append(a)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield who, np.array(at), pieces


def _regions(pieces: list[str], length: int, gram: int) -> dict[str, np.ndarray]:
    """The windows of the pieces, in regions: neighbouring windows with the same anchor, which is the gram of least hash in a
    window. What anchor a window has depends on its own characters only, so equal windows have equal anchors."""
    points = _points(pieces)
    n, width = len(points), length - gram + 1
    ends = np.cumsum([len(p) for p in pieces])
    h1, h2 = _Hashes(points, 0), _Hashes(points, 1)
    grams = h1.grams(gram)
    low = np.uint64((1 << 22) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    anchor = (least & low).astype(np.int64)[: n - length + 1]
    starts = np.arange(len(anchor))
    piece = np.searchsorted(ends, starts, side="right")
    whole = starts + length <= ends[piece]
    turn = np.ones(len(anchor) + 1, bool)
    turn[1:-1] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (piece[1:] != piece[:-1])
    edge = np.flatnonzero(turn)
    first, last = edge[:-1], edge[1:] - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    at = anchor[first]
    shape = ((last - first).astype(np.uint64) << np.uint64(32)) | (at - first).astype(np.uint64)
    begin = np.concatenate(([0], ends[:-1]))
    return {
        "piece": piece[first], "start": first - begin[piece[first]], "n": last - first + 1, "key": grams[at],
        "c1": _mixed(h1.of(first, last + length) ^ _mixed(shape, 3)), "c2": _mixed(h2.of(first, last + length) ^ _mixed(shape, 5)),
    }


def _cells(keys: np.ndarray, cells: int, rows: int = ROWS) -> list[np.ndarray]:
    return [(_mixed(keys, 0xA5A5 + 7919 * r) & np.uint64(cells - 1)).astype(np.int64) for r in range(rows)]


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(keys, 0x5EED) % np.uint64(shards)).astype(np.int32)


_SKETCH, _ROUTED, _KNOWN = 0, 1, 2
_SENT = "shard int, what byte, cells binary, keys array<bigint>, docs array<{}>"


def _anchors(length: int, gram: int, block: int, shards: int, cells: int, kind: pa.DataType, most: int):
    """Anchors of texts, for the shards of the sketch. Of each chunk of anchors (each once a record) a shard gets the partition's sketch of it - the cells that
    are counted, the top bit for twice or more - and the anchors with their records. An anchor that the chunk has in two records is known to
    be repeated: it counts twice in the sketch, and its records don't wait for an estimate; so an anchor in a third of all records is sent once a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        number: dict = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def given() -> pa.RecordBatch:
            key, doc = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            key, doc = key[new], doc[new]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            times = np.diff(np.append(np.flatnonzero(first), len(key)))
            known = np.repeat(times > 1, times)
            rows: list[tuple] = []
            shard = _shard_of(key[first], shards)
            at = np.argsort(shard, kind="stable")
            for part in np.split(at, np.flatnonzero(np.diff(shard[at])) + 1):
                row_cells = [c.astype(np.uint32) | ((times[part] > 1).astype(np.uint32) << np.uint32(31)) for c in _cells(key[first][part], cells)]
                rows.append((shard[part[0]], _SKETCH, np.stack(row_cells).tobytes(), None))
            one = np.flatnonzero(~known)
            own = _shard_of(key[one], shards)
            at = np.argsort(own, kind="stable")
            for part in np.split(at, np.flatnonzero(np.diff(own[at])) + 1) if len(one) else []:
                rows.append((own[part[0]], _ROUTED, None, one[part]))
            both = np.flatnonzero(known)
            for i in range(0, len(both), 1 << 16):
                rows.append((int(doc[both[i]]) % shards, _KNOWN, None, both[i : i + (1 << 16)]))
            who = pa.array(names, kind)
            picks = [r[3] for r in rows if r[3] is not None]
            flat = np.concatenate(picks) if picks else np.empty(0, np.int64)
            ends = pa.array(np.cumsum([0, *(0 if r[3] is None else len(r[3]) for r in rows)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(key[flat].view(np.int64))), pa.ListArray.from_arrays(ends, who.take(pa.array(doc[flat])))]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int8()), pa.array([r[2] for r in rows], pa.binary()), *lists], ["shard", "what", "cells", "keys", "docs"])

        for batch in batches:
            for who, _, pieces in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length, block):
                r = _regions(pieces, length, gram)
                code = []
                for w in who:
                    if w not in number:
                        number[w] = len(names)
                        names.append(w)
                    code.append(number[w])
                held.append((r["key"], np.array(code)[r["piece"]]))
                size += len(r["key"])
                if size >= most:
                    yield given()
                    names, number, held, size = [], {}, [], 0
        if size:
            yield given()

    return run


def estimated(counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a sketch estimates to be counted twice or more; the estimate is never too low."""
    hot = np.ones(len(keys), bool)
    for row, cell in zip(counts, _cells(keys, counts.shape[1])):
        hot &= row[cell] > 1
    return hot


def _by_shard(cells: int, kind: pa.DataType):
    """Of the rows of ``_anchors``, sorted by shard and kind: the partitions' sketches of a shard are merged, then its anchors stream past the merged
    sketch. Given are (doc, key) of anchors estimated, or known, to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, np.zeros((ROWS, cells), np.uint8)
        for batch in batches:
            docs, keys = [], []
            for i, (shard, what) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("what").to_pylist())):
                if shard != now:
                    now = shard
                    counts[:] = 0
                if what == _SKETCH:
                    for row, cell in zip(counts, np.frombuffer(batch.column("cells")[i].as_py(), np.uint32).reshape(ROWS, -1)):
                        twice = cell >> np.uint32(31) == 1
                        cell = (cell & np.uint32(0x7FFFFFFF)).astype(np.int64)
                        some, n = np.unique(cell, return_counts=True)
                        row[some] = np.minimum(row[some] + np.minimum(n, 2), 2)
                        row[cell[twice]] = 2
                    continue
                key = batch.column("keys")[i].values
                hot = np.ones(len(key), bool) if what == _KNOWN else estimated(counts, key.to_numpy().view(np.uint64))
                at = pa.array(np.flatnonzero(hot))
                docs.append(batch.column("docs")[i].values.take(at))
                keys.append(key.take(at))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.concat_arrays(keys)], ["doc", "key"])

    return run


def repeated_anchors(texts: DataFrame, length: int, gram: int, block: int, kind: str, arrow: pa.DataType, cells: int | None = None) -> DataFrame:
    """(doc, key) of the anchors estimated to be in two records or more; none that is is left out. There are as many shards as shuffle partitions; a
    shard's sketch has about four cells an anchor (``cells`` a row, if given), so what a task holds is its share of the data and nothing goes to all tasks."""
    shards = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if cells is None:
        chars = texts.agg(F.sum(F.length("text"))).collect()[0][0] or 0
        cells = _cells_for(2 * chars // (length - gram + 2) // shards)
    sent = texts.mapInArrow(_anchors(length, gram, block, shards, cells, arrow, CHUNK_KEYS), _SENT.format(kind))
    return sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "what").mapInArrow(_by_shard(cells, arrow), f"doc {kind}, key bigint")


def _cells_for(keys: int) -> int:
    return max(LEAST_CELLS, 1 << max(0, 4 * keys - 1).bit_length())


_REGION = "doc {}, start bigint, n int, key bigint, c1 bigint, c2 bigint"


def _repeated_regions(length: int, gram: int, block: int, kind: pa.DataType):
    """The regions whose anchor is one of the repeated ones (column ``hot``) of the texts of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.unique(batch.column("hot").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            for who, at, pieces in _blocks(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), length, block):
                r = _regions(pieces, length, gram)
                hot = np.isin(r["key"], known)
                piece = r["piece"][hot]
                cols = [pa.array(who, kind).take(pa.array(piece)), pa.array(r["start"][hot] + at[piece]), pa.array(r["n"][hot].astype(np.int32))]
                cols += [pa.array(r[c][hot].view(np.int64)) for c in ("key", "c1", "c2")]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "start", "n", "key", "c1", "c2"])

    return run


_ASKED = ("start", "n", "many", "key", "c1", "c2", "forms")
_PIECE = "doc {}, start bigint, many boolean, key bigint, c1 bigint, c2 bigint, forms bigint, piece string"


def _cut(length: int, kind: pa.DataType):
    """The texts of the regions asked for, in the columns of ``_PIECE``."""
    types = (kind, pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def given(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "asked"))):
                out += [(doc, a["start"], a["many"], a["key"], a["c1"], a["c2"], a["forms"], text[a["start"] : a["start"] + a["n"] + length - 1]) for a in asked]
                if len(out) > 20_000:
                    yield given(out)
                    out = []
            yield given(out)

    return run


_WINDOWS = "key bigint, c1 bigint, c2 bigint, doc {}, start bigint, offs array<int>, w1 bigint, w2 bigint, off int, many boolean"


def _windows_of(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some pieces: number of the piece, offset, two hashes."""
    points, sizes = _points(texts), np.array([len(x) for x in texts])
    n = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(texts)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(sizes) - sizes)[which] + off
    return which, off, *(_Hashes(points, k).of(start, start + length) for k in (0, 1))


def _compared(length: int, kind: pa.DataType, most: int):
    """Windows of pieces that come sorted by anchor. Equal windows have equal anchors, so those of an anchor's pieces are compared among themselves: of each piece
    that stands in one record the offsets of windows that stand in another too (column ``offs``). Pieces of an anchor with more than
    ``most`` of them may be in several tasks; their windows are given one by one, to be grouped."""
    names = [c.split()[0] for c in _WINDOWS.split(", ")]

    def inside(rows: list[dict]) -> pa.RecordBatch:
        number: dict = {}
        doc = np.array([number.setdefault(r["doc"], len(number)) for r in rows])
        many = np.array([r["many"] for r in rows])
        which, off, w1, w2 = _windows_of([r["piece"] for r in rows], length)
        order = np.lexsort((w2, w1))
        new = np.ones(len(order), bool)
        new[1:] = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
        edge = np.flatnonzero(new)
        d = doc[which[order]]
        shared = np.empty(len(order), bool)
        if len(order):
            hit = (np.minimum.reduceat(d, edge) != np.maximum.reduceat(d, edge)) | np.logical_or.reduceat(many[which[order]], edge)
            shared[order] = np.repeat(hit, np.diff(np.append(edge, len(order))))
            shared &= ~many[which]
        picked, count = off[shared].astype(np.int32), np.bincount(which[shared], minlength=len(rows))
        some = np.flatnonzero(count)
        ends = np.concatenate(([0], np.cumsum(count[some]))).astype(np.int32)
        cols = [pa.array([rows[i][c] for i in some], t) for c, t in (("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("doc", kind), ("start", pa.int64()))]
        none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.bool_())]
        return pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(ends), pa.array(picked)), *none], names)

    def each(rows: list[dict]) -> pa.RecordBatch:
        which, off, w1, w2 = _windows_of([r["piece"] for r in rows], length)
        col = lambda c, t: pa.array([r[c] for r in rows], t).take(pa.array(which))
        return pa.RecordBatch.from_arrays([
            col("key", pa.int64()), col("c1", pa.int64()), col("c2", pa.int64()), col("doc", kind), col("start", pa.int64()), pa.nulls(len(which), pa.list_(pa.int32())),
            pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(off.astype(np.int32)), col("many", pa.bool_())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        large: list[dict] = []
        size = wide = 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["forms"] > most:
                    large.append(r)
                    wide += len(r["piece"])
                    if wide > BLOCK // 4:
                        yield each(large)
                        large, wide = [], 0
                    continue
                if size > BLOCK // 4 and r["key"] != rows[-1]["key"]:
                    yield inside(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["piece"])
        if rows:
            yield inside(rows)
        if large:
            yield each(large)

    return run


def shared_spans(docs: DataFrame, length: int = 150, doc_id: str = "doc_id", text: str = "text", gram: int = 50, cells: int | None = None, block: int = BLOCK) -> DataFrame:
    """The maximal runs of characters that lie in a passage of ``length`` characters standing verbatim in another record:
    doc_id, span_start, span_end (exclusive).

    1. Each window of ``length`` characters has an anchor, its gram of least hash; neighbouring windows with the same anchor form a
       region. Equal windows have equal anchors, so a window can only be shared if its anchor's gram is in two records.
    2. Count-min prefilter: the partitions' sketches of anchors' grams (each once a record) are merged by shard of the gram, as many shards as shuffle
       partitions, and the anchors pass the merged sketch of their shard; a count is never too low. A second pass over the texts keeps the
       regions whose anchor is estimated to be in two records or more and loses none (``repeated_anchors``).
    3. Regions kept are grouped exactly by anchor and by 128 bits of their whole text. A text found in two records is shared
       as a whole. Only where regions of one anchor differ and some stand in one record alone are single windows compared,
       one region for each distinct text and within the anchor, again by 128 bits (``_compared``).
    4. Shared windows are merged into runs per record.

    No pair of records is ever formed, and a passage in a third of all records is one group that is combined before the shuffle
    by counts and extremes. Sketches grow with the data, about four cells an anchor, and so do the shards they are dealt to; nothing that grows is broadcast. Long texts are hashed in overlapping pieces of ``block`` characters, at most 2**21.

    Null, empty and shorter texts and null ids give nothing. A record is an id: rows repeated under one id don't share with
    each other, but an id must not have two different texts. Empty in, empty out; other columns are ignored.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= length))
    kind, arrow = docs.schema[doc_id].dataType.simpleString(), _arrow_type(docs, doc_id)
    hot = repeated_anchors(texts, length, gram, block, kind, arrow, cells).groupBy("doc").agg(F.collect_set("key").alias("hot"))
    regions = materialize(texts.join(hot, "doc").select("doc", "text", "hot").mapInArrow(_repeated_regions(length, gram, block, arrow), _REGION.format(kind)))
    forms = regions.groupBy("key", "c1", "c2").agg((F.min("doc") != F.max("doc")).alias("many"), F.min(F.struct("doc", "start", "n")).alias("one"), F.count(F.lit(1)).alias("regions"))
    forms = materialize(forms)
    mixed = forms.groupBy("key").agg(F.count(F.lit(1)).alias("forms"), F.bool_and("many").alias("all_many")).where("forms > 1 and not all_many").select("key", "forms")
    differing = lookup_join(forms, mixed, "key", "inner").select("key", "c1", "c2", "many", "forms", "one.*")
    asked = differing.groupBy("doc").agg(F.collect_list(F.struct(*_ASKED)).alias("asked"))
    pieces = texts.join(asked, "doc").select("doc", "text", "asked").mapInArrow(_cut(length, arrow), _PIECE.format(kind))
    route = F.when(F.col("forms") > MANY_FORMS, F.xxhash64("doc", "start")).otherwise(F.col("key"))
    dealt = pieces.withColumn("_to", route).repartition("_to").drop("_to").sortWithinPartitions("key")
    found = materialize(dealt.mapInArrow(_compared(length, arrow, MANY_FORMS), _WINDOWS.format(kind)))
    windows = found.where("w1 is not null")
    common = windows.groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.bool_or("many").alias("m"), F.count(F.lit(1)).alias("rows")).where("m or lo <> hi")
    common = materialize(common.select("w1", "w2", "rows"))
    single = lookup_join(windows.where(~F.col("many")), common.drop("rows"), ["w1", "w2"], "inner", hot=counted_hot(common, "w1", "rows")).groupBy("c1", "c2", "key").agg(F.collect_set("off").alias("offs"))
    partly = found.where("offs is not null").select("c1", "c2", "key", "offs").unionByName(single)
    wholly = forms.where("many").select("c1", "c2", "key", F.lit(None).cast("array<int>").alias("offs"))
    hits = lookup_join(regions, wholly.unionByName(partly), ["c1", "c2", "key"], "inner", hot=counted_hot(forms, "c1", "regions"))
    begin = F.explode(F.coalesce(F.transform("offs", lambda o: F.struct((F.col("start") + o).alias("a"), (F.col("start") + o + length).alias("b"))), F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + length - 1).alias("b")))))
    runs = hits.select("doc", begin.alias("r")).select("doc", "r.a", "r.b").distinct()
    order = Window.partitionBy("doc").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = runs.withColumn("new", F.coalesce((F.col("a") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("doc", "island").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).select(F.col("doc").alias(doc_id), "span_start", "span_end")


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


def shared_share(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per record: doc_id, n_chars, n_shared (characters in its spans)."""
    got = spans.groupBy(doc_id).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n_shared"))
    return docs.select(doc_id, F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars")).join(got, doc_id, "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
