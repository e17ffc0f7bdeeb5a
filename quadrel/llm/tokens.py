"""Encoding of a corpus with a public byte-level BPE vocabulary, and decoding."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.skew import counted_hot, lookup_join
from quadrel.storage import materialize, ship

#: In words of this many bytes or more a step of the fold joins all places of the lowest pair, in shorter ones the leftmost place: it keeps the ranks of
#: the neighbourhoods, which pays where a word is short, but takes as many steps as there are joins.
LONG_WORD = 64
#: The most frequent words, whose ids are sent to all tasks: at most so many, whatever the corpus, and of at most so many bytes each,
#: so at most 64 MB of words and ids; usually 2 MB. Longer or rarer words are joined, hot ones by salts.
FREQUENT_WORDS, FREQUENT_BYTES = 1 << 16, 256
_BUCKETS = 1 << 14
_STEP = 1 << 20
_NEVER = 2**31 - 1


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Ranks and split pattern; ``path`` is a rank file, by default that of byte_bpe_50k."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, public_tokenizers.PATTERN


def merge_sweeps(word: bytes, ranks: dict[bytes, int], below: int = _NEVER) -> list[bytes]:
    """The pieces of a word after all merges of a rank under ``below``. All places of the lowest pair are joined in one sweep:
    a joined piece ranks above its parts, so no pair made by a join can come before the other places of the same pair."""
    pieces = [word[i : i + 1] for i in range(len(word))]
    while len(pieces) > 1:
        least = min(ranks.get(a + b, _NEVER) for a, b in zip(pieces, pieces[1:]))
        if least >= below:
            break
        out, i = [], 0
        while i < len(pieces):
            if i + 1 < len(pieces) and ranks.get(pieces[i] + pieces[i + 1]) == least:
                out.append(pieces[i] + pieces[i + 1])
                i += 2
            else:
                out.append(pieces[i])
                i += 1
        pieces = out
    return pieces


@lru_cache(maxsize=4)
def _merge_json(path: str | None) -> tuple[str, str]:
    """The ids of the 256 bytes, and the merges: the two ids that are joined -> the id of the piece they give."""
    ranks, _ = vocabulary(path)
    buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    for piece, rank in ranks.items():
        if len(piece) > 1:
            parts = merge_sweeps(piece, ranks, rank)
            if len(parts) == 2:
                key = ranks[parts[0]] * _STEP + ranks[parts[1]]
                buckets[key % _BUCKETS][str(key)] = rank
    return json.dumps([ranks[bytes([i])] for i in range(256)]), json.dumps(buckets, separators=(",", ":"))


def words(text: Column, pattern: str) -> Column:
    """The words that merges never cross, as an array; white space and letters are those of Unicode."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), 0)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_merges(coded: DataFrame, path: str | None = None) -> DataFrame:
    """``coded`` (a column ``word``) with ``ids``: a fold of ranked merges over the bytes of the word. The merges are one literal:
    an array of small maps, as a lookup in a single map would compare all its keys.

    For words under ``LONG_WORD`` bytes a step joins the leftmost neighbours of lowest rank; the state is the ids of the pieces and the ranks
    of their neighbourhoods, of which a step changes two. For longer ones a step joins all places of the lowest pair from left to right: a piece
    that is joined ranks above its parts, so no pair made by a join can come before the other places of the same pair. Both give the same ids."""
    of_bytes, merges = _merge_json(path)
    byte_ids, table = F.from_json(F.lit(of_bytes), "array<bigint>"), F.from_json(F.lit(merges), "array<map<string,int>>").cast("array<map<bigint,int>>")
    latin = F.decode(F.encode("word", "utf-8"), "iso-8859-1")
    start = coded.withColumn("_ids", F.transform(F.split(latin, ""), lambda c: F.get(byte_ids, F.ascii(c))))
    # Bound to a variable, or each of its uses would be a copy in the plan that all tasks read.
    return start.withColumn("ids", _let(table, _fold)).drop("_ids")


def _fold(table: Column) -> Column:
    """The ids of ``word``, whose bytes' ids are ``_ids``."""

    def rank(a: Column, b: Column) -> Column:
        key = a * _STEP + b
        return F.coalesce(F.element_at(F.get(table, (key % _BUCKETS).cast("int")), key), F.lit(_NEVER))

    def ranks_of(ids: Column) -> Column:
        n = F.size(ids)
        return F.zip_with(F.slice(ids, F.lit(1), n - 1), F.slice(ids, F.lit(2), n), rank)

    def join(acc: Column, least: Column, at: Column) -> Column:
        ids, ranks, new = acc["ids"], acc["ranks"], least.cast("bigint")
        before = F.when(at > 1, F.array(rank(F.get(ids, at - 2), new))).otherwise(F.array().cast("array<int>"))
        after = F.when(at < F.size(ranks), F.array(rank(new, F.get(ids, at + 1)))).otherwise(F.array().cast("array<int>"))
        far = F.size(ids)
        return F.struct(
            F.concat(F.slice(ids, F.lit(1), at - 1), F.array(new), F.slice(ids, at + 2, far)).alias("ids"),
            F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(ranks, at + 2, far)).alias("ranks"),
        )

    def step(acc: Column, _: Column) -> Column:
        some = F.size(acc["ranks"]) > 0
        return F.when(some, _let(F.array_min(acc["ranks"]), lambda m: F.when(m == _NEVER, acc).otherwise(_let(F.array_position(acc["ranks"], m).cast("int"), lambda at: join(acc, m, at))))).otherwise(acc)

    def sweep(ids: Column, ranks: Column, least: Column) -> Column:
        # In a row of places that overlap every other one is joined; 1 marks the first piece of a join.
        marks = F.array_join(F.transform(ranks, lambda r: F.when(r == least, "1").otherwise("0")), "")
        chosen = F.split(F.regexp_replace(marks, "11", "10"), "")
        return _let(chosen, lambda at: F.filter(
            F.transform(ids, lambda x, i: F.when(F.get(at, i) == "1", least.cast("bigint")).when((i > 0) & (F.get(at, i - 1) == "1"), F.lit(-1)).otherwise(x)), lambda x: x >= 0))

    def sweep_step(acc: Column, _: Column) -> Column:
        stop = F.struct(acc["ids"].alias("ids"), F.lit(True).alias("over"))
        go = lambda ranks: _let(F.array_min(ranks), lambda m: F.when(m.isNull() | (m == _NEVER), stop).otherwise(F.struct(sweep(acc["ids"], ranks, m).alias("ids"), F.lit(False).alias("over"))))
        return F.when(acc["over"], acc).otherwise(_let(ranks_of(acc["ids"]), go))

    ids, steps = F.col("_ids"), F.array_repeat(F.lit(0), F.size("_ids") - 1)
    as_ints = lambda acc: F.transform(acc["ids"], lambda i: i.cast("int"))
    by_place = F.aggregate(steps, F.struct(ids.alias("ids"), ranks_of(ids).alias("ranks")), step, as_ints)
    by_pair = F.aggregate(steps, F.struct(ids.alias("ids"), F.lit(False).alias("over")), sweep_step, as_ints)
    return F.when(F.octet_length("word") < LONG_WORD, by_place).otherwise(by_pair)


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word."""
    return [ranks[p] for p in merge_sweeps(word, ranks)]


def word_table(corpus_words: DataFrame, path: str | None = None) -> DataFrame:
    """Every distinct word with its number and ids: word, n, ids; ``corpus_words`` has an array ``w`` a row. Words are dealt anew
    after they are counted, so that the tasks of the fold are alike in work and not in bytes."""
    counts = corpus_words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    tasks = 2 * int(corpus_words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fold_merges(counts.repartition(tasks, F.xxhash64("word")), path)


def _assemble(frequent, wide):
    """The ids of texts as bytes (of type ``wide``), the greatest value standing for a word that isn't frequent; and these words in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, offsets, flat = frequent.value
        known = pa.array(known, pa.string())
        sizes = np.diff(offsets)
        for batch in batches:
            lists = batch.column("w")
            start = lists.offsets.to_numpy()
            vals = lists.values.slice(start[0], start[-1] - start[0])
            start = start - start[0]
            at = pc.fill_null(pc.index_in(vals, value_set=known), -1).to_numpy(zero_copy_only=False)
            rare = at < 0
            n = np.where(rare, 1, sizes[np.maximum(at, 0)]) if len(sizes) else np.ones(len(at), np.int64)
            ends = np.concatenate(([0], np.cumsum(n)))
            ids = np.empty(ends[-1], wide)
            if len(sizes):
                src = np.repeat(np.where(rare, 0, offsets[np.maximum(at, 0)]), n) + (np.arange(ends[-1]) - np.repeat(ends[:-1], n))
                ids[:] = flat[np.minimum(src, len(flat) - 1)]
            where = np.flatnonzero(rare)
            doc_rare = np.concatenate(([0], np.cumsum(rare)))[start]
            ids[ends[:-1][where]] = np.iinfo(wide).max
            out = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((ends[start] * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            missing = pa.ListArray.from_arrays(pa.array(doc_rare.astype(np.int32)), vals.take(pa.array(where)))
            names = batch.schema.names[:-1]  # all columns but the words
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), out, missing], [*names, "ids", "rare"])

    return run


def _filled(wide):
    """Texts' ids as lists, each mark replaced by the next list of ``fill``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(wide).itemsize
            data = column.buffers()[2]
            ids = (np.frombuffer(data, wide) if data else np.empty(0, wide))[ends[0] : ends[-1]]
            ends = ends - ends[0]
            mark = ids == np.iinfo(wide).max
            n = np.ones(len(ids), np.int64)
            lists = batch.column("fill").flatten()
            n[mark] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(n)))
            out = np.empty(at[-1], np.int32)
            out[at[:-1][~mark]] = ids[~mark]
            out[np.repeat(mark, n)] = lists.flatten().to_numpy(zero_copy_only=False)
            names = batch.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.ListArray.from_arrays(pa.array(at[ends].astype(np.int32)), pa.array(out))], [*names, "ids"])

    return run


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns ``keep`` and ``ids`` (ints) of every row, without special tokens; a null and an empty text both give an empty list.

    The corpus' distinct words are counted (combined before the shuffle) and each is encoded once, by a fold of ranked merges
    over its bytes in Spark's higher-order functions. The ids of the ``FREQUENT_WORDS`` most frequent words, a fixed bound, go to all
    tasks, which put texts together batch-wise; a word beyond them leaves a mark, and those words meet the word table by a
    join on the word, in which hot words (long ones, as a separator line) are salted. All words are encoded alike; only the way of their ids differs. A text
    with such words gets them back in one row, as many as it has. No row needs another's text, so long texts and hot sources don't matter.

    Repeated rows and repeated or null ``doc_id`` are kept as they are; other columns are ignored and may have any name, those of ``keep`` any
    but doc_id, ids, row, rare, w. Empty in, empty out.
    """
    spark = docs.sparkSession
    ship(spark)
    _, pattern = vocabulary(path)
    kept = [F.col(c) for c in keep]
    texts = docs.select(F.col(doc_id).alias("doc_id"), *kept, words(F.coalesce(F.col(text), F.lit("")), pattern).alias("w"))
    table = materialize(word_table(texts.select("w"), path))
    sent = F.octet_length("word") <= FREQUENT_BYTES
    top = table.where(sent).orderBy(F.desc("n"), "word").limit(FREQUENT_WORDS).select("word", "ids", "n").toArrow()
    lists = top.column("ids").combine_chunks() if top.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    frequent = spark.sparkContext.broadcast((top.column("word").to_pylist(), offsets, lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)))
    types = ", ".join(f"`{c}` {docs.schema[c if c != 'doc_id' else doc_id].dataType.simpleString()}" for c in ("doc_id", *keep))
    wide = np.uint16 if len(vocabulary(path)[0]) < np.iinfo(np.uint16).max else np.uint32
    coded = materialize(texts.withColumn("row", F.monotonically_increasing_id()).select("doc_id", *kept, "row", "w").mapInArrow(_assemble(frequent, wide), f"{types}, row bigint, ids binary, rare array<string>"))
    marks = coded.where(F.size("rare") > 0)
    last = top.column("n")[-1].as_py() if top.num_rows else 0  # words not sent are rarer than all that are, or long
    hot = counted_hot(table.where(~sent | (F.col("n") <= last)), "word", "n")
    found = lookup_join(marks.select("row", F.posexplode("rare").alias("k", "word")), table.select("word", F.col("ids").alias("word_ids")), "word", "inner", hot=hot)
    back = found.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "word_ids"))), lambda x: x["word_ids"]).alias("fill"))
    none = F.array().cast("array<array<int>>").alias("fill")
    whole = coded.where(F.size("rare") == 0).select("doc_id", *kept, "ids", none)
    joined = marks.select("doc_id", *kept, "row", "ids").join(back, "row").select("doc_id", *kept, "ids", "fill")
    return whole.unionByName(joined).mapInArrow(_filled(wide), f"{types}, ids array<int>")


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of a list of ids: their binary pieces are concatenated. Ids that aren't in the vocabulary give nothing."""
    ranks = vocabulary(path)[0]
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex().upper()
    table = F.from_json(F.lit(json.dumps(pieces, separators=(",", ":"))), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "utf-8")
