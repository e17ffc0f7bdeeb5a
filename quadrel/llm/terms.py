"""Frequency of every distinct term and n-gram by suffix-sorted counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.skew import counted_hot
from quadrel.storage import ship


#: Occurrences of a term that a salt gets at least; bounds the record sets of its n-grams.
SALT_ROWS = 100_000


def _stack(max_n: int):
    """Counts of all prefixes of reverse-lexicographically sorted suffixes: a level of the stack per prefix of the current
    suffix, with its count and its records; a level is given out when the next suffix doesn't share it. Equal suffixes are sorted by record, so the
    records of a single term are counted as they change; only prefixes of longer suffixes need the set of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []
        levels: list[list] = []  # occurrences, records where no set is kept, last record, set
        out: list[tuple[list[str], int, int]] = []

        def pop_to(depth: int) -> None:
            while len(path) > depth:
                n, changes, _, records = levels.pop()
                out.append((path.copy(), n, changes if records is None else len(records)))
                path.pop()
                if path:
                    above = levels[-1]
                    above[0] += n
                    if len(above[3]) < len(records):
                        above[3], records = records, above[3]
                    above[3] |= records

        def given() -> pa.RecordBatch:
            grams, n, r = (list(x) for x in zip(*out)) if out else ([], [], [])
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.list_(pa.string())), pa.array(n, pa.int64()), pa.array(r, pa.int64())], ["gram", "n", "records"])

        for batch in batches:
            for suffix, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                same = 0
                for a, b in zip(path, suffix):
                    if a != b:
                        break
                    same += 1
                pop_to(same)
                for term in suffix[same:]:
                    path.append(term)
                    levels.append([0, 0, None, None if max_n == 1 else set()])
                top = levels[-1]
                top[0] += 1
                if top[3] is not None:
                    top[3].add(record)
                elif record != top[2]:
                    top[1], top[2] = top[1] + 1, record
            if len(out) > 20_000:
                yield given()
        pop_to(0)
        yield given()

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_stack`` for suffixes of one term, where the stack has one level: it is given out when the term changes. Batch-wise."""
    held: list = []  # the level: term, occurrences, records, last record
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        terms, records = batch.column(0).flatten(), batch.column(1)
        new, other = np.ones(rows, bool), np.ones(rows, bool)
        new[0] = not held or terms[0].as_py() != held[0]
        other[0] = new[0] or records[0].as_py() != held[3]
        if rows > 1:
            new[1:] = pc.not_equal(terms.slice(1), terms.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            other[1:] = new[1:] | pc.not_equal(records.slice(1), records.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        edges = np.concatenate(([0], starts, [rows]))
        n, r = np.diff(edges), np.add.reduceat(np.append(other, False).astype(np.int64), edges[:-1]) * (np.diff(edges) > 0)
        # The part before the first start belongs to the level held; the last level is held on.
        out_terms = [held[0]] if held and len(starts) else []
        out_n, out_r = ([held[1] + n[0]], [held[2] + r[0]]) if out_terms else ([], [])
        if len(starts):
            inner = terms.take(pa.array(starts[:-1]))
            grams = pa.concat_arrays([pa.array(out_terms, pa.string()), inner.cast(pa.string())])
            yield pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array(np.arange(len(grams) + 1, dtype=np.int32)), grams), pa.array(np.concatenate((out_n, n[1:-1])).astype(np.int64)),
                pa.array(np.concatenate((out_r, r[1:-1])).astype(np.int64))], ["gram", "n", "records"])
            held = [terms[int(starts[-1])].as_py(), int(n[-1]), int(r[-1]), records[rows - 1].as_py()]
        else:
            held = [held[0], held[1] + int(n.sum()), held[2] + int(r.sum()), records[rows - 1].as_py()]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([[held[0]]], pa.list_(pa.string())), pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int64())], ["gram", "n", "records"])


def gram_counts(occurrences: DataFrame, record: str, position: str, term: str, max_n: int = 1, order: str | None = None) -> DataFrame:
    """``gram`` (array of 1 to ``max_n`` terms), ``n`` occurrences and ``records`` holding it, of every distinct n-gram.

    An occurrence is a distinct (record, position, term); rows with a null term or record don't count, a null position is a
    position of its own. Where several terms stand at one place each counts as a term, and n-grams go on with the one that is
    greatest by ``order`` (then by text). Every occurrence starts a suffix of up to ``max_n`` terms, built by equi-joins
    on (record, position + 1), so a long record is spread too.

    Suffixes are routed by their first term, and those of a hot term by a salt of the record too, as many as it has
    ``SALT_ROWS`` occurrences; sorted reverse-lexicographically and by record within the task, and
    counted with a stack of prefixes. A salt has all suffixes of its records, so the record sets of two salts are disjoint and
    the counts of a term's salts add up. At most as many terms as there are shuffle partitions can hold more than a task's fair
    share, so the list of hot terms that goes to all tasks is bounded by that. Ties can't matter; empty in, empty out.
    """
    spark = occurrences.sparkSession
    ship(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = occurrences.where(F.col(term).isNotNull() & F.col(record).isNotNull())
    at = rows.select(F.col(record).alias("r"), F.col(position).alias("p"), F.col(term).alias("t"), (F.col(order) if order else F.lit(0)).alias("o"))
    suffixes = at.select("r", "p", "t").distinct().select("r", "p", F.array("t").alias("s"))
    if max_n > 1:
        follow = at.groupBy("r", "p").agg(F.max(F.struct("o", "t"))["t"].alias("next"))
        for k in range(1, max_n):
            step = follow.select("r", (F.col("p") - k).alias("p"), F.col("next"))
            suffixes = suffixes.join(step, ["r", "p"], "left").select("r", "p", F.when(F.col("next").isNotNull() & (F.size("s") == k), F.concat("s", F.array("next"))).otherwise(F.col("s")).alias("s"))
    hot = counted_hot(at.groupBy("t").agg(F.count(F.lit(1)).alias("c")), "t", "c", SALT_ROWS)
    route = [F.element_at("s", 1)]
    if hot:
        salts = F.broadcast(spark.createDataFrame([(t, int(-(-c // SALT_ROWS))) for t, c in hot], "_term string, _salts int"))
        suffixes = suffixes.join(salts, F.element_at("s", 1) == F.col("_term"), "left")
        route.append(F.pmod(F.xxhash64("r"), F.coalesce("_salts", F.lit(1))))
    routed = suffixes.select("s", "r", *[r.alias(f"_r{i}") for i, r in enumerate(route)]).repartition(tasks, *[f"_r{i}" for i in range(len(route))]).select("s", "r")
    parts = routed.sortWithinPartitions(F.desc("s"), "r").mapInArrow(_single if max_n == 1 else _stack(max_n), "gram array<string>, n bigint, records bigint")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))


def marked(counts: DataFrame, total_records: int, rare_below: int = 3, common_above: float = 0.08) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than that share of
    ``total_records``, else null; a gram that is both is ``rare``."""
    return counts.withColumn("mark", F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * total_records, "common"))
