"""Duplicates hidden by formatting: canonical records, range-partitioned, sorted and scanned for runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.storage import materialize, release, ship

_SCAN = "part int, id bigint, head bigint, in_first boolean, first_key string, last_key string, last_head bigint, one_run boolean"


def canonical_lang(lang: Column) -> Column:
    """Lower case, ``_`` as ``-``; null as empty."""
    return F.coalesce(F.replace(F.lower(lang), F.lit("_"), F.lit("-")), F.lit(""))


def canonical_text(text: Column) -> Column:
    """The runs of letters and digits of the lower-cased text. A text holding ``;`` or ``|`` is divided into fields by them:
    fields without letters or digits fall away, the others are sorted, and the form differs from that of all other texts."""
    runs = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}\p{N}]+", " "))
    fields = F.array_sort(F.filter(F.transform(F.split(text, r"[;|]"), runs), lambda x: x != ""))
    return F.when(text.rlike("[;|]"), F.concat(F.lit("fields\u0001"), F.array_join(fields, "\u0001"))).otherwise(F.concat(F.lit("plain\u0001"), runs(text)))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent runs of equal keys in a sorted partition: each row with the first id of its run; at the end a row with the
    partition's outer keys, by which runs that go on in the next partition are joined up."""
    part = TaskContext.get().partitionId()
    first_key = last_key = last_head = None
    runs = 0
    names = [f.split()[0] for f in _SCAN.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys, ids = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        if runs == 0:
            first_key = keys[0].as_py()
        new = np.ones(n, bool)
        new[0] = runs == 0 or keys[0].as_py() != last_key
        if n > 1:
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        head = np.where(at >= 0, ids[np.maximum(at, 0)], -1 if last_head is None else last_head)
        number = runs + np.cumsum(new)
        runs, last_key, last_head = int(number[-1]), keys[n - 1].as_py(), int(head[-1])
        none = lambda t: pa.nulls(n, t)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(ids), pa.array(head), pa.array(number == 1), none(pa.string()), none(pa.string()), none(pa.int64()), none(pa.bool_())], names)
    if runs:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([part, None, None, None, first_key, last_key, last_head, runs == 1], types)], names)


def copies(records: DataFrame, key: str, record_id: str) -> DataFrame:
    """``keep_id`` of every record: the smallest id among the records with an equal key; columns keep_id, id.

    Records are range-partitioned by (key, id), so a key that holds a third of all rows is cut into many partitions, and
    sorted there (Spark's sort is external and spills). A scan compares full keys of neighbours. Each partition tells its
    outer keys in one row; from these rows - as many as partitions - a run that began in an earlier partition gets its head.

    Rows with a null key or id are left out; a repeated id is given once per row; empty in, empty out.
    """
    ship(records.sparkSession)
    # Written first: the range partitioning reads its rows twice, once for a sample of bounds.
    rows = materialize(records.where(F.col(key).isNotNull() & F.col(record_id).isNotNull()).select(F.col(key).alias("key"), F.col(record_id).cast("bigint").alias("id")))
    ranged = rows.repartitionByRange(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "id").sortWithinPartitions("key", "id")
    scanned = materialize(ranged.mapInArrow(_scan, _SCAN))
    release(rows)
    order = Window.partitionBy(F.lit(0)).orderBy("part")  # one row a partition
    goes_on = F.coalesce(F.col("first_key") == F.lag("last_key").over(order), F.lit(False))
    bounds = scanned.where("id is null").withColumn("goes_on", goes_on)
    bounds = bounds.withColumn("base", F.when(~(F.col("one_run") & F.col("goes_on")), F.col("last_head")))
    carried = bounds.withColumn("carry", F.last("base", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("goes_on").select("part", F.lit(True).alias("in_first"), "carry")
    return scanned.where("id is not null").select("part", "in_first", "id", "head").join(F.broadcast(carried), ["part", "in_first"], "left").select(F.coalesce("carry", "head").alias("keep_id"), "id")


def copy_counts(kept: DataFrame) -> DataFrame:
    """One row per set of copies: keep_id, n_copies (all its records, the kept one included)."""
    return kept.groupBy("keep_id").agg(F.count(F.lit(1)).alias("n_copies"))
