"""Global ranks without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.storage import materialize


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row (from 1) in a total order: rows are range-partitioned and sorted, numbered within partitions, and
    moved by the sizes of the partitions before, of which there is one number each."""
    keyed = df.select("*", *[c.alias(f"_k{i}") for i, c in enumerate(order)])
    keys = [f"_k{i}" for i in range(len(order))]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(keyed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()).drop(*keys))
    part = F.shiftright("_id", 33).cast("int")
    sizes = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    offset, before = F.lit(0).cast("bigint"), 0
    pairs = []
    for p in sorted(sizes):
        pairs.append((p, before))
        before += sizes[p]
    if pairs:
        offset = F.create_map(*[F.lit(x) for p, b in pairs for x in (p, b)])[part].cast("bigint")
    return rows.withColumn(name, offset + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id")
