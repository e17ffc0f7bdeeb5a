"""Joins against a table with few rows a key where a few keys of the large side hold most of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with fewer rows is never hot: a task reads that many without harm.
MIN_HOT = 200_000


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def counted_hot(counts: DataFrame, key: str, n: str, min_rows: int | None = None) -> list[tuple]:
    """(key, rows) of the hot keys of a frame that has the counts. At most as many keys as there are shuffle partitions can hold more rows than
    a task's fair share, so the largest that many, found by a top-k, leave no hot key out."""
    big = counts.where(F.col(key).isNotNull() & (F.col(n) >= (min_rows or MIN_HOT)))
    return [tuple(r) for r in big.orderBy(F.desc(n), key).select(key, n).limit(_tasks(counts)).collect()]


def hot_keys(df: DataFrame, key: str, min_rows: int | None = None) -> list[tuple]:
    """(key, rows) of the hot keys; counts are combined before the shuffle. ``df`` is run for it, so it should be a written table."""
    return counted_hot(df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")), "k", "n", min_rows)


def lookup_join(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "left", min_rows: int | None = None, hot: list[tuple] | None = None, rows: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key or a few (of several columns the first tells hot keys).

    Rows of a hot key are dealt over as many salts as the key has fair shares of the hot rows, and the key's row in ``right`` is repeated for each salt: at
    most two rows a shuffle partition in all where keys are unique, so no side is broadcast and none grows. What goes to all tasks is the list of hot keys, at most one a
    shuffle partition. Null keys match nothing and are kept by a left join. ``how`` is ``left`` or ``inner``; column names other
    than the key must differ. Hot keys that are known already may be given as ``hot``; ``rows``, the number of rows of ``left``, spares counting
    where it is under the least number of a hot key."""
    keys, least = [key] if isinstance(key, str) else list(key), min_rows or MIN_HOT
    if hot is None:
        hot = [] if rows is not None and rows < least else hot_keys(left, keys[0], least)
    if not hot:
        return left.join(right, keys, how)
    share = max(least, sum(n for _, n in hot) / _tasks(left))
    kind = left.schema[keys[0]].dataType.simpleString()
    salts = F.broadcast(left.sparkSession.createDataFrame([(k, int(-(-n // share))) for k, n in hot], f"`{keys[0]}` {kind}, _salts int"))
    many = F.coalesce("_salts", F.lit(1))
    # The partition's number is added, or rows that repeat in all columns would share one salt.
    place = F.pmod(F.xxhash64(*left.columns) + F.spark_partition_id(), many).cast("int")
    dealt = left.join(salts, keys[0], "left").withColumn("_salt", place).drop("_salts")
    copied = right.join(salts, keys[0], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("_salts")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")
