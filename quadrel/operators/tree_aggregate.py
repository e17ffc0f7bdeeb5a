"""Counts per key that no single task has to carry, whatever share of the rows a key holds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tree_statistics(df: DataFrame, fields: Mapping[str, Column], measures: Mapping[str, Column], leaves: int = 512, fan_in: int = 8) -> DataFrame:
    """Per field and key: ``n_rows`` and, for each measure, the exact number of its distinct non-null values.

    Multi-level tree aggregation. Each row gives a (field, key, measure, value) state; equal states are combined
    where they are read and then spread by all four columns, so a hot key is divided among all tasks by its values.
    Distinct states are counted in ``leaves`` chunks a key, and the chunks' counts are merged ``fan_in`` at a time in
    logarithmically many rounds, so no reducer gets all partials of a key.

    A null key is a key of its own, with ``key_value`` null; null values count as rows, not as distinct values. Rows
    repeated count each time in ``n_rows``. An empty table gives no rows. Other columns of ``df`` don't matter,
    whatever their names. Columns out: field_name, key_value, n_rows, n_<measure>...
    """
    names = list(measures)
    states = df.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), k.cast("string").alias("key_value")) for f, k in fields.items()])).alias("_k"),
        F.array(*[F.struct(F.lit(i).cast("tinyint").alias("measure"), measures[m].cast("string").alias("value")) for i, m in enumerate(names)]).alias("_m"),
    ).select("_k.field_name", "_k.key_value", F.explode("_m").alias("_m"))
    states = states.groupBy("field_name", "key_value", F.col("_m.measure").alias("measure"), F.col("_m.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    width = leaves
    level = states.groupBy("field_name", "key_value", F.pmod(F.xxhash64("value"), F.lit(width)).alias("chunk")).agg(
        F.sum(F.when(F.col("measure") == 0, F.col("n"))).alias("n_rows"),
        *[F.count(F.when(F.col("measure") == i, F.col("value"))).alias(f"n_{m}") for i, m in enumerate(names)],
    )
    while width > 1:
        width = -(-width // fan_in)
        by = ["field_name", "key_value"] + ([F.floor(F.col("chunk") / fan_in).alias("chunk")] if width > 1 else [])
        level = level.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), *[F.sum(f"n_{m}").alias(f"n_{m}") for m in names])
    return level.select("field_name", "key_value", "n_rows", *[f"n_{m}" for m in names])


def heavy_keys(stats: DataFrame, share: float, total: int) -> DataFrame:
    """The rows of ``tree_statistics`` whose non-null key holds at least ``share`` of the ``total`` rows of the table."""
    return stats.where(F.col("key_value").isNotNull() & (F.col("n_rows") >= share * total))
