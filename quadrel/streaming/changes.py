"""Change notification and streaming readers as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.sources.ntriples import parse
from quadrel.sources.turtle import parse_documents
from quadrel.store import Store

EVENTS = "generation bigint, event string, s string, p string, o string, o_kind tinyint, o_dt string, o_lang string, g string, line int, field string, new_value string, step int"


def write_changes(store: Store, path: str, *mask: str) -> None:
    """Every commit of the store appends its net changes to the log at ``path``, in the order retract, assert, update."""
    store.monitor(lambda events: events.select(*[c.split()[0] for c in EVENTS.split(", ")]).orderBy("step").write.mode("append").parquet(path), *mask)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The log as a stream."""
    return spark.readStream.schema(EVENTS).parquet(path)


def monitor(changes: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, events: list[str] | None = None, once: bool = True):
    """Calls ``call(batch, number)`` with each batch of changes, exactly once for each by its number; ``once`` ends when all there is is read."""
    rows = changes if events is None else changes.where(F.col("event").isin(events))
    writer = rows.writeStream.foreachBatch(call).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_counts(changes: DataFrame, time: str, late: str = "10 minutes", width: str = "1 day", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts per window of event time; rows later than ``late`` behind the newest don't count."""
    return changes.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def read_ntriples(spark: SparkSession, path: str, quads: bool = False, graph: str = "user") -> DataFrame:
    """New files of a folder, statement by statement, as a stream."""
    return parse(spark.readStream.text(path), "value", quads, graph).where("is_statement")


def read_turtle(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """New Turtle or TriG files of a folder, as a stream of statements."""
    docs = spark.readStream.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_documents(docs, graph=graph, on_error="warning")
