"""A store kept in a folder: a Parquet snapshot and journals per graph, replayed when attached."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.schema import QUADS, visible
from quadrel.storage import create_new, delete, exists, rename
from quadrel.store import ROW, Store


def save_db(quads: DataFrame, path: str, graph: str | None = None) -> None:
    """The visible statements (of one graph) as Parquet, sorted by (p, s) within files."""
    rows = visible(quads).select(*ROW)
    (rows if graph is None else rows.where(F.col("g") == graph)).sortWithinPartitions("p", "s").write.mode("overwrite").parquet(path)


def load_db(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("born", F.lit(1).cast("bigint")).withColumn("died", F.lit(None).cast("bigint")).select(*[c.strip().split()[0] for c in QUADS.split(",")])


class Persistent:
    """Attached to a store: every commit appends its net changes to the journal, one Parquet batch a commit, partitioned by graph;
    ``flush`` merges journals into the snapshot. The lock file keeps a second process out."""

    def __init__(self, store: Store, path: str, access: str = "read-write", silent: tuple[str, ...] = ()) -> None:
        self.store, self.path, self.silent = store, path.rstrip("/"), set(silent)
        self.lock = f"{self.path}/lock"
        if access == "read-write":
            if not create_new(store.spark, self.lock, f"{os.getpid()} {time.time()}"):
                raise PermissionError(f"{self.path} is in use")
        base = self._base()
        journal = self._journal()
        if base is not None or journal is not None:
            store.insert(restore(store.spark, base, journal))
        self.batch = 0
        if access == "read-write":
            store.monitor(self._append)

    def _base(self) -> DataFrame | None:
        return load_db(self.store.spark, f"{self.path}/base") if exists(self.store.spark, f"{self.path}/base") else None

    def _journal(self) -> DataFrame | None:
        return self.store.spark.read.parquet(f"{self.path}/journal") if exists(self.store.spark, f"{self.path}/journal") else None

    def _append(self, events: DataFrame) -> None:
        kept = events.where(~F.col("g").isin(sorted(self.silent))) if self.silent else events
        self.batch += 1
        kept.withColumn("logged_at", F.current_timestamp()).withColumn("batch", F.lit(time.time_ns())).write.mode("append").parquet(f"{self.path}/journal")

    def persistency(self, g: str, on: bool) -> None:
        (self.silent.discard if on else self.silent.add)(g)

    def flush(self) -> None:
        """Merges all journals into a new snapshot."""
        save_db(self.store.quads.where(~F.col("g").isin(sorted(self.silent))) if self.silent else self.store.quads, f"{self.path}/base-new")
        spark = self.store.spark
        delete(spark, f"{self.path}/base")
        rename(spark, f"{self.path}/base-new", f"{self.path}/base")
        delete(spark, f"{self.path}/journal")

    def properties(self) -> dict:
        return {"directory": self.path, "silent": sorted(self.silent), "journal": self._journal() is not None, "snapshot": self._base() is not None}

    def files_of(self, g: str) -> dict[str, str]:
        return {"snapshot": f"{self.path}/base", "journal": f"{self.path}/journal", "graph": g}

    def detach(self) -> None:
        self.store.monitors = [(c, m) for c, m in self.store.monitors if c != self._append]
        delete(self.store.spark, self.lock)


def restore(spark: SparkSession, base: DataFrame | None, journal: DataFrame | None) -> DataFrame:
    """The statements after a snapshot and its journal: per statement the last event counts, as a max over (batch, step) that is combined
    before the shuffle. An update counts as the retract of the old and the assert of the new statement."""
    parts = []
    if base is not None:
        parts.append(base.select(*ROW, F.lit(0).cast("bigint").alias("batch"), F.lit(0).alias("step"), F.lit(True).alias("there")))
    if journal is not None:
        parts.append(journal.select(*ROW, "batch", "step", (F.col("event") == "assert").alias("there")))
        place = {"subject": "s", "predicate": "p", "object": "o", "graph": "g"}
        upd = journal.where("event = 'update'")
        cols = [F.coalesce(*[F.when(F.col("field") == f, F.col("new_value")) for f, c2 in place.items() if c2 == c], F.col(c)).alias(c) if c in place.values() else F.col(c) for c in ROW]
        parts.append(upd.select(*cols, "batch", (F.col("step") + 1).alias("step"), F.lit(True).alias("there")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(*ROW).agg(F.max(F.struct("batch", "step", "there")).alias("l")).where("l.there").select(*ROW)
