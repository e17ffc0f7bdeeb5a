"""Tables written in the shared folder: lineage is cut, lost executors cost a re-read only."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_written: dict[int, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="quadrel-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that Arrow and pandas functions find it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quadrel-code-"), "quadrel.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("quadrel", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(path)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back; the caller may ``release`` it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadrel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quadrel_path = path  # noqa: SLF001
    if not _written:
        atexit.register(_release_all, spark)
    _written.setdefault(0, []).append(path)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Frames materialised within are released at the end, but for those handed to the function it gives: ``with scratch() as keep: out = keep(materialize(...))``."""
    before, kept = set(_written.get(0, [])), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(getattr(df, "_quadrel_path", None))
        return df

    spark = None
    try:
        yield keep
    finally:
        for path in [p for p in _written.get(0, []) if p not in before and p not in kept]:
            spark = spark or SparkSession.active()
            _written[0].remove(path)
            _delete(spark, path)


def release(*frames: DataFrame) -> None:
    """Deletes the files of materialised frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_quadrel_path", None)
        if path in _written.get(0, []):
            _written[0].remove(path)
            _delete(df.sparkSession, path)


# -- files, wherever they lie (the shared folder may be on any file system Spark knows) --------------------------


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def modified(spark: SparkSession, path: str) -> str | None:
    """The time of change, null if there is no such file."""
    fs, where = _at(spark, path)
    return str(fs.getFileStatus(where).getModificationTime()) if fs.exists(where) else None


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _at(spark, old)
    if not fs.rename(where, _at(spark, new)[1]):
        raise OSError(f"can't rename {old}")


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file unless it is there; tells whether it did."""
    fs, where = _at(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError:
        if fs.exists(where):
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


delete = _delete


def _release_all(spark: SparkSession) -> None:
    for path in _written.pop(0, []):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
