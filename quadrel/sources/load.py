"""Loading files into a store: format by name or content type, conditional loads, a cache of parsed files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.schema import TRIPLE
from quadrel.sources import ntriples, persist, rdfa, rdfxml, turtle
from quadrel.storage import exists, modified
from quadrel.store import Store

# File extensions and content types of the formats.
EXTENSIONS = {"nt": "ntriples", "ntriples": "ntriples", "nq": "nquads", "nquads": "nquads", "ttl": "turtle", "n3": "turtle", "trig": "trig", "rdf": "xml", "rdfs": "xml", "owl": "xml", "htm": "rdfa", "html": "rdfa", "xhtml": "rdfa", "svg": "rdfa", "trp": "quick", "parquet": "quick"}
CONTENT_TYPES = {"application/n-triples": "ntriples", "application/n-quads": "nquads", "text/turtle": "turtle", "application/x-turtle": "turtle", "application/turtle": "turtle", "application/trig": "trig", "application/rdf+xml": "xml", "text/rdf+xml": "xml", "text/xml": "xml", "text/html": "rdfa", "application/xhtml+xml": "rdfa"}


#: Hook for sources that Spark can't open by itself: scheme -> function of (session, path) that gives the path of a local copy or a frame of statements.
OPENERS: dict[str, Callable[[SparkSession, str], str | DataFrame]] = {}


def format_of(path: str, content_type: str | None = None) -> str:
    if content_type and (found := CONTENT_TYPES.get(content_type.split(";")[0].strip().lower())):
        return found
    ext = path.removesuffix(".gz").rstrip("/").rpartition(".")[2].lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"unknown format of {path}")
    return EXTENSIONS[ext]


def read(spark: SparkSession, path: str, format: str | None = None, base: str | None = None, graph: str | None = None, on_error: str = "warning", anon_prefix: str = "_:genid") -> DataFrame:  # noqa: A002
    """Statements of a file, folder or pattern; the default graph is the source."""
    graph = graph or path
    opener = OPENERS.get(path.partition(":")[0]) if ":" in path else None
    if opener is not None:
        found = opener(spark, path)
        if isinstance(found, DataFrame):
            return found.select(*TRIPLE, "g", "line")
        path = found
    kind = format or format_of(path)
    if kind in ("ntriples", "nquads"):
        return ntriples.read(spark, path, kind == "nquads", graph, anon_prefix, on_error)[0]
    if kind in ("turtle", "trig"):
        rows = turtle.read(spark, path, base, graph, on_error)
    elif kind == "xml":
        rows = rdfxml.read(spark, path, base, graph)
    elif kind == "rdfa":
        docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        rows = rdfa.parse_documents(docs, base, graph)
    elif kind == "quick":
        return persist.load_db(spark, path).select(*TRIPLE, "g", "line")
    else:
        raise ValueError(f"unknown format {kind!r}")
    return rows.where("error is null").select(*TRIPLE, "g", "line")


def stamp(path: str) -> str | None:
    """The time of change; null for sources that are opened by a hook."""
    return None if path.partition(":")[0] in OPENERS else modified(SparkSession.active(), path)


def load(store: Store, paths: str | list[str], graph: str | None = None, if_: str = "changed", multifile: bool = False, cache: str | None = None, **options) -> list[str]:
    """Loads sources, each into its graph (by default named as the source), and tells which were loaded. ``if_``: true - always, changed - if the source
    is newer than what is there, not_loaded. A source loaded again replaces its graph unless ``multifile``. ``cache`` is a folder of
    parsed files, used while a source is unchanged. One frame holds all statements of a source, so files are read in parallel."""
    done = []
    for path in [paths] if isinstance(paths, str) else paths:
        g, modified = graph or path, stamp(path)
        known = store.state.graphs.get(g, {})
        if if_ == "not_loaded" and known.get("source") == path:
            continue
        if if_ == "changed" and known.get("source") == path and known.get("source_last_modified") == modified:
            continue
        rows = read(store.spark, path, graph=g, **options)
        if cache:
            kept = cache_file(cache, path)
            if not exists(store.spark, f"{kept}/_SUCCESS"):
                rows.write.mode("overwrite").parquet(kept)
            rows = store.spark.read.parquet(kept)
        store.load(rows, g, path, modified, multifile)
        done.append(path)
    return done


def cache_file(folder: str, path: str) -> str:
    """Where the parsed form of a source is kept: named by the source and its time of change."""
    return f"{folder}/{hashlib.md5(f'{path}|{stamp(path)}'.encode()).hexdigest()}.parquet"


def make(store: Store) -> list[str]:
    """Loads again what has changed."""
    return [p for g, s in store.sources().items() for p in load(store, s, g)]


def unload(store: Store, source: str) -> None:
    for g, s in store.sources().items():
        if s == source:
            store.unload_graph(g)
