"""Turtle and TriG written from quads: one text per subject, put together by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions.literals import canonical_text
from quadrel.functions.prefixes import Prefixes
from quadrel.operators.compare import coloured
from quadrel.schema import LITERAL, RDF, TRIPLE, XSD, visible
from quadrel.sources.ntriples import escape
from quadrel.storage import ship


def _node(c: Column, prefixes: Prefixes) -> Column:
    out = F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    for prefix, ns in reversed(prefixes.items()):
        local = F.substr(c, F.lit(len(ns) + 1))
        out = F.when(c.startswith(ns) & local.rlike(r"^([A-Za-z_][A-Za-z0-9_\-]*)?\z"), F.concat(F.lit(prefix + ":"), local)).otherwise(out)
    return out


def _object(prefixes: Prefixes, abbreviate: bool, canonize: bool = False) -> Column:
    o, dt = canonical_text(F.col("o"), F.col("o_dt")) if canonize else F.col("o"), F.col("o_dt")
    full = F.concat(F.lit('"'), escape(o), F.lit('"'), F.coalesce(F.concat(F.lit("@"), F.col("o_lang")), F.when(dt.isNotNull() & (dt != XSD + "string"), F.concat(F.lit("^^"), _node(dt, prefixes))), F.lit("")))
    short = (
        ((dt == XSD + "integer") & o.rlike(r"^[+-]?[0-9]+\z")) | ((dt == XSD + "decimal") & o.rlike(r"^[+-]?[0-9]*\.[0-9]+\z"))
        | ((dt == XSD + "double") & o.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]+\z")) | ((dt == XSD + "boolean") & o.isin("true", "false"))
    )
    literal = F.when(F.coalesce(short, F.lit(False)), o).otherwise(full) if abbreviate else full
    return F.when(F.col("o_kind") == LITERAL, literal).otherwise(_node(o, prefixes))


def _coloured_quads(rows: DataFrame) -> DataFrame:
    """Blank nodes named by what surrounds them in all graphs together: a statement's graph takes part as a piece of its predicate."""
    mark = "\u0001"
    named = coloured(rows.withColumn("p", F.concat(F.coalesce("g", F.lit("default")), F.lit(mark), F.col("p"))))
    return named.select("s", F.element_at(F.split("p", mark), 2).alias("p"), *TRIPLE[2:], F.element_at(F.split("p", mark), 1).alias("g"))


def subjects(quads: DataFrame, prefixes: Prefixes | None = None, canonical: bool = False, abbreviate: bool = True, a: bool = True, indent: int = 8, by_graph: bool = False,
             group: bool = True, single_line: bool = False, canonize_numbers: bool = False, base: str | None = None) -> DataFrame:
    """A text per subject (and graph): statements grouped by predicate and sorted, rdf:type first. Canonical texts name blank nodes by
    what surrounds them, so equal graphs (or sets of graphs) give equal texts. A subject's statements are in one text, as the format has it.

    ``group`` off gives a statement a line; ``single_line`` keeps a subject on one line; ``canonize_numbers`` writes integers and booleans in their
    canonical form; IRIs under ``base`` are written relative to it (``header`` tells it)."""
    prefixes = prefixes or Prefixes()
    rows = visible(quads)
    if canonical:
        rows = _coloured_quads(rows) if by_graph else coloured(rows)
    rows = rows.select(*TRIPLE, *(["g"] if by_graph else [])).distinct()
    node = lambda c: _node(c, prefixes) if base is None else F.when(c.startswith(base), F.concat(F.lit("<"), F.substr(c, F.lit(len(base) + 1)), F.lit(">"))).otherwise(_node(c, prefixes))
    verb = F.when(F.lit(a) & (F.col("p") == RDF + "type"), F.lit("a")).otherwise(node(F.col("p")))
    obj = F.when(F.col("o_kind") == LITERAL, _object(prefixes, abbreviate, canonize_numbers)).otherwise(node(F.col("o")))
    rows = rows.withColumn("verb", verb).withColumn("obj", obj).withColumn("first", F.when(F.col("p") == RDF + "type", 0).otherwise(1))
    keys = ["g", "s"] if by_graph else ["s"]
    per = rows.groupBy(*keys, "first", "p", "verb").agg(F.sort_array(F.collect_list("obj")).alias("objs"))
    pair = lambda text: F.struct("first", "p", F.concat_ws(" ", "verb", text).alias("t"))
    start = F.concat(node(F.col("s")), F.lit(" "))
    if not group:
        per = per.select(*keys, "first", "p", "verb", F.explode("objs").alias("obj"))
        lines = F.transform(F.sort_array(F.collect_list(pair(F.col("obj")))), lambda x: F.concat(node(F.col("s")), F.lit(" "), x["t"], F.lit(" .\n")))
        return per.groupBy(*keys).agg(lines.alias("lines")).select(*keys, F.array_join("lines", "").alias("value"))
    between = " ; " if single_line else " ;\n" + " " * indent
    body = F.array_join(F.transform(F.sort_array(F.collect_list(pair(F.array_join("objs", ", ")))), lambda x: x["t"]), between)
    return per.groupBy(*keys).agg(body.alias("body")).select(*keys, F.concat(start, "body", F.lit(" .\n")).alias("value"))


def header(prefixes: Prefixes, base: str | None = None, comment: str | None = None) -> str:
    """What stands before the statements: a comment, the base and the prefixes."""
    said = "".join(f"# {line}\n" for line in (comment or "").splitlines()) + (f"@base <{base}> .\n" if base else "")
    return said + "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in sorted(prefixes.known.items()))


def document(quads: DataFrame, prefixes: Prefixes | None = None, trig: bool = False, comment: str | None = None, **options) -> str:
    """One document as a text, for graphs that fit the driver: sorted IRIs, then blank nodes."""
    prefixes = prefixes or Prefixes()
    rows = subjects(quads, prefixes, by_graph=trig, **options)
    order = [F.col("s").startswith("_:"), "s"]
    parts, last = [header(prefixes, options.get("base"), comment)], None
    for r in rows.orderBy(*(["g"] if trig else []), *order).toLocalIterator():
        if trig and r["g"] != last:
            parts.append(("}\n" if last is not None and last != "default" else "") + ("" if r["g"] == "default" else f"<{r['g']}> {{\n"))
            last = r["g"]
        parts.append(r["value"])
    return "\n".join(parts) + ("}\n" if trig and last not in (None, "default") else "")


def write(quads: DataFrame, path: str, prefixes: Prefixes | None = None, comment: str | None = None, **options) -> None:
    """A folder of Turtle files, each with all prefixes: subjects are range-partitioned, texts are made where they are."""
    prefixes = prefixes or Prefixes()
    ship(quads.sparkSession)
    head = header(prefixes, options.get("base"), comment)
    rows = subjects(quads, prefixes, **options).repartitionByRange("s").sortWithinPartitions("s").select("value")

    def with_head(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        yield from batches

    rows.mapInArrow(with_head, "value string").write.mode("overwrite").text(path)
