"""N-Triples and N-Quads, read and written by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrel.operators.line_check import BODY, check_lines
from quadrel.schema import BNODE, IRI, LITERAL


def unescape(text: Column) -> Column:
    r"""Escapes (\t \b \n \r \f \" \' \\ \uXXXX \UXXXXXXXX) as characters; texts without a backslash aren't taken apart."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}(?:\\u[0-9A-Fa-f]{4})*|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), 0)
    wide = lambda t: F.decode(F.unhex(F.regexp_replace(t, r"\\U", "")), "UTF-32")
    short = lambda t: F.decode(F.unhex(F.regexp_replace(t, r"\\u", "")), "UTF-16BE")
    one = lambda t: F.translate(F.substring(t, 2, 1), "tbnrf", "\t\b\n\r\f")
    done = F.transform(parts, lambda t: F.when(t.startswith("\\U"), wide(t)).when(t.startswith("\\u"), short(t)).when(t.startswith("\\"), one(t)).otherwise(t))
    return F.when(text.contains("\\"), F.array_join(done, "")).otherwise(text)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for ch, to in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(ch), F.lit(to))
    return out


def _resource(term: Column, anon: Column) -> Column:
    return F.when(term.startswith("<"), unescape(F.substr(term, F.lit(2), F.length(term) - 2))).otherwise(F.concat(anon, F.substr(term, F.lit(3))))


def parse(lines: DataFrame, raw: str = "value", quads: bool = False, graph: str = "user", anon_prefix: str = "_:genid") -> DataFrame:
    """Quads of the good lines and, for every line, its errors: s, p, o, o_kind, o_dt, o_lang, g, errors, is_statement. Blank nodes get
    ``anon_prefix``; quads without a fourth term go to ``graph``. Other columns of ``lines`` stay unless they have these names."""
    taken = {"s", "p", "o", "g", "o_kind", "o_dt", "o_lang", "errors", "is_statement"}
    rows = lines.drop(*(taken - {raw})).withColumnRenamed(raw, "_raw")
    c, anon = check_lines(rows, "_raw", F.lit(quads), values=False), F.lit(anon_prefix)
    text = unescape(F.regexp_extract("o", rf'(?s)^"({BODY})"', 1))
    lang = F.regexp_extract("o", rf'(?s)^"{BODY}"@(.*)\z', 1)
    dt = F.regexp_extract("o", rf'(?s)^"{BODY}"\^\^<(.*)>\z', 1)
    literal = F.col("o").startswith('"')
    cols = {
        "s": _resource(F.col("s"), anon), "p": _resource(F.col("p"), anon), "o": F.when(literal, text).otherwise(_resource(F.col("o"), anon)),
        "o_kind": F.when(literal, LITERAL).when(F.col("o").startswith("<"), IRI).when(F.col("o").isNotNull(), BNODE).cast("tinyint"),
        "o_dt": F.when(literal & (dt != ""), unescape(dt)), "o_lang": F.when(literal & (lang != ""), F.lower(lang)),
        "g": F.when(F.col("is_statement"), F.coalesce(_resource(F.col("g"), anon), F.lit(graph))),
    }
    return c.select(*[x for x in c.columns if x not in (*cols, "_raw")], *[v.alias(k) for k, v in cols.items()])


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their numbers: path, line INT (from 1), value. A large file is read in blocks by many tasks: the lines of each block are
    counted, and a block's first number is the sum over the blocks before it; of blocks there is one row each."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("path", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("_shift"))
    return rows.join(starts, ["path", "block"]).select("path", (F.col("_at") + F.col("_shift")).cast("int").alias("line"), "value")


def read(spark: SparkSession, path: str, quads: bool | None = None, graph: str = "user", anon_prefix: str = "_:genid", on_error: str = "warning") -> tuple[DataFrame, DataFrame]:
    """The statements of text files (gzip too) with their lines, and the faulty lines (raw line, line and reason). ``quads`` follows the extension if not
    given. With on_error ``error`` a faulty line ends the read with a ValueError."""
    if quads is None:
        quads = path.removesuffix(".gz").endswith((".nq", ".nquads"))
    parsed = parse(numbered(spark, path).withColumn("raw_line", F.col("value")), "value", quads, graph, anon_prefix)
    faults = parsed.where(F.size("errors") > 0).select("raw_line", "line", F.col("errors")[0].alias("reason"))
    if on_error == "error" and (bad := faults.take(1)):
        raise ValueError(f"{bad[0]['reason']}: {bad[0]['raw_line']}")
    return parsed.where("is_statement").select("s", "p", "o", "o_kind", "o_dt", "o_lang", "g", "line"), faults


def format_lines(rows: DataFrame, quads: bool = False) -> DataFrame:
    """One line per statement, column ``value``."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    quoted = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("@"), F.col("o_lang")), F.lit("")), F.when(F.col("o_lang").isNull() & F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), F.col("o_dt"), F.lit(">"))).otherwise(F.lit("")))
    obj = F.when(F.col("o_kind") == LITERAL, quoted).otherwise(node("o"))
    parts = [node("s"), node("p"), obj, *([F.when(F.col("g") != "default", node("g"))] if quads else []), F.lit(".")]
    return rows.select(F.concat_ws(" ", *parts).alias("value"))


def write(rows: DataFrame, path: str, quads: bool = False) -> None:
    format_lines(rows, quads).write.mode("overwrite").text(path)
