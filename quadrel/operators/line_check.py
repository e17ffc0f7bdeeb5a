"""Rows that fail to parse: lines of N-Triples and N-Quads divided into statements and faults with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions import lexical
from quadrel.skew import lookup_join
from quadrel.storage import materialize

XSD = "http://www.w3.org/2001/XMLSchema#"
# The grammar of a line.
END = r"(?=[ \t]|\.?[ \t]*(?:#.*)?\z)"
ESCAPE = r"""\\(?:[tbnrf"'\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"""
BODY = rf"""(?:[^"\\]|{ESCAPE})*+"""
LITERAL = rf"""\"{BODY}\"(?:@[^ \t"<>]*?|\^\^<[^"]*?>)?{END}"""
IRI = rf"<.*?>{END}"
BNODE = rf"_:[^ \t<>\"]+?{END}"
STOP = r"\.[ \t\r]*(?:#.*)?\z"
TOKEN = rf"(?s){LITERAL}|{IRI}|{BNODE}|{STOP}|#.*\z|[^ \t]+"
BAD_IRI = r"[\x00-\x20\x7f-\x9f<>\"{}|^`\\]"
LANG = r"^[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*\z"


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: projections and filters aren't merged through a generator."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def _literal_fault(term: Column, values: bool) -> Column:
    """Whether a well-quoted literal has a faulty tag, datatype IRI or value."""
    lang = F.regexp_extract(term, rf"(?s)^\"{BODY}\"@(.*)\z", 1)
    dt = F.regexp_extract(term, rf"(?s)^\"{BODY}\"\^\^<(.*)>\z", 1)
    text = F.regexp_extract(term, rf"(?s)^\"({BODY})\"", 1)
    tagged, typed = term.rlike(rf"(?s)^\"{BODY}\"@"), term.rlike(rf"(?s)^\"{BODY}\"\^\^")
    wrong = (
        F.when(dt == XSD + "integer", ~text.rlike(lexical.INTEGER))
        .when(dt == XSD + "double", ~text.rlike(lexical.DOUBLE))
        .when(dt == XSD + "date", lexical.as_date(text).isNull())
        .when(dt == XSD + "boolean", ~text.isin("true", "false", "1", "0"))
        .otherwise(F.lit(False))
    )
    return F.when(tagged, ~lang.rlike(LANG)).when(typed, dt.rlike(BAD_IRI) | wrong if values else dt.rlike(BAD_IRI)).otherwise(F.lit(False))


def check_lines(lines: DataFrame, raw: str = "raw_line", quads: Column | None = None, values: bool = True) -> DataFrame:
    """``lines`` with nullable text columns s, p, o, g, the array ``errors`` and ``is_statement``.

    Each line is cut into terms as text; rules evaluated as columns give an array of reasons, empty for a good line, in
    the order quoting, columns, value. Null, blank and comment lines are no statements and have no errors. ``quads``
    tells where a fourth term is allowed (default nowhere). Without ``values`` the text of a literal isn't held against its datatype.
    """
    quads = F.coalesce(quads if quads is not None else F.lit(False), F.lit(False))
    line = F.regexp_replace(F.col(raw), r"[\r\n]+\z", "")
    blank = F.col(raw).isNull() | F.col(raw).rlike(r"^[ \t\r\n]*(#|\z)")
    out = _once(lines, "_t", F.when(~blank, F.regexp_extract_all(line, F.lit(TOKEN), 0)))
    is_literal = lambda t: t.rlike(rf"(?s)^{LITERAL}\z")
    is_iri = lambda t: t.rlike(r"(?s)^<.*>\z")
    is_node = lambda t: t.rlike(r"^_:[^ \t<>\"]+\z")
    ended = F.element_at("_t", -1).rlike(r"(?s)^\.[ \t\r]*(#.*)?\z") | (F.element_at("_t", -1).startswith("#") & F.get("_t", F.size("_t") - 2).rlike(r"^\.\z"))
    # Generated rows keep the optimiser from repeating the cutting for every use of the terms.
    cut = F.struct(F.coalesce(ended, F.lit(False)).alias("ended"), F.filter("_t", lambda t: ~(t.rlike(r"(?s)^\.[ \t\r]*(#.*)?\z") | t.startswith("#"))).alias("terms"))
    out = _once(_once(out, "_c", cut).withColumn("_ended", F.col("_c.ended")), "_terms", F.col("_c.terms")).drop("_c")
    s, p, o, g = (F.get("_terms", F.lit(i)) for i in range(4))
    count = F.size("_terms")
    quoting = F.exists("_terms", lambda t: t.contains('"') & ~is_iri(t) & ~is_literal(t))
    columns = ~F.col("_ended") | ~((count == 3) | (quads & (count == 4))) | F.exists("_terms", lambda t: ~t.contains('"') & ~is_iri(t) & ~is_node(t))
    value = (
        F.exists("_terms", lambda t: is_iri(t) & F.substring(t, 2, 1 << 30).substr(F.lit(1), F.length(t) - 2).rlike(BAD_IRI))
        | F.exists("_terms", lambda t: is_literal(t) & _literal_fault(t, values))
        | s.startswith('"') | ~is_iri(p) | F.coalesce(g.startswith('"'), F.lit(False))
    )
    rules = [("quoting", quoting), ("columns", columns), ("value", value)]
    errors = F.when(blank, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])))
    out = _once(out, "errors", errors).withColumn("is_statement", ~blank & (F.size("errors") == 0))
    cols = {n: F.when(F.col("is_statement"), t) for n, t in (("s", s), ("p", p), ("o", o), ("g", g))}
    return out.withColumns(cols).drop("_t", "_ended", "_terms")


def read_loads(lines: DataFrame, loads: DataFrame) -> DataFrame:
    """The lines that are read of every load, checked: load_id, line_no, s, p, o, g, load_graph, anon_prefix, is_statement,
    reason (null unless faulty).

    A load with on_error ``error`` stops at its first faulty line, others (``warning`` or null) read on. Letter case and
    outer blanks of format and on_error don't matter; a load without state is read as N-Triples with warnings. Loads of
    any size are spread: hot loads meet a broadcast of a bounded number of states, and the first fault is a map-side
    combined minimum.
    """
    norm = lambda c: F.lower(F.trim(F.col(c)))
    state = loads.where("load_id is not null").groupBy("load_id").agg(
        F.max(F.struct((norm("nt_format") == "nquads").alias("quads"), F.coalesce(norm("on_error") == "error", F.lit(False)).alias("strict"), F.col("graph").alias("load_graph"), "anon_prefix")).alias("_s")
    ).select("load_id", "_s.*")
    joined = lookup_join(lines.select("load_id", "line_no", "raw_line"), state, "load_id")
    checked = check_lines(joined, "raw_line", F.col("quads")).withColumn("reason", F.get("errors", F.lit(0)))
    parsed = materialize(checked.select("load_id", "line_no", "s", "p", "o", "g", "load_graph", "anon_prefix", "is_statement", "reason", F.coalesce("strict", F.lit(False)).alias("strict")))
    first = parsed.where("strict and reason is not null").groupBy("load_id").agg(F.min("line_no").alias("_stop"))
    return lookup_join(parsed, first, "load_id").where("_stop is null or line_no <= _stop").drop("_stop", "strict")


def error_counts(read: DataFrame, loads: DataFrame) -> DataFrame:
    """Per load the right error_count (n_errors), the recorded one, and the numbers of statements loaded."""
    counts = read.groupBy("load_id").agg(F.count("reason").alias("n_errors"), F.count(F.when(F.col("is_statement"), 1)).alias("n_statements"))
    return loads.select("load_id", F.col("error_count").alias("recorded")).join(counts, "load_id", "left").select(
        "load_id", "recorded", F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.coalesce("n_statements", F.lit(0)).alias("n_statements"))
