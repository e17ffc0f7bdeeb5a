"""Further queries of the store: literals and constraints, schema, administration, formats and streams; each with its SQL beside it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions import literals as lit
from quadrel.functions import terms
from quadrel.functions.prefixes import Prefixes, portray
from quadrel.functions.text import lang_equal
from quadrel.operators import closure, compare, lists, patterns, rdfs, statistics
from quadrel.operators.patterns import Literal, Match
from quadrel.operators.ranking import ranked
from quadrel.operators.text_index import LiteralIndex, Q
from quadrel.plans.mapping import EX, INVERSES, VOC, kept, kept_index, line_lists, region_bags, star, stored, table, with_schema
from quadrel.plans.store_oracles import _F, _LEAST, _LITS, _S, _STAR, _T, _TOK, _TX, _V, _W, _X, _CLS, _VALUES
from quadrel.schema import IRI, LITERAL, RDF, RDFS, TRIPLE, XSD, quads_frame, visible
from quadrel.sources import load as loading
from quadrel.sources import ntriples, persist, rdfa, results, turtle, turtle_write
from quadrel.storage import materialize, shared_dir
from quadrel.store import Store
from quadrel.streaming import changes

LABEL, TYPE = RDFS + "label", RDF + "type"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# -- literals and constraints -----------------------------------------------------------------------------------

_TEXT = f"o_kind = 2 AND coalesce(o_dt, '{XSD}string') = '{XSD}string'"


@query(f"{_W} {_T} o = '1' AND o_kind = 2 AND o_dt IS NULL AND o_lang IS NULL")
def lit_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals without type and language."""
    return patterns.triples(kept(spark, sf_dir), o=Match("plain", "1"))


@query(f"{_W} {_T} o = '1' AND o_kind = 2 AND coalesce(o_dt, '{XSD}string') = '{XSD}string' AND o_lang IS NULL")
def lit_untyped_is_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal without type is found as a string, and the other way round."""
    return patterns.triples(kept(spark, sf_dir), o=Literal("1", XSD + "string"))


@query(f"{_W} {_T} o_kind = 2")
def lit_empty_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty text is in every literal."""
    return patterns.triples(kept(spark, sf_dir), o=Match("substring", ""))


@query("SELECT lit_id, lang FROM rdf11 WHERE lower(lang) = 'en-gb'")
def lang_equal_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals whose tag is that of British English in any letter case."""
    return table(spark, sf_dir, "rdf11").where(lang_equal(F.col("lang"), F.lit("EN-gb"))).select("lit_id", "lang")


@query(" UNION ALL ".join([f"{_W} SELECT 'prefix' AS how, s, o FROM t WHERE {_TEXT} AND starts_with({_F}, 'b')", f"SELECT 'substring', s, o FROM t WHERE {_TEXT} AND contains({_F}, 'mor')",
                           f"SELECT 'word', s, o FROM t WHERE {_TEXT} AND regexp_matches({_F}, '(^|[^\\p{{L}}\\p{{N}}])near($|[^\\p{{L}}\\p{{N}}])')", f"SELECT 'like', s, o FROM t WHERE {_TEXT} AND {_F} LIKE 'ward:%kind%'", f"SELECT 'icase', s, o FROM t WHERE {_TEXT} AND {_F} = 'n/a'"]))
def constraint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text constraints behind a pattern: prefix, substring, word, like, icase."""
    found = patterns.triples(stored(spark, sf_dir))
    return _union([found.where(patterns.where(how, text)).select(F.lit(how).alias("how"), "s", "o") for how, text in (("prefix", "B"), ("substring", "mör"), ("word", "near"), ("like", "ward:*kind*"), ("icase", "N/A"))])


@query(" UNION ALL ".join(f"{_W if i == 0 else ''} SELECT '{place}' AS place, s, p, o FROM t WHERE p = '{VOC}storeys' AND {_V} < 3" for i, place in enumerate(("before", "inside", "after"))))
def constraint_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint before, inside and behind its pattern gives the same."""
    q = stored(spark, sf_dir)
    got = {
        "before": patterns.triples(q.where(patterns.where("<", 3)), p=VOC + "storeys"), "inside": patterns.triples(q, p=VOC + "storeys", o=Match("lt", 3)),
        "after": patterns.triples(q, p=VOC + "storeys").where(patterns.where("<", 3)),
    }
    return _union([f.select(F.lit(place).alias("place"), "s", "p", "o") for place, f in got.items()])


@query("SELECT 'nope' AS op, 'unknown constraint ''nope''' AS fault")
def constraint_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constraint that isn't known is refused."""
    try:
        patterns.where("nope", 1)
    except ValueError as e:
        return _values(spark, [("nope", str(e))], "op string, fault string")
    return _values(spark, [], "op string, fault string")


_BIG = "CASE WHEN line % 3 = 0 THEN '-' WHEN line % 3 = 1 THEN '+' ELSE '' END || CASE WHEN line % 2 = 0 THEN '00' ELSE '' END || line || repeat('0', 40) || (stmt_id % 97)"
_DIGITS = "CASE WHEN ltrim(ltrim(o, '+-'), '0') = '' THEN '0' ELSE ltrim(ltrim(o, '+-'), '0') END"


@query(f"""WITH b AS (SELECT DISTINCT {_BIG} AS o FROM rdf WHERE line IS NOT NULL), k AS (SELECT o, starts_with(o, '-') AS neg, {_DIGITS} AS d FROM b)
SELECT o, row_number() OVER (ORDER BY NOT neg, CASE WHEN neg THEN -length(d) ELSE length(d) END, CASE WHEN neg THEN translate(d, '0123456789', '9876543210') ELSE d END, upper(o), o) AS rank FROM k""")
def order_big_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of more than forty digits, made of the lines, in their order."""
    line, sid = F.col("line"), F.col("stmt_id")
    text = F.concat(F.when(line % 3 == 0, "-").when(line % 3 == 1, "+").otherwise(""), F.when(line % 2 == 0, "00").otherwise(""), line.cast("string"), F.repeat(F.lit("0"), F.lit(40)), (sid % 97).cast("string"))
    rows = table(spark, sf_dir, "rdf").where("line is not null").select(text.alias("o")).distinct()
    found = rows.select("o", F.lit(LITERAL).cast("tinyint").alias("o_kind"), F.lit(XSD + "integer").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    return ranked(found, lit.order_key()).select("o", "rank")


_S_KIND = "CASE WHEN starts_with(s, '_:') THEN 1 ELSE 0 END"


@query(f"""{_W} SELECT s, o, o_kind, o_dt, o_lang, CASE WHEN o_kind = 2 THEN 1 WHEN o_kind = 1 AND {_S_KIND} = 0 THEN 1 WHEN o_kind = 0 AND {_S_KIND} = 1 THEN -1
  WHEN s = o THEN 0 WHEN (upper(strip_accents(lower(s))), s) < (upper({_F}), o) THEN -1 ELSE 1 END AS sign FROM (SELECT DISTINCT s, o, o_kind, o_dt, o_lang FROM t)""")
def compare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each subject stands to each of its objects in the order of terms: literals, blank nodes, IRIs."""
    found = patterns.triples(stored(spark, sf_dir)).select("s", *TRIPLE[2:]).distinct()
    none = F.lit(None).cast("string")
    both = found.withColumns({"s_kind": F.when(F.col("s").startswith("_:"), 1).otherwise(0), "s_dt": none, "s_lang": none})
    return both.select("s", "o", "o_kind", "o_dt", "o_lang", lit.compare_terms("s", "o").alias("sign"))


@query(f"{_W} SELECT o_kind IN (0, 1) AS is_resource, o_kind = 2 AS is_literal, count(*) AS n FROM (SELECT DISTINCT o, o_kind, o_dt, o_lang FROM live) GROUP BY 1, 2")
def old_term_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distinct objects are resources and how many are literals."""
    found = patterns.enumerate_terms(stored(spark, sf_dir), "object")
    return found.groupBy(terms.is_resource(F.col("kind")).alias("is_resource"), terms.is_literal(F.col("kind")).alias("is_literal")).agg(F.count(F.lit(1)).alias("n"))


# -- patterns, closure, schema ----------------------------------------------------------------------------------


@query(f"{_X} SELECT {_LEAST.format('s')} AS s, {_LEAST.format('s')} AS o, 0 AS d")
def reach_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a predicate that isn't there a node reaches itself only."""
    q = with_schema(spark, sf_dir)
    least = visible(q).where((F.col("p") == VOC + "broader") & (F.col("o_kind") == IRI)).agg(F.min("s")).collect()[0][0]
    return closure.reachable(q, least, VOC + "nowhere").select("s", "o", "d")


@query(f"{_W} {_S} p = '{LABEL}'")
def partitioned_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern over statements written by predicate and subject, of which it reads the files that can match."""
    path = _folder(spark, "by-predicate")
    Store(spark, stored(spark, sf_dir)).partition_by_predicate(path, 8)
    return patterns.statements(spark.read.parquet(path), p=LABEL)


@query(f"""{_X}, up AS (SELECT s AS sub, o AS super FROM x WHERE p = '{RDFS}subPropertyOf' AND o_kind = 0 UNION SELECT u.sub, x.o FROM up u JOIN x ON x.p = '{RDFS}subPropertyOf' AND x.s = u.super)
SELECT s, p, o, o_kind, o_dt, o_lang, p AS real_p FROM x UNION SELECT x.s, up.super, x.o, o_kind, o_dt, o_lang, x.p FROM x JOIN up ON up.sub = x.p""")
def has_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triple under its predicate and all above it."""
    return closure.has_all(with_schema(spark, sf_dir)).select(*TRIPLE, "real_p")


@query(f"WITH {_STAR} SELECT s AS customer FROM st WHERE p = '{EX}segment' AND s NOT IN (SELECT a.o FROM st a JOIN st b ON b.s = a.s WHERE a.p = '{EX}placedBy' AND b.p = '{EX}priority' AND b.o = '1-URGENT')")
def bgp_not_exists_urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    q = star(spark, sf_dir)
    placed = patterns.resources(patterns.bind(patterns.triples(q, p=EX + "placedBy"), s="order", o="customer"), "customer")
    urgent = patterns.bind(patterns.triples(q, p=EX + "priority", o=Literal("1-URGENT")), s="order")
    return patterns.absent(patterns.bind(patterns.triples(q, p=EX + "segment"), s="customer"), patterns.exists(placed, urgent).select("customer"))


_DOMAINS = {
    "class": (("class", VOC + "Structure"), f"r IN (SELECT sub FROM sub WHERE super = '{VOC}Structure')"),
    "union_of": (("union_of", ("all_values_from", VOC + "Bridge"), ("all_values_from", VOC + "Mill")), f"r IN (SELECT r FROM ind WHERE c IN ('{VOC}Bridge', '{VOC}Mill'))"),
    "intersection_of": (("intersection_of", ("all_values_from", VOC + "Structure"), ("has_value", TYPE, VOC + "Mill")), f"r IN (SELECT r FROM ind WHERE c = '{VOC}Structure') AND r IN (SELECT s FROM x WHERE p = '{TYPE}' AND o = '{VOC}Mill' AND o_kind <> 2)"),
    "complement_of": (("complement_of", ("all_values_from", VOC + "Thing")), f"r NOT IN (SELECT r FROM ind WHERE c = '{VOC}Thing')"),
    "one_of": (("one_of", VOC + "Bridge", "http://data.example/site/1", "http://data.example/none"), f"r IN ('{VOC}Bridge', 'http://data.example/site/1', 'http://data.example/none')"),
    "all_values_from": (("all_values_from", VOC + "Thing"), f"r IN (SELECT r FROM ind WHERE c = '{VOC}Thing')"),
    "some_values_from": (("some_values_from", VOC + "Thing"), "TRUE"),
    "has_value": (("has_value", RDF + "type", VOC + "Bridge"), f"r IN (SELECT s FROM x WHERE p = '{TYPE}' AND o = '{VOC}Bridge' AND o_kind <> 2)"),
}


@query(f"{_X}, {_CLS}, ind AS (SELECT x.s AS r, sub.super AS c FROM x JOIN sub ON sub.sub = x.o WHERE x.p = '{TYPE}'), rs AS (SELECT DISTINCT s AS r FROM x) " + " UNION ALL ".join(f"SELECT '{n}' AS domain, r FROM rs WHERE {c}" for n, (_, c) in _DOMAINS.items()))
def domain_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects within each kind of domain description."""
    q = materialize(with_schema(spark, sf_dir))
    rows = materialize(visible(q).select(F.col("s").alias("r")).distinct())
    return _union([rdfs.in_domain(q, rows, d).select(F.lit(name).alias("domain"), "r") for name, (d, _) in _DOMAINS.items()])


@query(f"{_W} SELECT s AS r, '{RDFS}Resource' AS c FROM live UNION SELECT o, '{RDFS}Resource' FROM live WHERE o_kind <> 2 UNION SELECT o, '{RDFS}Literal' FROM live WHERE o_kind = 2")
def individual_of_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything is a Resource, or as a literal a Literal."""
    q = stored(spark, sf_dir)
    return rdfs.individual_of(q, RDFS + "Resource").unionByName(rdfs.individual_of(q, RDFS + "Literal"))


@query(f"""{_X}, l AS (SELECT s AS r, o AS label, o_lang, CASE WHEN p = '{LABEL}' THEN 0 ELSE 1 END AS rank FROM x WHERE p IN ('{LABEL}', '{VOC}altLabel') AND o_kind = 2
 UNION ALL SELECT DISTINCT s, CASE WHEN regexp_extract(s, '#([^#]*)$', 1) <> '' THEN regexp_extract(s, '#([^#]*)$', 1) WHEN regexp_extract(s, '/([^/]*)$', 1) <> '' THEN regexp_extract(s, '/([^/]*)$', 1) ELSE s END, NULL, 2
 FROM x WHERE s NOT IN (SELECT s FROM x WHERE p IN ('{LABEL}', '{VOC}altLabel') AND o_kind = 2))
SELECT r, label FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY rank, o_lang IS NULL, label) AS k FROM l) WHERE k = 1""")
def best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first label of every resource."""
    return rdfs.best_labels(with_schema(spark, sf_dir))


@query("SELECT l_orderkey AS k, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey), ' ') AS members, count(*) AS length FROM lineitem GROUP BY 1")
def list_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' lists of lines as arrays, made from their cells."""
    key = F.col("l_orderkey").cast("string")
    heads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), terms.create_bnode(key, F.lit(0), start="_:list").alias("list")).distinct()
    found = lists.list_arrays(materialize(line_lists(spark, sf_dir))).join(heads, "list")
    return found.select("k", F.array_join(F.transform("members", lambda m: F.regexp_extract(m, "([0-9]+)$", 1)), " ").alias("members"), F.size("members").cast("bigint").alias("length"))


@query("SELECT 'renamed' AS other, true AS equal UNION ALL SELECT 'one less', false UNION ALL SELECT 'two rings', false")
def graph_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regions' containers against themselves with blank nodes renamed, and with a statement less; a ring of six blank nodes against two rings
    of three, which colours can't tell apart."""
    bags = materialize(region_bags(spark, sf_dir))
    name = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:x"), F.md5(c))).otherwise(F.col(c))
    other = materialize(bags.withColumn("s", name("s")).withColumn("o", name("o")))
    least = bags.where(F.col("p") == RDF + "_1").agg(F.min("s")).collect()[0][0]
    less = bags.where(~((F.col("p") == RDF + "_1") & (F.col("s") == least)))
    ring = lambda n, a: [(f"_:{a}{i}", EX + "next", f"_:{a}{(i + 1) % n}") for i in range(n)]
    six, three = quads_frame(spark, ring(6, "a")), quads_frame(spark, ring(3, "b") + ring(3, "c"))
    pairs = {"renamed": (bags, other), "one less": (bags, less), "two rings": (six, three)}
    return _values(spark, [(n, bool(compare.equal_graphs(a, b)[0])) for n, (a, b) in pairs.items()], "other string, equal boolean")


@query(f"{_W} SELECT DISTINCT p, replace(replace(p, '{VOC}', 'voc:'), '{RDFS}', 'rdfs:') AS short, '''' || p || '''' AS quoted, replace(replace(p, '{VOC}', 'voc:'), '{RDFS}', 'rdfs:') || '=' || upper(p) AS labelled FROM live WHERE starts_with(p, '{VOC}') OR starts_with(p, '{RDFS}')")
def portray_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates as they are shown to people."""
    px, p = Prefixes({"voc": VOC, "rdfs": RDFS}), F.col("p")
    names = patterns.enumerate_terms(stored(spark, sf_dir), "predicate").select(F.col("term").alias("p")).where(p.startswith(VOC) | p.startswith(RDFS))
    return names.select("p", portray(p, px).alias("short"), portray(p, px, "writeq").alias("quoted"), portray(p, px, "prefix:id=label", F.upper(p)).alias("labelled"))


# -- text index -------------------------------------------------------------------------------------------------


@query(f"{_TX} SELECT DISTINCT literal FROM tok WHERE strip_accents(lower(token)) = 'near' EXCEPT SELECT literal FROM tok WHERE strip_accents(lower(token)) = 'ward'")
def text_and_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals with a token and without another."""
    return kept_index(spark, sf_dir).find(Q("and", "near", Q("not", "ward")))


@query(f"{_TX} SELECT DISTINCT literal FROM tok WHERE CASE WHEN regexp_full_match(token, '-?[0-9]+') THEN try_cast(token AS BIGINT) END <= 3")
def text_le(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals with a number of at most three."""
    return kept_index(spark, sf_dir).find(Q("le", 3))


@query(f"{_TX}, gone AS (SELECT literal FROM tok WHERE strip_accents(lower(token)) = 'near') SELECT count(DISTINCT token) AS tokens, count(DISTINCT literal) AS literals, count(*) AS postings FROM tok WHERE literal NOT IN (SELECT literal FROM gone)")
def index_administration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of labels to which all other literals are added and from which those with a token are taken away."""
    q = stored(spark, sf_dir)
    index = LiteralIndex(q.where(F.col("p") == LABEL)).add(q)
    return index.remove(materialize(index.find("near"))).statistics()


@query(f"{_W}, {_LITS.replace('o_kind = 2', 'o_kind = 2 AND o_lang IS NULL')} SELECT token, count(*) AS n FROM (SELECT DISTINCT o, unnest(string_split(lower(o), ' ')) AS token FROM lits) WHERE token <> '' GROUP BY 1")
def index_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of an index with its own way of cutting texts, from which literals with a language are left out."""
    cut = lambda text: F.array_distinct(F.filter(F.split(F.lower(text), " ", -1), lambda t: t != ""))
    index = LiteralIndex(stored(spark, sf_dir), cut, lambda rows: F.col("o_lang").isNotNull())
    return index.frame.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# -- administration ---------------------------------------------------------------------------------------------


@query(f"{_W} SELECT g, count(*) AS triples FROM live GROUP BY g UNION ALL SELECT '{EX}empty', 0")
def graphs_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All graphs, a created one without statements too."""
    store = Store(spark, stored(spark, sf_dir))
    store.create_graph(EX + "empty")
    return store.graphs()


@query("SELECT 1 AS depth, 'outer' AS names UNION ALL SELECT 2, 'inner outer' UNION ALL SELECT 0, ''")
def active_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the open transactions, innermost first."""
    store, seen = Store(spark), []
    note = lambda: seen.append((len(store.stack), " ".join(store.active_transactions())))
    with store.transaction("outer"):
        note()
        with store.transaction("inner"):
            note()
    note()
    return _values(spark, seen, "depth int, names string")


@query(f"""{_W}, n AS (SELECT greatest(max(born), coalesce(max(died), 0)) AS g FROM q) SELECT 'start' AS step, g AS generation FROM n UNION ALL SELECT 'inside', g FROM n
UNION ALL SELECT 'nested', g FROM n UNION ALL SELECT 'committed', g + 1 FROM n UNION ALL SELECT 'failed', g + 1 FROM n UNION ALL SELECT 'nothing changed', g + 1 FROM n""")
def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generation goes up by one with each outermost commit that changes something."""
    store, seen = Store(spark, stored(spark, sf_dir)), []
    note = lambda step: seen.append((step, store.generation[0] if store.stack else store.generation))
    note("start")
    with store.transaction():
        store.insert([(EX + "a", EX + "b", EX + "c")])
        note("inside")
        with store.transaction():
            store.insert([(EX + "a", EX + "b", EX + "d")])
            note("nested")
    note("committed")
    try:
        with store.transaction():
            store.insert([(EX + "a", EX + "b", EX + "e")])
            raise KeyError("given up")
    except KeyError:
        note("failed")
    with store.transaction():
        pass
    note("nothing changed")
    return _values(spark, seen, "step string, generation bigint")


@query(f"""{_W} SELECT 'snapshot' AS seen, p, count(*) AS n FROM live GROUP BY p UNION ALL SELECT 'now', p, count(*) FROM live WHERE p <> '{VOC}linksTo' GROUP BY p""")
def snapshot_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements per predicate in a transaction on an earlier snapshot, and now."""
    store = Store(spark, stored(spark, sf_dir))
    earlier = store.snapshot()
    store.retract(p=VOC + "linksTo")
    with store.transaction(snapshot=earlier):
        then = statistics.by_predicate(store.quads).select(F.lit("snapshot").alias("seen"), "p", F.col("triples").alias("n"))
    return then.unionByName(statistics.by_predicate(store.quads).select(F.lit("now").alias("seen"), "p", F.col("triples").alias("n")))


@query(f"{_W} SELECT 'kept' AS step, (SELECT count(*) FROM q) AS n UNION ALL SELECT 'compacted', (SELECT count(*) FROM live) UNION ALL SELECT 'reset', 0")
def compact_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows a store holds, with its history, after compaction, and after a reset."""
    store, seen = Store(spark, stored(spark, sf_dir)), []
    for step, do in (("kept", lambda: None), ("compacted", store.compact), ("reset", store.reset)):
        do()
        seen.append((step, store.state.quads.count()))
    return _values(spark, seen, "step string, n bigint")


@query(f"""{_W}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang, line FROM live WHERE p = '{LABEL}'))
SELECT 'loaded' AS step, n AS triples, false AS modified, 'file:labels' AS source FROM n UNION ALL SELECT 'changed', n + 1, true, 'file:labels' FROM n UNION ALL SELECT 'loaded again', n, false, 'file:labels' FROM n UNION ALL SELECT 'unloaded', 0, false, NULL""")
def graph_administration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of a graph of all labels: loaded, changed, loaded again, unloaded."""
    rows = materialize(patterns.statements(stored(spark, sf_dir), p=LABEL).drop("g"))
    store, seen, g = Store(spark), [], EX + "labels"

    def note(step: str) -> None:
        d = store.graph_properties(g)
        seen.append((step, d["triples"], d["modified"], d["source"]))

    store.load(rows, g, "file:labels", "1")
    note("loaded")
    store.insert([(EX + "a", EX + "b", EX + "c", g)])
    note("changed")
    store.load(rows, g, "file:labels", "1")
    note("loaded again")
    store.unload_graph(g)
    note("unloaded")
    return _values(spark, seen, "step string, triples bigint, modified boolean, source string")


@query(f"""{_W}, l AS (SELECT * FROM t WHERE p = '{VOC}linksTo'), f AS (SELECT count(*) / count(DISTINCT s) AS sf, count(*) / count(DISTINCT (o, o_kind, o_dt, o_lang)) AS of FROM l), n AS (SELECT count(*) AS n FROM live WHERE p = '{VOC}linksTo')
SELECT 'symmetric' AS step, true AS symmetric, '{VOC}linksTo' AS inverse_of, n AS triples, sf AS subject_branch_factor, of AS object_branch_factor FROM f, n
UNION ALL SELECT 'inverse', false, '{VOC}linkedFrom', n, sf, of FROM f, n UNION ALL SELECT 'none', false, NULL, n, sf, of FROM f, n""")
def predicate_administration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of a predicate made symmetric, given an inverse, and freed of it."""
    store, seen, p = Store(spark, materialize(stored(spark, sf_dir))), [], VOC + "linksTo"
    for step, change in (("symmetric", {"symmetric": True}), ("inverse", {"inverse_of": VOC + "linkedFrom"}), ("none", {"inverse_of": ""})):
        store.set_predicate(p, **change)
        d = store.predicate_properties(p)
        seen.append((step, d["symmetric"], d["inverse_of"], d["triples"], d["rdf_subject_branch_factor"], d["rdf_object_branch_factor"]))
    return _values(spark, seen, "step string, symmetric boolean, inverse_of string, triples bigint, subject_branch_factor double, object_branch_factor double")


@query("SELECT 'p' AS index, 2 AS n UNION ALL SELECT 'sp', 1 UNION ALL SELECT 'pg', 1 UNION ALL SELECT '-', 1")
def lookup_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often patterns were asked for, by the places bound."""
    store = Store(spark, stored(spark, sf_dir))
    store.triples(p=TYPE), store.triples(p=LABEL), store.triples(s=EX + "a", p=TYPE), store.statements(p=TYPE, g=EX + "g"), store.triples()
    return store.lookup_counts()


@query(f"{_W} SELECT 'opened' AS hook, (SELECT count(*) FROM t WHERE p = '{VOC}code')::VARCHAR AS result UNION ALL SELECT 'graph property', 'http://example.org/opened!' UNION ALL SELECT 'in', 'point(1 2)^^http://example.org/point' UNION ALL SELECT 'out', '(1, 2)'")
def extension_hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks for opening sources, for properties of graphs, and for literals of a type of one's own, in and out."""
    g, point = EX + "opened", EX + "point"
    rows = patterns.triples(stored(spark, sf_dir), p=VOC + "code").withColumns({"g": F.lit(g), "line": F.lit(None).cast("int")})
    loading.OPENERS["memory"] = lambda session, path: rows
    lit.IN_GROUND_TYPE.append(lambda value, type_: (f"point({value[0]} {value[1]})", point, None) if isinstance(value, tuple) and type_ is None else None)
    lit.OUT_TYPE[point] = lambda text: tuple(int(x) for x in text[6:-1].split())
    try:
        store = Store(spark)
        store.graph_hooks["shout"] = lambda s, name: name + "!"
        loading.load(store, "memory:codes", g, if_="true")
        text, kind, _ = lit.canonical((1, 2))
        seen = [("opened", str(store.triples().count())), ("graph property", store.graph_properties(g)["shout"]), ("in", f"{text}^^{kind}"), ("out", str(lit.host_value(text, kind)))]
    finally:
        loading.OPENERS.clear(), lit.IN_GROUND_TYPE.clear(), lit.OUT_TYPE.clear()
    return _values(spark, seen, "hook string, result string")


# -- formats, loading, persistence ------------------------------------------------------------------------------

@query("SELECT count(*) AS lines, count(*) AS numbers, count(DISTINCT load_id % 5) AS files FROM nt_lines WHERE raw_line IS NOT NULL AND NOT regexp_matches(raw_line, '[\\r\\n]')")
def nt_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines written to a few files and read with their numbers: each number of a file once, from 1 to the number of its lines."""
    path = _folder(spark, "numbered")
    lines = table(spark, sf_dir, "nt_lines").where(F.col("raw_line").isNotNull() & ~F.col("raw_line").rlike(r"[\r\n]"))
    lines.select("raw_line", (F.col("load_id") % 5).alias("part")).repartition("part").write.partitionBy("part").text(path)
    per = ntriples.numbered(spark, path).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("d"), F.max("line").alias("top"), F.min("line").alias("low"))
    right = F.when((F.col("low") == 1) & (F.col("top") == F.col("n")), F.col("d")).otherwise(0)
    return per.agg(F.sum("n").alias("lines"), F.sum(right).alias("numbers"), F.count(F.lit(1)).alias("files"))


def _written(spark: SparkSession, sf_dir: str, **options: str) -> str:
    path = _folder(spark, "statements")
    ntriples.format_lines(patterns.statements(stored(spark, sf_dir)), quads=True).write.options(**options).text(path)
    return path


_BAD = "'[\\x00-\\x20<>\"{}|^`\\\\]'"
_READ_BACK = f"""{_W} SELECT s, p, o, o_kind, g, count(*) AS n FROM live WHERE NOT regexp_matches(s || p || g, {_BAD}) AND (o_kind = 2 OR NOT regexp_matches(o, {_BAD}))
 AND (o_lang IS NULL OR regexp_full_match(o_lang, '[a-z]{{1,8}}(-[a-z0-9]{{1,8}})*')) GROUP BY ALL"""


@query(_READ_BACK)
def nq_gzip_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with their graphs written as compressed N-Quads files and read again."""
    got, _ = ntriples.read(spark, _written(spark, sf_dir, compression="gzip"), quads=True, graph="default", anon_prefix="_:")
    return got.groupBy("s", "p", "o", "o_kind", "g").agg(F.count(F.lit(1)).alias("n"))


@query(_READ_BACK)
def stream_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files read as a stream into a table."""
    path, out = _written(spark, sf_dir), _folder(spark, "streamed")
    rows = changes.read_ntriples(spark, path, True, "default").select("s", "p", "o", "o_kind", "g")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    node = lambda c: F.regexp_replace(c, "^_:genid", "_:")
    got = spark.read.schema("s string, p string, o string, o_kind tinyint, g string").parquet(out)
    return got.select(node("s").alias("s"), "p", F.when(F.col("o_kind") == 2, F.col("o")).otherwise(node("o")).alias("o"), "o_kind", "g").groupBy("s", "p", "o", "o_kind", "g").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT * FROM (VALUES ('text/turtle', 'turtle'), ('application/n-quads; charset=utf-8', 'nquads'), ('APPLICATION/RDF+XML', 'xml'), ('application/trig', 'trig'), ('text/html', 'rdfa'), ('', 'ntriples')) v(content_type, format)""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format told by a content type, or by the name where there is none."""
    given = ["text/turtle", "application/n-quads; charset=utf-8", "APPLICATION/RDF+XML", "application/trig", "text/html", ""]
    return _values(spark, [(t, loading.format_of("data.nt.gz", t or None)) for t in given], "content_type string, format string")


@query(f"""{_W}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang FROM live WHERE p = '{VOC}code'))
SELECT 'first' AS step, 1 AS loaded, n AS triples FROM n UNION ALL SELECT 'unchanged', 0, n FROM n UNION ALL SELECT 'from the cache', 1, n FROM n UNION ALL SELECT 'unloaded', 0, 0""")
def load_front_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of N-Triples loaded into its graph: once, not again while it is unchanged, again from the cache of what was parsed, and unloaded."""
    path, cache = _folder(spark, "codes") + ".nt", _folder(spark, "cache")
    ntriples.write(patterns.triples(stored(spark, sf_dir), p=VOC + "code"), path)
    store, seen = Store(spark), []

    def note(step: str, loaded: list) -> None:
        seen.append((step, len(loaded), store.triples().count()))

    note("first", loading.load(store, path, cache=cache))
    note("unchanged", loading.load(store, path, cache=cache))
    note("from the cache", loading.load(store, path, if_="true", cache=cache))
    loading.unload(store, path)
    note("unloaded", [])
    return _values(spark, seen, "step string, loaded int, triples bigint")


_EDITED = f"SELECT DISTINCT s, CASE WHEN p = '{VOC}altLabel' THEN '{LABEL}' ELSE p END AS p, o, o_kind, o_dt, o_lang, g, line FROM live WHERE p <> '{VOC}linksTo'"


@query(f"{_W} SELECT p, count(*) AS n FROM ({_EDITED}) GROUP BY p")
def journal_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store kept in a folder, changed twice after its snapshot, and restored from snapshot and journal by another."""
    path = _folder(spark, "persistent")
    store = Store(spark)
    keeper = persist.Persistent(store, path)
    store.insert(stored(spark, sf_dir).where("died is null"))
    keeper.flush()
    store.retract(p=VOC + "linksTo")
    store.update("predicate", LABEL, p=VOC + "altLabel")
    keeper.detach()
    other = Store(spark)
    persist.Persistent(other, path, access="read-only")
    return statistics.by_predicate(other.quads).select("p", F.col("triples").alias("n"))


@query(f"""{_W}, l AS (SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang, g, line FROM live), a AS (SELECT * FROM l WHERE p = '{VOC}altLabel'), u AS (SELECT a.* FROM a),
old AS (SELECT count(*) AS n FROM (SELECT DISTINCT o, o_dt, o_lang FROM l WHERE p = '{VOC}partOf' AND o_kind = 2 EXCEPT SELECT o, o_dt, o_lang FROM l WHERE p <> '{VOC}partOf' AND o_kind = 2))
SELECT 'retract' AS event, count(*) AS n FROM l WHERE p = '{VOC}partOf' UNION ALL SELECT 'assert', 1 UNION ALL SELECT 'update', count(*) FROM u UNION ALL SELECT 'new_literal', 1 UNION ALL SELECT 'old_literal', n FROM old WHERE n > 0""")
def monitor_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of a transaction, logged by a monitor of the store and read as a stream: a retract, an assert, an update, and literals that come and go."""
    log, out = _folder(spark, "changes"), _folder(spark, "counted")
    store = Store(spark, stored(spark, sf_dir))
    changes.write_changes(store, log, "retract", "assert", "update", "new_literal", "old_literal")
    with store.transaction("edit"):
        store.retract(p=VOC + "partOf")
        store.insert([(EX + "a", EX + "b", ("never said before", {"type": XSD + "string"}))])
        store.update("predicate", VOC + "otherLabel", p=VOC + "altLabel")
    write = lambda batch, number: batch.write.mode("append").parquet(f"{out}/batch={number}")
    changes.monitor(changes.read_changes(spark, log), write, f"{out}-state").awaitTermination()
    rows = spark.read.parquet(out).drop("batch", "step").distinct()
    return rows.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


_SMALL = f"SELECT c_custkey AS k, '{EX}customer/' || c_custkey AS iri, c_name AS name, cast(round(c_acctbal * 100) AS BIGINT)::VARCHAR AS cents FROM customer"
_SOLUTIONS = f"""WITH c AS ({_SMALL}) SELECT iri AS c, 0 AS c_kind, name, 2 AS name_kind, 'en' AS name_lang, cents AS balance, '{XSD}integer' AS balance_dt FROM c
UNION ALL SELECT '_:b' || k, 1, name, 2, NULL, NULL, NULL FROM c"""


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), F.concat(F.lit(EX + "customer/"), F.col("c_custkey").cast("string")).alias("iri"), F.col("c_name").alias("name"), F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string").alias("cents"))


_COLUMNS = ["c", "c_kind", "name", "name_kind", "name_lang", "balance", "balance_dt"]


@query(_SOLUTIONS)
def json_results_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result documents in JSON, one a customer with two solutions: an IRI, a tagged and a typed literal, and a blank node with a plain one."""
    no = F.lit(None).cast("string")
    term = lambda kind, v, dt=no, lang=no: F.struct(F.lit(kind).alias("type"), v.alias("value"), dt.alias("datatype"), lang.alias("xml:lang"))
    full = F.struct(term("uri", F.col("iri")).alias("c"), term("literal", F.col("name"), lang=F.lit("EN")).alias("name"), term("typed-literal", F.col("cents"), F.lit(XSD + "integer")).alias("balance"))
    plain = F.struct(term("bnode", F.concat(F.lit("b"), "k")).alias("c"), term("literal", F.col("name")).alias("name"), F.lit(None).cast("struct<type:string,value:string,datatype:string,`xml:lang`:string>").alias("balance"))
    docs = _customers(spark, sf_dir).select(F.to_json(F.struct(F.struct(F.array(full, plain).alias("bindings")).alias("results"))).alias("text"))
    return results.read_json(docs, ["c", "name", "balance"]).select(*_COLUMNS)


@query(_SOLUTIONS)
def xml_results_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in XML."""
    bind = lambda name, *inner: F.concat(F.lit(f'<binding name="{name}">'), *inner, F.lit("</binding>"))
    full = F.concat(bind("c", F.lit("<uri>"), "iri", F.lit("</uri>")), bind("name", F.lit('<literal xml:lang="EN">'), "name", F.lit("</literal>")), bind("balance", F.lit(f'<literal datatype="{XSD}integer">'), "cents", F.lit("</literal>")))
    plain = F.concat(bind("c", F.lit("<bnode>b"), "k", F.lit("</bnode>")), bind("name", F.lit("<literal>"), "name", F.lit("</literal>")))
    doc = F.concat(F.lit('<sparql xmlns="http://www.w3.org/2005/sparql-results#"><results><result>'), full, F.lit("</result><result>"), plain, F.lit("</result></results></sparql>"))
    return results.read_xml(_customers(spark, sf_dir).select(doc.alias("text")), ["c", "name", "balance"]).select(*_COLUMNS)


@query(" UNION ALL ".join([f"SELECT '{EX}doc/' || doc_id AS s, '{TYPE}' AS p, '{EX}File' AS o, 0 AS o_kind FROM documents", f"SELECT '{EX}doc/' || doc_id, '{EX}from', '{EX}source/' || source, 0 FROM documents WHERE source IS NOT NULL",
                           *[f"SELECT '{EX}doc/' || doc_id, '{EX}{c}', {c}, 2 FROM documents WHERE {c} IS NOT NULL" for c in ("lang", "text")]]))
def rdfa_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What marked-up pages say of the documents, one page each with its whole text."""
    def safe(c: str):
        out = F.col(c)
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    iri = F.concat(F.lit(EX + "doc/"), F.col("doc_id").cast("string"))
    said = lambda c, tag: F.coalesce(F.concat(F.lit(f'<{tag} property="ex:{c}">'), safe(c), F.lit(f"</{tag}>")), F.lit(""))
    link = F.coalesce(F.concat(F.lit(f'<a rel="ex:from" href="{EX}source/'), F.col("source"), F.lit('">source</a>')), F.lit(""))
    page = F.concat(F.lit(f'<html><body prefix="ex: {EX}"><div typeof="ex:File" resource="'), iri, F.lit('">'), said("lang", "b"), link, said("text", "pre"), F.lit("</div></body></html>"))
    return rdfa.parse_documents(table(spark, sf_dir, "documents").select(iri.alias("path"), page.alias("text"))).select("s", "p", "o", "o_kind")


@query(f"{_W} SELECT DISTINCT s, p, o, o_kind, nullif(o_dt, '{XSD}string') AS o_dt, o_lang, g FROM live WHERE starts_with(g, 'http://data.example/graph/') AND o_kind = 2 AND p IN ('{LABEL}', '{VOC}storeys', '{VOC}listed') AND NOT regexp_matches(s, {_BAD}) AND (o_lang IS NULL OR regexp_full_match(o_lang, '[a-z]+(-[a-z0-9]+)*'))")
def trig_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, numbers and truth values of all named graphs written as TriG, a text per subject and graph, statement by statement and relative to a base, and read again; language tags
    that the format can't hold are faults of their statements."""
    base, px = "http://data.example/", Prefixes({"voc": VOC, "xsd": XSD, "rdfs": RDFS})
    rows = stored(spark, sf_dir).where(F.col("g").startswith(base + "graph/") & (F.col("o_kind") == LITERAL) & F.col("p").isin(LABEL, VOC + "storeys", VOC + "listed") & ~F.col("s").rlike(r'[\x00-\x20<>"{}|^`\\]'))
    texts = turtle_write.subjects(rows, px, by_graph=True, group=False, base=base)
    doc = F.concat(F.lit(turtle_write.header(px, base, "One subject of one graph")), F.lit("<"), F.col("g"), F.lit("> {\n"), F.col("value"), F.lit("}\n"))
    got = turtle.parse_documents(texts.select(F.concat("g", F.lit(" "), "s").alias("path"), doc.alias("text")), on_error="warning")
    return got.where("error is null").select(*TRIPLE[:4], F.when(F.col("o_dt") != XSD + "string", F.col("o_dt")).alias("o_dt"), "o_lang", "g").distinct()
