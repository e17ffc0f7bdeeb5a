"""Queries that show every operator of the store over the tables of a directory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.edit import Editor
from quadrel.functions import literals as lit
from quadrel.functions import terms
from quadrel.functions.prefixes import Prefixes, split_url
from quadrel.functions.text import lang_matches
from quadrel.operators import closure, graph_digest, lists, patterns, rdfs, statistics, text_index
from quadrel.operators.patterns import Literal, Match
from quadrel.operators.ranking import ranked
from quadrel.operators.text_index import Q
from quadrel.plans.mapping import EX, INVERSES, VOC, as_lists, kept, kept_index, line_lists, line_members, region_bags, star, stored, table, with_schema
from quadrel.schema import LITERAL, RDF, RDFS, TRIPLE, XSD, visible
from quadrel.sources import library, ntriples, persist, rdfa, rdfxml, results, turtle, turtle_write
from quadrel.storage import materialize, scratch, shared_dir
from quadrel.store import Store
from quadrel.streaming import changes

LABEL, TYPE = RDFS + "label", RDF + "type"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _define(name: str, doc: str, build) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(spark, sf_dir)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run


# -- patterns ---------------------------------------------------------------------------------------------------

for _name, _args in {
    "rdf_p": {"p": LABEL}, "rdf_po": {"p": TYPE, "o": VOC + "Bridge"}, "rdf_o": {"o": VOC + "Mill"}, "rdf_spo_literal": {"p": VOC + "storeys", "o": Literal(5)}, "rdf_same_var": {"same": "so"},
    "rdf3_dedup": {"p": VOC + "broader"}, "lit_plain_string": {"o": Literal("true", XSD + "boolean")},
    "lit_icase": {"o": Match("icase", "N/A")}, "lit_substring": {"o": Match("substring", "mör")}, "lit_word": {"o": Match("word", "near")}, "lit_prefix": {"o": Match("prefix", "BÖ")}, "lit_like": {"o": Match("like", "ward:*kind*")},
    "lit_lt": {"o": Match("lt", 3)}, "lit_le": {"o": Match("le", 3)}, "lit_eq": {"o": Match("eq", 7)}, "lit_ge": {"o": Match("ge", 100)}, "lit_gt": {"o": Match("gt", 100.5)}, "lit_between": {"o": Match("between", 5, 6.5)},
    "lit_text_ge": {"o": Match("ge", "zu", lang="nl")}, "lang_matches_basic": {"o": Match("lang", "en")}, "lang_matches_wild": {"o": Match("lang", "*-gb")}, "lit_typed": {"p": VOC + "lat", "o": Match("type", XSD + "double")},
}.items():
    _define(_name, f"Distinct triples of the pattern {_args}.", lambda spark, d, a=_args: patterns.triples(kept(spark, d), **a))

for _name, _args in {"rdf4_nodedup": {"p": VOC + "broader"}, "rdf_g": {"g": "http://data.example/graph/catalog"}, "rdf_pg": {"p": LABEL, "g": "http://data.example/graph/registry"}}.items():
    _define(_name, f"Statements of the pattern {_args}.", lambda spark, d, a=_args: patterns.statements(kept(spark, d), **a))


@query
def rdf_sp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of one subject by one predicate."""
    return patterns.triples(stored(spark, sf_dir), "http://data.example/site/1", TYPE)


@query
def rdf_sg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a graph says of a subject."""
    return patterns.statements(stored(spark, sf_dir), s="http://data.example/site/1", g="http://data.example/graph/catalog")


@query
def source_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places where subjects are described."""
    return patterns.source_location(stored(spark, sf_dir))


@query
def estimate_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a pattern meets."""
    return patterns.estimate(stored(spark, sf_dir), p=TYPE)


@query
def constraint_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals with a prefix in a language range; constraints stand outside the pattern."""
    found = patterns.triples(stored(spark, sf_dir), p=LABEL)
    return found.where(patterns.where("lang_matches", "en")).where(F.lower("o").startswith("b"))


@query
def constraint_typed_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of one type only."""
    return patterns.triples(stored(spark, sf_dir)).where(patterns.where("==", 2, type=XSD + "integer"))


# -- joins of patterns ------------------------------------------------------------------------------------------


def _named(quads: DataFrame, p: str, **names: str) -> DataFrame:
    return patterns.bind(patterns.triples(quads, p=EX + p), **names)


@query
def bgp_customers_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers whose nation is in ASIA: a chain of three patterns."""
    q = star(spark, sf_dir)
    region = patterns.bind(patterns.triples(q, p=EX + "name", o=Literal("ASIA", XSD + "string")), s="region")
    nation = patterns.resources(_named(q, "inRegion", s="nation", o="region"), "region")
    customer = patterns.resources(_named(q, "inNation", s="customer", o="nation"), "nation").where(F.col("customer").startswith(EX + "customer/"))
    return patterns.conjunction(customer, nation, region).select("customer", "nation")


@query
def bgp_star_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that share a subject: status, priority and customer of each order."""
    q = star(spark, sf_dir)
    got = patterns.conjunction(_named(q, "placedBy", s="order", o="customer"), _named(q, "status", s="order", o="status"), _named(q, "priority", s="order", o="priority"))
    return got.select("order", "customer", "status", "priority")


@query
def bgp_theta_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different nations of one region."""
    q = star(spark, sf_dir)
    return patterns.conjunction(_named(q, "inRegion", s="a", o="region"), _named(q, "inRegion", s="b", o="region")).where("a <> b").select("a", "b")


@query
def bgp_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders, where they have any."""
    q = star(spark, sf_dir)
    orders = patterns.resources(_named(q, "placedBy", s="order", o="customer"), "customer")
    return patterns.optional(_named(q, "segment", s="customer", o="segment").select("customer", "segment"), orders).select("customer", "segment", "order")


@query
def bgp_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without orders."""
    q = star(spark, sf_dir)
    return patterns.absent(_named(q, "segment", s="customer"), patterns.resources(_named(q, "placedBy", o="customer"), "customer"))


@query
def bgp_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders."""
    q = star(spark, sf_dir)
    return patterns.exists(_named(q, "segment", s="customer"), patterns.resources(_named(q, "placedBy", o="customer"), "customer"))


@query
def bgp_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are urgent or finished."""
    q = star(spark, sf_dir)
    return patterns.either(patterns.bind(patterns.triples(q, p=EX + "priority", o=Literal("1-URGENT")), s="order"), patterns.bind(patterns.triples(q, p=EX + "status", o=Literal("F")), s="order"))


# -- entailment -------------------------------------------------------------------------------------------------


@query
def has_subproperty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is within what, by any property under it."""
    return closure.has(with_schema(spark, sf_dir), p=VOC + "within")


@query
def has_realpred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the property that holds, inverses too."""
    return closure.has(with_schema(spark, sf_dir), p=VOC + "within", inverses=INVERSES, real=True)


@query
def has_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrower, also where only broader is said."""
    return closure.has(with_schema(spark, sf_dir), p=VOC + "narrower", inverses=INVERSES).select("s", "o")


@query
def has_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in both directions."""
    return closure.has(with_schema(spark, sf_dir), p=VOC + "linksTo", inverses={VOC + "linksTo": VOC + "linksTo"}).select("s", "o")


@query
def subproperty_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties under properties, each under itself."""
    return rdfs.subproperty_of(with_schema(spark, sf_dir))


def _least(spark: SparkSession, sf_dir: str, column: str) -> str:
    rows = visible(stored(spark, sf_dir)).where((F.col("p") == VOC + "broader") & (F.col("o_kind") == 0))
    return rows.agg(F.min(column)).collect()[0][0]


@query
def reach_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything above the first node."""
    return closure.reachable(with_schema(spark, sf_dir), _least(spark, sf_dir, "s"), VOC + "within").select("s", "o", "d")


@query
def reach_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below the first node that has something below it."""
    return closure.reachable(with_schema(spark, sf_dir), None, VOC + "within", _least(spark, sf_dir, "o")).select("s", "o", "d")


@query
def reach_maxd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, at most two steps down."""
    return closure.reachable(with_schema(spark, sf_dir), None, VOC + "within", _least(spark, sf_dir, "o"), 2).select("s", "o", "d")


# -- schema vocabulary ------------------------------------------------------------------------------------------


@query
def subclass_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdfs.subclass_of(with_schema(spark, sf_dir))


@query
def individual_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is a Thing."""
    return rdfs.individual_of(with_schema(spark, sf_dir), VOC + "Thing")


@query
def class_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rdfs.class_property(with_schema(spark, sf_dir))


@query
def label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all resources, made from the name where there is none."""
    return rdfs.labels(with_schema(spark, sf_dir)).select("r", "label", "rank").distinct()


@query
def ns_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = Prefixes({"voc": VOC, "site": "http://data.example/site/", "data": "http://data.example/"})
    return rdfs.ns_labels(with_schema(spark, sf_dir), prefixes).distinct()


@query
def rdfs_find_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures with a word in a label."""
    return rdfs.find(with_schema(spark, sf_dir), "near", ("all_values_from", VOC + "Structure"), [LABEL], "word")


# -- order, enumeration, statistics -----------------------------------------------------------------------------


@query
def order_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every literal once, with its place in the order of literals."""
    found = visible(stored(spark, sf_dir)).where(F.col("o_kind") == LITERAL).select("o", "o_kind", "o_dt", "o_lang").distinct()
    return ranked(found, lit.order_key()).select("o", "o_dt", "o_lang", "rank")


for _what in ("subject", "predicate", "object", "node", "term", "iri", "bnode", "literal", "name", "resource"):
    _define(f"enum_{_what}", f"Distinct terms: {_what}.", lambda spark, d, w=_what: patterns.enumerate_terms(stored(spark, d), w))


@query
def stats_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.by_graph(stored(spark, sf_dir))


@query
def stats_pred_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.by_predicate(stored(spark, sf_dir))


@query
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.totals(stored(spark, sf_dir))


@query
def branch_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.branch_factors(stored(spark, sf_dir))


@query
def branch_factors_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.branch_factor_with_sub(with_schema(spark, sf_dir), VOC + "within")


@query
def graph_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.graph_md5(stored(spark, sf_dir))


@query
def prefix_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.graph_prefixes(stored(spark, sf_dir), Prefixes({"voc": VOC, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}))


@query
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates contracted, expanded again, split, and digested."""
    px = Prefixes({"voc": VOC, "rdf": RDF, "rdfs": RDFS})
    names = patterns.enumerate_terms(stored(spark, sf_dir), "predicate").select(F.col("term").alias("p"))
    short = px.contract_column(F.col("p"))
    base, local = split_url(F.col("p"))
    return names.select("p", short.alias("short"), px.expand_column(short).alias("long"), base.alias("base"), local.alias("local"), terms.atom_md5(F.col("p"), 2).alias("md5_twice"))


@query
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of typed literals, null where the form is faulty."""
    found = patterns.triples(stored(spark, sf_dir)).where(F.col("o_kind") == LITERAL)
    values = lit.typed_values(F.col("o"), F.col("o_dt"))
    return found.select("s", "p", "o", "o_dt", values["v_int"].alias("v_int"), values["v_double"].alias("v_double"), values["v_date"].alias("v_date")).where("o_dt is not null").distinct()


# -- lists and containers ---------------------------------------------------------------------------------------


def _of_lists(name: str, doc: str, build) -> None:
    _define(name, doc, lambda spark, d: build(materialize(line_lists(spark, d))))


_of_lists("list_members", "Members of every list with their place.", lambda q: lists.list_rows(q).groupBy("pos", "member").agg(F.count(F.lit(1)).alias("n")))
_of_lists("list_length", "How many lists there are of each length.", lambda q: lists.list_length(q).groupBy("length").agg(F.count(F.lit(1)).alias("n")))
_of_lists("list_nth1", "First members, counted from 1.", lambda q: lists.nth(q, 1).where("n = 1").groupBy("member").agg(F.count(F.lit(1)).alias("n")))
_of_lists("list_nth", "Members by place, counted from 0.", lambda q: lists.nth(q, 0).groupBy("n", "member").agg(F.count(F.lit(1)).alias("lists")))
_of_lists("list_last", "Last members.", lambda q: lists.last(q).groupBy("member").agg(F.count(F.lit(1)).alias("n")))
_of_lists("list_nextto", "Pairs of neighbours.", lists.next_to)


@query
def bag_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.container_members(region_bags(spark, sf_dir)).select("container", "n", "member")


@query
def alt_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.alternatives(region_bags(spark, sf_dir, "Alt")).select("container", "default", F.size("others").alias("n_others"))


# -- text index -------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_index(spark, sf_dir).frame


for _name, _q in {
    "text_token": Q("token", "near"), "text_and": Q("and", "ward", "keeper"), "text_or": Q("or", "ward", "near"), "text_not": Q("and", "ward", Q("not", "name")), "text_prefix": Q("prefix", "bö"), "text_between": Q("between", 10, 20),
    "text_ge": Q("ge", 300), "text_case": Q("case", "NEAR"), "text_stem": Q("stem", "wards"), "text_sounds": Q("sounds", "keepur"), "text_stop_word": Q("token", "the"),
}.items():
    _define(_name, f"Literals that match {_q}.", lambda spark, d, q=_q: text_index.find_literals(_index(spark, d), q))


@query
def stopgap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens in more than a hundred literals."""
    return text_index.stopgap_tokens(_index(spark, sf_dir), 100)


@query
def token_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that a prefix stands for."""
    return text_index.token_expansions(_index(spark, sf_dir), Q("and", Q("prefix", "kea"), "ward"))


# -- versions ---------------------------------------------------------------------------------------------------


@query
def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples as they were in the middle of the history."""
    q = stored(spark, sf_dir)
    middle = q.agg(F.floor(F.max("born") / 2)).collect()[0][0]
    return patterns.triples(q, p=VOC + "linksTo", generation=middle).select("s", "o")


@query
def update_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All Mills made Bridges, in one generation; what is a Bridge then."""
    store = Store(spark, stored(spark, sf_dir))
    store.update("object", VOC + "Bridge", p=TYPE, o=VOC + "Mill")
    return store.statements(p=TYPE, o=VOC + "Bridge").select("s", "g", "line")


@query
def retract_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicates left when a graph's labels and all numbers over 100 are taken away."""
    store = Store(spark, stored(spark, sf_dir))
    with store.transaction("clean"):
        store.retract(p=LABEL, g="http://data.example/graph/catalog")
        store.retract(o=Match("gt", 100))
    return statistics.by_predicate(store.quads)


@query
def assert_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements asserted a second time change nothing; in a new graph they are added."""
    store = Store(spark, stored(spark, sf_dir))
    links = store.statements(p=VOC + "partOf")
    with store.transaction():
        store.insert(links)
        store.insert(links.withColumn("g", F.lit(EX + "again")))
    return store.statements(p=VOC + "partOf").groupBy("g").agg(F.countDistinct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*TRIPLE, "line")]).alias("n"))


@query
def net_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction changes in the end: an update, a retract, and an assert that is taken back."""
    store = Store(spark, stored(spark, sf_dir))
    with store.transaction("edit"):
        store.insert([("http://data.example/site/1", LABEL, ("gone again", {"type": XSD + "string"}))])
        store.retract(o=Literal("gone again", XSD + "string"))
        store.retract(p=VOC + "partOf")
        store.insert([("http://data.example/site/1", VOC + "seen", ("1", {"type": XSD + "integer"}))])
    return store.changes(store.generation).groupBy("event", "p").agg(F.countDistinct("s", "o", "g", F.coalesce("line", F.lit(-1))).alias("n"))


@query
def monitor_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, counted as a stream with a watermark."""
    source = table(spark, sf_dir, "events")
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "*events.parquet").parquet(sf_dir)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/counts")
    changes.event_counts(rows, "ts").writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


# -- formats ----------------------------------------------------------------------------------------------------


@query
def nt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as N-Triples lines and read again; resources that are no IRIs can't be read."""
    lines = ntriples.format_lines(patterns.triples(stored(spark, sf_dir)))
    return ntriples.parse(lines, anon_prefix="_:").where("is_statement").select("s", "p", "o", "o_kind").distinct()


@query
def turtle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star's triples written as Turtle, a text per subject, and read again."""
    px = Prefixes({"ex": EX, "xsd": XSD})
    texts = turtle_write.subjects(star(spark, sf_dir), px)
    docs = texts.select(F.col("s").alias("path"), F.concat(F.lit(turtle_write.header(px)), "value").alias("text"))
    return turtle.parse_documents(docs).select("s", "p", "o", "o_kind").distinct()


@query
def rdfxml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star's triples written as RDF/XML, a document per subject, and read again."""
    docs = rdfxml.subjects(star(spark, sf_dir)).select(F.col("s").alias("path"), F.concat(F.lit(rdfxml.header()), "value", F.lit(rdfxml.footer())).alias("text"))
    return rdfxml.parse_documents(docs).select("s", "p", "o", "o_kind").distinct()


@query
def json_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of result documents, of which one is made per nation."""
    term = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    binding = F.struct(term("uri", F.concat(F.lit(EX + "nation/"), F.col("n_nationkey").cast("string"))).alias("n"), term("literal", F.col("n_name")).alias("name"))
    docs = table(spark, sf_dir, "nation").select(F.to_json(F.struct(F.struct(F.array(binding).alias("bindings")).alias("results"))).alias("text"))
    return results.read_json(docs, ["n", "name", "missing"]).select("n", "n_kind", "name", "name_kind", "missing")


@query
def graph_isomorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of the orders' lists is the same when its blank nodes are renamed. The lists' members are kept, not their statements, which are made as they are read."""
    with scratch():
        bags = as_lists(materialize(line_members(spark, sf_dir)))
        name = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit("_:x"), F.md5(c))).otherwise(F.col(c))
        other = bags.withColumn("s", name("s")).withColumn("o", name("o"))
        return spark.createDataFrame([(graph_digest.count_different(bags, other),)], "n_different bigint")


@query
def lang_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language tags in use and whether they are English."""
    return visible(stored(spark, sf_dir)).where("o_lang is not null").groupBy("o_lang").agg(F.count(F.lit(1)).alias("n")).withColumn("english", lang_matches(F.col("o_lang"), "en"))


@query
def rdfa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What marked-up pages say, one page made per nation."""
    page = F.concat(F.lit(f'<html><body prefix="ex: {EX}"><div typeof="ex:Nation" resource="{EX}nation/'), F.col("n_nationkey").cast("string"), F.lit('"><b property="ex:name">'), F.col("n_name"), F.lit(f'</b><a rel="ex:inRegion" href="{EX}region/'), F.col("n_regionkey").cast("string"), F.lit('">r</a></div></body></html>'))
    docs = table(spark, sf_dir, "nation").select(F.concat(F.lit("http://pages.example/"), F.col("n_nationkey").cast("string")).alias("path"), page.alias("text"))
    return rdfa.parse_documents(docs).select("s", "p", "o", "o_kind")


@query
def xml_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of result documents in XML, one made per region."""
    doc = F.concat(F.lit('<sparql xmlns="http://www.w3.org/2005/sparql-results#"><results><result><binding name="name"><literal xml:lang="EN">'), F.col("r_name"), F.lit("</literal></binding></result></results></sparql>"))
    return results.read_xml(table(spark, sf_dir, "region").select(doc.alias("text")), ["name", "missing"]).select("name", "name_kind", "name_lang", "missing")


@query
def persist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements per graph after saving the store and loading it."""
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    persist.save_db(stored(spark, sf_dir), path)
    return statistics.by_graph(persist.load_db(spark, path))


@query
def edit_undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct statements per predicate after two edits, of which both are undone and the first is done again."""
    editor = Editor(Store(spark, stored(spark, sf_dir)))
    editor.retract(p=VOC + "linksTo")
    editor.update("predicate", LABEL, p=VOC + "altLabel")
    editor.undo()
    editor.undo()
    editor.redo()
    return editor.store.quads.select(*TRIPLE, "g", "line").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query
def import_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a nation brings with it, where nations import their regions."""
    links = patterns.triples(star(spark, sf_dir), p=EX + "inRegion").select("s", F.lit(library.import_properties()["ontology"]).alias("p"), "o", "o_kind")
    return library.to_load(links, EX + "nation/0")


@query
def list_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements left by predicate when the list of the first order is taken away."""
    q = materialize(line_lists(spark, sf_dir))
    first = table(spark, sf_dir, "lineitem").agg(F.min("l_orderkey").cast("string").alias("k")).select(terms.create_bnode(F.col("k"), F.lit(0), start="_:list")).collect()[0][0]
    return statistics.by_predicate(lists.retract_list(q, first))


@query
def literal_map_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals whose postings have two tokens and lack a third."""
    pairs = table(spark, sf_dir, "rdf_litindex").where("token is not null and lit_id is not null").select(F.col("token").alias("key"), F.col("lit_id").alias("value"))
    return text_index.LiteralMap(pairs).find(["of", "near", ("not", "the")])


@query
def members_of_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of lists and containers alike, counted by set of a container."""
    both = region_bags(spark, sf_dir).unionByName(line_lists(spark, sf_dir))
    return rdfs.members(materialize(both)).groupBy("member").agg(F.count(F.lit(1)).alias("n"))
