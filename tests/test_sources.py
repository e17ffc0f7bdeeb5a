"""Readers and writers on small documents, and the streams."""

import gzip

import pytest
from pyspark.sql import functions as F

from quadrel.functions.prefixes import Prefixes
from quadrel.operators import patterns
from quadrel.operators.compare import equal_graphs, same_ground
from quadrel.schema import RDF, XSD, quads_frame
from quadrel.sources import library, load, ntriples, persist, rdfa, rdfxml, results, turtle, turtle_write
from quadrel.sources.turtle import Parser, TurtleError
from quadrel.store import Store
from quadrel.streaming import changes


def full(df):
    return df.withColumn("line", F.lit(None).cast("int")).withColumn("born", F.lit(1).cast("bigint")).withColumn("died", F.lit(None).cast("bigint"))


def short(rows):
    return [(s, p.removeprefix(RDF), o) for s, p, o, *_ in rows]


def test_turtle_terms():
    doc = """@prefix : <http://e/> . PREFIX x: <http://x/> @base <http://b/c/> .
:a a x:T ; :p 1, -2.5, 3e0, true, "t"@EN-gb, 'q\\u00e9\\n', \"\"\"long "quoted" text\"\"\", "5"^^x:d ; . <rel> :q <../up>, <#f> . x:a.b :pc x:%41\\~z ."""
    rows = [r[:6] for r in Parser(doc).parse()]
    assert [r[2] for r in rows] == ["http://x/T", "1", "-2.5", "3e0", "true", "t", "qé\n", 'long "quoted" text', "5", "http://b/up", "http://b/c/#f", "http://x/%41~z"]
    assert rows[1][4] == XSD + "integer" and rows[2][4] == XSD + "decimal" and rows[3][4] == XSD + "double" and rows[5][5] == "en-gb" and rows[8][4] == "http://x/d" and rows[9][0] == "http://b/c/rel"


def test_turtle_nodes():
    rows = Parser("@prefix : <e:> . [ :a :b ] :c :d . :e :f [ :g :h ], () , (1 [:i :j]) . (:x) :y _:z . [:only :this] .").parse()
    assert len(rows) == 2 + 2 + 1 + 5 + 1 + 3 - 0 + 1 and sum(p == "first" for _, p, _ in short(rows)) == 3
    assert rows[0][0] == rows[1][0] == "_:genid1" and any(o == RDF + "nil" for _, p, o in short(rows) if p == "e:f")


@pytest.mark.parametrize("bad", ["<a> <b> <c>", "<a> <b> .", "@prefix x <y> .", "a b c .", '<a> <b> "x', "<a> _:p <c> .", "x:a <b> <c> .", "<a> <b> (1 2 .", '<a> "lit" <c> .', "<a> <b> <c> ; <d> .", '<a> <b> "\\q" .', "{ <a> <b> <c> ", "<g> { <a> <b> { <c> } }"])
def test_turtle_faults(bad):
    with pytest.raises(TurtleError):
        Parser(bad).parse()


def test_turtle_goes_on_after_a_fault():
    p = Parser('<a> <b> <c> .\n<a> <b> "oops .\n<d> <e> <f> .\n<g> <h> .\n<i> <j> <k> .', on_error="warning")
    assert [r[0] for r in p.parse()] == ["a", "d", "i"] and [n for n, _ in p.errors] == [2, 4]


def test_trig_graphs():
    rows = Parser("@prefix : <e:> . :s :p :o . :g { :a :b :c . :a :d :e } GRAPH <h> { [] :x 1 } { :z :z :z . }").parse()
    assert [r[6] for r in rows] == ["default", "e:g", "e:g", "h", "default"]


def test_turtle_files_and_load(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix : <e:> . :s :p :o ; :q [ :r 'x' ] .")
    with gzip.open(tmp_path / "b.nt.gz", "wt") as f:
        f.write('<e:s> <e:p> "a\\u00e9\\n\\U0001F331"@EN .\n# note\n<e:bad> .\n_:x <e:p> _:y.\n')
    (tmp_path / "c.nq").write_text("<e:s> <e:p> <e:o> <e:g> .\n<e:s> <e:p> <e:o> .\n")
    s = Store(spark)
    a = str(tmp_path / "a.ttl")
    assert load.load(s, a) == [a] and s.quads.count() == 3 and load.load(s, a) == []
    (tmp_path / "a.ttl").write_text("@prefix : <e:> . :s :p :new .")
    import os

    os.utime(a, (1, 1))
    assert load.make(s) == [a] and [r["o"] for r in s.quads.collect()] == ["e:new"]
    good, faults = ntriples.read(spark, str(tmp_path / "b.nt.gz"))
    got = sorted((r["s"], r["o"], r["o_lang"]) for r in good.collect())
    assert got == [("_:genidx", "_:genidy", None), ("e:s", "aé\n🌱", "en")] and [r["reason"] for r in faults.collect()] == ["columns"]
    with pytest.raises(ValueError):
        ntriples.read(spark, str(tmp_path / "b.nt.gz"), on_error="error")
    assert sorted(r["g"] for r in load.read(spark, str(tmp_path / "c.nq"), graph="user").collect()) == ["e:g", "user"]
    assert load.load(s, str(tmp_path / "c.nq"), cache=str(tmp_path / "cache")) and os.path.isdir(load.cache_file(str(tmp_path / "cache"), str(tmp_path / "c.nq")))
    load.unload(s, a)
    assert [r["g"] for r in s.quads.select("g").distinct().collect()] == [str(tmp_path / "c.nq")]
    assert load.format_of("x.html", "text/turtle; charset=utf-8") == "turtle" and load.format_of("x.owl") == "xml"
    with pytest.raises(ValueError):
        load.format_of("x.doc")


GRAPH = [("http://e/a", RDF + "type", "http://e/T"), ("http://e/a", "http://e/p", ('x "y" <z> & é\n\\', {"lang": "en"})), ("http://e/a", "http://e/n", ("5", {"type": XSD + "integer"})), ("_:b", "http://e/p", "http://e/a"), ("http://e/a", "http://e/q", "_:b"), ("http://e/a", "http://e/d", ("1.5E0", {"type": XSD + "double"}))]


def test_writers_round_trip(spark, tmp_path):
    q = quads_frame(spark, GRAPH)
    px = Prefixes({"e": "http://e/", "xsd": XSD})
    rows = Parser(turtle_write.document(q, px), anon_prefix="_:t").parse()
    assert equal_graphs(q, quads_frame(spark, [(r[0], r[1], (r[2], {k: v for k, v in (("type", r[4]), ("lang", r[5])) if v}) if r[3] == 2 else r[2]) for r in rows]))[0]
    doc = spark.createDataFrame([("d", rdfxml.document(q, Prefixes({"rdf": RDF, "e": "http://e/"})))], "path string, text string")
    assert equal_graphs(q, full(rdfxml.parse_documents(doc).drop("source", "error")))[0]
    nt = ntriples.parse(ntriples.format_lines(q), anon_prefix="_:")
    assert same_ground(q, full(nt.drop("errors", "is_statement")))
    ntriples.write(q, str(tmp_path / "out"), quads=True)
    assert same_ground(q, full(ntriples.read(spark, str(tmp_path / "out"), True, anon_prefix="_:")[0]))
    turtle_write.write(q, str(tmp_path / "ttl"), px)
    assert load.read(spark, str(tmp_path / "ttl"), "turtle").count() == 6
    persist.save_db(q, str(tmp_path / "db"))
    assert same_ground(q, persist.load_db(spark, str(tmp_path / "db")))
    other = q.withColumn("s", F.when(F.col("s") == "_:b", "_:other").otherwise(F.col("s"))).withColumn("o", F.when(F.col("o") == "_:b", "_:other").otherwise(F.col("o")))
    assert turtle_write.document(q, px, canonical=True) == turtle_write.document(other, px, canonical=True)
    trig = turtle_write.document(q.withColumn("g", F.lit("http://e/g")), px, trig=True)
    assert {r[6] for r in Parser(trig).parse()} == {"http://e/g"}


def test_rdfxml():
    doc = f"""<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="http://e/" xml:lang="en"><e:T rdf:about="http://e/a" e:attr="v"><e:p rdf:resource="#x"/><e:q rdf:parseType="Resource"><e:r>t</e:r></e:q><e:l rdf:parseType="Collection"><e:T rdf:nodeID="n"/></e:l>
<e:d rdf:datatype="{XSD}int">5</e:d><e:x rdf:parseType="Literal"><b>m</b></e:x><rdf:li>one</rdf:li><e:n><rdf:Description rdf:ID="id"/></e:n></e:T></rdf:RDF>"""
    rows = rdfxml.Reader("http://base/").parse(doc)
    by = {p: (o, k, dt, lang) for _, p, o, k, dt, lang, *_ in rows}
    assert by["http://e/p"][0] == "http://base/#x" and by["http://e/attr"] == ("v", 2, None, "en") and by["http://e/d"] == ("5", 2, XSD + "int", None) and by[RDF + "_1"][0] == "one" and by["http://e/n"][0] == "http://base/#id" and by["http://e/x"][2] == RDF + "XMLLiteral"


def test_rdfa(spark):
    doc = """<html prefix="f: http://f/"><body vocab="http://s/" typeof="Person" resource="#me"><p property="name" lang="en">Ann</p><a property="url" href="/x">h</a><div rel="knows"><p typeof="Person"><b property="name">Bob</b></p></div>
<time property="born" datetime="2001-02-03"></time><i property="f:list" inlist>1</i><i property="f:list" inlist>2</i><meta property="note" content="c"><span about="#o" rel="f:in" rev="f:out" href="#me"></span></body></html>"""
    got = rdfa.parse_documents(spark.createDataFrame([("http://e/", doc), ("http://n/", "<p>no data <a href='x'>y</a>")], "path string, text string")).collect()
    said = {(r["s"], r["p"], r["o"]) for r in got if r["source"] == "http://e/"}
    assert {("http://e/#me", "http://s/name", "Ann"), ("http://e/#me", "http://s/url", "http://e/x"), ("http://e/#me", "http://s/born", "2001-02-03"), ("http://e/#me", "http://s/note", "c"), ("http://e/#o", "http://f/in", "http://e/#me"), ("http://e/#me", "http://f/out", "http://e/#o")} <= said
    assert any(p == "http://s/name" and o == "Bob" for _, p, o in said) and sum(p == RDF + "first" for _, p, _ in said) == 2 and not [r for r in got if r["source"] == "http://n/"]


def test_result_documents(spark):
    j = '{"head":{"vars":["a","b"]},"results":{"bindings":[{"a":{"type":"uri","value":"u"},"b":{"type":"literal","value":"v","xml:lang":"EN"}},{"a":{"type":"bnode","value":"x"}}]}}'
    x = '<sparql xmlns="http://www.w3.org/2005/sparql-results#"><results><result><binding name="a"><uri>u</uri></binding><binding name="b"><literal xml:lang="EN">v</literal></binding></result><result><binding name="a"><bnode>x</bnode></binding></result></results></sparql>'
    want = [("_:x", 1, None, None), ("u", 0, "v", "en")]
    for reader, doc in ((results.read_json, j), (results.read_xml, x)):
        got = reader(spark.createDataFrame([(doc,)], "text string"), ["a", "b"])
        assert sorted((r["a"], r["a_kind"], r["b"], r["b_lang"]) for r in got.collect()) == want
    assert results.json_boolean(spark.createDataFrame([('{"boolean":true}',)], "text string")).collect()[0][0] is True
    assert results.request("http://s/q", "ASK {}") == "http://s/q?query=ASK+%7B%7D"


def test_library(spark):
    t = RDF + "type"
    q = quads_frame(spark, [("a", t, library.LIB + "Ontology"), ("b", t, library.LIB + "Schema"), ("a", library.OWL + "imports", "b"), ("b", library.OWL + "imports", "c"), ("c", library.OWL + "imports", "a"), ("a", library.DCTERMS + "title", ("A",)), ("a", library.LIB + "providesNamespace", "ns"), ("b", library.LIB + "providesNamespace", "ns")])
    assert {(r["id"], r["level"]) for r in library.to_load(q, "a").collect()} == {("a", 0), ("b", 1), ("c", 2)} and library.to_load(q, "a", False).count() == 1
    assert library.conflicts(q).collect()[0]["ids"] == ["a", "b"] and [r["target"] for r in library.missing(q).collect()] == ["c"] and library.facets(q).where("facet = 'title'").count() == 1


def test_change_stream(spark, tmp_path):
    s, log, seen = Store(spark), str(tmp_path / "log"), []
    changes.write_changes(s, log)
    s.insert([("a", "p", "b")])
    s.retract(s="a")
    q = changes.monitor(changes.read_changes(spark, log), lambda df, n: seen.extend((r["generation"], r["event"]) for r in df.collect()), str(tmp_path / "c"))
    q.awaitTermination()
    assert sorted(seen) == [(1, "assert"), (2, "retract")]


def test_streaming_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.nt").write_text("<a> <b> <c> .\nbad\n")
    out = []
    q = changes.read_ntriples(spark, str(tmp_path / "in")).writeStream.foreachBatch(lambda df, n: out.extend(r["s"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert out == ["a"]


def whole_star():
    """Every statement of the star over the smallest tables, by SQL of its own; literals are kind 2, links kind 0."""
    import duckdb

    small, ex = "/root/testdata/sf0.001", "http://example.org/"
    cents = "cast(cast(round({} * 100) AS BIGINT) AS VARCHAR)".format
    columns = {
        ("region", "r_regionkey"): {"name": "r_name"}, ("nation", "n_nationkey"): {"name": "n_name", "inRegion": ("region", "n_regionkey")},
        ("customer", "c_custkey"): {"name": "c_name", "segment": "c_mktsegment", "inNation": ("nation", "c_nationkey"), "balance": cents("c_acctbal")},
        ("supplier", "s_suppkey"): {"name": "s_name", "inNation": ("nation", "s_nationkey"), "balance": cents("s_acctbal")},
        ("part", "p_partkey"): {"name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "cast(p_size AS VARCHAR)"},
        ("orders", "o_orderkey"): {"status": "o_orderstatus", "priority": "o_orderpriority", "placedBy": ("customer", "o_custkey"), "total": cents("o_totalprice")},
    }
    out = set()
    for (name, key), of in columns.items():
        for p, c in of.items():
            o, kind = (f"'{ex}{c[0]}/' || {c[1]}", 0) if isinstance(c, tuple) else (c, 2)
            rows = duckdb.sql(f"SELECT '{ex}{name.removesuffix('s')}/' || {key}, {o} FROM '{small}/{name}.parquet' WHERE {key} IS NOT NULL AND {o} IS NOT NULL").fetchall()
            out |= {(s, ex + p, o, kind) for s, o in rows}
    return out


def test_rdfxml_roundtrip_takes_the_whole_star(spark):
    from quadrel.plans import store_queries

    got = [tuple(r) for r in store_queries.rdfxml_roundtrip(spark, "/root/testdata/sf0.001").collect()]
    want = whole_star()
    assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert {s.split("/")[3] for s, *_ in got} == {"region", "nation", "customer", "supplier", "part", "order"}


def test_turtle_roundtrip_keeps_every_link(spark):
    from quadrel.plans import store_queries

    got = [tuple(r) for r in store_queries.turtle_roundtrip(spark, "/root/testdata/sf0.001").collect()]
    want = whole_star()
    assert len(got) == len(set(got)) == len(want) and set(got) == want
    assert sum(p == "http://example.org/placedBy" for _, p, *_ in got) > 1000


def test_blank_nodes_of_paths_with_equal_crc32_stay_apart(spark):
    import zlib

    from quadrel.sources import turtle

    a, b = "plumless", "buckeroo"
    assert zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    for reader, doc in ((turtle, "<e:s> <e:p> [] ."), (rdfxml, f'<rdf:RDF xmlns:rdf="{RDF}" xmlns:e="e:"><rdf:Description><e:p>x</e:p></rdf:Description></rdf:RDF>'), (rdfa, '<div typeof="http://e/T"></div>')):
        rows = reader.parse_documents(spark.createDataFrame([(a, doc), (b, doc)], "path string, text string"), base="http://b/").collect()
        names = {r["source"]: {x for x in (r["s"], r["o"]) if x.startswith("_:")} for r in rows}
        assert names[a] and names[b] and not names[a] & names[b]


def test_turtle_writer_options_read_back(spark):
    q = quads_frame(spark, [("http://b.example/s", RDF + "type", "http://b.example/T"), ("http://b.example/s", "http://x.example/n", ("007", {"type": XSD + "integer"})), ("http://b.example/s", "http://x.example/n", ("x", {"lang": "en"})), ("_:b", "http://x.example/p", "_:c")])
    px = Prefixes({"x": "http://x.example/"})
    want = sorted(map(tuple, patterns.triples(q).select("p", "o_kind").collect()))
    for options in ({}, {"group": False}, {"single_line": True}, {"base": "http://b.example/"}, {"canonize_numbers": True}, {"base": "http://b.example/", "group": False, "single_line": True}):
        text = turtle_write.document(q, px, comment="two\nlines", **options)
        got = turtle.parse_documents(spark.createDataFrame([("http://d.example/", text)], "path string, text string"))
        assert sorted(map(tuple, got.select("p", "o_kind").collect())) == want, options
        assert ("<s>" in text) == ("base" in options) and text.startswith("# two\n# lines\n") and ('"007"' in text or " 007" in text) != ("canonize_numbers" in options)


def test_a_fault_in_a_block_doesnt_end_it():
    p = Parser("<g> {\n<a> <p> 1 .\n<b> <p> <p> <p> .\n<c> <p> 2 .\n}\n<d> <p> 3 .\n", "http://x.example/", "default", "_:", on_error="warning")
    assert {(r[0][-1], r[6][-1]) for r in p.parse()} >= {("a", "g"), ("c", "g"), ("d", "t")}
    assert len(p.errors) == 1


def test_integers_that_end_in_a_line_end_are_quoted(spark):
    q = quads_frame(spark, [("http://x.example/s", "http://x.example/p", "http://x.example/o")]).withColumns({"o": F.lit("27\n"), "o_kind": F.lit(2).cast("tinyint"), "o_dt": F.lit(XSD + "integer")})
    assert '"27\\n"^^' in turtle_write.document(q)


def test_canonical_trig_is_the_same_for_renamed_blank_nodes(spark):
    rows = lambda a, b: quads_frame(spark, [(f"_:{a}", "http://x.example/p", f"_:{b}", "http://g.example/1"), (f"_:{b}", "http://x.example/p", ("v", {}), "http://g.example/2"), (f"_:{a}", "http://x.example/q", ("v", {}), "http://g.example/2")])
    one, other = (turtle_write.document(q, trig=True, canonical=True) for q in (rows("m", "n"), rows("z", "k")))
    assert one == other and "_:m" not in one
    swapped = quads_frame(spark, [("_:a", "http://x.example/p", "_:b", "http://g.example/2"), ("_:b", "http://x.example/p", ("v", {}), "http://g.example/1"), ("_:a", "http://x.example/q", ("v", {}), "http://g.example/2")])
    assert turtle_write.document(swapped, trig=True, canonical=True) != one
