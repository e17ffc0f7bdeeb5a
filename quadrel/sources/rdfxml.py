"""RDF/XML, read a document at a time and written from quads."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.functions.prefixes import Prefixes, xml_namespace
from quadrel.schema import BNODE, DEFAULT_GRAPH, IRI, LITERAL, RDF, TRIPLE, visible
from quadrel.storage import ship
from quadrel.sources.turtle import FLUSH, SCHEMA, as_frame, hash_of

_R, _XML = f"{{{RDF}}}", "{http://www.w3.org/XML/1998/namespace}"
_SYNTAX = {_R + n for n in ("about", "ID", "nodeID", "resource", "datatype", "parseType", "aboutEach", "bagID")}


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class Reader:
    def __init__(self, base: str = "", graph: str = DEFAULT_GRAPH, anon: str = "_:genid") -> None:
        self.base, self.graph, self.anon, self.n, self.out = base, graph, anon, 0, []

    def fresh(self) -> str:
        self.n += 1
        return f"{self.anon}{self.n}"

    def give(self, s: str, p: str, o: str, kind: int, dt: str | None = None, lang: str | None = None) -> None:
        self.out.append((s, p, o, kind, dt, lang.lower() if lang else None, self.graph, None))

    def link(self, s: str, p: str, o: str) -> None:
        self.give(s, p, o, BNODE if o.startswith("_:") else IRI)

    def parse(self, text: str) -> list[tuple]:
        root = ET.fromstring(text)
        lang, base = root.get(_XML + "lang"), root.get(_XML + "base", self.base)
        if root.tag == _R + "RDF":
            for child in root:
                self.node(child, lang, base)
        else:
            self.node(root, None, self.base)
        return self.out

    def node(self, e: ET.Element, lang: str | None, base: str) -> str:
        lang, base = e.get(_XML + "lang", lang), e.get(_XML + "base", base)
        if e.get(_R + "about") is not None:
            s = urljoin(base, e.get(_R + "about"))
        elif e.get(_R + "ID") is not None:
            s = urljoin(base, "#" + e.get(_R + "ID"))
        elif e.get(_R + "nodeID") is not None:
            s = f"{self.anon}_{e.get(_R + 'nodeID')}"
        else:
            s = self.fresh()
        if e.tag != _R + "Description":
            self.link(s, RDF + "type", _iri(e.tag))
        self.attributes(s, e, lang)
        members = 0
        for child in e:
            p = _iri(child.tag)
            if child.tag == _R + "li":
                members += 1
                p = f"{RDF}_{members}"
            self.property(s, p, child, lang, base)
        return s

    def attributes(self, s: str, e: ET.Element, lang: str | None) -> None:
        for k, v in e.attrib.items():
            if k in _SYNTAX or k.startswith(_XML) or not k.startswith("{"):
                continue
            if k == _R + "type":
                self.link(s, RDF + "type", v)
            else:
                self.give(s, _iri(k), v, LITERAL, None, lang)

    def property(self, s: str, p: str, e: ET.Element, lang: str | None, base: str) -> None:
        lang, base, kind = e.get(_XML + "lang", lang), e.get(_XML + "base", base), e.get(_R + "parseType")
        if e.get(_R + "resource") is not None or e.get(_R + "nodeID") is not None:
            o = urljoin(base, e.get(_R + "resource")) if e.get(_R + "resource") is not None else f"{self.anon}_{e.get(_R + 'nodeID')}"
            self.link(s, p, o)
            self.attributes(o, e, lang)
        elif kind == "Resource":
            o = self.fresh()
            self.link(s, p, o)
            for child in e:
                self.property(o, _iri(child.tag), child, lang, base)
        elif kind == "Collection":
            items = [self.node(c, lang, base) for c in e]
            cells = [self.fresh() for _ in items]
            self.link(s, p, cells[0] if cells else RDF + "nil")
            for i, (c, item) in enumerate(zip(cells, items)):
                self.link(c, RDF + "first", item)
                self.link(c, RDF + "rest", cells[i + 1] if i + 1 < len(cells) else RDF + "nil")
        elif kind is not None:
            inner = (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e)
            self.give(s, p, inner, LITERAL, RDF + "XMLLiteral")
        elif len(e):
            for child in e:
                self.link(s, p, self.node(child, lang, base))
        elif any(k.startswith("{") and k not in _SYNTAX and not k.startswith(_XML) for k in e.attrib):
            o = self.fresh()
            self.link(s, p, o)
            self.attributes(o, e, lang)
        else:
            dt = e.get(_R + "datatype")
            self.give(s, p, e.text or "", LITERAL, urljoin(base, dt) if dt else None, None if dt else lang)
        if e.get(_R + "ID") is not None and self.out:
            name, (_, _, o, k, dt, lg, *_) = urljoin(base, "#" + e.get(_R + "ID")), next(x for x in reversed(self.out) if x[0] == s and x[1] == p)
            self.link(name, RDF + "type", RDF + "Statement")
            self.link(name, RDF + "subject", s)
            self.link(name, RDF + "predicate", p)
            self.give(name, RDF + "object", o, k, dt, lg)


def parse_documents(docs: DataFrame, base: str | None = None, graph: str | None = None) -> DataFrame:
    """Quads of documents (path, text); a document that isn't XML gives one row with ``error``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch["path"], batch["text"]):
                reader = Reader(base or path, graph or DEFAULT_GRAPH, f"_:g{hash_of(path)}n")
                try:
                    out += [(*r, path, None) for r in reader.parse(content or "")]
                except ET.ParseError as e:
                    out.append((*[None] * 8, path, str(e)))
                if len(out) > FLUSH:
                    yield as_frame(out)
                    out = []
            yield as_frame(out)

    ship(docs.sparkSession)
    return docs.select("path", "text").mapInPandas(run, SCHEMA)


def read(spark: SparkSession, path: str, base: str | None = None, graph: str | None = None) -> DataFrame:
    return parse_documents(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")), base, graph)


def _xml(text):
    for ch, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(ch), F.lit(to))
    return text


def subjects(quads: DataFrame, prefixes: Prefixes | None = None) -> DataFrame:
    """An rdf:Description element per subject: s, value. Predicates without a known prefix declare their namespace in place."""
    prefixes = prefixes or Prefixes()
    ns, local = xml_namespace(F.col("p"))
    prefix = prefixes.prefix_of(ns)
    name = F.when(prefix.isNotNull() & (prefixes.expand_column(F.concat(prefix, F.lit(":"))) == ns), F.concat(prefix, F.lit(":"), local)).otherwise(F.concat(F.lit("ns:"), local))
    declare = F.when(name.startswith("ns:"), F.concat(F.lit(' xmlns:ns="'), _xml(ns), F.lit('"'))).otherwise("")
    o = F.col("o")
    attr = F.when(F.col("o_kind") == IRI, F.concat(F.lit(' rdf:resource="'), _xml(o), F.lit('"/>'))).when(F.col("o_kind") == BNODE, F.concat(F.lit(' rdf:nodeID="'), F.substr(o, F.lit(3)), F.lit('"/>')))
    kind = F.coalesce(F.concat(F.lit(' xml:lang="'), F.col("o_lang"), F.lit('"')), F.concat(F.lit(' rdf:datatype="'), _xml(F.col("o_dt")), F.lit('"')), F.lit(""))
    body = F.coalesce(attr, F.concat(kind, F.lit(">"), _xml(o), F.lit("</"), name, F.lit(">")))
    rows = visible(quads).select(*TRIPLE).distinct().select("s", F.concat(F.lit("    <"), name, declare, body, F.lit("\n")).alias("t"))
    about = F.when(F.col("s").startswith("_:"), F.concat(F.lit('rdf:nodeID="'), F.substr("s", F.lit(3)))).otherwise(F.concat(F.lit('rdf:about="'), _xml(F.col("s"))))
    return rows.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list("t")), "").alias("t")).select("s", F.concat(F.lit("  <rdf:Description "), about, F.lit('">\n'), "t", F.lit("  </rdf:Description>\n")).alias("value"))


def header(prefixes: Prefixes | None = None) -> str:
    names = "".join(f'\n    xmlns:{p}="{ns}"' for p, ns in sorted((prefixes or Prefixes()).known.items()))
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF{names}>\n'


def footer() -> str:
    return "</rdf:RDF>\n"


def document(quads: DataFrame, prefixes: Prefixes | None = None) -> str:
    """One document as a text, for graphs that fit the driver."""
    return header(prefixes) + "".join(r["value"] for r in subjects(quads, prefixes).orderBy("s").toLocalIterator()) + footer()
