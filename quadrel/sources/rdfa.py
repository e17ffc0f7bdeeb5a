"""RDFa in HTML and XML documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

from quadrel.functions.prefixes import BUILT_IN
from quadrel.schema import BNODE, DEFAULT_GRAPH, IRI, LITERAL, RDF, XSD
from quadrel.storage import ship
from quadrel.sources.turtle import FLUSH, SCHEMA, as_frame, hash_of

# Prefixes and terms that hold at the start of every document.
INITIAL = BUILT_IN | {
    "cc": "http://creativecommons.org/ns#", "ctag": "http://commontag.org/ns#", "dc": "http://purl.org/dc/terms/", "dc11": "http://purl.org/dc/elements/1.1/", "dcat": "http://www.w3.org/ns/dcat#",
    "gr": "http://purl.org/goodrelations/v1#", "grddl": "http://www.w3.org/2003/g/data-view#", "ical": "http://www.w3.org/2002/12/cal/icaltzd#", "ma": "http://www.w3.org/ns/ma-ont#", "og": "http://ogp.me/ns#",
    "org": "http://www.w3.org/ns/org#", "prov": "http://www.w3.org/ns/prov#", "qb": "http://purl.org/linked-data/cube#", "rdfa": "http://www.w3.org/ns/rdfa#", "rev": "http://purl.org/stuff/rev#", "rif": "http://www.w3.org/2007/rif#",
    "rr": "http://www.w3.org/ns/r2rml#", "schema": "http://schema.org/", "sd": "http://www.w3.org/ns/sparql-service-description#", "sioc": "http://rdfs.org/sioc/ns#", "skosxl": "http://www.w3.org/2008/05/skos-xl#", "v": "http://rdf.data-vocabulary.org/#",
    "vcard": "http://www.w3.org/2006/vcard/ns#", "wdr": "http://www.w3.org/2007/05/powder#", "wdrs": "http://www.w3.org/2007/05/powder-s#", "xhv": "http://www.w3.org/1999/xhtml/vocab#", "xml": "http://www.w3.org/XML/1998/namespace",
}
TERMS = {"describedby": "http://www.w3.org/2007/05/powder-s#describedby", "license": "http://www.w3.org/1999/xhtml/vocab#license", "role": "http://www.w3.org/1999/xhtml/vocab#role"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
TIMES = [(r"-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?", "dateTime"), (r"-?\d{4,}-\d\d-\d\d(Z|[+-]\d\d:\d\d)?", "date"), (r"\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)?", "time"), (r"-?\d{4,}-\d\d", "gYearMonth"), (r"-?\d{4,}", "gYear"), (r"-?P(\d+Y)?(\d+M)?(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?", "duration")]


class _Tree(HTMLParser):
    """Elements as [name, attributes, children]; void elements close themselves, end tags close what is open within."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = [tag, {k: v if v is not None else "" for k, v in attrs}, []]
        self.open[-1][2].append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][2].append([tag, {k: v if v is not None else "" for k, v in attrs}, []])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _text(e) -> str:
    return e if isinstance(e, str) else "".join(_text(c) for c in e[2])


def _markup(children) -> str:
    return "".join(c if isinstance(c, str) else f"<{c[0]}{''.join(f' {k}={chr(34)}{v}{chr(34)}' for k, v in c[1].items())}>{_markup(c[2])}</{c[0]}>" for c in children)


class Extractor:
    """The statements of a document, by the processing steps of RDFa 1.1."""

    def __init__(self, base: str, graph: str = DEFAULT_GRAPH, anon: str = "_:genid") -> None:
        self.base, self.graph, self.anon, self.n, self.out = base, graph, anon, 0, []

    def fresh(self) -> str:
        self.n += 1
        return f"{self.anon}{self.n}"

    def give(self, s, p, o, kind=None, dt=None, lang=None) -> None:
        if s and p and o is not None:
            self.out.append((s, p, o, kind if kind is not None else BNODE if o.startswith("_:") else IRI, dt, lang or None, self.graph, None))

    def run(self, markup: str) -> list[tuple]:
        tree = _Tree()
        tree.feed(markup)
        tree.close()
        for e in self.all(tree.root):
            if e[0] == "base" and e[1].get("href"):
                self.base = urljoin(self.base, e[1]["href"])
        self.element(tree.root, {"subject": self.base, "object": None, "incomplete": [], "lists": {}, "lang": None, "prefixes": dict(INITIAL), "vocab": None, "owner": None})
        return self.patterns()

    def all(self, e) -> Iterator:
        yield e
        for c in e[2]:
            if not isinstance(c, str):
                yield from self.all(c)

    def resource(self, value: str | None, ctx, safe: bool = True) -> str | None:
        if value is None:
            return None
        m = re.fullmatch(r"\[(.*)\]", value.strip())
        if m:
            return self.curie(m[1], ctx)
        return (self.curie(value, ctx) if safe else None) or urljoin(self.base, value)

    def curie(self, value: str, ctx) -> str | None:
        prefix, colon, local = value.partition(":")
        if not colon:
            return None
        if prefix == "_":
            return f"{self.anon}_{local}"
        if prefix.lower() in ctx["prefixes"] and not local.startswith("//"):
            return ctx["prefixes"][prefix.lower()] + local
        return "http://www.w3.org/1999/xhtml/vocab#" + local if prefix == "" else None

    def names(self, value: str | None, ctx) -> list[str]:
        out = []
        for v in (value or "").split():
            if ":" in v:
                found = self.curie(v, ctx) or (v if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", v) else None)
            elif ctx["vocab"]:
                found = ctx["vocab"] + v
            else:
                found = TERMS.get(v.lower())
            if found:
                out.append(found)
        return out

    def element(self, e, up) -> None:
        at = e[1]
        ctx = {**up, "prefixes": up["prefixes"], "incomplete": [], "lists": up["lists"]}
        if "vocab" in at:
            ctx["vocab"] = at["vocab"] or None
            if at["vocab"]:
                self.give(self.base, "http://www.w3.org/ns/rdfa#usesVocabulary", at["vocab"], IRI)
        pairs = re.findall(r"(\S+):\s+(\S+)", at.get("prefix", "")) + [(k[6:], v) for k, v in at.items() if k.startswith("xmlns:")]
        if pairs:
            ctx["prefixes"] = {**ctx["prefixes"], **{k.lower(): v for k, v in pairs}}
        lang = at.get("xml:lang", at.get("lang"))
        if lang is not None:
            ctx["lang"] = lang.lower() or None
        is_root, link = e[0] in ("html",) or up["owner"] is None and e[0] == "", at.get("resource", at.get("href", at.get("src")))
        has_rel, has_prop, typed = "rel" in at or "rev" in at, "property" in at, None
        rels, revs = self.names(at.get("rel"), ctx), self.names(at.get("rev"), ctx)
        if has_prop:
            rels = [r for r in rels if ":" in (at.get("rel") or "") or r not in TERMS.values()]
        about = self.resource(at.get("about"), ctx)
        skip, new, obj = False, None, None
        parent = up["object"] or up["subject"]
        if not has_rel:
            if has_prop and "content" not in at and "datatype" not in at:
                new = about or (self.base if is_root else parent)
                if "typeof" in at:
                    typed = about or (self.base if is_root else self.link(at, ctx) or self.fresh())
                    obj = typed
            else:
                new = about or self.link(at, ctx) or (self.base if is_root else self.fresh() if "typeof" in at else parent)
                skip = about is None and link is None and "typeof" not in at and not is_root and not has_prop
                typed = new if "typeof" in at else None
        else:
            new = about or (self.base if is_root else parent)
            if about and "typeof" in at:
                typed = new
            obj = self.link(at, ctx)
            if obj is None and "typeof" in at and about is None:
                obj = self.fresh()
            if "typeof" in at and about is None:
                typed = obj
        for t in self.names(at.get("typeof"), ctx):
            self.give(typed, RDF + "type", t)
        lists = {} if new and new != up["subject"] and not skip else up["lists"]
        ctx["lists"] = lists
        if has_rel and obj:
            for r in rels:
                if "inlist" in at:
                    lists.setdefault(r, []).append((obj, None, None, None))
                else:
                    self.give(new, r, obj)
            for r in revs:
                self.give(obj, r, new)
        elif has_rel:
            for r in rels:
                if "inlist" in at:
                    ctx["incomplete"].append(("list", lists.setdefault(r, [])))
                else:
                    ctx["incomplete"].append(("out", r))
            ctx["incomplete"] += [("in", r) for r in revs]
            obj = self.fresh()
        for p in self.names(at.get("property"), ctx):
            value = self.value(e, at, ctx, typed if not has_rel else None, link)
            if "inlist" in at:
                lists.setdefault(p, []).append(value)
            else:
                self.give(new, p, *value)
        if not skip and new:
            for kind, x in up["incomplete"]:
                if kind == "list":
                    x.append((new, None, None, None))
                elif kind == "out":
                    self.give(up["subject"], x, new)
                else:
                    self.give(new, x, up["subject"])
        below = {**ctx, "owner": e, "incomplete": up["incomplete"] if skip else ctx["incomplete"]}
        below["subject"] = up["subject"] if skip else new or up["subject"]
        below["object"] = up["object"] if skip else obj or new or up["subject"]
        if not skip and ctx["incomplete"]:
            below = {**below, "subject": new}
        for c in e[2]:
            if not isinstance(c, str):
                self.element(c, below)
        if lists is not up["lists"] or up["owner"] is None:
            for p, items in lists.items():
                cells = [self.fresh() for _ in items]
                self.give(new or self.base, p, cells[0] if cells else RDF + "nil")
                for i, (cell, item) in enumerate(zip(cells, items)):
                    self.give(cell, RDF + "first", *item)
                    self.give(cell, RDF + "rest", cells[i + 1] if i + 1 < len(cells) else RDF + "nil")

    def link(self, at, ctx) -> str | None:
        if "resource" in at:
            return self.resource(at["resource"], ctx)
        for k in ("href", "src"):
            if k in at:
                return urljoin(self.base, at[k])
        return None

    def value(self, e, at, ctx, typed, link) -> tuple:
        dt = at.get("datatype")
        if dt:
            name = (self.names(dt, ctx) or [None])[0]
            if name in (RDF + "XMLLiteral", RDF + "HTML") and "content" not in at:
                return _markup(e[2]), LITERAL, name, None
            return at.get("content", at.get("datetime", _text(e))), LITERAL, name, None
        if dt == "" :
            return at.get("content", _text(e)), LITERAL, None, ctx["lang"]
        if "content" in at:
            return at["content"], LITERAL, None, ctx["lang"]
        if e[0] == "time" or "datetime" in at:
            text = at.get("datetime", _text(e)).strip()
            kind = next((n for rx, n in TIMES if re.fullmatch(rx, text)), None)
            return text, LITERAL, XSD + kind if kind else None, None if kind else ctx["lang"]
        if "rel" not in at and "rev" not in at and link is not None:
            found = self.link(at, ctx)
            return found, BNODE if found.startswith("_:") else IRI, None, None
        if typed and "about" not in at:
            return typed, BNODE if typed.startswith("_:") else IRI, None, None
        return _text(e), LITERAL, None, ctx["lang"]

    def patterns(self) -> list[tuple]:
        """rdfa:copy: what a pattern says is said of those that copy it; used patterns fall away."""
        copy, kind, pattern = INITIAL["rdfa"] + "copy", RDF + "type", INITIAL["rdfa"] + "Pattern"
        of = {r[0] for r in self.out if r[1] == kind and r[2] == pattern}
        rows, used, new = list(self.out), set(), True
        while new:
            new = []
            for s, p, o, *_ in rows:
                if p == copy and o in of:
                    used.add(o)
                    new += [(s, *r[1:]) for r in rows if r[0] == o and not (r[1] == kind and r[2] == pattern)]
            new = [r for r in dict.fromkeys(new) if r not in rows]
            rows += new
        return [r for r in rows if not (r[1] == copy and r[2] in used) and r[0] not in used]


def parse_documents(docs: DataFrame, base: str | None = None, graph: str | None = None) -> DataFrame:
    """Quads of documents (path, text), a document a unit of work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch["path"], batch["text"]):
                out += [(*r, path, None) for r in Extractor(base or path, graph or DEFAULT_GRAPH, f"_:g{hash_of(path)}n").run(content or "")]
                if len(out) > FLUSH:
                    yield as_frame(out)
                    out = []
            yield as_frame(out)

    ship(docs.sparkSession)
    return docs.select("path", "text").mapInPandas(run, SCHEMA)
