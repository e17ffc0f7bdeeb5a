"""Turtle and TriG, parsed a document at a time within tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quadrel.storage import ship
from quadrel.schema import BNODE, DEFAULT_GRAPH, IRI, LITERAL, RDF, XSD

# The terminals of the grammar.
_PN_CHARS = r"\w\-·̀-ͯ‿-⁀"
_LOCAL = rf"(?:[{_PN_CHARS}:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%])"
TERMINALS = [
    ("space", r"[ \t\r\n]+|#[^\r\n]*"), ("iri", r"<(?:[^\x00-\x20<>\"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"),
    ("string", r'"""(?:(?:"|"")?(?:[^"\\]|\\.))*"""|' + r"'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|" + r'"(?:[^"\\\r\n]|\\.)*"|' + r"'(?:[^'\\\r\n]|\\.)*'"),
    ("bnode", rf"_:[\w](?:[{_PN_CHARS}.]*[{_PN_CHARS}])?"), ("directive", r"@(?:prefix|base)\b"), ("lang", r"@[A-Za-z]+(?:-[A-Za-z0-9]+)*"),
    ("number", r"[+-]?(?:[0-9]+\.[0-9]*[eE][+-]?[0-9]+|\.?[0-9]+[eE][+-]?[0-9]+|[0-9]*\.[0-9]+|[0-9]+)(?![\w:])"),
    ("name", rf"(?:[^\W\d_](?:[{_PN_CHARS}.]*[{_PN_CHARS}])?)?:(?:[\w:]|%[0-9A-Fa-f]{{2}}|\\[_~.\-!$&'()*+,;=/?#@%])?(?:(?:{_LOCAL}|\.)*{_LOCAL})?"),
    ("word", r"[A-Za-z]+"), ("mark", r"\^\^|[.;,\[\](){}]"),
]
_SCAN = re.compile("|".join(f"(?P<{n}>{p})" for n, p in TERMINALS), re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_ECHAR = dict(zip("tbnrf\"'\\", "\t\b\n\r\f\"'\\"))


class TurtleError(ValueError):
    """A document that isn't Turtle or TriG; tells the line."""


def _plain(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] or m[2]:
            return chr(int(m[1] or m[2], 16))
        if m[3] not in _ECHAR:
            raise TurtleError(f"unknown escape \\{m[3]}")
        return _ECHAR[m[3]]

    return _ESCAPE.sub(one, text) if "\\" in text else text


class Parser:
    """Statements of a document: (s, p, o, kind, datatype, language, graph, line)."""

    def __init__(self, text: str, base: str = "", graph: str = DEFAULT_GRAPH, anon_prefix: str = "_:genid", prefixes: dict[str, str] | None = None, on_error: str = "error") -> None:
        self.text, self.base, self.graph, self.default, self.anon = text, base, graph, graph, anon_prefix
        self.prefixes, self.on_error, self.errors = dict(prefixes or {}), on_error, []
        self.out: list[tuple] = []
        self.count, self.labels = 0, {}
        self.pos, self.line = 0, 1
        self.kind = self.value = ""
        self.at_line, self.begin = 1, 0

    # Reading of terminals.

    def next(self) -> None:
        while self.pos < len(self.text):
            m = _SCAN.match(self.text, self.pos)
            if not m:
                self.at_line, self.begin = self.line, self.pos
                raise TurtleError(f"line {self.line}: unexpected {self.text[self.pos:self.pos + 10]!r}")
            start, self.pos, here = self.pos, m.end(), self.line
            self.line += m[0].count("\n")
            if m.lastgroup != "space":
                self.kind, self.value, self.at_line, self.begin = m.lastgroup, m[0], here, start
                return
        self.kind, self.value, self.at_line = "end", "", self.line

    def need(self, mark: str) -> None:
        if self.kind != "mark" or self.value != mark:
            raise TurtleError(f"line {self.at_line}: {mark} expected, not {self.value!r}")
        self.next()

    def at(self, mark: str) -> bool:
        return self.kind == "mark" and self.value == mark

    # Statements.

    def parse(self) -> list[tuple]:
        try:
            self.next()
        except TurtleError as e:
            self.recover(e)
        while self.kind != "end":
            try:
                self.statement()
            except TurtleError as e:
                self.recover(e)
        return self.out

    def recover(self, error: TurtleError) -> None:
        """With on_error ``warning`` the error is noted and reading goes on behind the next dot that ends a line."""
        if self.on_error == "error":
            raise error
        self.errors.append((self.at_line, str(error)))
        m = re.compile(r"\.[ \t]*(?:#[^\n]*)?(?:\r?\n|$)").search(self.text, self.begin)
        self.line = self.at_line + self.text.count("\n", self.begin, m.end() if m else len(self.text))
        self.pos = m.end() if m else len(self.text)
        self.graph = self.default
        try:
            self.next()
        except TurtleError as e:
            self.recover(e)

    def statement(self) -> None:
        if self.kind == "directive" or (self.kind == "word" and self.value.upper() in ("PREFIX", "BASE")):
            return self.directive()
        if self.kind == "word" and self.value.upper() == "GRAPH":
            self.next()
            return self.block(self.name())
        if self.at("{"):
            return self.block(self.default)
        if self.kind in ("iri", "name", "bnode") or self.at("["):
            listed = self.at("[")
            s, used = self.subject()
            if self.at("{") and not used:
                return self.block(s)
            self.predicates(s, optional=used and listed)
        else:
            self.predicates(self.subject()[0], optional=False)
        return self.need(".")

    def block(self, graph: str) -> None:
        self.need("{")
        self.graph = graph
        while not self.at("}"):
            if self.at("{") or self.kind == "end":
                raise TurtleError(f"line {self.at_line}: graph within a graph or not closed")
            try:
                listed = self.at("[")
                s, used = self.subject()
                self.predicates(s, optional=used and listed)
                if not self.at("}"):
                    self.need(".")
            except TurtleError as e:  # the block goes on behind the fault
                self.recover(e)
                self.graph = graph
        self.graph = self.default
        self.next()
        if self.at("."):
            self.next()

    def directive(self) -> None:
        dotted, word = self.kind == "directive", self.value.lstrip("@").lower()
        self.next()
        if word == "prefix":
            if self.kind != "name" or not self.value.endswith(":"):
                raise TurtleError(f"line {self.at_line}: prefix expected")
            prefix = self.value[:-1]
            self.next()
            self.prefixes[prefix] = self.iri()
        else:
            self.base = self.iri()
        if dotted:
            self.need(".")

    # Terms.

    def iri(self) -> str:
        if self.kind != "iri":
            raise TurtleError(f"line {self.at_line}: IRI expected, not {self.value!r}")
        found = _plain(self.value[1:-1])
        self.next()
        if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", found):
            return found
        return urljoin(self.base, found) if found else self.base

    def name(self) -> str:
        if self.kind == "iri":
            return self.iri()
        if self.kind == "bnode":
            label = self.value[2:]
            self.next()
            return self.labels.setdefault(label, f"{self.anon}_{label}")
        if self.kind != "name":
            raise TurtleError(f"line {self.at_line}: name expected, not {self.value!r}")
        prefix, local = self.value.split(":", 1)
        if prefix not in self.prefixes:
            raise TurtleError(f"line {self.at_line}: unknown prefix {prefix!r}")
        self.next()
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def fresh(self) -> str:
        self.count += 1
        return f"{self.anon}{self.count}"

    def subject(self) -> tuple[str, bool]:
        """The subject, and whether it brought statements of its own."""
        if self.at("["):
            return self.bracketed()
        if self.at("("):
            return self.collection(), True
        return self.name(), False

    def bracketed(self) -> tuple[str, bool]:
        self.need("[")
        node = self.fresh()
        used = not self.at("]")
        if used:
            self.predicates(node, optional=False)
        self.need("]")
        return node, used

    def collection(self) -> str:
        self.need("(")
        items = []
        while not self.at(")"):
            items.append(self.object())
        self.next()
        cells = [self.fresh() for _ in items]
        for i, (cell, item) in enumerate(zip(cells, items)):
            self.give(cell, RDF + "first", item)
            rest = cells[i + 1] if i + 1 < len(cells) else RDF + "nil"
            self.give(cell, RDF + "rest", (rest, BNODE if i + 1 < len(cells) else IRI, None, None))
        return cells[0] if cells else RDF + "nil"

    def give(self, s: str, p: str, o: tuple) -> None:
        self.out.append((s, p, *o, self.graph, self.at_line))

    def predicates(self, s: str, optional: bool) -> None:
        if optional and (self.at(".") or self.at("}")):
            return
        while True:
            if self.kind == "word" and self.value == "a":
                self.next()
                p = RDF + "type"
            elif self.kind == "bnode":
                raise TurtleError(f"line {self.at_line}: a blank node is no predicate")
            else:
                p = self.name()
            while True:
                self.give(s, p, self.object())
                if not self.at(","):
                    break
                self.next()
            if not self.at(";"):
                return
            while self.at(";"):
                self.next()
            if self.at(".") or self.at("]") or self.at("}"):
                return

    def object(self) -> tuple:
        if self.at("["):
            return self.bracketed()[0], BNODE, None, None
        if self.at("("):
            head = self.collection()
            return head, BNODE if head != RDF + "nil" else IRI, None, None
        if self.kind == "string":
            return self.string()
        if self.kind == "number":
            v = self.value
            self.next()
            kind = "double" if "e" in v.lower() else "decimal" if "." in v else "integer"
            return v, LITERAL, XSD + kind, None
        if self.kind == "word" and self.value in ("true", "false"):
            v = self.value
            self.next()
            return v, LITERAL, XSD + "boolean", None
        node = self.name()
        return node, BNODE if node.startswith("_:") else IRI, None, None

    def string(self) -> tuple:
        n = 3 if self.value.startswith(('"""', "'''")) else 1
        text = _plain(self.value[n:-n])
        self.next()
        if self.kind == "lang":
            tag = self.value[1:].lower()
            self.next()
            return text, LITERAL, None, tag
        if self.at("^^"):
            self.next()
            return text, LITERAL, self.name(), None
        return text, LITERAL, None, None


SCHEMA = "s string, p string, o string, o_kind tinyint, o_dt string, o_lang string, g string, line int, source string, error string"


#: Statements that a task gives out at once.
FLUSH = 20_000


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")]).astype({"o_kind": "Int8", "line": "Int32"})


def _parse_all(base: str | None, graph: str | None, on_error: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch["path"], batch["text"]):
                parser = Parser(content or "", base or path, graph or DEFAULT_GRAPH, f"_:g{hash_of(path)}n", on_error=on_error)
                out += [(*r, path, None) for r in parser.parse()] + [(*[None] * 7, n, path, e) for n, e in parser.errors]
                if len(out) > FLUSH:
                    yield as_frame(out)
                    out = []
            yield as_frame(out)

    return run


def hash_of(text: str) -> str:
    """128 bits in hexadecimal digits, so that two paths with the same hash needn't be expected."""
    import hashlib

    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def parse_documents(docs: DataFrame, base: str | None = None, graph: str | None = None, on_error: str = "error") -> DataFrame:
    """Quads of documents (path, text), a document a unit of work: s, p, o, o_kind, o_dt, o_lang, g, line, source, error. Blank nodes are told
    apart by path. With on_error ``warning`` faults are rows with ``error`` set."""
    ship(docs.sparkSession)
    return docs.select("path", "text").mapInPandas(_parse_all(base, graph, on_error), SCHEMA)


def read(spark: SparkSession, path: str, base: str | None = None, graph: str | None = None, on_error: str = "error") -> DataFrame:
    """Turtle or TriG files (gzip too); statements outside graphs go to ``graph``."""
    from pyspark.sql import functions as F

    return parse_documents(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")), base, graph, on_error)
