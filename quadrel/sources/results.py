"""Result tables of remote query services, in JSON and XML: a row per solution, unbound variables null."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.storage import ship

_TERM = "struct<type:string,value:string,datatype:string,`xml:lang`:string>"
_NS = "{http://www.w3.org/2005/sparql-results#}"


def read_json(docs: DataFrame, variables: list[str], text: str = "text") -> DataFrame:
    """Columns per variable: its text, <v>_kind (0 IRI, 1 blank node, 2 literal), <v>_dt, <v>_lang; parsed by column expressions."""
    fields = ",".join(f"`{v}`:{_TERM}" for v in variables)
    parsed = docs.select(F.explode(F.from_json(F.col(text), f"struct<results:struct<bindings:array<struct<{fields}>>>>")["results"]["bindings"]).alias("b"))
    cols = []
    for v in variables:
        t = F.col("b")[v]
        kind = F.when(t["type"] == "uri", 0).when(t["type"] == "bnode", 1).when(t["type"].isin("literal", "typed-literal"), 2)
        cols += [F.when(kind == 1, F.concat(F.lit("_:"), t["value"])).otherwise(t["value"]).alias(v), kind.cast("tinyint").alias(f"{v}_kind"), t["datatype"].alias(f"{v}_dt"), F.lower(t["xml:lang"]).alias(f"{v}_lang")]
    return parsed.select(*cols)


def json_boolean(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.from_json(F.col(text), "struct<boolean:boolean>")["boolean"].alias("boolean"))


def read_xml(docs: DataFrame, variables: list[str], text: str = "text") -> DataFrame:
    """As ``read_json``, of XML documents."""
    schema = ", ".join(f"`{v}` string, `{v}_kind` tinyint, `{v}_dt` string, `{v}_lang` string" for v in variables)
    names = [n for v in variables for n in (v, f"{v}_kind", f"{v}_dt", f"{v}_lang")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc in batch["text"].dropna():
                for result in ET.fromstring(doc).iter(_NS + "result"):
                    row = dict.fromkeys(names)
                    for b in result:
                        v, term = b.get("name"), b[0]
                        if v not in variables:
                            continue
                        kind = {"uri": 0, "bnode": 1}.get(term.tag.removeprefix(_NS), 2)
                        lang = term.get("{http://www.w3.org/XML/1998/namespace}lang")
                        row |= {v: ("_:" if kind == 1 else "") + (term.text or ""), f"{v}_kind": kind, f"{v}_dt": term.get("datatype"), f"{v}_lang": lang.lower() if lang else None}
                    rows.append(row)
            yield pd.DataFrame(rows, columns=names).astype({f"{v}_kind": "Int8" for v in variables})

    ship(docs.sparkSession)
    return docs.select(F.col(text).alias("text")).mapInPandas(run, schema)


def request(server: str, query: str, **parameters: str) -> str:
    """The address that asks a server; nothing is sent."""
    from urllib.parse import urlencode

    return f"{server}{'&' if '?' in server else '?'}{urlencode({'query': query, **parameters})}"
