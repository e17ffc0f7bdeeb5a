"""Attribute-value rows into one row per entity with typed columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.functions.lexical import cut, typed, valid


def wide_table(rows: DataFrame, attributes: Mapping[str, tuple[str, str]], entity: str, attribute: str, value: str, order: list[str], source: str | None = None, long_integers: bool = False) -> DataFrame:
    """One row per entity that has a row of any of the attributes: ``entity`` and a typed column per attribute.

    ``attributes``: name of the attribute -> (column, type as in ``functions.lexical.typed``). Of several valid values of a
    cell the one greatest by ``order`` counts (nulls are least). With ``source`` there is a column ``<column>__source`` too, the
    source column of the row that gives the value. An integer column is DECIMAL(38,0), the widest there is; with ``long_integers`` each has a text column
    ``<column>__long`` beside it with the canonical digits of a value that needs more, so no valid value is lost.

    Values are reduced to one per cell by a max that is combined before the shuffle, so a hot entity or attribute is no
    burden; then the entity-by-attribute grid is completed (each entity explodes the short list of attributes), values are
    joined to it, cells are collected per entity sorted by attribute position and projected by fixed index through the
    type's cast. An entity's array has one element per attribute, never more.

    Rows with a null entity or attribute are left out; invalid and null values are no values (the entity stays). Ties in
    ``order`` go to the greatest value text. Repeated rows change nothing; empty in, empty out.
    """
    names = list(attributes)
    position = F.create_map(*[x for i, a in enumerate(names) for x in (F.lit(a), F.lit(i))])
    text = cut(F.col(value))
    right = F.lit(False)
    for a, (_, kind) in attributes.items():
        right = F.when(F.col(attribute) == a, valid(text, kind)).otherwise(right)
    known = rows.where(F.col(attribute).isin(names) & F.col(entity).isNotNull()).select(
        F.col(entity).alias("_entity"), position[F.col(attribute)].alias("_pos"),
        F.when(right, F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], text.alias("text"), (F.col(source) if source else F.lit(None)).alias("source"))).alias("_v"),
    )
    cells = known.groupBy("_entity", "_pos").agg(F.max("_v").alias("_v"))
    grid = cells.select("_entity").distinct().select("_entity", F.explode(F.array(*[F.lit(i) for i in range(len(names))])).alias("_pos"))
    full = grid.join(cells, ["_entity", "_pos"], "left")
    arrays = full.groupBy("_entity").agg(F.sort_array(F.collect_list(F.struct("_pos", "_v.text", "_v.source"))).alias("_c"))
    out = [F.col("_entity").alias(entity)]
    for i, (column, kind) in enumerate(attributes.values()):
        cell = F.col("_c")[i]
        out.append(typed(cell["text"], kind).alias(column))
        if long_integers and kind == "integer":
            digits = F.regexp_replace(F.regexp_replace(cell["text"], r"^\+", ""), r"^(-?)0+(?=[0-9])", "$1")
            out.append(F.when(typed(cell["text"], kind).isNull(), digits).alias(f"{column}__long"))
        if source:
            out.append(F.when(typed(cell["text"], kind).isNotNull() if kind != "integer" else cell["text"].isNotNull(), cell["source"]).alias(f"{column}__source"))
    return arrays.select(*out)


def cells_of(wide: DataFrame, attributes: Mapping[str, tuple[str, str]], entity: str) -> DataFrame:
    """The cells that aren't null of a ``wide_table`` with sources: entity, attribute, source."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"{c}__source").alias("source")) for a, (c, _) in attributes.items()])
    return wide.select(entity, F.explode(pairs).alias("_p")).select(entity, "_p.attribute", "_p.source").where("source is not null")
