"""Mixing sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_GRID = 1 << 12


def water_fill(weights: dict[str, float], sizes: dict[str, float], caps: dict[str, float], total: float | None = None) -> dict[str, float]:
    """The size each source gives: in proportion to its weight, never above size times cap.

    Sources that would exceed their greatest size are clamped there, and what they can't give is shared by the others in
    proportion to their weights, until all fit. Without ``total`` it is the greatest at which no source that has any
    text is clamped, so that their shares are met exactly; a source without text gives nothing and its weight is shared.
    """
    most = {s: max(0.0, sizes.get(s, 0.0)) * max(0.0, caps.get(s, 0.0)) for s in weights}
    free = {s for s in weights if most[s] > 0 and weights[s] > 0}
    if not free:
        return dict.fromkeys(weights, 0.0)
    if total is None:
        total = min(most[s] / weights[s] for s in free) * sum(weights[s] for s in free)
    given, left = dict.fromkeys(weights, 0.0), float(total)
    while free:
        weight = sum(weights[s] for s in free)
        over = {s for s in free if weights[s] / weight * left > most[s] * (1 + 1e-12)}
        if not over:
            for s in free:
                given[s] = weights[s] / weight * left
            break
        for s in over:
            given[s] = most[s]
        left -= sum(most[s] for s in over)
        free -= over
    return given


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, record: str = "doc_id", source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Records with ``repeats`` >= 1: doc_id, source, n_tokens, repeats.

    ``targets`` (source, target_share, max_repeats) is the list of sources, one row each; its size is that of a list of names,
    so it and the sizes per source are read by the driver. A source gets the repetitions r = given / size (``water_fill``): each record
    floor(r) times, and one time more the records that come first in a seeded hash order, up to the one at which the size asked
    for is reached. That record is found from sums over a fixed grid of hash values per source and then among the records of one
    grid cell, so no source is sorted or held by one task.

    Records whose source is null or no target are left out, as are targets with a null or negative share or cap. Records of size
    null or 0 count as size 0. Repeated rows are records of their own; equal hash values are ordered by record. Empty in, empty out.
    """
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).collect()
    weights = {r["source"]: max(0.0, r["w"] or 0.0) for r in rows}
    caps = {r["source"]: float(max(0, r["m"] or 0)) for r in rows}
    names = sorted(weights)
    part = sized.where(F.col(source).isin(names)).select(
        F.col(record).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n_tokens"),
        F.pmod(F.xxhash64(F.col(record), F.lit(seed)), F.lit(1 << 40)).alias("u"))
    part = part.withColumn("cell", F.floor(F.col("u") / F.lit((1 << 40) // _GRID)).cast("int"))
    cells = part.groupBy("source", "cell").agg(F.sum("n_tokens").alias("cell_tokens")).collect()  # at most _GRID a source
    sizes: dict[str, float] = {}
    for c in cells:
        sizes[c["source"]] = sizes.get(c["source"], 0.0) + c["cell_tokens"]
    given = water_fill(weights, sizes, caps, total)
    plan = []
    for s in names:
        if sizes.get(s, 0) <= 0:
            continue
        whole = int(given[s] / sizes[s] + 1e-12)
        extra, before, edge = given[s] - whole * sizes[s], 0.0, _GRID
        for c in sorted((c for c in cells if c["source"] == s), key=lambda c: c["cell"]):
            if before + c["cell_tokens"] > extra + 1e-6:
                edge = c["cell"]
                break
            before += c["cell_tokens"]
        plan.append((s, whole, int(edge), float(extra - before), int(whole < caps[s])))
    spark = sized.sparkSession
    rule = F.broadcast(spark.createDataFrame(plan, "source string, whole int, edge int, rest double, more int"))  # a row a source
    ruled = part.join(rule, "source")
    inner = ruled.where("cell <> edge").withColumn("extra", ((F.col("cell") < F.col("edge")) & (F.col("more") == 1)).cast("int"))
    order = Window.partitionBy("source", "cell").orderBy("u", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n_tokens").over(order)
    # The record that crosses the limit is taken if that comes nearer to it than leaving it.
    edge = ruled.where("cell = edge").withColumn("extra", ((upto - F.col("n_tokens") / 2 <= F.col("rest")) & (F.col("more") == 1)).cast("int"))
    both = inner.unionByName(edge).withColumn("repeats", F.col("whole") + F.col("extra"))
    return both.where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: source, target_share, max_repeats, n_docs, tokens (with repetitions), share (actual, of all tokens)."""
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    all_tokens = got.agg(F.sum("tokens")).collect()[0][0] or 0
    rows = targets.select("source", "target_share", "max_repeats").join(got, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    return rows.select("source", "target_share", "max_repeats", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), tokens.alias("tokens"), (tokens / F.lit(float(max(all_tokens, 1)))).alias("share"))
