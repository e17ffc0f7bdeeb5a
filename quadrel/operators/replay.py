"""Replay of a change feed of inserts, updates and deletes into the state it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrel.skew import hot_keys, lookup_join
from quadrel.storage import materialize

FIELDS = ("subject", "predicate", "object")


def clean_feed(feed: DataFrame) -> DataFrame:
    """The entry that holds of each (graph, seq): of several deliveries one with the highest attempt. Rows without a
    graph or seq can't be placed and are left out; action and field names lose outer blanks and letter case."""
    norm = lambda c: F.lower(F.trim(F.col(c)))
    entry = F.struct("attempt", norm("action").alias("action"), "line", *FIELDS, norm("upd_field").alias("upd_field"), "upd_value")
    held = feed.where("graph is not null and seq is not null").groupBy("graph", "seq").agg(F.max(entry).alias("e"))
    return held.select("graph", "seq", "e.*").drop("attempt")


#: Sequence numbers of a block: depths are summed within blocks and over blocks, so that a hot graph is spread.
BLOCK = 1 << 16


def _contiguous(entries: DataFrame, first_seq: int) -> DataFrame:
    """Per graph the last seq up to which all have come (``whole``), counted from ``first_seq``; what is numbered below that counts as come. A gap is
    found by an equi-join on (graph, seq + 1), not by a window over the graph, so a hot graph is spread."""
    seqs = entries.select("graph", "seq")
    start = entries.groupBy("graph").agg(F.lit(first_seq - 1).cast("bigint").alias("seq"))
    follow = seqs.select("graph", (F.col("seq") - 1).alias("seq"))
    breaks = seqs.where(F.col("seq") >= first_seq).unionByName(start).join(follow, ["graph", "seq"], "left_anti")
    return breaks.groupBy("graph").agg(F.min("seq").alias("whole"))


def _depths(marks: DataFrame) -> DataFrame:
    """``marks`` (graph, seq, action: begin, end or close) with ``depth``, the number of transactions open after each. An end without a begin
    changes nothing, a close ends all. Sums and least sums within blocks of seq, then over a graph's blocks, of which a
    task holds one row each."""
    delta = F.when(F.col("action") == "begin", 1).when(F.col("action") == "end", -1).otherwise(0)
    rows = marks.withColumn("block", F.floor(F.col("seq") / BLOCK)).withColumn("delta", delta)
    inside = Window.partitionBy("graph", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("sum", F.sum("delta").over(inside)).withColumn("low", F.min("sum").over(inside))
    blocks = summed.groupBy("graph", "block").agg(F.sum("delta").alias("total"), F.min("low").alias("least"))
    over = Window.partitionBy("graph").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("total").over(over), F.lit(0)))
    blocks = blocks.withColumn("floor", F.coalesce(F.min(F.col("before") + F.col("least")).over(over), F.lit(0))).select("graph", "block", "before", "floor")
    open_now = F.col("before") + F.col("sum") - F.least(F.lit(0), F.col("floor"), F.col("before") + F.col("low"))
    return summed.join(blocks, ["graph", "block"]).select("graph", "seq", "action", F.when(F.col("action") == "close", 0).otherwise(open_now).alias("depth"))


def watermark(entries: DataFrame, first_seq: int = 1, closed: bool = False, hot: list | None = None) -> DataFrame:
    """Per graph the last seq that may be shown (``shown``): all before it has come, and no transaction is open there.

    Transactions are assembled from their begins and ends with the depth of nesting as a running sum; one is complete where the
    depth is 0 again, and if one is open at the last seq without a gap, what is shown ends before its outermost begin. A graph's numbers start at
    ``first_seq``; if that hasn't come, nothing of the graph is shown. ``closed`` sets an end mark behind each graph's last entry:
    nothing will come any more, so gaps are void and what is open is closed by the mark. ``hot``: graphs known to hold many entries."""
    whole = entries.groupBy("graph").agg(F.max("seq").alias("whole")) if closed else _contiguous(entries, first_seq)
    marks = lookup_join(entries.where("action in ('begin', 'end')").select("graph", "seq", "action"), whole, "graph", "inner", hot=hot).where("seq <= whole").drop("whole")
    if closed:
        marks = marks.unionByName(whole.select("graph", (F.col("whole") + 1).alias("seq"), F.lit("close").alias("action")))
    last = _depths(marks).groupBy("graph").agg(
        F.max_by("depth", "seq").alias("open"), F.max(F.when((F.col("action") == "begin") & (F.col("depth") == 1), F.col("seq"))).alias("begun"))
    return whole.join(last, "graph", "left").select("graph", F.when(F.col("open") > 0, F.col("begun") - 1).otherwise(F.col("whole")).alias("shown"))


def replay(feed: DataFrame, at_end: bool = False, first_seq: int = 1) -> DataFrame:
    """The statements there after the feed: graph, line, subject, predicate, object.

    Commit-ordered transactional replay. Deliveries are reduced to one entry per (graph, seq), written once; the state shows what
    lies up to the contiguous committed ``watermark`` of each graph: entries behind a gap in seq, or in a transaction that isn't
    complete, are held. ``at_end`` says that the feed is over: an end mark is set behind it, which voids gaps and closes what
    is open, and all entries pass the watermark. Keys (graph, line) don't conflict and are folded in
    parallel: the last unload of a graph voids what came before; of a key, the last assert must come after the last
    retract; each field has the value of the latest assert or update of that field. All three are maxima of
    (seq, value), so the fold is combined before the shuffle and needs no order within a task.

    Nulls: rows without graph or seq are left out; a null line is a line of its own; unknown actions change nothing. Ties
    (equal attempt) are alike by contract, else the greatest entry is taken. Repeated rows change nothing. Empty in, empty out.
    """
    entries = materialize(clean_feed(feed))
    hot = hot_keys(entries, "graph")
    entries = lookup_join(entries, watermark(entries, first_seq, at_end, hot), "graph", "inner", hot=hot).where("seq <= shown").drop("shown")
    wiped = entries.where("action = 'unload'").groupBy("graph").agg(F.max("seq").alias("wiped"))
    kept = lookup_join(entries.where("action in ('assert', 'retract', 'update')"), wiped, "graph", hot=hot).where("wiped is null or seq > wiped")
    put, upd = F.col("action") == "assert", F.col("action") == "update"

    def latest(field: str) -> Column:
        value = F.when(put, F.struct("seq", F.col(field).alias("v"))).when(upd & (F.col("upd_field") == field), F.struct("seq", F.col("upd_value").alias("v")))
        return F.max(value).alias(field)

    keys = kept.groupBy("graph", "line").agg(F.max(F.when(put, F.col("seq"))).alias("put"), F.max(F.when(F.col("action") == "retract", F.col("seq"))).alias("gone"), *[latest(f) for f in FIELDS])
    return keys.where("put is not null and (gone is null or put > gone)").select("graph", "line", *[F.col(f"{f}.v").alias(f) for f in FIELDS])
