"""The general data operators against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quadrel import skew
from quadrel.operators.hierarchy import descendants, hierarchy
from quadrel.operators.line_check import error_counts, read_loads
from quadrel.operators.replay import clean_feed, replay, watermark
from quadrel.operators.tree_aggregate import heavy_keys, tree_statistics
from quadrel.operators.wide import cells_of, wide_table


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_tree_statistics_matches_brute_force(spark):
    rng = random.Random(1)
    data = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice(["g", None]), rng.choice([*map(str, range(9)), None]), str(rng.randrange(30)), 1) for _ in range(400)]
    df = spark.createDataFrame(data, "p string, g string, s string, o string, n_rows int")
    got = tree_statistics(df, {"p": F.col("p"), "g": F.col("g")}, {"s": F.col("s"), "o": F.col("o")}, leaves=16, fan_in=4)
    want = []
    for field, i in (("p", 0), ("g", 1)):
        for key in {d[i] for d in data}:
            part = [d for d in data if d[i] == key]
            want.append((field, key, len(part), len({d[2] for d in part} - {None}), len({d[3] for d in part})))
    assert rows(got) == sorted(want, key=repr)
    assert {(r["field_name"], r["key_value"]) for r in heavy_keys(got, 0.5, 400).collect()} == {(f, k) for f, k, n, *_ in want if k is not None and n >= 200}
    assert tree_statistics(df.limit(0), {"p": F.col("p")}, {"s": F.col("s")}).count() == 0


def brute_tree(links):
    up = {}
    for c, p in links:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    nodes = {x for link in links if None not in link for x in link}
    out = {}
    for n in nodes:
        seen, x = [n], n
        while x in up and up[x] not in seen:
            x = up[x]
            seen.append(x)
        if x not in up:
            out[n] = (x, len(seen) - 1, seen[::-1])
        else:
            loop = seen[seen.index(up[x]):]
            out[n] = (min(loop), -1 if n in loop else -2, None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchy_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(f"n{i}", f"n{rng.randrange(60) if rng.random() < 0.15 else rng.randrange(i)}") for i in range(1, 60)]
    links += [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("y", "x2"), ("z", "z"), ("w", "z"), ("x1", "x2"), (None, "n1"), ("n5", None)]
    links += [(f"c{i}", f"c{i + 1}") for i in range(37 + 60 * (seed == 2))] + [(f"e{i}", f"c{rng.randrange(37)}") for i in range(20)]
    links += [(f"l{i}", f"l{(i + 1) % 45}") for i in range(45 * (seed == 3))] + [(f"t{i}", f"t{i + 1}" if i < 20 else "l7") for i in range(21 * (seed == 3))]
    df = spark.createDataFrame([(*x, "extra") for x in links], "child string, parent string, node string")
    got = hierarchy(df)
    assert {r["node"]: (r["root"], r["depth"], r["path"]) for r in got.collect()} == brute_tree(links)
    below = {(r["node"], r["descendant"], r["distance"]) for r in descendants(got).collect()}
    assert below == {(a, n, len(p) - 1 - i) for n, (_, _, p) in brute_tree(links).items() if p for i, a in enumerate(p[:-1])}


def test_hierarchy_with_hot_parents_and_empty(spark, monkeypatch):
    monkeypatch.setattr(skew, "MIN_HOT", 5)
    links = [(f"k{i}", "hub") for i in range(40)] + [("hub", "root")] + [(f"d{i}", "c19") for i in range(30)] + [(f"c{i}", f"c{i - 1}") for i in range(1, 20)]
    got = hierarchy(spark.createDataFrame(links, "child string, parent string"), with_path=False)
    assert {r["node"]: (r["root"], r["depth"]) for r in got.collect()} == {n: v[:2] for n, v in brute_tree(links).items()}
    got = hierarchy(spark.createDataFrame(links, "child string, parent string"))
    assert {r["node"]: (r["root"], r["depth"], r["path"]) for r in got.collect()} == brute_tree(links)
    assert hierarchy(spark.createDataFrame([], "child string, parent string")).count() == 0


FEED = "graph string, seq long, attempt int, action string, line int, subject string, predicate string, object string, upd_field string, upd_value string, e string"


def brute_replay(feed, limit=None):
    held = {}
    for r in feed:
        if r[0] is not None and r[1] is not None and (r[:2] not in held or (r[2] or 0) > (held[r[:2]][2] or 0)):
            held[r[:2]] = r
    state = {}
    for (g, seq), r in sorted(held.items()):
        if limit is not None and seq > limit.get(g, -1):
            continue
        action, key = r[3].strip().lower(), (g, r[4])
        if action == "assert":
            state[key] = list(r[5:8])
        elif action == "retract":
            state.pop(key, None)
        elif action == "update" and key in state:
            state[key][("subject", "predicate", "object").index(r[8])] = r[9]
        elif action == "unload":
            state = {k: v for k, v in state.items() if k[0] != g}
    return sorted(((*k, *v) for k, v in state.items()), key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    feed = []
    for seq in range(300):
        action = rng.choice(["assert", " Assert", "retract", "update", "update ", "UPDATE", "begin", "end"] + ["unload"] * (rng.random() < 0.1))
        entry = (rng.choice(["g1", "g1", "g2"]), seq, 1, action, rng.choice([1, 2, 3, None]), f"s{seq}", "p", None if rng.random() < 0.1 else f"o{seq}", rng.choice(["subject", "predicate", "object"]), rng.choice([f"u{seq}", None]), "x")
        feed.append(entry)
        if rng.random() < 0.2:
            feed += [entry, entry]
        if rng.random() < 0.1:
            feed.append((*entry[:2], 2, "retract", *entry[4:]))
    feed.append((None, 5, 1, "assert", 1, "s", "p", "o", None, None, "x"))
    rng.shuffle(feed)
    df = spark.createDataFrame(feed, FEED)
    assert rows(replay(df, at_end=True)) == brute_replay(feed)
    assert replay(df.limit(0), at_end=True).count() == 0


def test_replay_holds_gaps_and_open_transactions(spark):
    a = lambda g, seq, action, line=None, s=None: (g, seq, 1, action, line, s, "p", "o", None, None, "x")
    feed = [a("gap", 1, "assert", 1, "a"), a("gap", 2, "assert", 2, "b"), a("gap", 4, "retract", 1), a("open", 1, "begin"), a("open", 2, "assert", 1, "a"), a("open", 3, "end"), a("open", 4, "begin"), a("open", 5, "retract", 1)]
    feed += [a("late", 5, "assert", 1, "a"), a("late", 6, "assert", 2, "b")]
    feed += [a("nest", 1, "begin"), a("nest", 2, "assert", 1, "a"), a("nest", 3, "begin"), a("nest", 4, "assert", 2, "b"), a("nest", 5, "end"), a("nest", 6, "assert", 3, "c")]
    feed += [a("stray", 1, "end"), a("stray", 2, "begin"), a("stray", 3, "assert", 1, "a"), a("stray", 4, "end"), a("stray", 5, "assert", 2, "b")]
    df = spark.createDataFrame(feed, FEED)
    got = rows(replay(df).select("graph", "line", "subject"))
    assert got == [("gap", 1, "a"), ("gap", 2, "b"), ("open", 1, "a"), ("stray", 1, "a"), ("stray", 2, "b")]
    assert {(r["graph"], r["line"]) for r in replay(df, first_seq=5).collect()} >= {("late", 1), ("late", 2)}
    ended = rows(replay(df, at_end=True).select("graph", "line", "subject"))
    assert ended == [("gap", 2, "b"), ("late", 1, "a"), ("late", 2, "b"), ("nest", 1, "a"), ("nest", 2, "b"), ("nest", 3, "c"), ("stray", 1, "a"), ("stray", 2, "b")]


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_watermark_matches_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr("quadrel.operators.replay.BLOCK", 7)
    monkeypatch.setattr(skew, "MIN_HOT", 20)
    rng = random.Random(seed)
    feed, limit = [], {}
    for g in ("a", "b", "c", "d", "e"):
        depth, shown, whole = 0, 0, True
        skip = {rng.randrange(1, 120) for _ in range(rng.randrange(2))}
        for seq in range(1, 100):
            action = rng.choices(["begin", "end", "assert", "update"], [2, 2.2, 5, 1])[0]
            whole = whole and seq not in skip
            if seq not in skip:
                feed.append((g, seq, 1, action, rng.randrange(9), f"s{seq}", "p", "o", "subject", f"u{seq}", "x"))
            depth = depth + 1 if action == "begin" else max(0, depth - 1) if action == "end" else depth
            if whole and depth == 0:
                shown = seq
        limit[g] = shown
    rng.shuffle(feed)
    df = spark.createDataFrame(feed, FEED)
    assert {r["graph"]: r["shown"] for r in watermark(clean_feed(df)).collect()} == limit
    assert rows(replay(df)) == brute_replay(feed, limit)
    assert rows(replay(df, at_end=True)) == brute_replay(feed)


def test_wide_table(spark):
    attributes = {"v:h": ("h", "double"), "v:n": ("n", "integer"), "v:d": ("d", "date"), "v:b": ("b", "boolean"), "v:c": ("c", "string")}
    data = [
        ("e1", "v:h", " 1.5\n", 1, 1), ("e1", "v:h", "2.", 2, 2), ("e1", "v:h", "INF", 9, 3), ("e1", "v:n", "+07", 1, 4), ("e1", "v:n", "7.0", 2, 5), ("e1", "v:d", "2024-02-30", 3, 6), ("e1", "v:d", "2024-02-29Z", 1, 7),
        ("e2", "v:b", "TRUE", 1, 8), ("e2", "v:b", "0", 1, 9), ("e2", "v:c", "", 1, 10), ("e2", "v:c", "x", None, 11), ("e2", "v:c", "x", None, 11), ("e3", "v:n", "no", 1, 12), ("e4", "v:zzz", "1", 1, 13), (None, "v:h", "1", 1, 14), ("e5", None, "1", 1, 15), ("e6", "v:h", None, 1, 16), ("e7", "v:n", "9" * 60, 1, 17),
    ]
    df = spark.createDataFrame([(*d, "clash") for d in data], "s string, p string, o string, born long, id long, _v string")
    wide = wide_table(df, attributes, "s", "p", "o", ["born", "id"], "id")
    got = {r["s"]: r for r in wide.collect()}
    assert set(got) == {"e1", "e2", "e3", "e6", "e7"}
    assert (got["e1"]["h"], got["e1"]["n"], str(got["e1"]["d"]), got["e2"]["b"], got["e2"]["c"]) == (2.0, 7, "2024-02-29", False, "x")
    assert rows(cells_of(wide, attributes, "s")) == sorted([("e1", "v:h", 2), ("e1", "v:n", 4), ("e1", "v:d", 7), ("e2", "v:b", 9), ("e2", "v:c", 11), ("e7", "v:n", 17)], key=repr)
    assert wide_table(df.limit(0), attributes, "s", "p", "o", ["born"]).count() == 0


GOOD = ["<a> <b> <c> .", "  <a>\t<b> _:x.", '<a> <b> "t" .', '<a> <b> "t"@en-GB . # note "x', r'<a> <b> "q \"x\" é \U0001F331" .', '<a> <b> "5"^^<http://www.w3.org/2001/XMLSchema#integer>.', '_:x <b> "a # b" .', '<a> <b> "" .']
BLANK = [None, "", "  \t", " # comment \"", "#"]
BAD = {
    '<a> <b> "t .': "quoting", '<a> <b> t" .': "quoting", '<a> <b> "a "b" x" .': "quoting", r'<a> <b> "\q" .': "quoting", r'<a> <b> "\u12G4" .': "quoting", r'<a> <b> "x\" .': "quoting", "<a> <b> .": "columns", "<a> .": "columns", "<a> <b> <c>": "columns",
    "<a> <b> <c> <d> <e> .": "columns", '<a> <b> "t"@en': "columns", "<a> <b> <c d> .": "value", "<a> <b> <c{d> .": "value", '"s" <b> <c> .': "value", '<a> _:p <c> .': "value", '<a> "p" <c> .': "value", '<a> <b> "t"@toolongtag .': "value",
    '<a> <b> "t"@e_n .': "value", '<a> <b> "x"^^<http://www.w3.org/2001/XMLSchema#integer> .': "value", '<a> <b> "2022-00-10"^^<http://www.w3.org/2001/XMLSchema#date> .': "value", '<a> <b> "True"^^<http://www.w3.org/2001/XMLSchema#boolean> .': "value",
    '<a> <b> "1.2.3"^^<http://www.w3.org/2001/XMLSchema#double> .': "value", '<a> <b> "2022-01-10Z"^^<http://www.w3.org/2001/XMLSchema#date> .': "value",
}


def test_lines_are_read_or_faulted(spark):
    lines = [*((t, None) for t in GOOD + BLANK), *BAD.items(), ('<a> <b> "t" <g> .', None)]
    data = [(1, i, t) for i, (t, _) in enumerate(lines)] + [(2, 1, "<a> <b> <c> ."), (2, 2, "<a>"), (2, 3, "<a> <b> <c> ."), (2, 4, "<b>"), (3, 1, "<a> <b> <c> <g> ."), (4, 1, '<a> <b> <c> "g" .')]
    loads = spark.createDataFrame([(1, "NQuads", None, 9), (2, "nquads", " ERROR", None), (4, "nquads", "warning", 0), (5, "ntriples", None, 0)], "load_id long, nt_format string, on_error string, error_count int").withColumn("graph", F.lit("g")).withColumn("anon_prefix", F.lit("_:x"))
    read = read_loads(spark.createDataFrame([(*d, "clash") for d in data], "load_id long, line_no int, raw_line string, errors string"), loads)
    got = {(r["load_id"], r["line_no"]): r["reason"] for r in read.collect()}
    assert {t: got[1, i] for i, (t, _) in enumerate(lines)} == dict(lines)
    assert {k: v for k, v in got.items() if k[0] > 1} == {(2, 1): None, (2, 2): "columns", (3, 1): "columns", (4, 1): "value"}
    assert rows(error_counts(read, loads)) == [(1, 9, len(BAD), len(GOOD) + 1), (2, None, 1, 1), (4, 0, 1, 0), (5, 0, 0, 0)]
    assert read_loads(spark.createDataFrame([], "load_id long, line_no int, raw_line string"), loads).count() == 0


def test_wide_table_keeps_long_integers(spark):
    data = [("a", "v:n", "9" * 60, 1), ("b", "v:n", "-00" + "7" * 39, 1), ("c", "v:n", "+5", 1), ("d", "v:n", "x", 1)]
    df = spark.createDataFrame(data, "e string, a string, v string, n int")
    got = {r["e"]: (r["n"], r["n__long"]) for r in wide_table(df, {"v:n": ("n", "integer")}, "e", "a", "v", ["n"], long_integers=True).collect()}
    assert got == {"a": (None, "9" * 60), "b": (None, "-" + "7" * 39), "c": (5, None), "d": (None, None)}


def test_lookup_join_splits_hot_keys(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 20 + ["a", "b", None])], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, w int")
    assert rows(skew.lookup_join(left, right, "k", min_rows=10)) == rows(left.join(right, "k", "left").select("k", "v", "w"))
    assert skew.lookup_join(left, right, "k", "inner", min_rows=10).count() == 21
    assert skew.hot_keys(left, "k", 10) == [("hot", 20)]
    same = spark.createDataFrame([("hot", 1)] * 200, "k string, v int").repartition(8)
    assert skew.lookup_join(same, right, "k", "inner", min_rows=10).count() == 200


def test_long_line_is_read(spark):
    text = '<a> <b> "' + "x " * 200_000 + '" .'
    loads = spark.createDataFrame([], "load_id long, nt_format string, on_error string, error_count int, graph string, anon_prefix string")
    got = read_loads(spark.createDataFrame([(1, 1, text), (1, 2, text[:-3])], "load_id long, line_no int, raw_line string"), loads).orderBy("line_no").collect()
    assert [r["reason"] for r in got] == [None, "quoting"]
    assert re.sub(r"[ x]", "", got[0]["o"]) == '""'
