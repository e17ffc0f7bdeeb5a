"""The training-data operators against brute force and the public tokenizers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quadrel.llm import spans, tokens
from quadrel.llm.copies import canonical_lang, canonical_text, copies, copy_counts
from quadrel.llm.mixing import mix, shares, water_fill
from quadrel.llm.spans import shared_share, shared_spans
from quadrel.llm.terms import gram_counts, marked
from quadrel.llm.tokens import fold_merges, decode, encode, merge_long, vocabulary


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("max_n", [1, 3])
def test_gram_counts_match_brute_force(spark, max_n):
    rng = random.Random(max_n)
    data = {(f"r{rng.randrange(12)}", p): rng.choice(["hot", "hot", "a", "b", "c"]) for p in range(40)}
    posts = [(r, p, t) for (r, p), t in data.items()]
    df = spark.createDataFrame([*posts, *posts[:5], (None, 1, "a"), ("r1", 99, None)], "r string, p int, t string").withColumn("n", F.lit(1)).withColumn("records", F.lit("x"))
    want: dict = {}
    for (r, p), _ in data.items():
        for n in range(1, max_n + 1):
            if all((r, p + k) in data for k in range(n)):
                want.setdefault(tuple(data[r, p + k] for k in range(n)), []).append(r)
    got = {tuple(r["gram"]): (r["n"], r["records"]) for r in gram_counts(df, "r", "p", "t", max_n).collect()}
    assert got == {g: (len(x), len(set(x))) for g, x in want.items()}
    assert gram_counts(df.limit(0), "r", "p", "t").count() == 0


@pytest.mark.parametrize("max_n", [1, 2])
def test_gram_counts_salt_hot_terms(spark, monkeypatch, max_n):
    monkeypatch.setattr("quadrel.llm.terms.SALT_ROWS", 10)
    posts = [(i, p, "hot" if p % 2 else f"t{i % 3}") for i in range(30) for p in range(4)] + [(7, 9, "hot")]
    got = {tuple(r["gram"]): (r["n"], r["records"]) for r in gram_counts(spark.createDataFrame(posts, "r long, p int, t string"), "r", "p", "t", max_n).collect()}
    want: dict = {}
    at = {(r, p): t for r, p, t in posts}
    for r, p in at:
        for n in range(1, max_n + 1):
            if all((r, p + k) in at for k in range(n)):
                want.setdefault(tuple(at[r, p + k] for k in range(n)), []).append(r)
    assert got == {g: (len(x), len(set(x))) for g, x in want.items()}


def test_terms_at_one_place_count_each_and_are_marked(spark):
    df = spark.createDataFrame([("r", 1, "a", 1), ("r", 1, "b", 2), ("r", 2, "c", 1), ("q", None, "c", 1)], "r string, p int, t string, o int")
    got = gram_counts(df, "r", "p", "t", 2, "o")
    assert rows(got) == sorted([(["a"], 1, 1), (["b"], 1, 1), (["c"], 2, 2), (["a", "c"], 1, 1), (["b", "c"], 1, 1)], key=repr)
    assert {r["gram"][0]: r["mark"] for r in marked(got, 10, 2, 0.15).where("size(gram) = 1").collect()} == {"a": "rare", "b": "rare", "c": "common"}


def brute_key(lang, text):
    run = lambda x: tuple(re.findall(r"[^\W_]+", x.lower()))
    lang = (lang or "").lower().replace("_", "-")
    if re.search("[;|]", text):
        return lang, "f", tuple(sorted(r for r in map(run, re.split("[;|]", text)) if r))
    return lang, "p", run(text)


def test_copies_match_brute_force(spark):
    rng = random.Random(5)
    texts = ["Red mill", "red  MILL!", "red mill.", "a: 1; b: 2", "B: 2 | a 1;;", "a 1 b 2", "réd mill", "", "...", ";", "one", "x_y", "x y", "Z" * 30_000]
    data = [(i, rng.choice([None, "", "en", "EN", "en_GB", "en-gb"]), rng.choice(texts)) for i in range(300)] + [(1000 + i, "nl", "hot text") for i in range(200)]
    rng.shuffle(data)
    df = spark.createDataFrame([*data, (None, "en", "one"), (2000, "en", None)], "id long, lang string, text string")
    keyed = df.select("id", F.concat(canonical_lang(F.col("lang")), F.lit("\u0002"), canonical_text(F.col("text"))).alias("key"), F.lit(1).alias("head"))
    got = copies(keyed, "key", "id")
    groups: dict = {}
    for i, lang, text in data:
        groups.setdefault(brute_key(lang, text), []).append(i)
    assert rows(got) == sorted(((min(g), i) for g in groups.values() for i in g), key=repr)
    assert rows(copy_counts(got)) == sorted(((min(g), len(g)) for g in groups.values()), key=repr)
    assert copies(keyed.limit(0), "key", "id").count() == 0


TEXTS = ["", None, "Hello world", "  two  spaces\n\n\tx ", "don't they're", "naïve ünïcødé 漢字 🌱🌱 é", "=" * 5000, "x" * 300, "a" * 63 + " " + "a" * 64 + " " + "b" * 65, "1234567890 " * 50, "<|endoftext|>", "\x1c  \u0085y\r\n", "tab\tsep", "def f(x):\n    return x*2\n" * 40]


def reference_ids(texts):
    import tiktoken

    ranks, pattern = vocabulary()
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return [e.encode_ordinary(t or "") for t in texts]


def test_encode_is_that_of_the_public_tokenizer(spark, monkeypatch):
    monkeypatch.setattr(tokens, "FREQUENT_WORDS", 20)  # so that rare words go the other way
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("row", F.lit(0))
    got = encode(df).cache()
    assert {r["doc_id"]: list(r["ids"]) for r in got.collect()} == dict(enumerate(reference_ids(TEXTS)))
    assert {r["doc_id"]: r["t"] for r in got.select("doc_id", decode(F.col("ids")).alias("t")).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encode(df.limit(0)).count() == 0


def test_encode_keeps_repeated_and_null_ids(spark):
    data = [(None, "one two"), (1, "one"), (1, "one"), (1, "other text")]
    got = encode(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(map(repr, [(r["doc_id"], list(r["ids"])) for r in got.collect()])) == sorted(map(repr, zip([d[0] for d in data], reference_ids([d[1] for d in data]))))


def test_encode_of_all_small_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: list(r["ids"]) for r in encode(docs).collect()} == dict(zip(texts, reference_ids(texts.values())))


def test_long_words_merge_as_short_ones():
    ranks, _ = vocabulary()
    rng = random.Random(2)
    for _ in range(200):
        w = "".join(rng.choice("abcdetherin") for _ in range(rng.randrange(1, 90)))
        pieces = [bytes([b]) for b in w.encode()]
        while True:  # one place at a time
            best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            pieces[best[1] : best[1] + 2] = [pieces[best[1]] + pieces[best[1] + 1]]
        assert merge_long(w.encode(), ranks) == [ranks[p] for p in pieces]


def test_fold_of_long_words(spark):
    ranks, _ = vocabulary()
    rng = random.Random(4)
    data = ["".join(rng.choice("abcdetherin=") for _ in range(n)) for n in (63, 64, 65, 200, 900)] + ["=" * 71, "a" * 130, "e" * 257, "é漢🌱" * 40, " " * 500]
    got = fold_merges(spark.createDataFrame([(w,) for w in data], "word string")).collect()
    assert {r["word"]: list(r["ids"]) for r in got} == {w: merge_long(w.encode(), ranks) for w in data}


def test_encode_salts_hot_long_words(spark, monkeypatch):
    from quadrel import skew

    monkeypatch.setattr(skew, "MIN_HOT", 10)
    monkeypatch.setattr(tokens, "FREQUENT_BYTES", 32)
    texts = ["# " + "=" * 70 + f" {i}" for i in range(50)] + ["word " * 5, ""]
    docs = spark.createDataFrame([(i % 40, t, f"s{i}", i) for i, t in enumerate(texts)], "doc_id long, text string, source string, n int")
    got = sorted((r["source"], r["doc_id"], list(r["ids"])) for r in encode(docs, keep=("source",)).collect())
    assert got == sorted((f"s{i}", i % 40, ids) for i, ids in enumerate(reference_ids(texts)))


def test_sizes_keep_repeated_and_null_ids(spark, tmp_path):
    from quadrel.llm import queries

    rows_in = [(1, "one two", "a"), (1, "one two", "a"), (None, "x", "b"), (2, None, None)]
    spark.createDataFrame(rows_in, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(queries._sized(spark, str(tmp_path))) == rows(spark.createDataFrame([(1, "a", 2), (1, "a", 2), (None, "b", 1), (2, None, 0)], "doc_id long, source string, n int"))


def test_water_filling():
    sizes, caps = {"a": 100, "b": 10, "c": 50}, {"a": 1, "b": 2, "c": 4}
    assert water_fill({"a": 0.5, "b": 0.4, "c": 0.1}, sizes, caps, 100) == pytest.approx({"a": 100 * 0.8 * 5 / 6, "b": 20, "c": 100 * 0.8 / 6})
    got = water_fill({"a": 0.5, "b": 0.4, "none": 0.1}, sizes, caps)
    assert got["none"] == 0 and got["a"] / got["b"] == pytest.approx(5 / 4) and got["b"] == pytest.approx(20)
    assert water_fill({"a": 1.0}, {}, {"a": 1}) == {"a": 0.0}
    assert sum(water_fill({"a": 0.5, "b": 0.5}, sizes, caps, 1000).values()) == pytest.approx(120)


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["big"] * 8 + ["small", "mid", "mid", "other", None]), rng.choice([0, 5, 20, 100, None])) for i in range(3000)]
    df = spark.createDataFrame([(*d, "x") for d in data], "doc_id long, source string, n_tokens long, cell string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.2, 4), ("mid", 0.3, 3), ("absent", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    got = mix(df, targets).cache()
    cap = {"big": 1, "small": 4, "mid": 3}
    assert all(1 <= r["repeats"] <= cap[r["source"]] for r in got.collect())
    assert got.count() == got.select("doc_id").distinct().count()
    share = {r["source"]: r["share"] for r in shares(got, targets).collect()}
    for s, w in (("big", 0.4), ("small", 0.2), ("mid", 0.3)):
        assert share[s] == pytest.approx(w / 0.9, abs=0.005)
    assert rows(mix(df, targets)) == rows(got)
    assert mix(df.limit(0), targets).count() == 0


def brute_spans(docs, length):
    seen: dict = {}
    for i, t in docs:
        for j in range(len(t or "") - length + 1):
            seen.setdefault(t[j : j + length], set()).add(i)
    out = []
    for i, t in docs:
        marks = [False] * len(t or "")
        for j in range(len(t or "") - length + 1):
            if len(seen[t[j : j + length]]) > 1:
                marks[j : j + length] = [True] * length
        j = 0
        while j < len(marks):
            if marks[j]:
                k = j
                while k < len(marks) and marks[k]:
                    k += 1
                out.append((i, j, k))
                j = k
            else:
                j += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_spans_match_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé漢🌱 \n") for _ in range(n))
    common = [word(rng.randrange(20, 90)) for _ in range(6)]
    docs = []
    for i in range(60):
        docs.append((i, "".join(rng.choice([word(rng.randrange(0, 60)), rng.choice(common), rng.choice(common)[: rng.randrange(15, 60)]]) for _ in range(rng.randrange(1, 9)))))
    docs += [(100, ""), (101, None), (102, "ab" * 900), (103, "ab" * 300), (104, docs[5][1]), (105, docs[5][1]), (106, word(3000) + common[0])]
    df = spark.createDataFrame([*docs, docs[7]], "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = shared_spans(df, 30, gram=8, block=700)  # so that texts are cut into pieces
    assert rows(got) == brute_spans(docs, 30)
    per = {r["doc_id"]: r["n_shared"] for r in shared_share(df.dropDuplicates(["doc_id"]), got).collect()}
    assert per[101] == 0 and per[104] == sum(b - a for i, a, b in brute_spans(docs, 30) if i == 104)
    assert shared_spans(df.limit(0), 30, gram=8).count() == 0


def test_a_full_sketch_loses_nothing(spark):
    rng = random.Random(9)
    docs = [(i, "".join(rng.choice("ab") for _ in range(200)) + "common passage that is long enough") for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(shared_spans(df, 20, gram=6, cells=8)) == brute_spans(docs, 20)  # every anchor is estimated repeated


def test_large_groups_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(spans, "MANY_FORMS", 2)
    monkeypatch.setattr(spans, "CHUNK_KEYS", 50)
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    common = [word(40) for _ in range(3)]
    docs = [(f"d{i}", word(rng.randrange(30)) + common[i % 3] + word(rng.randrange(30)) + common[(i + 1) % 3][: rng.randrange(10, 40)]) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    assert rows(shared_spans(df, 20, gram=6)) == brute_spans(docs, 20)


def test_the_sketch_passes_few_unique_anchors(spark):
    rng = random.Random(12)
    docs = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(3000))) for i in range(300)]
    texts = spark.createDataFrame(docs, "doc long, text string")
    import pyarrow as pa

    passed = lambda cells: spans.repeated_anchors(texts, 150, 50, spans.BLOCK, "bigint", pa.int64(), cells).count()
    every = passed(8)
    assert every > 10_000 and passed(None) < 0.2 * every


def test_mix_of_a_stated_total_clamps_and_redistributes(spark):
    data = [(i, "big", 10) for i in range(1000)] + [(2000 + i, "tiny", 10) for i in range(5)] + [(3000 + i, "mid", 10) for i in range(200)]
    df = spark.createDataFrame(data, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.4, 1), ("tiny", 0.2, 3), ("mid", 0.4, 2)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["tokens"] for r in shares(mix(df, targets, 9000), targets).collect()}
    # tiny is clamped at 150, then mid at 4000 of the 4425 it should give, and big gives the rest.
    assert got["tiny"] == 150 and got["mid"] == 4000 and got["big"] == pytest.approx(4850, abs=10)


def test_corpus_mixture_clamps_and_redistributes(spark):
    from quadrel.llm import queries

    small = "/root/testdata/sf0.001"
    sized = queries._sized(spark, small)
    size = {r[0]: r[1] for r in sized.groupBy("source").agg(F.sum("n_tokens")).collect()}
    got = {}
    for r in queries.QUERIES["p9_corpus"](spark, small).collect():
        got.setdefault(r["source"], []).append((r["n_tokens"], r["repeats"]))
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in queries.table(spark, small, "mix_targets").collect()}
    given = {s: sum(n * k for n, k in x) for s, x in got.items()}
    longest = max(n for x in got.values() for n, _ in x)
    clamped = {s for s in given if given[s] == size[s] * targets[s][1]}
    free = set(given) - clamped
    assert clamped and free and all(1 <= k <= targets[s][1] for s, x in got.items() for _, k in x)
    assert sum(given.values()) == pytest.approx(sum(n for s, n in size.items() if s in targets), abs=longest * len(given))
    left = sum(given[s] for s in free)
    for s in free:
        assert given[s] == pytest.approx(left * targets[s][0] / sum(targets[x][0] for x in free), abs=2 * longest)


def test_single_terms_are_counted_as_the_stack_counts_them():
    import pyarrow as pa
    from quadrel.llm.terms import _single, _stack

    rng = random.Random(1)
    for _ in range(200):
        data = sorted([(rng.choice("abcd"[: rng.randrange(1, 5)]), rng.randrange(rng.choice([2, 9]))) for _ in range(rng.randrange(40))], key=lambda x: (-ord(x[0]), x[1]))
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(rng.randrange(6)))
        batches = [pa.RecordBatch.from_arrays([pa.array([[t] for t, _ in data[i:j]], pa.list_(pa.string())), pa.array([r for _, r in data[i:j]], pa.int64())], ["s", "r"]) for i, j in zip([0, *cuts], [*cuts, len(data)])]
        got = lambda run: sorted((x["gram"], x["n"], x["records"]) for b in run(iter(batches)) for x in b.to_pylist())  # noqa: E731, B023
        assert got(_single) == got(_stack(1))
