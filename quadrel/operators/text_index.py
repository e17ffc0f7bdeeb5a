"""The index of tokens of literals, boolean search over it, and maps from keys to values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrel.functions.stem import sounds, sounds_column, stem, stem_column
from quadrel.functions.text import fold, fold_text
from quadrel.schema import LITERAL, visible
from quadrel.storage import materialize, release

# Words that are never indexed, and the limits of integers that are.
STOP_WORDS = ["and", "an", "or", "of", "on", "in", "this", "the"]
SMALLEST, LARGEST = -(2**30), 2**30


def tokens(text: Column) -> Column:
    """The distinct tokens of a text: runs of letters or of digits (a number may have a sign), without one-character tokens that are no
    numbers, stop words and numbers out of range."""
    parts = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}])-?\p{Nd}+(?![\p{L}\p{N}])|[\p{L}\p{N}]+"), 0)
    number = lambda t: t.rlike(r"^-?[0-9]+\z")
    keep = lambda t: F.when(number(t), t.try_cast("bigint").between(SMALLEST, LARGEST)).otherwise((F.length(t) > 1) & ~F.lower(t).isin(STOP_WORDS))
    return F.array_distinct(F.filter(parts, lambda t: F.coalesce(keep(t), F.lit(False))))


def postings(quads: DataFrame, tokenize: Callable[[Column], Column] = tokens, exclude: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """token, literal of the distinct literal texts of the visible statements; language and type don't count. Hooks: ``tokenize`` gives of a text
    the array of its tokens, ``exclude`` of the statements a test that leaves them out of the index."""
    rows = visible(quads).where(F.col("o_kind") == LITERAL)
    if exclude is not None:
        rows = rows.where(~F.coalesce(exclude(rows), F.lit(False)))
    texts = rows.select(F.col("o").alias("literal")).distinct()
    return texts.select(F.explode(tokenize(F.col("literal"))).alias("token"), "literal")


def _number(token: Column) -> Column:
    return F.when(token.rlike(r"^-?[0-9]+\z"), token.try_cast("bigint"))


class LiteralIndex:
    """A kept index: postings written once, sorted by folded token, so that a search for a token, a prefix or a number reads only the files and row
    groups that can hold it. New literals are added as further files. Columns token, literal, ``f`` (the folded token), ``n`` (its number)."""

    def __init__(self, quads: DataFrame, tokenize: Callable[[Column], Column] = tokens, exclude: Callable[[DataFrame], Column] | None = None) -> None:
        self.hooks = (tokenize, exclude)
        self.parts = [self._written(postings(quads, *self.hooks))]

    @staticmethod
    def _written(rows: DataFrame) -> DataFrame:
        # Written by ranges of (token, literal), so a token of many literals is spread over files.
        return materialize(rows.withColumn("f", fold(F.col("token"))).withColumn("n", _number(F.col("token"))).repartitionByRange("f", "literal").sortWithinPartitions("f", "literal"))

    @property
    def frame(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def add(self, quads: DataFrame) -> LiteralIndex:
        """Also the literals of these statements that aren't indexed yet."""
        fresh = postings(quads, *self.hooks)
        self.parts.append(self._written(fresh.join(self.frame.select("literal").distinct(), "literal", "left_anti").select("token", "literal")))
        return self

    def remove(self, literals: DataFrame) -> LiteralIndex:
        """Without these literals (column literal); the index is written anew."""
        rest = self._written(self.frame.select("token", "literal").join(literals.select("literal").distinct(), "literal", "left_anti"))
        release(*self.parts)
        self.parts = [rest]
        return self

    def find(self, query: Q | str, stopgaps: frozenset[str] = frozenset()) -> DataFrame:
        return find_literals(self.frame, query, stopgaps)

    def statistics(self) -> DataFrame:
        """One row: tokens, literals, postings."""
        return self.frame.agg(F.countDistinct("token").alias("tokens"), F.countDistinct("literal").alias("literals"), F.count(F.lit(1)).alias("postings"))


def stopgap_tokens(index: DataFrame, threshold: int = 50_000) -> DataFrame:
    """Tokens in more than ``threshold`` literals."""
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > threshold)


@dataclass(frozen=True)
class Q:
    """A search: Q("token", t), Q("case", t) exact case, Q("prefix", t), Q("ge", n), Q("le", n), Q("between", a, b), Q("stem", t), Q("sounds", t),
    Q("and", q...), Q("or", q...), Q("not", q). A plain text stands for Q("token", text)."""

    op: str
    args: tuple = field(default=())

    def __init__(self, op: str, *args) -> None:
        object.__setattr__(self, "op", op)
        object.__setattr__(self, "args", tuple(Q("token", a) if op in ("and", "or", "not") and not isinstance(a, Q) else a for a in args))


def normal_form(q: Q, negated: bool = False) -> list[list[tuple[Q, bool]]]:
    """Disjunctive normal form: conjunctions of (key, negated). Negations are carried down through all connectives."""
    if q.op == "not":
        return normal_form(q.args[0], not negated)
    if q.op in ("and", "or"):
        parts = [normal_form(a, negated) for a in q.args]
        if (q.op == "or") != negated:
            return [c for p in parts for c in p]
        out: list[list[tuple[Q, bool]]] = [[]]
        for p in parts:
            out = [a + b for a in out for b in p]
        return out
    return [[(q, negated)]]


def _key_test(q: Q, token: Column, folded: Column | None = None, number: Column | None = None) -> Column:
    """The test of a key; on an index that keeps folded tokens and numbers it is a test of those columns, pushed to the scan."""
    folded = fold(token) if folded is None else folded
    number = _number(token) if number is None else number
    if q.op == "token":
        return folded == fold_text(str(q.args[0]))
    if q.op == "case":
        return (token == q.args[0]) & (folded == fold_text(str(q.args[0])))
    if q.op == "prefix":
        return folded.startswith(fold_text(q.args[0]))
    if q.op == "ge":
        return number >= q.args[0]
    if q.op == "le":
        return number <= q.args[0]
    if q.op == "between":
        return number.between(*q.args)
    raise ValueError(f"unknown search {q.op!r}")


def _hits(index: DataFrame, q: Q) -> DataFrame:
    kept = "f" in index.columns and "n" in index.columns
    return index.where(_key_test(q, F.col("token"), *((F.col("f"), F.col("n")) if kept else ())))


def expansions(index: DataFrame, q: Q) -> DataFrame:
    """The distinct tokens that a key stands for."""
    if q.op not in ("stem", "sounds"):
        return _hits(index, q).select("token").distinct()
    words = index.select("token").distinct()
    if q.op == "stem":
        return words.where(stem_column(F.col("token")) == stem(q.args[0]))
    codes = [c for c in set(sounds(q.args[0])) if c]
    return words.where(F.arrays_overlap(sounds_column(F.col("token")), F.array(*[F.lit(c) for c in codes])))


def _matching(index: DataFrame, q: Q) -> DataFrame:
    if q.op in ("stem", "sounds"):
        return index.join(expansions(index, q), "token", "left_semi").select("literal").distinct()
    return _hits(index, q).select("literal").distinct()


def find_literals(index: DataFrame, query: Q | str, stopgaps: frozenset[str] = frozenset()) -> DataFrame:
    """The distinct literal texts that match. Stop words and ``stopgaps`` are left out of conjunctions; a conjunction needs a positive key
    left, else it gives nothing - so a search for a stop word alone is empty. Positive keys are joined as semi joins, negated as anti."""
    query = query if isinstance(query, Q) else Q("token", query)
    gone = {fold_text(w) for w in STOP_WORDS} | {fold_text(w) for w in stopgaps}
    out = None
    for conjunct in normal_form(query):
        keys = [(k, n) for k, n in conjunct if not (k.op in ("token", "case") and fold_text(str(k.args[0])) in gone)]
        positive, negative = [k for k, n in keys if not n], [k for k, n in keys if n]
        if not positive:
            continue
        found = _matching(index, positive[0])
        for k in positive[1:]:
            found = found.join(_matching(index, k), "literal", "left_semi")
        for k in negative:
            found = found.join(_matching(index, k), "literal", "left_anti")
        out = found if out is None else out.unionByName(found)
    return index.select("literal").limit(0) if out is None else out.distinct()


def token_expansions(index: DataFrame, query: Q | str) -> DataFrame:
    """Which tokens each key of a search stands for: key, token."""
    query = query if isinstance(query, Q) else Q("token", query)
    out = index.select(F.lit("").alias("key"), "token").limit(0)
    for key in dict.fromkeys(k for c in normal_form(query) for k, _ in c):
        name = f"{key.op}({','.join(map(str, key.args))})"
        out = out.unionByName(expansions(index, key).select(F.lit(name).alias("key"), "token"))
    return out


class LiteralMap:
    """An ordered map from keys (texts or integers) to sets of values, held as a frame (key, value). Texts are compared without case and
    accents, integers by value; operations give new frames and change nothing that was read before."""

    def __init__(self, pairs: DataFrame) -> None:
        self.pairs = pairs.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).distinct()

    def insert(self, pairs: DataFrame) -> LiteralMap:
        return LiteralMap(self.pairs.unionByName(pairs.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))))

    def delete(self, key, value=None) -> LiteralMap:
        hit = F.col("key") == str(key)
        if value is not None:
            hit = hit & (F.col("value") == str(value))
        return LiteralMap(self.pairs.where(~hit))

    def reset(self) -> LiteralMap:
        return LiteralMap(self.pairs.limit(0))

    def find(self, keys: list) -> DataFrame:
        """Values that all keys have; a key given as ``("not", k)`` must not have it. At least one key must be positive."""
        positive, negative = [k for k in keys if not isinstance(k, tuple)], [k[1] for k in keys if isinstance(k, tuple)]
        if not positive:
            raise ValueError("at least one key must not be negated")
        hits = self.pairs.where(fold(F.col("key")).isin([fold_text(str(k)) for k in positive])).select(fold(F.col("key")).alias("k"), "value").distinct()
        out = hits.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len({fold_text(str(k)) for k in positive})).select("value")
        if negative:
            out = out.join(self.pairs.where(fold(F.col("key")).isin([fold_text(str(k)) for k in negative])).select("value"), "value", "left_anti")
        return out

    def keys(self, spec: str = "all", *args) -> DataFrame:
        """Distinct keys: all, key(k), prefix(p), case(k), ge(n), le(n), between(a, b); texts compare by their folded form."""
        names = self.pairs.select("key").distinct()
        if spec == "all":
            return names
        if spec in ("ge", "le", "between") and isinstance(args[0], str):
            f = fold(F.col("key"))
            a = fold_text(args[0])
            return names.where(f >= a if spec == "ge" else f <= a if spec == "le" else f.between(a, fold_text(args[1])))
        return names.where(_key_test(Q({"key": "token"}.get(spec, spec), *args), F.col("key")))

    def statistics(self) -> DataFrame:
        """One row: keys, n_values (pairs)."""
        per = self.pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        return per.agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"))
