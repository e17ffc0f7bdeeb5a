"""Text matching that ignores case and accents, and language ranges."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

HOW = ("plain", "exact", "icase", "substring", "word", "prefix", "like")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Accented letters and their bases, from the canonical decompositions of the Latin, Greek and Cyrillic blocks. Letters
    without decomposition, as æ ð ø þ ß, stay."""
    pairs = []
    for cp in [*range(0xC0, 0x250), *range(0x370, 0x460), *range(0x1E00, 0x2000)]:
        ch = chr(cp).lower()
        base = unicodedata.normalize("NFD", ch)[0]
        if len(ch) == 1 and base != ch and base.isalpha() and chr(cp) == ch:
            pairs.append((ch, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents."""
    a, b = _accents()
    return F.translate(F.lower(c), a, b)


def fold_text(text: str) -> str:
    a, b = _accents()
    return text.lower().translate(str.maketrans(a, b))


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in text)


def match_folded(how: str, pattern: str, folded: Column) -> Column:
    """As ``match_label``, on a column that is folded already (stored so, the filter is pushed to the scan)."""
    if how not in HOW:
        raise ValueError(f"unknown match {how!r}")
    if pattern == "":
        return F.lit(True)
    p = fold_text(pattern)
    if how in ("exact", "icase", "plain"):
        return folded == p
    if how == "substring":
        return folded.contains(p)
    if how == "prefix":
        return folded.startswith(p)
    if how == "like":
        return folded.like(re.sub(r"([%_\\])", r"\\\1", p).replace("*", "%"))
    start = r"(?:^|(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}]))"
    return folded.rlike(start + _quoted(p) + r"(?![\p{L}\p{N}])")


def match_label(how: str, pattern: str, label: Column) -> Column:
    """Whether a text matches: ``exact`` = ``icase`` all of it, ``substring``, ``word`` from a word's start to a word's end, ``prefix``,
    ``like`` with ``*`` for any run. Letter case and accents don't count. ``plain`` compares the text as it is. An empty pattern
    matches any text but for ``plain``. Null gives null."""
    if how == "plain":
        return label == pattern
    return match_folded(how, pattern, fold(label))


def lang_matches(lang: Column, range_: str) -> Column:
    """RFC 4647: a range matches tags that begin with its subtags; ``*`` stands for any number of subtags. Null and empty tags never
    match."""
    parts = range_.lower().split("-")
    if parts == ["*"]:
        return F.coalesce(lang != "", F.lit(False))
    rx = ""
    for i, part in enumerate(parts):
        rx += (r"(?:[^-]+-)*" if i < len(parts) - 1 else r"(?:[^-]+-?)*") if part == "*" else re.escape(part) + ("-" if i < len(parts) - 1 else "")
    if parts[-1] == "*":
        rx = "^" + rx.removesuffix(r"(?:[^-]+-?)*").removesuffix("-") + r"(?:-.*)?\z"
    else:
        rx = "^" + rx + r"(?:-.*)?\z"
    return F.coalesce(F.lower(lang).rlike(rx) & (lang != ""), F.lit(False))


def lang_equal(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)
