"""Stems and sounds of words, for fuzzy search: the English stemming rules published by Porter, and double sound codes."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quadrel.storage import ship

# The suffixes of Porter's steps 2, 3 and 4.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel behind a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _closed(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + table[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of an English word; words of one or two letters stay."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and "v" in _shape(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _closed(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _closed(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# Sound rules, first that fits holds: pattern at the place, code, other code. "^" is the word's start, "$" its end.
SOUNDS = [
    (r"^(?:gn|kn|pn|wr|ps)", None, None), (r"^x", "S", "S"), (r"^wh", "W", "W"), (r"^[aeiouyàáâäåæèéêëìíîïòóôöøùúûüý]", "A", "A"),
    (r"bb?", "P", "P"), (r"ç", "S", "S"), (r"(?<=s)ch", "K", "K"), (r"cia", "X", "X"), (r"ch(?=[lrnmbhfvw])", "K", "K"), (r"tch", "X", "X"), (r"ch", "X", "K"), (r"c(?=[eiy])", "S", "S"), (r"c(?:ck|[cgkq])?", "K", "K"),
    (r"dg(?=[eiy])", "J", "J"), (r"d[dt]?", "T", "T"), (r"ff?", "F", "F"), (r"gh(?=[aeiouy])", "K", "K"), (r"(?<=[aeiou])gh(?=t|$)", "", ""), (r"gh", "F", "K"), (r"gn(?=$|ed$)", "N", "KN"),
    (r"g(?=[eiy])", "J", "K"), (r"gg?", "K", "K"), (r"(?:^|(?<=[aeiouy]))h(?=[aeiouy])", "H", "H"), (r"h", "", ""), (r"jj?", "J", "J"), (r"kk?", "K", "K"), (r"ll?", "L", "L"), (r"mb(?=$)", "M", "M"), (r"mm?", "M", "M"),
    (r"nn?|ñ", "N", "N"), (r"ph", "F", "F"), (r"p[pb]?", "P", "P"), (r"qq?", "K", "K"), (r"rr?", "R", "R"), (r"sch(?=[eiou])", "SK", "X"), (r"sch", "X", "S"), (r"sh", "X", "X"), (r"si[oa]", "S", "X"), (r"sc(?=[eiy])", "S", "S"),
    (r"s[sz]?", "S", "S"), (r"ti(?:on|a)", "XN", "XN"), (r"th|tth", "0", "T"), (r"t[td]?", "T", "T"), (r"vv?", "F", "F"), (r"^w(?=[aeiouy])", "A", "F"),
    (r"x", "KS", "KS"), (r"zh", "J", "J"), (r"zz?", "S", "TS"),
]


@lru_cache(maxsize=100_000)
def sounds(word: str) -> tuple[str, str]:
    """Two codes of how a word sounds, of up to four signs: the usual and another reading."""
    w, i, a, b = word.lower(), 0, "", ""
    rules = _compiled()
    while i < len(w) and min(len(a), len(b)) < 4:
        for rx, x, y in rules:
            m = rx.match(w, i)
            if m and m.end() > i:
                if x is None:
                    i += 1
                else:
                    a, b, i = a + x, b + y, m.end()
                break
        else:
            i += 1
    return a[:4], b[:4]


@lru_cache(maxsize=1)
def _compiled() -> list:
    return [(re.compile(p), x, y) for p, x, y in SOUNDS]


def stem_column(word: Column) -> Column:
    """Arrow-batched; apply it to distinct words."""
    ship(SparkSession.active())
    return F.pandas_udf(lambda s: s.map(stem, na_action="ignore"), "string")(word)


def sounds_column(word: Column) -> Column:
    """The distinct codes of a word as an array; Arrow-batched; apply it to distinct words."""
    ship(SparkSession.active())
    return F.pandas_udf(lambda s: pd.Series([None if w is None else sorted(set(sounds(w)) - {""}) for w in s]), "array<string>")(word)
