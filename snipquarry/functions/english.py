"""The English analyser: stop words and the stemmer published by M. F. Porter in 1980."""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Words that carry no content.
STOP = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they
    them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does
    did doing a an the and but if or because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where why how all any both each few
    more most other some such no nor not only own same so than too very s t can will just don should now""".split()
)
# Suffixes and what they become, for the second and third step of the algorithm.
_STEP2 = "ational ate,tional tion,enci ence,anci ance,izer ize,abli able,alli al,entli ent,eli e,ousli ous,ization ize,ation ate,ator ate,alism al,iveness ive,fulness ful,ousness ous,aliti al,iviti ive,biliti ble"
_STEP3 = "icate ic,ative ,alize al,iciti ic,ical ic,ful ,ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _table(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(p.split(" ")) for p in text.split(",")), key=lambda p: -len(p[0]))


_TWO, _THREE, _FOUR = _table(_STEP2), _table(_STEP3), sorted(_STEP4.split(), key=len, reverse=True)


def _shape(word: str) -> str:
    """v and c for vowels and consonants; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _swap(word: str, table: list[tuple[str, str]]) -> str:
    for old, new in table:
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word; a bounded memo spares the words that come back in every text."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (m := re.fullmatch(r"(.*)(ed|ing)", w)) and "v" in _shape(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _TWO), _THREE)
    for suffix in _FOUR:
        if w.endswith(suffix):
            rest = w[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
                w = rest
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def analyse(text: str | None) -> list[str]:
    return [stem(w) for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in STOP]


@F.pandas_udf(ArrayType(StringType()))
def _analyse(texts: pd.Series) -> pd.Series:
    return texts.map(analyse)


def tokens(c: Column) -> Column:
    """Stems of a text in order, without stop words."""
    return _analyse(c)


def matches(fields: list[Column], query: str) -> Column:
    """Every stem of the query stands in some field; a query of nothing but stop words matches nothing."""
    wanted = list(dict.fromkeys(analyse(query)))
    if not wanted:
        return F.lit(False)
    text = F.concat_ws(" ", *fields)
    # a stem differs from its words in its last two letters at most, so a compiled substring test spares most rows the analyser
    low = F.lower(text)
    may = reduce(and_, [F.contains(low, F.lit(w[: max(1, len(w) - 2)])) for w in wanted])
    return may & (F.size(F.array_intersect(_analyse(text), F.array(*map(F.lit, wanted)))) == len(wanted))
