"""Query terms, index tokens and the Porter stemmer."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quernstone.functions.text import let


def query_terms(query: Column) -> Column:
    """Distinct runs of a-z and 0-9 of two characters and more, in the order they first stand."""
    found = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 2))


@functools.cache
def _folds() -> tuple[str, str]:
    """Letters of the Latin blocks U+00C0-U+024F and U+1E00-U+1EFF and their base letters."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and private-use characters, without diacritics."""

    def of(low: Column) -> Column:
        marks = F.regexp_replace(F.translate(low, *_folds()), r"\p{Mn}+", "")
        runs = F.regexp_extract_all(marks, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))
        # ASCII text has nothing to fold, which most of the time goes into.
        return F.when(low.rlike(r"[^\x00-\x7F]"), runs).otherwise(F.array_remove(F.split(low, "[^a-z0-9]+"), ""))

    return let(F.lower(text), of)


def _consonant(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    return c != "y" or i == 0 or not _consonant(w, i - 1)


def _measure(stem: str) -> int:
    """How often a vowel run is followed by a consonant run."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(a is False and b is True for a, b in zip(kinds, kinds[1:]))


def _vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy"


# Suffix rules of steps 2, 3 and 4 of Porter's algorithm (1980).
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"


def _longest(rules: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(":")) if ":" in r else (r, "") for r in rules.split()), key=lambda r: -len(r[0]))


_RULES2, _RULES3, _RULES4 = _longest(_STEP2), _longest(_STEP3), _longest(_STEP4)


@functools.lru_cache(200_000)
def porter(word: str) -> str:
    """The Porter stem of a word of 3 to 64 bytes; others stay."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    w = word
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules, least in ((_RULES2, 0), (_RULES3, 0)):
        for end, put in rules:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > least:
                    w = w[: -len(end)] + put
                break
    for end, _ in _RULES4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    return w[:-1] if _double(w) and w[-1] == "l" and _measure(w[:-1]) > 1 else w


@F.pandas_udf(StringType())
def stem(term: pd.Series) -> pd.Series:
    """Stems each distinct term of a batch once."""
    codes, distinct = pd.factorize(term)
    return pd.Series([porter(t) for t in distinct], dtype=object).take(codes).reset_index(drop=True)
