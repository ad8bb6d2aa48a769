"""Stems of English words by Porter's published algorithm (1980), as full-text indexes use it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings and what they become, by step. Fixed values of the algorithm; the longest ending that fits counts.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

#: Longer words than this (in bytes of UTF-8) stay as they are. Fixed value.
LONGEST = 64


def _shape(word: str) -> str:
    """c for consonants, v for vowels; y is a vowel behind a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c", _shape(word)))


def _short_end(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def stem(word: str) -> str:
    if len(word) < 3 or len(word.encode()) > LONGEST:
        return word
    w = word
    if w.endswith("s"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((w[: -len(e)] for e in ("ed", "ing") if w.endswith(e) and "v" in _shape(w[: -len(e)])), None)
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short_end(cut) else cut
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for step in (STEP_2, STEP_3):
        e = _longest(w, step)
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + step[e]
    e = _longest(w, STEP_4)
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[: -len(e)].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or m == 1 and not _short_end(w[:-1]) else w
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stem of each word of an array, in place; words that were met before come from a table."""
    known: dict[str, str] = {}
    out = []
    for ws in words:
        if ws is None:
            out.append(None)
            continue
        if len(known) > 500_000:
            known.clear()
        out.append([known[w] if w in known else known.setdefault(w, stem(w)) for w in ws])
    return pd.Series(out, dtype=object)
