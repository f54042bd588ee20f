"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), over arrays of tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffixes of the published steps 2 and 3, and what replaces them where something with a vowel and a
# consonant after it stands before; those of step 4 go where two such pairs stand before.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
#: Distinct words that a worker remembers.
REMEMBERED = 1 << 17


def _form(word: str) -> str:
    """v or c for each letter; y is a consonant at the start and after a vowel."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _form(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _form(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


@lru_cache(maxsize=REMEMBERED)
def stem_word(word: str) -> str:
    """The stem of a word of small Latin letters; other words, and those of one or two letters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    plural = _longest(word, ("sses", "ies", "ss", "s"))
    if plural:
        word = word[: -len(plural)] + {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}[plural]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    elif (past := _longest(word, ("ed", "ing"))) and "v" in _form(word[: -len(past)]):
        word = word[: -len(past)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and _form(word)[-1] == "c" and word[-1] not in "lsz":
            word = word[:-1]
        elif _measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in _form(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        suffix = _longest(word, table)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + table[suffix]
    suffix = _longest(word, STEP_4)
    if suffix and _measure(rest := word[: -len(suffix)]) > 1 and (suffix != "ion" or rest[-1:] in ("s", "t")):
        word = rest
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The stems of arrays of tokens, which must be lower-cased; null stays null."""
    for series in tokens:
        yield series.map(lambda words: None if words is None else [None if w is None else stem_word(w) for w in words])
