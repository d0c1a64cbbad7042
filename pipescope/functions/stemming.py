"""English Snowball (Porter2) stemming of single words, and its Arrow form for columns of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI = "cdeghkmnrt"
# Words the algorithm lists as exceptions, with their stems.
_IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
_FINAL_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
# Suffixes of steps 2 to 4, longest first, with what replaces them.
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
    ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"),
    ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
    ("ogi", "og"), ("li", ""),
]
_STEP3 = [
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""),
    ("ical", "ic"), ("ness", ""), ("ful", ""),
]
_STEP4 = [
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize",
    "ion", "al", "er", "ic",
]
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _region_after(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _step1(word: str, r1: int) -> str:
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _FINAL_AFTER_1A:
        return word
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not word.endswith(suffix):
            continue
        stem = word[: -len(suffix)]
        if suffix in ("eed", "eedly"):
            word = stem + "ee" if len(stem) >= r1 else word
        elif any(c in _VOWELS for c in stem):
            if stem.endswith(("at", "bl", "iz")):
                word = stem + "e"
            elif stem.endswith(_DOUBLES):
                word = stem[:-1]
            else:
                word = stem + "e" if len(stem) <= r1 and _SHORT_END.search(stem) else stem
        break
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    return word


def _step2(word: str, r1: int) -> str:
    for suffix, new in _STEP2:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            allowed = (
                len(stem) >= r1
                and (suffix != "ogi" or stem.endswith("l"))
                and (suffix != "li" or stem[-1:] in tuple(_LI))
            )
            return stem + new if allowed else word
    return word


def _step3(word: str, r1: int, r2: int) -> str:
    for suffix, new in _STEP3:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if len(stem) >= (r2 if suffix == "ative" else r1) else word
    return word


def _step4(word: str, r2: int) -> str:
    for suffix in _STEP4:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            allowed = len(stem) >= r2 and (suffix != "ion" or stem.endswith(("s", "t")))
            return stem if allowed else word
    return word


def _step5(word: str, r1: int, r2: int) -> str:
    stem = word[:-1]
    if word.endswith("e") and (len(stem) >= r2 or (len(stem) >= r1 and not _SHORT_END.search(stem))):
        return stem
    if word.endswith("ll") and len(stem) >= r2:
        return stem
    return word


def stem(word: str) -> str:
    """The stem of one word; the word is lowercased first."""
    word = word.lower()
    if len(word) <= 2:
        return word
    word = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if word in _IRREGULAR:
        return _IRREGULAR[word]
    word = word.removeprefix("'")
    # a y that acts as a consonant is written Y until the end
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = re.match(r"gener|commun|arsen", word)
    r1 = prefix.end() if prefix else _region_after(word, 0)
    r2 = _region_after(word, r1)
    for suffix in ("'s'", "'s", "'"):
        if word.endswith(suffix):
            word = word[: -len(suffix)]
            break
    word = _step1(word, r1)
    if word not in _FINAL_AFTER_1A:
        word = _step5(_step4(_step3(_step2(word, r1), r1, r2), r2), r1, r2)
    return word.replace("Y", "y")


_EDGES = re.compile(r"([!-/:-@\[-`{-~]*)(.*?)([!-/:-@\[-`{-~]*)", re.DOTALL)


class _Stems(dict):
    """Stems of the words met so far, punctuation around a word left as it is."""

    def __missing__(self, word: str) -> str:
        left, core, right = _EDGES.fullmatch(word).groups()
        value = self[word] = left + stem(core) + right
        return value


@F.pandas_udf(T.StringType())
def stem_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts with every word stemmed; each distinct word of a task is stemmed once."""
    stems = _Stems()
    for batch in batches:
        if len(stems) > 1_000_000:
            stems.clear()
        yield batch.map(lambda text: " ".join([stems[w] for w in text.split()]), na_action="ignore")
