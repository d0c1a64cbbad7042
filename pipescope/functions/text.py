"""Text expressions: cleaning steps and rule-based tokenisers, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from pipescope.functions.scalar import PUNCTUATION

# Unicode white space, plus the four ASCII separators that also split words
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"
# the ASCII marks as a character class of both regex dialects
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
# English number words.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
    "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty",
    "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "trillion",
]
# The closed word classes (and punctuation) that carry little content.
CLOSED_CLASSES = ["ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ", "PUNCT"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def english_stop_words() -> list[str]:
    """Spark ML's English list, used wherever the caller gives none."""
    return StopWordsRemover.loadDefaultStopWords("english")


def whitespace_tokens(text: Column | str) -> Column:
    """Words between runs of white space; no empty words."""
    return F.filter(F.split(_col(text), WHITE_SPACE), lambda t: t != "")


def lowercase(text: Column | str) -> Column:
    return F.lower(_col(text))


def punctuation_to_space(text: Column | str) -> Column:
    return F.translate(_col(text), PUNCTUATION, " " * len(PUNCTUATION))


def digits_to_space(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"(?U)\d+", " ")


def drop_stop_words(text: Column | str, stop_words: Sequence[str] | None = None) -> Column:
    """Case-sensitive removal; remaining words are joined by single spaces.

    `isin` with literals is a hash-set lookup, so the list length does not matter per word.
    """
    words = list(stop_words if stop_words is not None else english_stop_words())
    return F.array_join(F.filter(whitespace_tokens(text), lambda t: ~t.isin(words)), " ")


def like_number(token: Column, number_words: Sequence[str] = NUMBER_WORDS) -> Column:
    """Digits (signs, commas and points aside), a simple fraction, or a number word."""
    body = F.regexp_replace(token, r"^[+\-±~]", "")
    plain = F.translate(body, ",.", "")
    return (
        plain.rlike(r"(?U)^\d+$") | body.rlike(r"(?U)^\d+/\d+$") | F.lower(body).isin(list(number_words))
    )


def pieces(text: Column | str) -> Column:
    """The text cut into words each with its following white space; joining gives the text back."""
    return F.regexp_extract_all(_col(text), F.lit(r"(?U)([^\s\x1c-\x1f]+[\s\x1c-\x1f]*|^[\s\x1c-\x1f]+)"), F.lit(1))


def piece_word(piece: Column) -> Column:
    return F.regexp_replace(piece, WHITE_SPACE, "")


def drop_numbers(text: Column | str, number_words: Sequence[str] = NUMBER_WORDS) -> Column:
    """Remove number-like words together with the white space after them; other spacing stays."""
    kept = F.filter(pieces(text), lambda p: ~like_number(piece_word(p), number_words))
    return F.array_join(kept, "")


# The published Penn Treebank tokenisation rules, in order, as (pattern, replacement)
# with \1 for groups.
TREEBANK_RULES = [
    # opening quotes
    (r'^"', r"``"),
    (r"(``)", r" \1 "),
    (r"([ (\[{<])(\"|'{2})", r"\1 `` "),
    # punctuation
    (r"([:,])([^\d])", r" \1 \2"),
    (r"([:,])$", r" \1 "),
    (r"\.\.\.", r" ... "),
    (r"([;@#$%&])", r" \1 "),
    (r"([^\.])(\.)([\]\)}>\"']*)\s*$", r"\1 \2\3 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    # brackets and dashes
    (r"([\]\[\(\)\{\}<>])", r" \1 "),
    (r"--", r" -- "),
    # room at both ends, then closing quotes and clitics
    (r"^", r" "),
    (r"$", r" "),
    (r"''", r" '' "),
    (r'"', r" '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    # fused words
    (r"(?i)\b(can)(not)\b", r" \1 \2 "),
    (r"(?i)\b(d)('ye)\b", r" \1 \2 "),
    (r"(?i)\b(gim)(me)\b", r" \1 \2 "),
    (r"(?i)\b(gon)(na)\b", r" \1 \2 "),
    (r"(?i)\b(got)(ta)\b", r" \1 \2 "),
    (r"(?i)\b(lem)(me)\b", r" \1 \2 "),
    (r"(?i)\b(more)('n)\b", r" \1 \2 "),
    (r"(?i)\b(wan)(na)(\s)", r" \1 \2 \3"),
    (r"(?i) ('t)(is)\b", r" \1 \2 "),
    (r"(?i) ('t)(was)\b", r" \1 \2 "),
]
# Names of brackets in treebank-style text.
BRACKET_NAMES = [("(", "-LRB-"), (")", "-RRB-"), ("[", "-LSB-"), ("]", "-RSB-"), ("{", "-LCB-"), ("}", "-RCB-")]


def java_replacement(replacement: str) -> str:
    """\\1-style groups as Java's $1, with literal dollars protected."""
    parts = replacement.replace("$", r"\$").split("\\")
    return parts[0] + "".join("$" + p if p[:1].isdigit() else "\\" + p for p in parts[1:])


def treebank_text(text: Column | str) -> Column:
    return reduce(
        lambda out, rule: F.regexp_replace(out, rule[0], java_replacement(rule[1])), TREEBANK_RULES, _col(text)
    )


def treebank_tokens(text: Column | str) -> Column:
    return whitespace_tokens(treebank_text(text))


def ptb_tokens(text: Column | str) -> Column:
    """Treebank words with brackets written by name."""
    def named(token: Column) -> Column:
        out = token
        for bracket, name in BRACKET_NAMES:
            out = F.when(token == bracket, name).otherwise(out)
        return out

    return F.transform(treebank_tokens(text), named)


def bigrams(tokens: Column | str) -> Column:
    """Neighbouring words joined by a space (the list zipped with itself, shifted by one)."""
    words = _col(tokens)
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def unigrams_and_bigrams(tokens: Column | str) -> Column:
    return F.concat(_col(tokens), bigrams(tokens))


def peel(word: Column | str) -> tuple[Column, Column, Column]:
    """Punctuation left of a word, its core, punctuation right; a word of marks only is all left."""
    pattern = f"(?s)^({PUNCT_CLASS}*)(.*?)({PUNCT_CLASS}*)$"
    w = _col(word)
    return tuple(F.regexp_extract(w, pattern, k) for k in (1, 2, 3))
