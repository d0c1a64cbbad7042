"""Named components: each is a function from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipescope.functions import text as tx

Step = Callable[[DataFrame], DataFrame]


def text_step(fn: Callable[[str], Column]) -> Step:
    """A text expression as a step over the `text` column."""
    return lambda df: df.withColumn("text", fn("text"))


def _stem(df: DataFrame) -> DataFrame:
    from pipescope.operators.vocabulary import stem_text

    return stem_text(df)


def lemmatise_with(lexicon: DataFrame) -> Step:
    from pipescope.operators.vocabulary import lemmatise_text

    return lambda df: lemmatise_text(df, lexicon)


def closed_class_with(lexicon: DataFrame) -> Step:
    from pipescope.operators.vocabulary import drop_closed_class

    return lambda df: drop_closed_class(df, lexicon)


PREPROCESSERS: dict[str, Step] = {
    "stem": _stem,
    "lowercase": text_step(tx.lowercase),
    "no_numbers_simple": text_step(tx.digits_to_space),
    "no_numbers_spacy": text_step(tx.drop_numbers),
    "no_punctuation": text_step(tx.punctuation_to_space),
    "no_stopwords_nltk": text_step(tx.drop_stop_words),
}
# steps that need a lexicon table: name -> function of that table
LEXICON_PREPROCESSERS: dict[str, Callable[[DataFrame], Step]] = {
    "lemmatize": lemmatise_with,
    "no_stopwords_spacy": closed_class_with,
}
# the order in which chosen steps are applied
STEP_ORDER = [
    "stem", "lemmatize", "lowercase", "no_numbers_simple", "no_numbers_spacy", "no_punctuation",
    "no_stopwords_spacy", "no_stopwords_nltk",
]


def _token_step(fn: Callable[[str], Column]) -> Step:
    return lambda df: df.withColumn("tokens", fn("text"))


def _train_rows(df: DataFrame) -> Column:
    """What is learnt comes from the train split, or from all rows of a corpus without splits."""
    return F.col("split") == "train" if "split" in df.columns else F.lit(True)


def _bpe(df: DataFrame) -> DataFrame:
    from pipescope.operators.vocabulary import bpe_tokens

    return bpe_tokens(df, rounds=200, train=_train_rows(df))


def _wordpiece(df: DataFrame) -> DataFrame:
    from pipescope.operators.vocabulary import distinct_words, wordpiece_tokens, wordpiece_vocabulary

    words = distinct_words(df.where(_train_rows(df)), tx.whitespace_tokens(F.lower("text")))
    return wordpiece_tokens(df, wordpiece_vocabulary(words, 20_000))


TOKENISERS: dict[str, Step] = {
    "whitespace": _token_step(tx.whitespace_tokens),
    "bpe": _bpe,
    "bert": _wordpiece,
    "stanford": _token_step(tx.ptb_tokens),
    "treebank": _token_step(tx.treebank_tokens),
}


def _named(table: dict, name: str, kind: str):
    if name not in table:
        raise ValueError(f"unknown {kind} {name!r}; known: {sorted(table)}")
    return table[name]


def preprocesser(name: str, lexicons: dict[str, DataFrame] | None = None) -> Step:
    if name in LEXICON_PREPROCESSERS:
        if not lexicons or name not in lexicons:
            raise ValueError(f"step {name!r} needs a lexicon table")
        return LEXICON_PREPROCESSERS[name](lexicons[name])
    return _named(PREPROCESSERS, name, "preprocesser")


def tokeniser(name: str) -> Step:
    return _named(TOKENISERS, name, "tokeniser")


def ordered_steps(names: Sequence[str]) -> list[str]:
    """The known names in registry order; asking for unknown ones only is an error."""
    known = [n for n in STEP_ORDER if n in names]
    if names and not known:
        raise ValueError(f"no preprocessers found with names {list(names)}")
    return known


def apply_steps(df: DataFrame, names: Sequence[str], lexicons: dict[str, DataFrame] | None = None) -> DataFrame:
    """Chosen steps one after the other on all splits alike: one plan."""
    steps = [preprocesser(n, lexicons) for n in ordered_steps([n for n in names if n != "empty"])]
    return reduce(DataFrame.transform, steps, df)
