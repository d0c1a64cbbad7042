"""Scalar expressions: hashes, keys, formats and path parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The preprocessing steps that can occur in result paths and logs, in registry order.
STEP_NAMES = ["stem", "lemmatize", "lowercase", "no_punctuation", "no_stopwords_spacy", "no_stopwords_nltk"]
PATH_PREFIX = "preprocessers_"
# The 32 ASCII punctuation marks.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_key(*cols: Column | str) -> Column:
    return F.concat_ws("_", *[_col(c).cast("string") for c in cols])


def json_string(c: Column | str) -> Column:
    """A JSON string literal of a name (names are ASCII; quotes and backslashes are escaped)."""
    escaped = F.replace(F.replace(_col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def canonical_config(
    preprocessers: Column | str = "preprocessers", tokeniser: Column | str = "tokeniser",
    featuriser: Column | str = "featuriser", model: Column | str = "model",
    finetune: Column | str | None = "finetune", seed: Column | str | None = "seed", legacy: bool = False,
) -> Column:
    """The configuration as JSON text with sorted keys and a sorted step list, spaced like `json.dumps`.

    An absent (NULL) seed is left out. A NULL `finetune` counts as false and is written; `legacy=True`
    writes the key only when it is true, which is how early log keys were made.
    """
    steps = F.array_sort(F.filter(_col(preprocessers), lambda step: step != "empty"))
    parts = [F.concat(F.lit('"featuriser": '), json_string(featuriser))]
    if finetune is not None:
        flag = F.coalesce(_col(finetune), F.lit(False))
        written = F.concat(F.lit('"finetune": '), F.when(flag, "true").otherwise("false"))
        parts.append(F.when(flag, written) if legacy else written)
    parts += [
        F.concat(F.lit('"model": '), json_string(model)),
        F.concat(F.lit('"preprocesser_order": ['), F.array_join(F.transform(steps, json_string), ", "), F.lit("]")),
    ]
    if seed is not None:
        parts.append(F.concat(F.lit('"seed": '), _col(seed).cast("string")))
    parts.append(F.concat(F.lit('"tokeniser": '), json_string(tokeniser)))
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def config_hash(**fields) -> Column:
    return F.sha2(canonical_config(**fields), 256)


def seed_from_path(path: Column | str) -> Column:
    found = F.regexp_extract(_col(path), r"seed_(\d+)", 1)
    return F.when(found != "", found.try_cast("int"))


def strip_suffix(c: Column | str, suffix: str) -> Column:
    text = _col(c)
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def split_step_names(concatenated: Column | str, names: Sequence[str] = STEP_NAMES) -> Column:
    """`lowercasestem` -> [lowercase, stem]. No name is a prefix of another, so one pass is enough."""
    return F.regexp_extract_all(_col(concatenated), F.lit("(" + "|".join(names) + ")"), F.lit(1))


def split_step_error(concatenated: Column | str, names: Sequence[str] = STEP_NAMES) -> Column:
    """NULL when the whole text was recognised, otherwise a message naming it."""
    text = _col(concatenated)
    rest = F.regexp_replace(text, "(" + "|".join(names) + ")", "")
    return F.when(rest != "", F.concat(F.lit("unknown step in "), text))


def result_path(
    root: str, preprocessers: Column | str, tokeniser: Column | str, featuriser: Column | str,
    model: Column | str, seed: Column | str, finetune: Column | str,
) -> Column:
    """Directory of a result; steps are written in the order given, none gives no such level."""
    steps = F.array_join(F.filter(_col(preprocessers), lambda step: step != "empty"), "")
    return F.concat_ws(
        "/", F.lit(root),
        F.when(steps != "", F.concat(F.lit(PATH_PREFIX), steps)),
        F.concat(F.lit("tokeniser_"), _col(tokeniser)),
        F.concat(F.lit("featuriser_"), _col(featuriser)),
        F.concat(F.lit("model_"), _col(model)),
        F.concat(F.lit("seed_"), _col(seed).cast("string")),
        F.when(F.coalesce(_col(finetune), F.lit(False)), "finetune"),
    )


def canonical_path(path: Column | str, names: Sequence[str] = STEP_NAMES) -> Column:
    """The path with the step names inside its `preprocessers_` level in sorted order."""
    def level(part: Column) -> Column:
        steps = split_step_names(F.substring(part, F.lit(len(PATH_PREFIX) + 1), F.length(part)), names)
        return F.when(
            part.startswith(PATH_PREFIX), F.concat(F.lit(PATH_PREFIX), F.array_join(F.array_sort(steps), ""))
        ).otherwise(part)

    return F.array_join(F.transform(F.split(_col(path), "/"), level), "/")


def number_text(x: Column | str) -> Column:
    """`<0.001`, three decimals below one, else whole with thousands separators."""
    value = _col(x)
    return (
        F.when(F.abs(value) < 0.001, "<0.001")
        .when(F.abs(value) < 1, F.format_number(value, 3))
        .otherwise(F.format_number(value, 0))
    )


def _fixed(x: Column, digits: int) -> Column:
    """Fixed decimals, rounding the exact binary value half-even."""
    return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))


def duration_text(seconds: Column | str) -> Column:
    s = _col(seconds).cast("double")
    return (
        F.when(s > 3600, F.concat(_fixed(s / 3600, 2), F.lit("h")))
        .when(s > 60, F.concat(_fixed(s / 60, 2), F.lit("m")))
        .otherwise(F.concat(_fixed(s, 2), F.lit("s")))
    )


# Label clean-up for report tables, applied in this order.
REPORT_LABELS = [
    ("_", "-"), ("%", "\\%"), ("rmse-test", "RMSE"), ("featuriser", "featurizer"),
    ("tokeniser", "tokenizer"), ("rmse-test", "rmse"), ("<", "\\textless"), (">", "\\textgreater"),
    ("obl", "\\named{obl}"), ("jcp", "\\named{jcp}"),
]


def replace_chain(c: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    out = _col(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def report_label(c: Column | str) -> Column:
    return replace_chain(c, REPORT_LABELS)


def axis_title(c: Column | str) -> Column:
    """Blanks for underscores, and every run of letters with a capital first, also after digits and marks."""
    runs = F.regexp_extract_all(F.replace(_col(c), F.lit("_"), F.lit(" ")), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")


def output_name(c: Column | str) -> Column:
    """Punctuation dropped, outer blanks trimmed, inner blanks as underscores."""
    return F.replace(F.trim(F.translate(_col(c), PUNCTUATION, "")), F.lit(" "), F.lit("_"))


def squared_error(prediction: Column | str = "prediction", label: Column | str = "label") -> Column:
    error = _col(prediction) - _col(label)
    return error * error


def absolute_error(prediction: Column | str = "prediction", label: Column | str = "label") -> Column:
    return F.abs(_col(prediction) - _col(label))
