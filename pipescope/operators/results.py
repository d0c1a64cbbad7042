"""Cleaning, filtering and segmenting result records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short codes of preprocessing steps in report tables; unknown steps keep their name.
STEP_CODES = {
    "empty": "empty", "lemmatize": "Le", "lowercase": "Lo", "no_numbers_simple": "NN",
    "no_numbers_spacy": "NNSC", "no_punctuation": "NP", "no_stopwords_nltk": "NSN",
    "no_stopwords_spacy": "NSCC", "stem": "S",
}
# Substrings of model names that were renamed.
MODEL_RENAMES = [("relu_mlp", "mlp"), ("no_activation_mlp", "deep_linear")]
SPLITS = ("train", "val", "test")
DL_MODELS = ["mlp", "resnet", "deep_linear"]
GBDT_MODELS = ["catboost", "xgboost"]
BOW_FEATURISERS = ["bow_count", "bow_binary", "tf_idf"]
BERT_FEATURISERS = ["bert_cls", "bert_mean"]


def unnest_one_level(df: DataFrame, keys: Sequence[str] = SPLITS) -> DataFrame:
    """Move the named fields of every struct column up as `column_field`.

    Fields that are not named stay in the struct; a struct left without fields disappears.
    """
    kept, lifted = [], []
    for field in df.schema.fields:
        if not isinstance(field.dataType, T.StructType):
            kept.append(F.col(f"`{field.name}`"))
            continue
        inner = field.dataType.names
        lifted += [F.col(f"`{field.name}`.`{k}`").alias(f"{field.name}_{k}") for k in inner if k in keys]
        rest = [k for k in inner if k not in keys]
        if len(rest) == len(inner):
            kept.append(F.col(f"`{field.name}`"))
        elif rest:
            kept.append(F.struct(*[F.col(f"`{field.name}`.`{k}`").alias(k) for k in rest]).alias(field.name))
    return df.select(*kept, *lifted)


def null_if_empty(df: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Empty strings, lists and maps become NULL; with `drop_zero` also 0 and false.

    Pruning zeros too would lose a metric or seed that is really 0, so it must be asked for.
    """
    def cleaned(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.StringType):
            empty = column == ""
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            empty = F.size(column) == 0
        elif drop_zero and isinstance(kind, T.BooleanType):
            empty = ~column
        elif drop_zero and isinstance(kind, T.NumericType):
            empty = column == 0
        else:
            return column
        return F.when(empty, F.lit(None)).otherwise(column).alias(field.name)

    return df.select(*[cleaned(field) for field in df.schema.fields])


def rename_model(model: Column | str) -> Column:
    out = F.col(model) if isinstance(model, str) else model
    for old, new in MODEL_RENAMES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def step_codes(steps: Column | str) -> Column:
    """Sorted, comma-joined short codes of a step list."""
    code_of = F.create_map(*[F.lit(x) for pair in STEP_CODES.items() for x in pair])
    coded = F.transform(steps, lambda step: F.coalesce(F.try_element_at(code_of, step), step))
    return F.array_join(F.array_sort(coded), ",")


def clean_records(df: DataFrame, default_seed: int | None = None) -> DataFrame:
    """Renamed models, defaults for missing fields, sorted step lists and their codes."""
    steps = F.when(F.size("preprocessers") > 0, F.col("preprocessers"))
    out = df.withColumns({
        "model": rename_model("model"),
        "finetune": F.coalesce("finetune", F.lit(False)),
        "preprocessers": F.array_sort(F.coalesce(steps, F.array(F.lit("empty")))),
    })
    if default_seed is not None:
        out = out.withColumn("seed", F.coalesce("seed", F.lit(default_seed)))
    return out.withColumn("codes", step_codes("preprocessers"))


def columns_like(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part in c]


def undo_scaling(df: DataFrame, std: Column | str = "std", part: str = "rmse") -> DataFrame:
    factor = F.col(std) if isinstance(std, str) else std
    return df.withColumns({c: F.col(c) * factor for c in columns_like(df, part)})


def log_metrics(df: DataFrame, part: str = "rmse") -> DataFrame:
    return df.withColumns({c: F.ln(c) for c in columns_like(df, part)})


def exclude(
    df: DataFrame, values: Mapping[str, Sequence], list_column: str = "preprocessers",
    list_substrings: Sequence[str] = (),
) -> DataFrame:
    """Drop rows holding one of the values, or a list element containing one of the substrings."""
    for column, unwanted in values.items():
        if unwanted:
            df = df.where(~F.col(column).isin(list(unwanted)))
    for part in list_substrings:
        df = df.where(~F.exists(list_column, _contains(part)))
    return df


def _contains(part: str) -> Callable[[Column], Column]:
    return lambda item: item.contains(part)


def matching(
    df: DataFrame, matches: Sequence[tuple[str, str]] = (), differs: Sequence[tuple[str, str]] = (),
    equals: Sequence[tuple[str, str]] = (),
) -> DataFrame:
    """AND of conditions: `matches` searches a regular expression, `equals`/`differs` compare exactly."""
    conditions = (
        [F.col(c).rlike(pattern) for c, pattern in matches]
        + [F.col(c) == value for c, value in equals]
        + [F.col(c) != value for c, value in differs]
    )
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def segment_rules() -> dict[str, Column]:
    """The (overlapping) groups of results the studies compare."""
    model, featuriser = F.col("model"), F.col("featuriser")
    dl, bert = model.isin(DL_MODELS), featuriser.isin(BERT_FEATURISERS)
    bow, glove = featuriser.isin(BOW_FEATURISERS), featuriser == "glove_mean"
    return {
        "BERT+DL w/ Finetuning": model.contains("ft"),
        "BERT+DL w/o Finetuning": dl & bert,
        "Not BERT+DL": dl & ~bert,
        "BoW+DL": dl & bow,
        "GloVe+DL": dl & glove,
        "BERT w/o DL": ~dl & bert,
        "BoW": bow,
        "BoW + GBDT": ~dl & bow,
        "GloVe + GBDT": ~dl & glove,
        "BERT + GBDT": ~dl & bert,
    }


def bow_segment_rules() -> dict[str, Column]:
    """The comparison of bag-of-words features across model families (GloVe rows belong to none)."""
    model, featuriser = F.col("model"), F.col("featuriser")
    considered = featuriser != "glove_mean"
    dl, ft = model.isin(DL_MODELS), model.isin([f"{m}_ft" for m in DL_MODELS])
    bow, gbdt = featuriser.isin(BOW_FEATURISERS), model.isin(GBDT_MODELS)
    return {
        "DL w/ BoW": considered & dl & bow,
        "DL w/o BoW": considered & dl & ~bow,
        "DL w/ BoW + Finetuning": considered & ft & bow,
        "DL w/o BoW + Finetuning": considered & ft & ~bow,
        "GBDT w/ BoW": considered & gbdt & bow,
    }


def with_segments(df: DataFrame, rules: Mapping[str, Column], out: str = "model_type") -> DataFrame:
    """One row per segment a row belongs to, in a single pass (rows in no segment disappear)."""
    labels = [F.when(rule, F.lit(name)) for name, rule in rules.items()]
    return df.withColumn(out, F.explode(F.array_compact(F.array(*labels))))


def has_step(step: str, column: str = "preprocessers") -> Column:
    return F.array_contains(column, step)


def any_step_outside(allowed: Sequence[str], column: str = "preprocessers") -> Column:
    return F.exists(column, lambda step: ~step.isin(list(allowed)))


def by_step(df: DataFrame, steps: Sequence[str]) -> DataFrame:
    """One row per (row, step) telling whether the row used the step."""
    marks = F.array(*[F.struct(F.lit(s).alias("step"), has_step(s).alias("has")) for s in steps])
    return df.withColumn("_mark", F.explode(marks)).select("*", "_mark.*").drop("_mark")


def keep_groups(df: DataFrame, keys: Sequence[str], condition: Callable[[Column], Column]) -> DataFrame:
    """Rows whose group has a wanted number of members.

    Counting is a partial aggregation and the choice a semi join, so a group that holds most of the
    data is never gathered in one task as a window over it would.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    return df.join(sizes.where(condition(F.col("_size"))).select(*keys), list(keys), "left_semi")


def with_group_size(df: DataFrame, keys: Sequence[str], out: str = "group_size") -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return df.join(sizes, list(keys))


def drop_extremes(df: DataFrame, metric: str, key: str, k: int) -> DataFrame:
    """Without the k rows of largest metric (ties broken by key): a top-k and an anti join."""
    worst = df.select(metric, key).orderBy(F.desc(metric), F.desc(key)).limit(k).select(key)
    return df.join(worst, key, "left_anti")


def paired_by_feature(
    df: DataFrame, left: Sequence[str], right: Sequence[str], on: Sequence[str], metric: str,
    suffixes: tuple[str, str], carried: Sequence[str] = (),
) -> DataFrame:
    """Inner many-to-many join of two featuriser groups on equal keys, with the metric difference."""
    columns = [*carried, metric]

    def side(names: Sequence[str], suffix: str) -> DataFrame:
        return df.where(F.col("featuriser").isin(list(names))).select(
            *on, *[F.col(c).alias(f"{c}_{suffix}") for c in columns]
        )

    joined = side(left, suffixes[0]).join(side(right, suffixes[1]), list(on))
    return joined.withColumn(f"{metric}_diff", F.col(f"{metric}_{suffixes[1]}") - F.col(f"{metric}_{suffixes[0]}"))
