"""One experiment end to end: preprocess, tokenise, featurise, fit, predict, evaluate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipescope.functions import registry
from pipescope.operators import boosting
from pipescope.operators import features as ft
from pipescope.operators import models as md
from pipescope.operators.aggregates import evaluate
from pipescope.session import cut_lineage

PART_BYTES = 32 << 20  # of text in a partition; a task of Spark's term counting reads about as much


@dataclass(frozen=True)
class Config:
    preprocessers: Sequence[str] = ()
    tokeniser: str = "whitespace"
    featuriser: str = "bow_count"
    model: str = "linear_regression"
    max_features: int = ft.MAX_FEATURES
    model_options: dict = field(default_factory=dict)


def featurise(tokenised: DataFrame, config: Config, vectors: DataFrame | None = None, width: int = 0) -> DataFrame:
    """Add `features`; whatever is learned comes from the train split."""
    train = tokenised.where("split = 'train'")
    if config.featuriser in ("bow_count", "bow_binary"):
        fitted = ft.bow_estimator(config.max_features, config.featuriser == "bow_binary").fit(train)
        return fitted.transform(tokenised)
    if config.featuriser == "tf_idf":
        return ft.fit_tf_idf(train, config.max_features).transform(tokenised)
    if vectors is None:
        raise ValueError(f"featuriser {config.featuriser!r} needs a table of word vectors")
    if config.featuriser == "glove_mean":
        pooled = ft.mean_vectors(tokenised, vectors, width)
    elif config.featuriser == "bert_mean":
        pooled = ft.mean_vectors(tokenised, vectors, width, normalise=False)
    elif config.featuriser == "bert_cls":
        pooled = ft.first_vector(tokenised, ft.token_vector_rows(tokenised, vectors), width)
    else:
        raise ValueError(f"unknown featuriser {config.featuriser!r}")
    return tokenised.join(pooled.select("doc_id", array_to_vector("features").alias("features")), "doc_id")


def fit_model(featurised: DataFrame, config: Config):
    train = featurised.where("split = 'train'")
    if config.model == "mean":
        return md.fit_mean(featurised)
    if config.model in ("linear_regression", "no_activation_mlp"):
        return md.fit_linear(train)
    if config.model == "catboost":
        return md.boosted_a(featurised, **config.model_options)
    if config.model == "xgboost":
        first = featurised.select("features").first()
        wide = first is not None and first[0].size > boosting.MAX_WIDTH
        return (md.boosted_b if wide else boosting.fit_penalised)(featurised, **config.model_options)
    raise ValueError(f"unknown model {config.model!r}")


def dealt(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """`rows` over as many partitions as the texts of `corpus` ask for, if they are fewer.

    Spark's estimators shuffle into as many partitions as they are given, which else follow files or join settings.
    """
    held = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = math.ceil(held / PART_BYTES)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def run(corpus: DataFrame, config: Config, vectors: DataFrame | None = None, width: int = 0,
        lexicons: dict[str, DataFrame] | None = None) -> tuple[DataFrame, object]:
    """(predictions with doc_id, split, prediction, label; the fitted model)."""
    cleaned = registry.apply_steps(corpus.select("doc_id", "split", "text", "label"), config.preprocessers, lexicons)
    # tokens and features are each read many times by the fits: written once to the shared folder
    tokenised = cut_lineage(
        dealt(registry.tokeniser(config.tokeniser)(cleaned).select("doc_id", "split", "label", "tokens"), corpus)
    )
    featurised = cut_lineage(
        featurise(tokenised, config, vectors, width).select("doc_id", "split", "label", "features")
    )
    model = fit_model(featurised, config)
    return model.transform(featurised).select("doc_id", "split", "prediction", "label"), model


def metrics(corpus: DataFrame, config: Config, **kw) -> DataFrame:
    """rmse, mae, r2, medae per split of one experiment."""
    return evaluate(run(corpus, config, **kw)[0])
