"""How much spread each part of a configuration is responsible for."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipescope.operators.aggregates import CONFIG, UPSTREAM, spread

Aggregate = str | Callable[[Column], Column]


def spread_over_model(
    df: DataFrame, metric: str, aggregate: Aggregate = "var", by: Sequence[str] = ()
) -> DataFrame:
    """Per upstream configuration seen with more than one model: spread of the replicate means.

    `models` lists the models; it has one entry per distinct model, so it stays short.
    """
    means = df.groupBy(*by, *CONFIG).agg(F.avg(metric).alias(metric))
    return (
        means.groupBy(*by, *UPSTREAM)
        .agg(
            spread(aggregate)(F.col(metric)).alias("spread"), F.count(F.lit(1)).alias("models_n"),
            F.array_join(F.sort_array(F.collect_list("model")), ",").alias("models"),
        )
        .where("models_n > 1")
    )


def spread_over_rest(
    df: DataFrame, metric: str, aggregate: Aggregate = "var", step: str = "model", by: Sequence[str] = ()
) -> DataFrame:
    """Per value of a step: spread of the replicate means over everything else."""
    means = df.groupBy(*by, *CONFIG).agg(F.avg(metric).alias(metric))
    return means.groupBy(*by, step).agg(
        spread(aggregate)(F.col(metric)).alias("spread"), F.count(F.lit(1)).alias("configs")
    )


def spread_over_replicate(
    df: DataFrame, metric: str, aggregate: Aggregate = "var", by: Sequence[str] = ()
) -> DataFrame:
    """Per configuration with more than one replicate: spread between its replicates."""
    return (
        df.groupBy(*by, *CONFIG)
        .agg(spread(aggregate)(F.col(metric)).alias("spread"), F.count(F.lit(1)).alias("replicates"))
        .where("replicates > 1")
    )


def expected(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Expected spread: the plain mean over groups (a group of one has no spread and is skipped)."""
    return groups.groupBy(*by).agg(F.avg("spread").alias("expected"), F.count(F.lit(1)).alias("groups"))


def decomposition(df: DataFrame, metric: str, aggregate: Aggregate = "var", by: Sequence[str] = ()) -> DataFrame:
    """One row per component (model, upstream, replicate) and partition."""
    parts = {
        "model": spread_over_model(df, metric, aggregate, by),
        "upstream": spread_over_rest(df, metric, aggregate, by=by),
        "replicate": spread_over_replicate(df, metric, aggregate, by),
    }
    rows = [expected(groups, by).withColumn("component", F.lit(name)) for name, groups in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def decomposition_table(df: DataFrame, metric: str, aggregate: Aggregate = "var", by: Sequence[str] = ()) -> DataFrame:
    """The same with components as columns."""
    long = decomposition(df, metric, aggregate, by)
    return long.groupBy(*by).pivot("component", ["model", "upstream", "replicate"]).agg(F.first("expected"))


def finetuned(df: DataFrame) -> DataFrame:
    return df.withColumn("finetuned", F.col("model").contains("_ft"))
