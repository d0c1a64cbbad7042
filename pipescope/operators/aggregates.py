"""Summaries of result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipescope.operators.ordering import exact_quantiles

CONFIG = ["codes", "tokeniser", "featuriser", "model"]
UPSTREAM = ["codes", "tokeniser", "featuriser"]
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def sem(c: Column | str) -> Column:
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def mean_improvement(c: Column | str) -> Column:
    """Expected gain over an arbitrary member by taking the best one."""
    return F.avg(c) - F.min(c)


# name -> aggregate expression; callers may add their own, including grouped-aggregate pandas UDFs
SPREADS: dict[str, Callable[[Column], Column]] = {
    "var": F.var_samp, "std": F.stddev_samp, "maximum_improvement": mean_improvement,
}


def spread(aggregate: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    if callable(aggregate):
        return aggregate
    if aggregate not in SPREADS:
        raise ValueError(f"unknown aggregate {aggregate!r}; known: {sorted(SPREADS)}")
    return SPREADS[aggregate]


def moments(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"),
        F.var_samp(metric).alias("var"), sem(metric).alias("sem"),
    )


def five_numbers(df: DataFrame, metric: str, keys: Sequence[str] = ()) -> DataFrame:
    """min, quartiles (interpolated), max and n per group."""
    return exact_quantiles(df, list(keys), metric, {"min": 0.0, **QUARTILES, "max": 1.0})


def fences(summary: DataFrame) -> DataFrame:
    """Outlier fence and plotting range from a five-number summary."""
    iqr = F.col("q3") - F.col("q1")
    return summary.withColumns({
        "fence": F.col("q3") + 1.5 * iqr,
        "axis_high": (F.col("median") + 1.5 * iqr) * 1.1,
        "axis_low": F.col("min") * 0.9,
    })


def replicate_means(df: DataFrame, metric: str, keys: Sequence[str] = CONFIG) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(metric).alias(metric), F.count("seed").alias("replicates"))


def per_config(df: DataFrame, metric: str, keys: Sequence[str] = CONFIG, replicates: int | None = None) -> DataFrame:
    """Mean, standard error and replicate count per configuration; optionally only complete ones."""
    out = df.groupBy(*keys).agg(
        F.avg(metric).alias("mean"), sem(metric).alias("sem"), F.count("seed").alias("replicates")
    )
    return out if replicates is None else out.where(F.col("replicates") == replicates)


def best(summary: DataFrame, k: int, keys: Sequence[str] = CONFIG) -> DataFrame:
    return summary.orderBy("mean", *keys).limit(k)


def worst(summary: DataFrame, k: int, keys: Sequence[str] = CONFIG) -> DataFrame:
    return summary.orderBy(F.desc("mean"), *[F.desc(key) for key in keys]).limit(k).orderBy("mean", *keys)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def list_value_counts(df: DataFrame, column: str, empty: str = "Empty") -> DataFrame:
    bag = F.when(F.size(column) == 0, F.array(F.lit(empty))).otherwise(F.col(column))
    return (
        df.select(F.explode(bag).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "value")
    )


def coverage(df: DataFrame, list_step: str = "preprocessers",
             steps: Sequence[str] = ("tokeniser", "featuriser", "model")) -> DataFrame:
    """How often every value of every step occurs: one pass over (step, value) pairs."""
    def pair(step: str, value: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), value.alias("value"))

    pairs = F.concat(
        F.transform(list_step, lambda v: pair(list_step, v)), F.array(*[pair(s, F.col(s)) for s in steps])
    )
    return df.select(F.explode(pairs).alias("p")).groupBy("p.step", "p.value").agg(F.count(F.lit(1)).alias("n"))


def reduction_in_error(df: DataFrame, metric: str, by: str = "model") -> DataFrame:
    """Best, worst, relative reduction and standard error per group, plus one row over everything."""
    rolled = df.rollup(by).agg(
        F.min(metric).alias("best"), F.max(metric).alias("worst"), sem(metric).alias("sem")
    )
    return rolled.select(
        F.coalesce(by, F.lit("(all)")).alias(by), "best", "worst", "sem",
        ((F.col("worst") - F.col("best")) / F.col("worst") * 100).alias("reduction"),
    )


def histogram(
    df: DataFrame, metric: str, bins: int = 100, group: str | None = None, low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Equal-width counts over the range (given or observed), per group, with percent shares."""
    kept = df
    if low is not None:
        kept = kept.where(F.col(metric) >= low)
    if high is not None:
        kept = kept.where(F.col(metric) <= high)
    bounds = kept.agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    lo, hi = F.lit(low).cast("double"), F.lit(high).cast("double")
    if low is None or high is None:
        binned = kept.withColumn("_range", bounds.select(F.struct("lo", "hi")).scalar())
        lo = lo if low is not None else F.col("_range.lo")
        hi = hi if high is not None else F.col("_range.hi")
    else:
        binned = kept
    number = F.when(hi > lo, F.least(F.floor((F.col(metric) - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(0)
    keys = [group] if group else []
    counts = binned.groupBy(*keys, number.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys)  # at most `bins` rows per group here
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(whole))


def box_stats(df: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (most extreme value inside 1.5 IQR) and the number of points beyond."""
    box = exact_quantiles(df, keys, metric, QUARTILES).drop("n")
    iqr = F.col("q3") - F.col("q1")
    low, high = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = F.col(metric).between(low, high)
    return (
        df.where(F.col(metric).isNotNull())
        .select(*keys, metric)
        .join(box, list(keys))
        .groupBy(*keys)
        .agg(
            *[F.first(q).alias(q) for q in QUARTILES],
            F.min(F.when(inside, F.col(metric))).alias("whisker_low"),
            F.max(F.when(inside, F.col(metric))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def segment_table(segmented: DataFrame, metric: str, digits: int = 0) -> DataFrame:
    return segmented.groupBy("model_type").agg(
        F.bround(F.avg(metric), digits).alias("mean"), F.bround(sem(metric), digits).alias("sem"),
        F.count(metric).alias("n"),
    )


def missing_seeds(df: DataFrame, expected: Sequence[int], keys: Sequence[str] = CONFIG) -> DataFrame:
    """Which of the expected seeds each partly replicated configuration still lacks."""
    seen = df.groupBy(*keys).agg(F.count("seed").alias("replicates"), F.collect_set("seed").alias("seen"))
    wanted = F.array(*[F.lit(s) for s in expected])
    partial = seen.where((F.col("replicates") > 1) & (F.col("replicates") < len(expected)))
    return partial.select(*keys, F.array_sort(F.array_except(wanted, "seen")).alias("missing"))


def sem_by_finetuning(complete: DataFrame) -> DataFrame:
    return complete.groupBy(F.col("model").contains("_ft").alias("finetuned")).agg(
        F.avg("sem").alias("mean_sem"), F.count("sem").alias("n")
    )


# regression metrics as aggregate expressions over (prediction, label); callers may add their own
def regression_metrics() -> dict[str, Column]:
    error = F.col("prediction") - F.col("label")
    total = F.var_pop("label") * F.count("label")
    return {
        "rmse": F.sqrt(F.avg(error * error)),
        "mae": F.avg(F.abs(error)),
        "r2": F.lit(1.0) - F.try_divide(F.sum(error * error), total),
    }


def evaluate(preds: DataFrame, keys: Sequence[str] = ("split",), extra: dict[str, Column] | None = None) -> DataFrame:
    """rmse, mae, r2 and median absolute error per group; `extra` adds aggregate expressions."""
    measured = {**regression_metrics(), **(extra or {})}
    moments_of = preds.groupBy(*keys).agg(*[c.alias(name) for name, c in measured.items()])
    errors = preds.select(*keys, F.abs(F.col("prediction") - F.col("label")).alias("_e"))
    medians = exact_quantiles(errors, list(keys), "_e", {"medae": 0.5}).select(*keys, "medae", "n")
    return moments_of.join(medians, list(keys))


def mean_baseline(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Predict the mean label of train and val; its rmse on test, in one pass.

    sum((y-m)^2) over test = n*var_pop + n*(mean_test - m)^2, so no second scan is needed.
    """
    seen = F.col("split").isin("train", "val")
    held = F.col("split") == "test"
    y = F.col(label)
    moments_of = labelled.agg(
        F.avg(F.when(seen, y)).alias("baseline"),
        F.avg(F.when(held, y)).alias("_mean"),
        F.var_pop(F.when(held, y)).alias("_var"),
        F.count(F.when(held, y)).alias("n_test"),
    )
    offset = F.col("_mean") - F.col("baseline")
    return moments_of.select("baseline", F.sqrt(F.col("_var") + offset * offset).alias("rmse"), "n_test")


def standardise(df: DataFrame, label: str = "label", out: str = "label_scaled") -> DataFrame:
    """(y - mean) / std with statistics of the train split and the population formula."""
    stats = scaling_params(df, label)
    scaled = df.withColumn("_scale", stats.select(F.struct("mean", "std")).scalar())
    return scaled.withColumn(out, (F.col(label) - F.col("_scale.mean")) / F.col("_scale.std")).drop("_scale")


def scaling_params(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col("split") == "train").agg(F.avg(label).alias("mean"), F.stddev_pop(label).alias("std"))
