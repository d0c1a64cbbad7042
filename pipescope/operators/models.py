"""Regressors on feature vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipescope.operators.curves import early_stop, with_slots

SEED = 97


@dataclass
class MeanModel:
    """Predicts one number."""

    value: float

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value))

    def frame(self, spark) -> DataFrame:
        return spark.range(1).select(F.lit(self.value).alias("pred"))


def fit_mean(df: DataFrame, label: str = "label") -> MeanModel:
    """Mean label of train and val."""
    return MeanModel(df.where(F.col("split").isin("train", "val")).agg(F.avg(label)).first()[0])


def fit_linear(train: DataFrame, label: str = "label", features: str = "features", solver: str = "auto",
               max_iter: int = 1000) -> LinearRegressionModel:
    """Least squares with intercept; `solver` and `max_iter` are Spark's. A fit that ends without converging
    is an error.

    The purely linear network is the same function class and uses this fit as well.
    """
    model = LinearRegression(featuresCol=features, labelCol=label, regParam=0.0, solver=solver, maxIter=max_iter).fit(train)
    if model.hasSummary and model.summary.totalIterations >= max_iter:
        raise RuntimeError(f"the linear fit did not converge in {max_iter} iterations")
    return model


def coefficients(model: LinearRegressionModel, spark, names: list[str] | None = None) -> DataFrame:
    """(term, coef), the intercept last."""
    values = model.coefficients.toArray().tolist()
    named = names or [f"x{i}" for i in range(len(values))]
    rows = [*zip(named, values), ("(intercept)", float(model.intercept))]
    return spark.createDataFrame(rows, "term string, coef double")


def best_round(losses: list[float], patience: int, spark) -> int:
    """Number of trees with the lowest validation loss before patience runs out."""
    curve = spark.createDataFrame([(0, i - 1, float(v)) for i, v in enumerate(losses)],
                                  "run_id int, epoch int, val_loss double")
    row = early_stop(with_slots(curve), patience).first()
    return row["best_epoch"] + 2  # the first loss, epoch -1, belongs to one tree


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model of the first `n` rounds: boosting adds trees one after the other, so it is a prefix."""
    java, context = model._java_obj, SparkContext._active_spark_context
    trees = context._gateway.new_array(context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = context._gateway.new_array(context._jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    short = context._jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights)
    short.setFeaturesCol(model.getFeaturesCol())
    short.setPredictionCol(model.getPredictionCol())
    return GBTRegressionModel(short)


def fit_boosted(
    df: DataFrame, label: str = "label", features: str = "features", depth: int = 6, rate: float = 0.03,
    rounds: int = 1000, patience: int = 10,
) -> GBTRegressionModel:
    """Boosted trees on train, cut back to the round chosen by early stopping on val."""
    train = df.where(F.col("split") == "train")
    val = df.where(F.col("split") == "val")
    model = GBTRegressor(featuresCol=features, labelCol=label, maxDepth=depth, stepSize=rate, maxIter=rounds,
                         seed=SEED, lossType="squared").fit(train)
    keep = best_round(model.evaluateEachIteration(val, "squared"), patience, df.sparkSession)
    return model if keep >= rounds else first_trees(model, keep)


def boosted_a(df: DataFrame, **kw) -> GBTRegressionModel:
    return fit_boosted(df, **{"depth": 6, "rate": 0.03, **kw})


def boosted_b(df: DataFrame, **kw) -> GBTRegressionModel:
    """As A with rate 0.3. Spark's trees have no L2 penalty on leaf values."""
    return fit_boosted(df, **{"depth": 6, "rate": 0.3, **kw})
