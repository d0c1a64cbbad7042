"""The study inputs as views over the star-schema test tables (FIXTURES.md part 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipescope.functions import scalar
from pipescope.operators.ordering import prior_totals, value_positions

# How table codes name the steps of an experiment.
MASK_NAMES = ["lemmatize", "lowercase", "no_punctuation", "no_stopwords_nltk", "stem"]
TOKENISER_OF_PRIORITY = {"1": "whitespace", "2": "bpe", "3": "bert", "4": "stanford", "5": "treebank"}
FEATURISER_OF_TYPE = {
    "ECONOMY": "bow_count", "LARGE": "bow_binary", "MEDIUM": "tf_idf",
    "PROMO": "bert_cls", "SMALL": "glove_mean", "STANDARD": "bert_mean",
}
MODEL_OF_FLAGS = {
    "AF": "relu_mlp", "AO": "no_activation_mlp", "NF": "resnet",
    "NO": "catboost", "RF": "xgboost", "RO": "linear_regression",
}
REPLICATE_SEEDS = [1, 2, 3, 97]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decode(column: Column, names: dict[str, str]) -> Column:
    """A small fixed mapping as one CASE expression."""
    out = None
    for code, name in names.items():
        out = F.when(column == code, name) if out is None else out.when(column == code, name)
    return out


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled corpus: doc_id, text, lang, source, label, quality."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id", "left").select(
        "doc_id", "text", "lang", "source", F.col("n_chars").cast("double").alias("label"), "quality"
    )


def raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result record per (experiment configuration, seed), before any cleaning.

    Grouping runs on the raw codes; names and lists are derived afterwards, once per group. Prices are
    summed as whole cents so that the average does not depend on the order of addition.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", ((F.col("l_linenumber") - 1) % 4).alias("replicate"), "l_returnflag", "l_linestatus",
                "l_extendedprice", "l_quantity")
    )
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.expr("p_size % 32").alias("mask"), F.substring_index("p_type", " ", 1).alias("kind")
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.substring("o_orderpriority", 1, 1).alias("priority")
    )
    grouped = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("mask", "priority", "kind", "l_returnflag", "l_linestatus", "replicate")
        .agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
            F.count(F.lit(1)).alias("n_lines"),
            F.sum("l_quantity").alias("total_time"),
        )
    )
    bits = [F.when(F.getbit("mask", F.lit(i)) == 1, name) for i, name in enumerate(MASK_NAMES)]
    featuriser = decode(F.col("kind"), FEATURISER_OF_TYPE)
    model = decode(F.concat("l_returnflag", "l_linestatus"), MODEL_OF_FLAGS)
    return grouped.select(
        F.when(F.col("mask") == 0, F.array(F.lit("empty"))).otherwise(F.array_compact(F.array(*bits)))
        .alias("preprocessers"),
        "mask",
        decode(F.col("priority"), TOKENISER_OF_PRIORITY).alias("tokeniser"),
        featuriser.alias("featuriser"),
        model.alias("model"),
        F.when(F.col("replicate") == 3, 97).otherwise(F.col("replicate") + 1).cast("int").alias("seed"),
        (featuriser.isin("bert_cls", "bert_mean")
         & model.isin("relu_mlp", "no_activation_mlp", "resnet")
         & (F.col("mask") % 2 == 0)).alias("finetune"),
        (F.col("cents") / (F.col("n_lines") * 100)).alias("rmse"),
        "total_time",
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results table of the studies: cleaned names, list codes, `_ft` models, excluded rows gone.

    `run_key` names one row; `config_key` one configuration without its seed.
    """
    from pipescope.operators.results import clean_records, exclude

    cleaned = clean_records(raw_results(spark, sf_dir))
    kept = exclude(cleaned, {"model": ["linear_regression"]}, list_substrings=["number"])
    named = kept.withColumn(
        "model", F.when(F.col("finetune"), F.concat("model", F.lit("_ft"))).otherwise(F.col("model"))
    )
    return named.withColumn("config_key", scalar.joined_key("codes", "tokeniser", "featuriser", "model")).withColumn(
        "run_key", scalar.joined_key("config_key", "seed")
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment log: config, seed, status, error; mostly the results, plus entries only logged."""
    base = (
        raw_results(spark, sf_dir)
        .withColumn("digest", results_digest())
        .select("preprocessers", "tokeniser", "featuriser", "model", "finetune", "seed", "digest")
    )
    first = F.substring("digest", 1, 1)
    # a row can be logged, be the origin of a log-only row, or both
    logged = F.when(~first.isin("0", "1"), F.col("seed"))
    log_only = F.when(first == "f", F.col("seed") + 1000)
    return (
        base.withColumn("seed", F.explode(F.array_compact(F.array(logged, log_only))))
        .withColumn("status", F.when(F.substring("digest", 2, 1).isin("0", "1", "2", "3"), "failed")
                    .otherwise("success"))
        .withColumn("error", F.when(F.col("status") == "failed", "OOM"))
    )


def results_digest() -> Column:
    return F.md5(F.concat_ws(":", F.col("mask").cast("string"), "tokeniser", "featuriser", "model",
                             F.col("seed").cast("string")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, prediction, label."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    split = (
        F.when(F.col("l_linenumber") <= 4, "train").when(F.col("l_linenumber") == 5, "val").otherwise("test")
    )
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        split.alias("split"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"),
        F.col("l_extendedprice").alias("label"),
    )


def loss_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, slot, epoch, val_loss: the events of a user in time order; the first is epoch -1.

    The day of an event is the bucket: each task orders one user's one day, and the days before it
    only contribute their counts.
    """
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.to_date("ts").alias("slot"), "ts", "event_id",
        F.col("value").alias("val_loss"),
    )
    totals = events.groupBy("run_id", "slot").agg(F.count(F.lit(1)).alias("_n"))
    offsets = prior_totals(totals, ["run_id"], "slot", {"_offset": F.sum("_n")})
    inside = Window.partitionBy("run_id", "slot").orderBy("ts", "event_id")
    return events.join(offsets, ["run_id", "slot"]).select(
        "run_id", "slot",
        (F.coalesce("_offset", F.lit(0)) + F.row_number().over(inside) - 2).cast("int").alias("epoch"),
        "val_loss",
    )


def word_counts(corpus_df: DataFrame) -> DataFrame:
    """(token, n) over the lowercased whitespace tokens."""
    from pipescope.functions.text import whitespace_tokens

    return (
        corpus_df.select(F.explode(whitespace_tokens(F.lower("text"))).alias("token"))
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, vec): tokens by falling frequency (ties by digest), each given the embedding of its rank."""
    counted = word_counts(table(spark, sf_dir, "documents")).withColumn("_less", -F.col("n"))
    ranked = value_positions(counted, "_less", ["token"]).select("token", (F.col("position") - 1).alias("vec_id"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return vectors.join(ranked, "vec_id").select("token", "vec")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(experiment, method, value) for the experiments in which every method occurs."""
    from pipescope.operators.ranking import complete_panel
    from pipescope.operators.results import clean_records

    cleaned = clean_records(raw_results(spark, sf_dir)).select(
        scalar.joined_key("codes", "tokeniser", "featuriser", "seed").alias("experiment"),
        F.col("model").alias("method"), F.col("rmse").alias("value"),
    )
    return complete_panel(cleaned)
