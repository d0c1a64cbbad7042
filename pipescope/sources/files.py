"""File readers and writers of corpora, result records, logs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipescope.functions.scalar import result_path, seed_from_path
from pipescope.functions.text import whitespace_tokens
from pipescope.operators.results import SPLITS
from pipescope.operators.sampling import split_corpus, split_train_val
from pipescope.session import cut_lineage
from pipescope.sources.split_csv import read_csv
from pipescope.sources.split_json import read_objects

METRICS = ("rmse", "mae", "r2", "medae")
# Corpora with their own train and test files.
FILE_CORPORA = [
    "jc_penney_products", "online_boat_listings", "online_boat_listings_no_foreign_languages",
]
SYNTHETIC_CORPUS = "test"
SYNTHETIC_DOCS, SYNTHETIC_TOKENS = 100, 500
COPIES_PER_RANGE = 10_000

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("preprocessers", T.ArrayType(T.StringType())),
        T.StructField("tokeniser", T.StringType()),
        T.StructField("featuriser", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("finetune", T.BooleanType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("total_time", T.DoubleType()),
        T.StructField("preprocess_time", T.DoubleType()),
        T.StructField("model_time", T.DoubleType()),
    ]
    + [
        T.StructField(m, T.StructType([T.StructField(s, T.DoubleType()) for s in SPLITS])) for m in METRICS
    ]
)
LOG_ENTRY = "struct<preprocesser_order:array<string>,tokeniser:string,featuriser:string,model:string," \
            "finetune:boolean,seed:int,status:string,error:string>"


# --- corpora ---------------------------------------------------------------------------------------


def read_corpus_csv(spark: SparkSession, path: str, schema: str = "text STRING, label DOUBLE") -> DataFrame:
    """Quoted CSV with a header; `NA` and empty fields are text, never NULL. Files are read by many tasks each, line
    breaks inside fields included."""
    df = read_csv(spark, path, schema)
    texts = {f.name: F.coalesce(f.name, F.lit("")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns(texts)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("errorifexists").option("header", True).option("escape", '"').option("quoteAll", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def load_corpus(spark: SparkSession, name: str, seed: int, root: str = "datasets",
                source: DataFrame | None = None) -> DataFrame:
    """A named corpus with its `split`. File corpora bring their test part; the synthetic one is cut
    from `source` (doc_id, text)."""
    if name == SYNTHETIC_CORPUS:
        if source is None:
            raise ValueError("the synthetic corpus needs a source of documents")
        return split_corpus(synthetic_corpus(source), seed)
    if name not in FILE_CORPORA:
        raise NotImplementedError(f"no loader is registered for corpus {name!r}")
    # written once: the split counts, orders and filters the ids, which each would read and shuffle the texts again
    rest = cut_lineage(with_row_id(read_corpus_csv(spark, f"{root}/{name}/train.csv").select("text", "label"), "train"))
    test = with_row_id(read_corpus_csv(spark, f"{root}/{name}/test.csv").select("text", "label"), "test")
    return split_train_val(rest, seed).unionByName(test.withColumn("split", F.lit("test")))


def with_row_id(corpus: DataFrame, part: str) -> DataFrame:
    """(text, label, doc_id) with an id for every row, repeated rows included.

    Equal rows are counted and numbered, and the id is a digest of part, text, label and number: it does not
    depend on files or partitions, and a row that occurs in a third of the corpus is one row while it is counted.
    """
    counted = corpus.groupBy("text", "label").agg(F.count(F.lit(1)).alias("_n"))
    # the copies of a row are numbered by ranges, which are dealt out before they are written out
    ranges = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES_PER_RANGE).cast("long"))))
    dealt = ranges.repartition("text", "label", "_from")
    rows = dealt.withColumn("_i", F.explode(F.sequence(F.col("_from") + 1, F.least("_n", F.col("_from") + COPIES_PER_RANGE))))
    digest = F.md5(F.concat_ws("\u0000", F.lit(part), "text", F.col("label").cast("string"), F.col("_i").cast("string")))
    return rows.select("text", "label", digest.alias("doc_id"))


def uniform(seed: int, key: Column, draw: str) -> Column:
    """A reproducible number in (0, 1) for a row."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(draw)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def normal(seed: int, key: Column) -> Column:
    """A reproducible standard normal number for a row (Box-Muller)."""
    radius = F.sqrt(-2 * F.ln(uniform(seed, key, "radius")))
    return radius * F.cos(2 * F.pi() * uniform(seed, key, "angle"))


def synthetic_corpus(source: DataFrame, docs: int = SYNTHETIC_DOCS, tokens: int = SYNTHETIC_TOKENS,
                     seed: int = 1) -> DataFrame:
    """The first documents cut to their first words, with random labels that never change."""
    words = F.slice(whitespace_tokens("text"), 1, tokens)
    return source.select("doc_id", "text").orderBy("doc_id").limit(docs).select(
        "doc_id", F.array_join(words, " ").alias("text"), normal(seed, F.col("doc_id")).alias("label")
    )


def preprocess_csv(spark: SparkSession, name: str, path: str, out_dir: str) -> str:
    """Apply one named step to the text of a CSV corpus; returns the folder written."""
    from pipescope.functions.registry import preprocesser

    step = preprocesser(name)
    keyed = read_corpus_csv(spark, path).withColumn("doc_id", F.monotonically_increasing_id())
    done = step(keyed).select("text")
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    target = f"{out_dir.rstrip('/')}/{name}_{stem}.csv"
    write_csv(done, target)
    return target


# --- result records --------------------------------------------------------------------------------


def read_results(spark: SparkSession, root: str, schema: T.StructType = RECORD_SCHEMA,
                 pattern: str = "*results.json", multi_line: bool = False) -> DataFrame:
    """Every result file below a folder, with `path` and the seed taken from it when missing.

    Records are one line each; `multi_line` reads files holding one indented record.
    """
    df = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .option("multiLine", multi_line).schema(schema).json(root)
    )
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("path")).withColumn("seed", F.coalesce("seed", seed_from_path("path")))


def directory(path: Column | str) -> Column:
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, "/[^/]*$", "")


def with_side_params(results: DataFrame, root: str, pattern: str = "normalisation_params.json") -> DataFrame:
    """Attach mean and std of the parameter file next to each result (NULL where there is none)."""
    spark = results.sparkSession
    params = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True)
        .schema("mean DOUBLE, std DOUBLE").json(root)
        .select(directory(F.col("_metadata.file_path")).alias("_dir"), "mean", "std")
    )
    return results.withColumn("_dir", directory("path")).join(params, "_dir", "left").drop("_dir")


def nested_records(df: DataFrame, metrics: Sequence[str] = METRICS, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Flat metric columns (`rmse_train`, ...) packed into one struct per metric."""
    flat = {f"{m}_{s}" for m in metrics for s in splits}
    packed = [F.struct(*[F.col(f"{m}_{s}").alias(s) for s in splits]).alias(m) for m in metrics]
    return df.select(*[c for c in df.columns if c not in flat], *packed)


def write_results(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Result records as JSON lines, optionally in a folder per configuration value."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def with_output_dir(df: DataFrame, root: str) -> DataFrame:
    return df.withColumn(
        "output_dir", result_path(root, "preprocessers", "tokeniser", "featuriser", "model", "seed", "finetune")
    )


def write_performances(df: DataFrame, path: str, metric: str = "rmse") -> None:
    """All configurations with their hash, sorted by the metric."""
    write_csv(performances(df, metric), path)


def performances(df: DataFrame, metric: str = "rmse") -> DataFrame:
    key = F.md5(F.concat_ws("_", "codes", "tokeniser", "featuriser", "model", F.col("finetune").cast("string")))
    return df.select(
        F.array_join("preprocessers", ",").alias("preprocessers"), "codes", "tokeniser", "featuriser", "model",
        "finetune", "seed", metric, key.alias("hash"),
    ).orderBy(metric, "hash", "seed")


def read_performances(spark: SparkSession, path: str, group: str, metric: str, experiment: Sequence[str]) -> DataFrame:
    """A performance CSV as (experiment, method, value) through three chosen column names."""
    from pipescope.operators.ranking import named_columns

    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(path)
    return named_columns(raw, group, metric, experiment)


def write_params(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_predictions(preds: DataFrame, path: str) -> None:
    """prediction,label in one CSV folder per split."""
    write_csv(preds.select("split", "prediction", "label"), path, ["split"])


def write_lines(values: DataFrame, path: str) -> None:
    """One sorted text column as lines."""
    column = values.columns[0]
    values.orderBy(column).select(F.col(column).cast("string").alias("value")).write.mode("errorifexists").text(path)


# --- logs ------------------------------------------------------------------------------------------


def read_log(spark: SparkSession, path: str, large: bool = False) -> DataFrame:
    """Log files, each one JSON object from hash to record, as one row per hash.

    A file is one row of one task; with `large` it is read entry by entry by many tasks, at the price of several passes.
    """
    if large:
        entries = read_objects(spark, path, LOG_ENTRY).withColumnRenamed("key", "hash")
    else:
        whole = spark.read.text(path, wholetext=True)
        entries = whole.select(F.explode(F.from_json("value", f"map<string,{LOG_ENTRY}>")).alias("hash", "entry"))
    return entries.select("hash", "entry.*").withColumnRenamed("preprocesser_order", "preprocessers")


def write_reconciliation(sides: DataFrame, path: str) -> None:
    """One folder per side; sides without rows get none."""
    sides.write.mode("errorifexists").partitionBy("side").json(path)


def append_run_events(events: DataFrame, path: str) -> None:
    """Run events are only ever appended; `latest_state` reads the current log out of them."""
    events.write.mode("append").json(path)


def removable_files(spark: SparkSession, root: str) -> DataFrame:
    """Files next to a results.json that are neither results, locks, predictions nor logs."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
        .withColumn("dir", directory("path")).withColumn("name", F.substring_index("path", "/", -1))
    )
    with_results = files.where(F.col("name") == "results.json").select("dir").distinct()
    unwanted = ~F.col("name").rlike(r"\.(json|lock)$") & ~F.col("name").contains("preds") & ~F.col("name").contains(
        "experiment_log"
    )
    return files.where(unwanted).join(with_results, "dir", "left_semi").select("path", "length")
