"""Readers, writers and streams: what is written to the shared folder is read back and compared."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipescope.functions.text import whitespace_tokens
from pipescope.operators import aggregates as ag
from pipescope.operators import experiments as ex
from pipescope.operators import hypothesis as hy
from pipescope.operators import ranking as rk
from pipescope.operators import results as rs
from pipescope.operators import vocabulary as vo
from pipescope.plans.catalog.base import CORPUS, PANEL, PREDS, RAW, RESULTS, query, rnd, words_sql
from pipescope.plans.catalog.bookkeeping import HASHED, HASHED_LOG, hashed_log, hashed_results
from pipescope.session import scratch_path
from pipescope.sources import files as fl
from pipescope.sources import views as v
from pipescope.streaming import intake


@query("corpus_csv_roundtrip", f"WITH {CORPUS} SELECT md5(text) AS text_md5, label FROM corpus")
def corpus_csv_roundtrip(spark, d):
    path = scratch_path(spark, "corpus.csv")
    fl.write_csv(v.corpus(spark, d).select("text", "label"), path)
    return fl.read_corpus_csv(spark, path).select(F.md5("text").alias("text_md5"), "label")


def _rows_sql(part: str, text: str, label: str, table: str) -> str:
    """Rows with the id `with_row_id` gives them."""
    return (f"SELECT text, label, md5(concat_ws(chr(0), '{part}', text, CAST(label AS VARCHAR), CAST(i AS VARCHAR))) AS doc_id FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY text, label) AS i FROM (SELECT {text} AS text, {label} AS label FROM {table}))")


@query("loaded_corpus", f"""WITH rest AS ({_rows_sql('train', 'text', 'CAST(n_chars AS DOUBLE)', 'documents')}),
placed AS (SELECT *, row_number() OVER (ORDER BY md5('4:' || doc_id)) <= ceil(0.25 * count(*) OVER ()) AS is_val FROM rest),
test AS ({_rows_sql('test', 'text', 'CAST(length(text) AS DOUBLE)', 'benchmark')})
SELECT doc_id, md5(text) AS text_md5, label, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split FROM placed
UNION ALL SELECT doc_id, md5(text), label, 'test' FROM test""")
def loaded_corpus(spark, d):
    """A named corpus from its files, with repeated rows told apart and splits of exact sizes."""
    root, name = scratch_path(spark, "datasets"), sorted(fl.FILE_CORPORA)[0]
    fl.write_csv(v.table(spark, d, "documents").select("text", F.col("n_chars").cast("double").alias("label")), f"{root}/{name}/train.csv")
    fl.write_csv(v.table(spark, d, "benchmark").select("text", F.length("text").cast("double").alias("label")), f"{root}/{name}/test.csv")
    return fl.load_corpus(spark, name, 4, root).select("doc_id", F.md5("text").alias("text_md5"), "label", "split")


@query("preprocessed_csv", "SELECT md5(lower(text)) AS text_md5 FROM documents")
def preprocessed_csv(spark, d):
    path = scratch_path(spark, "corpus.csv")
    fl.write_csv(v.corpus(spark, d).select("text", "label"), path)
    done = fl.preprocess_csv(spark, "lowercase", path, scratch_path(spark, "out"))
    return fl.read_corpus_csv(spark, done, "text STRING").select(F.md5("text").alias("text_md5"))


def flat_records(spark, d):
    """Result records with every metric for every split, derived from the result view."""
    raw = v.raw_results(spark, d)
    metrics = {f"{m}_{s}": F.col("rmse") * (i + 1) / (j + 1)
               for i, m in enumerate(fl.METRICS) for j, s in enumerate(rs.SPLITS)}
    times = {"preprocess_time": F.col("total_time") / 4, "model_time": F.col("total_time") * 3 / 4}
    return raw.withColumns({**metrics, **times}).drop("mask", "rmse")


@query("result_files_roundtrip", f"""WITH {RAW}
SELECT array_to_string(preprocessers, ',') AS preprocessers, tokeniser, featuriser, model, finetune, seed,
  approx(rmse, 4) AS rmse_train, approx(rmse / 3, 4) AS rmse_test, approx(rmse * 2 / 2, 4) AS mae_val, total_time
FROM raw_results""")
def result_files_roundtrip(spark, d):
    """Nested records in one folder per seed; the seed is only in the path, as in early records."""
    root = scratch_path(spark, "results")
    records = fl.nested_records(flat_records(spark, d))
    folder = F.concat(F.lit("seed_"), F.col("seed").cast("string"))
    fl.write_results(records.withColumn("run", folder).drop("seed"), root, ["run"])
    read = rs.unnest_one_level(fl.read_results(spark, root, pattern="*.json"))
    return read.select(
        F.array_join("preprocessers", ",").alias("preprocessers"), "tokeniser", "featuriser", "model", "finetune",
        "seed", rnd("rmse_train").alias("rmse_train"), rnd("rmse_test").alias("rmse_test"),
        rnd("mae_val").alias("mae_val"), "total_time",
    )


@query("result_layout", f"""WITH {RAW}
SELECT model, seed, tokeniser, featuriser, finetune, count(*) AS n FROM raw_results GROUP BY ALL""")
def result_layout(spark, d):
    """A folder level per configuration value: a filter on one of them reads only its folders."""
    path = scratch_path(spark, "layout")
    levels = ["tokeniser", "featuriser", "model", "seed", "finetune"]
    # rows of a folder are brought together before writing, so a folder gets few files
    fl.write_results(v.raw_results(spark, d).repartition(*levels), path, levels)
    schema = "preprocessers array<string>, rmse double, tokeniser string, featuriser string, model string, seed int, finetune boolean"
    read = spark.read.schema(schema).json(path)
    return read.groupBy("model", "seed", "tokeniser", "featuriser", "finetune").agg(F.count(F.lit(1)).alias("n"))


@query("performance_csv_roundtrip", f"""WITH {RESULTS}
SELECT model AS method, count(*) AS n, approx(avg(rmse), 4) AS mean FROM results GROUP BY model""")
def performance_csv_roundtrip(spark, d):
    path = scratch_path(spark, "performances")
    fl.write_performances(v.results(spark, d), path)
    read = fl.read_performances(spark, path, "model", "rmse", ["codes", "tokeniser", "featuriser", "seed"])
    return read.groupBy("method").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("value")).alias("mean"))


@query("all_performances", f"""WITH {RESULTS}
SELECT array_to_string(preprocessers, ',') AS preprocessers, codes, tokeniser, featuriser, model, finetune, seed,
  approx(rmse, 4) AS rmse, md5(concat_ws('_', codes, tokeniser, featuriser, model, finetune::VARCHAR)) AS hash FROM results""")
def all_performances(spark, d):
    return fl.performances(v.results(spark, d)).withColumn("rmse", rnd("rmse"))


@query("predictions_roundtrip", f"""WITH {PREDS}
SELECT split, count(*) AS n, approx(sum(prediction), 2) AS prediction, approx(sum(label), 2) AS label FROM preds GROUP BY split""")
def predictions_roundtrip(spark, d):
    path = scratch_path(spark, "preds")
    fl.write_predictions(v.predictions(spark, d), path)
    schema = "prediction double, label double, split string"
    read = spark.read.schema(schema).option("header", True).csv(path)
    return read.groupBy("split").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("prediction"), 2).alias("prediction"),
                                     rnd(F.sum("label"), 2).alias("label"))


@query("scaling_params_roundtrip", f"""WITH {PREDS}
SELECT approx(avg(label), 4) AS mean, approx(stddev_pop(label), 4) AS std FROM preds WHERE split = 'train'""")
def scaling_params_roundtrip(spark, d):
    path = scratch_path(spark, "params")
    fl.write_params(ag.scaling_params(v.predictions(spark, d)), path)
    read = spark.read.schema("mean double, std double").json(path)
    return read.select(rnd("mean").alias("mean"), rnd("std").alias("std"))


@query("reconciliation_roundtrip", f"""WITH {HASHED}
SELECT CASE WHEN l.hash IS NULL THEN 'results_only' WHEN r.hash IS NULL THEN 'log_only' ELSE 'shared' END AS side,
  count(*) AS n, count(l.error) AS errors
FROM hashed_log l FULL JOIN hashed_results r USING (hash) GROUP BY 1""")
def reconciliation_roundtrip(spark, d):
    path = scratch_path(spark, "sides")
    fl.write_reconciliation(ex.reconcile(hashed_log(spark, d), hashed_results(spark, d)), path)
    read = spark.read.schema("hash string, status string, error string, side string").json(path)
    return read.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("errors"))


@query("log_objects_roundtrip", f"""WITH {HASHED_LOG}
SELECT hash, array_to_string(list_sort(preprocessers), ',') AS preprocessers, tokeniser, featuriser, model, finetune, seed,
       status, error FROM hashed_log""")
def log_objects_roundtrip(spark, d):
    """Log files of one object (hash -> record) each, cut by hash prefix, read back entry by entry."""
    path = scratch_path(spark, "log")
    log = hashed_log(spark, d)
    # as many leading digits as keep an object at some hundred entries
    digits = max(1, math.ceil(math.log(max(1, log.count() / 400), 16)))
    entry = F.struct(F.col("preprocessers").alias("preprocesser_order"), "tokeniser", "featuriser", "model", "finetune",
                     "seed", "status", "error")
    objects = log.groupBy(F.substring("hash", 1, digits).alias("shard")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("hash", entry.alias("entry"))))).alias("value")
    )
    objects.repartition("shard").write.partitionBy("shard").text(path)
    return fl.read_log(spark, path).select(
        "hash", F.array_join(F.array_sort("preprocessers"), ",").alias("preprocessers"), "tokeniser", "featuriser",
        "model", "finetune", "seed", "status", "error",
    )


@query("failed_records_file", f"""WITH {HASHED_LOG}
SELECT hash, seed, status, error FROM hashed_log WHERE status = 'failed'""")
def failed_records_file(spark, d):
    """The failed entries of a log as a file of their own."""
    path = scratch_path(spark, "failed")
    failed = hashed_log(spark, d).where("status = 'failed'")
    failed.select("hash", "preprocessers", "tokeniser", "featuriser", "model", "finetune", "seed", "status", "error").write.json(path)
    return spark.read.schema("hash string, seed int, status string, error string").json(path)


@query("ranking_tables_roundtrip", f"""WITH {PANEL}, r AS (SELECT *, rank() OVER (PARTITION BY experiment ORDER BY value DESC)
    + (count(*) OVER (PARTITION BY experiment, value) - 1) / 2.0 AS rank FROM panel)
SELECT 'rank' AS kind, method AS name, approx(avg(rank), 6) AS value FROM r GROUP BY method
UNION ALL SELECT 'wins', method, approx(count(*) FILTER (rank = 1), 6) FROM r GROUP BY method
UNION ALL SELECT 'zeros', x.method || '|' || y.method, approx(count(*) FILTER (x.value = y.value), 6)
FROM panel x JOIN panel y ON x.experiment = y.experiment AND x.method < y.method GROUP BY ALL""")
def ranking_tables_roundtrip(spark, d):
    """Average ranks, wins and the tests of all pairs, each written as a CSV table and read back."""
    root, panel = scratch_path(spark, "ranking"), v.panel(spark, d)
    fl.write_csv(rk.average_ranks(panel), f"{root}/ranks")
    fl.write_csv(rk.wins(panel), f"{root}/wins")
    fl.write_csv(hy.holm(hy.wilcoxon_pairs(panel)), f"{root}/pairs")

    def read(name):
        return spark.read.option("header", True).option("escape", '"').csv(f"{root}/{name}")

    def rows(df, kind, name, value):
        return df.select(F.lit(kind).alias("kind"), name.alias("name"), rnd(F.col(value).cast("double"), 6).alias("value"))

    return (rows(read("ranks"), "rank", F.col("method"), "average_rank").union(rows(read("wins"), "wins", F.col("method"), "wins"))
            .union(rows(read("pairs"), "zeros", F.concat_ws("|", "a", "b"), "zeros")))


@query("side_params_joined", f"""WITH {RAW}, s AS (SELECT model, avg(total_time) AS mean, stddev_pop(total_time) AS std
  FROM raw_results WHERE model <> 'resnet' GROUP BY model)
SELECT r.model, count(*) AS n, approx(any_value(mean), 4) AS mean, approx(any_value(std), 4) AS std
FROM raw_results r LEFT JOIN s USING (model) GROUP BY r.model""")
def side_params_joined(spark, d):
    """Scaling parameters from the file beside each result file; one folder has none."""
    root, raw = scratch_path(spark, "beside"), v.raw_results(spark, d)
    runs = raw.withColumn("run", F.col("model"))
    fl.write_results(runs.repartition("run"), root, ["run"])
    params = runs.where("model <> 'resnet'").groupBy("run").agg(F.avg("total_time").alias("mean"), F.stddev_pop("total_time").alias("std"))
    params.select("run", F.to_json(F.struct("mean", "std")).alias("value")).write.mode("append").partitionBy("run").text(root)
    results = fl.read_results(spark, root, raw.select("model", "total_time", "seed").schema, "*.json")
    joined = fl.with_side_params(results, root, "*.txt")
    return joined.groupBy("model").agg(F.count(F.lit(1)).alias("n"), rnd(F.max("mean")).alias("mean"), rnd(F.max("std")).alias("std"))


@query("word_lines_roundtrip", f"SELECT DISTINCT unnest({words_sql('text')}) AS value FROM documents")
def word_lines_roundtrip(spark, d):
    path = scratch_path(spark, "words")
    words = vo.distinct_words(v.table(spark, d, "documents"), whitespace_tokens("text"))
    fl.write_lines(words.select("token"), path)
    return spark.read.text(path)


_EVENTS = """e AS (SELECT md5(concat_ws(':', user_id, event_type)) AS hash, event_id, ts, user_id AS seed,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events)"""


@query("streamed_log_state", f"""WITH {_EVENTS}
SELECT hash, event_id, seed, status FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ts DESC, event_id DESC) AS place FROM e) WHERE place = 1""")
def streamed_log_state(spark, d):
    return intake.upsert_log(intake.event_stream(spark, d)).select("hash", "event_id", "seed", "status")


@query("streamed_unique_results", f"WITH {_EVENTS} SELECT DISTINCT hash FROM e")
def streamed_unique_results(spark, d):
    return intake.first_per_hash(intake.event_stream(spark, d)).select("hash")


@query("streamed_status_counts", f"WITH {_EVENTS} SELECT seed, status, count(*) AS n FROM e GROUP BY 1, 2")
def streamed_status_counts(spark, d):
    return intake.status_counts(intake.event_stream(spark, d))


@query("run_events_appended", f"""WITH {_EVENTS}
SELECT hash, event_id, status FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ts DESC, event_id DESC) AS place FROM e) WHERE place = 1""")
def run_events_appended(spark, d):
    """Two independent appends, then the latest state per hash."""
    path = scratch_path(spark, "events")
    events = intake.as_run_events(v.table(spark, d, "events"))
    for status in ("success", "failed"):
        fl.append_run_events(events.where(F.col("status") == status), path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_ts", T.TimestampType()),
                           T.StructField("hash", T.StringType()), T.StructField("seed", T.LongType()),
                           T.StructField("status", T.StringType())])
    return ex.latest_state(spark.read.schema(schema).json(path)).select("hash", "event_id", "status")
