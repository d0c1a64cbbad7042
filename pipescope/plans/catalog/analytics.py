"""Result analytics: cleaning, filters, summaries, variance decomposition, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipescope.operators import aggregates as ag
from pipescope.operators import curves as cv
from pipescope.operators import ordering as od
from pipescope.operators import ranking as rk
from pipescope.operators import results as rs
from pipescope.operators import variance as vr
from pipescope.plans.catalog.base import CURVES, PANEL, PREDS, RAW, RECORDS, RESULTS, query, rnd
from pipescope.sources import views as v

SEM = "stddev_samp(rmse) / sqrt(count(rmse))"
CFG = "codes, tokeniser, featuriser, model"


def steps(column: str = "preprocessers"):
    return F.array_join(column, ",").alias(column)


# --- cleaning and filters --------------------------------------------------------------------------


@query("best_configs", f"""WITH {RESULTS}
SELECT {CFG}, approx(avg(rmse), 8) AS mean, approx({SEM}, 4) AS sem, count(*) AS replicates FROM results
GROUP BY {CFG} HAVING count(*) = 4 ORDER BY avg(rmse), {CFG} LIMIT 10""")
def best_configs(spark, d):
    summary = ag.per_config(v.results(spark, d), "rmse", replicates=4)
    return ag.best(summary, 10).withColumns({"mean": rnd("mean", 8), "sem": rnd("sem")})


@query("worst_configs", f"""WITH {RESULTS}
SELECT {CFG}, approx(avg(rmse), 8) AS mean, approx({SEM}, 4) AS sem, count(*) AS replicates FROM results
GROUP BY {CFG} HAVING count(*) = 4
ORDER BY avg(rmse) DESC, codes DESC, tokeniser DESC, featuriser DESC, model DESC LIMIT 10""")
def worst_configs(spark, d):
    summary = ag.per_config(v.results(spark, d), "rmse", replicates=4)
    return ag.worst(summary, 10).withColumns({"mean": rnd("mean", 8), "sem": rnd("sem")})


@query("cleaned_records", f"""WITH {RECORDS}
SELECT array_to_string(preprocessers, ',') AS preprocessers, codes, tokeniser, featuriser, model, finetune, seed,
       approx(rmse, 4) AS rmse FROM records""")
def cleaned_records(spark, d):
    """Defaults are restored where the raw record lacks the field."""
    raw = v.raw_results(spark, d).withColumns({
        "preprocessers": F.when(F.col("mask") != 0, F.col("preprocessers")).otherwise(F.array()),
        "finetune": F.when(F.col("finetune"), F.lit(True)),
    })
    return rs.clean_records(rs.null_if_empty(raw), default_seed=97).select(
        steps(), "codes", "tokeniser", "featuriser", "model", "finetune", "seed", rnd("rmse").alias("rmse")
    )


@query("pruned_zero_fields", """SELECT l_returnflag, count(CASE WHEN l_discount <> 0 THEN 1 END) AS discounts,
  count(CASE WHEN l_tax <> 0 THEN 1 END) AS taxes, count(*) AS n FROM lineitem GROUP BY 1""")
def pruned_zero_fields(spark, d):
    rows = v.table(spark, d, "lineitem").select("l_returnflag", "l_discount", "l_tax")
    return rs.null_if_empty(rows, drop_zero=True).groupBy("l_returnflag").agg(
        F.count("l_discount").alias("discounts"), F.count("l_tax").alias("taxes"), F.count(F.lit(1)).alias("n")
    )


@query("results_table", f"""WITH {RESULTS}
SELECT {CFG}, seed, finetune, config_key, run_key, approx(rmse, 4) AS rmse, total_time FROM results""")
def results_table(spark, d):
    return v.results(spark, d).select(
        "codes", "tokeniser", "featuriser", "model", "seed", "finetune", "config_key", "run_key",
        rnd("rmse").alias("rmse"), "total_time",
    )


@query("excluded_rows", f"""WITH {RECORDS}
SELECT model, count(*) AS n FROM records
WHERE tokeniser NOT IN ('bpe', 'treebank')
  AND len(list_filter(preprocessers, lambda p: contains(p, 'stop'))) = 0 GROUP BY model""")
def excluded_rows(spark, d):
    records = rs.clean_records(v.raw_results(spark, d))
    kept = rs.exclude(records, {"tokeniser": ["bpe", "treebank"]}, list_substrings=["stop"])
    return kept.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("rescaled_metrics", f"""WITH {RESULTS}, params AS (
  SELECT seed, stddev_pop(rmse) AS std FROM results GROUP BY seed)
SELECT run_key, approx(rmse * std, 0) AS rmse, approx(ln(rmse * std), 6) AS log_rmse
FROM results JOIN params USING (seed)""")
def rescaled_metrics(spark, d):
    results = v.results(spark, d).select("run_key", "seed", "rmse")
    params = results.groupBy("seed").agg(F.stddev_pop("rmse").alias("std"))
    scaled = rs.undo_scaling(results.join(params, "seed"))
    logged = rs.log_metrics(scaled.withColumnRenamed("rmse", "plain").withColumn("log_rmse", F.col("plain")), "rmse")
    return logged.select("run_key", rnd("plain", 0).alias("rmse"), rnd("log_rmse", 6).alias("log_rmse"))


@query("matching_rows", f"""WITH {RESULTS}
SELECT run_key FROM results WHERE regexp_matches(model, 'ft') AND regexp_matches(featuriser, '^bert')
  AND model <> 'resnet_ft' AND tokeniser = 'bert'""")
def matching_rows(spark, d):
    return rs.matching(
        v.results(spark, d), matches=[("model", "ft"), ("featuriser", "^bert")], differs=[("model", "resnet_ft")],
        equals=[("tokeniser", "bert")],
    ).select("run_key")


_SEGMENTS = """segments AS (
  SELECT *, unnest(list_filter([
    CASE WHEN contains(model, 'ft') THEN 'BERT+DL w/ Finetuning' END,
    CASE WHEN dl AND bert THEN 'BERT+DL w/o Finetuning' END,
    CASE WHEN dl AND NOT bert THEN 'Not BERT+DL' END,
    CASE WHEN dl AND bow THEN 'BoW+DL' END,
    CASE WHEN dl AND glove THEN 'GloVe+DL' END,
    CASE WHEN NOT dl AND bert THEN 'BERT w/o DL' END,
    CASE WHEN bow THEN 'BoW' END,
    CASE WHEN NOT dl AND bow THEN 'BoW + GBDT' END,
    CASE WHEN NOT dl AND glove THEN 'GloVe + GBDT' END,
    CASE WHEN NOT dl AND bert THEN 'BERT + GBDT' END], lambda s: s IS NOT NULL)) AS model_type
  FROM (SELECT *, model IN ('mlp', 'resnet', 'deep_linear') AS dl, featuriser IN ('bert_cls', 'bert_mean') AS bert,
               featuriser IN ('bow_count', 'bow_binary', 'tf_idf') AS bow, featuriser = 'glove_mean' AS glove
        FROM results))"""
SEGMENTS = RESULTS + ",\n" + _SEGMENTS


@query("segment_table", f"""WITH {SEGMENTS}
SELECT model_type, round_even(avg(rmse), 0) AS mean, round_even({SEM}, 0) AS sem, count(*) AS n
FROM segments GROUP BY model_type""")
def segment_table(spark, d):
    return ag.segment_table(rs.with_segments(v.results(spark, d), rs.segment_rules()), "rmse")


@query("segment_grouped_means", f"""WITH {SEGMENTS}
SELECT config_key, model_type, approx(avg(rmse), 8) AS rmse FROM segments GROUP BY 1, 2""")
def segment_grouped_means(spark, d):
    segments = rs.with_segments(v.results(spark, d), rs.segment_rules())
    return segments.groupBy("config_key", "model_type").agg(rnd(F.avg("rmse"), 8).alias("rmse"))


@query("bow_segment_box", f"""WITH {RESULTS}, means AS (
  SELECT {CFG}, avg(rmse) AS rmse FROM results GROUP BY {CFG}),
labelled AS (
  SELECT rmse, CASE WHEN model IN ('mlp', 'resnet', 'deep_linear') AND bow THEN 'DL w/ BoW'
    WHEN model IN ('mlp', 'resnet', 'deep_linear') THEN 'DL w/o BoW'
    WHEN model IN ('mlp_ft', 'resnet_ft', 'deep_linear_ft') AND bow THEN 'DL w/ BoW + Finetuning'
    WHEN model IN ('mlp_ft', 'resnet_ft', 'deep_linear_ft') THEN 'DL w/o BoW + Finetuning'
    WHEN model IN ('catboost', 'xgboost') AND bow THEN 'GBDT w/ BoW' END AS model_type
  FROM (SELECT *, featuriser IN ('bow_count', 'bow_binary', 'tf_idf') AS bow FROM means
        WHERE featuriser <> 'glove_mean'))
SELECT model_type, approx(min(rmse), 4) AS min, approx(quantile_cont(rmse, 0.25), 4) AS q1,
       approx(quantile_cont(rmse, 0.5), 4) AS median, approx(quantile_cont(rmse, 0.75), 4) AS q3,
       approx(max(rmse), 4) AS max, count(*) AS n
FROM labelled WHERE model_type IS NOT NULL GROUP BY model_type""")
def bow_segment_box(spark, d):
    means = ag.replicate_means(v.results(spark, d), "rmse")
    box = ag.five_numbers(rs.with_segments(means, rs.bow_segment_rules()), "rmse", ["model_type"])
    return box.select("model_type", *[rnd(c).alias(c) for c in ("min", "q1", "median", "q3", "max")], "n")


@query("metric_range", f"""WITH {RESULTS}
SELECT run_key, approx(rmse, 4) AS rmse FROM results WHERE rmse BETWEEN 20000 AND 60000 AND total_time < 80""")
def metric_range(spark, d):
    kept = v.results(spark, d).where(F.col("rmse").between(20000, 60000) & (F.col("total_time") < 80))
    return kept.select("run_key", rnd("rmse").alias("rmse"))


@query("step_predicates", f"""WITH {RESULTS}
SELECT model, count(CASE WHEN list_contains(preprocessers, 'stem') THEN 1 END) AS with_stem,
  count(CASE WHEN preprocessers = ['empty'] THEN 1 END) AS empty_only,
  count(CASE WHEN preprocessers[1] <> 'empty' THEN 1 END) AS preprocessed,
  count(CASE WHEN list_has_any(preprocessers, ['stem', 'lowercase']) THEN 1 END) AS any_of_two,
  count(CASE WHEN list_has_all(['empty', 'lowercase', 'no_stopwords_nltk', 'no_punctuation', 'lemmatize'],
        preprocessers) THEN 1 END) AS all_safe FROM results GROUP BY model""")
def step_predicates(spark, d):
    safe = ["empty", "lowercase", "no_stopwords_nltk", "no_punctuation", "lemmatize"]
    two = F.array(F.lit("stem"), F.lit("lowercase"))
    return v.results(spark, d).groupBy("model").agg(
        F.count_if(rs.has_step("stem")).alias("with_stem"),
        F.count_if(F.col("preprocessers") == F.array(F.lit("empty"))).alias("empty_only"),
        F.count_if(F.element_at("preprocessers", 1) != "empty").alias("preprocessed"),
        F.count_if(F.arrays_overlap("preprocessers", two)).alias("any_of_two"),
        F.count_if(~rs.any_step_outside(safe)).alias("all_safe"),
    )


@query("minimised_metric", f"""WITH {RESULTS} SELECT run_key, approx(-rmse, 4) AS rmse FROM results""")
def minimised_metric(spark, d):
    return rk.minimise(v.results(spark, d).select("run_key", "rmse"), "rmse").withColumn("rmse", rnd("rmse"))


@query("paired_features", f"""WITH {RESULTS}
SELECT codes, model, seed, g.tokeniser AS tokeniser_glove, b.tokeniser AS tokeniser_bert,
       approx(g.rmse, 4) AS rmse_glove, approx(b.rmse, 4) AS rmse_bert, approx(b.rmse - g.rmse, 4) AS rmse_diff
FROM (SELECT * FROM results WHERE featuriser = 'glove_mean') g
JOIN (SELECT * FROM results WHERE featuriser IN ('bert_cls', 'bert_mean')) b USING (codes, model, seed)
ORDER BY b.rmse - g.rmse""")
def paired_features(spark, d):
    pairs = glove_bert_pairs(spark, d)
    return pairs.orderBy("rmse_diff").withColumns(
        {c: rnd(c) for c in ("rmse_glove", "rmse_bert", "rmse_diff")}
    ).select("codes", "model", "seed", "tokeniser_glove", "tokeniser_bert", "rmse_glove", "rmse_bert", "rmse_diff")


def glove_bert_pairs(spark, d):
    return rs.paired_by_feature(
        v.results(spark, d), ["glove_mean"], rs.BERT_FEATURISERS, ["codes", "model", "seed"], "rmse",
        ("glove", "bert"), ["tokeniser", "run_key"],
    )


@query("pairs_per_key", f"""WITH {RESULTS}
SELECT codes, model, seed, count(*) AS pairs
FROM (SELECT * FROM results WHERE featuriser = 'glove_mean') g
JOIN (SELECT * FROM results WHERE featuriser IN ('bert_cls', 'bert_mean')) b USING (codes, model, seed)
GROUP BY 1, 2, 3""")
def pairs_per_key(spark, d):
    """How many pairs a join key yields, without forming the pairs: the product of both counts."""
    kept = v.results(spark, d).groupBy("codes", "model", "seed").agg(
        F.count_if(F.col("featuriser") == "glove_mean").alias("_g"),
        F.count_if(F.col("featuriser").isin(rs.BERT_FEATURISERS)).alias("_b"),
    )
    return kept.select("codes", "model", "seed", (F.col("_g") * F.col("_b")).alias("pairs")).where("pairs > 0")


@query("without_worst_rows", f"""WITH {RESULTS}
SELECT run_key, approx(rmse, 4) AS rmse
FROM (SELECT *, row_number() OVER (ORDER BY rmse DESC, run_key DESC) AS place FROM results) WHERE place > 10""")
def without_worst_rows(spark, d):
    return rs.drop_extremes(v.results(spark, d), "rmse", "run_key", 10).select("run_key", rnd("rmse").alias("rmse"))


# --- aggregates ------------------------------------------------------------------------------------


@query("moments_by_model", f"""WITH {RESULTS}
SELECT model, count(rmse) AS n, approx(avg(rmse), 4) AS mean, approx(stddev_samp(rmse), 4) AS std,
       approx(var_samp(rmse), 0) AS var, approx({SEM}, 4) AS sem FROM results GROUP BY model""")
def moments_by_model(spark, d):
    return ag.moments(v.results(spark, d), ["model"], "rmse").select(
        "model", "n", rnd("mean").alias("mean"), rnd("std").alias("std"), rnd("var", 0).alias("var"),
        rnd("sem").alias("sem"),
    )


@query("five_number_summary", f"""WITH {RESULTS}, s AS (
  SELECT min(rmse) AS min, quantile_cont(rmse, 0.25) AS q1, quantile_cont(rmse, 0.5) AS median,
         quantile_cont(rmse, 0.75) AS q3, max(rmse) AS max, count(*) AS n FROM results)
SELECT approx(min, 4) AS min, approx(q1, 4) AS q1, approx(median, 4) AS median, approx(q3, 4) AS q3, approx(max, 4) AS max,
       n, approx(q3 + 1.5 * (q3 - q1), 4) AS fence, approx((median + 1.5 * (q3 - q1)) * 1.1, 4) AS axis_high,
       approx(min * 0.9, 4) AS axis_low FROM s""")
def five_number_summary(spark, d):
    out = ag.fences(ag.five_numbers(v.results(spark, d), "rmse"))
    return out.select(*[rnd(c).alias(c) if c != "n" else F.col(c) for c in out.columns])


@query("replicate_means", f"""WITH {RESULTS}
SELECT {CFG}, approx(avg(rmse), 8) AS rmse, count(*) AS replicates FROM results GROUP BY {CFG}""")
def replicate_means(spark, d):
    return ag.replicate_means(v.results(spark, d), "rmse").withColumn("rmse", rnd("rmse", 8))


@query("complete_configs", f"""WITH {RESULTS}
SELECT {CFG}, approx(avg(rmse), 8) AS mean, approx({SEM}, 4) AS sem, count(*) AS replicates
FROM results GROUP BY {CFG} HAVING count(*) = 4""")
def complete_configs(spark, d):
    return ag.per_config(v.results(spark, d), "rmse", replicates=4).withColumns(
        {"mean": rnd("mean", 8), "sem": rnd("sem")}
    )


@query("tokeniser_counts", f"""WITH {RESULTS}
SELECT tokeniser AS value, count(*) AS n FROM results GROUP BY 1""")
def tokeniser_counts(spark, d):
    return ag.value_counts(v.results(spark, d), "tokeniser")


@query("step_counts", f"""WITH {RESULTS}, bagged AS (
  SELECT unnest(CASE WHEN preprocessers = ['empty'] THEN ['Empty'] ELSE preprocessers END) AS value FROM results)
SELECT value, count(*) AS n FROM bagged GROUP BY 1""")
def step_counts(spark, d):
    bags = v.results(spark, d).select(F.array_remove("preprocessers", "empty").alias("bag"))
    return ag.list_value_counts(bags, "bag")


@query("coverage", f"""WITH {RESULTS}
SELECT 'preprocessers' AS step, value, count(*) AS n FROM (SELECT unnest(preprocessers) AS value FROM results)
GROUP BY 2
UNION ALL SELECT 'tokeniser', tokeniser, count(*) FROM results GROUP BY 2
UNION ALL SELECT 'featuriser', featuriser, count(*) FROM results GROUP BY 2
UNION ALL SELECT 'model', model, count(*) FROM results GROUP BY 2""")
def coverage(spark, d):
    return ag.coverage(v.results(spark, d))


def _reduction_sql(source: str) -> str:
    return f"""SELECT coalesce(model, '(all)') AS model, approx(min(rmse), 4) AS best, approx(max(rmse), 4) AS worst,
  approx({SEM}, 4) AS sem, approx((max(rmse) - min(rmse)) / max(rmse) * 100, 6) AS reduction
FROM {source} GROUP BY ROLLUP (model)"""


def _rounded_reduction(df):
    return df.select(
        "model", rnd("best").alias("best"), rnd("worst").alias("worst"), rnd("sem").alias("sem"),
        rnd("reduction", 6).alias("reduction"),
    )


@query("reduction_in_error", f"WITH {RESULTS} " + _reduction_sql("results"))
def reduction_in_error(spark, d):
    return _rounded_reduction(ag.reduction_in_error(v.results(spark, d), "rmse"))


@query("reduction_in_error_of_means",
       f"WITH {RESULTS}, means AS (SELECT {CFG}, avg(rmse) AS rmse FROM results GROUP BY {CFG}) "
       + _reduction_sql("means"))
def reduction_in_error_of_means(spark, d):
    return _rounded_reduction(ag.reduction_in_error(ag.replicate_means(v.results(spark, d), "rmse"), "rmse"))


_MEANS = f"means AS (SELECT {CFG}, contains(model, '_ft') AS finetuned, avg(rmse) AS rmse FROM results GROUP BY {CFG})"
_UP = "codes, tokeniser, featuriser"


@query("variance_over_model", f"""WITH {RESULTS}, {_MEANS}
SELECT {_UP}, approx(var_samp(rmse), 0) AS spread, count(*) AS models_n, string_agg(model, ',' ORDER BY model) AS models
FROM means GROUP BY {_UP} HAVING count(*) > 1""")
def variance_over_model(spark, d):
    return vr.spread_over_model(v.results(spark, d), "rmse").withColumn("spread", rnd("spread", 0))


def _rest_sql(step: str, spread: str = "approx(var_samp(rmse), 0)") -> str:
    return f"""WITH {RESULTS}, {_MEANS}
SELECT {step}, {spread} AS spread, count(*) AS configs FROM means GROUP BY {step}"""


@query("variance_over_rest", _rest_sql("model"))
def variance_over_rest(spark, d):
    return vr.spread_over_rest(v.results(spark, d), "rmse").withColumn("spread", rnd("spread", 0))


@query("deviation_over_rest_by_featuriser", _rest_sql("featuriser", "approx(stddev_samp(rmse), 4)"))
def deviation_over_rest_by_featuriser(spark, d):
    return vr.spread_over_rest(v.results(spark, d), "rmse", "std", "featuriser").withColumn("spread", rnd("spread"))


@query("variance_over_replicate", f"""WITH {RESULTS}
SELECT {CFG}, approx(var_samp(rmse), 0) AS spread, count(*) AS replicates FROM results
GROUP BY {CFG} HAVING count(*) > 1""")
def variance_over_replicate(spark, d):
    return vr.spread_over_replicate(v.results(spark, d), "rmse").withColumn("spread", rnd("spread", 0))


def _decomposition_sql(spread: str, by: str = "", digits: int = 0) -> str:
    pre = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""WITH {RESULTS}, ft AS (SELECT *, contains(model, '_ft') AS finetuned FROM results), {_MEANS},
m AS (SELECT {pre}{_UP}, {spread} AS s FROM means GROUP BY {pre}{_UP} HAVING count(*) > 1),
u AS (SELECT {pre}model, {spread} AS s FROM means GROUP BY {pre}model),
r AS (SELECT {pre}{CFG}, {spread} AS s FROM ft GROUP BY {pre}{CFG} HAVING count(*) > 1)
SELECT {pre}'model' AS component, approx(avg(s), {digits}) AS expected, count(*) AS groups FROM m {grp}
UNION ALL SELECT {pre}'upstream', approx(avg(s), {digits}), count(*) FROM u {grp}
UNION ALL SELECT {pre}'replicate', approx(avg(s), {digits}), count(*) FROM r {grp}"""


@query("variance_decomposition", _decomposition_sql("var_samp(rmse)"))
def variance_decomposition(spark, d):
    return vr.decomposition(v.results(spark, d), "rmse").select("component", rnd("expected", 0).alias("expected"), "groups")


@query("deviation_decomposition", _decomposition_sql("stddev_samp(rmse)", digits=4))
def deviation_decomposition(spark, d):
    return vr.decomposition(v.results(spark, d), "rmse", "std").select(
        "component", rnd("expected").alias("expected"), "groups"
    )


@query("variance_decomposition_by_finetuning", _decomposition_sql("var_samp(rmse)", "finetuned"))
def variance_decomposition_by_finetuning(spark, d):
    out = vr.decomposition(vr.finetuned(v.results(spark, d)), "rmse", by=["finetuned"])
    return out.select("finetuned", "component", rnd("expected", 0).alias("expected"), "groups")


@query("variance_table", f"""WITH {RESULTS}, {_MEANS}
SELECT (SELECT approx(avg(s), 0) FROM (SELECT var_samp(rmse) AS s FROM means GROUP BY {_UP} HAVING count(*) > 1)) AS model,
  (SELECT approx(avg(s), 0) FROM (SELECT var_samp(rmse) AS s FROM means GROUP BY model)) AS upstream,
  (SELECT approx(avg(s), 0) FROM (SELECT var_samp(rmse) AS s FROM results GROUP BY {CFG} HAVING count(*) > 1)) AS replicate
""")
def variance_table(spark, d):
    table = vr.decomposition_table(v.results(spark, d), "rmse")
    return table.select(*[rnd(c, 0).alias(c) for c in ("model", "upstream", "replicate")])


@query("maximum_improvement", _decomposition_sql("(avg(rmse) - min(rmse))", digits=4))
def maximum_improvement(spark, d):
    return vr.decomposition(v.results(spark, d), "rmse", "maximum_improvement").select(
        "component", rnd("expected").alias("expected"), "groups"
    )


def _bins(metric: str, lo: str, hi: str, n: int) -> str:
    return f"CAST(least(floor(({metric} - {lo}) / ({hi} - {lo}) * {n}), {n - 1}) AS INTEGER)"


@query("metric_histogram", f"""WITH {RESULTS}, b AS (SELECT min(rmse) AS lo, max(rmse) AS hi FROM results)
SELECT {_bins("rmse", "lo", "hi", 100)} AS bin, count(*) AS n,
       approx(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM results, b GROUP BY 1""")
def metric_histogram(spark, d):
    return ag.histogram(v.results(spark, d), "rmse").withColumn("percent", rnd("percent", 6))


@query("timing_histogram", f"""WITH {RESULTS}, t AS (
  SELECT total_time, CASE WHEN contains(model, '_ft') THEN 'Finetuned' ELSE 'BOW' END AS grp FROM results
  WHERE contains(model, '_ft') OR featuriser IN ('bow_binary', 'bow_count', 'tf_idf')),
b AS (SELECT min(total_time) AS lo, max(total_time) AS hi FROM t)
SELECT grp, {_bins("total_time", "lo", "hi", 20)} AS bin, count(*) AS n,
       approx(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY grp), 6) AS percent FROM t, b GROUP BY 1, 2""")
def timing_histogram(spark, d):
    return ag.histogram(timed_groups(spark, d), "total_time", 20, "grp").withColumn("percent", rnd("percent", 6))


def timed_groups(spark, d):
    ft, bow = F.col("model").contains("_ft"), F.col("featuriser").isin(rs.BOW_FEATURISERS)
    return v.results(spark, d).where(ft | bow).withColumn("grp", F.when(ft, "Finetuned").otherwise("BOW"))


@query("bounded_histogram", f"""WITH {RESULTS}
SELECT {_bins("rmse", "20000", "60000", 40)} AS bin, count(*) AS n,
       approx(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent
FROM results WHERE rmse BETWEEN 20000 AND 60000 GROUP BY 1""")
def bounded_histogram(spark, d):
    return ag.histogram(v.results(spark, d), "rmse", 40, low=20000, high=60000).withColumn("percent", rnd("percent", 6))


@query("timing_summary", f"""WITH {RESULTS}, t AS (
  SELECT total_time, CASE WHEN contains(model, '_ft') THEN 'Finetuned' ELSE 'BOW' END AS grp FROM results
  WHERE contains(model, '_ft') OR featuriser IN ('bow_binary', 'bow_count', 'tf_idf'))
SELECT grp, count(*) AS n, approx(avg(total_time), 4) AS mean, approx(stddev_samp(total_time), 4) AS std FROM t GROUP BY grp
""")
def timing_summary(spark, d):
    return ag.moments(timed_groups(spark, d), ["grp"], "total_time").select(
        "grp", "n", rnd("mean").alias("mean"), rnd("std").alias("std")
    )


def _box_sql(source: str, key: str) -> str:
    return f"""WITH {source}, q AS (
  SELECT {key}, quantile_cont(rmse, 0.25) AS q1, quantile_cont(rmse, 0.5) AS median, quantile_cont(rmse, 0.75) AS q3
  FROM results GROUP BY {key}),
j AS (SELECT *, rmse BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM results JOIN q USING ({key}))
SELECT {key}, approx(any_value(q1), 4) AS q1, approx(any_value(median), 4) AS median, approx(any_value(q3), 4) AS q3,
  approx(min(rmse) FILTER (inside), 4) AS whisker_low, approx(max(rmse) FILTER (inside), 4) AS whisker_high,
  count(*) FILTER (NOT inside) AS outliers, count(*) AS n FROM j GROUP BY {key}"""


@query("box_by_model", _box_sql(RESULTS, "model"))
def box_by_model(spark, d):
    out = ag.box_stats(v.results(spark, d), "rmse", ["model"])
    return out.withColumns({c: rnd(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")})


@query("distinct_models", f"WITH {RESULTS} SELECT DISTINCT model FROM results")
def distinct_models(spark, d):
    return v.results(spark, d).select("model").distinct()


@query("distinct_steps", f"WITH {RESULTS} SELECT DISTINCT unnest(preprocessers) AS step FROM results")
def distinct_steps(spark, d):
    return v.results(spark, d).select(F.explode("preprocessers").alias("step")).distinct()


@query("missing_seeds", f"""WITH {RESULTS}, seen AS (
  SELECT {CFG}, list(DISTINCT seed) AS seeds FROM results GROUP BY {CFG} HAVING count(*) BETWEEN 2 AND 3)
SELECT array_to_string(list_sort(list_filter([1, 2, 3, 97], lambda s: NOT list_contains(seeds, s))), ',') AS missing,
       count(*) AS configs FROM seen GROUP BY 1""")
def missing_seeds(spark, d):
    missing = ag.missing_seeds(v.results(spark, d), v.REPLICATE_SEEDS)
    text = F.array_join(F.transform("missing", lambda s: s.cast("string")), ",")
    return missing.groupBy(text.alias("missing")).agg(F.count(F.lit(1)).alias("configs"))


@query("regression_metrics", f"""WITH {PREDS}
SELECT split, approx(sqrt(avg((prediction - label) ** 2)), 4) AS rmse, approx(avg(abs(prediction - label)), 4) AS mae,
  approx(1 - sum((prediction - label) ** 2) / (var_pop(label) * count(*)), 6) AS r2,
  approx(median(abs(prediction - label)), 4) AS medae, count(*) AS n FROM preds GROUP BY split""")
def regression_metrics(spark, d):
    return ag.evaluate(v.predictions(spark, d)).select(
        "split", rnd("rmse").alias("rmse"), rnd("mae").alias("mae"), rnd("r2", 6).alias("r2"),
        rnd("medae").alias("medae"), "n",
    )


@query("mean_baseline", f"""WITH {PREDS}, b AS (SELECT avg(label) AS baseline FROM preds WHERE split <> 'test')
SELECT approx(any_value(baseline), 4) AS baseline, approx(sqrt(avg((label - baseline) ** 2)), 4) AS rmse,
       count(*) AS n_test FROM preds, b WHERE split = 'test'""")
def mean_baseline(spark, d):
    return ag.mean_baseline(v.predictions(spark, d)).select(
        rnd("baseline").alias("baseline"), rnd("rmse").alias("rmse"), "n_test"
    )


@query("standardised_labels", f"""WITH {PREDS}, s AS (
  SELECT avg(label) AS mean, stddev_pop(label) AS std FROM preds WHERE split = 'train')
SELECT split, approx(avg((label - mean) / std), 6) + 0.0 AS mean_scaled, approx(min((label - mean) / std), 6) AS low,
       approx(max((label - mean) / std), 6) AS high, count(*) AS n FROM preds, s GROUP BY split""")
def standardised_labels(spark, d):
    return ag.standardise(v.predictions(spark, d)).groupBy("split").agg(
        (rnd(F.avg("label_scaled"), 6) + 0.0).alias("mean_scaled"), rnd(F.min("label_scaled"), 6).alias("low"),
        rnd(F.max("label_scaled"), 6).alias("high"), F.count(F.lit(1)).alias("n"),
    )


@query("sem_by_finetuning", f"""WITH {RESULTS}, c AS (
  SELECT model, {SEM} AS sem FROM results GROUP BY {CFG} HAVING count(*) = 4)
SELECT contains(model, '_ft') AS finetuned, approx(avg(sem), 4) AS mean_sem, count(*) AS n FROM c GROUP BY 1""")
def sem_by_finetuning(spark, d):
    complete = ag.per_config(v.results(spark, d), "rmse", replicates=4)
    return ag.sem_by_finetuning(complete).withColumn("mean_sem", rnd("mean_sem"))


@query("sem_histogram", f"""WITH {RESULTS}, c AS (
  SELECT contains(model, '_ft') AS finetuned, {SEM} AS sem FROM results GROUP BY {CFG} HAVING count(*) = 4),
b AS (SELECT min(sem) AS lo, max(sem) AS hi FROM c)
SELECT finetuned, {_bins("sem", "lo", "hi", 20)} AS bin, count(*) AS n,
       approx(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY finetuned), 6) AS percent FROM c, b GROUP BY 1, 2""")
def sem_histogram(spark, d):
    complete = vr.finetuned(ag.per_config(v.results(spark, d), "rmse", replicates=4))
    return ag.histogram(complete, "sem", 20, "finetuned").withColumn("percent", rnd("percent", 6))


# --- windows, ranks, limits, sets ------------------------------------------------------------------


@query("fully_replicated_rows", f"""WITH {RESULTS}
SELECT run_key FROM (SELECT run_key, count(seed) OVER (PARTITION BY config_key) AS n FROM results) WHERE n = 4""")
def fully_replicated_rows(spark, d):
    return rs.keep_groups(v.results(spark, d), ["config_key"], lambda n: n == 4).select("run_key")


@query("replicate_counts", f"""WITH {RESULTS}
SELECT run_key, count(seed) OVER (PARTITION BY config_key) AS replicates FROM results""")
def replicate_counts(spark, d):
    return rs.with_group_size(v.results(spark, d), ["config_key"], "replicates").select("run_key", "replicates")


@query("duplicated_keys", f"""WITH {RESULTS}
SELECT run_key, seed FROM (SELECT *, count(*) OVER (PARTITION BY codes, featuriser, seed) AS n FROM results) WHERE n > 1
""")
def duplicated_keys(spark, d):
    return rs.keep_groups(v.results(spark, d), ["codes", "featuriser", "seed"], lambda n: n > 1).select("run_key", "seed")


_RANKED = PANEL + """,
ranked AS (
  SELECT *, rank() OVER (PARTITION BY experiment ORDER BY value DESC)
            + (count(*) OVER (PARTITION BY experiment, value) - 1) / 2.0 AS rank FROM panel)"""


@query("method_ranks", f"WITH {_RANKED} SELECT experiment, method, approx(value, 4) AS value, CAST(rank AS DOUBLE) AS rank FROM ranked")  # noqa: E501
def method_ranks(spark, d):
    return rk.ranked(v.panel(spark, d)).withColumn("value", rnd("value"))


@query("average_ranks", f"WITH {_RANKED} SELECT method, approx(avg(rank), 6) AS average_rank FROM ranked GROUP BY method")
def average_ranks(spark, d):
    return rk.average_ranks(v.panel(spark, d)).withColumn("average_rank", rnd("average_rank", 6))


@query("method_wins", f"""WITH {_RANKED}
SELECT method, CAST(count(CASE WHEN rank = 1 THEN 1 END) AS DOUBLE) AS wins FROM ranked GROUP BY method""")
def method_wins(spark, d):
    return rk.wins(v.panel(spark, d))


@query("method_sizes", f"""WITH {RECORDS}, s AS (SELECT model AS method, count(*) AS n FROM records GROUP BY 1)
SELECT method, n, n >= 3 AS kept, min(n) FILTER (n >= 3) OVER () AS smallest, max(n) FILTER (n >= 3) OVER () AS largest
FROM s""")
def method_sizes(spark, d):
    records = rs.clean_records(v.raw_results(spark, d))
    return rk.method_sizes(records.select(F.col("model").alias("method")))


@query("balanced_panel", f"""WITH {RECORDS}, sized AS (
  SELECT model AS method, concat_ws('_', codes, tokeniser, featuriser, seed) AS experiment, rmse AS value FROM records),
smallest AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM sized GROUP BY method) WHERE n >= 3)
SELECT experiment, method, approx(value, 4) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY md5(experiment)) AS place FROM sized), smallest
WHERE place <= k""")
def balanced_panel(spark, d):
    records = rs.clean_records(v.raw_results(spark, d))
    named = rk.named_columns(records, "model", "rmse", ["codes", "tokeniser", "featuriser", "seed"])
    return rk.balanced_panel(named).withColumn("value", rnd("value"))


@query("method_pairs", f"""WITH {PANEL}
SELECT x.method AS a, y.method AS b, x.experiment, approx(x.value - y.value, 4) + 0.0 AS diff
FROM panel x JOIN panel y ON x.experiment = y.experiment AND x.method < y.method""")
def method_pairs(spark, d):
    return rk.method_pairs(v.panel(spark, d)).withColumn("diff", rnd("diff") + 0.0)


@query("metric_positions", f"""WITH {RESULTS}
SELECT run_key, row_number() OVER (ORDER BY rmse, md5(run_key), run_key) - 1 AS idx FROM results""")
def metric_positions(spark, d):
    placed = od.value_positions(v.results(spark, d).select("run_key", "rmse"), "rmse", ["run_key"])
    return placed.select("run_key", (F.col("position") - 1).alias("idx"))


@query("sorted_results", f"""WITH {RESULTS} SELECT run_key, approx(rmse, 4) AS rmse FROM results""")
def sorted_results(spark, d):
    return v.results(spark, d).orderBy("rmse", "run_key").select("run_key", rnd("rmse").alias("rmse"))


@query("extremes_by_model", f"""WITH {RESULTS}
SELECT model, approx(min(rmse), 4) AS low, approx(max(rmse), 4) AS high FROM results GROUP BY model""")
def extremes_by_model(spark, d):
    return v.results(spark, d).groupBy("model").agg(rnd(F.min("rmse")).alias("low"), rnd(F.max("rmse")).alias("high"))


_STOP_SQL = f"""WITH {CURVES},
b AS (SELECT *, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
      FROM curves),
i AS (SELECT *, best IS NULL OR val_loss < best AS improved FROM b),
l AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM i),
s AS (SELECT run_id, min(epoch) FILTER (epoch - last >= 10) AS hit, max(epoch) AS final FROM l GROUP BY run_id)
SELECT run_id, coalesce(hit, final) AS stop_epoch, CASE WHEN hit IS NULL THEN 'end' ELSE 'patience' END AS reason,
  min(val_loss) FILTER (improved AND epoch <= coalesce(hit, final)) AS best_loss,
  max(epoch) FILTER (improved AND epoch <= coalesce(hit, final)) AS best_epoch
FROM l JOIN s USING (run_id) GROUP BY run_id, hit, final"""


@query("early_stops", _STOP_SQL)
def early_stops(spark, d):
    return cv.early_stop(v.loss_curves(spark, d), 10)


@query("running_best_loss", f"""WITH {CURVES}
SELECT run_id, epoch, least(val_loss, min(val_loss) OVER (PARTITION BY run_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS best FROM curves""")
def running_best_loss(spark, d):
    marked = cv.running_best(v.loss_curves(spark, d))
    return marked.select("run_id", "epoch", F.least("val_loss", "best_before").alias("best"))


@query("time_limit_stops", f"""WITH {CURVES}, t AS (
  SELECT *, sum(CAST(round(val_loss * 100) AS BIGINT)) OVER (PARTITION BY run_id ORDER BY epoch) AS used FROM curves)
SELECT run_id, min(epoch) FILTER (used > 20000) AS stop_epoch FROM t GROUP BY run_id""")
def time_limit_stops(spark, d):
    timed = v.loss_curves(spark, d).withColumn("epoch_time", F.round(F.col("val_loss") * 100).cast("long"))
    return cv.time_limit_stop(timed, 20000)


@query("stacked_splits", f"""WITH {PREDS}
SELECT split, count(*) AS n, approx(sum(label), 2) AS total FROM preds GROUP BY split
UNION ALL SELECT 'train+val', count(*), approx(sum(label), 2) FROM preds WHERE split <> 'test'""")
def stacked_splits(spark, d):
    preds = v.predictions(spark, d)
    stacked = preds.unionByName(preds.where("split <> 'test'").withColumn("split", F.lit("train+val")),
                                allowMissingColumns=True)
    return stacked.groupBy("split").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("label"), 2).alias("total"))


@query("steps_outside_safe", f"""WITH {RESULTS}
SELECT DISTINCT unnest(preprocessers) AS step FROM results
EXCEPT SELECT unnest(['empty', 'lowercase', 'no_stopwords_nltk', 'no_punctuation', 'lemmatize'])""")
def steps_outside_safe(spark, d):
    safe = F.array(*[F.lit(s) for s in ("empty", "lowercase", "no_stopwords_nltk", "no_punctuation", "lemmatize")])
    return v.results(spark, d).select(F.explode(F.array_except("preprocessers", safe)).alias("step")).distinct()


@query("distinct_configs_without_seed", f"""WITH {RAW}
SELECT DISTINCT array_to_string(list_sort(preprocessers), ',') AS preprocessers, tokeniser, featuriser, model, finetune
FROM raw_results""")
def distinct_configs_without_seed(spark, d):
    raw = v.raw_results(spark, d).withColumn("preprocessers", F.array_join(F.array_sort("preprocessers"), ","))
    return raw.dropDuplicates(["preprocessers", "tokeniser", "featuriser", "model", "finetune"]).select(
        "preprocessers", "tokeniser", "featuriser", "model", "finetune"
    )


@query("seed_sets", f"""WITH {RESULTS}
SELECT seeds, count(*) AS configs FROM (
  SELECT config_key, array_to_string(list_sort(list(DISTINCT seed)), ',') AS seeds FROM results GROUP BY config_key)
GROUP BY seeds""")
def seed_sets(spark, d):
    sets = v.results(spark, d).groupBy("config_key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_set("seed")), lambda s: s.cast("string")), ",").alias("seeds")
    )
    return sets.groupBy("seeds").agg(F.count(F.lit(1)).alias("configs"))
