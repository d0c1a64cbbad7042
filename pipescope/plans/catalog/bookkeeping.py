"""Experiment grids, logs and their reconciliation with results; scalar expressions over both."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipescope.functions import scalar as sc
from pipescope.operators import experiments as ex
from pipescope.operators import results as rs
from pipescope.plans.catalog.base import LOG, RAW, RESULTS, query, rnd
from pipescope.sources import files as fl
from pipescope.sources import views as v

# the configuration as sorted JSON text, as SQL
_JSON_STEPS = ("array_to_string(list_transform(list_sort(list_filter(preprocessers, lambda p: p <> 'empty')), "
               "lambda p: '\"' || p || '\"'), ', ')")


def json_sql(finetune: str = "finetune") -> str:
    return (
        "'{\"featuriser\": \"' || featuriser || '\", \"finetune\": ' || CASE WHEN " + finetune
        + " THEN 'true' ELSE 'false' END || ', \"model\": \"' || model || '\", \"preprocesser_order\": [' || "
        + _JSON_STEPS + " || '], \"seed\": ' || seed || ', \"tokeniser\": \"' || tokeniser || '\"}'"
    )


HASHED_LOG = LOG + f",\nhashed_log AS (SELECT *, sha256({json_sql()}) AS hash FROM run_log)"
HASHED = HASHED_LOG + f",\nhashed_results AS (SELECT *, sha256({json_sql()}) AS hash FROM raw_results)"
_STEPS = "array_to_string(list_sort(preprocessers), ',')"
_REASON = """CASE WHEN list_contains(preprocessers, 'stem') AND list_contains(preprocessers, 'lemmatize')
    THEN 'stem and lemmatize together'
  WHEN featuriser IN ('bert_cls', 'bert_mean') AND tokeniser <> 'bert' THEN 'BERT features need BERT tokens'
  WHEN featuriser = 'glove_mean' AND tokeniser NOT IN ('whitespace', 'stanford') THEN 'GloVe needs plain word tokens'
  WHEN finetune AND NOT (featuriser IN ('bert_cls', 'bert_mean')
       AND model IN ('relu_mlp', 'resnet', 'shallow_mlp', 'no_activation_mlp')) THEN 'not finetunable' END"""


def hashed_log(spark, d):
    return ex.hashed_log(v.run_log(spark, d))


def hashed_results(spark, d):
    return ex.hashed_log(v.raw_results(spark, d))


@query("config_hashes", f"WITH {HASHED} SELECT hash, {json_sql()} AS config FROM hashed_results")
def config_hashes(spark, d):
    return hashed_results(spark, d).select("hash", sc.canonical_config().alias("config"))


@query("legacy_config_hashes", f"""WITH {RAW}
SELECT sha256(CASE WHEN finetune THEN c ELSE replace(c, '"finetune": false, ', '') END) AS hash
FROM (SELECT *, {json_sql()} AS c FROM raw_results)""")
def legacy_config_hashes(spark, d):
    return v.raw_results(spark, d).select(sc.config_hash(legacy=True).alias("hash"))


@query("config_reasons", f"""WITH {LOG}
SELECT coalesce({_REASON}, '(valid)') AS reason, count(*) AS n FROM run_log GROUP BY 1""")
def config_reasons(spark, d):
    checked = ex.check_configs(v.run_log(spark, d))
    return checked.groupBy(F.coalesce("reason", F.lit("(valid)")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("incomplete_configs", f"""WITH {LOG}, damaged AS (
  SELECT CASE WHEN status = 'failed' THEN NULL ELSE tokeniser END AS tokeniser,
         CASE WHEN seed > 1000 THEN NULL ELSE model END AS model FROM run_log)
SELECT coalesce('missing ' || nullif(concat_ws(',', CASE WHEN tokeniser IS NULL THEN 'tokeniser' END,
    CASE WHEN model IS NULL THEN 'model' END), ''), '(complete)') AS reason, count(*) AS n FROM damaged GROUP BY 1""")
def incomplete_configs(spark, d):
    damaged = v.run_log(spark, d).withColumns({
        "tokeniser": F.when(F.col("status") != "failed", F.col("tokeniser")),
        "model": F.when(F.col("seed") <= 1000, F.col("model")),
    })
    reason = F.coalesce(ex.missing_key_reason(), F.lit("(complete)"))
    return damaged.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_OBSERVED = """names AS (SELECT * FROM (VALUES (0)) t(z)),
obs_steps AS (SELECT list_sort(list(DISTINCT s)) AS steps FROM (SELECT unnest(preprocessers) AS s FROM raw_results)
              WHERE s <> 'empty'),
masks AS (SELECT m AS mask, list_filter(list_transform(range(1, len(steps) + 1),
            lambda i: CASE WHEN (m >> (i - 1)) & 1 = 1 THEN steps[i] END), lambda s: s IS NOT NULL) AS preprocessers
          FROM (SELECT steps, unnest(range(0, (2 ** len(steps))::BIGINT)) AS m FROM obs_steps)),
raw_grid AS (
  SELECT f.finetune, m.model, m.m_ix, x.featuriser, x.x_ix, t.tokeniser, t.t_ix, k.mask, k.preprocessers, 5 AS seed
  FROM (SELECT unnest([false, true]) AS finetune) f,
       (SELECT model, row_number() OVER (ORDER BY model) AS m_ix FROM (SELECT DISTINCT model FROM raw_results)) m,
       (SELECT featuriser, row_number() OVER (ORDER BY featuriser) AS x_ix
        FROM (SELECT DISTINCT featuriser FROM raw_results)) x,
       (SELECT tokeniser, row_number() OVER (ORDER BY tokeniser) AS t_ix
        FROM (SELECT DISTINCT tokeniser FROM raw_results)) t, masks k),
grid AS (SELECT * FROM raw_grid WHERE (""" + _REASON + """) IS NULL)"""


@query("observed_grid", f"""WITH {RAW}, {_OBSERVED}
SELECT array_to_string(preprocessers, ',') AS preprocessers, tokeniser, featuriser, model, finetune,
       sha256({json_sql()}) AS hash FROM grid""")
def observed_grid(spark, d):
    """All valid configurations of the components that occur in the results."""
    raw = v.raw_results(spark, d)
    return ex.grid(ex.observed_components(raw), seed=5).select(
        F.array_join("preprocessers", ",").alias("preprocessers"), "tokeniser", "featuriser", "model", "finetune",
        "hash",
    )


@query("observed_grid_reasons", f"""WITH {RAW}, {_OBSERVED}
SELECT coalesce({_REASON}, '(valid)') AS reason, count(*) AS n FROM raw_grid GROUP BY 1""")
def observed_grid_reasons(spark, d):
    full = ex.grid(ex.observed_components(v.raw_results(spark, d)), seed=5, valid_only=False)
    return full.groupBy(F.coalesce("reason", F.lit("(valid)")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("step_subsets", f"""WITH {RAW}, {_OBSERVED}
SELECT array_to_string(preprocessers, ',') AS subset, len(preprocessers) AS subset_size FROM masks""")
def step_subsets(spark, d):
    subsets = ex.power_set(ex.observed_components(v.raw_results(spark, d)))
    return subsets.select(F.array_join("subset", ",").alias("subset"), F.col("subset_size").cast("long").alias("subset_size"))


_NEW_GRID = _OBSERVED.replace("5 AS seed", "97 AS seed")
_ORDERED = (f"ordered AS (SELECT *, sha256({json_sql()}) AS hash, row_number() OVER (ORDER BY finetune, m_ix, x_ix, t_ix, "
            "len(preprocessers), list_transform(preprocessers, lambda p: p)) AS ord FROM grid)")


@query("next_unseen_configs", f"""WITH {HASHED_LOG}, {_NEW_GRID}, {_ORDERED}
SELECT hash, array_to_string(preprocessers, ',') AS preprocessers, tokeniser, featuriser, model, finetune
FROM ordered WHERE hash NOT IN (SELECT hash FROM hashed_log) ORDER BY ord LIMIT 20 OFFSET 5""")
def next_unseen_configs(spark, d):
    raw = v.raw_results(spark, d)
    grid = ex.grid(ex.observed_components(raw), seed=97)
    return ex.next_unseen(grid, hashed_log(spark, d), skip=5, n=20).select(
        "hash", F.array_join("preprocessers", ",").alias("preprocessers"), "tokeniser", "featuriser", "model", "finetune"
    )


@query("attempts_before_unseen", f"""WITH {HASHED_LOG}, {_NEW_GRID}, {_ORDERED},
flagged AS (SELECT ord, hash IN (SELECT hash FROM hashed_log) AS done FROM ordered)
SELECT count(*) AS attempts FROM flagged
WHERE done AND ord < (SELECT coalesce(min(ord), 1e18) FROM flagged WHERE NOT done)""")
def attempts_before_unseen(spark, d):
    grid = ex.grid(ex.observed_components(v.raw_results(spark, d)), seed=97)
    return ex.attempts_before_unseen(grid, hashed_log(spark, d))


@query("reconciled_log", f"""WITH {HASHED}
SELECT hash, CASE WHEN l.hash IS NULL THEN 'results_only' WHEN r.hash IS NULL THEN 'log_only' ELSE 'shared' END AS side,
  coalesce(l.seed, r.seed) AS seed, coalesce(l.tokeniser, r.tokeniser) AS tokeniser,
  coalesce(l.featuriser, r.featuriser) AS featuriser, coalesce(l.model, r.model) AS model,
  coalesce(l.status, 'success') AS status, l.error
FROM hashed_log l FULL JOIN hashed_results r USING (hash)""")
def reconciled_log(spark, d):
    return ex.reconcile(hashed_log(spark, d), hashed_results(spark, d)).select(
        "hash", "side", "seed", "tokeniser", "featuriser", "model", "status", "error"
    )


@query("shared_hashes", f"""WITH {HASHED} SELECT hash FROM hashed_log INTERSECT SELECT hash FROM hashed_results""")
def shared_hashes(spark, d):
    return hashed_log(spark, d).select("hash").intersect(hashed_results(spark, d).select("hash"))


@query("unlogged_results", f"""WITH {HASHED} SELECT hash FROM hashed_results EXCEPT SELECT hash FROM hashed_log""")
def unlogged_results(spark, d):
    return ex.unseen(hashed_results(spark, d), hashed_log(spark, d)).select("hash")


_PATH = """concat_ws('/', 'results',
  CASE WHEN steps <> '' THEN 'preprocessers_' || steps END, 'tokeniser_' || tokeniser, 'featuriser_' || featuriser,
  'model_' || model, 'seed_' || seed, CASE WHEN finetune THEN 'finetune' END)"""
_LINKED = """pathed AS (
  SELECT *, array_to_string(list_filter(preprocessers, lambda p: p <> 'empty'), '') AS steps FROM raw_results),
file_paths AS (SELECT """ + _PATH + """ AS path FROM pathed),
logged_paths AS (
  SELECT *, """ + _PATH + """ AS canonical
  FROM (SELECT *, array_to_string(list_sort(list_filter(preprocessers, lambda p: p <> 'empty')), '') AS steps
        FROM run_log))"""


@query("log_result_paths", f"""WITH {LOG}, {_LINKED}
SELECT canonical, status, f.path IS NOT NULL AS matched FROM logged_paths l LEFT JOIN file_paths f ON l.canonical = f.path
""")
def log_result_paths(spark, d):
    """Result paths are written with steps in table order and found again through the canonical path."""
    raw = v.raw_results(spark, d).withColumn("preprocessers", F.reverse("preprocessers"))
    files = fl.with_output_dir(raw, "results").select(F.col("output_dir").alias("path"))
    return ex.log_with_paths(v.run_log(spark, d), files).select("canonical", "status", "matched")


@query("parsed_step_names", f"""WITH {LOG}, {_LINKED}
SELECT DISTINCT steps AS concatenated, array_to_string(list_filter(preprocessers, lambda p: p <> 'empty'), ',') AS steps,
       false AS failed FROM pathed""")
def parsed_step_names(spark, d):
    text = F.array_join(F.array_remove("preprocessers", "empty"), "")
    cut = v.raw_results(spark, d).select(text.alias("concatenated")).distinct()
    return cut.select(
        "concatenated", F.array_join(sc.split_step_names("concatenated"), ",").alias("steps"),
        sc.split_step_error("concatenated").isNotNull().alias("failed"),
    )


@query("seeds_from_paths", f"""WITH {LOG}, {_LINKED}
SELECT CAST(regexp_extract(path, 'seed_(\\d+)', 1) AS INTEGER) AS seed, count(*) AS n FROM file_paths GROUP BY 1""")
def seeds_from_paths(spark, d):
    paths = fl.with_output_dir(v.raw_results(spark, d), "results")
    return paths.groupBy(sc.seed_from_path("output_dir").alias("seed")).agg(F.count(F.lit(1)).alias("n"))


@query("log_cleared_by_pattern", f"""WITH {LOG}, marked AS (
  SELECT *, list_has_any(preprocessers, ['stem', 'lowercase']) AND model IN ('resnet', 'relu_mlp') AS hit FROM run_log)
SELECT CASE WHEN hit THEN 'removed' ELSE 'kept' END AS part, model, count(*) AS n FROM marked GROUP BY 1, 2""")
def log_cleared_by_pattern(spark, d):
    patterns = {"preprocessers": ["stem", "lowercase"], "tokeniser": None, "model": ["resnet", "relu_mlp"]}
    kept, removed = ex.clear_by_pattern(v.run_log(spark, d), patterns)
    parts = kept.withColumn("part", F.lit("kept")).unionByName(removed.withColumn("part", F.lit("removed")))
    return parts.groupBy("part", "model").agg(F.count(F.lit(1)).alias("n"))


@query("failed_log_entries", f"""WITH {HASHED_LOG} SELECT hash, error FROM hashed_log WHERE status = 'failed'""")
def failed_log_entries(spark, d):
    return ex.split_by_status(hashed_log(spark, d))[1].select("hash", "error")


@query("log_without_failed", f"""WITH {HASHED_LOG} SELECT hash, status FROM hashed_log WHERE status <> 'failed'""")
def log_without_failed(spark, d):
    return ex.split_by_status(hashed_log(spark, d))[0].select("hash", "status")


@query("status_counts_by_seed", f"""WITH {LOG}
SELECT seed, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'failed') AS failures
FROM run_log GROUP BY seed""")
def status_counts_by_seed(spark, d):
    log = v.run_log(spark, d)
    good = ex.status_counts(log, "success").withColumnRenamed("n", "successes")
    return good.join(ex.status_counts(log, "failed").withColumnRenamed("n", "failures"), "seed")


@query("success_count", f"WITH {LOG} SELECT count(*) FILTER (status = 'success') AS successes FROM run_log")
def success_count(spark, d):
    return v.run_log(spark, d).agg(F.count_if(F.col("status") == "success").alias("successes"))


_DUPES = f"""groups AS (
  SELECT {_STEPS} AS steps, tokeniser, featuriser, model, finetune, count(*) AS n,
         array_to_string(list_sort(list(DISTINCT seed)), ',') AS seeds
  FROM run_log GROUP BY 1, 2, 3, 4, 5 HAVING count(*) > 1)"""


def _seed_text(column: str = "seeds"):
    return F.array_join(F.transform(column, lambda s: s.cast("string")), ",").alias("seeds")


@query("duplicate_groups", f"WITH {LOG}, {_DUPES} SELECT * FROM groups")
def duplicate_groups(spark, d):
    log = v.run_log(spark, d).withColumn("preprocessers", F.array_sort("preprocessers"))
    return ex.duplicate_groups(log).select("steps", "tokeniser", "featuriser", "model", "finetune", "n", _seed_text())


@query("duplicate_members", f"""WITH {HASHED_LOG}, {_DUPES}
SELECT l.hash, l.seed, g.n FROM hashed_log l JOIN groups g ON g.steps = array_to_string(list_sort(l.preprocessers), ',')
  AND g.tokeniser = l.tokeniser AND g.featuriser = l.featuriser AND g.model = l.model AND g.finetune = l.finetune""")
def duplicate_members(spark, d):
    return ex.duplicate_members(hashed_log(spark, d)).select("hash", "seed", "n")


@query("duplicate_seed_sets", f"WITH {LOG}, {_DUPES} SELECT DISTINCT seeds FROM groups")
def duplicate_seed_sets(spark, d):
    return ex.duplicate_groups(v.run_log(spark, d)).select(_seed_text()).distinct()


@query("log_without_seed_set", f"""WITH {HASHED_LOG}, {_DUPES}
SELECT hash FROM hashed_log l WHERE NOT EXISTS (
  SELECT 1 FROM groups g WHERE g.seeds = '1,2' AND g.steps = array_to_string(list_sort(l.preprocessers), ',')
  AND g.tokeniser = l.tokeniser AND g.featuriser = l.featuriser AND g.model = l.model AND g.finetune = l.finetune)""")
def log_without_seed_set(spark, d):
    return ex.without_seed_set(hashed_log(spark, d), [1, 2]).select("hash")


_AVAILABLE = """available AS (
  SELECT * FROM run_log WHERE list_has_all(['stem', 'lowercase', 'no_punctuation', 'empty'], preprocessers)
    AND tokeniser IN ('whitespace', 'bert') AND featuriser IN ('tf_idf', 'bert_cls', 'bow_count')
    AND model IN ('catboost', 'resnet', 'xgboost'))"""
_ENABLED = {
    "preprocessers": ["stem", "lowercase", "no_punctuation"], "tokenisers": ["whitespace", "bert"],
    "featurisers": ["tf_idf", "bert_cls", "bow_count"], "models": ["catboost", "resnet", "xgboost"],
}


@query("available_log_entries", f"""WITH {LOG}, {_AVAILABLE}
SELECT {_STEPS} AS preprocessers, tokeniser, featuriser, model, seed FROM available""")
def available_log_entries(spark, d):
    log = v.run_log(spark, d).withColumn("preprocessers", F.array_sort("preprocessers"))
    return ex.available(log, ex.component_lists(spark, _ENABLED)).select(
        F.array_join("preprocessers", ",").alias("preprocessers"), "tokeniser", "featuriser", "model", "seed"
    )


@query("resampled_configs", f"""WITH {LOG}, {_AVAILABLE}
SELECT DISTINCT {_STEPS} AS preprocessers, tokeniser, featuriser, model, finetune, 11 AS seed FROM available WHERE seed = 2
""")
def resampled_configs(spark, d):
    log = v.run_log(spark, d).withColumn("preprocessers", F.array_sort("preprocessers"))
    again = ex.resample(log, 2, 11, ex.component_lists(spark, _ENABLED))
    return again.withColumn("preprocessers", F.array_join("preprocessers", ","))


_REGISTRY = ex.COMPONENTS["preprocessers"]


@query("registry_order", f"""WITH {RAW}
SELECT DISTINCT array_to_string(preprocessers, ',') AS requested,
  array_to_string(list_filter({_REGISTRY!r}, lambda r: list_contains(preprocessers, r)), ',') AS applied
FROM raw_results WHERE mask <> 0""")
def registry_order(spark, d):
    asked = v.raw_results(spark, d).where("mask <> 0").select("preprocessers").distinct()
    return asked.select(
        F.array_join("preprocessers", ",").alias("requested"),
        F.array_join(ex.in_registry_order("preprocessers", _REGISTRY), ",").alias("applied"),
    )


def _draw(field: str, n: str, name: str = "") -> str:
    parts = f"'13', attempt, '{field}'"
    return f"(('0x' || substr(md5(concat_ws(':', {parts})), 1, 8))::BIGINT % {n})"


_PICKED = f"""drawn AS (
  SELECT attempt,
    featurisers[{_draw('featuriser', '6')} + 1] AS featuriser, models[{_draw('model', '6')} + 1] AS model,
    tokenisers[{_draw('tokeniser', '5')} + 1] AS any_tok, ['whitespace', 'stanford'][{_draw('tokeniser', '2')} + 1] AS word_tok,
    {_draw('finetune', '2')} = 1 AS coin,
    list_transform(list_slice(list_sort(list_transform(steps, lambda s: md5(concat_ws(':', '13', attempt, 'shuffle', s)) || s)),
      1, {_draw('length', '(len(steps) + 1)')}), lambda t: substr(t, 33)) AS chosen,
    CASE WHEN {_draw('conflict0', '2')} = 0 THEN 'stem' ELSE 'lemmatize' END AS loser
  FROM (SELECT o_orderkey AS attempt FROM orders),
    (SELECT list_sort(list(DISTINCT tokeniser)) AS tokenisers, list_sort(list(DISTINCT featuriser)) AS featurisers,
            list_sort(list(DISTINCT model)) AS models FROM raw_results),
    (SELECT list_sort(list(DISTINCT s)) AS steps FROM (SELECT unnest(preprocessers) AS s FROM raw_results) WHERE s <> 'empty')),
random_configs AS (
  SELECT attempt, list_sort(list_filter(chosen, lambda s: NOT (s = loser AND list_contains(chosen, 'stem')
      AND list_contains(chosen, 'lemmatize')))) AS preprocessers,
    CASE WHEN featuriser IN ('bert_cls', 'bert_mean') THEN 'bert' WHEN featuriser = 'glove_mean' THEN word_tok
         ELSE any_tok END AS tokeniser, featuriser, model,
    coin AND featuriser IN ('bert_cls', 'bert_mean') AND model IN ('relu_mlp', 'resnet', 'no_activation_mlp') AS finetune,
    4 AS seed FROM drawn)"""


@query("random_configs", f"""WITH {RAW}, {_PICKED}
SELECT min(attempt) AS attempt, sha256({json_sql()}) AS hash, array_to_string(preprocessers, ',') AS preprocessers,
       tokeniser, featuriser, model, finetune FROM random_configs GROUP BY ALL""")
def random_configs(spark, d):
    """One draw per order key."""
    attempts = v.table(spark, d, "orders").select(F.col("o_orderkey").alias("attempt"))
    lists = ex.observed_components(v.raw_results(spark, d))
    return ex.random_configs(attempts, lists, rng_seed=13, exp_seed=4).select(
        "attempt", "hash", F.array_join("preprocessers", ",").alias("preprocessers"), "tokeniser", "featuriser",
        "model", "finetune",
    )


@query("rekeyed_log", f"""WITH {LOG}, defaulted AS (SELECT * REPLACE (CASE WHEN seed > 1000 THEN 97 ELSE seed END AS seed)
  FROM run_log), keyed AS (SELECT sha256({json_sql()}) AS hash, status FROM defaulted)
SELECT hash, count(*) AS entries, max(status) AS last_status FROM keyed GROUP BY hash""")
def rekeyed_log(spark, d):
    """Entries without a seed get the default before hashing; colliding keys become one."""
    bare = v.run_log(spark, d).withColumn("seed", F.when(F.col("seed") <= 1000, F.col("seed")))
    keyed = ex.hashed_log(bare)
    entries = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("entries"))
    last = ex.latest_state(keyed.select("hash", "status"), order=["status"]).withColumnRenamed("status", "last_status")
    return entries.join(last, "hash")


@query("latest_log_state", """WITH e AS (
  SELECT md5(concat_ws(':', user_id, event_type)) AS hash, event_id, ts, user_id AS seed,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status FROM events)
SELECT hash, event_id, seed, status FROM (
  SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ts DESC, event_id DESC) AS place FROM e) WHERE place = 1""")
def latest_log_state(spark, d):
    from pipescope.streaming.intake import as_run_events

    events = as_run_events(v.table(spark, d, "events"))
    return ex.latest_state(events).select("hash", "event_id", "seed", "status")


# --- scalar expressions ----------------------------------------------------------------------------


@query("formatted_numbers", f"""WITH {RESULTS}, x AS (SELECT run_key, unnest([rmse, rmse / 123456, total_time / 1e7]) AS x FROM results)
SELECT run_key, CASE WHEN abs(x) < 0.001 THEN '<0.001' WHEN abs(x) < 1 THEN printf('%.3f', x)
  ELSE format('{{:,}}', CAST(round_even(x, 0) AS BIGINT)) END AS shown FROM x""")
def formatted_numbers(spark, d):
    values = F.explode(F.array(F.col("rmse"), F.col("rmse") / 123456, F.col("total_time") / 1e7))
    return v.results(spark, d).select("run_key", values.alias("x")).select("run_key", sc.number_text("x").alias("shown"))


@query("formatted_durations", f"""WITH {RESULTS}, x AS (SELECT run_key, unnest([total_time, total_time * 50, total_time / 7]) AS s FROM results)
SELECT run_key, CASE WHEN s > 3600 THEN printf('%.2fh', s / 3600) WHEN s > 60 THEN printf('%.2fm', s / 60)
  ELSE printf('%.2fs', s) END AS shown FROM x""")
def formatted_durations(spark, d):
    seconds = F.explode(F.array(F.col("total_time"), F.col("total_time") * 50, F.col("total_time") / 7))
    return v.results(spark, d).select("run_key", seconds.alias("s")).select("run_key", sc.duration_text("s").alias("shown"))


@query("report_labels", f"""WITH {RESULTS}, l AS (SELECT DISTINCT featuriser || '_100%_rmse_test' AS label FROM results)
SELECT label, replace(replace(replace(label, '_', '-'), '%', '\\%'), 'rmse-test', 'RMSE') AS shown,
  CASE WHEN ends_with(label, '_test') THEN substr(label, 1, length(label) - 5) ELSE label END AS metric,
  split_part(label, '_', -1) AS last_part FROM l""")
def report_labels(spark, d):
    names = v.results(spark, d).select(F.concat("featuriser", F.lit("_100%_rmse_test")).alias("label")).distinct()
    return names.select(
        "label", sc.report_label("label").alias("shown"), sc.strip_suffix("label", "_test").alias("metric"),
        F.element_at(F.split("label", "_"), -1).alias("last_part"),
    )


@query("axis_titles", f"""WITH {RESULTS}, l AS (SELECT DISTINCT tokeniser || '_' || model AS name FROM results),
w AS (SELECT name, list_transform(string_split(replace(name, '_', ' '), ' '),
        lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))) AS words FROM l)
SELECT name, array_to_string(words, ' ') AS title FROM w""")
def axis_titles(spark, d):
    names = v.results(spark, d).select(F.concat_ws("_", "tokeniser", "model").alias("name")).distinct()
    return names.select("name", sc.axis_title("name").alias("title"))


@query("output_names", f"""WITH {RESULTS}
SELECT run_key, replace(trim(translate('run --steps=' || codes || ' ' || model || '! ', '-=,!_', '')), ' ', '_') AS name
FROM results""")
def output_names(spark, d):
    command = F.concat(F.lit("run --steps="), "codes", F.lit(" "), "model", F.lit("! "))
    return v.results(spark, d).select("run_key", sc.output_name(command).alias("name"))


@query("prediction_errors", """SELECT l_linenumber, approx(sum((l_quantity * p_retailprice - l_extendedprice) ** 2), 2) AS squared,
  approx(sum(abs(l_quantity * p_retailprice - l_extendedprice)), 2) AS absolute
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def prediction_errors(spark, d):
    lines = v.table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    parts = v.table(spark, d, "part").select("p_partkey", "p_retailprice")
    paired = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_linenumber", (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"),
        F.col("l_extendedprice").alias("label"),
    )
    return paired.groupBy("l_linenumber").agg(
        rnd(F.sum(sc.squared_error()), 2).alias("squared"), rnd(F.sum(sc.absolute_error()), 2).alias("absolute")
    )


@query("renamed_models", f"""WITH {RAW}
SELECT DISTINCT model, replace(replace(model, 'relu_mlp', 'mlp'), 'no_activation_mlp', 'deep_linear') AS renamed
FROM raw_results""")
def renamed_models(spark, d):
    return v.raw_results(spark, d).select("model", rs.rename_model("model").alias("renamed")).distinct()
