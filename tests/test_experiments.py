import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pipescope.functions import registry
from pipescope.functions import scalar as sc
from pipescope.operators import experiments as ex
from pipescope.operators import results as rs


@pytest.fixture(scope="module")
def lists(spark):
    return ex.component_lists(spark)


def test_grid_sizes(lists):
    assert ex.grid(lists, 97, valid_only=False).count() == 23040
    assert ex.grid(lists, 97, valid_only=False).rdd.getNumPartitions() > 1
    grid = ex.grid(lists, 97)
    counts = grid.agg(F.count("*").alias("n"), F.count_if("finetune").alias("ft"), F.count_distinct("hash").alias("h"))
    assert tuple(counts.first()) == (5760, 288, 5760)
    assert ex.grid(lists, 97, include_preprocessers=False).count() == 120


def test_power_set_order(spark):
    lists = spark.sql("SELECT array('a', 'b', 'c') AS preprocessers")
    subsets = [tuple(r["subset"]) for r in ex.power_set(lists).collect()]
    assert subsets == [(), ("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c"), ("a", "b", "c")]


def test_hash_equals_sorted_json(spark):
    config = {"preprocesser_order": ["stem", "lowercase"], "tokeniser": "bert", "featuriser": "tf_idf",
              "model": "catboost", "finetune": False, "seed": 97}
    text = json.dumps({k: sorted(v) if isinstance(v, list) else v for k, v in sorted(config.items())})
    for order in ("array('stem', 'lowercase')", "array('lowercase', 'stem')"):
        df = spark.sql(f"SELECT {order} AS preprocessers, 'bert' AS tokeniser, 'tf_idf' AS featuriser, "
                       "'catboost' AS model, cast(null AS boolean) AS finetune, 97 AS seed")
        row = df.select(sc.canonical_config().alias("c"), sc.config_hash().alias("h"),
                        sc.canonical_config(legacy=True).alias("old"), sc.config_hash(seed=None).alias("bare")).first()
        assert row["c"] == text and row["h"] == hashlib.sha256(text.encode()).hexdigest()
        assert row["old"] == text.replace('"finetune": false, ', "") and row["bare"] != row["h"]


def test_next_unseen_skips_logged_and_failed(lists):
    grid = ex.grid(lists, 97, include_preprocessers=False)
    first = ex.next_unseen(grid, grid.select("hash", F.lit("success").alias("status")).limit(0)).first()
    log = grid.where(F.col("hash") == first["hash"]).select("hash", F.lit("failed").alias("status"))
    second = ex.next_unseen(grid, log).first()
    assert second["hash"] != first["hash"]
    assert ex.next_unseen(grid, log, retry_failed=True).first()["hash"] == first["hash"]
    assert ex.attempts_before_unseen(grid, log).first()["attempts"] == 1
    with pytest.raises(Exception, match="maximum number of attempts"):
        ex.attempts_before_unseen(grid, log, max_attempts=0).collect()


def test_random_configs_are_valid_and_repeatable(spark, lists):
    attempts = spark.range(500).withColumnRenamed("id", "attempt")
    one = ex.random_configs(attempts, lists, 7, 3)
    two = ex.random_configs(attempts.repartition(5), lists, 7, 3)
    assert sorted(one.select("hash").collect()) == sorted(two.select("hash").collect())
    assert ex.check_configs(one).where("reason IS NOT NULL").count() == 0
    both = F.array_contains("preprocessers", "no_stopwords_spacy") & F.array_contains("preprocessers", "no_stopwords_nltk")
    assert one.where(both).count() == 0
    assert one.count() == one.select("hash").distinct().count()


def test_reconcile_and_latest(spark):
    schema = "hash string, preprocessers array<string>, tokeniser string, featuriser string, model string, " \
             "finetune boolean, seed int, status string, error string"
    log = spark.createDataFrame([("a", ["x"], "t", "f", "m", False, 1, "failed", "OOM"),
                                 ("b", ["x"], "t", "f", "m", False, 2, "success", None)], schema)
    results = log.where("hash = 'a'").unionByName(log.where("hash = 'b'").withColumn("hash", F.lit("c")))
    out = {r["hash"]: (r["side"], r["status"], r["error"]) for r in ex.reconcile(log, results).collect()}
    assert out == {"a": ("shared", "failed", "OOM"), "b": ("log_only", "success", None),
                   "c": ("results_only", "success", None)}
    events = spark.createDataFrame([("h", 1, 1, "failed"), ("h", 2, 1, "success"), ("h", 2, 0, "failed")],
                                   "hash string, event_ts int, event_id int, status string")
    assert ex.latest_state(events).first()["status"] == "success"


def test_duplicates_by_exact_seed_set(spark):
    rows = [(["a"], "t", "f", "m", None, s) for s in (1, 2)] + [(["b"], "t", "f", "m", None, s) for s in (1, 2, 3)]
    log = spark.createDataFrame(rows, "preprocessers array<string>, tokeniser string, featuriser string, model string, "
                                      "finetune boolean, seed int")
    groups = {r["steps"]: (r["n"], r["seeds"]) for r in ex.duplicate_groups(log).collect()}
    assert groups == {"a": (2, [1, 2]), "b": (3, [1, 2, 3])}
    left = ex.without_seed_set(log, [2, 1]).select(F.explode("preprocessers").alias("p")).distinct().collect()
    assert [r["p"] for r in left] == ["b"]


def test_status_counts_keep_zero(spark):
    log = spark.createDataFrame([(1, "success"), (2, "failed")], "seed int, status string")
    assert {r["seed"]: r["n"] for r in ex.status_counts(log, "failed").collect()} == {1: 0, 2: 1}


def test_resample_needs_another_seed(lists):
    with pytest.raises(ValueError, match="differ"):
        ex.resample(lists, 1, 1, lists)


def test_paths(spark):
    df = spark.createDataFrame([("results/preprocessers_stemlowercase/tokeniser_bert/seed_12",),
                                ("results/tokeniser_bert/seed_7/finetune",)], "p string")
    rows = df.select(sc.canonical_path("p").alias("c"), sc.seed_from_path("p").alias("s")).collect()
    assert rows[0]["c"] == "results/preprocessers_lowercasestem/tokeniser_bert/seed_12" and rows[0]["s"] == 12
    assert rows[1]["c"] == "results/tokeniser_bert/seed_7/finetune"
    bad = spark.sql("SELECT 'stemxyz' AS t").select(sc.split_step_error("t").alias("e")).first()
    assert bad["e"] is not None


def test_formats(spark):
    def shown(fn, value):
        return spark.sql(f"SELECT cast({value!r} AS double) AS x").select(fn("x").alias("t")).first()["t"]

    assert [shown(sc.number_text, x) for x in (0.0005, -0.0005, 0.25, 1234.5, 1235.5)] == [
        "<0.001", "<0.001", "0.250", "1,234", "1,236"]
    assert [shown(sc.duration_text, x) for x in (59.0, 61.5, 4050.0)] == ["59.00s", "1.02m", "1.12h"]
    row = spark.sql("SELECT ' python run.py --x=1, ' AS c, 'rmse_test_score' AS a").select(
        sc.output_name("c").alias("n"), sc.axis_title("a").alias("t"), sc.report_label(F.lit("obl_rmse_test")).alias("l"))
    assert tuple(row.first()) == ("python_runpy_x1", "Rmse Test Score", "\\named{obl}-RMSE")


def test_pruning_and_unnesting(spark):
    df = spark.sql("SELECT named_struct('train', 1.0D, 'test', 2.0D, 'extra', 3) AS rmse, '' AS s, 0 AS z, "
                   "array() AS l, false AS f, 5 AS k")
    flat = rs.unnest_one_level(df).first().asDict(recursive=True)
    assert (flat["rmse_train"], flat["rmse_test"], flat["rmse"]) == (1.0, 2.0, {"extra": 3})
    kept = rs.null_if_empty(df).first()
    assert kept["s"] is None and kept["l"] is None and kept["z"] == 0 and kept["f"] is False
    assert rs.null_if_empty(df, drop_zero=True).first()["z"] is None


def test_registry(spark):
    assert registry.ordered_steps(["no_punctuation", "stem", "nonsense"]) == ["stem", "no_punctuation"]
    with pytest.raises(ValueError):
        registry.ordered_steps(["nonsense"])
    with pytest.raises(ValueError):
        registry.preprocesser("nonsense")
    with pytest.raises(ValueError):
        registry.tokeniser("nonsense")
    with pytest.raises(Exception, match="stem and lemmatize"):
        bad = spark.sql("SELECT array('stem', 'lemmatize') AS preprocessers, 'bpe' AS tokeniser, 'tf_idf' AS featuriser,"
                        " 'resnet' AS model, false AS finetune")
        ex.check_configs(bad, strict=True).collect()
