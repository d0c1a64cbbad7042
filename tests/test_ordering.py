import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipescope.operators import aggregates as ag
from pipescope.operators import ordering as od
from pipescope.operators import sampling as sp


@pytest.fixture(scope="module")
def skewed(spark):
    """Group `a` holds most rows, and a third of all rows share one value."""
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        group = "a" if i % 10 else "b"
        value = 7.0 if i % 3 == 0 else round(rng.gauss(0, 10), 2)
        rows.append((i, group, value))
    return rows, spark.createDataFrame(rows, "id int, g string, v double")


def test_quantiles_equal_linear_interpolation(skewed):
    rows, df = skewed
    got = {r["g"]: r for r in ag.five_numbers(df, "v", ["g"]).collect()}
    for g in "ab":
        values = [v for _, gg, v in rows if gg == g]
        assert got[g]["n"] == len(values)
        want = np.quantile(values, [0, 0.25, 0.5, 0.75, 1])
        assert np.allclose([got[g][c] for c in ("min", "q1", "median", "q3", "max")], want)


def test_published_quartiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    row = ag.five_numbers(df, "x").first()
    assert (row["q1"], row["median"], row["q3"]) == (1.75, 2.5, 4.75)
    moments = df.agg(ag.sem("x").alias("s"), F.stddev_pop("x").alias("p")).first()
    assert round(moments["s"], 4) == 2.0412 and round(moments["p"], 4) == 3.5355


def test_average_ranks_of_ties(skewed):
    rows, df = skewed
    got = {(r["g"], r["v"]): r["avg_rank"] for r in od.value_runs(df, ["g"], "v").collect()}
    for g in "ab":
        values = sorted(v for _, gg, v in rows if gg == g)
        for v in set(values):
            places = [i + 1 for i, x in enumerate(values) if x == v]
            assert got[(g, v)] == sum(places) / len(places)


def test_positions_form_a_total_order(skewed):
    rows, df = skewed
    got = {r["id"]: r["position"] for r in od.value_positions(df, "v", ["id"]).collect()}
    want = sorted(rows, key=lambda r: (r[2], hashlib.md5(str(r[0]).encode()).hexdigest()))
    assert [got[r[0]] for r in want] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_partitions_do_not_matter(spark, skewed, partitions):
    _, df = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        keyed = df.repartition(partitions).withColumnRenamed("id", "doc_id")
        split = sorted(map(tuple, sp.split_corpus(keyed, 5).select("doc_id", "split").collect()))
        box = sorted(map(tuple, ag.box_stats(df.repartition(partitions), "v", ["g"]).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    keyed = df.withColumnRenamed("id", "doc_id")
    assert split == sorted(map(tuple, sp.split_corpus(keyed, 5).select("doc_id", "split").collect()))
    assert box == sorted(map(tuple, ag.box_stats(df, "v", ["g"]).collect()))


def test_split_sizes_and_seeds(spark):
    df = spark.range(100).withColumnRenamed("id", "doc_id")

    def parts(seed):
        out = {"train": set(), "val": set(), "test": set()}
        for r in sp.split_corpus(df, seed).collect():
            out[r["split"]].add(r["doc_id"])
        return out

    one, again, other = parts(3), parts(3), parts(4)
    assert [len(one[s]) for s in ("train", "val", "test")] == [60, 20, 20]
    assert one == again and one["test"] == other["test"] and one["val"] != other["val"]
    split = sp.split_corpus(df, 3)
    kept = sp.downsample_train(split, 0.25).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in kept} == {"train": 15, "val": 20, "test": 20}
    assert sp.downsample_train(split, 0.001).where("split = 'train'").count() == 0


def test_histogram_top_edge_is_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    counts = {r["bin"]: r["n"] for r in ag.histogram(df, "x", 5).collect()}
    assert counts == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_box_counts_outliers(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [1, 2, 3, 4, 5, 100]], "g string, x double")
    row = ag.box_stats(df, "x", ["g"]).first()
    assert (row["whisker_low"], row["whisker_high"], row["outliers"], row["n"]) == (1.0, 5.0, 1, 6)


def test_early_stops_equal_a_loop_over_epochs(spark):
    """States of slots merge to what a loop over each whole curve gives, wherever slots are cut."""
    import random

    from pipescope.operators.curves import early_stop

    rng = random.Random(17)
    rows, want = [], {}
    for run in range(60):
        patience, per_slot, level, epoch, curve = 4, rng.choice([1, 2, 5, 9, 100]), 50.0, -1, []
        for _ in range(rng.randrange(1, 60)):
            level += rng.choice([-1.5, -0.5, 0.5, 1.0, 0.0])
            curve.append((epoch, level))
            epoch += rng.choice([1, 1, 1, 2, 7])
        rows += [(run, (e + 1) // per_slot, e, x) for e, x in curve]
        best, at, stop = None, None, None
        for e, x in curve:
            if best is None or x < best:
                best, at = x, e
            elif e - at >= patience:
                stop = e
                break
        want[run] = (curve[-1][0] if stop is None else stop, "end" if stop is None else "patience", best, at)
    df = spark.createDataFrame(rows, "run_id int, slot int, epoch int, val_loss double").repartition(7)
    got = {r.run_id: (r.stop_epoch, r.reason, r.best_loss, r.best_epoch) for r in early_stop(df, 4).collect()}
    assert got == want
    assert early_stop(df.where("false"), 4).count() == 0


def test_quantiles_of_small_hot_and_odd_groups(spark):
    """Groups of one to nine rows, one hot group with a value in most of its rows, nulls, ungrouped and empty tables."""
    rng = np.random.default_rng(23)
    groups = {f"g{n}": rng.normal(size=n).round(1).tolist() for n in range(1, 10)}
    groups["hot"] = [1.5] * 30_000 + rng.normal(size=20_000).tolist()
    groups["even"] = np.arange(25_001, dtype=float).tolist()
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("g3", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(9)
    probs = {"min": 0.0, "a": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "z": 0.999, "max": 1.0}
    got = {r["g"]: r for r in od.exact_quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert [got[g][p] for p in probs] == pytest.approx(list(np.quantile(vs, list(probs.values())))), g
        assert got[g]["n"] == len(vs)
    everything = [v for vs in groups.values() for v in vs]
    (whole,) = od.exact_quantiles(df, [], "v", probs).collect()
    assert [whole[p] for p in probs] == pytest.approx(list(np.quantile(everything, list(probs.values()))))
    assert od.exact_quantiles(df.where("false"), ["g"], "v", probs).count() == 0
    assert od.exact_quantiles(df, ["g"], "v", {"max": 1.0}).where("g = 'even'").first()["max"] == 25_000


def test_quantile_rows_are_neither_ordered_nor_dealt_by_group(spark):
    """All rows of a group were ordered in one task: three splits of a large table were three tasks."""
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    got = od.exact_quantiles(df, ["g"], "x", {"low": 0.0, "q1": 0.25, "median": 0.5, "high": 1.0})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    assert sorted((r["g"], r["low"], r["q1"], r["median"], r["high"], r["n"]) for r in got.collect()) == [
        (g, float(g), g + 749.25, g + 1498.5, g + 2997.0, 1000) for g in range(3)]


def test_brackets_of_many_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr(od, "BROADCAST_GROUPS", 2)
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    got = od.exact_quantiles(df, ["g"], "x", {"median": 0.5})
    assert sorted((r["g"], r["median"], r["n"]) for r in got.collect()) == [(g, g + 1498.5, 1000) for g in range(3)]
