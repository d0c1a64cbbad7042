import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipescope.functions import tails
from pipescope.operators import hypothesis as hy
from pipescope.operators import permutation as pm
from pipescope.operators import ranking as rk


def test_tails_at_published_points():
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert tails.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.student_two_sided(12.70620474, 1) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi_square_upper(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert tails.chi_square_upper(18.307038, 10) == pytest.approx(0.05, abs=1e-8)
    assert tails.chi_square_upper(3.0, 2) == pytest.approx(math.exp(-1.5), abs=1e-12)


def p_table(spark, ps):
    return spark.createDataFrame([(f"t{i}", p) for i, p in enumerate(ps)], "a string, p_value double")


def test_corrections(spark):
    table = p_table(spark, [0.01, 0.02, 0.03, 0.04])
    assert hy.holm(table, ties=["a"]).where("reject").count() == 1
    corrected = hy.benjamini_hochberg(table).collect()
    assert sum(r["reject"] for r in corrected) == 4 and corrected[0]["adjusted_alpha"] == pytest.approx(0.05)
    assert hy.benjamini_hochberg(p_table(spark, [0.9, 0.8])).where("reject").count() == 0
    # Holm stops at the first failure even when a later one would pass its own threshold
    assert hy.holm(p_table(spark, [0.03, 0.04]), ties=["a"]).where("reject").count() == 0


def test_exhaustive_pairs(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 2.0, 0.0), (3, 3.0, 0.0)], "pair int, a double, b double")
    row = pm.paired_exhaustive_test(df, "a", "b", "pair").first()
    assert (row["extreme"], row["permutations"]) == (2, 8) and row["p_value"] == pytest.approx(3 / 9)
    assert pm.paired_exhaustive_test(df, "a", "b", "pair", exact=True).first()["p_value"] == pytest.approx(2 / 8)
    rng = np.random.default_rng(3)
    d = np.round(rng.normal(0.4, 1, 7), 3)
    df = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate(d)], "pair int, a double, b double")
    hits = sum(abs(np.mean(d * s)) >= abs(d.mean()) - 1e-9 for s in product([1, -1], repeat=7))
    assert pm.paired_exhaustive_test(df, "a", "b", "pair", exact=True).first()["p_value"] == pytest.approx(hits / 128)
    big = spark.range(25).select(F.col("id").alias("pair"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    with pytest.raises(Exception, match="more than 20 pairs"):
        pm.paired_exhaustive_test(big, "a", "b", "pair").collect()


@pytest.fixture(scope="module")
def two_samples(spark):
    rng = np.random.default_rng(5)
    rows = []
    for block, mean in (("one", 100), ("two", 150)):
        for i in range(20):
            rows.append((f"{block}c{i}", block, False, float(rng.normal(mean, 10))))
            rows.append((f"{block}t{i}", block, True, float(rng.normal(mean + 12, 10))))
    return spark.createDataFrame(rows, "row string, block string, x boolean, v double")


def test_permutation_separates_and_blocks_help(spark, two_samples):
    plain = pm.permutation_test(two_samples, "v", "x", "row", 500).first()
    blocked = pm.blocked_permutation_test(two_samples, "v", "x", "row", "block", 500).first()
    assert plain["mean_diff"] == pytest.approx(blocked["mean_diff"])
    assert blocked["p_value"] < 0.02 < plain["p_value"] < 0.5
    assert plain["permutations"] == blocked["permutations"] == 500
    # the value of p moves with neither partitioning nor repeated runs
    again = pm.permutation_test(two_samples.repartition(3), "v", "x", "row", 500).first()
    assert again["extreme"] == plain["extreme"]


def test_permutation_of_equal_samples(spark):
    df = spark.range(60).select("id", (F.col("id") % 2 == 0).alias("x"), F.lit(1.0).alias("v"))
    assert pm.permutation_test(df, "v", "x", "id", 50).first()["p_value"] == 1.0


def test_monte_carlo_agrees_with_digest_form(spark, two_samples):
    a = pm.permutation_test(two_samples, "v", "x", "row", 2000).first()["p_value"]
    b = pm.monte_carlo_test(two_samples, "v", "x", "row", 2000).first()["p_value"]
    c = pm.monte_carlo_test(two_samples, "v", "x", "row", 2000).first()["p_value"]
    assert b == c and abs(a - b) < 0.04


@pytest.mark.parametrize("unit", [1e-8, 1.0, 1e8])
def test_p_does_not_depend_on_the_unit(spark, two_samples, unit):
    scaled = two_samples.withColumn("v", F.col("v") * F.lit(unit))
    assert pm.permutation_test(scaled, "v", "x", "row", 300).first()["extreme"] == pm.permutation_test(
        two_samples, "v", "x", "row", 300).first()["extreme"]
    pairs = spark.range(30).select("id", (F.col("id") * F.lit(unit)).alias("a"), ((F.col("id") + 1) * F.lit(unit)).alias("b"))
    assert pm.paired_permutation_test(pairs, "a", "b", "id", 100).first()["p_value"] < 0.05


def test_monte_carlo_over_several_blocks(spark, two_samples, monkeypatch):
    whole = pm.monte_carlo_test(two_samples, "v", "x", "row", 3000, one_sided=True).first()
    monkeypatch.setattr(pm, "ROWS_PER_BLOCK", 7)
    parts = pm.monte_carlo_test(two_samples, "v", "x", "row", 3000, one_sided=True).first()
    assert parts["permutations"] == 3000 and abs(whole["p_value"] - parts["p_value"]) < 0.04
    assert pm.monte_carlo_test(two_samples.where("x"), "v", "x", "row", 10).count() == 0


def test_paired_permutation_of_identical_pairs(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    assert pm.paired_permutation_test(df, "a", "b", "id", 40).first()["p_value"] == 1.0


def test_rank_sum_by_hand(spark):
    x, y = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0, 6.0, 7.0]
    df = spark.createDataFrame([(v, True) for v in x] + [(v, False) for v in y], "v double, x boolean")
    row = hy.mann_whitney(df, "v", "x").first()
    wins = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    assert row["u"] == wins and 0 < row["p_value"] <= 1


def test_t_tests_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 3.5)], "a double, b double")
    d = np.array([-1.0, -2.0, -0.5])
    row = hy.paired_t(df, "a", "b").first()
    assert row["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(3)))
    keyed = spark.createDataFrame([("p", True, 1.0), ("p", False, 2.0), ("p", False, 4.0), ("q", True, 3.0),
                                   ("q", False, 3.5), ("r", True, 9.0)], "k string, x boolean, v double")
    pairs = np.array([1 - 2, 1 - 4, 3 - 3.5])
    row = hy.keyed_paired_t(keyed, "v", "x", ["k"]).first()
    assert row["n"] == 3 and row["t"] == pytest.approx(pairs.mean() / (pairs.std(ddof=1) / math.sqrt(3)))
    marked = spark.createDataFrame([(True, v) for v in (1.0, 2.0, 4.0)] + [(False, v) for v in (3.0, 5.0)],
                                   "x boolean, v double")
    row = hy.pooled_t(marked, "v", "x").first()
    pooled = (2 * np.var([1, 2, 4], ddof=1) + np.var([3, 5], ddof=1)) / 3
    assert row["t"] == pytest.approx((7 / 3 - 4) / math.sqrt(pooled * (1 / 3 + 1 / 2)))
    assert (row["n"], row["m"]) == (3, 2)


def panel_of(spark, scores):
    rows = [(f"e{i}", f"m{j}", float(v)) for i, line in enumerate(scores) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, "experiment string, method string, value double")


def test_ranks_wins_and_friedman(spark):
    tied = panel_of(spark, [[3, 3, 1]])
    ranks = {r["method"]: r["rank"] for r in rk.ranked(tied).collect()}
    assert ranks == {"m0": 1.5, "m1": 1.5, "m2": 3.0}
    assert sum(r["wins"] for r in rk.wins(tied).collect()) == 0.0
    clear = panel_of(spark, [[1, 2, 3], [1, 3, 5], [2, 4, 6], [0, 1, 2]])
    row = hy.friedman(clear).first()
    assert row["chi_square"] == pytest.approx(8.0) and row["p_value"] == pytest.approx(math.exp(-4))
    assert hy.gated_pairs(clear).count() == 3
    flat = panel_of(spark, [[1, 2, 3], [3, 2, 1], [2, 3, 1], [2, 1, 3]])
    assert hy.gated_pairs(flat).count() == 0


def test_signed_rank_by_hand(spark):
    diffs = [0.0, 1.0, -2.0, 3.0, 3.0, 0.0, 5.0]
    panel = panel_of(spark, [[d, 0.0] for d in diffs])
    row = hy.wilcoxon_pairs(panel).first()
    # ranks of |d| with zeros: 0,0 -> 1.5 each, 1 -> 3, 2 -> 4, 3,3 -> 5.5, 5 -> 7
    assert (row["n"], row["zeros"], row["statistic"]) == (7, 2, 4.0)


def test_unordered_panel_is_balanced(spark):
    rows = [(f"e{i}", "big", float(i)) for i in range(50)] + [(f"e{i}", "mid", float(i)) for i in range(10)] + [
        ("e1", "tiny", 1.0)]
    df = spark.createDataFrame(rows, "experiment string, method string, value double")
    counts = {r["method"]: r["count"] for r in rk.balanced_panel(df).groupBy("method").count().collect()}
    assert counts == {"big": 10, "mid": 10}
    assert rk.balanced_panel(df, strict=True).select("method").distinct().count() == 1
    assert rk.balanced_panel(df, jitter_seed=1).where("value <> round(value)").count() > 0


def test_panel_is_evaluated_once(spark):
    """Sizes, cutoffs and rows each evaluated the panel: all joins and sums behind it ran four times."""
    rows = [(f"e{i}", "big", float(i)) for i in range(50)] + [(f"e{i}", "mid", float(i)) for i in range(10)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "experiment string, method string, value double"
    df = spark.createDataFrame(rows, schema).mapInArrow(counted, schema)
    assert rk.balanced_panel(df).count() == 20
    assert seen.value == 60


def test_cliques(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "c"), ("c", "d"), ("e", "f")], "a string, b string")
    found = sorted(tuple(r["clique"]) for r in rk.maximal_cliques(edges).collect())
    assert found == [("a", "b", "c"), ("c", "d"), ("e", "f")]


def test_normality_needs_eight_rows(spark):
    df = spark.range(7).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    assert hy.normality(df, "v", ["g"]).first()["k2"] is None


def test_exact_laws_equal_enumeration(spark):
    """Signed ranks with ties and zeros against all signs; rank sums against all orders."""
    import itertools
    import random

    from pipescope.functions.tails import rank_sum_two_sided

    rng = random.Random(31)
    rows, want = [], {}
    for group in range(12):
        diffs = [rng.choice([-3, -2, -1, 0, 1, 1, 2, 4, 5]) if group % 2 else rng.uniform(-1, 2) for _ in range(group + 1)]
        rows += [(group, f"e{i}", m, d if m == "a" else 0.0) for i, d in enumerate(map(float, diffs)) for m in "ab"]
        ranks = [1 + sum(abs(x) < abs(d) for x in diffs) + (sum(abs(x) == abs(d) for x in diffs) - 1) / 2 for d in diffs]
        kept = [(r, d) for r, d in zip(ranks, diffs) if d]
        low = min(sum(r for r, d in kept if d > 0), sum(r for r, d in kept if d < 0))
        sums = [sum(r for (r, _), s in zip(kept, signs) if s) for signs in itertools.product([0, 1], repeat=len(kept))]
        want[group] = min(1.0, 2 * sum(s <= low for s in sums) / len(sums))
    panel = spark.createDataFrame(rows, "g int, experiment string, method string, value double")
    got = {r.g: r.p_value for r in hy.wilcoxon_pairs(panel, ["g"], exact_zeros=True).collect()}
    assert got == pytest.approx(want)
    for n1, n2 in [(1, 1), (1, 6), (3, 4), (5, 3), (4, 8)]:
        orders = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
        for u in {*orders}:
            low = min(u, n1 * n2 - u)
            assert rank_sum_two_sided(u, n1, n2) == pytest.approx(min(1.0, 2 * sum(o <= low for o in orders) / len(orders)))
    assert 0 < rank_sum_two_sided(100_000, 8, 60_000) < 1


def test_shares_of_blocks_fit_together():
    """Blocks derive their shares alone; together they are what was drawn, with the hypergeometric moments."""
    sizes = np.array([40, 0, 7, 90, 33, 1, 60])
    ends, n, drawn = np.concatenate([[0], np.cumsum(sizes)]), 4000, 80
    shares = np.array([pm.block_shares(ends, b, drawn, 97, 3, n) for b in range(len(sizes))])
    assert (shares.sum(0) == drawn).all() and (shares >= 0).all() and (shares <= sizes[:, None]).all()
    total = sizes.sum()
    assert np.allclose(shares.mean(1), drawn * sizes / total, atol=0.35)
    spread = drawn * sizes / total * (1 - sizes / total) * (total - drawn) / (total - 1)
    assert np.allclose(shares.var(1), spread, rtol=0.15, atol=0.1)
    large = pm._split(np.random.default_rng(1), 3 * 10**9, 10**9, np.full(4000, 10**6))
    assert abs(large.mean() - 750_000) < 40 and abs(large.std() / math.sqrt(10**6 * 0.75 * 0.25) - 1) < 0.06


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_copied_rows_are_never_broadcast(spark, tmp_path, keys):
    """The rows copied for every permutation are not the side that is sent, however small the table they come from."""
    spark.range(8000).selectExpr("id", "id % 2 AS k", "id % 4 AS block").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).selectExpr(
        "id AS row_id", "k", "block", "id % 3 = 0 AS x", "cast(id * 7919 % 41 AS double) AS v")
    out = pm.blocked_permutation_test(rows, "v", "x", "row_id", "block", 100, keys)
    assert len(out.collect()) == 1 + len(keys)
    plan = out._jdf.queryExecution().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_b#" in line and "perm#" in line]
    assert joins and not any("BuildLeft" in line for line in joins)
