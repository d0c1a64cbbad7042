"""

Ranks come from tie-collapsed runs (`value_runs`), so no sample is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipescope.functions.tails import chi_square_p, normal_p, rank_sum_p, signed_rank_p, student_p
from pipescope.operators.ordering import value_runs
from pipescope.operators.ranking import method_pairs, ranked

ALPHA = 0.05
EXACT_SAMPLE = 8  # the exact rank-sum law holds for an untied sample of at most so many rows
EXACT_PANEL = 50  # the exact signed-rank law holds for at most so many differences


def paired_t(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    d = F.col(a) - F.col(b)
    moments = df.groupBy(*keys).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_sd")
    )
    t = F.try_divide("mean_diff", F.col("_sd") / F.sqrt("n"))
    return moments.select(*keys, "n", "mean_diff", t.alias("t")).withColumn(
        "p_value", student_p(F.col("t"), F.col("n") - 1)
    )


def keyed_paired_t(df: DataFrame, value: str, flag: str, on: Sequence[str]) -> DataFrame:
    """Paired t over all pairs (flagged row, other row) that share the key, without forming the pairs.

    With G and B rows of a key, the sums of the G*B differences and of their squares follow from the
    sums on either side, so a key with very many rows costs one partial aggregate and not G*B rows.
    Values are taken relative to the overall mean, which leaves differences as they are.
    """
    centred = df.withColumn("_c", F.col(value) - df.agg(F.avg(value)).scalar())
    x, y = F.when(F.col(flag), F.col("_c")), F.when(~F.col(flag), F.col("_c"))
    sides = centred.groupBy(*on).agg(
        F.count(x).alias("_g"), F.count(y).alias("_b"), F.sum(x).alias("_sx"), F.sum(y).alias("_sy"),
        F.sum(x * x).alias("_qx"), F.sum(y * y).alias("_qy"),
    ).where("_g > 0 AND _b > 0")
    g, b, sx, sy = (F.col(c) for c in ("_g", "_b", "_sx", "_sy"))
    sums = sides.agg(
        F.sum(g * b).alias("n"), F.sum(b * sx - g * sy).alias("_d"),
        F.sum(b * F.col("_qx") + g * F.col("_qy") - 2 * sx * sy).alias("_q"),
    )
    n, mean = F.col("n"), F.col("_d") / F.col("n")
    spread = F.sqrt((F.col("_q") - n * mean * mean) / (n - 1))
    return sums.select("n", mean.alias("mean_diff"), F.try_divide(mean, spread / F.sqrt(n)).alias("t")).withColumn(
        "p_value", student_p(F.col("t"), n - 1)
    )


def _two_sample_moments(value: str, flag: str) -> list[Column]:
    x, y = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    return [
        F.count(x).alias("n"), F.count(y).alias("m"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"),
        F.var_samp(x).alias("_vx"), F.var_samp(y).alias("_vy"),
    ]


def _pooled_t() -> Column:
    dof = F.col("n") + F.col("m") - 2
    pooled = ((F.col("n") - 1) * F.col("_vx") + (F.col("m") - 1) * F.col("_vy")) / dof
    return F.try_divide(F.col("_mx") - F.col("_my"), F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("m"))))


def pooled_t(df: DataFrame, value: str, flag: str, keys: Sequence[str] = ()) -> DataFrame:
    """Two-sample t with equal variances; `flag` marks the first sample."""
    moments = df.groupBy(*keys).agg(*_two_sample_moments(value, flag)).where("n > 1 AND m > 1")
    tested = moments.select(
        *keys, "n", "m", (F.col("_mx") - F.col("_my")).alias("mean_diff"), _pooled_t().alias("t")
    )
    return tested.withColumn("p_value", student_p(F.col("t"), F.col("n") + F.col("m") - 2))


def mann_whitney(df: DataFrame, value: str, flag: str, keys: Sequence[str] = (), exact_up_to: int = EXACT_SAMPLE) -> DataFrame:
    """Two-sided Mann-Whitney U.

    Where the smaller sample has at most `exact_up_to` rows and no values tie, p is exact; else it is the normal form
    with tie and continuity correction (`z` is always that of the normal form). `u` is the statistic of the flagged sample.
    """
    first = F.sum(F.when(F.col(flag), 1).otherwise(0))
    runs = value_runs(df, keys, value, {"_x": first})
    t = F.col("n").cast("double")
    sums = runs.groupBy(*keys).agg(
        F.sum("_x").alias("n1"), F.sum("n").alias("_all"),
        F.sum(F.col("_x") * F.col("avg_rank")).alias("_r1"), F.sum(t * t * t - t).alias("_ties"),
    )
    n1, total = F.col("n1").cast("double"), F.col("_all").cast("double")
    n2 = total - n1
    u1 = F.col("_r1") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * ((total + 1) - F.col("_ties") / (total * (total - 1)))
    z = (F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / F.sqrt(variance)
    exact = (F.least(n1, n2) <= exact_up_to) & (F.col("_ties") == 0)
    tested = sums.where((F.col("n1") > 0) & (F.col("n1") < F.col("_all"))).select(
        *keys, "n1", n2.cast("long").alias("n2"), u1.alias("u"), z.alias("z"), F.when(exact, u1).alias("_exact_u")
    )
    # below the centre the corrected z is negative: the two-sided p is then 1
    by_law = rank_sum_p(F.col("_exact_u"), F.col("n1"), F.col("n2"))
    return tested.withColumn("p_value", F.coalesce(by_law, normal_p(F.greatest("z", F.lit(0.0))))).drop("_exact_u")


def _k_squared(moments: DataFrame) -> DataFrame:
    """Add the D'Agostino-Pearson statistic `k2` from `_n`, biased skewness `_g1` and kurtosis `_b2`.

    Intermediate terms are columns of their own: each is used several times further on.
    """
    n, c = F.col("_n"), F.col
    return (
        moments.withColumns({
            "_y": c("_g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))),
            "_beta": 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)),
            "_x": (c("_b2") - 3 * (n - 1) / (n + 1))
            / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))),
            "_s": 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
            * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))),
        })
        .withColumns({
            "_w2": -1 + F.sqrt(2 * (c("_beta") - 1)),
            "_a": 6 + 8 / c("_s") * (2 / c("_s") + F.sqrt(1 + 4 / (c("_s") * c("_s")))),
        })
        .withColumns({
            "_z1": F.asinh(c("_y") / F.sqrt(2 / (c("_w2") - 1))) / F.sqrt(0.5 * F.ln("_w2")),
            "_z2": (1 - 2 / (9 * c("_a")) - F.cbrt((1 - 2 / c("_a")) / (1 + c("_x") * F.sqrt(2 / (c("_a") - 4)))))
            / F.sqrt(2 / (9 * c("_a"))),
        })
        .withColumn("k2", c("_z1") * c("_z1") + c("_z2") * c("_z2"))
    )


def normality(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """K-squared and p per group; NULL below eight rows or without spread."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.skewness(value).alias("_g1"), (F.kurtosis(value) + 3).alias("_b2"),
        F.var_pop(value).alias("_v"),
    )
    usable = (F.col("n") >= 8) & (F.col("_v") > 0)
    # the stand-in size keeps the formula away from sizes at which it divides by zero
    sized = moments.withColumn("_n", F.when(usable, F.col("n")).otherwise(100).cast("double"))
    k2 = F.when(usable, F.col("k2"))
    return _k_squared(sized).select(*keys, "n", k2.alias("k2"), F.exp(-k2 / 2).alias("normality_p"))


def compare_by_normality(
    marked: DataFrame, value: str, flag: str, keys: Sequence[str], alpha: float = ALPHA
) -> DataFrame:
    """t-test where both samples look normal, else Mann-Whitney; one row per key."""
    normal = normality(marked, value, [*keys, flag])
    both = normal.groupBy(*keys).agg(
        F.max(F.when(F.col(flag), F.col("normality_p"))).alias("p_with"),
        F.max(F.when(~F.col(flag), F.col("normality_p"))).alias("p_without"),
    )
    t = pooled_t(marked, value, flag, keys).select(*keys, "mean_diff", F.col("t").alias("t"),
                                                   F.col("p_value").alias("_t_p"))
    u = mann_whitney(marked, value, flag, keys).select(*keys, "n1", "n2", "u", F.col("p_value").alias("_u_p"))
    use_t = F.coalesce((F.col("p_with") > alpha) & (F.col("p_without") > alpha), F.lit(False))
    joined = both.join(u, list(keys)).join(t, list(keys), "left")
    return joined.select(
        *keys, "n1", "n2", "mean_diff", "t", "u", "p_with", "p_without",
        F.when(use_t, "t-test").otherwise("Mann-Whitney U").alias("test"),
        F.when(use_t, F.col("_t_p")).otherwise(F.col("_u_p")).alias("p_value"),
    )


def wilcoxon_pairs(panel: DataFrame, keys: Sequence[str] = (), exact_up_to: int = EXACT_PANEL, exact_zeros: bool = False) -> DataFrame:
    """Signed-rank test (zeros ranked, then dropped) for every pair of methods, aligned on experiments, per `keys`.

    With at most `exact_up_to` differences and no zero among them p comes from the law of the rank sum under random signs
    of the (possibly tied) ranks; else from the normal form with tie correction. `exact_zeros` extends the exact law to
    panels with zeros, whose ranks then start above those of the zeros. `z` is always that of the normal form.
    """
    d, of = F.col("diff"), [*keys, "a", "b"]
    runs = value_runs(
        method_pairs(panel, keys).withColumn("size", F.abs(d)), of, "size",
        {"_pos": F.count_if(d > 0), "_neg": F.count_if(d < 0), "_zero": F.count_if(d == 0)},
    )
    t = F.when(F.col("size") > 0, F.col("n").cast("double"))
    sums = runs.groupBy(*of).agg(
        F.sum("n").alias("n"), F.sum("_zero").alias("zeros"),
        F.sum(F.col("_pos") * F.col("avg_rank")).alias("_plus"),
        F.sum(F.col("_neg") * F.col("avg_rank")).alias("_minus"),
        F.coalesce(F.sum(t * t * t - t), F.lit(0.0)).alias("_ties"),
    )
    n, z = F.col("n").cast("double"), F.col("zeros").cast("double")
    statistic = F.least("_plus", "_minus")
    mean = n * (n + 1) / 4 - z * (z + 1) / 4
    var = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.col("_ties") / 2) / 24
    score = F.try_divide(statistic - mean, F.sqrt(var))
    tested = sums.select(*of, "n", "zeros", statistic.alias("statistic"), score.alias("z"))
    small = tested.where((F.col("n") <= exact_up_to) & (F.lit(exact_zeros) | (F.col("zeros") == 0))).select(*of)
    ranks = runs.where(F.col("size") > 0).join(small, of, "left_semi").groupBy(*of).agg(F.flatten(F.collect_list(
        F.array_repeat(F.round(2 * F.col("avg_rank")).cast("int"), F.col("n").cast("int")))).alias("_ranks"))
    by_law = F.when(F.col("_ranks").isNotNull(), signed_rank_p(F.col("_ranks"), F.col("statistic")))
    return tested.join(ranks, of, "left").withColumn(
        "p_value", F.coalesce(by_law, normal_p(F.col("z")), F.lit(1.0))).drop("_ranks")


def friedman(panel: DataFrame) -> DataFrame:
    """Friedman chi-square over a complete panel, with tie correction: one row."""
    ranks = ranked(panel, ascending=True)
    by_method = ranks.groupBy("method").agg(F.sum("rank").alias("_r"), F.count(F.lit(1)).alias("_n"))
    sums = by_method.agg(
        F.count(F.lit(1)).alias("k"), F.max("_n").alias("n"), F.sum(F.col("_r") * F.col("_r")).alias("_r2")
    )
    # each run of t tied values holds t rows, and each row contributes t^2 - 1
    ties = ranks.groupBy("experiment", "value").agg(F.count(F.lit(1)).cast("double").alias("_t")).agg(
        F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties")
    )
    both = sums.withColumn("_ties", ties.scalar())
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    chi = (12 / (n * k * (k + 1)) * F.col("_r2") - 3 * n * (k + 1)) / (1 - F.col("_ties") / (n * k * (k * k - 1)))
    return both.select("n", "k", chi.alias("chi_square")).withColumn(
        "p_value", chi_square_p(F.col("chi_square"), F.col("k") - 1)
    )


def holm(tests: DataFrame, p: str = "p_value", alpha: float = ALPHA, ties: Sequence[str] = ("a", "b")) -> DataFrame:
    """Step-down correction: reject in ascending order until the first failure.

    The windows run over the table of tests (one row per comparison).
    """
    order = Window.partitionBy().orderBy(p, *ties)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    place = F.row_number().over(order)
    stepped = tests.withColumn("threshold", F.lit(alpha) / (m - place + 1))
    ok = F.when(F.col(p) <= F.col("threshold"), 1).otherwise(0)
    return stepped.withColumn(
        "reject", F.min(ok).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    )


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", alpha: float = ALPHA,
                       ties: Sequence[str] = ()) -> DataFrame:
    """Step-up correction: reject everything up to the largest passing place; adds the adjusted alpha."""
    whole = Window.partitionBy()
    order = whole.orderBy(p, *ties)
    out = tests.withColumn("place", F.row_number().over(order)).withColumn(
        "threshold", F.col("place") * alpha / F.count(F.lit(1)).over(whole)
    )
    passing = F.when(F.col(p) <= F.col("threshold"), F.col("place"))
    out = out.withColumn("_last", F.coalesce(F.max(passing).over(whole), F.lit(0)))
    adjusted = F.max(F.when(F.col("place") == F.col("_last"), F.col("threshold"))).over(whole)
    return out.withColumns({"reject": F.col("place") <= F.col("_last"), "adjusted_alpha": adjusted}).drop("_last")


def gated_pairs(panel: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Pairwise tests with Holm, empty when the Friedman test does not reject."""
    gate = friedman(panel).select(F.col("p_value") < alpha)
    return holm(wilcoxon_pairs(panel), alpha=alpha).withColumn("_gate", gate.scalar()).where("_gate").drop("_gate")
