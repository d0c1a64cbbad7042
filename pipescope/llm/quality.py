"""Quality rules as robust multivariate outlier detection, in DataFrame functions only.

A document's statistics are turned into a vector: log of the number of words, log of the mean word length,
log of one plus the percentage of symbols per word, the share of words in repeated windows, and the share of lines
that repeat an earlier one. Per language and source, the minimum-covariance-determinant estimate finds the h rows whose
covariance has the smallest determinant, by concentration steps from two deterministic starts; documents
whose Mahalanobis distance to it is beyond the far tail of the chi-square law are rejected.

A first estimate has the highest breakdown point, h = (n + p + 1) / 2, so junk may be almost half of a group. Where
it finds that at most 1 - `support` of the group is beyond the tail, the estimate from h = `support` of the group
takes its place, which uses more of the ordinary rows; elsewhere that subset would have to take junk in, and the first
estimate stays.

Every concentration step is one aggregation: rows are binned by distance, each (group, start, bin) gets its
count and its sums of coordinates and products, and the bins up to the one that holds the h-th row form
the next subset (so a subset may exceed h by the rest of that bin). A group therefore never meets in one
task, whatever its size. Coordinates are whole multiples of 1/1024 and sums are whole numbers, so results
do not depend on the order of addition.

Defined cases: a null text has no words (all statistics 0, so the base rules reject it); null languages and
sources form groups of their own; a group whose rows agree has the floor variances; repeated rows count as
rows; an empty table gives no rows; columns beyond the named ones are passed through by `judged` under
any name that is not one of its own results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipescope.llm.common import SPACE, let, word_array, written
from pipescope.session import cut_lineage

WINDOW = 8
SCALE = 1024
# standard deviations added to each coordinate's spread, so that a coordinate that hardly varies in a
# source does not reject ordinary documents
FLOORS = (0.5, 0.1, 0.35, 0.1, 0.08)
D = len(FLOORS)
GROUPS_A_TASK = 200  # whose bins, some hundreds each, or estimates a task takes
COORDINATES = [f"x{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(hashes: Column) -> Column:
    """Words in 8-word windows that occur twice or more, from the hashes of the words in order."""
    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(rows: Column) -> Column:
            same = F.filter(rows, lambda r, k: (F.get(rows, k - 1)["h"] == r["h"]) | (F.get(rows, k + 1)["h"] == r["h"]))
            starts = F.array_sort(F.transform(same, lambda r: r["i"]))
            return let(starts, lambda s: F.aggregate(
                F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.least(
                    F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
                F.lit(0).cast("long"), lambda total, n: total + n))

        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(placed, repeated)).otherwise(
            F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW),
                          lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(hashes) > WINDOW, let(windows, covered)).otherwise(F.lit(0).cast("long"))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of every whole text and `base_failed`."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{SPACE[1:]}"))
    return (
        docs.withColumn("_words", word_array(F.col(text)))
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
            "_lines": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))),
            "n_repeat_words": let(F.transform("_words", lambda w: F.xxhash64(w)), _repeat_words),
        })
        .withColumns({"n_lines": F.col("_lines.n"), "n_dup_lines": F.col("_lines.again")})
        .drop("_words", "_lines")
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )


def with_coordinates(df: DataFrame) -> DataFrame:
    """Add the transformed statistics as whole multiples of 1/SCALE."""
    words = F.greatest("n_words", F.lit(1))
    values = (
        F.log1p(F.col("n_words").cast("double")), F.log(F.greatest("word_chars", F.lit(1)) / words),
        F.log1p(100 * F.col("n_symbols") / words), F.col("n_repeat_words") / words,
        F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    )
    return df.withColumns({x: F.round(v * SCALE).cast("long") for x, v in zip(COORDINATES, values)})


def chi_square_tail(x: float, dof: int) -> float:
    """P(X > x)."""
    half = x / 2
    if dof % 2:
        return math.erfc(math.sqrt(half)) + math.exp(-half) * sum(half ** (i + 0.5) / math.gamma(i + 1.5) for i in range(dof // 2))
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(dof // 2))


def chi_square_quantile(tail: float, dof: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_tail(high, dof) > tail:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_tail(middle, dof) > tail else (low, middle)
    return high


def with_distance(df: DataFrame, out: str) -> DataFrame:
    """Add the squared Mahalanobis distance of x0.. to means m0.. under the Cholesky factor l_ij."""
    names = []
    for i in range(D):
        rest = F.col(f"x{i}") / SCALE - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(names[j])
        names.append(f"_z{i}")
        df = df.withColumn(names[-1], rest / F.col(f"l{i}{i}"))
    square = sum((F.col(z) * F.col(z) for z in names[1:]), F.col(names[0]) * F.col(names[0]))
    return df.withColumn(out, square).drop(*names)


def with_cholesky(df: DataFrame) -> DataFrame:
    """Add the factor l_ij of the covariances c_ij plus the floors, and the log of its determinant."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # the floor keeps the matrix positive; rounding may not take that away
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.withColumn("log_det", sum((2 * F.log(f"l{i}{i}") for i in range(1, D)), 2 * F.log("l00")))


def _starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Two estimates per group: medians with quartile spreads, and medians with the floors alone.

    Medians and quartiles are exact: values are whole numbers in a short range, so they are counted.
    """
    stacked = ", ".join(f"{i}, x{i}" for i in range(D))
    counts = rows.selectExpr(*keys, f"stack({D}, {stacked}) as (dim, value)").groupBy(*keys, "dim", "value").agg(
        F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys, "dim")
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
    at = {q: F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("value"))) / SCALE for q in (0.25, 0.5, 0.75)}
    marks = placed.groupBy(*keys, "dim").agg(at[0.5].alias("middle"), ((at[0.75] - at[0.25]) / 1.349).alias("spread"))
    wide = marks.groupBy(*keys).agg(
        *[F.max(F.when(F.col("dim") == i, F.col("middle"))).alias(f"m{i}") for i in range(D)],
        *[F.max(F.when(F.col("dim") == i, F.col("spread"))).alias(f"s{i}") for i in range(D)])
    wide = wide.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    variances = {f"c{i}{j}": (F.col(f"s{i}") * F.col(f"s{i}") * (1 - F.col("start")) if i == j else F.lit(0.0))
                 for i, j in PAIRS}
    return with_cholesky(wide.withColumns(variances)).select(*keys, "start", *_estimate_columns())


def _estimate_columns() -> list[str]:
    return [f"m{i}" for i in range(D)] + [f"l{i}{j}" for i, j in PAIRS] + ["log_det"]


def _half(total: Column) -> Column:
    """The rows of the subset with the highest breakdown point."""
    return F.least(total, F.floor((total + D + 1) / 2))


def _step(rows: DataFrame, estimates: DataFrame, keys: list[str], support: float | None, tasks: int) -> DataFrame:
    """One concentration step for every group and start; `tasks` take the bins and the estimates."""
    near = with_distance(_with_group(rows, estimates, keys), "_d2")
    binned = near.withColumn("_bin", F.floor(16 * F.log2(1 + 64 * F.col("_d2"))))
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(COORDINATES)] + [
        F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS]
    bins = binned.groupBy(*keys, "start", "_bin").agg(F.count(F.lit(1)).alias("n"), *sums).coalesce(tasks)
    group = Window.partitionBy(*keys, "start")
    earlier = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    kept = bins.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(group)}).where(
        F.col("before") < (_half(F.col("total")) if support is None else F.ceil(F.lit(support) * F.col("total"))))
    totals = kept.groupBy(*keys, "start").agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(D)],
        *[F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in PAIRS])
    moments = totals.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") / SCALE for i in range(D)}).withColumns({
        f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n") / SCALE**2 - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS})
    return with_cholesky(moments).select(*keys, "start", *_estimate_columns()).coalesce(tasks)


def _with_group(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Join each row with the estimates of its group, null keys included."""
    renamed = estimates.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = None
    for k in keys:
        equal = rows[k].eqNullSafe(renamed[f"_g_{k}"])
        same = equal if same is None else same & equal
    return rows.join(renamed, same).drop(*[f"_g_{k}" for k in keys])


def mcd(rows: DataFrame, keys: list[str], support: float | None = 0.75) -> DataFrame:
    """(keys, m_i, l_ij, log_det): the minimum-covariance-determinant estimate of each group; None is (n + p + 1) / 2 rows.

    A step that does not make a determinant smaller (bins are taken in whole, so it may grow) leaves its estimate as it
    was; steps go on until no determinant falls any more. What is known of the groups is a short table, which as many
    tasks take as the groups ask for: a step has one stage over the rows, and few tasks besides.
    """
    starts = cut_lineage(_starts(rows, keys))
    tasks = max(1, math.ceil(starts.count() / 2 / GROUPS_A_TASK))
    estimates = cut_lineage(_step(rows, starts.coalesce(tasks), keys, support, tasks))
    while True:
        both = estimates.withColumn("_new", F.lit(0)).unionByName(
            _step(rows, estimates, keys, support, tasks).withColumn("_new", F.lit(1)))
        chosen = both.groupBy(*keys, "start").agg(F.min(F.struct(
            F.round("log_det", 6).alias("_rounded"), "_new", *_estimate_columns())).alias("_least"))
        stepped = cut_lineage(chosen.select(*keys, "start", "_least.*").coalesce(tasks))
        estimates = stepped.drop("_rounded", "_new")
        if stepped.where("_new = 1").isEmpty():
            break
    best = Window.partitionBy(*keys).orderBy(F.round("log_det", 9), "start")
    return estimates.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best", "start").coalesce(tasks)


def _consistency(support: float) -> float:
    """The usual factor between the spread of the nearest share of normal rows and the spread of all."""
    return support / (1 - chi_square_tail(chi_square_quantile(1 - support, D), D + 2))


def _of_groups(estimates: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = None
    for k in keys:
        equal = estimates[k].eqNullSafe(renamed[f"_g_{k}"])
        same = equal if same is None else same & equal
    return estimates.join(renamed, same, how)


def judged(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = (),
           support: float = 0.75, tail: float = 1e-9) -> DataFrame:
    """The `keep` columns of every row with its statistics, `base_failed`, `distance` and `kept`.

    `distance` is the squared robust distance with the usual consistency factor; rows beyond the
    chi-square quantile of `tail` are rejected. Documents the base rules reject have no part in the estimate.
    `support` is the share of a group's rows in the estimate where no more than the rest of them are outliers.
    """
    keys = ["_lang", "_source"]
    chosen = docs.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
                         F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    stats = with_coordinates(with_statistics(chosen, "_text"))
    # written once, with the columns to keep; the steps of the estimates read the coordinates alone
    small = written(stats.drop("_text", "n_lines"), "statistics")
    judging = small.where("not base_failed").select(*keys, *COORDINATES)
    cutoff = chi_square_quantile(tail, D)
    wary = cut_lineage(mcd(judging, keys, None).withColumn("factor", F.lit(_consistency(0.5))))
    shares = with_distance(_with_group(judging, wary, keys), "_d2").groupBy(*keys).agg(
        F.avg((F.col("_d2") > F.lit(cutoff) * F.col("factor")).cast("int")).alias("_beyond"))
    crowded = cut_lineage(shares.where(F.col("_beyond") > F.lit(1 - support)).select(*keys))
    usual = mcd(judging, keys, support).withColumn("factor", F.lit(_consistency(support)))
    estimates = cut_lineage(_of_groups(usual, crowded, keys, "left_anti").unionByName(_of_groups(wary, crowded, keys, "left_semi")))
    measured = with_distance(_left_group(small, estimates, keys), "_d2")
    distance = F.round(F.col("_d2") / F.col("factor"), 6)
    return measured.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], *STATISTICS, "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= F.lit(cutoff))).alias("kept"))


def kept_rows(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", **parameters) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns whatever their names."""
    names = docs.columns
    numbered = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {role: f"_c{names.index(name)}" for role, name in (("text", text), ("lang", lang), ("source", source))}
    kept = judged(numbered, keep=tuple(numbered.columns), **at, **parameters).where("kept")
    return kept.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def _left_group(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """As `_with_group`, but rows of groups without an estimate (all base-rejected) stay."""
    renamed = estimates.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    same = None
    for k in keys:
        equal = rows[k].eqNullSafe(renamed[f"_g_{k}"])
        same = equal if same is None else same & equal
    return rows.join(renamed, same, "left").drop(*[f"_g_{k}" for k in keys])
