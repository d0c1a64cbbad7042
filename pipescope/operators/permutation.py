"""Permutation tests.

A permutation of a sample is the order of its rows by md5(permutation:row:seed); the first n_x rows
form the permuted first sample. Which rows these are is found without sorting a permutation: the
leading digits of the digest are buckets, bucket sums come from a partial aggregation, whole buckets
below the cut are added up, and only the rows of the one bucket holding the cut are ordered. A test
over any number of rows therefore shuffles (permutations x buckets) sums and not
(permutations x rows) rows, and any partitioning gives the same p-value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipescope.session import cut_lineage

BUCKET_DIGITS = 2
EXACT_LIMIT = 20
# sums of the same numbers in another order differ in the last digits: differences that are this share of the
# largest value apart count as equal, so a test does not change with the unit of its values
TOLERANCE = 1e-9
ROWS_PER_BLOCK = 50_000
PERMUTATIONS_PER_TASK = 2_000
LANES = 64  # tasks that a sample of few blocks is copied for
HYPERGEOMETRIC_LIMIT = 10**9
BROADCAST_BYTES = 16 << 20
HOLDING_BYTES = 100  # of one row that tells the bucket of a cut


def _at_least(a: Column, b: Column, scale: Column) -> Column:
    return a >= b - F.lit(TOLERANCE) * scale


def sample_of(df: DataFrame, keys: Sequence[str], value: str, flag: str, row: str) -> DataFrame:
    """The compact sample (keys, _v, _x, _row), written once: four branches of the test read it.

    It is spread over all cores first, because every row is multiplied by the permutations later and a
    small sample often sits in one partition.
    """
    slim = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), F.col(flag).alias("_x"), F.col(row).cast("string").alias("_row")
    )
    return cut_lineage(slim.repartition(df.sparkSession.sparkContext.defaultParallelism))


def permutations_of(df: DataFrame, n_permutations: int) -> DataFrame:
    return df.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_permutations))))


def _row_digest(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col("perm").cast("string"), "_row", F.lit(str(seed))))


def permuted_sums(sample: DataFrame, keys: Sequence[str], n_permutations: int, seed: int) -> DataFrame:
    """(keys, perm, n_x, sum_x): the sum of the first n_x rows of every permutation of every group."""
    sizes = sample.groupBy(*keys).agg(F.count_if("_x").alias("n_x"))
    exploded = permutations_of(sample.drop("_x"), n_permutations).withColumn("_h", _row_digest(seed)).withColumn(
        "_b", F.substring("_h", 1, BUCKET_DIGITS)
    )
    bucket_sums = exploded.groupBy(*keys, "perm", "_b").agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_n"))
    group = [*keys, "perm"]
    upto = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sized = bucket_sums.join(sizes, list(keys)) if keys else bucket_sums.withColumn("n_x", sizes.scalar())
    placed = sized.withColumns({"_upto": F.sum("_n").over(upto), "_sum_upto": F.sum("_s").over(upto)})
    # the bucket in which the n_x-th row lies, with what lies wholly below it
    holding = placed.where((F.col("_upto") >= F.col("n_x")) & (F.col("_upto") - F.col("_n") < F.col("n_x"))).select(
        *group, "_b", "n_x", (F.col("n_x") - F.col("_upto") + F.col("_n")).alias("_need"),
        (F.col("_sum_upto") - F.col("_s")).alias("_below"),
    )
    # one row per group and permutation, against one per row and permutation of `exploded`: that side is never sent, however
    # small Spark's guess from the sample's size
    cuts = (sizes.count() if keys else 1) * n_permutations
    sent = F.broadcast(holding) if cuts * HOLDING_BYTES <= BROADCAST_BYTES else holding.hint("merge")
    inside = Window.partitionBy(*group, "_b").orderBy("_h", "_row")
    cut_rows = (
        exploded.join(sent, [*group, "_b"])
        .withColumn("_place", F.row_number().over(inside))
        .where(F.col("_place") <= F.col("_need"))
    )
    return cut_rows.groupBy(*group).agg(
        F.max("n_x").alias("n_x"), (F.sum("_v") + F.max("_below")).alias("sum_x")
    )


def _finish(perms: DataFrame, observed: DataFrame, keys: Sequence[str], one_sided: bool) -> DataFrame:
    """Count permutations at least as extreme as observed; p = (1 + count) / (1 + N)."""
    if keys:
        joined = perms.join(observed, list(keys))
    else:
        joined = perms.withColumn("_o", observed.select(F.struct("*")).scalar()).select("*", "_o.*")
    rest = F.col("_total") - F.col("sum_x")
    diff = F.col("sum_x") / F.col("n") - rest / F.col("m")
    scale = F.col("_scale")
    extreme = _at_least(diff, F.col("mean_diff"), scale) if one_sided else _at_least(F.abs(diff), F.abs("mean_diff"), scale)
    counted = joined.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("m").alias("m"), F.max("mean_diff").alias("mean_diff"),
        F.count_if(extreme).alias("extreme"), F.count(F.lit(1)).alias("permutations"),
    ).where("n IS NOT NULL")
    return counted.withColumn("p_value", (F.col("extreme") + 1) / (F.col("permutations") + 1))


def _sample_sums(sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sizes and sums of both samples for the groups that have both."""
    return (
        sample.groupBy(*keys)
        .agg(F.count_if("_x").alias("n"), F.count_if(~F.col("_x")).alias("m"),
             F.coalesce(F.sum(F.when(F.col("_x"), F.col("_v"))), F.lit(0.0)).alias("_sx"),
             F.sum("_v").alias("_total"), F.max(F.abs("_v")).alias("_scale"))
        .where("n > 0 AND m > 0")
    )


def _observed(sums: DataFrame) -> DataFrame:
    rest = F.col("_total") - F.col("_sx")
    return sums.withColumn("mean_diff", F.col("_sx") / F.col("n") - rest / F.col("m")).drop("_sx")


def permutation_test(
    df: DataFrame, value: str, flag: str, row: str, n_permutations: int = 100_000, keys: Sequence[str] = (),
    one_sided: bool = False, seed: int = 97,
) -> DataFrame:
    """Difference in means of the flagged and the other rows: n, m, mean_diff, extreme, p_value per key.

    `row` names a row of the sample uniquely; with `keys` many comparisons run in one job. Groups that
    lack one of the samples have no result.
    """
    sample = sample_of(df, keys, value, flag, row)
    observed = _observed(_sample_sums(sample, keys))
    perms = permuted_sums(sample, keys, n_permutations, seed)
    return _finish(perms, observed, keys, one_sided)


def blocked_permutation_test(
    df: DataFrame, value: str, flag: str, row: str, block: str, n_permutations: int = 10_000,
    keys: Sequence[str] = (), seed: int = 97,
) -> DataFrame:
    """The same with rows permuted inside their block only; blocks lacking a sample are left out."""
    inside = [*keys, block]
    sample = sample_of(df, inside, value, flag, row)
    blocks = _sample_sums(sample, inside)
    observed = _observed(
        blocks.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "m", "_sx", "_total")], F.max("_scale").alias("_scale"))
    )
    per_block = permuted_sums(sample, inside, n_permutations, seed).join(
        blocks.select(*inside), inside, "left_semi"
    )
    perms = per_block.groupBy(*keys, "perm").agg(F.sum("sum_x").alias("sum_x"))
    return _finish(perms, observed, keys, one_sided=False)


def paired_permutation_test(
    df: DataFrame, a: str, b: str, pair: str, n_permutations: int = 10_000, keys: Sequence[str] = (),
    seed: int = 97,
) -> DataFrame:
    """Random swaps inside pairs: a pair is swapped when the last bit of its digest is set.

    Each permutation is one sum of signed differences: a single partial aggregation.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pairs = cut_lineage(
        df.select(*keys, (F.col(a) - F.col(b)).alias("_d"), F.col(pair).cast("string").alias("_row"))
        .repartition(cores)
    )
    observed = pairs.groupBy(*keys).agg(F.count("_d").alias("n"), F.avg("_d").alias("mean_diff"), F.max(F.abs("_d")).alias("_scale"))
    swap = F.substring(_row_digest(seed), 32, 1).isin(list("13579bdf"))
    signed = F.when(swap, -F.col("_d")).otherwise(F.col("_d"))
    perms = permutations_of(pairs, n_permutations).groupBy(*keys, "perm").agg(F.avg(signed).alias("diff"))
    return _finish_paired(perms, observed, keys)


def _finish_paired(perms: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        joined = perms.join(observed, list(keys))
    else:
        joined = perms.withColumn("_o", observed.select(F.struct("*")).scalar()).select("*", "_o.*")
    counted = joined.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("mean_diff").alias("mean_diff"),
        F.count_if(_at_least(F.abs("diff"), F.abs("mean_diff"), F.col("_scale"))).alias("extreme"),
        F.count(F.lit(1)).alias("permutations"),
    )
    return counted.withColumn("p_value", (F.col("extreme") + 1) / (F.col("permutations") + 1))


def paired_exhaustive_test(df: DataFrame, a: str, b: str, pair: str, exact: bool = False,
                           keys: Sequence[str] = (), limit: int = EXACT_LIMIT) -> DataFrame:
    """All 2^n swap patterns, for at most `limit` pairs per key.

    By default p = (c + 1) / (2^n + 1) as published results used; `exact` gives c / 2^n.
    The differences of one key (at most `limit`) are kept as one array.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    oversized = sizes.agg(F.max("n")).scalar()
    checked = df.withColumn("_max", oversized).where(
        F.when(F.col("_max") > limit, F.raise_error(F.lit(f"more than {limit} pairs")).cast("boolean")).otherwise(True)
    )
    gathered = checked.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pair), (F.col(a) - F.col(b)).alias("d")))).alias("_pairs")
    )
    masks = F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("_pairs")).cast("int") - 1))
    swapped = F.expr(
        "aggregate(transform(_pairs, (p, i) -> if(getbit(mask, i) = 1, -p.d, p.d)), 0D, (s, d) -> s + d)"
    )
    plain = F.expr("aggregate(_pairs, 0D, (s, p) -> s + p.d)")
    n = F.size("_pairs")
    largest = F.array_max(F.transform("_pairs", lambda p: F.abs(p["d"])))
    each = gathered.withColumn("mask", masks).select(
        *keys, n.alias("n"), (plain / n).alias("mean_diff"), (swapped / n).alias("diff"), largest.alias("_scale")
    )
    counted = each.groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("mean_diff").alias("mean_diff"),
        F.count_if(_at_least(F.abs("diff"), F.abs("mean_diff"), F.col("_scale"))).alias("extreme"),
        F.count(F.lit(1)).alias("permutations"),
    )
    p = F.col("extreme") / F.col("permutations") if exact else (F.col("extreme") + 1) / (F.col("permutations") + 1)
    return counted.withColumn("p_value", p)


def _split(rng: np.random.Generator, left: int, right: int, drawn: np.ndarray) -> np.ndarray:
    """How many of `drawn` rows, drawn without replacement, come from the left part: hypergeometric.

    Beyond the generator's range of 10^9 rows a part, the normal law with the same mean and variance stands in.
    """
    if max(left, right) < HYPERGEOMETRIC_LIMIT:
        return rng.hypergeometric(left, right, drawn)
    total, share = left + right, left / (left + right)
    spread = np.sqrt(drawn * share * (1 - share) * (total - drawn) / max(total - 1, 1))
    guess = np.rint(drawn * share + spread * rng.standard_normal(len(drawn))).astype(np.int64)
    return np.clip(guess, np.maximum(0, drawn - right), np.minimum(left, drawn))


def block_shares(ends: np.ndarray, block: int, drawn: int, seed: int, task: int, n: int) -> np.ndarray:
    """How many of `drawn` rows a block gives in each of the `n` permutations of a task.

    `ends` are the running numbers of rows, from 0. The blocks are the leaves of a binary tree; each node splits its share
    between its halves by a draw seeded by task and node, so a block follows its own path from the root, and the shares of
    all blocks fit together although every block derives its own alone.
    """
    low, high, share = 0, len(ends) - 1, np.full(n, drawn, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, task, low, high])
        left = _split(rng, int(ends[middle] - ends[low]), int(ends[high] - ends[middle]), share)
        if block < middle:
            share, high = left, middle
        else:
            share, low = share - left, middle
    return share


def monte_carlo_test(
    df: DataFrame, value: str, flag: str, row: str, n_permutations: int = 100_000, one_sided: bool = False, seed: int = 97,
) -> DataFrame:
    """The two-sample test by random draws instead of digests, in one form for samples of any size.

    Rows are dealt into blocks by a hash of `row`. For a permutation each block derives how many rows of the smaller
    sample it gives (`block_shares`, in steps of the logarithm of the number of blocks), draws that many of its rows and
    reports their sum. No task holds more than a block, rows are copied only as often as a few blocks need to keep LANES
    tasks busy, and only (permutations x blocks) sums are shuffled.
    """
    slim = df.where(F.col(value).isNotNull()).select(
        F.col(value).cast("double").alias("_v"), F.col(flag).alias("_x"), F.col(row).cast("string").alias("_row"))
    sample = cut_lineage(slim)
    observed = _observed(_sample_sums(sample, [])).first()
    if observed is None:
        return _finish(df.sparkSession.createDataFrame([], "perm long, sum_x double"), _observed(_sample_sums(sample, [])), [], one_sided)
    n, m, total = observed["n"], observed["m"], observed["_total"]
    blocks = -(-(n + m) // ROWS_PER_BLOCK)
    placed = sample.withColumn("_block", F.pmod(F.xxhash64("_row"), F.lit(blocks)))
    counted = {r["_block"]: r["count"] for r in placed.groupBy("_block").count().collect()}  # one number per block
    ends = np.concatenate([[0], np.cumsum([counted.get(b, 0) for b in range(blocks)])]).astype(np.int64)
    smaller, first_is_smaller = min(n, m), n <= m
    tasks = -(-n_permutations // PERMUTATIONS_PER_TASK)
    lanes = min(tasks, max(1, LANES // blocks))

    def draw(key: tuple, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        block, lane = int(key[0]), int(key[1])
        values = rows.sort_values(["_row", "_v"])["_v"].to_numpy()
        for task in range(lane, tasks, lanes):
            numbers = np.arange(task * PERMUTATIONS_PER_TASK + 1, min((task + 1) * PERMUTATIONS_PER_TASK, n_permutations) + 1)
            shares = block_shares(ends, block, smaller, seed, task, len(numbers))
            rng = np.random.default_rng([seed, task, block, block])
            sums = [rng.choice(values, int(share), replace=False, shuffle=False).sum() for share in shares]
            yield pd.DataFrame({"perm": numbers, "part": sums})

    def drawn(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from draw(key, pd.concat(list(batches)))

    spread = placed.select("_block", "_row", "_v", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_lane"))
    parts = spread.groupBy("_block", "_lane").applyInPandas(drawn, "perm long, part double")
    sum_x = F.sum("part") if first_is_smaller else F.lit(total) - F.sum("part")
    return _finish(parts.groupBy("perm").agg(sum_x.alias("sum_x")), _observed(_sample_sums(sample, [])), [], one_sided)
