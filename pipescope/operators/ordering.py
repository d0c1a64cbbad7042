"""Order-dependent results without a one-task window.

A window partitioned by a group sorts that whole group in one task, which fails once a group holds a
large share of the data. Everything here works in two levels instead: rows are first put in *buckets*
that respect the order (value ranges, hash prefixes or time slots), buckets are totalled with partial
aggregation, the few totals per group are accumulated, and only then are rows ordered inside their
bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipescope.session import cut_lineage

BUCKET_LEVELS = 6  # value ranges per group: 2 to this power at least
HASH_BUCKET_DIGITS = 3  # digest buckets: 16 to this power at least
SKETCH = 10_000  # accuracy of the sketches that bracket quantiles: ranks are right within 1 / SKETCH of the rows
MARGIN = 4 / SKETCH  # half the width of a bracket
BROADCAST_GROUPS = 10_000  # whose brackets are sent to all tasks
ROWS_PER_BUCKET = 100_000  # ordered in one task; more rows get more buckets


def bucket_levels(df: DataFrame, keys: Sequence[str]) -> int:
    """The levels at which a bucket of the largest group holds about ROWS_PER_BUCKET rows."""
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    return max(BUCKET_LEVELS, math.ceil(math.log2(max(1, most / ROWS_PER_BUCKET))))


def hash_digits(rows: int) -> int:
    return max(HASH_BUCKET_DIGITS, math.ceil(math.log(max(1, rows / ROWS_PER_BUCKET), 16)))


def prior_totals(totals: DataFrame, keys: Sequence[str], bucket: str, specs: dict[str, Column]) -> DataFrame:
    """For every (keys, bucket) row: each aggregate over the strictly earlier buckets of the same keys.

    `totals` has one row per (keys, bucket), so the window holds at most as many rows as buckets.
    """
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, bucket, *[agg.over(before).alias(name) for name, agg in specs.items()])


def with_value_bucket(df: DataFrame, keys: Sequence[str], value: str, levels: int = BUCKET_LEVELS,
                      out: str = "bucket") -> DataFrame:
    """Number the value range each row falls in; ranges hold about equally many rows per group.

    The cut points (2^levels - 1 doubles per group) are fixed by a checkpoint, so every later use of
    the bucket number agrees even if tasks are re-run. A row finds its range by binary search.
    """
    buckets = 2**levels
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = cut_lineage(
        df.groupBy(*keys).agg(F.percentile_approx(F.col(value), shares, F.lit(buckets * 20)).alias("_cuts"))
    )
    if keys:
        placed = df.join(cuts, list(keys), "left")
    else:
        placed = df.withColumn("_cuts", cuts.scalar())
    placed = placed.withColumn(out, F.lit(0))
    for level in reversed(range(levels)):
        step = 2**level
        beyond = F.get("_cuts", F.col(out) + (step - 1)) < F.col(value)
        placed = placed.withColumn(out, F.col(out) + F.when(beyond, step).otherwise(0))
    return placed.drop("_cuts")


def value_runs(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, distinct value) with `n` rows, `n_before` rows of smaller value and the
    average ascending rank `avg_rank` that tied rows share. `sums` adds further aggregates.

    Ties are collapsed by a partial aggregation before anything is ordered, so a value repeated a
    billion times is one row here. The collapsed rows are written once, since the cut points, the
    bucket totals and the ranks all read them. NULL values are left out, as ranking leaves them out.
    """
    runs = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *[agg.alias(name) for name, agg in (sums or {}).items()])
    )
    runs = with_value_bucket(runs, keys, value, bucket_levels(runs, keys), out="_vb")
    totals = runs.groupBy(*keys, "_vb").agg(F.sum("n").alias("_bucket_n"))
    offsets = prior_totals(totals, keys, "_vb", {"_offset": F.sum("_bucket_n")})
    inside = Window.partitionBy(*keys, "_vb").orderBy(value)
    counted = (
        runs.join(offsets, [*keys, "_vb"])
        .withColumn("_upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n_before", F.coalesce("_offset", F.lit(0)) + F.col("_upto") - F.col("n"))
        .withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))
    )
    return counted.drop("_vb", "_offset", "_upto")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group and its size `n`, exact at any size. NULL values are left out.

    The quantile at p lies at position p*(n-1). One pass sketches for each p a pair of values that has this position
    between them; a second pass keeps what lies between, collapsed by value (about 2 * MARGIN of a group), and of the rest
    only its number and the nearest values on both sides. Positions are counted in that; nothing else is ordered, and
    of the data nothing is written. A position outside its pair would be an error, not a wrong value.
    """
    inner = {name: float(p) for name, p in probs.items() if 0 < p < 1}
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))

    def marks(shift: float) -> Column:
        shares = [min(1.0, max(0.0, p + shift)) for p in inner.values()]
        return F.percentile_approx("_v", F.array(*map(F.lit, shares)), F.lit(SKETCH))

    ends = [F.count(F.lit(1)).alias("n"), F.min("_v").cast("double").alias("_min"), F.max("_v").cast("double").alias("_max")]
    if not inner:
        sides = rows.groupBy(*keys).agg(*ends)
        return sides.select(*keys, *[F.col("_max" if p > 0 else "_min").alias(name) for name, p in probs.items()], "n")
    around = rows.groupBy(*keys).agg(F.struct(*ends, marks(-MARGIN).alias("low"), marks(MARGIN).alias("high")).alias("_around"))
    if keys:
        # written once, so that few groups can be counted and sent to the rows: dealt by group, a group were one task
        around = cut_lineage(around)
        placed = rows.join(F.broadcast(around) if around.count() <= BROADCAST_GROUPS else around, list(keys))
    else:
        placed = rows.withColumn("_around", around.scalar())

    def side(q: Column) -> Column:
        below = F.col("_v") < F.get("_around.low", q)
        return F.when(below, -1).when(F.col("_v") > F.get("_around.high", q), 1).otherwise(0)

    numbers = F.array(*map(F.lit, range(len(inner))))
    each = placed.withColumn("_q", F.explode(F.transform(numbers, lambda q: F.struct(q.alias("of"), side(q).alias("side")))))
    counts = each.groupBy(*keys, "_q", F.when(F.col("_q.side") == 0, F.col("_v")).alias("_at")).agg(
        F.count(F.lit(1)).alias("_count"), F.max("_v").alias("_high"), F.min("_v").alias("_low"),
        *[F.max(f"_around.{c}").alias(f"_all_{c}") for c in ("n", "_min", "_max")])
    order = Window.partitionBy(*keys, "_q.of").orderBy("_q.side", "_at").rowsBetween(Window.unboundedPreceding, 0)
    counted = counts.withColumn("_upto", F.sum("_count").over(order)).withColumn("_first", F.col("_upto") - F.col("_count"))
    columns = []
    for name, p in probs.items():
        if name not in inner:
            columns.append(F.max("_all__max" if p > 0 else "_all__min").alias(name))
            continue
        position = F.lit(float(p)) * (F.col("_all_n") - 1)

        def at(place: Column) -> Column:
            inside = (F.col("_q.side") == 0) & (F.col("_first") <= place) & (place < F.col("_upto"))
            value_there = (F.when(inside, F.col("_at")).when((F.col("_q.side") < 0) & (place == F.col("_upto") - 1), F.col("_high"))
                           .when((F.col("_q.side") > 0) & (place == F.col("_first")), F.col("_low")))
            found = F.max(F.when(F.col("_q.of") == list(inner).index(name), value_there))
            return F.coalesce(found.cast("double"), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))

        low, high = at(F.floor(position)), at(F.ceil(position))
        columns.append((low + (high - low) * F.max(position - F.floor(position))).alias(name))
    return counted.groupBy(*keys).agg(*columns, F.max("_all_n").alias("n"))


def digest_cutoffs(df: DataFrame, keys: Sequence[str], digest: str, wanted: Column) -> DataFrame:
    """(keys..., cutoff): the digest at place `wanted` of each group in digest order.

    Keeping `digest <= cutoff` then picks exactly that many rows of the group by a plain filter: no row
    is moved or numbered. `wanted` may use `n`, the group size. Hex digests are uniform, so their first
    digits (as many as the counted rows ask for) are ready-made buckets; only the digests of the one bucket
    that holds the cutoff are ever ordered. Groups for which nothing is wanted have no row.
    """
    bucketed = df.select(*keys, digest, F.substring(digest, 1, hash_digits(df.count())).alias("_hb"))
    counts = bucketed.groupBy(*keys, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_hb").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"n": F.sum("_n").over(group), "_upto": F.sum("_n").over(upto)}).withColumn(
        "_need", wanted.cast("long") - F.col("_upto") + F.col("_n")
    )
    holding = placed.where((F.col("_need") > 0) & (F.col("_need") <= F.col("_n"))).select(*keys, "_hb", "_need")
    inside = Window.partitionBy(*keys, "_hb").orderBy(digest)
    return (
        bucketed.join(holding, [*keys, "_hb"])
        .withColumn("_place", F.row_number().over(inside))
        .where(F.col("_place") == F.col("_need"))
        .select(*keys, F.col(digest).alias("cutoff"))
    )


def value_positions(df: DataFrame, value: str, ties: Sequence[str], out: str = "position") -> DataFrame:
    """Add the 1-based place of every row under the global order (value, ties...).

    Rows are bucketed by value range; a hot value is split further by the digest of its tie columns,
    which is also the order used among equal values.
    """
    digest = F.md5(F.concat_ws(":", *ties))
    rows = cut_lineage(df)
    bucketed = with_value_bucket(rows, [], value, bucket_levels(rows, []), out="_vb").withColumn("_digest", digest)
    # a value that fills a whole bucket is the only one that can be hot: give it digest sub-buckets
    spread = bucketed.withColumn("_sub", F.substring("_digest", 1, hash_digits(rows.count())))
    runs = spread.groupBy("_vb", value, "_sub").agg(F.count(F.lit(1)).alias("_run_n"))
    per_value = runs.groupBy("_vb", value).agg(F.sum("_run_n").alias("_value_n"))
    totals = per_value.groupBy("_vb").agg(F.sum("_value_n").alias("_bucket_n"))
    bucket_offsets = prior_totals(totals, [], "_vb", {"_bucket_offset": F.sum("_bucket_n")})
    inside_bucket = Window.partitionBy("_vb").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    value_offsets = per_value.withColumn("_value_offset", F.sum("_value_n").over(inside_bucket)).drop("_value_n")
    inside_value = Window.partitionBy("_vb", value).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    run_offsets = (
        runs.withColumn("_sub_offset", F.sum("_run_n").over(inside_value))
        .join(value_offsets, ["_vb", value])
        .join(bucket_offsets, "_vb")
        .select(
            "_vb", value, "_sub",
            (F.coalesce("_bucket_offset", F.lit(0)) + F.coalesce("_value_offset", F.lit(0))
             + F.coalesce("_sub_offset", F.lit(0))).alias("_offset"),
        )
    )
    inside = Window.partitionBy("_vb", value, "_sub").orderBy("_digest", *ties)
    return (
        spread.join(run_offsets, ["_vb", value, "_sub"])
        .withColumn(out, F.col("_offset") + F.row_number().over(inside))
        .drop("_vb", "_sub", "_digest", "_offset")
    )
