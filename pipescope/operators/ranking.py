"""Method panels, ranks, wins and groups of indistinguishable methods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipescope.operators.ordering import digest_cutoffs
from pipescope.session import cut_lineage


def complete_panel(df: DataFrame) -> DataFrame:
    """(experiment, method, value) rows of experiments in which every method has a value.

    Repeated (experiment, method) rows are averaged first, so an experiment holds one row per method.
    """
    cells = cut_lineage(df.groupBy("experiment", "method").agg(F.avg("value").alias("value")))
    methods = df.agg(F.count_distinct("method").alias("m"))
    full = cells.groupBy("experiment").agg(F.count(F.lit(1)).alias("m"))
    full = full.where(F.col("m") == methods.scalar()).select("experiment")
    return cells.join(full, "experiment", "left_semi")


def method_sizes(df: DataFrame, minimum: int = 3) -> DataFrame:
    """Group size per method, whether it has enough rows, and the smallest and largest kept size."""
    sizes = df.groupBy("method").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.col("n") >= minimum)
    over_kept = F.when(F.col("kept"), F.col("n"))
    whole = Window.partitionBy()  # one row per method
    return sizes.withColumns({
        "smallest": F.min(over_kept).over(whole), "largest": F.max(over_kept).over(whole)
    })


def balanced_panel(
    df: DataFrame, minimum: int = 3, strict: bool = False, jitter_seed: int | None = None
) -> DataFrame:
    """Cut every method to the size of the smallest one, taking experiments in a fixed digest order.

    Methods below `minimum` rows are dropped. `strict` drops methods of exactly the smallest size too
    (an old rule that empties a balanced panel). Optional jitter in [0, 0.1) breaks ties reproducibly.
    `df` is evaluated once: sizes, cutoffs and the rows are taken from what is written of it.
    """
    df = cut_lineage(df.select("experiment", "method", "value"))
    sizes = method_sizes(df, minimum).where("kept")
    if strict:
        sizes = sizes.where(F.col("n") > F.col("smallest"))
    digested = df.join(sizes.select("method", "smallest"), "method").withColumn(
        "_d", F.md5(F.col("experiment").cast("string"))
    )
    cutoffs = digest_cutoffs(digested, ["method", "smallest"], "_d", F.col("smallest")).drop("smallest")
    placed = digested.join(cutoffs, "method")
    out = placed.where(F.col("_d") <= F.col("cutoff")).select("experiment", "method", "value")
    if jitter_seed is not None:
        noise = F.conv(F.substring(F.md5(F.concat_ws(":", "experiment", "method", F.lit(str(jitter_seed)))), 1, 8),
                       16, 10).cast("double") / 4294967296.0 * 0.1
        out = out.withColumn("value", F.col("value") + noise)
    return out


def ranked(panel: DataFrame, ascending: bool = False) -> DataFrame:
    """Rank of each method inside its experiment, ties averaged (an experiment has one row per method)."""
    order = F.col("value").asc() if ascending else F.col("value").desc()
    inside = Window.partitionBy("experiment").orderBy(order)
    tied = Window.partitionBy("experiment", "value")
    rank = F.rank().over(inside) + (F.count(F.lit(1)).over(tied) - 1) / F.lit(2.0)
    return panel.withColumn("rank", rank)


def average_ranks(panel: DataFrame) -> DataFrame:
    return ranked(panel).groupBy("method").agg(F.avg("rank").alias("average_rank")).orderBy(
        F.desc("average_rank"), "method"
    )


def wins(panel: DataFrame) -> DataFrame:
    return ranked(panel).groupBy("method").agg(
        F.sum(F.when(F.col("rank") == 1.0, 1.0).otherwise(0.0)).alias("wins")
    )


def method_pairs(panel: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, experiment, a, b, diff) with a < b, values aligned on the experiment.

    The rows of an experiment (one per method) travel in one aggregation buffer, so pairing needs a
    single shuffle; the output is inherently methods*(methods-1)/2 rows per experiment.
    """
    by_experiment = panel.groupBy(*keys, "experiment").agg(
        F.array_sort(F.collect_list(F.struct("method", "value"))).alias("row")
    )
    pairs = F.expr(
        "flatten(transform(row, (x, i) -> transform(slice(row, i + 2, size(row)), "
        "y -> struct(x.method AS a, y.method AS b, x.value - y.value AS diff))))"
    )
    return by_experiment.select(*keys, "experiment", F.explode(pairs).alias("p")).select(*keys, "experiment", "p.*")


def maximal_cliques(edges: DataFrame, min_size: int = 2) -> DataFrame:
    """Maximal groups of mutually connected methods, as sorted arrays.

    Grows k-cliques to (k+1)-cliques by joining the edge table on the last member, then keeps groups
    that no larger clique contains. `edges` (a, b) is a table of method names, not of data.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ordered = cut_lineage(ordered)
    level = ordered.select(F.array("a", "b").alias("clique"))
    found = None
    size = 2
    while True:
        grown = (
            level.join(ordered, F.element_at("clique", -1) == F.col("a"))
            .select("clique", F.col("b").alias("_new"))
            # every earlier member must know the newcomer as well
            .withColumn("_member", F.explode("clique"))
            .join(ordered.select(F.col("a").alias("_member"), F.col("b").alias("_new")), ["_member", "_new"])
            .groupBy("clique", "_new").agg(F.count(F.lit(1)).alias("_known"))
            .where(F.col("_known") == F.size("clique"))
            .select(F.concat("clique", F.array("_new")).alias("clique"))
        )
        grown = cut_lineage(grown)
        contained = grown.select(
            F.explode(F.transform("clique", lambda x: F.array_remove(F.col("clique"), x))).alias("clique")
        )
        maximal = level.join(contained, "clique", "left_anti")
        if size >= min_size:
            found = maximal if found is None else found.unionByName(maximal)
        if grown.isEmpty():
            break
        level, size = grown, size + 1
    return found.withColumn("size", F.size("clique"))


def minimise(df: DataFrame, metric: str) -> DataFrame:
    return df.withColumn(metric, -F.col(metric))


def named_columns(df: DataFrame, group: str, metric: str, experiment: Sequence[str] | str) -> DataFrame:
    """A performance table with chosen columns as (experiment, method, value)."""
    parts = [experiment] if isinstance(experiment, str) else list(experiment)
    key: Column = F.concat_ws("_", *[F.col(p).cast("string") for p in parts])
    return df.select(key.alias("experiment"), F.col(group).alias("method"), F.col(metric).cast("double").alias("value"))
