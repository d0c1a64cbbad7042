"""Early stopping on loss curves.

Curves carry a `slot` column that respects the epoch order (a day, or a block of epochs). Running
values are accumulated over slots first and inside a slot second, so one very long curve is spread
over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipescope.operators.ordering import prior_totals


def with_slots(curves: DataFrame, epochs_per_slot: int = 1000) -> DataFrame:
    return curves.withColumn("slot", F.floor((F.col("epoch") + 1) / epochs_per_slot))


def running_best(curves: DataFrame) -> DataFrame:
    """Add `best_before`, `improved` (strictly below every earlier loss) and `last_improved` (epoch)."""
    keys, place = ["run_id", "slot"], Window.partitionBy("run_id", "slot").orderBy("epoch")
    earlier = place.rowsBetween(Window.unboundedPreceding, -1)
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    minima = curves.groupBy(*keys).agg(F.min("val_loss").alias("_min"))
    before = prior_totals(minima, ["run_id"], "slot", {"_prior": F.min("_min")})
    marked = (
        curves.join(before, keys)
        .withColumn("best_before", F.least("_prior", F.min("val_loss").over(earlier)))
        .withColumn("improved", F.col("best_before").isNull() | (F.col("val_loss") < F.col("best_before")))
        .drop("_prior")
    )
    improved_epoch = F.when(F.col("improved"), F.col("epoch"))
    lasts = marked.groupBy(*keys).agg(F.max(improved_epoch).alias("_last"))
    before = prior_totals(lasts, ["run_id"], "slot", {"_prior": F.max("_last")})
    return marked.join(before, keys).withColumn(
        "last_improved", F.greatest("_prior", F.max(improved_epoch).over(upto))
    ).drop("_prior")


def stopping_states(curves: DataFrame, patience: int) -> DataFrame:
    """One row per (run, slot): what early stopping needs to know of a slot, whatever came before it.

    A record is a loss strictly below all earlier ones of the slot. What came before decides only which of the records
    of the first `patience` epochs is the first improvement (if none of them is, patience ends first); from there on
    improvements are the slot's own records. So a state holds `opening` (the epochs of that stretch) and `heads` (its
    records), at most `patience` of each; `beyond`, the first epoch after it; `stop`, the first epoch at which the slot's
    own records run out of patience, with the record before it; and the last record. The rows of a slot are read in
    order, never collected.
    """
    place = Window.partitionBy("run_id", "slot").orderBy("epoch")
    upto = place.rowsBetween(Window.unboundedPreceding, 0)
    best = F.min("val_loss").over(place.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min("epoch").over(upto)
    marked = curves.select("run_id", "slot", "epoch", "val_loss", first.alias("_first"), (best.isNull() | (F.col("val_loss") < best)).alias("_record"))
    record = F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("val_loss").cast("double").alias("loss"))
    placed = marked.withColumn("_record_here", F.when(F.col("_record"), record)).withColumn(
        "_last", F.last("_record_here", ignorenulls=True).over(upto))
    early = F.col("epoch") < F.col("_first") + patience
    out = F.col("epoch") - F.col("_last.epoch") >= patience
    return placed.groupBy("run_id", "slot").agg(
        F.min("epoch").cast("long").alias("first"), F.max("epoch").cast("long").alias("last"),
        F.sort_array(F.collect_list(F.when(early, F.col("epoch").cast("long")))).alias("opening"),
        F.sort_array(F.collect_list(F.when(early, F.col("_record_here")))).alias("heads"),
        F.min(F.when(~early, F.col("epoch").cast("long"))).alias("beyond"),
        F.min(F.when(out, F.struct(F.col("epoch").cast("long").alias("at"), F.col("_last").alias("record")))).alias("stop"),
        F.max("_record_here").alias("record"),
    )


def _merge(patience: int):
    """The state of a run after one more slot: (best, at, stop)."""
    def merged(run, slot):
        limit = run["at"] + patience
        due = F.when(limit <= slot["first"], slot["first"]).otherwise(
            F.coalesce(F.get(F.filter(slot["opening"], lambda e: e >= limit), 0), slot["beyond"]))
        better = F.get(F.filter(slot["heads"], lambda h: run["best"].isNull() | (h["loss"] < run["best"])), 0)

        def state(best, at, stop):
            return F.struct(best.alias("best"), at.alias("at"), stop.alias("stop"))

        none = F.lit(None).cast("long")
        return (
            F.when(run["stop"].isNotNull(), run)
            .when(due.isNotNull() & (better.isNull() | (due < better["epoch"])), state(run["best"], run["at"], due))
            .when(better.isNull(), run)
            .when(slot["stop"].isNotNull(), state(slot["stop"]["record"]["loss"], slot["stop"]["record"]["epoch"], slot["stop"]["at"]))
            .otherwise(state(slot["record"]["loss"], slot["record"]["epoch"], none))
        )

    return merged


def early_stop(curves: DataFrame, patience: int) -> DataFrame:
    """Per run: where training stops and the best loss so far.

    Stops at the first epoch that is `patience` epochs past the last improvement; the initial loss
    (epoch -1) is the first best. `reason` is `patience` or `end`. The curves are shuffled once, by run and slot; the
    states of the slots, of bounded size, then meet by run and are merged in their order.
    """
    kind = curves.schema["epoch"].dataType
    slots = stopping_states(curves, patience)
    runs = slots.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "first", "opening", "heads", "beyond", "stop", "record"))).alias("_slots"),
        F.max("last").alias("_end"))
    begin = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("stop"))
    folded = runs.withColumn("_run", F.aggregate("_slots", begin, _merge(patience)))
    return folded.select(
        "run_id", F.coalesce("_run.stop", "_end").cast(kind).alias("stop_epoch"),
        F.when(F.col("_run.stop").isNotNull(), "patience").otherwise("end").alias("reason"),
        F.col("_run.best").alias("best_loss"), F.col("_run.at").cast(kind).alias("best_epoch"))


def time_limit_stop(curves: DataFrame, limit: float, time: str = "epoch_time") -> DataFrame:
    """Per run: the first epoch at which the time used exceeds the limit (NULL when it never does)."""
    keys = ["run_id", "slot"]
    totals = curves.groupBy(*keys).agg(F.sum(time).alias("_t"))
    before = prior_totals(totals, ["run_id"], "slot", {"_prior": F.sum("_t")})
    place = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    used = F.coalesce("_prior", F.lit(0.0)) + F.sum(time).over(place)
    return curves.join(before, keys).withColumn("_used", used).groupBy("run_id").agg(
        F.min(F.when(F.col("_used") > limit, F.col("epoch"))).alias("stop_epoch")
    )
