"""Mixing sources to target weights by exact token budgets.

Every document gets a hash-random key. Within a source the key order is cut into ranges (leading digits of
the key), documents are ordered inside their range, and prefix sums of sizes are put together from the
totals of the ranges before it: no task ever holds a source. Rows that agree in id and size are one row with a
count meanwhile, so an id that a third of the rows carry (or none) is as many rows of its range as it has sizes.
A source's budget takes whole epochs while it lasts and then the documents at the front of the key order, the
last one up to the exact word.

Defined cases: a null text has size 0; null is a source of its own and comes last; rows with the same id
are ordered by size, and rows that agree in both are interchangeable; an empty table gives no rows; only the
named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipescope.llm.common import word_array, written
from pipescope.session import cut_lineage

ROWS_PER_RANGE = 4096
COPIES = 4096
SEED = 17


def order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")))


def numbered_sources(sources: DataFrame) -> DataFrame:
    """Add `place`, the 0-based place of each source by code point, null last.

    The ranges of the sort are written first; a place is the rows of earlier ranges plus the place inside.
    """
    ranged = cut_lineage(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(F.col("source").asc_nulls_last())
    return ranged.join(offsets, "_range").withColumn(
        "place", F.col("_offset") + F.row_number().over(inside) - 1).drop("_range", "_offset")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs).

    Weights repeat along the places. What a source cannot take beyond `most` times its size is shared
    among the others by weight, until none is above. Every round of that is one small aggregation.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighted = cut_lineage(numbered_sources(sources).withColumn("weight", weight)
                           .withColumn("cap", F.lit(most) * F.col("source_size")))
    total = share * (weighted.agg(F.sum("source_size")).first()[0] or 0)
    per_weight, full = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(per_weight) > F.col("cap")
        row = weighted.agg(
            F.count(F.when(above, 1)).alias("full"), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)).alias("taken"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, per_weight = row["full"], (total - row["taken"]) / row["open"]
    return weighted.select("source", "source_size", "n_docs",
                           F.least("cap", F.col("weight") * F.lit(per_weight)).alias("target"))


def _ordered(docs: DataFrame, doc_id: str, text: str, source: str, weights: Sequence[float], share: float, most: float,
             seed: int) -> DataFrame:
    """Rows that agree in source, id and size as one with their number `n`, with their source's size, target, whole
    epochs and rest, and `prior`, the words before the first of them in key order."""
    sized = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                F.size(word_array(F.col(text))).cast("long").alias("size"))
                    .groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    per_source = targets(
        sized.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")),
        weights, share, most)
    budget = F.floor("target")
    per_source = cut_lineage(
        per_source.withColumn("digits", F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n_docs") / ROWS_PER_RANGE))).cast("int"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_of"))
    placed = (
        sized.join(per_source, F.col("source").eqNullSafe(F.col("_of"))).drop("_of", "n_docs")
        .withColumn("_key", order_key(F.col("doc_id"), seed)).withColumn("_range", F.expr("substring(_key, 1, digits)"))
    )
    words = F.sum(F.col("n") * F.col("size"))
    totals = placed.groupBy("source", "_range").agg(words.alias("_size"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("_of"), F.col("_range").alias("_at"),
                            F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    return written(
        placed.withColumn("_inside", F.coalesce(words.over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at")))
        .withColumn("prior", F.col("_offset") + F.col("_inside")).drop("_of", "_at", "_offset", "_inside", "_range", "digits"), "mix")


def _single(groups: DataFrame) -> DataFrame:
    """Each of the `n` copies of a row, with its own `prior`; many copies are made by many tasks."""
    def copies(df: DataFrame, first: Column, last: Column) -> DataFrame:
        return df.withColumn("_copy", F.explode(F.sequence(first, last))).withColumn("prior", F.col("prior") + F.col("_copy") * F.col("size"))

    few = copies(groups.where(F.col("n") <= COPIES), F.lit(0).cast("long"), F.col("n") - 1)
    pieces = groups.where(F.col("n") > COPIES).withColumn(
        "_first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    spread = pieces.repartition("source", "doc_id", "size", "_first")
    many = copies(spread, F.col("_first"), F.least(F.col("n"), F.col("_first") + COPIES) - 1)
    return few.unionByName(many.drop("_first"))


def _part(size: Column, rest: Column, prior: Column) -> Column:
    return F.greatest(F.lit(0), F.least(size, rest - prior))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, prior, taken), one row per row of `docs`.

    `prior` is the number of words of the source before the document in key order, `taken` the words the
    mix takes of it, repeats counted.
    """
    ordered = _single(_ordered(docs, doc_id, text, source, weights, share, most, seed))
    taken = F.col("epochs") * F.col("size") + _part(F.col("size"), F.col("rest"), F.col("prior"))
    return ordered.select("doc_id", "source", "size", "source_size", "target", "prior", taken.cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """The rows of the mix with all columns of `docs`: a row per epoch, and what the last epoch takes.

    Texts are not moved: a row is in the last epoch if it comes before its source's cut in key order, which is
    one row per source. The document at the cut goes up to its word (words then parted by one space); rows that
    agree with it in id and size share its words evenly. Rows without words are not in the mix.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = {role: f"_c{names.index(name)}" for role, name in (("doc", doc_id), ("text", text), ("source", source))}
    ordered = _ordered(numbered, at["doc"], at["text"], at["source"], weights, share, most, seed)
    inside = (F.col("prior") < F.col("rest")) & (F.col("rest") <= F.col("prior") + F.col("n") * F.col("size"))
    cuts = ordered.where(inside).select(
        F.col("source").alias("_of"), F.col("_key").alias("_cut_key"), F.col("doc_id").alias("_cut_doc"),
        F.col("size").alias("_cut_size"), F.floor((F.col("rest") - F.col("prior")) / F.col("n")).alias("_cut_part"))
    epochs = ordered.select("source", "epochs").distinct()
    per_source = cut_lineage(epochs.join(cuts, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of"))

    words = word_array(F.col(at["text"]))
    rows = numbered.withColumns({"_size": F.size(words).cast("long"), "_key": order_key(F.col(at["doc"]), seed)}).where("_size > 0")
    rows = rows.join(per_source, F.col(at["source"]).eqNullSafe(F.col("source")))
    # the order of the cut: key, id (null first), size
    before = F.struct("_key", F.col(at["doc"]).alias("d"), "_size") < F.struct("_cut_key", F.col("_cut_doc").alias("d"), F.col("_cut_size").alias("_size"))
    same = (F.col("_key") == F.col("_cut_key")) & F.col(at["doc"]).eqNullSafe(F.col("_cut_doc")) & (F.col("_size") == F.col("_cut_size"))
    part = F.when(F.col("_cut_key").isNull(), 0).when(same, F.col("_cut_part")).when(before, F.col("_size")).otherwise(0).cast("long")
    whole = F.when(F.col("epochs") > 0, F.array_repeat(F.col("_size"), F.col("epochs").cast("int"))).otherwise(F.array().cast("array<long>"))
    copies = rows.withColumn("_take", F.explode(F.filter(F.concat(whole, F.array(part)), lambda n: n > 0)))
    body = F.when(F.col("_take") == F.col("_size"), F.col(at["text"])).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("_take").cast("int")), " "))
    return copies.select(*[(body if f"_c{i}" == at["text"] else F.col(f"_c{i}")).alias(n) for i, n in enumerate(names)])
