"""JSON files that hold one large object, read entry by entry by many tasks per file.

A file is read in pieces that end at a closing brace, wherever that stands. Whether a piece begins inside a string is the
parity of the quotes before it, its depth the sum of the braces outside strings before it; both, and the number of entries
ended before it, are running sums: inside the part a task reads, carried on over the few parts of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STRINGS = r'"[^"]*+("|$)'  # once escapes are gone


def placed_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): what stands between the closing braces of JSON files, in order of block and line."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def _with_sum_before(pieces: DataFrame, change: Column, name: str) -> DataFrame:
    """Add `name`: the sum of `change` over all earlier pieces of the file."""
    changed = pieces.withColumn("_change", change)
    parts = changed.groupBy("file", "block").agg(F.sum("_change").alias("_part"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("file", "block", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_start") + F.sum("_change").over(inside) - F.col("_change")
    return changed.join(starts, ["file", "block"]).withColumn(name, total).drop("_change", "_start")


def object_entries(pieces: DataFrame) -> DataFrame:
    """(file, entry, value): the object of each file cut behind every entry that is itself an object; entries of other
    kinds stay with the one after them. Each value is a JSON object; one without entries may end a file."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = pieces.withColumns({"_plain": plain, "_quotes": F.regexp_count(plain, F.lit('"'))})
    known = _with_sum_before(quotes, F.col("_quotes"), "_before")
    outside = F.when(F.col("_before") % 2 == 0, F.col("_plain")).otherwise(F.regexp_replace("_plain", r'^[^"]*+("|$)', ""))
    closes = ((F.col("_before") + F.col("_quotes")) % 2 == 0).cast("int")
    braces = known.withColumns({"_opens": F.regexp_count(F.regexp_replace(outside, STRINGS, ""), F.lit(r"\{")), "_closes": closes})
    deep = _with_sum_before(braces, F.col("_opens") - F.col("_closes"), "_depth")
    after = F.col("_depth") + F.col("_opens") - F.col("_closes")
    ended = deep.withColumn("_ends", F.when(F.col("_closes") == 1, after))
    entries = _with_sum_before(ended, F.coalesce(F.col("_ends").isin(0, 1), F.lit(False)).cast("int"), "entry")
    together = entries.groupBy("file", "entry").agg(
        F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("_pieces"), F.max(F.col("_ends") == 1).alias("_closed"))
    text = F.concat(F.array_join(F.transform("_pieces", lambda p: p["value"]), "}"), F.when(F.col("_closed"), "}").otherwise(""))
    first = F.when(F.col("entry") == 0, F.regexp_replace(text, r"^\s*\{", "")).otherwise(text)
    return together.select("file", "entry", F.concat(F.lit("{"), F.regexp_replace(first, r"^[\s,]+", ""), F.lit("}")).alias("value"))


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(key, entry): the entries of JSON files that each hold one object, the values of it read as `schema`."""
    entries = F.explode(F.from_json("value", f"map<string,{schema}>")).alias("key", "entry")
    return object_entries(placed_pieces(spark, path)).select(entries)
