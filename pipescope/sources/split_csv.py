"""Quoted CSV whose fields hold line breaks, read by many tasks per file.

A line break ends a record only outside quotes, and whether a line begins inside quotes depends on everything before it.
Each line is therefore seen as a function from the state before it (outside, inside) to the state after it. There are
four: stay, flip, and the two that end in one state whatever was before. Functions of consecutive lines compose to such
a function again, so a first pass gives one per block of a file, the few blocks of a file are followed in order, and
inside a block the state of a line is that of the last line with a fixed end, flipped as often as lines flip since. The
lines of a record then meet by the number of records begun before it in its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITED = r'(^|,)"[^"]*+"(?=,|\r?$)'  # a whole quoted field, once doubled quotes are gone
OPENS = r'(^|,)"'


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value): the lines of text files; `block` is the start of the part a task reads, `line` orders
    the lines of a block."""
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line"), "value")


def _opens(text: Column) -> Column:
    """Whether a quoted field that begins in `text`, read from outside quotes, goes on in the next line."""
    return F.regexp_replace(text, DELIMITED, "$1").rlike(OPENS)


def _with_functions(lines: DataFrame) -> DataFrame:
    """Add `from_outside` and `from_inside`: whether the next line begins inside quotes."""
    plain = F.replace(F.col("value"), F.lit('""'), F.lit(""))
    closed = F.regexp_replace("_plain", r'^[^"]*+"', "")
    return lines.withColumn("_plain", plain).withColumns({
        "from_outside": _opens(F.col("_plain")),
        # the field that closes here is over; what follows it is read from outside, behind a delimiter
        "from_inside": ~F.contains("_plain", F.lit('"')) | _opens(F.concat(F.lit("x"), closed)),
    }).drop("_plain")


def _states(lines: DataFrame) -> DataFrame:
    """Add `_fixed` (the state after the last earlier line of the block with a fixed end, unflipped; null if none) and
    `_flips` (lines before this one in the block that flip the state)."""
    place = Window.partitionBy("file", "block").orderBy("line")
    earlier = place.rowsBetween(Window.unboundedPreceding, -1)
    flips = F.when(F.col("from_outside") & ~F.col("from_inside"), 1).otherwise(0)
    upto = F.sum(flips).over(place.rowsBetween(Window.unboundedPreceding, 0))
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), (F.col("from_outside").cast("int") + F.col("_upto")) % 2)
    return lines.withColumn("_upto", upto).withColumn("_here", fixed).withColumns({
        "_fixed": F.last("_here", ignorenulls=True).over(earlier), "_flips": F.col("_upto") - flips})


def _inside(start: Column) -> Column:
    """The state (1: inside quotes) at the beginning of a line, if its block begins in `start`."""
    return (F.coalesce("_fixed", start) + F.col("_flips")) % 2


def quoted_records(lines: DataFrame) -> DataFrame:
    """(file, record, value): the records of CSV files from 0 on, with the line breaks inside their fields."""
    states = _states(_with_functions(lines))

    def after(start: int) -> Column:
        return (F.coalesce(F.max_by(F.coalesce("_here", "_fixed"), "line"), F.lit(start)) + F.max("_upto")) % 2

    blocks = states.groupBy("file", "block").agg(
        *[after(s).cast("int").alias(f"_after{s}") for s in (0, 1)],
        *[F.count_if(_inside(F.lit(s)) == 0).alias(f"_begun{s}") for s in (0, 1)])
    # a file has few blocks: their functions are applied one after the other
    listed = blocks.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("block", "_after0", "_after1", "_begun0", "_begun1"))).alias("_blocks"))
    begin = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("records"), F.expr(
        "cast(array() as array<struct<block: bigint, state: int, records: bigint>>)").alias("out"))
    walked = F.aggregate("_blocks", begin, lambda w, b: F.struct(
        F.when(w["state"] == 0, b["_after0"]).otherwise(b["_after1"]).alias("state"),
        (w["records"] + F.when(w["state"] == 0, b["_begun0"]).otherwise(b["_begun1"])).alias("records"),
        F.concat(w["out"], F.array(F.struct(b["block"].alias("block"), w["state"].alias("state"), w["records"].alias("records")))).alias("out")),
        lambda w: w["out"])
    starts = listed.select("file", F.explode(walked).alias("_start")).select(
        "file", F.col("_start.block").alias("block"), F.col("_start.state").alias("_state"), F.col("_start.records").alias("_before"))
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.when(_inside(F.col("_state")) == 0, 1).otherwise(0)
    numbered = states.join(starts, ["file", "block"]).withColumn("_begun", begun).withColumn(
        "record", F.col("_before") + F.sum("_begun").over(upto) - 1)
    together = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: x["value"]), "\n")
    return together.select("file", "record", F.regexp_replace(text, r"\r$", "").alias("value"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of quoted CSV files with a header; quotes inside fields are doubled. Empty lines are left out, empty
    fields are empty strings."""
    records = quoted_records(placed_lines(spark, path)).where((F.col("record") > 0) & (F.col("value") != ""))
    options = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\u0000", "multiLine": "true"}
    return records.select(F.from_csv("value", schema, options).alias("row")).select("row.*")
