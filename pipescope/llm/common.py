"""What the operators of this package share: words, tables, written intermediate results, worker caches."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipescope.session import in_small_batches, scratch_path  # noqa: F401

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage is cut, and the rows survive the loss
    of any executor. The files go when the application ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def giving_back(rows: Iterator) -> Iterator:
    """What a task yields; memory that is free inside the worker goes back to the system when it ends, since the
    worker stays beside the executor while other stages run."""
    yield from rows
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as the Python worker, so that later tasks find what earlier ones put in.

    A worker keeps one such dict: asking for another name drops the last one.
    """
    holder = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if getattr(holder, "name", None) != name:
        holder.name, holder.cache = name, {}
    return holder.cache
