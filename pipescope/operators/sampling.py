"""Exact-size, reproducible splits and samples that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipescope.operators.ordering import digest_cutoffs

TEST_SEED = 1


def digest(seed: int, key: str = "doc_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def at_most(cutoffs: DataFrame, column: str) -> Column:
    """Rows up to the single cutoff (none when there is no cutoff)."""
    return F.coalesce(F.col(column) <= cutoffs.select(F.max("cutoff")).scalar(), F.lit(False))


def split_corpus(
    df: DataFrame, seed: int, key: str = "doc_id", test_share: float = 0.2, val_share: float = 0.25,
    test_seed: int = TEST_SEED,
) -> DataFrame:
    """Add `split`. The test part depends only on `test_seed`; val is a share of the rest by `seed`.

    The two cutoffs come from the keys alone; the corpus itself is only filtered, never shuffled.
    """
    keys = df.select(key).withColumns({"_t": digest(test_seed, key), "_v": digest(seed, key)})
    test_cut = digest_cutoffs(keys, [], "_t", F.ceil(F.col("n") * test_share))
    rest = keys.where(~at_most(test_cut, "_t"))
    val_cut = digest_cutoffs(rest, [], "_v", F.ceil(F.col("n") * val_share))
    marked = df.withColumns({"_t": digest(test_seed, key), "_v": digest(seed, key)})
    split = F.when(at_most(test_cut, "_t"), "test").when(at_most(val_cut, "_v"), "val").otherwise("train")
    return marked.withColumn("split", split).drop("_t", "_v")


def split_train_val(df: DataFrame, seed: int, key: str = "doc_id", val_share: float = 0.25) -> DataFrame:
    """Split rows that come with their own test file: only train and val are drawn."""
    keyed = df.withColumn("_v", digest(seed, key))
    cut = digest_cutoffs(keyed.select("_v"), [], "_v", F.ceil(F.col("n") * val_share))
    return keyed.withColumn("split", F.when(at_most(cut, "_v"), "val").otherwise("train")).drop("_v")


def downsample_train(df: DataFrame, share: float, seed: int = TEST_SEED, key: str = "doc_id") -> DataFrame:
    """Keep floor(share * n) train rows without replacement; other splits stay whole."""
    keyed = df.withColumn("_d", digest(seed, key))
    train = keyed.where(F.col("split") == "train").select("_d")
    cut = digest_cutoffs(train, [], "_d", F.floor(F.col("n") * share))
    return keyed.where((F.col("split") != "train") | at_most(cut, "_d")).drop("_d")


def sample_rows(df: DataFrame, k: int, seed: int, key: str = "doc_id") -> DataFrame:
    """k rows chosen by digest order (a distributed top-k)."""
    return df.withColumn("_d", digest(seed, key)).orderBy("_d").limit(k).drop("_d")
