"""Experiment configurations and their log: grids, validity, what to run next, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipescope.functions.scalar import canonical_path, config_hash, result_path

# Which features and models can be trained end to end, and tokeniser needs of features.
FINETUNABLE_FEATURISERS = ["bert_cls", "bert_mean"]
FINETUNABLE_MODELS = ["relu_mlp", "resnet", "shallow_mlp", "no_activation_mlp"]
GLOVE_TOKENISERS = ["whitespace", "stanford"]
# Components in registry order.
COMPONENTS = {
    "preprocessers": ["stem", "lemmatize", "lowercase", "no_punctuation", "no_stopwords_spacy", "no_stopwords_nltk"],
    "tokenisers": ["whitespace", "bpe", "bert", "stanford", "treebank"],
    "featurisers": ["bow_count", "bow_binary", "tf_idf", "bert_cls", "bert_mean", "glove_mean"],
    "models": ["linear_regression", "relu_mlp", "no_activation_mlp", "resnet", "catboost", "xgboost"],
}
CONFLICTS = [
    ("stem", "lemmatize"), ("no_numbers_simple", "no_numbers_spacy"), ("no_stopwords_spacy", "no_stopwords_nltk"),
]
MANDATORY = ["tokeniser", "featuriser", "model", "preprocessers"]
CONFIG_FIELDS = ["preprocessers", "tokeniser", "featuriser", "model", "finetune"]
MAX_POWER_SET = 20


def invalid_reason() -> Column:
    """NULL for a configuration that can run, otherwise why it cannot."""
    steps, featuriser, tokeniser = F.col("preprocessers"), F.col("featuriser"), F.col("tokeniser")
    both = F.array_contains(steps, "stem") & F.array_contains(steps, "lemmatize")
    bert = featuriser.isin(FINETUNABLE_FEATURISERS)
    tunable = bert & F.col("model").isin(FINETUNABLE_MODELS)
    return (
        F.when(both, "stem and lemmatize together")
        .when(bert & (tokeniser != "bert"), "BERT features need BERT tokens")
        .when((featuriser == "glove_mean") & ~tokeniser.isin(GLOVE_TOKENISERS), "GloVe needs plain word tokens")
        .when(F.coalesce("finetune", F.lit(False)) & ~tunable, "not finetunable")
    )


def missing_key_reason() -> Column:
    """NULL when every mandatory key is present, otherwise the missing ones."""
    missing = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in MANDATORY]))
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))


def check_configs(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add `reason`; with `strict` a bad configuration stops the job instead of being marked."""
    reason = F.coalesce(missing_key_reason(), invalid_reason())
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(reason).cast("string"))
    return df.withColumn("reason", reason)


def component_lists(spark: SparkSession, components: Mapping[str, Sequence[str]] = COMPONENTS) -> DataFrame:
    """The registry as one row of name lists."""
    return spark.range(1).select(*[
        F.array(*[F.lit(n) for n in names]).cast("array<string>").alias(kind) for kind, names in components.items()
    ])


def observed_components(results: DataFrame) -> DataFrame:
    """The component names that occur in a results table, as one row of sorted lists."""
    names = F.array_remove("preprocessers", "empty")
    steps = results.select(F.explode_outer(names).alias("step")).agg(
        F.array_sort(F.collect_set("step")).alias("preprocessers")
    )
    others = results.agg(*[
        F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("tokeniser", "featuriser", "model")
    ])
    return others.withColumn("preprocessers", steps.scalar())


def pick_by_mask(names: Column | str, mask: Column | str) -> Column:
    """The names whose bit is set in the mask, in list order."""
    bits = F.col(mask) if isinstance(mask, str) else mask
    chosen = F.transform(names, lambda name, i: F.when(F.getbit(bits, i) == 1, name))
    return F.array_compact(chosen)


def _named_lists(lists: DataFrame, columns: list[str]) -> list[list[str]]:
    """The lists of component names: one short row, which every form of the grid starts from."""
    row = lists.select(*columns).first()
    return [list(row[c]) for c in columns]


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def power_set(lists: DataFrame, column: str = "preprocessers", limit: int = MAX_POWER_SET) -> DataFrame:
    """Every subset of the list in `column`: (mask, subset_size, subset), smaller subsets first."""
    (names,) = _named_lists(lists, [column])
    if len(names) > limit:
        raise ValueError(f"too many names for all subsets: {len(names)}, at most {limit}")
    masks = lists.sparkSession.range(1 << len(names)).select(F.col("id").alias("mask"))
    return (
        masks.withColumn("subset", pick_by_mask(_names(names), "mask"))
        .withColumn("subset_size", F.bit_count("mask"))
        .orderBy("subset_size", "subset")
    )


def grid(lists: DataFrame, seed: int, include_preprocessers: bool = True, valid_only: bool = True) -> DataFrame:
    """All configurations of the listed components with their reason, hash and place `ord`.

    A configuration is a number of a range, which Spark deals over tasks; its digits choose the components.
    `ord` sorts like nested loops over finetune, model, featuriser, tokeniser, subset.
    """
    steps, models, featurisers, tokenisers = _named_lists(lists, ["preprocessers", "models", "featurisers", "tokenisers"])
    chosen = len(steps) if include_preprocessers else 0
    total = 2 * len(models) * len(featurisers) * len(tokenisers) << chosen
    if total >= 1 << 62:
        raise ValueError(f"a grid over {chosen} steps is too large to be numbered")
    sizes = [("_mask", 1 << chosen), ("_t", len(tokenisers)), ("_x", len(featurisers)), ("_m", len(models)), ("_f", 2)]
    digits, below = [], 1
    for name, size in sizes:
        kind = "bigint" if name == "_mask" else "int"
        digits.append(f"cast((id div {below}) % {max(size, 1)} as {kind}) as {name}")
        below *= max(size, 1)
    out = lists.sparkSession.range(total).selectExpr(*digits)
    places = F.array(*[F.lit(i) for i in range(len(steps))]).cast("array<int>")
    out = out.select(
        F.struct("_f", "_m", "_x", "_t", F.bit_count("_mask").alias("_size"),
                 pick_by_mask(places, F.col("_mask")).alias("_subset")).alias("ord"),
        pick_by_mask(_names(steps), "_mask").alias("preprocessers"),
        F.get(_names(tokenisers), F.col("_t")).alias("tokeniser"), F.get(_names(featurisers), F.col("_x")).alias("featuriser"),
        F.get(_names(models), F.col("_m")).alias("model"), (F.col("_f") == 1).alias("finetune"), F.lit(seed).alias("seed"),
    )
    out = out.withColumn("reason", invalid_reason())
    if valid_only:
        out = out.where(F.col("reason").isNull()).drop("reason")
    return out.withColumn("hash", config_hash())


def draw(seed: int, attempt: Column | str, field: Column | str, n: Column | int) -> Column:
    """A reproducible whole number below n for one field of one attempt."""
    name = F.lit(field) if isinstance(field, str) else field
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(attempt).cast("string")
                               if isinstance(attempt, str) else attempt, name))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")


def random_configs(
    attempts: DataFrame, lists: DataFrame, rng_seed: int, exp_seed: int, include_preprocessers: bool = True,
    attempt: str = "attempt",
) -> DataFrame:
    """One random valid configuration per attempt number, repeats removed (the earliest attempt stays).

    Every field is drawn from a digest of (seed, attempt, field), so any partitioning gives the same
    rows and no generator state is carried from one attempt to the next.
    """
    def pick(names: Column | str, field: str) -> Column:
        column = F.col(names) if isinstance(names, str) else names
        return F.element_at(column, draw(rng_seed, attempt, field, F.size(column)) + 1)

    described = attempts.select(attempt).withColumn("_lists", lists.select(F.struct("*")).scalar()).select(
        attempt, "_lists.*"
    )
    tagged = F.transform("preprocessers", lambda name: F.concat(
        F.md5(F.concat_ws(":", F.lit(str(rng_seed)), F.col(attempt).cast("string"), F.lit("shuffle"), name)), name))
    length = draw(rng_seed, attempt, "length", F.size("preprocessers") + 1)
    chosen = F.transform(F.slice(F.array_sort(tagged), F.lit(1), length), lambda t: F.substring(t, F.lit(33), F.length(t)))
    steps = chosen if include_preprocessers else F.array().cast("array<string>")
    for i, (first, second) in enumerate(CONFLICTS):
        both = F.array_contains(steps, first) & F.array_contains(steps, second)
        loser = F.when(draw(rng_seed, attempt, f"conflict{i}", 2) == 0, first).otherwise(second)
        steps = F.when(both, F.array_remove(steps, loser)).otherwise(steps)
    word_tokens = F.array(*[F.lit(t) for t in GLOVE_TOKENISERS])
    out = described.withColumns({
        "featuriser": pick("featurisers", "featuriser"), "model": pick("models", "model"),
        "_any_tokeniser": pick("tokenisers", "tokeniser"), "_word_tokeniser": pick(word_tokens, "tokeniser"),
        "_coin": draw(rng_seed, attempt, "finetune", 2) == 1, "preprocessers": F.array_sort(steps),
    })
    tunable = F.col("featuriser").isin(FINETUNABLE_FEATURISERS) & F.col("model").isin(FINETUNABLE_MODELS)
    out = out.select(
        attempt, "preprocessers",
        F.when(F.col("featuriser").isin(FINETUNABLE_FEATURISERS), "bert")
        .when(F.col("featuriser") == "glove_mean", F.col("_word_tokeniser"))
        .otherwise(F.col("_any_tokeniser")).alias("tokeniser"),
        "featuriser", "model", (tunable & F.col("_coin")).alias("finetune"), F.lit(exp_seed).alias("seed"),
    ).withColumn("hash", config_hash())
    fields = ["preprocessers", "tokeniser", "featuriser", "model", "finetune", "seed"]
    # equal hashes are equal configurations, so the earliest attempt number is all that must be kept
    return out.groupBy("hash", *fields).agg(F.min(attempt).alias(attempt))


def available(df: DataFrame, lists: DataFrame, steps: str = "preprocessers") -> DataFrame:
    """Configurations that use only available components."""
    row = lists.select(F.struct("*")).scalar()
    checked = df.withColumn("_have", row)
    fits = F.forall(steps, lambda s: F.array_contains("_have.preprocessers", s) | (s == "empty"))
    for one, many in (("tokeniser", "tokenisers"), ("featuriser", "featurisers"), ("model", "models")):
        fits = fits & F.array_contains(F.col(f"_have.{many}"), F.col(one))
    return checked.where(fits).drop("_have")


def resample(log: DataFrame, old_seed: int, new_seed: int, lists: DataFrame) -> DataFrame:
    """The distinct available configurations of one seed, to be run under another."""
    if old_seed == new_seed:
        raise ValueError("the new seed must differ from the seed to replicate")
    kept = available(log.where(F.col("seed") == old_seed), lists)
    return kept.select(*CONFIG_FIELDS).distinct().withColumn("seed", F.lit(new_seed))


def in_registry_order(names: Column | str, registry: Sequence[str]) -> Column:
    """The requested names in registry order; an error when none of them is known."""
    wanted = F.col(names) if isinstance(names, str) else names
    known = F.filter(F.array(*[F.lit(n) for n in registry]), lambda n: F.array_contains(wanted, n))
    return F.when((F.size(known) == 0) & (F.size(wanted) > 0),
                  F.raise_error(F.lit("no known component requested")).cast("array<string>")).otherwise(known)


def logged_hashes(log: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Hashes that count as done: every logged one, or only the successful ones."""
    done = log.where(F.col("status") == "success") if retry_failed else log
    return done.select("hash")


def unseen(candidates: DataFrame, log: DataFrame, retry_failed: bool = False) -> DataFrame:
    return candidates.join(logged_hashes(log, retry_failed), "hash", "left_anti")


def next_unseen(candidates: DataFrame, log: DataFrame, skip: int = 0, n: int = 1,
                retry_failed: bool = False) -> DataFrame:
    return unseen(candidates, log, retry_failed).orderBy("ord").offset(skip).limit(n)


def attempts_before_unseen(candidates: DataFrame, log: DataFrame, max_attempts: int = 100_000) -> DataFrame:
    """How many done candidates come before the first open one; an error beyond `max_attempts`."""
    first = unseen(candidates, log).agg(F.min("ord").alias("first"))
    done = candidates.join(logged_hashes(log), "hash", "left_semi")
    counted = done.withColumn("_first", first.scalar()).agg(
        F.count_if(F.col("_first").isNull() | (F.col("ord") < F.col("_first"))).alias("attempts")
    )
    over = F.raise_error(F.lit("maximum number of attempts reached")).cast("long")
    return counted.select(F.when(F.col("attempts") > max_attempts, over).otherwise(F.col("attempts")).alias("attempts"))


def hashed_log(log: DataFrame, default_seed: int = 97) -> DataFrame:
    """Re-key a log: defaults first, sorted steps, then the hash; the last of colliding entries wins."""
    ready = log.withColumns({
        "seed": F.coalesce("seed", F.lit(default_seed)), "finetune": F.coalesce("finetune", F.lit(False)),
        "preprocessers": F.array_sort("preprocessers"),
    })
    return ready.withColumn("hash", config_hash())


def latest_state(events: DataFrame, key: str = "hash", order: Sequence[str] = ("event_ts", "event_id")) -> DataFrame:
    """The last event per key. `max_by` keeps one row per key and task, so a key with very many events
    (a retried configuration) is reduced before anything is shuffled."""
    rest = [c for c in events.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return events.groupBy(key).agg(newest).select(key, "_row.*")


def reconcile(log: DataFrame, results: DataFrame) -> DataFrame:
    """Full comparison by hash: `side` is shared, log_only or results_only.

    Shared rows take status and error from the log; a result without log entry counts as a success.
    """
    fields = [*CONFIG_FIELDS, "seed"]
    logged = log.select("hash", *[F.col(f).alias(f"_l_{f}") for f in fields], "status", "error",
                        F.lit(True).alias("_in_log"))
    found = results.select("hash", *[F.col(f).alias(f"_r_{f}") for f in fields], F.lit(True).alias("_in_results"))
    joined = logged.join(found, "hash", "full_outer")
    side = (
        F.when(F.col("_in_log").isNull(), "results_only").when(F.col("_in_results").isNull(), "log_only")
        .otherwise("shared")
    )
    return joined.select(
        "hash", side.alias("side"), *[F.coalesce(f"_r_{f}", f"_l_{f}").alias(f) for f in fields],
        F.coalesce("status", F.lit("success")).alias("status"), "error",
    )


def log_with_paths(log: DataFrame, files: DataFrame, root: str = "results") -> DataFrame:
    """Attach the result file of each log entry through the canonical path; unmatched entries stay."""
    expected_path = canonical_path(result_path(root, "preprocessers", "tokeniser", "featuriser", "model", "seed",
                                               "finetune"))
    known = files.select(canonical_path("path").alias("canonical"), F.col("path").alias("file"))
    return log.withColumn("canonical", expected_path).join(known, "canonical", "left").withColumn(
        "matched", F.col("file").isNotNull()
    )


def pattern_mask(patterns: Mapping[str, Sequence[str] | None]) -> Column:
    """AND over the dimensions, OR inside one; an unset dimension accepts everything."""
    mask = F.lit(True)
    for column, names in patterns.items():
        if not names:
            continue
        if column == "preprocessers":
            hit = F.arrays_overlap(column, F.array(*[F.lit(n) for n in names]))
        else:
            hit = F.col(column).isin(list(names))
        mask = mask & F.coalesce(hit, F.lit(False))
    return mask


def clear_by_pattern(log: DataFrame, patterns: Mapping[str, Sequence[str] | None]) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) log entries."""
    mask = pattern_mask(patterns)
    return log.where(~mask), log.where(mask)


def split_by_status(log: DataFrame, status: str = "failed") -> tuple[DataFrame, DataFrame]:
    return log.where(F.col("status") != status), log.where(F.col("status") == status)


def status_counts(log: DataFrame, status: str) -> DataFrame:
    """Entries of one status for every seed, zero included."""
    return log.groupBy("seed").agg(F.count_if(F.col("status") == status).alias("n"))


def config_columns() -> list[Column]:
    return [F.array_join("preprocessers", ",").alias("steps"), F.col("tokeniser"), F.col("featuriser"),
            F.col("model"), F.coalesce("finetune", F.lit(False)).alias("finetune")]


def duplicate_groups(log: DataFrame) -> DataFrame:
    """Configurations logged more than once (seed aside): how often, and under which seeds."""
    return (
        log.groupBy(*config_columns())
        .agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("seed")).alias("seeds"))
        .where("n > 1")
    )


def duplicate_members(log: DataFrame) -> DataFrame:
    """The entries of all duplicate groups, one row each (never a list per group)."""
    keyed = log.select("*", config_columns()[0])
    groups = duplicate_groups(log).select("steps", "tokeniser", "featuriser", "model", "finetune", "n")
    return keyed.withColumn("finetune", F.coalesce("finetune", F.lit(False))).join(
        groups, ["steps", "tokeniser", "featuriser", "model", "finetune"]
    )


def without_seed_set(log: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """The log without duplicate groups whose set of seeds is exactly the given one."""
    wanted = F.array(*[F.lit(s) for s in sorted(set(seeds))])
    doomed = duplicate_groups(log).where(F.col("seeds") == wanted).drop("n", "seeds")
    keyed = log.select("*", config_columns()[0]).withColumn("finetune", F.coalesce("finetune", F.lit(False)))
    return keyed.join(doomed, ["steps", "tokeniser", "featuriser", "model", "finetune"], "left_anti").drop("steps")


