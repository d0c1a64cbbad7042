"""Boosted regression trees with a penalty on leaf values, grown level by level from histograms.

For squared error a leaf that holds the rows S is worth -G / (n + penalty), G being the sum of (prediction - label) over
S, and a split gains GL^2 / (nL + penalty) + GR^2 / (nR + penalty) - G^2 / (n + penalty). Features are cut into bins at
quantiles of train once. A level of a tree is one job with one shuffle: tasks add up (G, n) per node, feature and bin of
their rows, the sums meet under node and a few features, and the driver sees the best split of each of these, never rows. The loss on val comes with
the first level of the next tree, so early stopping needs no job of its own.

Binned rows of up to WHOLE_BYTES are read by one task, which grows CUT_EVERY trees in a job: below that, the jobs of the
levels take longer than their sums.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipescope.session import cut_lineage

BINS = 256
CUT_EVERY = 25  # trees after which predictions are written
MAX_WIDTH = 1024  # features; a task holds sums of nodes x features x bins
PART_BYTES = 1 << 21  # of binned rows a task reads
WHOLE_BYTES = 1 << 25  # of binned rows that one task fits by itself
ROW_BYTES = 32  # of label, slope and node beside a row's bins; narrower rows count as so wide
PART_CELLS = 1 << 18  # of sums a task compares
FEATURES_PER_SUM = 16  # whose sums of a node travel together
LOSS = -1  # "node" of the loss on val


@dataclass
class Tree:
    """A tree in level order: the children of node i are 2i + 1 (value <= threshold) and 2i + 2."""

    feature: np.ndarray  # -1 at leaves
    bin: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.full(n, np.nan), np.zeros(n))

    def nodes(self, x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The deepest node each row of `x` reaches; `cuts` are `bin` or `threshold`, whichever `x` is given in."""
        at = np.zeros(len(x), int)
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            right = ~(x[np.arange(len(x)), np.maximum(f, 0)] <= cuts[at])
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at


@dataclass
class PenalisedTrees:
    """A fitted model: base + rate * (sum of the leaf values a row reaches)."""

    base: float
    rate: float
    width: int
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)  # on val, before the first tree and after each
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `prediction`; a row without features gets null. NaN goes right at every split."""
        base, rate, trees = self.base, self.rate, self.trees

        @F.pandas_udf(T.DoubleType())
        def predicted(vectors):
            out = np.full(len(vectors), np.nan)
            known = vectors.notna().to_numpy()
            if known.any():
                x = np.stack(vectors[known].to_list())
                out[known] = base + rate * sum((t.value[t.nodes(x, t.threshold)] for t in trees), np.zeros(len(x)))
            return vectors.__class__(out)

        vector = F.when(F.col(self.features).isNotNull(), vector_to_array(self.features))
        return df.withColumn("prediction", F.when(F.col(self.features).isNotNull(), predicted(vector)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, value) of every node that a row can reach; feature and threshold are null at
        leaves. Tree -1 holds the base, its value undamped by the rate."""
        rows = [(-1, 0, None, None, self.base)]
        for i, tree in enumerate(self.trees):
            reached = {0}
            for j, f in enumerate(tree.feature.tolist()):
                if j in reached and f >= 0:
                    reached |= {2 * j + 1, 2 * j + 2}
                    rows.append((i, j, f, float(tree.threshold[j]), None))
                elif j in reached:
                    rows.append((i, j, None, None, float(tree.value[j])))
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, value double")


def write_trees(model: PenalisedTrees, spark: SparkSession, path: str) -> None:
    rows = model.frame(spark).withColumns({"rate": F.lit(model.rate), "width": F.lit(model.width)})
    rows.coalesce(1).write.mode("errorifexists").parquet(path)


def read_trees(spark: SparkSession, path: str, features: str = "features") -> PenalisedTrees:
    """The model behind a folder of `write_trees`, without its losses."""
    rows = spark.read.parquet(path).orderBy("tree", "node").collect()
    size = max(r["node"] for r in rows) + 1
    depth = max(1, math.ceil(math.log2(size + 1)) - 1)
    model = PenalisedTrees(rows[0]["value"], rows[0]["rate"], rows[0]["width"], features=features)
    for r in rows[1:]:
        if r["node"] == 0:
            model.trees.append(Tree.stump(depth))
        tree, j = model.trees[-1], r["node"]
        if r["feature"] is None:
            tree.value[j] = r["value"]
        else:
            tree.feature[j], tree.threshold[j] = r["feature"], r["threshold"]
    return model


def bin_edges(train: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Per feature, the ascending values of `train` (column `x`) that bins end with: quantiles of it, or every value where
    there are few. NaN and null take no part."""
    steps = [i / bins for i in range(1, bins)]
    values = train.select(F.posexplode("x").alias("feature", "value")).where(~F.isnan("value") & F.col("value").isNotNull())
    rows = values.groupBy("feature").agg(F.array_distinct(F.percentile_approx("value", steps, 50 * bins)).alias("edges")).collect()
    found = {r["feature"]: np.unique(r["edges"]) for r in rows}
    return [found.get(i, np.empty(0)) for i in range(width)]


def _blocks(rows: DataFrame, edges: list[np.ndarray]) -> DataFrame:
    """(train, label, bins, pred): the rows of each Arrow batch as four byte strings; of `bins` one byte per row and feature,
    the number of edges below its value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(edges))
            out = np.empty(x.shape, np.uint8)
            for f, e in enumerate(edges):
                out[:, f] = np.searchsorted(e, x[:, f])
            train = batch.column("train").to_numpy(zero_copy_only=False)
            label, pred = (batch.column(c).to_numpy() for c in ("label", "pred"))
            yield pa.RecordBatch.from_pylist([{"train": train.tobytes(), "label": label.tobytes(), "bins": out.tobytes(),
                                               "pred": pred.tobytes()}])

    return rows.select("train", "label", "x", "pred").mapInArrow(pack, "train binary, label binary, bins binary, pred binary")


def _arrays(block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    train, label, bins, pred = block
    return (np.frombuffer(train, bool), np.frombuffer(label, np.float64),
            np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(pred, np.float64))


def _advanced(blocks: DataFrame, trees: list[Tree], rate: float, width: int) -> DataFrame:
    """The blocks with `pred` moved on by `trees`."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                _, _, x, pred = _arrays(block.values(), width)
                for tree in trees:
                    pred = pred + rate * tree.value[tree.nodes(x, tree.bin)]
                yield pa.RecordBatch.from_pylist([{**block, "pred": pred.tobytes()}])

    return blocks.mapInArrow(move, blocks.schema) if trees else blocks


def _sums(blocks: RDD, trees: list[Tree], growing: Tree, frontier: list[int], rate: float, width: int, bins: int, parts: int) -> RDD:
    """((node, first feature), (2, features, bins) of the sums of g and n) over all train rows, per node of `frontier` and
    FEATURES_PER_SUM features; at the root also the loss on val, as node LOSS."""
    place = np.full(len(growing.feature), -1)
    place[frontier] = np.arange(len(frontier))
    root = frontier == [0]

    def add_up(part: Iterator) -> Iterator[tuple]:
        size = len(frontier) * width * bins
        sums, loss, seen = np.zeros((2, size)), 0.0, 0
        for block in part:
            train, label, x, pred = _arrays(block, width)
            slope = pred - label
            for tree in trees:
                slope = slope + rate * tree.value[tree.nodes(x, tree.bin)]
            if root:
                loss, seen = loss + float((slope[~train] ** 2).sum()), seen + int((~train).sum())
            at = place[growing.nodes(x, growing.bin)]
            used = train & (at >= 0)
            if used.any():
                key = ((at[used, None] * width + np.arange(width)) * bins + x[used]).ravel()
                sums[0] += np.bincount(key, np.repeat(slope[used], width), size)
                sums[1] += np.bincount(key, minlength=size)
        if root:
            yield (LOSS, 0), np.array([loss, seen])
        shaped = sums.reshape(2, len(frontier), width, bins)
        for i, node in enumerate(frontier):
            for first in range(0, width, FEATURES_PER_SUM):
                yield (node, first), shaped[:, i, first:first + FEATURES_PER_SUM]

    return blocks.mapPartitions(add_up).reduceByKey(np.add, parts)


def _best_of(sums: np.ndarray, first: int, penalty: float, min_rows: int, unit: float) -> dict:
    """The split with the largest gain of one node among the features from `first` on, from their (2, features, bins) sums.

    Gains that agree to ten digits of `unit` count as equal, then the smaller feature and the smaller bin win. `gain` is None
    where no split leaves `min_rows` on both sides.
    """
    (g, n), (gl, nl) = sums.sum(2, keepdims=True), sums.cumsum(2)

    def score(g, n):
        with np.errstate(divide="ignore", invalid="ignore"):
            return g * g / (n + penalty)

    gain = score(gl, nl) + score(g - gl, n - nl) - score(g, n)
    valid = (sums[1] > 0) & (nl >= min_rows) & (n - nl >= min_rows)
    found = {"g": float(g[0, 0]), "n": int(n[0, 0]), "first": first, "gain": None, "rank": -math.inf}
    if valid.any():
        rank = np.where(valid, np.round(gain / unit, 10), -np.inf)
        f, b = np.unravel_index(np.argmax(rank), rank.shape)  # of equal ones the smallest feature, then the smallest bin
        found |= {"feature": first + int(f), "bin": int(b), "gl": float(gl[f, b]), "nl": int(nl[f, b]), "gain": float(gain[f, b]),
                  "rank": float(rank[f, b])}
    return found


def _lowest(losses: list[float]) -> int:
    """The place of the first loss that no later one is below."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
    return best


def _trees(level: Callable[[Tree, list[int]], dict[int, dict]], losses: list[float], number: int, rounds: int, patience: int,
           depth: int, penalty: float, min_gain: float) -> Iterator[Tree]:
    """Trees from the one numbered `number` on, without thresholds, until `rounds` are there or `patience` of them have brought
    no lower loss on val.

    `level` gives the best split of each node of a frontier, at the root also the loss on val of the trees before, which is
    added to `losses`.
    """
    best = _lowest(losses)
    for number in range(number, rounds + 1):
        tree, frontier = Tree.stump(depth), [0]
        found = level(tree, frontier)
        loss = found.pop(LOSS)
        if loss["n"]:
            losses.append(loss["g"] / loss["n"])
            if losses[-1] < losses[best]:
                best = number
            if number - best >= patience:
                return
        if number == rounds:
            return
        tree.value[0] = -found[0]["g"] / (found[0]["n"] + penalty)
        for deep in range(depth):
            following = []
            for j in frontier:
                r = found[j]
                if r["gain"] is None or r["gain"] <= min_gain:
                    continue
                tree.feature[j], tree.bin[j] = r["feature"], r["bin"]
                tree.value[2 * j + 1] = -r["gl"] / (r["nl"] + penalty)
                tree.value[2 * j + 2] = -(r["g"] - r["gl"]) / (r["n"] - r["nl"] + penalty)
                following += [2 * j + 1, 2 * j + 2]
            frontier = following
            if not frontier or deep == depth - 1:
                break
            found = level(tree, frontier)
        yield tree


class _Rows:
    """All rows of a fit in one task, those of train first; `bins` has a row per feature."""

    def __init__(self, blocks: list, width: int):
        train, label, x, pred = (np.concatenate(a) for a in zip(*(_arrays(b, width) for b in blocks)))
        order = np.argsort(~train, kind="stable")
        self.n_train = int(train.sum())
        self.bins = np.ascontiguousarray(x[order].T)
        self.slope = (pred - label)[order]
        self.at = np.zeros(len(order), int)
        self.sums: dict[int, np.ndarray] = {}  # of the nodes of a level

    def descend(self, tree: Tree) -> None:
        """Rows at a node that is split go on to its children."""
        f = tree.feature[self.at]
        moved = np.flatnonzero(f >= 0)
        at = self.at[moved]
        self.at[moved] = 2 * at + 1 + (self.bins[f[moved], moved] > tree.bin[at])

    def level(self, tree: Tree, frontier: list[int], bins: int, penalty: float, min_rows: int, unit: float) -> dict[int, dict]:
        """What `_trees` asks for; the levels of a tree come one after the other."""
        found: dict[int, dict] = {}
        if frontier == [0]:
            self.at[:] = 0
            slope = self.slope[self.n_train:]
            found[LOSS] = {"g": float((slope ** 2).sum()), "n": len(slope)}
        else:
            self.descend(tree)
        counted, others = frontier, []
        if frontier != [0] and all(np.isfinite(of).all() for of in self.sums.values()):
            # of two children the one with fewer rows is added up, the other has what it leaves of the node above
            held = np.bincount(self.at[:self.n_train], minlength=len(tree.feature))
            counted = [j if held[j] <= held[j + 1] else j + 1 for j in frontier[::2]]
            others = [(j + 1 if c == j else j, c) for j, c in zip(frontier[::2], counted)]
        sums = self._sums(counted, len(tree.feature), bins)
        for j, c in others:
            rest = self.sums[(j - 1) // 2] - sums[c]
            rest[0][rest[1] == 0] = 0
            sums[j] = rest
        self.sums = sums
        return found | {j: _best_of(sums[j], 0, penalty, min_rows, unit) for j in frontier}

    def _sums(self, nodes: list[int], n_nodes: int, bins: int) -> dict[int, np.ndarray]:
        """Per node the (2, features, bins) sums of slopes and rows of train."""
        place = np.full(n_nodes, -1)
        place[nodes] = np.arange(len(nodes))
        at = place[self.at[:self.n_train]]
        used = np.flatnonzero(at >= 0)
        begin, slope = at[used] * bins, self.slope[used]
        size, width = len(nodes) * bins, len(self.bins)
        sums = np.empty((len(nodes), 2, width, bins))
        for f in range(width):
            key = begin + self.bins[f][used]
            sums[:, 0, f] = np.bincount(key, slope, size).reshape(-1, bins)
            sums[:, 1, f] = np.bincount(key, minlength=size).reshape(-1, bins)
        return dict(zip(nodes, sums))

    def advance(self, tree: Tree, rate: float) -> None:
        """Slopes after a tree whose last level has not been gone down yet."""
        self.descend(tree)
        self.slope += rate * tree.value[self.at]


def fit_penalised(
    df: DataFrame, label: str = "label", features: str = "features", depth: int = 6, rate: float = 0.3, penalty: float = 1.0,
    min_gain: float = 1e-6, min_rows: int = 1, rounds: int = 1000, patience: int = 10, bins: int = BINS,
) -> PenalisedTrees:
    """Trees for squared error, fitted to the rows of `df` whose `split` is train.

    Fitting ends after `patience` rounds without a lower loss on the rows of val and keeps the trees up to the lowest one,
    as `curves.early_stop` does for curves; without val rows all rounds are kept. The base is the mean label. Rows without
    label or features take no part; no train row at all is an error. NaN counts as larger than everything. Rows that are
    repeated weigh as often as they occur.
    """
    if not 2 <= bins <= BINS or min_rows < 1:
        raise ValueError(f"bins must be between 2 and {BINS}, min_rows at least 1")
    given = df.where(F.col("split").isin("train", "val") & F.col(label).isNotNull() & F.col(features).isNotNull())
    rows = given.select((F.col("split") == "train").alias("train"), F.col(label).cast("double").alias("label"),
                        vector_to_array(features).alias("x"))
    train = rows.where("train")
    size = F.size("x")
    base, spread, width, narrowest = train.agg(F.avg("label"), F.var_pop("label") * F.count("label"), F.max(size), F.min(size)).first()
    if base is None:
        raise ValueError("no train rows")
    if width != narrowest:
        raise ValueError("vectors of different lengths")
    if not 1 <= width <= MAX_WIDTH:
        raise ValueError(f"between 1 and {MAX_WIDTH} features, not {width}")
    edges = bin_edges(train, width, bins)
    model = PenalisedTrees(float(base), rate, width, features=features)
    count, unit = rows.count(), spread or 1.0
    whole = count * max(width, ROW_BYTES) <= WHOLE_BYTES
    tasks = math.ceil(count * width / PART_BYTES)
    state = cut_lineage(_blocks(rows.withColumn("pred", F.lit(float(base))).repartition(tasks), edges))
    pending: list[Tree] = []  # trees that `pred` does not hold yet
    rules = (rounds, patience, depth, penalty, min_gain)

    def level(tree: Tree, frontier: list[int]) -> dict[int, dict]:
        parts = math.ceil(len(frontier) * width * bins / PART_CELLS)
        sums = _sums(state.rdd, pending, tree, frontier, rate, width, bins, parts)

        def best(item: tuple) -> tuple[int, dict]:
            (node, first), of = item
            return node, {"g": float(of[0]), "n": int(of[1])} if node == LOSS else _best_of(of, first, penalty, min_rows, unit)

        found: dict[int, dict] = {}
        for node, r in sorted(sums.map(best).collect(), key=lambda item: (item[0], item[1].get("first", 0))):
            # totals of a node are those of its first feature
            if node not in found:
                found[node] = r
            elif r["rank"] > found[node]["rank"] or (math.isnan(r["rank"]) and not math.isnan(found[node]["rank"])):
                found[node] = {**r, "g": found[node]["g"], "n": found[node]["n"]}
        return found

    def next_trees() -> tuple[list[Tree], list[float]]:
        """Up to CUT_EVERY trees that one task grows, and the losses with those of theirs."""
        losses, number, most = list(model.losses), len(model.trees), CUT_EVERY

        def grow(part: Iterator) -> Iterator[tuple]:
            blocks = list(part)
            if not blocks:
                return
            held, out = _Rows(blocks, width), []
            for tree in islice(_trees(lambda *at: held.level(*at, bins, penalty, min_rows, unit), losses, number, *rules), most):
                out.append(tree)
                held.advance(tree, rate)
            yield out, losses

        ((out, after),) = state.rdd.coalesce(1).mapPartitions(grow).collect()
        return out, after

    def taken(tree: Tree) -> Tree:
        for j in np.flatnonzero(tree.feature >= 0):
            tree.threshold[j] = edges[tree.feature[j]][tree.bin[j]]
        model.trees.append(tree)
        return tree

    if whole:
        while True:
            grown, model.losses = next_trees()
            pending = [taken(tree) for tree in grown]
            if len(pending) < CUT_EVERY:
                break
            state = cut_lineage(_advanced(state, pending, rate, width))
    else:
        for tree in _trees(level, model.losses, 0, *rules):
            pending.append(taken(tree))
            if len(pending) == CUT_EVERY:
                state, pending = cut_lineage(_advanced(state, pending, rate, width)), []
    if model.losses:
        model.trees = model.trees[:_lowest(model.losses)]
    return model
