"""Exact top-k search by inner product, by distributed histogram selection.

Queries and candidates are dealt into blocks; every pair of blocks is one group, in which all scores are one
matrix product. No score leaves the group. Instead, rounds of histograms locate each query's k-th score: a
group counts its scores per bin, the counts are added up, the bin that holds the k-th score is found from
above and becomes the interval of the next, finer round, until bins are single scores. A last pass keeps
what reaches the k-th score, and equal scores are ordered by the smaller id.

What a group reports is bounded: scores below its own k-th best cannot be the k-th best overall, so they are
not counted, and the last pass returns at most k rows per query and group, which a per-task limit on the
ranking cuts again before anything is shuffled. A vector that a third of the rows share makes many ties, but
no more rows than any other; candidates are dealt by their id and a number written with them, so rows that repeat
one id are spread as well.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; components are floor(scale * x); a shorter vector counts as padded with zeros; a query's candidates are
the rows with another id, so copies of its own row under its id are left out, while repeated candidates are
listed as often as they occur; of several rows with one query id the smallest vector is the query; scores
beyond 2^61 count as 2^61; fewer than k candidates are all returned; empty tables give no rows. Only the
named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipescope.llm.common import written
from pipescope.session import cut_lineage

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
BINS = 256
LARGEST = 2**61
ABSENT = np.iinfo(np.int64).min


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(id, v): the rows that take part, with components floor(scale * x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    return df.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors of one block as rows, padded with zeros to `width`."""
    arrays = lists.combine_chunks()
    if isinstance(arrays, pa.ChunkedArray):
        arrays = pa.concat_arrays(arrays.chunks) if arrays.num_chunks else pa.array([], lists.type)
    sizes = np.diff(arrays.offsets.to_numpy())
    flat = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(queries: pa.Table, candidates: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and the whole-number scores between them; a query's own id is ABSENT."""
    def width(t: pa.Table) -> int:
        return max((len(x) for x in t["v"]), default=0)

    size = max(width(queries), width(candidates))
    q, c = _matrix(queries["v"], size), _matrix(candidates["v"], size)
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * size
    if bound < 2**53:
        scores = (q.astype(float) @ c.astype(float).T).astype(np.int64)
    else:
        exact = q.astype(object) @ c.astype(object).T
        scores = np.clip(exact, -LARGEST, LARGEST).astype(np.int64)
    qid, cid = queries["id"].to_numpy(), candidates["id"].to_numpy()
    scores[qid[:, None] == cid[None, :]] = ABSENT
    return qid, cid, scores


def _own_best(scores: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score inside the block, ABSENT if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), ABSENT)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _histogram(k: int, width: int, step: int):
    def counts(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(candidates) or not len(queries):
            qid = bins = n = np.array([], np.int64)
        else:
            ids, _, scores = _scores(queries, candidates)
            low = queries["low"].to_numpy()
            least = np.maximum(_own_best(scores, k), low)
            row, col = np.nonzero((scores >= least[:, None]) & (scores > ABSENT) & (scores <= (low + (width - 1))[:, None]))
            of = (scores[row, col] - low[row]) // step
            cells, n = np.unique(np.column_stack([row, of]), axis=0, return_counts=True) if len(row) else (
                np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
            qid, bins = ids[cells[:, 0]], cells[:, 1]
        return pa.table({"id": pa.array(qid, pa.int64()), "bin": pa.array(bins, pa.int64()), "n": pa.array(n, pa.int64())})

    return counts


def _reaching(k: int):
    def best(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(candidates) or not len(queries):
            q = v = s = np.array([], np.int64)
        else:
            ids, cids, scores = _scores(queries, candidates)
            least = np.maximum(_own_best(scores, k), queries["low"].to_numpy())
            row, col = np.nonzero((scores >= least[:, None]) & (scores > ABSENT))
            order = np.lexsort((cids[col], -scores[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, row)  # rows are sorted: where each query begins
            kept = np.arange(len(row)) - first < k
            row, col = row[kept], col[kept]
            q, v, s = ids[row], cids[col], scores[row, col]
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.int64())})

    return best


def exact_top_k(df: DataFrame, is_query: Column, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
                scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row for which `is_query` holds."""
    rows = written(whole_vectors(df.select(vec_id, vector), vec_id, vector, scale).withColumn("number", F.monotonically_increasing_id()),
                   "vectors")
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max(length).alias("longest")).first()
    query_blocks = max(1, math.ceil(size["q"] / QUERY_BLOCK))
    candidate_blocks = max(1, math.ceil(size["n"] / CANDIDATE_BLOCK))
    reach = min(LARGEST, int((size["longest"] or 0.0) ** 2 * (1 + 1e-9)) + 1)

    def block(blocks: int, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    placed = rows.select(F.col("id").alias("id"), F.col("v").alias("v"), block(candidate_blocks, "id", "number").alias("c")).withColumn(
        "q", every(query_blocks))

    def pairs(state: DataFrame):
        asked = queries.join(state, "id").withColumn("q", block(query_blocks, "id")).withColumn("c", every(candidate_blocks))
        return placed.groupBy("q", "c").cogroup(asked.groupBy("q", "c"))

    state = queries.select("id", F.lit(-reach).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    width = 2 * reach + 1
    while width > 1:
        step = math.ceil(width / BINS)
        bins = pairs(state).applyInArrow(_histogram(k, width, step), "id long, bin long, n long").groupBy("id", "bin").agg(
            F.sum("n").alias("n"))
        above = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        placed_bins = bins.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).join(state, "id")
        found = placed_bins.where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))).select(
            "id", (F.col("low") + F.col("bin") * step).alias("at"), (F.col("need") - F.col("above")).alias("rest"))
        # a query with fewer than k candidates has no such bin and keeps the lowest bound
        state = cut_lineage(state.join(found, "id", "left").select(
            "id", F.coalesce("at", "low").alias("low"), F.coalesce("rest", "need").alias("need")))
        width = step
    reaching = pairs(state).applyInArrow(_reaching(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reaching.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
