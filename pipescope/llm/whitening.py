"""Whitening of embeddings from an exact covariance, by bit-sliced scatter.

Components become whole numbers x = floor(scale * c) + offset. One pass finds count, sum, smallest and largest of each
dimension. Each dimension is shifted by its smallest value, so that it needs few bits, and a second pass packs every
bit of it across rows into words: plane (i, a) holds bit a of dimension i, one bit a row. The product of two
dimensions is then sum of 2^(a+b) * popcount(plane(i, a) AND plane(j, b)), exactly. A task adds its blocks up and
reports one row per pair of dimensions, limbs of whole numbers that Spark sums; only dimensions squared reach the
driver. There n * sum(xy) - sum(x) * sum(y) is formed in whole numbers of any size: the centred scatter without any
rounding, divided once, so that offsets far larger than the spread cost no digits. Its eigenvectors give the components.

Defined cases: rows whose vector is null or holds null or non-finite components take no part; a null id stays null; a
shorter vector counts as padded with zeros up to the longest; scaled components beyond 2^62 count as 2^62; copies of a
vector count as often as they occur. A component without variance (its eigenvalue within rounding of zero beside the
largest) cannot be scaled to one and is left out, so a table of one distinct vector, or an empty one, gives no rows.
Eigenvectors have either sign; the largest entry is made positive. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipescope.llm.common import written

BLOCK_ROWS = 4096
LIMB = 40
LIMBS = 5
LARGEST = 2**62
#: products of two shifted dimensions over a block stay below 2^63 up to this many bits a dimension
NARROW = 24


def whole_vectors(df: DataFrame, vec_id: str, vector: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, x): the rows that take part, with components floor(scale * c) + offset."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))

    def whole(c):
        scaled = F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * F.lit(float(scale))))
        return F.floor(scaled).cast("long") + F.lit(offset).cast("long")

    return df.where(F.col(vector).isNotNull() & finite).select(F.col(vec_id).alias("vec_id"), F.transform(vector, whole).alias("x"))


def _rows(batch: pa.RecordBatch, width: int, empty: int) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers, padded with what a zero component becomes."""
    lists = batch.column("x")
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.full((len(sizes), width), empty, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _ranges(width: int, empty: int):
    """One row a dimension and task: how many vectors, the smallest and largest component, and their sum."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, None, None, np.zeros(width, object)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, width, empty)
                n += len(x)
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
                # halves keep the sums of a batch inside 64 bits
                total = total + (x >> 32).sum(0).astype(object) * 2**32 + (x & 0xFFFFFFFF).sum(0).astype(object)
        if n:
            yield pa.RecordBatch.from_pydict({
                "d": pa.array(np.arange(width), pa.int32()), "n": pa.array([n] * width, pa.int64()),
                "low": pa.array(low, pa.int64()), "high": pa.array(high, pa.int64()),
                "total": pa.array([int(t) for t in total], pa.decimal128(38, 0))})

    return of


def _planes(y: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of non-negative columns, packed into words of 64 rows, and the first plane of each column."""
    first = np.concatenate([[0], np.cumsum(bits)])
    words = -(-len(y) // 64)
    packed = np.zeros((int(first[-1]), words * 8), np.uint8)
    columns = np.ascontiguousarray(y.T).view(np.uint64)
    for i, of in enumerate(bits):
        for a in range(of):
            row = np.packbits(((columns[i] >> np.uint64(a)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            packed[first[i] + a, :len(row)] = row
    return packed.view(np.uint64), first


def _block_products(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Upper triangle of the column products of a block: 2^(a+b) popcount(plane(i, a) AND plane(j, b)), summed."""
    planes, first = _planes(y, bits)
    narrow = max(bits, default=0) <= NARROW
    dtype = np.int64 if narrow else object
    out = np.zeros((len(bits), len(bits)), dtype)
    place = np.array([2**b for of in bits for b in range(of)], dtype)
    at = [i for i, of in enumerate(bits) if of]  # a constant dimension has no planes
    for k, i in enumerate(at):
        rest = planes[first[i]:]
        starts = first[at[k:]] - first[i]
        for a in range(bits[i]):
            ones = np.bitwise_count(rest & planes[first[i] + a]).sum(axis=1, dtype=np.int64)
            weighted = (ones if narrow else ones.astype(object)) * place[first[i]:]
            out[i, at[k:]] += np.add.reduceat(weighted, starts) * 2**a
    return out


def _products(width: int, empty: int, low: list[int], bits: list[int]):
    """One row a pair of dimensions and task: the sum of products of the shifted dimensions, in limbs."""
    base = np.array(low, np.int64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, held, seen = np.zeros((width, width), object), [], 0, False
        for batch in batches:
            if batch.num_rows:
                waiting.append(_rows(batch, width, empty) - base)
                held, seen = held + batch.num_rows, True
            if held >= BLOCK_ROWS:
                block = np.concatenate(waiting)
                for start in range(0, held - held % BLOCK_ROWS, BLOCK_ROWS):
                    total = total + _block_products(block[start:start + BLOCK_ROWS], bits)
                waiting, held = [block[held - held % BLOCK_ROWS:]], held % BLOCK_ROWS
        if held:
            total = total + _block_products(np.concatenate(waiting), bits)
        if not seen:
            return
        i, j = np.triu_indices(width)
        sums = [int(s) for s in total[i, j]]
        limbs = {f"limb{k}": pa.array([s >> LIMB * k & (1 << LIMB) - 1 for s in sums], pa.int64()) for k in range(LIMBS)}
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), **limbs})

    return of


@dataclass(frozen=True)
class Fit:
    """Count and sums of the fitted vectors, their exact scatter n * sum(xy) - sum(x) sum(y), and its components."""

    n: int
    sums: list[int]
    scatter: list[list[int]]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        total = sum(self.scatter[i][i] for i in range(len(self.sums))) / self.n / self.n
        return self.values / total if total > 0 else self.values


def fit(rows: DataFrame, empty: int) -> Fit | None:
    """The fit of whole vectors (vec_id, x); None if there are none."""
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    ranges = rows.mapInArrow(_ranges(width, empty), "d int, n long, low long, high long, total decimal(38, 0)").groupBy("d").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total")).orderBy("d").collect()
    n, low, sums = ranges[0]["n"], [r["low"] for r in ranges], [int(r["total"]) for r in ranges]
    bits = [(r["high"] - r["low"]).bit_length() for r in ranges]
    names = [f"limb{k}" for k in range(LIMBS)]
    limbs = rows.mapInArrow(_products(width, empty, low, bits), "i int, j int, " + ", ".join(f"{x} long" for x in names))
    shifted = [s - n * b for s, b in zip(sums, low)]
    scatter = [[0] * width for _ in range(width)]
    for r in limbs.groupBy("i", "j").agg(*(F.sum(F.col(x).cast("decimal(38, 0)")).alias(x) for x in names)).collect():
        i, j = r["i"], r["j"]
        product = sum(int(r[x]) << LIMB * k for k, x in enumerate(names))
        scatter[i][j] = scatter[j][i] = n * product - shifted[i] * shifted[j]
    covariance = np.array([[c / (n * n) for c in line] for line in scatter])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(width)])
    return Fit(n, sums, scatter, values, vectors)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, in 64-bit numbers where they fit, else in Python's."""
    reach = n * max(int(np.abs(x).max(initial=0)), 1) + max((abs(s) for s in sums), default=0)
    return x * n - np.array(sums, np.int64) if reach < 2**62 else x.astype(object) * n - np.array(sums, object)


def _whitened(width: int, empty: int, n: int, sums: list[int], axes: np.ndarray):
    """Rows with the exact deviation and the whitened components."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _centred(_rows(batch, width, empty), n, sums)
            largest = max(int(np.abs(centred).max(initial=0)), 1)
            wide = centred if largest**2 * width < 2**63 else centred.astype(object)
            deviation = (wide * wide).sum(axis=1)
            white = (centred / n).astype(float) @ axes
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([min(int(d), 10**38 - 1) for d in deviation], pa.decimal128(38, 0)), lists],
                ["vec_id", "deviation", "white"])

    return of


def _moments(k: int):
    """Rows (i, j, total) of a task: sums of products of whitened components, of single components where j is -1."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, seen = np.zeros((k, k)), np.zeros(k), False
        for batch in batches:
            if batch.num_rows:
                z, seen = batch.column("white").flatten().to_numpy().reshape(-1, k), True
                products, sums = products + z.T @ z, sums + z.sum(0)
        if seen:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.concatenate([i, np.arange(k)]), pa.int32()), "j": pa.array(np.concatenate([j, np.full(k, -1)]), pa.int32()),
                "total": pa.array(np.concatenate([products[i, j], sums]))})

    return of


def identity_error(white: DataFrame, k: int, n: int) -> float:
    """Largest entry, without sign, of the covariance of the whitened components minus the identity.

    The components were centred by the exact mean before; what is left of their means is taken off as well.
    """
    totals = white.select("white").mapInArrow(_moments(k), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    at = {(r["i"], r["j"]): r["total"] / n for r in totals.collect()}
    return max(abs(at[i, j] - at[i, -1] * at[j, -1] - (i == j)) for i in range(k) for j in range(i, k))


def whiten(df: DataFrame, *, components: int = 8, scale: float = 1024.0, offset: int = 100_000, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row that takes part and each
    component up to `components`, by falling eigenvalue; `deviation` is decimal(38, 0)."""
    spark = df.sparkSession
    rows = written(whole_vectors(df, vec_id, vector, scale, offset), "vectors")
    schema = "component int, n long, deviation decimal(38, 0), whitened double, explained double, identity_error double"
    found = fit(rows, offset)
    kept = 0 if found is None else int((found.values[:components] > max(found.values[0], 0) * len(found.sums) * np.finfo(float).eps).sum())
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not kept:
        return spark.createDataFrame([], f"vec_id {kind}, {schema}")
    axes = found.vectors[:, :kept] / np.sqrt(found.values[:kept])
    white = written(rows.mapInArrow(_whitened(len(found.sums), offset, found.n, found.sums, axes),
                                    f"vec_id {kind}, deviation decimal(38, 0), white array<double>"), "whitened")
    error = identity_error(white, kept, found.n)
    shares = F.array(*(F.lit(float(x)) for x in found.explained[:kept]))
    return white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
