"""Near-duplicate groups with HyperMinHash sketches.

A document's set of word shingles is hashed; the hashes fall into 160 buckets, and each bucket stores its
smallest hash in compressed form: the count of leading zeros and the ten bits after the first one. Five registers
make one of 32 bands, and documents that agree in a band are candidates. At a similarity of 0.8 a pair misses all
bands with probability 3e-6. Empty registers count as a value, bands of nothing but empty registers do not
exist, so a few differing shingles cannot break all bands of a short document.

Documents with equal sets are one class and only classes go on. Links are found in two rounds:
1. in every band bucket each class is compared with one of them (the smallest), a number of pairs linear in the
   bucket's size. Registers that agree, corrected for chance collisions of compressed registers, estimate the
   similarity; pairs far below the threshold are dropped, the rest are confirmed on their full sets;
2. buckets that still hold several components after that are compared completely, in blocks of bounded size and
   inside one task each: first by estimate, to find which classes have any candidate outside their component,
   then those by their full sets, best estimates first and skipping what a found link has already joined. Only
   a spanning forest of the confirmed links leaves a task, never all pairs.

Defined cases: a null or empty text has the empty set, links with nothing and is a component of its own; a text with
fewer words than a shingle has one shingle, all its words; documents without an id have null as their component
unless a linked document has one; rows that share an id are judged by their own texts; an empty table gives no
rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipescope.llm.common import giving_back, in_small_batches, written
from pipescope.llm.components import components
from pipescope.llm.pieces import text_parts
from pipescope.llm.shingles import shingle_hashes, word_hashes

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
VALUE_BITS = 32  # of a hash inside its bucket
BLOCK = 1024
SLACK = 5.5  # standard deviations by which an estimate may fall short of the threshold
BROADCAST_BYTES = 16 << 20


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of one document from its sorted distinct shingle hashes; 0 is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(hashes):
        return out
    # bucket = hash * REGISTERS / 2^64, and the fraction of that is the hash inside its bucket
    high = (hashes >> np.uint64(32)) * np.uint64(REGISTERS) + (((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(REGISTERS)) >> np.uint64(32))
    bucket = (high >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted hashes: a bucket's first is its smallest
    value = high[first] & np.uint64(0xFFFFFFFF)
    _, size = np.frexp(value.astype(np.float64))  # exact below 2^53: the number of bits of the value
    below = np.maximum(size.astype(np.int64) - 1, 0)
    tail = value - (np.uint64(1) << below.astype(np.uint64)) * (value > 0)
    mantissa = np.where(below >= MANTISSA, tail >> np.maximum(below - MANTISSA, 0).astype(np.uint64),
                        tail << np.maximum(MANTISSA - below, 0).astype(np.uint64))
    zeros = VALUE_BITS - size.astype(np.int64)
    out[bucket[first]] = (zeros << MANTISSA) + mantissa.astype(np.int64) + 1
    return out


@lru_cache(maxsize=256)
def collision_rate(log_load: int) -> float:
    """Chance that two unequal smallest hashes give one register, with 2^log_load hashes in the bucket."""
    load = 2.0 ** log_load
    cells = np.concatenate([2.0 ** -k * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA)) for k in range(VALUE_BITS, 0, -1)] + [np.ones(1)])
    inside = -np.diff(np.power(np.clip(1 - cells, 0, 1), load))
    return float((inside ** 2).sum())


def estimates(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of rows of registers: the share of agreeing registers without the expected collisions."""
    used = (a > 0) | (b > 0)
    agree = ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
    load = np.round(np.log2(np.maximum((n_a + n_b) / 2 / REGISTERS, 1))).astype(int)
    chance = np.array([collision_rate(int(x)) for x in np.unique(load)])[np.searchsorted(np.unique(load), load)]
    return (agree - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _shingle_sets(texts, size: int):
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = shingle_hashes(*word_hashes(texts), size)
    ends = np.cumsum(counts)
    for begin, end in zip((ends - counts).tolist(), ends.tolist()):
        yield np.unique(hashes[begin:end])


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, digest, registers, text_hash) of every row."""
    def sketch(batches):
        for batch in batches:
            ids = batch.column(0)
            for part, texts in text_parts(batch.column(1)):
                sets = list(_shingle_sets(texts, size))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(part.start, part.stop - part.start).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) for s in sets], pa.binary()), pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                    batch.column(2).slice(part.start, part.stop - part.start),
                ], ["doc_id", "n_shingles", "digest", "registers", "text_hash"])

    return in_small_batches(docs.select(F.col(doc_id).cast("long"), F.col(text), F.xxhash64(text))).mapInArrow(
        lambda batches: giving_back(sketch(batches)), "doc_id long, n_shingles long, digest binary, registers binary, text_hash long")


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the wanted classes (node, rep, digest), from the texts of their representatives."""
    def sets(batches):
        for batch in batches:
            for _, texts in text_parts(batch.column(0)):
                found = list(_shingle_sets(texts, size))
                yield pa.RecordBatch.from_arrays([
                    pa.array([digest(s) for s in found], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]), pa.int32()),
                                             pa.array(np.concatenate(found).view(np.int64))),
                ], ["digest", "shingles"])

    reps = wanted.select(F.col("rep").alias("_rep")).distinct()
    if reps.count() * 8 <= BROADCAST_BYTES:
        reps = F.broadcast(reps)
    texts = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text"))
    chosen = texts.join(reps, F.col("_doc").eqNullSafe(F.col("_rep")), "left_semi").select("_text")
    found = in_small_batches(chosen).mapInArrow(lambda batches: giving_back(sets(batches)), "digest binary, shingles array<long>")
    # several rows may hold the text of one class; their sets are equal
    return wanted.select("node", "digest").join(found, "digest").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _near_pairs(pairs: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate reaches `least`."""
    def filtered(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            keep = estimates(_matrix(t["ra"]), _matrix(t["rb"]), t["na"].to_numpy(), t["nb"].to_numpy()) >= least
            yield t.select(["a", "b"]).filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else (
                batch.select(["a", "b"]).slice(0, 0))

    left = sketched.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra"))
    right = sketched.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(filtered, "a long, b long")


def linked(inner: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * inner >= percent * (n_a + n_b - inner)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    inner = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(a, "a").join(b, "b").where(linked(inner, F.size("sa"), F.size("sb"), percent)).select("a", "b")


def _cross_pairs(band: int, regs: np.ndarray, n: np.ndarray, roots: np.ndarray, side: np.ndarray, least: float):
    """Index pairs of one block that lie in different components, share no earlier band and reach `least`.

    `side` is 0 or 1 for the two halves of a block; within a half of its own block pairs count once.
    """
    left, right = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
    for i in left.tolist():
        others = right[(roots[right] != roots[i]) & ((right > i) if side[i] == 1 else True)]
        if not len(others):
            continue
        est = estimates(np.broadcast_to(regs[i], (len(others), REGISTERS)), regs[others], np.broadcast_to(n[i], len(others)), n[others])
        near = est >= least
        others, est = others[near], est[near]
        if band and len(others):
            same = (regs[others][:, :band * ROWS] == regs[i][:band * ROWS]).reshape(len(others), band, ROWS).all(axis=2)
            full = (regs[i][:band * ROWS].reshape(band, ROWS) > 0).any(axis=1)
            fresh = ~(same & full).any(axis=1)
            others, est = others[fresh], est[fresh]
        if len(others):
            yield i, others, est


def _block_rows(t: pa.Table):
    t = t.sort_by([("side", "ascending"), ("node", "ascending")])
    return (t["node"].to_numpy(), t["root"].to_numpy(), t["side"].to_numpy(), _matrix(t["registers"]), t["n_shingles"].to_numpy(), t)


def _with_candidates(least: float):
    """The classes of a block that have a candidate outside their component."""
    def find(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        nodes, roots, side, regs, n, t = _block_rows(t)
        hit = np.zeros(len(nodes), bool)
        for i, others, _ in _cross_pairs(key[0].as_py(), regs, n, roots, side, least):
            hit[i] = True
            hit[others] = True
        return t.select(["band", "bucket", "i", "j", "side", "node", "root"]).filter(pa.array(hit))

    return find


def _block_links(least: float, percent: int):
    """A spanning forest of the confirmed links between components in a block."""
    def link(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        nodes, roots, side, regs, n, t = _block_rows(t)
        lists = t["shingles"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        of: dict[int, int] = {}

        def root(x: int) -> int:
            while of.get(x, x) != x:
                x = of[x] = of.get(of[x], of[x])
            return x

        pairs = [(np.full(len(o), i), o, e) for i, o, e in _cross_pairs(key[0].as_py(), regs, n, roots, side, least)]
        found = []
        if pairs:
            left, right, est = (np.concatenate(x) for x in zip(*pairs))
            for p in np.argsort(-est, kind="stable").tolist():
                i, j = int(left[p]), int(right[p])
                a, b = root(int(roots[i])), root(int(roots[j]))
                if a == b:
                    continue
                x, y = flat[bounds[i]:bounds[i + 1]], flat[bounds[j]:bounds[j + 1]]
                inner = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * inner >= percent * (len(x) + len(y) - inner):
                    of[max(a, b)] = min(a, b)
                    found.append((int(nodes[i]), int(nodes[j])))
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _blocked(members: DataFrame) -> DataFrame:
    """Deal every bucket (band, bucket, node, root) into pairs of blocks (i <= j) of about BLOCK classes.

    A class is copied to the pairs its block is part of; `side` is 0 in the first block of a pair, 2 in the
    second and 1 if the pair is the block with itself.
    """
    sizes = members.groupBy("band", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return (
        members.join(sizes, ["band", "bucket"]).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("band", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                F.when(F.col("own") == F.col("other"), 1).when(F.col("own") < F.col("other"), 0).otherwise(2).alias("side"),
                "node", "root")
    )


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, group, text_hash), one row per row of `docs`.

    Documents whose shingle sets have a similarity of at least `percent` are linked; `component_id` is the
    smallest id reachable, `group` a number of the component (null for empty sets).
    """
    least = least_estimate(percent / 100)
    rows = written(sketches(docs, size, doc_id, text), "sketches")
    classes = written(
        rows.where("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
        .withColumn("node", F.monotonically_increasing_id()), "classes")
    sketched = classes.select("node", "n_shingles", "registers")

    width = 2 * ROWS
    band = F.posexplode(F.array(*[F.substring("registers", 1 + width * b, width) for b in range(BANDS)])).alias("band", "part")
    bands = classes.select("node", band).where(F.col("part") != F.lit(bytes(width))).select(
        "band", F.xxhash64("part").alias("bucket"), "node")
    shared = bands.groupBy("band", "bucket").agg(F.min("node").alias("centre"), F.max("node").alias("_last")).where("centre < _last")
    members = written(bands.join(shared.drop("_last"), ["band", "bucket"]), "members")

    # round 1: every class with the centre of its bucket
    stars = members.where("node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    near = written(_near_pairs(stars, sketched, least), "near")
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).distinct().join(classes, "node").select("node", "rep", "digest")
    sets = written(_full_sets(docs, wanted, size, doc_id, text), "sets")
    links = written(_confirmed(near, sets, percent), "links")
    first = written(components(links), "components")

    # round 2: buckets that hold several components, completely
    placed = members.join(first, "node", "left").select("band", "bucket", "node", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("band", "bucket").agg(F.min("root").alias("_low"), F.max("root").alias("_high"),
                                                 F.count(F.lit(1)).alias("_n")).where("_low < _high and _n > 2").select("band", "bucket")
    open_rows = written(placed.join(mixed, ["band", "bucket"]), "open")
    keys = ["band", "bucket", "i", "j"]
    kind = "band int, bucket long, i int, j int, side int, node long, root long"
    candidates = written(
        _blocked(open_rows).join(sketched, "node").groupBy(*keys).applyInArrow(_with_candidates(least), kind), "candidates")
    missing = candidates.select("node").distinct().join(sets, "node", "left_anti").join(classes, "node").select("node", "rep", "digest")
    more = written(_full_sets(docs, missing, size, doc_id, text), "sets")
    late = candidates.join(sketched, "node").join(sets.union(more), "node").groupBy(*keys).applyInArrow(
        _block_links(least, percent), "a long, b long")
    final = written(components(links.union(late)), "components")

    rooted = classes.join(final, "node", "left").select("digest", "rep", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = rooted.join(smallest, "root").select(F.col("digest").alias("_digest"), "component_id", F.col("root").alias("group"))
    joined = rows.drop("registers").join(of_class, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
                         "group", "text_hash")


def kept_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """One row of each group of near duplicates, with all columns of `docs` whatever their names.

    It is a row with the group's smallest id; of several such rows one with the smallest text hash, and one of
    those that agree in text. Rows with empty sets all stay.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at_id, at_text = f"_c{names.index(doc_id)}", f"_c{names.index(text)}"
    found = near_duplicates(numbered, doc_id=at_id, text=at_text, **parameters).where("kept")
    chosen = found.where("group is not null").groupBy("group").agg(F.first("doc_id").alias("_id"), F.min("text_hash").alias("_hash")).select(
        "_id", "_hash", F.lit(True).alias("_one"))
    lone = found.where("group is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct().withColumn(
        "_one", F.lit(False))
    keep = written(chosen.union(lone), "kept")
    same = F.col(at_id).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(at_text) == F.col("_hash"))
    rows = numbered.join(keep, same)
    both = rows.where("not _one").drop("_hash", "_one", "_id").union(
        rows.where("_one").dropDuplicates(["_id", "_hash"]).drop("_hash", "_one", "_id"))
    return both.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
