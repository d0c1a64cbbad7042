"""Ranked lexical search over all documents, by presence-mask grouping.

The terms of the items are a bounded vocabulary (items go through in rounds of at most `ROUND_BYTES` of text). One pass
over the documents writes for each its length and its counts of those terms, and the corpus totals are sums over that.
Scoring goes over blocks of documents: each term is a bitmap over the block, and the bitmaps of an item's terms give
every document its mask of matched terms. Documents with the same mask form a group. The most a mask can score is the
sum of its terms' largest contributions in the block; masks are evaluated from the highest such bound down, with exact
scores for their documents, until the bound of the next mask is below the k-th best score so far. What a task has found
carries over to its next blocks, so most masks there are never evaluated. A task reports at most k documents an item,
and the last step ranks those.

Scores are whole numbers: a term weighs w = floor(1000 * ln((2N + 2) / (2 df + 1))), a document has
m = 100 - B + (B * n * N) div L with B = 75, and a term that occurs tf times adds w * ((10^9 tf) div (1000 tf + 8 m)) for
each time it stands in the item.

Defined cases: a null text has no terms, and such documents count neither in N nor in L; documents without an id are
ranked, with a null id, after those with equal scores; rows that repeat an id are documents of their own; items that
repeat as a whole row are answered once, items that repeat an id with another text are answered each; an item without
terms, or whose terms no document holds, has no rows; scores of 0 are not returned. Empty tables give no rows. Only the
named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipescope.llm.common import LOWER, UPPER, giving_back, written

ROUND_BYTES = 1 << 24
BLOCK_DOCS = 8192
FIRST_LOOK = 64
LENGTH_SHARE = 75

#: bytes of UTF-8: letters, digits and everything beyond ASCII stay, A-Z in lower case; the rest separates
_TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms_of(text: str | bytes) -> list[bytes]:
    """The terms of a text in order, as bytes of UTF-8."""
    return (text.encode() if isinstance(text, str) else text).translate(_TABLE).split()


class Questions:
    """The items of one round: their distinct terms by number, and each item's terms with repeats."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids = [i for i, _ in items]
        counts = [Counter(terms_of(text or "")) for _, text in items]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        self.terms = [np.array(sorted(self.vocabulary[t] for t in c), np.int64) for c in counts]
        names = list(self.vocabulary)
        self.times = [np.array([c[names[t]] for t in own], np.int64) for c, own in zip(counts, self.terms)]


def _counted(vocabulary: dict[bytes, int]):
    """Documents with a term at all: id, number of terms, and the item terms among them with their counts."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = vocabulary.get
        for batch in batches:
            sizes, held, terms, times, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column("text").cast(pa.large_binary())):
                if not text.is_valid:
                    continue
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts = Counter(map(find, words))
                counts.pop(None, None)
                own = sorted(counts)
                held.append(row)
                sizes.append(len(words))
                terms += own
                times += [counts[t] for t in own]
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(held, pa.int32())), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], ["doc_id", "n", "terms", "times"])

    return lambda batches: giving_back(of(batches))


def _holders(width: int):
    """(term, df) of a task."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(width, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=width)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.int32()), "df": pa.array(df[found], pa.int64())})

    return of


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class _Block:
    """Documents with their postings by term: for each term its documents, contributions and bitmap."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, n: int, length: int):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = table.column("doc_id")
        self.known = ids.is_valid().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        lists = table.column("terms").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        times = table.column("times").combine_chunks()
        times = times.chunk(0) if isinstance(times, pa.ChunkedArray) else times
        term, tf = lists.flatten().to_numpy(), times.flatten().to_numpy()
        size = table.column("n").to_numpy()
        if int(size.max(initial=0)) * n * LENGTH_SHARE < 2**63:
            m = 100 - LENGTH_SHARE + LENGTH_SHARE * size * n // length
        else:
            m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(s) * n // length for s in size], np.int64)
        doc = np.repeat(np.arange(len(size)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(term, kind="stable")  # by term, then by document
        term, doc, tf = term[order], doc[order], tf[order]
        self.adds = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        self.docs = doc
        self.at = np.searchsorted(term, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        present = np.flatnonzero(np.diff(self.at))
        self.most[present] = np.maximum.reduceat(self.adds, self.at[present]) if len(present) else 0
        self.words = -(-len(size) // 64)
        self.bitmaps = {}

    def __len__(self) -> int:
        return len(self.ids)

    def bitmap(self, term: int) -> np.ndarray:
        """One bit a document, set where it holds the term."""
        if term not in self.bitmaps:
            bits = np.zeros(self.words * 64, np.uint8)
            bits[self.docs[self.at[term]:self.at[term + 1]]] = 1
            self.bitmaps[term] = np.packbits(bits, bitorder="little")
        return self.bitmaps[term]

    def groups(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks over `terms` (as rows of 0 and 1), the documents ordered by mask, and where each mask's begin."""
        rows = np.array([self.bitmap(t) for t in terms])
        matched = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(rows, axis=0), bitorder="little"))
        bits = np.unpackbits(rows, axis=1, bitorder="little")[:, matched]
        parts = []
        for start in range(0, len(terms), 64):
            part = np.zeros(len(matched), np.uint64)
            for place, line in enumerate(bits[start:start + 64]):
                part |= line.astype(np.uint64) << np.uint64(place)
            parts.append(part)
        order = np.argsort(parts[0], kind="stable") if len(parts) == 1 else np.lexsort(parts)
        new = np.zeros(len(matched), bool)
        new[:1] = True
        for part in parts:
            held = part[order]
            new[1:] |= held[1:] != held[:-1]
        begins = np.flatnonzero(new)
        return bits[:, order[begins]].T, matched[order], np.append(begins, len(matched))

    def scores(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for term, n in zip(terms, times):
            start, end = self.at[term], self.at[term + 1]
            place = np.minimum(np.searchsorted(self.docs[start:end], docs), end - start - 1)
            out += np.where(self.docs[start + place] == docs, self.adds[start + place] * n, 0)
        return out


def _best(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best of (scores, known, ids): highest score, then documents with an id, then the smaller id."""
    scores, known, ids = found
    order = np.lexsort((ids, ~known, -scores))[:k]
    return scores[order], known[order], ids[order]


def _search(block: _Block, terms: np.ndarray, times: np.ndarray, found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """`found` with the documents of `block` that belong to the k best."""
    here = block.most[terms] > 0
    terms, times = terms[here], times[here]
    if not len(terms):
        return found
    most = block.most[terms] * times
    if len(found[0]) == k and most.sum() < found[0][-1]:
        return found
    masks, docs, begins = block.groups(terms)
    bounds = masks @ most
    order = np.argsort(-bounds, kind="stable")
    look = FIRST_LOOK
    while len(order):
        least = found[0][-1] if len(found[0]) == k else 1
        order = order[:np.searchsorted(-bounds[order], -least, side="right")]
        now, order = order[:look], order[look:]
        if len(now):
            own = np.concatenate([docs[begins[g]:begins[g + 1]] for g in now])
            scores = block.scores(own, terms, times)
            good = scores >= least
            found = _best(tuple(np.concatenate(x) for x in zip(found, (scores[good], block.known[own[good]], block.ids[own[good]]))), k)
        look *= 2
    return found


def _ranked(questions: Questions, weights: np.ndarray, n: int, length: int, k: int):
    """The k best documents of a task for every item, block after block."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        found, waiting, held = [none] * len(questions.ids), [], 0

        def searched():
            block = _Block(waiting, weights, n, length)
            return [_search(block, terms, times, f, k) for terms, times, f in zip(questions.terms, questions.times, found)]

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(start, BLOCK_DOCS)
                if held and held + part.num_rows > BLOCK_DOCS:
                    found, waiting, held = searched(), [], 0
                waiting.append(part)
                held += part.num_rows
        if held:
            found = searched()
        item = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        scores, known, ids = (np.concatenate([f[i] for f in found]) if found else none[i] for i in range(3))
        yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(ids, pa.int64(), mask=~known),
                                          "score": pa.array(scores, pa.int64())})

    return lambda batches: giving_back(of(batches))


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = written(items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct(), "items")
    kind = items.schema["item_id"].dataType.simpleString()
    size = items.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 64), F.lit(0))).first()[0]
    rounds = max(1, math.ceil(2 * size / ROUND_BYTES)) if size > ROUND_BYTES else 1
    answers = None
    for r in range(rounds):
        # at most about ROUND_BYTES of items: the query set, in blocks
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r).orderBy("item_id", "text").collect()
        answer = _round(spark, docs, Questions([(x["item_id"], x["text"]) for x in own]), k, kind)
        answers = answer if answers is None else answers.unionByName(answer)
    return answers


def _round(spark, docs: DataFrame, questions: Questions, k: int, kind: str) -> DataFrame:
    counted = written(docs.mapInArrow(_counted(questions.vocabulary), "doc_id long, n long, terms array<int>, times array<long>"), "counted")
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    width = len(questions.vocabulary)
    weights = np.zeros(width, np.int64)
    if width and total["n"]:
        for r in counted.select("terms").mapInArrow(_holders(width), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            weights[r["term"]] = weight(total["n"], r["df"])
    best = counted.mapInArrow(_ranked(questions, weights, total["n"], total["length"], k), "item int, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame(list(enumerate(questions.ids)), f"item int, item_id {kind}")
    return best.withColumn("rank", place).where(F.col("rank") <= k).join(names, "item").select("item_id", "rank", "doc_id", "score")
