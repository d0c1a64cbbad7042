"""Features of tokenised documents, as long tables and as Spark ML stages.

Documents enter as (doc_id, split, tokens). Terms are counted, weighed and scaled inside the row of their
document, so the corpus itself is never shuffled; only (term, count) partials are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, SQLTransformer,
)
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipescope.operators.ordering import digest_cutoffs
from pipescope.session import cut_lineage, in_small_batches

MAX_FEATURES = 100_000
BLOCK_BYTES = 64 * 2**20  # of word vectors that a task holds
WRONG_VECTOR = "a word vector has null entries or another width"
ROWS_AT_ONCE = 16_384  # word positions whose vectors are written out together
WORDS_AT_ONCE = 1_000_000  # words of whole documents whose terms are counted together


def _plain_counts(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """As `_term_numbers`, for words that are null or hold a space and so may look like a pair."""
    rows, terms, counts = [], [], []
    for row, listed in enumerate(tokens.to_pylist()):
        listed = listed or []
        found = Counter(listed)
        found.update([f"{a} {b}" for a, b in zip(listed, listed[1:])])
        rows += [row] * len(found)
        terms += found.keys()
        counts += found.values()
    coded = pa.array(terms, pa.string()).dictionary_encode("encode")
    of = coded.indices.to_numpy()
    order = np.argsort(of, kind="stable")
    return np.array(rows, np.int64)[order], of[order], coded.dictionary, np.array(counts, np.int64)[order]


def _coded(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    """(row, word number) of all words in order and the distinct words; None if a word is null or holds a space."""
    flat = tokens.flatten()
    coded = flat.dictionary_encode()
    if flat.null_count or pc.any(pc.match_substring(coded.dictionary, " ")).as_py():
        return None
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(tokens)), lengths), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _term_numbers(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(row, term number, terms, tf): the words and word pairs of each list with their counts, by term."""
    coded = _coded(tokens)
    if coded is None:
        return _plain_counts(tokens)
    row, code, words = coded
    n, rows = len(words), max(len(tokens), 1)
    same = np.flatnonzero(row[1:] == row[:-1])
    single, single_tf = np.unique(code * rows + row, return_counts=True)
    pair, pair_tf = np.unique((code[same] * n + code[same + 1]) * rows + row[same], return_counts=True)
    pair_of = pair // rows
    first = np.diff(pair_of, prepend=-1) != 0
    left, right = np.divmod(pair_of[first], max(n, 1))
    pairs = pc.binary_join_element_wise(words.take(pa.array(left)), words.take(pa.array(right)), " ")
    return (np.concatenate([single % rows, pair % rows]), np.concatenate([single // rows, n - 1 + np.cumsum(first)]),
            pa.concat_arrays([words, pairs]), np.concatenate([single_tf, pair_tf]))


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of documents in runs of whole rows, of about WORDS_AT_ONCE words."""
    lengths = pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // WORDS_AT_ONCE, prepend=0))
    for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if begin < end:
            yield batch.slice(begin, end - begin)


def _beside(docs: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], docs.schema["split"], T.StructField("term", T.StringType()), T.StructField(name, kind)])


def spread(docs: DataFrame) -> DataFrame:
    """Rows of fewer files than there are cores are dealt over the cores; a corpus of many files stays where it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if len(docs.inputFiles()) < cores else docs


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, split, term, tf) over words and word pairs, counted inside each row."""
    schema = _beside(docs, "tf", T.LongType())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                row, of, terms, tf = _term_numbers(part.column("tokens"))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("split").take(at), terms.take(pa.array(of)), pa.array(tf)], schema.names)

    return in_small_batches(spread(docs.select("doc_id", "split", "tokens"))).mapInArrow(counted, schema)


def _term_totals(docs: DataFrame) -> DataFrame:
    """(term, total, df) of all rows; the rows of a batch are added up before their terms leave Python."""
    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                _, of, terms, tf = _term_numbers(part.column("tokens"))
                if len(of):
                    first = np.flatnonzero(np.diff(of, prepend=-1))
                    df = np.diff(first, append=len(of))
                    yield pa.RecordBatch.from_arrays(
                        [terms.take(pa.array(of[first])), pa.array(np.add.reduceat(tf, first)), pa.array(df)], ["term", "total", "df"])

    counted = in_small_batches(spread(docs.select("tokens"))).mapInArrow(added, "term string, total long, df long")
    return counted.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def fit_terms(docs: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, total, df): the most frequent terms of the train split (ties by digest of the term).

    The number of terms per total (a short table) tells the total at which `max_features` is reached; terms above
    it are a filter, and of those at it the first by digest are found from the leading digits of the digests.
    """
    totals = cut_lineage(_term_totals(docs.where(F.col("split") == "train")))
    sizes = totals.groupBy("total").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("total")).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    edge = placed.where((F.col("_above") < max_features) & (F.col("_above") + F.col("_n") > max_features)).first()
    if edge is None:
        return totals
    tied = totals.where(F.col("total") == edge["total"]).withColumn("_d", F.md5("term"))
    cut = digest_cutoffs(tied.select("_d"), [], "_d", F.lit(max_features - edge["_above"]))
    first = tied.where(F.col("_d") <= cut.select(F.max("cutoff")).scalar()).drop("_d")
    return totals.where(F.col("total") > edge["total"]).unionByName(first)


def bag_of_words(docs: DataFrame, terms: DataFrame, binary: bool = False) -> DataFrame:
    """(doc_id, split, term, tf) restricted to the fitted terms, which `max_features` bounds."""
    counts = term_counts(docs).join(F.broadcast(terms.select("term")), "term", "left_semi")
    return counts.withColumn("tf", F.lit(1).cast("long")) if binary else counts


class _Fitted:
    """Fitted terms, looked up by the numbers of their words."""

    def __init__(self, idf: dict[str | None, float]):
        self.idf, named = idf, {t: t.split(" ") for t in idf if t is not None}
        self.terms = pa.array(list(named), pa.string())
        self.weights = np.array([idf[t] for t in named], np.float64)
        # of more than two words are only terms of words that hold spaces themselves
        places = {len_: [i for i, w in enumerate(named.values()) if len(w) == len_] for len_ in (1, 2)}
        split = list(named.values())
        self.words = pa.array(sorted({w for k in (1, 2) for i in places[k] for w in split[i]}), pa.string())
        number = {w: i for i, w in enumerate(self.words.to_pylist())}
        self.single = np.full(len(number) + 1, -1, np.int64)  # the last stands for unknown words
        for i in places[1]:
            self.single[number[split[i][0]]] = i
        pairs = np.array([number[split[i][0]] * len(number) + number[split[i][1]] for i in places[2]], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_term = pairs[order], np.array(places[2], np.int64)[order]

    def found(self, tokens: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """(row, term, tf * idf) of the fitted terms of each list, by row."""
        coded = _coded(tokens)
        if coded is None:
            row, of, terms, tf = _plain_counts(tokens)
            known = np.array([self.idf.get(t, np.nan) for t in terms.to_pylist()], np.float64)[of]
            keep = np.flatnonzero(~np.isnan(known))
            keep = keep[np.argsort(row[keep], kind="stable")]
            return row[keep], terms.take(pa.array(of[keep])), tf[keep] * known[keep]
        row, code, words = coded
        n = len(self.words)
        number = pc.fill_null(pc.index_in(words, value_set=self.words), n).to_numpy().astype(np.int64)[code]
        single = self.single[number]
        held = single >= 0
        at = np.flatnonzero((row[1:] == row[:-1]) & (number[1:] < n) & (number[:-1] < n)) if len(self.pairs) else np.zeros(0, np.int64)
        wanted = number[at] * n + number[at + 1]
        place = np.minimum(np.searchsorted(self.pairs, wanted), max(len(self.pairs) - 1, 0))
        hit = self.pairs[place] == wanted if len(at) else np.zeros(0, bool)
        size = max(len(self.terms), 1)
        keys = np.concatenate([row[held] * size + single[held], row[at[hit]] * size + self.pair_term[place[hit]]])
        keys, tf = np.unique(keys, return_counts=True)
        of = keys % size
        return keys // size, self.terms.take(pa.array(of)), tf * self.weights[of]


def tf_idf(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, split, term, weight): tf * (ln((1+n)/(1+df)) + 1), each document scaled to unit length.

    A document's terms are weighed and scaled inside its row, with the fitted terms (at most `max_features`)
    sent to every task.
    """
    n = docs.where(F.col("split") == "train").count()
    fitted = {r["term"]: math.log((1 + n) / (1 + r["df"])) + 1 for r in terms.select("term", "df").collect()}
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    schema = _beside(docs, "weight", T.DoubleType())

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Fitted(shared.value)
        for batch in batches:
            for part in _parts(batch):
                row, names, weights = known.found(part.column("tokens"))
                if not len(row):
                    continue
                first = np.flatnonzero(np.diff(row, prepend=-1))
                squares, ends = (weights * weights).tolist(), [*first[1:].tolist(), len(row)]
                norms = np.array([math.sqrt(math.fsum(squares[b:e])) for b, e in zip(first.tolist(), ends)])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("split").take(at), names,
                     pa.array(weights / np.repeat(norms, np.diff(first, append=len(row))))], schema.names)

    return in_small_batches(spread(docs.select("doc_id", "split", "tokens"))).mapInArrow(weighed, schema)


# --- pooled vectors --------------------------------------------------------------------------------


def unit(vec: Column) -> Column:
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


class _Block:
    """The vectors of a block of words, beside which batches of documents are read."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        words = rows.column("token").combine_chunks().dictionary_encode()
        self.words, codes = words.dictionary, words.indices.to_numpy()
        # a word may have several vectors: they lie side by side
        order = np.argsort(codes, kind="stable")
        self.vectors = rows.column("vec").combine_chunks().take(pa.array(order))
        self.sizes = np.bincount(codes, minlength=len(self.words))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def found(self, documents: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, position, vector) numbers of the known words of some documents, in order."""
        tokens, positions = documents.column("tokens"), documents.column("places").flatten().to_numpy()
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.words, skip_nulls=True), -1).to_numpy()
        places = np.flatnonzero(codes >= 0)
        known = codes[places]
        document = np.repeat(np.arange(len(lengths)), lengths)[places]
        position = positions[places]
        times = self.sizes[known]
        ends = np.cumsum(times)
        nth = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - times, times)
        return np.repeat(document, times), np.repeat(position, times), np.repeat(self.starts[known], times) + nth


def _beside_vectors(
    docs: DataFrame, vectors: DataFrame, use: Callable[[_Block, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType,
) -> DataFrame:
    """`use(block, documents)` of every share of the documents with every block of the word vectors.

    Words are dealt into blocks of at most BLOCK_BYTES of vectors and documents into shares, as many as fill the
    shuffle partitions. A task reads the vectors of its block and then the batches of its share, one after the
    other: a word moves once, a vector once per share, and no vector travels with a word. Documents have columns
    doc_id, tokens and places: their words of the block and where they stood.
    """
    spark = docs.sparkSession
    known = cut_lineage(vectors.where("token is not null").select("token", "vec"))
    held = known.agg(F.sum(8 * F.coalesce(F.size("vec"), F.lit(0)) + F.octet_length("token")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, math.ceil(held / BLOCK_BYTES))
    shares = math.ceil(int(spark.conf.get("spark.sql.shuffle.partitions")) / blocks)
    block_of = lambda word: F.pmod(F.xxhash64(word), F.lit(blocks)) if blocks > 1 else F.lit(0).cast("long")
    task = (F.col("_block") * shares + F.col("_share")).cast("int").alias("_task")
    dealt = known.withColumn("_block", block_of("token")).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    vector_rows = dealt.select(
        task, F.lit(False).alias("_text"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.lit(None).cast("array<string>").alias("tokens"), F.lit(None).cast("array<int>").alias("places"), "token", "vec")
    placed = docs.select("doc_id", "tokens", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(shares)).alias("_share"))
    numbered = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), i.alias("place")))
    placed = placed.withColumn("_words", numbered).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if blocks > 1:
        placed = placed.withColumn("_words", F.filter("_words", lambda w: block_of(w["token"]) == F.col("_block")))
    text_rows = placed.select(
        task, F.lit(True).alias("_text"), "doc_id", "_words.token", "_words.place").toDF("_task", "_text", "doc_id", "tokens", "places")
    text_rows = text_rows.withColumns({"token": F.lit(None).cast("string"), "vec": F.lit(None).cast(known.schema["vec"].dataType)})
    union = vector_rows.unionByName(text_rows).repartitionById(blocks * shares, "_task").sortWithinPartitions("_text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            first = batch.num_rows - (pc.sum(batch.column("_text")).as_py() or 0)
            if first:
                held.append(batch.slice(0, first).select(["token", "vec"]))
            if first < batch.num_rows and (block or held):
                block = block or _Block(held)
                yield from use(block, batch.slice(first))

    return in_small_batches(union).mapInArrow(read, schema)


def _sums(vec: str, width: int) -> list[Column]:
    """One sum per dimension: plain numbers, which are added up in a hash table without ordering the rows.

    Null vectors are left out, null or missing entries of a vector are an error.
    """
    wrong = F.when(F.col(vec).isNotNull(), F.raise_error(F.lit(WRONG_VECTOR)).cast("double"))
    return [F.sum(F.coalesce(F.get(vec, F.lit(i)).cast("double"), wrong)).alias(f"_{i}") for i in range(width)]


def mean_vectors(docs: DataFrame, vectors: DataFrame, width: int, normalise: bool = True) -> DataFrame:
    """(doc_id, features): mean of the known words' vectors, unit-scaled first unless told otherwise.

    The vectors of a document's words are added up where its words meet them; null vectors are left out. Documents
    without a known word get zeros.
    """
    scaled = unit(F.col("vec")) if normalise else F.transform("vec", lambda x: x.cast("double"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])

    def pooled(block: _Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        document, _, vector = block.found(batch)
        entries = block.vectors.flatten()
        if entries.null_count or len(entries) != len(block.vectors) * width:
            raise ValueError(WRONG_VECTOR)
        matrix = entries.to_numpy().reshape(-1, width)
        sums = np.zeros((batch.num_rows, width))
        for begin in range(0, len(vector), ROWS_AT_ONCE):
            of = document[begin:begin + ROWS_AT_ONCE]
            edges = np.flatnonzero(np.diff(of, prepend=-1))
            sums[of[edges]] += np.add.reduceat(matrix[vector[begin:begin + ROWS_AT_ONCE]], edges, axis=0)
        n = np.bincount(document, minlength=batch.num_rows)
        some = np.flatnonzero(n)
        ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(some)), pa.ListArray.from_arrays(ends, pa.array(sums[some].ravel())), pa.array(n[some])],
            ["doc_id", "vec", "n"])

    added = _beside_vectors(docs, vectors.select("token", scaled.alias("vec")).where("vec is not null"), pooled, schema)
    total = added.groupBy("doc_id").agg(*_sums("vec", width), F.sum("n").alias("_n"))
    means = total.select("doc_id", F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(width)]).alias("features"))
    return _every_document(docs, means, width)


def token_vector_rows(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, pos, vec): one row per known word position, as an encoder would output."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("pos", T.IntegerType()), vectors.schema["vec"]])

    def rows(block: _Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        document, position, vector = block.found(batch)
        for begin in range(0, len(vector), ROWS_AT_ONCE):
            part = slice(begin, begin + ROWS_AT_ONCE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(document[part])), pa.array(position[part].astype(np.int32)),
                 block.vectors.take(pa.array(vector[part]))], ["doc_id", "pos", "vec"])

    return _beside_vectors(docs, vectors, rows, schema)


def _every_document(docs: DataFrame, pooled: DataFrame, width: int) -> DataFrame:
    """(doc_id, features) of all documents: zeros for those without a known token."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return docs.select("doc_id").join(pooled, "doc_id", "left").select("doc_id", F.coalesce("features", zeros).alias("features"))


def _first_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the row of every document with the smallest position."""
    for batch in batches:
        codes = pc.fill_null(batch.column("doc_id").dictionary_encode().indices, -1).to_numpy()
        positions = pc.fill_null(batch.column("pos").cast(pa.int64()), np.iinfo(np.int64).max).to_numpy()
        order = np.lexsort((positions, codes))
        yield batch.take(pa.array(order[np.flatnonzero(np.diff(codes[order], prepend=-2))]))


def first_vector(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, features) of every document: the vector at the first position of `rows`.

    All but the first rows of a batch are left out before anything is ordered.
    """
    some = rows.select("doc_id", "pos", "vec")
    firsts = some.mapInArrow(_first_of_batches, some.schema)
    pooled = firsts.groupBy("doc_id").agg(F.transform(F.min_by("vec", "pos"), lambda x: x.cast("double")).alias("features"))
    return _every_document(docs, pooled, width)


def mean_position_vector(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(doc_id, features) of every document: mean over its positions in `rows` (padding never enters)."""
    total = rows.groupBy("doc_id").agg(*_sums("vec", width), F.count("vec").alias("_n"))
    means = total.where("_n > 0").select("doc_id", F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(width)]).alias("features"))
    return _every_document(docs, means, width)


def batched_features(
    docs: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str, width: int,
    batch_size: int = 100, out: str = "features",
) -> DataFrame:
    """Apply a user model to batches of `width`-number inputs; it is built once per Python worker."""
    run = predict_batch_udf(
        make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[width]]
    )
    return docs.withColumn(out, run(column))


# --- Spark ML stages -------------------------------------------------------------------------------


def _bow_stages(max_features: int, binary: bool, out: str) -> list:
    return [
        NGram(n=2, inputCol="tokens", outputCol="_bigrams"),
        SQLTransformer(statement="SELECT *, concat(tokens, _bigrams) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol=out, vocabSize=max_features, minDF=1.0, binary=binary),
    ]


def bow_estimator(max_features: int = MAX_FEATURES, binary: bool = False, out: str = "features") -> Pipeline:
    return Pipeline(stages=_bow_stages(max_features, binary, out))


def fit_tf_idf(train: DataFrame, max_features: int = MAX_FEATURES, out: str = "features"):
    """A fitted transformer chain for smoothed, unit-length TF-IDF.

    Spark's IDF lacks the `+ 1`; scaling raw counts by (idf + 1) adds it without leaving sparse vectors.
    """
    from pyspark.ml import PipelineModel

    counts = Pipeline(stages=_bow_stages(max_features, False, "_tf")).fit(train)
    idf = IDF(inputCol="_tf", outputCol="_unused").fit(counts.transform(train))
    scale = ElementwiseProduct(scalingVec=_plus_one(idf.idf), inputCol="_tf", outputCol="_scaled")
    return PipelineModel([*counts.stages, scale, Normalizer(p=2.0, inputCol="_scaled", outputCol=out)])


def _plus_one(vector):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(vector.toArray() + 1.0)
