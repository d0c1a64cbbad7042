"""Token-to-value work done once per distinct word and joined back to the corpus.

A lexicon or vocabulary of up to SENT_BYTES is sent to the tasks, which look the words of a document up inside its
row: no word is moved. A larger one meets the words in a join, which adaptive execution splits at frequent words;
documents are told apart by a row number of their own there, so rows that repeat a key keep their own texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipescope.functions.stemming import stem_texts
from pipescope.functions.text import CLOSED_CLASSES, piece_word, pieces, whitespace_tokens
from pipescope.session import cut_lineage, in_small_batches

CHECKPOINT_EVERY = 10
RANKED_PAIRS = 64
KNOWN_WORDS = 200_000  # distinct words a task remembers the pieces of
SENT_BYTES = 16 << 20  # of a lexicon or vocabulary that is sent to the tasks
SYMBOL_EDGE = "\ue000"  # private-use mark around each symbol of a segmented word
WORD_START = "Ġ"
LONGEST_WORD = 100  # characters; longer words are unknown to a word-piece vocabulary
# Code points of Chinese characters, which are words of their own.
CJK_RANGES = [
    (0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F),
]


def distinct_words(docs: DataFrame, words: Column) -> DataFrame:
    """(token, n) of a column of word lists."""
    return docs.select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def look_up(words: DataFrame, mapping: DataFrame, how: str = "left") -> DataFrame:
    """Join on `token`."""
    return words.join(mapping, "token", how)


def _placed(docs: DataFrame, rest: Sequence[str], listed: Column, name: str) -> DataFrame:
    """(_row, _rest, pos, name): the elements of a list per row of `docs`, at least one row each.

    The columns `rest` ride along once per document, with its first element.
    """
    columns = F.struct(*rest) if rest else F.struct(F.lit(None).cast("string").alias("_none"))
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = numbered.select("_row", columns.alias("_rest"), F.posexplode_outer(listed).alias("pos", name))
    return rows.withColumn("_rest", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("_rest")))


def piece_rows(docs: DataFrame, text: str) -> DataFrame:
    """(_row, _rest, pos, token, space): words with the white space that follows them."""
    rows = _placed(docs, [c for c in docs.columns if c != text], pieces(text), "_piece")
    word = piece_word(F.col("_piece"))
    return rows.select(
        "_row", "_rest", "pos", word.alias("token"), F.substring("_piece", F.length(word) + 1, F.length("_piece")).alias("space")
    )


def gather(rows: DataFrame, value: Column, keep: Column | None = None) -> DataFrame:
    """The columns that rode along and `values`, those of a document in order; rows not kept are left out."""
    present = F.col("pos").isNotNull() if keep is None else F.col("pos").isNotNull() & keep
    listed = F.collect_list(F.when(present, F.struct("pos", value.alias("value"))))
    gathered = rows.groupBy("_row").agg(
        F.first("_rest", ignorenulls=True).alias("_rest"),
        F.transform(F.array_sort(listed), lambda r: r["value"]).alias("values"))
    return gathered.select("_rest.*", "values").drop("_none")


def stem_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with every word stemmed and single spaces between words; no row is moved."""
    return in_small_batches(docs).withColumn(text, stem_texts(F.coalesce(F.col(text), F.lit(""))))


def sent_table(table: DataFrame, key: str) -> list | None:
    """The rows of a table for the tasks, by their counted size; None if it is too large to be sent."""
    known = cut_lineage(table)
    size = known.agg(F.sum(F.octet_length(key) + sum(
        F.coalesce(F.octet_length(F.concat_ws("", c)), F.lit(0)) + 16 for c in known.columns if c != key)).alias("n")).first()["n"] or 0
    return known.collect() if size <= SENT_BYTES else None


def rewritten(docs: DataFrame, text: str, values: dict[str, list[str]]) -> DataFrame:
    """`docs` with every word that `values` has replaced by its values, each with the white space that follows the word."""
    shared = docs.sparkSession.sparkContext.broadcast(values)

    @F.arrow_udf(T.StringType())
    def written(lists: pa.Array) -> pa.Array:
        found = lists.flatten().dictionary_encode()
        changed = []
        for piece in found.dictionary.to_pylist():
            word = piece.rstrip()
            new = shared.value.get(word)
            changed.append(piece if new is None else "".join(sorted(v + piece[len(word):] for v in new)))
        ends = np.append(0, np.cumsum(pc.list_value_length(lists)))
        out = pa.array(changed, pa.string()).take(found.indices)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), out), "")

    listed = F.coalesce(pieces(text), F.array().cast("array<string>"))
    return in_small_batches(docs).withColumn(text, written(listed))


def lemmatise_text(docs: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with words replaced by the `lemma` of a (token, lemma) table; spacing stays."""
    lemmas = lexicon.where("token is not null").groupBy("token").agg(F.collect_list(F.coalesce("lemma", "token")).alias("lemmas"))
    sent = sent_table(lemmas, "token")
    if sent is not None:
        return rewritten(docs, text, {r["token"]: r["lemmas"] for r in sent})
    rows = look_up(piece_rows(docs, text), lexicon.select("token", "lemma"))
    out = gather(rows, F.concat(F.coalesce("lemma", "token"), "space"))
    return out.withColumn(text, F.array_join("values", "")).select(*docs.columns)


def drop_closed_class(
    docs: DataFrame, lexicon: DataFrame, text: str = "text", classes: Sequence[str] = tuple(CLOSED_CLASSES),
) -> DataFrame:
    """`docs` without the words a (token, pos_tag) table puts in a closed class."""
    keep = F.coalesce(~F.col("pos_tag").isin(list(classes)), F.lit(True))
    # a word stays once for each of its open classes; those that stay once need not be listed
    times = lexicon.where("token is not null").groupBy("token").agg(F.count_if(keep).alias("times")).where("times <> 1")
    sent = sent_table(times, "token")
    if sent is not None:
        return rewritten(docs, text, {r["token"]: [r["token"]] * r["times"] for r in sent})
    rows = look_up(piece_rows(docs, text), lexicon.select("token", "pos_tag"))
    out = gather(rows, F.concat("token", "space"), keep)
    return out.withColumn(text, F.array_join("values", "")).select(*docs.columns)


# --- byte-pair merges ------------------------------------------------------------------------------


def _symbols(segmented: Column) -> Column:
    inner = F.substring(segmented, F.lit(2), F.length(segmented) - 2)
    return F.split(inner, SYMBOL_EDGE * 2)


def _edged(symbol: Column | str) -> Column:
    edge = F.lit(SYMBOL_EDGE)
    return F.concat(edge, F.lit(symbol) if isinstance(symbol, str) else symbol, edge)


def spelled(word: Column) -> Column:
    """A word as a chain of one-character symbols, each between edge marks."""
    letters = F.split(word, "")
    return F.array_join(F.transform(letters, _edged), "")


def pair_counts(words: DataFrame) -> DataFrame:
    """(left, right, n) over neighbouring symbols of a (segmented, n) table; `n` may be negative."""
    symbols = words.select(_symbols(F.col("segmented")).alias("s"), "n").where(F.size("s") > 1)
    n = F.size("s") - 1
    pairs = F.zip_with(
        F.slice("s", F.lit(1), n), F.slice("s", F.lit(2), n),
        lambda left, right: F.struct(left.alias("left"), right.alias("right")),
    )
    return symbols.select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))


def merge_pair(segmented: Column, left: str, right: str) -> Column:
    return F.replace(segmented, F.concat(_edged(left), _edged(right)), _edged(left + right))


def merge_batch(top: Sequence[tuple[str, str, int]], complete: bool) -> list[tuple[str, str, int]]:
    """The first pairs of a ranking that merging one after the other would choose next, in this order.

    Pairs that share no symbol leave each other's counts alone. A pair that a merge creates is at most as frequent
    as the pair it replaces, which shares a symbol with the merged one: so everything that is more frequent than
    the first pair with a shared symbol (or than what the ranking leaves out, if it is not `complete`) comes first.
    """
    batch, used, limit = [], set(), 0 if complete else top[-1][2]
    for left, right, n in top:
        if used & {left, right}:
            limit = n
            break
        used |= {left, right}
        batch.append((left, right, n))
    return batch[:1] + [p for p in batch[1:] if p[2] > limit]


def learn_merges(words: DataFrame, rounds: int) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """Byte-pair merges of a (token, n) table and the segmented words.

    A merge takes the most frequent pair of neighbouring symbols (ties by symbol); merges that cannot affect each
    other are done in one job, and only the head of the ranking comes back to the driver. Pair counts are kept as
    a table: a job subtracts the pairs of the words it changes and adds their new ones, so all words are counted
    only once.
    """
    spelled_out = words.select("token", "n", spelled(F.concat(F.lit(WORD_START), "token")).alias("segmented"))
    current = cut_lineage(spelled_out.repartition("token"))
    counts = cut_lineage(pair_counts(current))
    merges: list[tuple[str, str, int]] = []
    jobs = 0
    while len(merges) < rounds:
        top = [tuple(r) for r in counts.orderBy(F.desc("n"), "left", "right").limit(RANKED_PAIRS).select("left", "right", "n").collect()]
        if not top:
            break
        batch = merge_batch(top, len(top) < RANKED_PAIRS)[:rounds - len(merges)]
        merges += batch
        merged, hit = F.col("segmented"), F.lit(False)
        for left, right, _ in batch:
            merged = merge_pair(merged, left, right)
            hit = hit | F.contains("segmented", F.concat(_edged(left), _edged(right)))
        both = F.explode(F.array(
            F.struct(F.col("segmented"), (-F.col("n")).alias("n")), F.struct(merged.alias("segmented"), F.col("n"))
        ))
        delta = pair_counts(current.where(hit).select(both.alias("w")).select("w.*"))
        counts = cut_lineage(
            counts.union(delta).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0")
        )
        current, jobs = current.withColumn("segmented", merged), jobs + 1
        if jobs % CHECKPOINT_EVERY == 0:
            current = cut_lineage(current)
    return merges, current.select("token", _symbols(F.col("segmented")).alias("pieces"))


def split_words(docs: DataFrame, pieces_of: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `tokens`: every word replaced by the pieces a (token, pieces) table gives it."""
    rest = [c for c in docs.columns if c != "tokens"]
    rows = look_up(_placed(docs, rest, whitespace_tokens(text), "token"), pieces_of)
    return gather(rows, F.col("pieces")).select(*rest, F.flatten("values").alias("tokens"))


def bpe_tokens(docs: DataFrame, rounds: int, text: str = "text", train: Column | None = None) -> DataFrame:
    """Learn merges on the corpus, or on its rows where `train` holds, and apply them to all of it.

    The merges are sent to the tasks and applied inside the row of a document: no word of it is moved.
    """
    fitted = docs if train is None else docs.where(train)
    merges, _ = learn_merges(distinct_words(fitted, whitespace_tokens(text)), rounds)
    merged = merged_words([(left, right) for left, right, _ in merges])
    words = F.coalesce(whitespace_tokens(text), F.array().cast("array<string>"))
    rest = [c for c in docs.columns if c != "tokens"]
    return in_small_batches(docs).select(*rest, merged(words).alias("tokens"))


def merged_words(merges: Sequence[tuple[str, str]]):
    """A column function of word lists: the pieces of all words under `merges`, in their order.

    Each distinct word of a task is cut once.
    """
    edge = SYMBOL_EDGE
    pairs = [(f"{edge}{a}{edge}{edge}{b}{edge}", f"{edge}{a}{b}{edge}") for a, b in merges]

    def one(token: str) -> list[str]:
        chain = "".join(f"{edge}{c}{edge}" for c in WORD_START + token)
        for pair, merged in pairs:
            if pair in chain:
                chain = chain.replace(pair, merged)
        return chain[1:-1].split(edge * 2)

    return pieces_inside(lambda: one)


def pieces_inside(make: Callable[[], Callable[[str], list[str]]]):
    """A column function of word lists: what the function that `make` gives in a task makes of each word, in order."""
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one, known = make(), {}
        for batch in batches:
            if len(known) > KNOWN_WORDS:
                known.clear()
            words = batch.flatten().dictionary_encode()
            distinct = words.dictionary.to_pylist()
            known.update((word, one(word)) for word in distinct if word not in known)
            pieces = pa.array([known[word] for word in distinct], pa.list_(pa.string())).take(words.indices)
            upto = np.append(0, np.cumsum(pc.list_value_length(pieces)))
            ends = np.append(0, np.cumsum(pc.list_value_length(batch)))
            yield pa.ListArray.from_arrays(pa.array(upto[ends].astype(np.int32)), pieces.flatten())

    return cut


def apply_merges(words: DataFrame, merges: Sequence[tuple[str, str]]) -> DataFrame:
    """(token, pieces) of any words under merges learnt elsewhere, in their order."""
    return words.select("token", merged_words(merges)(F.array("token")).alias("pieces"))


# --- word pieces -----------------------------------------------------------------------------------


def wordpiece_vocabulary(words: DataFrame, frequent: int) -> DataFrame:
    """(piece): the most frequent lowercased words, every character, and its continuation form."""
    top = words.orderBy(F.desc("n"), "token").limit(frequent).select(F.col("token").alias("piece"))
    letters = words.select(F.explode(F.array_distinct(F.split("token", ""))).alias("c")).distinct()
    marked = letters.select(F.explode(F.array(F.col("c"), F.concat(F.lit("##"), "c"))).alias("piece"))
    return top.union(marked).distinct()


def _basic_words(word: str) -> list[str]:
    """Lowercased, accents and control characters stripped; punctuation and Chinese characters are words of
    their own."""
    plain = "".join(c for c in unicodedata.normalize("NFD", word.lower())
                    if unicodedata.category(c) not in ("Mn", "Cc", "Cf", "Co", "Cs") and c != "\ufffd")
    out, run = [], ""
    for c in plain:
        alone = (unicodedata.category(c).startswith("P") or (ord(c) < 128 and not c.isalnum())
                 or any(low <= ord(c) <= high for low, high in CJK_RANGES))
        if alone:
            out += [run, c]
            run = ""
        else:
            run += c
    return [w for w in [*out, run] if w]


@F.pandas_udf(T.ArrayType(T.StringType()))
def basic_words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(_basic_words)


def longest_pieces(words: DataFrame, vocabulary: DataFrame, unknown: str = "[UNK]", longest: int = LONGEST_WORD) -> DataFrame:
    """(word, pieces) of distinct words: greedy longest match in a (piece) table.

    All parts of a word that might be pieces meet the vocabulary in a join, so its size does not matter. The
    longest piece from each place on is kept, and the word is walked from piece to piece. Words beyond
    `longest` characters, and words with a place no piece fits, are unknown.
    """
    short = words.where(F.length("word") <= longest)
    starts = short.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("_s"))
    parts = starts.select("word", "_s", F.explode(F.sequence(F.col("_s"), F.length("word"))).alias("_e"))
    spelled_out = F.concat(F.when(F.col("_s") > 1, "##").otherwise(""), F.expr("substring(word, _s, _e - _s + 1)"))
    known = parts.withColumn("piece", spelled_out).join(vocabulary.select("piece").distinct(), "piece", "left_semi")
    ends = known.groupBy("word", "_s").agg(F.max("_e").alias("_e")).groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("_s", "_e"))).alias("_ends"))
    walked = F.expr("""aggregate(sequence(1, length(word)), named_struct('at', 1, 'out', array()),
      (acc, i) -> if(i <> acc.at, acc, named_struct(
        'at', coalesce(_ends[i] + 1, -1),
        'out', if(_ends[i] is null, acc.out, concat(acc.out, array(
          concat(if(i > 1, '##', ''), substring(word, i, _ends[i] - i + 1))))))))""".replace(
            "'out', array())", "'out', cast(array() as array<string>))"))
    cut = ends.withColumn("_walk", walked)
    pieces = F.when(F.col("_walk.at") == F.length("word") + 1, F.col("_walk.out"))
    return words.join(cut.select("word", pieces.alias("_pieces")), "word", "left").select(
        "word", F.coalesce("_pieces", F.array(F.lit(unknown))).alias("pieces"))


def wordpiece_of(words: DataFrame, vocabulary: DataFrame, unknown: str = "[UNK]") -> DataFrame:
    """(token, pieces) for a table of distinct words."""
    rows = words.select("token", F.posexplode_outer(basic_words("token")).alias("_i", "word"))
    cut = longest_pieces(rows.where("word is not null").select("word").distinct(), vocabulary, unknown)
    listed = F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "pieces"))))
    return rows.join(cut, "word", "left").groupBy("token").agg(
        F.flatten(F.transform(listed, lambda r: r["pieces"])).alias("pieces"))


def cut_words(vocabulary: Sequence[str], unknown: str = "[UNK]", longest: int = LONGEST_WORD):
    """A column function of word lists: the word pieces of all words, as `wordpiece_of` gives them."""
    shared = SparkContext._active_spark_context.broadcast(frozenset(vocabulary))

    def make():
        known = shared.value
        most = max(map(len, known), default=0)

        def pieces_of(word: str) -> list[str]:
            if len(word) > longest:
                return [unknown]
            out, at = [], 0
            while at < len(word):
                mark = "##" if at else ""
                end = min(len(word), at + most)
                while end > at and mark + word[at:end] not in known:
                    end -= 1
                if end == at:
                    return [unknown]
                out.append(mark + word[at:end])
                at = end
            return out

        return lambda token: [p for word in _basic_words(token) for p in pieces_of(word)]

    return pieces_inside(make)


def wordpiece_tokens(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `tokens`."""
    sent = sent_table(vocabulary.select("piece").where("piece is not null").distinct(), "piece")
    if sent is not None:
        cut = cut_words([r["piece"] for r in sent])
        rest = [c for c in docs.columns if c != "tokens"]
        words = F.coalesce(whitespace_tokens(text), F.array().cast("array<string>"))
        return in_small_batches(docs).select(*rest, cut(words).alias("tokens"))
    words = distinct_words(docs, whitespace_tokens(text)).select("token")
    return split_words(docs, wordpiece_of(words, vocabulary), text)


def characters(docs: DataFrame, text: str = "text") -> DataFrame:
    """(char, docs): the distinct characters and in how many documents each occurs.

    A document contributes each of its characters once, before anything is shuffled.
    """
    seen = F.explode(F.array_distinct(F.split(text, ""))).alias("char")
    return docs.select(seen).where("char <> ''").groupBy("char").agg(F.count(F.lit(1)).alias("docs"))
