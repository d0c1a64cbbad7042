import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pipescope.llm import edits, huffman, pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", " a", "a ", "  a  b ", "a\n b", "a \n\n b\t\tc", "x  y", "it's we'll  'd", "<|endoftext|> a<|endoftext|>", "漢字 é  z", "\n", " ",
       "tab\there 12 345,67!! ##\r\n\r\n next", "a\x1c b", "end.\n Next", "a\u0085 b"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def sample_texts(spark, small, n=60):
    return [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(n).collect()]


def test_pieces_give_the_ids_of_whole_texts(spark, small, tokenizer):
    texts = ODD + sample_texts(spark, small) + ["".join(random.Random(i).choices("ab \n\t.,'s1é", k=60)) for i in range(300)]
    encoder = pieces.PieceEncoder(pieces.tokenizer_text(PATH))
    ids, sizes = encoder.ids(texts)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]
    assert [c.sum() for c in encoder.token_counts(texts)] == list(map(len, want))
    assert all(len(c) == len(edits.cut(t)) for c, t in zip(encoder.token_counts(texts), texts))


def test_code_lengths_are_optimal_and_limited():
    import heapq

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 300):
        counts = rng.integers(1, 1000, n)
        heap, cost = counts.tolist(), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            cost += (pair := heapq.heappop(heap) + heapq.heappop(heap))
            heapq.heappush(heap, pair)
        assert int((huffman.code_lengths(counts, 30) * counts).sum()) == (cost or counts[0])
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    limited = huffman.code_lengths(fib, 5)
    assert limited.max() <= 5 and sum(2.0 ** -int(x) for x in limited) <= 1
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(9, int), 3)


def test_files_give_the_ids_back(spark, frame, tokenizer, small, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK", 2 * huffman.LANE)
    texts = ODD + [None] + sample_texts(spark, small)
    rows = [(1000 - 3 * i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "no id", "", "", 0), (5, "b", "", "", 0), (5, "a", "", "", 0)]
    rows.append((2, "long " + "word " * 70_000, "", "", 0))
    docs = frame(rows).withColumn("start", F.lit("clash"))
    manifest = huffman.write_ids(docs.repartition(5), PATH)
    back = huffman.token_ids(manifest).orderBy("start").collect()
    assert [r.start for r in back] == [0, *np.cumsum([len(r.ids) for r in back])[:-1].tolist()]
    assert [r.doc_id for r in back] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    want = sorted((str(r[0]), tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in back) == want
    crc = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in huffman.digests(manifest).collect()}
    assert crc == {(r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in back}


def test_empty_table_has_no_ids(frame):
    assert huffman.digests(huffman.write_ids(frame([]), PATH)).count() == 0


def test_counts_follow_random_edits(spark, small, tokenizer):
    encoder = pieces.PieceEncoder(pieces.tokenizer_text(PATH))
    rng = random.Random(4)
    for text in ODD + sample_texts(spark, small, 25):
        document = edits.EditedDocument(encoder, text)
        plain = text
        for _ in range(12):
            start, length = rng.randint(0, len(plain) + 3), rng.choice([0, 1, 5, 40, 4000])
            new = rng.choice(["", " ", "  ", "\n", "word", " two words ", "x" * 50, " ".join("many" for _ in range(900))])
            document.edit(start, length, new)
            plain = plain[:start] + new + plain[start + length:]
            assert document.text() == plain
            assert document.tokens == len(tokenizer.encode(plain, add_special_tokens=False).ids), plain[:80]


def test_edited_counts_of_a_table(spark, frame, tokenizer):
    rows = [(1, "one two three", "", "", 0), (2, None, "", "", 0), (3, "", "", "", 0), (1, "one two three", "", "", 0), (None, "x y", "", "", 0)]
    changes = spark.createDataFrame([(1, 2, 0, 3, "four five"), (1, 1, 13, 99, " end"), (2, 1, None, None, None), (3, 1, 5, 5, "new")],
                                    "doc_id long, seq int, start long, length long, replacement string")
    got = edits.edited_counts(edits.with_edits(frame(rows), changes), PATH).collect()
    after = {1: "four five two three end", 2: "", 3: "new", None: "x y"}
    assert sorted((str(r.doc_id), r.tokens_after, r.chars_after) for r in got) == sorted(
        (str(r[0]), len(tokenizer.encode(after[r[0]], add_special_tokens=False).ids), len(after[r[0]])) for r in rows)
    assert edits.edited_counts(frame([]).withColumn("edits", edits.derived_edits(F.col("doc_id"), F.col("text"))), PATH).count() == 0


def test_query_counts_equal_full_encodings(spark, small, tokenizer):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("edits", edits.derived_edits(F.col("doc_id"), F.col("text")))
    got = {r.doc_id: r for r in edits.edited_counts(docs, PATH).collect()}
    encoded = chars = 0
    for r in docs.collect():
        text = r.text or ""
        assert got[r.doc_id].tokens_before == len(tokenizer.encode(text, add_special_tokens=False).ids)
        for e in r.edits:
            start = min(e.start, len(text))
            text = text[:start] + e.replacement + text[start + e.length:]
        assert (got[r.doc_id].tokens_after, got[r.doc_id].chars_after) == (len(tokenizer.encode(text, add_special_tokens=False).ids), len(text))
        encoded, chars = encoded + got[r.doc_id].chars_encoded, chars + len(text)
    assert encoded < chars / 2
