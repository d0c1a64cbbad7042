import itertools
import math
from collections import Counter
from itertools import chain

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pipescope.llm import sampling
from pipescope.llm.shingles import mix

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "hello  world ", "é漢𠀀\n\tx", "the cat", "x" * 300, "▁", "  if x:\n" + " " * 16 + "y" + " " * 40 + "z  "]


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as stream:
        return sampling.PieceModel(stream.read(), 1.0)


@pytest.fixture(scope="module")
def processor():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


def segmentations(processor, text):
    """All segmentations of a text with their exact probabilities, by recursion over the whole text with all pieces of the model."""
    n = len(processor)
    normal = [i for i in range(n) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
    normal.sort(key=lambda i: (-processor.get_score(i), i))
    vocabulary = {processor.id_to_piece(i): (i, -math.log(rank + 3)) for rank, i in enumerate(normal)}
    bytes_of = {int(processor.id_to_piece(i)[1:-1], 16): i for i in range(n) if processor.is_byte(i)}

    def of(rest):
        if not rest:
            return [((), 0.0)]
        out = []
        for size in range(1, len(rest) + 1):
            if rest[:size] in vocabulary:
                i, weight = vocabulary[rest[:size]]
                out += [((i, *ids), w + weight) for ids, w in of(rest[size:])]
            elif size == 1:
                own = tuple(bytes_of[b] for b in rest[0].encode())
                out += [((*own, *ids), w - math.log(len(normal) + 3) * len(own)) for ids, w in of(rest[1:])]
        return out

    # every piece and byte weighs the same constant more after scaling to probabilities
    scale = math.log(sum(math.exp(w) for _, w in vocabulary.values()) + len(bytes_of) / (len(normal) + 3))
    found = {ids: w - scale * len(ids) for ids, w in of("▁" + text.replace(" ", "▁"))}
    total = math.log(sum(map(math.exp, found.values())))
    return {ids: w - total for ids, w in found.items()}


def drawn(model, text, n, k):
    lattice, searches = sampling.sample_batch(model, [text] * n, mix(np.arange(1, n + 1, dtype=np.uint64)), k)
    return [[(tuple(lattice.ids(edges)[0].tolist()), float(upto[-1]), top) for edges, _, upto, top in s.samples] for s in searches], searches


@pytest.mark.parametrize("text", ["at on é", "a   é", " at on ", "    "])
def test_samples_follow_the_law_of_sampling_without_replacement(model, processor, text):
    n = 6000
    law = segmentations(processor, text)
    assert len(law) > 6
    rows, _ = drawn(model, text, n, 3)
    first, second = Counter(r[0][0] for r in rows), Counter((r[0][0], r[1][0]) for r in rows)
    for ids, w in law.items():
        p = math.exp(w)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        for other, v in law.items():
            if other != ids:  # drawn second from what the first left
                q = p * math.exp(v) / (1 - p)
                assert abs(second[ids, other] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
    for r in rows:
        assert len({x[0] for x in r}) == 3 and [x[2] for x in r] == sorted((x[2] for x in r), reverse=True)
        assert all(x[1] == pytest.approx(law[x[0]]) for x in r)


@pytest.mark.parametrize("text", ["the at", "  a  b", "x" + " " * 9, "a ▁b"])
def test_all_segmentations_come_out_when_k_is_large(model, processor, text):
    law = segmentations(processor, text)
    rows, searches = drawn(model, text, 3, len(law) + 5)
    assert all({x[0] for x in r} == set(law) and len(r) == len(law) for r in rows) and not any(s.agenda for s in searches)


def test_inclusion_scores_estimate_totals(model, processor):
    """A sum over all segmentations, estimated from samples weighted by p over inclusion, is right on average."""
    text, n = "on the", 3000
    law = segmentations(processor, text)
    want = sum(math.exp(w) * len(ids) for ids, w in law.items())
    rows, searches = drawn(model, text, n, 2)
    estimates = [sum(math.exp(w) * len(ids) / -math.expm1(-math.exp(w + s.agenda[0][0])) for ids, w, _ in r) for r, s in zip(rows, searches)]
    assert np.mean(estimates) == pytest.approx(want, abs=5 * np.std(estimates) / math.sqrt(n))


def test_table_of_odd_texts(frame, processor, spark):
    rows = [(i, t, "", "", 0) for i, t in enumerate(TEXTS)] + [(None, "no id", "", "", 0), (6, "the cat", "", "", 0), (99, "word é " * 20_000, "", "", 0)]
    docs = frame(rows).withColumn("key", F.lit("clash")).withColumn("seed", F.lit(1))
    got = sampling.sample_segmentations(docs, PATH, k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r.key, []).append(r)
    for i, t in enumerate(TEXTS):
        for r in by[i]:
            assert r.n_pieces == len(r.ids) and 0 < r.inclusion <= 1 and r.decoded == (t != "▁")
            if t not in (None, "", "▁"):
                assert processor.decode(list(r.ids)) == t
    assert len(by[0]) == len(by[1]) == 1 and list(by[1][0].ids) == [] and by[1][0].inclusion == 1
    # a space behind the one put in front: together, or each by itself
    assert sorted([processor.id_to_piece(i) for i in r.ids] for r in by[2]) == [["▁", "▁"], ["▁▁"]]
    assert sorted(map(str, by[6][:3])) == sorted(map(str, by[6][3:])) or len(by[6]) == 6
    assert len(by[99]) == 3 and all(r.decoded for r in by[99]) and len(by[None]) == 3
    again = sampling.sample_segmentations(docs.repartition(7), PATH, k=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sampling.sample_segmentations(frame([]), PATH).count() == 0
    decoded = sampling.sample_segmentations(docs, PATH, k=1).withColumn("t", sampling.decode_ids(F.col("ids"), PATH, spark))
    assert {r.key: r.t for r in decoded.where("key between 3 and 7").collect()} == {i: TEXTS[i] for i in range(3, 8)}


def test_words_that_end_alike_share_a_lattice(model):
    """Most of the work of a text is its lattice, so a word's end is looked up once for all words that have it."""
    words = ["nation", "station", "on", "ration", "n", "é漢on", "x" * 50 + "ation", "y" * 50, "x" * 50, "ation", "▁on"]
    seeds = mix(np.arange(1, len(words) + 3, dtype=np.uint64))
    texts = [*words, "  ".join(words) + " ", " ".join(words[:4])]
    lattice, searches = sampling.sample_batch(model, texts, seeds, 3)
    distinct = set(chain.from_iterable(map(sampling.split_words, texts)))
    ends = {w[i:] for w in distinct for i in range(max(0, len(w) - 32), len(w))}
    assert lattice.end == len(distinct) + len(ends) + sum(max(0, len(w) - 32) for w in distinct)
    assert lattice.end < sum(len(w) + 1 for w in distinct)
    for text, seed, search in zip(texts, seeds, searches):
        alone, (own,) = sampling.sample_batch(model, [text], np.array([seed]), 3)
        assert len(own.samples) == len(search.samples)
        for (edges, _, upto, top), (own_edges, _, own_upto, own_top) in zip(search.samples, own.samples):
            assert lattice.ids(edges)[0].tolist() == alone.ids(own_edges)[0].tolist()
            assert upto.tolist() == own_upto.tolist() and top == own_top


def test_copies_that_follow_each_other_are_drawn_once(frame):
    """The epochs of a mix give a text several times in a row; every row has its samples, one search serves them."""
    import pyarrow as pa

    keys = [1, 1, 1, 2, 2, None, None, 3, 3, 1]
    texts = ["the cat", "the cat", "the", "the", "the", "on", "on", None, None, "the cat"]
    batch, times = sampling._without_copies(pa.record_batch([pa.array(keys), pa.array(range(10)), pa.array(texts)], ["key", "seed", "text"]))
    assert batch.column(0).to_pylist() == [1, 1, 2, None, None, 3, 3, 1] and times.tolist() == [2, 1, 2, 1, 1, 1, 1, 1]
    assert batch.column(2).to_pylist() == ["the cat", "the", "the", "on", "on", None, None, "the cat"]
    assert sampling._without_copies(batch.slice(0, 0))[1].tolist() == []

    rows = [(k, t, "", "", 0) for k, t in zip(keys, texts)] + [(9, "at on " * 50, "", "", 0)] * 7 + [(10, "x y " * 300_000, "", "", 0)] * 2
    got = Counter(map(str, sampling.sample_segmentations(frame(rows).coalesce(1), PATH, k=3).collect()))
    each = Counter()
    for row in set(rows):
        alone = sampling.sample_segmentations(frame([row]), PATH, k=3).collect()
        assert 1 <= len(alone) <= 3
        each.update({str(r): rows.count(row) for r in alone})
    assert got == each
