import math
import random
import re
from collections import Counter

import pytest

from pipescope.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, score string", "item_id long, text string, rank string"


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    held = [(i, Counter(t)) for i, text, _ in docs if (t := terms(text))]
    n, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in {(i, t) for i, t, _ in items}:
        scored = []
        for doc, counts in held:
            m = 25 + 75 * counts.total() * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                        for t, times in Counter(terms(text)).items() if counts[t])
            if score > 0:
                scored.append((-score, doc is None, doc, score))
        out += [(item, rank, d, s) for rank, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k):
    got = lexical.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), k=k)
    return sorted(map(tuple, got.collect()), key=str)


def made(rng, n):
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "STRASSE", "x_y", "a-b", "日本", "9", "K"]
    return [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randrange(40))), "") for i in range(n)]


@pytest.mark.parametrize("block,rounds", [(8192, 1 << 24), (50, 1 << 24), (64, 3000)])
def test_equals_brute_force(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "FIRST_LOOK", 2)
    monkeypatch.setattr(lexical, "ROUND_BYTES", rounds)
    rng = random.Random(8)
    docs = made(rng, 500)
    docs += [(1000 + i, "w1 w2 w3 w4", "") for i in range(250)]  # copies: ties in a third of the rows
    docs += [(None, "w1 w2 w3 w4", ""), (None, None, ""), (2000, None, ""), (2001, "", ""), (2002, "-_ .", ""), (7, docs[7][1], ""),
             (2003, "w9 w3 " * 50_000, "")]
    items = [(i, t, "") for i, t, _ in made(rng, 40)] + [(50, "w1 w2 w3 w4 w1", ""), (51, None, ""), (52, "nowhere to-be-found", ""), (None, "w5", ""),
             (53, "w5", ""), (53, "w5", ""), (53, "w6 w7", ""), (54, " ".join(f"w{i}" for i in range(60)) + " extra" * 3, "")]
    assert run(spark, docs, items, 10) == brute(docs, items, 10)


def test_more_than_64_terms_and_few_documents(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(f"v{j}" for j in range(200) if rng.random() < 0.3), "") for i in range(80)]
    items = [(1, " ".join(f"v{j}" for j in range(200)), ""), (2, "v1 v199", "")]
    assert run(spark, docs, items, 25) == brute(docs, items, 25)
    assert run(spark, [(1, "a b", ""), (2, "b", "")], [(1, "A", "")], 10) == [(1, 1, 1, brute([(1, "a b", ""), (2, "b", "")], [(1, "a", "")], 10)[0][3])]


def test_empty_tables_and_common_terms(spark):
    assert run(spark, [], [(1, "a", "")], 10) == [] and run(spark, [(1, "a", "")], [], 10) == []
    everywhere = [(i, "a", "") for i in range(2000)]  # the weight of a term that all documents hold is 0
    assert run(spark, everywhere, [(1, "a", "")], 10) == brute(everywhere, [(1, "a", "")], 10) == []
