import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipescope.llm import hyperminhash
from pipescope.llm.components import components


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent=80):
    """(doc_id, n, component) by comparing all pairs."""
    sets = [(d, shingles(t, size)) for d, t in rows]
    of = list(range(len(sets)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                of[root(i)] = root(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if s and d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def found(df):
    rows = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


def edited(rng, words, share):
    return [w if rng.random() > share else f"z{rng.randrange(10**6)}" for w in words]


def test_equals_all_pairs_on_groups_of_copies(frame, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK", 16)
    rng = random.Random(3)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 6, 25, 120, 400]))]
        texts += [" ".join(base)] * rng.randrange(3)
        for _ in range(rng.choice([1, 3, 40])):  # a large group whose members are mostly linked through others
            texts.append(" ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.06, 0.1]))))
    chain = [f"c{i}" for i in range(100)]
    for i in range(8):  # each like the next, the ends unlike
        chain = chain[6:] + [f"d{i}_{j}" for j in range(6)]
        texts.append("  ".join(chain).upper())
    texts += ["", None, " \n", "one", "One", "a b", "b a"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, texts[0]), (None, "alone at last here"), (5, "second text of five"), (5, texts[3])]
    docs = frame([(d, t, "", "", 0) for d, t in rows]).withColumn("node", F.lit("clash")).withColumn("digest", F.lit(1))
    for size in (2, 5):
        assert found(hyperminhash.near_duplicates(docs, size=size)) == brute(rows, size), size


def test_kept_rows_are_one_of_each_group(frame):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(4, text, "en", "a", 1), (2, text + " more", "en", "b", 2), (2, text + " more", "en", "b", 2), (9, "x y z", "en", "c", 3),
            (7, "", "en", "d", 4), (7, "", "en", "d", 4), (None, None, "en", "e", 5)]
    docs = frame(rows).withColumn("kept", F.lit("clash"))
    kept = hyperminhash.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.source) for r in kept.collect()) == [("2", "b"), ("7", "d"), ("7", "d"), ("9", "c"), ("None", "e")]
    assert hyperminhash.kept_rows(frame([])).count() == 0 and hyperminhash.near_duplicates(frame([])).count() == 0


def test_equals_all_pairs_on_the_test_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(hyperminhash.near_duplicates(docs, size=5)) == brute(rows, 5)


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (200, 20_000):
        for share in (0.3, 0.6, 0.9):
            inner = int(2 * n * share / (1 + share))
            pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            got = []
            for _ in range(20):
                pool = rng.permutation(pool)
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:inner], pool[n:2 * n - inner]]))
                ra, rb = hyperminhash.registers(a)[None], hyperminhash.registers(b)[None]
                got.append(hyperminhash.estimates(ra, rb, np.array([n]), np.array([n]))[0])
                pool = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            assert np.mean(got) == pytest.approx(share, abs=0.05)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    of = {x: x for e in edges for x in e}

    def root(x):
        return x if of[x] == x else root(of[x])

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        of[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
