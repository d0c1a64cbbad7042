import math

import numpy as np
from pyspark.sql import functions as F

from pipescope.llm import topk

SCHEMA = "vec_id long, embedding array<float>, id string"


def brute(rows, k, scale=64):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in kept:
        if i % 5 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = set()
    for q, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    return out


def run(spark, rows, k):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in topk.exact_top_k(df, F.col("id") % 5 == 0, k=k).collect()}


def test_equals_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "BINS", 8)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist(), "x") for i in range(150)]
    rows += [(200 + i, [0.5] * 6, None) for i in range(80)]  # one vector shared by a third
    rows += [(500, None, "x"), (501, [1.0, None], "x"), (505, [math.nan] * 6, "x"), (None, [1.0] * 6, "x"), (510, [math.inf], "x"),
             (515, [], "x"), (520, [1.0, 2.0], "x")]
    assert run(spark, rows, 7) == brute(rows, 7)


def test_an_id_that_many_rows_repeat_is_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    rng = np.random.default_rng(3)
    rows = [(77 if i % 3 else i, rng.normal(size=4).tolist(), "x") for i in range(120)]
    got = topk.exact_top_k(spark.createDataFrame(rows, SCHEMA), F.col("id") % 5 == 0, k=9)
    want = sorted((q, rank, i, s) for q, rank, i, s in brute(rows, 9))
    assert sorted(map(tuple, got.collect())) == want


def test_few_candidates_large_numbers_and_empty_tables(spark):
    rows = [(0, [1e6, -1e6], ""), (1, [3e7, 1.0], ""), (5, [-2.0, 1e-9], "")]
    assert run(spark, rows, 20) == brute(rows, 20)
    huge = [(0, [1e30, 1.0], ""), (1, [1e30, 1.0], ""), (2, [-1e30, 0.0], "")]
    assert [r[2:] for r in sorted(run(spark, huge, 5))] == [(1, topk.LARGEST), (2, -topk.LARGEST)]
    assert run(spark, [], 3) == set() and run(spark, [(1, [1.0], "")], 3) == set() and run(spark, [(0, [1.0], "")], 3) == set()
