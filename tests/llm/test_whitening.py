import math
from fractions import Fraction

import numpy as np
import pytest

from pipescope.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string"


def whole(rows, scale=1024, offset=100_000):
    kept = [(i, [math.floor(scale * float(np.float32(c))) + offset for c in v]) for i, v, _ in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    return [(i, x + [offset] * (width - len(x))) for i, x in kept]


def check(spark, rows, components=8):
    """Rows of the result against fractions and numpy."""
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA), components=components).collect()
    kept = whole(rows)
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[j] for _, x in kept) for j in range(d)]
    exact = [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for _, x in kept), n ** 3) for j in range(d)] for i in range(d)]
    v = np.array([[float(c) for c in line] for line in exact])
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(components, int((values > values[0] * d * 1e-15).sum()))
    assert len(got) == n * k
    deviations = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept)
    assert sorted((str(r.vec_id), int(r.deviation)) for r in got if r.component == 1) == deviations
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for _, x in kept])
    for c in range(1, k + 1):
        own = [r for r in got if r.component == c]
        assert {r.n for r in own} == {n}
        assert own[0].explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
        z = sorted(abs(r.whitened) for r in own)
        w, axes = np.linalg.eigh(v)
        if min(abs(values[c - 1] - values[j]) for j in range(d) if j != c - 1) > 1e-6 * values[0]:
            assert z == pytest.approx(sorted(np.abs(centred @ axes[:, ::-1][:, c - 1] / math.sqrt(values[c - 1]))), abs=1e-6)
    assert {r.identity_error for r in got} and got[0].identity_error < 1e-8
    return got


def test_equals_fractions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=10) * np.arange(1, 11) / 10 + 3).tolist(), "x") for i in range(400)]
    rows += [(500 + i, [0.25] * 10, "x") for i in range(200)]  # one vector in a third of the rows
    rows += [(1, None, "x"), (2, [1.0, None], "x"), (3, [math.nan] * 10, "x"), (4, [math.inf] * 10, "x"), (None, [0.1] * 10, "x"), (9, [0.5, 1.0], "x"),
             (0, rows[0][1], "x"), (10, [], "x")]
    check(spark, rows)


def test_large_numbers_and_dimensions_without_spread(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(rng.normal() * 1e9), 7.0, float(rng.normal() * 1e-2), float(rng.normal() * 1e7)], "") for i in range(90)]
    got = check(spark, rows)
    assert {r.component for r in got} <= {1, 2, 3}
    huge = [(i, [float(s) * 3e38, float(t)], "") for i, (s, t) in enumerate([(1, 0), (-1, 1), (1, 5), (-1, 2)])]
    assert whitening.whiten(spark.createDataFrame(huge, SCHEMA)).count() >= 4


def test_more_components_than_dimensions_and_nothing_to_whiten(spark):
    check(spark, [(i, [float(i), float(i * i % 7)], "") for i in range(20)])
    for rows in ([], [(1, None, "")], [(1, [1.0, 2.0], "")], [(i, [1.0, 2.0], "") for i in range(5)], [(1, [], "")]):
        out = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
        assert out.count() == 0 and "whitened" in out.columns


def test_block_products_are_exact():
    rng = np.random.default_rng(6)
    for high in (2, 1300, 2**24 - 1, 2**40, 2**63 - 1):
        y = rng.integers(0, high, (130, 5))
        y[:, 3] = 0
        bits = [int(m).bit_length() for m in y.max(0)]
        want = np.triu(y.astype(object).T @ y.astype(object))
        assert (whitening._block_products(y, bits) == want).all()
