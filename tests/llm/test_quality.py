import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipescope.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    covered = np.zeros(len(words), bool)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered[i:i + 8] = True
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), int(covered.sum())


TEXTS = [
    None, "", "   \n", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 40, "ü𠀀 é y\x0bz\x1cq",
    "same line here\nother\nsame line here\n\n \n", "## ** $$ a|b <c>", "a b c d e f g h i a b c d e f g h j a b c d e f g h",
    "p q r s t u v w " + "z " * 30 + "p q r s t u v w p q", "\n".join(["l"] * 5),
]


def test_statistics_equal_a_brute_count(frame):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in quality.with_statistics(frame(rows)).collect()}
    for i, t in enumerate(TEXTS):
        want = counted(t)
        assert tuple(got[i][c] for c in quality.STATISTICS) == want, t
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def brute_mcd(x, support=0.75):
    """The same estimate with numpy, group by group."""
    x = np.round(x * quality.SCALE).astype(np.int64)
    v = x / quality.SCALE
    order = np.sort(x, axis=0)
    at = [order[int(np.ceil(q * len(x))) - 1] / quality.SCALE for q in (0.25, 0.5, 0.75)]
    floor = np.diag(np.square(quality.FLOORS))
    best = None
    for start in (0, 1):
        mean, cov = at[1], np.diag(((at[2] - at[0]) / 1.349) ** 2) * (1 - start) + floor
        for _ in range(12):
            z = np.linalg.solve(np.linalg.cholesky(cov), (v - mean).T)
            bins = np.floor(16 * np.log2(1 + 64 * (z ** 2).sum(0)))
            cut = np.sort(bins)[int(np.ceil(support * len(v))) - 1]
            part = v[bins <= cut]
            mean, cov = part.mean(0), part.T @ part / len(part) - np.outer(part.mean(0), part.mean(0)) + floor
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0] - 1e-9:
            best = det, mean, cov
    return best


def test_estimates_and_verdicts_equal_numpy(frame, spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        n = int(rng.integers(25, 90))
        words = ["w" * int(rng.integers(2, 9)) + str(rng.integers(1000)) for _ in range(n)]
        if i % 10 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "hot" if i % 2 else None, 1))
    docs = frame(rows)
    got = quality.judged(docs, keep=("doc_id", "lang", "source", "text")).toPandas()
    quantile = quality.chi_square_quantile(0.25, 5)
    factor = 0.75 / (1 - quality.chi_square_tail(quantile, 7))
    for _, group in got.groupby(["lang", "source"], dropna=False):
        n = group.n_words.to_numpy(float)
        x = np.column_stack([np.log1p(n), np.log(group.word_chars / n), np.log1p(100 * group.n_symbols / n), group.n_repeat_words / n,
                             group.n_dup_lines / 1.0])
        _, mean, cov = brute_mcd(x)
        v = np.round(x * quality.SCALE) / quality.SCALE
        z = np.linalg.solve(np.linalg.cholesky(cov), (v - mean).T)
        assert np.allclose((z ** 2).sum(0) / factor, group.distance, rtol=1e-4, atol=1e-4)
    junk = got.text.str.contains("###")
    assert not got.kept[junk].any() and got.kept[~junk].all()


def test_edge_tables(frame):
    assert quality.judged(frame([]), keep=("doc_id",)).count() == 0
    rows = [(None, None, None, None, None), (1, "x", None, "s", 1), (1, "x", None, "s", 1), (2, "", "en", None, 0)]
    docs = frame(rows).withColumn("n_words", F.lit("clash")).withColumn("distance", F.lit(1)).withColumn("x0", F.lit(2))
    got = quality.judged(docs, keep=("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert len(got) == 4 and not any(r["kept"] for r in got)
    long = "word " * 3 + " ".join(f"v{i}" for i in range(200_000))
    assert quality.judged(frame([(1, long, "en", "s", 0)]), keep=("doc_id",)).first()["n_words"] == 200_003


def test_chi_square():
    assert quality.chi_square_quantile(0.05, 4) == pytest.approx(9.487729, abs=1e-5)
    assert quality.chi_square_quantile(0.05, 5) == pytest.approx(11.070498, abs=1e-5)
    assert quality.chi_square_quantile(1e-9, 7) == pytest.approx(54.5, abs=2)


def test_groups_with_a_third_of_junk(frame):
    """Junk that is more than a quarter of a group goes, and the ordinary rows stay."""
    rng = np.random.default_rng(9)
    rows, junk = [], set()
    for source, share, mark in (("few", 0.1, "###"), ("third", 0.34, "###"), ("one", 0.34, "#"), ("most", 0.45, "###")):
        for i in range(300):
            words = ["w" * int(rng.integers(2, 9)) + str(rng.integers(1000)) for _ in range(int(rng.integers(25, 90)))]
            if i < share * 300:
                words = [w + mark for w in words]
                junk.add(len(rows))
            rows.append((len(rows), " ".join(words), "en", source, 1))
    rejected = {r.doc_id for r in quality.judged(frame(rows), keep=("doc_id",)).where("not kept").collect()}
    assert rejected == junk


def test_repeated_short_lines(frame):
    """Lines of under 8 words that recur are outliers; a few repeated lines are not."""
    rng = np.random.default_rng(13)
    rows, junk = [], set()
    for i in range(300):
        lines = [" ".join(str(rng.integers(10**6)) for _ in range(6)) for _ in range(12)]
        if i % 12 == 0:
            junk.add(i)
            # ten short lines in changing order: hardly a window of 8 words recurs
            lines = [f"{i}a{k} {i}b{k}" for k in rng.integers(0, 10, 60)]
        elif i % 3 == 0:
            lines[5] = lines[2]
        rows.append((i, "\n".join(lines), "en", "s", 1))
    got = quality.judged(frame(rows), keep=("doc_id",)).collect()
    assert {r.doc_id for r in got if not r.kept} == junk
    assert any(not r.base_failed for r in got if not r.kept)


def test_estimates_of_few_groups_stay_in_one_task(spark, monkeypatch):
    """Steps over some groups run few tasks beside those over the rows, whatever the number of shuffle partitions."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        rows = spark.range(120).selectExpr(
            "if(id % 3 = 0, null, string(id % 3)) AS g", *[f"1000 * {i} + (id * {7 + i}) % 41 AS x{i}" for i in range(quality.D)])
        cut, tasks = quality.cut_lineage, []
        monkeypatch.setattr(quality, "cut_lineage", lambda df: tasks.append((out := cut(df)).rdd.getNumPartitions()) or out)
        one = quality.mcd(rows, ["g"])
        assert one.rdd.getNumPartitions() == 1 and len(tasks) > 2 and set(tasks[1:]) == {1}
        got = sorted(map(str, one.collect()))
        assert len(got) == 3
        monkeypatch.setattr(quality, "GROUPS_A_TASK", 1)
        assert sorted(map(str, quality.mcd(rows, ["g"]).collect())) == got
    finally:
        spark.conf.set(key, before)
