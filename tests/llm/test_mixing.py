from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pipescope.llm import mixing


def rows_of(n):
    return [(i, " ".join(["w"] * (i % 13)), "en", ["b", "a", None, "c", "é"][i % 5] if i % 3 else "hot", i) for i in range(n)]


def test_targets_and_takes(frame):
    rows = rows_of(600)
    got = mixing.mix(frame(rows).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(1))).toPandas()
    total = sum(i % 13 for i in range(600))
    sizes, order = got.groupby("source", dropna=False)["size"].sum(), ["a", "b", "c", "hot", "é", None]
    caps = {s: 2.0 * (sizes[s] if s else got.loc[got.source.isna(), "size"].sum()) for s in order}
    weights = dict(zip(order, [3, 1, 2, 3, 1, 2]))
    full, share = set(), None
    while True:
        share = (1.5 * total - sum(caps[s] for s in full)) / sum(weights[s] for s in order if s not in full)
        more = {s for s in order if s not in full and share * weights[s] > caps[s]}
        if not more:
            break
        full |= more
    for s in order:
        part = got[got.source.isna()] if s is None else got[got.source == s]
        target = caps[s] if s in full else share * weights[s]
        assert part.target.iloc[0] == pytest.approx(target) and part.taken.sum() == int(part.target.iloc[0])
        assert (part.taken <= 2 * part["size"]).all()


def test_mixed_rows_take_what_mix_says(frame):
    docs = frame(rows_of(400)).withColumn("_key", F.lit("clash"))
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    words = defaultdict(int)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        assert r.text and r.source == (["b", "a", None, "c", "é"][r.doc_id % 5] if r.doc_id % 3 else "hot")
        words[r.doc_id] += len(r.text.split())
    assert words == {d: t for d, t in taken.items() if t}


def test_edges(frame):
    assert mixing.mix(frame([])).count() == 0 and mixing.mixed_rows(frame([])).count() == 0
    empty = [(1, None, "en", None, 0), (2, "", "en", "s", 0)]
    assert [(r.size, r.target, r.taken) for r in mixing.mix(frame(empty)).select("size", "target", "taken").collect()] == [(0, 0.0, 0)] * 2
    same = [(7, "a b c", "en", "s", 0)] * 50 + [(None, "d e", "en", "s", 0)] * 3 + [(8, "x " * 100_000, "en", None, 0)]
    got = mixing.mix(frame(same)).toPandas()
    for source, part in got.groupby("source", dropna=False):
        assert part.taken.sum() == int(part.target.iloc[0])
    again = mixing.mix(frame(same[::-1])).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).to_numpy(float).tolist().__repr__() == again[key].sort_values(key).to_numpy(float).tolist().__repr__()
    out = mixing.mixed_rows(frame(same)).toPandas()
    assert abs(sum(len(t.split()) for t in out.text) - got.taken.sum()) < 60


def test_ids_that_many_rows_share(frame, monkeypatch):
    """Rows of one id and size take what single rows in their place would."""
    monkeypatch.setattr(mixing, "COPIES", 16)
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", 32)
    rows = [(None, "w " * (i % 3), "en", "a", 0) for i in range(200)] + [(7, "w w", "en", "a", 0)] * 150
    rows += [(100 + i, "w " * (i % 9), "en", "ab"[i % 2], 0) for i in range(300)]
    got = mixing.mix(frame(rows)).collect()
    assert len(got) == len(rows)
    for source in "ab":
        part = sorted((r for r in got if r.source == source), key=lambda r: (r.prior, r.size))
        at = 0
        for r in part:  # the priors follow one another without a gap, whoever stands where
            assert r.prior == at
            at += r.size
        assert at == part[0].source_size and sum(r.taken for r in part) == int(part[0].target)
    assert sum(r.doc_id is None for r in got) == 200 and sum(r.doc_id == 7 for r in got) == 150
    out = mixing.mixed_rows(frame(rows)).collect()
    assert abs(sum(len(r.text.split()) for r in out) - sum(r.taken for r in got)) < 200
