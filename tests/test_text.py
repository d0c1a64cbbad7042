import collections
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipescope.functions import text as tx
from pipescope.functions.stemming import stem
from pipescope.functions.text import whitespace_tokens
from pipescope.operators import features as ft
from pipescope.operators import models as md
from pipescope.operators import vocabulary as vo
from pipescope.plans import experiment as xp

# published pairs of the English Snowball sample vocabulary
STEMS = {
    "consistency": "consist", "consolatory": "consolatori", "conspicuously": "conspicu", "knackeries": "knackeri",
    "kneeling": "kneel", "knightly": "knight", "generously": "generous", "communication": "communic",
    "dying": "die", "skies": "sky", "hopping": "hop", "hoping": "hope", "relational": "relat", "ties": "tie",
    "cries": "cri", "gas": "gas", "kiwis": "kiwi", "exceed": "exceed", "agreed": "agre", "electricity": "electr",
}


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "text string").select(fn("text").alias("o")).first()["o"]


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS
    assert stem("RUNNING") == "run"


def test_cleaning_steps(spark):
    assert one(spark, "Abc ÉÀ", tx.lowercase) == "abc éà"
    assert one(spark, "a,b.(c)!", tx.punctuation_to_space) == "a b  c  "
    assert one(spark, "a12b3 ٣٤", tx.digits_to_space) == "a b   "
    assert one(spark, " The the of  cat\n", lambda c: tx.drop_stop_words(c, ["the", "of"])) == "The cat"
    assert one(spark, "buy 12 or 1/2  or ten, 3.5\nkg", tx.drop_numbers) == "buy or or ten, kg"
    assert one(spark, "", tx.whitespace_tokens) == [] and one(spark, " \n ", tx.whitespace_tokens) == []


def test_treebank(spark):
    text = "They'll save (and) \"invest\" $3.88 in New York, can't they? Cannot... done."
    assert one(spark, text, tx.treebank_tokens) == [
        "They", "'ll", "save", "(", "and", ")", "``", "invest", "''", "$", "3.88", "in", "New", "York", ",", "ca", "n't",
        "they", "?", "Can", "not", "...", "done", "."]
    assert one(spark, "(x) [y]", tx.ptb_tokens) == ["-LRB-", "x", "-RRB-", "-LSB-", "y", "-RSB-"]


def test_bigrams(spark):
    assert one(spark, "a b c", lambda c: tx.unigrams_and_bigrams(tx.whitespace_tokens(c))) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, "a", lambda c: tx.unigrams_and_bigrams(tx.whitespace_tokens(c))) == ["a"]
    assert one(spark, "", lambda c: tx.unigrams_and_bigrams(tx.whitespace_tokens(c))) == []


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Running (cats), running dogs!"), (2, ""), (3, "*** the the the cats")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_stemmed_text(docs):
    got = {r["doc_id"]: r["text"] for r in vo.stem_text(docs).collect()}
    assert got == {1: "run (cat), run dog!", 2: "", 3: "*** the the the cat"}


def test_lexicon_steps_keep_spacing(spark):
    docs = spark.createDataFrame([(1, "two  mice ran\noff ")], "doc_id long, text string")
    lemmas = spark.createDataFrame([("mice", "mouse"), ("ran", "run")], "token string, lemma string")
    assert vo.lemmatise_text(docs, lemmas).first()["text"] == "two  mouse run\noff "
    tags = spark.createDataFrame([("off", "ADP"), ("mice", "NOUN")], "token string, pos_tag string")
    assert vo.drop_closed_class(docs, tags).first()["text"] == "two  mice ran\n"


def test_repeated_rows_keep_their_own_texts(spark):
    docs = spark.createDataFrame([(1, "the running cats"), (1, "the running cats"), (1, "dogs ran"), (2, None)], "doc_id long, text string")
    docs = docs.withColumn("n", F.col("doc_id") * 2)
    lemmas = spark.createDataFrame([("cats", "cat"), ("dogs", "dog")], "token string, lemma string")
    tags = spark.createDataFrame([("the", "DET")], "token string, pos_tag string")
    stems = sorted(r["text"] for r in vo.stem_text(docs).collect())
    assert stems == ["", "dog ran", "the run cat", "the run cat"]
    lemmatised = vo.lemmatise_text(docs, lemmas)
    assert lemmatised.columns == docs.columns
    assert sorted((r["n"], r["text"]) for r in lemmatised.collect()) == [(2, "dog ran"), (2, "the running cat"), (2, "the running cat"), (4, "")]
    assert sorted(r["text"] for r in vo.drop_closed_class(docs, tags).collect()) == ["", "dogs ran", "running cats", "running cats"]
    pieces = sorted(" ".join(r["tokens"]) for r in vo.bpe_tokens(docs, 1).collect())
    assert len(pieces) == 4 and pieces[-1] == pieces[-2]


def test_merges_learnt_on_train_apply_to_all(spark):
    rows = [("train", "low lower lowest"), ("test", "low slow zz")]
    docs = spark.createDataFrame(rows, "split string, text string")
    fitted = vo.bpe_tokens(docs, 3, train=F.col("split") == "train").collect()
    alone, _ = vo.learn_merges(vo.distinct_words(docs.where("split = 'train'"), whitespace_tokens("text")), 3)
    got = {r["split"]: r["tokens"] for r in fitted}
    assert [m[:2] for m in alone] == [("l", "o"), ("lo", "w"), ("Ġ", "low")] or len(alone) == 3
    assert "".join(got["test"]) == "ĠlowĠslowĠzz" and "Ġlow" in got["test"]


def plain_merges(words, rounds):
    """Byte-pair merges by full recounting."""
    segs, merges = {w: list("Ġ" + w) for w in words}, []
    for _ in range(rounds):
        pairs = collections.Counter()
        for w, n in words.items():
            for p in zip(segs[w], segs[w][1:]):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs.items(), key=lambda kv: (-kv[1], kv[0]))
        merges.append((*best[0], best[1]))
        for w, s in segs.items():
            out, i = [], 0
            while i < len(s):
                if tuple(s[i:i + 2]) == best[0]:
                    out.append(s[i] + s[i + 1])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            segs[w] = out
    return merges, segs


def test_merges_equal_full_recounting(spark):
    words = {"aaaa": 3, "abab": 4, "lower": 5, "lowest": 2, "newer": 6, "wider": 3}
    merges, segs = plain_merges(words, 12)
    table = spark.createDataFrame(list(words.items()), "token string, n long")
    got, pieces = vo.learn_merges(table, 12)
    assert got == merges
    assert {r["token"]: r["pieces"] for r in pieces.collect()} == segs


def test_merge_batches_are_what_single_merges_choose():
    rng = np.random.default_rng(3)
    for _ in range(30):
        words = {"".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))): int(rng.integers(1, 40)) for _ in range(40)}
        want, segs = plain_merges(words, 25)
        done = []
        while len(done) < len(want):
            _, now = plain_merges(words, len(done))
            pairs = collections.Counter()
            for w, n in words.items():
                for p in zip(now[w], now[w][1:]):
                    pairs[p] += n
            ranked = sorted(((a, b, n) for (a, b), n in pairs.items()), key=lambda p: (-p[2], p[0], p[1]))
            done += vo.merge_batch(ranked[:6], len(ranked) <= 6)
        assert done[:len(want)] == want


def test_word_pieces(spark):
    vocabulary = spark.createDataFrame([(p,) for p in ("un", "##aff", "##able", "##a", ",", "cafe")], "piece string")
    docs = spark.createDataFrame([(1, "Unaffable, Café xyz"), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in vo.wordpiece_tokens(docs, vocabulary).collect()}
    assert got == {1: ["un", "##aff", "##able", ",", "cafe", "[UNK]"], 2: []}
    odd = spark.createDataFrame([(1, "un" * 60), (2, "cafe漢\u0007 un"), (3, "\u0301")], "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in vo.wordpiece_tokens(odd, vocabulary).collect()}
    assert got == {1: ["[UNK]"], 2: ["cafe", "[UNK]", "un"], 3: []}


@pytest.fixture(scope="module")
def token_docs(spark):
    rows = [(1, "train", ["a", "b", "a"]), (2, "train", ["b", "c"]), (3, "test", ["a", "z"]), (4, "val", [])]
    return spark.createDataFrame(rows, "doc_id long, split string, tokens array<string>")


def test_terms_come_from_train_only(token_docs):
    terms = [(r["term"], r["total"], r["df"]) for r in ft.fit_terms(token_docs, 3).collect()]
    tie = min(["a b", "b a", "b c", "c"], key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sorted(terms) == sorted([("a", 2, 1), ("b", 2, 2), (tie, 1, 1)])
    bag = {(r["doc_id"], r["term"]): r["tf"] for r in ft.bag_of_words(token_docs, ft.fit_terms(token_docs, 3)).collect()}
    where = {"a b": 1, "b a": 1, "b c": 2, "c": 2}[tie]
    assert bag == {(1, "a"): 2, (1, "b"): 1, (where, tie): 1, (2, "b"): 1, (3, "a"): 1}


def test_tf_idf_by_formula_and_by_stages(token_docs):
    long = ft.tf_idf(token_docs, ft.fit_terms(token_docs))
    got = {(r["doc_id"], r["term"]): r["weight"] for r in long.collect()}
    a = 2 * (math.log(3 / 2) + 1)
    b = math.log(3 / 3) + 1
    other = math.log(3 / 2) + 1
    norm = math.sqrt(a * a + b * b + 2 * other * other)
    assert got[(1, "a")] == pytest.approx(a / norm) and got[(1, "b a")] == pytest.approx(other / norm)
    chain = ft.fit_tf_idf(token_docs.where("split = 'train'"))
    vectors = {r["doc_id"]: r["features"].toArray() for r in chain.transform(token_docs).collect()}
    assert sorted(x for x in vectors[1] if x) == pytest.approx(sorted(w for (d, _), w in got.items() if d == 1))
    assert not vectors[4].any()


def test_mean_vectors(spark, token_docs):
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 2.0])], "token string, vec array<float>")
    got = {r["doc_id"]: r["features"] for r in ft.mean_vectors(token_docs, vectors, 2).collect()}
    assert got[1] == pytest.approx([(0.6 * 2) / 3, (0.8 * 2 + 1) / 3])
    assert got[3] == pytest.approx([0.6, 0.8]) and got[4] == [0.0, 0.0]
    plain = {r["doc_id"]: r["features"] for r in ft.mean_vectors(token_docs, vectors, 2, normalise=False).collect()}
    assert plain[1] == pytest.approx([2.0, 10 / 3])


def vector_cases(spark):
    docs = spark.createDataFrame(
        [(1, ["x", "a", "b", "a"]), (2, ["b"]), (2, ["c", None]), (3, ["x"]), (4, []), (5, None), (None, ["a"])],
        "doc_id long, tokens array<string>")
    vectors = spark.createDataFrame(
        [("a", [3.0, 4.0]), ("b", [0.0, 2.0]), ("c", [1.0, 0.0]), ("c", [0.0, 3.0]), (None, [9.0, 9.0])],
        "token string, vec array<float>")
    return docs, vectors


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block_bytes", [1, 64 * 2**20])
def test_vectors_meet_words_in_blocks(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(ft, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(ft, "ROWS_AT_ONCE", 2)
    docs, vectors = vector_cases(spark)
    rows = ft.token_vector_rows(docs, vectors)
    assert sorted((str(r["doc_id"]), r["pos"], r["vec"]) for r in rows.collect()) == [
        ("1", 1, [3.0, 4.0]), ("1", 2, [0.0, 2.0]), ("1", 3, [3.0, 4.0]), ("2", 0, [0.0, 2.0]), ("2", 0, [0.0, 3.0]),
        ("2", 0, [1.0, 0.0]), ("None", 0, [3.0, 4.0])]

    def got(df):
        return sorted((str(r["doc_id"]), [round(x, 9) for x in r["features"]]) for r in df.collect())

    rest = [("3", [0.0, 0.0]), ("4", [0.0, 0.0]), ("5", [0.0, 0.0]), ("None", [0.0, 0.0])]
    pooled = [("2", [round(1 / 3, 9), round(5 / 3, 9)])] * 2
    assert got(ft.mean_vectors(docs, vectors, 2, normalise=False)) == [("1", [2.0, round(10 / 3, 9)]), *pooled, *rest]
    assert got(ft.mean_position_vector(docs, rows, 2)) == [("1", [2.0, round(10 / 3, 9)]), *pooled, *rest]
    firsts = got(ft.first_vector(docs, rows, 2))
    assert firsts[0] == ("1", [3.0, 4.0]) and firsts[3:] == rest
    assert firsts[1] == firsts[2] and firsts[1][1] in ([0.0, 2.0], [1.0, 0.0], [0.0, 3.0])


def test_null_vectors_are_left_out_and_null_entries_an_error(spark):
    docs = spark.createDataFrame([(1, ["a", "b"])], "doc_id long, tokens array<string>")

    def means(*vecs):
        vectors = spark.createDataFrame(list(zip("abc", vecs)), "token string, vec array<float>")
        rows = ft.token_vector_rows(docs, vectors)
        return [lambda: ft.mean_vectors(docs, vectors, 2, normalise=False).first()["features"],
                lambda: ft.mean_position_vector(docs, rows, 2).first()["features"]]

    for mean in means([1.0, 2.0], None, [1.0, 1.0]):
        assert mean() == [1.0, 2.0]
    for wrong in ([1.0, None], [1.0]):
        for mean in means([1.0, 2.0], wrong, [1.0, 1.0]):
            with pytest.raises(Exception, match="null entries or another width"):
                mean()


def test_no_vector_travels_with_a_word_and_none_is_ordered(spark):
    """Joining words with vectors moved a vector per word, and what pooled them ordered all of these rows."""
    docs, vectors = vector_cases(spark)
    rows = ft.token_vector_rows(docs, vectors)
    for df in (ft.mean_vectors(docs, vectors, 2), ft.mean_position_vector(docs, rows, 2)):
        plan = plan_of(df)
        assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
        assert "MapInArrow" in plan and "Join" not in plan[plan.index("MapInArrow"):]
    plan = plan_of(ft.first_vector(docs, rows, 2))
    assert plan.count("MapInArrow") == 2 and "Join" not in plan[plan.index("MapInArrow"):]


def test_merges_are_applied_inside_the_row(spark):
    """Every word of the corpus was moved to its pieces and back to its document."""
    docs = spark.createDataFrame([(1, "low lower"), (1, "low"), (None, ""), (2, None), (3, " newer  low ")], "doc_id long, text string")
    got = vo.bpe_tokens(docs, 3)
    plan = plan_of(got)
    assert "Join" not in plan and "Exchange" not in plan
    merged = [" ".join(r["tokens"]) for r in got.orderBy("doc_id", "text").collect()]
    assert merged == ["", "Ġlow", "Ġlow Ġlow e r", "", "Ġ n e w e r Ġlow"] and got.columns == ["doc_id", "text", "tokens"]


def linear_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 5))
    y = x @ np.arange(1, 6) + 10 + rng.normal(scale=0.001, size=100)
    from pyspark.ml.linalg import Vectors

    rows = [("train" if i < 80 else "val", Vectors.dense(x[i]), float(y[i])) for i in range(100)]
    return spark.createDataFrame(rows, ["split", "features", "label"])


def test_linear_model_recovers_coefficients(spark):
    model = md.fit_linear(linear_rows(spark).where("split = 'train'"))
    assert model.coefficients.toArray() == pytest.approx(np.arange(1, 6), rel=0.1)
    assert model.intercept == pytest.approx(10, rel=0.1)
    last = md.coefficients(model, spark).collect()[-1]
    assert last["term"] == "(intercept)"


def test_boosted_trees_and_model_sink(spark, tmp_path):
    df = linear_rows(spark)
    model = md.boosted_b(df, rounds=3, depth=2)
    assert model.transform(df).where("prediction IS NULL").count() == 0
    model.write().overwrite().save(str(tmp_path / "trees"))
    assert (tmp_path / "trees").exists()


def test_first_trees_are_the_shorter_fit(spark):
    from pyspark.ml.regression import GBTRegressor

    df = linear_rows(spark)
    long, short = (GBTRegressor(maxDepth=2, maxIter=n, seed=md.SEED).fit(df) for n in (6, 2))
    cut = md.first_trees(long, 2)
    assert cut.getNumTrees == 2
    got = [r["prediction"] for r in cut.transform(df).collect()]
    assert got == pytest.approx([r["prediction"] for r in short.transform(df).collect()])


def test_best_round_obeys_patience(spark):
    assert md.best_round([5, 4, 4, 3, 3, 3, 3, 1], 3, spark) == 4
    assert md.best_round([3, 2, 1], 5, spark) == 3


def test_experiment_runs(spark):
    rows = [(i, "train" if i < 60 else "val" if i < 80 else "test", f"word{i % 5} the end", float(i % 5)) for i in range(100)]
    corpus = spark.createDataFrame(rows, "doc_id long, split string, text string, label double")
    out = {r["split"]: r["rmse"] for r in xp.metrics(corpus, xp.Config(["lowercase"], model="linear_regression")).collect()}
    assert set(out) == {"train", "val", "test"} and out["test"] < 0.1
    with pytest.raises(ValueError):
        xp.metrics(corpus, xp.Config(model="nonsense"))
    with pytest.raises(ValueError):
        xp.metrics(corpus, xp.Config(featuriser="glove_mean"))


@pytest.mark.parametrize("work", ["count", "weigh", "stem"])
def test_texts_go_through_python_in_small_batches(spark, work):
    """A worker holds at most 2,000 documents of a batch, however many a task has."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        docs = spark.range(2).selectExpr("id AS doc_id", "'train' AS split", "'a b' AS text", "array('a', 'b') AS tokens")
        if work == "stem":
            vo.stem_text(docs)
        elif work == "count":
            ft.term_counts(docs)
        else:
            ft.tf_idf(docs, spark.createDataFrame([("a", 2)], "term string, df long"))
        assert int(spark.conf.get(key)) <= 2000
    finally:
        spark.conf.set(key, before)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_lexicon_steps_move_no_word_and_agree_with_the_join(spark, monkeypatch):
    texts = ["two  mice ran\noff ", "  lead\x1cthe mice", "", None, "the the xx ", "ran"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.col("doc_id") * 2)
    lemmas = spark.createDataFrame([("mice", "mouse"), ("ran", "run"), ("ran", "r"), ("xx", None), (None, "no")], "token string, lemma string")
    tags = spark.createDataFrame([("the", "DET"), ("off", "ADP"), ("off", None), ("mice", "NOUN"), ("mice", "VERB"), ("two", "DET"), ("two", "PRON"), (None, "DET")],
                                 "token string, pos_tag string")
    steps = [lambda: vo.lemmatise_text(docs, lemmas), lambda: vo.drop_closed_class(docs, tags)]
    inside = [s() for s in steps]
    assert [shuffles(df) for df in inside] == [0, 0]
    monkeypatch.setattr(vo, "SENT_BYTES", -1)
    joined = [s() for s in steps]
    assert all(shuffles(df) for df in joined)
    for a, b in zip(inside, joined):
        assert a.columns == b.columns == docs.columns
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_word_pieces_move_no_word_and_agree_with_the_join(spark, monkeypatch):
    texts = ["Unwanted, running Été 中文!", "", None, "x" * 101 + " un " + "x" * 100, "​ un", "wantednot qq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary = spark.createDataFrame([(p,) for p in ["un", "##want", "##wanted", "##ed", "run", "##ning", ",", "ete", "中", "!", "x", "##x", "want", "un", None]], "piece string")
    inside = vo.wordpiece_tokens(docs, vocabulary)
    assert shuffles(inside) == 0
    got = {r["doc_id"]: r["tokens"] for r in inside.collect()}
    assert got[0][:5] == ["un", "##wanted", ",", "run", "##ning"] and got[3] == ["[UNK]", "un", "x", *["##x"] * 99] and got[4] == ["un"]
    monkeypatch.setattr(vo, "SENT_BYTES", -1)
    joined = vo.wordpiece_tokens(docs, vocabulary)
    assert shuffles(joined) and {r["doc_id"]: r["tokens"] for r in joined.collect()} == got
    empty = vocabulary.where("piece = 'none'")
    monkeypatch.undo()
    assert {r["doc_id"]: r["tokens"] for r in vo.wordpiece_tokens(docs, empty).collect()}[5] == ["[UNK]", "[UNK]"]


def test_terms_are_counted_and_weighed_in_batches_as_one_by_one(spark, monkeypatch):
    """Rows without nulls or spaces in words, others, repeated rows and rows without words; no row of a term is exploded."""
    lists = [["a", "b", "a", "b"], ["b", "a"], [], None, ["", "a", ""], ["a", "b", "a", "b"]]
    odd = [["a b", "a", "b"], [None, "a"], ["c"]]
    monkeypatch.setattr(ft, "WORDS_AT_ONCE", 3)
    for tokens in (lists, lists + odd):
        rows = [(i % 5, "train" if i % 2 else None, t) for i, t in enumerate(tokens)]
        docs = spark.createDataFrame(rows, "doc_id int, split string, tokens array<string>").coalesce(1)
        want = []
        for doc, split, t in rows:
            found = Counter(t or [])
            found.update(f"{a} {b}" for a, b in zip(t or [], (t or [])[1:]))
            want.append((doc, split, found))
        counts = ft.term_counts(docs)
        assert "Generate" not in counts._jdf.queryExecution().executedPlan().toString()
        order = lambda r: tuple(str(x) for x in r)
        assert sorted(map(tuple, counts.collect()), key=order) == sorted(((d, s, x, n) for d, s, f in want for x, n in f.items()), key=order)
        totals = {r["term"]: (r["total"], r["df"]) for r in ft.fit_terms(docs).collect()}
        train = [f for _, s, f in want if s == "train"]
        assert totals == {x: (sum(f[x] for f in train), sum(x in f for f in train)) for f in train for x in f}
        n = len(train)
        weights = ft.tf_idf(docs, ft.fit_terms(docs))
        assert "Generate" not in weights._jdf.queryExecution().executedPlan().toString()
        expected = []
        for doc, split, f in want:
            known = {x: k * (math.log((1 + n) / (1 + totals[x][1])) + 1) for x, k in f.items() if x in totals}
            norm = math.sqrt(math.fsum(w * w for w in known.values()))
            expected += [(doc, split, x, w / norm) for x, w in known.items()]
        assert sorted(map(tuple, weights.collect()), key=order) == sorted(expected, key=order)
    empty = docs.where("doc_id > 9")
    assert ft.fit_terms(empty).isEmpty() and ft.tf_idf(docs, ft.fit_terms(empty)).isEmpty()


def test_partitions_of_an_experiment_follow_its_texts(spark, monkeypatch):
    """Spark's counting of terms has as many tasks as the tokenised rows have partitions."""
    corpus = spark.range(40).selectExpr("id AS doc_id", "'train' AS split", "'a b c d' AS text", "double(id) AS label").coalesce(2)
    seen = []
    featurise = xp.featurise
    monkeypatch.setattr(xp, "PART_BYTES", 28)
    monkeypatch.setattr(xp, "featurise", lambda t, *rest: seen.append(t.rdd.getNumPartitions()) or featurise(t, *rest))
    rows, _ = xp.run(corpus, xp.Config([], "whitespace", "tf_idf", "mean"))
    assert rows.count() == 40 and seen == [10]
    monkeypatch.setattr(xp, "PART_BYTES", 1 << 20)
    xp.run(corpus, xp.Config([], "whitespace", "tf_idf", "mean"))
    assert seen == [10, 2]
