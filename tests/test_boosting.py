import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from pipescope.operators import boosting as bo

SCHEMA = ["split", "features", "label"]


def rows_of(spark, x, y, split):
    return spark.createDataFrame([(str(s), Vectors.dense(a), float(b)) for s, a, b in zip(split, x, y)], SCHEMA).repartition(5)


def brute(x, slope, depth, penalty):
    """Leaf value of every row by trying every value of every feature as a cut."""

    def grow(rows, left):
        g, n = slope[rows].sum(), len(rows)
        best = (1e-6, None)
        if left:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    low = x[rows, f] <= cut
                    a, na = slope[rows][low].sum(), low.sum()
                    gain = a * a / (na + penalty) + (g - a) ** 2 / (n - na + penalty) - g * g / (n + penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, low)
        if best[1] is None:
            out[rows] = -g / (n + penalty)
        else:
            grow(rows[best[1]], left - 1)
            grow(rows[~best[1]], left - 1)

    out = np.zeros(len(x))
    grow(np.arange(len(x)), depth)
    return out


def sample(n=240, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 30, (n, 3)).astype(float)
    return x, 2 * x[:, 0] + np.where(x[:, 1] > 12, 40, 0) + rng.normal(scale=5, size=n)


def test_trees_equal_trying_every_cut(spark):
    x, y = sample()
    split = np.where(np.arange(240) < 180, "train", "val")
    model = bo.fit_penalised(rows_of(spark, x, y, split), depth=3, rate=0.5, penalty=2.0, rounds=4, patience=99)
    tx, ty = x[:180], y[:180]
    pred = np.full(180, ty.mean())
    losses = []
    for _ in range(4):
        pred = pred + 0.5 * brute(tx, pred - ty, 3, 2.0)
        losses.append(((pred - ty) ** 2).mean())
    got = model.transform(rows_of(spark, x, y, split)).where("split = 'train'").toPandas()
    assert len(model.trees) == 4 and len(model.losses) == 5
    assert ((got["prediction"] - got["label"]) ** 2).mean() == pytest.approx(losses[-1])
    assert sorted(got["prediction"]) == pytest.approx(sorted(pred))


def test_stops_at_the_lowest_loss_on_val(spark):
    x, y = sample()
    noise = np.random.default_rng(5).normal(scale=40, size=len(y))
    split = np.where(np.arange(240) % 2 == 0, "train", "val")
    df = rows_of(spark, x, y + noise, split)
    model = bo.fit_penalised(df, depth=4, rate=0.3, patience=3)
    best = int(np.argmin(model.losses))
    assert len(model.trees) == best and len(model.losses) == best + 4
    val = model.transform(df).where("split = 'val'").toPandas()
    assert ((val["prediction"] - val["label"]) ** 2).mean() == pytest.approx(model.losses[best])


def test_written_predictions_change_nothing(spark, monkeypatch):
    x, y = sample(80)
    df = rows_of(spark, x, y, ["train"] * 60 + ["val"] * 20)
    whole = bo.fit_penalised(df, depth=2, rounds=5, patience=9)
    monkeypatch.setattr(bo, "CUT_EVERY", 2)
    cut = bo.fit_penalised(df, depth=2, rounds=5, patience=9)
    assert cut.losses == pytest.approx(whole.losses)


def test_written_trees_predict_the_same_and_in_sql(spark, tmp_path):
    x, y = sample(100)
    df = rows_of(spark, x, y, ["train"] * 100)
    model = bo.fit_penalised(df, depth=3, rounds=3)
    assert len(model.trees) == 3 and not model.losses  # no val rows: every round stays
    bo.write_trees(model, spark, str(tmp_path / "trees"))
    again = bo.read_trees(spark, str(tmp_path / "trees"))
    want = sorted(r["prediction"] for r in model.transform(df).collect())
    assert sorted(r["prediction"] for r in again.transform(df).collect()) == want
    import duckdb

    frame = spark.read.parquet(str(tmp_path / "trees")).toPandas()
    points = df.toPandas().assign(x=lambda d: d["features"].map(lambda f: f.toArray().tolist()))[["x"]].reset_index()
    con = duckdb.connect()
    con.register("trees", frame), con.register("points", points)
    got = con.sql("""WITH RECURSIVE walk AS (
      SELECT "index", x, tree, 0 AS node FROM points, (SELECT DISTINCT tree FROM trees WHERE tree >= 0)
      UNION ALL SELECT "index", x, walk.tree, 2 * walk.node + CASE WHEN x[CAST(feature + 1 AS BIGINT)] <= threshold THEN 1 ELSE 2 END
      FROM walk JOIN trees ON trees.tree = walk.tree AND trees.node = walk.node WHERE feature IS NOT NULL)
    SELECT (SELECT value FROM trees WHERE tree = -1) + sum(rate * value) FROM walk JOIN trees
    ON trees.tree = walk.tree AND trees.node = walk.node WHERE feature IS NULL GROUP BY "index" """).fetchall()
    assert sorted(v for v, in got) == pytest.approx(want)


def test_penalty_shrinks_leaves(spark):
    df = rows_of(spark, [[0.0], [0.0], [1.0], [1.0]], [0, 0, 6, 6], ["train"] * 4)
    for penalty, leaf in ((0.0, 3.0), (1.0, 2.0)):
        tree = bo.fit_penalised(df, depth=1, rate=1.0, penalty=penalty, rounds=1).trees[0]
        assert tree.value[1:].tolist() == [-leaf, leaf] and tree.threshold[0] == 0.0


def test_odd_rows(spark):
    nan = float("nan")
    rows = [("train", Vectors.dense([nan, 1.0]), 5.0), ("train", Vectors.dense([1.0, 1.0]), 1.0), ("train", Vectors.dense([1.0, 1.0]), 1.0),
            ("train", None, 9.0), ("train", Vectors.dense([2.0, 1.0]), None), ("test", None, 1.0), ("test", Vectors.sparse(2, {}), 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = bo.fit_penalised(df, depth=2, rate=1.0, penalty=0.0, rounds=1)
    out = {(r["split"], r["label"], r["features"] is None): r["prediction"] for r in model.transform(df).collect()}
    assert out[("train", 5.0, False)] == 5.0 and out[("train", 1.0, False)] == 1.0 and out[("train", 9.0, True)] is None
    flat = bo.fit_penalised(df.where("label = 1 AND features IS NOT NULL"), rounds=2)
    assert flat.base == 1.0 and all((t.feature == -1).all() for t in flat.trees)
    with pytest.raises(ValueError):
        bo.fit_penalised(df.where("false"))


def test_a_level_is_one_job(spark):
    """Fits are hundreds of levels long, so that a level's jobs and shuffles decide how long they take."""
    x, y = sample(200)
    df = rows_of(spark, x, y, ["train"] * 200)
    jobs = []
    for rounds in (2, 6):
        spark.sparkContext.setJobGroup(f"fit {rounds}", "")
        trees = bo.fit_penalised(df, depth=3, rounds=rounds).trees
        assert len(trees) == rounds and all(t.feature[0] >= 0 and t.feature[1:3].max() >= 0 for t in trees)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit {rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 4 * 3


def test_one_task_grows_the_trees_that_levels_of_jobs_grow(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = sample(400)
    x = np.column_stack([x, rng.integers(0, 3, 400), rng.normal(size=400).round(1)])
    x[rng.random(400) < 0.05, 4] = np.nan
    df = rows_of(spark, x, y + rng.normal(scale=30, size=400), np.where(np.arange(400) % 4 < 3, "train", "val"))
    for options in ({"depth": 4, "patience": 3}, {"depth": 6, "rounds": 5, "min_rows": 9, "bins": 16}, {"depth": 1, "rounds": 3, "rate": 1.0}):
        found = []
        for most, every in ((bo.WHOLE_BYTES, 25), (bo.WHOLE_BYTES, 3), (0, 25)):
            monkeypatch.setattr(bo, "WHOLE_BYTES", most), monkeypatch.setattr(bo, "CUT_EVERY", every)
            found.append(bo.fit_penalised(df, **options))
            monkeypatch.undo()
        *whole, levels = found
        for model in whole:
            assert len(model.trees) == len(levels.trees) > 1 and model.losses == pytest.approx(levels.losses)
            for one, other in zip(model.trees, levels.trees):
                assert one.feature.tolist() == other.feature.tolist() and one.bin.tolist() == other.bin.tolist()
                assert one.value == pytest.approx(other.value) and np.array_equal(one.threshold, other.threshold, equal_nan=True)


def test_a_fit_that_one_task_holds_is_a_job_for_many_trees(spark):
    """The jobs of a level take a tenth of a second whatever the rows, and a fit has thousands of levels."""
    x, y = sample(200)
    df = rows_of(spark, x, y, ["train"] * 150 + ["val"] * 50)
    jobs = []
    for rounds in (5, 60):
        spark.sparkContext.setJobGroup(f"whole fit {rounds}", "")
        assert len(bo.fit_penalised(df, rounds=rounds, patience=99).losses) == rounds + 1
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"whole fit {rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 8


def test_rows_left_by_the_smaller_child_are_those_of_the_other():
    """Sums of a child are taken from its parent's: no row is lost, and bins without rows hold nothing."""
    rng = np.random.default_rng(2)
    x, slope = rng.integers(0, 8, (300, 4)).astype(np.uint8), rng.normal(size=300) * 1e6
    train = np.arange(300) % 5 > 0
    rows = bo._Rows([(train[part].tobytes(), np.zeros(150).tobytes(), x[part].tobytes(), slope[part].tobytes())
                     for part in (slice(150), slice(150, 300))], 4)
    tree, rules = bo.Tree.stump(3), (8, 1.0, 1, 1.0)
    found = rows.level(tree, [0], *rules)
    assert found[bo.LOSS] == {"g": pytest.approx((slope[~train] ** 2).sum()), "n": 60} and found[0]["n"] == 240
    tree.feature[:3], tree.bin[:3] = [1, 0, 2], [5, 2, 3]
    for frontier in ([1, 2], [3, 4, 5, 6]):
        rows.level(tree, frontier, *rules)
        upto = bo.Tree(np.where(np.arange(15) < frontier[0], tree.feature, -1), tree.bin, tree.threshold, tree.value)
        nodes = upto.nodes(x, tree.bin)
        for j in frontier:
            at = train & (nodes == j)
            for f in range(4):
                assert rows.sums[j][1, f].tolist() == np.bincount(x[at, f], minlength=8).tolist()
                assert rows.sums[j][0, f] == pytest.approx(np.bincount(x[at, f], slope[at], 8), abs=1e-6)
                assert not rows.sums[j][0, f][rows.sums[j][1, f] == 0].any()
