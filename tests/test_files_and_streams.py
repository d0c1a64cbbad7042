import datetime
import json

import pytest
from pyspark.sql import functions as F

from pipescope.operators import curves as cv
from pipescope.operators import results as rs
from pipescope.sources import files as fl
from pipescope.streaming import intake


def test_quoted_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('"text","label"\n"say ""hi""",1\n"two\nlines",2\n"",3\n,4\n"NA",5\n')
    rows = sorted(fl.read_corpus_csv(spark, str(path)).collect(), key=lambda r: r["label"])
    assert [r["text"] for r in rows] == ['say "hi"', "two\nlines", "", "", "NA"]
    assert [r["label"] for r in rows] == [1.0, 2.0, 3.0, 4.0, 5.0]
    out = fl.preprocess_csv(spark, "lowercase", str(path), str(tmp_path))
    assert out.endswith("lowercase_c.csv") and fl.read_corpus_csv(spark, out, "text STRING").count() == 5


def test_corpora_by_name(spark, tmp_path):
    folder = tmp_path / "online_boat_listings"
    folder.mkdir()
    body = "\n".join(f'"boat {i}",{i}' for i in range(40))
    (folder / "train.csv").write_text('"text","label"\n' + body + "\n")
    (folder / "test.csv").write_text('"text","label"\n"last",99\n')
    counts = fl.load_corpus(spark, "online_boat_listings", 1, str(tmp_path)).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in counts} == {"train": 30, "val": 10, "test": 1}
    with pytest.raises(NotImplementedError):
        fl.load_corpus(spark, "california_house_prices", 1)
    source = spark.range(150).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 600).alias("text"))
    made = fl.load_corpus(spark, "test", 4, source=source)
    assert made.count() == 100 and made.where(F.size(F.split("text", " ")) == 500).count() == 100
    assert {r["split"]: r["count"] for r in made.groupBy("split").count().collect()} == {"train": 60, "val": 20, "test": 20}


@pytest.fixture
def result_tree(tmp_path):
    for seed, name, extra in ((3, "results.json", {}), (97, "old_results.json", {"seed": 5})):
        folder = tmp_path / f"tokeniser_bert/seed_{seed}"
        folder.mkdir(parents=True)
        record = {"preprocessers": [], "tokeniser": "bert", "featuriser": "tf_idf", "model": "relu_mlp",
                  "total_time": 2.5, "rmse": {"train": 1.0, "val": 2.0, "test": 3.0}, **extra}
        (folder / name).write_text(json.dumps(record))
        (folder / "normalisation_params.json").write_text(json.dumps({"mean": 1.0, "std": 10.0}))
        (folder / "model.pth").write_text("x")
        (folder / "test_preds.csv").write_text("x")
        (folder / "run.lock").write_text("x")
    return str(tmp_path)


def test_result_scan(spark, result_tree):
    read = fl.read_results(spark, result_tree)
    assert sorted(r["seed"] for r in read.collect()) == [3, 5]
    flat = rs.clean_records(rs.unnest_one_level(fl.with_side_params(read, result_tree)))
    row = rs.undo_scaling(flat).where("seed = 3").first()
    assert (row["rmse_test"], row["model"], row["codes"], row["finetune"]) == (30.0, "mlp", "empty", False)


def test_removable_files(spark, result_tree):
    paths = [r["path"].rsplit("/", 2)[-2:] for r in fl.removable_files(spark, result_tree).collect()]
    assert paths == [["seed_3", "model.pth"]]


def test_log_objects(spark, tmp_path):
    entry = {"preprocesser_order": ["stem"], "tokeniser": "bert", "featuriser": "tf_idf", "model": "m", "seed": 3,
             "status": "failed", "error": "OOM"}
    (tmp_path / "experiment_log.json").write_text(json.dumps({"h1": entry, "h2": {**entry, "status": "success"}}, indent=0))
    rows = {r["hash"]: (r["status"], r["finetune"], r["preprocessers"]) for r in
            fl.read_log(spark, str(tmp_path / "experiment_log.json")).collect()}
    assert rows == {"h1": ("failed", None, ["stem"]), "h2": ("success", None, ["stem"])}


def test_sides_without_rows_get_no_folder(spark, tmp_path):
    df = spark.createDataFrame([("h", "shared")], "hash string, side string")
    fl.write_reconciliation(df, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("side=*")] == ["side=shared"]


def test_lines_are_sorted(spark, tmp_path):
    fl.write_lines(spark.createDataFrame([("b",), ("a",), ("c",)], "w string"), str(tmp_path / "w"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "w").glob("part-*")))
    assert text.split() == ["a", "b", "c"]


def curve(spark, losses):
    return cv.with_slots(spark.createDataFrame([(1, i - 1, float(x)) for i, x in enumerate(losses)],
                                               "run_id int, epoch int, val_loss double"), 2)


def test_early_stop(spark):
    row = cv.early_stop(curve(spark, [5, 4, 4, 3, 3, 3, 3]), 3).first()
    assert (row["best_loss"], row["best_epoch"], row["stop_epoch"], row["reason"]) == (3.0, 2, 5, "patience")
    row = cv.early_stop(curve(spark, [5, 4, 3]), 3).first()
    assert (row["best_loss"], row["stop_epoch"], row["reason"]) == (3.0, 1, "end")
    # the best epoch after the stop does not count
    assert cv.early_stop(curve(spark, [5, 6, 6, 6, 1]), 3).first()["best_loss"] == 5.0
    timed = curve(spark, [1, 1, 1, 1]).withColumn("epoch_time", F.lit(2.0))
    assert cv.time_limit_stop(timed, 5.0).first()["stop_epoch"] == 1


def test_streams_over_several_batches(spark, tmp_path):
    folder = tmp_path / "in"
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(minutes=i), i % 3, "error" if i % 4 == 0 else "view", 1.0, "{}")
            for i in range(24)]
    df = spark.createDataFrame(rows, intake.EVENTS_SCHEMA)
    for part in range(3):
        df.where(F.col("event_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(folder))

    def stream():
        return intake.event_stream(spark, str(folder), "*.parquet", files_per_batch=1)

    batch = intake.as_run_events(df)
    state = {r["hash"]: r["event_id"] for r in intake.upsert_log(stream()).collect()}
    assert state == {r["hash"]: r["m"] for r in batch.groupBy("hash").agg(F.max("event_id").alias("m")).collect()}
    counts = {(r["seed"], r["status"]): r["n"] for r in intake.status_counts(stream()).collect()}
    assert counts == {(r["seed"], r["status"]): r["count"] for r in batch.groupBy("seed", "status").count().collect()}
    unique = intake.first_per_hash(stream()).collect()
    assert len(unique) == len({r["hash"] for r in unique}) == batch.select("hash").distinct().count()


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, kept = tmp_path / "in", str(tmp_path / "kept")
    start = datetime.datetime(2024, 1, 1)

    def add(ids):
        rows = [(i, start + datetime.timedelta(minutes=i), i % 2, "view", 1.0, "{}") for i in ids]
        spark.createDataFrame(rows, intake.EVENTS_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    add(range(10))
    assert {r["n"] for r in intake.status_counts(intake.event_stream(spark, str(folder), "*.parquet"), kept).collect()} == {5}
    add(range(10, 14))
    again = intake.status_counts(intake.event_stream(spark, str(folder), "*.parquet"), kept)
    assert {r["n"] for r in again.collect()} == {7}
    assert spark.read.parquet(f"{kept}/status_counts").select("batch_id").distinct().count() == 2


def test_repeated_rows_of_a_corpus_have_ids_of_their_own(spark, tmp_path):
    name = sorted(fl.FILE_CORPORA)[0]
    train = [("same text", 1.0)] * 6 + [(f"text {i}", float(i)) for i in range(14)]
    for part, rows in (("train", train), ("test", [("same text", 1.0)] * 2)):
        fl.write_csv(spark.createDataFrame(rows, "text string, label double"), str(tmp_path / name / f"{part}.csv"))
    corpus = fl.load_corpus(spark, name, 3, str(tmp_path))
    assert corpus.select("doc_id").distinct().count() == 22
    assert {r["split"]: r["count"] for r in corpus.groupBy("split").count().collect()} == {"train": 15, "val": 5, "test": 2}


def test_csv_cut_anywhere_equals_one_task_per_file(spark, tmp_path):
    """Blocks of a few bytes, so that cuts fall into quoted fields, doubled quotes and line ends of both kinds."""
    import csv
    import random

    from pipescope.sources import split_csv

    rng = random.Random(41)
    bits = ['"', '""', ",", "\n", "\n\n", "\r\n", "é", "word", " ", "x,y", '"\n"', ",\n,"]
    want = []
    for f in range(3):
        rows = [("".join(rng.choices(bits, k=rng.randrange(9))), float(i)) for i in range(60)]
        rows += [("NA", -1.0), ("long " * 100 + "\nend", -2.0), ("", -3.0)]
        want += [(t.replace("\r\n", "\n"), v) for t, v in rows]
        with open(tmp_path / f"{f}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if f == 1 else "\n")
            writer.writerow(["text", "label"])
            writer.writerows(rows)
            if f == 2:
                out.write("\nan unquoted 5\" field,7.0\n")
                want.append(('an unquoted 5" field', 7.0))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "101")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        lines = split_csv.placed_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() > 20 and lines.rdd.getNumPartitions() > 20
        got = [(r.text.replace("\r\n", "\n"), r.label) for r in fl.read_corpus_csv(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted(got) == sorted(want)


def test_many_copies_of_a_row_get_ids_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(fl, "COPIES_PER_RANGE", 7)
    rows = spark.createDataFrame([("a", 1.0)] * 50 + [("b", 1.0), ("b", None), ("b", None)], "text string, label double")
    ids = fl.with_row_id(rows, "train")
    assert ids.count() == 53 and ids.select("doc_id").distinct().count() == 53
    monkeypatch.setattr(fl, "COPIES_PER_RANGE", 10_000)
    assert {r.doc_id for r in ids.collect()} == {r.doc_id for r in fl.with_row_id(rows, "train").collect()}


def test_loaded_corpus_reads_its_texts_once(spark, tmp_path):
    """The split counted, ordered and filtered the ids, each time from the files and through two shuffles of the texts."""
    name = "online_boat_listings"
    rows = spark.createDataFrame([(f"text {i % 7}", float(i % 7)) for i in range(20)], "text string, label double")
    fl.write_csv(rows, f"{tmp_path}/{name}/train.csv")
    fl.write_csv(rows.limit(3), f"{tmp_path}/{name}/test.csv")
    corpus = fl.load_corpus(spark, name, 3, str(tmp_path))
    assert corpus.where("split <> 'test'")._jdf.queryExecution().optimizedPlan().toString().count("Generate") <= 2
    assert {r["split"]: r["count"] for r in corpus.groupBy("split").count().collect()} == {"train": 15, "val": 5, "test": 3}
