import json

from pipescope.sources import files as fl
from pipescope.sources import split_json as sj

SCHEMA = "struct<a:string,n:array<int>,o:struct<x:string>>"
LOG = {
    "h1": {"a": 'br}ace {"quoted"} \\', "n": [1, 2], "o": {"x": "}{"}},
    'k"{}': {"a": "", "n": [], "o": None},
    "plain": None,
    "h2": {},
    "h3": {"a": "line\nbreak, ünï }", "n": [3], "o": {"x": '\\"'}},
    "last": None,
}


def rows_of(df):
    return {r["key"]: r["entry"].asDict(True) if r["entry"] else None for r in df.collect()}


def filled(value):
    return value and {"a": value.get("a"), "n": value.get("n"), "o": value.get("o")} if value != {} else {"a": None, "n": None, "o": None}


def test_objects_are_cut_at_entries_in_any_layout_and_part_size(spark, tmp_path):
    want = {k: filled(v) for k, v in LOG.items()}
    for i, options in enumerate([{}, {"indent": 4}, {"ensure_ascii": False, "separators": (",", ":")}]):
        path = tmp_path / f"log{i}.json"
        path.write_text(json.dumps(LOG, **options), encoding="utf-8")
        for size in ("37b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            try:
                pieces = sj.placed_pieces(spark, str(path))
                assert size == "128m" or pieces.rdd.getNumPartitions() > 3
                assert rows_of(sj.read_objects(spark, str(path), SCHEMA)) == want
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_empty_objects_and_several_files(spark, tmp_path):
    for name, text in {"a": "{}", "b": " {\n}\n", "c": "", "d": '{"x": {"a": "1"}}\n', "e": '{"y": {"a": "2"}}'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert {k: v["a"] for k, v in rows_of(sj.read_objects(spark, str(tmp_path), SCHEMA)).items()} == {"x": "1", "y": "2"}


def test_large_logs_equal_whole_ones(spark, tmp_path):
    log = {f"h{i}": {"preprocesser_order": ["a"] * (i % 3), "model": "m}" * i, "seed": i, "status": "success"} for i in range(20)}
    (tmp_path / "log.json").write_text(json.dumps(log, indent=2))
    large, whole = (sorted(map(str, fl.read_log(spark, str(tmp_path), large=x).collect())) for x in (True, False))
    assert large == whole and len(large) == 20
