import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from pipescope.llm import url_filters

TABLES = "documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def text_of(value):
    return str(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    columns = [d[0] for d in con.description]
    got = entry.queries()[name](spark, small)
    assert sorted(got.columns) == sorted(columns)
    assert sorted([text_of(x) for x in r] for r in got.select(*columns).collect()) == sorted([text_of(x) for x in r] for r in want)


def test_one_query_for_each_operator():
    numbers = [n[2:].split("_")[0] for n in entry.queries() if n.startswith("op")]
    assert sorted(numbers, key=int) == [str(n) for n in range(1, 14)] and "pipeline" in entry.queries()


URLS = [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.ORG/es/x?y#z"), (5, "ftp://example.org/en/12"), (6, "x://org"), (7, "x://borg/"),
        (8, "https://sub.a.com/fr/"), (9, "https://com/de/q"), (10, "https://a.com/De/q"), (11, "a://b://c/d"), (12, "http://u@h.co.uk:80/p"),
        (13, "http://example.org?q=/es/"), (14, "http://example.org/EN/1"), (14, "http://éx.org/\nq"), (None, "http://a.net/" + "p" * 100_000)]


def test_rules_and_reputation_of_odd_urls(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(0))
    outcomes = spark.createDataFrame([(10, 1)] * 40 + [(12, 0), (12, None), (99, 1)], "page_id long, bad int")
    got = {(r.page_id, r.path[:20]): r for r in url_filters.judge_urls(pages, outcomes).collect()}
    by = {k[0]: r for k, r in got.items()}
    assert len(got) == len(URLS)
    assert (by[1].host, by[1].path, by[3].host, by[11].host, by[11].path) == ("", "", "", "b:", "//c/d")
    assert [by[i].rule for i in (4, 5, 6, 7, 8, 9, 10, 13)] == ["example.org/es/", "example.org/en/1", None, None, "com/fr/", "com/de/", None, None]
    assert [by[i].verdict for i in (4, 5, 8, 9)] == ["block", "block", "allow", "block"] and got[14, "/EN/1"].rule == "org/"
    assert by[10].n_labelled == 40 and by[10].verdict == "block" and by[12].n_labelled == 1 and by[12].verdict == "allow"
    domains = {r.host: (r.domain, r.suffix) for r in url_filters.host_reputation(pages, outcomes).collect()}
    assert domains["u@h.co.uk:80"] == ("h.co.uk", "co.uk") and domains["sub.a.com"] == ("a.com", "com") and domains[""] == ("", "")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert url_filters.judge_urls(pages, none).where("verdict = 'block'").count() == 3
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string"), none).count() == 0


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("kept", F.lit("clash"))
    names, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.where("sample = 0").count() == counts[4] and last.where("not decoded").count() == 0
    direct = corpus_pipeline.run(spark, small)
    key = ["doc_id", "sample", "n_pieces", "ids"]
    assert sorted(map(str, last.select(key).collect())) == sorted(map(str, direct.select(key).collect()))


def test_pipeline_of_no_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() == 0


def test_entry_works_without_these_parts(tmp_path):
    for name in os.listdir(ROOT):
        if name in ("__spark_entry__.py", "pipescope"):
            subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    subprocess.run(["mv", f"{tmp_path}/pipescope/llm", f"{tmp_path}/elsewhere"], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op')], 'pipeline' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.stdout.strip().endswith("[] False"), out.stderr
