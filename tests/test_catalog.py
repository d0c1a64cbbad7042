import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# one query per kind of plan; tools/check_oracles.py compares all of them
COMPARED = [
    "best_configs", "segment_table", "box_by_model", "variance_decomposition_by_finetuning", "reconciled_log",
    "next_unseen_configs", "random_configs", "early_stops", "tf_idf_features", "byte_pair_tokens", "rank_sum_steps",
]


def test_flagship(spark):
    """The best ten of the complete configurations; studies leave linear regressions out."""
    rows = entry.entry(spark).collect()
    assert len(rows) == 10 and all(r["replicates"] == 4 and r["model"] != "linear_regression" for r in rows)
    assert [r["mean"] for r in rows] == sorted(r["mean"] for r in rows)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, small).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(frame):
        return sorted(tuple(str(float(x)) if isinstance(x, (int, float)) else str(x) for x in row)
                      for row in frame[columns].astype(object).itertuples(index=False, name=None))

    assert rows(got) == rows(want)
