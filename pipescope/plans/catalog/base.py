"""Registration of queries, and the shared views as SQL common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipescope.operators.results import STEP_CODES
from pipescope.sources.views import FEATURISER_OF_TYPE, MASK_NAMES, MODEL_OF_FLAGS, TOKENISER_OF_PRIORITY

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


# Sums in another order differ in the last digits, so compared numbers are rounded; short fractions
# often lie exactly on a rounding edge, so both sides count a ten-thousandth of the last digit below it as on it.
EDGE_SHIFT = 0.0001


def rnd(c: Column | str, digits: int = 4) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column + F.lit(EDGE_SHIFT / 10**digits), digits)


def with_rounding(sql: str) -> str:
    """Write out `approx(x, digits)`, the SQL form of `rnd`."""
    while (start := sql.find("approx(")) >= 0:
        depth, end = 1, start + len("approx(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner, digits = sql[start + len("approx("):end - 1].rsplit(",", 1)
        shift = EDGE_SHIFT / 10 ** int(digits)
        sql = f"{sql[:start]}round({inner} + {shift!r},{digits}){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_rounding(sql)
        return fn

    return register


def _case(column: str, names: dict[str, str], otherwise: str = "") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {column} {whens}{otherwise} END"


_BITS = ", ".join(f"CASE WHEN (mask >> {i}) & 1 = 1 THEN '{name}' END" for i, name in enumerate(MASK_NAMES))
_CODES = _case("p", STEP_CODES, " ELSE p")

RAW = f"""raw_results AS (
  SELECT CASE WHEN mask = 0 THEN ['empty'] ELSE list_filter([{_BITS}], lambda p: p IS NOT NULL) END AS preprocessers,
         mask, tokeniser, featuriser, model, seed,
         featuriser IN ('bert_cls', 'bert_mean') AND model IN ('relu_mlp', 'no_activation_mlp', 'resnet')
           AND mask % 2 = 0 AS finetune, rmse, total_time
  FROM (SELECT p_size % 32 AS mask, {_case("substr(o_orderpriority, 1, 1)", TOKENISER_OF_PRIORITY)} AS tokeniser,
               {_case("split_part(p_type, ' ', 1)", FEATURISER_OF_TYPE)} AS featuriser,
               {_case("l_returnflag || l_linestatus", MODEL_OF_FLAGS)} AS model,
               CASE (l_linenumber - 1) % 4 WHEN 3 THEN 97 ELSE (l_linenumber - 1) % 4 + 1 END AS seed,
               CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS rmse,
               sum(l_quantity) AS total_time
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
        GROUP BY 1, 2, 3, 4, 5))"""

RECORDS = RAW + f""",
records AS (
  SELECT list_sort(preprocessers) AS preprocessers, mask, tokeniser, featuriser,
         replace(replace(model, 'relu_mlp', 'mlp'), 'no_activation_mlp', 'deep_linear') AS model,
         seed, finetune, rmse, total_time,
         array_to_string(list_sort(list_transform(preprocessers, lambda p: {_CODES})), ',') AS codes
  FROM raw_results)"""

RESULTS = RECORDS + """,
results AS (
  SELECT *, concat_ws('_', codes, tokeniser, featuriser, model) AS config_key,
         concat_ws('_', codes, tokeniser, featuriser, model, seed) AS run_key
  FROM (SELECT * REPLACE (CASE WHEN finetune THEN model || '_ft' ELSE model END AS model)
        FROM records WHERE model <> 'linear_regression')
  WHERE len(list_filter(preprocessers, lambda p: contains(p, 'number'))) = 0)"""

LOG = RAW + """,
digested AS (SELECT *, md5(concat_ws(':', mask, tokeniser, featuriser, model, seed)) AS digest FROM raw_results),
run_log AS (
  SELECT preprocessers, tokeniser, featuriser, model, finetune, s.seed,
         CASE WHEN substr(digest, 2, 1) IN ('0', '1', '2', '3') THEN 'failed' ELSE 'success' END AS status,
         CASE WHEN substr(digest, 2, 1) IN ('0', '1', '2', '3') THEN 'OOM' END AS error
  FROM (SELECT * EXCLUDE (seed), seed FROM digested WHERE substr(digest, 1, 1) NOT IN ('0', '1')
        UNION ALL
        SELECT * EXCLUDE (seed), seed + 1000 FROM digested WHERE substr(digest, 1, 1) = 'f') s)"""

PANEL = RECORDS + """,
cells AS (SELECT concat_ws('_', codes, tokeniser, featuriser, seed) AS experiment, model AS method,
                 avg(rmse) AS value FROM records GROUP BY 1, 2),
panel AS (SELECT * FROM cells WHERE experiment IN (
  SELECT experiment FROM cells GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT method) FROM cells)))"""

PREDS = """preds AS (
  SELECT CASE WHEN l_linenumber <= 4 THEN 'train' WHEN l_linenumber = 5 THEN 'val' ELSE 'test' END AS split,
         l_quantity * p_retailprice AS prediction, l_extendedprice AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CURVES = """curves AS (
  SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 2 AS INTEGER) AS epoch,
         value AS val_loss FROM events)"""

CORPUS = """corpus AS (
  SELECT d.doc_id, text, lang, source, CAST(n_chars AS DOUBLE) AS label, quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> '')"


SPLIT_SEED = 3
# the test part by the constant seed, then val among the rest
SPLIT = f"""placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('1:' || doc_id)) <= ceil(0.2 * count(*) OVER ()) AS is_test
  FROM documents),
split_of AS (
  SELECT doc_id, CASE WHEN is_test THEN 'test'
    WHEN row_number() OVER (PARTITION BY is_test ORDER BY md5('{SPLIT_SEED}:' || doc_id))
         <= ceil(0.25 * count(*) OVER (PARTITION BY is_test)) THEN 'val' ELSE 'train' END AS split
  FROM placed)"""

VECTORS = f"""ranked_words AS (
  SELECT token, row_number() OVER (ORDER BY count(*) DESC, md5(token), token) - 1 AS vec_id
  FROM (SELECT unnest({words_sql("lower(text)")}) AS token FROM documents) GROUP BY token),
vectors AS (SELECT token, embedding AS vec FROM ranked_words JOIN embeddings USING (vec_id))"""
