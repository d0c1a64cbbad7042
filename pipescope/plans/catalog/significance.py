"""Tests of significance. SQL checks statistics, p-values (tail areas by numeric integration) and decisions;
permutation p-values by the same digest order."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipescope.functions import scalar as sc
from pipescope.operators import hypothesis as hy
from pipescope.operators import permutation as pm
from pipescope.operators import ranking as rk
from pipescope.operators import results as rs
from pipescope.plans.catalog.analytics import SEGMENTS, glove_bert_pairs, timed_groups
from pipescope.plans.catalog.base import PANEL, RESULTS, query, rnd
from pipescope.sources import views as v

N = 200


def _integral(density: str, upper: str, steps: int = 4000) -> str:
    """SQL of Simpson's rule for `density` (an expression in x) from 0 to `upper`."""
    x = f"({upper}) * i / {steps}.0"
    weight = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    term = f"{weight} * ({density.replace('[x]', f'({x})')})"
    return f"(({upper}) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda i: {term})))"


def normal_p_sql(z: str) -> str:
    """Two-sided p of a standard normal statistic, by integration."""
    return f"greatest(0, 1 - 2 * {_integral('exp(-[x] * [x] / 2) / sqrt(2 * pi())', f'abs({z})')})"


def student_p_sql(t: str, dof: str) -> str:
    density = (f"exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(({dof}) * pi()) "
               f"* pow(1 + [x] * [x] / ({dof}), -(({dof}) + 1) / 2.0)")
    return f"greatest(0, 1 - 2 * {_integral(density, f'abs({t})')})"


def chi_square_p_sql(x: str, dof: str) -> str:
    """Upper tail; integrated over the root of the statistic, where the density has no pole."""
    density = f"2 * pow([x], ({dof}) - 1) * exp(-[x] * [x] / 2 - ({dof}) / 2.0 * ln(2) - lgamma(({dof}) / 2.0))"
    return f"greatest(0, 1 - {_integral(density, f'sqrt({x})')})"
SAFE = ["empty", "no_stopwords_spacy", "lowercase", "no_stopwords_nltk", "no_punctuation", "lemmatize"]
TESTED_STEPS = ["lemmatize", "lowercase", "no_punctuation", "no_stopwords_nltk", "stem"]


def _tested(df, *keys):
    return df.select(*keys, "n", "m", rnd("mean_diff").alias("mean_diff"), "extreme", "permutations",
                     rnd("p_value", 8).alias("p_value"))


def permutation_sql(sample: str, keys: str = "", one_sided: bool = False, n: int = N, block: str = "") -> str:
    """SQL of the digest-ordered permutation test over a CTE `sample` (keys, v, x, row_id [, block])."""
    pre = f"{keys}, " if keys else ""
    inside = ", ".join(c for c in (keys, block) if c)
    part = f"{inside}, perm" if inside else "perm"
    size = f"OVER (PARTITION BY {inside})" if inside else "OVER ()"
    diff, obs = ("diff", "mean_diff") if one_sided else ("abs(diff)", "abs(mean_diff)")
    join = f"JOIN obs USING ({keys})" if keys else ", obs"
    outer = f"GROUP BY {keys}" if keys else ""
    usable = (f"WHERE EXISTS (SELECT 1 FROM sample0 b WHERE b.x AND b.{block} = a.{block}"
              + (f" AND b.{keys} = a.{keys}" if keys else "")
              + f") AND EXISTS (SELECT 1 FROM sample0 b WHERE NOT b.x AND b.{block} = a.{block}"
              + (f" AND b.{keys} = a.{keys}" if keys else "") + ")") if block else ""
    return f"""{sample.replace('sample AS', 'sample0 AS')},
sample AS (SELECT * FROM sample0 a {usable}),
obs AS (SELECT {pre}count(*) FILTER (x) AS n, count(*) FILTER (NOT x) AS m,
          sum(v) FILTER (x) / count(*) FILTER (x) - sum(v) FILTER (NOT x) / count(*) FILTER (NOT x) AS mean_diff,
          max(abs(v)) * 1e-9 AS tol
        FROM sample {outer} HAVING count(*) FILTER (x) > 0 AND count(*) FILTER (NOT x) > 0),
sized AS (SELECT *, count(*) FILTER (x) {size} AS nx FROM sample),
placed AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY md5(concat_ws(':', perm, row_id, '97')), row_id)
             <= nx AS taken FROM sized, (SELECT unnest(range(1, {n + 1})) AS perm)),
perms AS (SELECT {pre}perm, sum(v) FILTER (taken) / count(*) FILTER (taken)
            - sum(v) FILTER (NOT taken) / count(*) FILTER (NOT taken) AS diff
          FROM placed GROUP BY {pre}perm)
SELECT {pre}any_value(n) AS n, any_value(m) AS m, approx(any_value(mean_diff), 4) AS mean_diff,
  count(*) FILTER ({diff} >= {obs} - tol) AS extreme, count(*) AS permutations,
  approx((count(*) FILTER ({diff} >= {obs} - tol) + 1) / (count(*) + 1), 8) AS p_value
FROM perms {join} {outer}"""


_TIMES = f"""WITH {RESULTS}, sample AS (
  SELECT total_time AS v, NOT contains(model, '_ft') AS x, run_key AS row_id FROM results
  WHERE contains(model, '_ft') OR featuriser IN ('bow_binary', 'bow_count', 'tf_idf'))"""


@query("permutation_training_times", permutation_sql(_TIMES))
def permutation_training_times(spark, d):
    sample = timed_groups(spark, d).withColumn("x", F.col("grp") == "BOW")
    return _tested(pm.permutation_test(sample, "total_time", "x", "run_key", N))


_SAFE_SQL = f"""WITH {RESULTS}, sample AS (
  SELECT rmse AS v, list_has_all({SAFE!r}, preprocessers) AS x, run_key AS row_id FROM results)"""


@query("permutation_safe_steps", permutation_sql(_SAFE_SQL, one_sided=True))
def permutation_safe_steps(spark, d):
    sample = v.results(spark, d).withColumn("x", ~rs.any_step_outside(SAFE))
    return _tested(pm.permutation_test(sample, "rmse", "x", "run_key", N, one_sided=True))


_VECTOR_SQL = f"""WITH {RESULTS}, sample AS (
  SELECT rmse AS v, featuriser NOT IN ('bert_cls', 'bert_mean', 'glove_mean') AS x, run_key AS row_id FROM results
  WHERE model NOT IN ('mlp', 'resnet', 'deep_linear', 'mlp_ft', 'resnet_ft', 'deep_linear_ft'))"""


@query("permutation_embeddings", permutation_sql(_VECTOR_SQL))
def permutation_embeddings(spark, d):
    dl = [*rs.DL_MODELS, *[f"{m}_ft" for m in rs.DL_MODELS]]
    sample = v.results(spark, d).where(~F.col("model").isin(dl)).withColumn(
        "x", ~F.col("featuriser").isin("bert_cls", "bert_mean", "glove_mean")
    )
    return _tested(pm.permutation_test(sample, "rmse", "x", "run_key", N))


_STEP_SQL = f"""WITH {RESULTS}, sample AS (
  SELECT step, rmse AS v, list_contains(preprocessers, step) AS x, run_key AS row_id
  FROM results, (SELECT unnest({TESTED_STEPS!r}) AS step))"""


@query("permutation_each_step", permutation_sql(_STEP_SQL, "step", n=100))
def permutation_each_step(spark, d):
    marked = rs.by_step(v.results(spark, d), TESTED_STEPS)
    return _tested(pm.permutation_test(marked, "rmse", "has", "run_key", 100, keys=["step"]), "step")


# the segment pairs the study compares
COMPARED = [
    ("ft vs no_ft", "BERT+DL w/ Finetuning", "BERT+DL w/o Finetuning"),
    ("ft vs bow", "BERT+DL w/ Finetuning", "BoW"),
    ("no_ft vs bow", "BERT+DL w/o Finetuning", "BoW"),
]
_ROLES = ", ".join(f"('{c}', '{a}', true), ('{c}', '{b}', false)" for c, a, b in COMPARED)
_COMPARED_SQL = f"""WITH {SEGMENTS}, roles(comparison, model_type, x) AS (VALUES {_ROLES}),
sample AS (SELECT comparison, rmse AS v, x, seed, concat_ws('_', model_type, run_key) AS row_id
           FROM segments JOIN roles USING (model_type))"""


def compared_segments(spark, d):
    segments = rs.with_segments(v.results(spark, d), rs.segment_rules())
    roles = [(c, a, True) for c, a, _ in COMPARED] + [(c, b, False) for c, _, b in COMPARED]
    role = F.explode(F.array(*[
        F.when(F.col("model_type") == segment, F.struct(F.lit(c).alias("comparison"), F.lit(x).alias("x")))
        for c, segment, x in roles
    ]))
    rows = segments.withColumn("_r", role).where(F.col("_r").isNotNull())
    return rows.select("_r.*", "rmse", "seed", F.concat_ws("_", "model_type", "run_key").alias("row_id"))


@query("permutation_segments", permutation_sql(_COMPARED_SQL, "comparison", n=100))
def permutation_segments(spark, d):
    return _tested(pm.permutation_test(compared_segments(spark, d), "rmse", "x", "row_id", 100, ["comparison"]),
                   "comparison")


_BLOCKED = permutation_sql(_COMPARED_SQL, "comparison", n=100, block="seed")


@query("permutation_scaled_times", permutation_sql(_TIMES.replace("total_time AS v", "total_time * 1e-8 AS v")).replace(
    "approx(any_value(mean_diff), 4)", "approx(any_value(mean_diff) * 1e8, 4)"))
def permutation_scaled_times(spark, d):
    """The p-value does not depend on the unit of the values."""
    sample = timed_groups(spark, d).withColumn("x", F.col("grp") == "BOW").withColumn("total_time", F.col("total_time") * F.lit(1e-8))
    out = pm.permutation_test(sample, "total_time", "x", "run_key", N)
    return _tested(out.withColumn("mean_diff", F.col("mean_diff") * F.lit(1e8)))


@query("blocked_permutation_segments", _BLOCKED)
def blocked_permutation_segments(spark, d):
    return _tested(blocked_segments(spark, d), "comparison")


def blocked_segments(spark, d):
    return pm.blocked_permutation_test(compared_segments(spark, d), "rmse", "x", "row_id", "seed", 100, ["comparison"])


@query("blocked_segments_corrected", f"""SELECT comparison, mean_diff, p_value, place, approx(place * 0.05 / 3, 8) AS threshold,
  place <= coalesce(max(CASE WHEN p_value <= place * 0.05 / 3 THEN place END) OVER (), 0) AS reject
FROM (SELECT *, row_number() OVER (ORDER BY p_value, comparison) AS place FROM ({_BLOCKED}))""")
def blocked_segments_corrected(spark, d):
    """The table of blocked tests with the Benjamini-Hochberg decision."""
    corrected = hy.benjamini_hochberg(blocked_segments(spark, d), ties=["comparison"])
    return corrected.select("comparison", rnd("mean_diff").alias("mean_diff"), rnd("p_value", 8).alias("p_value"),
                            "place", rnd("threshold", 8).alias("threshold"), "reject")


# two blocks of customers whose values lie 50 apart, with an effect of 5 in each
_TWO_BLOCKS = """WITH sample AS (SELECT c_custkey AS row_id, c_nationkey % 2 AS block, c_custkey % 3 = 0 AS x,
  CAST(100 + 50 * (c_nationkey % 2) + CASE WHEN c_custkey % 3 = 0 THEN 5 ELSE 0 END + c_custkey * 7919 % 41 - 20 AS DOUBLE) AS v
  FROM customer)"""


@query("blocked_against_plain", f"""SELECT 'plain' AS test, * FROM ({permutation_sql(_TWO_BLOCKS)})
UNION ALL SELECT 'blocked', * FROM ({permutation_sql(_TWO_BLOCKS, block='block')})""")
def blocked_against_plain(spark, d):
    """What blocks are for: the difference between them hides an effect from the plain test, not from the blocked one."""
    key, block = F.col("c_custkey"), F.col("c_nationkey") % 2
    sample = v.table(spark, d, "customer").select(
        key.alias("row_id"), block.alias("block"), (key % 3 == 0).alias("x"),
        (100 + 50 * block + F.when(key % 3 == 0, 5).otherwise(0) + key * 7919 % 41 - 20).cast("double").alias("v"))
    plain = _tested(pm.permutation_test(sample, "v", "x", "row_id", N))
    blocked = _tested(pm.blocked_permutation_test(sample, "v", "x", "row_id", "block", N))
    return plain.withColumn("test", F.lit("plain")).unionByName(blocked.withColumn("test", F.lit("blocked")))


_PAIRS = f"""pairs AS (
  SELECT b.rmse AS a, g.rmse AS b, g.run_key || '|' || b.run_key AS pair
  FROM (SELECT * FROM results WHERE featuriser = 'glove_mean') g
  JOIN (SELECT * FROM results WHERE featuriser IN ('bert_cls', 'bert_mean')) b USING (codes, model, seed))"""


def keyed_pairs(spark, d):
    return glove_bert_pairs(spark, d).withColumn("pair", F.concat_ws("|", "run_key_glove", "run_key_bert"))


@query("paired_permutation_features", f"""WITH {RESULTS}, {_PAIRS},
obs AS (SELECT count(*) AS n, avg(a - b) AS mean_diff, max(abs(a - b)) * 1e-9 AS tol FROM pairs),
perms AS (SELECT perm, avg(CASE WHEN substr(md5(concat_ws(':', perm, pair, '97')), 32, 1)
            IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN b - a ELSE a - b END) AS diff
          FROM pairs, (SELECT unnest(range(1, {N + 1})) AS perm) GROUP BY perm)
SELECT any_value(n) AS n, approx(any_value(mean_diff), 4) AS mean_diff,
  count(*) FILTER (abs(diff) >= abs(mean_diff) - tol) AS extreme, count(*) AS permutations,
  approx((count(*) FILTER (abs(diff) >= abs(mean_diff) - tol) + 1) / (count(*) + 1), 8) AS p_value
FROM perms, obs""")
def paired_permutation_features(spark, d):
    out = pm.paired_permutation_test(keyed_pairs(spark, d), "rmse_bert", "rmse_glove", "pair", N)
    return out.select("n", rnd("mean_diff").alias("mean_diff"), "extreme", "permutations", rnd("p_value", 8).alias("p_value"))


@query("paired_exhaustive_models", f"""WITH {RESULTS}, {_PAIRS},
means AS (SELECT codes, model, avg(a) AS a, avg(b) AS b FROM (
    SELECT codes, model, avg(rmse) FILTER (featuriser = 'bert_cls') AS a, avg(rmse) FILTER (featuriser = 'bert_mean') AS b
    FROM results GROUP BY codes, model) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL),
d AS (SELECT codes, a - b AS diff, row_number() OVER (PARTITION BY codes ORDER BY model) - 1 AS i FROM means),
signs AS (SELECT codes, mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -diff ELSE diff END) / count(*) AS diff,
            sum(diff) / count(*) AS mean_diff, count(*) AS n, max(abs(diff)) * 1e-9 AS tol
          FROM d JOIN (SELECT codes AS c, count(*) AS k FROM d GROUP BY 1) s ON s.c = codes,
               (SELECT unnest(range(0, 4096)) AS mask) WHERE mask < 2 ** k GROUP BY codes, mask)
SELECT codes, any_value(n) AS n, approx(any_value(mean_diff), 4) AS mean_diff,
  count(*) FILTER (abs(diff) >= abs(mean_diff) - tol) AS extreme, count(*) AS permutations,
  approx((count(*) FILTER (abs(diff) >= abs(mean_diff) - tol) + 1) / (count(*) + 1), 8) AS p_value
FROM signs GROUP BY codes""")
def paired_exhaustive_models(spark, d):
    """Per step combination: CLS against mean features over the models, with every swap pattern."""
    cls, mean = F.col("featuriser") == "bert_cls", F.col("featuriser") == "bert_mean"
    means = v.results(spark, d).groupBy("codes", "model").agg(
        F.avg(F.when(cls, F.col("rmse"))).alias("a"), F.avg(F.when(mean, F.col("rmse"))).alias("b")
    ).where("a IS NOT NULL AND b IS NOT NULL")
    out = pm.paired_exhaustive_test(means, "a", "b", "model", keys=["codes"])
    return out.select("codes", "n", rnd("mean_diff").alias("mean_diff"), "extreme", "permutations",
                      rnd("p_value", 8).alias("p_value"))


@query("monte_carlo_training_times")
def monte_carlo_training_times(spark, d):
    """As many permutations as the study draws, by random numbers."""
    sample = timed_groups(spark, d).withColumn("x", F.col("grp") == "BOW")
    return pm.monte_carlo_test(sample, "total_time", "x", "run_key", 100_000)


@query("paired_t_features", f"""WITH {RESULTS}, {_PAIRS}
SELECT n, approx(d, 4) AS mean_diff, approx(t, 6) AS t, approx({student_p_sql("t", "n - 1")}, 6) AS p_value
FROM (SELECT count(*) AS n, avg(a - b) AS d, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM pairs)""")
def paired_t_features(spark, d):
    compared = v.results(spark, d).where(F.col("featuriser").isin("glove_mean", *rs.BERT_FEATURISERS))
    marked = compared.withColumn("bert", F.col("featuriser") != "glove_mean")
    out = hy.keyed_paired_t(marked, "rmse", "bert", ["codes", "model", "seed"])
    return out.select("n", rnd("mean_diff").alias("mean_diff"), rnd("t", 6).alias("t"), rnd("p_value", 6).alias("p_value"))


_MARKED = f"""marked AS (SELECT step, rmse, list_contains(preprocessers, step) AS has
  FROM results, (SELECT unnest({TESTED_STEPS!r}) AS step)
  WHERE featuriser IN ('bow_count', 'bow_binary', 'tf_idf'))"""


def marked_steps(spark, d):
    bow = v.results(spark, d).where(F.col("featuriser").isin(rs.BOW_FEATURISERS))
    return rs.by_step(bow, TESTED_STEPS)


_POOLED = """s AS (SELECT step, count(*) FILTER (has) AS n, count(*) FILTER (NOT has) AS m,
    avg(rmse) FILTER (has) AS mx, avg(rmse) FILTER (NOT has) AS my, var_samp(rmse) FILTER (has) AS vx,
    var_samp(rmse) FILTER (NOT has) AS vy FROM marked GROUP BY step)"""


_T = "(mx - my) / sqrt(((n - 1) * vx + (m - 1) * vy) / (n + m - 2) * (1 / n + 1 / m))"


@query("pooled_t_steps", f"""WITH {RESULTS}, {_MARKED}, {_POOLED}
SELECT step, n, m, approx(mx - my, 4) AS mean_diff, approx(t, 6) AS t, approx({student_p_sql("t", "n + m - 2")}, 6) AS p_value
FROM (SELECT *, {_T} AS t FROM s)""")
def pooled_t_steps(spark, d):
    out = hy.pooled_t(marked_steps(spark, d), "rmse", "has", ["step"])
    return out.select("step", "n", "m", rnd("mean_diff").alias("mean_diff"), rnd("t", 6).alias("t"), rnd("p_value", 6).alias("p_value"))


_RANK_SUM = """ranked AS (SELECT step, has, rank() OVER (PARTITION BY step ORDER BY rmse)
    + (count(*) OVER (PARTITION BY step, rmse) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY step, rmse) AS t FROM marked),
u AS (SELECT step, count(*) FILTER (has) AS n1, count(*) FILTER (NOT has) AS n2,
        sum(r) FILTER (has) - count(*) FILTER (has) * (count(*) FILTER (has) + 1) / 2 AS u,
        sum(t::DOUBLE * t - 1) AS ties, count(*)::DOUBLE AS n FROM ranked GROUP BY step)"""


_Z = "(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))"


@query("rank_sum_steps", f"""WITH {RESULTS}, {_MARKED}, {_RANK_SUM}
SELECT step, n1, n2, CAST(u AS DOUBLE) AS u, approx(z, 6) AS z, approx({normal_p_sql("greatest(z, 0)")}, 6) AS p_value
FROM (SELECT *, {_Z} AS z FROM u)""")
def rank_sum_steps(spark, d):
    out = hy.mann_whitney(marked_steps(spark, d), "rmse", "has", ["step"])
    return out.select("step", "n1", "n2", "u", rnd("z", 6).alias("z"), rnd("p_value", 6).alias("p_value"))


@query("rank_sum_cls_mean", f"""WITH {RESULTS}, marked AS (
  SELECT 'all' AS step, rmse, featuriser = 'bert_cls' AS has FROM results WHERE featuriser IN ('bert_cls', 'bert_mean')),
{_RANK_SUM} SELECT n1, n2, CAST(u AS DOUBLE) AS u FROM u""")
def rank_sum_cls_mean(spark, d):
    bert = v.results(spark, d).where(F.col("featuriser").isin(rs.BERT_FEATURISERS))
    marked = bert.withColumn("has", F.col("featuriser") == "bert_cls")
    return hy.mann_whitney(marked, "rmse", "has").select("n1", "n2", "u")


_K2 = """m AS (SELECT step, has, count(*)::DOUBLE AS n, avg(rmse) AS mu FROM marked GROUP BY 1, 2),
c AS (SELECT step, has, any_value(n) AS n, avg((rmse - mu) ** 2) AS m2, avg((rmse - mu) ** 3) AS m3, avg((rmse - mu) ** 4) AS m4
      FROM marked JOIN m USING (step, has) GROUP BY 1, 2),
g AS (SELECT step, has, n, m3 / m2 ** 1.5 AS g1, m4 / m2 ** 2 AS b2 FROM c),
h AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
        (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))) AS x,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM g),
i AS (SELECT *, -1 + sqrt(2 * (beta - 1)) AS w2, 6 + 8 / s * (2 / s + sqrt(1 + 4 / s ** 2)) AS a FROM h),
k AS (SELECT step, has, n, (asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2))) ** 2
        + ((1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a))) ** 2 AS k2 FROM i)"""


# all subsets of 24 places, cut in halves of 12: how many subsets of the first `places` have `size` members and sum `total`
_SUBSETS = """half AS (SELECT m, bit_count(m)::INTEGER AS size,
    list_sum(list_transform(range(12), lambda i: ((m >> i) & 1) * (i + 1)))::INTEGER AS total FROM (SELECT unnest(range(4096)) AS m)),
subsets AS (SELECT CASE WHEN hi.m > 0 THEN 13 + floor(log2(hi.m))::INTEGER WHEN lo.m > 0 THEN 1 + floor(log2(lo.m))::INTEGER ELSE 0 END AS places,
    lo.size + hi.size AS size, lo.total + hi.total + 12 * hi.size AS total, count(*) AS orders FROM half lo, half hi GROUP BY ALL)"""
_CELL = ["featuriser", "model", "tokeniser", "seed", "step"]
_CELLS = ", ".join(_CELL)


# untied samples, the smaller of at most eight rows, by enumeration of all orders; the others by the normal form
@query("rank_sum_small_samples", f"""WITH {RESULTS}, marked AS (
  SELECT {_CELLS}, rmse, list_contains(preprocessers, step) AS has FROM results, (SELECT unnest({TESTED_STEPS!r}) AS step)),
{_RANK_SUM.replace("step, has", f"{_CELLS}, has").replace("PARTITION BY step", f"PARTITION BY {_CELLS}").replace("SELECT step, count", f"SELECT {_CELLS}, count").replace("GROUP BY step", f"GROUP BY {_CELLS}")},
{_SUBSETS}, sized AS (SELECT *, {_Z} AS z, ties = 0 AND least(n1, n2) <= 8 AS exact FROM u WHERE n1 > 0 AND n2 > 0),
wanted AS (SELECT DISTINCT least(n1, n2) AS size, n1 + n2 AS places, least(u, n1 * n2 - u) AS low FROM sized WHERE exact),
law AS (SELECT w.size, w.places, w.low, sum(orders) FILTER (total - w.size * (w.size + 1) / 2 <= w.low) / sum(orders) AS share
  FROM wanted w JOIN subsets s ON s.size = w.size AND s.places <= w.places GROUP BY ALL)
SELECT {_CELLS}, n1, n2, CAST(u AS DOUBLE) AS u, exact,
       approx(CASE WHEN exact THEN least(1, 2 * share) ELSE {normal_p_sql("greatest(z, 0)")} END, 6) AS p_value
FROM sized LEFT JOIN law ON law.size = least(n1, n2) AND law.places = n1 + n2 AND law.low = least(u, n1 * n2 - u)""")
def rank_sum_small_samples(spark, d):
    marked = rs.by_step(v.results(spark, d), TESTED_STEPS)
    ties = marked.groupBy(*_CELL).agg((F.count_distinct("rmse") == F.count("rmse")).alias("_untied"))
    tested = hy.mann_whitney(marked, "rmse", "has", _CELL).join(ties, _CELL)
    return tested.select(*_CELL, "n1", "n2", "u", (F.col("_untied") & (F.least("n1", "n2") <= hy.EXACT_SAMPLE)).alias("exact"),
                         rnd("p_value", 6).alias("p_value"))


@query("normality_steps", f"""WITH {RESULTS}, {_MARKED}, {_K2}
SELECT step, has, CAST(n AS BIGINT) AS n, approx(k2, 4) AS k2, approx(exp(-k2 / 2), 6) AS normality_p FROM k""")
def normality_steps(spark, d):
    out = hy.normality(marked_steps(spark, d), "rmse", ["step", "has"])
    return out.select("step", "has", "n", rnd("k2").alias("k2"), rnd("normality_p", 6).alias("normality_p"))


@query("chosen_tests_steps", f"""WITH {RESULTS}, {_MARKED}, {_K2},
p AS (SELECT step, max(exp(-k2 / 2)) FILTER (has) AS p_with, max(exp(-k2 / 2)) FILTER (NOT has) AS p_without FROM k GROUP BY step)
SELECT step, count(*) FILTER (has) AS n1, count(*) FILTER (NOT has) AS n2,
  approx(avg(rmse) FILTER (has) - avg(rmse) FILTER (NOT has), 4) AS mean_diff,
  CASE WHEN any_value(p_with) > 0.05 AND any_value(p_without) > 0.05 THEN 't-test' ELSE 'Mann-Whitney U' END AS test
FROM marked JOIN p USING (step) GROUP BY step""")
def chosen_tests_steps(spark, d):
    out = hy.compare_by_normality(marked_steps(spark, d), "rmse", "has", ["step"])
    return out.select("step", "n1", "n2", rnd("mean_diff").alias("mean_diff"), "test")


@query("chosen_tests_with_p", f"""WITH {RESULTS}, {_MARKED}, {_K2}, {_POOLED}, {_RANK_SUM},
p AS (SELECT step, max(exp(-k2 / 2)) FILTER (has) AS p_with, max(exp(-k2 / 2)) FILTER (NOT has) AS p_without FROM k GROUP BY step),
tt AS (SELECT step, n + m - 2 AS dof, mx - my AS mean_diff, {_T} AS t FROM s),
uu AS (SELECT step, n1, n2, u, {_Z} AS z FROM u)
SELECT step, n1, n2, approx(mean_diff, 4) AS mean_diff, approx(t, 6) AS t, CAST(u AS DOUBLE) AS u, approx(p_with, 6) AS p_with,
  approx(p_without, 6) AS p_without,
  CASE WHEN p_with > 0.05 AND p_without > 0.05 THEN 't-test' ELSE 'Mann-Whitney U' END AS test,
  approx(CASE WHEN p_with > 0.05 AND p_without > 0.05 THEN {student_p_sql("t", "dof")}
              ELSE {normal_p_sql("greatest(z, 0)")} END, 6) AS p_value
FROM p JOIN tt USING (step) JOIN uu USING (step)""")
def chosen_tests_with_p(spark, d):
    out = hy.compare_by_normality(marked_steps(spark, d), "rmse", "has", ["step"])
    digits = {"mean_diff": 4, "t": 6, "p_with": 6, "p_without": 6, "p_value": 6}
    return out.select("step", "n1", "n2", "u", "test", *[rnd(c, n).alias(c) for c, n in digits.items()])


_WILCOXON = """diffs AS (SELECT x.method AS a, y.method AS b, x.value - y.value AS d
  FROM panel x JOIN panel y ON x.experiment = y.experiment AND x.method < y.method),
absr AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r,
           count(*) OVER (PARTITION BY a, b, abs(d)) AS t FROM diffs),
w AS (SELECT a, b, count(*)::DOUBLE AS n, count(*) FILTER (d = 0)::DOUBLE AS z0,
        least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS statistic,
        coalesce(sum(t::DOUBLE * t - 1) FILTER (d <> 0), 0) AS ties FROM absr GROUP BY a, b),
wz AS (SELECT *, (statistic - (n * (n + 1) / 4 - z0 * (z0 + 1) / 4))
         / sqrt((n * (n + 1) * (2 * n + 1) - z0 * (z0 + 1) * (2 * z0 + 1) - ties / 2) / 24) AS z FROM w)"""


_PAIR_P = f"coalesce({normal_p_sql('z')}, 1)"
# step-down decisions: the largest |z| has the smallest p
_HOLM = f"""stepped AS (SELECT *, {_PAIR_P} AS p, row_number() OVER (ORDER BY abs(z) DESC, a, b) AS place, count(*) OVER () AS m FROM wz),
decided AS (SELECT *, 0.05 / (m - place + 1) AS threshold,
  bool_and(p <= 0.05 / (m - place + 1)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reject FROM stepped)"""


@query("signed_rank_pairs", f"""WITH {PANEL}, {_WILCOXON}
SELECT a, b, CAST(n AS BIGINT) AS n, CAST(z0 AS BIGINT) AS zeros, CAST(statistic AS DOUBLE) AS statistic,
       approx(z, 6) AS z, approx({_PAIR_P}, 6) AS p_value FROM wz""")
def signed_rank_pairs(spark, d):
    return hy.wilcoxon_pairs(v.panel(spark, d)).select(
        "a", "b", "n", "zeros", "statistic", rnd("z", 6).alias("z"), rnd("p_value", 6).alias("p_value"))


# every assignment of signs to the ranks: the sums over the first ten of them, joined with the sums over the others
_SIGNS = """ranks AS (SELECT codes, featuriser, a, b, list(r ORDER BY r) AS rs FROM absr GROUP BY ALL),
first_sums AS (SELECT codes, featuriser, a, b, unnest(list_reduce(list_transform(rs[1:10], lambda x: [x]),
    lambda sums, x: list_concat(sums, list_transform(sums, lambda s: s + x[1])), [0.0])) AS s FROM ranks),
other_sums AS (SELECT codes, featuriser, a, b, unnest(list_reduce(list_transform(rs[11:], lambda x: [x]),
    lambda sums, x: list_concat(sums, list_transform(sums, lambda s: s + x[1])), [0.0])) AS s FROM ranks),
signed AS (SELECT w.codes, w.featuriser, w.a, w.b, avg(CASE WHEN f.s + o.s <= w.statistic THEN 1.0 ELSE 0.0 END) AS share
  FROM wz w JOIN first_sums f USING (codes, featuriser, a, b) JOIN other_sums o USING (codes, featuriser, a, b) GROUP BY ALL)"""
_SMALL_PANEL = """small AS (SELECT DISTINCT codes, featuriser, concat_ws('_', codes, tokeniser, featuriser, seed) AS experiment FROM records),
panels AS (SELECT codes, featuriser, panel.* FROM panel JOIN small USING (experiment))"""


@query("signed_rank_small_panels", f"""WITH {PANEL}, {_SMALL_PANEL}, {_WILCOXON.replace("SELECT x.method", "SELECT x.codes, x.featuriser, x.method").replace("FROM panel x JOIN panel y", "FROM panels x JOIN panels y").replace("PARTITION BY a, b", "PARTITION BY codes, featuriser, a, b").replace("SELECT a, b, count", "SELECT codes, featuriser, a, b, count").replace("GROUP BY a, b", "GROUP BY codes, featuriser, a, b")},
{_SIGNS}
SELECT codes, featuriser, a, b, CAST(n AS BIGINT) AS n, CAST(statistic AS DOUBLE) AS statistic, approx(least(1, 2 * share), 6) AS p_value
FROM wz JOIN signed USING (codes, featuriser, a, b)""")
def signed_rank_small_panels(spark, d):
    """The methods of each step combination and featuriser compared over its few tokenisers and seeds."""
    names = rs.clean_records(v.raw_results(spark, d)).select(
        "codes", "featuriser", sc.joined_key("codes", "tokeniser", "featuriser", "seed").alias("experiment")).distinct()
    panels = v.panel(spark, d).join(names, "experiment")
    return hy.wilcoxon_pairs(panels, ["codes", "featuriser"]).select(
        "codes", "featuriser", "a", "b", "n", "statistic", rnd("p_value", 6).alias("p_value"))


@query("holm_pairs", f"""WITH {PANEL}, {_WILCOXON}, {_HOLM}
SELECT a, b, approx(p, 6) AS p_value, approx(threshold, 8) AS threshold, reject FROM decided""")
def holm_pairs(spark, d):
    tested = hy.holm(hy.wilcoxon_pairs(v.panel(spark, d)))
    return tested.select("a", "b", rnd("p_value", 6).alias("p_value"), rnd("threshold", 8).alias("threshold"), "reject")


_FRIEDMAN = """ranked AS (SELECT *, rank() OVER (PARTITION BY experiment ORDER BY value)
    + (count(*) OVER (PARTITION BY experiment, value) - 1) / 2.0 AS r,
    count(*) OVER (PARTITION BY experiment, value) AS t FROM panel),
m AS (SELECT method, sum(r) AS rj, count(*)::DOUBLE AS n FROM ranked GROUP BY method),
s AS (SELECT count(*)::DOUBLE AS k, max(n) AS n, sum(rj * rj) AS r2 FROM m),
ti AS (SELECT sum(t::DOUBLE * t - 1) AS ties FROM ranked),
chi AS (SELECT n, k, (12 / (n * k * (k + 1)) * r2 - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS x FROM s, ti),
friedman AS (SELECT n, k, x, """ + chi_square_p_sql("x", "k - 1") + """ AS p FROM chi)"""


@query("friedman_methods", f"""WITH {PANEL}, {_FRIEDMAN}
SELECT CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, approx(x, 6) AS chi_square, approx(p, 6) AS p_value FROM friedman""")
def friedman_methods(spark, d):
    return hy.friedman(v.panel(spark, d)).select("n", "k", rnd("chi_square", 6).alias("chi_square"), rnd("p_value", 6).alias("p_value"))


def _decisions(tested):
    return tested.select("a", "b", "n", rnd("z", 6).alias("z"), rnd("p_value", 6).alias("p_value"), "reject")


_GATED = f"""{_FRIEDMAN}, {_WILCOXON}, {_HOLM}
SELECT a, b, CAST(n AS BIGINT) AS n, approx(z, 6) AS z, approx(p, 6) AS p_value, reject
FROM decided WHERE (SELECT p FROM friedman) < 0.05"""


@query("gated_method_pairs", f"WITH {PANEL}, {_GATED}")
def gated_method_pairs(spark, d):
    """Pairwise decisions, none when the Friedman test does not reject."""
    return _decisions(hy.gated_pairs(v.panel(spark, d)))


SHIFTED = "value + 0.01 * abs(value) * length(method)"


@query("gated_shifted_pairs", f"WITH {PANEL.replace('panel AS (SELECT *', f'panel AS (SELECT * REPLACE ({SHIFTED} AS value)')}, {_GATED}")
def gated_shifted_pairs(spark, d):
    """The same where methods differ by construction, so that the gate opens."""
    return _decisions(hy.gated_pairs(v.panel(spark, d).withColumn("value", F.expr(SHIFTED))))


@query("method_cliques", f"""WITH {PANEL}, {_WILCOXON}, {_HOLM},
edges AS (SELECT a, b FROM decided WHERE NOT reject),
names AS (SELECT method, row_number() OVER (ORDER BY method) - 1 AS i FROM (SELECT DISTINCT method FROM panel)),
masks AS (SELECT m, list(method ORDER BY method) AS members FROM names, (SELECT unnest(range(0, 64)) AS m)
          WHERE (m >> i) & 1 = 1 GROUP BY m HAVING count(*) >= 2),
cliques AS (SELECT members FROM masks WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT unnest(members) AS x) p, (SELECT unnest(members) AS y) q
  WHERE p.x < q.y AND NOT EXISTS (SELECT 1 FROM edges WHERE a = p.x AND b = q.y)))
SELECT array_to_string(members, ',') AS clique, len(members) AS size FROM cliques c
WHERE NOT EXISTS (SELECT 1 FROM cliques o WHERE len(o.members) > len(c.members) AND list_has_all(o.members, c.members))""")
def method_cliques(spark, d):
    """Maximal groups of methods that the step-down decisions do not tell apart."""
    edges = hy.holm(hy.wilcoxon_pairs(v.panel(spark, d))).where(~F.col("reject")).select("a", "b")
    found = rk.maximal_cliques(edges)
    return found.select(F.array_join("clique", ",").alias("clique"), F.col("size").cast("long").alias("size"))
