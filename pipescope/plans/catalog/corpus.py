"""Corpus work: splits, cleaning, tokenising, features and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipescope.functions import registry
from pipescope.functions import text as tx
from pipescope.functions.scalar import PUNCTUATION
from pipescope.operators import boosting
from pipescope.operators import features as ft
from pipescope.operators import models as md
from pipescope.operators import sampling as sp
from pipescope.operators import vocabulary as vo
from pipescope.operators.aggregates import evaluate
from pipescope.plans import experiment as xp
from pipescope.plans.catalog.base import CORPUS, SPLIT, SPLIT_SEED, VECTORS, query, rnd, words_sql
from pipescope.session import cut_lineage
from pipescope.sources import files as fl
from pipescope.sources import views as v

WIDTH = 64  # of the embedding table
WORDS = words_sql("text")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def documents(spark, d):
    return v.table(spark, d, "documents").select("doc_id", "text")


def split_documents(spark, d):
    return sp.split_corpus(v.corpus(spark, d).select("doc_id", "text", "label"), SPLIT_SEED)


def tokenised(spark, d):
    return split_documents(spark, d).withColumn("tokens", tx.whitespace_tokens("text"))


# --- splits and samples ----------------------------------------------------------------------------


@query("labelled_corpus", f"WITH {CORPUS} SELECT doc_id, md5(text) AS text_md5, lang, source, label, coalesce(quality, -1) AS quality FROM corpus")
def labelled_corpus(spark, d):
    return v.corpus(spark, d).select(
        "doc_id", F.md5("text").alias("text_md5"), "lang", "source", "label",
        F.coalesce("quality", F.lit(-1)).alias("quality"),
    )


@query("corpus_split", f"WITH {SPLIT} SELECT doc_id, split FROM split_of")
def corpus_split(spark, d):
    return sp.split_corpus(documents(spark, d), SPLIT_SEED).select("doc_id", "split")


@query("downsampled_train", f"""WITH {SPLIT}
SELECT doc_id, split FROM (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('1:' || doc_id)) AS place,
         count(*) OVER (PARTITION BY split) AS n FROM split_of)
WHERE split <> 'train' OR place <= floor(0.2 * n)""")
def downsampled_train(spark, d):
    return sp.downsample_train(sp.split_corpus(documents(spark, d), SPLIT_SEED), 0.2).select("doc_id", "split")


@query("sampled_texts", "SELECT doc_id, text FROM documents ORDER BY md5('42:' || doc_id) LIMIT 10")
def sampled_texts(spark, d):
    return sp.sample_rows(documents(spark, d), 10, 42)


def _uniform(draw: str) -> str:
    return f"((('0x' || substr(md5(concat_ws(':', '1', doc_id, '{draw}')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)"


@query("synthetic_corpus", f"""SELECT doc_id, array_to_string(list_slice({WORDS}, 1, 500), ' ') AS text,
  approx(sqrt(-2 * ln({_uniform('radius')})) * cos(2 * pi() * {_uniform('angle')}), 6) + 0.0 AS label
FROM documents ORDER BY doc_id LIMIT 100""")
def synthetic_corpus(spark, d):
    return fl.synthetic_corpus(documents(spark, d)).withColumn("label", rnd("label", 6) + 0.0)


# --- vocabulary and characters ---------------------------------------------------------------------


@query("distinct_words", f"""SELECT token, count(*) AS n FROM (SELECT unnest({WORDS}) AS token FROM documents) GROUP BY token""")
def distinct_words(spark, d):
    return vo.distinct_words(documents(spark, d), tx.whitespace_tokens("text"))


@query("distinct_characters", """SELECT char, count(*) AS docs FROM (
  SELECT DISTINCT doc_id, unnest(string_split(text, '')) AS char FROM documents) WHERE char <> '' GROUP BY char""")
def distinct_characters(spark, d):
    return vo.characters(documents(spark, d))


@query("vocabulary_sizes", f"""SELECT lang, count(DISTINCT token) AS words FROM (
  SELECT lang, unnest({WORDS}) AS token FROM documents) GROUP BY lang""")
def vocabulary_sizes(spark, d):
    """Distinct words per corpus; distinct pairs first, so that no count holds a whole vocabulary."""
    words = v.table(spark, d, "documents").select("lang", F.explode(tx.whitespace_tokens("text")).alias("token"))
    return words.distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("words"))


# --- cleaning steps --------------------------------------------------------------------------------


@query("lowercased_text", "SELECT doc_id, md5(lower(text)) AS text_md5 FROM documents")
def lowercased_text(spark, d):
    return documents(spark, d).select("doc_id", F.md5(tx.lowercase("text")).alias("text_md5"))


@query("text_without_punctuation",
       f"SELECT doc_id, md5(translate(text, {quoted(PUNCTUATION)}, repeat(' ', 32))) AS text_md5 FROM documents")
def text_without_punctuation(spark, d):
    return documents(spark, d).select("doc_id", F.md5(tx.punctuation_to_space("text")).alias("text_md5"))


@query("text_without_digits", "SELECT doc_id, md5(regexp_replace(text, '\\p{Nd}+', ' ', 'g')) AS text_md5 FROM documents")
def text_without_digits(spark, d):
    return documents(spark, d).select("doc_id", F.md5(tx.digits_to_space("text")).alias("text_md5"))


_NUMBER = f"""regexp_matches(translate(regexp_replace(w, '^[-+±~]', ''), ',.', ''), '^\\p{{Nd}}+$')
  OR regexp_matches(regexp_replace(w, '^[-+±~]', ''), '^\\p{{Nd}}+/\\p{{Nd}}+$')
  OR lower(regexp_replace(w, '^[-+±~]', '')) IN ({', '.join(quoted(w) for w in tx.NUMBER_WORDS)})"""


@query("text_without_numbers", f"""SELECT doc_id, md5(array_to_string(list_transform(list_filter(list_transform(
    regexp_extract_all(text, '[^\\s]+\\s*|^\\s+'), lambda p: {{'p': p, 'w': regexp_replace(p, '\\s+', '', 'g')}}),
    lambda q: NOT ({_NUMBER.replace("(w,", "(q.w,")})), lambda q: q.p), '')) AS text_md5 FROM documents""")
def text_without_numbers(spark, d):
    return documents(spark, d).select("doc_id", F.md5(tx.drop_numbers("text")).alias("text_md5"))


STOP = ["the", "of", "and", "to", "in", "le", "la", "de", "und", "der", "el"]


@query("text_without_stop_words", f"""SELECT doc_id, md5(array_to_string(list_filter({WORDS},
  lambda t: t NOT IN ({', '.join(quoted(w) for w in STOP)})), ' ')) AS text_md5 FROM documents""")
def text_without_stop_words(spark, d):
    return documents(spark, d).select("doc_id", F.md5(tx.drop_stop_words("text", STOP)).alias("text_md5"))


@query("stemmed_text")
def stemmed_text(spark, d):
    return vo.stem_text(documents(spark, d))


def plural_lexicon(spark, d):
    """(token, lemma) learnt from the corpus: a word in -s whose form without it occurs as well."""
    words = vo.distinct_words(documents(spark, d), tx.whitespace_tokens("text")).select("token")
    plural = words.where(F.col("token").endswith("s") & (F.length("token") > 3)).select(
        "token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma")
    )
    return plural.join(words.select(F.col("token").alias("lemma")), "lemma", "left_semi")


_PIECES = "regexp_extract_all(text, '[^\\s]+\\s*|^\\s+')"
_LEMMAS = f"""words AS (SELECT DISTINCT unnest({WORDS}) AS token FROM documents),
lexicon AS (SELECT token, substr(token, 1, length(token) - 1) AS lemma FROM words
  WHERE ends_with(token, 's') AND length(token) > 3 AND substr(token, 1, length(token) - 1) IN (SELECT token FROM words)),
cut AS (SELECT doc_id, unnest({_PIECES}) AS piece, unnest(range(1, len({_PIECES}) + 1)) AS i FROM documents),
pieces AS (SELECT doc_id, i, piece, regexp_replace(piece, '\\s+', '', 'g') AS token FROM cut)"""


@query("lemmatised_text", f"""WITH {_LEMMAS}
SELECT doc_id, md5(string_agg(coalesce(lemma, token) || substr(piece, length(token) + 1), '' ORDER BY i)) AS text_md5
FROM pieces LEFT JOIN lexicon USING (token) GROUP BY doc_id""")
def lemmatised_text(spark, d):
    out = vo.lemmatise_text(documents(spark, d), plural_lexicon(spark, d))
    return out.select("doc_id", F.md5("text").alias("text_md5"))


def tag_lexicon(spark, d):
    """(token, pos_tag) from the benchmark texts: short words count as determiners, others as nouns."""
    words = vo.distinct_words(v.table(spark, d, "benchmark"), tx.whitespace_tokens("text")).select("token")
    return words.withColumn("pos_tag", F.when(F.length("token") <= 3, "DET").otherwise("NOUN"))


@query("text_without_closed_classes", f"""WITH {_LEMMAS}, tags AS (
  SELECT DISTINCT unnest({WORDS}) AS token FROM benchmark)
SELECT doc_id, md5(coalesce(string_agg(piece, '' ORDER BY i)
    FILTER (NOT (token IN (SELECT token FROM tags) AND length(token) <= 3)), '')) AS text_md5
FROM pieces GROUP BY doc_id""")
def text_without_closed_classes(spark, d):
    out = vo.drop_closed_class(documents(spark, d), tag_lexicon(spark, d))
    return out.select("doc_id", F.md5("text").alias("text_md5"))


@query("chained_steps", f"""SELECT doc_id, md5(translate(regexp_replace(lower(text), '\\p{{Nd}}+', ' ', 'g'),
  {quoted(PUNCTUATION)}, repeat(' ', 32))) AS text_md5 FROM documents""")
def chained_steps(spark, d):
    """Registry order applies however the steps are requested."""
    out = registry.apply_steps(documents(spark, d), ["no_punctuation", "no_numbers_simple", "lowercase"])
    return out.select("doc_id", F.md5("text").alias("text_md5"))


# --- tokenisers ------------------------------------------------------------------------------------


def token_digest(df, tokens="tokens"):
    """Number of tokens and a digest of the token list of every document."""
    return df.select("doc_id", F.size(tokens).cast("long").alias("n"), F.md5(F.array_join(tokens, "\u0001")).alias("digest"))


_DIGEST = "CAST(len(tokens) AS BIGINT) AS n, md5(array_to_string(tokens, chr(1))) AS digest"


@query("whitespace_tokens", f"SELECT doc_id, {_DIGEST} FROM (SELECT doc_id, {WORDS} AS tokens FROM documents)")
def whitespace_tokens(spark, d):
    return token_digest(documents(spark, d).withColumn("tokens", tx.whitespace_tokens("text")))


def treebank_sql() -> str:
    out = "text"
    for pattern, replacement in tx.TREEBANK_RULES:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return words_sql(out)


@query("treebank_tokens", f"SELECT doc_id, {_DIGEST} FROM (SELECT doc_id, {treebank_sql()} AS tokens FROM documents)")
def treebank_tokens(spark, d):
    return token_digest(documents(spark, d).withColumn("tokens", tx.treebank_tokens("text")))


_NAMED = "CASE t " + " ".join(f"WHEN '{b}' THEN '{n}'" for b, n in tx.BRACKET_NAMES) + " ELSE t END"


@query("ptb_tokens", f"""SELECT doc_id, {_DIGEST} FROM (
  SELECT doc_id, list_transform({treebank_sql()}, lambda t: {_NAMED}) AS tokens FROM documents)""")
def ptb_tokens(spark, d):
    return token_digest(documents(spark, d).withColumn("tokens", tx.ptb_tokens("text")))


_EDGE = f"chr({ord(vo.SYMBOL_EDGE)})"
BPE_ROUNDS = 20


def bpe_sql(rounds: int) -> str:
    """Merge rounds unrolled: each one counts pairs over the distinct words and replaces the best pair."""
    parts = [f"""w0 AS (SELECT token, count(*) AS n, array_to_string(list_transform(string_split('{vo.WORD_START}' || token, ''),
    lambda c: {_EDGE} || c || {_EDGE}), '') AS s FROM (SELECT unnest({WORDS}) AS token FROM documents) GROUP BY token)"""]
    for k in range(rounds):
        parts.append(f"""y{k} AS MATERIALIZED (SELECT n, string_split(substr(s, 2, length(s) - 2), {_EDGE} || {_EDGE}) AS x FROM w{k}),
p{k} AS MATERIALIZED (SELECT p.l, p.r, sum(n) AS n FROM (
  SELECT n, unnest(list_transform(range(1, len(x)), lambda i: {{'l': x[i], 'r': x[i + 1]}})) AS p FROM y{k})
  GROUP BY p.l, p.r ORDER BY 3 DESC, 1, 2 LIMIT 1),
w{k + 1} AS MATERIALIZED (SELECT token, w{k}.n, replace(s, {_EDGE} || l || {_EDGE} || {_EDGE} || r || {_EDGE}, {_EDGE} || l || r || {_EDGE}) AS s
  FROM w{k}, p{k})""")
    return ",\n".join(parts)


@query("byte_pair_words", f"""WITH {bpe_sql(BPE_ROUNDS)}
SELECT token, array_to_string(string_split(substr(s, 2, length(s) - 2), {_EDGE} || {_EDGE}), ' ') AS pieces FROM w{BPE_ROUNDS}""")
def byte_pair_words(spark, d):
    words = vo.distinct_words(documents(spark, d), tx.whitespace_tokens("text"))
    return vo.learn_merges(words, BPE_ROUNDS)[1].select("token", F.array_join("pieces", " ").alias("pieces"))


@query("byte_pair_tokens", f"""WITH {bpe_sql(BPE_ROUNDS)},
cut AS (SELECT token, string_split(substr(s, 2, length(s) - 2), {_EDGE} || {_EDGE}) AS pieces FROM w{BPE_ROUNDS}),
placed AS (SELECT doc_id, unnest({WORDS}) AS token, unnest(range(1, len({WORDS}) + 1)) AS i FROM documents),
docs AS (SELECT doc_id, flatten(list(pieces ORDER BY i)) AS tokens FROM placed JOIN cut USING (token) GROUP BY doc_id)
SELECT doc_id, {_DIGEST} FROM docs""")
def byte_pair_tokens(spark, d):
    return token_digest(vo.bpe_tokens(documents(spark, d), BPE_ROUNDS))


@query("word_piece_tokens")
def word_piece_tokens(spark, d):
    docs = documents(spark, d)
    vocabulary = vo.wordpiece_vocabulary(vo.distinct_words(docs, tx.whitespace_tokens(F.lower("text"))), 2000)
    return token_digest(vo.wordpiece_tokens(docs, vocabulary))


# --- features --------------------------------------------------------------------------------------

_TERMS = f"""{SPLIT},
toks AS (SELECT doc_id, split, {WORDS} AS t FROM documents JOIN split_of USING (doc_id)),
exploded AS (SELECT doc_id, split, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term
  FROM toks),
counts AS (SELECT doc_id, split, term, count(*) AS tf FROM exploded GROUP BY 1, 2, 3),
fitted AS (SELECT term, sum(tf) AS total, count(*) AS df FROM counts WHERE split = 'train' GROUP BY term
  ORDER BY 2 DESC, md5(term) LIMIT {ft.MAX_FEATURES})"""


@query("fitted_terms", f"WITH {_TERMS} SELECT term, CAST(total AS BIGINT) AS total, df FROM fitted")
def fitted_terms(spark, d):
    return ft.fit_terms(tokenised(spark, d))


@query("word_count_features", f"""WITH {_TERMS}
SELECT doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS largest
FROM counts WHERE term IN (SELECT term FROM fitted) GROUP BY doc_id""")
def word_count_features(spark, d):
    docs = tokenised(spark, d)
    bag = ft.bag_of_words(docs, ft.fit_terms(docs))
    return bag.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("total"), F.max("tf").alias("largest"))


@query("binary_word_features", f"""WITH {_TERMS}
SELECT split, term, count(*) AS docs FROM counts WHERE term IN (SELECT term FROM fitted) GROUP BY 1, 2""")
def binary_word_features(spark, d):
    docs = tokenised(spark, d)
    bag = ft.bag_of_words(docs, ft.fit_terms(docs), binary=True)
    return bag.groupBy("split", "term").agg(F.sum("tf").alias("docs"))


@query("tf_idf_features", f"""WITH {_TERMS},
n AS (SELECT count(*) AS n FROM toks WHERE split = 'train'),
weighted AS (SELECT doc_id, split, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM counts JOIN fitted USING (term), n)
SELECT doc_id, split, term, approx(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 8) AS weight FROM weighted""")
def tf_idf_features(spark, d):
    docs = tokenised(spark, d)
    return ft.tf_idf(docs, ft.fit_terms(docs)).withColumn("weight", rnd("weight", 8))


_WORD_VECS = f"""{VECTORS},
toks AS (SELECT doc_id, unnest({WORDS}) AS token, unnest(range(1, len({WORDS}) + 1)) AS pos FROM documents),
found AS (SELECT doc_id, pos, vec FROM toks JOIN vectors USING (token))"""


def _long(df):
    """(doc_id, dim, value) of a vector column."""
    return df.select("doc_id", F.posexplode("features").alias("dim", "value")).select(
        "doc_id", "dim", (rnd(F.col("value").cast("double"), 6) + 0.0).alias("value")
    )


def plain_tokens(spark, d):
    return documents(spark, d).withColumn("tokens", tx.whitespace_tokens("text"))


@query("mean_word_vectors", f"""WITH {_WORD_VECS},
unit AS (SELECT doc_id, list_transform(vec, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(vec, lambda y: y::DOUBLE * y::DOUBLE)))) AS u
         FROM found),
dims AS (SELECT doc_id, unnest(range(0, {WIDTH})) AS dim, unnest(u) AS x FROM unit),
means AS (SELECT doc_id, dim, avg(x) AS value FROM dims GROUP BY 1, 2)
SELECT d.doc_id, g.dim, approx(coalesce(value, 0), 6) + 0.0 AS value
FROM documents d CROSS JOIN (SELECT unnest(range(0, {WIDTH})) AS dim) g LEFT JOIN means m ON m.doc_id = d.doc_id AND m.dim = g.dim""")
def mean_word_vectors(spark, d):
    return _long(ft.mean_vectors(plain_tokens(spark, d), v.token_vectors(spark, d), WIDTH))


@query("first_position_vectors", f"""WITH {_WORD_VECS}, first AS (SELECT doc_id, arg_min(vec, pos) AS vec FROM found GROUP BY doc_id),
dims AS (SELECT doc_id, unnest(range(0, {WIDTH})) AS dim, unnest(vec)::DOUBLE AS x FROM first)
SELECT d.doc_id, g.dim, approx(coalesce(x, 0), 6) + 0.0 AS value
FROM documents d CROSS JOIN (SELECT unnest(range(0, {WIDTH})) AS dim) g LEFT JOIN dims m ON m.doc_id = d.doc_id AND m.dim = g.dim""")
def first_position_vectors(spark, d):
    docs = plain_tokens(spark, d)
    return _long(ft.first_vector(docs, ft.token_vector_rows(docs, v.token_vectors(spark, d)), WIDTH))


@query("mean_position_vectors", f"""WITH {_WORD_VECS},
dims AS (SELECT doc_id, unnest(range(0, {WIDTH})) AS dim, unnest(vec)::DOUBLE AS x FROM found),
means AS (SELECT doc_id, dim, avg(x) AS x FROM dims GROUP BY 1, 2)
SELECT d.doc_id, g.dim, approx(coalesce(x, 0), 6) + 0.0 AS value
FROM documents d CROSS JOIN (SELECT unnest(range(0, {WIDTH})) AS dim) g LEFT JOIN means m ON m.doc_id = d.doc_id AND m.dim = g.dim""")
def mean_position_vectors(spark, d):
    docs = plain_tokens(spark, d)
    return _long(ft.mean_position_vector(docs, ft.token_vector_rows(docs, v.token_vectors(spark, d)), WIDTH))


def vector_norm_model():
    """A stand-in for a user model: batches of vectors in, two numbers per vector out."""
    import numpy as np

    def predict(batch: np.ndarray) -> np.ndarray:
        return np.stack([np.linalg.norm(batch, axis=1), batch.mean(axis=1)], axis=1).astype("float32")

    return predict


@query("batched_model_features", """SELECT vec_id, approx(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 3) AS norm,
  approx(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 3) + 0.0 AS mean FROM embeddings""")
def batched_model_features(spark, d):
    vectors = v.table(spark, d, "embeddings").select("vec_id", "embedding")
    out = ft.batched_features(vectors, vector_norm_model, "embedding", WIDTH)
    return out.select("vec_id", rnd(F.col("features")[0].cast("double"), 3).alias("norm"),
                      (rnd(F.col("features")[1].cast("double"), 3) + 0.0).alias("mean"))


# --- fitted models ---------------------------------------------------------------------------------


@query("mean_model_metrics", f"""WITH {SPLIT}, y AS (SELECT split, CAST(n_chars AS DOUBLE) AS label FROM documents JOIN split_of USING (doc_id)),
m AS (SELECT avg(label) AS p FROM y WHERE split <> 'test')
SELECT split, approx(sqrt(avg((label - p) ** 2)), 4) AS rmse, approx(avg(abs(label - p)), 4) AS mae,
  approx(1 - sum((label - p) ** 2) / (var_pop(label) * count(*)), 6) + 0.0 AS r2, approx(median(abs(label - p)), 4) AS medae,
  count(*) AS n FROM y, m GROUP BY split""")
def mean_model_metrics(spark, d):
    labelled = split_documents(spark, d).select("split", "label")
    return evaluate(md.fit_mean(labelled).transform(labelled)).select(
        "split", rnd("rmse").alias("rmse"), rnd("mae").alias("mae"), (rnd("r2", 6) + 0.0).alias("r2"),
        rnd("medae").alias("medae"), "n",
    )


def text_shape(spark, d):
    """Simple numbers of each document as features: words, distinct words, lines."""
    from pyspark.ml.functions import array_to_vector

    docs = tokenised(spark, d)
    shape = F.array(
        F.size("tokens"), F.size(F.array_distinct("tokens")), F.size(F.split("text", "\n"))
    ).cast("array<double>")
    return docs.select("doc_id", "split", "label", array_to_vector(shape).alias("features"))


_SHAPE = f"""{SPLIT}, shape AS (SELECT split, CAST(n_chars AS DOUBLE) AS y, len({WORDS})::DOUBLE AS a
  FROM documents JOIN split_of USING (doc_id))"""


@query("linear_length_coefficients", f"""WITH {_SHAPE}
SELECT 'words' AS term, approx(regr_slope(y, a), 4) AS coef FROM shape WHERE split = 'train'
UNION ALL SELECT '(intercept)', approx(regr_intercept(y, a), 3) FROM shape WHERE split = 'train'""")
def linear_length_coefficients(spark, d):
    """Least squares of the label on the number of words."""
    from pyspark.ml.functions import array_to_vector

    docs = tokenised(spark, d).where("split = 'train'")
    train = docs.select("label", array_to_vector(F.array(F.size("tokens").cast("double"))).alias("features"))
    model = md.fit_linear(train)
    out = md.coefficients(model, spark, ["words"])
    digits = F.when(F.col("term") == "words", rnd("coef", 4)).otherwise(rnd("coef", 3))
    return out.select("term", digits.alias("coef"))


# least squares by making the features orthogonal on train one after the other
@query("linear_model_metrics", f"""WITH {SPLIT}, shape AS (
  SELECT split, CAST(n_chars AS DOUBLE) AS y, len({WORDS})::DOUBLE AS a, len(list_distinct({WORDS}))::DOUBLE AS b,
    len(string_split(text, chr(10)))::DOUBLE AS c FROM documents JOIN split_of USING (doc_id)),
f1 AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, coalesce(regr_slope(y, a), 0) AS ya,
         coalesce(regr_slope(b, a), 0) AS ba, coalesce(regr_slope(c, a), 0) AS ca FROM shape WHERE split = 'train'),
o1 AS (SELECT split, y, my + ya * (a - ma) AS p, b - mb - ba * (a - ma) AS b, c - mc - ca * (a - ma) AS c FROM shape, f1),
f2 AS (SELECT coalesce(regr_slope(y, b), 0) AS yb, coalesce(regr_slope(c, b), 0) AS cb FROM o1 WHERE split = 'train'),
o2 AS (SELECT split, y, p + yb * b AS p, c - cb * b AS c FROM o1, f2),
f3 AS (SELECT coalesce(regr_slope(y, c), 0) AS yc FROM o2 WHERE split = 'train'),
y AS (SELECT split, y AS label, p + yc * c AS p FROM o2, f3)
SELECT split, approx(sqrt(avg((label - p) ** 2)), 4) AS rmse, approx(avg(abs(label - p)), 4) AS mae,
  approx(1 - sum((label - p) ** 2) / (var_pop(label) * count(*)), 6) + 0.0 AS r2, approx(median(abs(label - p)), 4) AS medae,
  count(*) AS n FROM y GROUP BY split""")
def linear_model_metrics(spark, d):
    shaped = cut_lineage(text_shape(spark, d))
    return evaluate(md.fit_linear(shaped.where("split = 'train'")).transform(shaped)).select(
        "split", rnd("rmse").alias("rmse"), rnd("mae").alias("mae"), (rnd("r2", 6) + 0.0).alias("r2"),
        rnd("medae").alias("medae"), "n",
    )


KNOWN = {"quantity": 3.0, "discount": -2.0, "tax": 0.5, "(intercept)": 7.0}


@query("recovered_coefficients", "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {c}::DOUBLE)" for t, c in KNOWN.items()) + ") AS known(term, coef)")
def recovered_coefficients(spark, d):
    """A fit to labels that are a known linear function of three features of every line item gives that function back."""
    from pyspark.ml.functions import array_to_vector

    lines = v.table(spark, d, "lineitem")
    features = {"quantity": F.col("l_quantity").cast("double"), "discount": F.col("l_discount").cast("double") * 100,
                "tax": F.col("l_tax").cast("double") * 100}
    label = sum((c * F.lit(KNOWN[t]) for t, c in features.items()), F.lit(KNOWN["(intercept)"]))
    model = md.fit_linear(lines.select(label.alias("label"), array_to_vector(F.array(*features.values())).alias("features")))
    return md.coefficients(model, spark, list(features)).withColumn("coef", rnd("coef"))


@query("tf_idf_linear_metrics")
def tf_idf_linear_metrics(spark, d):
    config = xp.Config(["lowercase", "no_punctuation"], "whitespace", "tf_idf", "linear_regression", 2000)
    return xp.metrics(split_documents(spark, d), config)


@query("boosted_trees_a_metrics")
def boosted_trees_a_metrics(spark, d):
    shaped = cut_lineage(text_shape(spark, d))
    return evaluate(md.boosted_a(shaped, rounds=20, patience=10).transform(shaped))


@query("boosted_trees_b_metrics")
def boosted_trees_b_metrics(spark, d):
    config = xp.Config([], "whitespace", "glove_mean", "xgboost")
    return xp.metrics(split_documents(spark, d), config, vectors=v.token_vectors(spark, d), width=WIDTH)


def _best_split_sql(rows):
    """The best split per node of `rows` (node, g, x), every value of every feature being tried."""
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain / unit, 10) DESC, f, cut) AS place FROM (
    SELECT *, gl * gl / (nl + 1) + (gs - gl) * (gs - gl) / (ns - nl + 1) - gs * gs / (ns + 1) AS gain FROM (
      SELECT node, f, cut, sum(g) OVER upto AS gl, sum(n) OVER upto AS nl, sum(g) OVER whole AS gs, sum(n) OVER whole AS ns
      FROM (SELECT node, f, x[f + 1] AS cut, sum(g) AS g, count(*) AS n FROM {rows}, (SELECT unnest([0, 1, 2]) AS f) GROUP BY ALL)
      WINDOW upto AS (PARTITION BY node, f ORDER BY cut), whole AS (PARTITION BY node, f))
    WHERE nl < ns), (SELECT sum(g * g) AS unit FROM rows0)) WHERE place = 1"""


def _moved_sql(rows, splits):
    return (f"SELECT 2 * node + CASE WHEN x[f + 1] <= cut THEN 1 ELSE 2 END AS node, g, x FROM {rows} "
            f"JOIN (SELECT node, f, cut FROM {splits}) USING (node)")


@query("boosted_first_tree", f"""WITH rows0 AS (
  SELECT 0 AS node, avg(l_extendedprice::DOUBLE) OVER () - l_extendedprice::DOUBLE AS g,
    [l_quantity::DOUBLE, l_discount::DOUBLE, l_tax::DOUBLE] AS x FROM lineitem),
best0 AS ({_best_split_sql("rows0")}), rows1 AS ({_moved_sql("rows0", "best0")}),
best1 AS ({_best_split_sql("rows1")}), rows2 AS ({_moved_sql("rows1", "best1")})
SELECT node::INT AS node, f::INT AS feature, cut AS threshold, NULL::DOUBLE AS leaf FROM (FROM best0 UNION ALL FROM best1)
UNION ALL SELECT node::INT, NULL, NULL, approx(-sum(g) / (count(*) + 1), 4) FROM rows2 GROUP BY node""")
def boosted_first_tree(spark, d):
    """The first tree, two levels deep, for the price of every line item by quantity, discount and tax."""
    from pyspark.ml.functions import array_to_vector

    lines = v.table(spark, d, "lineitem")
    given = F.array("l_quantity", "l_discount", "l_tax").cast("array<double>")
    rows = lines.select(F.lit("train").alias("split"), F.col("l_extendedprice").cast("double").alias("label"),
                        array_to_vector(given).alias("features"))
    tree = boosting.fit_penalised(rows, depth=2, rounds=1).frame(spark).where("tree = 0")
    return tree.select("node", "feature", "threshold", rnd("value").alias("leaf"))
