"""Text vectors over the whole documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION, STOP_WORDS
from ..functions.vectors import random_factors
from ..operators import textvec, vocab
from ..session import materialize
from .fixtures import Tables, sql, sql_hash_uniform
from .registry import query

_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
BOW_SQL = f"""SELECT doc_id, token, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM documents)
  WHERE token NOT IN ({_STOPS}) GROUP BY ALL"""
TFIDF_SQL = {
    "bow": BOW_SQL,
    "freq": "SELECT token, count(*) AS df FROM bow GROUP BY token",
    "weights": """SELECT doc_id, token, tf, df,
      tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM bow JOIN freq USING (token)""",
    "tfidf": """SELECT doc_id, token, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
      FROM weights""",
}


def bow(t: Tables):
    return textvec.bag_of_words(t.documents, "doc_id", F.col("text"))


def tfidf(t: Tables, signs: Column | None = None):
    counts = materialize(bow(t), "bow")
    return textvec.tf_idf(counts, "doc_id", t.documents, signs)


@query("txt_1_bag_of_words", sql("SELECT doc_id, token, tf FROM bow", bow=BOW_SQL))
def _(t):
    return bow(t)


@query("txt_1_articles", sql(
    f"""SELECT news_id, token, count(*) AS tf FROM (
          SELECT news_id, unnest(regexp_extract_all(lower(coalesce(abstract, ' . ') || title),
            '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS token FROM news)
        WHERE token NOT IN ({_STOPS}) GROUP BY ALL""", "news"))
def _(t):
    from ..functions.text import joined_text

    return textvec.bag_of_words(t.news, "news_id", joined_text(["abstract", "title"]))


@query("txt_2_tf_idf", sql(
    "SELECT doc_id, token, tf, df, round(weight, 6) AS weight FROM tfidf", **TFIDF_SQL))
def _(t):
    return tfidf(t).withColumn("weight", F.round("weight", 6))


MAX_TOKENS = 1000
_PUNCT_SQL = PUNCTUATION.replace("'", "''")
IDS_SQL = {
    "tokens": f"""SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(
        regexp_replace(lower(text), '{_PUNCT_SQL}', '', 'g'), '\\s+'), lambda x: x <> '') AS toks
      FROM documents)""",
    "vocab": f"""SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS idx FROM tokens
      GROUP BY token QUALIFY idx < {MAX_TOKENS}""",
    "ids": """SELECT doc_id, pos, coalesce(idx, 1) AS idx FROM tokens LEFT JOIN vocab USING (token)""",
}


@query("txt_3_token_ids", sql(
    """SELECT d.doc_id, coalesce(string_agg(idx::VARCHAR, ' ' ORDER BY pos), '') AS ids
       FROM documents d LEFT JOIN ids USING (doc_id) GROUP BY d.doc_id""", **IDS_SQL))
def _(t):
    ids = textvec.token_ids(t.documents, "doc_id", F.col("text"), MAX_TOKENS)
    return ids.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


DIM = 4
VEC_SQL = "SELECT i AS idx, [" + ", ".join(sql_hash_uniform("i", str(d), "7") for d in range(DIM)) + \
    f"] AS vector FROM range(1, {MAX_TOKENS}) r(i)"


@query("emb_1_mean_token_vector", sql(
    "SELECT doc_id, " + ", ".join(f"round(avg(vector[{d + 1}]), 6) AS e{d}" for d in range(DIM))
    + " FROM ids JOIN vecs USING (idx) GROUP BY doc_id", **IDS_SQL, vecs=VEC_SQL))
def _(t):
    ids = textvec.token_ids(t.documents, "doc_id", F.col("text"), MAX_TOKENS)
    table = t.spark.range(1, MAX_TOKENS).select(
        F.col("id").alias("idx"), random_factors(F.col("id"), DIM, 7).alias("vector"))
    mean = textvec.mean_embedding(ids, "doc_id", table, DIM)
    return mean.select(
        "doc_id", *[F.round(F.element_at("embedding", d + 1), 6).alias(f"e{d}") for d in range(DIM)])


@query("emb_2_concatenated", sql(
    """SELECT e.vec_id, len(list_concat(embedding::DOUBLE[], [label::DOUBLE]))::BIGINT AS n,
         round(list_sum(list_concat(embedding::DOUBLE[], [label::DOUBLE])), 5) AS total FROM embeddings e"""))
def _(t):
    from ..functions.vectors import total

    both = textvec.concatenated(
        F.col("embedding").cast("array<double>"), F.array(F.col("label").cast("double")))
    return t.raw("embeddings").select("vec_id", both.alias("x")).select(
        "vec_id", F.size("x").cast("bigint").alias("n"), F.round(total(F.col("x")), 5).alias("total"))


@query("red_1_random_projection", sql(
    "SELECT doc_id, " + ", ".join(
        f"round(sum(weight * CASE WHEN {sql_hash_uniform('token', str(d), '42')} < 0.5 THEN -1.0 ELSE 1.0 END)"
        f" / sqrt({DIM}), 6) AS p{d}" for d in range(DIM)) + " FROM tfidf GROUP BY doc_id", **TFIDF_SQL))
def _(t):
    flat = textvec.random_projection(tfidf(t, textvec.token_signs(DIM)), "doc_id", DIM)
    return flat.select(
        "doc_id", *[F.round(F.element_at("embedding", d + 1), 6).alias(f"p{d}") for d in range(DIM)])


@query("voc_2_word_vocabulary", sql("SELECT token, idx FROM vocab", **IDS_SQL))
def _(t):
    from ..functions.text import plain_words

    rows = t.documents.select(F.explode(plain_words(F.col("text"))).alias("token"))
    return vocab.frequency_vocabulary(rows, "token", MAX_TOKENS, 2).select("token", "idx")
