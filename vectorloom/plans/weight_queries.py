"""Weighting queries."""

from pyspark.sql import functions as F

from vectorloom.operators import vocab as v
from vectorloom.operators import weight as w
from vectorloom.plans.registry import BOW, TOK, VOCAB, documents, query, r6, table

NDOCS = "(SELECT count(*) FROM documents)"
TFIDF_SQL = (f"{BOW}, idf AS (SELECT token, log2({NDOCS} * 1.0 / count(*)) AS idf FROM bow GROUP BY token), "
             "raw AS (SELECT doc_id, token, tf * idf AS w FROM bow JOIN idf USING (token) WHERE abs(idf) > 1e-12), "
             "tfidf AS (SELECT doc_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)")


def corpus_tfidf(spark, d):
    docs = documents(spark, d)
    runs = v.token_runs(docs)
    vocab = v.token_counts(docs)
    return w.tfidf(runs, vocab, docs.count(), key="token")


@query("tfidf", f"WITH {TFIDF_SQL} SELECT doc_id, token, round(w, 6) AS weight FROM tfidf WHERE abs(w) > 1e-12")
def _(spark, d):
    return corpus_tfidf(spark, d).select("doc_id", "token", r6(F.col("weight"), "weight"))


@query("log_entropy",
       f"WITH {BOW}, e AS (SELECT token, 1 + sum((tf / gf) * ln(tf / gf)) / ln({NDOCS} + 1.0) AS e FROM "
       "(SELECT *, CAST(sum(tf) OVER (PARTITION BY token) AS DOUBLE) AS gf FROM bow) GROUP BY token), "
       "x AS (SELECT doc_id, token, ln(tf + 1.0) * e AS w FROM bow JOIN e USING (token)) "
       "SELECT doc_id, token, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x")
def _(spark, d):
    docs = documents(spark, d)
    out = w.log_entropy(v.token_runs(docs), docs.count(), key="token")
    return out.select("doc_id", "token", r6(F.col("weight"), "weight"))


@query("normalize_l1",
       f"WITH {BOW} SELECT doc_id, token, round(tf * 1.0 / sum(tf) OVER (PARTITION BY doc_id), 6) AS weight FROM bow")
def _(spark, d):
    rows = v.token_runs(documents(spark, d)).select("doc_id", "token", F.col("tf").cast("double").alias("weight"))
    return w.normalize(rows, norm="l1").select("doc_id", "token", r6(F.col("weight"), "weight"))


@query("normalize_l2",
       f"WITH {BOW} SELECT doc_id, token, round(tf / sqrt(sum(tf * tf * 1.0) OVER (PARTITION BY doc_id)), 6) AS weight FROM bow")
def _(spark, d):
    rows = v.token_runs(documents(spark, d)).select("doc_id", "token", F.col("tf").cast("double").alias("weight"))
    return w.normalize(rows).select("doc_id", "token", r6(F.col("weight"), "weight"))


@query("random_projection",
       f"WITH {TFIDF_SQL}, h AS (SELECT DISTINCT token, md5(token || '|0|0') AS h FROM tfidf), t AS (SELECT unnest(range(0, 32)) AS topic), "
       "s AS (SELECT doc_id, topic, sum(CASE WHEN substr(h, topic + 1, 1) < '8' THEN w ELSE -w END) / sqrt(32.0) AS weight "
       "FROM tfidf JOIN h USING (token), t GROUP BY ALL) SELECT doc_id, CAST(topic AS INTEGER) AS topic, round(weight, 6) AS weight FROM s WHERE abs(weight) > 1e-9")
def _(spark, d):
    out = w.random_projection(corpus_tfidf(spark, d), 32, key="token")
    return out.select("doc_id", "topic", r6(F.col("weight"), "weight"))


@query("log_normalize",
       "SELECT vec_id, dim, round(x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)), 6) AS weight FROM "
       "(SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)")
def _(spark, d):
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "weight"))
    return w.log_normalize(rows, "vec_id").select(
        "vec_id", F.col("dim").cast("long").alias("dim"), r6(F.col("weight"), "weight"))


@query("vocab_transform",
       f"WITH {VOCAB} SELECT doc_id, row_number_new AS term_id, tf FROM bow JOIN (SELECT token, "
       "row_number() OVER (ORDER BY df DESC, token) - 1 AS row_number_new FROM vocab WHERE df >= 5) USING (token)")
def _(spark, d):
    docs = documents(spark, d)
    vocab = v.build_vocab(docs)
    kept = v.assign_ids(vocab.filter("df >= 5").withColumnRenamed("term_id", "old_id"), name="new_id")
    return w.vocab_transform(v.doc2bow(docs, vocab), kept.select("old_id", "new_id"))


@query("sparse_to_dense",
       "WITH o AS (SELECT o_custkey AS doc_id, n % 7 AS term_id, sum(o_totalprice) AS v FROM "
       "(SELECT *, extract('dayofweek' FROM o_orderdate) AS n FROM orders) GROUP BY ALL) "
       "SELECT doc_id, " + ", ".join(f"round(coalesce(sum(v) FILTER (term_id = {i}), 0), 2) AS d{i}" for i in range(7)) +
       " FROM o GROUP BY doc_id")
def _(spark, d):
    rows = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("doc_id"), (F.dayofweek("o_orderdate") - 1).alias("term_id")).agg(
        F.sum("o_totalprice").alias("weight"))
    dense = w.sparse_to_dense(rows, 7)
    return dense.select("doc_id", *[F.round(F.get("vector", F.lit(i)), 2).alias(f"d{i}") for i in range(7)])


@query("dense_to_sparse",
       "SELECT vec_id AS doc_id, i AS term_id, round(x, 6) AS weight FROM (SELECT vec_id, "
       "CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE abs(x) > 1e-9")
def _(spark, d):
    out = w.dense_to_sparse(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "embedding")
    return out.select("doc_id", F.col("term_id").cast("long").alias("term_id"), r6(F.col("weight"), "weight"))


@query("dense_top_n",
       "SELECT vec_id AS doc_id, i AS term_id, round(x, 6) AS weight FROM (SELECT vec_id, "
       "CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) "
       "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, i) <= 8")
def _(spark, d):
    out = w.dense_to_top_n(table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "embedding", 8)
    return out.select("doc_id", F.col("term_id").cast("long").alias("term_id"), r6(F.col("weight"), "weight"))


@query("corpus_slice", "SELECT doc_id, n_chars FROM documents WHERE doc_id >= 10 AND (doc_id - 10) % 3 = 0")
def _(spark, d):
    return w.corpus_slice(table(spark, d, "documents"), 10, None, 3, idx="doc_id").select("doc_id", "n_chars")


@query("corpus_repeat", "SELECT doc_id, copy FROM documents, (SELECT unnest(range(0, 3)) AS copy)")
def _(spark, d):
    out = w.corpus_repeat(table(spark, d, "documents"), 3)
    return out.select("doc_id", F.col("copy").cast("long").alias("copy"))


@query("corpus_chunks",
       "SELECT CAST(floor(doc_id / 64) AS BIGINT) AS chunk, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars "
       "FROM documents GROUP BY ALL")
def _(spark, d):
    return w.corpus_chunks(table(spark, d, "documents"), 64, idx="doc_id").groupBy("chunk").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
