"""Topic model and SVD queries."""

import numpy as np
from pyspark.sql import functions as F

from vectorloom.operators import spectral as sp
from vectorloom.operators import topics as tp
from vectorloom.operators import vocab as v
from vectorloom.operators import weight as w
from vectorloom.plans.cooc_queries import tensor
from vectorloom.plans.registry import OCC, documents, query, r6, table
from vectorloom.plans.search_queries import _WORDVEC, word_vectors
from vectorloom.runtime import broadcast_if_small, cut

def _tfidf_ids(spark, d):
    docs = documents(spark, d)
    vocab = cut(v.filter_extremes(v.token_counts(docs), docs, 5, 0.5, None))
    return w.tfidf(v.doc2bow(docs, vocab), vocab, docs.count()), vocab, docs


@query("lsi_fit")
def _(spark, d):
    rows, vocab, _ = _tfidf_ids(spark, d)
    terms, s = sp.lsi_fit(rows, 10)
    return sp.lsi_topics(terms, vocab, 10).withColumn("singular_value", F.get(F.array(*[F.lit(float(x)) for x in s]), "topic"))


@query("lsi_merge")
def _(spark, d):
    rows, vocab, _ = _tfidf_ids(spark, d)
    first, second = w.hashed_split(cut(rows), ["doc_id"], 0.5)
    terms, s = sp.lsi_merge(sp.lsi_fit(first, 10), sp.lsi_fit(second, 10), 10, decay=0.9)
    return sp.lsi_topics(terms, vocab, 10)


@query("lsi_transform",
       f"WITH {_WORDVEC}, bow AS (SELECT doc_id, token, count(*) AS tf FROM occ GROUP BY ALL), "
       "x AS (SELECT doc_id, tf * unnest(v) / (1 + generate_subscripts(v, 1)) AS x, generate_subscripts(v, 1) - 1 AS topic FROM bow JOIN wv ON word = token) "
       "SELECT doc_id, topic, round(sum(x), 6) AS weight FROM x GROUP BY ALL")
def _(spark, d):
    docs, wv = documents(spark, d), cut(word_vectors(spark, d))
    ids = broadcast_if_small(wv.select(F.col("word").alias("token"), F.col("idx").alias("term_id")), sp.LOOKUP_ROWS)
    rows = v.token_runs(docs).join(ids, "token").select(
        "doc_id", "term_id", F.col("tf").cast("double").alias("weight"))
    out = sp.lsi_transform(rows, wv.select(F.col("idx").alias("term_id"), "vector"), np.arange(2.0, 66.0))
    return out.select("doc_id", F.posexplode("vector").alias("topic", "weight")).select(
        "doc_id", F.col("topic").cast("long").alias("topic"), r6(F.col("weight"), "weight"))


@query("ppmi_svd")
def _(spark, d):
    from vectorloom.operators.cooc import symmetrize

    e, _, rmse = sp.ppmi_svd(symmetrize(tensor(spark, d, 2)[0]), 16)
    return e.select("idx", F.posexplode("vector").alias("dim", "value"), F.lit(rmse).alias("rmse"))


def _lda(spark, d, k=8, share=1.0):
    """(documents, chunks fitted on, the other chunks, vocabulary, model)."""
    docs = documents(spark, d)
    chunks, vocab = tp.vectorize(docs)
    train, rest = w.hashed_split(chunks, ["doc_id"], share)
    return docs, train, rest, vocab, tp.lda_fit(cut(train), vocab.count(), k, passes=2)


@query("lda_fit")
def _(spark, d):
    *_, vocab, model = _lda(spark, d)
    return tp.show_topics(tp.topic_terms_table(model, vocab), 10)


@query("lda_transform")
def _(spark, d):
    _, chunks, _, _, model = _lda(spark, d)
    return tp.lda_transform(model, chunks)


@query("lda_word_topics")
def _(spark, d):
    docs, chunks, _, vocab, model = _lda(spark, d)
    return tp.word_topics(tp.lda_transform(model, chunks), v.token_runs(docs), tp.topic_terms_table(model, vocab))


@query("lda_perplexity")
def _(spark, d):
    _, _, held_out, _, model = _lda(spark, d, share=0.8)
    return spark.createDataFrame([tp.lda_perplexity(model, held_out)], "bound double, perplexity double")


@query("lda_learned_priors")
def _(spark, d):
    """Both priors learned from the corpus, beside the topics' shares of it."""
    chunks, vocab = tp.vectorize(documents(spark, d))
    model = tp.lda_fit(chunks, vocab.count(), 8, passes=2, alpha="auto", eta="auto")
    rows = [(t, float(a), float(e), float(n)) for t, (a, e, n) in enumerate(zip(model.alpha, model.eta, model.totals / model.totals.sum()))]
    return spark.createDataFrame(rows, "topic int, alpha double, eta double, share double")


@query("choose_topic_count")
def _(spark, d):
    docs = documents(spark, d)
    chunks, vocab = tp.vectorize(docs)
    return tp.choose_topic_count(docs, chunks, vocab, [2, 4, 6, 8, 12])


# topics given by the data: word shares per language
_LT = (f"{OCC}, lt AS (SELECT lang AS topic, token, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY lang), 12) AS prob FROM occ "
       "JOIN documents USING (doc_id) GROUP BY lang, token)")


def language_topics(spark, d):
    langs = table(spark, d, "documents").select("doc_id", "lang")
    n = v.token_runs(documents(spark, d)).join(langs, "doc_id").groupBy(F.col("lang").alias("topic"), "token").agg(F.sum("tf").alias("n"))
    total = n.groupBy("topic").agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total), "topic").select("topic", "token", F.round(F.col("n") / F.col("total"), 12).alias("prob"))  # a row a language


@query("show_topics", f"WITH {_LT} SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY prob DESC, token) AS rank, token, round(prob, 6) AS prob "
       "FROM lt QUALIFY rank <= 15")
def _(spark, d):
    return tp.show_topics(language_topics(spark, d), 15).select("topic", "rank", "token", r6(F.col("prob"), "prob"))


@query("format_topics",
       f"WITH {_LT}, b AS (SELECT topic, token, prob, row_number() OVER (PARTITION BY topic ORDER BY prob DESC, token) AS rank FROM lt QUALIFY rank <= 10) "
       "SELECT topic, string_agg(printf('%.3f', prob) || '*\"' || token || '\"', ' + ' ORDER BY rank) AS text FROM b GROUP BY topic")
def _(spark, d):
    return tp.format_topics(language_topics(spark, d), 10)


@query("term_topics", f"WITH {_LT} SELECT token, topic, round(prob, 6) AS prob FROM lt WHERE prob >= 0.002")
def _(spark, d):
    return tp.term_topics(language_topics(spark, d), 0.002).select("token", "topic", r6(F.col("prob"), "prob"))


# shares of a word's language topics: each word of a document belongs to its language fully; slices = source number
@query("topic_evolution",
       f"WITH {OCC}, m AS (SELECT CAST(replace(source, 'src', '') AS BIGINT) // 5 AS slice, lang AS topic, token, CAST(count(*) AS DOUBLE) AS m FROM occ "
       "JOIN documents USING (doc_id) GROUP BY ALL), s AS (SELECT slice, topic, token, m FROM m UNION ALL SELECT slice - 1, topic, token, 0.5 * m FROM m "
       "UNION ALL SELECT slice + 1, topic, token, 0.5 * m FROM m), k AS (SELECT slice, topic, token, sum(m) AS m FROM s WHERE slice IN (SELECT slice FROM m) GROUP BY ALL) "
       "SELECT slice, topic, token, round(m / sum(m) OVER (PARTITION BY slice, topic), 6) AS prob FROM k")
def _(spark, d):
    meta = table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("topic"), F.floor(F.replace("source", F.lit("src"), F.lit("")).cast("long") / 5).alias("slice"))
    shares = v.token_runs(documents(spark, d)).join(meta.drop("slice"), "doc_id").withColumn("phi", F.lit(1.0))
    out = tp.topic_evolution(shares, meta.select("doc_id", "slice"))
    return out.select("slice", "topic", "token", r6(F.col("prob"), "prob"))


@query("topic_evolution_tables",
       f"WITH {OCC} SELECT 'frequency' AS kind, token AS key, count(*) AS n FROM occ GROUP BY token "
       "UNION ALL SELECT 'length', CAST(doc_id AS VARCHAR), count(*) FROM occ GROUP BY doc_id")
def _(spark, d):
    lengths, frequencies = tp.evolution_tables(v.token_runs(documents(spark, d)))
    return frequencies.select(F.lit("frequency").alias("kind"), F.col("token").alias("key"), F.col("frequency").alias("n")).unionByName(
        lengths.select(F.lit("length").alias("kind"), F.col("doc_id").cast("string").alias("key"), F.col("length").alias("n")))


@query("online_lda")
def _(spark, d):
    docs = documents(spark, d)
    vocab = cut(v.filter_extremes(v.token_counts(docs), docs, 5, 0.5, None))
    chunks = cut(tp.chunk_documents(v.token_runs(docs), vocab))
    model = tp.OnlineLda(8, vocab.count(), seed=1)
    first, second = w.hashed_split(chunks, ["doc_id"], 0.5)
    model.update(first).update(second)
    return model.transform(chunks).select("doc_id", F.posexplode("theta").alias("topic", "prob"))


