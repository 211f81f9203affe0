"""Factorisation and streaming queries."""

from pyspark.sql import functions as F

from vectorloom.operators import cooc as c
from vectorloom.operators import factor as fa
from vectorloom.operators import topics as tp
from vectorloom.operators import vocab as v
from vectorloom.plans.cooc_queries import IDS, PHRASES, id_docs, pmi_sql, tensor, tensor_sql
from vectorloom.plans.registry import OCC, VOCAB, documents, hash01_sql, query, r6, table, tok_sql
from vectorloom.plans.search_queries import EMB
from vectorloom.functions.text import simple_preprocess
from vectorloom.runtime import cut, scratch_dir
from vectorloom.streaming import incremental as inc

#: Most passes of a training; it ends earlier when the loss settles (factor.TOLERANCE).
STEPS = 10


def _vectors(state, losses, f="U"):
    out = fa.factor_table(state, f)
    return out.select("idx", F.posexplode("vector").alias("dim", "value"), F.lit(losses[-1] <= losses[0]).alias("improved"))


@query("cp_decompose")
def _(spark, d):
    return _vectors(*fa.cp_decompose(c.symmetrize(tensor(spark, d, 2)[0]), 8, STEPS, rate=0.05))


@query("cp_sals")
def _(spark, d):
    return _vectors(*fa.cp_als(c.symmetrize(tensor(spark, d, 2)[0]), 8, 15))


@query("cp_2sgd")
def _(spark, d):
    return _vectors(*fa.cp_als(c.symmetrize(tensor(spark, d, 2)[0]), 8, 15, sequential=False))


@query("cp_symmetric")
def _(spark, d):
    return _vectors(*fa.cp_symmetric(tensor(spark, d, 3)[0], 8, STEPS, rate=0.05))


@query("cp_symmetric_nonnegative")
def _(spark, d):
    return _vectors(*fa.cp_symmetric(tensor(spark, d, 3)[0], 8, STEPS, nonnegative=True, l1=1e-6, rate=0.05))


@query("cp_joint_symmetric")
def _(spark, d):
    return _vectors(*fa.cp_joint_symmetric([(tensor(spark, d, 2)[0], 1.0), (tensor(spark, d, 3)[0], 1.0)], 8, STEPS, rate=0.05))


@query("glove")
def _(spark, d):
    counts = c.count_with_context(c.context_windows(id_docs(spark, d)[0], 3, fixed_size=False))
    return _vectors(*fa.glove(counts, 8, STEPS))


@query("nnse")
def _(spark, d):
    return _vectors(*fa.nnse(c.symmetrize(tensor(spark, d, 2)[0]), 8, STEPS, rate=0.05))


@query("sgns")
def _(spark, d):
    ids, vocab = id_docs(spark, d)
    return _vectors(*fa.sgns(c.skipgram_pairs(ids, 2), vocab, 8, STEPS, negatives=2))


@query("hosg")
def _(spark, d):
    ids, vocab = id_docs(spark, d)
    windows = c.context_windows(ids, 2, fixed_size=True)
    near = windows.select("doc_id", "pos", "target", F.posexplode("context").alias("k", "context"))
    return _vectors(*fa.hosg(fa.hosg_rows(near, vocab, 2), 8, STEPS))


@query("cbow")
def _(spark, d):
    ids, vocab = id_docs(spark, d)
    return _vectors(*fa.cbow(c.context_windows(ids, 2, fixed_size=True), vocab, 8, STEPS, negatives=2), f="C")


@query("word2vec")
def _(spark, d):
    return fa.word2vec(documents(spark, d), 16, 5, 20).select("word", F.posexplode("vector").alias("dim", "value"))


@query("doc_vectors")
def _(spark, d):
    ids, vocab = id_docs(spark, d)
    return _vectors(*fa.doc_vectors(ids, vocab, 8, STEPS, negatives=2), f="D")


@query("doc_vectors_dm")
def _(spark, d):
    ids, vocab = id_docs(spark, d)
    state, losses = fa.doc_vectors_dm(c.context_windows(ids, 2, fixed_size=True), vocab, 8, STEPS, negatives=2)
    return fa.document_table(state).select("doc_id", F.posexplode("vector").alias("dim", "value"), F.lit(losses[-1] <= losses[0]).alias("improved"))


@query("infer_vectors")
def _(spark, d):
    ids, vocab = id_docs(spark, d)
    outputs = fa.random_embedding(vocab.select("term_id"), 8, key="term_id").join(vocab.select("term_id", "count"), "term_id").select(
        F.col("term_id").alias("idx"), "vector", "count")
    return fa.infer_vectors(ids, outputs, 8).select("doc_id", F.posexplode("vector").alias("dim", "value"))


@query("random_embedding",
       f"WITH {OCC}, w AS (SELECT DISTINCT token AS word FROM occ), d AS (SELECT word, unnest(range(1, 5)) AS i FROM w), "
       f"u AS (SELECT word, i, {hash01_sql('word', 'i', 0)} + pow(2.0, -53) AS a, {hash01_sql('word', 'i', 1)} + pow(2.0, -53) AS b FROM d) "
       "SELECT word, CAST(i - 1 AS INTEGER) AS dim, round(sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) AS value FROM u")
def _(spark, d):
    words = v.token_counts(documents(spark, d)).select(F.col("token").alias("word"))
    return fa.random_embedding(words, 4).select("word", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.round("value", 6))


# part and supplier vectors: rows of the embeddings table by key
_FACTOR = (f"WITH {EMB}, t AS (SELECT l_partkey % n AS i, l_suppkey % n AS j, avg(l_discount) AS value FROM lineitem, (SELECT count(*) AS n FROM emb) GROUP BY ALL)")


@query("reconstruction_error",
       f"{_FACTOR} SELECT round(sqrt(avg(pow(value - list_dot_product(x.v, y.v), 2))), 6) AS rmse FROM t JOIN emb x ON x.idx = i JOIN emb y ON y.idx = j")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vector"))
    n = e.count()
    rows = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % n).alias("i"), (F.col("l_suppkey") % n).alias("j")).agg(
        F.avg("l_discount").alias("value"))
    return fa.reconstruction_error(rows, {"i": e, "j": e}).select(r6(F.col("rmse"), "rmse"))


@query("sentence_log_prob",
       f"WITH {OCC}, wv AS (SELECT token, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS r "
       "FROM occ GROUP BY token) JOIN embeddings ON r = vec_id), ks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p, v FROM occ JOIN wv USING (token)) "
       "SELECT x.doc_id, round(sum(-ln(1 + exp(-list_dot_product(x.v, y.v)))), 5) AS log_prob FROM ks x JOIN ks y ON x.doc_id = y.doc_id AND "
       "y.p BETWEEN x.p - 2 AND x.p + 2 AND y.p <> x.p GROUP BY x.doc_id")
def _(spark, d):
    docs = documents(spark, d)
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("vector"))
    vocab = v.assign_ids(v.word_counts(docs, 1), by="count").filter(F.col("term_id") < e.count())
    pairs = c.context_windows(c.to_ids(docs, vocab), 2, fixed_size=False).select(
        "doc_id", "target", F.explode("context").alias("context"))
    return fa.sentence_log_prob(pairs, e, e).select("doc_id", F.round("log_prob", 5).alias("log_prob"))


# ---------------------------------------------------------------- streams: the corpus arrives in four files
def doc_stream(spark, d, name):
    path = scratch_dir(spark, name)
    documents(spark, d).repartition(4, "doc_id").write.parquet(path)
    return inc.file_stream(spark, path), scratch_dir(spark, name + "-state")


@query("stream_vocab", f"WITH {VOCAB} SELECT token, df, cf FROM vocab")
def _(spark, d):
    stream, state = doc_stream(spark, d, "sv")
    inc.stream_vocab(stream, state)
    return inc.read_vocab(spark, state)


@query("stream_phrases", f"WITH {PHRASES} SELECT key, CAST(count AS BIGINT) AS count FROM cnt")
def _(spark, d):
    stream, state = doc_stream(spark, d, "sp")
    inc.stream_phrases(stream, state)
    return inc.read_phrases(spark, state)


@query("stream_cooccurrence",
       f"WITH {IDS}, {tensor_sql(2)}, {pmi_sql(2)} SELECT i, j, round(value, 6) AS value FROM pmi WHERE value > 0")
def _(spark, d):
    vocab = cut(c.vocab_for(v.word_counts(documents(spark, d), 20), 20))
    stream, state = doc_stream(spark, d, "sc")
    inc.stream_cooccurrence(stream, state, vocab)
    return inc.read_ppmi(spark, state).select("i", "j", r6(F.col("value"), "value"))


@query("stream_similarity_index",
       f"WITH {OCC}, bow AS (SELECT doc_id, token, count(*) AS tf FROM occ GROUP BY ALL), "
       "n AS (SELECT doc_id, token, tf / sqrt(sum(tf * tf * 1.0) OVER (PARTITION BY doc_id)) AS w FROM bow), "
       f"bt AS ({tok_sql('benchmark', 'item_id')}), bb AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(tokens) AS token FROM bt) GROUP BY ALL), "
       "q AS (SELECT item_id, token, tf / sqrt(sum(tf * tf * 1.0) OVER (PARTITION BY item_id)) AS w FROM bb), "
       "h AS (SELECT item_id AS query_id, doc_id AS hit_id, round(sum(q.w * n.w), 6) AS score FROM q JOIN n USING (token) GROUP BY ALL) "
       "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(score) DESC, hit_id) AS rank FROM h WHERE abs(score) > 1e-9 QUALIFY rank <= 5")
def _(spark, d):
    stream, state = doc_stream(spark, d, "ss")
    inc.stream_similarity_index(stream, state)
    items = table(spark, d, "benchmark").select("item_id", simple_preprocess(F.col("text")).alias("tokens"))
    return inc.query_index(spark, state, items, 5, "item_id")


@query("stream_lda_update")
def _(spark, d):
    docs = documents(spark, d)
    vocab = cut(v.filter_extremes(v.token_counts(docs), docs, 5, 0.5, None))
    stream, state = doc_stream(spark, d, "sl")
    inc.stream_lda_update(stream, state, vocab, tp.OnlineLda(6, vocab.count(), seed=1))
    facts = inc.latest(spark, f"{state}/facts").first()
    return inc.latest(spark, f"{state}/model").select("term_id", F.posexplode("vector").alias("topic", "weight"), F.lit(facts.updates).alias("updates"),
                                                      F.lit(facts.seen).alias("seen"))


@query("stream_lsi_update")
def _(spark, d):
    docs = documents(spark, d)
    vocab = cut(v.filter_extremes(v.token_counts(docs), docs, 5, 0.5, None))
    stream, state = doc_stream(spark, d, "si")
    inc.stream_lsi_update(stream, state, vocab, 5, 0.9)
    return inc.latest(spark, f"{state}/model").select("term_id", F.posexplode("vector").alias("topic", "weight"))


@query("stream_vocab_online")
def _(spark, d):
    start = cut(v.assign_ids(v.word_counts(table(spark, d, "conversations").select(
        simple_preprocess(F.col("text")).alias("tokens")), 5), by="count"))
    stream, state = doc_stream(spark, d, "so")
    inc.stream_vocab_online(stream, state, start)
    return inc.latest(spark, f"{state}/vocab")


@query("stream_topic_slices",
       "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS slice, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    path, state = scratch_dir(spark, "ev"), scratch_dir(spark, "ev-state")
    table(spark, d, "events").select("ts", "event_type").repartitionByRange(4, "ts").write.parquet(path)
    # files may be picked up out of time order, so the allowed lateness spans the table
    inc.stream_topic_slices(inc.file_stream(spark, path), state, key="event_type", lateness="3650 days")
    return inc.read_topic_slices(spark, state, "event_type").select(
        F.date_format("slice", "yyyy-MM-dd").alias("slice"), "event_type", "n")


@query("stream_mini_batches")
def _(spark, d):
    rows = cut(tensor(spark, d, 2)[0])
    settings = fa.Settings(8, rate=0.05)
    start = fa.start_from_tensor(rows, {"i": "U", "j": "U"}, settings)
    path, state = scratch_dir(spark, "mb"), scratch_dir(spark, "mb-state")
    rows.repartition(4, "i", "j").write.parquet(path)
    inc.stream_mini_batches(inc.file_stream(spark, path), state, {"i": "U", "j": "U"}, settings, start)
    return inc.latest(spark, f"{state}/factors").select("f", "idx", F.posexplode("vec").alias("dim", "value"))


