"""Phrase, co-occurrence and coherence queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.operators import coherence as coh
from vectorloom.operators import cooc as c
from vectorloom.operators import phrases as ph
from vectorloom.operators import vocab as v
from vectorloom.plans.registry import draw_sql, OCC, documents, query, r6, table
from vectorloom.runtime import Kept

# ---------------------------------------------------------------- phrases
PHRASES = (f"{OCC}, bg AS (SELECT x.doc_id, x.pos, x.token AS a, y.token AS b FROM occ x JOIN occ y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1), "
           "cnt AS (SELECT key, count(*) AS count FROM (SELECT token AS key FROM occ UNION ALL SELECT a || '_' || b FROM bg) GROUP BY key), "
           "ph AS (SELECT a, b, a || '_' || b AS key, k.count, (k.count - 5.0) / ca.count / cb.count * (SELECT count(*) FROM cnt) AS score "
           "FROM (SELECT DISTINCT a, b FROM bg) JOIN cnt k ON k.key = a || '_' || b JOIN cnt ca ON ca.key = a JOIN cnt cb ON cb.key = b "
           "WHERE score > 10.0)")
JOINED = (f"{PHRASES}, hit AS (SELECT doc_id, pos FROM bg SEMI JOIN ph USING (a, b)), "
          "rn AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM hit), "
          "kept AS (SELECT doc_id, pos FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, run) AS f FROM rn) WHERE (pos - f) % 2 = 0), "
          "out AS (SELECT o.doc_id, o.pos, CASE WHEN k.pos IS NOT NULL THEN o.token || '_' || n.token ELSE o.token END AS token "
          "FROM occ o LEFT JOIN kept k ON k.doc_id = o.doc_id AND k.pos = o.pos LEFT JOIN kept p ON p.doc_id = o.doc_id AND p.pos = o.pos - 1 "
          "LEFT JOIN occ n ON n.doc_id = o.doc_id AND n.pos = o.pos + 1 WHERE p.pos IS NULL)")


def phrases(spark, d):
    docs = documents(spark, d)
    return docs, ph.phrase_scores(docs, ph.phrase_counts(docs))


@query("phrase_counts", f"WITH {PHRASES} SELECT key, count FROM cnt")
def _(spark, d):
    return ph.phrase_counts(documents(spark, d))


@query("phrase_scores", f"WITH {JOINED} SELECT a, b, count, round(score, 6) AS score FROM ph SEMI JOIN (SELECT a, b FROM kept JOIN bg USING (doc_id, pos)) USING (a, b)")
def _(spark, d):
    return phrases(spark, d)[1].select("a", "b", "count", r6(F.col("score"), "score"))


@query("apply_phrases", f"WITH {JOINED} SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS tokens FROM out GROUP BY doc_id")
def _(spark, d):
    docs, found = phrases(spark, d)
    return ph.apply_phrases(docs, found).filter(F.size("tokens") > 0).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@query("phrase_second_pass",
       f"WITH {JOINED}, num AS (SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM out), "
       "bg2 AS (SELECT x.token || '_' || y.token AS key FROM num x JOIN num y ON x.doc_id = y.doc_id AND y.p = x.p + 1) "
       "SELECT key, CAST(sum(n) AS BIGINT) AS count FROM (SELECT key, count AS n FROM cnt UNION ALL SELECT key, count(*) FROM "
       "(SELECT token AS key FROM num UNION ALL SELECT key FROM bg2) GROUP BY key) GROUP BY key")
def _(spark, d):
    docs, found = phrases(spark, d)
    return ph.merge_counts(ph.phrase_counts(docs), ph.phrase_counts(ph.apply_phrases(docs, found)))


# ---------------------------------------------------------------- co-occurrence
MIN_COUNT = 20
WINDOW = 5
IDS = (f"{OCC}, vocab AS (SELECT token, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS term_id FROM occ "
       f"GROUP BY token HAVING count(*) >= {MIN_COUNT}), "
       "seq AS (SELECT doc_id, term_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS p FROM occ JOIN vocab USING (token)), "
       "chunks AS (SELECT doc_id, CAST(floor(p / 11) AS BIGINT) AS chunk, p % 11 AS slot, term_id FROM seq), "
       "un AS (SELECT DISTINCT doc_id, chunk, term_id FROM chunks)")


def tensor_sql(n):
    on = " ".join(f"JOIN ok {m} ON {m}.doc_id = i.doc_id AND {m}.chunk = i.chunk AND {m}.term_id > {p}.term_id"
                  for p, m in zip("ijk", "jkl"[:n - 1]))
    cols = ", ".join(f"{m}.term_id AS {m}" for m in "ijkl"[:n])
    return (f"ok AS (SELECT * FROM un WHERE (doc_id, chunk) IN (SELECT (doc_id, chunk) FROM un GROUP BY doc_id, chunk HAVING count(*) >= {n})), "
            f"uni AS (SELECT term_id, count(*) AS count FROM ok GROUP BY term_id), "
            f"ng AS (SELECT {cols}, count(*) AS count FROM ok i {on} GROUP BY ALL)")


def pmi_sql(n):
    modes = "ijkl"[:n]
    on = " ".join(f"JOIN uni u{m} ON u{m}.term_id = ng.{m}" for m in modes)
    minus = " ".join(f"- log2(u{m}.count)" for m in modes)
    return (f"pmi AS (SELECT {', '.join('ng.' + m for m in modes)}, ng.count, CASE WHEN ng.count > 5 THEN log2(ng.count) + {n - 1} * "
            f"log2((SELECT sum(count) FROM uni)) {minus} ELSE 0 END AS value FROM ng {on} WHERE ng.count > 1)")


def id_docs(spark, d):
    docs = documents(spark, d)
    vocab = c.vocab_for(v.word_counts(docs, MIN_COUNT), MIN_COUNT)
    return c.to_ids(docs, vocab), vocab


def chunks(spark, d):
    ids, vocab = id_docs(spark, d)
    ids = Kept(spark, "ids").put(ids)  # counts and unigrams read them; texts are cleaned once
    return c.chunk_sentences(ids, WINDOW), vocab


def tensor(spark, d, n, **kw):
    parts, vocab = chunks(spark, d)
    counts = c.prune_ngrams(c.ngram_cooccurrence(parts, n))
    return c.ppmi_tensor(counts, c.chunk_unigrams(parts, n), **kw), counts, vocab, parts


@query("context_windows",
       f"WITH {IDS} SELECT t.doc_id, t.p AS pos, t.term_id AS target, string_agg(CAST(x.term_id AS VARCHAR), ' ' ORDER BY x.p) AS context "
       "FROM seq t JOIN seq x ON x.doc_id = t.doc_id AND x.p BETWEEN t.p - 5 AND t.p + 5 AND x.p <> t.p GROUP BY ALL HAVING count(*) = 10")
def _(spark, d):
    out = c.context_windows(id_docs(spark, d)[0], WINDOW)
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "target",
                      F.array_join(F.col("context").cast("array<string>"), " ").alias("context"))


@query("context_windows_truncated",
       f"WITH {IDS} SELECT t.doc_id, t.p AS pos, t.term_id AS target, string_agg(CAST(x.term_id AS VARCHAR), ' ' ORDER BY x.p) AS context "
       "FROM seq t JOIN seq x ON x.doc_id = t.doc_id AND x.p BETWEEN t.p - 2 AND t.p + 2 AND x.p <> t.p GROUP BY ALL")
def _(spark, d):
    out = c.context_windows(id_docs(spark, d)[0], 2, fixed_size=False).filter(F.size("context") > 0)
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "target",
                      F.array_join(F.col("context").cast("array<string>"), " ").alias("context"))


@query("chunk_sentences",
       f"WITH {IDS} SELECT doc_id, chunk, string_agg(CAST(term_id AS VARCHAR), ' ' ORDER BY slot) AS ids FROM chunks GROUP BY ALL")
def _(spark, d):
    return chunks(spark, d)[0].select("doc_id", F.col("chunk").cast("long").alias("chunk"),
                                      F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("skipgram_pairs",
       f"WITH {IDS}, r AS (SELECT *, {WINDOW} - {draw_sql('doc_id', 'p', seed=1)} % {WINDOW} AS reach FROM seq) "
       "SELECT t.term_id AS target, count(*) AS pairs, count(DISTINCT x.term_id) AS contexts FROM r t JOIN seq x ON x.doc_id = t.doc_id "
       "AND x.p BETWEEN t.p - 5 AND t.p + 5 AND abs(x.p - t.p) BETWEEN 1 AND t.reach GROUP BY 1")
def _(spark, d):
    return c.skipgram_pairs(id_docs(spark, d)[0], WINDOW).groupBy("target").agg(
        F.count("*").alias("pairs"), F.count_distinct("context").alias("contexts"))


for _n in (2, 3):
    @query(f"ngram_cooccurrence_{_n}", f"WITH {IDS}, {tensor_sql(_n)} SELECT * FROM ng WHERE count > 1")
    def _(spark, d, n=_n):
        return c.prune_ngrams(c.ngram_cooccurrence(chunks(spark, d)[0], n))


@query("ngram_cooccurrence_4",
       "WITH un AS (SELECT DISTINCT l_orderkey AS doc_id, (l_linenumber - 1) // 11 AS chunk, l_suppkey AS term_id FROM lineitem), "
       f"{tensor_sql(4)} SELECT * FROM ng")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", F.floor((F.col("l_linenumber") - 1) / 11).alias("chunk"), "l_suppkey")  # 11 lines per chunk
    baskets = lines.groupBy("l_orderkey", "chunk").agg(F.collect_set("l_suppkey").alias("ids"))
    return c.ngram_cooccurrence(baskets, 4)


@query("chunk_unigrams", f"WITH {IDS}, {tensor_sql(3)} SELECT term_id, count FROM uni")
def _(spark, d):
    return c.chunk_unigrams(chunks(spark, d)[0], 3)


@query("pmi_2", f"WITH {IDS}, {tensor_sql(2)}, {pmi_sql(2)} SELECT i, j, count, round(value, 6) AS value FROM pmi")
def _(spark, d):
    parts, _ = chunks(spark, d)
    out = c.pmi(c.prune_ngrams(c.ngram_cooccurrence(parts, 2)), c.chunk_unigrams(parts, 2))
    return out.select("i", "j", "count", r6(F.col("value"), "value"))


@query("ppmi_tensor_3",
       f"WITH {IDS}, {tensor_sql(3)}, {pmi_sql(3)} SELECT i, j, k, round(value, 6) AS value FROM pmi WHERE value > 0")
def _(spark, d):
    return tensor(spark, d, 3)[0].select("i", "j", "k", r6(F.col("value"), "value"))


@query("ppmi_shifted",
       f"WITH {IDS}, {tensor_sql(2)}, {pmi_sql(2)} SELECT i, j, round(value - log2(15), 6) AS value FROM pmi WHERE value - log2(15) > 0")
def _(spark, d):
    import math

    return tensor(spark, d, 2, shift=-math.log2(15))[0].select("i", "j", r6(F.col("value"), "value"))


@query("count_tensor", f"WITH {IDS}, {tensor_sql(2)} SELECT i, j, CAST(count AS DOUBLE) AS value FROM ng WHERE count > 1")
def _(spark, d):
    return tensor(spark, d, 2, use_pmi=False)[0]


@query("limit_large_vals",
       f"WITH {IDS}, {tensor_sql(2)}, {pmi_sql(2)} SELECT i, j, round(value, 6) AS value FROM pmi WHERE value > 0 AND NOT (i < 15 AND j < 15)")
def _(spark, d):
    return c.limit_large_vals(tensor(spark, d, 2)[0]).select("i", "j", r6(F.col("value"), "value"))


@query("add_zero_samples",
       f"WITH {IDS}, {tensor_sql(2)}, {pmi_sql(2)}, v AS (SELECT i, j, round(value, 6) AS value FROM pmi WHERE value > 0), "
       "n AS (SELECT CAST(floor(0.2::DOUBLE * (SELECT count(*) FROM v)) AS BIGINT) AS draws, (SELECT count(*) FROM vocab) AS size), "
       f"d AS (SELECT {draw_sql('id', 0, seed=1)} % size AS a, {draw_sql('id', 1, seed=1)} % size AS b "
       "FROM (SELECT unnest(range(0, draws)) AS id, size FROM n)), "
       "z AS (SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j FROM d WHERE a <> b) "
       "SELECT * FROM v UNION ALL SELECT i, j, 0.0::DOUBLE FROM z ANTI JOIN (SELECT i, j FROM ng WHERE count > 1) USING (i, j)")
def _(spark, d):
    values, counts, vocab, _ = tensor(spark, d, 2)
    return c.add_zero_samples(values, counts, vocab.count(), 0.2).select("i", "j", r6(F.col("value"), "value"))


@query("symmetrize",
       f"WITH {IDS}, {tensor_sql(2)}, {pmi_sql(2)}, p AS (SELECT i, j, round(value, 6) AS value FROM pmi WHERE value > 0) "
       "SELECT i, j, value FROM p UNION ALL SELECT j, i, value FROM p")
def _(spark, d):
    return c.symmetrize(tensor(spark, d, 2)[0]).select("i", "j", r6(F.col("value"), "value"))


@query("top_tuples",
       f"WITH {IDS}, {tensor_sql(2)}, {pmi_sql(2)}, p AS (SELECT i, j, round(value, 6) AS value FROM pmi WHERE value > 0 "
       "ORDER BY round(value, 6) DESC, i, j LIMIT 50) SELECT a.token AS word_i, b.token AS word_j, value FROM p "
       "JOIN vocab a ON a.term_id = i JOIN vocab b ON b.term_id = j")
def _(spark, d):
    values, _, vocab, _ = tensor(spark, d, 2)
    return c.top_tuples(values, vocab, 50)


@query("batch_slice",
       f"WITH {IDS}, {tensor_sql(2)}, {pmi_sql(2)}, b AS (SELECT DISTINCT i.term_id AS i, j.term_id AS j FROM un i JOIN un j "
       "ON i.doc_id = j.doc_id AND i.chunk = j.chunk AND j.term_id > i.term_id JOIN documents d ON d.doc_id = i.doc_id WHERE d.lang = 'de') "
       "SELECT i, j, round(value, 6) AS value FROM pmi SEMI JOIN b USING (i, j) WHERE value > 0")
def _(spark, d):
    values, _, _, parts = tensor(spark, d, 2)
    german = table(spark, d, "documents").filter("lang = 'de'").select("doc_id")
    return c.batch_slice(values, parts.join(german, "doc_id", "left_semi")).select("i", "j", r6(F.col("value"), "value"))


@query("count_with_context_2",
       f"WITH {IDS} SELECT t.term_id AS i, x.term_id AS j, count(*) AS count FROM seq t JOIN seq x ON x.doc_id = t.doc_id "
       "AND x.p BETWEEN t.p - 2 AND t.p + 2 AND x.p <> t.p GROUP BY ALL")
def _(spark, d):
    return c.count_with_context(c.context_windows(id_docs(spark, d)[0], 2, fixed_size=False), 2)


@query("count_with_context_3",
       f"WITH {IDS} SELECT t.term_id AS i, x.term_id AS j, y.term_id AS k, count(*) AS count FROM seq t JOIN seq x ON x.doc_id = t.doc_id "
       "AND x.p BETWEEN t.p - 1 AND t.p + 1 AND x.p <> t.p JOIN seq y ON y.doc_id = t.doc_id AND y.p BETWEEN t.p - 1 AND t.p + 1 AND y.p <> t.p GROUP BY ALL")
def _(spark, d):
    return c.count_with_context(c.context_windows(id_docs(spark, d)[0], 1, fixed_size=False), 3)


# ---------------------------------------------------------------- coherence: topics = each language's most frequent words
TOPICS = (f"{OCC}, topics AS (SELECT lang AS topic, token, row_number() OVER (PARTITION BY lang ORDER BY count(DISTINCT doc_id) DESC, token) - 1 AS rank "
          "FROM occ JOIN documents USING (doc_id) GROUP BY lang, token QUALIFY rank < 10), "
          "tw AS (SELECT DISTINCT token FROM topics), lens AS (SELECT doc_id, len(tokens) AS n FROM tok)")


def units_sql(window=None):
    if window is None:
        units = "units AS (SELECT DISTINCT doc_id, 0 AS u, token FROM occ SEMI JOIN tw USING (token))"
        total = "(SELECT count(*) FROM documents)"
    else:
        units = (f"units AS (SELECT DISTINCT doc_id, unnest(range(greatest(pos - {window} + 1, 0), least(pos, greatest(n - {window}, 0)) + 1)) AS u, token "
                 "FROM occ SEMI JOIN tw USING (token) JOIN lens USING (doc_id))")
        total = f"(SELECT sum(greatest(n - {window} + 1, 1)) FROM lens)"
    return (f"{units}, s1 AS (SELECT token, count(*) AS n FROM units GROUP BY token), "
            "s2 AS (SELECT x.token AS a, y.token AS b, count(*) AS n FROM units x JOIN units y ON x.doc_id = y.doc_id AND x.u = y.u GROUP BY ALL), "
            f"tot AS (SELECT CAST({total} AS DOUBLE) AS t), "
            "seg AS (SELECT x.topic, x.token AS a, y.token AS b, x.rank AS ra, y.rank AS rb FROM topics x JOIN topics y ON x.topic = y.topic), "
            "pc AS (SELECT topic, seg.a, seg.b, ra, rb, p.n AS na, q.n AS nb, coalesce(s2.n, 0) AS nab, t FROM seg JOIN s1 p ON p.token = seg.a "
            "JOIN s1 q ON q.token = seg.b LEFT JOIN s2 ON s2.a = seg.a AND s2.b = seg.b, tot)")


LCP = "ln((nab / t + 1e-12) / (nb / t))"
PMI = "ln((nab / t + 1e-12) / ((na / t) * (nb / t)))"
NPMI = f"{PMI} / -ln(nab / t + 1e-12)"


def topics(spark, d):
    docs = documents(spark, d)
    langs = table(spark, d, "documents").select("doc_id", "lang")
    df = v.token_runs(docs).join(langs, "doc_id").groupBy(F.col("lang").alias("topic"), "token").agg(F.count("*").alias("df"))
    w = W.partitionBy("topic").orderBy(F.col("df").desc(), "token")
    return docs, df.withColumn("rank", F.row_number().over(w) - 1).filter("rank < 10").drop("df")


for _name, _cond in (("one_pre", "x.rank > y.rank"), ("one_one", "x.rank <> y.rank"), ("one_set", "true")):
    @query(f"segment_{_name}", f"WITH {TOPICS} SELECT x.topic, x.token AS w_prime, y.token AS w_star FROM topics x JOIN topics y "
           f"ON x.topic = y.topic AND {_cond}")
    def _(spark, d, name=_name):
        return getattr(coh, f"segment_{name}")(topics(spark, d)[1])


def _pairs(spark, d, window=None):
    docs, tp = topics(spark, d)
    units, total = coh.document_units(docs, tp) if window is None else coh.window_units(docs, tp, window)
    return coh.pair_counts(units, coh.segment_one_one(tp)), total


for _name, _window in (("p_boolean_document", None), ("p_sliding_window", 10)):
    @query(_name, f"WITH {TOPICS}, {units_sql(_window)} SELECT DISTINCT a AS w_prime, b AS w_star, CAST(na AS DOUBLE) AS n_prime, "
           "CAST(nb AS DOUBLE) AS n_star, CAST(nab AS DOUBLE) AS n_both FROM pc WHERE ra <> rb")
    def _(spark, d, window=_window):
        return _pairs(spark, d, window)[0]


for _name, _expr, _window in (("log_conditional_probability", LCP, None), ("log_ratio", PMI, 10), ("normalized_log_ratio", NPMI, 10)):
    @query(_name, f"WITH {TOPICS}, {units_sql(_window)} SELECT DISTINCT a AS w_prime, b AS w_star, round({_expr}, 6) AS m FROM pc WHERE ra <> rb")
    def _(spark, d, name=_name, window=_window):
        counts, total = _pairs(spark, d, window)
        out = coh.log_conditional_probability(counts, total) if window is None else coh.log_ratio(counts, total, "norm" in name)
        return out.select("w_prime", "w_star", r6(F.col("m"), "m"))


for _name, _expr, _window, _cond in (("u_mass", LCP, None, "ra > rb"), ("c_uci", PMI, 10, "ra <> rb"), ("c_npmi", NPMI, 10, "ra <> rb")):
    @query(f"coherence_{_name}", f"WITH {TOPICS}, {units_sql(_window)} SELECT topic, round(avg({_expr}), 6) AS coherence FROM pc "
           f"WHERE {_cond} GROUP BY topic")
    def _(spark, d, name=_name):
        docs, tp = topics(spark, d)
        return coh.coherence_per_topic(docs, tp, name).select("topic", r6(F.col("coherence"), "coherence"))


@query("coherence_c_v",
       f"WITH {TOPICS}, {units_sql(110)}, c AS (SELECT topic, a, b, {NPMI} AS u FROM pc), "
       "s AS (SELECT topic, b, sum(u) AS s FROM c GROUP BY ALL), "
       "m AS (SELECT topic, a, sum(u * s) / sqrt(sum(u * u)) / sqrt(sum(s * s)) AS m FROM c JOIN s USING (topic, b) GROUP BY ALL) "
       "SELECT round(avg(m), 6) AS coherence FROM m")
def _(spark, d):
    docs, tp = topics(spark, d)
    return coh.coherence(docs, tp, "c_v").select(r6(F.col("coherence"), "coherence"))


@query("top_topics",
       f"WITH {TOPICS}, {units_sql()} SELECT topic, round(sum(ln((nab + 1.0) / nb)), 6) AS score FROM pc WHERE ra > rb GROUP BY topic")
def _(spark, d):
    docs, tp = topics(spark, d)
    return coh.top_topics(docs, tp).select("topic", r6(F.col("score"), "score"))
