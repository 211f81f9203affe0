"""Distance and similarity-search queries."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.functions import vectors as vx
from vectorloom.functions.text import simple_preprocess
from vectorloom.operators import distance as dist
from vectorloom.operators import search as s
from vectorloom.operators import vocab as v
from vectorloom.operators import weight as w
from vectorloom.plans.registry import BOW, OCC, documents, query, r6, table, tok_sql
from vectorloom.plans.weight_queries import NDOCS, TFIDF_SQL, corpus_tfidf

K = 5
PAIRS_SQL = "pairs AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents))"
ALIGNED = (f"WITH {BOW}, {PAIRS_SQL}, al AS (SELECT a, b, token, sum(wa) AS wa, sum(wb) AS wb FROM ("
           "SELECT a, b, token, CAST(tf AS DOUBLE) AS wa, 0.0::DOUBLE AS wb FROM pairs JOIN bow ON doc_id = a UNION ALL "
           "SELECT a, b, token, 0.0::DOUBLE AS wa, CAST(tf AS DOUBLE) AS wb FROM pairs JOIN bow ON doc_id = b) "
           "GROUP BY a, b, token)")


def neighbours(spark, d):
    """Every document with its successor."""
    ids = table(spark, d, "documents").select("doc_id")
    nxt = ids.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"))
    return nxt.join(ids, nxt.a == ids.doc_id, "left_semi")


def _rows(spark, d):
    return v.token_runs(documents(spark, d)).withColumn("tf", F.col("tf").cast("double"))


COLS = {"key": "token", "weight": "tf"}


@query("cossim", f"{ALIGNED} SELECT p.a, p.b, round(coalesce(x, 0), 6) AS similarity FROM pairs p LEFT JOIN (SELECT a, b, "
       "CASE WHEN sum(wa*wa) > 0 AND sum(wb*wb) > 0 THEN sum(wa*wb)/sqrt(sum(wa*wa))/sqrt(sum(wb*wb)) ELSE 0 END AS x "
       "FROM al GROUP BY a, b) q ON p.a = q.a AND p.b = q.b")
def _(spark, d):
    return dist.cossim(neighbours(spark, d), _rows(spark, d), **COLS).select("a", "b", r6(F.col("similarity"), "similarity"))


# One half of every word's mass is spread over the pair's common axis so that the divergence is finite.
@query("kullback_leibler",
       f"{ALIGNED}, sm AS (SELECT a, b, token, wa + 1 AS wa, wb + 1 AS wb FROM al), "
       "pr AS (SELECT a, b, wa / sum(wa) OVER (PARTITION BY a, b) AS p, wb / sum(wb) OVER (PARTITION BY a, b) AS q FROM sm) "
       "SELECT a, b, round(sum(p * ln(p / q)), 6) AS divergence FROM pr GROUP BY a, b")
def _(spark, d):
    out = dist.kullback_leibler(neighbours(spark, d), _rows(spark, d), smooth=1.0, **COLS)
    return out.select("a", "b", (F.round("divergence", 6) + 0.0).alias("divergence"))  # no minus zero


@query("kullback_leibler_raw",
       f"{ALIGNED}, pr AS (SELECT a, b, wa / sum(wa) OVER (PARTITION BY a, b) AS p, wb / sum(wb) OVER (PARTITION BY a, b) AS q "
       "FROM al), t AS (SELECT a, b, count(*) FILTER (p > 0 AND q = 0) AS holes, "
       "sum(CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END) AS x FROM pr GROUP BY a, b HAVING sum(p) > 0 AND sum(q) > 0) "
       "SELECT a, b, holes > 0 AS infinite, round(CASE WHEN holes > 0 THEN -1 ELSE x END, 6) AS divergence FROM t")
def _(spark, d):
    out = dist.kullback_leibler(neighbours(spark, d), _rows(spark, d), **COLS)
    inf = F.col("divergence") == float("inf")
    return out.select("a", "b", inf.alias("infinite"), r6(F.when(inf, -1.0).otherwise(F.col("divergence")), "divergence"))


@query("hellinger", f"{ALIGNED} SELECT a, b, round(sqrt(0.5 * sum(pow(sqrt(wa) - sqrt(wb), 2))), 6) AS distance FROM al GROUP BY a, b")
def _(spark, d):
    return dist.hellinger(neighbours(spark, d), _rows(spark, d), **COLS).select("a", "b", r6(F.col("distance"), "distance"))


@query("hellinger_shorter",
       f"{ALIGNED}, x AS (SELECT a, b, count(*) FILTER (wa <> 0) AS na, count(*) FILTER (wb <> 0) AS nb, "
       "sum(CASE WHEN wa <> 0 THEN pow(sqrt(wa) - sqrt(wb), 2) ELSE 0 END) AS sa, "
       "sum(CASE WHEN wb <> 0 THEN pow(sqrt(wa) - sqrt(wb), 2) ELSE 0 END) AS sb FROM al GROUP BY a, b) "
       "SELECT a, b, round(sqrt(0.5 * CASE WHEN na <= nb THEN sa ELSE sb END), 6) AS distance FROM x")
def _(spark, d):
    return dist.hellinger(neighbours(spark, d), _rows(spark, d), keys="shorter", **COLS).select(
        "a", "b", r6(F.col("distance"), "distance"))


@query("jaccard", f"{ALIGNED} SELECT a, b, round(1 - sum(least(wa, wb)) / sum(wa + wb), 6) AS distance FROM al GROUP BY a, b")
def _(spark, d):
    return dist.jaccard(neighbours(spark, d), _rows(spark, d), **COLS).select("a", "b", r6(F.col("distance"), "distance"))


@query("jaccard_set", f"{ALIGNED} SELECT a, b, round(1 - count(*) FILTER (wa <> 0 AND wb <> 0) * 1.0 / count(*), 6) AS distance "
       "FROM al GROUP BY a, b")
def _(spark, d):
    return dist.jaccard_set(neighbours(spark, d), _rows(spark, d), **COLS).select("a", "b", r6(F.col("distance"), "distance"))


# ---- embeddings: word = zero-padded id so that text order and id order agree
EMB = ("emb AS (SELECT 'w' || lpad(CAST(vec_id AS VARCHAR), 8, '0') AS word, vec_id AS idx, label, "
       "CAST(embedding AS DOUBLE[]) AS v FROM embeddings), "
       "un AS (SELECT word, idx, label, v, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM emb)")
DOT = "list_dot_product({}, {})"


def word_of(c):
    return F.concat(F.lit("w"), F.lpad(c.cast("string"), 8, "0"))


def embedding(spark, d):
    return table(spark, d, "embeddings").select(
        word_of(F.col("vec_id")).alias("word"), F.col("vec_id").alias("idx"), "label",
        F.col("embedding").cast("array<double>").alias("vector"))


@query("word_similarity",
       f"WITH {EMB} SELECT x.idx AS id, round({DOT.format('x.u', 'y.u')}, 6) AS similarity FROM un x JOIN un y ON y.idx = x.idx + 7")
def _(spark, d):
    ids = table(spark, d, "embeddings").select("vec_id")
    pairs = ids.select(F.col("vec_id").alias("id"), word_of(F.col("vec_id")).alias("a"), word_of(F.col("vec_id") + 7).alias("b"))
    return dist.word_similarity(pairs, embedding(spark, d)).select("id", r6(F.col("similarity"), "similarity"))


def _mean_sql(source, by, vec="u"):
    return (f"SELECT {by}, list(m ORDER BY i) AS m FROM (SELECT {by}, i, avg(x) AS m FROM (SELECT {by}, unnest({vec}) AS x, "
            f"generate_subscripts({vec}, 1) AS i FROM {source}) GROUP BY {by}, i) GROUP BY {by}")


def _norm(x):
    return f"sqrt({DOT.format(x, x)})"


@query("n_similarity",
       f"WITH {EMB}, mem AS (SELECT CAST(floor(idx / 8) AS BIGINT) AS g, CASE WHEN idx % 8 < 4 THEN 'a' ELSE 'b' END AS side, v FROM emb), "
       f"mm AS ({_mean_sql('mem', 'g, side', 'v')}) SELECT x.g AS pair_id, round({DOT.format('x.m', 'y.m')} / "
       f"({_norm('x.m')} * {_norm('y.m')}), 6) AS similarity FROM mm x JOIN mm y ON x.g = y.g AND x.side = 'a' AND y.side = 'b'")
def _(spark, d):
    e = embedding(spark, d)
    sets = e.select(F.floor(F.col("idx") / 8).cast("long").alias("pair_id"),
                    F.when(F.col("idx") % 8 < 4, "a").otherwise("b").alias("side"), "word")
    return dist.n_similarity(sets, e).select("pair_id", r6(F.col("similarity"), "similarity"))


_WORDVEC = (f"{OCC}, wv AS (SELECT token AS word, CAST(embedding AS DOUBLE[]) AS v FROM (SELECT token, "
            "row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS r FROM occ GROUP BY token) JOIN embeddings ON r = vec_id)")


def word_vectors(spark, d):
    """The corpus' most frequent words, each given one row of the embeddings table by rank."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    ranked = v.assign_ids(v.word_counts(documents(spark, d), 1), by="count")  # the join keeps the ranks that have a vector
    return ranked.join(e, ranked.term_id == e.vec_id).select(F.col("token").alias("word"), F.col("term_id").alias("idx"), "vector")


@query("relaxed_wmd",
       f"WITH {_WORDVEC}, ct AS ({tok_sql('conversations', 'conv_id, turn')}), cu AS (SELECT conv_id, turn, unnest(tokens) AS word FROM ct), "
       "n AS (SELECT conv_id, turn, word, count(*) AS tf, v FROM cu JOIN wv USING (word) GROUP BY ALL), "
       "m AS (SELECT *, tf * 1.0 / sum(tf) OVER (PARTITION BY conv_id, turn) AS mass FROM n), "
       "x AS (SELECT a.conv_id, a.turn, a.word AS wa, b.word AS wb, a.mass AS ma, b.mass AS mb, list_distance(a.v, b.v) AS dd "
       "FROM m a JOIN m b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), "
       "ab AS (SELECT conv_id, turn, sum(c) AS s FROM (SELECT conv_id, turn, wa, min(dd) * min(ma) AS c FROM x GROUP BY conv_id, turn, wa) GROUP BY ALL), "
       "ba AS (SELECT conv_id, turn, sum(c) AS s FROM (SELECT conv_id, turn, wb, min(dd) * min(mb) AS c FROM x GROUP BY conv_id, turn, wb) GROUP BY ALL) "
       "SELECT conv_id, turn, round(greatest(ab.s, ba.s), 5) AS distance FROM ab JOIN ba USING (conv_id, turn)")
def _(spark, d):
    turns = table(spark, d, "conversations").select(
        F.struct("conv_id", "turn").alias("doc_id"), simple_preprocess(F.col("text")).alias("tokens"))
    counted = v.token_runs(turns).withColumnRenamed("token", "word")
    pairs = turns.select(F.col("doc_id").alias("a"),
                         F.struct(F.col("doc_id.conv_id"), (F.col("doc_id.turn") + 1).alias("turn")).alias("b"))
    out = dist.relaxed_wmd(pairs, counted, word_vectors(spark, d))
    return out.filter(F.col("distance") < float("inf")).select(
        F.col("a.conv_id").alias("conv_id"), F.col("a.turn").alias("turn"), F.round("distance", 5).alias("distance"))


# ---- search
_BM = (f"bt AS ({tok_sql('benchmark', 'item_id')}), bo AS (SELECT item_id, unnest(tokens) AS token FROM bt), "
       "bq AS (SELECT item_id, token, count(*) * idf AS w FROM bo JOIN idf USING (token) GROUP BY item_id, token, idf), "
       "q AS (SELECT item_id, token, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM bq)")
_HITS = ("hits AS (SELECT item_id AS query_id, doc_id AS hit_id, round(sum(q.w * t.w), 6) AS score FROM q JOIN tfidf t USING (token) "
         f"GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(score) DESC, hit_id) AS rank FROM hits "
         f"WHERE abs(score) > 1e-9 QUALIFY rank <= {K})")


def benchmark_hits(spark, d):
    docs = documents(spark, d)
    runs, vocab, n = v.token_runs(docs), v.token_counts(docs), docs.count()
    index = s.index_documents(w.tfidf(runs, vocab, n, key="token"), key="token")
    items = table(spark, d, "benchmark").select("item_id", simple_preprocess(F.col("text")).alias("tokens"))
    asked = w.tfidf(v.token_runs(items, "item_id"), vocab, n, doc_id="item_id", key="token")
    q = s.index_documents(asked, "item_id", "token")
    return s.sparse_similarity(q, index, K, "item_id")


@query("similarity_query", f"WITH {TFIDF_SQL}, {_BM}, {_HITS} SELECT query_id, hit_id, score, rank FROM best")
def _(spark, d):
    return benchmark_hits(spark, d)


@query("top_texts", f"WITH {TFIDF_SQL}, {_BM}, {_HITS} SELECT query_id, hit_id, score, text FROM best JOIN documents ON doc_id = hit_id")
def _(spark, d):
    return s.top_texts(benchmark_hits(spark, d), table(spark, d, "documents")).select("query_id", "hit_id", "score", "text")


@query("similarity_self_join",
       f"WITH {TFIDF_SQL}, h AS (SELECT x.doc_id AS query_id, y.doc_id AS hit_id, round(sum(x.w * y.w), 6) AS score FROM tfidf x "
       "JOIN tfidf y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY ALL) SELECT *, "
       f"row_number() OVER (PARTITION BY query_id ORDER BY abs(score) DESC, hit_id) AS rank FROM h WHERE abs(score) > 1e-9 QUALIFY rank <= {K}")
def _(spark, d):
    return s.similarity_self_join(s.index_documents(corpus_tfidf(spark, d), key="token"), K)


@query("similarity_by_id",
       f"WITH {TFIDF_SQL}, h AS (SELECT x.doc_id AS query_id, y.doc_id AS hit_id, round(sum(x.w * y.w), 6) AS score FROM tfidf x "
       "JOIN tfidf y ON x.token = y.token WHERE x.doc_id = (SELECT min(doc_id) FROM documents) GROUP BY ALL) SELECT *, "
       "row_number() OVER (PARTITION BY query_id ORDER BY abs(score) DESC, hit_id) AS rank FROM h WHERE abs(score) > 1e-9 QUALIFY rank <= 10")
def _(spark, d):
    first = table(spark, d, "documents").agg(F.min("doc_id")).first()[0]
    return s.similarity_by_id(s.index_documents(corpus_tfidf(spark, d), key="token"), first, 10)


@query("dense_similarity",
       f"WITH {EMB}, h AS (SELECT x.idx AS query_id, y.idx AS hit_id, round({DOT.format('x.u', 'y.u')}, 6) AS score FROM un x JOIN un y ON x.idx <> y.idx) "
       f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM h QUALIFY rank <= {K}")
def _(spark, d):
    e = embedding(spark, d)
    return s.dense_similarity(e.select(F.col("idx").alias("q"), "vector"), e, K, "q", "idx", drop_self=True)


_INPUTS = ("inp AS (SELECT idx AS query_id, un.word, t.wgt FROM (SELECT idx FROM un WHERE idx + 2 < (SELECT count(*) FROM un)) g, "
           "(VALUES (0, 1.0), (1, -1.0), (2, 1.0)) t(o, wgt) JOIN un ON un.idx = g.idx + t.o)")


def analogy_inputs(spark, d):
    ids = table(spark, d, "embeddings").select("vec_id")
    n = ids.count()
    terms = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(x).alias("weight")) for o, x in ((0, 1.0), (1, -1.0), (2, 1.0))]))
    return ids.filter(F.col("vec_id") + 2 < n).select("vec_id", terms.alias("t")).select(
        F.col("vec_id").alias("query_id"), word_of(F.col("vec_id") + F.col("t.o")).alias("word"), F.col("t.weight").alias("weight"))


_INP2 = ("inp AS (SELECT g.idx AS query_id, u.word, t.wgt, u.u FROM un g CROSS JOIN (VALUES (0, 1.0), (1, -1.0), (2, 1.0)) t(o, wgt) "
         "JOIN un u ON u.idx = g.idx + t.o WHERE g.idx + 2 < (SELECT count(*) FROM un))")


@query("most_similar",
       f"WITH {EMB}, {_INP2}, sg AS (SELECT query_id, list_transform(u, lambda x: x * wgt) AS s FROM inp), "
       f"qv AS ({_mean_sql('sg', 'query_id', 's')}), h AS (SELECT query_id, un.word AS hit_id, "
       f"round({DOT.format('m', 'un.u')} / {_norm('m')}, 6) AS score FROM qv, un WHERE un.idx < 400 "
       "AND NOT EXISTS (SELECT 1 FROM inp WHERE inp.query_id = qv.query_id AND inp.word = un.word)) "
       "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM h QUALIFY rank <= 3")
def _(spark, d):
    return s.most_similar(analogy_inputs(spark, d), embedding(spark, d), 3, restrict_vocab=400)


@query("neighbour_report",
       f"WITH {EMB}, h AS (SELECT x.word, y.word AS hit, round({DOT.format('x.u', 'y.u')}, 6) AS score FROM un x JOIN un y ON x.idx <> y.idx WHERE x.idx % 5 = 0), "
       "b AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, hit) AS rank FROM h QUALIFY rank <= 3) "
       "SELECT word, string_agg(printf('%s:%.3f', hit, score), ' ' ORDER BY rank) AS neighbours FROM b GROUP BY word")
def _(spark, d):
    e = embedding(spark, d)
    return s.neighbour_report(e.filter(F.col("idx") % 5 == 0), e, 3)


@query("most_similar_cosmul",
       f"WITH {EMB}, {_INP2}, c AS (SELECT query_id, un.word AS hit_id, inp.wgt, (1 + {DOT.format('inp.u', 'un.u')}) / 2 AS c FROM inp, un), "
       "h AS (SELECT query_id, hit_id, round(exp(sum(ln(c)) FILTER (wgt > 0)) / (exp(sum(ln(c)) FILTER (wgt < 0)) + 1e-6), 6) AS score FROM c GROUP BY ALL) "
       "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit_id) AS rank FROM h "
       "WHERE NOT EXISTS (SELECT 1 FROM inp WHERE inp.query_id = h.query_id AND inp.word = h.hit_id) QUALIFY rank <= 3")
def _(spark, d):
    return s.most_similar_cosmul(analogy_inputs(spark, d), embedding(spark, d), 3)


@query("doesnt_match",
       f"WITH {EMB}, mem AS (SELECT CAST(floor(idx / 6) AS BIGINT) AS g, word, u FROM un), mm AS ({_mean_sql('mem', 'g')}), "
       f"sc AS (SELECT g, word, round({DOT.format('u', 'm')} / {_norm('m')}, 6) AS score FROM mem JOIN mm USING (g)) "
       "SELECT g AS group_id, word, score FROM sc QUALIFY row_number() OVER (PARTITION BY g ORDER BY score, word) = 1")
def _(spark, d):
    e = embedding(spark, d)
    groups = e.select(F.floor(F.col("idx") / 6).cast("long").alias("group_id"), "word")
    return s.doesnt_match(groups, e)


@query("approx_nearest")
def _(spark, d):
    e = embedding(spark, d)
    return s.approx_nearest(e.select(F.col("idx").alias("q"), "vector"), e, K, "q", "idx", dim=64, drop_self=True)


_CELLS = "cells AS (SELECT word, unnest(v) AS value, generate_subscripts(v, 1) - 1 AS dim FROM emb)"


@query("top_words_per_dimension",
       f"WITH {EMB}, {_CELLS} SELECT word, dim, round(value, 6) AS value FROM cells "
       "QUALIFY row_number() OVER (PARTITION BY dim ORDER BY value DESC, word) <= 5")
def _(spark, d):
    return s.top_words_per_dimension(embedding(spark, d), 5).select(
        "word", F.col("dim").cast("long").alias("dim"), r6(F.col("value"), "value"))


@query("top_dimensions_of_words",
       f"WITH {EMB}, {_CELLS}, td AS (SELECT word, dim FROM cells QUALIFY row_number() OVER (PARTITION BY word ORDER BY value DESC, dim) <= 2), "
       "ld AS (SELECT dim, word AS leader, row_number() OVER (PARTITION BY dim ORDER BY value DESC, word) AS r FROM cells QUALIFY r <= 4) "
       "SELECT td.word, td.dim, leader, row_number() OVER (PARTITION BY td.word, td.dim ORDER BY r) AS rank FROM td JOIN ld USING (dim) "
       "WHERE word <> leader QUALIFY rank <= 3")
def _(spark, d):
    return s.top_dimensions_of_words(embedding(spark, d), 2, 3).select(
        "word", F.col("dim").cast("long").alias("dim"), "leader", F.col("rank").cast("long").alias("rank"))


@query("dimension_intruders")
def _(spark, d):
    return s.dimension_intruders(embedding(spark, d))


@query("embedding_norms",
       f"WITH {EMB} SELECT word, round(list_sum(list_transform(v, lambda x: abs(x))), 6) AS l1, round({_norm('v')}, 6) AS l2, "
       "round(list_max(list_transform(v, lambda x: abs(x))), 6) AS linf, round(list_min(list_transform(v, lambda x: abs(x))), 6) AS lmin FROM emb")
def _(spark, d):
    c = F.col("vector")
    return embedding(spark, d).select("word", r6(vx.vector_norm(c, "1"), "l1"), r6(vx.vector_norm(c, "2"), "l2"),
                                      r6(vx.vector_norm(c, "inf"), "linf"), r6(vx.vector_norm(c, "-inf"), "lmin"))


@query("normalize_rows",
       f"WITH {EMB} SELECT word, generate_subscripts(u, 1) - 1 AS dim, round(unnest(u), 6) AS value FROM un")
def _(spark, d):
    return embedding(spark, d).select("word", F.posexplode(vx.normalize_rows(F.col("vector"))).alias("dim", "value")).select(
        "word", F.col("dim").cast("long").alias("dim"), r6(F.col("value"), "value"))


@query("intersect_embedding",
       f"WITH {EMB} SELECT x.word, y.word IS NOT NULL AS locked, round(coalesce(list_sum(y.u), list_sum(x.v)), 6) AS total "
       "FROM emb x LEFT JOIN un y ON x.word = y.word AND y.label <= 4")
def _(spark, d):
    e = embedding(spark, d)
    other = e.filter("label <= 4").withColumn("vector", vx.unit(F.col("vector")))
    return s.intersect_embedding(e, other).select("word", "locked", r6(vx.total(F.col("vector")), "total"))


@query("docs_to_mean_vector",
       f"WITH {_WORDVEC}, x AS (SELECT doc_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM occ JOIN wv ON word = token) "
       "SELECT doc_id, dim, round(avg(x), 6) AS value FROM x GROUP BY ALL")
def _(spark, d):
    out = w.docs_to_vectors(documents(spark, d), word_vectors(spark, d), 64)
    return out.select("doc_id", F.posexplode("vector").alias("dim", "value")).select(
        "doc_id", F.col("dim").cast("long").alias("dim"), r6(F.col("value"), "value"))
