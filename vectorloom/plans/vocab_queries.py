"""Vocabulary queries over the whole corpus."""

from pyspark.sql import functions as F

from vectorloom.functions.text import simple_preprocess
from vectorloom.operators import vocab as v
from vectorloom.plans.registry import BOW, OCC, TOK, VOCAB, documents, query, r6, table, tok_sql, hash01_sql

COUNTS = f"{OCC}, cnt AS (SELECT token, count(*) AS count FROM occ GROUP BY token)"


@query("build_vocab", f"WITH {VOCAB} SELECT token, df, cf, term_id FROM vocab")
def _(spark, d):
    return v.build_vocab(documents(spark, d))


@query("item_vocab",
       "SELECT CAST(l_partkey AS VARCHAR) AS token, count(DISTINCT l_orderkey) AS df, count(*) AS cf, "
       "row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, CAST(l_partkey AS VARCHAR)) - 1 AS term_id "
       "FROM lineitem GROUP BY l_partkey")
def _(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("token"))
    per_order = items.groupBy("l_orderkey", "token").agg(F.count("*").alias("tf"))
    return v.assign_ids(per_order.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))


@query("corpus_stats",
       f"WITH {BOW} SELECT (SELECT count(*) FROM documents) AS num_docs, CAST(sum(tf) AS BIGINT) AS num_pos, "
       "count(*) AS num_nnz FROM bow")
def _(spark, d):
    return v.corpus_stats(documents(spark, d))


@query("doc2bow", f"WITH {VOCAB} SELECT doc_id, term_id, tf FROM bow JOIN vocab USING (token)")
def _(spark, d):
    docs = documents(spark, d)
    return v.doc2bow(docs, v.build_vocab(docs))


@query("doc2bow_missing",
       f"WITH {BOW}, known AS (SELECT token FROM bow GROUP BY token HAVING count(*) >= 5) "
       "SELECT doc_id, token, tf FROM bow WHERE token NOT IN (SELECT token FROM known)")
def _(spark, d):
    docs = documents(spark, d)
    return v.missing_tokens(docs, v.token_counts(docs).filter("df >= 5"))


_EXT = ("SELECT token, df, cf, row_number() OVER (ORDER BY df DESC, token) - 1 AS term_id FROM (SELECT token, df, cf "
        "FROM vocab WHERE df >= 5 AND df <= floor(0.5 * (SELECT count(*) FROM documents)) "
        "ORDER BY df DESC, token LIMIT 2000)")


@query("filter_extremes", f"WITH {VOCAB} {_EXT}")
def _(spark, d):
    docs = documents(spark, d)
    return v.filter_extremes(v.token_counts(docs), docs, no_below=5, no_above=0.5, keep_n=2000)


@query("filter_n_most_frequent",
       f"WITH {VOCAB} SELECT token, df, cf, row_number() OVER (ORDER BY df DESC, token) - 1 AS term_id FROM vocab "
       "WHERE term_id >= 50")
def _(spark, d):
    return v.filter_n_most_frequent(v.token_counts(documents(spark, d)), 50)


@query("filter_tokens",
       f"WITH {VOCAB}, bm AS ({tok_sql('benchmark', 'item_id')}), bad AS (SELECT DISTINCT unnest(tokens) AS token FROM bm) "
       "SELECT token, df, cf, row_number() OVER (ORDER BY df DESC, token) - 1 AS term_id FROM vocab "
       "WHERE token NOT IN (SELECT token FROM bad)")
def _(spark, d):
    bad = table(spark, d, "benchmark").select(F.explode(simple_preprocess(F.col("text"))).alias("token")).distinct()
    return v.filter_tokens(v.token_counts(documents(spark, d)), bad=bad)


_CONV = (f"ctok AS ({tok_sql('conversations', 'conv_id, turn')}), "
         "cocc AS (SELECT conv_id, turn, unnest(tokens) AS token FROM ctok), "
         "cbow AS (SELECT conv_id, turn, token, count(*) AS tf FROM cocc GROUP BY ALL), "
         "cvocab AS (SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, "
         "row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS term_id FROM cbow GROUP BY token), "
         "sums AS (SELECT token, CAST(sum(df) AS BIGINT) AS df, CAST(sum(cf) AS BIGINT) AS cf FROM "
         "(SELECT token, df, cf FROM vocab UNION ALL SELECT token, df, cf FROM cvocab) GROUP BY token), "
         "merged AS (SELECT token, df, cf, row_number() OVER (ORDER BY df DESC, token) - 1 AS term_id FROM sums)")


def _conv_docs(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", simple_preprocess(F.col("text")).alias("tokens"))


@query("merge_dictionaries", f"WITH {VOCAB}, {_CONV} SELECT token, df, cf, term_id FROM merged")
def _(spark, d):
    left, right = v.build_vocab(documents(spark, d)), v.build_vocab(_conv_docs(spark, d))
    return v.merge_vocabs(left, right)[0]


@query("merge_dictionaries_id_map",
       f"WITH {VOCAB}, {_CONV} SELECT c.term_id AS old_id, m.term_id AS new_id FROM cvocab c JOIN merged m USING (token)")
def _(spark, d):
    left, right = v.build_vocab(documents(spark, d)), v.build_vocab(_conv_docs(spark, d))
    return v.merge_vocabs(left, right)[1]


@query("vocab_from_bow",
       "WITH c AS (SELECT l_partkey AS term_id, count(*) AS df, CAST(sum(l_quantity) AS BIGINT) AS cf FROM lineitem "
       "GROUP BY l_partkey) "
       "SELECT r.term_id, coalesce(df, 0) AS df, coalesce(cf, 0) AS cf FROM "
       "(SELECT unnest(range(0, (SELECT max(term_id) + 1 FROM c))) AS term_id) r LEFT JOIN c ON c.term_id = r.term_id")
def _(spark, d):
    bow = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term_id"), F.col("l_quantity").alias("tf"))
    return v.vocab_from_bow(bow)


@query("hash_bow")
def _(spark, d):
    return v.hash_bow(documents(spark, d))


@query("hash_vocab_filter",
       f"WITH {VOCAB} SELECT token, df, cf FROM vocab WHERE df >= 3 AND df <= floor(0.4 * (SELECT count(*) FROM documents)) "
       "ORDER BY df DESC, token LIMIT 3000")
def _(spark, d):
    docs = documents(spark, d)
    return v.hash_vocab_filter(v.hash_vocab(docs), docs, 3, 0.4, 3000).select("token", "df", "cf")


@query("word_counts", f"WITH {COUNTS} SELECT token, count FROM cnt WHERE count >= 5")
def _(spark, d):
    return v.word_counts(documents(spark, d), 5)


@query("word_counts_trim_rule",
       f"WITH {COUNTS} SELECT token, count FROM cnt WHERE CASE WHEN token LIKE 'th%' THEN true "
       "WHEN length(token) < 4 THEN false ELSE count >= 5 END")
def _(spark, d):
    def rule(word, count):
        return F.when(word.startswith("th"), "keep").when(F.length(word) < 4, "discard").otherwise("default")

    return v.word_counts(documents(spark, d), 5, rule)


def _p(n, t):
    return f"least(1.0, (sqrt({n} / {t}) + 1) * ({t} / {n}))"


@query("retention_report",
       f"WITH {COUNTS}, k AS (SELECT *, count >= 5 AS keep FROM cnt), "
       "s AS (SELECT count(*) AS raw_unique, CAST(sum(count) AS BIGINT) AS raw_total, count(*) FILTER (keep) AS retain_unique, "
       "CAST(sum(count) FILTER (keep) AS BIGINT) AS retain_total FROM k), "
       f"p AS (SELECT count, {_p('CAST(count AS DOUBLE)', '(0.001 * retain_total)')} AS p FROM k, s WHERE keep), "
       "dn AS (SELECT count(*) FILTER (p < 1) AS downsample_unique, CAST(sum(floor(p * count)) AS BIGINT) AS downsample_total FROM p) "
       "SELECT *, raw_unique - retain_unique AS drop_unique, retain_unique * 500 AS vocab_bytes, "
       "retain_unique * 400 AS vector_bytes FROM s, dn")
def _(spark, d):
    return v.retention_report(documents(spark, d))


@query("subsample_probability",
       f"WITH {COUNTS}, t AS (SELECT 0.001 * sum(count) AS t FROM cnt) SELECT token, count, "
       f"round({_p('CAST(count AS DOUBLE)', 't')}, 6) AS keep_prob FROM cnt, t")
def _(spark, d):
    out = v.subsample_probability(v.word_counts(documents(spark, d), 1))
    return out.select("token", "count", r6(F.col("keep_prob"), "keep_prob"))


@query("subsample_tokens",
       f"WITH {COUNTS}, t AS (SELECT 0.001::DOUBLE * sum(count)::DOUBLE AS t FROM cnt), p AS (SELECT token, {_p('CAST(count AS DOUBLE)', 't')} AS p FROM cnt, t) "
       f"SELECT doc_id, count(*) AS kept FROM occ JOIN p USING (token) WHERE {hash01_sql('doc_id', 'pos', seed=1)} < p GROUP BY doc_id")
def _(spark, d):
    docs = documents(spark, d)
    kept = v.subsample_tokens(docs, v.subsample_probability(v.word_counts(docs, 1)))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("negative_sampling_table",
       f"WITH {COUNTS}, w AS (SELECT token, count, pow(CAST(count AS DOUBLE), 0.75) AS w FROM cnt) "
       "SELECT token, count, round(sum(w) OVER (ORDER BY count DESC, token ROWS UNBOUNDED PRECEDING) / "
       "sum(w) OVER (), 6) AS share FROM w")
def _(spark, d):
    out = v.negative_sampling_table(v.word_counts(documents(spark, d), 1))
    return out.select("token", "count", r6(F.col("share"), "share"))


@query("update_vocab",
       f"WITH {COUNTS}, ctok AS ({tok_sql('conversations', 'conv_id')}), cocc AS (SELECT unnest(tokens) AS token FROM ctok), "
       "ccnt AS (SELECT token, count(*) AS n FROM cocc GROUP BY token), "
       "old AS (SELECT token, count, row_number() OVER (ORDER BY count DESC, token) - 1 AS term_id FROM cnt WHERE count >= 5) "
       "SELECT token, term_id, count + coalesce(n, 0) AS count FROM old LEFT JOIN ccnt USING (token) UNION ALL "
       "SELECT token, row_number() OVER (ORDER BY n DESC, token) - 1 + (SELECT count(*) FROM old) AS term_id, n AS count "
       "FROM ccnt WHERE n >= 5 AND token NOT IN (SELECT token FROM old)")
def _(spark, d):
    old = v.assign_ids(v.word_counts(documents(spark, d), 5), by="count")
    return v.update_vocab(old, _conv_docs(spark, d), 5)


@query("most_frequent", f"WITH {COUNTS} SELECT token, count FROM cnt ORDER BY count DESC, token LIMIT 500")
def _(spark, d):
    return v.most_frequent(v.word_counts(documents(spark, d), 1), 500)


@query("common_vocab",
       f"WITH {TOK}, ctok AS ({tok_sql('conversations', 'conv_id')}) SELECT DISTINCT unnest(tokens) AS word FROM tok "
       "INTERSECT SELECT unnest(tokens) AS word FROM ctok")
def _(spark, d):
    return v.common_vocab([x.select(F.explode("tokens").alias("word"))
                           for x in (documents(spark, d), _conv_docs(spark, d))])


@query("tag_stats",
       f"WITH c AS ({tok_sql('conversations', 'conv_id, turn, role')}), "
       "t AS (SELECT conv_id, len(tokens) AS n, unnest([role, 'turn' || CAST(turn AS VARCHAR)]) AS tag FROM c) "
       "SELECT tag, count(*) AS doc_count, CAST(sum(n) AS BIGINT) AS word_count, min(conv_id) AS first_seen FROM t GROUP BY tag")
def _(spark, d):
    docs = table(spark, d, "conversations").select(
        "conv_id", F.array("role", F.concat(F.lit("turn"), F.col("turn").cast("string"))).alias("tags"),
        simple_preprocess(F.col("text")).alias("tokens"))
    return v.tag_stats(docs, order="conv_id")
