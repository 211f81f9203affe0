"""Text function queries (whole texts of documents and pages)."""

from pyspark.sql import functions as F

from vectorloom.functions import text as tx
from vectorloom.plans.registry import query, spread, table, tok_sql

STOPWORDS = ("the and of to in is it for on was with as by at an be this that are from or had not but "
             "der die das und ist ein eine nicht le la les un une de des et est que el los las en y por").split()
STOP = "('" + "','".join(STOPWORDS) + "')"
WS = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
PUNCT = r"[!-/:-@\[-`{-~]+"


def words_sql(c):
    return f"list_filter(string_split_regex({c}, '{WS}'), lambda w: w <> '')"


def _docs(spark, d):
    return spread(table(spark, d, "documents"), "doc_id")


@query("strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS cleaned FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("cleaned"))


@query("strip_punctuation", f"SELECT doc_id, regexp_replace(text, '{PUNCT}', ' ', 'g') AS cleaned FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", tx.strip_punctuation(F.col("text")).alias("cleaned"))


@query("strip_numeric", "SELECT doc_id, regexp_replace(text, '[0-9]+', '', 'g') AS cleaned FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", tx.strip_numeric(F.col("text")).alias("cleaned"))


@query("strip_non_alphanum",
       r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}_]', ' ', 'g') AS cleaned FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", tx.strip_non_alphanum(F.col("text")).alias("cleaned"))


@query("strip_multiple_whitespaces",
       f"SELECT page_id, regexp_replace(html, '{WS}', ' ', 'g') AS cleaned FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.strip_multiple_whitespaces(F.col("html")).alias("cleaned"))


@query("split_alphanum",
       r"SELECT doc_id, regexp_replace(regexp_replace(text, '([a-z]+)([0-9]+)', '\1 \2', 'g'), "
       r"'([0-9]+)([a-z]+)', '\1 \2', 'g') AS cleaned FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", tx.split_alphanum(F.col("text")).alias("cleaned"))


@query("strip_short",
       f"SELECT doc_id, array_to_string(list_filter({words_sql('text')}, lambda w: length(w) >= 3), ' ') AS cleaned "
       "FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", tx.strip_short(F.col("text")).alias("cleaned"))


@query("remove_stopwords",
       f"SELECT doc_id, array_to_string(list_filter({words_sql('lower(text)')}, lambda w: w NOT IN {STOP}), ' ') "
       "AS cleaned FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", tx.remove_stopwords(F.lower("text"), STOPWORDS).alias("cleaned"))


@query("tokenize",
       r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}_]+')) AS token FROM documents) "
       "SELECT token, count(*) AS cf, count(DISTINCT doc_id) AS df FROM t GROUP BY token")
def _(spark, d):
    from vectorloom.operators.vocab import token_counts

    return token_counts(_docs(spark, d).select(tx.tokenize(F.col("text"), lower=True).alias("tokens")))


@query("simple_preprocess",
       f"WITH t AS ({tok_sql('pages', 'page_id', 'html')}) SELECT page_id, array_to_string(tokens, ' ') AS tokens FROM t")
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", F.array_join(tx.simple_preprocess(F.col("html")), " ").alias("tokens"))


@query("deaccent", "SELECT doc_id, strip_accents(text) AS cleaned FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", tx.deaccent(F.col("text")).alias("cleaned"))


_STEPS = "lower(text)"
for _pattern, _to in (("<[^>]+>", ""), (PUNCT, " "), (WS, " "), ("[0-9]+", "")):
    _STEPS = f"regexp_replace({_STEPS}, '{_pattern}', '{_to}', 'g')"


@query("preprocess_string_unstemmed",
       f"SELECT doc_id, array_to_string(list_filter({words_sql(_STEPS)}, "
       f"lambda w: w NOT IN {STOP} AND length(w) >= 3), ' ') AS tokens FROM documents")
def _(spark, d):
    return _docs(spark, d).select(
        "doc_id", F.array_join(tx.preprocess_string(F.col("text"), tx.default_filters(STOPWORDS, stemming=False)), " ").alias("tokens"))


@query("preprocess_string")
def _(spark, d):
    return _docs(spark, d).select(
        "doc_id", F.array_join(tx.preprocess_string(F.col("text")), " ").alias("tokens"))


@query("stem_vocabulary")
def _(spark, d):
    from vectorloom.operators.vocab import token_counts
    from vectorloom.plans.registry import documents

    return tx.stem_vocabulary(token_counts(documents(spark, d))).groupBy("stem").agg(
        F.count("*").alias("forms"), F.sum("cf").alias("cf"))


@query("decode_html_entities")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", tx.decode_html_entities(F.col("html")).alias("decoded"))


@query("strip_wiki_markup")
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", tx.strip_wiki_markup(tx.decode_html_entities(F.col("html"))).alias("cleaned"))


_NS = "|".join(tx.IGNORED_NAMESPACES)


@query("clean_wiki_articles",
       f"WITH t AS ({tok_sql('documents', 'doc_id, source AS title')}) SELECT doc_id, title, len(tokens) AS n_tokens "
       f"FROM t WHERE len(tokens) >= 50 AND NOT regexp_matches(title, '^({_NS}):')")
def _(spark, d):
    arts = tx.clean_wiki_articles(_docs(spark, d).select("doc_id", F.col("source").alias("title"), "text"))
    return arts.select("doc_id", "title", F.size("tokens").cast("long").alias("n_tokens"))


_PROTECT = (r"regexp_replace(regexp_replace(text, '([A-Z][a-z]{1,2}\.)\s([\p{L}\p{N}_])', '\1@\2', 'g'), "
            r"'(\.[a-zA-Z]\.)\s([\p{L}\p{N}_])', '\1@\2', 'g')")
SENT_SQL = (
    f"sent0 AS (SELECT doc_id, regexp_extract_all({_PROTECT}, "
    r"'(\S[^\n]+?[.!?])(\s+|$)|(\S[^\n]+?)(\n|$)') AS s FROM documents), "
    "sent AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, regexp_replace(regexp_replace(regexp_replace(unnest(s), "
    r"'([A-Z][a-z]{1,2}\.)@([\p{L}\p{N}_])', '\1 \2', 'g'), '(\.[a-zA-Z]\.)@([\p{L}\p{N}_])', '\1 \2', 'g'), "
    r"'\s+$', '') AS sentence FROM sent0)")


@query("split_sentences", f"WITH {SENT_SQL} SELECT doc_id, pos, sentence FROM sent")
def _(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(tx.split_sentences(F.col("text"))).alias("pos", "sentence")).select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.regexp_replace("sentence", r"\s+$", "").alias("sentence"))


SENTENCE_STEPS = "lower(sentence)"
for _pattern, _to in (("<[^>]+>", ""), (PUNCT, " "), (WS, " "), ("[0-9]+", "")):
    SENTENCE_STEPS = f"regexp_replace({SENTENCE_STEPS}, '{_pattern}', '{_to}', 'g')"


@query("clean_by_sentence",
       f"WITH {SENT_SQL}, c AS (SELECT doc_id, pos, array_to_string(list_filter({words_sql(SENTENCE_STEPS)}, "
       f"lambda w: w NOT IN {STOP} AND length(w) >= 3), ' ') AS tokens FROM sent) SELECT * FROM c WHERE tokens <> ''")
def _(spark, d):
    out = tx.clean_by_sentence(_docs(spark, d), "doc_id", filters=tx.default_filters(STOPWORDS, stemming=False))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("tokens", " ").alias("tokens"))


@query("clean_by_word",
       r"WITH w0 AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(regexp_replace(text, "
       r"'([a-zA-Z])\.([a-zA-Z])\.', '\1\2', 'g'))), '[\p{L}\p{Nl}\p{No}_]+') AS w FROM documents), "
       "w1 AS (SELECT doc_id, unnest(w) AS word FROM w0), "
       f"w2 AS (SELECT doc_id, word, replace(word, '_', ' ') AS token FROM w1), "
       f"w3 AS (SELECT doc_id, word, array_to_string(list_filter({words_sql('token')}, "
       f"lambda w: w NOT IN {STOP} AND length(w) >= 3), '') AS token FROM w2) "
       "SELECT token, count(*) AS n, count(DISTINCT word) AS forms FROM w3 WHERE token <> '' GROUP BY token")
def _(spark, d):
    out = tx.clean_by_word(_docs(spark, d), "doc_id", filters=tx.default_filters(STOPWORDS, stemming=False))
    return out.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("word").alias("forms"))


@query("standardize_words",
       r"WITH o AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}_]+')) AS word FROM documents), "
       "c AS (SELECT word, min(doc_id) AS idx, count(*) AS n FROM o GROUP BY word), "
       r"s AS (SELECT *, lower(regexp_replace(word, '[^\p{L}\p{N}]', '', 'g')) AS w FROM c) "
       "SELECT w AS word, idx, n FROM s WHERE w <> '' "
       "QUALIFY row_number() OVER (PARTITION BY w ORDER BY (CASE WHEN w = word THEN 0 ELSE 1 END), idx, n) = 1")
def _(spark, d):
    occ = _docs(spark, d).select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("word"))
    counts = occ.groupBy("word").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    ranked = counts.withColumn("idx", F.struct("first", "n"))
    out = tx.standardize_words(ranked, lower=True, clean=True)
    return out.select("word", F.col("first").alias("idx"), "n")


@query("tagged_lemma_filter",
       "WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents), "
       "g AS (SELECT token, CASE WHEN token LIKE '%tion' THEN 'NN' WHEN token LIKE '%en' THEN 'VB' "
       "WHEN token LIKE '%ly' THEN 'RB' ELSE 'XX' END AS tag FROM t) "
       "SELECT tag, token, count(*) AS n FROM g WHERE tag IN ('NN','VB','JJ','RB') GROUP BY ALL")
def _(spark, d):
    t = _docs(spark, d).select(F.explode(F.split("text", " ")).alias("token"))
    tag = (F.when(F.col("token").endswith("tion"), "NN").when(F.col("token").endswith("en"), "VB")
           .when(F.col("token").endswith("ly"), "RB").otherwise("XX"))
    return tx.tagged_lemma_filter(t.withColumn("tag", tag)).groupBy("tag", "token").agg(F.count("*").alias("n"))
