"""Round trips: a table is written in a format and read back with the matching reader."""

from pyspark.sql import functions as F

from vectorloom.operators import vocab as v
from vectorloom.plans.registry import VOCAB, documents, query, spread, table
from vectorloom.plans.search_queries import EMB, embedding
from vectorloom.runtime import cut, scratch_dir
from vectorloom.sources import readers as rd
from vectorloom.sources import writers as wr


def lines_of(df, path, *order):
    """Write (order..., line) as ordered text."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
    return path


# documents as single lines, in order of doc_id (ids are 0..n-1 in the corpus)
FLAT = r"regexp_replace(text, '\s+', ' ', 'g')"


def flat_lines(spark, d, name):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return lines_of(docs.select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("line")), scratch_dir(spark, name), "doc_id")


LINES = (f"ln0 AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line, {FLAT} AS value FROM documents), "
         r"ln_ AS (SELECT line, value, list_filter(string_split_regex(value, '\s+'), lambda w: w <> '') AS t FROM ln0)")


@query("read_lines_sentences",
       f"WITH {LINES}, p AS (SELECT line, unnest(range(0, len(t), 100)) AS s, t FROM ln_) "
       "SELECT line, s // 100 AS piece, array_to_string(t[s + 1:s + 100], ' ') AS tokens FROM p")
def _(spark, d):
    out = rd.read_lines_sentences(spark, flat_lines(spark, d, "lines"), 100)
    return out.select("line", F.col("piece").cast("long").alias("piece"), F.array_join("tokens", " ").alias("tokens"))


@query("read_text8",
       f"WITH {LINES}, w AS (SELECT line, unnest(t) AS w, generate_subscripts(t, 1) AS k FROM ln_), "
       "c AS (SELECT line, k, regexp_replace(lower(w), '&quot;|[}{\\]\\[,)(\\\\.'']', '', 'g') AS token FROM w WHERE NOT (" +
       " OR ".join(f"contains(w, '{m}')" for m in rd.TEXT8_MARKUP) + ")), "
       "n AS (SELECT token, row_number() OVER (ORDER BY line, k) - 1 AS p FROM c) "
       "SELECT CAST(floor(p / 1000) AS BIGINT) AS sentence, string_agg(token, ' ' ORDER BY p) AS tokens FROM n GROUP BY 1")
def _(spark, d):
    return rd.read_text8(spark, flat_lines(spark, d, "text8"), 1000).select("sentence", F.array_join("tokens", " ").alias("tokens"))


@query("read_tagged_tokens",
       f"WITH {LINES}, w AS (SELECT line, list_transform(t, lambda x: lower(replace(x, '/', ' ')) || '/' || CASE WHEN x LIKE '%.' THEN '..' ELSE 'NN1' END) AS w FROM ln_), "
       "p AS (SELECT line, list_filter(list_transform(w, lambda x: string_split(x, '/')), lambda p: len(p) = 2) AS p FROM "
       r"(SELECT line, list_filter(string_split_regex(array_to_string(w, ' '), '\s+'), lambda x: x <> '') AS w FROM w)), "
       r"k AS (SELECT line, list_transform(list_filter(p, lambda p: regexp_full_match(p[2][1:2], '\p{L}+')), lambda p: lower(p[1]) || '/' || p[2][1:2]) AS k FROM p) "
       "SELECT line, array_to_string(k, ' ') AS tokens FROM k WHERE len(k) > 0")
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    tag = lambda x: F.when(x.endswith("."), "..").otherwise("NN1")
    tagged = F.transform(F.filter(F.split(F.regexp_replace("text", r"\s+", " "), r"\s+"), lambda x: x != ""),
                         lambda x: F.concat(F.lower(F.translate(x, "/", " ")), F.lit("/"), tag(x)))
    path = lines_of(docs.select("doc_id", F.array_join(tagged, " ").alias("line")), scratch_dir(spark, "tagged"), "doc_id")
    return rd.read_tagged_tokens(spark, path).select("line", F.array_join("tokens", " ").alias("tokens"))


@query("read_tagged_lines", f"WITH {LINES} SELECT line AS tag, array_to_string(t, ' ') AS words FROM ln_")
def _(spark, d):
    return rd.read_tagged_lines(spark, flat_lines(spark, d, "taglines")).select(
        F.get("tags", F.lit(0)).alias("tag"), F.array_join("words", " ").alias("words"))


@query("read_text_corpus",
       r"WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}_]+') AS t FROM documents) "
       "SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS token FROM t) GROUP BY ALL")
def _(spark, d):
    return v.token_runs(rd.read_text_corpus(spark, flat_lines(spark, d, "textcorpus")))


@query("read_csv_corpus",
       "WITH o AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) - 1 AS doc_id, [l_quantity, l_discount, l_tax] AS w FROM lineitem) "
       "SELECT doc_id, generate_subscripts(w, 1) - 1 AS term_id, unnest(w) AS weight FROM o")
def _(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"]
    lines = table(spark, d, "lineitem").select(*order, F.concat_ws(
        ",", "l_returnflag", *[F.col(c).cast("string") for c in order[3:]]).alias("line"))
    path = lines_of(lines, scratch_dir(spark, "csv"), *order)
    return rd.read_csv_corpus(spark, path, labels=True)


def _bow(spark, d):
    docs = documents(spark, d)
    vocab = cut(v.build_vocab(docs))
    rows = v.doc2bow(docs, vocab).select("doc_id", "term_id", F.col("tf").cast("double").alias("weight"))
    return rows, vocab, table(spark, d, "documents").select("doc_id")


ROWS = f"WITH {VOCAB}, r AS (SELECT doc_id, term_id, CAST(tf AS DOUBLE) AS weight, token FROM bow JOIN vocab USING (token))"


@query("matrix_market_round_trip",
       f"{ROWS} SELECT d.doc_id, term_id, weight FROM documents d LEFT JOIN r USING (doc_id)")
def _(spark, d):
    rows, _, docs = _bow(spark, d)
    path = scratch_dir(spark, "mm")
    wr.write_matrix_market(rows, path, num_docs=docs.agg(F.max("doc_id")).first()[0] + 1)
    return rd.read_matrix_market(spark, path, with_empty=True)


@query("svmlight_round_trip",
       f"{ROWS} SELECT dense_rank() OVER (ORDER BY doc_id) - 1 AS doc_id, lang AS target, term_id, weight FROM r JOIN documents USING (doc_id)")
def _(spark, d):
    rows, _, docs = _bow(spark, d)
    path = scratch_dir(spark, "svmlight")
    targets = table(spark, d, "documents").select("doc_id", F.col("lang").alias("target"))
    wr.write_svmlight(rows, path, targets.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"))
    return rd.read_svmlight(spark, path)


@query("blei_round_trip", f"{ROWS} SELECT doc_id, term_id, weight, token FROM r")
def _(spark, d):
    rows, vocab, docs = _bow(spark, d)
    path = scratch_dir(spark, "blei")
    wr.write_blei(rows, path, docs, vocab)
    return rd.read_blei(spark, path, path + ".vocab")


@query("uci_round_trip", f"{ROWS} SELECT doc_id, term_id, weight FROM r")
def _(spark, d):
    rows, _, _ = _bow(spark, d)
    path = scratch_dir(spark, "uci")
    wr.write_uci(rows, path)
    return rd.read_uci(spark, path)


_SORTED = "s AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS term_id FROM vocab)"


@query("low_round_trip", f"WITH {VOCAB}, {_SORTED} SELECT doc_id, s.term_id, token, CAST(tf AS DOUBLE) AS weight FROM bow JOIN s USING (token)")
def _(spark, d):
    rows, vocab, docs = _bow(spark, d)
    path = scratch_dir(spark, "low")
    wr.write_low(rows, path, vocab, docs)
    return rd.read_low(spark, path)


@query("mallet_round_trip",
       f"WITH {VOCAB}, {_SORTED} SELECT doc_id, lang, s.term_id, CAST(tf AS DOUBLE) AS weight FROM bow JOIN s USING (token) JOIN documents USING (doc_id)")
def _(spark, d):
    rows, vocab, _ = _bow(spark, d)
    path = scratch_dir(spark, "mallet")
    meta = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), "lang")
    wr.write_mallet(rows, path, vocab, meta)
    back, names = rd.read_mallet(spark, path)
    return back.join(names, "doc_id").select("doc_id", "lang", "term_id", "weight")


@query("vw_lines",
       f"{ROWS} SELECT '| ' || string_agg(term_id || ':' || CAST(weight AS BIGINT), ' ' ORDER BY term_id) AS line FROM r GROUP BY doc_id")
def _(spark, d):
    rows, _, _ = _bow(spark, d)
    path = scratch_dir(spark, "vw")
    wr.write_vw(rows, path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("vocab_text_round_trip", f"WITH {VOCAB} SELECT term_id, token, df FROM vocab")
def _(spark, d):
    path = scratch_dir(spark, "vocab")
    wr.write_vocab_text(v.build_vocab(documents(spark, d)), path, by_df=True)
    return wr.read_vocab_text(spark, path)


_VEC = (f"WITH {EMB} SELECT word, round(list_sum(list_transform(v, lambda x: CAST(CAST(round(x, 6) AS FLOAT) AS DOUBLE))), 6) AS total, "
        "row_number() OVER (ORDER BY label DESC, word) - 1 AS idx FROM emb")


def _counted(spark, d):
    e = embedding(spark, d)
    return e.select("word", "vector"), e.select("word", F.col("label").alias("count"))


def _vector_sum(e):
    return e.select("word", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), "idx")


@query("word2vec_text_round_trip", _VEC)
def _(spark, d):
    path = scratch_dir(spark, "w2v")
    wr.write_word2vec_text(*(_counted(spark, d)[0], path), counts=_counted(spark, d)[1])
    return _vector_sum(rd.read_word2vec_text(spark, path))


@query("glove_text_round_trip", _VEC)
def _(spark, d):
    source, target = scratch_dir(spark, "glove"), scratch_dir(spark, "glove-w2v")
    wr.write_word2vec_text(_counted(spark, d)[0], source, counts=_counted(spark, d)[1], header=False)
    wr.glove_to_word2vec(spark, source, target)
    both = rd.read_glove_text(spark, source).join(rd.read_word2vec_text(spark, target).select("word"), "word", "left_semi")
    return _vector_sum(both)


@query("load_embedding",
       f"WITH {EMB} SELECT upper(word) AS word, round(list_sum(u), 6) AS total FROM un")
def _(spark, d):
    path = scratch_dir(spark, "load")
    e = embedding(spark, d).withColumn("word", F.concat(F.lit("-"), F.col("word")))
    wr.write_word2vec_text(e.select("word", "vector"), path, decimals=12)
    out = rd.load_embedding(spark, path, clean=True)
    return out.select(F.upper("word").alias("word"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("read_analogy_questions",
       "SELECT (CASE WHEN label < 5 THEN 'gram' ELSE 'topic' END) || CAST(label AS VARCHAR) AS category, CASE WHEN label < 5 THEN 'syntactic' ELSE 'semantic' END AS family, "
       "'w' || vec_id AS a, 'x' || vec_id AS b, 'y' || vec_id AS c, 'z' || vec_id AS answer FROM embeddings")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    section = F.concat(F.when(F.col("label") < 5, "gram").otherwise("topic"), F.col("label").cast("string"))
    heads = e.select("label").distinct().select("label", F.lit(-1).cast("long").alias("vec_id"), F.concat(F.lit(": "), section).alias("line"))
    asked = e.select("label", "vec_id", F.concat_ws(" ", *[F.concat(F.lit(p), F.col("vec_id").cast("string")) for p in "wxyz"]).alias("line"))
    whole = heads.unionByName(asked).repartitionByRange("label").sortWithinPartitions("label", "vec_id")  # a section lives in one file
    path = scratch_dir(spark, "questions")
    whole.select("line").write.text(path)
    return rd.read_analogy_questions(spark, path).drop("query_id")


@query("read_outlier_groups",
       "WITH e AS (SELECT label || '_' || vec_id // 200 AS g, 'w' || vec_id AS word, vec_id % 9 = 8 AS o FROM embeddings), "
       "n AS (SELECT *, count(*) FILTER (NOT o) OVER (PARTITION BY g) AS c, row_number() OVER (PARTITION BY g, o ORDER BY word) - 1 AS r FROM e) "
       "SELECT g, word, o AS is_outlier, CASE WHEN o THEN greatest(c, 1) + 1 + r ELSE r END AS pos FROM n")
def _(spark, d):
    e = table(spark, d, "embeddings").select(
        F.concat_ws("_", F.col("label").cast("string"), F.floor(F.col("vec_id") / 200).cast("string")).alias("g"),
        F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), (F.col("vec_id") % 9 == 8).alias("o"))
    listed = lambda o: F.array_join(F.sort_array(F.collect_list(F.when(F.col("o") == o, F.col("word")))), "\n")  # noqa: E731  at most 200
    path = scratch_dir(spark, "outliers")
    e.groupBy("g").agg(F.concat(listed(False), F.lit("\n\n"), listed(True)).alias("value")).write.partitionBy("g").text(path)
    files = rd.read_outlier_groups(spark, path + "/*")
    return files.join(e.select("word", "g"), "word").select("g", "word", "is_outlier", F.col("pos").cast("long").alias("pos"))


@query("read_labelled_words",
       "SELECT c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) AS word, arg_min(CASE WHEN c_custkey % 4 = 0 THEN 'A B' ELSE 'L' || CAST(c_custkey % 4 AS VARCHAR) END, c_custkey) AS label "
       "FROM customer GROUP BY 1 HAVING label NOT LIKE '% %'")
def _(spark, d):
    c = table(spark, d, "customer")
    label = F.when(F.col("c_custkey") % 4 == 0, "A B").otherwise(F.concat(F.lit("L"), (F.col("c_custkey") % 4).cast("string")))
    lines = c.select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit("_"), F.col("c_nationkey").cast("string"), F.lit("\t"), label).alias("line"))
    return rd.read_labelled_words(spark, lines_of(lines, scratch_dir(spark, "labelled"), "c_custkey"))


@query("read_labelled_dirs",
       "SELECT 'quality=' || CAST(quality AS VARCHAR) AS label, count(*) AS n, CAST(sum(length(replace(regexp_replace(lower(array_to_string(list_transform("
       "string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: trim(x)), ' ')), '<br />|[,.\"''!?()]', '', 'g'), '/', ' '))) AS BIGINT) AS chars "
       "FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def _(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("text", "quality", "doc_id")
    path = scratch_dir(spark, "dirs")
    rows.write.partitionBy("quality", "doc_id").text(path)  # one file per document
    out = rd.read_labelled_dirs(spark, path, depth=2)
    return out.select(F.col("label"), F.length("text").cast("long").alias("chars")).groupBy("label").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("read_wiki_xml",
       "SELECT CAST(page_id AS VARCHAR) AS page_id, url AS title, page_id % 3 = 0 AS kept FROM pages")
def _(spark, d):
    pages = table(spark, d, "pages").select(
        F.col("url").alias("title"), (F.col("page_id") % 3).cast("string").alias("ns"), F.col("page_id").cast("string").alias("id"),
        F.struct(F.col("html").alias("text")).alias("revision"))
    path = scratch_dir(spark, "wiki")
    pages.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
    return rd.read_wiki_xml(spark, path).select("page_id", "title", (F.length("text") > 0).alias("kept"))


@query("coo_tensor_round_trip",
       "WITH u AS (SELECT DISTINCT l_orderkey, (l_linenumber - 1) // 11 AS c, l_suppkey AS s FROM lineitem) "
       "SELECT x.s AS i, y.s AS j, CAST(count(*) AS DOUBLE) AS value FROM u x JOIN u y ON x.l_orderkey = y.l_orderkey AND x.c = y.c AND x.s < y.s GROUP BY ALL")
def _(spark, d):
    from vectorloom.operators import cooc

    lines = table(spark, d, "lineitem").select("l_orderkey", F.floor((F.col("l_linenumber") - 1) / 11).alias("c"), "l_suppkey")
    baskets = lines.groupBy("l_orderkey", "c").agg(F.collect_set("l_suppkey").alias("ids"))
    path = scratch_dir(spark, "coo")
    wr.write_coo_tensor(cooc.ngram_cooccurrence(baskets, 2).withColumn("value", F.col("count").cast("double")), path)
    return spark.read.parquet(path).select("i", "j", "value")


@query("save_run",
       "SELECT 'demo' AS method, CAST(0 AS BIGINT) AS num_docs, CAST(1 AS BIGINT) AS min_count, CAST(64 AS BIGINT) AS dim, count(*) AS vocab_size, "
       "CAST(0 AS DOUBLE) AS elapsed FROM embeddings")
def _(spark, d):
    run = wr.save_run(scratch_dir(spark, "run"), "demo", 0, 1, 64, embedding(spark, d))
    return spark.read.json(f"{run}/metadata")

