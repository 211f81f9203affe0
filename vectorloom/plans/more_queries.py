"""Index maintenance, lookups and corpus cycling."""

from pyspark.sql import functions as F

from vectorloom.operators import factor as fa
from vectorloom.operators import search as s
from vectorloom.operators import vocab as v
from vectorloom.operators import weight as w
from vectorloom.plans.cooc_queries import PHRASES
from vectorloom.plans.registry import BOW, documents, query, r6, table
from vectorloom.plans.search_queries import EMB, embedding, word_of
from vectorloom.runtime import scratch_dir


@query("add_documents",
       f"WITH {BOW} SELECT doc_id, count(*) AS terms, round(sum(tf) / sqrt(sum(tf * tf * 1.0)), 6) AS total FROM bow GROUP BY doc_id")
def _(spark, d):
    path = scratch_dir(spark, "index")
    rows = v.token_runs(documents(spark, d)).select("doc_id", "token", F.col("tf").cast("double").alias("weight"))
    for part in w.hashed_split(rows, ["doc_id"], 0.5):
        s.add_documents(path, s.index_documents(part, key="token"), buckets=8)
    return spark.read.parquet(path).select("doc_id", F.size("ids").cast("long").alias("terms"),
                                           r6(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), "total"))


@query("corpus_repeat_to",
       "SELECT k * n + doc_id AS idx FROM documents, (SELECT count(*) AS n FROM documents), (SELECT unnest(range(0, 3)) AS k) "
       "WHERE k * n + doc_id < 2 * n + 17")
def _(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("idx"))
    return w.corpus_repeat_to(docs, 2 * docs.count() + 17)


@query("get_vectors",
       f"WITH {EMB} SELECT 'w' || lpad(CAST(e.idx + 9 AS VARCHAR), 8, '0') AS word, round(coalesce(list_sum(o.v), 64.0), 6) AS total "
       "FROM emb e LEFT JOIN emb o ON o.idx = e.idx + 9")
def _(spark, d):
    asked = table(spark, d, "embeddings").select(word_of(F.col("vec_id") + 9).alias("word"))
    out = s.get_vectors(asked, embedding(spark, d), [1.0] * 64)
    return out.select("word", r6(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), "total"))


@query("min_count", f"WITH {PHRASES} SELECT token, count(*) AS count FROM occ GROUP BY token HAVING count(*) >= 50")
def _(spark, d):
    return v.min_count(v.word_counts(documents(spark, d), 1), 50)


@query("phrase_lookup")
def _(spark, d):
    names = table(spark, d, "part").select("p_partkey", F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("phrase"))
    single = names.select(F.explode(F.split("phrase", "_")).alias("word"))
    known = fa.random_embedding(single.unionByName(names.select(F.col("phrase").alias("word"))).distinct(), 4)
    return s.phrase_lookup(names.withColumnRenamed("p_partkey", "phrase_id"), known).select(
        "phrase_id", F.posexplode("vector").alias("dim", "value"))
