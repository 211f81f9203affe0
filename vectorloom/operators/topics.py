"""Topic models: inspection, choosing the number of topics, topics over time; the model itself is in `lda`.

`topics(topic, term_id|token, prob)` is the exchange form. Vocabularies are filtered by document frequency and not cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.operators.lda import (  # noqa: F401 - one place to import topic models from
    OnlineLda,
    _fit_documents,
    digamma,
    lda_fit,
    lda_perplexity,
    lda_transform,
    topic_terms_table,
)
from vectorloom.operators.vocab import filter_extremes, token_counts, token_runs
from vectorloom.operators.weight import hashed_split
from vectorloom.runtime import broadcast_if_small, cut


# ---------------------------------------------------------------- documents as terms and counts
def vectorize(docs: DataFrame, no_below: int = 5, no_above: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((doc_id, ids, counts), vocabulary): documents over all tokens within the bounds of document frequency."""
    vocab = cut(filter_extremes(token_counts(docs), docs, no_below, no_above, None))
    return cut(chunk_documents(token_runs(docs), vocab)), vocab


# ---------------------------------------------------------------- words
def word_topics(doc_topics: DataFrame, runs: DataFrame, topics: DataFrame, doc_id: str = "doc_id", key: str = "token") -> DataFrame:
    """(doc_id, token, topic, phi): topic shares of every word of a document, phi ~ theta_k * beta_kw."""
    shares = lambda df, by, name: df.groupBy(by).agg(F.collect_list(F.struct("topic", F.col("prob").cast("double").alias("p"))).alias(name))
    # a word travels once, to its document; its topics are formed in the row. Rows of one (document, word) share their total.
    rows = runs.select(doc_id, key).repartition(doc_id).withColumn("_n", F.count("*").over(W.partitionBy(doc_id, key)))
    rows = rows.join(broadcast_if_small(shares(topics, key, "_b")), key).join(shares(doc_topics, doc_id, "_t"), doc_id)
    cells = F.flatten(F.transform("_b", lambda b: F.transform(F.filter("_t", lambda t: t["topic"] == b["topic"]), lambda t: F.struct(
        b["topic"].alias("topic"), (t["p"] * b["p"]).alias("phi")))))
    total = F.aggregate("_c", F.lit(0.0), lambda x, c: x + c["phi"]) * F.col("_n")
    rows = rows.withColumn("_c", cells).withColumn("_total", total)
    return rows.select(doc_id, key, F.explode("_c").alias("_c"), "_total").select(
        doc_id, key, "_c.topic", (F.col("_c.phi") / F.col("_total")).alias("phi"))


# ---------------------------------------------------------------- inspection
def show_topics(topics: DataFrame, topn: int = 10, word: str = "token", by_abs: bool = False) -> DataFrame:
    """(topic, rank, word, prob) of the strongest words; the limit acts before the shuffle."""
    strength = F.abs("prob") if by_abs else F.col("prob")
    w = W.partitionBy("topic").orderBy(strength.desc(), word)
    return topics.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= topn).select("topic", "rank", word, "prob")


def format_topics(topics: DataFrame, topn: int = 10, word: str = "token") -> DataFrame:
    """(topic, text) as `0.123*"word" + ...`."""
    best = show_topics(topics, topn, word).withColumn("_t", F.format_string('%.3f*"%s"', F.col("prob"), F.col(word)))
    return best.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "_t"))).alias("_l")).select(  # topn entries
        "topic", F.array_join(F.col("_l._t"), " + ").alias("text"))


def term_topics(topics: DataFrame, minimum_probability: float = 0.01, word: str = "token") -> DataFrame:
    """(word, topic, prob) above the minimum."""
    return topics.filter(F.col("prob") >= minimum_probability).select(word, "topic", "prob")


def chunk_documents(runs: DataFrame, vocab: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids, counts) for `OnlineLda`."""
    pairs = runs.join(vocab.select("token", "term_id"), "token").groupBy(doc_id).agg(
        F.sort_array(F.collect_list(F.struct("term_id", F.col("tf").cast("double").alias("c")))).alias("_p"))
    return pairs.select(doc_id, F.col("_p.term_id").alias("ids"), F.col("_p.c").alias("counts"))


# ---------------------------------------------------------------- number of topics, topics over time
def choose_topic_count(docs: DataFrame, chunks: DataFrame, vocab: DataFrame, candidates: list[int],
                       measure: str = "u_mass", seed: int = 0, topn: int = 10, at_once: int = 4, **options) -> DataFrame:
    """(k, perplexity, coherence) per candidate: fits scored by held-out bound and topic coherence.

    Candidates are independent, so `at_once` of them submit their jobs side by side: an update is short, and alone leaves cores idle.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from vectorloom.operators.coherence import coherence

    spark = chunks.sparkSession
    train, test = (cut(part) for part in hashed_split(cut(chunks), ["doc_id"], 0.9, seed))
    size = vocab.count()

    def fit(k: int) -> tuple[int, float, float]:
        model = lda_fit(train, size, k, seed=seed, **options)
        best = show_topics(topic_terms_table(model, vocab), topn).select("topic", (F.col("rank") - 1).alias("rank"), "token")
        return k, float(lda_perplexity(model, test)[1]), float(coherence(docs, cut(best), measure).first()[0])

    with ThreadPoolExecutor(at_once) as pool:
        out = list(pool.map(inheritable_thread_target(spark)(fit), candidates))
    return spark.createDataFrame(out, "k int, perplexity double, coherence double")


def topic_evolution(word_shares: DataFrame, slices: DataFrame, chain: float = 0.5, doc_id: str = "doc_id",
                    key: str = "token", count: str = "tf") -> DataFrame:
    """(slice, topic, token, prob): topics of one model, word mass re-estimated per time slice.

    `word_shares(doc_id, token, tf, topic, phi)`; mass = sum of count * phi, smoothed along the chain of slices by
    mixing in `chain` of the neighbouring slices, then scaled to one per slice and topic.
    """
    mass = word_shares.join(slices, doc_id).groupBy("slice", "topic", key).agg(F.sum(F.col(count) * F.col("phi")).alias("m"))
    side = F.explode(F.array(*[F.struct((F.col("slice") + o).alias("slice"), (F.col("m") * w).alias("m"))
                               for o, w in ((0, 1.0), (-1, chain), (1, chain))]))
    spread = mass.select("topic", key, side.alias("_s")).groupBy(F.col("_s.slice").alias("slice"), "topic", key).agg(
        F.sum("_s.m").alias("m"))
    known = slices.select("slice").distinct()
    spread = spread.join(known, "slice", "left_semi")
    total = spread.groupBy("slice", "topic").agg(F.sum("m").alias("_t"))
    return spread.join(total, ["slice", "topic"]).select("slice", "topic", key, (F.col("m") / F.col("_t")).alias("prob"))


def evolution_tables(runs: DataFrame, doc_id: str = "doc_id", key: str = "token") -> tuple[DataFrame, DataFrame]:
    """Document lengths and term frequencies, as topic displays want them."""
    return (runs.groupBy(doc_id).agg(F.sum("tf").alias("length")), runs.groupBy(key).agg(F.sum("tf").alias("frequency")))
