"""Structured Streaming twins of the counting and model-update operators.

Counts: every micro-batch writes its own partial counts to `<state>/counts/batch=<id>`, overwriting on replay, and the
current value is the sum over batches, so a repeated batch changes nothing. Every MERGE_EVERY batches the sum so far is
written to `<state>/merged/upto=<id>`; readers take the last of these and the batches after it, so reads do not grow
with the age of a stream. Models: batch n reads the state
written by batch n-1 and writes its own. Counts commute, so late data simply adds; only event-time slices use a
watermark.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectorloom.operators import cooc, factor, phrases, spectral, topics, vocab
from vectorloom.operators.search import index_documents, sparse_similarity
from vectorloom.operators.vocab import token_runs
from vectorloom.runtime import cut


#: Batches after which partial counts are summed up into one table.
MERGE_EVERY = 16


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _run(stream: DataFrame, state: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    query = (stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{state}/_progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def _partial_counts(stream: DataFrame, state: str, count: Callable[[DataFrame], DataFrame], keys: list[str], values: list[str]) -> StreamingQuery:
    def each(batch: DataFrame, batch_id: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{state}/counts/batch={batch_id}")
        if batch_id % MERGE_EVERY == MERGE_EVERY - 1:
            _summed(batch.sparkSession, state, keys, values, batch_id).write.mode("overwrite").parquet(f"{state}/merged/upto={batch_id}")

    return _run(stream, state, each)


def _summed(spark: SparkSession, state: str, keys: list[str], values: list[str], upto: int | None = None) -> DataFrame:
    """Sums over all batches (with `upto`: those up to that one, from what was merged before it)."""
    rows = spark.read.parquet(f"{state}/counts")
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    try:
        merged = spark.read.parquet(f"{state}/merged")
    except AnalysisException:  # nothing merged yet
        merged = None
    last = None if merged is None else merged.filter(F.col("upto") < (upto if upto is not None else 1 << 62)).agg(F.max("upto")).first()[0]
    if last is not None:
        rows = rows.filter(F.col("batch") > last).select(*keys, *values).unionByName(merged.filter(F.col("upto") == last).select(*keys, *values))
    return rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


# ---------------------------------------------------------------- counts
def stream_vocab(stream: DataFrame, state: str) -> StreamingQuery:
    """df and cf per token of a stream of (doc_id, tokens)."""
    return _partial_counts(stream, state, vocab.token_counts, ["token"], ["df", "cf"])


def read_vocab(spark: SparkSession, state: str) -> DataFrame:
    return _summed(spark, state, ["token"], ["df", "cf"])


def stream_phrases(stream: DataFrame, state: str) -> StreamingQuery:
    return _partial_counts(stream, state, phrases.phrase_counts, ["key"], ["count"])


def read_phrases(spark: SparkSession, state: str) -> DataFrame:
    return _summed(spark, state, ["key"], ["count"])


def stream_cooccurrence(stream: DataFrame, state: str, words: DataFrame, n: int = 2, window: int = 5) -> StreamingQuery:
    """n-gram and unigram counts over chunks, unigrams stored as tuples (i, -1[, -1]); PMI is computed when read."""
    modes = cooc.MODES[:n]

    def count(batch: DataFrame) -> DataFrame:
        chunks = cut(cooc.chunk_sentences(cooc.to_ids(batch, words), window))
        single = cooc.chunk_unigrams(chunks, n).select(
            F.col("term_id").alias("i"), *[F.lit(-1).cast("long").alias(m) for m in modes[1:]], "count")
        return cooc.ngram_cooccurrence(chunks, n).unionByName(single)

    return _partial_counts(stream, state, count, modes, ["count"])


def read_ppmi(spark: SparkSession, state: str, n: int = 2, min_count: int = 1, **options) -> DataFrame:
    modes = cooc.MODES[:n]
    counts = _summed(spark, state, modes, ["count"])
    tuples = counts.filter(F.col("j") >= 0)
    single = counts.filter(F.col("j") < 0).select(F.col("i").alias("term_id"), "count")
    return cooc.ppmi_tensor(cooc.prune_ngrams(tuples, min_count), single, **options)


# ---------------------------------------------------------------- similarity index
def stream_similarity_index(stream: DataFrame, state: str, doc_id: str = "doc_id") -> StreamingQuery:
    """Append documents as unit-length bags of words; the index can be queried between batches."""
    def each(batch: DataFrame, batch_id: int) -> None:
        rows = token_runs(batch, doc_id).select(doc_id, "token", F.col("tf").cast("double").alias("weight"))
        index_documents(rows, doc_id, "token").write.mode("overwrite").parquet(f"{state}/index/batch={batch_id}")

    return _run(stream, state, each)


def query_index(spark: SparkSession, state: str, docs: DataFrame, k: int, query_id: str, doc_id: str = "doc_id") -> DataFrame:
    rows = token_runs(docs, query_id).select(query_id, "token", F.col("tf").cast("double").alias("weight"))
    index = spark.read.parquet(f"{state}/index").drop("batch")
    return sparse_similarity(index_documents(rows, query_id, "token"), index, k, query_id, doc_id)


# ---------------------------------------------------------------- models
def stream_lda_update(stream: DataFrame, state: str, words: DataFrame, model: topics.OnlineLda) -> StreamingQuery:
    """One online LDA update per batch; the topic table is written per batch and read again, so a replay repeats one update.

    The state of a batch is a table (term_id, vector) and one row of what the driver knows (updates, documents seen, priors).
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id > 0:
            read_lda(spark, state, batch_id - 1, model)
        model.update(cut(topics.chunk_documents(token_runs(batch), words)))
        facts = [(model.updates, model.seen, model.alpha.tolist(), model.eta.tolist())]
        model.table(spark).write.mode("overwrite").parquet(f"{state}/model/batch={batch_id}")
        spark.createDataFrame(facts, "updates long, seen long, alpha array<double>, eta array<double>").write.mode("overwrite").parquet(
            f"{state}/facts/batch={batch_id}")

    return _run(stream, state, each)


def read_lda(spark: SparkSession, state: str, batch_id: int, model: topics.OnlineLda) -> topics.OnlineLda:
    """`model` as it was after a batch of `stream_lda_update`."""
    facts = spark.read.parquet(f"{state}/facts/batch={batch_id}").first()
    model.restore(spark.read.parquet(f"{state}/model/batch={batch_id}"), written=True)
    model.updates, model.seen, model.alpha, model.eta = facts.updates, facts.seen, np.array(facts.alpha), np.array(facts.eta)
    return model


def stream_lsi_update(stream: DataFrame, state: str, words: DataFrame, k: int, decay: float = 1.0) -> StreamingQuery:
    """Fold each batch's projection into the running one; decay < 1 forgets. State: term vectors and singular values."""
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = token_runs(batch).join(words.select("token", "term_id"), "token").select(
            "doc_id", "term_id", F.col("tf").cast("double").alias("weight"))
        new = spectral.lsi_fit(rows, k)
        if batch_id > 0:
            old = spark.read.parquet(f"{state}/model/batch={batch_id - 1}")
            s = np.array(old.first()["s"])
            new = spectral.lsi_merge((old.select("term_id", "vector"), s), new, k, decay)
        terms, s = new
        terms.withColumn("s", F.array(*[F.lit(float(x)) for x in s])).write.mode("overwrite").parquet(f"{state}/model/batch={batch_id}")

    return _run(stream, state, each)


def stream_vocab_online(stream: DataFrame, state: str, start: DataFrame, min_count: int = 5) -> StreamingQuery:
    """Growing word counts: known words add up, new ones enter when their batch count passes min_count."""
    def each(batch: DataFrame, batch_id: int) -> None:
        old = start if batch_id == 0 else batch.sparkSession.read.parquet(f"{state}/vocab/batch={batch_id - 1}")
        vocab.update_vocab(old, batch, min_count).write.mode("overwrite").parquet(f"{state}/vocab/batch={batch_id}")

    return _run(stream, state, each)


def stream_mini_batches(stream: DataFrame, state: str, factors: dict[str, str], settings: factor.Settings,
                        start: DataFrame) -> StreamingQuery:
    """One optimiser step per micro-batch of tensor rows (i, j[, k], value)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        old = start if batch_id == 0 else batch.sparkSession.read.parquet(f"{state}/factors/batch={batch_id - 1}")
        rows = cut(batch.withColumn("weight", F.lit(1.0)))
        grads = cut(factor.gradients(rows, old, factors, settings, mean_of=max(1, rows.count())))
        new = factor.update(old, grads.filter("f <> '_loss'"), settings, batch_id + 1)
        new.write.mode("overwrite").parquet(f"{state}/factors/batch={batch_id}")

    return _run(stream, state, each)


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The state written by the last batch."""
    rows = spark.read.parquet(folder)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.filter(F.col("batch") == last).drop("batch")


# ---------------------------------------------------------------- event-time slices
def stream_topic_slices(stream: DataFrame, state: str, ts: str = "ts", key: str = "token", length: str = "1 day",
                        lateness: str = "1 hour") -> StreamingQuery:
    """Counts per tumbling slice and key; rows later than the watermark are dropped. Each batch rewrites what changed."""
    counts = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).groupBy(F.window(ts, length).alias("w"), key).agg(F.count("*").alias("n"))
    changed = counts.select(F.col("w.start").alias("slice"), key, "n")

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/slices/batch={batch_id}")

    return _run(changed, state, each, "update")


def read_topic_slices(spark: SparkSession, state: str, key: str = "token") -> DataFrame:
    """The newest count of every slice and key."""
    rows = spark.read.parquet(f"{state}/slices")
    return rows.groupBy("slice", key).agg(F.max_by("n", "batch").alias("n"))
