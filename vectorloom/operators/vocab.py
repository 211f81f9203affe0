"""Vocabularies: document frequencies, pruning, merging, hashing, sampling.

Tables: `docs(doc_id, tokens ARRAY<STRING>)`, `vocab(token, df, cf[, term_id])`, `bow(doc_id, token|term_id, tf)`.
Ids follow (df DESC, token ASC), zero-based.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.runtime import dense_ids, hash01, running_total


def token_runs(docs: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """One row per distinct (document, token) with its count, computed inside the row: no shuffle.

    The sorted token array is cut where the value changes; each run start is a distinct token and the
    gap to the next start is its count.
    """
    sorted_docs = docs.select(doc_id, F.sort_array(F.col(tokens)).alias("_s"))
    starts = sorted_docs.withColumn(
        "_starts",
        F.when(F.size("_s") > 0, F.filter(F.sequence(F.lit(1), F.size("_s")),
                                          lambda i: (i == 1) | (F.get(F.col("_s"), i - 1) != F.get(F.col("_s"), i - 2)))))
    runs = F.transform(
        F.col("_starts"),
        lambda at, k: F.struct(
            F.get(F.col("_s"), at - 1).alias("token"),
            (F.coalesce(F.get(F.col("_starts"), k + 1), F.size("_s") + 1) - at).cast("long").alias("tf")))
    return starts.select(doc_id, F.explode(runs).alias("_r")).select(doc_id, "_r.token", "_r.tf")


def token_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """df and cf per token in one pass and one shuffle with map-side combine."""
    flagged = docs.select(F.sort_array(F.col(tokens)).alias("_s")).select(
        F.explode(F.transform(
            F.col("_s"),
            lambda t, i: F.struct(t.alias("token"),
                                  ((i == 0) | (F.get(F.col("_s"), i - 1) != t)).cast("long").alias("first")))
        ).alias("_t"))
    return flagged.groupBy(F.col("_t.token").alias("token")).agg(
        F.sum("_t.first").alias("df"), F.count("*").alias("cf"))


def assign_ids(vocab: DataFrame, by: str = "df", token: str = "token", name: str = "term_id") -> DataFrame:
    return dense_ids(vocab, [F.col(by).desc(), F.col(token).asc()], name)


def build_vocab(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    return assign_ids(token_counts(docs, tokens))


def corpus_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """One row: documents, processed positions, distinct (document, token) pairs."""
    return docs.agg(
        F.count("*").alias("num_docs"),
        F.coalesce(F.sum(F.size(tokens)), F.lit(0)).cast("long").alias("num_pos"),
        F.coalesce(F.sum(F.size(F.array_distinct(tokens))), F.lit(0)).cast("long").alias("num_nnz"))


def doc2bow(docs: DataFrame, vocab: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, term_id, tf) for known tokens. The join strategy is left to runtime statistics."""
    return token_runs(docs, doc_id).join(vocab.select("token", "term_id"), "token").select(doc_id, "term_id", "tf")


def missing_tokens(docs: DataFrame, vocab: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return token_runs(docs, doc_id).join(vocab.select("token"), "token", "left_anti")


def with_num_docs(vocab: DataFrame, docs: DataFrame) -> DataFrame:
    """Attach the document count; the joined side is one row."""
    return vocab.join(F.broadcast(docs.agg(F.count("*").alias("num_docs"))))


def filter_extremes(vocab: DataFrame, docs: DataFrame, no_below: int = 5, no_above: float = 0.5,
                    keep_n: int | None = 100_000) -> DataFrame:
    """Keep tokens with no_below <= df <= no_above * documents, then the keep_n most frequent; new ids."""
    kept = with_num_docs(vocab.drop("term_id"), docs).filter(
        (F.col("df") >= no_below) & (F.col("df") <= F.floor(F.col("num_docs") * no_above))).drop("num_docs")
    numbered = assign_ids(kept)
    return numbered if keep_n is None else numbered.filter(F.col("term_id") < keep_n)


def filter_n_most_frequent(vocab: DataFrame, remove_n: int) -> DataFrame:
    top = vocab.orderBy(F.col("df").desc(), "token").limit(remove_n).select("token")
    return assign_ids(vocab.drop("term_id").join(top, "token", "left_anti"))


def filter_tokens(vocab: DataFrame, good: DataFrame | None = None, bad: DataFrame | None = None) -> DataFrame:
    """Keep or remove listed tokens, then close the gaps in the ids."""
    kept = vocab.drop("term_id")
    if bad is not None:
        kept = kept.join(bad.select("token"), "token", "left_anti")
    if good is not None:
        kept = kept.join(good.select("token"), "token", "left_semi")
    return assign_ids(kept)


def merge_vocabs(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of tokens with summed counts, and the map from the right side's old ids to the new ones."""
    sums = (left.select("token", "df", "cf").unionByName(right.select("token", "df", "cf"))
            .groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")))
    merged = assign_ids(sums)
    id_map = right.select("token", F.col("term_id").alias("old_id")).join(
        merged.select("token", F.col("term_id").alias("new_id")), "token").select("old_id", "new_id")
    return merged, id_map


def vocab_from_bow(bow: DataFrame) -> DataFrame:
    """df and cf per id, ids 0..max present even when unused."""
    counts = bow.groupBy("term_id").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))
    top = counts.agg(F.max("term_id")).first()[0]
    ids = bow.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", "term_id")
    return ids.join(counts, "term_id", "left").fillna(0, ["df", "cf"])


# ---------------------------------------------------------------- hashing
def hash_ids(id_range: int = 32_000, hash_function: Callable[[bytes], int] = zlib.adler32):
    """Column function token -> id; an Arrow UDF meant for tables of distinct tokens."""
    def ids(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: hash_function(t.encode("utf8")) % id_range)

    return lambda c: F.pandas_udf(ids, "long")(c)


def hash_vocab(docs: DataFrame, id_range: int = 32_000,
               hash_function: Callable[[bytes], int] = zlib.adler32) -> DataFrame:
    """token -> hashed id, hashing each distinct token once."""
    return token_counts(docs).withColumn("term_id", hash_ids(id_range, hash_function)(F.col("token")))


def hash_bow(docs: DataFrame, id_range: int = 32_000, doc_id: str = "doc_id",
             hash_function: Callable[[bytes], int] = zlib.adler32) -> DataFrame:
    """Bag of hashed ids; colliding tokens add up."""
    ids = hash_vocab(docs, id_range, hash_function).select("token", "term_id")
    return (token_runs(docs, doc_id).join(ids, "token")
            .groupBy(doc_id, "term_id").agg(F.sum("tf").alias("tf")))


def hash_vocab_filter(vocab: DataFrame, docs: DataFrame, no_below: int = 5, no_above: float = 0.5,
                      keep_n: int = 100_000) -> DataFrame:
    """Prune the token side of a hashed vocabulary; the ids themselves never change."""
    kept = with_num_docs(vocab, docs).filter(
        (F.col("df") >= no_below) & (F.col("df") <= F.floor(F.col("num_docs") * no_above))).drop("num_docs")
    return kept.orderBy(F.col("df").desc(), "token").limit(keep_n)


# ---------------------------------------------------------------- word counts and sampling
def word_counts(docs: DataFrame, min_count: int = 5, trim_rule: Callable[[Column, Column], Column] | None = None,
                tokens: str = "tokens") -> DataFrame:
    """Total counts; `trim_rule(word, count)` gives 'keep', 'discard' or 'default' per word."""
    counts = docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    keep = F.col("count") >= min_count
    if trim_rule is not None:
        verdict = trim_rule(F.col("token"), F.col("count"))
        keep = F.when(verdict == "keep", True).when(verdict == "discard", False).otherwise(keep)
    return counts.filter(keep)


def keep_probability(count: Column, total: Column, sample: float) -> Column:
    """Chance that one occurrence of a word with `count` survives down-sampling."""
    if sample == 0:
        return F.lit(1.0)
    threshold = total * sample if sample < 1 else F.lit(float(int(sample * (3 + 5 ** 0.5) / 2)))
    return F.least(F.lit(1.0), (F.sqrt(count / threshold) + 1) * (threshold / count))


def subsample_probability(counts: DataFrame, sample: float = 1e-3) -> DataFrame:
    totals = counts.agg(F.sum("count").cast("double").alias("_total"))
    return (counts.join(F.broadcast(totals))  # one row
            .withColumn("keep_prob", keep_probability(F.col("count").cast("double"), F.col("_total"), sample))
            .drop("_total"))


def retention_report(docs: DataFrame, min_count: int = 5, sample: float = 1e-3, dim: int = 100,
                     tokens: str = "tokens") -> DataFrame:
    """What a vocabulary with these settings would keep, drop and cost, as one row."""
    raw = docs.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    kept = F.col("count") >= min_count
    sums = raw.agg(F.count("*").alias("raw_unique"), F.sum("count").alias("raw_total"),
                   F.sum(kept.cast("long")).alias("retain_unique"),
                   F.sum(F.when(kept, F.col("count")).otherwise(0)).alias("retain_total"))
    n, t = F.col("count").cast("double"), F.col("retain_total").cast("double")
    p = keep_probability(n, t, sample)
    down = raw.filter(kept).join(F.broadcast(sums)).agg(  # one row
        F.sum((p < 1).cast("long")).alias("downsample_unique"),
        F.sum(F.floor(p * n)).cast("long").alias("downsample_total"))
    return (sums.join(F.broadcast(down))  # one row
            .withColumn("drop_unique", F.col("raw_unique") - F.col("retain_unique"))
            .withColumn("vocab_bytes", F.col("retain_unique") * 500)
            .withColumn("vector_bytes", F.col("retain_unique") * dim * 4))


def subsample_tokens(docs: DataFrame, probabilities: DataFrame, seed: int = 1, doc_id: str = "doc_id",
                     tokens: str = "tokens") -> DataFrame:
    """Occurrences that survive; the draw depends on (document, position, seed) only."""
    occurrences = docs.select(doc_id, F.posexplode(tokens).alias("pos", "token"))
    draw = hash01(F.col(doc_id), F.col("pos"), seed=seed)
    return (occurrences.join(probabilities.select("token", "keep_prob"), "token")
            .filter(draw < F.col("keep_prob")).drop("keep_prob"))


def negative_sampling_table(counts: DataFrame, power: float = 0.75, domain: int = 2**31 - 1) -> DataFrame:
    """Cumulative share of count^power over words in rank order, scaled to `domain`."""
    weighted = counts.select("token", "count", F.pow(F.col("count").cast("double"), F.lit(power)).alias("_w"))
    summed = running_total(weighted, [F.col("count").desc(), F.col("token").asc()], "_w", "_c")
    grand = weighted.agg(F.sum("_w").alias("_t"))
    return (summed.join(F.broadcast(grand))  # one row
            .select("token", "count", (F.col("_c") / F.col("_t")).alias("share"),
                    F.round((F.col("_c") - F.col("_w")) / F.col("_t") * domain).cast("long").alias("lower"),
                    F.round(F.col("_c") / F.col("_t") * domain).cast("long").alias("upper")))


def update_vocab(old: DataFrame, new_docs: DataFrame, min_count: int = 5) -> DataFrame:
    """Add new counts to known words; new words enter when they pass min_count, ids appended after the old."""
    fresh = new_docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("_n"))
    known = (old.join(fresh, "token", "left")
             .select("token", "term_id", (F.col("count") + F.coalesce("_n", F.lit(0))).alias("count")))
    added = (fresh.join(old.select("token"), "token", "left_anti").filter(F.col("_n") >= min_count)
             .withColumnRenamed("_n", "count"))
    top = old.agg(F.max("term_id")).first()[0]
    numbered = dense_ids(added, [F.col("count").desc(), F.col("token").asc()], "term_id",
                         start=0 if top is None else top + 1)
    return known.unionByName(numbered.select("token", "term_id", "count"))


def most_frequent(vocab: DataFrame, k: int, by: str = "count", token: str = "token") -> DataFrame:
    return vocab.orderBy(F.col(by).desc(), F.col(token).asc()).limit(k)


def min_count(vocab: DataFrame, n: int, by: str = "count") -> DataFrame:
    return vocab.filter(F.col(by) >= n)


def common_vocab(embeddings: Iterable[DataFrame], word: str = "word") -> DataFrame:
    """Words present in every embedding."""
    parts = [e.select(word).distinct() for e in embeddings]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy(word).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(parts)).select(word)


def tag_stats(docs: DataFrame, tags: str = "tags", tokens: str = "tokens", order: str = "doc_id") -> DataFrame:
    """Documents, words and first position per tag."""
    return (docs.select(F.explode(tags).alias("tag"), F.size(tokens).cast("long").alias("_n"), F.col(order).alias("_o"))
            .groupBy("tag").agg(F.count("*").alias("doc_count"), F.sum("_n").alias("word_count"),
                                F.min("_o").alias("first_seen")))
