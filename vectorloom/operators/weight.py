"""Weighting and projection of sparse documents held as (doc_id, term_id, value) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.runtime import hash01

EPS = 1e-12


def unit_length(rows: DataFrame, doc_id: str = "doc_id", weight: str = "weight", norm: str = "l2") -> DataFrame:
    """Scale every document to length one; a zero document stays as it is."""
    size = F.abs(F.col(weight)) if norm == "l1" else F.col(weight) * F.col(weight)
    length = F.sum(size).over(W.partitionBy(doc_id))
    length = length if norm == "l1" else F.sqrt(length)
    return (rows.withColumn("_len", length)
            .withColumn(weight, F.when(F.col("_len") > 0, F.col(weight) / F.col("_len")).otherwise(F.col(weight)))
            .drop("_len"))


normalize = unit_length


def tfidf(bow: DataFrame, vocab: DataFrame, num_docs: int, doc_id: str = "doc_id", key: str = "term_id",
          wlocal: Callable[[Column], Column] = lambda tf: tf,
          wglobal: Callable[[Column, int], Column] = lambda df, n: F.log2(F.lit(float(n)) / df),
          normed: bool = True) -> DataFrame:
    """tf * log2(N/df), terms of zero idf dropped, documents scaled to unit length.

    `vocab` already carries df, so the corpus is not scanned again. One join on the term, one shuffle by document.
    """
    idf = vocab.select(key, wglobal(F.col("df").cast("double"), num_docs).alias("_idf")).filter(F.abs("_idf") > EPS)
    weighted = bow.join(idf, key).select(doc_id, key, (wlocal(F.col("tf").cast("double")) * F.col("_idf")).alias("weight"))
    weighted = weighted.filter(F.abs("weight") > EPS)
    return unit_length(weighted, doc_id).filter(F.abs("weight") > EPS) if normed else weighted


def log_entropy(bow: DataFrame, num_docs: int, doc_id: str = "doc_id", key: str = "term_id",
                normed: bool = True) -> DataFrame:
    """ln(tf+1) * (1 + sum p ln p / ln(N+1)) with p = tf / corpus frequency.

    sum p ln p = (sum tf ln tf)/gf - ln gf, so one aggregation per term gives the entropy.
    """
    tf = F.col("tf").cast("double")
    entropy = bow.groupBy(key).agg(F.sum(tf).alias("_gf"), F.sum(tf * F.log(tf)).alias("_s")).select(
        key, (1 + (F.col("_s") / F.col("_gf") - F.log("_gf")) / F.log(F.lit(num_docs + 1.0))).alias("_e"))
    weighted = bow.join(entropy, key).select(doc_id, key, (F.log(tf + 1) * F.col("_e")).alias("weight"))
    return unit_length(weighted, doc_id) if normed else weighted


def random_projection(rows: DataFrame, k: int, doc_id: str = "doc_id", key: str = "term_id",
                      value: str = "weight", seed: int = 0) -> DataFrame:
    """Project onto k random +-1 directions; the matrix is a hash of (term, topic), never stored.

    Each term yields one array of k signed values; arrays are summed per document component by component.
    """
    digits = F.concat(*[F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(f"{b}|{seed}"))) for b in range(-(-k // 32))])
    signed = rows.select(doc_id, value, digits.alias("_h"))  # one hexadecimal digit a topic: the upper half is minus
    parts = signed.select(doc_id, F.array(*[
        F.when(F.substring("_h", t + 1, 1) < "8", F.col(value)).otherwise(-F.col(value)) for t in range(k)]).alias("_v"))
    sums = parts.groupBy(doc_id).agg(*[F.sum(F.get("_v", F.lit(t))).alias(f"_t{t}") for t in range(k)])
    packed = F.array(*[F.col(f"_t{t}") / F.lit(float(k) ** 0.5) for t in range(k)])
    return (sums.select(doc_id, F.posexplode(packed).alias("topic", "weight"))
            .filter(F.abs("weight") > 1e-9))


def log_normalize(rows: DataFrame, by: str, value: str = "weight") -> DataFrame:
    """Subtract log(sum(exp(value))) within each `by` group, shifted by the maximum against overflow."""
    w = W.partitionBy(by)
    top = rows.withColumn("_m", F.max(value).over(w))
    return (top.withColumn("_z", F.log(F.sum(F.exp(F.col(value) - F.col("_m"))).over(w)) + F.col("_m"))
            .withColumn(value, F.col(value) - F.col("_z")).drop("_m", "_z"))


def vocab_transform(rows: DataFrame, old2new: DataFrame, key: str = "term_id") -> DataFrame:
    """Rename feature ids; unmapped ones disappear."""
    m = old2new.select(F.col("old_id").alias(key), "new_id")
    return rows.join(m, key).drop(key).withColumnRenamed("new_id", key)


# ---------------------------------------------------------------- packing
def pack(rows: DataFrame, doc_id: str = "doc_id", key: str = "term_id", value: str = "weight") -> DataFrame:
    """One row per document: parallel arrays of ids and values, ordered by id."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))))
    return rows.groupBy(doc_id).agg(pairs.alias("_p")).select(
        doc_id, F.col("_p.k").alias("ids"), F.col("_p.v").alias("weights"))


def sparse_to_dense(rows: DataFrame, length: int, doc_id: str = "doc_id", key: str = "term_id",
                    value: str = "weight") -> DataFrame:
    entries = rows.groupBy(doc_id).agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("_m"))
    return entries.select(doc_id, F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.coalesce(F.element_at("_m", i.cast(rows.schema[key].dataType)).cast("double"), F.lit(0.0)))
        .alias("vector"))


def dense_to_sparse(rows: DataFrame, vector: str, doc_id: str = "doc_id", eps: float = 1e-9) -> DataFrame:
    return (rows.select(doc_id, F.posexplode(F.col(vector).cast("array<double>")).alias("term_id", "weight"))
            .filter(F.abs("weight") > eps))


def dense_to_top_n(rows: DataFrame, vector: str, n: int, doc_id: str = "doc_id", eps: float = 1e-9) -> DataFrame:
    """The n components of largest absolute value, chosen inside each row."""
    entries = F.transform(F.col(vector).cast("array<double>"), lambda x, i: F.struct((-F.abs(x)).alias("o"), i.alias("i"), x.alias("x")))
    best = F.slice(F.sort_array(entries), 1, n)
    return (rows.select(doc_id, F.explode(best).alias("_e"))
            .select(doc_id, F.col("_e.i").alias("term_id"), F.col("_e.x").alias("weight"))
            .filter(F.abs("weight") > eps))


# ---------------------------------------------------------------- corpus slicing over an indexed corpus
def corpus_slice(docs: DataFrame, start: int = 0, stop: int | None = None, step: int = 1, idx: str = "idx") -> DataFrame:
    keep = (F.col(idx) >= start) & ((F.col(idx) - start) % step == 0)
    return docs.filter(keep if stop is None else keep & (F.col(idx) < stop))


def corpus_repeat(docs: DataFrame, times: int) -> DataFrame:
    """Every document `times` times, with the copy number."""
    return docs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def corpus_repeat_to(docs: DataFrame, length: int, idx: str = "idx") -> DataFrame:
    """Cycle the indexed corpus until it has `length` documents."""
    n = docs.count()
    rounds = -(-length // n) if n else 0
    if rounds == 0:
        return docs.limit(0)
    copies = docs.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return copies.withColumn(idx, F.col("_c") * n + F.col(idx)).filter(F.col(idx) < length).drop("_c")


def corpus_chunks(docs: DataFrame, size: int, idx: str = "idx") -> DataFrame:
    return docs.withColumn("chunk", F.floor(F.col(idx) / size).cast("long"))


# ---------------------------------------------------------------- documents from word vectors
def docs_to_vectors(docs: DataFrame, embedding: DataFrame, dim: int, how: str = "mean", doc_id: str = "doc_id",
                    tokens: str = "tokens", word: str = "word", vector: str = "vector") -> DataFrame:
    """Sum or mean of the vectors of a document's known words (each occurrence counts)."""
    from vectorloom.operators.vocab import token_runs

    counted = token_runs(docs, doc_id, tokens).join(embedding.select(F.col(word).alias("token"), vector), "token")
    sums = counted.groupBy(doc_id).agg(
        F.sum("tf").alias("_n"),
        *[F.sum(F.get(vector, F.lit(d)).cast("double") * F.col("tf")).alias(f"_d{d}") for d in range(dim)])
    by = F.col("_n") if how == "mean" else F.lit(1)
    return sums.select(doc_id, F.array(*[F.col(f"_d{d}") / by for d in range(dim)]).alias("vector"))


def hashed_split(rows: DataFrame, keys: list[str], share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Stable train/test split by a hash of the keys."""
    u = hash01(*[F.col(k) for k in keys], seed=seed)
    return rows.filter(u < share), rows.filter(u >= share)
