"""Similarity search: exact top-k over sparse and dense indexes, analogies, LSH, index maintenance.

Exact search compares every query with every indexed row; what travels is kept small. Queries that fit one
block (checked by counting) go to every task and the index is scanned in place. Larger query sets are cut
into blocks by a hash of their unique id, as is the index, and each (index block, query block) cell returns
its k best. No pair of rows is ever emitted, only k candidates per query and cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.functions import vectors as vx
from vectorloom.operators.distance import vector_mean
from vectorloom.operators.sparse_join import top_k_join
from vectorloom.operators.weight import pack, unit_length
from vectorloom.runtime import fits, hash01

#: Queries per block and index rows per block of the large path.
QUERY_BLOCK = 1024
INDEX_BLOCK = 50_000
EPS = 1e-9
DIGITS = 6

Score = Callable[[pd.DataFrame], np.ndarray]
Prepare = Callable[[pd.DataFrame], Score]


def _best(scores: np.ndarray, ids: np.ndarray, k: int, by_abs: bool) -> np.ndarray:
    """Positions of the k best entries: larger rounded score first, then smaller id."""
    rank = np.abs(scores) if by_abs else scores
    usable = np.flatnonzero(~np.isnan(rank))
    if len(usable) > k:
        floor = np.partition(rank[usable], len(usable) - k)[len(usable) - k]
        usable = usable[rank[usable] >= floor]
    return usable[np.lexsort((ids[usable], -rank[usable]))][:k]


def _scan(batches: Iterator[pd.DataFrame], queries: pd.DataFrame, prepare: Prepare, k: int, qid: str, iid: str,
          by_abs: bool, drop_self: bool) -> Iterator[pd.DataFrame]:
    if len(queries) == 0:
        return
    score = prepare(queries)
    q_ids = queries[qid].to_numpy()
    held: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(q_ids)
    for batch in batches:
        if len(batch) == 0:
            continue
        ids = batch[iid].to_numpy()
        table = np.round(score(batch), DIGITS) + 0.0
        for i, row in enumerate(table):
            if drop_self:
                row = np.where(ids == q_ids[i], np.nan, row)
            if by_abs:
                row = np.where(np.abs(row) > EPS, row, np.nan)
            at = _best(row, ids, k, by_abs)
            found = (ids[at], row[at])
            if held[i] is not None:
                found = (np.concatenate([held[i][0], found[0]]), np.concatenate([held[i][1], found[1]]))
                at = _best(found[1], found[0], k, by_abs)
                found = (found[0][at], found[1][at])
            held[i] = found
    out = [(q_ids[i], ids, scores) for i, pair in enumerate(held) if pair is not None for ids, scores in [pair] if len(ids)]
    if out:
        yield pd.DataFrame({
            "query_id": np.concatenate([np.repeat(np.asarray(q, dtype=object), len(s)) for q, s, _ in out]),
            "hit_id": np.concatenate([s for _, s, _ in out]),
            "score": np.concatenate([s for _, _, s in out])})


def top_k(queries: DataFrame, index: DataFrame, prepare: Prepare, k: int, query_id: str, index_id: str,
          by_abs: bool = False, drop_self: bool = False, query_block: int = QUERY_BLOCK,
          index_block: int = INDEX_BLOCK, cells: list[str] | None = None) -> DataFrame:
    """(query_id, hit_id, score, rank) of the k best index rows per query.

    With `cells`, queries only meet index rows that agree on those columns (used by the LSH operator);
    hot cells are cut into blocks by their counted size.
    """
    qt, it = queries.schema[query_id].dataType.simpleString(), index.schema[index_id].dataType.simpleString()
    schema = f"query_id {qt}, hit_id {it}, score double"

    def run(batches, qpdf):
        yield from _scan(batches, qpdf, prepare, k, query_id, index_id, by_abs, drop_self)

    if cells is None and fits(queries, query_block):
        block = queries.toPandas()  # at most query_block rows, counted above
        found = index.mapInPandas(lambda batches: run(batches, block), schema)
    else:
        keys = cells or []
        q = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # fresh columns: both sides may be one table
        i = index
        if cells is None:
            sizes = (math.ceil(q.count() / query_block), math.ceil(i.count() / index_block))
            q = q.withColumn("_nq", F.lit(max(1, sizes[0]))).withColumn("_ni", F.lit(max(1, sizes[1])))
            i = i.withColumn("_nq", F.lit(max(1, sizes[0]))).withColumn("_ni", F.lit(max(1, sizes[1])))
        else:
            nq = q.groupBy(*keys).agg(F.ceil(F.count("*") / query_block).cast("int").alias("_nq"))
            ni = i.groupBy(*keys).agg(F.ceil(F.count("*") / index_block).cast("int").alias("_ni"))
            cuts = nq.join(ni, keys)
            q, i = q.join(cuts, keys), i.join(cuts, keys)

        def block_of(c, n):
            return F.pmod(F.xxhash64(c), F.col(n)).cast("int")

        def copies(n):
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        q = q.withColumn("_bq", block_of(query_id, "_nq")).withColumn("_bi", copies("_ni")).drop("_nq", "_ni")
        i = i.withColumn("_bi", block_of(index_id, "_ni")).withColumn("_bq", copies("_nq")).drop("_nq", "_ni")

        def cell(qpdf: pd.DataFrame, ipdf: pd.DataFrame) -> pd.DataFrame:
            parts = (ipdf.iloc[at:at + 10_000] for at in range(0, len(ipdf), 10_000))
            got = list(run(parts, qpdf))
            return got[0] if got else pd.DataFrame({"query_id": [], "hit_id": [], "score": []})

        on = [*keys, "_bq", "_bi"]
        found = q.groupBy(*on).cogroup(i.groupBy(*on)).applyInPandas(cell, schema)
        if cells is not None:
            found = found.dropDuplicates(["query_id", "hit_id"])
    order = F.abs("score") if by_abs else F.col("score")
    w = W.partitionBy("query_id").orderBy(order.desc(), "hit_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- sparse documents
def _sparse_prepare(queries: pd.DataFrame) -> Score:
    """Dot products of packed sparse queries with packed sparse rows."""
    lengths = queries["ids"].map(len).to_numpy()
    flat = np.concatenate(queries["ids"].to_list())
    terms, column = np.unique(flat, return_inverse=True)
    matrix = np.zeros((len(terms), len(queries)))
    matrix[column, np.repeat(np.arange(len(queries)), lengths)] = np.concatenate(queries["weights"].to_list())

    def score(batch: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(batch), len(queries)))
        sizes = batch["ids"].map(len).to_numpy()
        rows = np.repeat(np.arange(len(batch)), sizes)
        ids, values = np.concatenate(batch["ids"].to_list()), np.concatenate(batch["weights"].to_list())
        at = np.minimum(np.searchsorted(terms, ids), len(terms) - 1)
        hit = terms[at] == ids
        rows, at, values = rows[hit], at[hit], values[hit]
        step = max(1, 4_000_000 // len(queries))
        for lo in range(0, len(rows), step):
            r = rows[lo:lo + step]
            firsts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            out[r[firsts]] += np.add.reduceat(matrix[at[lo:lo + step]] * values[lo:lo + step, None], firsts, axis=0)
        return out.T

    return score


def index_documents(rows: DataFrame, doc_id: str = "doc_id", key: str = "term_id", value: str = "weight") -> DataFrame:
    """Unit-length documents packed one per row; string keys are hashed to 64-bit ids."""
    if dict(rows.dtypes)[key] == "string":
        rows = rows.withColumn(key, F.xxhash64(key))
    return pack(unit_length(rows, doc_id, value), doc_id, key, value)


def sparse_similarity(queries: DataFrame, index: DataFrame, k: int, query_id: str, index_id: str = "doc_id",
                      drop_self: bool = False) -> DataFrame:
    """Top-k cosine of packed queries against a packed index, largest absolute score first.

    Few queries are scored against the index in place; more go through an inverted index with exact bounds (`sparse_join`).
    """
    if not fits(queries, 256):
        return top_k_join(queries, index, k, query_id, index_id, drop_self)
    return top_k(queries, index, _sparse_prepare, k, query_id, index_id, by_abs=True, drop_self=drop_self, query_block=256)


def similarity_self_join(index: DataFrame, k: int, doc_id: str = "doc_id") -> DataFrame:
    """The k most similar other documents of every document."""
    return sparse_similarity(index.withColumnRenamed(doc_id, "_q"), index, k, "_q", doc_id, drop_self=True)


def similarity_by_id(index: DataFrame, doc: int, k: int, doc_id: str = "doc_id") -> DataFrame:
    """Query with a stored document."""
    q = index.filter(F.col(doc_id) == doc).withColumnRenamed(doc_id, "_q")
    if q.isEmpty():
        raise ValueError(f"document {doc} is not in the index")
    return sparse_similarity(q, index, k, "_q", doc_id)


def top_texts(hits: DataFrame, texts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return hits.join(texts.select(F.col(doc_id).alias("hit_id"), text), "hit_id")


def add_documents(path: str, index: DataFrame, doc_id: str = "doc_id", buckets: int = 32, mode: str = "append") -> None:
    """Append packed documents to an index on disk, bucketed by document id."""
    (index.withColumn("bucket", F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int"))
     .repartition("bucket").write.mode(mode).partitionBy("bucket").parquet(path))


# ---------------------------------------------------------------- dense vectors
def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype("float64")


def _units(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def _dense_prepare(vector: str = "vector") -> Prepare:
    def prepare(queries: pd.DataFrame) -> Score:
        q = _units(_matrix(queries["vector"]))
        return lambda batch: q @ _units(_matrix(batch[vector])).T

    return prepare


def dense_similarity(queries: DataFrame, index: DataFrame, k: int, query_id: str, index_id: str,
                     vector: str = "vector", drop_self: bool = False, **blocks) -> DataFrame:
    """Top-k cosine between dense vectors; `queries` has `query_id, vector`."""
    return top_k(queries, index.select(index_id, vector), _dense_prepare(vector), k, query_id, index_id,
                 drop_self=drop_self, **blocks)


def _without_inputs(hits: DataFrame, inputs: DataFrame, k: int) -> DataFrame:
    used = inputs.select("query_id", F.col("word").alias("hit_id")).distinct()
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "hit_id")
    return (hits.drop("rank").join(used, ["query_id", "hit_id"], "left_anti")
            .withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k))


def most_similar(inputs: DataFrame, embedding: DataFrame, k: int = 10, restrict_vocab: int | None = None,
                 word: str = "word", vector: str = "vector", idx: str = "idx") -> DataFrame:
    """Batch of additive analogies; `inputs(query_id, word, weight)` with negative weights for words to move away from.

    Query vector = mean of weight * unit vector; input words are never returned; `restrict_vocab` keeps
    only the first so many (most frequent) words as answers.
    """
    e = embedding.select(F.col(word).alias("word"), vx.unit(vx.as_double(F.col(vector))).alias("vector"))
    signed = inputs.join(e, "word").select("query_id", vx.scale(F.col("vector"), F.col("weight").cast("double")).alias("vector"))
    q = vector_mean(signed, ["query_id"])
    index = embedding if restrict_vocab is None else embedding.filter(F.col(idx) < restrict_vocab)
    most = inputs.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    hits = dense_similarity(q, index.withColumnRenamed(word, "hit"), k + most, "query_id", "hit", vector)
    return _without_inputs(hits, inputs, k)


def most_similar_cosmul(inputs: DataFrame, embedding: DataFrame, k: int = 10, word: str = "word",
                        vector: str = "vector") -> DataFrame:
    """Multiplicative combination: product of (1+cos)/2 over positives divided by that over negatives + 1e-6."""
    e = embedding.select(F.col(word).alias("word"), vx.unit(vx.as_double(F.col(vector))).alias("vector"))
    q = inputs.join(e, "word").groupBy("query_id").agg(
        F.collect_list(F.col("weight").cast("double")).alias("signs"),
        F.flatten(F.collect_list("vector")).alias("flat"))

    def prepare(queries: pd.DataFrame) -> Score:
        parts = [(np.asarray(s), np.asarray(f).reshape(len(s), -1)) for s, f in zip(queries["signs"], queries["flat"])]

        def score(batch: pd.DataFrame) -> np.ndarray:
            m = _units(_matrix(batch[vector]))
            out = np.empty((len(parts), len(m)))
            for i, (signs, rows) in enumerate(parts):
                closeness = (1 + rows @ m.T) / 2
                out[i] = closeness[signs > 0].prod(0) / (closeness[signs < 0].prod(0) + 1e-6)
            return out

        return score

    most = inputs.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    hits = top_k(q, embedding.select(F.col(word).alias("hit"), vector), prepare, k + most, "query_id", "hit")
    return _without_inputs(hits, inputs, k)


def doesnt_match(groups: DataFrame, embedding: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """The word of every group farthest from the group's mean direction; `groups(group_id, word)`."""
    e = embedding.select(F.col(word).alias("word"), vx.unit(vx.as_double(F.col(vector))).alias("vector"))
    members = groups.join(e, "word")
    centre = vector_mean(members, ["group_id"]).select("group_id", vx.unit(F.col("vector")).alias("_c"))
    scored = members.join(centre, "group_id").select(
        "group_id", "word", F.round(vx.dot(F.col("vector"), F.col("_c")), DIGITS).alias("score"))
    return scored.groupBy("group_id").agg(F.min(F.struct("score", "word")).alias("_m")).select(
        "group_id", "_m.word", "_m.score")


# ---------------------------------------------------------------- approximate search
def approx_nearest(queries: DataFrame, index: DataFrame, k: int, query_id: str, index_id: str, dim: int,
                   vector: str = "vector", tables: int = 12, bits: int | None = None, seed: int = 7,
                   drop_self: bool = False) -> DataFrame:
    """Random-hyperplane LSH: rows meet in buckets of equal sign patterns, several tables; scores are exact cosines.

    By default the number of bits grows with the logarithm of the index, so that a bucket keeps about 64 rows at any size.
    Buckets larger than a block are split, so one crowded bucket does not become one task.
    """
    bits = bits if bits is not None else min(40, max(4, (index.count() // 64).bit_length()))
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))
    weights = 1 << np.arange(bits)

    def signatures(column: pd.Series) -> pd.Series:
        signs = (_matrix(column) @ planes.T > 0).reshape(len(column), tables, bits)
        return pd.Series(list((signs * weights).sum(-1).astype("int64")))

    def bucketed(df: DataFrame) -> DataFrame:
        return df.select("*", F.posexplode(F.pandas_udf(signatures, "array<bigint>")("vector")).alias("_table", "_bucket"))

    q = bucketed(queries.select(query_id, "vector"))
    i = bucketed(index.select(index_id, F.col(vector).alias("vector")))
    return top_k(q, i, _dense_prepare(), k, query_id, index_id, drop_self=drop_self, cells=["_table", "_bucket"])


# ---------------------------------------------------------------- reports on an embedding
def neighbour_report(words: DataFrame, embedding: DataFrame, k: int = 10, word: str = "word") -> DataFrame:
    """(word, neighbours): the k nearest words of each listed word, nearest first, as `name:cosine` joined by blanks."""
    asked = words.select(F.col(word).alias("query_id"), F.col(word).alias("word"), F.lit(1.0).alias("weight"))
    found = most_similar(asked, embedding, k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "hit_id", "score"))).alias("_l"))
    # format_number rounds the exact value of a double as C does; format_string would round its shortest decimal form (0.4795 up)
    shown = F.transform("_l", lambda x: F.concat_ws(":", x["hit_id"], F.format_number(x["score"], 3)))
    return found.select(F.col("query_id").alias(word), F.array_join(shown, " ").alias("neighbours"))


def top_words_per_dimension(embedding: DataFrame, n: int, word: str = "word", vector: str = "vector") -> DataFrame:
    """The n words with the largest value in every dimension; the limit is applied before the shuffle too."""
    cells = embedding.select(word, F.posexplode(vx.as_double(F.col(vector))).alias("dim", "value"))
    w = W.partitionBy("dim").orderBy(F.col("value").desc(), word)
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_dimensions_of_words(embedding: DataFrame, n_dims: int, n_words: int, word: str = "word",
                            vector: str = "vector") -> DataFrame:
    """For every word its n_dims strongest dimensions and the strongest other words there."""
    best = F.slice(F.sort_array(F.transform(vx.as_double(F.col(vector)), lambda x, i: F.struct((-x).alias("o"), i.alias("dim")))), 1, n_dims)
    dims = embedding.select(word, F.explode(best).alias("_b")).select(word, F.col("_b.dim").alias("dim"))
    leaders = top_words_per_dimension(embedding, n_words + 1, word, vector).select(
        "dim", F.col(word).alias("leader"), F.col("rank").alias("_r"))
    w = W.partitionBy(word, "dim").orderBy("_r")
    return (dims.join(leaders, "dim").filter(F.col(word) != F.col("leader"))
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_words).drop("_r"))


def dimension_intruders(embedding: DataFrame, seed: int = 0, word: str = "word", vector: str = "vector") -> DataFrame:
    """Per dimension one word of its lower half that is in the top tenth of another dimension, drawn by hash."""
    cells = embedding.select(word, F.posexplode(vx.as_double(F.col(vector))).alias("dim", "value"))
    # thresholds of each dimension from mergeable sketches: no dimension is sorted in one task
    limits = cells.groupBy("dim").agg(F.percentile_approx("value", [0.5, 0.9]).alias("_q"))
    ranked = cells.join(F.broadcast(limits), "dim")  # a row for each dimension
    high = ranked.filter(F.col("value") > F.col("_q")[1]).groupBy(word).agg(F.collect_set("dim").alias("_dims"))
    low = ranked.filter(F.col("value") <= F.col("_q")[0]).select(word, "dim").join(high, word)
    elsewhere = low.filter(F.size(F.array_except("_dims", F.array("dim"))) > 0)
    draw = hash01(F.col(word), F.col("dim"), seed=seed)
    return elsewhere.groupBy("dim").agg(F.min_by(word, F.struct(draw, word)).alias("intruder"))


def get_vectors(words: DataFrame, embedding: DataFrame, default: list[float], word: str = "word",
                vector: str = "vector") -> DataFrame:
    """Vector of every asked word, the default for unknown ones."""
    fallback = F.array(*[F.lit(float(x)) for x in default])
    return words.join(embedding.select(word, vx.as_double(F.col(vector)).alias(vector)), word, "left").withColumn(
        vector, F.coalesce(vector, fallback))


def intersect_embedding(own: DataFrame, other: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """Take over the other table's vectors for shared words and mark them locked; nothing is added."""
    o = other.select(word, F.col(vector).alias("_o"))
    return own.join(o, word, "left").select(
        *[c for c in own.columns if c != vector], F.coalesce("_o", vector).alias(vector),
        F.col("_o").isNotNull().alias("locked"))


def phrase_lookup(phrases: DataFrame, embedding: DataFrame, whole_phrases: bool = True, lower: bool = True,
                  mask_digits: bool = False, word: str = "word", vector: str = "vector") -> DataFrame:
    """(phrase_id, vector) of `a_b_c` phrases: mean over the longest known stretches from left to right.

    Without `whole_phrases` the single known parts are averaged. Every stretch of a phrase is looked up by one
    join; the left-to-right walk happens inside the row. `mask_digits` turns runs of two or more digits into `#`.
    """
    text = F.lower("phrase") if lower else F.col("phrase")
    text = F.regexp_replace(text, r"(?<=[0-9])[0-9]|[0-9](?=[0-9])", "#") if mask_digits else text
    split = phrases.select("phrase_id", F.split(text, "_").alias("_p"))
    longest = F.size("_p") if whole_phrases else F.lit(1)

    def stretches(i):
        return F.transform(F.sequence(F.lit(1), F.least(F.size("_p") - i, longest)), lambda n: F.struct(
            i.alias("at"), n.alias("n"), F.array_join(F.slice("_p", i + 1, n), "_").alias("word")))

    spans = split.select("phrase_id", F.explode(F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("_p") - 1), stretches))).alias("_s")).select("phrase_id", "_s.*")
    e = embedding.select(F.col(word).alias("word"), vx.as_double(F.col(vector)).alias("vector"))
    known = spans.join(e.select("word"), "word", "left_semi")
    best = known.groupBy("phrase_id", "at").agg(F.max(F.struct("n", "word")).alias("_b"))
    rows = best.groupBy("phrase_id").agg(F.sort_array(F.collect_list(F.struct("at", "_b.n", "_b.word"))).alias("_l"))
    walked = F.aggregate(
        F.col("_l"), F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("taken")),
        lambda s, x: F.when(x["at"] >= s["free"], F.struct(
            (x["at"] + x["n"]).alias("free"), F.concat(s["taken"], F.array(x["word"])).alias("taken"))).otherwise(s))
    chosen = rows.select("phrase_id", F.explode(walked["taken"]).alias("word"))
    return vector_mean(chosen.join(e, "word"), ["phrase_id"])
