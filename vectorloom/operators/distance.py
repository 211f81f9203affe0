"""Distances between listed pairs of sparse documents, and between word vectors.

`pairs(a, b)` names the documents to compare, `rows(doc_id, term_id, weight)` holds them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.functions import vectors as vx


def aligned(pairs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", key: str = "term_id",
            weight: str = "weight") -> DataFrame:
    """(a, b, term, wa, wb): both documents of every pair on a common term axis, absent terms as 0.

    A document travels as one packed row, once to its place and once more to its partner. Terms are unpacked where `b` lives, which
    is where all rows of (a, b) are: neither the sum over equal terms nor a later one over (a, b) moves anything.
    """
    entry = F.struct(F.col(key).alias("term"), F.col(weight).cast("double").alias("w"))
    packed = rows.groupBy(F.col(doc_id).alias("_d")).agg(F.collect_list(entry).alias("_l"))
    one = pairs.select("a", "b").join(packed, F.col("a") == F.col("_d"), "left").select("a", "b", F.col("_l").alias("_la"))
    both = one.join(packed, F.col("b") == F.col("_d"), "left").select("a", "b", "_la", F.col("_l").alias("_lb"))
    zero = F.lit(0.0)
    left = F.transform("_la", lambda x: F.struct(x["term"].alias("term"), x["w"].alias("wa"), zero.alias("wb")))
    right = F.transform("_lb", lambda x: F.struct(x["term"].alias("term"), zero.alias("wa"), x["w"].alias("wb")))
    terms = F.concat(F.coalesce(left, F.array()), F.coalesce(right, F.array()))
    return both.select("a", "b", F.explode(terms).alias("_t")).groupBy("a", "b", F.col("_t.term").alias("term")).agg(
        F.sum("_t.wa").alias("wa"), F.sum("_t.wb").alias("wb"))


def _per_pair(pairs: DataFrame, both: DataFrame, value, name: str, empty: float | None = None) -> DataFrame:
    out = both.groupBy("a", "b").agg(value.alias(name))
    if empty is None:
        return out
    return pairs.select("a", "b").join(out, ["a", "b"], "left").fillna({name: empty})


def cossim(pairs: DataFrame, rows: DataFrame, **cols) -> DataFrame:
    """Cosine; 0 when either document is empty."""
    a2, b2 = F.sum(F.col("wa") * F.col("wa")), F.sum(F.col("wb") * F.col("wb"))
    value = F.when((a2 > 0) & (b2 > 0), F.sum(F.col("wa") * F.col("wb")) / F.sqrt(a2) / F.sqrt(b2)).otherwise(0.0)
    return _per_pair(pairs, aligned(pairs, rows, **cols), value, "similarity", empty=0.0)


def kullback_leibler(pairs: DataFrame, rows: DataFrame, smooth: float = 0.0, **cols) -> DataFrame:
    """sum p ln(p/q) after adding `smooth` to every weight of the pair's common axis and scaling both to sum 1.

    Infinite when p has mass where q has none; NaN when a side has no mass, which no scaling makes a distribution. With the totals A and
    B, the sum is that of a ln(a/b) over A plus ln(B/A), so that one pass needs no totals beforehand.
    """
    both = aligned(pairs, rows, **cols).select("a", "b", (F.col("wa") + smooth).alias("wa"), (F.col("wb") + smooth).alias("wb"))
    term = F.when(F.col("wa") == 0, 0.0).when(F.col("wb") == 0, float("inf")).otherwise(F.col("wa") * F.log(F.col("wa") / F.col("wb")))
    a, b = F.sum("wa"), F.sum("wb")
    value = F.when((a > 0) & (b > 0), F.sum(term) / a + F.log(b / a)).otherwise(float("nan"))
    return _per_pair(pairs, both, value, "divergence")


def hellinger(pairs: DataFrame, rows: DataFrame, keys: str = "union", **cols) -> DataFrame:
    """sqrt(half the squared distance of square roots); `keys='shorter'` looks only at the shorter document's terms."""
    both = aligned(pairs, rows, **cols)
    d2 = F.pow(F.sqrt("wa") - F.sqrt("wb"), F.lit(2.0))
    if keys == "shorter":
        na, nb = F.sum((F.col("wa") != 0).cast("int")), F.sum((F.col("wb") != 0).cast("int"))
        on_a, on_b = F.sum(F.when(F.col("wa") != 0, d2).otherwise(0.0)), F.sum(F.when(F.col("wb") != 0, d2).otherwise(0.0))
        value = F.sqrt(0.5 * F.when(na <= nb, on_a).otherwise(on_b))
    else:
        value = F.sqrt(0.5 * F.sum(d2))
    return _per_pair(pairs, both, value, "distance")


def jaccard(pairs: DataFrame, rows: DataFrame, **cols) -> DataFrame:
    """Bags: 1 - sum(min) / (sum of both), so equal bags are 0.5 apart."""
    value = 1 - F.sum(F.least("wa", "wb")) / F.sum(F.col("wa") + F.col("wb"))
    return _per_pair(pairs, aligned(pairs, rows, **cols), value, "distance")


def jaccard_set(pairs: DataFrame, rows: DataFrame, **cols) -> DataFrame:
    """Sets: 1 - |intersection| / |union|."""
    both_in = F.sum(((F.col("wa") != 0) & (F.col("wb") != 0)).cast("double"))
    return _per_pair(pairs, aligned(pairs, rows, **cols), 1 - both_in / F.count("*"), "distance")


# ---------------------------------------------------------------- word vectors
def vector_mean(rows: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """Mean vector per group; partial sums are formed before the shuffle."""
    return rows.groupBy(*by).agg(Summarizer.mean(array_to_vector(vx.as_double(F.col(vector)))).alias("_m")).select(
        *by, vector_to_array("_m").alias(vector))


def vector_sum(rows: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    return rows.groupBy(*by).agg(Summarizer.sum(array_to_vector(vx.as_double(F.col(vector)))).alias("_m")).select(
        *by, vector_to_array("_m").alias(vector))


def word_similarity(pairs: DataFrame, embedding: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """Cosine of the two words of every pair; pairs with an unknown word drop out."""
    e = embedding.select(F.col(word).alias("_w"), vx.unit(vx.as_double(F.col(vector))).alias("_v"))
    left = pairs.join(e, pairs.a == e._w).drop("_w").withColumnRenamed("_v", "_va")
    both = left.join(e, left.b == e._w).drop("_w")
    return both.withColumn("similarity", vx.dot(F.col("_va"), F.col("_v"))).drop("_va", "_v")


def n_similarity(sets: DataFrame, embedding: DataFrame, word: str = "word", vector: str = "vector") -> DataFrame:
    """Cosine between the mean vectors of side 'a' and side 'b' of each `pair_id`; `sets(pair_id, side, word)`."""
    e = embedding.select(F.col(word).alias("word"), vx.as_double(F.col(vector)).alias("vector"))
    means = vector_mean(sets.join(e, "word"), ["pair_id", "side"])
    a = means.filter("side = 'a'").select("pair_id", F.col("vector").alias("_a"))
    b = means.filter("side = 'b'").select("pair_id", F.col("vector").alias("_b"))
    return a.join(b, "pair_id").select(
        "pair_id", vx.dot(vx.unit(F.col("_a")), vx.unit(F.col("_b"))).alias("similarity"))


def relaxed_wmd(pairs: DataFrame, counted: DataFrame, embedding: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Lower bound of the word mover's distance: every word moves to its nearest word of the other document.

    `counted(doc_id, word, tf)`; unknown words drop out, an empty side gives infinity, and the larger of the two
    directions is kept. Each document is packed once; distances are formed inside Arrow batches, so no
    word-by-word rows are ever emitted.
    """
    known = counted.join(embedding.select("word", vx.as_double(F.col("vector")).alias("vector")), "word")
    packed = known.groupBy(doc_id).agg(F.collect_list(F.struct(F.col("tf").cast("double").alias("n"), "vector")).alias("_b"))
    packed = packed.select(F.col(doc_id).alias("_id"), F.col("_b.n").alias("_n"), F.flatten("_b.vector").alias("_f"))
    one = pairs.join(packed, pairs.a == F.col("_id"), "left").select("a", "b", F.col("_n").alias("_na"), F.col("_f").alias("_fa"))
    both = one.join(packed, one.b == F.col("_id"), "left").select("a", "b", "_na", "_fa", "_n", "_f")

    def bound(na, fa, nb, fb) -> float:
        if na is None or nb is None:
            return float("inf")
        x, y = np.asarray(fa).reshape(len(na), -1), np.asarray(fb).reshape(len(nb), -1)
        near_x, near_y = np.full(len(x), np.inf), np.full(len(y), np.inf)
        for at in range(0, len(x), 512):
            for to in range(0, len(y), 512):  # blocks of differences: exact near zero, of bounded size
                d = np.sqrt(((x[at:at + 512, None, :] - y[None, to:to + 512, :]) ** 2).sum(-1))
                near_x[at:at + 512] = np.minimum(near_x[at:at + 512], d.min(1))
                near_y[to:to + 512] = np.minimum(near_y[to:to + 512], d.min(0))
        return float(max((near_x * (na / np.sum(na))).sum(), (near_y * (nb / np.sum(nb))).sum()))

    def distances(batch_na: pd.Series, batch_fa: pd.Series, batch_nb: pd.Series, batch_fb: pd.Series) -> pd.Series:
        return pd.Series([bound(*t) for t in zip(batch_na, batch_fa, batch_nb, batch_fb)], dtype="float64")

    d = F.pandas_udf(distances, "double")("_na", "_fa", "_n", "_f")
    return both.select("a", "b", d.alias("distance")).withColumn("similarity", 1 / (1 + F.col("distance")))
