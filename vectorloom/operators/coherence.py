"""Topic coherence: segmentation, probability estimation, confirmation, aggregation.

`topics(topic, rank, token)` lists each topic's top words from rank 0. All counting looks only at occurrences
of those words, and word windows are handled as intervals, so nothing grows with the window size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON = 1e-12
# measure -> (segmentation, estimation, default window, confirmation)
PIPELINES = {
    "u_mass": ("one_pre", "document", None, "log_conditional"),
    "c_v": ("one_set", "window", 110, "indirect_cosine"),
    "c_uci": ("one_one", "window", 10, "log_ratio"),
    "c_npmi": ("one_one", "window", 10, "normalized_log_ratio"),
}


# ---------------------------------------------------------------- segmentation
def _sides(topics: DataFrame):
    a = topics.select("topic", F.col("rank").alias("_ra"), F.col("token").alias("w_prime"))
    b = topics.select("topic", F.col("rank").alias("_rb"), F.col("token").alias("w_star"))
    return a.join(b, "topic")  # a topic has a fixed, small number of top words


def segment_one_pre(topics: DataFrame) -> DataFrame:
    return _sides(topics).filter("_ra > _rb").select("topic", "w_prime", "w_star")


def segment_one_one(topics: DataFrame) -> DataFrame:
    return _sides(topics).filter("_ra <> _rb").select("topic", "w_prime", "w_star")


def segment_one_set(topics: DataFrame) -> DataFrame:
    """(word, word of the set) rows; the set is the whole topic."""
    return _sides(topics).select("topic", "w_prime", "w_star")


# ---------------------------------------------------------------- probability estimation
def _top_words(topics: DataFrame) -> DataFrame:
    return topics.select("token").distinct()


def _occurrences(docs: DataFrame, words: DataFrame, doc_id: str, tokens: str) -> DataFrame:
    at = docs.select(doc_id, F.size(tokens).alias("_len"), F.posexplode(tokens).alias("pos", "token"))
    return at.join(F.broadcast(words), "token", "left_semi")  # top words of the topics: topics * topn rows


def document_units(docs: DataFrame, topics: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens"):
    """Interval form of Boolean document probability: one unit per document."""
    occ = _occurrences(docs, _top_words(topics), doc_id, tokens)
    units = occ.groupBy(doc_id, "token").agg(F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    return units, docs.agg(F.count("*").cast("double").alias("n_units"))


def window_units(docs: DataFrame, topics: DataFrame, window: int, doc_id: str = "doc_id", tokens: str = "tokens"):
    """A word at position p lies in windows max(0,p-w+1) .. min(p, L-w); a document has max(1, L-w+1) windows."""
    occ = _occurrences(docs, _top_words(topics), doc_id, tokens)
    last = F.greatest(F.col("_len") - window, F.lit(0))
    units = occ.select(doc_id, "token", F.greatest(F.col("pos") - window + 1, F.lit(0)).alias("lo"),
                       F.least(F.col("pos"), last).alias("hi"))
    total = docs.agg(F.sum(F.greatest(F.size(tokens) - window + 1, F.lit(1))).cast("double").alias("n_units"))
    return units, total


def _covered(units: DataFrame, by: list[str], doc_id: str) -> DataFrame:
    """Number of units covered by the union of intervals per `by`, summed over documents."""
    before = F.max("hi").over(W.partitionBy(*by, doc_id).orderBy("hi", "lo").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.col("hi") - F.greatest(F.col("lo"), F.coalesce("_before", F.lit(-1)) + 1) + 1, F.lit(0))
    return units.withColumn("_before", before).withColumn("_n", fresh).groupBy(*by).agg(
        F.sum("_n").cast("double").alias("n"))


def unit_counts(units: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(token, n): units that hold the word."""
    return _covered(units, ["token"], doc_id)


def pair_counts(units: DataFrame, pairs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(w_prime, w_star, n_prime, n_star, n_both) for distinct pairs.

    Units with both words = units of one + units of the other - units of either, where the last is again a
    union of intervals.
    """
    wanted = pairs.select("w_prime", "w_star").distinct()
    single = unit_counts(units, doc_id)
    member = wanted.select("w_prime", "w_star", F.explode(F.array_distinct(F.array("w_prime", "w_star"))).alias("token"))
    either = _covered(units.join(F.broadcast(member), "token"), ["w_prime", "w_star"], doc_id)  # topics * topn^2 rows
    n1 = single.select(F.col("token").alias("w_prime"), F.col("n").alias("n_prime"))
    n2 = single.select(F.col("token").alias("w_star"), F.col("n").alias("n_star"))
    return (wanted.join(n1, "w_prime").join(n2, "w_star").join(either, ["w_prime", "w_star"])
            .select("w_prime", "w_star", "n_prime", "n_star",
                    F.when(F.col("w_prime") == F.col("w_star"), F.col("n_prime"))
                    .otherwise(F.col("n_prime") + F.col("n_star") - F.col("n")).alias("n_both")))


# ---------------------------------------------------------------- confirmation
def log_conditional_probability(counts: DataFrame, total: DataFrame) -> DataFrame:
    value = F.log((F.col("n_both") / F.col("n_units") + EPSILON) / (F.col("n_star") / F.col("n_units")))
    return counts.join(F.broadcast(total)).select("w_prime", "w_star", value.alias("m"))  # one row


def log_ratio(counts: DataFrame, total: DataFrame, normalize: bool = False) -> DataFrame:
    n = F.col("n_units")
    joint = F.col("n_both") / n + EPSILON
    value = F.log(joint / ((F.col("n_prime") / n) * (F.col("n_star") / n)))
    value = value / -F.log(joint) if normalize else value
    return counts.join(F.broadcast(total)).select("w_prime", "w_star", value.alias("m"))  # one row


def indirect_cosine(topics: DataFrame, direct: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Cosine between each word's vector of confirmations with the topic's words and the sum of all those vectors."""
    cells = segment_one_set(topics).join(direct, ["w_prime", "w_star"]).select(
        "topic", "w_prime", "w_star", F.pow("m", F.lit(float(gamma))).alias("u"))
    whole = cells.groupBy("topic", "w_star").agg(F.sum("u").alias("s"))
    both = cells.join(whole, ["topic", "w_star"])
    dot, uu, ss = (F.sum(F.col(x) * F.col(y)) for x, y in (("u", "s"), ("u", "u"), ("s", "s")))
    return both.groupBy("topic", "w_prime").agg(
        F.when((uu > 0) & (ss > 0), dot / F.sqrt(uu) / F.sqrt(ss)).otherwise(0.0).alias("m"))


# ---------------------------------------------------------------- pipelines
def segment_scores(docs: DataFrame, topics: DataFrame, measure: str = "c_v", window: int | None = None,
                   doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """(topic, m): one row per segment."""
    segmentation, estimation, default, confirmation = PIPELINES[measure]
    if estimation == "document":
        units, total = document_units(docs, topics, doc_id, tokens)
    else:
        units, total = window_units(docs, topics, default if window is None else window, doc_id, tokens)
    segments = {"one_pre": segment_one_pre, "one_one": segment_one_one, "one_set": segment_one_set}[segmentation](topics)
    counts = pair_counts(units, segments, doc_id)
    if confirmation == "log_conditional":
        direct = log_conditional_probability(counts, total)
    else:
        direct = log_ratio(counts, total, normalize=confirmation != "log_ratio")
    if confirmation == "indirect_cosine":
        return indirect_cosine(topics, direct).select("topic", "m")
    return segments.join(direct, ["w_prime", "w_star"]).select("topic", "m")


def coherence_per_topic(docs: DataFrame, topics: DataFrame, measure: str = "c_v", window: int | None = None, **cols) -> DataFrame:
    return segment_scores(docs, topics, measure, window, **cols).groupBy("topic").agg(F.avg("m").alias("coherence"))


def coherence(docs: DataFrame, topics: DataFrame, measure: str = "c_v", window: int | None = None, **cols) -> DataFrame:
    """One row: the arithmetic mean over all segments of all topics."""
    return segment_scores(docs, topics, measure, window, **cols).agg(F.avg("m").alias("coherence"))


def top_topics(docs: DataFrame, topics: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """Sum over word pairs of ln((D(m,l)+1)/D(l)) per topic, best first."""
    units, _ = document_units(docs, topics, doc_id, tokens)
    segments = segment_one_pre(topics)
    scored = segments.join(pair_counts(units, segments, doc_id), ["w_prime", "w_star"])
    return (scored.groupBy("topic").agg(F.sum(F.log((F.col("n_both") + 1) / F.col("n_star"))).alias("score"))
            .orderBy(F.col("score").desc()))
