"""Embedding evaluation: similarity, analogies, relations, clustering, outliers, classification."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.functions import vectors as vx
from vectorloom.operators.distance import vector_mean, vector_sum
from vectorloom.operators.search import _matrix, _units, _without_inputs, top_k
from vectorloom.operators.weight import hashed_split
from vectorloom.runtime import cut, hash01, running_total

DIGITS = 6


# ---------------------------------------------------------------- rank correlation
def _average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Tie-averaged ranks over the whole table, from counts per distinct value and a two-level prefix sum."""
    counts = rows.groupBy(value).agg(F.count("*").alias("_n"))
    upto = running_total(counts, [F.col(value)], "_n", "_upto")
    ranks = upto.select(F.col(value), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return rows.join(ranks, value)


def spearman(rows: DataFrame, x: str, y: str, by: list[str] | None = None, name: str = "correlation") -> DataFrame:
    """Spearman correlation of two columns, per group or over everything."""
    rows = rows.withColumn(x, F.round(x, DIGITS)).withColumn(y, F.round(y, DIGITS))
    if not by:
        ranked = _average_ranks(_average_ranks(rows, x, "_rx"), y, "_ry")
        return ranked.agg(F.corr("_rx", "_ry").alias(name))

    def rank(c):
        tied = F.count("*").over(W.partitionBy(*by, c))
        return F.rank().over(W.partitionBy(*by).orderBy(c)) + (tied - 1) / 2

    return rows.withColumn("_rx", rank(x)).withColumn("_ry", rank(y)).groupBy(*by).agg(F.corr("_rx", "_ry").alias(name))


def _lookup(embedding: DataFrame, name: str, on: str, word: str = "word", vector: str = "vector") -> DataFrame:
    return embedding.select(F.col(word).alias(on), vx.as_double(F.col(vector)).alias(name))


def _mean_row(embedding: DataFrame, vector: str = "vector") -> DataFrame:
    return vector_mean(embedding.select(F.lit(0).alias("_g"), vector), ["_g"], vector).select(F.col(vector).alias("_mean"))


def eval_similarity(pairs: DataFrame, embedding: DataFrame, missing: str = "mean") -> DataFrame:
    """Spearman between dot products and human scores; unknown words get the mean vector, or their pair is dropped."""
    how = "left" if missing == "mean" else "inner"
    both = pairs.join(_lookup(embedding, "_a", "w1"), "w1", how).join(_lookup(embedding, "_b", "w2"), "w2", how)
    if missing == "mean":
        both = both.join(F.broadcast(_mean_row(embedding)))  # one row
        both = both.withColumn("_a", F.coalesce("_a", "_mean")).withColumn("_b", F.coalesce("_b", "_mean"))
    return spearman(both.select(vx.dot(F.col("_a"), F.col("_b")).alias("_s"), F.col("score").cast("double").alias("_h")), "_s", "_h")


# ---------------------------------------------------------------- analogies
def _question_vectors(questions: DataFrame, embedding: DataFrame, unit: bool, missing: str) -> DataFrame:
    e = embedding.withColumn("vector", vx.unit(vx.as_double(F.col("vector")))) if unit else embedding
    how = "left" if missing == "mean" else "inner"
    out = questions
    for role in "abc":
        out = out.join(_lookup(e, f"_{role}", role), role, how)
    if missing == "mean":
        out = out.join(F.broadcast(_mean_row(e)))  # one row
        for role in "abc":
            out = out.withColumn(f"_{role}", F.coalesce(f"_{role}", "_mean"))
        out = out.drop("_mean")
    return out


def predict_analogies(questions: DataFrame, embedding: DataFrame, method: str = "add", k: int | None = None,
                      exclude_inputs: bool = True, unit: bool = False, missing: str = "mean") -> DataFrame:
    """(query_id, predicted): the word maximising w.(b-a+c) or log-3CosMul, inputs excluded unless told otherwise."""
    index = embedding if k is None else embedding.filter(F.col("idx") < k)
    vectors = _question_vectors(questions, index, unit, missing).select("query_id", "_a", "_b", "_c")

    def prepare(q: pd.DataFrame):
        a, b, c = (_matrix(q[f"_{r}"]) for r in "abc")

        def score(batch: pd.DataFrame) -> np.ndarray:
            m = _matrix(batch["vector"])
            m = _units(m) if unit else m
            if method == "add":
                return (b - a + c) @ m.T
            la, lb, lc = (np.log((1 + x @ m.T) / 2 + 1e-5) for x in (a, b, c))
            return lb - la + lc

        return score

    hits = top_k(vectors, index.select(F.col("word").alias("hit"), "vector"), prepare, 4 if exclude_inputs else 1,
                 "query_id", "hit")
    if exclude_inputs:
        inputs = questions.select("query_id", F.explode(F.array("a", "b", "c")).alias("word"))
        hits = _without_inputs(hits, inputs, 1)
    return hits.select("query_id", F.col("hit_id").alias("predicted"))


def _accuracy(judged: DataFrame, by: str, total: str = "all") -> DataFrame:
    return judged.rollup(by).agg(
        F.avg(F.col("ok").cast("double")).alias("accuracy"), F.sum(F.col("ok").cast("long")).alias("correct"),
        F.count("*").alias("count")).withColumn(by, F.coalesce(by, F.lit(total)))


def judge(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    return questions.join(predictions, "query_id", "left").withColumn(
        "ok", F.coalesce(F.col("predicted") == F.col("answer"), F.lit(False)))


def eval_analogy(questions: DataFrame, embedding: DataFrame, method: str = "add", k: int | None = None) -> DataFrame:
    """Accuracy, correct and count per category and for 'all'."""
    return _accuracy(judge(questions, predict_analogies(questions, embedding, method, k)), "category")


def accuracy(questions: DataFrame, embedding: DataFrame, restrict_vocab: int = 30_000, case_insensitive: bool = True) -> DataFrame:
    """Sectioned analogy accuracy over the most frequent words; questions with an unknown word are skipped.

    With case_insensitive, words meet in upper case and the most frequent variant lends its vector.
    """
    known = embedding.filter(F.col("idx") < restrict_vocab)
    q = questions
    if case_insensitive:
        known = known.groupBy(F.upper("word").alias("word")).agg(F.min_by(F.struct("idx", "vector"), "idx").alias("_v")).select(
            "word", "_v.idx", "_v.vector")
        q = q.select("query_id", *[F.upper(c).alias(c) for c in ("a", "b", "c", "answer")], "category")
    q = q.join(known.select(F.col("word").alias("answer")), "answer", "left_semi")
    for role in "abc":
        q = q.join(known.select(F.col("word").alias(role)), role, "left_semi")
    return _accuracy(judge(q, predict_analogies(q, known, "add", unit=True, missing="drop")), "category", "total")


def deterministic_analogies(questions: DataFrame, embedding: DataFrame) -> DataFrame:
    """Repeated questions once; answer may be an input word; accuracy per high-level category."""
    q = questions.dropDuplicates(["a", "b", "c", "answer"])
    return _accuracy(judge(q, predict_analogies(q, embedding, exclude_inputs=False, unit=True, missing="drop")), "category")


def eval_wordrep(pairs: DataFrame, embedding: DataFrame, max_pairs: int = 1000, groups: DataFrame | None = None) -> DataFrame:
    """Every ordered pair of two word pairs of a category is one analogy; `pairs(category, pos, left, right)`.

    The report is defined over pair combinations; `max_pairs` per category bounds them (max_pairs^2 questions).
    """
    kept = pairs.filter(F.col("pos") < max_pairs)
    other = kept.select("category", F.col("pos").alias("_p"), F.col("left").alias("c"), F.col("right").alias("answer"))
    q = kept.join(other, "category").filter(F.col("pos") != F.col("_p")).select(
        F.struct("category", "pos", "_p").alias("query_id"), F.col("left").alias("a"), F.col("right").alias("b"), "c", "answer", "category")
    q = q.withColumn("query_id", F.concat_ws("|", "category", F.col("query_id.pos"), F.col("query_id._p")))
    judged = cut(judge(q, predict_analogies(q, embedding)))
    out = _accuracy(judged, "category")
    if groups is not None:
        out = out.unionByName(_accuracy(judged.join(groups, "category"), "family").filter("family <> 'all'").withColumnRenamed("family", "category"))
    return out


def eval_semeval_relations(prototypes: DataFrame, questions: DataFrame, embedding: DataFrame) -> DataFrame:
    """Spearman of (mean left - mean right of the prototypes).(left - right) with the score, per category.

    `prototypes(category, left, right)`, `questions(category, family, left, right, score)`; result per family and 'all'.
    """
    mean = F.broadcast(_mean_row(embedding))  # one row

    def both(df):
        out = df.join(_lookup(embedding, "_l", "left"), "left", "left").join(_lookup(embedding, "_r", "right"), "right", "left").join(mean)
        return out.withColumn("_d", F.zip_with(F.coalesce("_l", "_mean"), F.coalesce("_r", "_mean"), lambda x, y: x - y))

    direction = vector_mean(both(prototypes).select("category", "_d"), ["category"], "_d").withColumnRenamed("_d", "_p")
    scored = both(questions).join(direction, "category").select(
        "category", "family", vx.dot(F.col("_p"), F.col("_d")).alias("_s"), F.col("score").cast("double").alias("_h"))
    cors = spearman(scored, "_s", "_h", ["category", "family"]).withColumn(
        "correlation", F.when(F.isnan("correlation") | F.col("correlation").isNull(), 0.0).otherwise(F.col("correlation")))
    return cors.rollup("family").agg(F.avg("correlation").alias("correlation")).withColumn(
        "family", F.coalesce("family", F.lit("all")))


# ---------------------------------------------------------------- clustering
def purity(rows: DataFrame, truth: str, cluster: str) -> DataFrame:
    """Share of items that belong to the majority class of their cluster."""
    sizes = rows.groupBy(cluster, truth).agg(F.count("*").alias("_n"))
    best = sizes.groupBy(cluster).agg(F.max("_n").alias("_m"), F.sum("_n").alias("_t"))
    return best.agg((F.sum("_m") / F.sum("_t")).alias("purity"))


def eval_categorization(rows: DataFrame, truth: str = "label", vector: str = "vector", seeds: int = 3) -> DataFrame:
    """Best purity over seeded k-means and bisecting k-means with one cluster per class."""
    data = cut(rows.select(F.col(truth).alias("truth"), array_to_vector(vx.as_double(F.col(vector))).alias("features")))
    k = data.select("truth").distinct().count()
    parts = []
    for algorithm, name in ((KMeans, "kmeans"), (BisectingKMeans, "bisecting")):
        for seed in range(seeds):
            model = algorithm(k=k, seed=seed, maxIter=20).fit(data)
            parts.append(purity(model.transform(data), "truth", "prediction").select(
                F.lit(name).alias("method"), F.lit(seed).alias("seed"), "purity"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---------------------------------------------------------------- outliers
def outlier_positions(groups: DataFrame, embedding: DataFrame, n: int = 2) -> DataFrame:
    """(group_id, outlier, op, size): rank of each outlier among the cluster by compactness.

    `groups(group_id, pos, word, is_outlier)`. With unit vectors and S their sum over the cluster of size m, the
    pair sums have closed forms: all pairs = (|S|^2 - m)/2 and, without item i, (|S - v_i|^2 - (m-1))/2, so no
    pair is formed. n=3 uses triples and runs inside the (small, fixed-size) test group.
    """
    known = groups.join(_lookup(embedding, "v", "word"), "word")
    if n == 3:
        return _outlier_triples(known)
    known = known.withColumn("v", vx.unit(F.col("v")))
    cluster, outliers = known.filter("not is_outlier"), known.filter("is_outlier")
    sums = vector_sum(cluster, ["group_id"], "v").withColumnRenamed("v", "s").join(
        cluster.groupBy("group_id").agg(F.count("*").alias("m")), "group_id").filter(F.col("m") >= n)
    rest = F.zip_with("s", "v", lambda x, y: x - y)
    items = cluster.join(sums, "group_id").select(
        "group_id", "pos", "m", rest.alias("rest")).withColumn("inner", (vx.dot(F.col("rest"), F.col("rest")) - (F.col("m") - 1)) / 2)
    out = outliers.join(sums, "group_id").select(
        "group_id", F.col("word").alias("outlier"), F.col("v").alias("o"),
        F.round((vx.dot(F.col("s"), F.col("s")) - F.col("m")) / 2, DIGITS).alias("own"))
    scored = out.join(items, "group_id").withColumn(
        "c", F.round(F.col("inner") + vx.dot(F.col("rest"), F.col("o")), DIGITS))
    return scored.groupBy("group_id", "outlier").agg(
        F.sum((F.col("c") < F.col("own")).cast("long")).alias("op"), F.max("m").alias("size"))


def _outlier_triples(known: DataFrame) -> DataFrame:
    def closeness(a, b, c):
        centre = (a + b + c) / 3
        d = sum(np.linalg.norm(centre - x, axis=-1) for x in (a, b, c)) / 3
        return np.where(d == 0, 1e5, 1 / np.where(d == 0, 1, d))

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        c = pdf[~pdf["is_outlier"]]
        o = pdf[pdf["is_outlier"]]
        rows = []
        if len(c) >= 3 and len(o):
            v = np.stack(c["v"].to_list())
            m = len(v)
            triples = np.array(list(itertools.combinations(range(m), 3)))
            pairs = np.array(list(itertools.combinations(range(m), 2)))
            inside = closeness(v[triples[:, 0]], v[triples[:, 1]], v[triples[:, 2]])
            own = round(float(inside.sum()), DIGITS)
            for word, vec in zip(o["word"], o["v"]):
                across = closeness(v[pairs[:, 0]], v[pairs[:, 1]], np.asarray(vec))
                scores = [round(float(inside[(triples != i).all(1)].sum() + across[(pairs != i).all(1)].sum()), DIGITS) for i in range(m)]
                rows.append((c["group_id"].iloc[0], word, sum(s < own for s in scores), m))
        return pd.DataFrame(rows, columns=["group_id", "outlier", "op", "size"])

    gid = known.schema["group_id"].dataType.simpleString()
    return known.groupBy("group_id").applyInPandas(group, f"group_id {gid}, outlier string, op long, size long")


def eval_outliers(groups: DataFrame, embedding: DataFrame, n: int = 2) -> DataFrame:
    """One row: OPP, accuracy and the shares of filtered items and groups, all in percent."""
    cases = outlier_positions(groups, embedding, n).agg(
        (F.avg(F.col("op") / F.col("size")) * 100).alias("opp"),
        (F.avg((F.col("op") == F.col("size")).cast("double")) * 100).alias("accuracy"), F.count("*").alias("cases"))
    marked = groups.join(embedding.select("word", F.lit(1).alias("_known")), "word", "left")
    missing = F.col("_known").isNull().cast("double")
    per_group = marked.groupBy("group_id").agg(
        F.avg(F.when(~F.col("is_outlier"), missing)).alias("_c"), F.avg(F.when(F.col("is_outlier"), missing)).alias("_o"),
        F.sum((~F.col("is_outlier") & F.col("_known").isNotNull()).cast("int")).alias("_nc"),
        F.sum((F.col("is_outlier") & F.col("_known").isNotNull()).cast("int")).alias("_no"))
    filtered = per_group.agg(
        (F.avg("_c") * 100).alias("filtered_cluster_items"), (F.avg("_o") * 100).alias("filtered_outliers"),
        (F.avg(((F.col("_nc") < n) | (F.col("_no") < 1)).cast("double")) * 100).alias("filtered_groups"))
    return cases.join(F.broadcast(filtered))  # one row


# ---------------------------------------------------------------- classification
def _classify(train: DataFrame, test: DataFrame, label: str, reg: float = 0.0) -> float:
    model = LogisticRegression(labelCol=label, featuresCol="features", maxIter=50, regParam=reg).fit(train)
    return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(model.transform(test))


def eval_word_classification(rows: DataFrame, key: str, label: str = "label", vector: str = "vector",
                             shares: tuple = (0.1, 0.3, 0.5, 1.0), seed: int = 0, normalize: bool = False) -> DataFrame:
    """Accuracy of logistic regression on vectors for several shares of an 85/15 hashed split."""
    v = vx.as_double(F.col(vector))
    data = cut(rows.select(key, F.col(label).cast("double").alias("label"),
                           array_to_vector(vx.unit(v) if normalize else v).alias("features")))
    train, test = hashed_split(data, [key], 0.85, seed)
    scores = []
    for share in shares:
        part, _ = hashed_split(train, [key], share, seed + 1) if share < 1 else (train, None)
        scores.append((float(share), _classify(part, test, "label")))
    return rows.sparkSession.createDataFrame(scores, "train_share double, accuracy double")


def eval_sentiment(doc_vectors: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", seed: int = 0) -> DataFrame:
    """Documents as summed word vectors, judged by logistic regression on a hashed split."""
    return eval_word_classification(doc_vectors.join(labels, key), key, label, shares=(1.0,), seed=seed)


# ---------------------------------------------------------------- learned analogies
def fit_analogy_map(questions: DataFrame, embedding: DataFrame, steps: int = 20, rate: float = 0.05, reg: float = 1e-3,
                    multiplicative: bool = False, seed: int = 0):
    """Matrices W1, W2, W3 and offset b so that unit(-W1 a + W2 b + W3 c + offset) is near the answer (or the product form).

    Each step sums gradients over partitions; only the 3 d*d + d parameters live on the driver. Returns (W1, W2, W3, b, losses).
    """
    v = _question_vectors(questions, embedding, True, "drop").join(_lookup(
        embedding.withColumn("vector", vx.unit(vx.as_double(F.col("vector")))), "_y", "answer"), "answer")
    data = cut(v.select("_a", "_b", "_c", "_y"))
    first = data.first()
    if first is None:
        raise ValueError("no question has all four words in the embedding")
    d = len(first["_a"])
    w = [np.eye(d) for _ in range(3)]
    b = np.random.default_rng(seed).uniform(-1, 1, d) * (0 if multiplicative else 0.01)
    params = np.concatenate([*(m.ravel() for m in w), b])
    mom, vel, losses = np.zeros_like(params), np.zeros_like(params), []

    def unpack(p):
        return p[:d * d].reshape(d, d), p[d * d:2 * d * d].reshape(d, d), p[2 * d * d:3 * d * d].reshape(d, d), p[3 * d * d:]

    def gradients(current):
        w1, w2, w3, off = unpack(current)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, count, grad = 0.0, 0, np.zeros(len(current))
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                a, bb, c, y = (_matrix(pdf[k]) for k in ("_a", "_b", "_c", "_y"))
                p1, p2, p3 = a @ w1.T, bb @ w2.T, c @ w3.T
                raw = p1 * p2 * p3 if multiplicative else -p1 + p2 + p3 + off
                norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
                u = raw / norm
                diff = u - y
                loss += float((diff ** 2).sum())
                count += len(pdf)
                g = 2 * (diff - u * (diff * u).sum(1, keepdims=True)) / norm
                parts = (g * p2 * p3, g * p1 * p3, g * p1 * p2) if multiplicative else (-g, g, g)
                grad += np.concatenate([*((p.T @ x).ravel() for p, x in zip(parts, (a, bb, c))),
                                        np.zeros(d) if multiplicative else g.sum(0)])
            yield pd.DataFrame({"loss": [loss], "n": [count], "grad": [grad]})

        return run

    for step in range(1, steps + 1):
        rows = data.mapInPandas(gradients(params), "loss double, n long, grad array<double>")
        total = rows.agg(F.sum("loss"), F.sum("n")).first()
        grad = np.asarray(vector_sum(rows.select(F.lit(0).alias("g"), "grad"), ["g"], "grad").first()["grad"]) / total[1]
        grad[2 * d * d:3 * d * d] += reg * params[2 * d * d:3 * d * d]
        losses.append(total[0] / total[1])
        mom, vel = 0.9 * mom + 0.1 * grad, 0.999 * vel + 0.001 * grad ** 2
        params = params - rate * (mom / (1 - 0.9 ** step)) / (np.sqrt(vel / (1 - 0.999 ** step)) + 1e-8)
    return (*unpack(params), losses)


def learned_analogy(train: DataFrame, test: DataFrame, embedding: DataFrame, multiplicative: bool = False, **fit) -> DataFrame:
    """Accuracy per category of a fitted analogy map on held-out questions."""
    w1, w2, w3, off, _ = fit_analogy_map(train, embedding, multiplicative=multiplicative, **fit)
    vectors = _question_vectors(test, embedding, True, "drop").select("query_id", "_a", "_b", "_c")

    def prepare(q: pd.DataFrame):
        p1, p2, p3 = _matrix(q["_a"]) @ w1.T, _matrix(q["_b"]) @ w2.T, _matrix(q["_c"]) @ w3.T
        target = _units(p1 * p2 * p3 if multiplicative else -p1 + p2 + p3 + off)
        return lambda batch: target @ _matrix(batch["vector"]).T

    hits = top_k(vectors, embedding.select(F.col("word").alias("hit"), "vector"), prepare, 1, "query_id", "hit")
    return _accuracy(judge(test, hits.select("query_id", F.col("hit_id").alias("predicted"))), "category")


# ---------------------------------------------------------------- reports
def compare_embeddings(scores: DataFrame, methods: list[str]) -> DataFrame:
    """Metric by method table: mean and spread over seeds; `scores(metric, method, seed, value)`."""
    out = scores.groupBy("metric").pivot("method", methods).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out


def eval_all(embedding: DataFrame, similarity: DataFrame, questions: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row with every suite's headline number."""
    sim = eval_similarity(similarity, embedding).select(F.col("correlation").alias("similarity"))
    ana = eval_analogy(questions, embedding).filter("category = 'all'").select(F.col("accuracy").alias("analogy"))
    cat = eval_categorization(clusters, seeds=1).agg(F.max("purity").alias("categorization"))
    return sim.join(F.broadcast(ana)).join(F.broadcast(cat))  # one row each


def search_hyperparams(rows: DataFrame, key: str, label: str, vector: str = "vector", trials: int = 4, restarts: int = 2,
                       low: float = 1e-5, high: float = 1e-1, shares: tuple = (0.5, 1.0), seed: int = 0) -> DataFrame:
    """Log-uniform regularisation strengths, each scored as the mean over restarts and training shares, best first."""
    data = cut(rows.select(key, F.col(label).cast("double").alias("label"), array_to_vector(vx.as_double(F.col(vector))).alias("features")))
    rng = np.random.default_rng(seed)
    out = []
    for reg in np.exp(rng.uniform(math.log(low), math.log(high), trials)):
        scores = []
        for restart in range(restarts):
            train, test = hashed_split(data, [key], 0.85, seed + restart)
            for share in shares:
                part = train if share >= 1 else hashed_split(train, [key], share, seed + 100 + restart)[0]
                scores.append(_classify(part, test, "label", float(reg)))
        out.append((float(reg), float(np.mean(scores))))
    return rows.sparkSession.createDataFrame(sorted(out, key=lambda t: -t[1]), "reg double, accuracy double")


def human_similarity_correlation(model_pairs: DataFrame, human_pairs: DataFrame) -> DataFrame:
    """Pearson correlation of model and human similarity over the same document pairs."""
    return model_pairs.join(human_pairs, ["a", "b"]).agg(F.corr("similarity", "human").alias("correlation"))


def hashed_draw(rows: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Stable shuffle key for seeded orders."""
    return rows.withColumn("draw", hash01(*[F.col(k) for k in keys], seed=seed))
