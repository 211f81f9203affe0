import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import distance as dist
from vectorloom.operators import phrases as ph
from vectorloom.operators import search as s
from vectorloom.operators import vocab as v
from vectorloom.operators import weight as w
from vectorloom.runtime import dense_ids, running_total


def test_vocab_goldens(spark, toy):
    vocab = v.build_vocab(toy)
    assert vocab.count() == 12
    assert v.corpus_stats(toy).first().asDict() == {"num_docs": 9, "num_pos": 29, "num_nnz": 28}
    kept = v.filter_extremes(vocab, toy, 2, 1.0, 4)
    assert kept.count() == 4 and {r["df"] for r in kept.collect()} == {3}
    rest = v.filter_n_most_frequent(vocab, 4)
    assert rest.count() == 8 and {r["df"] for r in rest.collect()} == {2}
    assert sorted(r["term_id"] for r in rest.collect()) == list(range(8))


def test_hash_ids(spark, toy):
    want = {"computer": 10608, "eps": 31049, "graph": 18451, "human": 31002, "interface": 12466, "response": 5232,
            "system": 5798, "time": 29104, "trees": 23844, "user": 12736}
    got = {r["token"]: r["term_id"] for r in v.hash_vocab(toy).collect()}
    assert {k: got[k] for k in want} == want


def test_tfidf_and_entropy(spark, toy):
    out = w.tfidf(v.token_runs(toy), v.token_counts(toy), 9, key="token").filter("doc_id = 0").collect()
    assert [round(r["weight"], 9) for r in out] == [0.57735027] * 3 or all(abs(r["weight"] - 0.577350269) < 1e-8 for r in out)
    triples = [(0, 0, 1), (0, 1, 3), (0, 3, 5), (1, 1, 2), (1, 2, 1), (1, 4, 4), (2, 0, 2), (2, 1, 2), (2, 2, 8), (2, 3, 1), (2, 4, 2)]
    bow = spark.createDataFrame(triples, "doc_id long, term_id long, tf long")
    got = {r["term_id"]: r["weight"] for r in w.log_entropy(bow, 3, normed=False).filter("doc_id = 0").collect()}
    for k, x in {0: 0.3748900964, 1: 0.3073021532, 3: 1.2094175546}.items():
        assert abs(got[k] - x) < 1e-9


def test_similarity_golden(spark, toy):
    index = s.index_documents(v.token_runs(toy).select("doc_id", "token", F.col("tf").cast("double").alias("weight")), key="token")
    got = [(r["hit_id"], r["score"]) for r in s.similarity_by_id(index, 0, 10).orderBy("rank").collect()]
    assert got == [(0, 1.0), (2, 0.288675), (1, 0.235702), (3, 0.235702)]
    with pytest.raises(ValueError):
        s.similarity_by_id(index, 99, 3)


def test_block_path_equals_broadcast_path(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(90)]
    e = spark.createDataFrame(rows, "idx long, vector array<double>")
    q = e.select(F.col("idx").alias("q"), "vector")
    a = s.dense_similarity(q, e, 4, "q", "idx", drop_self=True)
    b = s.dense_similarity(q, e, 4, "q", "idx", drop_self=True, query_block=13, index_block=17)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_lsh_recall(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((20, 16))
    rows = [(i, [float(x) for x in base[i % 20] + 0.15 * rng.standard_normal(16)]) for i in range(300)]
    e = spark.createDataFrame(rows, "idx long, vector array<double>")
    q = e.select(F.col("idx").alias("q"), "vector")
    exact = {(r["query_id"], r["hit_id"]) for r in s.dense_similarity(q, e, 5, "q", "idx", drop_self=True).collect()}
    found = {(r["query_id"], r["hit_id"]) for r in s.approx_nearest(q, e, 5, "q", "idx", 16, drop_self=True).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_distance_goldens(spark):
    v1 = [(2, .1), (3, .4), (4, .1), (5, .1), (1, .1), (7, .2)]
    v2 = [(1, .1), (3, .8), (4, .1)]
    rows = spark.createDataFrame([("v1", t, p) for t, p in v1] + [("v2", t, p) for t, p in v2] +
                                 [("d1", i, p) for i, p in enumerate([.6, .1, .1, .2])] +
                                 [("d2", i, p) for i, p in enumerate([.2, .2, .1, .5])], "doc_id string, term_id int, weight double")
    pairs = spark.createDataFrame([("v1", "v2"), ("v2", "v1"), ("d1", "d2"), ("v1", "v1")], "a string, b string")
    short = {(r.a, r.b): r.distance for r in dist.hellinger(pairs, rows, keys="shorter").collect()}
    assert abs(short["v1", "v2"] - 0.185241936534) < 1e-9
    union = {(r.a, r.b): r.distance for r in dist.hellinger(pairs, rows).collect()}
    assert abs(union["d1", "d2"] - 0.309742984153) < 1e-9
    kl = {(r.a, r.b): r.divergence for r in dist.kullback_leibler(pairs, rows).collect()}
    assert abs(kl["v2", "v1"] - 0.55451775) < 1e-6 and kl["v1", "v2"] == math.inf
    assert {(r.a, r.b): r.distance for r in dist.jaccard(pairs, rows).collect()}["v1", "v1"] == pytest.approx(0.5)
    empty = spark.createDataFrame([("v1", "none")], "a string, b string")
    assert dist.cossim(empty, rows).first()["similarity"] == 0.0


def test_relaxed_wmd_invariants(spark):
    e = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [3.0, 4.0]), ("c", [6.0, 8.0])], "word string, vector array<double>")
    counted = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "c", 1), (3, "zz", 1)], "doc_id int, word string, tf long")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 1), (1, 3)], "a int, b int")
    got = {(r.a, r.b): r.distance for r in dist.relaxed_wmd(pairs, counted, e).collect()}
    assert got[1, 2] == pytest.approx(7.5) and got[2, 1] == pytest.approx(7.5) and got[1, 1] == 0 and got[1, 3] == math.inf


def test_phrases_golden(spark, toy):
    more = toy.unionByName(spark.createDataFrame([(9, "graph minors survey human interface".split())], toy.schema))
    found = ph.phrase_scores(more, ph.phrase_counts(more), 1, 1.0)
    got = {r["doc_id"]: r["tokens"] for r in ph.apply_phrases(more, found).collect()}
    assert got[1] == ["survey", "user", "computer", "system", "response_time"]
    assert len(got) == 10 and got[5] == ["trees"]


def test_greedy_runs(spark):
    docs = spark.createDataFrame([(0, list("aaaaab")), (1, list("ba")), (2, [])], "doc_id long, tokens array<string>")
    pairs = spark.createDataFrame([("a", "a")], "a string, b string")
    got = {r["doc_id"]: r["tokens"] for r in ph.apply_phrases(docs, pairs).collect()}
    assert got == {0: ["a_a", "a_a", "a", "b"], 1: ["b", "a"], 2: []}


def test_numbering_is_partition_invariant(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(1.0).alias("one"))
    for parts in (1, 7):
        df = rows.repartition(parts)
        assert all(r["n"] == r["x"] for r in dense_ids(df, [F.col("x")], "n").collect())
        assert all(r["t"] == r["x"] + 1 for r in running_total(df, [F.col("x")], "one", "t").collect())


def test_random_projection_keeps_norms(spark):
    rows = spark.createDataFrame([(d, t, 1.0) for d in range(5) for t in range(d * 10, d * 10 + 40)], "doc_id int, term_id int, weight double")
    norms = {r["doc_id"]: r["n"] for r in w.random_projection(rows, 64).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()}
    assert all(0.5 < n / 40 < 1.6 for n in norms.values())


def test_phrases_are_scanned_beside_their_documents(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, None if i == 7 else [f"w{x}" for x in rng.integers(0, 5, rng.integers(0, 30))]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, tokens array<string>").repartition(3, "doc_id")
    pairs = spark.createDataFrame([("w0", "w1"), ("w1", "w1"), ("w1", "w2"), ("w4", "w0"), ("w9", "w0")], "a string, b string")
    got = ph.apply_phrases(docs, pairs)
    accepted = ph._accepted_pairs(docs, pairs, "tokens").collect()
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the test's own repartition
    got = {r["doc_id"]: r["tokens"] for r in got.collect()}
    monkeypatch.setattr(ph, "SCAN_ROWS", 0)
    want = {r["doc_id"]: r["tokens"] for r in ph.apply_phrases(docs, pairs).collect()}
    assert got == want and any("w1_w2" in t for t in got.values() if t) and got[7] is None
    assert set(map(tuple, accepted)) == {(r["a"], r["b"]) for r in ph.accepted_positions(docs, pairs).collect()}


def test_phrase_lookup_takes_longest_known_stretches(spark):
    e = spark.createDataFrame([("new_york", [1.0, 0.0]), ("new", [9.0, 9.0]), ("york", [9.0, 9.0]), ("city", [0.0, 1.0]), ("a##", [4.0, 4.0])],
                              "word string, vector array<double>")
    q = spark.createDataFrame([(1, "New_York_of_City"), (2, "york"), (3, "x_y"), (4, "a12")], "phrase_id int, phrase string")
    got = {r["phrase_id"]: r["vector"] for r in s.phrase_lookup(q, e, mask_digits=True).collect()}
    assert got == {1: [0.5, 0.5], 2: [9.0, 9.0], 4: [4.0, 4.0]}
    parts = {r["phrase_id"]: r["vector"] for r in s.phrase_lookup(q, e, whole_phrases=False).collect()}
    assert parts[1] == pytest.approx([6.0, 19 / 3])


def test_divergence_without_mass(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", 3.0)], "doc_id long, term_id string, weight double")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 1), (3, 4)], "a long, b long")
    got = {(r.a, r.b): r.divergence for r in dist.kullback_leibler(pairs, rows).collect()}
    assert got[1, 2] == pytest.approx(0.5 * math.log(2) + 0.5 * math.log(2 / 3))
    assert math.isnan(got[1, 3]) and math.isnan(got[3, 1]) and (3, 4) not in got
    smooth = {(r.a, r.b): r.divergence for r in dist.kullback_leibler(pairs, rows, smooth=1.0).collect()}
    assert smooth[1, 2] == pytest.approx(0.5 * math.log(1.5) + 0.5 * math.log(0.75))
    assert smooth[1, 3] == pytest.approx(0) and smooth[3, 1] == pytest.approx(0)


def test_alignment_moves_documents_once(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "a", 1.0), (2, "b", 3.0)], "doc_id long, term_id string, weight double")
    pairs = spark.createDataFrame([(1, 2), (2, 2), (2, 3)], "a long, b long")
    got = {tuple(r) for r in dist.aligned(pairs, rows).collect()}
    assert got == {(1, 2, "a", 3.0, 1.0), (1, 2, "b", 0.0, 3.0), (2, 2, "a", 1.0, 1.0), (2, 2, "b", 3.0, 3.0), (2, 3, "a", 1.0, 0.0), (2, 3, "b", 3.0, 0.0)}
    adaptive, size = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = dist.kullback_leibler(pairs, rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    # pairs by a, pairs with one document by b, packed documents; the same exchange again for the partner
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 4


def test_report_rounds_as_c_does(spark):
    vectors = [("a", [1.0, 0.0]), ("b", [0.4795, (1 - 0.4795 ** 2) ** 0.5]), ("c", [-0.0001, -1.0])]
    e = spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(vectors)], "idx long, word string, vector array<double>")
    got = s.neighbour_report(e.filter("word = 'a'"), e, 2).first()["neighbours"]
    assert got == f"b:{0.4795:.3f} c:{-0.0001:.3f}" == "b:0.479 c:-0.000"
