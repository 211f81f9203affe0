import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.operators import cooc, evaluate as ev, factor as fa, spectral as sp, topics as tp, vocab as v, weight as w


def test_lsi_golden(spark, toy):
    vocab = v.build_vocab(toy)
    rows = v.doc2bow(toy, vocab).select("doc_id", "term_id", F.col("tf").cast("double").alias("weight"))
    terms, s = sp.lsi_fit(rows, 2)
    doc0 = sp.lsi_transform(rows, terms).filter("doc_id = 0").first()["vector"]
    np.testing.assert_allclose(np.abs(doc0), [0.6594664, 0.142115444], atol=1e-5)
    a = rows.groupBy("doc_id").pivot("term_id").sum("weight").fillna(0).toPandas().drop(columns="doc_id").to_numpy()
    np.testing.assert_allclose(s, np.linalg.svd(a, compute_uv=False)[:2], rtol=1e-6)
    first, second = rows.filter("doc_id < 5"), rows.filter("doc_id >= 5")
    _, merged = sp.lsi_merge(sp.lsi_fit(first, 9, clip=False, power_iterations=0), sp.lsi_fit(second, 9, clip=False, power_iterations=0), 2)
    np.testing.assert_allclose(merged, s, rtol=1e-4)


def planted(spark, modes, rank, n=12, seed=0):
    rng = np.random.default_rng(seed)
    u = rng.random((n, rank))
    rows = []
    for idx in np.ndindex(*(n,) * modes):
        if all(a < b for a, b in zip(idx, idx[1:])):
            rows.append((*map(int, idx), float(np.prod([u[i] for i in idx], axis=0).sum())))
    names = ", ".join(f"{m} long" for m in cooc.MODES[:modes])
    return spark.createDataFrame(rows, f"{names}, value double")


def test_symmetric_loss_falls(spark):
    _, losses = fa.cp_symmetric(planted(spark, 3, 2), 3, 4, rate=0.1)
    assert losses[-1] < 0.9 * losses[0]


def test_nonnegative_stays_nonnegative(spark):
    state, losses = fa.cp_symmetric(planted(spark, 2, 2), 3, 3, nonnegative=True, rate=0.1)
    assert losses[-1] < losses[0]
    assert state.select(F.min(F.array_min("vec"))).first()[0] >= 0


def test_joint_orders_share_a_factor(spark):
    state, losses = fa.cp_joint_symmetric([(planted(spark, 2, 2), 1.0), (planted(spark, 3, 2), 1.0)], 3, 3, rate=0.1)
    assert losses[-1] < losses[0] and {r["f"] for r in state.select("f").distinct().collect()} == {"U"}


@pytest.mark.parametrize("sequential", [True, False])
def test_als_recovers_a_planted_matrix(spark, sequential):
    rng = np.random.default_rng(1)
    a = rng.random((8, 2)) @ rng.random((2, 9))
    t = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(8) for j in range(9)], "i long, j long, value double")
    _, losses = fa.cp_als(t, 3, 3, sequential=sequential)
    assert losses[-1] < losses[0]


def test_glove_and_sgns(spark, toy):
    vocab = cooc.vocab_for(v.word_counts(toy, 1), 1)
    ids = cooc.to_ids(toy, vocab)
    _, g = fa.glove(cooc.count_with_context(cooc.context_windows(ids, 2, fixed_size=False)), 4, 3)
    assert g[-1] < g[0]
    _, s = fa.sgns(cooc.skipgram_pairs(ids, 2), vocab, 4, 3, negatives=2)
    assert s[-1] < s[0]
    _, c = fa.cbow(cooc.context_windows(ids, 2, fixed_size=False), vocab, 4, 3, negatives=2)
    assert c[-1] < c[0]


def test_negative_draws_follow_the_table(spark):
    counts = spark.createDataFrame([("a", 0, 1000), ("b", 1, 100), ("c", 2, 1)], "token string, term_id long, count long")
    rows = spark.range(4000).withColumnRenamed("id", "k")
    drawn = fa.draw_negatives(rows, ["k"], fa.sampling_spans(counts), 3)
    n = {r["negative"]: r["count"] for r in drawn.groupBy("negative").count().collect()}
    share = np.array([1000, 100, 1]) ** 0.75
    assert sum(n.values()) == 12000
    np.testing.assert_allclose([n[0] / 12000, n[1] / 12000], (share / share.sum())[:2], atol=0.02)


def test_online_lda_separates_topics(spark):
    docs = spark.createDataFrame([(i, ([0, 1, 2] if i % 2 else [3, 4, 5]), [5.0, 4.0, 3.0]) for i in range(40)],
                                 "doc_id long, ids array<int>, counts array<double>")
    model = tp.OnlineLda(2, 6, seed=3)
    for _ in range(4):
        model.update(docs)
    theta = {r["doc_id"]: int(np.argmax(r["theta"])) for r in model.transform(docs).collect()}
    assert len({theta[i] for i in range(0, 40, 2)}) == 1 and theta[0] != theta[1]
    assert abs(tp.digamma(np.array([1.0]))[0] + 0.5772156649) < 1e-10


def test_reconstruction_and_ppmi_svd(spark):
    t = cooc.symmetrize(planted(spark, 2, 2))
    e, c, rmse = sp.ppmi_svd(t, 4)
    assert rmse < t.agg(F.stddev("value")).first()[0] * 2 and e.count() == 12 and c.count() == 12


def test_purity_golden(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 2, 2, 3], [2, 2, 2, 2, 1])), "t int, c int")
    assert ev.purity(rows, "t", "c").first()[0] == pytest.approx(0.6)


def test_outliers(spark):
    rng = np.random.default_rng(2)
    centre = np.array([1.0, 0, 0, 0])
    words = [(f"w{i}", [float(x) for x in centre + 0.05 * rng.standard_normal(4)]) for i in range(8)] + [("out", [0.0, 0.0, 1.0, 0.0])]
    e = spark.createDataFrame(words, "word string, vector array<double>")
    groups = spark.createDataFrame([("g", i, w_, w_ == "out") for i, (w_, _) in enumerate(words)] + [("g", 20, "oov", False)],
                                   "group_id string, pos int, word string, is_outlier boolean")
    vec = {k: np.array(x) / np.linalg.norm(x) for k, x in words}
    c = [f"w{i}" for i in range(8)]

    def compact(names):
        return sum(vec[a] @ vec[b] for i, a in enumerate(names) for b in names[i + 1:])

    own = compact(c)
    op = sum(compact([x for x in c if x != i]) + sum(vec[x] @ vec["out"] for x in c if x != i) < own for i in c)
    for n in (2, 3):
        r = ev.outlier_positions(groups, e, n).first()
        assert r["size"] == 8 and (r["op"] == op if n == 2 else r["op"] == 8)
    s = ev.eval_outliers(groups, e).first()
    assert s["accuracy"] == 100.0 and s["filtered_cluster_items"] == pytest.approx(100 / 9)


def test_spearman_ties(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (4.0, 0.0)], "x double, y double")
    want = np.corrcoef([1, 2.5, 2.5, 4], [2, 3, 4, 1])[0, 1]
    assert ev.spearman(rows, "x", "y").first()[0] == pytest.approx(want)
    assert ev.spearman(rows.withColumn("g", F.lit(1)), "x", "y", ["g"]).first()["correlation"] == pytest.approx(want)


def test_learned_analogy_improves(spark):
    rng = np.random.default_rng(3)
    e = spark.createDataFrame([(f"w{i}", i, [float(x) for x in rng.standard_normal(5)]) for i in range(30)], "word string, idx long, vector array<double>")
    q = spark.createDataFrame([(i, f"w{i}", f"w{i + 1}", f"w{i + 2}", f"w{i + 3}", "c") for i in range(25)],
                              "query_id long, a string, b string, c string, answer string, category string")
    *_, losses = ev.fit_analogy_map(q, e, steps=3)
    assert losses[-1] < losses[0]


def test_hashed_split_is_stable(spark):
    rows = spark.range(1000)
    a = {r["id"] for r in w.hashed_split(rows.repartition(3), ["id"], 0.85)[0].collect()}
    b = {r["id"] for r in w.hashed_split(rows.repartition(8), ["id"], 0.85)[0].collect()}
    assert a == b and 800 < len(a) < 900


def test_inferred_vectors_ignore_unknown_words(spark):
    outputs = spark.createDataFrame([(3, [1.0, 0.0], 10), (7, [0.0, 1.0], 10)], "idx long, vector array<double>, count long")
    docs = spark.createDataFrame([(0, [5, 9]), (1, []), (2, [3, 3, 5]), (3, [3, 3])], "doc_id long, ids array<long>")
    got = {r["doc_id"]: np.array(r["vector"]) for r in fa.infer_vectors(docs, outputs, 2, noise=64).collect()}
    again = {r["doc_id"]: np.array(r["vector"]) for r in fa.infer_vectors(docs.repartition(3), outputs, 2, noise=64).collect()}
    assert all((got[i] == again[i]).all() for i in range(4))
    assert np.abs(got[0]).max() <= 0.25 and np.abs(got[1]).max() <= 0.25  # start vectors: nothing known to learn from
    known = spark.createDataFrame([(2, [3, 3])], docs.schema)
    assert (fa.infer_vectors(known, outputs, 2, noise=64).first()["vector"] == got[2]).all() and np.abs(got[2] - got[0]).max() > 0.01


def test_log_probability_of_far_vectors_is_finite(spark):
    pairs = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "doc_id int, target long, context long")
    words = spark.createDataFrame([(0, [1000.0])], "idx long, vector array<double>")
    contexts = spark.createDataFrame([(0, [-1.0]), (1, [1.0])], "idx long, vector array<double>")
    got = {r["doc_id"]: r["log_prob"] for r in fa.sentence_log_prob(pairs, words, contexts).collect()}
    assert got[0] == -1000.0 and got[1] == 0.0


def test_phrases_need_an_accepted_place(spark):
    from vectorloom.operators import phrases as ph

    docs = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(20)] + [(100 + i, [f"x{i}"]) for i in range(400)], "doc_id int, tokens array<string>")
    found = {(r["a"], r["b"]) for r in ph.phrase_scores(docs, ph.phrase_counts(docs), 1, 1.0).collect()}
    assert found == {("a", "b")}  # "b c" always follows an accepted pair


def test_document_batches_agree_with_single_documents():
    rng = np.random.default_rng(4)
    beta, alpha = rng.random((3, 20)), np.full(3, 0.3)
    ids = [rng.choice(20, n, replace=False) for n in (3, 7, 1)]
    counts = [rng.integers(1, 5, len(i)).astype(float) for i in ids]
    together, _, expected = tp._fit_documents(ids, counts, beta, alpha, 200, 1e-12)
    for at in range(3):
        alone, _, _ = tp._fit_documents(ids[at:at + 1], counts[at:at + 1], beta, alpha, 200, 1e-12)
        np.testing.assert_allclose(together[at], alone[0], rtol=1e-6)
    np.testing.assert_allclose(expected.sum(), sum(c.sum() for c in counts))


def test_lda_passes_visit_every_document_and_score_held_out_ones(spark):
    docs = spark.createDataFrame([(i, ([0, 1, 2] if i % 2 else [3, 4, 5]), [5.0, 4.0, 3.0]) for i in range(60)],
                                 "doc_id long, ids array<int>, counts array<double>")
    model = tp.lda_fit(docs.filter("doc_id < 50"), 6, 2, passes=3, seed=3)
    assert model.seen % 50 == 0
    bound, perplexity = tp.lda_perplexity(model, docs.filter("doc_id >= 50"))
    assert bound < 0 and 2 < perplexity < 6 and abs(perplexity - 2 ** -bound) < 1e-9


def test_distributed_memory_vectors(spark, toy):
    vocab = cooc.vocab_for(v.word_counts(toy, 1), 1)
    state, losses = fa.doc_vectors_dm(cooc.context_windows(cooc.to_ids(toy, vocab), 2, fixed_size=False), vocab, 4, 3, negatives=2)
    assert losses[-1] < losses[0]
    assert {r["doc_id"] for r in fa.document_table(state).collect()} == set(range(9))


def test_ids_are_looked_up_beside_the_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, ["x"]), (3, None), (4, []), (5, [None, "c"])], "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([("a", 7), ("b", 3), ("c", 0)], "token string, term_id long")
    found = cooc.to_ids(docs, vocab)
    assert {r.doc_id: r.ids for r in found.collect()} == {1: [3, 7, 3], 5: [0]}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(cooc, "LOOKUP_ROWS", 2)
    joined = cooc.to_ids(docs, vocab)
    assert {r.doc_id: r.ids for r in joined.collect()} == {1: [3, 7, 3], 5: [0]} and joined.dtypes == found.dtypes


def test_rare_tuples_go_before_the_joins(spark):
    counts = spark.createDataFrame([(0, 1, 9), (0, 2, 5), (1, 2, 8)], "i long, j long, count long")
    unigrams = spark.createDataFrame([(0, 20), (1, 20), (2, 20)], "term_id long, count long")
    plan = lambda **o: cooc.ppmi_tensor(counts, unigrams, **o)._jdf.queryExecution().optimizedPlan().toString()
    assert "> 5" in plan().split("Join")[-1] and "> 5" not in plan(shift=1.0).split("Join")[-1]
    values = {(r.i, r.j): r.value for r in cooc.ppmi_tensor(counts, unigrams).collect()}
    assert set(values) == {(0, 1), (1, 2)}
    assert {(r.i, r.j) for r in cooc.ppmi_tensor(counts, unigrams, shift=1.0).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_carried_vectors_are_added_up_in_place(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (2, 1, 3.0), (3, 9, 1.0), (4, None, 1.0)], "doc_id long, term_id long, weight double")
    vectors = spark.createDataFrame([(1, [0.0, 5.0]), (0, [1.0, 2.0])], "term_id long, vector array<double>")
    found = sp.carry(rows, vectors, "term_id", "doc_id")
    assert {r.doc_id: r.vector for r in found.collect()} == {1: [2.0, 9.0], 2: [0.0, 15.0]}
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(sp, "LOOKUP_ROWS", 1)
    assert {r.doc_id: r.vector for r in sp.carry(rows, vectors, "term_id", "doc_id").collect()} == {1: [2.0, 9.0], 2: [0.0, 15.0]}


def test_sentence_scores_exchange_sums_only(spark):
    pairs = spark.createDataFrame([(1, 0, 1), (1, 0, 1), (2, 1, 0), (3, 0, 9)], "doc_id long, target long, context long")
    e = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "idx long, vector array<double>")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = fa.sentence_log_prob(pairs, e, e)
        one = -np.log1p(np.exp(1.5))
        assert {r.doc_id: round(r.log_prob, 9) for r in found.collect()} == {1: round(2 * one, 9), 2: round(one, 9)}
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)


def test_combinations_of_a_chunk_leave_in_bounded_batches(spark, monkeypatch):
    import itertools

    monkeypatch.setattr(cooc, "COMBINED_ROWS", 4)
    chunks = spark.createDataFrame([([3, 1, 2, 1],), ([1, 2, 3],), ([5, 4, 3, 2, 1],), ([7, 8],)], "ids array<bigint>")
    want = {}
    for s in ([1, 2, 3], [1, 2, 3], [1, 2, 3, 4, 5]):
        for c in itertools.combinations(s, 3):
            want[c] = want.get(c, 0) + 1
    assert {tuple(r[:3]): r["count"] for r in cooc.ngram_cooccurrence(chunks, 3).collect()} == want


def test_cbow_gives_the_same_losses_in_any_number_of_cells(spark, toy, monkeypatch):
    vocab = cooc.vocab_for(v.word_counts(toy, 1), 1)
    windows = cooc.context_windows(cooc.to_ids(toy, vocab), 2, fixed_size=False)
    found = []
    for size in (100, 6):
        monkeypatch.setattr(fa, "CELL_EXAMPLES", size)
        found.append(fa.cbow(windows, vocab, 4, 3, negatives=2)[1])
    assert found[0] == pytest.approx(found[1], rel=1e-9) and found[0][-1] < found[0][0]


def test_skipgram_windows_are_drawn_once_a_position(spark):
    docs = spark.createDataFrame([(1, [4, 5, 6, 7])], "doc_id long, ids array<bigint>")
    pairs = cooc.skipgram_pairs(docs, 3)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert {(r.target, r.context) for r in pairs.collect()} >= {(4, 5), (5, 4), (5, 6), (6, 5), (6, 7), (7, 6)}
