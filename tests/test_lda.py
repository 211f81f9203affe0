"""Distributed online LDA against a small dense model."""

import math

import numpy as np
import pytest

from vectorloom.operators import lda
from vectorloom.operators import topics as tp
from vectorloom.operators.topics import choose_topic_count

K, TERMS = 3, 14


def psi(x):
    return np.vectorize(lambda v: (math.lgamma(v + 1e-4) - math.lgamma(v - 1e-4)) / 2e-4, otypes=[float])(x)


def logs(a):
    return psi(a) - psi(a.sum(-1, keepdims=True))


def posterior(ids, counts, beta, alpha):
    """One document by plain coordinate ascent."""
    gamma = alpha + sum(counts) / len(alpha)
    for _ in range(400 if len(ids) else 0):
        theta = np.exp(logs(gamma))
        share = theta[:, None] * beta[:, ids]
        gamma = alpha + (share / share.sum(0) * counts).sum(1)
    share = np.exp(logs(gamma))[:, None] * beta[:, ids]
    return gamma, share / share.sum(0) * counts if len(ids) else share


def newton(prior, n, mean_log, rho):
    """The Newton step with a written-out Hessian."""
    m = np.arange(200_000)
    trigamma = np.vectorize(lambda v: (1 / (v + m) ** 2).sum() + 1 / (v + len(m) - 0.5), otypes=[float])
    slope = n * (psi(prior.sum()) - psi(prior) + mean_log)
    hessian = n * (trigamma(prior.sum()) - np.diag(trigamma(prior)))
    moved = prior - rho * np.linalg.solve(hessian, slope)
    return moved if (moved > 0).all() else prior


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(0)
    docs = []
    for i in range(40):
        ids = np.sort(rng.choice(TERMS // 2, 4, replace=False) + (i % 2) * (TERMS // 2))
        docs.append((i, ids.tolist(), rng.integers(1, 6, 4).astype(float).tolist()))
    return [*docs, (40, [], []), (41, None, None)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, ids array<int>, counts array<double>")


def dense_table(model, spark):
    out = np.zeros((model.k, model.vocab_size))
    for r in model.table(spark).collect():
        out[:, r.term_id] = r.vector
    return out


@pytest.mark.parametrize("alpha, eta", [(None, None), ("symmetric", 0.2), ("asymmetric", [0.1, 0.2, 0.4]), ("auto", "auto"), ([0.3, 0.1, 0.5], "auto"),
                                        ("auto", "table"), (0.7, "symmetric")])
def test_update_equals_a_dense_model(spark, docs, corpus, monkeypatch, alpha, eta):
    monkeypatch.setattr(lda, "BLOCK_DOCS", 7)
    matrix = np.random.default_rng(5).uniform(0.05, 0.6, (K, TERMS))
    given = spark.createDataFrame([(t, matrix[:, t].tolist()) for t in range(TERMS)], "term_id long, vector array<double>") if eta == "table" else eta
    model = lda.OnlineLda(K, TERMS, alpha, given, iterations=400, tolerance=1e-10, seed=2)
    lam = dense_table(model, spark)
    want_alpha, want_eta = model.alpha.copy(), matrix if eta == "table" else np.tile(model.eta[:, None], (1, TERMS))
    for turn in range(2):
        rho, beta = (1 + turn) ** -0.5, np.exp(logs(lam))
        found = [posterior(np.array(i or [], int), np.array(c or []), beta, want_alpha) for _, i, c in corpus]
        stats = np.zeros_like(lam)
        for (_, ids, _), (_, share) in zip(corpus, found):
            for at, t in enumerate(ids or []):
                stats[:, t] += share[:, at]
        lam = (1 - rho) * lam + rho * (want_eta + stats * 100 / len(corpus))
        if alpha == "auto":
            want_alpha = newton(want_alpha, len(corpus), np.mean([logs(g) for g, _ in found], 0), rho)
        if eta == "auto":
            want_eta = np.tile(newton(want_eta[:, 0], TERMS, logs(lam.T).mean(0), rho)[:, None], (1, TERMS))
        model.update(docs, 100)
        np.testing.assert_allclose(dense_table(model, spark), lam, rtol=1e-4)
        np.testing.assert_allclose(model.alpha, want_alpha, rtol=1e-4)
        if eta != "table":
            np.testing.assert_allclose(model.eta, want_eta[:, 0], rtol=1e-4)
    beta = np.exp(logs(lam))
    theta = {r.doc_id: np.array(r.theta) for r in model.transform(docs).collect()}
    assert len(theta) == len(corpus)
    for i, ids, counts in corpus:
        gamma = posterior(np.array(ids or [], int), np.array(counts or []), beta, want_alpha)[0]
        np.testing.assert_allclose(theta[i], gamma / gamma.sum(), atol=1e-4)


def test_bound_equals_a_dense_model(spark, docs, corpus):
    model = lda.OnlineLda(K, TERMS, "asymmetric", 0.3, iterations=400, tolerance=1e-10).update(docs)
    lam, alpha, gammaln = dense_table(model, spark), model.alpha, np.vectorize(math.lgamma, otypes=[float])
    log_beta, total, words = logs(lam), 0.0, 0.0
    for _, ids, counts in corpus:
        ids, counts = np.array(ids or [], int), np.array(counts or [])
        gamma = posterior(ids, counts, np.exp(log_beta), alpha)[0]
        log_theta = logs(gamma)
        total += sum(c * math.log(np.exp(log_theta + log_beta[:, t]).sum()) for t, c in zip(ids, counts))
        total += ((alpha - gamma) * log_theta + gammaln(gamma) - gammaln(alpha)).sum() + math.lgamma(alpha.sum()) - math.lgamma(gamma.sum())
        words += counts.sum()
    own = ((0.3 - lam) * log_beta + gammaln(lam) - math.lgamma(0.3)).sum() + (math.lgamma(0.3 * TERMS) - gammaln(lam.sum(1))).sum()
    filled = sum(bool(i) for _, i, _ in corpus)
    assert model.bound(docs) == pytest.approx((total + own * filled / len(corpus)) / words, rel=1e-4)
    assert model.bound(docs) == model.bound(docs)


def test_learned_alpha_follows_the_shares_of_the_topics(spark):
    rows = [(i, ([0, 1, 2] if i % 5 else [3, 4, 5]), [5.0, 4.0, 3.0]) for i in range(100)]  # four in five documents are of one topic
    model = lda.lda_fit(spark.createDataFrame(rows, "doc_id long, ids array<int>, counts array<double>"), 6, 2, passes=12, updates=2, seed=3, alpha="auto")
    probs = {(r.topic, r.term_id): r.prob for r in model.topic_terms(spark).collect()}
    large = int(probs[1, 0] > probs[0, 0])
    assert model.alpha[large] > 1.5 * model.alpha[1 - large]


def test_special_functions():
    x = np.array([1e-3, 0.1, 0.5, 1, 2.5, 7, 40, 1e4])
    np.testing.assert_allclose(lda.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-12)
    np.testing.assert_allclose(lda.digamma(x[1:]), psi(x[1:]), rtol=1e-5)
    assert lda.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329) and lda.trigamma(np.array([1.0]))[0] == pytest.approx(math.pi ** 2 / 6)


def test_priors():
    np.testing.assert_allclose(lda.prior_of("asymmetric", 3)[0], np.array([1 / (i + math.sqrt(3)) for i in range(3)]) / sum(1 / (i + math.sqrt(3)) for i in range(3)))
    assert lda.prior_of("auto", 4)[1] and not lda.prior_of(0.5, 4)[1]
    for wrong in ("other", [1.0, 2.0], -1.0):
        with pytest.raises(ValueError):
            lda.prior_of(wrong, 3)


def test_two_candidates_are_scored(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [f"w{j}" for j in rng.integers(0, 6, 20) + 6 * (i % 2)]) for i in range(120)]
    tokens = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([(t, f"w{t}") for t in range(12)], "term_id long, token string")
    from vectorloom.operators.topics import chunk_documents
    from vectorloom.operators.vocab import token_runs

    out = choose_topic_count(tokens, chunk_documents(token_runs(tokens), vocab), vocab, [2, 3], passes=2).collect()
    assert [r.k for r in out] == [2, 3] and all(1 < r.perplexity < 14 and r.coherence < 0 for r in out)


def test_small_tables_go_to_the_blocks(spark, docs, monkeypatch):
    """Blocks stay where they lie beside a small table of topics; a large one is joined, with the same parameters and rows."""
    found = {}
    for small in (True, False):
        monkeypatch.setattr(lda, "fits", lambda *_: small)
        blocks = lda.pack_blocks(docs, 3)
        model = lda.OnlineLda(3, 12, alpha="auto", seed=2).update(blocks).update(blocks)
        theta = model.transform(blocks)
        assert ("Exchange" in theta._jdf.queryExecution().executedPlan().toString()) is not small
        found[small] = ({r.term_id: r.vector for r in model.table(spark).collect()}, {r.doc_id: r.theta for r in theta.collect()}, model.bound(docs))
    for a, b in zip(found[True][:2], found[False][:2], strict=True):
        assert a.keys() == b.keys() and all(np.allclose(a[x], b[x]) for x in a)
    assert np.isclose(found[True][2], found[False][2])


def test_word_topics_stay_in_the_row(spark):
    """Equal rows and repeated keys share one total, unknown words and documents drop out, and a word is not exchanged once a topic."""
    runs = [(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, "c"), (4, "a"), (None, "a"), (5, "b")]
    theta = [(1, 0, 0.25), (1, 1, 0.75), (2, 1, 1.0), (3, 0, 1.0), (5, 0, 0.5), (5, 0, 0.5)]
    beta = [(t, w, p) for w, ps in (("a", (0.5, 0.1)), ("b", (0.2, 0.4))) for t, p in enumerate(ps)]
    out = tp.word_topics(spark.createDataFrame(theta, "doc_id long, topic int, prob double"), spark.createDataFrame(runs, "doc_id long, token string"),
                         spark.createDataFrame(beta, "topic int, token string, prob double"))
    cells = [(d, w, t, p * q) for d, w in runs for e, t, p in theta if e == d for u, x, q in beta if (u, x) == (t, w)]
    total = {}
    for d, w, _, x in cells:
        total[d, w] = total.get((d, w), 0) + x
    assert sorted((r.doc_id, r.token, r.topic, round(r.phi, 9)) for r in out.collect()) == sorted((d, w, t, round(x / total[d, w], 9)) for d, w, t, x in cells)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and not [x for x in plan.splitlines() if "hashpartitioning(doc_id" in x and "topic" in x.split("hashpartitioning")[1]]
