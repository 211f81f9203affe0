from collections import Counter

import pytest

from vectorloom.operators import coherence as coh
from vectorloom.operators import cooc as c


def test_confirmation_goldens(spark):
    counts = spark.createDataFrame([("1", "2", 3.0, 2.0, 1.0)], "w_prime string, w_star string, n_prime double, n_star double, n_both double")
    total = spark.createDataFrame([(5.0,)], "n_units double")
    assert coh.log_conditional_probability(counts, total).first()["m"] == pytest.approx(-0.693147181, abs=1e-8)
    assert coh.log_ratio(counts, total).first()["m"] == pytest.approx(-0.182321557, abs=1e-8)
    assert coh.log_ratio(counts, total, True).first()["m"] == pytest.approx(-0.113282753, abs=1e-8)


def test_indirect_cosine_golden(spark):
    rows = [("1", "1", 3.0, 3.0, 3.0), ("1", "2", 3.0, 2.0, 1.0), ("2", "1", 2.0, 3.0, 1.0), ("2", "2", 2.0, 2.0, 2.0)]
    counts = spark.createDataFrame(rows, "w_prime string, w_star string, n_prime double, n_star double, n_both double")
    topics = spark.createDataFrame([(0, 0, "1"), (0, 1, "2")], "topic int, rank int, token string")
    direct = coh.log_ratio(counts, spark.createDataFrame([(5.0,)], "n_units double"), True)
    got = [round(r["m"], 4) for r in coh.indirect_cosine(topics, direct).collect()]
    assert got == [0.6230, 0.6230]


def brute_windows(texts, window):
    units = []
    for t in texts:
        units += [set(t[i:i + window]) for i in range(max(1, len(t) - window + 1))]
    return units


@pytest.mark.parametrize("window", [1, 2, 3, 5, 50])
def test_windows_equal_brute_force(spark, toy, window):
    texts = [r["tokens"] for r in toy.collect()]
    texts.append("a b a c a a b c d a b a".split())
    docs = toy.unionByName(spark.createDataFrame([(9, texts[-1])], toy.schema))
    words = ["system", "user", "graph", "a", "b", "c"]
    topics = spark.createDataFrame([(0, i, x) for i, x in enumerate(words)], "topic int, rank int, token string")
    units, total = coh.window_units(docs, topics, window)
    brute = brute_windows(texts, window)
    assert total.first()[0] == len(brute)
    for r in coh.pair_counts(units, coh.segment_one_set(topics)).collect():
        a, b = r["w_prime"], r["w_star"]
        assert r["n_prime"] == sum(a in u for u in brute)
        assert r["n_both"] == sum(a in u and b in u for u in brute), (a, b)


@pytest.mark.parametrize("measure", ["u_mass", "c_v", "c_uci", "c_npmi"])
def test_good_topics_beat_bad(spark, toy, measure):
    def score(topics):
        rows = [(t, i, x) for t, ws in enumerate(topics) for i, x in enumerate(ws)]
        return coh.coherence(toy, spark.createDataFrame(rows, "topic int, rank int, token string"), measure).first()[0]

    good = [["human", "computer", "system", "interface"], ["graph", "minors", "trees", "eps"]]
    bad = [["user", "graph", "minors", "system"], ["time", "graph", "survey", "minors"]]
    assert score(good) > score(bad)


def test_ngram_counts_brute(spark):
    import itertools
    from collections import Counter

    chunks = [[3, 1, 2, 3], [1, 2], [5, 1, 2, 4], [7]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(chunks)], "doc_id int, ids array<long>")
    for n in (2, 3, 4):
        want = Counter(t for x in chunks for t in itertools.combinations(sorted(set(x)), n))
        got = {tuple(r)[:-1]: r["count"] for r in c.ngram_cooccurrence(df, n).collect()}
        assert got == dict(want)
    assert c.symmetrize(c.ngram_cooccurrence(df, 3).withColumnRenamed("count", "value")).count() == 6 * c.ngram_cooccurrence(df, 3).count()


def test_windows_and_chunks(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5])], "doc_id int, ids array<long>")
    full = [(r["target"], r["context"]) for r in c.context_windows(df, 2).collect()]
    assert full == [(3, [1, 2, 4, 5])]
    cut = [(r["target"], r["context"]) for r in c.context_windows(df, 2, fixed_size=False).collect()]
    assert cut[0] == (1, [2, 3]) and cut[4] == (5, [3, 4]) and len(cut) == 5
    assert [r["ids"] for r in c.chunk_sentences(df, 1).collect()] == [[1, 2, 3], [4, 5]]


def test_ordered_triples_exchange_one_order(spark):
    """Counts of (target, context, context') equal those of all pairs of places; only j <= k is grouped."""
    windows = [(1, [2, 3, 2, 5]), (1, [3, 2]), (4, [4, 4]), (4, []), (2, [7])]
    expected = Counter((t, x, y) for t, context in windows for x in context for y in context)
    found = c.count_with_context(spark.createDataFrame(windows, "target long, context array<long>"), 3)
    assert {(r.i, r.j, r.k): r["count"] for r in found.collect()} == expected
    assert "Generate" in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]  # the other order comes after the count
