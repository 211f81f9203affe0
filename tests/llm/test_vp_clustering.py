"""Centroid clustering against brute force: the tree, whole runs, ties, odd rows."""

import hashlib
import math

import numpy as np
import pytest
from conftest import CLASHES

from vectorloom.llm import vp_clustering as vp


def brute(rows, k, rounds, dims):
    """Lloyd rounds over Python integers: {row number: (cluster, distance)}, centroids."""
    kept = {i: [math.floor(256 * x) for x in v] for i, (_, v) in enumerate(rows)
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)}
    key = lambda i: (hashlib.sha256(f"2:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), kept[i])
    centroids = [kept[i] for i in sorted(kept, key=key)[:k]]
    assign = lambda: {i: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for i, v in kept.items()}
    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [kept[i] for i in kept if found[i][1] == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    return {i: (n, d) for i, (d, n) in assign().items()}, centroids


@pytest.mark.parametrize("spread", [1, 3, 500])
def test_tree_finds_the_nearest_and_the_smaller_of_ties(spread):
    rng = np.random.default_rng(spread)
    for k in (1, 2, 5, 40, 300):
        centroids = rng.integers(-spread, spread + 1, (k, 4))  # few values: many ties and equal centroids
        vectors = rng.integers(-2 * spread, 2 * spread + 1, (400, 4))
        d = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
        cluster, best = vp.VantageTree(centroids).nearest(vectors)
        assert (cluster == d.argmin(1)).all() and (best == d.min(1)).all()


def test_tree_leaves_out_what_is_far():
    """On separated centroids the search opens a small part of the nodes."""
    rng = np.random.default_rng(1)
    centroids = rng.integers(-10**6, 10**6, (256, 2))
    tree = vp.VantageTree(centroids)
    seen = []
    exact = vp.distances
    vp.distances = lambda a, b: seen.append(len(a)) or exact(a, b)
    try:
        tree.nearest(rng.integers(-10**6, 10**6, (500, 2)))
    finally:
        vp.distances = exact
    assert sum(seen) < 0.25 * 500 * 256


def test_clusters_equal_brute_force(spark, written):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [rows[5], rows[5], (None, rows[9][1]), (7, rows[2][1])]
    rows += [(600, None), (601, []), (602, [1.0] * 7), (603, [0.0] * 6), (604, [None] + [1.0] * 5), (605, [float("nan")] + [1.0] * 5),
             (606, [float("inf")] * 6), (607, [-100.0, 250.5] * 3), (608, [1.0] * 5)]
    table = written([(i, v, 1, "k", 2, 3, 0.5, 4, "d", 5, 6, "st", 7) for i, v in rows], "vec_id long, embedding array<float>" + CLASHES)
    want, centroids = brute(rows, 12, 3, 6)
    assigned, found = vp.centroid_clusters(table, k=12, rounds=3, dims=6)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert found.tolist() == centroids
    assert sorted(map(tuple, assigned.collect()), key=key) == sorted([(rows[i][0], *w) for i, w in want.items()], key=key)
    report = vp.cluster_report(table, k=12, rounds=3, dims=6).collect()
    total = sum(d for _, d in want.values())
    assert len(report) == len(want)
    for r in report:
        assert r.inertia == total and r.cluster_inertia == sum(d for c, d in want.values() if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_few_vectors_and_none(spark, written):
    schema = "vec_id long, embedding array<double>"
    assert vp.cluster_report(written([], schema)).count() == 0
    assert vp.cluster_report(written([(1, None), (2, [1.0])], schema)).count() == 0
    rows = vp.cluster_report(written([(i, [float(i)] * 64) for i in range(3)], schema)).collect()
    assert len(rows) == 3 and {r.distance for r in rows} == {0} and len({r.cluster for r in rows}) == 3
    far = vp.cluster_report(written([(0, [1e12] * 64), (1, [1e5] * 64), (2, [-1e5] * 64)], schema)).collect()
    assert {r.vec_id for r in far} == {1, 2}
    with pytest.raises(ValueError):
        vp.centroid_clusters(written([], schema), k=1 << 20)
