"""Lattice hashing: the decoder, probes, recall of the production tables, and whole runs against brute force."""

import math

import numpy as np
import pytest
from conftest import CLASHES

from vectorloom.llm import lattice, lattice_dedup
from vectorloom.llm.lattice_dedup import LAYOUTS, PROBES, WIDTH


def test_decoder_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 3
    point = lattice.decode(x)
    whole = (point == np.rint(point)).all(1)
    assert (whole | (point - 0.5 == np.rint(point - 0.5)).all(1)).all() and (point.sum(1) % 2 == 0).all()
    gap = ((x - point) ** 2).sum(1)
    assert len(lattice.roots()) == 241 and np.allclose((lattice.roots()[:-1] ** 2).sum(1), 2)
    # a point of E8 is the nearest one if none of its 240 neighbours and 2160 second neighbours is nearer
    for step in lattice.roots():
        assert (((x - point - step) ** 2).sum(1) >= gap - 1e-9).all()
    assert gap.max() <= 1 + 1e-9  # covering radius


def test_probes_are_cells_of_neighbouring_points():
    rng = np.random.default_rng(1)
    units = rng.normal(size=(40, 64))
    units /= np.linalg.norm(units, axis=1)[:, None]
    names = lattice.cells(units, 3, 2, WIDTH, PROBES)
    assert names.shape == (40, PROBES + 1) and (names[:, 0] == lattice.cells(units, 3, 2, WIDTH)[:, 0]).all()
    assert all(len(set(r)) == PROBES + 1 for r in names.tolist())


def _pairs(rng, n, cosine, dims=64):
    a = rng.normal(size=(n, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.normal(size=(n, dims))
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * b


@pytest.mark.parametrize("rows, blocks, tables", LAYOUTS)
def test_recall_of_the_tables(rows, blocks, tables):
    """At the limit itself nine of ten links are found or more, a little above it nearly all."""
    for cosine, least in ((0.9, 0.9), (0.95, 0.995)):
        a, b = _pairs(np.random.default_rng(2), 1000, cosine)
        found = np.zeros(1000, bool)
        for t in range(tables):
            x, y = lattice.cells(a, t, blocks, WIDTH, PROBES), lattice.cells(b, t, blocks, WIDTH, PROBES)
            found |= (x == y[:, :1]).any(1) | (y == x[:, :1]).any(1)
        assert found.mean() >= least, (cosine, found.mean())


def brute(rows, limit):
    """{row: (links, component)} over all pairs."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(range(len(rows)), 0)
    for n in {len(rows[i][1]) for i in good}:
        own = [i for i in good if len(rows[i][1]) == n]
        x = np.array([rows[i][1] for i in own], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for p, q in zip(*np.nonzero(np.triu(x @ x.T >= limit, 1))):
            links[own[p]] += 1
            links[own[q]] += 1
            root[find(own[p])] = find(own[q])
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min((v for v in (k, least.get(find(i))) if v is not None), default=None)
    return [(k, links[i], least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows)]


def _cloud(rng, centre, noise, n):
    centre = centre / np.linalg.norm(centre)
    out = centre + rng.normal(size=(n, len(centre))) * noise / math.sqrt(len(centre))
    return (out * rng.uniform(0.2, 5, (n, 1))).astype(np.float32)


@pytest.mark.parametrize("crowd, block", [(16, 512), (4, 7)])
def test_links_and_components_equal_brute_force(spark, written, monkeypatch, crowd, block):
    monkeypatch.setattr(lattice_dedup, "CROWD", crowd)
    monkeypatch.setattr(lattice_dedup, "BLOCK", block)
    rng = np.random.default_rng(4)
    parts = [rng.normal(size=(150, 64)).astype(np.float32)]
    for noise, n in ((0.05, 90), (0.18, 60), (0.3, 50), (0.34, 30), (0.1, 2), (0.2, 3)):
        parts.append(_cloud(rng, rng.normal(size=64), noise, n))
    x, y = rng.normal(size=(2, 64))
    parts += [_cloud(rng, x, 0.1, 40), _cloud(rng, x / np.linalg.norm(x) + 0.45 * y / np.linalg.norm(y), 0.1, 40)]  # two balls linked in part
    vectors = np.concatenate(parts)
    ids = rng.permutation(len(vectors))
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, vectors)]
    rows += [(1000 + i, rows[200][1]) for i in range(30)] + [rows[160], rows[160], (None, rows[170][1]), (2000, [2 * c for c in rows[3][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 64), (3003, [None] + [1.0] * 63), (3004, [float("nan")] * 64), (3005, [float("inf")] * 64),
             (3006, [1.0, 2.0]), (3007, [1.0, 2.5]), (3008, [1.0] * 7), (None, None)]
    table = written([(i, v, 1, "k", 2, 3, 0.5, 4, "d", 5, 6, "st", 7) for i, v in rows], "vec_id long, embedding array<float>" + CLASHES)
    got = lattice_dedup.near_duplicates(table, layout=(2, 24)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(brute(rows, 0.9), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)) == want


def test_nothing(written):
    schema = "vec_id long, embedding array<double>"
    assert lattice_dedup.near_duplicates(written([], schema)).count() == 0
    rows = lattice_dedup.near_duplicates(written([(4, None), (2, [0.0]), (3, [1e300, 1e300]), (1, [1e-300, 1e-300])], schema)).collect()
    assert {tuple(r) for r in rows} == {(4, 0, 4, True), (2, 0, 2, True), (3, 1, 1, False), (1, 1, 1, True)}
