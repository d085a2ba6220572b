"""Tables of distances: equal to the kernels, floors never above them, and nothing stored for a pair."""

import itertools

import numpy as np
import pytest

from pathlore.operators import analysis, core
from pathlore.operators import clustering as cl
from pathlore.operators import similarity as sim
from pathlore.plans.storage import WIDEST_GAP


def _every(a, b):
    return tuple(g.ravel() for g in np.indices((len(a), len(b))))


def _paths(rng, n, steps, scale=1.0):
    found = [rng.normal(size=(steps, 2)) * scale for _ in range(n)]
    return found + [found[0].copy(), found[1] + 1e-7 * scale]


@pytest.mark.parametrize("name", ["euclidean", "manhattan", "cosine", "negative_euclidean", "vector_euclidean"])
def test_tables_hold_the_distances_of_the_kernels(name):
    rng, m = np.random.default_rng(1), sim.MEASURES[name]
    a, b = _paths(rng, 70, 32), _paths(rng, 530, 32)
    b += a[:3]  # exact copies
    if m.vector:
        a, b = [[p.ravel() for p in side] for side in (a, b)]
        a.append(np.zeros(64))
    ia, ib = _every(a, b)
    assert np.allclose(m.table(a, b)[ia, ib], m.kernel(a, b, ia, ib), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e6, 1e17, 1e160])
def test_floors_are_never_above_the_distances(scale):
    rng = np.random.default_rng(2)
    a, b = _paths(rng, 30, 20, scale), _paths(rng, 300, 20, scale)
    ia, ib = _every(a, b)
    for m in (sim.MEASURES["euclidean"], sim.MEASURES["manhattan"], WIDEST_GAP, sim.find_measure("dtw"), sim.find_measure("dtw", 3)):
        with np.errstate(over="ignore"):
            floor, d = m.floor(a, b, np.inf)[ia, ib], m.kernel(a, b, ia, ib)
        assert (floor <= d * (1 + 1e-12)).all()
        if scale == 1.0:
            assert (floor >= d * 0.999 - 1e-3).all()


def test_warping_floor_takes_paths_of_any_length_and_gives_up_only_beyond_the_reach():
    rng = np.random.default_rng(3)
    a, b = ([np.cumsum(rng.normal(size=(rng.integers(1, 60), 2)), axis=0) for _ in range(n)] for n in (40, 300))
    ia, ib = _every(a, b)
    for band in (None, 5):
        m = sim.find_measure("dtw", band)
        d = m.kernel(a, b, ia, ib)
        for reach in (5.0, 40.0, np.inf):
            floor = m.floor(a, b, reach)[ia, ib]
            assert (floor[d <= reach] <= d[d <= reach]).all() and (floor[d > reach] > reach * 0.99 - 0.1).all()


def test_histogram_by_tables_stores_no_distance(spark, monkeypatch):
    rng = np.random.default_rng(4)
    items = [(i, [(float(x), float(y)) for x, y in rng.normal(size=(4, 2))]) for i in range(90)]
    frame = spark.createDataFrame(items, "traj_id long, points array<struct<x:double,y:double>>")
    p = [np.array(v) for _, v in items]
    d = np.array([np.sqrt(((p[i] - p[j]) ** 2).sum(axis=1)).sum() for i, j in itertools.combinations(range(90), 2)])

    def stored(*_, **__):
        raise AssertionError("the histogram stored something")

    monkeypatch.setattr(core, "cut_lineage", stored)
    got = {r.bin: r.n for r in sim.distance_histogram(frame, "euclidean", 9, block_rows=20).collect()}
    want = np.unique(np.minimum((d - d.min()) / ((d.max() - d.min()) / 9), 8).astype(int), return_counts=True)
    assert got == dict(zip(want[0].tolist(), want[1].tolist()))


def test_blocks_grow_with_the_items_so_that_fewer_copies_travel(spark):
    ids = spark.range(40_000).selectExpr("id", "array(1.0D) AS v")
    copies = lambda most: sim._tasks(ids, sim.BLOCK_ROWS, (), most).count() / 40_000
    assert copies(0) > 150 and copies(sim.WIDE_ROWS) < 25


def test_sparse_links_keep_the_clusters_with_few_links(spark):
    rng = np.random.default_rng(5)
    n, least, size = 400, 3, 4
    at = np.concatenate([rng.integers(0, 8, (250, 2)) / 4, rng.uniform(0, 60, (150, 2))])  # a crowd with many copies, and strays
    every = np.array([(i, j) for i, j in itertools.combinations(range(n), 2) if np.hypot(*(at[i] - at[j])) <= 3.0])
    u, v = sim.sparse_links(every[:, 0], every[:, 1], least)
    assert len(u) <= (least + 1) * n < len(every)
    frame = spark.createDataFrame([(i, [(float(x), float(y))]) for i, (x, y) in enumerate(at)], "id long, points array<struct<x:double,y:double>>")
    want = cl.relabel_by_size(cl.density_clusters(frame.select("id"), sim.pairs_within(frame, "dtw", 3.0, ident="id"), least, size))
    got = analysis.geometric_labels(frame, "dtw", 3.0, least, size)
    assert sorted(got.collect()) == sorted(want.collect())
    assert sim.density_links(frame, "dtw", 3.0, least, ident="id", block_rows=64).count() < len(every) / 4
