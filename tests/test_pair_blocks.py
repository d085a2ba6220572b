"""Pairs of whole blocks: floors that take few steps, items that do not travel for every block, results as by brute force."""

import numpy as np
import pandas as pd
import pytest

from pathlore.operators import blocks, core
from pathlore.operators import clustering as cl
from pathlore.operators import similarity as sim
from pathlore.plans.storage import WIDEST_GAP


def _every(a, b):
    return tuple(g.ravel() for g in np.indices((len(a), len(b))))


@pytest.mark.parametrize("band", [None, 0, 1, 4])
def test_warping_floor_takes_a_step_a_diagonal(monkeypatch, band):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 24, 2)), rng.normal(size=(100, 30 if band is None or band > 5 else 24, 2))
    calls, least = [], np.minimum

    def counted(*args, **how):
        calls.append(1)
        return least(*args, **how)

    monkeypatch.setattr(np, "minimum", counted)
    floor = sim.dtw_floor(list(a), list(b), np.inf, band)
    monkeypatch.undo()
    assert len(calls) <= 2 * (a.shape[1] + b.shape[1])
    d = sim.dtw(list(a), list(b), *_every(a, b), band=band).reshape(floor.shape)
    assert (floor <= d).all() and (floor >= d * 0.999 - 1e-3).all()


def test_floors_stay_close_far_from_the_origin():
    rng = np.random.default_rng(2)
    a, b = ([p + 1e6 for p in rng.normal(size=(n, 20, 2))] for n in (20, 30))
    ia, ib = _every(a, b)
    for m in (sim.MEASURES["euclidean"], WIDEST_GAP, sim.find_measure("dtw"), sim.find_measure("dtw", 3)):
        floor, d = m.floor(a, b, np.inf)[ia, ib], m.kernel(a, b, ia, ib)
        assert (floor <= d).all() and (floor >= d * 0.999 - 1e-3).all()


def test_warping_floor_of_paths_without_points():
    none, some = np.empty((0, 2)), np.ones((3, 2))
    assert np.isinf(sim.dtw_floor([none], [some, none], np.inf)).all()
    assert np.isinf(sim.dtw_floor([none, some], [none, some], np.inf)).tolist() == [[True, True], [True, False]]


def _frame(spark, paths, ids=None):
    rows = [(int(i), [(float(x), float(y)) for x, y in p]) for i, p in zip(range(len(paths)) if ids is None else ids, paths)]
    return spark.createDataFrame(rows, "traj_id long, points array<struct<x:double,y:double>>")


@pytest.fixture
def many(monkeypatch):
    """A hundred items are many, and no block is copied for those it meets."""
    monkeypatch.setattr(sim, "FEW_ITEMS", 50)
    monkeypatch.setattr(sim, "BLOCK_ROWS", 16)
    monkeypatch.setattr(blocks, "COPIES", 0)
    monkeypatch.setattr(blocks, "SORTED_ROWS", 64)
    monkeypatch.setattr(blocks, "LEAST_ROWS", 16)


def _no_copies(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
    assert "Exchange" not in plan[plan.index("MapInPandas"):]


@pytest.mark.parametrize("name,band,eps", [("euclidean", None, 12.0), ("manhattan", None, 15.0), ("dtw", None, 8.0), ("dtw", 2, 9.0)])
def test_pairs_of_many_items_are_found_without_copies(spark, many, name, band, eps):
    rng = np.random.default_rng(3)
    paths = list(rng.normal(size=(200, 8, 2)))
    paths[7] = paths[3].copy()
    ia, ib = np.triu_indices(200, 1)
    d = sim.find_measure(name, band).kernel(paths, paths, ia, ib)
    found = sim.pairs_within(_frame(spark, paths), name, eps, band=band)
    _no_copies(found)
    got = {(r.i, r.j): r.d for r in found.collect()}
    assert got.keys() == {(i, j) for i, j, x in zip(ia.tolist(), ib.tolist(), d) if x <= eps} and len(got) > 100
    assert all(got[i, j] == pytest.approx(x, abs=1e-9) for i, j, x in zip(ia.tolist(), ib.tolist(), d) if x <= eps)


def test_blocks_that_meet_few_others_are_copied_to_them(spark, monkeypatch, many):
    monkeypatch.setattr(blocks, "COPIES", 20)  # of a hundred blocks
    rng = np.random.default_rng(4)
    paths = [p + 100 * (n % 50) for n, p in enumerate(rng.normal(size=(400, 5, 2)))]
    found = sim.pairs_within(_frame(spark, paths), "euclidean", 8.0, block_rows=4)
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
    ia, ib = np.triu_indices(400, 1)
    d = sim.euclidean(paths, paths, ia, ib)
    assert {(r.i, r.j) for r in found.collect()} == set(zip(ia[d <= 8].tolist(), ib[d <= 8].tolist()))


@pytest.mark.parametrize("name,band", [("euclidean", None), ("dtw", 3)])
def test_nearest_of_many_items_without_copies(spark, many, name, band):
    rng = np.random.default_rng(5)
    paths = list(rng.normal(size=(150, 8, 2)))
    paths[20] = paths[21] = paths[22]
    d = np.full((150, 150), np.inf)
    at = np.triu_indices(150, 1)
    d[at] = sim.find_measure(name, band).kernel(paths, paths, *at)
    d = np.minimum(d, d.T)
    got = {(r.id, r.rank): r.other for r in sim.nearest(_frame(spark, paths), 3, name, band=band).collect()}
    assert got == {(i, k + 1): int(o) for i in range(150) for k, o in enumerate(np.lexsort((np.arange(150), d[i]))[:3])}


def test_totals_and_histogram_of_many_items_read_stored_blocks(spark, monkeypatch, many):
    def copied(*_, **__):
        raise AssertionError("items were copied for every block")

    monkeypatch.setattr(sim, "_tasks", copied)
    rng = np.random.default_rng(6)
    paths = list(rng.normal(size=(120, 6, 2)))
    frame = _frame(spark, paths)
    table = sim.MEASURES["euclidean"].table(paths, paths)
    d = table[np.triu_indices(120, 1)]
    totals = sim.affinity_totals(frame, "euclidean")
    assert "CartesianProduct" in totals._jdf.queryExecution().executedPlan().toString()
    for r in totals.collect():
        own = np.delete(table[r.id], r.id)
        assert (r.n, r.total, r.low, r.high) == (119, pytest.approx(own.sum()), pytest.approx(own.min()), pytest.approx(own.max()))
    got = {r.bin: r.n for r in sim.distance_histogram(frame, "euclidean", 9).collect()}
    want = np.unique(np.minimum((d - d.min()) / ((d.max() - d.min()) / 9), 8).astype(int), return_counts=True)
    assert got == dict(zip(want[0].tolist(), want[1].tolist()))


def test_ids_may_repeat_or_be_null_in_packed_blocks():
    pdf = pd.DataFrame({"id": [4, 4, None], "v": [[1.0, 2.0], [3.0, 4.0, 5.0, 6.0], [7.0, 8.0]]})
    row = blocks.pack(9, pdf["id"], pdf["v"], np.array([[1.0], [np.nan], [3.0]]), np.array([1.0, np.inf, 2.0]))
    side = blocks.unpack(row, lambda v: sim._decode(v, False), (9,))
    assert side.ids[:2].tolist() == [4, 4] and np.isnan(side.ids[2]) and (row["lo"], row["hi"], row["reach"]) == ([1.0], [3.0], np.inf)
    assert [p.tolist() for p in side.items] == [[[1.0, 2.0]], [[3.0, 4.0], [5.0, 6.0]], [[7.0, 8.0]]] and side.reach.tolist() == [1.0, np.inf, 2.0]


@pytest.mark.parametrize("largest", [8, 0])
def test_sorted_edges_are_computed_once(spark, monkeypatch, largest):
    monkeypatch.setattr(core, "MAX_ROWS", 16)
    monkeypatch.setattr(sim, "LARGEST_RANGE", largest)
    rng = np.random.default_rng(7)
    rows = [(int(i), int(j), float(round(d, 2))) for i, j, d in zip(rng.integers(0, 30, 300), rng.integers(30, 60, 300), rng.exponential(size=300))]
    counted = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            counted.add(len(pdf))
            yield pdf

    edges = spark.createDataFrame(rows, "i long, j long, d double").mapInPandas(seen, "i long, j long, d double")
    got = sorted((r.position, r.d, r.i, r.j) for r in sim.sorted_distances(edges).collect())
    assert [(d, i, j) for _, d, i, j in got] == sorted((d, i, j) for i, j, d in rows)
    assert [p for p, *_ in got] == list(range(300)) and counted.value == 300


def test_sorted_edges_of_one_distance_or_none_that_is_a_number(spark, monkeypatch):
    monkeypatch.setattr(core, "MAX_ROWS", 4)
    for d in ([1.0] * 20, [1.0] * 10 + [float("inf")] * 10, []):
        edges = spark.createDataFrame([(n, n + 1, x) for n, x in enumerate(d)], "i long, j long, d double")
        assert sorted((r.position, r.i) for r in sim.sorted_distances(edges).collect()) == [(n, n) for n in range(len(d))]


def test_density_clusters_store_few_links(spark, monkeypatch):
    rng = np.random.default_rng(8)
    at = np.concatenate([rng.uniform(0, 3, (150, 2)), rng.uniform(0, 60, (100, 2))])
    near = [(i, j) for i in range(250) for j in range(i + 1, 250) if np.hypot(*(at[i] - at[j])) <= 2.0]
    assert len(near) > 5000
    edges = spark.createDataFrame(near + [(240, 240), (7, None), (None, 249), (None, None)] + near[:3], "i long, j long").coalesce(2)
    assert cl.reduced_edges(edges, 3).count() < 1000
    around = {n: {j if i == n else i for i, j in near if n in (i, j)} for n in range(250)}
    counts = np.bincount(np.array(near + near[:3]).ravel(), minlength=250) + np.bincount([240, 240, 7, 249], minlength=250)
    core_ids, want = set(np.flatnonzero(counts >= 3).tolist()), {n: -1 for n in range(250)}
    left = set(core_ids)
    while left:
        group, edge = set(), [min(left)]
        while edge:
            n = edge.pop()
            if n not in group:
                group.add(n)
                edge += around[n] & core_ids
        left -= group
        if len(group) >= 4:
            want |= {n: min(group) for n in group}
    for most in (1 << 20, 64):
        monkeypatch.setattr(cl, "EDGES_AT_ONCE", most)
        got = cl.density_clusters(spark.range(250), edges, 3, 4).collect()
        assert {r.id: r.label for r in got} == want


def test_features_look_at_single_pairs_once_few_are_left():
    rng = np.random.default_rng(9)
    phi_a, phi_b, reach = rng.normal(size=(60, 5)), rng.normal(size=(70, 5)), rng.uniform(0.1, 2.0, (60, 70))
    phi_a[:, 0] *= 40
    looked = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            got = super().__getitem__(at)
            looked.append(np.size(got))
            return got

    keep = blocks.close_mask(phi_a, phi_b, reach.view(Counted))
    assert (keep == (np.abs(phi_a[:, None] - phi_b[None]) <= reach[:, :, None]).all(axis=2)).all() and keep.any()
    assert looked and max(looked) < reach.size / 8
