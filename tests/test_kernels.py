"""Operators without oracle SQL against brute force, and numeric kernels."""

import dataclasses
import itertools
import math
import random
import tracemalloc
from collections import deque

import numpy as np
import pandas as pd
import pytest
from helpers import make_log, tuples
from pyspark.sql import functions as F

from pathlore.operators import clustering as cl
from pathlore.operators import blocks, core, motifs, pellets, spatial, wide_pca
from pathlore.operators import similarity as sim
from pathlore.operators.spatial import MazeGrid


def path_frame(spark, paths):
    rows = [(i, [{"x": float(x), "y": float(y)} for x, y in p]) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "traj_id long, points array<struct<x:double,y:double>>")


def random_paths(n, seed, lengths=(6,)):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(lengths[i % len(lengths)], 2)).cumsum(axis=0) for i in range(n)]


def dtw_by_hand(a, b, band=None):
    best = {(-1, -1): 0.0}
    for i in range(len(a)):
        for j in range(len(b)):
            if band is None or abs(i - j) <= band:
                best[i, j] = math.dist(a[i], b[j]) + min(best.get(p, math.inf) for p in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return best.get((len(a) - 1, len(b) - 1), math.inf)


def all_pairs(paths, fn):
    return {(i, j): fn(paths[i], paths[j]) for i in range(len(paths)) for j in range(i + 1, len(paths))}


@pytest.mark.parametrize("name,fn", [
    ("euclidean", lambda a, b: float(np.sqrt(((a - b) ** 2).sum(1)).sum())),
    ("manhattan", lambda a, b: float(np.abs(a - b).sum())),
    ("dtw", dtw_by_hand),
])
@pytest.mark.parametrize("eps", [None, 6.0])
def test_pairs_match_brute_force(spark, name, fn, eps):
    paths = random_paths(30, 5, (6,) if name != "dtw" else (6, 4, 9))
    want = {k: d for k, d in all_pairs(paths, fn).items() if eps is None or d <= eps}
    got = {(r.i, r.j): r.d for r in sim.pairs_within(path_frame(spark, paths), name, eps, block_rows=4).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_hot_cell_is_split_and_stays_whole(spark):
    # a third of the paths start and stay at the same place
    paths = random_paths(20, 6) + [np.zeros((6, 2))] * 10
    frame = path_frame(spark, paths)
    want = {k for k, d in all_pairs(paths, dtw_by_hand).items() if d <= 2.5}
    assert {(r.i, r.j) for r in sim.pairs_within(frame, "dtw", 2.5, block_rows=3).collect()} == want


def test_band_too_narrow_is_infinite_and_equal_paths_are_zero(spark):
    paths = [np.zeros((3, 2)), np.zeros((8, 2)), np.zeros((8, 2))]
    got = {(r.i, r.j): r.d for r in sim.affinity(path_frame(spark, paths), "dtw", band=2).collect()}
    assert got[0, 1] == math.inf and got[1, 2] == 0.0
    paths = random_paths(12, 7, (6, 8))
    got = {(r.i, r.j): r.d for r in sim.affinity(path_frame(spark, paths), "dtw", band=3).collect()}
    assert all(d == pytest.approx(dtw_by_hand(paths[i], paths[j], 3)) for (i, j), d in got.items())


def test_unequal_lengths_and_unknown_measures_are_refused(spark):
    frame = path_frame(spark, random_paths(4, 8, (3, 4)))
    with pytest.raises(Exception, match="equal length"):
        sim.affinity(frame, "euclidean").collect()
    with pytest.raises(ValueError):
        sim.affinity(frame, "frechet")
    with pytest.raises(ValueError):
        sim.affinity(frame, "euclidean", band=3)
    own = sim.affinity(frame, lambda a, b, ia, ib: np.abs(ia - ib).astype(float)).collect()
    assert len(own) == 6


def test_nearest_totals_and_histogram(spark):
    paths = random_paths(25, 9)
    dist = all_pairs(paths, dtw_by_hand)
    frame = path_frame(spark, paths)
    both = {i: sorted((d, a + b - i) for (a, b), d in dist.items() if i in (a, b)) for i in range(25)}
    near = sim.nearest(frame, 3, "dtw", block_rows=5).collect()
    assert {(r.id, r.rank): r.other for r in near} == {(i, k + 1): both[i][k][1] for i in both for k in range(3)}
    for r in sim.affinity_totals(frame, "dtw", block_rows=5).collect():
        assert (r.n, r.total, r.low) == (24, pytest.approx(sum(d for d, _ in both[r.id])), pytest.approx(both[r.id][0][0]))
    h = sim.distance_histogram(frame, "dtw", 10, block_rows=5).collect()
    want, _ = np.histogram(list(dist.values()), 10)
    assert {r.bin: r.n for r in h} == {i: n for i, n in enumerate(want) if n}


def test_alignment_path_adds_up(spark):
    paths = random_paths(6, 10, (5, 8))
    frame = path_frame(spark, paths)
    edges = spark.createDataFrame([(0, 1), (2, 4), (3, 3)], "i long, j long")
    for r in sim.alignment_paths(sim.with_points(edges, frame)).collect():
        a, b = paths[r.i], paths[r.j]
        steps = [(p.i, p.j) for p in r.path]
        assert steps[0] == (0, 0) and steps[-1] == (len(a) - 1, len(b) - 1)
        assert all((y[0] - x[0], y[1] - x[1]) in ((1, 1), (1, 0), (0, 1)) for x, y in zip(steps, steps[1:]))
        assert sum(math.dist(a[i], b[j]) for i, j in steps) == pytest.approx(r.d) == pytest.approx(dtw_by_hand(a, b))


def test_vector_affinity(spark):
    rng = np.random.default_rng(3)
    vs = [list(map(float, v)) for v in rng.normal(size=(10, 4))] + [[0.0] * 4]
    df = spark.createDataFrame(list(enumerate(vs)), "traj_id long, points array<double>")
    cos = {(r.i, r.j): r.d for r in sim.affinity(df, "cosine", block_rows=3).collect()}
    for (i, j), d in cos.items():
        n = np.linalg.norm(vs[i]) * np.linalg.norm(vs[j])
        assert d == pytest.approx(np.dot(vs[i], vs[j]) / n if n else 0.0)


def bfs(free, start, blocked=(), link=True):
    dist, queue = {start: 0}, deque([start])
    while queue:
        x, y = queue.popleft()
        around = [(p, False) for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1))]
        if link:
            around += [((27, -1), True)] if (x, y) == (-27, -1) else [((-27, -1), True)] if (x, y) == (27, -1) else []
        for p, jump in around:
            if p not in dist and (jump or (p in free and p not in blocked)):
                dist[p] = dist[x, y] + 1
                queue.append(p)
    return dist


@pytest.fixture(scope="module")
def maze(spark):
    rng = random.Random(11)
    walls = [(x, y) for x in range(-14, 14) for y in range(-16, 15) if rng.random() < 0.12]
    grid = MazeGrid.from_walls(spark.createDataFrame(walls, "x long, y long"))
    covered = {(2 * x + i, 2 * y - j) for x, y in walls for i in (0, 1, 2) for j in (0, 1, 2)}
    free = {(x, y) for x in range(-27, 28) for y in range(-33, 28)} - covered
    return grid, free


def test_graph_distances_and_paths(spark, maze):
    grid, free = maze
    rng = random.Random(12)
    cells = [(x, y) for x in range(-27, 28) for y in range(-33, 28)]
    starts = rng.sample(cells, 5) + [(-27, -1), (27, -1)]  # some lie in walls
    pairs = [(*s, *rng.choice(cells)) for s in starts for _ in range(20)] + [(*s, *s) for s in starts]
    frame = spark.createDataFrame(pairs, "sx long, sy long, tx long, ty long")
    by_start = {s: bfs(free, s) for s in starts}
    for r in spatial.graph_distances(frame, grid).collect():
        steps = by_start[r.sx, r.sy].get((r.tx, r.ty))
        assert r.distance == (math.inf if steps is None else steps / 2)
    tracks = {}
    for r in spatial.shortest_paths(frame, grid).collect():
        tracks.setdefault((r.sx, r.sy, r.tx, r.ty), {})[r.pos] = (r.x2, r.y2)
    for (sx, sy, tx, ty), track in tracks.items():
        n = by_start[sx, sy][tx, ty]
        assert sorted(track) == list(range(n + 1)) and track[0] == (sx, sy) and track[n] == (tx, ty)
        for k in range(n):
            (ax, ay), (bx, by) = track[k], track[k + 1]
            assert abs(ax - bx) + abs(ay - by) == 1 or {(ax, ay), (bx, by)} == {(-27, -1), (27, -1)}


def test_all_pairs_table_is_symmetric(spark):
    walls = spark.createDataFrame([(x, y) for x in range(-14, 14) for y in range(-16, 15) if not (-2 <= x <= 1 and -1 <= y <= 2)], "x long, y long")
    grid = MazeGrid.from_walls(walls, tunnel=None)
    table = {(r.sx, r.sy, r.tx, r.ty): r.distance for r in spatial.all_pairs_distances(grid, spark).collect()}
    assert len(table) == int(grid.free.sum()) ** 2 and all(table[c, d, a, b] == v for (a, b, c, d), v in table.items())


def test_reachability_with_blocked_cells(spark, maze):
    grid, free = maze
    rng = random.Random(13)
    open_cells = sorted(free)
    rows = []
    for _ in range(40):
        s, t = rng.sample(open_cells, 2)
        ring = [(s[0] + dx, s[1] + dy) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        rows.append((*s, *t, [{"x2": x, "y2": y} for x, y in (ring if rng.random() < 0.4 else rng.sample(open_cells, 3)) + ([t] if rng.random() < 0.2 else [])]))
    frame = spark.createDataFrame(rows, "sx long, sy long, tx long, ty long, blocked array<struct<x2:bigint,y2:bigint>>")
    for r in spatial.reachability(frame, grid).collect():
        gone = {(c.x2, c.y2) for c in r.blocked}
        assert r.reachable == ((r.tx, r.ty) not in gone and (r.tx, r.ty) in bfs(free, (r.sx, r.sy), gone))


def test_entity_distances_join_back_to_every_row(spark, maze):
    grid, free = maze
    rng = random.Random(14)
    rows = [{f"Ghost{g}_{a}": rng.randint(-20, 20) / 2 for g in (1, 2, 3, 4) for a in "XY"} | {"Pacman_X": rng.randint(-20, 20) / 2, "Pacman_Y": rng.randint(-20, 20) / 2} for _ in range(25)]
    out = spatial.entity_path_distances(make_log(spark, rows).df, grid).orderBy("i").collect()
    assert len(out) == 25
    for r in out:
        for g in (1, 2, 3, 4):
            steps = bfs(free, (round(2 * r[f"Ghost{g}_X"]), round(2 * r[f"Ghost{g}_Y"]))).get((round(2 * r.Pacman_X), round(2 * r.Pacman_Y)))
            assert r[f"Ghost{g}_distance"] == (math.inf if steps is None else steps / 2)


def test_matrix_profile_of_many_short_levels(spark):
    """Levels go to Python in batches, not one call each; batches that cut a level and blocks change nothing."""
    rng = random.Random(4)
    series = {level: [rng.randint(0, 5) for _ in range(rng.choice((3, 8, 9, 30, 41)))] for level in range(25)}
    log = make_log(spark, [{"level_id": k, "Pacman_X": float(v)} for k, vs in series.items() for v in vs])
    want = {}
    for level, v in series.items():
        best, _ = motifs.compare_windows(np.array(v, float), np.array(v, float), 0, 0, 4, 1) if len(v) >= 4 else (motifs._Best(0), None)
        want |= {(level, i): (n, d) for i, (n, d) in enumerate(zip(best.at, best.d)) if np.isfinite(d)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for block in (16, 2048):
            profile = motifs.matrix_profile(log, "Pacman_X", 4, block=block)
            assert "InPandas" not in profile._jdf.queryExecution().toString()
            rows = profile.collect()
            assert {(r.level_id, r.start): (r.neighbour, r.d) for r in rows} == want
            assert len(rows) == len({(r.level_id, r.start) for r in rows})
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


DOTS = [(x + 0.5, y + 0.5) for x in range(-3, 3) for y in range(-2, 2)]


def pellets_by_hand(rows, dots, full):
    """Whole-log scan without any row reduction."""
    left, out = sorted(dots, key=lambda p: (-p[1], p[0])), []
    order = {p: i for i, p in enumerate(left)}
    for i, (x, y, counter) in enumerate(rows):
        near = sorted(left, key=lambda p: (math.hypot(p[0] - x, p[1] - y), order[p]))
        if i == 0:
            gone = near[: max(0, full - counter)]
        else:
            gone = near[:1] if near and (math.hypot(near[0][0] - x, near[0][1] - y) <= 0.5 or counter - rows[i - 1][2] == -1) else []
        for p in gone:
            left.remove(p)
            out.append((i, *p))
    return out


@pytest.mark.parametrize("first", [244, 243, 242, 240])
def test_pellets_match_a_whole_scan(spark, strategy, first):
    rng = random.Random(first)
    levels, want = [], set()
    for level in (1, 2):
        x, y, counter, rows = 0.0, 0.0, first, []
        for _ in range(160):
            x, y = max(-3, min(3, x + rng.choice((-0.25, 0, 0, 0.25)))), max(-2, min(2, y + rng.choice((-0.25, 0, 0, 0.25))))
            rows.append((x, y, counter))
            counter -= rng.choice((0, 0, 0, 0, 1, 2))
        levels += [{"level_id": level, "Pacman_X": a, "Pacman_Y": b, "pellets": c} for a, b, c in rows]
        want |= {(level, *e) for e in pellets_by_hand(rows, DOTS, 244)}
    log, dots = make_log(spark, levels), spark.createDataFrame(DOTS, "px double, py double")
    eaten = pellets.eaten_pellets(log, dots)
    assert {(r.level_id, r.step, r.px, r.py) for r in eaten.collect()} == want
    left = pellets.pellet_availability(log, dots, eaten).collect()
    assert len(left) == 320
    assert all(r.remaining == len(DOTS) - sum(e[0] == r.level_id and e[1] <= r.step for e in want) for r in left)
    points = pellets.available_points(log.df.where("step = 20"), dots, eaten, ["level_id"]).groupBy("level_id").count().collect()
    assert {r.level_id: r["count"] for r in points} == {r.level_id: r.remaining for r in left if r.step == 20}


def test_pellets_of_many_short_levels(spark, monkeypatch):
    """Levels of all lengths, a NULL key among them, are folded together over batches that cut them, not one call a level."""
    rng = random.Random(3)
    levels, want = [], set()
    for level in [None, *range(60)]:
        rows = [(rng.randint(-12, 12) / 4, rng.randint(-8, 8) / 4, 244 - k // 2) for k in range(rng.choice((1, 2, 5, 40, 90)))]
        levels += [{"level_id": level, "Pacman_X": a, "Pacman_Y": b, "pellets": c} for a, b, c in rows]
        want |= {(level, *e) for e in pellets_by_hand(rows, DOTS, 244)}
    log, dots = make_log(spark, levels), spark.createDataFrame(DOTS, "px double, py double")
    monkeypatch.setattr(pellets, "CELLS", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        eaten = pellets.eaten_pellets(log, dots)
        got = [(r.level_id, r.step, r.px, r.py) for r in eaten.collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and set(got) == want
    assert "InPandas" not in eaten._jdf.queryExecution().toString()


def test_remaining_pills(spark):
    dots = spark.createDataFrame([(12.5, 10.5), (11.5, 10.5), (-12.5, 10.5)], "px double, py double")
    log = make_log(spark, [{"Pacman_X": 11.5}, {"Pacman_X": 11.5}, {"Pacman_X": 12.5}, {}])
    out = pellets.remaining_pills(log, dots, pellets.eaten_pellets(log, dots)).orderBy("step").collect()
    assert [(r.pill_1, r.pill_2, r.pill_3, r.pill_4) for r in out] == [(False, False, True, True)] * 2 + [(False, False, True, False)] * 2


def test_recurrence_counts(spark, strategy):
    at = {1, 2, 3, 7, 8, 20}
    rows = [{"Pacman_X": 0.5 if i in at or i == 0 else 9.5 + i % 3, "Pacman_Y": 0.5 + (0 if i in at else i % 7)} for i in range(22)]
    got = spatial.recurrence_visits(make_log(spark, rows), "Pacman_X", "Pacman_Y").where("gx = 14 and gy = 17")
    assert sorted(r.step for r in got.collect()) == [1, 7, 20]


def test_matrix_profile_blocks_and_constant_windows(spark):
    rng = np.random.default_rng(5)
    series = np.r_[rng.normal(size=40), np.zeros(12), rng.normal(size=20), np.zeros(9)]
    m, zone = 6, 2
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(series)], "k long, i long, v double")
    got = {r.start: r.d for r in motifs.matrix_profile(core.order_log(df, ["k"], ["i"]), "v", m, block=16).collect()}
    wins = np.lib.stride_tricks.sliding_window_view(series, m)

    def dist(a, b):
        sa, sb = a.std(), b.std()
        if sa == 0 or sb == 0:
            return 0.0 if sa == sb else math.sqrt(m)
        return math.sqrt((((a - a.mean()) / sa - (b - b.mean()) / sb) ** 2).sum())

    assert len(got) == len(wins)
    for i in range(len(wins)):
        assert got[i] == pytest.approx(min(dist(wins[i], wins[j]) for j in range(len(wins)) if abs(i - j) > zone), abs=1e-6)


def test_components_and_noise(spark):
    rng = random.Random(15)
    edges = [(i, i + 1) for i in range(40)] + [(100, j) for j in range(101, 130)] + [(rng.randint(200, 230), rng.randint(200, 230)) for _ in range(15)]
    frame = spark.createDataFrame(edges, "i long, j long")
    nodes = spark.createDataFrame([(i,) for i in range(300)], "id long")
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.id: r.component for r in cl.min_label_components(nodes, frame).collect()}
    assert got == {i: root(i) for i in range(300)}
    labels = {r.id: r.label for r in cl.density_clusters(nodes, frame.where("i <> j").distinct(), 2, 10).collect()}
    assert {labels[i] for i in range(1, 40)} == {1} and labels[0] == labels[100] == labels[299] == -1


def test_pca_and_kmeans(spark):
    rng = np.random.default_rng(6)
    data = np.r_[rng.normal(size=(40, 3)) * [3, 1, 0.2], rng.normal(size=(40, 3)) * [3, 1, 0.2] + [30, 0, 0]]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(data)], "id long, v array<double>")
    out, model = cl.reduce_dimensions(df, "v", 2)
    got = np.array([r.reduced for r in out.orderBy("id").collect()])
    centred = data - data.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:2].T), atol=1e-8)
    assert np.allclose(model.explainedVariance, (s**2 / (s**2).sum())[:2])
    assert cl.reduce_dimensions(df.withColumn("v", F.slice("v", 1, 2)), "v")[1] is None
    labelled, _ = cl.kmeans(df, "v", 2, seed=1)
    first = {r.label for r in labelled.where("id < 40").collect()}
    second = {r.label for r in labelled.where("id >= 40").collect()}
    assert len(first) == len(second) == 1 and first != second


@pytest.mark.parametrize("limit", [3, 10_000])
def test_centroids_in_blocks_give_the_same_labels(spark, monkeypatch, limit):
    monkeypatch.setattr(cl, "MAX_CENTROIDS", limit)
    rng = random.Random(12)
    centres = [(i, [float(rng.randint(0, 4)), float(rng.randint(0, 4))]) for i in range(11)]
    points = [(i, [float(rng.randint(0, 4)), float(rng.randint(0, 4))]) for i in range(30)]
    got = cl.assign_nearest(
        spark.createDataFrame(points, "id int, v array<double>"), "v", spark.createDataFrame(centres, "label int, centre array<double>")
    ).collect()
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assert {r["id"]: r["label"] for r in got} == {i: min((far(v, c), n) for n, c in centres)[1] for i, v in points}


def test_agents_outside_the_maze_need_no_field(spark):
    maze = spatial.MazeGrid.from_walls(spark.createDataFrame([(0, 0)], "x long, y long"))
    inside = {"Pacman_X": 0.5, "Pacman_Y": 10.5}
    ghosts = {f"Ghost{g}_{a}": 1.5 if a == "X" else 10.5 for g in (1, 2, 3, 4) for a in "XY"}
    rows = [{**inside, **ghosts}] + [{"Pacman_X": 1000.0 + i, "Pacman_Y": 0.5, **ghosts} for i in range(5)]
    got = spatial.entity_path_distances(spark.createDataFrame(rows), maze).collect()
    assert sorted(r["Ghost1_distance"] for r in got)[:2] == [1.0, float("inf")]


@pytest.mark.parametrize("name,eps", [("euclidean", 8.0), ("dtw", 6.0)])
def test_few_pairs_are_compared_when_items_lie_apart(spark, name, eps):
    """Boxes, features and bounds keep far items from the kernel; what is left is every pair within the distance."""
    rng = random.Random(31)
    paths = [[(float(rng.randint(0, 60)), float(rng.randint(0, 60)))] * 2 for _ in range(300)]
    frame = path_frame(spark, paths)
    assert sim.compared_pairs(frame, name, eps) < 300 * 299 / 2 / 20
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if sum(math.dist(p, q) for p, q in zip(paths[i], paths[j])) <= eps}
    assert {(r.i, r.j) for r in sim.pairs_within(frame, name, eps).collect()} == want


def walks(n, seed, length=24):
    """Walks around some places, as recorded paths are: near in groups, far between them."""
    rng = np.random.default_rng(seed)
    homes = rng.uniform(0, 60, (12, 2))
    return [homes[i % 12] + rng.normal(0, 0.4, (length, 2)).cumsum(axis=0) for i in range(n)]


@pytest.mark.parametrize("name,band,eps", [("euclidean", None, 60.0), ("manhattan", None, 75.0), ("dtw", None, 40.0), ("dtw", 3, 45.0)])
def test_paths_of_several_places_compare_a_tenth_of_their_pairs(spark, name, band, eps):
    paths = walks(600, 4)
    frame = path_frame(spark, paths)
    every = {(r.i, r.j): r.d for r in sim.affinity(frame, name, band=band).where(f"d <= {eps}").collect()}
    got = {(r.i, r.j): r.d for r in sim.pairs_within(frame, name, eps, band=band, block_rows=32).collect()}
    assert got.keys() == every.keys() and len(got) > 500
    assert all(got[p] == pytest.approx(every[p], abs=1e-9) for p in got)
    assert sim.compared_pairs(frame, name, eps, band=band, block_rows=32) < 600 * 599 / 2 / 10


@pytest.mark.parametrize("name", ["euclidean", "dtw"])
def test_nearest_compares_less_than_the_power_of_one_and_a_half(spark, monkeypatch, name):
    """The k-th distance inside an item's own block bounds its search; ties and copies included."""
    done = []
    for n in (300, 1200):
        paths = walks(n, 8)
        paths[5] = paths[6] = paths[7]
        frame = path_frame(spark, paths)
        counted = spark.sparkContext.accumulator(0)
        m = sim.MEASURES[name]

        def kernel(a, b, ia, ib, eps=None, _m=m, _n=counted):
            _n.add(len(ia))
            return _m.kernel(a, b, ia, ib, eps=eps)

        near = sim.nearest(frame, 3, dataclasses.replace(m, kernel=kernel, metric=False, features=sim._outline if name == "dtw" else sim._totals), block_rows=16)
        got = {(r.id, r.rank): r.other for r in near.collect()}
        done.append(counted.value)
        d = np.full((n, n), np.inf)
        at = np.triu_indices(n, 1)
        d[at] = m.kernel(paths, paths, *at)
        d = np.minimum(d, d.T)
        want = {(i, k + 1): int(o) for i in range(n) for k, o in enumerate(np.lexsort((np.arange(n), d[i]))[:3])}
        assert got == want
    assert done[1] < done[0] * 4**1.5


def test_equal_items_are_found_at_distance_zero(spark):
    paths = walks(60, 2) + walks(60, 2)[:20]
    got = {(r.i, r.j) for r in sim.pairs_within(path_frame(spark, paths), "euclidean", 0.0, block_rows=8).collect()}
    assert got == {(i, i + 60) for i in range(20)}


def test_blocks_stay_inside_their_group(spark):
    paths = walks(80, 3)
    frame = path_frame(spark, paths).withColumn("g", F.col("traj_id") % 3)
    got = {(r.g, r.i, r.j) for r in sim.pairs_within(frame, "euclidean", 60.0, group=["g"], block_rows=8).collect()}
    want = {(i % 3, i, j) for (i, j), d in all_pairs(paths, lambda a, b: float(np.sqrt(((a - b) ** 2).sum(1)).sum())).items() if d <= 60 and i % 3 == j % 3}
    assert got == want


def test_many_boxes_meet_by_buckets(spark, monkeypatch):
    monkeypatch.setattr(blocks, "FEW_BLOCKS", 2)
    paths = walks(300, 6)
    frame = path_frame(spark, paths)
    got = {(r.i, r.j) for r in sim.pairs_within(frame, "dtw", 20.0, block_rows=4).collect()}
    assert got == {(r.i, r.j) for r in sim.affinity(frame, "dtw").where("d <= 20").collect()}
    near = {(r.id, r.rank): r.other for r in sim.nearest(frame, 2, "euclidean", block_rows=4).collect()}
    whole = {(r.id, r.rank): r.other for r in sim.nearest(frame, 2, lambda a, b, ia, ib: sim.euclidean(a, b, ia, ib)).collect()}
    assert near == whole


def test_bounds_never_exceed_the_warping_distance():
    paths = random_paths(40, 12, (1, 2, 6, 9, 14))
    ia, ib = np.triu_indices(40, 1)
    for band in (None, 0, 2, 5):
        bound, d = sim.dtw_bound(paths, paths, ia, ib, band), sim.dtw(paths, paths, ia, ib, band)
        assert (bound <= d * sim.SLACK).all()
        early = sim.dtw(paths, paths, ia, ib, band, eps=6.0)
        assert (np.where(d <= 6.0, d, np.inf) == np.where(early <= 6.0, early, np.inf)).all()


def test_banded_alignment_in_little_memory():
    for band in (None, 0, 1, 3, 20):
        for a in random_paths(5, 21, (7,)):
            for b in random_paths(3, 22, (4, 7, 9)):
                d, steps = sim.warp_path(a, b, band)
                assert d == pytest.approx(dtw_by_hand(a, b, band))
                if math.isinf(d):
                    assert not len(steps)
                    continue
                assert band is None or all(abs(i - j) <= band for i, j in steps)
                assert sum(math.dist(a[i], b[j]) for i, j in steps) == pytest.approx(d)
                assert all((y[0] - x[0], y[1] - x[1]) in ((1, 1), (1, 0), (0, 1)) for x, y in zip(steps, steps[1:]))
    a, b = random_paths(2, 23, (2000,))
    tracemalloc.start()
    d, steps = sim.warp_path(a, b)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert d == pytest.approx(sim.dtw([a], [b], np.zeros(1, int), np.zeros(1, int))[0])


@pytest.mark.parametrize("m,block", [(4, 8), (9, 7), (16, 64), (300, 400)])
def test_profile_along_diagonals_is_that_of_all_windows(spark, monkeypatch, m, block):
    """Neighbour included, ties to the smaller start; constant stretches and repeats make many."""
    monkeypatch.setattr(motifs, "RESET", 5)
    rng = np.random.default_rng(m)
    n = 90 if m < 100 else 900
    v = rng.integers(0, 3, n).astype(float)
    v[10 : 10 + m + 3] = 1.0
    v[-m - 4 :] = v[:m + 4]
    df = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(v)], "k long, i long, v double")
    got = {r.start: (r.neighbour, r.d) for r in motifs.matrix_profile(core.order_log(df, ["k"], ["i"]), "v", m, block=block).collect()}
    w = np.lib.stride_tricks.sliding_window_view(v, m)
    flat = w.max(axis=1) == w.min(axis=1)
    z = np.where(flat[:, None], 0.0, (w - w.mean(axis=1, keepdims=True)) / np.where(flat, 1.0, w.std(axis=1))[:, None])
    for i in range(len(w)):
        best = min(
            (round(0.0 if flat[i] and flat[j] else math.sqrt(m) if flat[i] or flat[j] else float(np.sqrt(((z[i] - z[j]) ** 2).sum())), 6), j)
            for j in range(len(w)) if abs(i - j) > math.ceil(m / 4)
        )
        assert got[i][1] == pytest.approx(best[0], abs=2e-6)
        assert got[i][0] == best[1]


def test_one_search_a_start_gives_the_paths_to_all_its_targets(spark, monkeypatch):
    rng = random.Random(14)
    maze = MazeGrid.from_walls(spark.createDataFrame([(rng.randint(-14, 13), rng.randint(-16, 14)) for _ in range(150)], "x long, y long"))
    starts = [(2 * rng.randint(-12, 12), 2 * rng.randint(-15, 12)) for _ in range(4)]
    pairs = [(*s, rng.randint(-27, 27), rng.randint(-33, 27)) for s in starts for _ in range(30)]
    frame = spark.createDataFrame(pairs, "sx long, sy long, tx long, ty long")
    floods = spark.sparkContext.accumulator(0)

    class Counting(type(maze)):
        def flood(self, found, blocked=None):
            floods.add(len(found))
            return super().flood(found, blocked)

    counting = Counting(**{f.name: getattr(maze, f.name) for f in dataclasses.fields(maze)})
    rows = spatial.shortest_paths(frame, counting).collect()
    assert floods.value == len(set(starts))
    lengths = {(r.sx, r.sy, r.tx, r.ty): r.distance for r in spatial.graph_distances(frame, maze).collect()}
    paths = {}
    for r in rows:
        paths.setdefault((r.sx, r.sy, r.tx, r.ty), {})[r.pos] = (r.x2, r.y2)
    assert {p for p, d in lengths.items() if d < math.inf} == set(paths)
    for (sx, sy, tx, ty), points in paths.items():
        assert len(points) == 2 * lengths[sx, sy, tx, ty] + 1 and points[0] == (sx, sy) and points[len(points) - 1] == (tx, ty)
        assert all(abs(points[i][0] - points[i + 1][0]) + abs(points[i][1] - points[i + 1][1]) in (1, 54) for i in range(len(points) - 1))


def test_a_stored_affinity_grows_by_its_new_items_only(spark, tmp_path):
    from pathlore.sources import files

    paths = walks(70, 15)
    compared = spark.sparkContext.accumulator(0)

    def kernel(a, b, ia, ib):
        compared.add(len(ia))
        return sim.euclidean(a, b, ia, ib)

    def update(old, new, rows):
        before = compared.value
        frame = path_frame(spark, rows)
        got = {(r.i, r.j): r.d for r in files.update_affinity(spark, f"{tmp_path}/{old}", f"{tmp_path}/{new}", frame, kernel, block_rows=16).collect()}
        want = all_pairs(rows, lambda a, b: float(np.sqrt(((a - b) ** 2).sum(1)).sum()))
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
        return compared.value - before

    assert update("none", "a", paths[:60]) == 60 * 59 // 2
    assert update("a", "b", paths) == 10 * 60 + 10 * 9 // 2
    changed = [p + 1 if i == 5 else p for i, p in enumerate(paths)][:65]
    assert update("b", "c", changed) == 64
    assert update("c", "d", changed) == 0


def test_wide_components_are_those_of_the_covariance(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(60, 5)) * [9, 5, 3, 2, 1] @ rng.normal(size=(5, 90)) + rng.normal(size=(60, 90)) * 0.1 + 7
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)] + [(60, None)], "id long, v array<double>").repartition(5)
    monkeypatch.setattr(wide_pca, "PART", 64)
    out, model = cl.reduce_dimensions(frame, "v", 3, wide=50)
    got = {r.id: r.reduced for r in out.collect()}
    assert got.pop(60) is None and set(out.columns) == {"id", "v", "reduced"}
    centred = rows - rows.mean(axis=0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    want = centred @ axes[:3].T
    for c in range(3):
        mine = np.array([got[i][c] for i in range(60)])
        assert min(abs(mine - want[:, c]).max(), abs(mine + want[:, c]).max()) < 1e-6
    assert np.allclose(model.explainedVariance, (s**2 / (s**2).sum())[:3])
    assert model.passes <= 20


def test_wide_components_beyond_the_rank_and_close_variances(spark):
    rng = np.random.default_rng(5)
    few = rng.normal(size=(4, 40))
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(few)], "id long, v array<double>")
    model = wide_pca.fit(frame, "v", 40, 6)
    assert np.allclose(model.pc.T @ model.pc, np.eye(6), atol=1e-9)
    assert np.isclose(model.explainedVariance[:3].sum(), 1) and np.allclose(model.explainedVariance[3:], 0, atol=1e-12)
    same = spark.createDataFrame([(0, [2.0] * 40), (1, [2.0] * 40)], "id long, v array<double>")
    assert not wide_pca.fit(same, "v", 40, 2).explainedVariance.any()
    flat = rng.normal(size=(300, 40))  # variances of random directions lie close together
    frame = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(flat)], "id long, v array<double>")
    model = wide_pca.fit(frame, "v", 40, 2, extra=2)
    values, axes = np.linalg.eigh(np.cov(flat.T))
    assert np.allclose(abs(model.pc.T @ axes[:, ::-1][:, :2]), np.eye(2), atol=1e-6)


def test_histogram_compares_a_pair_once_and_settles_the_edges(spark, monkeypatch):
    rng = np.random.default_rng(6)
    items = [(i, [float(x) for x in rng.integers(0, 6, 2)]) for i in range(60)]  # many equal distances, some on edges
    frame = spark.createDataFrame(items, "traj_id long, points array<double>")
    d = np.array([np.hypot(a[0] - b[0], a[1] - b[1]) for (i, a), (j, b) in itertools.combinations(items, 2)])
    seen = spark.sparkContext.accumulator(0)

    def kernel(a, b, ia, ib):
        seen.add(len(ia))
        x, y = np.stack(a), np.stack(b)
        return np.sqrt(((x[ia] - y[ib]) ** 2).sum(axis=1))

    measure = sim.Measure(kernel, vector=True)
    for bits in (40, 52, 62):  # coarse cells leave more to be looked at
        monkeypatch.setattr(sim, "FINE_BITS", bits)
        got = {r.bin: r.n for r in sim.distance_histogram(frame, measure, 7, block_rows=16).collect()}
        width = (d.max() - d.min()) / 7
        want = np.unique(np.minimum(np.floor((d - d.min()) / width), 6), return_counts=True)
        assert got == dict(zip(want[0].astype(int).tolist(), want[1].tolist()))
    assert seen.value == 3 * len(d)
    assert sim.distance_histogram(frame.limit(1), measure, 7).count() == 0
    banded = sim.distance_histogram(spark.createDataFrame([(0, [(0.0, 0.0)]), (1, [(1.0, 0.0)]), (2, [(0.0, 0.0)] * 9)], "traj_id long, points array<struct<x:double,y:double>>"), "dtw", 4, band=2)
    assert [(r.bin, r.n) for r in banded.collect()] == [(0, 1)]
