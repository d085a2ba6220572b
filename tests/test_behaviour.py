import random

import pytest
from helpers import make_log, tuples
from pyspark.sql import functions as F

from pathlore.operators import behaviour as bh
from pathlore.operators.spatial import MazeGrid

NEAR = {"pacman_attack": 1, "Pacman_X": 0.5, "Pacman_Y": 3.5, "Ghost1_X": 5.5, "Ghost1_Y": 0.5, "ghost1_state": 3}
FAR = {"pacman_attack": 1, "Pacman_X": 12.5, "Pacman_Y": 3.5, "Ghost1_X": 5.5, "Ghost1_Y": 0.5, "ghost1_state": 3}


def test_hunt_near_house_ends(spark, strategy):
    rows = [NEAR] * 2 + [FAR] + [{}] + [NEAR] * 3 + [{}] * 2 + [NEAR] * 4
    log = make_log(spark, rows)
    got = tuples(bh.hunt_near_house(log), "start_step", "end_step", "value", "start_t")
    # active on row 0: kept; ended by attack -> 0: kept with its own start time; open on the last row: dropped
    assert [g[:3] for g in got] == [(0, 2, 2.0), (4, 7, 3.0)]
    assert got[1][3] == pytest.approx(0.2)
    wide = tuples(bh.hunt_near_house(log, bh.HuntNearHouse(context=15)), "start_step", "end_step")
    assert wide == [(0, 12), (0, 12)]


def test_captures_count_every_entity(spark, strategy):
    rows = [{"ghost1_state": 3, "ghost2_state": 3}, {"ghost1_state": 4, "ghost2_state": 4}, {"ghost1_state": 3}, {"ghost1_state": 4}, {}, {"ghost3_state": 4}]
    got = tuples(bh.captures(make_log(spark, rows), bh.Captures(context=2)), "instant_step", "start_step", "end_step")
    assert got == [(1, 0, 3), (1, 0, 3), (3, 1, 5)]


def approaching(distance, **more):
    return {"Pacman_X": 0.5, "Pacman_Y": 10.5, "Ghost1_X": 0.5, "Ghost1_Y": 10.5 - distance, "ghost1_state": 1, **more}


def test_hunt_after_pill_stops(spark, strategy):
    pill = [{}, {"pacman_attack": 1}, {"pacman_attack": 1}]
    # window ends by itself
    rows = pill + [approaching(d) for d in (4.5, 4, 3.5, 3, 2.5)]
    p = bh.HuntAfterPill(search_window=3)
    log = make_log(spark, rows)
    assert tuples(bh.hunt_after_pill(log, p), "start_step", "end_step", "value", "died", "pill") == [(3, 5, 3.0, False, 1)]
    # death inside the window
    rows = pill + [approaching(4.5), approaching(4), approaching(3.5, lives=2), approaching(3, lives=2)]
    assert tuples(bh.hunt_after_pill(make_log(spark, rows), p), "start_step", "end_step", "value", "died") == [(3, 4, 2.0, True)]
    # level end inside the window
    rows = pill + [approaching(4.5), approaching(4)]
    assert tuples(bh.hunt_after_pill(make_log(spark, rows), p), "start_step", "end_step", "value", "died") == [(3, 3, 1.0, False)]
    # a new pill ends the search; its row is not scored; two pills in one quadrant stay two rows
    rows = pill + [approaching(4.5), approaching(4), approaching(3.5, pacman_attack=1), approaching(3), approaching(2.5)]
    got = tuples(bh.hunt_after_pill(make_log(spark, rows), p), "start_step", "end_step", "value", "pill")
    assert got == [(3, 4, 1.0, 1), (6, 6, 1.0, 1)]
    # an entity that appears counts as an approach; without pills left nothing is searched
    rows = pill + [{}, approaching(4)]
    assert tuples(bh.hunt_after_pill(make_log(spark, rows), p), "value") == [(1.0,)]
    assert tuples(bh.hunt_after_pill(make_log(spark, rows, powerPellets=0), p), "value") == []
    # nor where the last pill goes inside the running attack
    rows = [{}, {"pacman_attack": 1, "powerPellets": 1}] + [{"pacman_attack": 1, "powerPellets": 0}] * 2 + [approaching(d, powerPellets=0) for d in (4.5, 4, 3.5, 3)]
    assert tuples(bh.hunt_after_pill(make_log(spark, rows), p), "value") == []


def test_chase_or_collect(spark, strategy):
    a = {"pacman_attack": 1}
    # starts in attack: ignored until the first 0 -> 1; an entity that appears is no approach here
    rows = [approaching(4, **a), approaching(3, **a), {}, {**a}, approaching(4.5, **a), approaching(4, **a), approaching(3.5, **a), {}]
    log = make_log(spark, rows)
    got = tuples(bh.chase_or_collect(log), "start_step", "end_step", "value")
    assert got == [(3, 7, 2 / 4)]
    assert tuples(bh.chase_or_collect(log, bh.ChaseOrCollect(normalize=False)), "value") == [(2.0,)]
    # a tie for the closest takes the first entity, which does not approach; counting all finds the other one
    tie = [{}, a, {**approaching(3, **a), "Ghost2_X": 0.5, "Ghost2_Y": 14.5, "ghost2_state": 1},
           {**approaching(3, **a), "Ghost2_X": 0.5, "Ghost2_Y": 13.5, "ghost2_state": 1}, {}]
    log = make_log(spark, tie)
    assert tuples(bh.chase_or_collect(log), "value") == []
    assert tuples(bh.chase_or_collect(log, bh.ChaseOrCollect(only_closest=False, normalize=False)), "value") == [(1.0,)]


def trap_log(spark, flags, lives=None, attack=()):
    rows = [{"lives": (lives or [3] * len(flags))[i], "pacman_attack": int(i in attack)} for i in range(len(flags))]
    log = make_log(spark, rows)
    marked = [i for i, f in enumerate(flags) if f]
    return log.having(log.df.withColumn("trapped", F.col("step").isin(*marked) if marked else F.lit(False)))


def test_trap_instances(spark, strategy):
    # free again; died at once (one row, starts a row earlier); open at the end with no lives
    log = trap_log(spark, [0, 1, 1, 0, 0, 1, 0, 0, 1, 1, 1], [3, 3, 3, 3, 3, 3, 2, 2, 1, 1, 0])
    got = tuples(bh.trap_instances(log), "start_step", "end_step", "value", "died")
    assert got == [(1, 3, 2.0, False), (4, 5, 1.0, True), (8, 9, 2.0, True)]
    # the last row never counts, it only closes an instance
    log = trap_log(spark, [0, 1, 1, 1], [3, 3, 3, 0])
    assert tuples(bh.trap_instances(log), "start_step", "end_step", "value", "died") == [(1, 2, 2.0, True)]
    log = trap_log(spark, [0, 1, 1], [0, 0, 0])
    assert tuples(bh.trap_instances(log), "start_step", "end_step", "died") == [(1, 2, True)]
    # a death splits a trapped stretch
    log = trap_log(spark, [1, 1, 1, 1, 0, 0], [3, 3, 2, 2, 2, 2])
    assert tuples(bh.trap_instances(log), "start_step", "end_step", "value", "died") == [(0, 1, 2.0, True), (2, 4, 2.0, False)]


def test_trapped_flag_needs_two_near_and_a_cut(spark):
    maze = MazeGrid.from_walls(spark.createDataFrame([], "x long, y long"))
    near = {"Pacman_X": 0.5, "Pacman_Y": 10.5, "ghost1_state": 1, "ghost2_state": 1, "Ghost1_X": 1.5, "Ghost1_Y": 10.5, "Ghost2_X": -0.5, "Ghost2_Y": 10.5}
    one = {**near, "ghost2_state": 0}
    got = tuples(bh.trapped_flag(make_log(spark, [near, one, {**near, "pacman_attack": 1}]), maze).df, "step", "trapped")
    assert got == [(0, False), (1, False), (2, False)]  # an open field leaves a way round
    # a corridor from the agent to its goal (-12.5, -9.5), entities on both sides
    walls = [(x, y) for x in range(-14, 14) for y in range(-16, 15)]
    open_cells = {(x, -19) for x in range(-27, 28)}
    frame = spark.createDataFrame([(x, y) for x, y in walls if not any((2 * x + i, 2 * y - j) in open_cells for i in (0, 1, 2) for j in (0, 1, 2))], "x long, y long")
    maze = MazeGrid.from_walls(frame, tunnel=None)
    base = {"Pacman_X": 0.5, "Pacman_Y": -9.5, "ghost1_state": 1, "ghost2_state": 1, "Ghost1_Y": -9.5, "Ghost2_Y": -9.5, "Ghost2_X": 3.5}
    assert maze.free[-19 - maze.y0].all()
    rows = [{**base, "Pacman_Y": -9.5, "Ghost1_X": -2.5}, {**base, "Ghost1_X": 2.5}]
    # quadrant 2 (x > 0, y < 0) heads for (-12.5, 8.5), which the corridor never reaches
    assert tuples(bh.trapped_flag(make_log(spark, rows), maze).df, "step", "trapped") == [(0, True), (1, True)]


def test_mean_distance_without_rows_is_zero(spark, strategy):
    log = make_log(spark, [{"pacman_attack": 1}, {"pacman_attack": 1}])
    assert tuples(bh.mean_distance(log, False), "value") == [(0.0,)]
    log = make_log(spark, [approaching(4), approaching(2), {}])
    assert tuples(bh.mean_distance(log, False), "value") == [(3.0,)]
    assert tuples(bh.mean_distance(log, False, bh.MeanDistance("average")), "value") == [(3.0,)]


def close_calls_by_hand(rows, close, window):
    """Straight scan over one level: rows are (near, attack, lives)."""
    out, start, last = [], None, len(rows) - 1
    for i, (near, attack, lives) in enumerate(rows):
        if i == last:
            if start is not None:
                out.append((start, i))
        elif i + window <= last:
            if start is None:
                if near and not attack and i + window < last and rows[i + window][2] >= lives:
                    start = i
            elif i >= start + window:
                if attack or not near:
                    out.append((start, i))
                    start = None
                elif rows[i + 1][2] < lives:
                    start = None
    return out


@pytest.mark.parametrize("seed", range(2))
def test_close_calls_match_a_scan(spark, strategy, seed):
    rng = random.Random(seed)
    rows, plain, lives = [], [], 9
    for _ in range(80):
        near, attack = rng.random() < 0.7, rng.random() < 0.1
        lives -= rng.random() < 0.08
        plain.append((near, attack, lives))
        rows.append(approaching(1 if near else 8, pacman_attack=int(attack), lives=int(lives)))
    log = make_log(spark, rows)
    for window in (1, 4):
        got = tuples(bh.close_calls(log, bh.CloseCalls(search_window=window)), "start_step", "end_step")
        assert got == close_calls_by_hand(plain, 1.5, window)


def test_registry_names_and_parameters(spark):
    assert bh.pick("Aggression") == ["Aggression1", "Aggression3", "Aggression4", "Aggression6"]
    assert bh.pick("Caution1") == ["Caution1"]
    assert bh.category("Caution2a") == "Caution"
    for bad in ("Aggression2", "Nothing"):
        with pytest.raises(ValueError):
            bh.pick([bad])
    tool = bh.Behaviours(overrides={"Aggression3": {"context": 20}})
    assert tool.parameters("Aggression3").context == 20
    assert tool.parameters("Aggression3", context=5).context == 5
    with pytest.raises(ValueError):
        tool.parameters("Aggression3", window=3)
    log = make_log(spark, [{"ghost1_state": 3}, {"ghost1_state": 4}, {}])
    row = tool.summary(log, ["Aggression3", "Aggression4"]).first().asDict()
    assert row == {"level_id": 1, "Aggression3_value": 1.0, "Aggression3_instances": 1, "Aggression4_value": 0.0, "Aggression4_instances": 0}


def test_bad_levels_are_set_aside(spark):
    log = make_log(spark, [{"level_id": 1}, {"level_id": 2}, {"level_id": 2, "Ghost1_X": float("nan")}])
    good, bad = bh.split_valid(log.df, ["level_id"])
    assert tuples(good, "level_id") == [(1,)]
    assert tuples(bad, "level_id", "bad_rows") == [(2, 1)]


def test_a_detector_without_its_maze_is_an_error(spark):
    log = make_log(spark, [{}, {}])
    for names in ("all", "Caution", ["Caution1"], []):
        with pytest.raises(ValueError):
            bh.Behaviours().summary(log, names)
        with pytest.raises(ValueError):
            bh.Behaviours().instances(log, names)
