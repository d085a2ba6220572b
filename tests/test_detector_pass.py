"""One pass for all detectors against each detector on its own, on levels, on slices and split into blocks."""

import random

import pytest
from helpers import make_log
from pyspark.sql import functions as F

from pathlore.operators import behaviour as bh
from pathlore.operators import core, detector_pass, sequences
from pathlore.operators.core import OrderedLog
from pathlore.operators.spatial import MazeGrid

OUT = ["level_id", "start_step", "end_step", "start_t", "end_t", "value", "pill", "died", "instant_step"]


def busy_rows(seed, n=160, levels=3):
    """Runs, captures, traps, close calls and deaths, each often."""
    rng = random.Random(seed)
    rows, state = [], {}
    for level in range(levels):
        attack, lives, pills = 0, 3, 4
        x, y = 0.5, 10.5
        for i in range(n if level else 1):
            if rng.random() < 0.12:
                attack = 1 - attack
                pills = max(0, pills - attack)
            if rng.random() < 0.05 and lives:
                lives -= 1
            if rng.random() < 0.03:
                pills, lives = rng.randint(0, 4), rng.randint(0, 3)
            x, y = min(13.5, max(-13.5, x + rng.choice([-0.5, 0, 0.5]))), min(13.5, max(-16.5, y + rng.choice([-0.5, 0, 0.5])))
            row = {"level_id": level, "pacman_attack": attack, "lives": lives, "powerPellets": pills, "Pacman_X": x, "Pacman_Y": y}
            for g in (1, 2, 3, 4):
                row[f"ghost{g}_state"] = rng.choice([0, 1, 3, 3, 4])
                row[f"Ghost{g}_X"], row[f"Ghost{g}_Y"] = x + rng.randint(-6, 6) / 2, y + rng.randint(-6, 6) / 2
            rows.append(row)
    return rows


def walls(spark):
    rng = random.Random(2)
    return MazeGrid.from_walls(spark.createDataFrame([(rng.randint(-14, 13), rng.randint(-16, 14)) for _ in range(200)], "x long, y long"))


def as_rows(df, *key):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    return sorted((tuple(plain(r[c]) for c in (*key, *OUT[1:])) for r in df.collect()), key=str)


PARAMS = [
    {},
    {
        "Aggression1": {"closeness": "Distance to house", "boundary_distance": 12.0, "context": 3}, "Aggression3": {"context": 2},
        "Aggression4": {"search_window": 4, "value_threshold": 0, "distance_threshold": 9, "context": 1}, "Aggression6": {"only_closest": False, "normalize": False, "context": 2},
        "Caution1": {"distance_threshold": 5, "merge_gap": 2, "context": 4}, "Caution2a": {"method": "average"}, "Caution3": {"close_distance": 2.5, "search_window": 3, "context": 2},
    },
]


@pytest.mark.parametrize("over", PARAMS)
def test_every_detector_gives_what_it_gives_alone(spark, strategy, over):
    log, set_up = make_log(spark, busy_rows(5)), bh.Behaviours(maze=walls(spark), overrides=over)
    got = set_up.instances(log).collect()
    for name in bh.DETECTORS:
        alone = as_rows(set_up.detect(log, name), "level_id")
        both = sorted((tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in OUT) for r in got if r["name"] == name), key=str)
        assert both == alone, name
        assert alone


def test_slices_are_logs_of_their_own(spark, strategy):
    """The same detectors over (level, run) as over a log in which every slice is a level."""
    log, set_up = make_log(spark, busy_rows(9)), bh.Behaviours(maze=walls(spark))
    cut = sequences.cut(log, "pacman_attack", context=6)
    slices = OrderedLog(cut.drop("step").withColumnRenamed("run_step", "step"), ("level_id", "run"), "step", log.block)
    one = slices.df.withColumn("level_id", F.col("level_id") * 1000 + F.col("run")).drop("run")
    names = ["Aggression1", "Aggression3", "Aggression4", "Aggression6", "Caution1"]
    got = set_up.instances(slices, names).withColumn("level_id", F.col("level_id") * 1000 + F.col("run"))
    for name in names:
        alone = as_rows(set_up.detect(OrderedLog(one, ("level_id",), "step", log.block), name), "level_id")
        assert as_rows(got.where(F.col("name") == name), "level_id") == alone, name


def test_the_log_is_read_and_exchanged_once(spark):
    log, set_up = make_log(spark, busy_rows(3)), bh.Behaviours(maze=walls(spark))
    seen = []
    plain = core.cut_lineage

    def watched(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(core, "cut_lineage", watched)
        detector_pass.mark(log, {n: set_up.parameters(n) for n in bh.DETECTORS})
    (plan,) = seen
    initial = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert initial.count("Exchange hashpartitioning") == 1 and initial.count("Scan") == 1


def test_rows_are_marked_in_one_direction(spark, monkeypatch):
    """No window of the marks goes back through all rows; close calls do so in the keys that have one."""
    log, set_up, seen = make_log(spark, busy_rows(3, 20)), bh.Behaviours(maze=walls(spark)), []
    monkeypatch.setattr(core, "cut_lineage", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), df)[1])
    detector_pass.mark(log, {"Caution3": set_up.parameters("Caution3")})
    assert "Window" in seen[0] and "DESC" not in seen[0]


def test_nothing_chosen_or_no_maze_is_an_error(spark):
    log = make_log(spark, busy_rows(3, 5))
    with pytest.raises(ValueError):
        bh.Behaviours().instances(log)
    with pytest.raises(ValueError):
        bh.Behaviours().instances(log, [])
