"""Sources, slicing, normalisation, masks, validation and player tables on small rows."""

import math

import pytest
from helpers import make_log, tuples
from pyspark.sql import functions as F

from pathlore.operators import core, filters, masks, players, restructure, sequences, slicing, validation
from pathlore.operators import normalize as nz
from pathlore.sources import files, schemas


def test_level_file_is_read_with_its_schema(spark, tmp_path):
    head = ",".join(f'"{n}"' for n in schemas.LEVEL_FILE.names)
    path = tmp_path / "game.csv"
    path.write_text(head + '\n"7","3","1","2","5","web","2024-10-28 10:39:00","12.5","0","2"\n')
    row = files.read_levels(spark, str(path)).first()
    assert (row.level_id, row.duration, row.level_in_session, row.total_levels_played, row.win) == (7, 12.5, 2, 5, 0)
    assert str(row.date_played) == "2024-10-28 10:39:00"


def test_states_trajectories_and_affinity_round_trip(spark, tmp_path):
    log = make_log(spark, [{"level_id": k} for k in (1, 1, 2)])
    files.save_states(log.df, f"{tmp_path}/states")
    back = files.read_states(spark, "missing.csv", f"{tmp_path}/states")
    assert tuples(back, "level_id", "step") == [(1, 0), (1, 1), (2, 0)]
    packed = slicing.trajectories(log, metadata=["lives"], chunk=1)
    files.save_trajectories(packed, f"{tmp_path}/paths")
    assert files.load_trajectories(spark, f"{tmp_path}/paths").count() == 3  # lengths survive, nothing is padded
    edges = spark.createDataFrame([(1, 2, 0.5)], "i long, j long, d double")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    assert files.load_affinity(spark, f"{tmp_path}/aff", ids) is None
    files.save_affinity(edges, ids, f"{tmp_path}/aff")
    assert files.load_affinity(spark, f"{tmp_path}/aff", ids).count() == 1
    other = spark.createDataFrame([(1,), (3,)], "id long")  # same size, other ids
    assert files.load_affinity(spark, f"{tmp_path}/aff", other) is None
    with pytest.raises(ValueError):
        files.read_table(spark, "x", "nothing")


def test_bucketed_log_needs_no_shuffle(spark):
    log = make_log(spark, [{"level_id": k % 3} for k in range(30)])
    files.save_bucketed(log.df, "bucketed_log", 4)
    try:
        stored = files.read_bucketed(spark, "bucketed_log")
        found = core.flag_runs(stored, F.col("lives") == 3, keep_first=True)
        plan = core.near(stored, 1, lambda w: {"p": F.lag("lives").over(w)})._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and found.count() == 3
    finally:
        spark.sql("DROP TABLE bucketed_log")


def test_slices(spark, strategy):
    log = make_log(spark, [{"level_id": 1}] * 60 + [{"level_id": 2}] * 130)
    last = slicing.slice_preset(log, "last_5_seconds").groupBy("level_id").agg(F.min("step"), F.max("step"), F.max("run_step")).collect()
    assert sorted(map(tuple, last)) == [(1, 0, 59, 59), (2, 30, 129, 99)]  # shorter than the slice: everything
    with pytest.raises(ValueError):
        slicing.slice_preset(log, "first_hour")
    with pytest.raises(ValueError):
        slicing.segment(log.df, 5, 4)
    with pytest.raises(ValueError):
        slicing.thin(log.df, 0)


def test_flag_slices(spark, strategy):
    flags = [1, 1, 0, 1, 0, 0, 1, 1]
    log = make_log(spark, [{"pacman_attack": f} for f in flags])
    spans = slicing.flag_intervals(log, F.col("pacman_attack") == 1, 2)
    assert tuples(spans, "start_step", "end_step") == [(1, 6), (4, 7)]  # contexts overlap, the open run is kept
    assert tuples(slicing.flag_intervals(log, F.col("pacman_attack") == 1), "start_step", "end_step") == [(3, 4), (6, 7)]
    rows = slicing.slice_flag_runs(log, F.col("pacman_attack") == 1, 2).groupBy("run").count().collect()
    assert sorted(r["count"] for r in rows) == [4, 6]
    always = make_log(spark, [{"pacman_attack": 1}] * 5)
    assert slicing.flag_intervals(always, F.col("pacman_attack") == 1).count() == 0


def test_first_change(spark, strategy):
    log = make_log(spark, [{"lives": v, "pellets": w} for v, w in [(3, 9), (3, 9), (2, 8), (2, 8), (2, 7), (1, 7), (1, 7)]])
    runs = spark.createDataFrame([(1, 1, 0, 3), (1, 2, 2, 3), (1, 3, 3, 6), (1, 4, 1, 4)], "level_id long, run long, start_step long, end_step long")
    got = {r.run: r.first_changed for r in slicing.first_changes(log, runs, ["lives", "pellets"]).collect()}
    assert got == {1: 1, 2: None, 3: 2, 4: 1}  # same row: first column; no change: none


def test_games(spark, strategy):
    # id 4 is missing; user 2 ends with wins; the loss at 7 claims three levels but a loss lies between
    rows = [(1, 1, 1, 1), (2, 1, 1, 2), (3, 1, 0, 3), (5, 1, 0, 1), (6, 1, 1, 1), (7, 1, 0, 3), (8, 2, 0, 1), (9, 2, 1, 1)]
    df = spark.createDataFrame([(*r, float(r[0]), f"d{r[0]}") for r in rows], "level_id long, user_id long, win int, level long, duration double, date_played string")
    games = restructure.assemble_games(df)
    assert tuples(games, "game_id", "level_ids", "game_duration", "date_played") == [
        (3, [1, 2, 3], 6.0, "d1"), (5, [5], 5.0, "d5"), (7, [6, 7], 13.0, "d6"), (8, [8], 8.0, "d8")]
    assert tuples(restructure.assign_games(df).where("game_id is null"), "level_id") == [(9,)]
    assert tuples(restructure.level_numbers(df.drop("level")), "level_id", "level")[:5] == [(1, 1), (2, 2), (3, 3), (5, 1), (6, 1)]


def test_normalisation_edges(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame([(1, 2.0, 1.0, inf, "4"), (2, 2.0, None, -inf, "x"), (3, 2.0, 3.0, nan, "6"), (4, 2.0, inf, inf, None)], "i long, c double, v double, n double, t string")
    got = nz.normalize_columns(df, {"c": nz.minmax(), "v": nz.distance(), "n": nz.distance(), "t": nz.standardize()}).orderBy("i").collect()
    assert [r.c for r in got] == [0.0] * 4
    assert [r.v for r in got] == [0.0, 0.0, 1.0, inf]
    assert got[0].n == inf and got[1].n == -inf and (got[2].n is None or math.isnan(got[2].n))
    s = math.sqrt(2)
    assert [round(r.t, 6) for r in got] == [round(-1 / s, 6), 0.0, round(1 / s, 6), 0.0]
    assert [r.v for r in nz.normalize_columns(df, {"v": nz.user_function(lambda c: c * 2)}).orderBy("i").collect()][0] == 2.0
    with pytest.raises(KeyError):
        nz.Normalizer(strict=True).normalize(df)
    with pytest.raises(KeyError):
        nz.Normalizer().normalize(df, columns=["i", "missing"])
    with pytest.raises(ValueError):
        nz.position("z")


def test_masks(spark, strategy):
    log = make_log(spark, [{"level_id": k} for k in range(40) for _ in range(100)])
    for dist in ("random", "geometric"):
        spec = masks.NoiseMask(0.3, 4, distribution=dist, seed=1)
        out = masks.noise_mask(log, ["Pacman_X"], spec)
        rate = 1 - out.agg(F.avg(F.col("keep").cast("int"))).first()[0]
        assert abs(rate - 0.3) < 0.06
        assert tuples(out, "level_id", "step", "keep") == tuples(masks.noise_mask(log, ["Pacman_X"], spec), "level_id", "step", "keep")
        if dist == "geometric":
            runs = core.flag_runs(core.OrderedLog(out, ("level_id",), "step", log.block), ~F.col("keep"), keep_first=True)
            assert 3 < runs.agg(F.avg("n_rows")).first()[0] < 5
    with pytest.raises(ValueError):
        masks.NoiseMask(distribution="block")
    with pytest.raises(ValueError):
        masks.NoiseMask(mode="other")
    spec = masks.NoiseMask(0.98, 20).harder()
    assert (spec.ratio, spec.mean_length) == (1.0, 20)


def test_sequence_arguments_are_checked(spark):
    log = make_log(spark, [{}] * 3)
    with pytest.raises(ValueError):
        sequences.make_sequences(log, "Unknown")
    with pytest.raises(ValueError):
        sequences.make_sequences(log, "Pacman", normalization="level")
    out = sequences.make_sequences(log, "Pacman", "whole_level", pad=-999.0)
    assert out.count() == 3


def test_agreement_special_cases(spark):
    rows = [(i % 3, float(i % 3), 1.0, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "label long, same double, one double, single double").withColumn("none", F.lit(None).cast("double"))
    got = {r.validation_set: r for r in validation.validate(df, "label", ["same", "one", "single", "none"]).collect()}
    assert (got["same"].ARI, got["same"].NMI, got["same"].AMI) == (1.0, pytest.approx(1.0), pytest.approx(1.0))
    assert (got["one"].ARI, got["one"].NMI) == (0.0, 0.0) and got["one"].AMI == pytest.approx(0.0, abs=1e-9)
    assert got["single"].ARI == 0.0 and got["single"].AMI == pytest.approx(0.0, abs=1e-9)
    assert all(math.isnan(got["none"][c]) for c in ("ARI", "NMI", "AMI"))


def test_validation_labels_drop_empty_columns(spark):
    df = spark.createDataFrame([(1, 0.0, 3.0, 0.0), (2, 2.0, 0.0, 0.0), (3, None, None, None)], "id long, a double, Aggression3_value double, z double")
    got = tuples(validation.validation_labels(df, ["a", "Aggression3_value", "z"]), "id", "a", "Aggression3_value", "z")
    assert got == [(1, -1.0, 3.0, None), (2, 1.0, -1.0, None), (3, -1.0, -1.0, None)]


def test_player_tables(spark, strategy):
    flow = spark.createDataFrame([(1, 1, 4.0), (1, 2, 6.0), (1, 3, 5.0), (2, 1, 3.0), (3, 9, 1.0)], "user_id long, total_levels_played long, FLOW double")
    games = spark.createDataFrame([(1, 1, 1, 10.0), (1, 2, 2, 30.0), (1, 3, 3, 20.0), (2, 1, 1, 40.0), (4, 1, 1, 5.0)], "user_id long, total_levels_played long, total_games_played long, max_score double")
    out = players.flow_table(flow, games)
    assert out.columns == ["user_id", "FLOW", "total_games_played", "max_score", "log(max_score)", "inv(max_score)", "log(inv(max_score))",
                           "log(total_games_played)", "flow_z_score", "cum_score", "log(cum_score)", "score_deviation"]
    rows = {(r.user_id, r.total_games_played): r for r in out.collect()}
    assert len(rows) == 4 and rows[1, 2]["inv(max_score)"] == 11.0 and rows[1, 3].cum_score == 60.0
    assert rows[1, 2].flow_z_score == pytest.approx(1.0) and rows[2, 1].flow_z_score is None
    assert rows[2, 1].score_deviation == pytest.approx(0.0)
    assert sum(rows[1, i].score_deviation for i in (1, 2, 3)) == pytest.approx(0.0)
    q = {(r.attribute, r.q): r.value for r in players.quantiles(games, ["max_score"], [0.0, 0.25, 0.5, 1.0]).collect()}
    assert q == {("max_score", 0.0): 5.0, ("max_score", 0.25): 10.0, ("max_score", 0.5): 20.0, ("max_score", 1.0): 40.0}
    hist = {r.bin: r.n for r in players.histogram(games, "max_score", 5).collect()}
    assert hist == {0: 2, 2: 1, 3: 1, 4: 1}  # 5, 10 | 20 | 30 | 40 in bins of width 7


def test_selection_guards(spark):
    df = make_log(spark, [{"level_id": 1}, {"level_id": 1}, {"level_id": 2}]).df
    ids = df.withColumn("gid", F.col("level_id") * 10 + F.col("i"))
    assert filters.states_in_range(ids, 10, 11, "gid").count() == 2
    for lo, hi in ((10, 20), (50, 90)):  # two levels, none
        with pytest.raises(ValueError):
            filters.states_in_range(ids, lo, hi, "gid")
    with pytest.raises(ValueError):
        filters.states_for_levels(df, [])
    with pytest.raises(ValueError):
        filters.select_features(df, "nothing")


def test_padded_arrays_have_one_length(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, [5.0])], "k int, v array<double>")
    got = {r.k: r.v for r in slicing.pad_arrays(df, "v", -1.0).collect()}
    assert got == {1: [1.0, 2.0], 2: [-1.0, -1.0], 3: [5.0, -1.0]}
    assert slicing.pad_arrays(df.limit(0), "v").count() == 0


def test_embedded_sequences_cluster_by_their_shape(spark):
    from pathlore.operators import analysis

    rows = [(i, [float(i % 3 == 0) * 50 + i * 0.01, 1.0, float(i % 3 == 0) * -40]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, flat array<double>")
    got = {r.id: r.label for r in analysis.embedding_labels(df, 2).collect()}
    assert got == {i: int(i % 3 == 0) for i in range(30)}  # the larger cluster is 0
    own = analysis.embedding_labels(df, 2, encoder=lambda values: [[v[0], v[2]] for v in values])
    assert {r.id: r.label for r in own.collect()} == got


def test_a_table_that_is_no_maze_is_refused(spark):
    from helpers import make_log

    from pathlore.operators.pellets import MAX_POINTS, eaten_pellets

    points = spark.range(MAX_POINTS + 1).select(F.col("id").cast("double").alias("px"), F.lit(0.5).alias("py"))
    with pytest.raises(ValueError):
        eaten_pellets(make_log(spark, [{}]), points)
