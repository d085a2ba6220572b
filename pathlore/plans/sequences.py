"""Registered queries: slicing, masks, sequence preparation."""

from pyspark.sql import functions as F

from pathlore.functions.expressions import live_distance, mixed_uniform_sql
from pathlore.operators import core, masks, sequences, slicing
from pathlore.plans.registry import query
from pathlore.sources.adapters import PATHS_SQL, STATE_SQL, path_steps, paths, state_log, table

ST = f"WITH {STATE_SQL} "
PT = f"WITH {PATHS_SQL} "


def _slice_sql(lo, hi):
    return ST + f"""SELECT level_id, step, step - {lo} AS run_step, game_state_id FROM states WHERE step >= {lo} AND step < {hi}"""


@query("l1_slice_first", _slice_sql("0", "50"))
def l1_first(spark, sf):
    return slicing.slice_preset(state_log(spark, sf), "first_50_steps").select("level_id", "step", "run_step", "game_state_id")


@query("l1_slice_last", _slice_sql("greatest(n_rows - 100, 0)", "n_rows"))
def l1_last(spark, sf):
    return slicing.slice_preset(state_log(spark, sf), "last_5_seconds").select("level_id", "step", "run_step", "game_state_id")


@query("l1_slice_negative_bounds", _slice_sql("greatest(n_rows - 40, 0)", "n_rows - 10"))
def l1_negative(spark, sf):
    return slicing.slice_rows(state_log(spark, sf), -40, -10).select("level_id", "step", "run_step", "game_state_id")


def runs_sql(flag, src="states", prefix="fr"):
    """Islands of a flag in the way of the slicer: not opened on row 0, open ones end at the last row."""
    return f"""{prefix}1 AS (SELECT *, ({flag}) AS f, lag({flag}) OVER w AS p, lead(step) OVER w AS nx FROM {src}
 WINDOW w AS (PARTITION BY level_id ORDER BY step)),
{prefix}2 AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(p, false) THEN 1 ELSE 0 END)
 OVER (PARTITION BY level_id ORDER BY step) AS run FROM {prefix}1),
{prefix}runs AS (SELECT level_id, CAST(run AS BIGINT) AS run, min(step) AS start_step, max(step) AS last_step,
 max(coalesce(nx, step)) AS end_step, count(*) AS n_rows, max(nx IS NULL) AS is_open FROM {prefix}2 WHERE f GROUP BY 1, 2)"""


@query(
    "l2_flag_runs",
    ST + f", {runs_sql('pacman_attack = 1')} SELECT * FROM frruns WHERE start_step > 0",
)
def l2(spark, sf):
    return core.flag_runs(state_log(spark, sf), F.col("pacman_attack") == 1)


_SPANS = """spans AS (SELECT r.level_id, run, greatest(start_step - {c}, 0) AS start_step,
 least(end_step + {c}, b.final_step) AS end_step FROM frruns r JOIN (SELECT level_id, max(step) AS final_step FROM states GROUP BY 1) b
 USING (level_id) WHERE start_step > 0)"""


@query(
    "l2_slice_flag_runs",
    ST + f""", {runs_sql('pacman_attack = 1')}, {_SPANS.format(c=3)}
 SELECT s.level_id, run, step, step - start_step AS run_step, game_state_id FROM spans s JOIN states t
 ON s.level_id = t.level_id AND step BETWEEN start_step AND end_step""",
)
def l2_slice(spark, sf):
    out = slicing.slice_flag_runs(state_log(spark, sf), F.col("pacman_attack") == 1, context=3)
    return out.select("level_id", "run", "step", "run_step", "game_state_id")


_FIRST = f""", {runs_sql('pacman_attack = 1')}, {_SPANS.format(c=2)},
sl AS (SELECT s.level_id, run, start_step, step, """ + ", ".join(f"powerpelletstate_{j}" for j in (1, 2, 3, 4)) + """ FROM spans s JOIN states t
 ON s.level_id = t.level_id AND step BETWEEN start_step AND end_step),
f0 AS (SELECT *, """ + ", ".join(f"first_value(powerpelletstate_{j}) OVER w AS b{j}" for j in (1, 2, 3, 4)) + """ FROM sl
 WINDOW w AS (PARTITION BY level_id, run ORDER BY step)),
f1 AS (SELECT level_id, run, """ + ", ".join(
    f"coalesce(min(CASE WHEN powerpelletstate_{j} <> b{j} THEN step END), 1000000000) AS m{j}" for j in (1, 2, 3, 4)
) + " FROM f0 GROUP BY 1, 2)"


@query(
    "l3_runs_by_first_change",
    ST + _FIRST + """ SELECT level_id, run, CAST(CASE WHEN least(m1, m2, m3, m4) = 1000000000 THEN NULL WHEN m1 = least(m1, m2, m3, m4) THEN 1
 WHEN m2 = least(m1, m2, m3, m4) THEN 2 WHEN m3 = least(m1, m2, m3, m4) THEN 3 ELSE 4 END AS BIGINT) AS first_changed FROM f1""",
)
def l3(spark, sf):
    log = state_log(spark, sf, "powerPellets")
    spans = slicing.flag_intervals(log, F.col("pacman_attack") == 1, 2)
    return slicing.first_changes(log, spans, [f"powerpelletstate_{j}" for j in (1, 2, 3, 4)])


@query(
    "l4_slice_changes",
    ST + """SELECT level_id, CAST(row_number() OVER (PARTITION BY level_id ORDER BY step) AS BIGINT) AS run,
 greatest(step - 5, 0) AS start_step, least(step + 5, n_rows - 1) AS end_step FROM
 (SELECT *, lag(direction) OVER (PARTITION BY level_id ORDER BY step) AS pd FROM states) WHERE direction <> pd""",
)
def l4(spark, sf):
    return slicing.slice_changes(state_log(spark, sf), "direction", 5)


@query("l4_slice_event_flag", ST + f", {runs_sql('ghost1_state = 3')} SELECT level_id, run, start_step, end_step FROM frruns WHERE start_step > 0")
def l4_flag(spark, sf):
    return slicing.flag_intervals(state_log(spark, sf), F.col("ghost1_state") == 3).select("level_id", "run", "start_step", "end_step")


@query("l5_segment", PT + "SELECT traj_id, step, x, y FROM path_steps WHERE step >= 4 AND step < 20")
def l5(spark, sf):
    return slicing.segment(path_steps(spark, sf).drop("label"), 4, 20)


@query(
    "l6_rebase_scores",
    ST + f""", {runs_sql('pacman_attack = 1')}, {_SPANS.format(c=0)}
 SELECT s.level_id, run, step, score - first_value(score) OVER (PARTITION BY s.level_id, run ORDER BY step) AS score
 FROM spans s JOIN states t ON s.level_id = t.level_id AND step BETWEEN start_step AND end_step""",
)
def l6(spark, sf):
    cut = slicing.slice_flag_runs(state_log(spark, sf, "score"), F.col("pacman_attack") == 1)
    return slicing.rebase_scores(cut, ["level_id", "run"]).select("level_id", "run", "step", "score")


@query("l7_thin", PT + "SELECT traj_id, step, x, y FROM path_steps WHERE step % 5 = 0")
def l7(spark, sf):
    return slicing.thin(path_steps(spark, sf).drop("label"), 5)


@query(
    "l8_pad_sequences",
    ST + """, sl AS (SELECT level_id, step AS run_step, Pacman_X, Pacman_Y FROM states),
 n AS (SELECT level_id, count(*) AS n FROM sl GROUP BY 1)
 SELECT * FROM sl UNION ALL SELECT level_id, i AS run_step, -999.0::DOUBLE, -999.0::DOUBLE FROM n,
 unnest(range(n, (SELECT max(n) FROM n))) AS u(i)""",
)
def l8(spark, sf):
    cut = slicing.slice_preset(state_log(spark, sf), "whole_level")
    return slicing.pad_sequences(cut, ["level_id"], ["Pacman_X", "Pacman_Y"])


@query(
    "l9_sort_across_columns",
    ST + "SELECT game_state_id, l[1] AS Ghost1_X, l[2] AS Ghost2_X, l[3] AS Ghost3_X, l[4] AS Ghost4_X FROM "
    "(SELECT game_state_id, list_sort([Ghost1_X, Ghost2_X, Ghost3_X, Ghost4_X]) AS l FROM states)",
)
def l9(spark, sf):
    cols = [f"Ghost{g}_X" for g in (1, 2, 3, 4)]
    return slicing.sort_across_columns(state_log(spark, sf).df.select("game_state_id", *cols), cols)


DIST_SQL = ", ".join(
    f"""CASE WHEN ghost{g}_state NOT IN (0, 4) AND NOT (Ghost{g}_X > -3.5 AND Ghost{g}_X < 3.5 AND Ghost{g}_Y > -2.5 AND Ghost{g}_Y < 1.5)
 THEN abs(Pacman_X - Ghost{g}_X) + abs(Pacman_Y - Ghost{g}_Y) ELSE 'inf'::DOUBLE END AS Ghost{g}_distance"""
    for g in (1, 2, 3, 4)
)
_D = [f"Ghost{g}_distance" for g in (1, 2, 3, 4)]
FINITE = "CASE WHEN {c} < 'inf'::DOUBLE THEN {c} END"


def _scaled(c, over):
    lo, hi = f"min({FINITE.format(c=c)}) OVER {over}", f"max({FINITE.format(c=c)}) OVER {over}"
    return f"""CASE WHEN {lo} IS NULL OR {c} = 'inf'::DOUBLE THEN {c}
 ELSE ({c} - {lo}) / greatest({hi} - {lo}, 1.1920928955078125e-07::DOUBLE) END AS {c}"""


@query(
    "l10_make_sequences",
    ST + f""", dd AS (SELECT *, {DIST_SQL} FROM states), {runs_sql('pacman_attack = 1', 'dd')}, {_SPANS.format(c=4)},
 cut AS (SELECT s.level_id, run, step - start_step AS run_step, {', '.join(_D)},
  score - first_value(score) OVER (PARTITION BY s.level_id, run ORDER BY step) AS score
  FROM spans s JOIN dd t ON s.level_id = t.level_id AND step BETWEEN start_step AND end_step),
 nn AS (SELECT level_id, run, run_step, list_sort([{', '.join(_D)}]) AS l, score FROM (SELECT level_id, run, run_step,
 {', '.join(_scaled(c, '(PARTITION BY level_id, run)') for c in _D)},
 (score - min(score) OVER (PARTITION BY level_id, run)) / greatest(max(score) OVER (PARTITION BY level_id, run) - min(score) OVER (PARTITION BY level_id, run), 1.1920928955078125e-07::DOUBLE) AS score
 FROM cut))
 SELECT level_id, run, run_step, {', '.join(f'l[{i+1}] AS {c}' for i, c in enumerate(_D))}, score FROM nn""",
)
def l10(spark, sf):
    log = state_log(spark, sf, "score")
    log = log.having(log.df.withColumns({f"Ghost{g}_distance": live_distance(g) for g in (1, 2, 3, 4)}))
    out = sequences.make_sequences(
        log, "Experimental2", "pacman_attack", context=4, normalization="sample", rebase=True, sort_distances=True
    )
    return out.select("level_id", "run", "run_step", *_D, "score")


@query(
    "l11_trajectories",
    ST + """SELECT level_id, count(*) AS n_points, min(user_id) AS user_id, round(sum((step + 1) * (Pacman_X + 2 * Pacman_Y + 3 * time_elapsed)), 3) AS checksum
 FROM states GROUP BY 1""",
)
def l11(spark, sf):
    packed = slicing.trajectories(state_log(spark, sf, "time_elapsed"), time="time_elapsed", metadata=["user_id"])
    pts = packed.select("level_id", "first_step", "user_id", F.posexplode("points").alias("i", "p"))
    weight = (F.col("first_step") + F.col("i") + 1) * (F.col("p.x") + 2 * F.col("p.y") + 3 * F.col("p.t"))
    return pts.groupBy("level_id").agg(
        F.count(F.lit(1)).alias("n_points"), F.min("user_id").alias("user_id"), F.round(F.sum(weight), 3).alias("checksum")
    )


@query(
    "l12_indexing",
    "SELECT vec_id AS traj_id, CAST(embedding[5] AS DOUBLE) AS x2, CAST(embedding[len(embedding)] AS DOUBLE) AS y_last, "
    "3::BIGINT AS n_sub, CAST(embedding[9] AS DOUBLE) AS sub_x, CAST(embedding[4] AS DOUBLE) AS y1 FROM embeddings",
)
def l12(spark, sf):
    p = paths(spark, sf)
    sub = slicing.sub_path("points", 4, 3)
    return p.select(
        "traj_id", slicing.point_at("points", 2)["x"].alias("x2"), slicing.point_at("points", -1)["y"].alias("y_last"),
        F.size(sub).cast("long").alias("n_sub"), slicing.point_at(sub, 0)["x"].alias("sub_x"),
        F.get(slicing.coordinate("points", "y"), F.lit(1)).alias("y1"),
    )


# ---- masks --------------------------------------------------------------------------------------------


@query(
    "m1_padding_mask",
    ST + """, n AS (SELECT level_id, count(*) AS n FROM states GROUP BY 1)
 SELECT level_id, step AS run_step, true AS valid FROM states UNION ALL SELECT level_id, i, false FROM n,
 unnest(range(n, (SELECT max(n) FROM n))) AS u(i)""",
)
def m1(spark, sf):
    cols = ["Pacman_X", "Pacman_Y"]
    padded = slicing.pad_sequences(slicing.slice_preset(state_log(spark, sf), "whole_level"), ["level_id"], cols)
    return padded.select("level_id", "run_step", masks.padding_mask(cols).alias("valid"))


def _distances(spark, sf):
    df = state_log(spark, sf).df
    return df.select("game_state_id", *[live_distance(g).alias(f"Ghost{g}_distance") for g in (1, 2, 3, 4)])


@query(
    "m2_observation_mask",
    ST + f", dd AS (SELECT game_state_id, {DIST_SQL} FROM states) SELECT game_state_id, "
    + ", ".join(f"{c} < 'inf'::DOUBLE AS {c}" for c in _D) + " FROM dd",
)
def m2(spark, sf):
    return _distances(spark, sf).select("game_state_id", *[masks.observation_mask(c).alias(c) for c in _D])


@query(
    "m3_replace_inf",
    ST + f", dd AS (SELECT game_state_id, {DIST_SQL} FROM states) SELECT game_state_id, " + ", ".join(
        f"CASE WHEN {c} = 'inf'::DOUBLE THEN coalesce((SELECT max({c}) FROM dd WHERE {c} < 'inf'::DOUBLE), 0) ELSE {c} END AS {c}" for c in _D
    ) + " FROM dd",
)
def m3(spark, sf):
    return masks.replace_inf(_distances(spark, sf), _D)


_FEATS = "(VALUES (0, 'x'), (1, 'y')) AS f(no, feature)"


@query(
    "m4_noise_mask_random",
    PT + f"SELECT traj_id, step, feature, {mixed_uniform_sql(['traj_id', 'step', 'no'], 5)} >= 0.15 AS keep FROM path_steps, {_FEATS}",
)
def m4(spark, sf):
    log = core.assume_steps(path_steps(spark, sf), ["traj_id"])
    return masks.noise_mask(log, ["x", "y"], masks.NoiseMask(0.15, mode="separate", distribution="random", seed=5))


_P0, _P1 = 1 / 3, (1 / 3) * 0.25 / (1 - 0.25)
_CHAIN = """, u AS (SELECT traj_id, step, feature, {u} AS u FROM path_steps, {f}),
 t AS (SELECT *, CASE WHEN step = 0 THEN CASE WHEN u > 0.25 THEN 1 ELSE 0 END WHEN u >= {lo} AND u < {hi} THEN 1 END AS c,
  CASE WHEN step > 0 AND u < {lo} THEN 1 ELSE 0 END AS s FROM u),
 v AS (SELECT *, sum(s) OVER w AS ss, max(CASE WHEN c IS NOT NULL THEN step END) OVER w AS at FROM t
  WINDOW w AS (PARTITION BY traj_id, feature ORDER BY step))
 SELECT a.traj_id, a.step, a.feature, (b.c + a.ss - b.ss) % 2 = 1 AS keep FROM v a JOIN v b
 ON a.traj_id = b.traj_id AND a.feature = b.feature AND a.at = b.step"""


@query(
    "m5_noise_mask_geometric",
    PT + _CHAIN.format(u=mixed_uniform_sql(["traj_id", "step", "no"], 9), f=_FEATS, lo=repr(_P1) + "::DOUBLE", hi=repr(_P0) + "::DOUBLE"),
)
def m5(spark, sf):
    log = core.assume_steps(path_steps(spark, sf), ["traj_id"])
    return masks.noise_mask(log, ["x", "y"], masks.NoiseMask(0.25, 3, seed=9))


@query(
    "m6_mask_excluding_features",
    PT + f"""SELECT traj_id, step, feature, feature = 'y' OR {mixed_uniform_sql(['traj_id', 'step', '0'], 5)} >= 0.2 AS keep FROM path_steps, {_FEATS}""",
)
def m6(spark, sf):
    log = core.assume_steps(path_steps(spark, sf), ["traj_id"])
    spec = masks.NoiseMask(0.15, mode="concurrent", distribution="random", exclude=("y",), seed=5).harder()
    return masks.noise_mask(log, ["x", "y"], spec)


@query(
    "m7_split_by_hash",
    f"SELECT vec_id, CASE WHEN {mixed_uniform_sql(['vec_id'], 3)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM embeddings",
)
def m7(spark, sf):
    return masks.split_by_hash(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 0.8, seed=3)


@query(
    "m8_time_major",
    """SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(s AS BIGINT) AS step, CAST(embedding[s + 1] AS DOUBLE) AS a,
 CAST(embedding[len(embedding) // 2 + s + 1] AS DOUBLE) AS b FROM embeddings, unnest(range(len(embedding) // 2)) AS u(s)""",
)
def m8(spark, sf):
    half = (F.size("embedding") / 2).cast("int")
    emb = F.transform("embedding", lambda v: v.cast("double"))
    df = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("long").alias("label"),
        F.slice(emb, F.lit(1), half).alias("a"), F.slice(emb, half + 1, half).alias("b"),
    )
    return masks.to_time_major(df, ["a", "b"], ["vec_id", "label"])
