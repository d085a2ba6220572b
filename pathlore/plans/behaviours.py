"""Registered queries: detectors, their instance tables, summaries and encodings; the flagship report."""

from pyspark.sql import functions as F

from pathlore.functions.expressions import is_live, quadrant_index
from pathlore.operators import behaviour as bh
from pathlore.operators import core, sequences
from pathlore.operators.core import OrderedLog
from pathlore.operators.spatial import MazeGrid
from pathlore.plans.registry import query
from pathlore.plans.sequences import runs_sql
from pathlore.sources.adapters import STATE_SQL, event_k, state_log, table

ST = f"WITH {STATE_SQL} "
G4 = (1, 2, 3, 4)


def live_sql(g):
    return (f"(ghost{g}_state NOT IN (0, 4) AND NOT (Ghost{g}_X > -3.5 AND Ghost{g}_X < 3.5 AND Ghost{g}_Y > -2.5 AND Ghost{g}_Y < 1.5))")


def dist_sql(g):
    return f"CASE WHEN {live_sql(g)} THEN abs(Pacman_X - Ghost{g}_X) + abs(Pacman_Y - Ghost{g}_Y) ELSE 'inf'::DOUBLE END"


QUAD = """CASE WHEN Pacman_X < 0 AND Pacman_Y > 0 THEN 0 WHEN Pacman_X >= 0 AND Pacman_Y >= 0 THEN 1
 WHEN Pacman_X > 0 AND Pacman_Y < 0 THEN 2 WHEN Pacman_X <= 0 AND Pacman_Y <= 0 THEN 3 END"""
DD = "dd AS (SELECT *, " + ", ".join(f"{dist_sql(g)} AS d{g}" for g in G4) + f", {QUAD} AS slot FROM states)"
LAGS = "ap AS (SELECT *, " + ", ".join(f"lag(d{g}) OVER w AS q{g}" for g in G4) + """, lag(time_elapsed) OVER w AS tb,
 lead(step) OVER w IS NULL AS last_row, lag(pacman_attack) OVER w AS pa, lead(lives) OVER w AS nl
 FROM dd WINDOW w AS (PARTITION BY level_id ORDER BY step))"""

OUT = ["level_id", "start_step", "end_step", "start_t", "end_t", "value"]


def detectors_log(spark, sf):
    return state_log(spark, sf, "time_elapsed", "lives", "powerPellets")


def maze_walls(spark, sf):
    """About a ninth of the grid tiles act as walls, chosen by the ids of the events on the tile."""
    tile = table(spark, sf, "events").select(
        ((event_k() % 28) - 14).alias("x"), ((F.col("event_id") % 31) - 16).alias("y"), "event_id"
    )
    return tile.groupBy("x", "y").agg((F.sum("event_id") % 9).alias("m")).where("m = 0").select("x", "y")


WALLS_SQL = """walls AS (SELECT x, y FROM (SELECT k % 28 - 14 AS x, event_id % 31 - 16 AS y, event_id FROM ev) GROUP BY 1, 2 HAVING sum(event_id) % 9 = 0),
wallpts AS (SELECT DISTINCT 2 * x + i AS x2, 2 * y - j AS y2 FROM walls, (VALUES (0), (1), (2)) AS a(i), (VALUES (0), (1), (2)) AS b(j)),
nodes AS (SELECT x2, y2 FROM (SELECT x2, y2 FROM range(-27, 28) AS a(x2), range(-33, 28) AS b(y2)) AS g ANTI JOIN wallpts USING (x2, y2))"""


def detectors_with_maze(spark, sf):
    return bh.Behaviours(maze=MazeGrid.from_walls(maze_walls(spark, sf)))


@query("b0a_live_entities", ST + "SELECT game_state_id, " + ", ".join(f"{live_sql(g)} AS live{g}" for g in G4) + " FROM states")
def b0a(spark, sf):
    return state_log(spark, sf).df.select("game_state_id", *[is_live(g).alias(f"live{g}") for g in G4])


@query("b0b_live_distances", ST + f", {DD} SELECT game_state_id, d1, d2, d3, d4 FROM dd")
def b0b(spark, sf):
    df = state_log(spark, sf).df.select("game_state_id", bh.live_distances().alias("d"))
    return df.select("game_state_id", *[F.col("d")[g - 1].alias(f"d{g}") for g in G4])


@query("b0c_quadrant", ST + f"SELECT game_state_id, {QUAD} AS quadrant FROM states")
def b0c(spark, sf):
    return state_log(spark, sf).df.select("game_state_id", quadrant_index().alias("quadrant"))


_NEAR = f"""pacman_attack = 1 AND Pacman_X BETWEEN -6.5 AND 6.5 AND Pacman_Y BETWEEN -5.5 AND 4.5 AND (""" + " OR ".join(
    f"({live_sql(g)} AND Ghost{g}_X BETWEEN -6.5 AND 6.5 AND Ghost{g}_Y BETWEEN -5.5 AND 4.5)" for g in G4
) + ")"
_NEAR_D = """pacman_attack = 1 AND abs(Pacman_X) + abs(Pacman_Y + 0.5) <= 7.5 AND (""" + " OR ".join(
    f"({live_sql(g)} AND abs(Ghost{g}_X) + abs(Ghost{g}_Y + 0.5) <= 7.5)" for g in G4
) + ")"


def _hunt_sql(flag, context):
    return ST + f""", {runs_sql(flag)} SELECT r.level_id, greatest(start_step - {context}, 0) AS start_step, least(end_step + {context}, b.n_rows - 1) AS end_step,
 a.time_elapsed AS start_t, b.time_elapsed AS end_t, CAST(r.n_rows AS DOUBLE) AS value FROM frruns r
 JOIN states a ON a.level_id = r.level_id AND a.step = start_step JOIN states b ON b.level_id = r.level_id AND b.step = end_step WHERE NOT is_open"""


@query("b1_hunt_near_house", _hunt_sql(_NEAR, 0))
def b1(spark, sf):
    return bh.hunt_near_house(detectors_log(spark, sf)).select(*OUT)


@query("b1_hunt_by_distance", _hunt_sql(_NEAR_D, 0))
def b1_distance(spark, sf):
    return bh.hunt_near_house(detectors_log(spark, sf), bh.HuntNearHouse(closeness="Distance to house")).select(*OUT)


@query("b0d_context", _hunt_sql(_NEAR, 15))
def b0d(spark, sf):
    return bh.hunt_near_house(detectors_log(spark, sf), bh.HuntNearHouse(context=15)).select(*OUT)


_CAPTURES = "cap AS (" + " UNION ALL ".join(
    f"SELECT level_id, step, n_rows, time_elapsed FROM (SELECT *, lag(ghost{g}_state) OVER (PARTITION BY level_id ORDER BY step) AS ps FROM states) WHERE ps = 3 AND ghost{g}_state = 4"
    for g in G4
) + ")"


@query(
    "b2_captures",
    ST + f""", {_CAPTURES} SELECT level_id, greatest(step - 10, 0) AS start_step, least(step + 10, n_rows - 1) AS end_step,
 time_elapsed AS start_t, time_elapsed AS end_t, 1.0::DOUBLE AS value, step AS instant_step FROM cap""",
)
def b2(spark, sf):
    return bh.captures(detectors_log(spark, sf)).select(*OUT, "instant_step")


def _hunt_after_sql(window, threshold, distance):
    score = " + ".join(f"CASE WHEN d{g} < q{g} AND d{g} < {distance} THEN 1 ELSE 0 END" for g in G4)
    return f"""{DD}, {LAGS}, {runs_sql('pacman_attack = 1', 'dd')},
 wo AS (SELECT r.level_id, run, a.slot AS pill, end_step AS w0, b.lives AS l0, b.time_elapsed AS start_t FROM frruns r
  JOIN dd a ON a.level_id = r.level_id AND a.step = start_step JOIN dd b ON b.level_id = r.level_id AND b.step = end_step
  JOIN dd c ON c.level_id = r.level_id AND c.step = last_step WHERE NOT is_open AND start_step > 0 AND c.powerPellets > 0),
 sr AS (SELECT wo.*, step, {score} AS n, lives, tb, pacman_attack, last_row,
  (pacman_attack = 1 OR last_row OR lives < l0 OR step = w0 + {window}) AS stops FROM wo JOIN ap ON ap.level_id = wo.level_id AND step > w0 AND step <= w0 + {window}),
 sx AS (SELECT *, min(CASE WHEN stops THEN step END) OVER (PARTITION BY level_id, run) AS stop FROM sr),
 ha AS (SELECT level_id, w0 AS start_step, stop - 1 AS end_step, start_t, max(CASE WHEN step = stop THEN tb END) AS end_t,
  CAST(sum(CASE WHEN step < stop OR (step = stop AND pacman_attack = 0) THEN n ELSE 0 END) AS DOUBLE) AS value, pill,
  bool_or(step = stop AND pacman_attack = 0 AND lives < l0) AS died FROM sx GROUP BY level_id, run, w0, stop, start_t, pill
  HAVING sum(CASE WHEN step < stop OR (step = stop AND pacman_attack = 0) THEN n ELSE 0 END) >= {threshold})"""


@query("b3_hunt_after_pill", ST + ", " + _hunt_after_sql(10, 1, 5) + " SELECT * FROM ha")
def b3(spark, sf):
    return bh.hunt_after_pill(detectors_log(spark, sf)).select(*OUT, "pill", "died")


@query("b3_hunt_after_pill_wide", ST + ", " + _hunt_after_sql(30, 3, 15) + " SELECT * FROM ha")
def b3_wide(spark, sf):
    p = bh.HuntAfterPill(search_window=30, value_threshold=3, distance_threshold=15)
    return bh.hunt_after_pill(detectors_log(spark, sf), p).select(*OUT, "pill", "died")


@query(
    "b15_slot_values",
    ST + ", " + _hunt_after_sql(30, 3, 15) + """ SELECT level_id, CAST(pill AS INTEGER) AS pill, sum(value) AS value, count(*) AS instances, bool_or(died) AS died FROM ha
 GROUP BY level_id, pill""",
)
def b15_slots(spark, sf):
    p = bh.HuntAfterPill(search_window=30, value_threshold=3, distance_threshold=15)
    return bh.slot_values(bh.hunt_after_pill(detectors_log(spark, sf), p), ["level_id"], "Aggression4")


_CLOSEST = "(CASE " + " ".join(f"WHEN d{g} = least(d1, d2, d3, d4) THEN q{g}" for g in G4) + " END)"


def _chase_sql(closest, normal):
    if closest:
        n = f"CASE WHEN least(d1, d2, d3, d4) < {_CLOSEST} AND least(d1, d2, d3, d4) < 5 AND {_CLOSEST} < 'inf'::DOUBLE THEN 1 ELSE 0 END"
    else:
        n = " + ".join(f"CASE WHEN d{g} < q{g} AND d{g} < 5 AND q{g} < 'inf'::DOUBLE THEN 1 ELSE 0 END" for g in G4)
    value = "n / (end_step - start_step)::DOUBLE" if normal else "n::DOUBLE"
    return f"""{DD}, {LAGS}, {runs_sql('pacman_attack = 1', 'dd')},
 qt AS (SELECT level_id, min(step) AS quiet FROM ap WHERE pacman_attack = 0 AND pa = 0 AND powerPellets = 0 GROUP BY 1),
 cs AS (SELECT r.level_id, run, start_step, end_step, CAST(sum({n}) AS BIGINT) AS n FROM frruns r JOIN ap ON ap.level_id = r.level_id
  AND step > start_step AND step <= last_step AND NOT last_row WHERE start_step > 0 GROUP BY 1, 2, 3, 4),
 cc AS (SELECT cs.level_id, start_step, end_step, a.time_elapsed AS start_t, b.time_elapsed AS end_t, {value} AS value, a.slot AS pill
  FROM cs JOIN dd a ON a.level_id = cs.level_id AND a.step = start_step JOIN dd b ON b.level_id = cs.level_id AND b.step = end_step
  LEFT JOIN qt ON qt.level_id = cs.level_id WHERE n >= 1 AND (quiet IS NULL OR start_step < quiet))"""


@query("b4_chase_or_collect", ST + ", " + _chase_sql(True, True) + " SELECT * FROM cc")
def b4(spark, sf):
    return bh.chase_or_collect(detectors_log(spark, sf)).select(*OUT, "pill")


@query("b4_chase_all_entities", ST + ", " + _chase_sql(False, False) + " SELECT * FROM cc")
def b4_all(spark, sf):
    p = bh.ChaseOrCollect(only_closest=False, normalize=False)
    return bh.chase_or_collect(detectors_log(spark, sf), p).select(*OUT, "pill")


def near_cell_sql(g):
    return f"""({live_sql(g)} AND abs(round_even(2 * Pacman_X, 0) - round_even(2 * Ghost{g}_X, 0)) + abs(round_even(2 * Pacman_Y, 0) - round_even(2 * Ghost{g}_Y, 0)) <= 20)"""


CAND = f"""tc AS (SELECT *, pacman_attack = 0 AND ({' + '.join(f'CAST({near_cell_sql(g)} AS INTEGER)' for g in G4)}) >= 2 AS candidate FROM states)"""


@query("b5_trap_candidates", ST + f", {CAND} SELECT game_state_id, candidate FROM tc")
def b5_candidates(spark, sf):
    return bh.trap_candidates(state_log(spark, sf).df).select("game_state_id", "candidate")


def traps_sql(flag, src):
    """Instances of a trapped flag: never on the last row, cut after a row before a death."""
    return f"""tr1 AS (SELECT *, coalesce(lead(lives) OVER w < lives, false) AS dies, lead(step) OVER w AS nx, lead(time_elapsed) OVER w AS nt,
  lag(time_elapsed) OVER w AS lt, lead(lives) OVER w AS nl FROM {src} WINDOW w AS (PARTITION BY level_id ORDER BY step)),
 tr2 AS (SELECT *, {flag} AND nx IS NOT NULL AS f FROM tr1),
 tr3 AS (SELECT *, lag(f AND NOT dies) OVER (PARTITION BY level_id ORDER BY step) AS pf FROM tr2),
 tr4 AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(pf, false) THEN 1 ELSE 0 END) OVER (PARTITION BY level_id ORDER BY step) AS run FROM tr3),
 tr5 AS (SELECT level_id, run, min(step) AS s, max(step) AS l, max(nx) AS e, count(*) AS n, bool_or(dies) AS killed,
  min_by(time_elapsed, step) AS t0, max_by(time_elapsed, step) AS t1, max_by(nt, step) AS t2, min_by(coalesce(lt, time_elapsed), step) AS tp,
  max_by(nl, step) AS left_lives, max(n_rows) AS n_rows FROM tr4 WHERE f GROUP BY 1, 2),
 traps AS (SELECT level_id, CASE WHEN killed AND n = 1 THEN greatest(s - 1, 0) ELSE s END AS start_step, CASE WHEN killed THEN l ELSE e END AS end_step,
  CASE WHEN killed AND n = 1 THEN tp ELSE t0 END AS start_t, CASE WHEN killed THEN t1 ELSE t2 END AS end_t, CAST(n AS DOUBLE) AS value,
  killed OR (e = n_rows - 1 AND left_lives = 0) AS died FROM tr5)"""


MERGE_SQL = """mg1 AS (SELECT *, CASE WHEN start_step - lag(end_step) OVER (PARTITION BY level_id ORDER BY start_step) <= 20 THEN 0 ELSE 1 END AS fresh FROM traps),
 mg2 AS (SELECT *, sum(fresh) OVER (PARTITION BY level_id ORDER BY start_step) AS g FROM mg1),
 merged AS (SELECT level_id, count(*) AS n_merged, min(start_step) AS start_step, max(end_step) AS end_step, min_by(start_t, start_step) AS start_t,
  max_by(end_t, start_step) AS end_t, sum(value) AS value, max_by(died, start_step) AS died FROM mg2 GROUP BY level_id, g)"""


@query("b5_trap_islands", ST + f", {CAND}, {traps_sql('candidate', 'tc')} SELECT * FROM traps")
def b5_islands(spark, sf):
    log = detectors_log(spark, sf)
    return bh.trap_instances(log.having(bh.trap_candidates(log.df)), "candidate").select(*OUT, "died")


@query("b6_merge_instances", ST + f", {CAND}, {traps_sql('candidate', 'tc')}, {MERGE_SQL} SELECT * FROM merged")
def b6(spark, sf):
    log = detectors_log(spark, sf)
    merged = bh.merge_traps(log, bh.trap_instances(log.having(bh.trap_candidates(log.df)), "candidate"))
    return merged.select(*OUT, "died", "n_merged")


# One search per distinct key of the candidates, as a key-wise recursive flood.
FLOOD_SQL = f"""tk AS (SELECT *, CAST(round_even(2 * Pacman_X, 0) AS BIGINT) AS sx, CAST(round_even(2 * Pacman_Y, 0) AS BIGINT) AS sy,
  CASE {QUAD} WHEN 0 THEN 25 WHEN 1 THEN -25 WHEN 2 THEN -25 ELSE 25 END AS tx, CASE {QUAD} WHEN 0 THEN -19 WHEN 1 THEN -19 WHEN 2 THEN 17 ELSE 17 END AS ty,
  list_filter([{', '.join(f"CASE WHEN {near_cell_sql(g)} THEN CAST(round_even(2 * Ghost{g}_X, 0) AS BIGINT) * 1000 + CAST(round_even(2 * Ghost{g}_Y, 0) AS BIGINT) END" for g in G4)}], lambda c: c IS NOT NULL) AS blk FROM tc WHERE candidate),
 nb AS (SELECT a.x2, a.y2, b.x2 AS nx, b.y2 AS ny, false AS link FROM grid a JOIN nodes b ON abs(a.x2 - b.x2) + abs(a.y2 - b.y2) = 1
  UNION ALL SELECT -27, -1, 27, -1, true UNION ALL SELECT 27, -1, -27, -1, true),
 fl(id, x2, y2) AS (SELECT game_state_id, sx, sy FROM tk
  UNION SELECT f.id, nb.nx, nb.ny FROM fl f JOIN nb ON f.x2 = nb.x2 AND f.y2 = nb.y2 JOIN tk ON tk.game_state_id = f.id
  WHERE nb.link OR NOT list_contains(tk.blk, nb.nx * 1000 + nb.ny))"""
GRID_SQL = "grid AS (SELECT x2, y2 FROM range(-27, 28) AS a(x2), range(-33, 28) AS b(y2))"


TRAPPED_SQL = f"""{CAND}, {WALLS_SQL}, {GRID_SQL}, {FLOOD_SQL},
 hit AS (SELECT DISTINCT id FROM fl JOIN tk ON fl.id = tk.game_state_id WHERE fl.x2 = tk.tx AND fl.y2 = tk.ty AND NOT list_contains(blk, tx * 1000 + ty)),
 tcap AS (SELECT tc.*, tc.candidate AND hit.id IS NULL AS trapped FROM tc LEFT JOIN hit ON hit.id = tc.game_state_id)"""


@query("b5_trapped", "WITH RECURSIVE " + STATE_SQL + f", {TRAPPED_SQL} SELECT game_state_id, trapped FROM tcap")
def b5_trapped(spark, sf):
    maze = MazeGrid.from_walls(maze_walls(spark, sf))
    return bh.trapped_flag(state_log(spark, sf), maze).df.select("game_state_id", "trapped")


@query(
    "b5_caution1_instances",
    "WITH RECURSIVE " + STATE_SQL + f""", {TRAPPED_SQL}, {traps_sql('trapped', 'tcap')}, {MERGE_SQL}
 SELECT m.level_id, greatest(start_step - 4, 0) AS start_step, least(end_step + 4, f) AS end_step, start_t, end_t, value, died FROM merged m
 JOIN (SELECT level_id, max(step) AS f FROM states GROUP BY 1) USING (level_id)""",
)
def b5_caution1(spark, sf):
    """The whole detector: reachability, instances, merge, context and deaths."""
    found = detectors_with_maze(spark, sf).detect(detectors_log(spark, sf), "Caution1", context=4)
    return found.select(*OUT, "died")


def _mean_sql(attack, method):
    n = " + ".join(f"CASE WHEN {live_sql(g)} THEN 1 ELSE 0 END" for g in G4)
    s = lambda e: " + ".join(f"CASE WHEN {live_sql(g)} THEN {e.format(g=g)} ELSE 0 END" for g in G4)
    if method == "centroid":
        d = f"abs(Pacman_X - ({s('Ghost{g}_X')}) / ({n})) + abs(Pacman_Y - ({s('Ghost{g}_Y')}) / ({n}))"
    else:
        d = f"({s('abs(Pacman_X - Ghost{g}_X) + abs(Pacman_Y - Ghost{g}_Y)')}) / ({n})"
    return ST + f"SELECT level_id, coalesce(round(avg(CASE WHEN pacman_attack = {attack} AND ({n}) > 0 THEN {d} END), 6), 0) AS value FROM states GROUP BY 1"


for _name, _attack, _method in (
    ("b7_mean_distance_calm", False, "centroid"), ("b7_mean_distance_attack", True, "centroid"), ("b7_mean_distance_average", False, "average"),
):

    def _run(spark, sf, attack=_attack, method=_method):
        out = bh.mean_distance(detectors_log(spark, sf), attack, bh.MeanDistance(method))
        return out.select("level_id", F.round("value", 6).alias("value"))

    query(_name, _mean_sql(int(_attack), _method))(_run)


def close_sql(close, window):
    near = " OR ".join(f"d{g} < {close}" for g in G4)
    return f"""{DD}, cl1 AS (SELECT *, ({near}) AS near, coalesce(lead(lives) OVER w < lives, false) AS dies, lead(lives, {window}) OVER w AS later FROM dd
  WINDOW w AS (PARTITION BY level_id ORDER BY step)),
 cl2 AS (SELECT *, near AND pacman_attack <> 1 AND step + {window} < n_rows - 1 AND later >= lives AS starts,
  step + {window} <= n_rows - 1 AND (pacman_attack = 1 OR NOT near OR dies) AS releases FROM cl1),
 cl3 AS (SELECT a.level_id, a.step AS s, coalesce(min(r.step), max(a.n_rows) - 1) AS e FROM cl2 a LEFT JOIN cl2 r ON r.level_id = a.level_id AND r.step >= a.step + {window}
  AND r.releases WHERE a.starts GROUP BY 1, 2)"""


_CLOSE_CHAIN = """, ch(level_id, s, e) AS (SELECT level_id, min(s), min_by(e, s) FROM cl3 GROUP BY 1
 UNION ALL SELECT c.level_id, n.s, n.e FROM ch c, LATERAL (SELECT s, e FROM cl3 x WHERE x.level_id = c.level_id AND x.s > c.e ORDER BY s LIMIT 1) n)
 SELECT ch.level_id, s AS start_step, e AS end_step, a.time_elapsed AS start_t, b.time_elapsed AS end_t, 1.0::DOUBLE AS value FROM ch
 JOIN cl2 a ON a.level_id = ch.level_id AND a.step = s JOIN cl2 b ON b.level_id = ch.level_id AND b.step = e
 WHERE NOT (b.releases AND b.dies AND b.near AND b.pacman_attack <> 1)"""


def _close_sql(close, window):
    return "WITH RECURSIVE " + STATE_SQL + ", " + close_sql(close, window) + _CLOSE_CHAIN


@query("b8_close_calls", _close_sql(1.5, 20))
def b8(spark, sf):
    return bh.close_calls(detectors_log(spark, sf)).select(*OUT)


@query("b8_close_calls_short_window", _close_sql(6, 3))
def b8_short(spark, sf):
    return bh.close_calls(detectors_log(spark, sf), bh.CloseCalls(close_distance=6, search_window=3)).select(*OUT)


# ---- encodings ------------------------------------------------------------------------------------------

EVERY = ["Aggression1", "Aggression3", "Aggression4", "Aggression6", "Caution1", "Caution2a", "Caution2b", "Caution3"]


def _values(per_level, name, value, n="count(*)"):
    return f"SELECT level_id, '{name}' AS name, CAST({value} AS DOUBLE) AS v, CAST({n} AS BIGINT) AS n FROM ({per_level}) GROUP BY level_id"


def _renamed(sql, tag):
    """Give the run CTEs of one detector their own names."""
    return sql.replace("frruns", f"{tag}runs").replace("fr1", f"{tag}1").replace("fr2", f"{tag}2")


_AFTER = _hunt_after_sql(10, 1, 5).replace(f"{DD}, {LAGS}, ", "")
_CLOSE = close_sql(1.5, 20).replace(f"{DD}, ", "")
_CLOSE_KEPT = _CLOSE_CHAIN[: _CLOSE_CHAIN.index("\n SELECT")] + """,
 ck AS (SELECT ch.level_id, s FROM ch JOIN cl2 b ON b.level_id = ch.level_id AND b.step = e WHERE NOT (b.releases AND b.dies AND b.near AND b.pacman_attack <> 1))"""
_MEANS = {a: _mean_sql(a, "centroid").replace(ST, "").replace("round(", "(").replace(", 6), 0)", "), 0)") for a in (0, 1)}
SUMMARY_CTES = (
    f"{STATE_SQL}, {DD}, {LAGS}, {_renamed(runs_sql(_NEAR), 'hn')}, {_CAPTURES}, {_AFTER}, "
    + _renamed(_chase_sql(True, True).replace(f"{DD}, {LAGS}, ", ""), "ch") + f", {_CLOSE}{_CLOSE_KEPT}, {TRAPPED_SQL}, {traps_sql('trapped', 'tcap')}, {MERGE_SQL}"
    + f""", vals AS ({_values('SELECT level_id, n_rows FROM hnruns WHERE NOT is_open', 'Aggression1', 'sum(n_rows)')}
 UNION ALL {_values('SELECT level_id FROM cap', 'Aggression3', 'count(*)')} UNION ALL {_values('SELECT * FROM ha', 'Aggression4', 'sum(value)')}
 UNION ALL SELECT level_id, 'Aggression6', avg(v), CAST(sum(n) AS BIGINT) FROM (SELECT level_id, pill, sum(value) AS v, count(*) AS n FROM cc GROUP BY 1, 2) GROUP BY 1
 UNION ALL {_values('SELECT * FROM merged', 'Caution1', 'count(*)')}
 UNION ALL SELECT level_id, 'Caution2a', value, 0 FROM ({_MEANS[0]}) UNION ALL SELECT level_id, 'Caution2b', value, 0 FROM ({_MEANS[1]})
 UNION ALL {_values('SELECT * FROM ck', 'Caution3', 'count(*)')}),
 keys AS (SELECT DISTINCT level_id FROM states)"""
)


def summary_sql(names, instances=True, extra=""):
    cols = ", ".join(
        f"coalesce(round(max(CASE WHEN name = '{n}' THEN v END), 6), 0) AS {n}_value"
        + (f", coalesce(max(CASE WHEN name = '{n}' THEN n END), 0) AS {n}_instances" if instances else "")
        for n in names
    )
    return f"WITH RECURSIVE {SUMMARY_CTES}{extra} SELECT level_id, {cols} FROM keys LEFT JOIN vals USING (level_id) GROUP BY level_id"


def _round_values(df):
    return df.withColumns({c: F.round(c, 6) for c in df.columns if c.endswith("_value")})


@query("b10_summary", summary_sql(EVERY))
def b10(spark, sf):
    return _round_values(detectors_with_maze(spark, sf).summary(detectors_log(spark, sf)))


@query(
    "b11_instances",
    f"""WITH RECURSIVE {SUMMARY_CTES} SELECT level_id, 'Aggression3' AS name, greatest(step - 10, 0) AS start_step, least(step + 10, n_rows - 1) AS end_step,
 1.0::DOUBLE AS value, CAST(NULL AS INTEGER) AS pill FROM cap
 UNION ALL SELECT level_id, 'Aggression4', start_step, end_step, value, CAST(pill AS INTEGER) FROM ha
 UNION ALL SELECT level_id, 'Aggression6', start_step, end_step, value, CAST(pill AS INTEGER) FROM cc
 UNION ALL SELECT level_id, 'Aggression1', start_step, end_step, CAST(n_rows AS DOUBLE), NULL FROM hnruns WHERE NOT is_open
 UNION ALL SELECT level_id, 'Caution1', start_step, end_step, value, NULL FROM merged""",
)
def b11(spark, sf):
    names = ["Aggression1", "Aggression3", "Aggression4", "Aggression6", "Caution1"]
    found = detectors_with_maze(spark, sf).instances(detectors_log(spark, sf), names)
    return found.select("level_id", "name", "start_step", "end_step", "value", "pill")


@query("b12_one_category", summary_sql(["Caution1", "Caution2a", "Caution2b", "Caution3"]))
def b12(spark, sf):
    return _round_values(detectors_with_maze(spark, sf).summary(detectors_log(spark, sf), "Caution"))


@query("b15_vector_encoding", summary_sql(EVERY, instances=False))
def b15(spark, sf):
    return _round_values(detectors_with_maze(spark, sf).encoding(detectors_log(spark, sf)))


def slice_log(spark, sf):
    """The attack runs of every level with six rows of context, as a log of its own (key level_id, run; step from 0)."""
    log = detectors_log(spark, sf)
    cut = sequences.cut(log, "pacman_attack", context=6)
    return OrderedLog(cut.drop("step").withColumnRenamed("run_step", "step"), ("level_id", "run"), "step", log.block)


# The slices as states of their own: a slice is a level whose number holds level and run.
SLICE_CTES = SUMMARY_CTES.replace(
    STATE_SQL,
    STATE_SQL.replace("\nstates AS", "\nlstates AS") + f""", {runs_sql('pacman_attack = 1', 'lstates', 'sc')},
 sspans AS (SELECT r.level_id, run, greatest(start_step - 6, 0) AS s0, least(end_step + 6, b.f) AS s1 FROM scruns r
  JOIN (SELECT level_id, max(step) AS f FROM lstates GROUP BY 1) b USING (level_id) WHERE start_step > 0),
 states AS (SELECT s.level_id * 1000000 + s.run AS level_id, t.step - s0 AS step, s1 - s0 + 1 AS n_rows, row_number() OVER (ORDER BY s.level_id, s.run, t.step) AS game_state_id,
  t.* EXCLUDE (level_id, step, n_rows, game_state_id) FROM sspans s JOIN lstates t ON t.level_id = s.level_id AND t.step BETWEEN s0 AND s1)""",
    1,
)
SLICE_KEY = "level_id // 1000000 AS level_id, level_id % 1000000 AS run"
FIVE = ["Aggression1", "Aggression3", "Aggression4", "Aggression6", "Caution1"]


@query(
    "b13_detectors_on_slices",
    f"""WITH RECURSIVE {SLICE_CTES}, si AS (
 SELECT level_id, 'Aggression1' AS name, start_step, end_step, CAST(n_rows AS DOUBLE) AS value, CAST(NULL AS INTEGER) AS pill FROM hnruns WHERE NOT is_open
 UNION ALL SELECT level_id, 'Aggression3', greatest(step - 10, 0), least(step + 10, n_rows - 1), 1.0::DOUBLE, NULL FROM cap
 UNION ALL SELECT level_id, 'Aggression4', start_step, end_step, value, CAST(pill AS INTEGER) FROM ha
 UNION ALL SELECT level_id, 'Aggression6', start_step, end_step, value, CAST(pill AS INTEGER) FROM cc
 UNION ALL SELECT level_id, 'Caution1', start_step, end_step, value, NULL FROM merged)
 SELECT {SLICE_KEY}, name, start_step, end_step, value, pill FROM si""",
)
def b13(spark, sf):
    found = detectors_with_maze(spark, sf).instances(slice_log(spark, sf), FIVE)
    return found.select("level_id", "run", "name", "start_step", "end_step", "value", "pill")


@query(
    "b13_summary_on_slices",
    f"WITH RECURSIVE {SLICE_CTES} SELECT {SLICE_KEY.replace('level_id //', 'k.level_id //').replace('level_id %', 'k.level_id %')}, "
    + ", ".join(f"coalesce(round(max(CASE WHEN name = '{n}' THEN v END), 6), 0) AS {n}_value, coalesce(max(CASE WHEN name = '{n}' THEN n END), 0) AS {n}_instances" for n in EVERY)
    + " FROM keys k LEFT JOIN vals v ON v.level_id = k.level_id GROUP BY k.level_id",
)
def b13_summary(spark, sf):
    return _round_values(detectors_with_maze(spark, sf).summary(slice_log(spark, sf)))


@query("b14_rejected_levels", "SELECT user_id AS level_id, count(*) AS bad_rows FROM events WHERE value > 300 GROUP BY 1")
def b14(spark, sf):
    df = state_log(spark, sf).df.withColumn("lives", F.lit(3))
    spoiled = df.withColumn("Pacman_X", F.when(F.col("value") <= 300, F.col("Pacman_X")))
    return bh.split_valid(spoiled, ["level_id"])[1]


@query(
    "b14_valid_levels",
    "SELECT user_id AS level_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 300) GROUP BY 1",
)
def b14_valid(spark, sf):
    df = state_log(spark, sf).df.withColumn("lives", F.lit(3))
    spoiled = df.withColumn("Pacman_X", F.when(F.col("value") <= 300, F.col("Pacman_X")))
    return bh.split_valid(spoiled, ["level_id"])[0].groupBy("level_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b16_instance_paths",
    ST + f""", {runs_sql(_NEAR)}, iv AS (SELECT level_id, CAST(row_number() OVER (PARTITION BY level_id ORDER BY start_step, end_step) - 1 AS BIGINT) AS instance, start_step, end_step
  FROM frruns WHERE NOT is_open), wd AS (SELECT iv.level_id, instance, greatest(start_step - 5, 0) AS s, least(end_step + 5, m) AS e FROM iv
  JOIN (SELECT level_id, max(step) AS m FROM states GROUP BY 1) USING (level_id))
 SELECT wd.level_id, instance, step, step - s AS run_step, Pacman_X, Pacman_Y, user_id FROM wd JOIN states t ON t.level_id = wd.level_id AND step BETWEEN s AND e""",
)
def b16(spark, sf):
    log = detectors_log(spark, sf)
    rows = bh.instance_paths(log, bh.hunt_near_house(log), 5, ["user_id"])
    return rows.select("level_id", "instance", "step", "run_step", "Pacman_X", "Pacman_Y", "user_id")


@query(
    "attack_run_report",
    ST + f""", {runs_sql('pacman_attack = 1')}, {_CAPTURES}, c AS (SELECT r.level_id, run, count(*) AS n FROM frruns r JOIN cap ON cap.level_id = r.level_id
  AND cap.step BETWEEN start_step AND end_step WHERE start_step > 0 GROUP BY 1, 2)
 SELECT r.level_id AS user_id, count(*) AS runs, CAST(sum(n_rows) AS BIGINT) AS attack_rows, max(n_rows) AS longest, round(sum(t1.time_elapsed - t0.time_elapsed), 4) AS attack_seconds,
 CAST(coalesce(sum(c.n), 0) AS BIGINT) AS captures FROM (SELECT * FROM frruns WHERE start_step > 0) r LEFT JOIN c ON c.level_id = r.level_id AND c.run = r.run
 JOIN (SELECT level_id, step, time_elapsed FROM states) t0 ON t0.level_id = r.level_id AND t0.step = start_step
 JOIN (SELECT level_id, step, time_elapsed FROM states) t1 ON t1.level_id = r.level_id AND t1.step = end_step GROUP BY 1""",
)
def attack_run_report(spark, sf):
    """How long each player stays in attack mode and how many captures the runs contain."""
    log = state_log(spark, sf, "time_elapsed")
    runs = core.flag_runs(log, F.col("pacman_attack") == 1, carry=["time_elapsed"])
    names = [f"ghost{g}_state" for g in G4]
    hits = core.point_events(log, names, {n: (F.col(f"prev_{n}") == 3) & (F.col(n) == 4) for n in names}).select("level_id", "step")
    inside = core.range_attach(runs.select("level_id", "run", "start_step", "end_step"), hits, ["level_id"])
    counted = inside.groupBy("level_id", "run").agg(F.count(F.lit(1)).alias("n"))
    return (
        runs.join(counted, ["level_id", "run"], "left")
        .groupBy(F.col("level_id").alias("user_id"))
        .agg(
            F.count(F.lit(1)).alias("runs"), F.sum("n_rows").alias("attack_rows"), F.max("n_rows").alias("longest"),
            F.round(F.sum(F.col("end_time_elapsed") - F.col("start_time_elapsed")), 4).alias("attack_seconds"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("captures"),
        )
    )
