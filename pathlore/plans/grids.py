"""Registered queries: movement, grids, maze graph."""

from pyspark.sql import functions as F

from pathlore.functions.expressions import grid_x, grid_y, half_unit, quadrant_index
from pathlore.operators import spatial
from pathlore.operators.pellets import POWER_PILLS, eaten_pellets, pellet_availability, remaining_pills
from pathlore.operators.spatial import MazeGrid
from pathlore.operators.behaviour import OPPOSITE_CORNER
from pathlore.plans.behaviours import GRID_SQL, QUAD, WALLS_SQL, maze_walls
from pathlore.plans.registry import query
from pathlore.sources.adapters import STATE_SQL, event_k, state_log

ST = f"WITH {STATE_SQL} "

VEL = """vel AS (SELECT *, coalesce(round_even((Pacman_X - lag(Pacman_X) OVER w) * 2, 0) / 2.0::DOUBLE, 0) + 0.0::DOUBLE AS vx,
 coalesce(round_even((Pacman_Y - lag(Pacman_Y) OVER w) * 2, 0) / 2.0::DOUBLE, 0) + 0.0::DOUBLE AS vy FROM {src} WINDOW w AS (PARTITION BY level_id ORDER BY step))"""
# A coarser walk, so that cells are revisited within a few steps.
COARSE = "cw AS (SELECT * REPLACE (CAST(k % 3 - 13.5 AS DOUBLE) AS Pacman_X, CAST(game_state_id % 2 - 16.5 AS DOUBLE) AS Pacman_Y) FROM states)"


def coarse(spark, sf):
    log = state_log(spark, sf)
    return log.having(
        log.df.withColumns({"Pacman_X": (F.col("k") % 3) - 13.5, "Pacman_Y": (F.col("game_state_id") % 2) - 16.5})
    )


def gx_sql(c="Pacman_X"):
    return f"CAST(greatest(least(ceil({c} + 13.5 - 0.5), 27), 0) AS BIGINT)"


def gy_sql(c="Pacman_Y"):
    return f"CAST(greatest(least(ceil({c} + 16.5 - 0.5), 30), 0) AS BIGINT)"


COUNTED = f"""gl AS (SELECT level_id, {gx_sql()} AS gx, {gy_sql()} AS gy, list(step ORDER BY step) AS steps FROM cw WHERE step > 0 GROUP BY 1, 2, 3),
 gk AS (SELECT level_id, gx, gy, unnest(list_reduce(steps, lambda acc, s: CASE WHEN len(acc) = 0 OR s[1] - acc[len(acc)] > 4 THEN list_concat(acc, s) ELSE acc END, []::BIGINT[])) AS step
 FROM (SELECT level_id, gx, gy, list_transform(steps, lambda s: [s]) AS steps FROM gl))"""


@query("g1_velocities", ST + f", {VEL.format(src='states')} SELECT level_id, step, vx, vy FROM vel")
def g1(spark, sf):
    return spatial.velocities(state_log(spark, sf), "Pacman_X", "Pacman_Y").select("level_id", "step", "vx", "vy")


@query(
    "g2_speeds",
    ST + """SELECT level_id, step, round((Pacman_X - lag(Pacman_X) OVER w) / nullif(time_elapsed - lag(time_elapsed) OVER w, 0), 6) + 0.0::DOUBLE AS sx,
 round((Pacman_Y - lag(Pacman_Y) OVER w) / nullif(time_elapsed - lag(time_elapsed) OVER w, 0), 6) + 0.0::DOUBLE AS sy FROM states WINDOW w AS (PARTITION BY level_id ORDER BY step)""",
)
def g2(spark, sf):
    out = spatial.speeds(state_log(spark, sf, "time_elapsed"), "Pacman_X", "Pacman_Y", "time_elapsed")
    return out.select("level_id", "step", (F.round("sx", 6) + 0.0).alias("sx"), (F.round("sy", 6) + 0.0).alias("sy"))


@query("g3_path_length", ST + f", {VEL.format(src='states')} SELECT level_id, round(sum(sqrt(vx * vx + vy * vy)), 6) AS length FROM vel GROUP BY 1")
def g3(spark, sf):
    out = spatial.path_length(state_log(spark, sf), "Pacman_X", "Pacman_Y")
    return out.withColumn("length", F.round("length", 6))


@query("g4_grid_cell", ST + f"SELECT game_state_id, {gx_sql('Ghost1_X')} AS gx, {gy_sql('Ghost1_Y')} AS gy FROM states")
def g4(spark, sf):
    return state_log(spark, sf).df.select("game_state_id", grid_x("Ghost1_X").alias("gx"), grid_y("Ghost1_Y").alias("gy"))


@query("g5_recurrence_visits", ST + f", {COARSE}, {COUNTED} SELECT * FROM gk")
def g5(spark, sf):
    return spatial.recurrence_visits(coarse(spark, sf), "Pacman_X", "Pacman_Y")


@query(
    "g6_velocity_grid",
    ST + f""", {COARSE}, {COUNTED}, {VEL.format(src='cw')}, gg AS (SELECT k.level_id, gx, gy, count(*) AS n, sum(vx) AS vx, sum(vy) AS vy FROM gk k
 JOIN vel v ON v.level_id = k.level_id AND v.step = k.step - 1 GROUP BY 1, 2, 3)
 SELECT level_id, gx, gy, n, round(CASE WHEN vx * vx + vy * vy > 0 THEN vx / sqrt(vx * vx + vy * vy) ELSE vx END, 6) + 0.0::DOUBLE AS vx,
 round(CASE WHEN vx * vx + vy * vy > 0 THEN vy / sqrt(vx * vx + vy * vy) ELSE vy END, 6) + 0.0::DOUBLE AS vy FROM gg""",
)
def g6(spark, sf):
    out = spatial.velocity_grid(coarse(spark, sf), "Pacman_X", "Pacman_Y", normalize=True)
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("vx", "vy")})


@query(
    "g6b_aggregate_grid",
    ST + f""", {COARSE}, {COUNTED}, {VEL.format(src='cw')}, gg AS (SELECT gx, gy, count(*) AS n, sum(vx) AS vx, sum(vy) AS vy FROM gk k
 JOIN vel v ON v.level_id = k.level_id AND v.step = k.step - 1 GROUP BY 1, 2)
 SELECT gx, gy, n, vx, vy, round(n / (max(n) OVER ())::DOUBLE, 6) AS share FROM gg""",
)
def g6b(spark, sf):
    grid = spatial.velocity_grid(coarse(spark, sf), "Pacman_X", "Pacman_Y", over=())
    return spatial.relative_counts(grid).withColumn("share", F.round("share", 6))


@query("g7_snap_half_unit", "SELECT event_id, CAST(round_even(value * 2, 0) AS BIGINT) AS v2 FROM events")
def g7(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", half_unit(F.col("value")).alias("v2"))


@query(
    "g8_mirroring",
    ST + """SELECT game_state_id, (CASE WHEN Pacman_X < 0 THEN -Pacman_X ELSE Pacman_X END)::DOUBLE AS mirror_x, (CASE WHEN Pacman_Y < -0.5 THEN -1.0 - Pacman_Y ELSE Pacman_Y END)::DOUBLE AS mirror_y,
 (CASE WHEN Pacman_X >= 0 AND Pacman_Y >= -0.5 THEN 1 WHEN Pacman_X <= 0 AND Pacman_Y >= -0.5 THEN 2 WHEN Pacman_X <= 0 AND Pacman_Y <= -0.5 THEN 3
 WHEN Pacman_X >= 0 AND Pacman_Y <= -0.5 THEN 4 ELSE 0 END)::DOUBLE AS quadrant FROM states""",
)
def g8(spark, sf):
    return state_log(spark, sf).df.select("game_state_id", *[c.alias(n) for n, c in spatial.mirrored().items()])


@query("g9_inflate_walls", "WITH ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events), "
       + WALLS_SQL + " SELECT CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM wallpts")
def g9(spark, sf):
    return spatial.inflate_walls(maze_walls(spark, sf))


# Path lengths by a keyed recursive search from every start cell that occurs.
_EDGES = f"""{GRID_SQL}, nb AS (SELECT a.x2, a.y2, b.x2 AS nx, b.y2 AS ny FROM grid a JOIN nodes b ON abs(a.x2 - b.x2) + abs(a.y2 - b.y2) = 1
 UNION ALL SELECT -27, -1, 27, -1 UNION ALL SELECT 27, -1, -27, -1)"""
_BFS = """bf(sx, sy, x2, y2, d) USING KEY (sx, sy, x2, y2) AS (SELECT DISTINCT sx, sy, sx, sy, 0::BIGINT FROM src
 UNION SELECT f.sx, f.sy, nb.nx, nb.ny, f.d + 1 FROM bf f JOIN nb ON nb.x2 = f.x2 AND nb.y2 = f.y2
 WHERE NOT EXISTS (SELECT 1 FROM recurring.bf r WHERE r.sx = f.sx AND r.sy = f.sy AND r.x2 = nb.nx AND r.y2 = nb.ny))"""
_GOALS = "SELECT DISTINCT CASE {q} WHEN 0 THEN 25 WHEN 1 THEN -25 WHEN 2 THEN -25 ELSE 25 END AS sx, CASE {q} WHEN 0 THEN -19 WHEN 1 THEN -19 WHEN 2 THEN 17 ELSE 17 END AS sy, CAST(round_even(2 * Pacman_X, 0) AS BIGINT) AS tx, CAST(round_even(2 * Pacman_Y, 0) AS BIGINT) AS ty FROM states"


def goal_pairs(spark, sf):
    """From the corner opposite to the agent's quadrant to the agent."""
    df = state_log(spark, sf).df
    q = quadrant_index()
    corner = [F.coalesce(*[F.when(q == i, int(2 * c[axis])) for i, c in OPPOSITE_CORNER.items()]).cast("long") for axis in (0, 1)]
    return df.select(
        corner[0].alias("sx"), corner[1].alias("sy"), half_unit(F.col("Pacman_X")).alias("tx"), half_unit(F.col("Pacman_Y")).alias("ty")
    )


@query(
    "g10_graph_distance",
    "WITH RECURSIVE " + STATE_SQL + f", {WALLS_SQL}, {_EDGES}, asked AS ({_GOALS.format(q=QUAD)}), src AS (SELECT DISTINCT sx, sy FROM asked), {_BFS}"
    + """ SELECT CAST(asked.sx AS BIGINT) AS sx, CAST(asked.sy AS BIGINT) AS sy, tx, ty, coalesce(d / 2.0::DOUBLE, 'inf'::DOUBLE) AS distance
 FROM asked LEFT JOIN bf ON bf.sx = asked.sx AND bf.sy = asked.sy AND bf.x2 = tx AND bf.y2 = ty""",
)
def g10(spark, sf):
    return spatial.graph_distances(goal_pairs(spark, sf), MazeGrid.from_walls(maze_walls(spark, sf)))


# Back from the target to the first neighbour one step nearer to the start: left, right, down, up, then the link.
_WALK = """wk(sx, sy, tx, ty, pos, x2, y2) AS (
 SELECT asked.sx, asked.sy, tx, ty, bf.d, bf.x2, bf.y2 FROM asked JOIN bf ON bf.sx = asked.sx AND bf.sy = asked.sy AND bf.x2 = tx AND bf.y2 = ty
 UNION ALL
 SELECT sx, sy, tx, ty, pos - 1, pt.x2, pt.y2 FROM (
  SELECT w.sx, w.sy, w.tx, w.ty, w.pos, arg_min({'x2': b.x2, 'y2': b.y2}, CASE WHEN b.x2 = w.x2 - 1 AND b.y2 = w.y2 THEN 1 WHEN b.x2 = w.x2 + 1 AND b.y2 = w.y2 THEN 2
    WHEN b.x2 = w.x2 AND b.y2 = w.y2 - 1 THEN 3 WHEN b.x2 = w.x2 AND b.y2 = w.y2 + 1 THEN 4 ELSE 5 END) AS pt
  FROM wk w JOIN bf b ON b.sx = w.sx AND b.sy = w.sy AND b.d = w.pos - 1 AND (abs(b.x2 - w.x2) + abs(b.y2 - w.y2) = 1 OR (abs(w.x2) = 27 AND w.y2 = -1 AND b.x2 = -w.x2 AND b.y2 = -1))
  WHERE w.pos > 0 GROUP BY w.sx, w.sy, w.tx, w.ty, w.pos, w.x2, w.y2))"""


@query(
    "g10_shortest_path_points",
    "WITH RECURSIVE " + STATE_SQL + f", {WALLS_SQL}, {_EDGES}, asked AS ({_GOALS.format(q=QUAD)}), src AS (SELECT DISTINCT sx, sy FROM asked), {_BFS}, {_WALK}"
    + " SELECT CAST(sx AS BIGINT) AS sx, CAST(sy AS BIGINT) AS sy, CAST(tx AS BIGINT) AS tx, CAST(ty AS BIGINT) AS ty, CAST(pos AS BIGINT) AS pos, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2 FROM wk",
)
def g10_paths(spark, sf):
    return spatial.shortest_paths(goal_pairs(spark, sf), MazeGrid.from_walls(maze_walls(spark, sf)))


# The same search against the edges, from every agent cell: one length for each point it can be reached from.
_BACK = """rb(sx, sy, x2, y2, d) USING KEY (sx, sy, x2, y2) AS (SELECT DISTINCT ax, ay, ax, ay, 0::BIGINT FROM seen WHERE ax BETWEEN -27 AND 27 AND ay BETWEEN -33 AND 27
 UNION SELECT f.sx, f.sy, nb.x2, nb.y2, f.d + 1 FROM rb f JOIN nb ON nb.nx = f.x2 AND nb.ny = f.y2
 WHERE NOT EXISTS (SELECT 1 FROM recurring.rb r WHERE r.sx = f.sx AND r.sy = f.sy AND r.x2 = nb.x2 AND r.y2 = nb.y2))"""


def _point_sql(name):
    return f"CAST(round_even(2 * {name}_X, 0) AS BIGINT)", f"CAST(round_even(2 * {name}_Y, 0) AS BIGINT)"


_SEEN = "seen AS (SELECT game_state_id, {} AS ax, {} AS ay, ".format(*_point_sql("Pacman")) + ", ".join(
    "{} AS gx{g}, {} AS gy{g}".format(*_point_sql(f"Ghost{g}"), g=g) for g in (1, 2, 3, 4)
) + " FROM states)"


@query(
    "r10_entity_path_distances",
    "WITH RECURSIVE " + STATE_SQL + f", {WALLS_SQL}, {_EDGES}, {_SEEN}, {_BACK} SELECT game_state_id, "
    + ", ".join(f"coalesce(r{g}.d / 2.0::DOUBLE, 'inf'::DOUBLE) AS Ghost{g}_distance" for g in (1, 2, 3, 4)) + " FROM seen "
    + " ".join(f"LEFT JOIN rb r{g} ON r{g}.sx = ax AND r{g}.sy = ay AND r{g}.x2 = gx{g} AND r{g}.y2 = gy{g}" for g in (1, 2, 3, 4)),
)
def r10(spark, sf):
    maze = MazeGrid.from_walls(maze_walls(spark, sf))
    out = spatial.entity_path_distances(state_log(spark, sf).df, maze)
    return out.select("game_state_id", *[f"Ghost{g}_distance" for g in (1, 2, 3, 4)])


@query(
    "g12_path_offsets",
    ST + f""", {COARSE}, {COUNTED}, {VEL.format(src='cw')}, po AS (SELECT v.level_id, v.step, v.Pacman_X, v.Pacman_Y, vx, vy, {gx_sql()} AS gx, {gy_sql()} AS gy,
 CASE WHEN k.step IS NULL THEN 0 ELSE 1 END AS hit FROM vel v LEFT JOIN gk k ON k.level_id = v.level_id AND k.step = v.step),
 pq AS (SELECT *, sum(hit) OVER (PARTITION BY level_id, gx, gy ORDER BY step) AS n_seen, max(hit) OVER (PARTITION BY level_id, gx, gy) AS anyhit FROM po)
 SELECT level_id, step, CAST(n_seen AS BIGINT) AS n_seen, Pacman_X + CASE WHEN anyhit = 1 AND abs(vx) < abs(vy) THEN 0.5 * (n_seen - 1) ELSE 0 END::DOUBLE AS off_x,
 Pacman_Y + CASE WHEN anyhit = 1 AND abs(vx) > abs(vy) THEN 0.5 * (n_seen - 1) ELSE 0 END::DOUBLE AS off_y FROM pq""",
)
def g12(spark, sf):
    out = spatial.path_offsets(coarse(spark, sf), "Pacman_X", "Pacman_Y")
    return out.select("level_id", "step", "n_seen", "off_x", "off_y")


@query(
    "g13_stride_segments",
    ST + """SELECT a.level_id, a.step AS start_step, b.step - a.step AS i, b.Pacman_X AS x, b.Pacman_Y AS y FROM states a JOIN states b
 ON b.level_id = a.level_id AND b.step BETWEEN a.step AND a.step + 10 WHERE a.step % 10 = 0 AND a.step + 10 < a.n_rows""",
)
def g13(spark, sf):
    segs = spatial.stride_segments(state_log(spark, sf), "Pacman_X", "Pacman_Y", 10)
    long = segs.select("level_id", "start_step", F.posexplode("points").alias("i", "p"))
    return long.select("level_id", "start_step", F.col("i").cast("long").alias("i"), "p.x", "p.y")


def pellet_grid(spark, sf):
    """Pellet points: the grid tiles whose events' ids sum to 1 or 2 modulo 5."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    k = event_k()
    tile = ev.select(((k % 28) - 13.5).alias("px"), ((F.col("event_id") % 31) - 16.5).alias("py"), "event_id")
    return tile.groupBy("px", "py").agg((F.sum("event_id") % 5).alias("m")).where("m in (1, 2)").select("px", "py")


# The fold row by row: the pellets left travel as a list; ties go to the pellet first in reading order.
_FOLD = """dots AS (SELECT CAST(row_number() OVER (ORDER BY py DESC, px) - 1 AS BIGINT) AS p, px, py FROM (
  SELECT k % 28 - 13.5::DOUBLE AS px, event_id % 31 - 16.5::DOUBLE AS py FROM ev GROUP BY 1, 2 HAVING sum(event_id) % 5 IN (1, 2))),
 alldots AS (SELECT list({'p': p, 'x': px, 'y': py} ORDER BY p) AS l FROM dots),
 falls AS (SELECT level_id, step, Pacman_X AS x, Pacman_Y AS y, pellets, coalesce(pellets - lag(pellets) OVER (PARTITION BY level_id ORDER BY step) = -1, false) AS fell FROM states),
 rc(level_id, step, rest, gone) AS (
  SELECT level_id, step, list_filter(l, lambda v: NOT list_contains(first, v.p)), list_filter(l, lambda v: list_contains(first, v.p)) FROM (
   SELECT f.level_id, f.step, l, list_transform(list_sort(list_transform(l, lambda v: {'d': (v.x - f.x) * (v.x - f.x) + (v.y - f.y) * (v.y - f.y), 'p': v.p}))[1:greatest(0, 244 - pellets)], lambda v: v.p) AS first
   FROM falls f, alldots WHERE f.step = 0)
  UNION ALL
  SELECT level_id, step, CASE WHEN eat THEN list_filter(rest, lambda v: v.p <> near.p) ELSE rest END, CASE WHEN eat THEN list_filter(rest, lambda v: v.p = near.p) ELSE [] END FROM (
   SELECT *, len(rest) > 0 AND (near.d <= 0.25 OR fell) AS eat FROM (
    SELECT f.level_id, f.step, rest, fell, list_sort(list_transform(rest, lambda v: {'d': (v.x - f.x) * (v.x - f.x) + (v.y - f.y) * (v.y - f.y), 'p': v.p}))[1] AS near
    FROM rc JOIN falls f ON f.level_id = rc.level_id AND f.step = rc.step + 1)))"""


@query(
    "r8_eaten_pellets",
    "WITH RECURSIVE " + STATE_SQL + f", {_FOLD} SELECT level_id, step, g.p AS pellet, g.x AS px, g.y AS py FROM (SELECT level_id, step, unnest(gone) AS g FROM rc)",
)
def r8(spark, sf):
    return eaten_pellets(state_log(spark, sf), pellet_grid(spark, sf))


@query("r8_pellet_availability", "WITH RECURSIVE " + STATE_SQL + f", {_FOLD} SELECT level_id, step, CAST(len(rest) AS BIGINT) AS remaining FROM rc")
def r8_availability(spark, sf):
    log, dots = state_log(spark, sf), pellet_grid(spark, sf)
    return pellet_availability(log, dots, eaten_pellets(log, dots))


@query(
    "r9_remaining_pills",
    "WITH RECURSIVE " + STATE_SQL + f", {_FOLD} SELECT level_id, step, "
    + ", ".join(f"len(list_filter(rest, lambda v: v.x = {x} AND v.y = {y})) > 0 AS pill_{i}" for i, (x, y) in enumerate(POWER_PILLS, 1)) + " FROM rc",
)
def r9(spark, sf):
    log, dots = state_log(spark, sf), pellet_grid(spark, sf)
    return remaining_pills(log, dots, eaten_pellets(log, dots))
