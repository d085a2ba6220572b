"""Registered queries: trajectory similarity, embedding affinity, matrix profile."""

from pyspark.sql import functions as F

from pathlore.operators import motifs
from pathlore.operators import similarity as sim
from pathlore.plans.registry import query
from pathlore.sources.adapters import PATHS_SQL, STATE_SQL, paths, state_log, table

PT = f"WITH {PATHS_SQL}"
ST = f"WITH {STATE_SQL} "

_PAIRS = """, pr AS (SELECT a.traj_id AS i, b.traj_id AS j, sum({local}) AS d FROM path_steps a JOIN path_steps b
 ON a.step = b.step AND a.traj_id < b.traj_id GROUP BY 1, 2)"""
_EU = PT + _PAIRS.format(local="sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))")
_MA = PT + _PAIRS.format(local="abs(a.x - b.x) + abs(a.y - b.y)")


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


@query("d1_euclidean_within", _EU + " SELECT i, j, round(d, 6) AS d FROM pr WHERE d <= 5.9")
def d1(spark, sf):
    return _rounded(sim.pairs_within(paths(spark, sf), "euclidean", 5.9), "d")


@query("d2_manhattan_within", _MA + " SELECT i, j, round(d, 6) AS d FROM pr WHERE d <= 7.5")
def d2(spark, sf):
    return _rounded(sim.pairs_within(paths(spark, sf), "manhattan", 7.5), "d")


@query("d3_dtw_within")
def d3(spark, sf):
    return _rounded(sim.pairs_within(paths(spark, sf), "dtw", 4.6), "d")


@query("d4_dtw_band_within")
def d4(spark, sf):
    return _rounded(sim.pairs_within(paths(spark, sf), "dtw", 4.8, band=4), "d")


@query("d5_alignment_paths")
def d5(spark, sf):
    p = paths(spark, sf)
    edges = sim.nearest(p, 1, "dtw", band=8).select(F.col("id").alias("i"), F.col("other").alias("j"))
    aligned = sim.alignment_paths(sim.with_points(edges, p), band=8)
    return aligned.select("i", "j", F.round("d", 6).alias("d"), F.size("path").cast("long").alias("n"))


_BAND = 8


@query(
    "d5_alignment_steps",
    f"""WITH RECURSIVE {PATHS_SQL}, tr AS (SELECT traj_id, list({{'x': x, 'y': y}} ORDER BY step) AS p FROM path_steps GROUP BY 1),
 pr AS (SELECT a.traj_id AS i, b.traj_id AS j, a.p AS a, b.p AS b, len(a.p) AS n, len(b.p) AS m FROM tr a JOIN tr b ON b.traj_id = a.traj_id + 1),
 dg AS (
  SELECT i, j, a, b, n, m, 1 AS k, list_transform(range(0, n + 1), lambda x: CASE WHEN x = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS two,
   list_transform(range(0, n + 1), lambda x: 'inf'::DOUBLE) AS one, list_transform(range(0, n + 1), lambda x: 0) AS way FROM pr
  UNION ALL
  SELECT i, j, a, b, n, m, k + 1, one, list_transform(range(0, n + 1), lambda x: CASE WHEN x < 1 OR k + 1 - x < 1 OR k + 1 - x > m OR abs(2 * x - k - 1) > {_BAND} THEN 'inf'::DOUBLE
    ELSE sqrt(pow(a[x].x - b[k + 1 - x].x, 2) + pow(a[x].y - b[k + 1 - x].y, 2)) + least(two[x], one[x], one[x + 1]) END),
   list_transform(range(0, n + 1), lambda x: CASE WHEN x < 1 THEN 0 WHEN one[x + 1] < least(two[x], one[x]) THEN 2 WHEN one[x] < two[x] THEN 1 ELSE 0 END)
  FROM dg WHERE k < n + m),
 bk AS (
  SELECT i, j, n AS u, m AS v FROM pr
  UNION ALL
  SELECT bk.i, bk.j, u - CASE WHEN way[u + 1] = 2 THEN 0 ELSE 1 END, v - CASE WHEN way[u + 1] = 1 THEN 0 ELSE 1 END
  FROM bk JOIN dg ON dg.i = bk.i AND dg.j = bk.j AND dg.k = u + v WHERE u + v > 2)
 SELECT i, j, CAST(row_number() OVER (PARTITION BY i, j ORDER BY u + v) - 1 AS BIGINT) AS place, CAST(u - 1 AS BIGINT) AS step_i, CAST(v - 1 AS BIGINT) AS step_j FROM bk""",
)
def d5_steps(spark, sf):
    """Every path aligned with its successor, step by step."""
    p = paths(spark, sf)
    ids = p.select(F.col("traj_id").alias("i"))
    edges = ids.join(p.select(F.col("traj_id").alias("j")), F.col("j") == F.col("i") + 1)
    aligned = sim.alignment_paths(sim.with_points(edges, p), band=_BAND)
    return aligned.select("i", "j", F.posexplode("path").alias("place", "s")).select("i", "j", F.col("place").cast("long").alias("place"), F.col("s.i").alias("step_i"), F.col("s.j").alias("step_j"))


@query(
    "d6_nearest_trajectories",
    _EU + """, bo AS (SELECT i AS id, j AS other, d FROM pr UNION ALL SELECT j, i, d FROM pr),
 rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM bo) SELECT id, other, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 3""",
)
def d6(spark, sf):
    return _rounded(sim.nearest(paths(spark, sf), 3, "euclidean"), "d")


@query(
    "d6_affinity_totals",
    _EU + """, bo AS (SELECT i AS id, d FROM pr UNION ALL SELECT j, d FROM pr)
 SELECT id, count(*) AS n, round(sum(d), 4) AS total, round(min(d), 6) AS low, round(max(d), 6) AS high FROM bo GROUP BY 1""",
)
def d6_totals(spark, sf):
    out = sim.affinity_totals(paths(spark, sf), "euclidean")
    return _rounded(out, "low", "high").withColumn("total", F.round("total", 4))


_EMB = """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings),
 n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS norm FROM v)"""


@query(
    "d7_cosine_totals",
    _EMB + """, bo AS (SELECT a.id, CASE WHEN a.norm = 0 OR b.norm = 0 THEN 0 ELSE list_dot_product(a.e, b.e) / (a.norm * b.norm) END AS s FROM n a JOIN n b ON a.id <> b.id)
 SELECT id, round(sum(s), 5) + 0.0::DOUBLE AS total, round(min(s), 6) + 0.0::DOUBLE AS low, round(max(s), 6) + 0.0::DOUBLE AS high FROM bo GROUP BY 1""",
)
def d7(spark, sf):
    out = sim.affinity_totals(table(spark, sf, "embeddings"), "cosine", ident="vec_id", value="embedding")
    return _rounded(out, "low", "high").withColumn("total", F.round("total", 5) + F.lit(0.0)).drop("n")


@query(
    "d7_negative_euclidean_totals",
    _EMB + """, bo AS (SELECT a.id, -list_distance(a.e, b.e) AS s FROM n a JOIN n b ON a.id <> b.id)
 SELECT id, round(sum(s), 4) AS total, round(min(s), 6) AS low, round(max(s), 6) AS high FROM bo GROUP BY 1""",
)
def d7_euclid(spark, sf):
    out = sim.affinity_totals(table(spark, sf, "embeddings"), "negative_euclidean", ident="vec_id", value="embedding")
    return _rounded(out, "low", "high").withColumn("total", F.round("total", 4)).drop("n")


@query(
    "d8_distance_histogram",
    _EU + """, r AS (SELECT min(d) AS lo, (max(d) - min(d)) / 200 AS w FROM pr)
 SELECT bin, count(*) AS n FROM (SELECT least(CAST(floor((d - lo) / w) AS BIGINT), 199) AS bin FROM pr, r) GROUP BY 1""",
)
def d8_histogram(spark, sf):
    return sim.distance_histogram(paths(spark, sf), "euclidean").select("bin", "n")


@query(
    "d8_mean_distance_rank",
    _EU + """, bo AS (SELECT i AS id, d FROM pr UNION ALL SELECT j, d FROM pr), m AS (SELECT id, sum(d) / (count(*) + 1) AS mean_d FROM bo GROUP BY 1)
 SELECT id, round(mean_d, 6) AS mean_d, CAST(row_number() OVER (ORDER BY mean_d DESC, id) - 1 AS BIGINT) AS position FROM m""",
)
def d8_mean(spark, sf):
    return _rounded(sim.mean_distances(paths(spark, sf), "euclidean"), "mean_d")


@query(
    "d8_sorted_distances",
    _EU + " SELECT i, j, round(d, 6) AS d, CAST(row_number() OVER (ORDER BY d, i, j) - 1 AS BIGINT) AS position FROM pr WHERE d <= 5.9",
)
def d8_sorted(spark, sf):
    return _rounded(sim.sorted_distances(sim.pairs_within(paths(spark, sf), "euclidean", 5.9)), "d")


@query(
    "t1_direction_codes",
    ST + "SELECT game_state_id, CASE direction WHEN 'left' THEN 1 WHEN 'right' THEN 2 WHEN 'up' THEN 3 WHEN 'down' THEN 4 ELSE 0 END AS code FROM states",
)
def t1(spark, sf):
    return state_log(spark, sf).df.select("game_state_id", motifs.direction_code("direction").alias("code"))


_PROFILE = ST + """, w AS (SELECT level_id, step AS start, list(k::DOUBLE) OVER (PARTITION BY level_id ORDER BY step ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM states),
 z AS (SELECT level_id, start, list_avg(v) AS mu, list_stddev_pop(v) AS sd, v FROM w WHERE len(v) = 8),
 zz AS (SELECT level_id, start, sd = 0 AS flat, list_transform(v, lambda e: CASE WHEN sd = 0 THEN 0 ELSE (e - mu) / sd END) AS u FROM z),
 pd AS (SELECT a.level_id, a.start, b.start AS neighbour, CASE WHEN a.flat AND b.flat THEN 0 WHEN a.flat OR b.flat THEN sqrt(8)
  ELSE sqrt(greatest(16 - 2 * list_dot_product(a.u, b.u), 0)) END AS d FROM zz a JOIN zz b ON a.level_id = b.level_id AND abs(a.start - b.start) > 2),
 mp AS (SELECT level_id, start, arg_min(neighbour, (round(d, 6), neighbour)) AS neighbour, min(round(d, 6)) AS d FROM pd GROUP BY 1, 2)"""


@query("t2_matrix_profile", _PROFILE + " SELECT level_id, start, neighbour, d FROM mp")
def t2(spark, sf):
    return _rounded(motifs.matrix_profile(state_log(spark, sf), "k", 8), "d")


@query(
    "t3_motif_distances",
    _PROFILE + """ SELECT level_id, start, neighbour, CAST(rank AS INTEGER) AS rank, d FROM (SELECT *, row_number() OVER (PARTITION BY level_id ORDER BY d, start) AS rank FROM mp) WHERE rank <= 2""",
)
def t3(spark, sf):
    pair = motifs.motif_pair(motifs.matrix_profile(state_log(spark, sf), "k", 8), ["level_id"])
    return _rounded(pair.select("level_id", "start", "neighbour", "rank", "d"), "d")
