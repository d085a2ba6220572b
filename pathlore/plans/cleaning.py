"""Registered queries: parsing, selection, level / game restructuring, log repair."""

from pyspark.sql import functions as F

from pathlore.functions.expressions import mixed_uniform_sql
from pathlore.operators import core, filters, restructure
from pathlore.plans.registry import query
from pathlore.sources.adapters import LEVELS_SQL, STATE_SQL, levels, state_log, survey, table
from pathlore.sources.files import parse_points

ST = f"WITH {STATE_SQL} "
LV = f"WITH {LEVELS_SQL} "
BOTH = f"WITH {STATE_SQL}, {LEVELS_SQL} "


@query(
    "s7_json_points",
    """SELECT event_id, CAST(i AS BIGINT) AS pos, CAST(k + i AS DOUBLE) AS x, CAST(event_id % 31 AS DOUBLE) AS y FROM
 (SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events), unnest([0, 1]) AS u(i)""",
)
def s7(spark, sf):
    k = F.get_json_object("props", "$.k")
    text = F.concat(
        F.lit("[["), k, F.lit(","), F.col("event_id") % 31, F.lit("],["), k.cast("long") + 1, F.lit(","),
        F.col("event_id") % 31, F.lit("]]"),
    )
    ev = table(spark, sf, "events").select("event_id", F.posexplode(parse_points(text)).alias("pos", "p"))
    return ev.select("event_id", F.col("pos").cast("long").alias("pos"), "p.x", "p.y")


_BAN = "(user_id IN (42, 7) OR level_id IN (419, 3))"


@query("f1_drop_banned_levels", LV + f"SELECT level_id, user_id FROM levels WHERE NOT {_BAN}")
def f1_levels(spark, sf):
    lv, _ = filters.drop_banned(levels(spark, sf), state_log(spark, sf).df, (42, 7), (419, 3))
    return lv.select("level_id", "user_id")


@query(
    "f1_drop_banned_states",
    BOTH + f"""SELECT level_id, game_state_id FROM states
 WHERE level_id NOT IN (SELECT level_id FROM levels WHERE {_BAN})""",
)
def f1_states(spark, sf):
    _, st = filters.drop_banned(levels(spark, sf), state_log(spark, sf).df, (42, 7), (419, 3))
    return st.select("level_id", "game_state_id")


@query("f2_orphans", "SELECT o_orderkey AS level_id FROM orders WHERE o_orderkey NOT IN (SELECT user_id FROM events)")
def f2(spark, sf):
    return filters.orphans(levels(spark, sf).select("level_id"), state_log(spark, sf).df)


@query("f3_states_for_levels", "SELECT user_id AS level_id, event_id AS game_state_id FROM events WHERE user_id IN (3, 8, 46, 7)")
def f3(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("level_id"), F.col("event_id").alias("game_state_id"))
    return filters.states_for_levels(ev, [3, 8, 46, 7])


@query(
    "f4_states_for_users",
    """SELECT user_id AS level_id, event_id AS game_state_id FROM events
 WHERE user_id IN (SELECT o_orderkey FROM orders WHERE o_custkey % 5 = 1)""",
)
def f4(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("level_id"), F.col("event_id").alias("game_state_id"))
    return filters.states_for_users(ev, levels(spark, sf), F.col("user_id") % 5 == 1)


@query(
    "f5_states_in_range",
    """SELECT e.user_id AS level_id, e.event_id AS game_state_id FROM events e JOIN
 (SELECT user_id, min(event_id) + (max(event_id) - min(event_id)) // 4 AS lo,
  max(event_id) - (max(event_id) - min(event_id)) // 4 AS hi FROM events GROUP BY 1) r USING (user_id)
 WHERE event_id BETWEEN lo AND hi""",
)
def f5(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("level_id"), F.col("event_id").alias("game_state_id"))
    span = "(max(game_state_id) - min(game_state_id)) div 4"
    ranges = ev.groupBy("level_id").agg(
        F.expr(f"min(game_state_id) + {span}").alias("lo"), F.expr(f"max(game_state_id) - {span}").alias("hi")
    )
    return filters.states_in_ranges(ev, ranges)


@query(
    "f6_collect_metadata",
    LV + """, long AS (SELECT user_id, 'session_number' AS attribute, CAST(session_number AS VARCHAR) AS value FROM levels
 UNION SELECT user_id, 'win', CAST(win AS VARCHAR) FROM levels UNION SELECT user_id, 'level_id', CAST(level_id AS VARCHAR) FROM levels)
 SELECT *, count(*) OVER (PARTITION BY user_id, attribute) AS n_values FROM long""",
)
def f6(spark, sf):
    return filters.collect_metadata(levels(spark, sf), ["user_id"], ["session_number", "win", "level_id"])


@query(
    "f7_select_features",
    ST + "SELECT game_state_id, Pacman_X, Pacman_Y, " + ", ".join(f"Ghost{g}_X, Ghost{g}_Y" for g in (1, 2, 3, 4)) + " FROM states",
)
def f7(spark, sf):
    return filters.select_features(state_log(spark, sf).df, "Pacman_Ghosts", ["game_state_id"])


@query(
    "f8_join_states_levels",
    "SELECT event_id AS game_state_id, user_id AS level_id, CAST(o_orderstatus <> 'F' AS INTEGER) AS win, o_totalprice AS duration FROM events JOIN orders ON user_id = o_orderkey",
)
def f8(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_id").alias("game_state_id"), F.col("user_id").alias("level_id"))
    return filters.join_states_levels(ev, levels(spark, sf), ["win", "duration"])


@query("f9_duration_outliers", LV + "SELECT level_id, duration FROM levels WHERE duration < 250000 AND duration > 1000")
def f9(spark, sf):
    return filters.within(levels(spark, sf), "duration", 1000, 250000).select("level_id", "duration")


@query(
    "f10_keep_users_max_above",
    LV + "SELECT level_id, user_id FROM levels WHERE user_id IN (SELECT user_id FROM levels GROUP BY 1 HAVING max(level) > 5)",
)
def f10(spark, sf):
    return filters.keep_max_above(levels(spark, sf, "level"), ["user_id"], "level", 5).select("level_id", "user_id")


@query(
    "f11_keep_group_size",
    LV + "SELECT level_id, user_id FROM levels WHERE user_id IN (SELECT user_id FROM levels GROUP BY 1 HAVING count(*) >= 10)",
)
def f11(spark, sf):
    return filters.keep_group_size(levels(spark, sf), ["user_id"], 10).select("level_id", "user_id")


@query(
    "f12_sample_per_group",
    f"""SELECT * FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type
 ORDER BY {mixed_uniform_sql(['event_id'], 11)}, event_id) AS INTEGER) AS pick FROM events) WHERE pick <= 4""",
)
def f12(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "event_id")
    return filters.sample_per_group(ev, ["event_type"], "event_id", 4, seed=11)


@query("f12_first_n", "SELECT event_id, user_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def f12_first(spark, sf):
    return filters.first_n(table(spark, sf, "events").select("event_id", "user_id", "ts"), ["ts", "event_id"], 100)


@query(
    "r1_max_score",
    BOTH + """SELECT l.level_id, l.user_id, s.max_score FROM levels l LEFT JOIN
 (SELECT level_id, max(score) AS max_score FROM states GROUP BY 1) s USING (level_id)""",
)
def r1(spark, sf):
    return restructure.max_score(levels(spark, sf).select("level_id", "user_id"), state_log(spark, sf, "score").df)


GAMES_SQL = """gm AS (SELECT *, min(CASE WHEN win = 0 THEN level_id END) OVER (PARTITION BY user_id ORDER BY level_id
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS game_id FROM levels)"""


@query(
    "r2_assign_games",
    LV + f", {GAMES_SQL} SELECT level_id, user_id, level, game_id FROM gm",
)
def r2_levels(spark, sf):
    return restructure.assign_games(levels(spark, sf, "level")).select("level_id", "user_id", "level", "game_id")


@query(
    "r2_assemble_games",
    LV + f""", {GAMES_SQL} SELECT game_id, max(user_id) AS user_id, max(level) AS max_level,
 round(sum(duration), 4) AS game_duration, min_by(date_played, level_id) AS date_played,
 string_agg(CAST(level_id AS VARCHAR), ',' ORDER BY level_id) AS level_ids FROM gm WHERE game_id IS NOT NULL GROUP BY 1""",
)
def r2_games(spark, sf):
    games = restructure.assemble_games(levels(spark, sf, "level"))
    return games.withColumns(
        {
            "level_ids": F.array_join(F.transform("level_ids", lambda i: i.cast("string")), ","),
            "game_duration": F.round("game_duration", 4),
        }
    )


@query(
    "r3_game_counters",
    LV + """SELECT level_id, user_id, session_number, row_number() OVER (PARTITION BY user_id ORDER BY level_id) AS total_games_played,
 row_number() OVER (PARTITION BY user_id, session_number ORDER BY level_id) AS game_in_session FROM levels WHERE win = 0""",
)
def r3(spark, sf):
    out = restructure.game_counters(levels(spark, sf).select("level_id", "user_id", F.col("session_number").cast("long").alias("session_number"), "win"))
    return out.drop("win")


@query(
    "r4_rebase_first",
    ST + """SELECT level_id, step, score - first_value(score) OVER (PARTITION BY level_id ORDER BY step) AS score,
 round(value - first_value(value) OVER (PARTITION BY level_id ORDER BY step), 6) AS value FROM states""",
)
def r4(spark, sf):
    log = state_log(spark, sf, "score")
    both = restructure.rebase_first(log.having(restructure.rebase_first(log, "score")), "value")
    return both.select("level_id", "step", "score", F.round("value", 6).alias("value"))


@query(
    "r5_close_lost_levels",
    BOTH + """SELECT s.level_id, s.step, CASE WHEN s.step = s.n_rows - 1 AND l.win = 0 THEN 0 ELSE s.lives END AS lives
 FROM states s LEFT JOIN levels l USING (level_id)""",
)
def r5(spark, sf):
    return restructure.close_lost_levels(state_log(spark, sf, "lives"), levels(spark, sf)).select("level_id", "step", "lives")


@query(
    "r6_repair_attack_prefix",
    ST + """SELECT level_id, step, CASE WHEN step < 350 AND powerPellets = 4 AND pacman_attack = 1 THEN 0 ELSE pacman_attack END AS pacman_attack FROM
 (SELECT * REPLACE (CAST(CASE WHEN k % 3 = 0 THEN 4 ELSE powerPellets END AS INTEGER) AS powerPellets) FROM states)""",
)
def r6(spark, sf):
    df = state_log(spark, sf, "powerPellets").df
    # pills stay at 4 on a third of the rows, so that the fault occurs
    df = df.withColumn("powerPellets", F.when(F.col("k") % 3 == 0, 4).otherwise(F.col("powerPellets")))
    return restructure.repair_attack_prefix(df).select("level_id", "step", "pacman_attack")


@query(
    "r7_repair_house_prefix",
    ST + "SELECT level_id, step, " + ", ".join(
        f"""CASE WHEN step < 350 AND powerPellets = 4 AND ghost{g}_state = 4 AND Ghost{g}_X > -3.5 AND Ghost{g}_X < 3.5
 AND Ghost{g}_Y > -2.5 AND Ghost{g}_Y < 1.5 THEN 0 ELSE ghost{g}_state END AS ghost{g}_state""" for g in (1, 2, 3, 4)
    ) + " FROM states",
)
def r7(spark, sf):
    df = restructure.repair_house_prefix(state_log(spark, sf, "powerPellets").df)
    return df.select("level_id", "step", *[f"ghost{g}_state" for g in (1, 2, 3, 4)])


@query(
    "state_log_view",
    ST + """SELECT level_id, game_state_id, step, round(time_elapsed, 6) AS time_elapsed, pacman_attack, Pacman_X, Pacman_Y,
 lives, score, pellets, powerPellets, powerpelletstate_2, direction, Ghost3_X, Ghost4_Y, ghost2_state FROM states""",
)
def state_view(spark, sf):
    df = state_log(spark, sf, "time_elapsed", "lives", "score", "powerPellets").df
    return df.select(
        "level_id", "game_state_id", "step", F.round("time_elapsed", 6).alias("time_elapsed"), "pacman_attack",
        "Pacman_X", "Pacman_Y", "lives", "score", "pellets", "powerPellets", "powerpelletstate_2", "direction",
        "Ghost3_X", "Ghost4_Y", "ghost2_state",
    )
