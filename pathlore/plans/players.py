"""Registered queries: surveys, player statistics, descriptive tables."""

from pyspark.sql import functions as F

from pathlore.operators import behaviour as bh
from pathlore.operators import core, players
from pathlore.plans.behaviours import SUMMARY_CTES, _hunt_after_sql, detectors_log, ST
from pathlore.plans.registry import query
from pathlore.sources.adapters import LEVELS_SQL, SURVEY_SQL, levels, survey, table

LV = f"WITH {LEVELS_SQL} "
SV = f"WITH {SURVEY_SQL} "
ITEMS = [f"item_{i}" for i in range(1, 9)]
_SUM = lambda names: " + ".join(f"coalesce({c}, 0)" for c in names)


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


@query("p1_flow_sum", SV + f"SELECT row_id, user_id, {_SUM(ITEMS)} AS FLOW FROM survey WHERE instrument = '1-URGENT'")
def p1(spark, sf):
    return players.flow_scores(survey(spark, sf), ITEMS, "1-URGENT", "instrument").select("row_id", "user_id", "FLOW")


@query("p1_flow_mean", SV + f"SELECT row_id, user_id, ({' + '.join(ITEMS)}) / 8 AS FLOW FROM survey WHERE instrument = '1-URGENT'")
def p1_mean(spark, sf):
    return players.flow_scores(survey(spark, sf), ITEMS, "1-URGENT", "instrument", mean=True).select("row_id", "user_id", "FLOW")


def _flow_and_games(spark, sf):
    """Answers numbered like the levels of their user; games are the lost levels with the same number."""
    answers = core.order_log(survey(spark, sf), ["user_id"], ["row_id"], step="_n").df.withColumn("total_levels_played", F.col("_n") + 1)
    flow = players.flow_scores(answers, ITEMS, "1-URGENT", "instrument")
    played = core.order_log(levels(spark, sf), ["user_id"], ["level_id"], step="_n").df.withColumn("total_levels_played", F.col("_n") + 1)
    lost = core.order_log(played.where("win = 0"), ["user_id"], ["level_id"], step="_g").df
    games = lost.select("user_id", "total_levels_played", (F.col("_g") + 1).alias("total_games_played"), F.floor("duration").cast("double").alias("max_score"))
    return flow.select("user_id", "total_levels_played", "FLOW", *ITEMS), games


FLOW_SQL = f"""{SURVEY_SQL}, {LEVELS_SQL}, an AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_id) AS total_levels_played FROM survey),
 fl AS (SELECT *, {_SUM(ITEMS)} AS FLOW FROM an WHERE instrument = '1-URGENT'),
 pl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level_id) AS total_levels_played FROM levels),
 gm AS (SELECT user_id, total_levels_played, row_number() OVER (PARTITION BY user_id ORDER BY level_id) AS total_games_played, floor(duration)::DOUBLE AS max_score FROM pl WHERE win = 0),
 fg AS (SELECT fl.user_id, fl.total_levels_played, FLOW, {', '.join(ITEMS)}, total_games_played, max_score FROM fl JOIN gm ON gm.user_id = fl.user_id AND gm.total_levels_played = fl.total_levels_played)"""


@query(
    "p2_flow_games_join",
    f"WITH {FLOW_SQL} SELECT user_id, total_levels_played, FLOW, total_games_played, max_score FROM fg WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ITEMS),
)
def p2(spark, sf):
    return players.join_flow_games(*_flow_and_games(spark, sf)).drop(*ITEMS)


_T3 = """t3 AS (SELECT user_id, FLOW, total_games_played, max_score, ln(max_score) AS ls, max(max_score) OVER () - max_score + 1 AS inv FROM fg)"""


@query(
    "p3_score_transforms",
    f"WITH {FLOW_SQL}, {_T3} SELECT user_id, total_games_played, round(ls, 6) AS log_score, inv AS inv_score, round(ln(inv), 6) AS log_inv FROM t3",
)
def p3(spark, sf):
    flow, games = _flow_and_games(spark, sf)
    out = players.score_transforms(players.join_flow_games(flow.drop(*ITEMS), games))
    return out.select(
        "user_id", "total_games_played", F.round("log(max_score)", 6).alias("log_score"), F.col("inv(max_score)").alias("inv_score"),
        F.round("log(inv(max_score))", 6).alias("log_inv"),
    )


@query(
    "p4_z_score_within_user",
    LV + """SELECT level_id, CASE WHEN stddev_samp(duration) OVER w > 0 THEN round((duration - avg(duration) OVER w) / stddev_samp(duration) OVER w, 5) + 0.0::DOUBLE END AS z
 FROM levels WINDOW w AS (PARTITION BY user_id)""",
)
def p4(spark, sf):
    out = players.z_score_within(levels(spark, sf), ["user_id"], "duration", "z")
    return out.select("level_id", (F.round("z", 5) + 0.0).alias("z"))


@query(
    "p5_running_total",
    LV + "SELECT level_id, round(sum(duration) OVER (PARTITION BY user_id ORDER BY level_id), 2) AS total FROM levels",
)
def p5(spark, sf):
    out = players.running_total(levels(spark, sf), ["user_id"], ["level_id"], "duration", "total")
    return out.select("level_id", F.round("total", 2).alias("total"))


@query(
    "p6_fit_residual",
    LV + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level_id)::DOUBLE AS trial, ln(duration) AS y FROM levels),
 f AS (SELECT user_id, coalesce(regr_slope(y, trial), 0) AS a, coalesce(regr_intercept(y, trial), avg(y)) AS b, count(*) AS c FROM n GROUP BY 1)
 SELECT level_id, round(CASE WHEN c = 1 THEN 0 ELSE y - (a * trial + b) END, 6) + 0.0::DOUBLE AS residual FROM n JOIN f USING (user_id)""",
)
def p6(spark, sf):
    log = core.order_log(levels(spark, sf), ["user_id"], ["level_id"])
    df = log.df.select("user_id", "level_id", (F.col("step") + 1.0).alias("trial"), F.log("duration").alias("y"))
    out = players.fit_residual(df, ["user_id"], "y", "trial", "residual")
    return out.select("level_id", (F.round("residual", 6) + 0.0).alias("residual"))


_GROUPS = {"BIS": ITEMS[:7], "REW": ITEMS[:5], "DRIVE": ITEMS[:4], "FUN": ITEMS[4:]}


@query(
    "p7_scales",
    SV + ", s AS (SELECT * REPLACE (CASE WHEN row_id % 11 = 0 THEN NULL ELSE instrument END AS instrument) FROM survey) SELECT user_id, row_id, "
    + ", ".join(f"{_SUM(c)} AS {n}" for n, c in _GROUPS.items())
    + " FROM s WHERE (instrument IS NULL OR instrument NOT IN ('2-HIGH', '5-LOW')) AND user_id > 60",
)
def p7(spark, sf):
    rows = survey(spark, sf).withColumn("instrument", F.when(F.col("row_id") % 11 != 0, F.col("instrument")))
    return players.scales(
        rows, _GROUPS, user="user_id", column="instrument", consent=None, repeated=("2-HIGH", "5-LOW"), keep=["row_id"]
    )


@query(
    "p8_user_profile",
    LV + """, s AS (SELECT *, row_number() OVER (PARTITION BY user_id, session_number ORDER BY level_id) AS level_in_session FROM levels)
 SELECT user_id, round(avg(duration), 6) AS avg_game_duration, max(level) AS max_level, count(*) AS games_played, max(level_in_session) AS longest_session,
 max(session_number) AS amount_sessions, CAST(sum(win) AS BIGINT) AS wins, CAST(count(*) - sum(win) AS BIGINT) AS losses, round(sum(win) / count(*)::DOUBLE, 6) AS winrate FROM s GROUP BY 1""",
)
def p8(spark, sf):
    lv = levels(spark, sf, "level").withColumn("session_number", F.col("session_number").cast("long"))
    log = core.order_log(lv, ["user_id", "session_number"], ["level_id"])
    out = players.user_profile(log.df.withColumn("level_in_session", F.col("step") + 1))
    return _r(out, "winrate").withColumn("avg_game_duration", F.round("avg_game_duration", 6))


@query(
    "p9_describe",
    """WITH l AS (SELECT 'l_quantity' AS attribute, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem)
 SELECT attribute, statistic, round(value, 4) AS value FROM (
 SELECT attribute, 'count' AS statistic, count(v)::DOUBLE AS value FROM l GROUP BY 1 UNION ALL SELECT attribute, 'mean', avg(v) FROM l GROUP BY 1
 UNION ALL SELECT attribute, 'std', stddev_samp(v) FROM l GROUP BY 1 UNION ALL SELECT attribute, 'min', min(v) FROM l GROUP BY 1
 UNION ALL SELECT attribute, 'max', max(v) FROM l GROUP BY 1 UNION ALL SELECT attribute, '25%', quantile_cont(v, 0.25) FROM l GROUP BY 1
 UNION ALL SELECT attribute, '50%', quantile_cont(v, 0.5) FROM l GROUP BY 1 UNION ALL SELECT attribute, '75%', quantile_cont(v, 0.75) FROM l GROUP BY 1)""",
)
def p9(spark, sf):
    out = players.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"])
    return out.withColumn("value", F.round("value", 4))


@query("p10_counts_per_user", LV + "SELECT user_id, count(*) AS n FROM levels GROUP BY 1")
def p10(spark, sf):
    return players.counts(levels(spark, sf), "user_id")


@query("p10_value_counts", LV + "SELECT level, count(*) AS n FROM levels GROUP BY 1")
def p10_values(spark, sf):
    return players.counts(levels(spark, sf, "level"), "level")


@query(
    "p11_histogram",
    """WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders),
 h AS (SELECT CAST(least(floor((o_totalprice - lo) / w), 29) AS BIGINT) AS bin, lo, w FROM orders, b) SELECT bin, round(min(lo + bin * w), 4) AS lo, count(*) AS n FROM h GROUP BY 1""",
)
def p11(spark, sf):
    return players.histogram(table(spark, sf, "orders"), "o_totalprice", 30).withColumn("lo", F.round("lo", 4))


@query(
    "p12_nonzero_distribution",
    f"WITH RECURSIVE {SUMMARY_CTES} SELECT v AS Aggression4_value, count(*) AS n FROM vals WHERE name = 'Aggression4' AND v <> 0 GROUP BY 1",
)
def p12(spark, sf):
    return players.nonzero_distribution(bh.Behaviours().summary(detectors_log(spark, sf), "Aggression4"), "Aggression4_value")


@query(
    "p12_survival_counts",
    ST + ", " + _hunt_after_sql(30, 3, 15) + " SELECT 'Aggression4' AS name, count(CASE WHEN died THEN 1 END) AS died, count(CASE WHEN NOT died THEN 1 END) AS survived FROM ha",
)
def p12_died(spark, sf):
    found = bh.Behaviours().detect(detectors_log(spark, sf), "Aggression4", search_window=30, value_threshold=3, distance_threshold=15)
    return players.survival_counts(found)


@query(
    "p13_user_overall",
    f"""WITH {LEVELS_SQL}, {SURVEY_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level_id) AS trial FROM levels WHERE win = 0),
 sc AS (SELECT l_orderkey AS level_id, max(l_quantity) AS score FROM lineitem GROUP BY 1),
 j AS (SELECT t.user_id, trial, score FROM t FULL JOIN sc ON sc.level_id = t.level_id), u AS (SELECT user_id, max(trial) AS total_whole_games_played, max(score) AS score FROM j GROUP BY 1),
 s AS (SELECT user_id, max({_SUM(ITEMS[:7])}) AS BIS FROM survey WHERE user_id > 60 GROUP BY 1) SELECT u.user_id, total_whole_games_played, u.score, BIS FROM u JOIN s USING (user_id)""",
)
def p13(spark, sf):
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("level_id")).agg(F.max("l_quantity").alias("score"))
    bis = players.scales(survey(spark, sf), {"BIS": ITEMS[:7]}, user="user_id", column="instrument", consent=None, repeated=("none",))
    return players.user_overall(levels(spark, sf).where("win = 0"), scores, bis.groupBy("user_id").agg(F.max("BIS").alias("BIS")))


_CUST = "l AS (SELECT l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS t FROM lineitem)"


@query(
    "p14_spearman_matrix",
    f"""WITH {_CUST}, r AS (SELECT """ + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r{c}" for c in "qpdt")
    + " FROM l) " + " UNION ALL ".join(
        f"SELECT '{na}' AS a, '{nb}' AS b, round(corr(r{a}, r{b}), 6) AS rho FROM r"
        for (a, na), (b, nb) in [(x, y) for i, x in enumerate([("q", "l_quantity"), ("p", "l_extendedprice"), ("d", "l_discount"), ("t", "l_tax")])
                                 for y in [("q", "l_quantity"), ("p", "l_extendedprice"), ("d", "l_discount"), ("t", "l_tax")][i + 1:]]
    ),
)
def p14(spark, sf):
    out = players.spearman_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumn("rho", F.round("rho", 6))


def _trials(spark, sf):
    log = core.order_log(levels(spark, sf), ["user_id"], ["level_id"])
    return log.df.select("user_id", (F.col("step") + 1).alias("trial"), "duration")


TRIALS = LV + ", tr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY level_id) AS trial, duration FROM levels)"


@query(
    "p15_pearson_per_user",
    TRIALS + " SELECT user_id, CASE WHEN count(*) > 1 THEN round(corr(trial, duration), 6) + 0.0::DOUBLE END AS r FROM tr GROUP BY 1",
)
def p15(spark, sf):
    out = players.correlation_by(_trials(spark, sf), ["user_id"], "trial", "duration")
    return out.withColumn("r", F.round(F.nanvl("r", F.lit(None)), 6) + 0.0)


@query(
    "p16_fit_per_user",
    TRIALS + """ SELECT user_id, CASE WHEN count(*) > 1 THEN round(regr_slope(duration, trial), 4) + 0.0::DOUBLE ELSE 0 END AS slope,
 round(coalesce(regr_intercept(duration, trial), avg(duration)), 6) AS intercept, CASE WHEN count(*) > 1 THEN round(regr_r2(duration, trial), 6) END AS r2, count(*) AS n FROM tr GROUP BY 1""",
)
def p16(spark, sf):
    out = players.group_fits(_trials(spark, sf), ["user_id"], "duration", "trial")
    return out.select("user_id", (F.round("slope", 4) + 0.0).alias("slope"), F.round("intercept", 6).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query(
    "p17_scales_left_join_flow",
    SV + f", s AS (SELECT user_id, row_id, {_SUM(ITEMS[:7])} AS BIS FROM survey WHERE (instrument IS NULL OR instrument <> '1-URGENT') AND user_id > 60), f AS (SELECT user_id, row_id AS flow_row, ({' + '.join(ITEMS)}) / 8 AS FLOW FROM survey WHERE instrument = '1-URGENT')"
    + " SELECT s.user_id, row_id, BIS, flow_row, FLOW FROM s LEFT JOIN f USING (user_id)",
)
def p17(spark, sf):
    rows = survey(spark, sf)
    flow = players.flow_scores(rows, ITEMS, "1-URGENT", "instrument", mean=True).select("user_id", F.col("row_id").alias("flow_row"), "FLOW")
    base = players.scales(
        rows, {"BIS": ITEMS[:7]}, user="user_id", column="instrument", consent=None, repeated=("1-URGENT",), keep=["row_id"]
    )
    return base.join(flow, "user_id", "left")


@query("p18_learning_curve", TRIALS + " SELECT trial, round(avg(duration), 4) AS avg_score FROM tr WHERE trial <= 10 GROUP BY 1")
def p18(spark, sf):
    out = players.learning_curve(_trials(spark, sf), "trial", "duration", 10)
    return out.withColumn("avg_score", F.round("avg_score", 4))


@query(
    "flow_table",
    f"""WITH {FLOW_SQL}, {_T3}, lf AS (SELECT user_id, regr_slope(ln(inv), total_games_played) AS a, regr_intercept(ln(inv), total_games_played) AS b, avg(ln(inv)) AS m, count(*) AS n FROM t3 GROUP BY 1)
 SELECT t3.user_id, FLOW, total_games_played, max_score, round(ls, 6) AS log_score, inv AS inv_score, round(ln(inv), 6) AS log_inv, round(ln(total_games_played), 6) AS log_games,
 CASE WHEN stddev_samp(FLOW) OVER w > 0 THEN round((FLOW - avg(FLOW) OVER w) / stddev_samp(FLOW) OVER w, 5) + 0.0::DOUBLE END AS flow_z_score,
 sum(max_score) OVER o AS cum_score, round(ln(sum(max_score) OVER o), 6) AS log_cum, round(CASE WHEN n = 1 THEN 0 ELSE ln(inv) - (a * total_games_played + b) END, 5) + 0.0::DOUBLE AS score_deviation
 FROM t3 JOIN lf ON lf.user_id = t3.user_id WINDOW w AS (PARTITION BY t3.user_id), o AS (PARTITION BY t3.user_id ORDER BY total_games_played)""",
)
def flow_table(spark, sf):
    out = players.flow_table(*_flow_and_games(spark, sf))
    return out.select(
        "user_id", "FLOW", "total_games_played", "max_score", F.round("log(max_score)", 6).alias("log_score"),
        F.col("inv(max_score)").alias("inv_score"), F.round("log(inv(max_score))", 6).alias("log_inv"),
        F.round("log(total_games_played)", 6).alias("log_games"), (F.round("flow_z_score", 5) + 0.0).alias("flow_z_score"), "cum_score",
        F.round("log(cum_score)", 6).alias("log_cum"), (F.round("score_deviation", 5) + 0.0).alias("score_deviation"),
    )
