"""Registered queries: normalisation strategies, registry and scopes."""

from pyspark.sql import functions as F

from pathlore.functions.expressions import live_distance
from pathlore.operators import normalize as nz
from pathlore.operators import sequences
from pathlore.plans.registry import query
from pathlore.plans.sequences import DIST_SQL, FINITE, _D, _scaled
from pathlore.sources.adapters import STATE_SQL, state_log, table

ST = f"WITH {STATE_SQL} "
EPS = "1.1920928955078125e-07::DOUBLE"
LI = "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, "


def _lines(spark, sf, *cols):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *cols)


def _rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


@query(
    "n1_standardize_global",
    LI + """round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_samp(l_extendedprice) FROM lineitem), 6) + 0.0::DOUBLE AS l_extendedprice
 FROM lineitem""",
)
def n1(spark, sf):
    df = nz.normalize_columns(_lines(spark, sf, "l_extendedprice"), {"l_extendedprice": nz.standardize()})
    return _rounded(df, ["l_extendedprice"])


@query(
    "n1_standardize_text",
    """WITH t AS (SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS v FROM orders)
 SELECT o_orderkey, coalesce(round((v - (SELECT avg(v) FROM t)) / (SELECT stddev_samp(v) FROM t), 6), 0) + 0.0::DOUBLE AS v FROM t""",
)
def n1_text(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise(F.col("o_totalprice").cast("string")).alias("v"),
    )
    return _rounded(nz.normalize_columns(df, {"v": nz.standardize()}), ["v"])


@query(
    "n1_standardize_per_order",
    LI + """coalesce(round((l_extendedprice - avg(l_extendedprice) OVER w) / CASE WHEN stddev_samp(l_extendedprice) OVER w > 1.1920928955078125e-07::DOUBLE
 THEN stddev_samp(l_extendedprice) OVER w ELSE 1.0::DOUBLE END, 6), 0) + 0.0::DOUBLE AS l_extendedprice FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
)
def n1_order(spark, sf):
    df = nz.normalize_columns(_lines(spark, sf, "l_extendedprice"), {"l_extendedprice": nz.standardize()}, ["l_orderkey"])
    return _rounded(df, ["l_extendedprice"])


@query(
    "n2_minmax_per_order",
    LI + f"""round((l_discount - min(l_discount) OVER w) / greatest(max(l_discount) OVER w - min(l_discount) OVER w, {EPS}), 6) AS l_discount
 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""",
)
def n2(spark, sf):
    df = nz.normalize_columns(_lines(spark, sf, "l_discount"), {"l_discount": nz.minmax()}, ["l_orderkey"])
    return _rounded(df, ["l_discount"])


@query(
    "n3_counter",
    ST + """SELECT game_state_id, round((score - (SELECT min(score) FROM states)) / greatest((SELECT max(score) - min(score) FROM states), 1e-7::DOUBLE), 6) AS score FROM states""",
)
def n3(spark, sf):
    df = state_log(spark, sf, "score").df.select("game_state_id", "score")
    return _rounded(nz.normalize_columns(df, {"score": nz.counter()}), ["score"])


@query("n4_binary_flag", "SELECT event_id, CAST(greatest(least(value, 1), 0) AS DOUBLE) AS value FROM events")
def n4(spark, sf):
    return nz.normalize_columns(table(spark, sf, "events").select("event_id", "value"), {"value": nz.binary_flag()})


@query(
    "n5_multistate_flag",
    ST + "SELECT game_state_id, " + ", ".join(f"greatest(least(ghost{g}_state, 3), 0) / 3.0::DOUBLE AS ghost{g}_state" for g in (1, 2, 3, 4)) + " FROM states",
)
def n5(spark, sf):
    cols = [f"ghost{g}_state" for g in (1, 2, 3, 4)]
    df = state_log(spark, sf).df.select("game_state_id", *cols)
    return nz.normalize_columns(df, {c: nz.multistate_flag() for c in cols})


@query("n6_position", ST + "SELECT game_state_id, (Pacman_X + 13.5) / 27.0::DOUBLE AS Pacman_X, (Pacman_Y + 16.5) / 30.0::DOUBLE AS Pacman_Y FROM states")
def n6(spark, sf):
    df = state_log(spark, sf).df.select("game_state_id", "Pacman_X", "Pacman_Y")
    return nz.normalize_columns(df, {"Pacman_X": nz.position("x"), "Pacman_Y": nz.position("y")})


def _distance_log(spark, sf, *need):
    log = state_log(spark, sf, *need)
    return log.having(log.df.withColumns({f"Ghost{g}_distance": live_distance(g) for g in (1, 2, 3, 4)}))


@query(
    "n7_distance",
    ST + f", dd AS (SELECT game_state_id, {DIST_SQL} FROM states) SELECT game_state_id, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in _D) + f" FROM (SELECT game_state_id, {', '.join(_scaled(c, '()') for c in _D)} FROM dd)",
)
def n7(spark, sf):
    df = _distance_log(spark, sf).df.select("game_state_id", *_D)
    return _rounded(nz.normalize_columns(df, {c: nz.distance() for c in _D}), _D)


_POS = ", ".join(f"({w}_X + 13.5) / 27.0::DOUBLE AS {w}_X, ({w}_Y + 16.5) / 30.0::DOUBLE AS {w}_Y" for w in ("Pacman", "Ghost2"))


@query(
    "n8_registry",
    ST + f"""SELECT game_state_id, {_POS}, CAST(pacman_attack AS DOUBLE) AS pacman_attack, greatest(least(ghost1_state, 4), 0) / 4.0::DOUBLE AS ghost1_state,
 round((lives - (SELECT min(lives) FROM states)) / greatest((SELECT max(lives) - min(lives) FROM states), {EPS}), 6) AS lives FROM states""",
)
def n8(spark, sf):
    df = state_log(spark, sf, "lives").df.select(
        "game_state_id", "Pacman_X", "Pacman_Y", "Ghost2_X", "Ghost2_Y", "pacman_attack", "ghost1_state", "lives"
    )
    tool = nz.Normalizer(strict=True).set("ghost1_state", nz.multistate_flag(4))
    return _rounded(tool.normalize(df, exempt=["game_state_id"]), ["lives"])


@query(
    "n9_normalize_subset",
    ST + "SELECT game_state_id, (Pacman_X + 13.5) / 27.0::DOUBLE AS Pacman_X, CAST(powerpelletstate_2 AS DOUBLE) AS powerpelletstate_2 FROM states",
)
def n9(spark, sf):
    df = state_log(spark, sf, "powerPellets").df
    return nz.Normalizer().normalize(df, columns=["game_state_id", "Pacman_X", "powerpelletstate_2"])


def _scope_sql(stage, over):
    """Distances normalised before cutting (global) or after (sequence, sample); the slice is the last 100 rows."""
    cut = "step >= greatest(n_rows - 100, 0)"
    inner = f"(SELECT level_id, step, n_rows, {', '.join(_scaled(c, over) for c in _D)} FROM "
    inner += "dd)" if stage == "global" else f"dd WHERE {cut})"
    return (
        ST + f", dd AS (SELECT level_id, step, n_rows, {DIST_SQL} FROM states) SELECT level_id, 0::BIGINT AS run, step - greatest(n_rows - 100, 0) AS run_step, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in _D) + f" FROM {inner} WHERE {cut}"
    )


for _scope, _over in (("global", "()"), ("sequence", "()"), ("sample", "(PARTITION BY level_id)")):

    def _run(spark, sf, scope=_scope):
        out = sequences.make_sequences(_distance_log(spark, sf), "Ghost_Distances", "last_5_seconds", normalization=scope)
        return _rounded(out, _D)

    query(f"n10_scope_{_scope}", _scope_sql(_scope, _over))(_run)
