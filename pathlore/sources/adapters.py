"""Driver tables as the reference-shaped views, once for Spark and once as SQL text for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.operators import core
from pathlore.operators.core import OrderedLog

_DIRECTION = {"click": "left", "view": "right", "purchase": "up", "signup": "down", "error": "none"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_k():
    """The integer of ``{"k": n}``; cheaper than a JSON parse, which Spark may repeat per use of the column."""
    return F.expr("""cast(trim(both '{}"k: ' from props) as bigint)""")


def state_log(spark: SparkSession, sf_dir: str, *need: str, max_rows: int | None = None) -> OrderedLog:
    """``events`` as a state log. ``need`` names the order-dependent columns to add:
    time_elapsed, lives, score, powerPellets. Everything else is a plain expression and always there."""
    base = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("level_id"), "user_id", F.col("event_id").alias("game_state_id"), "ts", "event_type",
        "value", "props", event_k().alias("k"),
    )
    log = core.order_log(base, ["level_id"], ["ts", "game_state_id"], max_rows=max_rows)
    words = " ".join(f"WHEN '{kind}' THEN '{word}'" for kind, word in _DIRECTION.items())
    e = "game_state_id"
    log = log.having(log.df.selectExpr(
        "*",
        "int(event_type IN ('click', 'view')) AS pacman_attack",
        "(k % 28) - 13.5D AS Pacman_X",
        f"({e} % 31) - 16.5D AS Pacman_Y",
        "244 - step AS pellets",
        f"CASE event_type {words} END AS direction",
        *[
            column
            for g in (1, 2, 3, 4)
            for column in (
                f"((k * {g} + {e}) % 55) / 2D - 13.5D AS Ghost{g}_X",
                f"(({e} * {g} + k) % 61) / 2D - 16.5D AS Ghost{g}_Y",
                f"int(({e} * {g} + k) % 5) AS ghost{g}_state",
            )
        ],
    ))
    totals = {}
    if "time_elapsed" in need:
        totals["_t0"] = F.min("ts")
    if "lives" in need:
        totals["_n"] = F.count(F.lit(1))
    if totals:
        log = log.having(core.total_steps(log, totals))
    df = log.df
    if "time_elapsed" in need:
        df = df.withColumn("time_elapsed", F.expr("timestampdiff(MICROSECOND, _t0, ts)") / 1e6)
    if "lives" in need:
        df = df.withColumn("lives", F.expr("cast(3 - (3 * step) div _n as int)"))
    df = df.drop("_t0", "_n")
    if "score" in need:
        df = core.running_steps(log.having(df), {"score": ("sum", F.floor("value"))})
    if "powerPellets" in need:
        df = core.near(log.having(df), 1, lambda w: {"_pa": F.lag("pacman_attack", 1, 0).over(w)})
        # a pill goes where a run begins, and now and then inside one
        begun = ((F.col("pacman_attack") == 1) & ((F.col("_pa") == 0) | (F.col("k") % 13 == 0))).cast("long")
        df = core.running_steps(log.having(df), {"_runs": ("sum", begun)})
        df = df.withColumn("powerPellets", F.greatest(F.lit(0), 4 - F.col("_runs")).cast("int")).drop("_pa", "_runs")
        df = df.withColumns(
            {f"powerpelletstate_{j}": (F.col("powerPellets") >= j).cast("int") for j in (1, 2, 3, 4)}
        )
    return log.having(df)


def levels(spark: SparkSession, sf_dir: str, *need: str) -> DataFrame:
    """``orders`` as the level table; ``level`` (position since the previous loss) only on request."""
    df = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("level_id"),
        F.col("o_custkey").alias("user_id"),
        F.year("o_orderdate").alias("session_number"),
        (F.col("o_orderstatus") != "F").cast("int").alias("win"),
        F.col("o_totalprice").alias("duration"),
        F.col("o_orderdate").alias("date_played"),
    )
    if "level" in need:
        from pathlore.operators.restructure import level_numbers

        df = level_numbers(df)
    return df


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as survey answers: item_1..item_8 (1-5 or NULL), instrument, user_id."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("row_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("instrument"),
        F.col("o_totalprice").alias("score"),
        *[
            F.when((key + i) % 17 != 0, (key * i) % 5 + 1).cast("double").alias(f"item_{i}")
            for i in range(1, 9)
        ],
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as one 2-D path per vector: traj_id, label, points array<struct<x,y>>."""
    df = table(spark, sf_dir, "embeddings")
    at = lambda i: F.element_at("embedding", i.cast("int")).cast("double")
    return df.select(
        F.col("vec_id").alias("traj_id"),
        "label",
        F.transform(
            F.sequence(F.lit(0), (F.size("embedding") / 2).cast("int") - 1),
            lambda s: F.struct(at(2 * s + 1).alias("x"), at(2 * s + 2).alias("y")),
        ).alias("points"),
    )


def path_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``paths`` in long form: traj_id, label, step, x, y."""
    return paths(spark, sf_dir).select("traj_id", "label", F.posexplode("points").alias("step", "p")).select(
        "traj_id", "label", F.col("step").cast("long").alias("step"), "p.x", "p.y"
    )


# ---- the same views for the oracle ------------------------------------------------------------------

_GHOSTS = ",\n".join(
    f"((k*{g}+event_id)%55)/2.0::DOUBLE-13.5 AS Ghost{g}_X, ((event_id*{g}+k)%61)/2.0::DOUBLE-16.5 AS Ghost{g}_Y, "
    f"CAST((event_id*{g}+k)%5 AS INTEGER) AS ghost{g}_state"
    for g in (1, 2, 3, 4)
)
_WORDS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _DIRECTION.items())

STATE_SQL = f"""ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
st0 AS (SELECT user_id AS level_id, user_id, event_id AS game_state_id, ts, event_type, value, props, k,
 CAST(row_number() OVER w - 1 AS BIGINT) AS step, count(*) OVER (PARTITION BY user_id) AS n_rows,
 date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts)/1e6 AS time_elapsed,
 CAST(event_type IN ('click','view') AS INTEGER) AS pacman_attack,
 CAST((k%28)-13.5 AS DOUBLE) AS Pacman_X, CAST((event_id%31)-16.5 AS DOUBLE) AS Pacman_Y,
 CAST(sum(CAST(floor(value) AS BIGINT)) OVER w AS BIGINT) AS score,
 CASE event_type {_WORDS} END AS direction,
 {_GHOSTS}
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
st1 AS (SELECT *, CAST(3-(3*step)//n_rows AS INTEGER) AS lives, 244-step AS pellets,
 lag(pacman_attack, 1, 0) OVER (PARTITION BY level_id ORDER BY step) AS prev_attack FROM st0),
st2 AS (SELECT *, CAST(greatest(0, 4 - sum(CASE WHEN pacman_attack=1 AND (prev_attack=0 OR k%13=0) THEN 1 ELSE 0 END)
 OVER (PARTITION BY level_id ORDER BY step)) AS INTEGER) AS powerPellets FROM st1),
states AS (SELECT *, {", ".join(f"CAST(powerPellets>={j} AS INTEGER) AS powerpelletstate_{j}" for j in (1,2,3,4))} FROM st2)"""

LEVELS_SQL = """lv0 AS (SELECT o_orderkey AS level_id, o_custkey AS user_id, year(o_orderdate) AS session_number,
 CAST(o_orderstatus<>'F' AS INTEGER) AS win, o_totalprice AS duration, o_orderdate AS date_played,
 coalesce(sum(CAST(o_orderstatus='F' AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run_no FROM orders),
levels AS (SELECT *, row_number() OVER (PARTITION BY user_id, run_no ORDER BY level_id) AS level FROM lv0)"""

SURVEY_SQL = f"""survey AS (SELECT o_orderkey AS row_id, o_custkey AS user_id, o_orderpriority AS instrument,
 o_totalprice AS score, {", ".join(
     f"CAST(CASE WHEN (o_orderkey+{i})%17<>0 THEN (o_orderkey*{i})%5+1 END AS DOUBLE) AS item_{i}" for i in range(1, 9))}
 FROM orders)"""

PATHS_SQL = """path_steps AS (SELECT vec_id AS traj_id, label, CAST(s AS BIGINT) AS step,
 CAST(embedding[2*s+1] AS DOUBLE) AS x, CAST(embedding[2*s+2] AS DOUBLE) AS y
 FROM embeddings, unnest(range(len(embedding)//2)) AS u(s))"""
