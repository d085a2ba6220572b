"""Level and game tables, counters, and repair of known logging faults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.functions.expressions import ENTITIES, inside_house_sql
from pathlore.operators import core
from pathlore.operators.core import OrderedLog

FULL_PILLS = 4  # power pills at level start


def max_score(levels: DataFrame, states: DataFrame) -> DataFrame:
    """Level table with the highest score seen in its states (NULL without states)."""
    best = states.groupBy("level_id").agg(F.max("score").alias("max_score"))
    return levels.join(best, "level_id", "left")


def level_numbers(levels: DataFrame) -> DataFrame:
    """``level`` = position among the user's levels since the previous loss, from 1."""
    log = core.order_log(levels, ["user_id"], ["level_id"], step="_pos")
    begun = core.running_steps(
        log, {"_from": ("max", F.when(F.col("win") == 0, F.col("_pos") + 1))}, exclusive=True
    )
    level = F.col("_pos") - F.coalesce(F.col("_from"), F.lit(0)) + 1
    return begun.withColumn("level", level.cast("long")).drop("_pos", "_from")


def assign_games(levels: DataFrame) -> DataFrame:
    """Level table with ``game_id``: the level that ends its game with a loss.

    A game reaches back from the loss over at most the losing row's ``level`` rows of the same user and
    never past an earlier loss. Levels the user never lost afterwards get NULL.
    """
    log = core.order_log(levels, ["user_id"], ["level_id"], step="_pos")
    loss = F.when(F.col("win") == 0, F.struct("_pos", "level_id", "level"))
    ahead = core.running_steps(log, {"_loss": ("min", loss)}, reverse=True)
    back = F.col("_loss._pos") - F.col("_pos")
    return ahead.withColumn("game_id", F.when(back < F.col("_loss.level"), F.col("_loss.level_id"))).drop("_loss", "_pos")


def assemble_games(levels: DataFrame) -> DataFrame:
    """One row per game: summed duration, first date, sorted level ids (at most ``max_level`` of them)."""
    return (
        assign_games(levels)
        .where("game_id is not null")
        .groupBy("game_id")
        .agg(
            F.max("user_id").alias("user_id"),
            F.max("level").alias("max_level"),
            F.sum("duration").alias("game_duration"),
            F.min_by("date_played", "level_id").alias("date_played"),
            F.array_sort(F.collect_list("level_id")).alias("level_ids"),
        )
    )


def game_counters(levels: DataFrame) -> DataFrame:
    """Losses only: running number of the game per user and per (user, session)."""
    lost = levels.where("win = 0")
    total = core.order_log(lost, ["user_id"], ["level_id"], step="_n").df
    session = core.order_log(total, ["user_id", "session_number"], ["level_id"], step="_m").df
    return session.withColumns(
        {"total_games_played": F.col("_n") + 1, "game_in_session": F.col("_m") + 1}
    ).drop("_n", "_m")


def rebase_first(log: OrderedLog, column: str, out: str | None = None) -> DataFrame:
    """Subtract the key's first non-null value."""
    first = F.min_by(column, F.when(F.col(column).isNotNull(), F.col(log.step)))
    return (
        core.total_steps(log, {"_first": first})
        .withColumn(out or column, F.col(column) - F.col("_first"))
        .drop("_first")
    )


def close_lost_levels(log: OrderedLog, levels: DataFrame) -> DataFrame:
    """The last state of a lost level gets ``lives = 0``."""
    seen = core.near(log, 1, lambda w: {"_next": F.lead(log.step).over(w)})
    lost = levels.where("win = 0").select("level_id").distinct().withColumn("_lost", F.lit(True))
    ends = F.col("_next").isNull() & F.coalesce("_lost", F.lit(False))
    return (
        seen.join(lost, "level_id", "left")
        .withColumn("lives", F.when(ends, F.lit(0)).otherwise(F.col("lives")).cast("int"))
        .drop("_next", "_lost")
    )


def repair_attack_prefix(df: DataFrame, n: int = 350, step: str = "step") -> DataFrame:
    """No attack can be on in the first rows while all power pills are left."""
    fault = (F.col(step) < n) & (F.col("powerPellets") == FULL_PILLS) & (F.col("pacman_attack") == 1)
    return df.withColumn("pacman_attack", F.when(fault, 0).otherwise(F.col("pacman_attack")).cast("int"))


def repair_house_prefix(df: DataFrame, n: int = 350, step: str = "step", entities: Sequence[int] = ENTITIES) -> DataFrame:
    """In the same rows an entity inside the house cannot be 'eaten' (4); it is at home (0)."""
    early = f"{step} < {n} AND powerPellets = {FULL_PILLS}"
    return df.withColumns(
        {
            f"ghost{g}_state": F.expr(
                f"int(CASE WHEN {early} AND ghost{g}_state = 4 AND {inside_house_sql(g)} THEN 0 ELSE ghost{g}_state END)"
            )
            for g in entities
        }
    )


def repair_prefix(df: DataFrame, n: int = 350, step: str = "step") -> DataFrame:
    return repair_attack_prefix(repair_house_prefix(df, n, step), n, step)
