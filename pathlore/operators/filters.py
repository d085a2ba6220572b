"""Row and key selection: bans, orphans, key lookups, feature sets, group-size filters, seeded samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.expressions import mixed_uniform
from pathlore.operators.core import null_safe

# Named feature sets.
_DISTANCES = ["Ghost1_distance", "Ghost2_distance", "Ghost3_distance", "Ghost4_distance"]
FEATURE_SETS: dict[str, list[str]] = {
    "Pacman": ["Pacman_X", "Pacman_Y"],
    "Pacman_Ghosts": ["Pacman_X", "Pacman_Y"] + [f"Ghost{g}_{a}" for g in (1, 2, 3, 4) for a in "XY"],
    "Ghost_Distances": _DISTANCES,
    "Experimental": _DISTANCES + ["score", "lives"],
    "Experimental2": _DISTANCES + ["score"],
}
BANNED_USERS = (42,)
BANNED_LEVELS = (419,)


def drop_banned(
    levels: DataFrame,
    states: DataFrame,
    users: Sequence[int] = BANNED_USERS,
    level_ids: Sequence[int] = BANNED_LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the banned users' levels and the listed levels."""
    banned = F.col("user_id").isin(*users) | F.col("level_id").isin(*level_ids)
    hit = F.coalesce(banned, F.lit(False))
    return levels.where(~hit), states.join(levels.where(hit).select("level_id"), "level_id", "left_anti")


def orphans(states: DataFrame, levels: DataFrame, key: str = "level_id") -> DataFrame:
    """Keys of the log that the level table does not know."""
    return states.select(key).distinct().join(levels.select(key), key, "left_anti")


def states_for_levels(states: DataFrame, level_ids: Sequence[int], key: str = "level_id") -> DataFrame:
    if not level_ids:
        raise ValueError("at least one level id is needed")
    return states.where(F.col(key).isin(*level_ids))


def states_for_users(states: DataFrame, levels: DataFrame, users: Sequence[int] | Column) -> DataFrame:
    """States of the levels that belong to the users (ids, or a condition on the level table)."""
    chosen = users if isinstance(users, Column) else F.col("user_id").isin(*users)
    return states.join(levels.where(chosen).select("level_id"), "level_id", "left_semi")


def states_in_range(states: DataFrame, lo: int, hi: int, by: str = "game_state_id", key: str = "level_id") -> DataFrame:
    """States with lo <= id <= hi; the range must lie inside one level."""
    found = states.where(F.col(by).between(lo, hi))
    first, last = found.agg(F.min(key), F.max(key)).first()
    if first is None or first != last:
        raise ValueError(f"states {lo}..{hi} do not lie in exactly one level")
    return found


def states_in_ranges(states: DataFrame, ranges: DataFrame, by: str = "game_state_id", key: str = "level_id") -> DataFrame:
    """The same for one (key, lo, hi) range per level; ranges carry their level, so they cannot cross levels."""
    return states.join(ranges, key).where(F.col(by).between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def collect_metadata(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Distinct values per group and metadata column, long form: key, attribute, value, position, n_values.

    ``n_values = 1`` marks what would be a scalar. Values are never gathered into one row.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    long = df.select(*key, F.explode(pairs).alias("p")).select(*key, "p.attribute", "p.value").distinct()
    counts = long.groupBy(*key, "attribute").agg(F.count(F.lit(1)).alias("n_values"))
    return long.join(counts, [*key, "attribute"])


def select_features(df: DataFrame, name: str, keep: Sequence[str] = (), registry: Mapping[str, list[str]] = FEATURE_SETS) -> DataFrame:
    if name not in registry:
        raise ValueError(f"unknown feature set {name!r}; known: {sorted(registry)}")
    return df.select(*keep, *registry[name])


def join_states_levels(states: DataFrame, levels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each state with its level's row (inner). The level side is broadcast by Spark when it is small enough."""
    return states.join(levels.select("level_id", *columns), "level_id")


def within(df: DataFrame, column: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Outlier filter: lo < value < hi."""
    out = df
    if lo is not None:
        out = out.where(F.col(column) > lo)
    if hi is not None:
        out = out.where(F.col(column) < hi)
    return out


def keep_groups(df: DataFrame, key: Sequence[str], condition: Column) -> DataFrame:
    """Rows of the groups whose aggregate satisfies ``condition`` (for example ``F.max('n') > 3``)."""
    good = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(condition.alias("_ok")).where("_ok")
    return df.join(good, null_safe(df, good, [(k, f"_k_{k}") for k in key]), "left_semi")


def keep_max_above(df: DataFrame, key: Sequence[str], column: str, k: float) -> DataFrame:
    return keep_groups(df, key, F.max(column) > k)


def keep_group_size(df: DataFrame, key: Sequence[str], at_least: int) -> DataFrame:
    return keep_groups(df, key, F.count(F.lit(1)) >= at_least)


def sample_per_group(df: DataFrame, key: Sequence[str], ident: str, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` rows per group, chosen by a seeded hash of the id: stable on any partitioning.

    Rank-limit windows are cut to n rows per group before the shuffle.
    """
    w = Window.partitionBy(*key).orderBy(mixed_uniform([ident], seed), ident)
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """First n rows under a total order."""
    return df.orderBy(*order).limit(n)
