"""Survey scales, per-player statistics, ranks, correlations and descriptive tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.functions.expressions import row_sum
from pathlore.operators import core

# The instruments and their items.
FLOW_ITEMS = [f"fss_{i}" for i in range(1, 9)]
SCALES = {
    "BIS": [f"bis_{i}" for i in range(1, 8)],
    "REW": [f"rew_{i}" for i in range(1, 6)],
    "DRIVE": [f"drive_{i}" for i in range(1, 5)],
    "FUN": [f"fun_{i}" for i in range(1, 5)],
}
REPEATED = ("flow", "sam")
FIRST_PARTICIPANT = 60


def flow_scores(survey: DataFrame, items: Sequence[str] = FLOW_ITEMS, instrument: str = "flow",
                column: str = "redcap_repeat_instrument", mean: bool = False) -> DataFrame:
    """``FLOW`` = sum of the items (missing items count 0) on the rows of one instrument; ``mean`` divides by
    the item count and is NULL with a missing item."""
    rows = survey.where(F.col(column) == instrument)
    if mean:
        total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
        return rows.withColumn("FLOW", total / len(items))
    return rows.withColumn("FLOW", row_sum(items))


def scales(survey: DataFrame, groups: Mapping[str, Sequence[str]] = SCALES, *, user: str = "record_id",
           column: str = "redcap_repeat_instrument", consent: str | None = "consent_timestamp",
           repeated: Sequence[str] = REPEATED, above: int = FIRST_PARTICIPANT, keep: Sequence[str] = ()) -> DataFrame:
    """Scale sums of the baseline rows (instrument missing or not a repeated one) of consenting participants."""
    rows = survey.where((F.col(column).isNull() | ~F.col(column).isin(*repeated)) & (F.col(user) > above))
    if consent:
        rows = rows.where(F.col(consent).isNotNull())
    return rows.select(F.col(user).alias("user_id"), *keep, *[row_sum(c).alias(n) for n, c in groups.items()])


def join_flow_games(flow: DataFrame, games: DataFrame, on: Sequence[str] = ("user_id", "total_levels_played")) -> DataFrame:
    """Survey rows with the game they belong to; incomplete rows are dropped."""
    return flow.join(games, list(on)).na.drop()


def score_transforms(df: DataFrame, score: str = "max_score") -> DataFrame:
    """log(score), inv(score) = global maximum - score + 1, and its log."""
    top = core.attach_totals(df, [], {"_top": F.max(score)})
    inverse = F.col("_top") - F.col(score) + 1
    return top.withColumns(
        {f"log({score})": F.log(score), f"inv({score})": inverse, f"log(inv({score}))": F.log(inverse)}
    ).drop("_top")


def z_score_within(df: DataFrame, key: Sequence[str], column: str, out: str) -> DataFrame:
    """(x - mean) / sample deviation inside each group; NULL where the deviation is missing or 0."""
    stats = core.attach_totals(df, list(key), {"_m": F.avg(column), "_s": F.stddev_samp(column)})
    z = F.when(F.col("_s") > 0, (F.col(column) - F.col("_m")) / F.col("_s"))
    return stats.withColumn(out, z).drop("_m", "_s")


def running_total(df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, out: str) -> DataFrame:
    log = core.order_log(df, list(key), list(order), step="_pos")
    return core.running_steps(log, {out: ("sum", F.col(column))}).drop("_pos")


def _line(y: str, x: str) -> dict:
    return {"slope": F.regr_slope(y, x), "intercept": F.coalesce(F.regr_intercept(y, x), F.avg(y)), "r2": F.regr_r2(y, x)}


def fit_residual(df: DataFrame, key: Sequence[str], y: str, x: str, out: str = "score_deviation") -> DataFrame:
    """y minus the group's least-squares line on x; with a single x the line is the mean."""
    fit = _line(y, x)
    line = core.attach_totals(df, list(key), {"_a": fit["slope"], "_b": fit["intercept"]})
    return line.withColumn(out, F.col(y) - (F.coalesce("_a", F.lit(0.0)) * F.col(x) + F.col("_b"))).drop("_a", "_b")


def group_fits(df: DataFrame, key: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope (0 where undefined), intercept and r2 per group."""
    fit = _line(y, x)
    return df.groupBy(*key).agg(
        F.coalesce(fit["slope"], F.lit(0.0)).alias("slope"), fit["intercept"].alias("intercept"), fit["r2"].alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def flow_table(flow: DataFrame, games: DataFrame) -> DataFrame:
    """Flow answers with performance measures, one row per answered game."""
    df = join_flow_games(
        flow.select("user_id", "total_levels_played", "FLOW"),
        games.select("user_id", "total_levels_played", "total_games_played", "max_score"),
    ).drop("total_levels_played")
    df = score_transforms(df).withColumn("log(total_games_played)", F.log("total_games_played"))
    df = z_score_within(df, ["user_id"], "FLOW", "flow_z_score")
    df = running_total(df, ["user_id"], ["total_games_played"], "max_score", "cum_score").withColumn("log(cum_score)", F.log("cum_score"))
    df = fit_residual(df, ["user_id"], "log(inv(max_score))", "total_games_played")
    return df.select(
        "user_id", "FLOW", "total_games_played", "max_score", "log(max_score)", "inv(max_score)", "log(inv(max_score))",
        "log(total_games_played)", "flow_z_score", "cum_score", "log(cum_score)", "score_deviation",
    )


def user_profile(levels: DataFrame) -> DataFrame:
    n, wins = F.count("level_id"), F.sum("win")
    return levels.groupBy("user_id").agg(
        F.avg("duration").alias("avg_game_duration"), F.max("level").alias("max_level"), n.alias("games_played"),
        F.max("level_in_session").alias("longest_session"), F.max("session_number").alias("amount_sessions"),
        wins.alias("wins"), (n - wins).alias("losses"), (wins / n).alias("winrate"),
    )


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: (attribute, q, value).

    Positions come from the block-wise ordering, so no task holds a whole column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null and not isnan(value)")
    log = core.order_log(long, ["attribute"], ["value"])
    sized = core.total_steps(log, {"_n": F.count(F.lit(1))})
    picked = sized.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in points]))).withColumn(
        "_h", (F.col("_n") - 1) * F.col("q")
    ).where((F.col("step") == F.floor("_h")) | (F.col("step") == F.ceil("_h")))
    lower, upper = F.min("value"), F.max("value")
    return picked.groupBy("attribute", "q").agg(
        (lower + (upper - lower) * (F.max("_h") - F.floor(F.max("_h")))).alias("value")
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, long form (attribute, statistic, value)."""
    basic = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    one = df.agg(*[
        F.struct(*[fn(F.col(c).cast("double")).cast("double").alias(n) for n, fn in basic.items()]).alias(c) for c in columns
    ])
    cells = F.array(*[
        F.struct(F.lit(c).alias("attribute"), F.lit(n).alias("statistic"), F.col(f"`{c}`.{n}").alias("value"))
        for c in columns for n in basic
    ])
    names = {0.25: "25%", 0.5: "50%", 0.75: "75%"}
    label = F.when(F.col("q") == 0.25, names[0.25]).when(F.col("q") == 0.5, names[0.5]).otherwise(names[0.75])
    quart = quantiles(df, columns, list(names)).select("attribute", label.alias("statistic"), "value")
    return one.select(F.explode(cells).alias("s")).select("s.*").unionByName(quart)


def histogram(df: DataFrame, column: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width counts (bin, lo, n) between the column's bounds or the given ones; the last bin is closed."""
    value = F.col(column).cast("double")
    bounded = core.attach_totals(
        df.where(value.isNotNull()).select(value.alias("_v")), [], {"_lo": F.min("_v"), "_hi": F.max("_v")}
    )
    low = F.col("_lo") if lo is None else F.lit(float(lo))
    high = F.col("_hi") if hi is None else F.lit(float(hi))
    width = (high - low) / bins
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("_v") - low, width)), F.lit(bins - 1)), F.lit(0)).cast("long")
    inside = bounded.where(F.col("_v").between(low, high))
    return inside.select(at.alias("bin"), (low + at * width).alias("lo")).groupBy("bin").agg(F.min("lo").alias("lo"), F.count(F.lit(1)).alias("n"))


def nonzero_distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts of the values other than 0."""
    return counts(df.where(F.col(column) != 0), column)


def survival_counts(instances: DataFrame, by: Sequence[str] = ("name",)) -> DataFrame:
    return instances.where("died is not null").groupBy(*by).agg(
        F.count(F.when(F.col("died"), 1)).alias("died"), F.count(F.when(~F.col("died"), 1)).alias("survived")
    )


def user_overall(lost_levels: DataFrame, scores: DataFrame, user_scales: DataFrame) -> DataFrame:
    """Number of games and best score per player, with the player's scales.

    Scores without a lost level (and the reverse) take part in the outer join, as NULLs.
    """
    played = core.order_log(lost_levels, ["user_id"], ["level_id"], step="_n").df
    trials = played.withColumn("total_whole_games_played", F.col("_n") + 1).drop("_n")
    joined = trials.join(scores, "level_id", "full")
    per_user = joined.groupBy("user_id").agg(
        F.max("total_whole_games_played").alias("total_whole_games_played"), F.max("score").alias("score")
    )
    return per_user.join(user_scales, "user_id")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Rank with ties averaged. Equal values are combined first, then ordered block-wise."""
    values = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    log = core.order_log(values.withColumn("_one", F.lit(0)), ["_one"], [column], step="_pos")
    below = core.running_steps(log, {"_below": ("sum", F.col("_n"))}, exclusive=True)
    ranks = below.select(F.col(column).alias("_value"), (F.coalesce("_below", F.lit(0)) + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, df[column] == ranks["_value"], "left").drop("_value")


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair of columns over complete rows: (a, b, rho), a before b."""
    ranked = df.select(*columns).na.drop()
    for c in columns:
        ranked = average_ranks(ranked, c, f"_r_{c}")
    pairs = list(combinations(columns, 2))
    one = ranked.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("rho")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(cells).alias("p")).select("p.*")


def correlation_by(df: DataFrame, key: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*key).agg(F.corr(x, y).alias("r"))


def learning_curve(df: DataFrame, trial: str, score: str, upto: int = 10) -> DataFrame:
    return df.where(F.col(trial) <= upto).groupBy(trial).agg(F.avg(score).alias("avg_score"))
