"""Cutting logs into sequences, in long form: (key..., run, run_step, columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.operators import core
from pathlore.operators.core import OrderedLog

# The named whole-level slices (start, end); negative counts from the end, -1 = to the end.
PRESETS = {
    "first_5_seconds": (0, 100),
    "last_5_seconds": (-100, -1),
    "first_50_steps": (0, 50),
    "whole_level": (0, -1),
}
PAD = -999.0


def slice_rows(log: OrderedLog, start: int = 0, end: int = -1) -> DataFrame:
    """Rows start <= step < end of each key, as one sequence per key (``run`` = 0, ``run_step`` from 0)."""
    step, df = F.col(log.step), log.df
    if start < 0 or end < -1:
        df = core.total_steps(log, {"_n": F.count(F.lit(1))})
    lo = F.lit(start) if start >= 0 else F.greatest(F.col("_n") + start, F.lit(0))
    hi = None if end == -1 else (F.lit(end) if end >= 0 else F.col("_n") + end)
    found = df.where((step >= lo) if hi is None else (step >= lo) & (step < hi))
    return found.withColumns(
        {"run": F.lit(0).cast("long"), "run_step": (step - lo).cast("long")}
    ).drop("_n")


def slice_preset(log: OrderedLog, name: str) -> DataFrame:
    if name not in PRESETS:
        raise ValueError(f"unknown slice {name!r}; known: {sorted(PRESETS)}")
    return slice_rows(log, *PRESETS[name])


def flag_intervals(log: OrderedLog, flag: Column, context: int = 0) -> DataFrame:
    """Inclusive intervals of the flag's runs: from the first flagged row to the first row after it,
    widened by ``context`` and clamped. A run active on row 0 is not opened; an open run is kept."""
    runs = core.flag_runs(log, flag)
    closed = runs.withColumn("_open", F.col("is_open"))
    return core.widen(closed, log.key, context, context, core.key_bounds(log)).drop("_open")


def slice_flag_runs(log: OrderedLog, flag: Column, context: int = 0, pill: int | None = None,
                    pill_columns: Sequence[str] = ()) -> DataFrame:
    """Rows of each flag interval; optionally only runs whose first changing column is number ``pill``."""
    spans = flag_intervals(log, flag, context)
    if pill is not None:
        first = first_changes(log, spans, pill_columns).where(F.col("first_changed") == pill)
        spans = spans.join(first.select(*log.key, "run"), [*log.key, "run"], "left_semi")
    return core.range_attach(spans.select(*log.key, "run", "start_step", "end_step"), log.df, log.key, step=log.step)


def first_changes(log: OrderedLog, runs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per interval the 1-based position of the column that first leaves its initial value, NULL if none.

    The first departure from the initial value is the first change between neighbours, so only the
    sparse change rows are joined to the intervals.
    """
    seen = core.near(log, 1, lambda w: {f"_d{i}": ~F.col(c).eqNullSafe(F.lag(c).over(w)) & F.lag(F.lit(True)).over(w)
                                        for i, c in enumerate(columns)})
    any_change = F.lit(False)
    for i in range(len(columns)):
        any_change = any_change | F.coalesce(F.col(f"_d{i}"), F.lit(False))
    changes = seen.where(any_change).select(*log.key, log.step, *[f"_d{i}" for i in range(len(columns))])
    hits = core.range_attach(runs.select(*log.key, "run", "start_step", "end_step"), changes, log.key, step=log.step)
    inside = hits.where(F.col(log.step) > F.col("start_step"))
    steps = inside.groupBy(*log.key, "run").agg(
        *[F.min(F.when(F.col(f"_d{i}"), F.col(log.step))).alias(f"_m{i}") for i in range(len(columns))]
    )
    ranked = F.filter(
        F.array(*[F.struct(F.col(f"_m{i}").alias("at"), F.lit(i + 1).alias("no")) for i in range(len(columns))]),
        lambda s: s["at"].isNotNull(),
    )
    first = steps.select(*log.key, "run", F.array_min(ranked)["no"].cast("long").alias("first_changed"))
    return runs.select(*log.key, "run").join(first, [*log.key, "run"], "left")


def slice_changes(log: OrderedLog, column: str, context: int) -> DataFrame:
    """Intervals step - context .. step + context around every change of a column."""
    changed = core.point_events(log, [column], {column: F.col(column) != F.col(f"prev_{column}")})
    numbered = core.running_steps(
        log.having(changed.select(*log.key, log.step)), {"run": ("sum", F.lit(1).cast("long"))}
    )
    spans = numbered.withColumns({"start_step": F.col(log.step), "end_step": F.col(log.step)})
    return core.widen(spans.drop(log.step), log.key, context, context, core.key_bounds(log))


def segment(df: DataFrame, start: int, end: int, step: str = "step") -> DataFrame:
    """Rows start <= step < end; an end beyond the data is simply clipped, -1 means to the end."""
    if end != -1 and start > end:
        raise ValueError("segment start lies after its end")
    rows = F.col(step) >= start
    return df.where(rows if end == -1 else rows & (F.col(step) < end))


def rebase_scores(df: DataFrame, seq: Sequence[str], column: str = "score", step: str = "run_step") -> DataFrame:
    """Subtract the sequence's first value."""
    first = df.where(F.col(step) == 0).select(*seq, F.col(column).alias("_first"))
    return df.join(first, list(seq)).withColumn(column, F.col(column) - F.col("_first")).drop("_first")


def thin(df: DataFrame, n: int, step: str = "step") -> DataFrame:
    if n < 1:
        raise ValueError("thinning factor must be at least 1")
    return df.where(F.col(step) % n == 0)


def pad_sequences(df: DataFrame, seq: Sequence[str], features: Sequence[str], step: str = "run_step",
                  value: float = PAD) -> DataFrame:
    """Long-form padding: every sequence gets rows up to the longest one, features set to ``value``.

    Only (sequence, length) pairs and the one-row maximum are needed to generate the missing rows.
    """
    lengths = df.groupBy(*seq).agg(F.count(F.lit(1)).alias("_len"))
    longest = lengths.agg(F.max("_len").alias("_max"))
    missing = (
        lengths.crossJoin(F.broadcast(longest))  # one row
        .where("_len < _max")
        .select(*seq, F.explode(F.sequence(F.col("_len"), F.col("_max") - 1)).alias(step),
                *[F.lit(value).alias(c) for c in features])
    )
    return df.select(*seq, step, *[F.col(c).cast("double").alias(c) for c in features]).unionByName(missing)


def pad_arrays(df: DataFrame, column: str, value: float = PAD) -> DataFrame:
    """The same for packed sequences: array<double> columns are extended to the longest one."""
    longest = df.agg(F.max(F.size(column)).alias("_max"))
    filler = F.array_repeat(F.lit(value), F.col("_max") - F.size(column))
    return df.crossJoin(F.broadcast(longest)).withColumn(column, F.concat(column, filler)).drop("_max")


def sort_across_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per row: the columns hold their values in ascending order."""
    ordered = df.withColumn("_s", F.array_sort(F.array(*columns)))
    return ordered.withColumns({c: F.col("_s")[i] for i, c in enumerate(columns)}).drop("_s")


def trajectories(log: OrderedLog, x: str = "Pacman_X", y: str = "Pacman_Y", time: str | None = None,
                 metadata: Sequence[str] = (), chunk: int = 1 << 16) -> DataFrame:
    """Packed paths: key, chunk, first_step, points array<struct<x,y[,t]>>, metadata values of the first row.

    A key longer than ``chunk`` rows is stored as several consecutive chunks, so no row grows without bound.
    """
    parts = [F.col(log.step).alias("s"), F.col(x).alias("x"), F.col(y).alias("y")]
    if time:
        parts.append(F.col(time).alias("t"))
    packed = log.df.groupBy(*log.key, block_chunk(log, chunk).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct(*parts))).alias("_p"),
        F.min(log.step).alias("first_step"),
        *[F.min_by(c, log.step).alias(c) for c in metadata],
    )
    names = ["x", "y"] + (["t"] if time else [])
    return packed.withColumn(
        "points", F.transform("_p", lambda p: F.struct(*[p[n].alias(n) for n in names]))
    ).drop("_p")


def block_chunk(log: OrderedLog, chunk: int) -> Column:
    return core.block_of(F.col(log.step), chunk)


def point_at(points: Column | str, i: int) -> Column:
    """Point i (0-based; negative counts from the end), NULL outside."""
    return F.try_element_at(points, F.lit(i + 1 if i >= 0 else i))


def sub_path(points: Column | str, start: int, length: int) -> Column:
    return F.slice(points, start + 1, length)


def coordinate(points: Column | str, name: str) -> Column:
    return F.transform(points, lambda p: p[name])
