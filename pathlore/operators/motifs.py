"""Direction codes and matrix profile of series in a log."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.operators import core
from pathlore.operators.core import OrderedLog

# Codes of the direction words.
DIRECTION_CODES = {"none": 0, "left": 1, "right": 2, "up": 3, "down": 4}


def direction_code(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    code = F.lit(0)
    for word, n in DIRECTION_CODES.items():
        code = F.when(c == word, n).otherwise(code)
    return F.coalesce(code, F.lit(0))


RESET = 256  # rows after which dot products are taken anew
DIGITS = 6  # decimals in which distances are compared, so that equal distances tie whatever their rounding


def _shape(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of every window, and whether it is constant."""
    w = np.lib.stride_tricks.sliding_window_view(v, m)
    return w.mean(axis=1), w.std(axis=1), w.max(axis=1) == w.min(axis=1)


class _Best:
    """Nearest window so far of a stretch of windows: distance, then the smaller start."""

    def __init__(self, n: int):
        self.d, self.at = np.full(n, np.inf), np.full(n, -1, np.int64)

    def offer(self, where, d, at) -> None:
        less = (d < self.d[where]) | ((d == self.d[where]) & np.isfinite(d) & (at < self.at[where]))
        self.d[where], self.at[where] = np.where(less, d, self.d[where]), np.where(less, at, self.at[where])


def compare_windows(x: np.ndarray, y: np.ndarray, sx: int, sy: int, m: int, zone: int, both: bool = True) -> tuple[_Best, _Best]:
    """Nearest windows of ``y`` for those of ``x`` and, if ``both``, the other way round; sx and sy are the first starts.

    A row of dot products follows from the row before: along a diagonal one product leaves and one enters. Only one row is
    held, whatever the lengths.
    """
    base = x.mean()
    x, y = x - base, y - base  # smaller products lose less
    (mx, dx, fx), (my, dy, fy) = _shape(x, m), _shape(y, m)
    n, k = len(mx), len(my)
    starts = sy + np.arange(k)
    first = np.lib.stride_tricks.sliding_window_view(x, m) @ y[:m]
    dots = np.lib.stride_tricks.sliding_window_view(y, m) @ x[:m]
    mine, theirs = _Best(n), _Best(k)
    spread_y = np.where(fy, 1.0, m * dy)
    for i in range(n):
        if i % RESET == 0 and i:
            dots = np.lib.stride_tricks.sliding_window_view(y, m) @ x[i : i + m]  # rounding does not pile up
        elif i:
            dots[1:] = dots[:-1] - x[i - 1] * y[: k - 1] + x[i + m - 1] * y[m : m + k - 1]
            dots[0] = first[i]
        if fx[i]:
            d = np.where(fy, 0.0, np.sqrt(m))
        else:
            same = (dots - m * mx[i] * my) / (dx[i] * spread_y)
            d = np.where(fy, np.sqrt(m), np.sqrt(np.maximum(2 * m * (1 - same), 0.0)))
        d = np.round(d, DIGITS)
        d[np.abs(starts - (sx + i)) <= zone] = np.inf
        at = int(d.argmin())
        if np.isfinite(d[at]):  # a row is met once
            mine.d[i], mine.at[i] = d[at], starts[at]
        if both:
            theirs.offer(slice(None), d, np.full(k, sx + i))
    return mine, theirs


def matrix_profile(log: OrderedLog, column: str, m: int, block: int = 2048) -> DataFrame:
    """Per window start: distance ``d`` to and start ``neighbour`` of the nearest z-normalised window of the
    same key farther than ceil(m / 4) steps away.

    Windows are cut into blocks of consecutive starts (with m - 1 rows of overlap). A task compares two blocks along their
    diagonals and sends on one candidate per window; the best candidate is a combine-before-shuffle minimum. Distances
    count to ``DIGITS`` decimals, and of equal ones the smaller start is the neighbour. Two constant windows have distance 0,
    a constant and a varying one sqrt(m).
    """
    key, step = list(log.key), F.col(log.step)
    zone = ceil(m / 4)
    total = core.total_steps(log, {"_len": F.count(F.lit(1))}).where(F.col("_len") >= m)
    own, first = core.block_of(step, block), core.block_of(F.greatest(step - (m - 1), F.lit(0)), block)
    last_block = core.block_of(F.col("_len") - m, block)
    rows = total.select(
        *key, step.alias("step"), F.col(column).cast("double").alias("v"), last_block.alias("_nb"),
        F.explode(F.sequence(first, own)).alias("b"),
    ).where("b <= _nb")
    copies = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb")))).select(
        *key, F.least("b", "o").alias("lb"), F.greatest("b", "o").alias("rb"), "b", "step", "v"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in core.whole_groups(batches, [*key, "lb", "rb"]):
            lb, rb, b, at, v = (rows.column(c).to_numpy() for c in ("lb", "rb", "b", "step", "v"))
            out = []
            for i, j in zip(first, np.append(first[1:], len(at))):
                # Sorted by block and step, so the left block is the head of the group and the right one its tail.
                parts = [slice(i + p, i + q) for p, q in (np.searchsorted(b[i:j], (n, n + 1)) for n in (lb[i], rb[i]))]
                x, y = (v[p][: block + m - 1] for p in parts)
                if len(x) < m or len(y) < m:
                    continue
                starts = [int(at[p.start]) for p in parts]
                best = compare_windows(x, y, *starts, m, zone, both=lb[i] != rb[i])
                out += [(i, s + np.arange(len(f.d)), f.at, f.d) for s, f in list(zip(starts, best))[: 1 if lb[i] == rb[i] else 2]]
            if not out:
                continue
            at, near, d = (np.concatenate([o[n] for o in out]) for n in (1, 2, 3))
            group = np.repeat([o[0] for o in out], [len(o[3]) for o in out])
            found = np.isfinite(d)
            ids = pa.array(group[found])
            yield pa.RecordBatch.from_arrays(
                [*[rows.column(k).combine_chunks().take(ids) for k in key], pa.array(at[found]), pa.array(near[found]), pa.array(d[found])], [*key, "start", "neighbour", "d"]
            )

    kinds = ", ".join(f"{k} {log.df.schema[k].dataType.simpleString()}" for k in key)
    copies = core.spread(copies, *key, "lb", "rb").sortWithinPartitions(*key, "lb", "rb", "b", "step")
    part = copies.mapInArrow(compare, f"{kinds}, start long, neighbour long, d double")
    return part.groupBy(*key, "start").agg(F.min(F.struct("d", "neighbour")).alias("b")).select(*key, "start", "b.neighbour", "b.d")


def motif_pair(profile: DataFrame, key: list[str]) -> DataFrame:
    """The two windows with the smallest profile values per key (rank 1 and 2)."""
    w = Window.partitionBy(*key).orderBy("d", "start")
    return profile.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
