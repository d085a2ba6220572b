"""Which pellets are left at each state: an ordered fold over a provably bounded set of rows per level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathlore.operators import core
from pathlore.operators.core import OrderedLog

REACH = 0.5  # a pellet this near is eaten
FULL_COUNT = 244  # counter before the first pellet
CELLS = 1 << 18  # (level, point) distances that are taken at once
MAX_POINTS = 4096  # points that go to the driver and whose distances are all taken
# The power pill points.
POWER_PILLS = ((12.5, -9.5), (-12.5, -9.5), (-12.5, 10.5), (12.5, 10.5))


def _dimension(pellets: DataFrame, x: str, y: str) -> np.ndarray:
    """Pellet points of the maze in reading order: top row first, left to right. More than ``MAX_POINTS`` are no maze's."""
    rows = [(r[0], r[1]) for r in pellets.select(F.col(x).cast("double"), F.col(y).cast("double")).distinct().limit(MAX_POINTS + 1).collect()]
    if len(rows) > MAX_POINTS:
        raise ValueError(f"more than {MAX_POINTS} pellet points; the maze has 55 x 61 at most")
    return np.array(sorted(rows, key=lambda p: (-p[1], p[0])), dtype=float).reshape(-1, 2)


def counted_rows(log: OrderedLog, x: str, y: str, counter: str) -> DataFrame:
    """(key..., step, x, y, counter, drop) of all rows; ``drop``: the counter fell by one."""
    return core.near(log, 1, lambda w: {"_drop": (F.col(counter) - F.lag(counter).over(w)) == -1}).select(
        *log.key, F.col(log.step).alias("step"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(counter).alias("counter"),
        F.coalesce("_drop", F.lit(False)).alias("drop"),
    )


def relevant_rows(log: OrderedLog, points: np.ndarray, x: str, y: str, counter: str) -> DataFrame:
    """The rows that can change the set: first row, contacts, and counter drops by one - all bounded per level.

    A row within reach of a remaining pellet p always eats p or another pellet at most 2 x REACH from p. With
    m such neighbours p is gone after m + 1 contact rows, so its first m + 1 contacts suffice. Every counter
    drop eats one pellet while any is left, so the first D drops suffice for D pellets.
    """
    rows = counted_rows(log, x, y, counter)
    spark = log.df.sparkSession
    gaps = np.hypot(*(points[:, None, :] - points[None, :, :]).transpose(2, 0, 1))
    contacts_kept = int((gaps <= 2 * REACH).sum(axis=1).max()) if len(points) else 0
    dims = spark.createDataFrame(
        pd.DataFrame({"pellet": np.arange(len(points)), "px": points[:, 0], "py": points[:, 1]}),
        "pellet long, px double, py double",
    )
    cells = dims.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("px") - REACH), F.floor(F.col("px") + REACH)))).withColumn(
        "_by", F.explode(F.sequence(F.floor(F.col("py") - REACH), F.floor(F.col("py") + REACH)))
    )
    keep = [*log.key, "step", "x", "y", "counter", "drop"]
    touching = (
        rows.where("step > 0")
        .withColumns({"_bx": F.floor("x"), "_by": F.floor("y")})
        .join(F.broadcast(cells), ["_bx", "_by"])  # at most 4 rows per pellet of the maze
        .where(F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")) <= REACH)
    )
    by_pellet = Window.partitionBy(*log.key, "pellet").orderBy("step")
    by_level = Window.partitionBy(*log.key).orderBy("step")
    contacts = touching.withColumn("_r", F.row_number().over(by_pellet)).where(F.col("_r") <= contacts_kept).select(*keep)
    drops = rows.where("drop and step > 0").withColumn("_r", F.row_number().over(by_level)).where(
        F.col("_r") <= len(points)
    ).select(*keep)
    return rows.where("step = 0").unionByName(contacts).unionByName(drops).dropDuplicates([*log.key, "step"])


def fold_levels(points: np.ndarray, first: np.ndarray, end: np.ndarray, step: np.ndarray, x: np.ndarray, y: np.ndarray,
                gone_before: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eaten (row, pellet) of levels whose rows go from ``first`` to ``end`` in order; their n-th rows are taken together."""
    order = np.argsort(first - end, kind="stable")  # longest first, so that those still going on are always the head
    first, length = first[order], (end - first)[order]
    gone = np.zeros((len(first), len(points)), bool)
    left = np.full(len(first), len(points))
    rows, pellets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in range(int(length[0]) if len(length) and len(points) else 0):
        going = int(np.searchsorted(-length, -n))  # levels of more than n rows
        if not left[:going].any():
            break
        r = first[:going] + n
        d = (points[:, 0] - x[r][:, None]) ** 2 + (points[:, 1] - y[r][:, None]) ** 2  # squares of half units are exact, so ties are ties
        start = np.flatnonzero(step[r] == 0)
        many = gone_before[r[start]]
        for i, m in zip(start[many > 0], many[many > 0]):
            p = np.argsort(d[i], kind="stable")[:m]
            gone[i, p] = True
            left[i] = len(points) - len(p)
            rows.append(np.full(len(p), r[i]))
            pellets.append(p)
        np.copyto(d, np.inf, where=gone[:going])
        nearest = d.argmin(axis=1)
        eats = (left[:going] > 0) & (step[r] != 0) & ((d[np.arange(going), nearest] <= REACH**2) | drop[r])
        at = np.flatnonzero(eats)
        gone[at, nearest[at]] = True
        left[at] -= 1
        rows.append(r[at])
        pellets.append(nearest[at])
    return np.concatenate(rows), np.concatenate(pellets)


def eaten_pellets(log: OrderedLog, pellets: DataFrame, px: str = "px", py: str = "py", *, x: str = "Pacman_X",
                  y: str = "Pacman_Y", counter: str = "pellets", full: int = FULL_COUNT) -> DataFrame:
    """Eaten events (key..., step, pellet, px, py).

    First row: the ``full`` - counter nearest pellets are gone. Later rows: the nearest remaining pellet is
    eaten when within reach or when the counter fell by exactly one.
    """
    points = _dimension(pellets, px, py)
    key = list(log.key)

    def fold(rows: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        cols = [rows.column(k).combine_chunks() for k in key]
        end = np.append(first[1:], rows.num_rows)
        step, x_, y_, count, drop = (rows.column(c).to_numpy() for c in ("step", "x", "y", "counter", "drop"))
        begins = step == 0
        if np.isnan(count[begins]).any():
            raise ValueError(f"{counter} is NULL or NaN in the first row of a level")
        before = np.zeros(len(step), np.int64)
        before[begins] = np.maximum(0, full - np.trunc(count[begins]).astype(np.int64))
        held = max(1, CELLS // max(1, len(points)))
        for k in range(0, len(first), held):
            at, p = fold_levels(points, first[k : k + held], end[k : k + held], step, x_, y_, before, drop)
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(at)) for c in cols], pa.array(step[at]), pa.array(p), pa.array(points[p, 0]), pa.array(points[p, 1])],
                [*key, "step", "pellet", "px", "py"],
            )

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first in core.whole_groups(batches, key):
            yield from fold(rows, first)

    # Rows of a level that fits a task are read as they are; only larger ones are worth leaving rows out first.
    rows = counted_rows(log, x, y, counter) if log.block is None else relevant_rows(log, points, x, y, counter)
    rows = rows.select(*key, F.col("step").cast("long"), *[F.col(c).cast("double") for c in ("x", "y", "counter")], "drop")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    return core.spread(rows, *key).sortWithinPartitions(*key, "step").mapInArrow(levels, f"{kinds}, step long, pellet long, px double, py double")


def pellet_availability(log: OrderedLog, pellets: DataFrame, eaten: DataFrame, px: str = "px", py: str = "py") -> DataFrame:
    """``remaining`` pellets per state (key..., step, remaining), from the events alone."""
    total = pellets.select(px, py).distinct().agg(F.count(F.lit(1)).alias("_all"))
    hits = eaten.groupBy(*log.key, "step").agg(F.count(F.lit(1)).alias("_hits"))
    rows = log.df.select(*log.key, F.col(log.step).alias("step")).join(hits, [*log.key, "step"], "left")
    so_far = core.running_steps(
        OrderedLog(rows, log.key, "step", log.block), {"_gone": ("sum", F.coalesce("_hits", F.lit(0)))}
    )
    return so_far.crossJoin(F.broadcast(total)).select(  # one row
        *log.key, "step", (F.col("_all") - F.col("_gone")).alias("remaining")
    )


def available_points(states: DataFrame, pellets: DataFrame, eaten: DataFrame, key: list[str], step: str = "step",
                     px: str = "px", py: str = "py") -> DataFrame:
    """The remaining points of the requested states, one row per point. Grows by the maze's pellet count."""
    points = F.broadcast(pellets.select(px, py).distinct())  # bounded by the maze
    asked = states.select(*key, step).crossJoin(points)
    gone = eaten.select(*key, px, py, F.col("step").alias("_gone_at"))
    joined = asked.join(gone, [*key, px, py], "left")
    return joined.where(F.col("_gone_at").isNull() | (F.col(step) < F.col("_gone_at"))).drop("_gone_at")


def remaining_pills(log: OrderedLog, pellets: DataFrame, eaten: DataFrame, px: str = "px", py: str = "py") -> DataFrame:
    """``pill_1`` .. ``pill_4``: whether each power pill point is a pellet of the maze and not yet eaten."""
    at = lambda p: (F.col(px) == p[0]) & (F.col(py) == p[1])
    known = pellets.agg(*[F.max(at(p)).alias(f"_is{i}") for i, p in enumerate(POWER_PILLS, 1)])
    gone = eaten.groupBy(*log.key).agg(*[F.min(F.when(at(p), F.col("step"))).alias(f"_e{i}") for i, p in enumerate(POWER_PILLS, 1)])
    rows = log.df.select(*log.key, F.col(log.step).alias("step"))
    joined = rows.join(gone, list(log.key), "left").crossJoin(F.broadcast(known))  # one row
    return joined.select(
        *log.key, "step",
        *[(F.col(f"_is{i}") & (F.col(f"_e{i}").isNull() | (F.col("step") < F.col(f"_e{i}")))).alias(f"pill_{i}")
          for i in range(1, 5)],
    )
