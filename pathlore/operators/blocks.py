"""Blocks of near items with bounding boxes, so that whole blocks are ruled out before any two items meet.

Every item gets *features*: numbers that differ between two items by no more than their distance. Distances to a few
reference items are such numbers wherever the triangle rule holds (a pivot table); measures without that rule bring their
own. Items are sorted by the nearest of some centres in the feature space and by how far they are from it, and cut into
blocks of up to ``rows`` items. The gap between the boxes of two blocks is a lower bound for all their pairs: blocks whose
gap exceeds the reach never meet, and inside a meeting the features rule out single pairs before a kernel runs.

A block is stored as one row, packed. Where a block meets few others, boxes meet by an equi-join on buckets of one feature and
the blocks that meet are copied to their task. Where most blocks meet, copies would fill the disks with the square of the items:
then a task reads some blocks of either side from the stored table, and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.operators import core

SAMPLE = 256  # items of least hash from which reference items and centres are chosen; steers the work, not the result
PIVOTS = 16
CENTRES = 64
LEAST_ROWS, MOST_ROWS, WIDE_ROWS = 64, 512, 2048  # items of a block; a power of two between these, up to the last for short items
SHORT = 128  # numbers of an item, on average, with which blocks may be as large as the last of these
SORTED_ROWS = 1 << 16  # items that one task sorts
FEW_BLOCKS = 64  # up to so many boxes need no buckets
PACKED_NUMBERS = 1 << 20  # numbers of a packed block, on average, at most
SIDE_BYTES = 32 << 20  # packed blocks that a task reads of either side
TASKS_PER_CORE = 16  # of a comparison of all blocks; they differ in size
FEW_KEPT = 8  # features look at single pairs once they leave less than one in so many
COPIES = 4  # other blocks that a block may meet, on average, to be copied for each of them
BUCKETS = 4096  # most buckets over the range of a feature

Features = Callable[[list], np.ndarray]


def farthest_first(n: int, wanted: int, distances: Callable[[int], np.ndarray]) -> list[int]:
    """Up to ``wanted`` of n items, each the farthest from those before it; ``distances(i)`` are those of item i to all."""
    if not n:
        return []
    chosen, near = [0], distances(0)
    while len(chosen) < min(wanted, n):
        at = int(np.argmax(near))
        if not near[at] > 0:
            break
        chosen.append(at)
        near = np.minimum(near, distances(at))
    return chosen


def sample_of(items: DataFrame) -> list:
    """Plain values of the ``SAMPLE`` items of least hash."""
    return [r["v"] for r in items.select("id", "v").orderBy(F.xxhash64("id", F.lit(11)), "id").limit(SAMPLE).collect()]


def pivot_features(sample: list, kernel, own: Features | None, metric: bool) -> Features:
    """The feature function of a measure: its own features, then the distances to reference items if it is a metric."""
    pivots = []
    if metric and sample:
        every = np.arange(len(sample))
        picked = farthest_first(len(sample), PIVOTS, lambda i: kernel(sample, sample, np.full(len(sample), i), every))
        pivots = [sample[i] for i in picked]

    def features(items: list) -> np.ndarray:
        columns = [np.asarray(own(items), float)] if own is not None else []
        every = np.arange(len(items))
        columns += [kernel(items, [p], every, np.zeros(len(items), np.int64))[:, None] for p in pivots]
        return np.concatenate(columns, axis=1) if columns else np.zeros((len(items), 0))

    return features


def nearest_centre(centres: np.ndarray) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(number of the nearest centre by largest difference, that difference) of feature rows."""

    def place(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, at = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        for k, c in enumerate(centres):
            far = np.abs(rows - c).max(axis=1)
            closer = far < best
            best[closer], at[closer] = far[closer], k
        return at, best

    return place


PACKED = "block long, n long, lo array<double>, hi array<double>, reach double, ids binary, whole boolean, sizes binary, numbers binary, phi binary, reaches binary"
_PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]


@dataclass
class Side:
    """The items of one of two blocks that meet; ``key`` tells the block."""

    ids: np.ndarray
    items: list
    phi: np.ndarray
    reach: np.ndarray
    key: tuple = ()


def pack(block: int, ids: pd.Series, values: Sequence, phi: np.ndarray, reach: np.ndarray) -> dict:
    """A block as one row. Its box leaves NaN out: an item without features is near nothing."""
    whole = pd.api.types.is_integer_dtype(ids.dtype)  # else some are NULL and all are doubles
    arrays = [np.asarray(v, float).ravel() for v in values]
    edges = [fn.reduce(phi, axis=0).tolist() if phi.shape[1] else [] for fn in (np.fmin, np.fmax)]
    return {
        "block": int(block), "n": len(arrays), "lo": edges[0], "hi": edges[1], "reach": float(reach.max()),
        "ids": ids.to_numpy(np.int64 if whole else float).tobytes(), "whole": whole, "sizes": np.array([len(v) for v in arrays], np.int64).tobytes(),
        "numbers": np.concatenate(arrays).tobytes(), "phi": np.ascontiguousarray(phi, float).tobytes(), "reaches": np.asarray(reach, float).tobytes(),
    }


def unpack(row: dict, decode: Callable[[Sequence], list], key: tuple) -> Side:
    numbers, ends = np.frombuffer(row["numbers"]), np.cumsum(np.frombuffer(row["sizes"], np.int64))
    return Side(
        np.frombuffer(row["ids"], np.int64 if row["whole"] else float), decode(np.split(numbers, ends[:-1])),
        np.frombuffer(row["phi"]).reshape(row["n"], -1), np.frombuffer(row["reaches"]), key,
    )


def sides(batches: Iterator[pd.DataFrame], decode: Callable[[Sequence], list], group: Sequence[str] = ()) -> Iterator[tuple[Side, Side, bool]]:
    """(left, right, both are one block) of every row of two packed blocks."""
    last = None
    for pdf in batches:
        for values in pdf.itertuples(index=False, name=None):
            row = dict(zip(pdf.columns, values))
            own = tuple(row[g] for g in group)
            found = []
            for side in "ab":
                key = (*own, row[f"{side}_block"])
                if side == "a" and last is not None and last.key == key:
                    found.append(last)
                    continue
                found.append(unpack({c: row[f"{side}_{c}"] for c in _PACKED_NAMES}, decode, key))
            last = found[0]
            yield *found, found[0].key == found[1].key


def parts_of(n: int, bytes_: float, cores: int) -> int:
    """Partitions of ``n`` packed blocks so that every two make a task: of bounded size, several for each core."""
    return max(1, min(n, max(math.isqrt(TASKS_PER_CORE * cores - 1) + 1, math.ceil(bytes_ / SIDE_BYTES))))


def twice(packed: DataFrame) -> list[DataFrame]:
    return [packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns]) for side in "ab"]


def every_two(packed: DataFrame, near: Column | None = None) -> DataFrame:
    """Every two blocks once, and every block with itself, without a shuffle: a task reads two partitions of the stored table.
    Which of two is the left one follows their hashes, so that all tasks get about as many."""
    core.small_batches(packed.sparkSession)
    a, b = twice(packed)
    even = F.xxhash64("a_block").bitwiseXOR(F.xxhash64("b_block")).bitwiseAND(F.lit(1)) == 0
    once = (F.col("a_block") == F.col("b_block")) | ((even == (F.col("a_block") < F.col("b_block"))) & (F.col("a_block") != F.col("b_block")))
    return a.join(b.hint("shuffle_replicate_nl"), once if near is None else once & near)


class Blocks:
    """``rows``: the items (group, id, v) with ``phi`` (features) and ``block``, to be packed once.

    ``decode`` turns a column of plain values into the kernel's items. Blocks never cross a group.
    """

    def __init__(self, items: DataFrame, decode: Callable[[Sequence], list], kernel, own: Features | None, metric: bool, group: Sequence[str] = (), rows: int | None = None):
        self.group = list(group)
        # Two actions on the items: a bounded sample, and the stored table, whose count then costs no work.
        sample = decode(sample_of(items))
        features = pivot_features(sample, kernel, own, metric)
        known = features(sample)
        self.width = known.shape[1]
        centres = known[farthest_first(len(known), CENTRES, lambda i: np.abs(known - known[i]).max(axis=1))]
        place = nearest_centre(centres)
        self.widest = int(np.argmax(known.std(axis=0))) if len(known) and self.width else 0

        @F.pandas_udf("phi array<double>, cell long, far double")
        def placed(v: pd.Series) -> pd.DataFrame:
            phi = features(decode(v))
            cell, far = place(phi)
            return pd.DataFrame({"phi": list(phi), "cell": cell, "far": far})

        marked = core.cut_lineage(items.select(*self.group, "id", "v", placed("v").alias("p")).select(*self.group, "id", "v", "p.*"))
        self.n, numbers = marked.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("v")), F.lit(0.0))).first()
        most = WIDE_ROWS if numbers <= SHORT else MOST_ROWS  # every item is copied once for each block it meets
        most = min(most, 1 << max(0, int(PACKED_NUMBERS / max(1.0, numbers)).bit_length() - 1))
        size = min(LEAST_ROWS, most)
        while size < most and size * (16 if size < MOST_ROWS else 32) <= self.n:
            size *= 2
        if rows is not None:
            size = 1 << max(0, rows.bit_length() - 1)
        order = [*self.group, "cell", "far", "id"]
        cuts = self.n // SORTED_ROWS + 1
        laid = marked.repartitionByRange(cuts, *order).sortWithinPartitions(*order)
        # Places are numbered from partition << 33, so a shift by the size of a block never joins two partitions.
        self.shift = size.bit_length() - 1
        numbered = laid.withColumn("block", F.shiftright(F.monotonically_increasing_id(), self.shift))
        self.rows = numbered.select(*self.group, "id", "v", "phi", "block")
        self.decode = decode
        self.parts = parts_of(-(-self.n // size) + cuts - 1, self.n * 8.0 * (numbers + self.width + 3), marked.sparkSession.sparkContext.defaultParallelism)

    def packed(self, reaches: Callable[[list], np.ndarray]) -> DataFrame:
        """The blocks as stored rows (group, ``PACKED``); ``reaches`` gives how far each item of a block looks."""
        group, decode = self.group, self.decode

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            row = pack(pdf["block"].iloc[0], pdf["id"], pdf["v"], np.stack(pdf["phi"].to_list()), reaches(decode(pdf["v"])))
            return pd.DataFrame([{**{g: pdf[g].iloc[0] for g in group}, **row}])

        kinds = "".join(f"{g} {self.rows.schema[g].dataType.simpleString()}, " for g in group)
        made = core.spread(self.rows, *group, "block").groupBy(*group, "block").applyInPandas(work, kinds + PACKED)
        first = F.shiftright("block", 33 - self.shift)  # the partition it was cut in; blocks of one are dealt out in turn
        place = F.pmod(F.col("block").bitwiseAND(F.lit((1 << 33 - self.shift) - 1)) + 7 * first, F.lit(self.parts))
        return core.cut_lineage(made.repartitionById(self.parts, place.cast("int")))

    def met(self, packed: DataFrame, slack: float) -> DataFrame:
        """Rows of two packed blocks (group, a_.., b_..) whose gap is within the ``reach`` of either one."""
        core.small_batches(packed.sparkSession)
        boxes = packed.select(*self.group, "block", "n", "lo", "hi", "reach")
        if not self.group:
            a, b = twice(boxes)
            near = self._gap() <= F.greatest("a_reach", "b_reach") * F.lit(slack)
            some = a.orderBy(F.xxhash64("a_block"), "a_block").limit(FEW_BLOCKS)
            meet, n = some.join(b, near, "left").agg(F.count("b_block"), F.count_distinct("a_block")).first()
            if meet > COPIES * n:
                return every_two(packed, near)
        left, right = ([F.col(c).alias(f"{side}_{c}") for c in _PACKED_NAMES] for side in "ab")
        pairs = self.meetings(boxes, slack).withColumnsRenamed({"a": "a_block", "b": "b_block"})
        joined = pairs.join(packed.select(*self.group, *left), [*self.group, "a_block"]).join(packed.select(*self.group, *right), [*self.group, "b_block"])
        return core.spread(joined, *self.group, "a_block", "b_block")

    def _gap(self) -> Column:
        gaps = [F.greatest(F.col("a_lo")[i] - F.col("b_hi")[i], F.col("b_lo")[i] - F.col("a_hi")[i]) for i in range(self.width)]
        return F.greatest(*gaps, F.lit(0.0)) if gaps else F.lit(0.0)

    def meetings(self, boxes: DataFrame, slack: float) -> DataFrame:
        """(group, a, b) with a <= b: blocks whose gap is within the ``reach`` of either one."""
        q = self.widest
        low, high = F.col("lo")[q], F.col("hi")[q]
        out = F.col("reach") * F.lit(slack)
        n, least, most, span = boxes.agg(
            F.count(F.lit(1)), F.min(low), F.max(high), F.percentile_approx(high - low + F.when(out < 1e300, 2 * out).otherwise(0.0), 0.95)
        ).first()
        few = n <= FEW_BLOCKS or not most - least > 0
        step = 1.0 if few else max(span, (most - least) / BUCKETS)
        bucket = (lambda c: F.lit(0).cast("long")) if few else (lambda c: F.floor((F.least(F.greatest(c, F.lit(least)), F.lit(most)) - F.lit(least)) / F.lit(step)).cast("long"))
        first, last = bucket(low - out), bucket(high + out)
        wide = boxes.select(*self.group, F.col("block").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), out.alias("out_a"), first.alias("from_a"), F.explode(F.sequence(first, last)).alias("_bucket"))
        own_first, own_last = bucket(low), bucket(high)
        own = boxes.select(*self.group, F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), own_first.alias("from_b"), F.explode(F.sequence(own_first, own_last)).alias("_bucket"))
        joined = wide.join(own, [*self.group, "_bucket"]).where(F.col("_bucket") == F.greatest("from_a", "from_b"))
        gaps = [F.greatest(F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i]) for i in range(self.width)]
        gap = F.greatest(*gaps, F.lit(0.0)) if gaps else F.lit(0.0)
        near = joined.where(gap <= F.col("out_a"))
        return near.select(*self.group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def close_mask(phi_a: np.ndarray, phi_b: np.ndarray, reach: np.ndarray, worth: float = 0.0) -> np.ndarray:
    """Which pairs have all features within ``reach`` (rows x rows). Features that rule out less than a share ``worth`` of some
    of the pairs are left out: then all are."""
    keep = np.ones(reach.shape, bool)
    if worth and keep.size:
        some, other = slice(0, None, -(-len(phi_a) // 8)), slice(0, None, -(-len(phi_b) // 64))
        if close_mask(phi_a[some], phi_b[other], reach[some, other]).mean() > 1 - worth:
            return keep
    for i in range(phi_a.shape[1]):
        keep &= np.abs(phi_a[:, i, None] - phi_b[None, :, i]) <= reach
        if np.count_nonzero(keep) * FEW_KEPT < keep.size:
            break
    else:
        return keep
    ia, ib = np.nonzero(keep)  # few pairs are left: only they are looked at further
    for k in range(i + 1, phi_a.shape[1]):
        near = np.abs(phi_a[ia, k] - phi_b[ib, k]) <= reach[ia, ib]
        ia, ib = ia[near], ib[near]
    keep[:] = False
    keep[ia, ib] = True
    return keep


def close_pairs(phi_a: np.ndarray, phi_b: np.ndarray, reach_a: np.ndarray, reach_b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs whose features all lie within the larger reach of the two; ``same``: both sides are one block, pairs once."""
    keep = close_mask(phi_a, phi_b, np.maximum(reach_a[:, None], reach_b[None, :]))
    return np.nonzero(np.triu(keep, 1) if same else keep)
