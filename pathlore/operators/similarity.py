"""Distances between trajectories: bounded blocks of pairs as Spark tasks, a vectorised kernel inside each.

A task holds one pair of blocks of items, so its size does not depend on the data. Where a result needs every pair, items
are hashed into blocks. ``pairs_within`` and ``nearest`` lay near items into the same block instead (``blocks``): blocks
whose boxes lie farther apart than the reach never meet, features and cheap bounds rule out single pairs, and the kernels
stop early on pairs that are already too far. All of it is exact; measures that allow no bound compare every pair.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.operators import blocks, core

BLOCK_ROWS = 256
FEW_ITEMS = 4096  # up to so many items all blocks meet: laying them out would cost more than it saves. Steers the work, not the result
WIDE_ROWS = 2048  # items of a block, at most, where tables of distances are formed: fewer copies of the items travel
FINE_BITS = 40  # trailing bits of a distance that a fine cell of the histogram leaves open: 4,096 cells for each power of two
LEAST_BLOCKS = 16  # blocks that many items are cut into at least, so that every core has some pairs
PAIRS_AT_ONCE = 1024  # keeps the working rows of a chunk in the processor cache
PART_ROWS = 512  # left rows of a table of distances that is formed at once
TABLE_ROWS, TABLE_COLUMNS = 64, 512  # part of it whose working rows stay in the cache
LARGEST = 1e15  # single precision is not used for greater numbers: their squares could overflow
FEW_LEFT = 16  # a table of least distances is not worth it where features leave less than one in so many of its pairs
WORTH = 0.1  # share of the first pairs of a task that a bound must rule out to be taken for the others
SQUARE_ROWS, SQUARE_COLUMNS, SQUARE_POINTS = 64, 128, 8  # the same for products of matrices
DTW_CELLS, DTW_COLUMNS = 1 << 17, 128  # cells of an anti-diagonal, of all pairs of a part, and its columns, for warping
EARLY_POINTS = 16  # points or rows between two looks at what is already too far
DISTANCE_CELLS = 1 << 16  # by which edges are counted before they are sorted
LARGEST_RANGE = 8  # times the rows of a sorted range that those of one cell may be
SLACK = 1 + 1e-9  # bounds are this much wider than eps, so rounding loses no pair; the last test is exact


# ---- kernels: (A, B) lists of (n, 2) arrays, index arrays ia, ib -> distances ---------------------------


def _stack(paths) -> np.ndarray:
    lengths = {len(p) for p in paths}
    if len(lengths) > 1:
        raise ValueError("point-wise measures need trajectories of equal length; use dtw for others")
    return np.stack(paths)


def _pointwise(local: Callable[[np.ndarray], np.ndarray]):
    """Sum of a local cost over the points. With ``eps`` a pair stops once its sum so far is above: it gives infinity."""

    def measure(a, b, ia, ib, eps: float | None = None):
        sa, sb = _stack(a), _stack(b)
        if sa.shape[1] != sb.shape[1]:
            raise ValueError("point-wise measures need trajectories of equal length; use dtw for others")
        n = sa.shape[1]
        parts = []
        for s in range(0, len(ia), PAIRS_AT_ONCE):
            ja, jb = ia[s : s + PAIRS_AT_ONCE], ib[s : s + PAIRS_AT_ONCE]
            if eps is None or n < 2 * EARLY_POINTS:
                parts.append(local(sa[ja] - sb[jb]).sum(axis=1))
                continue
            total, live, stopped = np.zeros(len(ja)), np.arange(len(ja)), 0
            for at in range(0, n, EARLY_POINTS):
                total[live] += local(sa[ja[live], at : at + EARLY_POINTS] - sb[jb[live], at : at + EARLY_POINTS]).sum(axis=1)
                far = total[live] > eps * SLACK
                if at + EARLY_POINTS < n and far.any():
                    total[live[far]] = np.inf
                    live, stopped = live[~far], stopped + int(far.sum())
                    if not len(live):
                        break
            parts.append(total)
            if stopped < WORTH * len(ja):
                eps = None  # these pairs lie too close together for looking to pay
        return np.concatenate(parts or [np.empty(0)])

    return measure


euclidean = _pointwise(lambda d: np.sqrt((d * d).sum(axis=2)))
manhattan = _pointwise(lambda d: np.abs(d).sum(axis=2))


def _euclidean_step(total, x, y):
    np.multiply(x, x, out=x)
    np.multiply(y, y, out=y)
    np.add(x, y, out=x)
    np.add(total, np.sqrt(x, out=x), out=total)


def _manhattan_step(total, x, y):
    np.add(total, np.abs(x, out=x), out=total)
    np.add(total, np.abs(y, out=y), out=total)


def by_points(a, b, step: Callable, kind=np.float64) -> np.ndarray:
    """Table over all of ``a`` and all of ``b``, point after point: ``step`` (total, x differences, y differences) adds a point.
    Nothing is copied for a pair, and the working rows stay in the processor cache."""
    sa, sb = _stack(a), _stack(b)
    if sa.shape[1] != sb.shape[1]:
        raise ValueError("point-wise measures need trajectories of equal length; use dtw for others")
    (ax, ay), (bx, by) = (np.ascontiguousarray(s.transpose(2, 1, 0), kind) for s in (sa, sb))
    out = np.zeros((len(a), len(b)), kind)
    for r in range(0, len(a), TABLE_ROWS):
        for c in range(0, len(b), TABLE_COLUMNS):
            rows, columns = slice(r, r + TABLE_ROWS), slice(c, c + TABLE_COLUMNS)
            total = np.zeros(out[rows, columns].shape, kind)
            x, y = np.empty_like(total), np.empty_like(total)
            for p in range(sa.shape[1]):
                np.subtract(ax[p, rows, None], bx[p, None, columns], out=x)
                np.subtract(ay[p, rows, None], by[p, None, columns], out=y)
                step(total, x, y)
            out[rows, columns] = total
    return out


def lowered(table: np.ndarray, steps: int, largest: float) -> np.ndarray:
    """A table of ``steps`` added distances in single precision, made smaller by more than all that its rounding may have added."""
    table *= 1 - 2.4e-7 * (steps + 8)
    table -= steps * 1e-6 * largest
    return table


def _largest(*sides) -> float:
    """The greatest absolute number; NaN where one is NaN."""
    points = [p for side in sides for p in side if len(p)]
    return float(np.abs(np.concatenate(points)).max()) if points else 0.0


def floor_by_points(step: Callable, last: Callable = lambda total: total):
    """The ``floor`` of a measure that adds up, or takes the greatest of, something no greater than the points' Manhattan distance."""

    def floor(a, b, reach: float):
        largest = _largest(a, b)
        if not largest < LARGEST:
            return last(by_points(a, b, step))
        return lowered(last(by_points(a, b, step, np.float32)), len(a[0]) if len(a) else 0, largest)

    return floor


def _centre(*sides) -> tuple[np.ndarray, float]:
    """(mean of all points, the greatest coordinate from it)."""
    points = np.concatenate([p for side in sides for p in side])
    centre = points.mean(axis=0)
    return centre, float(np.abs(points - centre).max())


def _four(points: np.ndarray, centre: np.ndarray, far: float, left: bool) -> np.ndarray:
    """Four numbers for each point, so that the scalar product of a left and a right point's is never above their squared
    distance: what is taken away is three times what rounding may add. ``far``: the greatest coordinate from the centre."""
    p = points - centre
    own, one = (p * p).sum(axis=-1), np.ones(p.shape[:-1])
    numbers = [-2 * p[..., 0], -2 * p[..., 1], own - 1e-5 * far * far, one] if left else [p[..., 0], p[..., 1], one, own]
    return np.stack(numbers, axis=-1).astype(np.float32)


def floor_by_squares(step: Callable, join: np.ufunc, each: Callable | None = None, last: Callable = lambda total: total):
    """``floor_by_points`` for a measure of the points' Euclidean distances: their squares come from products of matrices, ``each``
    is taken of them in place, ``join`` puts the points together."""
    plain = floor_by_points(step, last)

    def floor(a, b, reach: float):
        if not _largest(a, b) < LARGEST or not len(a) or not len(b) or not len(a[0]):
            return plain(a, b, reach)
        sa, sb = _stack(a), _stack(b)
        if sa.shape[1] != sb.shape[1]:
            raise ValueError("point-wise measures need trajectories of equal length; use dtw for others")
        centre, far = _centre(a, b)
        left = np.ascontiguousarray(_four(sa, centre, far, True).transpose(1, 0, 2))  # point, pair, number
        right = np.ascontiguousarray(_four(sb, centre, far, False).transpose(1, 2, 0))
        out = np.empty((len(a), len(b)), np.float32)
        for r in range(0, len(a), SQUARE_ROWS):
            for c in range(0, len(b), SQUARE_COLUMNS):
                rows, columns = slice(r, r + SQUARE_ROWS), slice(c, c + SQUARE_COLUMNS)
                total = np.zeros(out[rows, columns].shape, np.float32)
                zero = np.zeros(total.shape, np.float32)  # a number instead of a table would take three times as long
                for p in range(0, sa.shape[1], SQUARE_POINTS):
                    points = slice(p, p + SQUARE_POINTS)
                    squares = np.matmul(left[points, rows], right[points, :, columns])
                    np.maximum(squares, zero, out=squares)
                    if each is not None:
                        each(squares, out=squares)
                    for part in squares:
                        join(total, part, out=total)
                out[rows, columns] = total
        return lowered(last(out), sa.shape[1], far)

    return floor


def _padded(paths) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in paths])
    out = np.zeros((len(paths), max(lengths.max(), 1), 2))
    for i, p in enumerate(paths):
        out[i, : len(p)] = p
    return out, lengths


def dtw(a, b, ia, ib, band: int | None = None, eps: float | None = None):
    """Dynamic time warping with Euclidean local cost; the recurrence runs over all pairs of a chunk at once.

    ``band``: cells with |i - j| > band are closed; a band too narrow for the lengths gives infinity.
    ``eps``: pairs whose cheapest cell of a row is above it are given up with infinity.
    """
    pa, la = _padded(a)
    pb, lb = _padded(b)
    parts = []
    for s in range(0, len(ia), PAIRS_AT_ONCE):
        xa, xb = pa[ia[s : s + PAIRS_AT_ONCE]], pb[ib[s : s + PAIRS_AT_ONCE]]
        na, nb = la[ia[s : s + PAIRS_AT_ONCE]], lb[ib[s : s + PAIRS_AT_ONCE]]
        n, m = xa.shape[1], xb.shape[1]
        result, live = np.full(len(xa), np.inf), np.arange(len(xa))
        bx, by = np.ascontiguousarray(xb[:, :, 0].T), np.ascontiguousarray(xb[:, :, 1].T)
        before = np.full((m + 1, len(live)), np.inf)
        before[0] = 0.0
        spare, cost, dy, low = np.empty((m + 1, len(live))), np.empty((m, len(live))), np.empty((m, len(live))), np.empty(len(live))
        for i in range(1, n + 1):
            now = spare
            now.fill(np.inf)
            lo, hi = (1, m) if band is None else (max(1, i - band), min(m, i + band))
            if lo <= hi:
                c, d, reach = cost[lo - 1 : hi], dy[lo - 1 : hi], now[lo : hi + 1]
                np.subtract(bx[lo - 1 : hi], xa[:, i - 1, 0], out=c)
                np.multiply(c, c, out=c)
                np.subtract(by[lo - 1 : hi], xa[:, i - 1, 1], out=d)
                np.multiply(d, d, out=d)
                np.add(c, d, out=c)
                np.sqrt(c, out=c)
                np.minimum(before[lo : hi + 1], before[lo - 1 : hi], out=reach)
                for j in range(lo, hi + 1):
                    np.minimum(now[j], now[j - 1], out=low)
                    np.add(cost[j - 1], low, out=now[j])
            done = na == i
            if done.any():
                at = np.nonzero(done)[0]
                result[live[at]] = now[nb[at], at]
            before, spare = now, before
            if eps is not None and i % EARLY_POINTS == 0 and i < n:
                go = np.nonzero((now.min(axis=0) <= eps * SLACK) & (na > i))[0]
                if not len(go):
                    break
                if len(go) < 0.75 * len(live):
                    live, xa, na, nb = live[go], xa[go], na[go], nb[go]
                    bx, by, before = np.ascontiguousarray(bx[:, go]), np.ascontiguousarray(by[:, go]), np.ascontiguousarray(before[:, go])
                    spare, cost, dy, low = np.empty((m + 1, len(go))), np.empty((m, len(go))), np.empty((m, len(go))), np.empty(len(go))
        parts.append(result)
    return np.concatenate(parts or [np.empty(0)])


def dtw_floor(a, b, reach: float, band: int | None = None) -> np.ndarray:
    """Table never above the warping distances of all of ``a`` with all of ``b``: the recurrence in single precision, lowered.
    It goes from one anti-diagonal to the next, so that all cells of one, of all pairs of a part, are formed at once. Parts in
    which no pair can come within ``reach`` any more are given up with infinity."""
    plain = not _largest(a, b) < LARGEST
    kind = np.float64 if plain else np.float32
    out = np.full((len(a), len(b)), np.inf, kind)
    if not any(map(len, a)) or not any(map(len, b)):
        return out
    centre, far = (np.zeros(2), 0.0) if plain else _centre(a, b)
    sides = [np.argsort([len(p) for p in side], kind="stable") for side in (a, b)]
    for s in range(0, len(b), DTW_COLUMNS):
        columns = sides[1][s : s + DTW_COLUMNS]
        pb, nb = _padded([b[k] for k in columns])
        m = pb.shape[1]
        turned = pb[:, ::-1] if plain else _four(pb[:, ::-1], centre, far, False)
        right = np.ascontiguousarray(turned.transpose(1, 2, 0))  # step from the last, number, pair
        most = m if band is None else min(m, band + 1)
        wanted = max(1, DTW_CELLS // (most * len(columns)))
        for r in range(0, len(a), wanted):
            rows = sides[0][r : r + wanted]
            pa, na = _padded([a[k] for k in rows])
            n, shape = pa.shape[1], (len(rows), len(columns))
            left = np.ascontiguousarray((pa if plain else _four(pa, centre, far, True)).transpose(1, 0, 2))  # step, pair, number
            two, one, now = (np.full((n + 2, *shape), np.inf, kind) for _ in range(3))  # by step of a: two diagonals before, one, this
            two[0] = 0.0
            room, zero = min(n, most), np.zeros((1, *shape), kind)
            cost, other = np.empty((room, *shape), kind), np.empty((room if plain else 0, *shape), kind)
            found, ends = np.full(shape, np.inf, kind), na[:, None] + nb[None, :]
            last = set(np.unique(ends).tolist())
            for k in range(2, n + m + 1):
                lo, hi = max(1, k - m), min(n, k - 1)
                if band is not None:
                    lo, hi = max(lo, -((band - k) // 2)), min(hi, (k + band) // 2)
                if lo > n:
                    break
                if lo <= hi:
                    c, cells, own, theirs = cost[: hi - lo + 1], now[lo : hi + 1], left[lo - 1 : hi], right[m - k + lo : m - k + hi + 1]
                    if plain:
                        d = other[: hi - lo + 1]
                        np.subtract(own[:, :, :1], theirs[:, :1], out=c)
                        np.subtract(own[:, :, 1:], theirs[:, 1:], out=d)
                        np.add(np.multiply(c, c, out=c), np.multiply(d, d, out=d), out=c)
                    else:
                        np.maximum(np.matmul(own, theirs, out=c), zero, out=c)
                    np.minimum(one[lo - 1 : hi], one[lo : hi + 1], out=cells)
                    np.minimum(cells, two[lo - 1 : hi], out=cells)
                    np.add(cells, np.sqrt(c, out=c), out=cells)
                now[lo - 1] = now[hi + 1] = np.inf  # the next two diagonals look no farther
                if k in last:
                    i, j = np.nonzero((ends == k) & (lo <= na[:, None]) & (na[:, None] <= hi))
                    found[i, j] = now[na[i], i, j]
                two, one, now = one, now, two
                if k % EARLY_POINTS == 0 and k < n + m and lo <= hi:
                    least = min(one[lo - 1 : hi + 2].min(), two[max(0, lo - 2) : hi + 2].min())
                    if lowered(np.array([least]), n + m, far).item() > reach:
                        break
            if not plain:
                lowered(found, n + m, far)
            out[np.ix_(rows, columns)] = found
    return out


def _envelopes(points: np.ndarray, lengths: np.ndarray, width: int, band: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) corner, for each step of a path of up to ``width`` steps, of the points that may be aligned with it."""
    steps = np.arange(points.shape[1])
    there = (steps[None, :] < lengths[:, None])[:, :, None]
    least, most = np.where(there, points, np.inf), np.where(there, points, -np.inf)
    if band is None:
        return least.min(axis=1, keepdims=True), most.max(axis=1, keepdims=True)
    lower, upper = np.empty((len(points), width, 2)), np.empty((len(points), width, 2))
    for i in range(width):
        window = slice(max(0, i - band), max(1, i + band + 1))
        near = least[:, window], most[:, window]
        lower[:, i] = near[0].min(axis=1) if near[0].shape[1] else np.inf  # nothing to align with: the distance is infinite
        upper[:, i] = near[1].max(axis=1) if near[1].shape[1] else -np.inf
    return lower, upper


def dtw_bound(a, b, ia, ib, band: int | None = None):
    """Never above the warping distance: every alignment pairs the two first and the two last points, and each point of
    either path with one that lies in the box around all it may be aligned with."""
    pa, la = _padded(a)
    pb, lb = _padded(b)
    fa, fb = pa[:, 0], pb[:, 0]
    ea, eb = pa[np.arange(len(a)), la - 1], pb[np.arange(len(b)), lb - 1]
    box_a, box_b = _envelopes(pa, la, pb.shape[1], band), _envelopes(pb, lb, pa.shape[1], band)

    def outside(points, lengths, which, box, other):
        there = np.arange(points.shape[1])[None, :] < lengths[which][:, None]
        x = points[which]
        off = np.maximum(np.maximum(box[0][other] - x, x - box[1][other]), 0.0)
        return np.where(there, np.sqrt((off * off).sum(axis=2)), 0.0).sum(axis=1)

    parts = []
    for s in range(0, len(ia), PAIRS_AT_ONCE):
        ja, jb = ia[s : s + PAIRS_AT_ONCE], ib[s : s + PAIRS_AT_ONCE]
        first = np.sqrt(((fa[ja] - fb[jb]) ** 2).sum(axis=1))
        last = np.sqrt(((ea[ja] - eb[jb]) ** 2).sum(axis=1))
        ends = np.where((la[ja] == 1) & (lb[jb] == 1), first, first + last)
        parts.append(np.maximum(ends, np.maximum(outside(pa, la, ja, box_b, jb), outside(pb, lb, jb, box_a, ja))))
    return np.concatenate(parts or [np.empty(0)])


def dtw_banded(band: int):
    return lambda a, b, ia, ib, eps=None: dtw(a, b, ia, ib, band=band, eps=eps)


def _vectors(paths) -> np.ndarray:
    return np.stack([np.asarray(p, dtype=float) for p in paths])


def cosine(a, b, ia, ib):
    """Cosine similarity, 0 where a norm is 0."""
    va, vb = _vectors(a), _vectors(b)
    na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
    dots = np.einsum("ij,ij->i", va[ia], vb[ib])
    norms = na[ia] * nb[ib]
    return np.where(norms > 0, dots / np.where(norms > 0, norms, 1.0), 0.0)


def negative_euclidean(a, b, ia, ib):
    va, vb = _vectors(a), _vectors(b)
    return -np.sqrt(((va[ia] - vb[ib]) ** 2).sum(axis=1))


def vector_euclidean(a, b, ia, ib):
    return -negative_euclidean(a, b, ia, ib)


def cosine_table(a, b):
    va, vb = _vectors(a), _vectors(b)
    na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
    ua, ub = va / np.where(na > 0, na, 1.0)[:, None], vb / np.where(nb > 0, nb, 1.0)[:, None]
    return ua @ ub.T


def vector_euclidean_table(a, b):
    """By the scalar product; pairs so close, against their lengths, that it loses digits are taken from the differences."""
    va, vb = _vectors(a), _vectors(b)
    centre = va.mean(axis=0) if len(va) else 0.0
    va, vb = va - centre, vb - centre
    qa, qb = (va * va).sum(axis=1), (vb * vb).sum(axis=1)
    out = va @ vb.T
    out *= -2.0
    out += qa[:, None]
    out += qb[None, :]
    ia, ib = np.nonzero(~(out > 1e-4 * (qa.max(initial=0.0) + qb.max(initial=0.0))))
    np.sqrt(np.maximum(out, 0.0, out=out), out=out)
    for s in range(0, len(ia), PAIRS_AT_ONCE):
        ja, jb = ia[s : s + PAIRS_AT_ONCE], ib[s : s + PAIRS_AT_ONCE]
        out[ja, jb] = np.sqrt(((va[ja] - vb[jb]) ** 2).sum(axis=1))
    return out


def negative_euclidean_table(a, b):
    return -vector_euclidean_table(a, b)


# ---- measures -----------------------------------------------------------------------------------------

Kernel = Callable[[list, list, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Measure:
    """``features``: numbers of each item that differ by no more than the distance. ``metric``: the triangle rule holds, so
    distances to reference items are features too. ``bound``: cheap kernel that is never above the distance. ``stops``: the
    kernel takes ``eps`` and may give infinity above it. ``table``: (A, B) -> distances of all of A with all of B. ``floor``:
    (A, B, reach) -> table that is never above the distances (beyond ``reach`` any number above it), cheaper than they are."""

    kernel: Kernel
    features: Callable[[list], np.ndarray] | None = None
    metric: bool = False
    vector: bool = False
    bound: Kernel | None = None
    stops: bool = False
    table: Callable[[list, list], np.ndarray] | None = None
    floor: Callable[[list, list, float], np.ndarray] | None = None

    @property
    def prunes(self) -> bool:
        return self.metric or self.features is not None


def _totals(paths) -> np.ndarray:
    """The summed differences of one axis never exceed the summed point distances."""
    return np.array([p.sum(axis=0) for p in paths]).reshape(-1, 2)


def _outline(paths) -> np.ndarray:
    """First and last point and the bounding box: every alignment pairs the ends, and the extreme point of one path with some
    point of the other, which is no more extreme than that path's own extreme."""
    return np.array([np.concatenate([p[0], p[-1], p.min(axis=0), p.max(axis=0)]) for p in paths]).reshape(-1, 8)


MEASURES: dict[str, Measure] = {
    "euclidean": Measure(
        euclidean, _totals, metric=True, stops=True, table=lambda a, b: by_points(a, b, _euclidean_step), floor=floor_by_squares(_euclidean_step, np.add, np.sqrt)
    ),
    "manhattan": Measure(
        manhattan, _totals, metric=True, stops=True, table=lambda a, b: by_points(a, b, _manhattan_step), floor=floor_by_points(_manhattan_step)
    ),
    "dtw": Measure(dtw, _outline, bound=dtw_bound, stops=True, floor=dtw_floor),
    "cosine": Measure(cosine, vector=True, table=cosine_table),
    "negative_euclidean": Measure(negative_euclidean, vector=True, table=negative_euclidean_table),
    "vector_euclidean": Measure(vector_euclidean, metric=True, vector=True, table=vector_euclidean_table),
}


def find_measure(measure: str | Measure | Kernel, band: int | None = None) -> Measure:
    """A registered name, a ``Measure``, or a user kernel (A, B, ia, ib) -> distances."""
    if isinstance(measure, Measure):
        return measure
    if callable(measure):
        return Measure(measure)
    if measure not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}; known: {sorted(MEASURES)}")
    if band is not None:
        if measure != "dtw":
            raise ValueError("only dtw takes a band")
        return Measure(dtw_banded(band), _outline, bound=lambda a, b, ia, ib: dtw_bound(a, b, ia, ib, band), stops=True, floor=lambda a, b, reach: dtw_floor(a, b, reach, band))
    return MEASURES[measure]


# ---- blocks of pairs ----------------------------------------------------------------------------------


def _tasks(placed: DataFrame, block_rows: int, group: Iterable[str] = (), most: int = 0) -> DataFrame:
    """Copies of the items keyed by task (group, lb, rb) for every pair of blocks; the blocks follow the group's measured size.
    ``most``: blocks of many items grow up to so many, since every item is copied once for each block."""
    group, n = list(group), F.count(F.lit(1))
    rows = F.greatest(F.lit(block_rows), F.least(F.lit(most), F.floor(n / LEAST_BLOCKS)))
    sizes = placed.groupBy(*group).agg(F.ceil(n / rows).cast("long").alias("nb"))
    sized = placed.join(sizes, group) if group else placed.crossJoin(F.broadcast(sizes))  # one row
    # A salted id spreads evenly over the blocks, whatever the ids look like.
    copies = sized.withColumn("b", F.pmod(F.xxhash64("id", F.lit(7)), F.col("nb"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    return copies.select(
        *group, F.least("b", "o").alias("lb"), F.greatest("b", "o").alias("rb"), (F.col("b") <= F.col("o")).alias("left"), (F.col("b") >= F.col("o")).alias("right"), "id", "v"
    )


def flat(c: Column | str) -> Column:
    """Points as x1, y1, x2, y2, ...: plain doubles cross to Python without a dict per point."""
    return F.flatten(F.transform(c, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))


def _decode(values, vector: bool) -> list:
    if vector:
        return [np.asarray(v, dtype=float) for v in values]
    return [np.asarray(v, dtype=float).reshape(-1, 2) for v in values]


def _pairs_of(pdf: pd.DataFrame, m: Measure):
    """(ids left, ids right, distances) of one task over hashed blocks; each unordered pair once."""
    left, right = pdf[pdf["left"]], pdf[pdf["right"]]
    a, b = _decode(left["v"], m.vector), _decode(right["v"], m.vector)
    il, ir = left["id"].to_numpy(), right["id"].to_numpy()
    first = pdf.iloc[0]
    if first["lb"] == first["rb"]:
        ia, ib = np.nonzero(il[:, None] < ir[None, :])
    else:
        ia, ib = (g.ravel() for g in np.indices((len(il), len(ir))))
    d = np.empty(0) if not len(ia) else m.kernel(a, b, ia, ib) if m.table is None else m.table(a, b)[ia, ib]
    return il[ia], ir[ib], d


def _sides(pdf: pd.DataFrame, m: Measure, features: Callable | None = None, reach: float = np.inf) -> tuple[blocks.Side, blocks.Side]:
    """The two sides of one task over hashed blocks."""
    found = []
    for side in ("left", "right"):
        rows = pdf[pdf[side]]
        items = _decode(rows["v"], m.vector)
        phi = np.zeros((len(items), 0)) if features is None else features(items)
        found.append(blocks.Side(rows["id"].to_numpy(), items, phi, np.full(len(items), reach)))
    return tuple(found)


def _each_table(left: blocks.Side, right: blocks.Side, m: Measure, table: Callable | None = None):
    """(rows left, table of distances) of two blocks, some left rows at a time; ``table`` instead of the measure's own."""
    for s in range(0, len(left.items), PART_ROWS):
        part = left.items[s : s + PART_ROWS]
        if m.table is not None:
            d = (table or m.table)(part, right.items)
        else:
            ia, ib = (g.ravel() for g in np.indices((len(part), len(right.items))))
            d = m.kernel(part, right.items, ia, ib).reshape(len(part), len(right.items))
        yield slice(s, s + len(part)), d


def _tables(items: DataFrame, m: Measure, ident: str, value: str, block_rows: int | None) -> Callable[[Callable, str], DataFrame]:
    """(work, schema) -> what ``work`` gives for every two sides, and whether they are one block, by hashed blocks. Few items are
    copied for each block they meet; the blocks of many are stored once, packed, and read by the tasks."""
    plain = _plain(items, m, ident, value, ())
    most, n = _most(m, block_rows), 0 if block_rows is not None else plain.count()
    if n <= FEW_ITEMS:
        tasks = core.spread(_tasks(plain, block_rows or BLOCK_ROWS, (), most), "lb", "rb").groupBy("lb", "rb")
        return lambda work, schema: tasks.applyInPandas(lambda pdf: work(*_sides(pdf, m), pdf["lb"].iloc[0] == pdf["rb"].iloc[0]), schema)
    every = blocks.every_two(_packed_by_hash(plain, m, n, most))

    def read(work: Callable, schema: str) -> DataFrame:
        return every.mapInPandas(lambda batches: (work(*sides) for sides in blocks.sides(batches, lambda v: _decode(v, m.vector))), schema)

    return read


def _packed_by_hash(plain: DataFrame, m: Measure, n: int, most: int) -> DataFrame:
    """Stored blocks of items by the hash of their ids, without features."""
    numbers = plain.agg(F.coalesce(F.avg(F.size("v")), F.lit(0.0))).first()[0]
    rows = max(BLOCK_ROWS, min(most, n // LEAST_BLOCKS))
    rows = max(1, min(rows, int(blocks.PACKED_NUMBERS / max(1.0, numbers))))
    count = -(-n // rows)
    parts = blocks.parts_of(count, n * 8.0 * (numbers + 3), plain.sparkSession.sparkContext.defaultParallelism)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([blocks.pack(pdf["block"].iloc[0], pdf["id"], pdf["v"], np.zeros((len(pdf), 0)), np.full(len(pdf), np.inf))])

    placed = plain.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(count)))
    made = core.spread(placed, "block").groupBy("block").applyInPandas(work, blocks.PACKED)
    return core.cut_lineage(made.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")))


def _most(m: Measure, block_rows: int | None) -> int:
    return WIDE_ROWS if block_rows is None and m.table is not None else 0


def _plain(items: DataFrame, m: Measure, ident: str, value: str, group: Iterable[str]) -> DataFrame:
    plain = F.transform(value, lambda x: x.cast("double")) if m.vector else flat(value)
    return items.select(*group, F.col(ident).alias("id"), plain.alias("v"))


def _run(items, measure, ident, value, block_rows, shape: Callable, schema: str, band=None, group=()):
    """Every pair, by hashed blocks; ``shape`` turns the distances of a task into its output."""
    m = find_measure(measure, band)
    tasks = _tasks(_plain(items, m, ident, value, group), block_rows or BLOCK_ROWS, group)
    return _compared(tasks, m, shape, _kinds(items, group) + schema, group)


def _compared(tasks: DataFrame, m: Measure, shape: Callable, schema: str, group: Iterable[str] = ()) -> DataFrame:
    keys = [*group, "lb", "rb"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, d = _pairs_of(pdf, m)
        return _named(shape(np.minimum(i, j), np.maximum(i, j), d), pdf, group)

    return core.spread(tasks, *keys).groupBy(*keys).applyInPandas(work, schema)


def _cross_tasks(left: DataFrame, right: DataFrame, block_rows: int) -> DataFrame:
    """Copies of the items keyed by task (lb, rb) for every pair of a left and a right block; right blocks count down from -1."""
    sides = []
    sizes = [max(1, -(-side.count() // block_rows)) for side in (left, right)]
    for side, own, others, is_left in ((left, sizes[0], sizes[1], True), (right, sizes[1], sizes[0], False)):
        mine = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(own))
        copies = side.withColumn("b", mine).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long"))))
        lb, rb = ("b", "o") if is_left else ("o", "b")
        sides.append(copies.select(F.col(lb).alias("lb"), (-1 - F.col(rb)).alias("rb"), F.lit(is_left).alias("left"), F.lit(not is_left).alias("right"), "id", "v"))
    return sides[0].unionByName(sides[1])


def _named(out: pd.DataFrame, pdf: pd.DataFrame, group: Iterable[str]) -> pd.DataFrame:
    for g in reversed(list(group)):
        out.insert(0, g, pdf[g].iloc[0])
    return out


def _kinds(items: DataFrame, group: Iterable[str]) -> str:
    return "".join(f"{g} {items.schema[g].dataType.simpleString()}, " for g in group)


def _reached(m: Measure, left: blocks.Side, right: blocks.Side, same: bool):
    """(places, places, distances) of the pairs within the ``reach`` of either item that neither features nor bound rule out."""
    a, b, ra, rb = left.items, right.items, left.reach, right.reach
    if m.floor is not None:
        found = _above_floor(m, a, b, left.phi, right.phi, ra * SLACK, rb * SLACK, same)
    else:
        found = blocks.close_pairs(left.phi, right.phi, ra * SLACK, rb * SLACK, same)
    ia, ib = found
    if m.floor is None and m.bound is not None and len(ia):
        keep = np.ones(len(ia), bool)
        for at in range(0, len(ia), 8 * PAIRS_AT_ONCE):
            part = slice(at, at + 8 * PAIRS_AT_ONCE)
            keep[part] = m.bound(a, b, ia[part], ib[part]) <= np.maximum(ra[ia[part]], rb[ib[part]]) * SLACK
            if keep[part].mean() > 1 - WORTH:
                break  # it rules out too little here
        ia, ib = ia[keep], ib[keep]
    most = float(max(ra.max(), rb.max()))
    return ia, ib, np.empty(0) if not len(ia) else m.kernel(a, b, ia, ib, eps=most) if m.stops else m.kernel(a, b, ia, ib)


def _shaped(shape: Callable, left: blocks.Side, right: blocks.Side, ia: np.ndarray, ib: np.ndarray, d: np.ndarray) -> pd.DataFrame:
    i, j = left.ids[ia], right.ids[ib]
    return shape(np.minimum(i, j), np.maximum(i, j), d)


def _above_floor(m: Measure, a: list, b: list, phi_a, phi_b, ra: np.ndarray, rb: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that neither the features nor the table of least distances rule out. The features of some left rows are
    tried first: where they rule out nearly all, only the rest is looked at; where they rule out too little, they are left out."""
    parts = []
    for s in range(0, len(a), PART_ROWS):
        rows = slice(s, s + PART_ROWS)
        reach = np.maximum(ra[rows, None], rb[None, :])
        keep = blocks.close_mask(phi_a[rows], phi_b, reach, WORTH)
        if same:
            keep = np.triu(keep, s + 1)
        own, other = np.flatnonzero(keep.any(axis=1)), np.flatnonzero(keep.any(axis=0))  # the rest of the part has no pair
        left = np.count_nonzero(keep)
        if left and left * FEW_LEFT > len(own) * len(other):
            cut = np.ix_(own, other)
            floor = m.floor([a[s + k] for k in own], [b[k] for k in other], float(reach[cut].max()))
            ia, ib = np.nonzero(keep[cut] & (floor <= reach[cut]))
            ia, ib = own[ia], other[ib]
        else:
            ia, ib = np.nonzero(keep)
            if m.bound is not None and len(ia):
                near = m.bound(a[rows], b, ia, ib) <= reach[ia, ib]
                ia, ib = ia[near], ib[near]
        parts.append((ia + s, ib))
    return tuple(np.concatenate(side) for side in zip(*parts)) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _near(found: blocks.Blocks, m: Measure, reaches: Callable[[list], np.ndarray], work: Callable, schema: str) -> DataFrame:
    """``work`` turns the sides of all the blocks that may hold pairs within the ``reaches`` of their items, those of a task at a
    time, into (key of a block, rows)."""
    group, packed = found.group, found.packed(reaches)

    def read(batches):
        for key, out in work(blocks.sides(batches, lambda v: _decode(v, m.vector), group)):
            for g, value in reversed(list(zip(group, key))):
                out.insert(0, g, value)
            yield out

    return found.met(packed, SLACK).mapInPandas(read, _kinds(packed, group) + schema)


def _few_near(plain: DataFrame, m: Measure, eps: float, shape: Callable, schema: str, group: list[str]) -> DataFrame:
    """The same for few items: hashed blocks all meet, features are taken inside the task."""
    sample = _decode([r["v"] for r in plain.select("v").limit(4 * blocks.PIVOTS).collect()], m.vector)
    features = blocks.pivot_features(sample, m.kernel, m.features, m.metric)
    keys = [*group, "lb", "rb"]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(pdf, m, features, eps)
        found = _reached(m, left, right, pdf["lb"].iloc[0] == pdf["rb"].iloc[0])
        return _named(_shaped(shape, left, right, *found), pdf, group)

    return core.spread(_tasks(plain, BLOCK_ROWS, group), *keys).groupBy(*keys).applyInPandas(work, _kinds(plain, group) + schema)


def _blocks(items: DataFrame, m: Measure, ident: str, value: str, group: Iterable[str], block_rows: int | None) -> blocks.Blocks:
    return blocks.Blocks(_plain(items, m, ident, value, group), lambda v: _decode(v, m.vector), m.kernel, m.features, m.metric, list(group), block_rows)


def _within(items, measure, eps, ident, value, block_rows, shape, schema, band=None, group=()):
    m = find_measure(measure, band)
    if not m.prunes:
        return _run(items, measure, ident, value, block_rows, shape, schema, band, group)
    plain = _plain(items, m, ident, value, group)
    if block_rows is None and plain.count() <= FEW_ITEMS:
        return _few_near(plain, m, float(eps), shape, schema, list(group))
    eps = float(eps)

    def work(sides):
        for left, right, same in sides:
            yield left.key, _shaped(shape, left, right, *_reached(m, left, right, same))

    return _near(_blocks(items, m, ident, value, group, block_rows), m, lambda items: np.full(len(items), eps), work, schema)


def compared_pairs(items: DataFrame, measure="euclidean", eps: float = 0.0, *, ident: str = "traj_id", value: str = "points",
                   block_rows: int | None = None, band: int | None = None, group: Iterable[str] = ()) -> int:
    """How many pairs ``pairs_within`` hands to the kernel: a figure for tuning."""
    counted = _within(items, measure, eps, ident, value, block_rows, lambda i, j, d: pd.DataFrame({"n": [len(i)]}), "n long", band, list(group))
    return counted.agg(F.sum("n")).first()[0] or 0


def pairs_within(items: DataFrame, measure="euclidean", eps: float | None = None, *, ident: str = "traj_id",
                 value: str = "points", block_rows: int | None = None, band: int | None = None,
                 group: Iterable[str] = ()) -> DataFrame:
    """Edges (i < j, d) with d <= eps; ``eps=None`` gives the whole affinity (every pair, as asked for). ``eps=0`` finds equal items."""

    def shape(i, j, d):
        keep = slice(None) if eps is None else d <= eps
        return pd.DataFrame({"i": i[keep], "j": j[keep], "d": d[keep]})

    schema, group = "i long, j long, d double", list(group)
    if eps is None:
        return _run(items, measure, ident, value, block_rows, shape, schema, band, group)
    return _within(items, measure, eps, ident, value, block_rows, shape, schema, band, group)


def sparse_links(i: np.ndarray, j: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links with the same density clusters: an item with ``least`` links is marked by a link to itself, marked items that
    hang together are linked to one of them, and every link of an item that is not marked stays."""
    ids, place = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = place[: len(i)], place[len(i) :]
    marked = np.bincount(place, minlength=len(ids)) >= least
    inner = marked[a] & marked[b]
    root, u, v = np.arange(len(ids)), a[inner], b[inner]
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low < high
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(marked)
    hung = own[root[own] != own]
    return np.concatenate([ids[own], ids[root[hung]], i[~inner]]), np.concatenate([ids[own], ids[hung], j[~inner]])


def density_links(items: DataFrame, measure, eps: float, least: int, *, ident: str = "traj_id", value: str = "points",
                  block_rows: int | None = None, band: int | None = None) -> DataFrame:
    """Links (i, j) with the density clusters of all pairs within ``eps``, for cores of ``least`` neighbours or fewer; (i, i)
    marks a core. A task sends on no more than ``least`` links an item, however many pairs lie within ``eps``."""

    def shape(i, j, d):
        u, v = sparse_links(i[d <= eps], j[d <= eps], least)
        return pd.DataFrame({"i": u, "j": v})

    return _within(items, measure, eps, ident, value, block_rows, shape, "i long, j long", band)


def affinity(items: DataFrame, measure="euclidean", **how) -> DataFrame:
    """The full symmetric affinity as its upper triangle. Quadratic by definition; prefer ``pairs_within``,
    ``nearest`` or ``affinity_totals``, which send on only what their result needs."""
    return pairs_within(items, measure, None, **how)


def item_hashes(items: DataFrame, ident: str = "traj_id", value: str = "points") -> DataFrame:
    """(id, h1, h2): 128 bits of every item's values, by which a stored affinity knows whether it still holds."""
    return items.select(F.col(ident).alias("id"), F.xxhash64(F.lit(1), value).alias("h1"), F.xxhash64(F.lit(2), value).alias("h2"))


def extend_affinity(items: DataFrame, edges: DataFrame, known: DataFrame, measure="euclidean", *, ident: str = "traj_id",
                    value: str = "points", block_rows: int | None = None, band: int | None = None) -> DataFrame:
    """The affinity of ``items`` from ``edges`` (i, j, d) computed for ``known`` (id, h1, h2): only pairs with a new or
    changed item are compared; edges of items that are gone or have changed are left out."""
    m = find_measure(measure, band)
    same = core.cut_lineage(item_hashes(items, ident, value).join(known, ["id", "h1", "h2"], "left_semi").select("id"))
    plain = _plain(items, m, ident, value, ())
    fresh, rest = core.cut_lineage(plain.join(same, "id", "left_anti")), plain.join(same, "id", "left_semi")

    def shape(i, j, d):
        return pd.DataFrame({"i": i, "j": j, "d": d})

    size, schema = block_rows or BLOCK_ROWS, "i long, j long, d double"
    among = _compared(_tasks(fresh, size), m, shape, schema)
    between = _compared(_cross_tasks(fresh, rest, size), m, shape, schema)
    still = edges.join(same.withColumnRenamed("id", "i"), "i", "left_semi").join(same.withColumnRenamed("id", "j"), "j", "left_semi")
    return still.select("i", "j", "d").unionByName(among).unionByName(between)


def _least(at: np.ndarray, other: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` least distances of each place, ties to the smaller id."""
    order = np.lexsort((other, d, at))
    at, every = at[order], np.arange(len(order))
    first = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1]][: len(at)], every, 0))
    keep = every - first < k
    return at[keep], other[order][keep], d[order][keep]


def _kth(items: list, m: Measure, k: int) -> np.ndarray:
    """How far each item's ``k`` nearest among ``items`` can be at most: the distances of the k of least floor, or of all."""
    n = len(items)
    if n <= k:
        return np.full(n, np.inf)
    if m.floor is not None:
        d = np.empty((n, k))
        for s in range(0, n, PART_ROWS):
            least = m.floor(items[s : s + PART_ROWS], items, np.inf)
            own = np.arange(len(least))
            least[own, s + own] = np.nan  # sorted last, after infinity
            at = np.argpartition(least, k - 1, axis=1)[:, :k]
            d[s : s + PART_ROWS] = m.kernel(items[s : s + PART_ROWS], items, np.repeat(own, k), at.ravel()).reshape(len(own), k)
        reach = d.max(axis=1)
    else:
        if m.table is not None:
            d = m.table(items, items)
        else:
            ia, ib = np.triu_indices(n, 1)
            d = np.empty((n, n))
            d[ia, ib] = d[ib, ia] = m.kernel(items, items, ia, ib)
        np.fill_diagonal(d, np.inf)
        reach = np.partition(d, k - 1, axis=1)[:, k - 1]
    return np.where(np.isnan(reach), np.inf, reach)


def nearest(items: DataFrame, k: int, measure="euclidean", *, ident: str = "traj_id", value: str = "points",
            block_rows: int | None = None, band: int | None = None) -> DataFrame:
    """The k nearest items of each item: (id, rank, other, d), exact, ties to the smaller id.

    An item's k-th distance inside its own block bounds how far its neighbours can be; then it meets only blocks within that
    reach. A task sends on at most k candidates per item, however many blocks it holds. Where bounds are of no use every pair is
    compared.
    """
    m = find_measure(measure, band)

    def shape(i, j, d):
        both = pd.DataFrame({"id": np.r_[i, j], "other": np.r_[j, i], "d": np.r_[d, d]})
        return both.sort_values(["id", "d", "other"]).groupby("id", sort=False).head(k)

    schema = "id long, other long, d double"
    if m.prunes and (block_rows is not None or items.count() > FEW_ITEMS):

        def work(sides):
            best = {}
            for left, right, same in sides:
                ia, ib, d = _reached(m, left, right, same)
                ends = [(left, ia, right.ids[ib], d), (right, ib, left.ids[ia], d)]
                for side, at, other, d in [tuple(np.concatenate(x) if n else x[0] for n, x in enumerate(zip(*ends)))] if same else ends:
                    _, *known = best.get(side.key, (None, *(np.empty(0, x.dtype) for x in (at, other, d))))
                    best[side.key] = side.ids, *_least(*(np.concatenate(x) for x in zip(known, (at, other, d))), k)
            for key, (ids, at, other, d) in best.items():
                yield key, pd.DataFrame({"id": ids[at], "other": other, "d": d})

        part = _near(_blocks(items, m, ident, value, (), block_rows), m, lambda items: _kth(items, m, k), work, schema)
    else:
        part = _run(items, measure, ident, value, block_rows, shape, schema, band)
    w = Window.partitionBy("id").orderBy("d", "other")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def affinity_totals(items: DataFrame, measure="euclidean", *, ident: str = "traj_id", value: str = "points",
                    block_rows: int | None = None, band: int | None = None) -> DataFrame:
    """Per item over all others: number of pairs, sum, min and max of the distance. Pairs are never sent on."""

    m = find_measure(measure, band)

    def work(left: blocks.Side, right: blocks.Side, same: bool) -> pd.DataFrame:
        parts, theirs, ir = [], None, right.ids
        for rows, d in _each_table(left, right, m):
            il = left.ids[rows]
            pairs = (il[:, None] != ir[None, :]) if same else True  # one block with itself: both ends of a pair are rows
            low, high = (fn.reduce(d, axis=1, where=pairs, initial=e) for fn, e in ((np.fmin, np.inf), (np.maximum, -np.inf)))
            n = pairs.sum(axis=1) if same else np.full(len(il), len(ir))
            parts.append(pd.DataFrame({"id": il, "n": n, "total": d.sum(axis=1, where=pairs), "low": low, "high": high}))
            if not same:
                mine = [np.full(len(ir), len(il)), d.sum(axis=0), np.fmin.reduce(d, axis=0), np.maximum.reduce(d, axis=0)]
                theirs = mine if theirs is None else [fn(x, y) for fn, x, y in zip((np.add, np.add, np.fmin, np.maximum), theirs, mine)]
        if theirs is not None:
            parts.append(pd.DataFrame(dict(zip(("id", "n", "total", "low", "high"), (ir, *theirs)))))
        out = pd.concat(parts) if parts else pd.DataFrame({"id": [], "n": [], "total": [], "low": [], "high": []})
        return out[out["n"] > 0]

    part = _tables(items, m, ident, value, block_rows)(work, "id long, n long, total double, low double, high double")
    return part.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def mean_distances(items: DataFrame, measure="euclidean", **how) -> DataFrame:
    """Mean of an item's affinity column, diagonal included: (id, mean_d, position by falling mean)."""
    means = affinity_totals(items, measure, **how).select("id", (F.col("total") / (F.col("n") + 1)).alias("mean_d"))
    ranked = core.order_log(means.withColumns({"_one": F.lit(0), "_down": -F.col("mean_d")}), ["_one"], ["_down", "id"], step="position")
    return ranked.df.select("id", "mean_d", "position")


def distance_histogram(items: DataFrame, measure="euclidean", bins: int = 200, *, ident: str = "traj_id",
                       value: str = "points", block_rows: int | None = None, band: int | None = None) -> DataFrame:
    """Equal-width histogram of all pair distances (bin, lo, n); the last bin is closed.

    With a ``table`` of the measure there are two passes, the range of all first, then the bins: a task gives back its range and
    its counts, and no distance is stored or sent on. A kernel alone costs too much to be asked twice: ``_stored_histogram``.
    Infinite distances (outside a band) are in no bin; no pairs, no rows.
    """
    m = find_measure(measure, band)
    if m.table is None:
        return _stored_histogram(items, measure, bins, ident, value, block_rows, band)

    def each(left: blocks.Side, right: blocks.Side, same: bool):
        for rows, d in _each_table(left, right, m):
            d = d[left.ids[rows][:, None] < right.ids[None, :]] if same else d.ravel()
            yield d[np.isfinite(d)]

    def ends(*sides) -> pd.DataFrame:
        found = [(d.min(), d.max()) for d in each(*sides) if len(d)]
        return pd.DataFrame({"low": [min(x for x, _ in found)], "high": [max(y for _, y in found)]} if found else {"low": [], "high": []}, dtype=float)

    tables = _tables(items, m, ident, value, block_rows)
    low, high = tables(ends, "low double, high double").agg(F.min("low"), F.max("high")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins or 1.0

    def counts(*sides) -> pd.DataFrame:
        n = np.zeros(bins, np.int64)
        for d in each(*sides):
            n += np.bincount(np.minimum((d - low) / width, bins - 1).astype(np.int64), minlength=bins)
        at = np.flatnonzero(n)
        return pd.DataFrame({"bin": at, "n": n[at]})

    counted = tables(counts, "bin long, n long")
    return counted.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("lo", F.lit(low) + F.col("bin") * F.lit(width))


def _stored_histogram(items: DataFrame, measure, bins: int, ident: str, value: str, block_rows: int | None, band: int | None) -> DataFrame:
    """The histogram of a measure that compares every pair once.

    Tasks store their distances in fine cells (equal leading bits, so a cell is an interval) with count, least and greatest.
    The bins follow from the range of all: a cell inside one bin adds its count, and only the values of the cells across
    an edge, less than one an edge, are looked at.
    """

    def shape(i, j, d):
        d = np.sort(d[np.isfinite(d)])
        cell = d.view(np.int64) >> FINE_BITS
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(d)])
        last = np.r_[first[1:], len(d)][: len(first)] - 1
        parts = np.split(d, first[1:]) if len(d) else []
        return pd.DataFrame({"cell": cell[first], "n": last - first + 1, "low": d[first], "high": d[last], "d": pd.Series(parts, dtype=object)})

    fine = core.cut_lineage(_run(items, measure, ident, value, block_rows, shape, "cell long, n long, low double, high double, d array<double>", band))
    cells = core.cut_lineage(fine.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")))
    low, high = cells.agg(F.min("low"), F.max("high")).first()
    if low is None:
        low = high = 0.0
    width = (high - low) / bins or 1.0

    def bin_of(d):
        return F.least(F.floor((F.col(d) - F.lit(low)) / F.lit(width)), F.lit(bins - 1).cast("long"))

    placed = cells.select("cell", "n", bin_of("low").alias("bin"), bin_of("high").alias("to"))
    across = F.broadcast(placed.where("bin <> to").select("cell"))  # fewer than ``bins`` cells
    looked = fine.join(across, "cell").select(F.explode("d").alias("d")).select(bin_of("d").alias("bin"), F.lit(1).cast("long").alias("n"))
    whole = placed.where("bin = to").select("bin", "n")
    return whole.unionByName(looked).groupBy("bin").agg(F.sum("n").alias("n")).withColumn("lo", F.lit(low) + F.col("bin") * F.lit(width))


def sorted_distances(edges: DataFrame) -> DataFrame:
    """Edges in rising order of distance with their position, without one global task.

    The edges are computed and written once. Counts of equal-width cells of the distance then tell how many edges come before
    any range of cells, so one shuffle of the ranges is all: a range is sorted in its task and numbered from there.
    """
    names, spark = edges.columns, edges.sparkSession
    path = f"{core.shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    edges.write.parquet(path)
    stored = spark.read.schema(edges.schema).parquet(path)
    n, least, most, odd = stored.agg(
        F.count(F.lit(1)), F.min("d"), F.max("d"), F.count(F.when(F.col("d").isNull() | F.isnan("d") | (F.abs("d") == np.inf), 1))
    ).first()
    width = 0.0 if odd or n <= core.MAX_ROWS else float((most - least) / DISTANCE_CELLS)
    if width > 0:
        cell = F.floor((F.col("d") - F.lit(least)) / F.lit(width)).cast("long")
        held = dict(stored.groupBy(cell.alias("cell")).count().collect())  # at most DISTANCE_CELLS + 1 rows
        ranges, part, rows, before = [], 0, 0, 0
        for c in sorted(held):
            if rows and rows + held[c] > core.MAX_ROWS:
                part, before, rows = part + 1, before + rows, 0
            ranges.append((c, part, before))
            rows += held[c]
        if max(held.values()) <= LARGEST_RANGE * core.MAX_ROWS:
            ranged = stored.withColumn("_cell", cell).join(F.broadcast(spark.createDataFrame(ranges, "_cell long, _part int, _before long")), "_cell").drop("_cell")
            laid = ranged.repartitionById(part + 1, F.col("_part")).sortWithinPartitions("d", "i", "j")
            place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in the partition, which holds one range
            return laid.select(*names, (place + F.col("_before")).alias("position"))
    ranked = core.order_log(stored.withColumn("_one", F.lit(0)), ["_one"], ["d", "i", "j"], step="position")
    return ranked.df.drop("_one")


def warp_path(a: np.ndarray, b: np.ndarray, band: int | None = None) -> tuple[float, np.ndarray]:
    """(distance, steps (i, j) from 0) of the cheapest alignment, diagonal steps first on ties, then those along ``a``.

    Costs are kept for three anti-diagonals; of every cell inside the band only the direction it was reached from stays, one
    byte. A band too narrow for the lengths gives infinity and no steps.
    """
    n, m = len(a), len(b)
    wide = max(n, m) if band is None else band
    if not n or not m or abs(n - m) > wide:
        return np.inf, np.empty((0, 2), np.int64)
    two, one = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # by i, of the diagonals i + j = k - 2 and k - 1
    two[0] = 0.0
    ways: list[tuple[int, np.ndarray]] = []
    for k in range(2, n + m + 1):
        low, high = max(1, k - m, -((wide - k) // 2)), min(n, k - 1, (k + wide) // 2)
        now = np.full(n + 1, np.inf)
        if low <= high:
            i = np.arange(low, high + 1)
            off = a[i - 1] - b[k - i - 1]
            best, way = two[low - 1 : high].copy(), np.zeros(len(i), np.uint8)
            for number, other in ((1, one[low - 1 : high]), (2, one[low : high + 1])):
                less = other < best
                best[less], way[less] = other[less], number
            now[low : high + 1] = np.sqrt((off * off).sum(axis=1)) + best
            ways.append((low, way))
        else:
            ways.append((low, np.empty(0, np.uint8)))
        two, one = one, now
    steps, i, j = [], n, m
    while True:
        steps.append((i - 1, j - 1))
        if i == 1 and j == 1:
            break
        low, way = ways[i + j - 2]
        move = way[i - low]
        i, j = i - (move != 2), j - (move != 1)
    return float(one[n]), np.array(steps[::-1], np.int64)


def alignment_paths(pairs: DataFrame, a: str = "points_a", b: str = "points_b", keep: Iterable[str] = ("i", "j"), band: int | None = None) -> DataFrame:
    """Optimal warping path of each given pair: ``path`` array<struct<i,j>> (0-based) and its cost ``d``.

    One pair is aligned at a time, in memory of a byte for each cell inside the band. A pair that the band does not admit has
    an empty path and an infinite ``d``.
    """
    keep = list(keep)
    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches):
        for pdf in batches:
            found = [warp_path(x, y, band) for x, y in zip(_decode(pdf[a], False), _decode(pdf[b], False))]
            yield pdf[keep].assign(path=[[{"i": i, "j": j} for i, j in steps.tolist()] for _, steps in found], d=[d for d, _ in found])

    return core.spread(pairs.select(*keep, flat(a).alias(a), flat(b).alias(b)), *keep).mapInPandas(work, f"{kinds}, path array<struct<i:bigint,j:bigint>>, d double")


def with_points(edges: DataFrame, items: DataFrame, ident: str = "traj_id", value: str = "points") -> DataFrame:
    """Edges with both ends' points."""
    a = items.select(F.col(ident).alias("i"), F.col(value).alias("points_a"))
    b = items.select(F.col(ident).alias("j"), F.col(value).alias("points_b"))
    return edges.join(a, "i").join(b, "j")
