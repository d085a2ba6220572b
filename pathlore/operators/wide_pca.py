"""Principal components of wide vectors, without a matrix of width x width anywhere.

A block of axes is sharpened in passes over the rows: every pass sends the newest directions to the tasks, which give back
the covariance applied to them, summed in two steps. The driver holds a few dozen vectors of the width (``BASIS`` blocks at
most, then the best are kept) and solves the small problem within them. The passes end when the axes are eigenvectors of the
covariance up to ``tolerance``, or when the directions span all that the rows hold.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 16  # numbers in a row of partial sums
BASIS = 8  # blocks of directions that are held before the best are kept
STEP_BYTES = 1 << 25  # of rows that a task multiplies at once


@dataclass(frozen=True)
class WidePCA:
    """``pc`` (width x n, columns of length 1, largest entry positive), ``mean``, shares of the variance, passes over the rows."""

    pc: np.ndarray
    mean: np.ndarray
    explainedVariance: np.ndarray
    passes: int


def _matrices(batches, width: int):
    """The vectors of Arrow batches as matrices of bounded size; NULL vectors are left out."""
    rows = max(1, STEP_BYTES // (8 * width))
    for pdf in batches:
        for start in range(0, len(pdf), rows):
            found = [v for v in pdf.iloc[start : start + rows, 0] if v is not None]
            if found:
                yield np.asarray(np.stack(found), dtype=float)


def _sum_parts(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[:1].assign(sums=[np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)])


def sum_over_rows(vectors: DataFrame, width: int, size: int, share: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``share`` (matrix of some rows -> ``size`` numbers) over all rows of a one-column frame of arrays."""

    def work(batches):
        total = np.zeros(size)
        for matrix in _matrices(batches, width):
            total += share(matrix)
        task = TaskContext.get().partitionId()
        for part in range(-(-size // PART)):
            yield pd.DataFrame({"part": [part], "task": [task], "sums": [total[part * PART : (part + 1) * PART]]})

    schema = "part int, task int, sums array<double>"
    partial = vectors.mapInPandas(work, schema)
    some = max(1, math.isqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    for bucket in (F.pmod("task", F.lit(some)), F.lit(0)):
        partial = partial.withColumn("task", bucket.cast("int")).groupBy("part", "task").applyInPandas(_sum_parts, schema)
    out = np.zeros(size)
    for row in partial.toLocalIterator():
        out[row["part"] * PART : row["part"] * PART + len(row["sums"])] = row["sums"]
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """Directions of ``block`` that are new to ``basis`` and longer than ``least``."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > least]
    return np.linalg.qr(u - basis @ (basis.T @ u))[0] if u.shape[1] else u


def fit(df: DataFrame, column: str, width: int, n: int, *, extra: int = 8, passes: int = 200, tolerance: float = 1e-11, seed: int = 0) -> WidePCA:
    """The first ``n`` components of the vectors in ``column`` (array<double> of length ``width``; NULL vectors do not count).

    Variances divide by rows - 1. Components beyond the rank of the rows are any unit vectors at right angles to the others.
    A warning says so if the passes end before the axes are settled.
    """
    vectors = df.select(F.col(column))
    first = sum_over_rows(vectors, width, width + 1, lambda x: np.append(x.sum(axis=0), len(x)))
    count = first[-1]
    mean = first[:-1] / max(count, 1.0)
    n, size = min(n, width), min(n + extra, width)
    new = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, size)))[0]
    basis, image = np.empty((width, 0)), np.empty((width, 0))
    context = df.sparkSession.sparkContext
    spread, residual, done = 0.0, np.inf, 0
    least, stalled = np.inf, 0
    while done < passes:
        sent = context.broadcast((mean, new))

        def share(x: np.ndarray) -> np.ndarray:
            centre, directions = sent.value
            x = x - centre
            return np.append((x.T @ (x @ directions)).ravel(), (x * x).sum())

        found = sum_over_rows(vectors, width, width * new.shape[1] + 1, share) / max(count - 1.0, 1.0)
        sent.destroy()
        spread, done = found[-1], done + 1
        basis, image = np.hstack([basis, new]), np.hstack([image, found[:-1].reshape(width, -1)])
        inner = basis.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        best, applied = basis @ turn[:, :size], image @ turn[:, :size]
        off = applied - best * values[:size]
        residual = np.linalg.norm(off[:, :n], axis=0).max(initial=0.0)
        if residual <= tolerance * max(values[0], 0.0) or basis.shape[1] == width:
            residual = 0.0
            break
        least, stalled = (residual, 0) if residual < least / 2 else (least, stalled + 1)
        if stalled >= 6 and residual <= 1e4 * tolerance * max(values[0], 0.0):  # as exact as the sums are
            residual = 0.0
            break
        if basis.shape[1] + size > BASIS * size:
            basis, image = best, applied
        new = _orthonormal(off, basis, 1e-13 * max(values[0], 0.0))[:, : width - basis.shape[1]]
        if not new.shape[1]:
            residual = 0.0
            break
    if residual:
        warnings.warn(f"components not settled after {done} passes: residual {residual:.3g} of a largest variance of {values[0]:.3g}", stacklevel=2)
    axes = best[:, :n]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(n)])
    return WidePCA(axes * np.where(signs == 0, 1.0, signs), mean, np.maximum(values[:n], 0.0) / spread if spread else np.zeros(n), done)


def transform(df: DataFrame, column: str, model: WidePCA, out: str) -> DataFrame:
    """``df`` with the centred scores of its vectors in ``out``; NULL for a NULL vector."""
    sent = df.sparkSession.sparkContext.broadcast((model.mean, model.pc))

    @F.pandas_udf("array<double>")
    def scores(values: pd.Series) -> pd.Series:
        mean, axes = sent.value
        rows = max(1, STEP_BYTES // (8 * len(mean)))
        told: list = []
        for start in range(0, len(values), rows):
            part = values.iloc[start : start + rows]
            kept = [v for v in part if v is not None]
            turned = iter((np.stack(kept) - mean) @ axes) if kept else iter(())
            told += [None if v is None else next(turned) for v in part]
        return pd.Series(told, dtype=object)

    return df.withColumn(out, scores(F.col(column)))
