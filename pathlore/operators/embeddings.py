"""Data side of sequence models: masked error, pooling, batch embedding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions.expressions import mixed_uniform
from pathlore.operators import core

LOWEST = -3.4028234663852886e38  # smallest float32, the pooled maximum of a sequence without valid steps


def masked_mse(df: DataFrame, by: Sequence[str] = (), x: str = "x", x_hat: str = "x_hat", masks: Sequence[str] = ()) -> DataFrame:
    """Mean squared error over the rows where every boolean mask holds; the divisor is at least 1."""
    weight: Column = F.lit(1.0)
    for m in masks:
        weight = weight * F.col(m).cast("double")
    valid = weight > 0
    error = F.when(valid, (F.col(x_hat) - F.col(x)) * (F.col(x_hat) - F.col(x)))
    total = F.coalesce(F.sum(error), F.lit(0.0)) / (F.greatest(F.sum(weight), F.lit(1.0)) + 1e-8)
    return df.groupBy(*by).agg(total.alias("mse"))


def sample_ids(ids: DataFrame, ident: str, fraction: float, seed: int = 0) -> DataFrame:
    """Exactly max(1, floor(fraction x n)) ids, the smallest by seeded hash."""
    hashed = ids.select(ident).distinct().withColumns({"_one": F.lit(0), "_u": mixed_uniform([ident], seed)})
    log = core.order_log(hashed, ["_one"], ["_u", ident], step="_pos")
    counted = core.total_steps(log, {"_n": F.count(F.lit(1))})
    return counted.where(F.col("_pos") < F.greatest(F.floor(F.col("_n") * fraction), F.lit(1))).select(ident)


def sampled_error(df: DataFrame, ident: str, fraction: float = 0.1, seed: int = 0, **how) -> DataFrame:
    chosen = sample_ids(df, ident, fraction, seed)
    return masked_mse(df.join(chosen, ident, "left_semi"), **how)


def pool_steps(df: DataFrame, seq: Sequence[str], features: Sequence[str], how: str, valid: Column | None = None,
               step: str = "step") -> DataFrame:
    """Masked pooling of step vectors per sequence: mean, sum, max, or first."""
    ok = F.lit(True) if valid is None else valid
    n = F.sum(F.when(ok, 1.0).otherwise(0.0))
    rules = {
        "mean": lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0.0)) / F.greatest(n, F.lit(1e-6)),
        "sum": lambda c: F.sum(F.when(ok, F.col(c)).otherwise(0.0)),
        "max": lambda c: F.coalesce(F.max(F.when(ok, F.col(c))), F.lit(LOWEST)),
        "first": lambda c: F.min_by(c, step),
    }
    if how not in rules:
        raise ValueError(f"unknown pooling {how!r}; known: {sorted(rules)}")
    return df.groupBy(*seq).agg(*[rules[how](c).alias(c) for c in features])


def embed(df: DataFrame, column: str, encoder: Callable[[pd.Series], Sequence] | None = None, *, n: int = 2,
          out: str = "embedding") -> DataFrame:
    """Batch embedding of packed sequences (array<double>, padded to one length).

    ``encoder`` gets a pandas Series of arrays and returns one vector per entry; it runs on Arrow batches
    inside the tasks. Without one, the flattened features are reduced by PCA.
    """
    if encoder is None:
        from pathlore.operators.clustering import reduce_dimensions

        return reduce_dimensions(df, column, n, out)[0]

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in encoder(values)])

    return df.withColumn(out, run(column))
