"""Padding, observation and noise masks in long form; reproducible on any partitioning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions.expressions import INF, is_finite, mixed_uniform
from pathlore.operators import core
from pathlore.operators.core import OrderedLog
from pathlore.operators.slicing import PAD


def padding_mask(features: Sequence[str], pad: float = PAD) -> Column:
    """True where any feature differs from the padding value."""
    return F.exists(F.array(*[F.col(c).cast("double") for c in features]), lambda v: v != pad)


def observation_mask(column: str) -> Column:
    return is_finite(F.col(column))


def replace_inf(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """+-inf becomes the feature's largest finite value over the data set, 0 where none is finite."""
    tops = {f"_m_{c}": F.max(F.when(is_finite(F.col(c)), F.col(c))) for c in features}
    joined = core.attach_totals(df, [], tops)
    return joined.withColumns(
        {c: F.when(F.abs(F.col(c)) == INF, F.coalesce(F.col(f"_m_{c}"), F.lit(0.0))).otherwise(F.col(c)) for c in features}
    ).drop(*tops)


@dataclass(frozen=True)
class NoiseMask:
    """Parameters of the noise mask. True = keep, False = masked."""

    ratio: float = 0.15
    mean_length: int = 3
    mode: str = "separate"
    distribution: str = "geometric"
    exclude: tuple[str, ...] = ()
    seed: int = 0

    def __post_init__(self):
        if self.mode not in ("separate", "concurrent"):
            raise ValueError(f"unknown noise mask mode {self.mode!r}")
        if self.distribution not in ("random", "geometric"):
            raise ValueError(f"unknown noise mask distribution {self.distribution!r}")

    def harder(self) -> "NoiseMask":
        """Next curriculum step."""
        return replace(self, mean_length=min(20, self.mean_length + 1), ratio=min(1.0, self.ratio + 0.05))


def noise_mask(log: OrderedLog, features: Sequence[str], spec: NoiseMask, ids: Sequence[str] | None = None) -> DataFrame:
    """Long form (key..., step, feature, keep) for the given features.

    ``ids`` are the integer columns that identify a sequence for the hash (default: the key).
    """
    ids = list(ids or log.key)
    names = F.array(*[F.struct(F.lit(i).cast("long").alias("no"), F.lit(c).alias("feature")) for i, c in enumerate(features)])
    long = log.df.select(*log.key, log.step, F.explode(names).alias("f")).select(*log.key, log.step, "f.no", "f.feature")
    lane = F.col("no") if spec.mode == "separate" else F.lit(0).cast("long")
    u = mixed_uniform([*ids, log.step, lane], spec.seed)
    if spec.distribution == "random":
        masked = long.withColumn("keep", u >= spec.ratio)
    else:
        masked = _two_state_chain(OrderedLog(long, (*log.key, "feature"), log.step, log.block), u, spec)
    if spec.exclude:
        masked = masked.withColumn("keep", F.col("keep") | F.col("feature").isin(*spec.exclude))
    return masked.drop("no")


def _two_state_chain(log: OrderedLog, u: Column, spec: NoiseMask) -> DataFrame:
    """Two-state Markov chain as running aggregates.

    Each row's transition is a map on {masked, kept}: swap, constant or identity. The state is therefore
    the last constant, flipped once per swap since then.
    """
    if spec.ratio >= 1:
        return log.df.withColumn("keep", F.lit(False))
    leave_masked = 1 / spec.mean_length
    leave_kept = leave_masked * spec.ratio / (1 - spec.ratio)
    low, high = min(leave_masked, leave_kept), max(leave_masked, leave_kept)
    absorbing = 1 if leave_masked > leave_kept else 0
    first = F.col(log.step) == 0
    drawn = log.df.withColumn("_u", u)
    marked = drawn.withColumns(
        {
            "_set": F.when(first, (F.col("_u") > spec.ratio).cast("int")).when(
                (F.col("_u") >= low) & (F.col("_u") < high), absorbing
            ),
            "_swap": (~first & (F.col("_u") < low)).cast("long"),
        }
    )
    swaps = core.running_steps(log.having(marked), {"_swaps": ("sum", F.col("_swap"))})
    anchor = F.when(F.col("_set").isNotNull(), F.struct(F.col(log.step).alias("at"), F.col("_set").alias("to"), F.col("_swaps").alias("n")))
    state = core.running_steps(log.having(swaps), {"_anchor": ("max", anchor)})
    flips = (F.col("_swaps") - F.col("_anchor.n")) % 2
    return state.withColumn("keep", (F.col("_anchor.to") + flips) % 2 == 1).drop("_u", "_set", "_swap", "_swaps", "_anchor")


def split_by_hash(df: DataFrame, ident: str, fraction: float, seed: int = 0) -> DataFrame:
    """``part`` = train for about ``fraction`` of the ids, else test; an id always lands in the same part."""
    return df.withColumn("part", F.when(mixed_uniform([ident], seed) < fraction, "train").otherwise("test"))


def to_time_major(df: DataFrame, channels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Channel arrays (one array per channel) to one row per time step with a column per channel."""
    zipped = F.arrays_zip(*[F.col(c) for c in channels])
    long = df.select(*keep, F.posexplode(zipped).alias("step", "v"))
    return long.select(*keep, F.col("step").cast("long").alias("step"), *[F.col(f"v.{c}").alias(c) for c in channels])
