"""Column normalisation: a strategy is an optional set of aggregates plus an expression over them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions.expressions import ENTITIES, INF, X_BOUNDS, Y_BOUNDS
from pathlore.operators import core

EPS = 1.1920928955078125e-07  # smallest span or deviation that counts (float32 machine epsilon)


@dataclass(frozen=True)
class Strategy:
    """``stats``: name -> aggregate over the numeric column. ``apply``: (column, stats) -> normalised column."""

    apply: Callable[[Column, Mapping[str, Column]], Column]
    stats: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)


def numeric(c: Column) -> Column:
    """Double value; text that is no number and NaN count as missing."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def standardize(mean: float | None = None, std: float | None = None) -> Strategy:
    stats = {}
    if mean is None:
        stats["mean"] = F.avg
    if std is None:
        stats["std"] = F.stddev_samp

    def apply(v, s):
        m = F.lit(mean) if mean is not None else s["mean"]
        d = F.lit(std) if std is not None else s["std"]
        return F.coalesce((v - m) / F.when(d > EPS, d).otherwise(F.lit(1.0)), F.lit(0.0))

    return Strategy(apply, stats)


def minmax(lo: float | None = None, hi: float | None = None) -> Strategy:
    stats = {}
    if lo is None:
        stats["lo"] = F.min
    if hi is None:
        stats["hi"] = F.max

    def apply(v, s):
        low = F.lit(float(lo)) if lo is not None else s["lo"]
        high = F.lit(float(hi)) if hi is not None else s["hi"]
        return F.coalesce((v - low) / F.greatest(high - low, F.lit(EPS)), F.lit(0.0))

    return Strategy(apply, stats)


def counter() -> Strategy:
    return minmax()


def binary_flag() -> Strategy:
    return Strategy(lambda v, s: F.greatest(F.least(F.coalesce(v, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


def multistate_flag(max_state: int = 3) -> Strategy:
    return Strategy(
        lambda v, s: F.greatest(F.least(F.coalesce(v, F.lit(0.0)), F.lit(float(max_state))), F.lit(0.0)) / max(max_state, 1)
    )


def position(axis: str, bounds: tuple[float, float] | None = None) -> Strategy:
    known = {"x": X_BOUNDS, "y": Y_BOUNDS}
    if bounds is None and axis not in known:
        raise ValueError(f"unknown axis {axis!r}; known: x, y")
    return minmax(*(bounds or known[axis]))


def distance() -> Strategy:
    """Min-max over finite values; +-inf stays, missing becomes 0; a column without finite values stays as it is."""
    finite = lambda v: F.when(F.abs(v) < INF, v)

    def apply(v, s):
        scaled = (v - s["lo"]) / F.greatest(s["hi"] - s["lo"], F.lit(EPS))
        return F.when(s["lo"].isNull(), v).when(F.abs(v) < INF, scaled).when(v.isNotNull(), v).otherwise(F.lit(0.0))

    return Strategy(apply, {"lo": lambda v: F.min(finite(v)), "hi": lambda v: F.max(finite(v))})


def user_function(fn: Callable[[Column], Column], stats: Mapping[str, Callable[[Column], Column]] | None = None) -> Strategy:
    """A strategy of the user's own: Column -> Column (a pandas_udf works too); with ``stats``, (Column, stats) -> Column."""
    return Strategy((lambda v, s: fn(v, s)) if stats else (lambda v, s: fn(v)), stats or {})


def default_strategies() -> dict[str, Strategy]:
    """Fixed assignment of strategies to the log's columns."""
    found = {c: counter() for c in ("score", "lives", "pellets")}
    found |= {c: binary_flag() for c in ["pacman_attack", "fruitState_1", "fruitState_2"]}
    found |= {f"powerpelletstate_{j}": binary_flag() for j in (1, 2, 3, 4)}
    found |= {f"ghost{g}_state": multistate_flag(3) for g in ENTITIES}
    found |= {f"{who}_X": position("x") for who in ("Pacman", "Ghost1", "Ghost2", "Ghost3", "Ghost4")}
    found |= {f"{who}_Y": position("y") for who in ("Pacman", "Ghost1", "Ghost2", "Ghost3", "Ghost4")}
    found |= {f"Ghost{g}_distance": distance() for g in ENTITIES}
    return found


class Normalizer:
    """Registry of strategies per column."""

    def __init__(self, strategies: Mapping[str, Strategy] | None = None, strict: bool = False):
        self.strategies = dict(default_strategies() if strategies is None else strategies)
        self.strict = strict

    def set(self, column: str, strategy: Strategy) -> "Normalizer":
        self.strategies[column] = strategy
        return self

    def update(self, strategies: Mapping[str, Strategy]) -> "Normalizer":
        self.strategies.update(strategies)
        return self

    def normalize(self, df: DataFrame, scope: Sequence[str] = (), columns: Sequence[str] | None = None,
                  exempt: Sequence[str] = ()) -> DataFrame:
        """Normalise the registered columns of ``df`` over ``scope`` (no column: the whole frame).

        All aggregates of all columns come from one combine-before-shuffle aggregation.
        """
        if columns is not None:
            absent = sorted(set(columns) - set(df.columns))
            if absent:
                raise KeyError(f"columns {absent} are not in the data")
            df = df.select(*dict.fromkeys([*scope, *columns]))
        unknown = sorted(set(df.columns) - set(self.strategies) - set(scope) - set(exempt))
        if unknown and self.strict:
            raise KeyError(f"columns {unknown} have no normalisation strategy")
        chosen = {c: s for c, s in self.strategies.items() if c in df.columns}
        totals = {
            f"_{n}_{c}": agg(numeric(F.col(c))) for c, s in chosen.items() for n, agg in s.stats.items()
        }
        joined = core.attach_totals(df, list(scope), totals) if totals else df
        done = joined.withColumns(
            {
                c: s.apply(numeric(F.col(c)), {n: F.col(f"_{n}_{c}") for n in s.stats}).cast("double")
                for c, s in chosen.items()
            }
        )
        return done.drop(*totals)


def normalize_columns(df: DataFrame, strategies: Mapping[str, Strategy], scope: Sequence[str] = ()) -> DataFrame:
    return Normalizer(strategies).normalize(df, scope)
