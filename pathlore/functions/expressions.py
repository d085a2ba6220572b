"""Column expressions shared by the operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the maze and the game rules.
HOUSE_X = (-3.5, 3.5)
HOUSE_Y = (-2.5, 1.5)
HOUSE_CENTRE = (0.0, -0.5)
X_BOUNDS = (-13.5, 13.5)
Y_BOUNDS = (-16.5, 13.5)
GRID_COLUMNS, GRID_ROWS = 28, 31
TUNNEL = ((-13.5, -0.5), (13.5, -0.5))
DEAD_STATES = (0, 4)
ENTITIES = (1, 2, 3, 4)
INF = float("inf")


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: Column) -> Column:
    """Round half to even without a negative zero."""
    return F.rint(c) + F.lit(0.0)


def half_unit(c: Column) -> Column:
    """Nearest half-unit grid line as an integer (2 x coordinate)."""
    return F.rint(c * 2).cast("long")


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def manhattan(x1, y1, x2, y2) -> Column:
    return F.abs(as_col(x1) - as_col(x2)) + F.abs(as_col(y1) - as_col(y2))


# Per-entity rules are SQL text: one expression parsed at once instead of dozens of column calls.


def inside_house_sql(g: int) -> str:
    """Entity g strictly inside the house box."""
    (x0, x1), (y0, y1) = HOUSE_X, HOUSE_Y
    return f"(Ghost{g}_X > {x0}D AND Ghost{g}_X < {x1}D AND Ghost{g}_Y > {y0}D AND Ghost{g}_Y < {y1}D)"


def is_live_sql(g: int) -> str:
    """Entity g is neither dead / returning nor inside the house."""
    return f"(ghost{g}_state NOT IN {DEAD_STATES} AND NOT {inside_house_sql(g)})"


def entity_distance_sql(g: int) -> str:
    return f"(abs(Pacman_X - Ghost{g}_X) + abs(Pacman_Y - Ghost{g}_Y))"


def is_live(g: int) -> Column:
    return F.expr(is_live_sql(g))


def live_distance(g: int) -> Column:
    """Manhattan distance to entity g, infinity unless it is live."""
    return F.expr(f"CASE WHEN {is_live_sql(g)} THEN {entity_distance_sql(g)} ELSE double('Infinity') END")


def quadrant_index(x: str = "Pacman_X", y: str = "Pacman_Y") -> Column:
    """0 top-left, 1 top-right, 2 bottom-right, 3 bottom-left; NULL where no rule applies."""
    return F.expr(
        f"""CASE WHEN isnan({x}) OR isnan({y}) THEN NULL WHEN {x} < 0 AND {y} > 0 THEN 0 WHEN {x} >= 0 AND {y} >= 0 THEN 1
        WHEN {x} > 0 AND {y} < 0 THEN 2 WHEN {x} <= 0 AND {y} <= 0 THEN 3 END"""
    )


def grid_index(c: Column, origin: float, cells: int) -> Column:
    """Nearest cell of a unit grid that starts at ``origin``; ties take the lower cell."""
    raw = F.ceil(c - F.lit(origin) - F.lit(0.5))
    return F.greatest(F.least(raw, F.lit(cells - 1)), F.lit(0)).cast("long")


def grid_x(x="Pacman_X") -> Column:
    return grid_index(as_col(x), X_BOUNDS[0], GRID_COLUMNS)


def grid_y(y="Pacman_Y") -> Column:
    return grid_index(as_col(y), Y_BOUNDS[0], GRID_ROWS)


def row_sum(items: Sequence[Column | str]) -> Column:
    """Sum that skips NULL and NaN."""
    total = F.lit(0.0)
    for item in items:
        c = as_col(item).cast("double")
        total = total + F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return total


def uniform(*parts, seed: int = 0) -> Column:
    """Hash-based uniform number in [0, 1): the same row gets the same number on any partitioning."""
    h = F.xxhash64(F.lit(seed), *[as_col(p) for p in parts])
    return F.pmod(h, F.lit(2**31)).cast("double") / F.lit(float(2**31))


# Fixed values of the portable row hash.
MIX_A, MIX_C, MIX_M, MIX_SHIFT = 1103515245, 12345, 2**31, 15


def mixed_uniform(parts: Sequence[Column | str], seed: int = 0) -> Column:
    """Uniform number in [0, 1) from integer ids: plain arithmetic, so other engines can repeat it."""
    h: Column = F.lit(seed % MIX_M).cast("long")
    for part in [*parts, F.lit(0)]:
        mixed = (h.bitwiseXOR(F.pmod(as_col(part).cast("long"), F.lit(MIX_M).cast("long")))) * MIX_A + MIX_C
        mixed = F.pmod(mixed, F.lit(MIX_M).cast("long"))
        h = mixed.bitwiseXOR(F.shiftright(mixed, MIX_SHIFT))
    return h.cast("double") / float(MIX_M)


def mixed_uniform_sql(parts: Sequence[str], seed: int = 0) -> str:
    """The same number as SQL text."""
    h = f"{seed % MIX_M}::BIGINT"
    for part in [*parts, "0"]:
        mixed = f"((xor({h}, ((({part})::BIGINT % {MIX_M}) + {MIX_M}) % {MIX_M})) * {MIX_A} + {MIX_C}) % {MIX_M}"
        h = f"xor({mixed}, ({mixed}) >> {MIX_SHIFT})"
    return f"({h})::DOUBLE / {MIX_M}.0::DOUBLE"
