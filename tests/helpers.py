from pyspark.sql import functions as F

from pathlore.operators import core

BASE = {
    "level_id": 1, "i": 0, "time_elapsed": 0.0, "lives": 3, "pacman_attack": 0, "powerPellets": 4, "pellets": 244,
    "Pacman_X": 0.5, "Pacman_Y": 10.5,
    **{f"Ghost{g}_X": 12.5 for g in (1, 2, 3, 4)}, **{f"Ghost{g}_Y": -15.5 for g in (1, 2, 3, 4)},
    **{f"ghost{g}_state": 0 for g in (1, 2, 3, 4)},
}
KINDS = {int: "long", float: "double"}


def make_log(spark, rows, **same):
    """An ordered log from partial rows; levels are numbered by position unless given."""
    filled, seen = [], {}
    for r in rows:
        row = {**BASE, **same, **r}
        n = seen.get(row["level_id"], 0)
        seen[row["level_id"]] = n + 1
        row["i"], row["time_elapsed"] = n, n * 0.05
        filled.append(tuple(float(v) if isinstance(BASE[c], float) else v for c, v in ((c, row[c]) for c in BASE)))
    schema = ", ".join(f"{c} {'double' if isinstance(v, float) else 'int' if c not in ('level_id', 'i') else 'long'}" for c, v in BASE.items())
    return core.order_log(spark.createDataFrame(filled, schema), ["level_id"], ["i"])


def tuples(df, *columns):
    return sorted(tuple(r) for r in df.select(*[F.col(c) for c in columns]).collect())
