"""Ordered-log primitives that every other operator is built from.

An ``OrderedLog`` is a DataFrame whose rows carry a dense position ``step`` (0, 1, ...) inside their key.
Two physical strategies exist and are chosen from a measured bound, never assumed:

* ``block is None``: every key was counted and holds at most ``max_rows`` rows, so an ordinary window
  partitioned by the key is safe and all windows of a plan share one exchange and one sort;
* ``block = B``: at least one key is larger. Windows are partitioned by (key, step div B), which bounds
  the rows of one task by B whatever the skew. Running aggregates receive a carry from the per-block
  totals, and bounded look-around (lag / lead) receives a halo of neighbouring rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

MAX_ROWS = 1 << 20  # rows of one key that a single window task may sort
ATTACH_BUCKET = 256  # steps per equi-join bucket of an interval join

SMALL_BYTES = 64 << 20  # estimated size up to which all rows are counted before the rows of each key
REMEMBERED = 1024  # measured peaks kept by a session

_peaks: dict[tuple, int] = {}


@dataclass(frozen=True)
class OrderedLog:
    """Rows with a dense per-key position; see the module docstring for ``block``."""

    df: DataFrame
    key: tuple[str, ...]
    step: str = "step"
    block: int | None = None

    def having(self, df: DataFrame) -> "OrderedLog":
        """The same log after a row-preserving change of columns (or a filter, for ``running`` only)."""
        return replace(self, df=df)

    def blocks(self) -> list[Column]:
        return [] if self.block is None else [block_of(F.col(self.step), self.block)]


def block_of(step: Column, size: int) -> Column:
    return F.floor(step / F.lit(size)).cast("long")


def peak_rows(df: DataFrame, groups: Sequence[Column]) -> int:
    """Largest number of rows in one group: a map-side combined count, one number to the driver."""
    named = [g.alias(f"_g{i}") for i, g in enumerate(groups)]
    row = df.select(*named).groupBy(*[f"_g{i}" for i in range(len(named))]).count().agg(F.max("count")).first()
    return row[0] or 0


def _key_peak(df: DataFrame, key: Sequence[str], max_rows: int) -> int:
    """``peak_rows`` per key, or the number of all rows where that is small enough already, which needs no shuffle by key.

    Remembered per logical plan, its files and their size; it steers the strategy, not the result.
    """
    narrow = df.select(*key)
    size = int(str(narrow._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    ident = (df.sparkSession.sparkContext.applicationId, narrow.semanticHash(), tuple(key), max_rows, size, tuple(sorted(narrow.inputFiles())))
    if ident not in _peaks:
        if len(_peaks) >= REMEMBERED:
            _peaks.clear()
        rows = narrow.count() if size <= SMALL_BYTES else None
        _peaks[ident] = rows if rows is not None and rows <= max_rows else peak_rows(df, [F.col(k) for k in key])
    return _peaks[ident]


HOT_KEYS = 4096  # up to so many hot keys travel to every task; more are joined by a shuffle


def split_hot(df: DataFrame, key: Sequence[str], max_rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows of keys with at most ``max_rows`` rows, rows of the others)."""
    names = [f"_h{i}" for i in range(len(key))]
    counted = df.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names)]).agg(F.count(F.lit(1)).alias("_rows"))
    hot = cut_lineage(counted.where(F.col("_rows") > max_rows).drop("_rows"))  # at most rows / max_rows of them
    if hot.count() <= HOT_KEYS:
        hot = F.broadcast(hot)
    same = null_safe(df, hot, list(zip(key, names)))
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def laid_out(df: DataFrame, key: Sequence[str], order: Sequence[str], max_rows: int, step: str) -> DataFrame:
    """``df`` with ``step``, by sampled ranges of (key, order) of about half ``max_rows`` rows each; written once.

    The cuts compare the values in their own types, so NULL, NaN, infinities, strings and wide integers keep their order. A
    row's place in its sorted range is written with it; the rows of earlier ranges of its key come from one small table. Rows
    that tie in all order columns share a range.
    """
    parts = max(2, -(-2 * df.count() // max_rows))
    laid = df.repartitionByRange(parts, *key, *order).sortWithinPartitions(*key, *order)
    laid = cut_lineage(laid.withColumns({"_cell": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    held = laid.groupBy(*key, "_cell").agg(F.count(F.lit(1)).alias("_held"), F.min("_at").alias("_first"))
    along = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ahead = held.select(
        *[F.col(k).alias(f"_r{k}") for k in key], F.col("_cell").alias("_rcell"), (F.coalesce(F.sum("_held").over(along), F.lit(0)) - F.col("_first")).alias("_ahead")
    )
    ahead = cut_lineage(ahead)  # a row a range, one more for each key that begins inside one
    if ahead.count() <= HOT_KEYS:
        ahead = F.broadcast(ahead)
    joined = laid.join(ahead, null_safe(laid, ahead, [*[(k, f"_r{k}") for k in key], ("_cell", "_rcell")]))
    return joined.select(*[c for c in df.columns if c != step], (F.col("_at") + F.col("_ahead")).alias(step))


def order_log(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    step: str = "step",
    max_rows: int | None = None,
) -> OrderedLog:
    """Attach ``step`` = 0-based position of the row inside its key under the total order ``order``.

    Keys of at most ``max_rows`` rows are numbered by a window, whatever the others hold; only the rows of larger keys are
    laid out by ranges and written.
    """
    key, max_rows = tuple(key), max_rows or MAX_ROWS
    number = (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).cast("long")
    if _key_peak(df, key, max_rows) <= max_rows:
        return OrderedLog(df.withColumn(step, number), key, step, None)
    cold, hot = split_hot(df, key, max_rows)
    numbered = cold.withColumn(step, number).select(*[c for c in df.columns if c != step], step)
    return OrderedLog(numbered.unionByName(laid_out(hot, key, order, max_rows, step)), key, step, max_rows)


def assume_steps(df: DataFrame, key: Sequence[str], step: str = "step", max_rows: int | None = None) -> OrderedLog:
    """A log whose dense ``step`` was stored by an earlier job."""
    key, max_rows = tuple(key), max_rows or MAX_ROWS
    return OrderedLog(df, key, step, None if _key_peak(df, key, max_rows) <= max_rows else max_rows)


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, carried: Column, local: Column) -> Column:
    if kind == "min":
        return F.least(carried, local)  # least / greatest skip NULL
    if kind == "max":
        return F.greatest(carried, local)
    return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def running(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, Column]],
    cells: Sequence[Column] = (),
    *,
    reverse: bool = False,
    exclusive: bool = False,
) -> DataFrame:
    """Running sum / min / max per key, split by ``cells`` (order-preserving, may be empty).

    With cells: a window per (key, cell), plus the carry of all earlier cells from their totals. Only one
    row per cell goes through the key-wide window.
    """
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    last = -1 if exclusive else 0
    if not cells:
        w = Window.partitionBy(*key).orderBy(*map(direction, order)).rowsBetween(Window.unboundedPreceding, last)
        return df.withColumns({n: _AGG[k](v).over(w) for n, (k, v) in aggs.items()})
    names = [f"_c{i}" for i in range(len(cells))]
    parts = df.withColumns({n: c for n, c in zip(names, cells)}).withColumns(
        {f"_v_{n}": v for n, (_, v) in aggs.items()}
    )
    group = [*key, *names]
    w = Window.partitionBy(*group).orderBy(*map(direction, order)).rowsBetween(Window.unboundedPreceding, last)
    local = parts.withColumns({f"_l_{n}": _AGG[k](f"_v_{n}").over(w) for n, (k, _) in aggs.items()})
    totals = parts.groupBy(*group).agg(*[_AGG[k](f"_v_{n}").alias(f"_t_{n}") for n, (k, _) in aggs.items()])
    over = Window.partitionBy(*key).orderBy(*map(direction, names)).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(g).alias(f"_r{g}") for g in group],
        *[_AGG[k](f"_t_{n}").over(over).alias(f"_k_{n}") for n, (k, _) in aggs.items()],
        F.lag(F.lit(True)).over(Window.partitionBy(*key).orderBy(*map(direction, names))).alias("_later"),
    ).where("_later").drop("_later")  # keys of one cell carry nothing
    joined = local.join(carry, null_safe(local, carry, [(g, f"_r{g}") for g in group]), "left")
    keep = [c for c in df.columns if c not in aggs]
    return joined.select(
        *keep, *[_merge(k, F.col(f"_k_{n}"), F.col(f"_l_{n}")).alias(n) for n, (k, _) in aggs.items()]
    )


def running_steps(log: OrderedLog, aggs: Mapping[str, tuple[str, Column]], **how) -> DataFrame:
    """``running`` in step order. Steps may have gaps."""
    return running(log.df, log.key, [log.step], aggs, log.blocks(), **how)


def near(log: OrderedLog, reach: int, build: Callable[[WindowSpec], Mapping[str, Column]]) -> DataFrame:
    """Window columns that look at most ``reach`` rows back or ahead (dense steps required).

    Blocked logs copy the rows within ``reach`` of a block edge into the neighbouring block.
    """
    if log.block is None:
        return log.df.withColumns(dict(build(Window.partitionBy(*log.key).orderBy(log.step))))
    size = max(log.block, reach)
    step = F.col(log.step)
    own = block_of(step, size)
    copies = log.df.withColumn(
        "_b", F.explode(F.array_distinct(F.array(own, block_of(F.greatest(step - reach, F.lit(0)), size), block_of(step + reach, size))))
    )
    w = Window.partitionBy(*log.key, "_b").orderBy(log.step)
    return copies.withColumns(dict(build(w))).where(F.col("_b") == own).drop("_b")


def attach_totals(df: DataFrame, key: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Per-group aggregates on every row: combine before the shuffle, then join the one-row-per-group side.

    Unlike an unordered window this never gathers a group; a hot key is split by the skew join.
    """
    if not key:
        return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in aggs.items()])))  # exactly one row
    totals = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in key]).agg(*[c.alias(n) for n, c in aggs.items()])
    joined = df.join(totals, null_safe(df, totals, [(k, f"_k_{k}") for k in key]), "left")
    return joined.drop(*[f"_k_{k}" for k in key])


def total_steps(log: OrderedLog, aggs: Mapping[str, Column]) -> DataFrame:
    """Per-key aggregates on every row; reuses the window exchange when keys are known to be small."""
    if log.block is None:
        w = Window.partitionBy(*log.key)
        return log.df.withColumns({n: c.over(w) for n, c in aggs.items()})
    return attach_totals(log.df, log.key, aggs)


def flag_runs(
    log: OrderedLog,
    flag: Column,
    *,
    keep_first: bool = False,
    keep_open: bool = True,
    carry: Sequence[str] = (),
    aggs: Mapping[str, Column] | None = None,
    split_after: Column | None = None,
) -> DataFrame:
    """Maximal runs of rows where ``flag`` holds.

    One row per run: ``run`` (1, 2, ... over all runs of the key), ``start_step``, ``last_step`` (last
    flagged row), ``end_step`` (first row after the run, or the last row when still open), ``n_rows``,
    ``is_open``. For each name in ``carry``: ``start_<name>`` and ``end_<name>`` at those rows. ``aggs``
    are extra aggregates over the flagged rows. ``keep_first`` keeps a run active on row 0. A run also ends
    with a row where ``split_after`` holds.
    """
    step = log.step
    split = F.lit(False) if split_after is None else F.coalesce(split_after, F.lit(False))
    flagged = log.having(log.df.withColumns({"_f": F.coalesce(flag, F.lit(False)), "_x": split}))
    seen = near(
        flagged,
        1,
        lambda w: {
            "_p": F.lag(F.col("_f") & ~F.col("_x")).over(w),
            "_n": F.lead(step).over(w),
            **{f"_e_{c}": F.coalesce(F.lead(c).over(w), F.col(c)) for c in carry},
        },
    )
    marked = seen.withColumn("_s", (F.col("_f") & ~F.coalesce(F.col("_p"), F.lit(False))).cast("long"))
    numbered = running_steps(log.having(marked), {"run": ("sum", F.col("_s"))}).where("_f")
    runs = numbered.groupBy(*log.key, "run").agg(
        F.min(step).alias("start_step"),
        F.max(step).alias("last_step"),
        F.max(F.coalesce(F.col("_n"), F.col(step))).alias("end_step"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.col("_n").isNull()).alias("is_open"),
        *[F.min_by(c, step).alias(f"start_{c}") for c in carry],
        *[F.max_by(f"_e_{c}", step).alias(f"end_{c}") for c in carry],
        *[c.alias(n) for n, c in (aggs or {}).items()],
    )
    if not keep_first:
        runs = runs.where("start_step > 0")
    return runs if keep_open else runs.where(~F.col("is_open"))


def key_bounds(log: OrderedLog, carry: Sequence[str] = ()) -> DataFrame:
    """First and last step of each key (plus the values of ``carry`` there)."""
    return log.df.groupBy(*log.key).agg(
        F.min(log.step).alias("first_step"),
        F.max(log.step).alias("final_step"),
        *[F.min_by(c, log.step).alias(f"first_{c}") for c in carry],
        *[F.max_by(c, log.step).alias(f"final_{c}") for c in carry],
    )


def widen(runs: DataFrame, key: Sequence[str], before: int, after: int, bounds: DataFrame) -> DataFrame:
    """Grow each interval by context rows, clamped to the first and last step of its key."""
    clamped = runs.join(bounds.select(*key, "first_step", "final_step"), list(key))
    return clamped.withColumns(
        {
            "start_step": F.greatest(F.col("start_step") - before, F.col("first_step")),
            "end_step": F.least(F.col("end_step") + after, F.col("final_step")),
        }
    ).drop("first_step", "final_step")


def range_attach(
    runs: DataFrame,
    df: DataFrame,
    key: Sequence[str],
    lo: str = "start_step",
    hi: str = "end_step",
    step: str = "step",
    bucket: int = ATTACH_BUCKET,
) -> DataFrame:
    """Rows of ``df`` inside each interval [lo, hi] of the same key, with ``run_step`` counted from ``lo``.

    An interval join as an equi-join on (key, step bucket): each row falls in one bucket, each interval is
    repeated once per bucket it covers, so a hot key spreads over many join partitions.
    """
    spans = runs.withColumn(
        "_bucket", F.explode(F.sequence(block_of(F.col(lo), bucket), block_of(F.col(hi), bucket)))
    )
    rows = df.withColumn("_bucket", block_of(F.col(step), bucket))
    joined = spans.join(rows, [*key, "_bucket"]).where(F.col(step).between(F.col(lo), F.col(hi)))
    return joined.withColumn("run_step", F.col(step) - F.col(lo)).drop("_bucket")


def coalesce_gaps(
    log: OrderedLog,
    start: str,
    end: str,
    max_gap: int,
    sums: Sequence[str] = (),
    lasts: Sequence[str] = (),
    firsts: Sequence[str] = (),
) -> DataFrame:
    """Merge intervals of a key whose gap ``start - previous end`` is at most ``max_gap``.

    ``log.step`` must be the interval start. Sums add up, ``lasts`` come from the last merged interval.
    """
    seen = running_steps(log, {"_pe": ("max", F.col(end))}, exclusive=True)
    fresh = (F.col("_pe").isNull() | (F.col(start) - F.col("_pe") > max_gap)).cast("long")
    grouped = running_steps(log.having(seen), {"group_no": ("sum", fresh)})
    return grouped.groupBy(*log.key, "group_no").agg(
        F.count(F.lit(1)).alias("n_merged"),
        F.min(start).alias(start),
        F.max(end).alias(end),
        *[F.sum(c).alias(c) for c in sums],
        *[F.max_by(c, start).alias(c) for c in lasts],
        *[F.min_by(c, start).alias(c) for c in firsts],
    )


def point_events(log: OrderedLog, lagged: Sequence[str], events: Mapping[str, Column]) -> DataFrame:
    """Rows where a condition on the row and its predecessor holds.

    Conditions refer to the previous row as ``prev_<name>``; output is one row per (row, event) with the
    event's name in ``entity``. The first row of a key has no predecessor and never fires.
    """
    seen = near(log, 1, lambda w: {f"prev_{c}": F.lag(c).over(w) for c in lagged})
    hits = F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in events.items()]), lambda e: e.isNotNull())
    return seen.withColumn("entity", F.explode(hits)).drop(*[f"prev_{c}" for c in lagged])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by keys into several tasks per core, for stages whose work is in Python.

    Their shuffles are small in bytes but long in time, so partitions must not be merged by size; an explicit
    partition number keeps them apart.
    """
    spark = df.sparkSession
    wanted = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted, *keys)


BATCH_BYTES = 1 << 20  # rows that a Python function gets at a time; a larger row is a batch of its own
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python functions some ``BATCH_BYTES`` at a time, if it names no limit itself."""
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, BATCH_BYTES)


def group_starts(columns: list[pa.Array]) -> np.ndarray:
    """Places of the rows whose key differs from that of the row before; the first row is one."""
    starts = np.zeros(len(columns[0]), bool)
    starts[:1] = True
    for c in columns:
        a, b = c.slice(1), c.slice(0, max(0, len(c) - 1))
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(c.type):
            other &= ~pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False).to_numpy(zero_copy_only=False)
        none = pc.is_null(c).to_numpy(zero_copy_only=False)
        starts[1:] |= other | (none[1:] != none[:-1])
    return np.flatnonzero(starts)


def whole_groups(batches: Iterator[pa.RecordBatch], key: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by ``key`` as tables of whole groups, with the places where a group begins; the last group of a batch
    waits for the next one."""
    def ready(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        return rows, group_starts([rows.column(k).combine_chunks() for k in key])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = group_starts([batch.column(k) for k in key])
        if held:
            seam = [pa.concat_arrays([held[-1].column(k).slice(held[-1].num_rows - 1), batch.column(k).slice(0, 1)]) for k in key]
            starts = starts if len(group_starts(seam)) > 1 else starts[1:]
        if len(starts):
            if held or starts[-1]:
                yield ready([*held, batch.slice(0, starts[-1])])
            held, batch = [], batch.slice(starts[-1])
        held.append(batch)
    if held:
        yield ready(held)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors of the session share: the one it names, or on one machine one of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not folder:
            if not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pathlore-checkpoint-")  # one machine, one process
        sc.setCheckpointDir(folder)
    return (folder or sc.getCheckpointDir()).rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names; iterative operators call it between rounds."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def greedy_intervals(
    log: OrderedLog, end: str, max_island: int = 4096
) -> DataFrame:
    """Keep, per key, the first interval and then always the next one starting after the kept one's end.

    ``log.step`` is the start; ends must not decrease with the start. An interval that begins after every
    earlier end is kept whatever happened before, so it opens an independent island: islands are folded on
    their own. Islands above ``max_island`` intervals follow next-pointers by doubling instead.
    """
    key, start = list(log.key), log.step
    seen = running_steps(log, {"_pe": ("max", F.col(end))}, exclusive=True)
    head = F.col("_pe").isNull() | (F.col(start) > F.col("_pe"))
    isles = running_steps(
        log.having(seen.withColumn("_h", head.cast("long"))), {"_isle": ("sum", F.col("_h"))}
    ).drop("_pe")
    group = [*key, "_isle"]
    if log.block is not None and peak_rows(isles, [F.col(c) for c in group]) > max_island:
        return _greedy_by_doubling(log, isles, end)
    # The single row that opens an island needs no fold.
    wide = isles.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias("_a")
    )
    none = F.expr("cast(array() as array<bigint>)")
    first = F.struct(
        F.lit(-(2**62)).cast("long").alias("busy"), F.expr("cast(array() as array<array<bigint>>)").alias("done"),
        none.alias("cur"),
    )

    def visit(acc, c):  # accepted starts go into chunks so that appending stays cheap on long islands
        full = F.size(acc["cur"]) >= 256
        return F.when(
            c["s"] > acc["busy"],
            F.struct(
                c["e"].alias("busy"),
                F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
                F.when(full, F.array(c["s"])).otherwise(F.concat(acc["cur"], F.array(c["s"]))).alias("cur"),
            ),
        ).otherwise(acc)

    folded = F.aggregate("_a", first, visit, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["cur"]))))
    kept = wide.select(
        *key, F.explode(F.when(F.size("_a") == 1, F.array(F.col("_a")[0]["s"])).otherwise(folded)).alias(start)
    )
    return log.df.join(kept, [*key, start], "left_semi")


def _greedy_by_doubling(log: OrderedLog, isles: DataFrame, end: str) -> DataFrame:
    key, start = list(log.key), log.step
    isles = cut_lineage(isles.select(*key, start, end, "_h"))
    # next(s) = first start after end(s): merge starts and queries on one axis and look ahead.
    marks = isles.select(*key, F.col(start).alias("_at"), F.col(start).alias("_start"), F.lit(None).cast("long").alias("_from"))
    asks = isles.select(*key, (F.col(end) + 1).alias("_at"), F.lit(None).cast("long").alias("_start"), F.col(start).alias("_from"))
    axis = marks.unionByName(asks)
    nxt = running(
        axis, key, ["_at", "_start"], {"_to": ("min", F.col("_start"))},
        [] if log.block is None else [block_of(F.col("_at"), log.block)], reverse=True,
    ).where("_from is not null").select(*key, F.col("_from").cast("long"), "_to")
    nxt = cut_lineage(nxt.where("_to is not null"))
    reached = isles.where("_h = 1").select(*key, F.col(start).alias("_from"))
    while True:
        more = reached.join(nxt, [*key, "_from"]).select(*key, F.col("_to").alias("_from"))
        grown = cut_lineage(reached.unionByName(more).distinct())
        hop = nxt.select(*key, F.col("_from").alias("_to"), F.col("_to").alias("_to2"))
        nxt = cut_lineage(nxt.join(hop, [*key, "_to"]).select(*key, "_from", F.col("_to2").alias("_to")))
        reached = grown
        if nxt.isEmpty():
            break
    return log.df.join(reached.withColumnRenamed("_from", start), [*key, start], "left_semi")
