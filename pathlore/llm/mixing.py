"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in a shuffled order (a hash of the id), a second round after the first. A copy gets a
virtual finish time: the tokens of its source up to its end, divided by the source's target. The copies of all sources
are sorted by that time in ranges and cut where the budget is used up. Running sums over a hot source are made in two
steps: totals of hash ranges, and within a range. There are about as many ranges as the square root of the rows, so
neither step ever has more than a few times that many rows in a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.llm.common import WORD, bounded, scratch, stored, whole_text

ROUNDS = 2  # a document is taken at most this often


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fair_targets(sizes: Mapping[str | None, int], weights: Sequence[float], share: float, most: float = ROUNDS) -> dict[str | None, float]:
    """Tokens to take from each source: ``share`` of all, by weight, never over ``most`` times what the source has.

    Sources go by code point, NULL last; the weights repeat. What a full source cannot take goes to the others by
    weight until none is above its limit.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    left, open_ = share * sum(sizes.values()), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > most * sizes[s]]
        if not full:
            return target | {s: weight[s] * unit for s in open_}
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ = [s for s in open_ if s not in full]
    return target


def _running(df: DataFrame, groups: list[str], cell: str, order: list[Column], size: str, out: str) -> DataFrame:
    """Running total of ``size`` within ``groups`` along (cell, order): totals of cells first, then within each cell."""
    totals = df.groupBy(*groups, cell).agg(F.sum(size).alias("_cell_total"))
    ahead = Window.partitionBy(*groups).orderBy(cell) if groups else Window.partitionBy(F.lit(0)).orderBy(cell)
    carried = totals.withColumn("_carry", F.sum("_cell_total").over(ahead.rowsBetween(Window.unboundedPreceding, -1)))
    within = Window.partitionBy(*groups, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_within", F.sum(size).over(within))
    joined = rows.join(carried.drop("_cell_total"), [*groups, cell])
    return joined.withColumn(out, F.col("_within") + F.coalesce("_carry", F.lit(0))).drop("_within", "_carry")


def mix_plan(docs: DataFrame, weights: Sequence[float], share: float, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(sized rows, taken copies).

    Sized rows: row, id, src, size, source_size, target. Taken copies: row, round (0 or 1) and finish, the virtual
    finish time, in the order of the mix. A source with no words has target 0 and is not taken. NULL sources form one
    source; rows that repeat an id are rows of their own; the same input gives the same mix.
    """
    whole = whole_text(text)
    rows = stored(docs.select(
        F.col(id_col).alias("id"), F.col(source).alias("src"), word_count(whole).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), whole).alias("deal"),
        F.monotonically_increasing_id().alias("row"),
    ))
    per_source = rows.groupBy("src").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # one row a source
    sizes = {r["src"]: r["size"] or 0 for r in per_source}
    targets = fair_targets(sizes, weights, share)
    n_rows = sum(r["n"] for r in per_source)
    goals = docs.sparkSession.createDataFrame(
        [(s, sizes[s], float(targets.get(s, 0.0))) for s in sizes], "src string, source_size long, target double"
    )
    goals = goals.withColumnRenamed("src", "goal_src")
    sized = rows.join(F.broadcast(goals), F.col("src").eqNullSafe(F.col("goal_src"))).drop("goal_src")
    ranges = ranges or isqrt(n_rows) + 1
    share_of_deals = F.col("deal").cast("double") / F.lit(2.0**64) + 0.5  # rises with the deal, so the order is the same for any number of ranges
    live = sized.where("size > 0 and target > 0").withColumn("cell", F.least(F.floor(share_of_deals * ranges).cast("long"), F.lit(ranges - 1).cast("long")))
    live = live.withColumn("lane", F.coalesce(F.concat(F.lit("="), "src"), F.lit("-")))
    summed = _running(live, ["lane"], "cell", [F.col("deal"), F.col("id"), F.col("row")], "size", "done")
    copies = summed.select("*", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1))).alias("round"))
    timed = copies.withColumn("finish", (F.col("done") + F.col("round") * F.col("source_size")) / F.col("target"))
    budget = sum(targets.values())
    # Sources advance in step, so the cut lies near time 1 and the budget spreads evenly over the times before it.
    slices = ROUNDS * ranges
    sliced = timed.withColumn("slice", F.floor(F.col("finish") * slices).cast("long"))
    order = [F.col("finish"), F.col("lane"), F.col("deal"), F.col("id"), F.col("row"), F.col("round")]
    queued = _running(sliced, [], "slice", order, "size", "used")
    return sized, queued.where(F.col("used") <= budget).select("row", "round", "finish", "used")


def mix_counts(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0, ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target of its source, and taken (words the mix takes of it)."""
    sized, queue = mix_plan(docs, weights, share, id_col, source, text, seed, ranges)
    times = queue.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
    return sized.join(times, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.coalesce("times", F.lit(0))).cast("long").alias("taken")
    )


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0, ranges: int | None = None) -> DataFrame:
    """The mix itself: the taken copies with all columns of ``docs`` plus mix_round and mix_time, sorted by mix_time.

    Columns of ``docs`` with those two names are replaced. Rows that repeat id and text are dealt each by itself, as in
    ``mix_counts``; their copies all carry the other columns of one of them. An empty table gives an empty mix, and documents
    without words are not taken.
    """
    docs = docs.drop("mix_round", "mix_time")
    key = scratch(docs, "key")["key"]
    numbered = docs.withColumn(key, F.xxhash64(F.lit(seed + 1), F.col(id_col), whole_text(text)))
    sized, queue = mix_plan(numbered, weights, share, key, source, text, seed, ranges)
    taken = queue.join(sized.select("row", F.col("id").alias(key)), "row").select(key, F.col("round").alias("mix_round"), F.col("finish").alias("mix_time"))
    repeats = stored(sized.groupBy(F.col("id").alias(key)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    n_repeats = repeats.count()
    if n_repeats:  # one row of each repeated document, whatever the number of its rows
        again = bounded(repeats, n_repeats)
        numbered = numbered.join(again, key, "left_anti").unionByName(numbered.join(again, key, "left_semi").dropDuplicates([key]))
    return numbered.join(taken, key).drop(key).orderBy("mix_time", id_col, "mix_round")
