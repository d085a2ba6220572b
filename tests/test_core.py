import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F

from pathlore.operators import core


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def runs_by_hand(flags, keep_first=False, keep_open=True):
    out, i, n = [], 0, len(flags)
    while i < n:
        if flags[i]:
            j = i
            while j + 1 < n and flags[j + 1]:
                j += 1
            is_open = j == n - 1
            if (i > 0 or keep_first) and (keep_open or not is_open):
                out.append((i, j, min(j + 1, n - 1), j - i + 1, is_open))
            i = j
        i += 1
    return out


def test_steps_follow_the_total_order_with_tied_times(spark, strategy):
    rng = random.Random(1)
    rows = [(k, rng.choice([0.0, 0.0, 5.0, 1e6]), i) for i, k in enumerate(rng.choices([1, 1, 1, 2, 3], k=200))]
    log = core.order_log(frame(spark, rows, "k long, t double, i long"), ["k"], ["t", "i"])
    assert (log.block is None) == (strategy == "plain")
    got = {(r.k, r.i): r.step for r in log.df.collect()}
    for k in (1, 2, 3):
        mine = sorted((t, i) for kk, t, i in rows if kk == k)
        assert [got[(k, i)] for _, i in mine] == list(range(len(mine)))


@pytest.mark.parametrize("keep_first,keep_open", [(False, True), (True, False), (True, True)])
def test_flag_runs_match_a_scan(spark, strategy, keep_first, keep_open):
    rng = random.Random(2)
    logs = {k: [rng.random() < 0.6 for _ in range(n)] for k, n in ((1, 40), (2, 9), (3, 1), (4, 13))}
    logs[5] = [True] * 12
    logs[6] = [False] * 6
    rows = [(k, i, f) for k, fs in logs.items() for i, f in enumerate(fs)]
    log = core.order_log(frame(spark, rows, "k long, i long, f boolean"), ["k"], ["i"])
    found = core.flag_runs(log, F.col("f"), keep_first=keep_first, keep_open=keep_open, carry=["i"]).collect()
    for k, fs in logs.items():
        mine = sorted((r.start_step, r.last_step, r.end_step, r.n_rows, r.is_open) for r in found if r.k == k)
        assert mine == runs_by_hand(fs, keep_first, keep_open)
    assert all(r.start_i == r.start_step and r.end_i == r.end_step for r in found)


def test_near_sees_over_block_edges(spark, strategy):
    rows = [(1, i, i * i) for i in range(30)]
    log = core.order_log(frame(spark, rows, "k long, i long, v long"), ["k"], ["i"])
    got = core.near(log, 6, lambda w: {"back": F.lag("v", 6).over(w), "ahead": F.lead("v", 5).over(w)}).collect()
    assert len(got) == 30
    for r in got:
        assert r.back == ((r.i - 6) ** 2 if r.i >= 6 else None)
        assert r.ahead == ((r.i + 5) ** 2 if r.i + 5 < 30 else None)


@pytest.mark.parametrize("reverse,exclusive", [(False, False), (False, True), (True, False), (True, True)])
def test_running_aggregates(spark, strategy, reverse, exclusive):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, 1, 2, 7])) for k in (1, None) for i in range(23)]
    log = core.order_log(frame(spark, rows, "k long, i long, v long"), ["k"], ["i"])
    v = F.col("v")
    got = core.running_steps(log, {"s": ("sum", v), "lo": ("min", v), "hi": ("max", v)}, reverse=reverse, exclusive=exclusive).collect()
    by = {(k, i): x for k, i, x in rows}
    for r in got:
        span = range(r.i, 23) if reverse else range(0, r.i + 1)
        seen = [by[(r.k, j)] for j in span if not (exclusive and j == r.i) and by[(r.k, j)] is not None]
        assert (r.s, r.lo, r.hi) == ((sum(seen), min(seen), max(seen)) if seen else (None, None, None))


def test_range_attach_handles_overlap_and_long_intervals(spark):
    runs = frame(spark, [(1, 1, 0, 700), (1, 2, 300, 310), (2, 1, 5, 5)], "k long, run long, start_step long, end_step long")
    rows = frame(spark, [(k, s) for k in (1, 2) for s in range(720)], "k long, step long")
    got = core.range_attach(runs, rows, ["k"]).collect()
    assert len(got) == 701 + 11 + 1
    assert all(r.run_step == r.step - r.start_step for r in got)


def test_coalesce_gaps_at_the_threshold(spark, strategy):
    # gaps of 20 and 21 and three groups: the running value restarts with each group
    rows = [(1, 0, 10, 1.0, False), (1, 30, 40, 2.0, True), (1, 61, 70, 4.0, False), (1, 200, 201, 8.0, True), (1, 210, 215, 16.0, False)]
    df = frame(spark, rows, "k long, s long, e long, v double, died boolean")
    log = core.OrderedLog(df, ("k",), "s", None if strategy == "plain" else 4)
    got = sorted((r.s, r.e, r.v, r.died, r.n_merged) for r in core.coalesce_gaps(log, "s", "e", 20, ["v"], ["died"]).collect())
    assert got == [(0, 40, 3.0, True, 2), (61, 70, 4.0, False, 1), (200, 215, 24.0, False, 2)]


@pytest.mark.parametrize("max_island", [4096, 3])
def test_greedy_intervals_match_a_scan(spark, strategy, max_island):
    rng = random.Random(4)
    rows, want = [], set()
    for k in range(6):
        busy = -1
        starts = sorted(rng.sample(range(120), 50))
        for s in starts:
            e = s + 5 + (k if s % 7 < 3 else 5)
            e = max(e, rows[-1][2] if rows and rows[-1][0] == k else 0)
            rows.append((k, s, e))
            if s > busy:
                want.add((k, s))
                busy = e
    df = frame(spark, rows, "k long, s long, e long")
    log = core.OrderedLog(df, ("k",), "s", None if strategy == "plain" else 16)
    got = {(r.k, r.s) for r in core.greedy_intervals(log, "e", max_island).collect()}
    assert got == want


def test_one_key_holding_a_third_is_split(spark, monkeypatch):
    monkeypatch.setattr(core, "MAX_ROWS", 1000)
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("k"), F.col("id").alias("i"))
    log = core.order_log(df, ["k"], ["i"])
    assert log.block == 1000
    assert log.df.agg(F.max("step")).first()[0] == 2999
    w = core.near(log, 1, lambda w: {"p": F.lag("i").over(w)})
    assert w.where("p is null").count() == 501


def test_plain_strategy_shares_one_exchange(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").alias("i"), (F.col("id") % 3 == 0).alias("f"))
    log = core.order_log(df, ["k"], ["i"])
    out = core.running_steps(log.having(core.near(log, 1, lambda w: {"p": F.lag("f").over(w)})), {"n": ("sum", F.col("f").cast("int"))})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_partition_independence(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("i"), (F.hash("id") % 2 == 0).alias("f"))
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            log = core.order_log(df.repartition(n), ["k"], ["i"])
            results.append(sorted(map(tuple, core.flag_runs(log, F.col("f")).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


WIDE = 2**60
VALUES = {
    "a long": [WIDE, WIDE + 1, WIDE + 2, WIDE + 3, None, -WIDE, WIDE + 1],
    "a string": ["b", "a", "é", None, "", "ab", "a"],
    "a double": [float("inf"), float("-inf"), float("nan"), 0.0, None, 1.5, float("inf")],
    "a boolean": [True, False, None, True, False, True, True],
    "a date": [datetime.date(2020, 1, d) for d in (3, 1, 2, 3, 1, 9, 8)],
    "a decimal(38,2)": [decimal.Decimal(10) ** 30, decimal.Decimal(10) ** 30 + 1, None, decimal.Decimal(0), decimal.Decimal(-1), decimal.Decimal(10) ** 30, decimal.Decimal(5)],
}


@pytest.mark.parametrize("kind", list(VALUES))
def test_steps_do_not_depend_on_the_row_limit(spark, kind):
    """Split keys give the steps of whole keys for every type: wide integers, strings, infinities, NaN, NULL."""
    rows = [(k, v, i) for k in (1, 2) for i, v in enumerate(VALUES[kind] * 3)]
    df = spark.createDataFrame(rows, f"k int, {kind}, b int")
    steps = lambda n: sorted((r["k"], r["step"], r["b"]) for r in core.order_log(df, ["k"], ["a", "b"], max_rows=n).df.collect())
    assert core.order_log(df, ["k"], ["a", "b"], max_rows=4).block == 4
    assert steps(4) == steps(1 << 20)


def test_string_keys_and_null_keys_can_be_split(spark):
    df = spark.createDataFrame([(k, i % 5, i) for k in ("x", None) for i in range(20)], "k string, a int, b int")
    got = core.order_log(df, ["k"], ["a", "b"], max_rows=3).df.collect()
    assert {(r["k"], r["step"]) for r in got} == {(k, s) for k in ("x", None) for s in range(20)}


def test_the_strategy_follows_a_path_that_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(3).selectExpr("1 AS k", "id AS a").write.parquet(path)
    assert core.order_log(spark.read.parquet(path), ["k"], ["a"], max_rows=5).block is None
    spark.range(30).selectExpr("1 AS k", "id AS a").write.mode("overwrite").parquet(path)
    assert core.order_log(spark.read.parquet(path), ["k"], ["a"], max_rows=5).block == 5


def test_only_rows_of_hot_keys_are_written_and_once(spark, monkeypatch):
    """One key with a third of all rows among many: the others stay in plain windows."""
    rows = [(0, i % 7, i) for i in range(500)] + [(1 + i % 100, i % 3, i) for i in range(1000)] + [(None, 1, i) for i in range(9)]
    df = spark.createDataFrame(rows, "k long, o long, i long")
    written = []
    plain = core.cut_lineage

    def watched(frame):
        out = plain(frame)
        written.append((out.count(), len(out.columns)))
        return out

    monkeypatch.setattr(core, "cut_lineage", watched)
    log = core.order_log(df, ["k"], ["o", "i"], max_rows=40)
    assert written[:2] == [(1, 1), (500, 5)]  # the list of hot keys, and the rows of the one hot key
    assert len(written) == 3 and written[2][0] <= 30  # a row a range
    got = {}
    for r in log.df.collect():
        got.setdefault(r.k, []).append((r.step, r.o, r.i))
    for k, seen in got.items():
        want = sorted((o, i) for key, o, i in rows if key == k)
        assert [s[1:] for s in sorted(seen)] == want and sorted(s[0] for s in seen) == list(range(len(want)))
    want = set()
    for k, seen in got.items():
        total = 0
        for step, _, i in sorted(seen):
            total += i
            want.add((k, step, total))
    assert {(r.k, r.step, r.t) for r in core.running_steps(log, {"t": ("sum", F.col("i"))}).collect()} == want


def test_steps_of_a_hot_key_keep_the_order_of_its_types(spark):
    inf, nan = float("inf"), float("nan")
    values = [None, -inf, -2.5, 0.0, 1e300, inf, nan]
    rows = [("hot" if i % 3 else None, values[i % 7], 2**62 + i) for i in range(210)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    blocks = {(r.k, r.n): r.step for r in core.order_log(df, ["k"], ["v", "n"], max_rows=16).df.collect()}
    plain = {(r.k, r.n): r.step for r in core.order_log(df, ["k"], ["v", "n"]).df.collect()}
    assert blocks == plain
