"""All detectors from one pass over an ordered log.

``mark`` reads the log once: every flag, lag, lead, running number and key total that any chosen detector needs is computed
over the same (key, step) windows, which share one exchange, and the narrow result is stored. Each detector's instances are
then sparse filters and combines of the marked rows. Runs are numbered inside the marks, so a log may have a key of any
columns, slices (level, run) included, and rows of several slices that ask the same maze question share one search.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions.expressions import ENTITIES, entity_distance_sql, is_live_sql, quadrant_index
from pathlore.operators import behaviour as bh
from pathlore.operators import core
from pathlore.operators.core import OrderedLog
from pathlore.operators.spatial import MazeGrid, reachability

RUNS = ("Aggression4", "Aggression6")


def _close(p) -> Column:
    return F.expr(" OR ".join(f"({is_live_sql(g)} AND {entity_distance_sql(g)} < {p.close_distance})" for g in ENTITIES))


def mark(log: OrderedLog, params: Mapping[str, object]) -> OrderedLog:
    """Marked rows of ``log`` for the detectors named in ``params``; only what they need is computed and kept.

    ``_nx, _nt, _nl``: step, time and lives of the next row (NULL on the last one), ``_pt`` the time of the previous row,
    ``_dies`` whether the next row has fewer lives, ``_final`` step and time of the key's last row. ``_opens`` begins a close call,
    ``_free`` (not NULL) may end one, by a lost life if it is true.
    """
    step, df = log.step, log.df
    row: dict[str, Column] = {
        "_t": F.col("time_elapsed"), "_l": F.col("lives"), "_on": F.coalesce(F.col("pacman_attack") == 1, F.lit(False)), "_pa": F.col("pacman_attack"),
    }
    kept = ["_t", "_l", "_on", "_nx", "_nt", "_nl", "_pt", "_dies", "_final"]
    reach, chase, after, close = 1, params.get("Aggression6"), params.get("Aggression4"), params.get("Caution3")
    if "Aggression1" in params:
        agent, entity = bh.near_house(params["Aggression1"])
        row["_f1"] = F.coalesce((F.col("pacman_attack") == 1) & agent & entity, F.lit(False))
        kept += ["_f1", "_r1"]
    if chase or after:
        row |= {"_slot": quadrant_index(), "_pills": F.col("powerPellets")} | {f"_d{g}": bh.live_distance(g) for g in ENTITIES}
        kept += ["_slot", "_pills", "_ra", "_end", "_begins", "_na", "_pa"] + ["_n4"] * bool(after) + ["_n6"] * bool(chase)
    if "Aggression3" in params:
        row |= {f"_g{g}": F.col(f"ghost{g}_state") for g in ENTITIES}
        kept.append("_caught")
    if "Caution1" in params:
        df = bh.trap_candidates(df, params["Caution1"])
        row |= {"_ask": F.when(F.col("candidate"), F.col("trap_key"))}
        kept.append("_ask")
    for name in ("Caution2a", "Caution2b"):
        if name in params:
            row[f"_{name}"] = F.when(F.col("pacman_attack") == (1 if name == "Caution2b" else 0), bh.row_distance(params[name]))
            kept.append(f"_{name}")
    if close:
        if close.search_window < 1:
            raise ValueError("the search window must be at least one row")
        reach = close.search_window + 1
        row["_near"] = F.coalesce(_close(close), F.lit(False))
        kept += ["_opens", "_free"]

    def around(w) -> dict[str, Column]:
        out = {
            "_nx": F.lead(step).over(w), "_nt": F.lead("_t").over(w), "_nl": F.lead("_l").over(w), "_pt": F.lag("_t").over(w),
            "_dies": F.coalesce(F.lead("_l").over(w) < F.col("_l"), F.lit(False)), "_was": F.coalesce(F.lag("_on").over(w), F.lit(False)),
        }
        if "_f1" in row:
            out["_p1"] = F.coalesce(F.lag("_f1").over(w), F.lit(False))
        if chase or after:
            out |= {"_begins": F.lag("_pa").over(w) == 0, "_na": F.coalesce(F.lead("_on").over(w), F.lit(False))}
        if after:
            out["_n4"] = bh.approach_counts(after.distance_threshold, w, from_anywhere=True)
        if chase:
            out["_n6"] = bh.closest_approach(chase.distance_threshold, w) if chase.only_closest else bh.approach_counts(chase.distance_threshold, w, from_anywhere=False)
        if "_g1" in row:
            hits = [F.coalesce(((F.lag(f"_g{g}").over(w) == 3) & (F.col(f"_g{g}") == 4)).cast("int"), F.lit(0)) for g in ENTITIES]
            out["_caught"] = sum(hits[1:], hits[0])
        if close:
            n = close.search_window
            out |= {"_later": F.lead("_l", n).over(w), "_reach": F.lead(step, n).over(w), "_inside": F.lead(step, n + 1).over(w)}
        return out

    narrow = log.having(df.select(*log.key, step, *[c.alias(n) for n, c in row.items()]))
    seen = narrow.having(core.near(narrow, reach, around))
    seen = seen.having(core.total_steps(seen, {"_final": F.max(F.struct(F.col(step).alias("s"), F.col("_t").alias("t")))}))
    count = lambda c: ("sum", c.cast("long"))
    numbers = {}
    if "_f1" in row:
        numbers["_r1"] = count(F.col("_f1") & ~F.col("_p1"))
    if chase or after:
        numbers["_ra"] = count(F.col("_on") & ~F.col("_was"))
        numbers["_end"] = ("max", F.when(~F.col("_on") & F.col("_was"), F.struct(F.col(step).alias("s"), F.col("_l").alias("l"))))
    if numbers:
        seen = seen.having(core.running_steps(seen, numbers))
    if close:
        clear = (F.col("_pa") == 1) | ~F.col("_near")
        free = F.when(F.col("_reach").isNotNull() & (clear | F.col("_dies")), ~clear)
        opens = F.col("_near") & (F.col("_pa") != 1) & F.col("_inside").isNotNull() & (F.col("_later") >= F.col("_l"))
        seen = seen.having(seen.df.withColumns({"_free": free, "_opens": F.coalesce(opens, F.lit(False))}))
    return seen.having(core.cut_lineage(seen.df.select(*log.key, step, *kept)))


def instances(log: OrderedLog, params: Mapping[str, object], maze: MazeGrid | None = None) -> tuple[DataFrame, DataFrame]:
    """(instances of all detectors in ``params``, keys of the log) in the shape of the single detectors."""
    marked = mark(log, params)
    df, key, step = marked.df, list(log.key), F.col(log.step)
    ends = df.groupBy(*key).agg(F.max("_final.s").alias("final_step")).withColumn("first_step", F.lit(0).cast("long"))
    found = []

    def add(rows: DataFrame, name: str, context: int = 0, **columns: Column) -> None:
        shaped = bh._instances(log, rows, name, **columns)
        found.append(core.widen(shaped, key, context, context, ends) if context else shaped)

    if p := params.get("Aggression1"):
        runs = df.where("_f1").groupBy(*key, "_r1").agg(
            F.min(step).alias("start_step"), F.max(F.coalesce("_nx", step)).alias("end_step"), F.count(F.lit(1)).alias("n"),
            F.min_by("_t", step).alias("start_t"), F.max_by(F.coalesce("_nt", "_t"), step).alias("end_t"), F.max(F.col("_nx").isNull()).alias("open"),
        )
        add(runs.where("not open"), "Aggression1", p.context, value=F.col("n"))
    if p := params.get("Aggression3"):
        hits = df.where("_caught > 0").select(*key, step.alias("_s"), "_t", F.explode(F.sequence(F.lit(1), F.col("_caught"))).alias("_e"))
        add(hits, "Aggression3", p.context, value=F.lit(1.0), start_step=F.col("_s"), end_step=F.col("_s"), start_t=F.col("_t"), end_t=F.col("_t"), instant_step=F.col("_s"))
    if any(n in params for n in RUNS):
        runs = _attack_runs(marked, params.get("Aggression4"), "Aggression6" in params)
        if p := params.get("Aggression4"):
            add(_after_pill(runs, p), "Aggression4", p.context)
        if p := params.get("Aggression6"):
            first_quiet = df.where("_pa = 0 and _begins and _pills = 0").groupBy(*key).agg(F.min(step).alias("_quiet"))
            kept = runs.where(F.col("_count") >= p.value_threshold).join(first_quiet, key, "left").where("_quiet is null or start_step < _quiet")
            value = F.col("_count") / (F.col("end_step") - F.col("start_step")) if p.normalize else F.col("_count")
            add(kept, "Aggression6", p.context, value=value, start_t=F.col("_first.t"), end_t=F.col("_last.t"))
    if p := params.get("Caution1"):
        add(bh.merge_traps(log, _traps(marked, maze), p.merge_gap), "Caution1", p.context)
    means = [n for n in ("Caution2a", "Caution2b") if n in params]
    if means:
        each = df.groupBy(*key).agg(*[F.coalesce(F.avg(f"_{n}"), F.lit(0.0)).alias(n) for n in means])
        for n in means:
            add(each, n, value=F.col(n))
    if p := params.get("Caution3"):
        spans = _close_calls(marked, p.search_window).where("_opens").select(
            *key, step.alias("start_step"), F.col("_t").alias("start_t"), F.coalesce("_until.s", "_final.s").alias("end_step"),
            F.coalesce("_until.t", "_final.t").alias("end_t"), F.coalesce("_until.lost", F.lit(False)).alias("_lost"),
        )
        chosen = core.greedy_intervals(OrderedLog(spans, log.key, "start_step", log.block), "end_step")
        add(chosen.where("not _lost"), "Caution3", p.context, value=F.lit(1.0))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, ends.select(*key)


def _close_calls(marked: OrderedLog, n: int) -> DataFrame:
    """The rows of keys in which a close call opens, with ``_until``: of an opening row, the first row that frees at least ``n``
    rows later. Few keys have one, so the others are spared the way back through their rows."""
    names = [f"_o{k}" for k in marked.key]
    some = core.cut_lineage(marked.df.where("_opens").select(*[F.col(k).alias(o) for k, o in zip(marked.key, names)]).distinct())
    if some.count() <= core.HOT_KEYS:
        some = F.broadcast(some)
    rows = marked.df.select(*marked.key, marked.step, "_t", "_opens", "_free", "_final")
    rows = rows.join(some, core.null_safe(rows, some, list(zip(marked.key, names))), "left_semi")
    freed = F.when(F.col("_free").isNotNull(), F.struct(F.col(marked.step).alias("s"), F.col("_t").alias("t"), F.col("_free").alias("lost")))
    ahead = marked.having(core.running_steps(marked.having(rows), {"_next": ("min", freed)}, reverse=True))
    return core.near(ahead, n, lambda w: {"_until": F.when(F.col("_opens"), F.lead("_next", n).over(w))})


def _attack_runs(marked: OrderedLog, after: object | None, chase: bool) -> DataFrame:
    """Attack runs begun inside the key, with the approaches made in them and the few rows after them that a hunt may last."""
    step, on = F.col(marked.step), F.col("_on")
    rows = marked.df.where(on)
    more = []
    if after:
        gap = ~on & (step - F.col("_end.s")).between(0, after.search_window)
        rows = marked.df.where(on | F.coalesce(gap, F.lit(False)))
        seen = F.struct(step.alias("s"), F.col("_n4").alias("n"), F.col("_l").alias("l"), F.col("_pt").alias("tb"), F.col("_nx").isNull().alias("e"), F.col("_na").alias("a"), F.col("_t").alias("t"))
        more.append(F.array_sort(F.collect_list(F.when(~on, seen))).alias("_w"))  # at most search_window + 1 rows
    if chase:
        hit = on & ~F.col("_begins") & F.col("_nx").isNotNull() & (F.col("_n6") > 0)
        more.append(F.sum(F.when(hit, F.col("_n6"))).cast("double").alias("_count"))
    runs = rows.groupBy(*marked.key, "_ra").agg(
        F.min(F.when(on, step)).alias("start_step"), F.max(F.when(on, F.coalesce("_nx", step))).alias("end_step"),
        F.max(on & F.col("_nx").isNull()).alias("open"),
        F.min(F.when(on, F.struct(step.alias("s"), F.col("_slot").alias("slot"), F.col("_t").alias("t")))).alias("_first"),
        F.max(F.when(on, F.struct(step.alias("s"), F.coalesce("_nt", "_t").alias("t"), F.coalesce("_nl", "_l").alias("l"), F.col("_pills").alias("pills")))).alias("_last"),
        *more,
    )
    return runs.where("start_step > 0").withColumn("pill", F.col("_first.slot"))


def _after_pill(runs: DataFrame, p) -> DataFrame:
    """Approaches after a run up to a death, the key's last row, the end of the window, or the row before a new run."""
    live, limit = F.col("_last.l"), F.col("end_step") + p.search_window
    own = F.transform(
        F.filter("_w", lambda r: (r["s"] > F.col("end_step")) & (r["e"] | (r["l"] < live) | (r["s"] == limit))),
        lambda r: F.struct(r["s"].alias("s"), r["tb"].alias("tb"), r["l"].alias("l"), F.lit(False).alias("a")),
    )
    fresh = F.transform(
        F.filter("_w", lambda r: r["a"] & (r["s"] + 1 <= limit)),
        lambda r: F.struct((r["s"] + 1).alias("s"), r["t"].alias("tb"), r["l"].alias("l"), F.lit(True).alias("a")),
    )
    stopped = runs.where("not open and _last.pills > 0").withColumn("_stop", F.array_min(F.concat(own, fresh))).where("_stop is not null")
    scored = F.filter("_w", lambda r: (r["s"] > F.col("end_step")) & (r["s"] <= F.col("_stop.s")))
    valued = stopped.withColumn("value", F.aggregate(scored, F.lit(0), lambda acc, r: acc + r["n"])).where(F.col("value") >= p.value_threshold)
    return valued.withColumns({
        "start_step": F.col("end_step"), "start_t": F.col("_last.t"), "end_step": F.col("_stop.s") - 1, "end_t": F.col("_stop.tb"),
        "died": ~F.col("_stop.a") & (F.col("_stop.l") < live),
    })


def _traps(marked: OrderedLog, maze: MazeGrid) -> DataFrame:
    """Unmerged trap instances. Only candidate rows are joined to the answers of the search, and only trapped ones go on."""
    step, key = F.col(marked.step), list(marked.key)
    asking = marked.df.where("_ask is not null")
    answer = reachability(asking.select("_ask.*").distinct(), maze)
    blocked = answer.where("not reachable").select(F.struct("sx", "sy", "tx", "ty", "blocked").alias("_ask"))
    rows = asking.join(blocked, "_ask", "left_semi").where("_nx is not null").select(*key, marked.step, "_t", "_l", "_nt", "_nl", "_pt", "_dies", "_final")
    held = core.near(marked.having(rows), 1, lambda w: {"_before": F.lag(F.struct(step.alias("s"), "_dies")).over(w)})
    fresh = F.col("_before").isNull() | (F.col("_before.s") < step - 1) | F.col("_before._dies")
    runs = core.running_steps(marked.having(held), {"_rt": ("sum", fresh.cast("long"))}).groupBy(*key, "_rt").agg(
        F.min(step).alias("_from"), F.max(step).alias("_to"), F.count(F.lit(1)).alias("n"), F.max("_dies").alias("_killed"),
        F.min_by("_t", step).alias("_t0"), F.min_by(F.coalesce("_pt", "_t"), step).alias("_t_before"), F.max_by("_t", step).alias("_t1"),
        F.max_by("_nt", step).alias("_t2"), F.max_by("_nl", step).alias("_left"), F.max("_final.s").alias("_end_of_key"),
    )
    at_once = F.col("_killed") & (F.col("n") == 1)
    return runs.select(
        *key, F.when(at_once, F.greatest(F.col("_from") - 1, F.lit(0))).otherwise(F.col("_from")).alias("start_step"),
        F.when(F.col("_killed"), F.col("_to")).otherwise(F.col("_to") + 1).alias("end_step"),
        F.when(at_once, F.col("_t_before")).otherwise(F.col("_t0")).alias("start_t"), F.when(F.col("_killed"), F.col("_t1")).otherwise(F.col("_t2")).alias("end_t"),
        F.col("n").cast("double").alias("value"), (F.col("_killed") | ((F.col("_to") + 1 == F.col("_end_of_key")) & (F.col("_left") == 0))).alias("died"),
    )
