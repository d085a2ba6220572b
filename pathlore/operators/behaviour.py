"""Rule-based behaviour detectors over an ordered state log.

Each detector maps a log to an instance table: key..., name, start_step, end_step, start_t, end_t, value,
pill, died, instant_step. Totals per key are aggregates of that table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.functions.expressions import (
    ENTITIES, HOUSE_CENTRE, INF, entity_distance_sql, is_live_sql, live_distance, quadrant_index,
)
from pathlore.operators import core, slicing
from pathlore.operators.core import OrderedLog
from pathlore.operators.spatial import MazeGrid, reachability

# Opposite corner per quadrant, and the slots of the four power pills.
OPPOSITE_CORNER = {0: (12.5, -9.5), 1: (-12.5, -9.5), 2: (-12.5, 8.5), 3: (12.5, 8.5)}

INSTANCE_COLUMNS = {
    "name": "string", "start_step": "long", "end_step": "long", "start_t": "double", "end_t": "double",
    "value": "double", "pill": "int", "died": "boolean", "instant_step": "long",
}


# ---- parameters (defaults are fixed values) --------------------------------------------------------------


@dataclass(frozen=True)
class HuntNearHouse:
    closeness: str = "House perimeter"
    boundary_distance: float = 7.5
    x_boundaries: tuple[float, float] = (-6.5, 6.5)
    y_boundaries: tuple[float, float] = (-5.5, 4.5)
    context: int = 0


@dataclass(frozen=True)
class Captures:
    context: int = 10


@dataclass(frozen=True)
class HuntAfterPill:
    search_window: int = 10
    value_threshold: int = 1
    distance_threshold: float = 5
    context: int = 0


@dataclass(frozen=True)
class ChaseOrCollect:
    value_threshold: int = 1
    only_closest: bool = True
    normalize: bool = True
    distance_threshold: float = 5
    context: int = 0


@dataclass(frozen=True)
class Trapped:
    distance_threshold: float = 10
    merge_gap: int = 20
    context: int = 0


@dataclass(frozen=True)
class MeanDistance:
    method: str = "centroid"


@dataclass(frozen=True)
class CloseCalls:
    close_distance: float = 1.5
    search_window: int = 20
    context: int = 0


# ---- shared parts --------------------------------------------------------------------------------------


def live_distances() -> Column:
    """Array of the distances to the four entities, infinity where not live."""
    return F.array(*[live_distance(g) for g in ENTITIES])


def with_context(instances: DataFrame, log: OrderedLog, n: int) -> DataFrame:
    """Widen intervals by n rows inside the key's bounds; times stay those of the unwidened interval."""
    return core.widen(instances, log.key, n, n, core.key_bounds(log)) if n else instances


def _instances(log: OrderedLog, df: DataFrame, name: str, context: int = 0, **columns: Column) -> DataFrame:
    """Shape a frame with start_step / end_step into the instance schema."""
    given = {"name": F.lit(name), **columns}
    shaped = df.select(
        *log.key,
        *[
            (given[c] if c in given else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
            for c, t in INSTANCE_COLUMNS.items()
        ],
    )
    return with_context(shaped, log, context)


# ---- detectors -----------------------------------------------------------------------------------------


def near_house(p: HuntNearHouse) -> tuple[Column, Column]:
    """(agent near the house, any live entity near the house)."""
    if p.closeness == "House perimeter":
        (x0, x1), (y0, y1) = p.x_boundaries, p.y_boundaries
        near = lambda who: f"({who}_X BETWEEN {x0} AND {x1} AND {who}_Y BETWEEN {y0} AND {y1})"
    elif p.closeness == "Distance to house":
        hx, hy = HOUSE_CENTRE
        near = lambda who: f"(abs({who}_X - ({hx}D)) + abs({who}_Y - ({hy}D)) <= {p.boundary_distance})"
    else:
        raise ValueError(f"unknown closeness {p.closeness!r}")
    any_entity = " OR ".join(f"({is_live_sql(g)} AND {near(f'Ghost{g}')})" for g in ENTITIES)
    return F.expr(near("Pacman")), F.expr(any_entity)


def hunt_near_house(log: OrderedLog, p: HuntNearHouse = HuntNearHouse()) -> DataFrame:
    agent, entity = near_house(p)
    flag = (F.col("pacman_attack") == 1) & agent & entity
    runs = core.flag_runs(log, flag, keep_first=True, keep_open=False, carry=["time_elapsed"])
    return _instances(
        log, runs, "Aggression1", p.context,
        value=F.col("n_rows"), start_t=F.col("start_time_elapsed"), end_t=F.col("end_time_elapsed"),
    )


def captures(log: OrderedLog, p: Captures = Captures()) -> DataFrame:
    """An entity state going from 3 to 4 between consecutive rows, one instance per entity."""
    names = [f"ghost{g}_state" for g in ENTITIES]
    hits = core.point_events(log, names, {n: (F.col(f"prev_{n}") == 3) & (F.col(n) == 4) for n in names})
    step = F.col(log.step)
    points = hits.withColumns({"start_step": step, "end_step": step})
    return _instances(
        log, points, "Aggression3", p.context,
        value=F.lit(1.0), start_t=F.col("time_elapsed"), end_t=F.col("time_elapsed"), instant_step=step,
    )


def approach_counts(threshold: float, w, *, from_anywhere: bool) -> Column:
    """Entities nearer than on the previous row and within the threshold. ``from_anywhere`` also counts an
    entity that was not live on the previous row."""
    total = F.lit(0)
    for g in ENTITIES:
        now, before = F.col(f"_d{g}"), F.lag(f"_d{g}").over(w)
        hit = (now < before) & (now < threshold)
        if not from_anywhere:
            hit = hit & (before != INF)
        total = total + F.coalesce(hit.cast("int"), F.lit(0))
    return total


def closest_approach(threshold: float, w) -> Column:
    """1 where the nearest live entity came nearer than on the previous row, was live there, and is within the threshold."""
    ds = [F.col(f"_d{g}") for g in ENTITIES]
    low = F.least(*ds)
    before = F.coalesce(*[F.when(d == low, F.lag(f"_d{g}").over(w)) for g, d in zip(ENTITIES, ds)])
    return F.coalesce(((low < before) & (low < threshold) & (before != INF)).cast("int"), F.lit(0))


def _with_distances(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_d{g}": live_distance(g) for g in ENTITIES})


def _attack_runs(log: OrderedLog, *, keep_open: bool) -> DataFrame:
    """Attack runs begun inside the log, with the pill slot (quadrant where it began) and what holds at both ends."""
    held = log.having(log.df.withColumns({"_slot": quadrant_index(), "_step": F.col(log.step)}))
    return core.flag_runs(
        held, F.col("pacman_attack") == 1, keep_open=keep_open,
        carry=["_slot", "time_elapsed", "lives"], aggs={"pills_left": F.max_by(F.col("powerPellets"), F.col(log.step))},
    ).withColumn("pill", F.col("start__slot"))


def hunt_after_pill(log: OrderedLog, p: HuntAfterPill = HuntAfterPill()) -> DataFrame:
    """Approaches within the search window after an attack run wears off.

    The search stops at the end of the window, at a death, at the last row, or before a new run. A run
    whose last row has no pill left is not searched, even if it began with one.
    """
    runs = _attack_runs(log, keep_open=False).where("pills_left > 0").select(
        *log.key, "run", "pill",
        F.col("end_step").alias("start_step"), F.col("end_time_elapsed").alias("start_t"), F.col("end_lives").alias("_lives"),
        (F.col("end_step") + p.search_window).alias("end_step"),
    )
    scored = core.near(
        log.having(_with_distances(log.df)), 1,
        lambda w: {
            "_n": approach_counts(p.distance_threshold, w, from_anywhere=True),
            "_t_before": F.lag("time_elapsed").over(w),
            "_last": F.lead(log.step).over(w).isNull(),
        },
    ).select(*log.key, log.step, "_n", "_t_before", "_last", F.col("lives").alias("_l"), "pacman_attack")
    rows = core.range_attach(runs, scored, log.key, step=log.step).where("run_step > 0")
    found = rows.groupBy(*log.key, "run").agg(
        *[F.first(c).alias(c) for c in ("pill", "start_step", "start_t", "_lives")],
        F.array_sort(F.collect_list(F.struct(  # at most search_window rows
            F.col(log.step).alias("s"), F.col("_n").alias("n"), F.col("_l").alias("l"), F.col("_t_before").alias("tb"),
            (F.col("pacman_attack") == 1).alias("a"), F.col("_last").alias("e"),
        ))).alias("_w"),
    )
    # the stopping row: death, last row, end of window, or a new run (whose row is not scored)
    stop = F.array_min(F.transform(
        F.filter("_w", lambda r: r["a"] | r["e"] | (r["l"] < F.col("_lives")) | (r["s"] == F.col("start_step") + p.search_window)),
        lambda r: F.struct(r["s"].alias("s"), r["tb"].alias("tb"), r["l"].alias("l"), r["a"].alias("a")),
    ))
    stopped = found.withColumn("_stop", stop).where("_stop is not null")
    value = F.aggregate(
        F.filter("_w", lambda r: (r["s"] < F.col("_stop.s")) | ((r["s"] == F.col("_stop.s")) & ~r["a"])),
        F.lit(0), lambda acc, r: acc + r["n"],
    )
    valued = stopped.withColumn("value", value).where(F.col("value") >= p.value_threshold)
    return _instances(
        log, valued, "Aggression4", p.context, end_step=F.col("_stop.s") - 1, end_t=F.col("_stop.tb"),
        died=~F.col("_stop.a") & (F.col("_stop.l") < F.col("_lives")),
    )


def chase_or_collect(log: OrderedLog, p: ChaseOrCollect = ChaseOrCollect()) -> DataFrame:
    """Approaches while attacking, per run; divided by the run's length when normalised.

    Runs after the first quiet row without pills are ignored; the row a run begins on and the last row of
    the log are not scored.
    """
    spans = _attack_runs(log, keep_open=True)

    def build(w):
        n = closest_approach(p.distance_threshold, w) if p.only_closest else approach_counts(p.distance_threshold, w, from_anywhere=False)
        return {
            "_n": F.coalesce(n, F.lit(0)),
            "_begins": F.lag("pacman_attack").over(w) == 0,
            "_last": F.lead(log.step).over(w).isNull(),
        }

    scored = core.near(log.having(_with_distances(log.df)), 1, build)
    hits = scored.where("pacman_attack = 1 and not _begins and not _last and _n > 0").select(*log.key, log.step, "_n")
    totals = (
        core.range_attach(spans.select(*log.key, "run", "start_step", "last_step"), hits, log.key, hi="last_step", step=log.step)
        .groupBy(*log.key, "run").agg(F.sum("_n").cast("double").alias("_count"))
    )
    quiet = (
        scored.where("pacman_attack = 0 and _begins and powerPellets = 0")
        .groupBy(*log.key).agg(F.min(log.step).alias("_quiet"))
    )
    found = spans.join(totals, [*log.key, "run"]).join(quiet, list(log.key), "left").where(
        (F.col("_quiet").isNull() | (F.col("start_step") < F.col("_quiet"))) & (F.col("_count") >= p.value_threshold)
    )
    value = F.col("_count") / (F.col("end_step") - F.col("start_step")) if p.normalize else F.col("_count")
    return _instances(
        log, found, "Aggression6", p.context,
        value=value, start_t=F.col("start_time_elapsed"), end_t=F.col("end_time_elapsed"),
    )


def trap_candidates(df: DataFrame, p: Trapped = Trapped()) -> DataFrame:
    """Adds ``candidate`` (not attacking, at least two live entities near) and ``trap_key``, what its search
    depends on: cell sx, sy, goal tx, ty and the near entities' cells (sorted, distinct).

    Other rows get a key that no search has, spread over many values so that they do not meet in one task.
    """
    cell = lambda who: (f"bigint(rint({who}_X * 2))", f"bigint(rint({who}_Y * 2))")
    (ax, ay), cells = cell("Pacman"), []
    for g in ENTITIES:
        gx, gy = cell(f"Ghost{g}")
        near = f"{is_live_sql(g)} AND abs({ax} - {gx}) + abs({ay} - {gy}) <= {2 * p.distance_threshold}"
        cells.append(f"CASE WHEN {near} THEN named_struct('x2', {gx}, 'y2', {gy}) END")
    goals = [" ".join(f"WHEN {i} THEN {int(2 * c[axis])}L" for i, c in OPPOSITE_CORNER.items()) for axis in (0, 1)]
    near_df = df.withColumns({"_near": F.expr(f"filter(array({', '.join(cells)}), c -> c IS NOT NULL)"), "_q": quadrant_index()})
    own = f"""named_struct('sx', {ax}, 'sy', {ay}, 'tx', CASE _q {goals[0]} END, 'ty', CASE _q {goals[1]} END,
        'blocked', array_sort(array_distinct(_near)))"""
    spot = "Pacman_X, Pacman_Y, Ghost1_X, Ghost2_X, Ghost3_X, Ghost4_X"
    none = f"""named_struct('sx', pmod(xxhash64({spot}), 4096L), 'sy', bigint(NULL), 'tx', bigint(NULL), 'ty', bigint(NULL),
        'blocked', cast(NULL AS array<struct<x2:bigint,y2:bigint>>))"""
    return (
        near_df.withColumn("candidate", F.expr("coalesce(pacman_attack = 0 AND size(_near) >= 2, false)"))
        .withColumn("trap_key", F.expr(f"CASE WHEN candidate THEN {own} ELSE {none} END"))
        .drop("_near", "_q")
    )


def trapped_flag(log: OrderedLog, maze: MazeGrid, p: Trapped = Trapped()) -> OrderedLog:
    """Log with ``trapped``: candidate whose goal cannot be reached past the near entities.

    The search runs once per distinct key of the candidate rows; other rows never reach Python.
    """
    df = trap_candidates(log.df, p)
    # The flag is tested after the combine: a filter on it below would be copied into every column it uses.
    asked = df.groupBy("trap_key").agg(F.max("candidate").alias("c")).where("c").select("trap_key.*")
    answer = reachability(asked, maze)
    packed = answer.select(F.struct("sx", "sy", "tx", "ty", "blocked").alias("trap_key"), "reachable")
    joined = df.join(packed, "trap_key", "left")
    return log.having(
        joined.withColumn("trapped", F.col("candidate") & ~F.coalesce("reachable", F.lit(True))).drop("trap_key", "candidate", "reachable")
    )


def trap_instances(log: OrderedLog, flag: str = "trapped") -> DataFrame:
    """Unmerged instances of a trapped flag. The last row of a key is never trapped, it only ends instances;
    a death on the next row ends the instance on the trapped row itself."""
    seen = core.near(
        log, 1,
        lambda w: {
            "_dies": F.coalesce(F.lead("lives").over(w) < F.col("lives"), F.lit(False)),
            "_has_next": F.lead(log.step).over(w).isNotNull(),
            "_t_before": F.coalesce(F.lag("time_elapsed").over(w), F.col("time_elapsed")),
        },
    )
    held = log.having(seen.withColumns({"_dead_end": F.col("_dies"), "_left": F.col("lives"), "_more": F.col("_has_next")}))
    runs = core.flag_runs(
        held, F.col(flag) & F.col("_has_next"), keep_first=True, split_after=F.col("_dies"),
        carry=["time_elapsed", "_t_before", "_left", "_more"],
        aggs={"_killed": F.max("_dead_end"), "_t_last": F.max_by("time_elapsed", log.step)},
    )
    at_once = F.col("_killed") & (F.col("n_rows") == 1)
    return runs.select(
        *log.key, "run",
        F.when(at_once, F.greatest(F.col("start_step") - 1, F.lit(0))).otherwise(F.col("start_step")).alias("start_step"),
        F.when(F.col("_killed"), F.col("last_step")).otherwise(F.col("end_step")).alias("end_step"),
        F.when(at_once, F.col("start__t_before")).otherwise(F.col("start_time_elapsed")).alias("start_t"),
        F.when(F.col("_killed"), F.col("_t_last")).otherwise(F.col("end_time_elapsed")).alias("end_t"),
        F.col("n_rows").cast("double").alias("value"),
        (F.col("_killed") | (~F.col("end__more") & (F.col("end__left") == 0))).alias("died"),
    )


def merge_traps(log: OrderedLog, instances: DataFrame, gap: int = 20) -> DataFrame:
    """Merge instances at most ``gap`` rows apart: values add up, ``died`` of the last one."""
    spans = OrderedLog(instances, log.key, "start_step", log.block)
    return core.coalesce_gaps(spans, "start_step", "end_step", gap, ["value"], ["died", "end_t"], ["start_t"])


def trapped_by_entities(log: OrderedLog, maze: MazeGrid, p: Trapped = Trapped()) -> DataFrame:
    merged = merge_traps(log, trap_instances(trapped_flag(log, maze, p)), p.merge_gap)
    return _instances(log, merged, "Caution1", p.context)


def row_distance(p: MeanDistance = MeanDistance()) -> Column:
    """Per row: distance of the agent to the live entities, NULL when none is live."""
    add = lambda what: " + ".join(f"CASE WHEN {is_live_sql(g)} THEN {what(g)} ELSE 0 END" for g in ENTITIES)
    n = add(lambda g: "1")
    if p.method == "centroid":
        x, y = add(lambda g: f"Ghost{g}_X"), add(lambda g: f"Ghost{g}_Y")
        return F.expr(f"CASE WHEN {n} > 0 THEN abs(Pacman_X - ({x}) / ({n})) + abs(Pacman_Y - ({y}) / ({n})) END")
    if p.method == "average":
        return F.expr(f"CASE WHEN {n} > 0 THEN ({add(entity_distance_sql)}) / ({n}) END")
    raise ValueError(f"unknown distance method {p.method!r}")


def mean_distance(log: OrderedLog, attacking: bool, p: MeanDistance = MeanDistance()) -> DataFrame:
    """Mean over the rows with (without) attack; 0 when there is none. One row per key."""
    d = F.when(F.col("pacman_attack") == (1 if attacking else 0), row_distance(p))
    totals = log.df.groupBy(*log.key).agg(F.coalesce(F.avg(d), F.lit(0.0)).alias("value"))
    spans = totals.withColumns({"start_step": F.lit(None), "end_step": F.lit(None)})
    return _instances(log, spans, "Caution2b" if attacking else "Caution2a")


def close_calls(log: OrderedLog, p: CloseCalls = CloseCalls()) -> DataFrame:
    """A live entity very close without attack, and no life lost ``search_window`` rows later.

    The instance ends on the first row at least that much later where the agent is clear or attacking; a
    death while still close discards it; the last row ends it. The next one starts after that.
    """
    w_rows, step = p.search_window, log.step
    close = F.expr(" OR ".join(f"({is_live_sql(g)} AND {entity_distance_sql(g)} < {p.close_distance})" for g in ENTITIES))
    if w_rows < 1:
        raise ValueError("the search window must be at least one row")
    seen = core.near(
        log, w_rows + 1,
        lambda w: {
            "_later": F.lead("lives", w_rows).over(w),
            "_in_reach": F.lead(step, w_rows).over(w).isNotNull(),  # step + window <= last
            "_inside": F.lead(step, w_rows + 1).over(w).isNotNull(),  # step + window < last
            "_dies": F.coalesce(F.lead("lives").over(w) < F.col("lives"), F.lit(False)),
        },
    )
    clear = (F.col("pacman_attack") == 1) | ~close
    marked = seen.withColumns(
        {
            "_start": close & (F.col("pacman_attack") != 1) & F.col("_inside") & (F.col("_later") >= F.col("lives")),
            "_release": F.when(
                F.col("_in_reach") & (clear | F.col("_dies")),
                F.struct(F.col(step).alias("s"), F.col("time_elapsed").alias("t"), (~clear).alias("lost")),
            ),
        }
    ).select(*log.key, step, "time_elapsed", "_start", "_release")
    ahead = core.running_steps(log.having(marked), {"_next": ("min", F.col("_release"))}, reverse=True)
    from_window = core.near(log.having(ahead), w_rows, lambda w: {"_end": F.lead("_next", w_rows).over(w)})
    finals = core.key_bounds(log, ["time_elapsed"])
    starts = from_window.where("_start").join(finals.select(*log.key, "final_step", "final_time_elapsed"), list(log.key))
    spans = starts.select(
        *log.key, F.col(step).alias("start_step"), F.col("time_elapsed").alias("start_t"),
        F.coalesce("_end.s", "final_step").alias("end_step"), F.coalesce("_end.t", "final_time_elapsed").alias("end_t"),
        F.coalesce("_end.lost", F.lit(False)).alias("_lost"),
    )
    chosen = core.greedy_intervals(OrderedLog(spans, log.key, "start_step", log.block), "end_step")
    return _instances(log, chosen.where("not _lost"), "Caution3", p.context, value=F.lit(1.0))


# ---- registry and encodings ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Detector:
    run: Callable[..., DataFrame]
    params: object
    total: str  # how instances make the key's value: sum, count, slots
    needs_maze: bool = False


DETECTORS: dict[str, Detector] = {
    "Aggression1": Detector(hunt_near_house, HuntNearHouse(), "sum"),
    "Aggression3": Detector(captures, Captures(), "count"),
    "Aggression4": Detector(hunt_after_pill, HuntAfterPill(), "sum"),
    "Aggression6": Detector(chase_or_collect, ChaseOrCollect(), "slots"),
    "Caution1": Detector(trapped_by_entities, Trapped(), "count", needs_maze=True),
    "Caution2a": Detector(lambda log, p: mean_distance(log, False, p), MeanDistance(), "mean"),
    "Caution2b": Detector(lambda log, p: mean_distance(log, True, p), MeanDistance(), "mean"),
    "Caution3": Detector(close_calls, CloseCalls(), "count"),
}


def pick(names: str | Sequence[str] = "all") -> list[str]:
    """Detector names: all, one name, a category ('Aggression', 'Caution') or a list of names."""
    if isinstance(names, str):
        found = list(DETECTORS) if names == "all" else [n for n in DETECTORS if n == names or (names.isalpha() and n.startswith(names))]
        if not found:
            raise ValueError(f"unknown behaviour {names!r}; known: {list(DETECTORS)}")
        return found
    for n in names:
        if n not in DETECTORS:
            raise ValueError(f"unknown behaviour {n!r}; known: {list(DETECTORS)}")
    return list(names)


def category(name: str) -> str:
    pick([name])
    return "Aggression" if name.startswith("Aggression") else "Caution"


@dataclass(frozen=True)
class Behaviours:
    """A configured set of detectors: parameters may be overridden here and again per call."""

    maze: MazeGrid | None = None
    overrides: Mapping[str, Mapping[str, object]] | None = None

    def parameters(self, name: str, **call) -> object:
        pick([name])
        merged = {**((self.overrides or {}).get(name, {})), **call}
        known = {f.name for f in fields(DETECTORS[name].params)}
        if set(merged) - known:
            raise ValueError(f"{name} has no parameters {sorted(set(merged) - known)}; known: {sorted(known)}")
        return replace(DETECTORS[name].params, **merged)

    def detect(self, log: OrderedLog, name: str, **call) -> DataFrame:
        p, d = self.parameters(name, **call), DETECTORS[name]
        if d.needs_maze:
            if self.maze is None:
                raise ValueError(f"{name} needs the maze")
            return d.run(log, self.maze, p)
        return d.run(log, p)

    def _ready(self, chosen: Sequence[str]) -> None:
        """No detector is left out in silence: choosing one that needs the maze without a maze is an error, and so is choosing none."""
        if not chosen:
            raise ValueError("choose at least one behaviour")
        if self.maze is None and (lacking := [n for n in chosen if DETECTORS[n].needs_maze]):
            raise ValueError(f"{', '.join(lacking)} needs the maze")

    def _pass(self, log: OrderedLog, names: str | Sequence[str]) -> tuple[list[str], DataFrame, DataFrame]:
        """(names, instances, keys) of the chosen detectors from one pass over the log."""
        from pathlore.operators import detector_pass

        chosen = pick(names)
        self._ready(chosen)
        found, keys = detector_pass.instances(log, {n: self.parameters(n) for n in chosen}, self.maze)
        return chosen, found, keys

    def instances(self, log: OrderedLog, names: str | Sequence[str] = "all") -> DataFrame:
        """One row per detected instance, all chosen detectors together."""
        return self._pass(log, names)[1]

    def summary(self, log: OrderedLog, names: str | Sequence[str] = "all") -> DataFrame:
        """One row per key: ``<name>_value`` and ``<name>_instances``, 0 where nothing was found."""
        chosen, found, keys = self._pass(log, names)
        return summarize(found, log, chosen, {n: self.parameters(n) for n in chosen}, keys)

    def encoding(self, log: OrderedLog, names: str | Sequence[str] = "all") -> DataFrame:
        """Only the value columns, as one vector per key."""
        s = self.summary(log, names)
        return s.select(*log.key, *[c for c in s.columns if c.endswith("_value")])


def summarize(instances: DataFrame, log: OrderedLog, names: Sequence[str], params: Mapping[str, object] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Totals per key in one conditional aggregation, joined to all keys of the log (``keys``, where they are known already)."""
    aggs = []
    for n in names:
        mine = F.col("name") == n
        total = DETECTORS[n].total
        counted = F.count(F.when(mine & F.col("start_step").isNotNull(), 1))
        if total == "count":
            value = counted.cast("double")
        elif total == "slots" and getattr((params or {}).get(n, DETECTORS[n].params), "normalize", False):
            slots = [F.coalesce(F.sum(F.when(mine & (F.col("pill") == q), F.col("value"))), F.lit(0.0)) for q in range(4)]
            used = sum((F.when(s != 0, 1).otherwise(0) for s in slots), F.lit(0))
            value = F.when(used > 0, sum(slots, F.lit(0.0)) / used).otherwise(F.lit(0.0))
        else:
            value = F.coalesce(F.sum(F.when(mine, F.col("value"))), F.lit(0.0))
        aggs += [value.alias(f"{n}_value"), counted.alias(f"{n}_instances")]
    found = instances.groupBy(*log.key).agg(*aggs)
    every = log.df.select(*log.key).distinct() if keys is None else keys
    return every.join(found, list(log.key), "left").na.fill(0)


def slot_values(instances: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Summed value, instances and deaths per pill slot of a pill detector."""
    return instances.where(F.col("name") == name).groupBy(*key, "pill").agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("instances"),
        F.coalesce(F.max("died"), F.lit(False)).alias("died"),
    )


def instance_paths(log: OrderedLog, instances: DataFrame, context: int = 0, metadata: Sequence[str] = ()) -> DataFrame:
    """Rows (long form) of every instance's trajectory, widened by ``context`` inside its key.

    ``instance`` numbers the instances of a key and detector by start.
    """
    spans = instances.where("start_step is not null")
    numbered = core.order_log(spans, [*log.key, "name"], ["start_step", "end_step"], step="instance").df
    wide = with_context(numbered, log, context)
    rows = log.df.select(*log.key, log.step, "Pacman_X", "Pacman_Y", *metadata)
    return core.range_attach(wide.select(*log.key, "name", "instance", "start_step", "end_step"), rows, log.key, step=log.step)


REQUIRED = ["pacman_attack", "lives", "Pacman_X", "Pacman_Y"] + [f"Ghost{g}_{a}" for g in ENTITIES for a in "XY"] + [f"ghost{g}_state" for g in ENTITIES]


def split_valid(df: DataFrame, key: Sequence[str], required: Sequence[str] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(rows of usable keys, rejected keys with the number of bad rows): one bad level does not stop the others."""
    bad = F.lit(False)
    for c in required:
        missing = F.col(c).isNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            missing = missing | F.isnan(c)
        bad = bad | missing
    rejects = df.where(bad).groupBy(*key).agg(F.count(F.lit(1)).alias("bad_rows"))
    return df.join(rejects, list(key), "left_anti"), rejects
