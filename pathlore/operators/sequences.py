"""From a repaired log to model-ready sequences: slice, rebase, normalise, select, sort, pad - one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.operators import slicing
from pathlore.operators.core import OrderedLog
from pathlore.operators.filters import FEATURE_SETS
from pathlore.operators.normalize import Normalizer

SCOPES = (None, "global", "sequence", "sample")


def cut(log: OrderedLog, kind: str, context: int = 0, pill: int | None = None) -> DataFrame:
    if kind == "pacman_attack":
        pills = [c for c in log.df.columns if c.startswith("powerpellet")]
        return slicing.slice_flag_runs(log, F.col("pacman_attack") == 1, context, pill, pills)
    return slicing.slice_preset(log, kind)


def make_sequences(
    log: OrderedLog,
    feature_set: str,
    kind: str = "first_5_seconds",
    *,
    context: int = 0,
    pill: int | None = None,
    normalization: str | None = None,
    rebase: bool = False,
    sort_distances: bool = False,
    pad: float | None = None,
    normalizer: Normalizer | None = None,
) -> DataFrame:
    """Long form (key, run, run_step, features). ``normalization``: the whole log before cutting
    ('global'), all cut sequences together ('sequence') or each one by itself ('sample')."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"unknown feature set {feature_set!r}; known: {sorted(FEATURE_SETS)}")
    if normalization not in SCOPES:
        raise ValueError(f"unknown normalisation scope {normalization!r}")
    features = FEATURE_SETS[feature_set]
    normalizer = normalizer or Normalizer()
    used = Normalizer({c: s for c, s in normalizer.strategies.items() if c in features})
    seq = [*log.key, "run"]
    if normalization == "global":
        log = log.having(used.normalize(log.df))
    df = cut(log, kind, context, pill)
    if rebase and "score" in df.columns:
        df = slicing.rebase_scores(df, seq)
    if normalization in ("sequence", "sample"):
        df = used.normalize(df, seq if normalization == "sample" else ())
    df = df.select(*seq, "run_step", *features)
    if pad is not None:
        df = slicing.pad_sequences(df, seq, features, value=pad)
    distances = [c for c in features if c.startswith("Ghost") and c.endswith("_distance")]
    return slicing.sort_across_columns(df, distances) if sort_distances and distances else df
