"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathlore.operators.core import cut_lineage

#: White space of the corpus rules: space and the control characters from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: Column | str) -> Column:
    """The text, with NULL read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a text without words."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


BROADCAST_ROWS = 250_000  # rows of a few numbers or short strings that may be sent to every executor


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, which the caller has counted; else left to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


BATCH_BYTES = 1 << 20  # texts that a Python function gets at a time; a longer text is a batch of its own
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python functions some ``BATCH_BYTES`` at a time, if it names no limit itself.

    Each running function holds a batch beside the JVM's heap and again in its worker, and Spark's default of 10,000 rows
    is tens of MB of documents. Narrow rows still come by the 10,000.
    """
    if spark.conf.get(_BYTES, None) is None:
        spark.conf.set(_BYTES, BATCH_BYTES)


def row_hashes(id_col: str, text: str) -> tuple[Column, Column]:
    """Two hashes of a row's id and text: a key for rows whose ids may repeat or be NULL."""
    return tuple(F.xxhash64(F.lit(n), F.col(id_col).isNull(), F.col(id_col), whole_text(text)) for n in (1, 2))


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: read more than once, computed once, safe from lost executors."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder; where none is set (one machine, as in tests) a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pathlore-shared-")
    return folder.rstrip("/")


def scratch(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Column names that do not clash with those of ``df``, so that extra columns of any name can stay."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in wanted:
        free = f"_{name}"
        while free.lower() in taken:
            free = f"_{free}"
        out[name] = free
        taken.add(free.lower())
    return out


def byte_texts(batch: pa.Array, rows: int = 256) -> Iterator[bytes]:
    """The UTF-8 bytes of a batch of texts, as Python objects of a few rows at a time."""
    raw = batch.cast(pa.binary())
    for start in range(0, len(raw), rows):
        yield from raw.slice(start, rows).to_pylist()
