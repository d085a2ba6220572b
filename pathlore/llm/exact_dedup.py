"""Exact dedup in two passes with a Bloom filter of repeated hashes.

Pass one counts the cells of a two-hash Bloom filter and keeps the bits of cells that were hit at least twice, as
bitmaps of 4 KB. Pass two reads the digests again against those bitmaps: a row with a cell that was hit once is unique
for certain and passes straight through; only possibly repeated rows are shuffled by their digest and settled exactly.
The filter has sixteen cells a row up to ``max_cells`` (a 64 MB broadcast). Beyond that false alarms rise, more rows
shuffle, and the result stays the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import SPACE, scratch, stored, whole_text

CELLS_PER_ROW = 16
MAX_CELLS = 1 << 29
BUCKET_BITS = 32768  # bits of one bitmap of Spark's bitmap functions


def without_space(text: Column) -> Column:
    """The text without white space: one plain replacement a character, which the JVM does on bytes."""
    for c in SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def cells_for(rows: int, max_cells: int) -> int:
    cells = BUCKET_BITS
    while cells < min(rows * CELLS_PER_ROW, max_cells):
        cells *= 2
    return cells


def cell(digest: Column, salt: int, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), digest), F.lit(cells))


def repeated_bits(digests: DataFrame, digest: str, cells: int) -> DataFrame:
    """(bucket, bits): bitmaps of the cells hit at least twice. A hot digest is one pair of cells, counted map-side first."""
    hit = digests.select(F.explode(F.array(cell(F.col(digest), 1, cells), cell(F.col(digest), 2, cells))).alias("cell"))
    twice = hit.groupBy("cell").count().where("count > 1")
    return twice.groupBy(F.expr(f"cell div {BUCKET_BITS}").alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(cell % {BUCKET_BITS})").alias("bits")
    )


def bit_is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id, group_size, kept and text_sha256.

    Texts are equal when they are identical without white space (NULL counts as empty). The row with the most code
    points in its original text stays, then the smallest id (NULL last); exactly one row of a group is kept, so of rows
    that repeat both id and length one is. Extra columns are not read; an empty table gives an empty table.
    """
    whole = whole_text(text)
    digests = stored(docs.select(
        F.col(id_col).alias("id"), F.sha2(without_space(whole), 256).alias("sha"), F.length(whole).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    ))
    cells = cells_for(digests.count(), max_cells)
    bits = repeated_bits(digests, "sha", cells)
    for salt in (1, 2):
        place = cell(F.col("sha"), salt, cells)
        own = F.broadcast(bits.select(F.col("bucket").alias(f"bucket{salt}"), F.col("bits").alias(f"bits{salt}")))
        digests = digests.withColumn(f"cell{salt}", place).join(own, F.expr(f"cell{salt} div {BUCKET_BITS}") == F.col(f"bucket{salt}"), "left")
    maybe = F.lit(True)
    for salt in (1, 2):
        maybe = maybe & bit_is_set(F.col(f"bits{salt}"), F.col(f"cell{salt}") % BUCKET_BITS)
    marked = stored(digests.select("id", "sha", "size", "row", maybe.alias("maybe")))
    single = marked.where(~F.col("maybe")).select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    shared = marked.where("maybe")
    best = stored(shared.groupBy("sha").agg(  # stored, so that the join has an exchange of its own on either side and Spark may split a hot digest
        F.min(F.struct(-F.col("size"), F.col("id").isNull(), "id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")
    ))
    settled = shared.join(best, "sha").select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return single.unionByName(settled)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The id must be unique and not NULL here."""
    names = scratch(docs, "keep")
    kept = exact_dedup(docs, id_col, text).where("kept").select(F.col(id_col).alias(names["keep"]))
    return docs.join(kept, F.col(id_col) == F.col(names["keep"]), "left_semi")
