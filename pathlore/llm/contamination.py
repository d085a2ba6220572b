"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification, in DataFrame functions.

Test items are partitioned by their number of shingles. A document that holds the share t of an item of at most u shingles
misses at most u - ceil(t u) of them, so it holds at least one of the item's u - ceil(t u) + 1 least hashes: a bottom
sketch of that size, set by partition, finds every match however long the document is, where one MinHash over a whole
document would drown a short item. The shingle hashes of all documents meet the sketches; the few documents they hit are
read again and compared shingle by shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import bounded, row_hashes, scratch, stored, whole_text, words_of

SHINGLE = 5
SHARE = 0.8


def shingle_texts(words: Column, width: Column | int) -> Column:
    """Distinct shingles of ``width`` words; none if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width
    last = F.size(words) - width
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, width), " ")))).otherwise(
        F.array().cast("array<string>")
    )


def shingle_hashes(words: Column, width: int) -> Column:
    """Hash of the shingle at each place, repeats included. ``words`` must be a column of its own, not an expression."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))).otherwise(
        F.array().cast("array<bigint>")
    )


def partition_of(n: Column) -> Column:
    """Upper bound of the size partition: the next power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("int")


def sketches(items: DataFrame, item_id: str, text: str, share: float) -> DataFrame:
    """(item, width, shingles, n, least): distinct shingles of every item with words, and the hashes of its sketch.

    Items of fewer than five words are one shingle of all their words.
    """
    words = items.select(F.col(item_id).alias("item"), words_of(F.lower(whole_text(text))).alias("words")).where("size(words) > 0")
    sized = words.select("item", "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("width"))
    cut = sized.select("item", "width", shingle_texts(F.col("words"), F.col("width")).alias("shingles")).withColumn("n", F.size("shingles"))
    upper = F.col("upper")
    cut = cut.withColumn("upper", partition_of(F.col("n"))).withColumn("k", F.least(upper - F.ceil(upper * share - 1e-9).cast("int") + 1, F.col("n")))
    by_width = None  # a shingle's hash is that of its words, as on the document side
    for width in range(1, SHINGLE + 1):
        part = cut.where(F.col("width") == width)
        parts = F.transform(F.col("shingles"), lambda s: F.split(s, " "))
        hashed = part.withColumn("parts", parts).withColumn(
            "least", F.slice(F.array_sort(F.transform("parts", _hash_of(width))), F.lit(1), F.col("k"))
        ).drop("parts", "upper", "k")
        by_width = hashed if by_width is None else by_width.unionByName(hashed)
    return by_width


def _hash_of(width: int):
    return lambda p: F.xxhash64(*[F.get(p, F.lit(j)) for j in range(width)])


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(r1, r2, doc, item, n, shared, containment) for every row that holds at least ``share`` of an item's distinct shingles.

    r1 and r2 stand for the row's id and text, so equal rows give one result each; texts are lower-cased and split at
    white space. NULL and empty texts hold nothing and items without words are held by nothing; items that repeat are
    reported each; NULL ids pass through. Empty tables give no rows.
    """
    known = stored(sketches(items, item_id, item_text, share))
    widths = [r["width"] for r in known.select("width").distinct().collect()]  # at most five values
    n_items = known.count()
    n_hashes = known.agg(F.sum(F.size("shingles"))).first()[0] or 0
    whole = whole_text(text)
    keys = row_hashes(id_col, text)
    read = docs.select(F.col(id_col).alias("doc"), *[k.alias(n) for n, k in zip(("r1", "r2"), keys)], words_of(F.lower(whole)).alias("words"))
    found = None
    for width in widths:
        least = known.where(F.col("width") == width).select(F.explode("least").alias("hash"), "item")
        hashed = read.select("r1", "r2", F.explode(shingle_hashes(F.col("words"), width)).alias("hash"))
        part = hashed.join(bounded(least, n_hashes), "hash").select("r1", "r2", "item")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = read.select("r1", "r2").join(known.select("item").limit(0), F.lit(False))
    candidates = stored(found.distinct())
    rows = candidates.select("r1", "r2").distinct()
    again = read.join(bounded(rows, candidates.count()), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
    pairs = again.join(candidates, ["r1", "r2"]).join(bounded(known.drop("least"), n_items), "item")
    compared = pairs.withColumn("shared", F.size(F.array_intersect("shingles", shingle_texts(F.col("words"), F.col("width")))))
    return compared.select("r1", "r2", "doc", "item", "n", "shared", (F.col("shared") / F.col("n")).alias("containment")).where(F.col("containment") >= share)


def leak_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """Pairs (doc id, item id) with the item's number of shingles, those held, and the containment; rows that share an id
    are one document, whose best row counts."""
    found = find_leaks(docs, items, id_col, text, item_id, item_text, share)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("containment", "shared", "n")).alias("b"))
    return best.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_id), F.col("b.n").cast("long").alias("item_shingles"),
        F.col("b.shared").cast("long").alias("shared"), F.col("b.containment").alias("containment"),
    )


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    bad = stored(find_leaks(docs, items, id_col, text, item_id, item_text, share).select("r1", "r2").distinct())
    names = scratch(docs, "r1", "r2")
    keys = dict(zip((names["r1"], names["r2"]), row_hashes(id_col, text)))
    bad = bad.select(F.col("r1").alias(names["r1"]), F.col("r2").alias(names["r2"]))
    return docs.withColumns(keys).join(bounded(bad, bad.count()), list(keys), "left_anti").select(*docs.columns)
