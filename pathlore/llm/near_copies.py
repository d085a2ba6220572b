"""Near copies by the Jaccard similarity of word shingles: SimHash search, checked, then a set join that loses no pair.

Two documents are copies if their sets of five-word shingles have a similarity of ``4/5`` or more. Fingerprints of 128
bits are searched by BK-trees over their pieces (``simhash.wide_pairs``), and what is found is compared shingle by shingle.
No radius that a tree can search holds all pairs at 0.8, where about 19 of 128 bits differ, so what the fingerprints left
apart is searched exactly: all shingles get one total order (those common in a sample last, the others by hash). The
first shingle in that order that two copies share stands among the first fifth of either set, so a document is listed
under that fifth only, and pairs that meet there are bounded by size and place before their texts are compared.

A list of many copies is not paired: its documents meet the least of them first, and only documents that are still in
different groups after that meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.llm.common import bounded, byte_texts, row_hashes, scratch, small_batches, stored, whole_text
from pathlore.llm.components import components
from pathlore.llm.simhash import majority, mixed, wide_pairs

WIDTH = 5
SAMPLE = 4000  # documents whose shingles are counted to put common ones last
COMMON = 100_000  # shingles that are put last at most; the order never changes a result
HELD = 64  # shingle sets that a task keeps while it compares pairs


def shingles(text: bytes, width: int = WIDTH) -> set[bytes]:
    """Distinct shingles of a text; a shorter text is one shingle. Only A-Z are lower-cased."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the six characters of white space
    span = min(width, len(words))
    return {b" ".join(words[k : k + span]) for k in range(len(words) - span + 1)} if words else set()


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    import xxhash

    found = shingles(text, width)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))


def set_hash(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 1)).view(np.int64))


def least_shared(n: int) -> int:
    """Shingles of a set of n that any copy of it must hold: 4/5, rounded up."""
    return (4 * n + 4) // 5


def set_of(text: Column, width: int = WIDTH) -> Column:
    """(node, low, high): 64-bit name of the shingle set and the halves of its fingerprint of 128 bits."""
    kind = pa.struct([("node", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def named(raw: bytes) -> dict:
        hashes = shingle_hashes(raw, width)
        return {"node": set_hash(hashes), "low": majority(hashes), "high": majority(mixed(hashes))}

    @F.arrow_udf("struct<node:long,low:long,high:long>")
    def sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([named(t) for t in byte_texts(batch)], kind)

    return sets(whole_text(text))


def hashes_of(text: Column, width: int = WIDTH) -> Column:
    @F.arrow_udf("array<long>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingle_hashes(t, width).view(np.int64) for t in byte_texts(batch)], pa.list_(pa.int64()))

    return hashed(whole_text(text))


def first_shingles(text: Column, common: np.ndarray, rank: np.ndarray, width: int = WIDTH) -> Column:
    """(node, n, keys): name and size of the shingle set, and its first shingles in the total order."""
    kind = pa.struct([("node", pa.int64()), ("n", pa.int32()), ("keys", pa.list_(pa.int64()))])

    def listed(raw: bytes) -> dict:
        hashes = shingle_hashes(raw, width)
        n = len(hashes)
        late = np.zeros(n, np.int64)
        if len(common) and n:
            at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
            late = np.where(common[at] == hashes, rank[at], 0)
        ordered = hashes[np.lexsort((hashes, late))]
        return {"node": set_hash(hashes), "n": n, "keys": ordered[: n - least_shared(n) + 1 if n else 0].view(np.int64)}

    @F.arrow_udf("struct<node:long,n:int,keys:array<long>>")
    def first(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([listed(t) for t in byte_texts(batch)], kind)

    return first(whole_text(text))


def common_shingles(docs: DataFrame, text: str, rows: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, count of each in the sample) of shingles that two or more documents of a sample hold."""
    part = docs.where(F.pmod(F.xxhash64(F.lit(3), whole_text(text)), F.lit(max(1, rows // SAMPLE))) == 0)
    counted = part.select(F.explode(hashes_of(F.col(text), width)).alias("key")).groupBy("key").count().where("count > 1")
    top = counted.orderBy(F.desc("count"), "key").limit(COMMON).collect()
    keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["count"] for r in top], np.int64)[order]


def may_be_copies(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles whose first shared one has place i and j (from 0) can reach the similarity."""
    return 9 * (1 + F.least(n - 1 - i, m - 1 - j)) >= 4 * (n + m)


def enough_shared(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """The pairs (a, b) whose listed shingles (node, n, keys) let them reach the similarity.

    Of the two lists the one that ends first in the total order holds only shingles that the other would list too, so
    the sets share no more than the lists do and what follows that list, at most ``least_shared`` - 1.
    """
    x, y = (lists.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("keys_a", "keys_b"))
    rest = F.floor((4 * F.greatest("n_a", "n_b") + 4) / 5) - 1
    return pairs.join(x, "a").join(y, "b").where(9 * (shared + rest) >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def texts_of(pairs: DataFrame, docs: DataFrame, marked: DataFrame, id_col: str, text: str) -> DataFrame:
    """(node, text): one text of each shingle set of the pairs."""
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    rows = marked.join(bounded(wanted, wanted.count()), "node", "left_semi")
    source = stored(rows.groupBy("node").agg(F.min(F.struct("r1", "r2")).alias("r")).select("node", "r.r1", "r.r2"))
    r1, r2 = row_hashes(id_col, text)
    named = docs.select(r1.alias("r1"), r2.alias("r2"), whole_text(text).alias("text"))
    return named.join(bounded(source, source.count()), ["r1", "r2"]).groupBy("node").agg(F.first("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have a similarity of 4/5 or more."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, set[bytes]] = {}

        def known(node: int, raw: bytes) -> set[bytes]:
            if node not in held:
                if len(held) >= HELD:
                    held.pop(next(iter(held)))
                held[node] = shingles(raw, width)
            return held[node]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for p, q, x, y in zip(a, b, byte_texts(batch.column(2)), byte_texts(batch.column(3))):
                x, y = known(p, x), known(q, y)
                keep.append(9 * len(x & y) >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = texts.select(F.col("node").alias("a"), F.col("text").alias("x")), texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def still_apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) that are not in one group of ``label`` (node, label)."""
    x, y = (label.select(F.col("node").alias(c), F.col("label").alias(f"group_{c}")) for c in "ab")
    return pairs.join(x, "a", "left").join(y, "b", "left").where("group_a is null or group_b is null or group_a <> group_b").select("a", "b")


def copy_links(docs: DataFrame, marked: DataFrame, id_col: str, text: str, width: int = WIDTH) -> DataFrame:
    """(a, b): links of shingle sets whose components are those of all pairs of similarity 4/5 or more.

    The components of a step go on as stars, so the next one starts from them and not from all links again.
    """
    common, rank = common_shingles(docs, text, docs.count(), width)
    listed = docs.select(first_shingles(F.col(text), common, rank, width).alias("s"))
    rows = listed.select(F.col("s.node").alias("node"), F.col("s.n").alias("n"), F.posexplode("s.keys").alias("place", "key"))
    # One exchange serves the repeats of a set and both windows.
    rows = rows.repartition("key").dropDuplicates(["key", "node"])
    over = Window.partitionBy("key")
    hub = F.min(F.struct("node", "n", "place")).over(over)
    live = stored(rows.withColumn("size", F.count(F.lit(1)).over(over)).withColumn("hub", hub).where("size > 1"))

    lists = stored(live.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("key").alias("keys")))
    def verify(pairs: DataFrame) -> DataFrame:
        close = stored(enough_shared(pairs, lists))
        return verified(close, texts_of(close, docs, marked, id_col, text), width)

    sets = marked.groupBy("node").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    found = stored(verify(stored(wide_pairs(sets))))
    label = components(found)

    near_hub = may_be_copies(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place"))
    asked = live.where(F.col("node") != F.col("hub.node")).where(near_hub).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    asked = stored(still_apart(asked, label))
    stars = stored(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(verify(asked)))
    label = components(stars)

    open_keys = live.where("size > 2").select("key", "node", "n", "place").join(label, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label")
    apart = open_keys.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key")
    open_keys = stored(open_keys.join(apart, "key"))
    left = open_keys.select("key", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "place", "group")])
    right = open_keys.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "place", "group")])
    met = left.join(right, "key").where("node_a < node_b and group_a <> group_b")
    met = met.where(may_be_copies(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b")))
    rest = met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct().join(asked, ["a", "b"], "left_anti")
    return label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(verify(rest))


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, r1, r2, copies): for each row of ``docs`` its id, row hashes and the name of its group of near copies.

    NULL texts and texts without words are copies of each other. Rows that repeat an id count by their own texts.
    """
    small_batches(docs.sparkSession)
    r1, r2 = row_hashes(id_col, text)
    marked = stored(docs.select(F.col(id_col).alias("id"), r1.alias("r1"), r2.alias("r2"), set_of(F.col(text), width).alias("s")).select("id", "r1", "r2", "s.*"))
    label = components(copy_links(docs, marked, id_col, text, width))
    return marked.join(label, "node", "left").select("id", "r1", "r2", F.coalesce("label", "node").alias("copies"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the smallest id (NULL last), one row of it."""
    found = stored(copy_groups(docs, id_col, text, width))
    stays = found.groupBy("copies").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "r1", "r2")).alias("k")).select("k.r1", "k.r2")
    repeats = found.groupBy("r1", "r2").count()
    names = scratch(docs, "r1", "r2", "n")
    stays = stays.join(repeats, ["r1", "r2"]).select(F.col("r1").alias(names["r1"]), F.col("r2").alias(names["r2"]), F.col("count").alias(names["n"]))
    rows = docs.withColumns(dict(zip((names["r1"], names["r2"]), row_hashes(id_col, text)))).join(stays, [names["r1"], names["r2"]])
    single = rows.where(F.col(names["n"]) == 1)
    repeated = rows.where(F.col(names["n"]) > 1).dropDuplicates([names["r1"], names["r2"]])
    return single.unionByName(repeated).select(*docs.columns)
