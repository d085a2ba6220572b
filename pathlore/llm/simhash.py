"""SimHash near-dedup with BK-trees.

Fingerprints of 64 bits link when at most three bits differ. One tree over everything would have to sit in every task and
every search would walk most of it, so the trees are sharded: the 64 bits are cut into five blocks, and two linked
fingerprints agree on at least two whole blocks. Each pair of blocks is a shard key (ten a fingerprint), a shard's tree
meets only the fingerprints of its shard, and a shard over ``SHARD`` fingerprints is searched block against block.
In a tree children hang on integer Hamming distances to their parent; a search follows only the edges within the radius.
Trees of many shards are built and searched together as flat arrays. A shard passes on a spanning forest of its links,
not its pairs, and components of those links give the groups.

Near copies by similarity differ in more bits than that. ``wide_pairs`` finds them by fingerprints of 128 bits: each of
their four pieces of 32 bits has trees of its own with the same radius, and what they find is held against the whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import byte_texts, stored, whole_text
from pathlore.llm.components import components

RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))  # (lowest bit, bits); RADIUS + 2 blocks, so two are untouched
PIECE_BLOCKS = ((0, 7), (7, 7), (14, 6), (20, 6), (26, 6))  # those of a 32-bit piece
WIDE_RADIUS = 32  # of 128 bits; a Jaccard similarity of 0.8 has about 19, unrelated texts 64
SHARD = 4096  # fingerprints of one tree
BATCH = 1 << 16  # rows of shards that are searched together
VISITS = 1 << 22  # (search, tree node) pairs that one call may hold at worst
HASH_CHUNK = 1 << 16


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """Majority of the bits of the hashes of word shingles, repeats included; 0 without words. Only A-Z are lower-cased."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and exactly the six characters of white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(width, len(words)) - 1
    starts, ends = starts[: len(words) - span].tolist(), ends[span:].tolist()
    total, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), HASH_CHUNK):
        part = [h64(line[a:b], seed) for a, b in zip(starts[k : k + HASH_CHUNK], ends[k : k + HASH_CHUNK])]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big", signed=True)


def fingerprint_of(text: Column, width: int = 3, seed: int = 42) -> Column:
    @F.arrow_udf("long")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t, width, seed) for t in byte_texts(batch)], pa.int64())

    return simhash(whole_text(text))


def majority(hashes: np.ndarray) -> int:
    """Majority of the bits of 64-bit hashes; 0 without any."""
    if not len(hashes):
        return 0
    total = sum(
        np.unpackbits(hashes[k : k + HASH_CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        for k in range(0, len(hashes), HASH_CHUNK)
    )
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits of each hash (the last steps of MurmurHash3)."""
    out = hashes.astype(np.uint64)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        out = (out ^ (out >> np.uint64(33))) * np.uint64(factor)
    return out ^ (out >> np.uint64(33))


def shard_keys(fp: Column, blocks: tuple = BLOCKS) -> Column:
    """The keys of a fingerprint: the number of the pair of blocks and their bits. Bits above the blocks part the shards."""
    def bits(block):
        return F.shiftrightunsigned(fp, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))

    top = sum(blocks[-1])
    head = F.shiftleft(F.shiftrightunsigned(fp, top), 36) if top < 64 else F.lit(0)
    return F.array(*[
        head + F.lit(n << 32) + F.shiftleft(bits(a), 16) + bits(b) for n, (a, b) in enumerate(combinations(blocks, 2))
    ])


def grow(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards, level by level: (root shard, root node, edge keys in order, child of each edge).

    An edge key is node * 128 + distance. The first item of a bag becomes its node; the others go on by distance.
    """
    item, bag = np.arange(len(fp)), shard.astype(np.int64)
    roots: tuple[np.ndarray, np.ndarray] | None = None
    keys, children = [], []
    while len(item):
        order = np.argsort(bag, kind="stable")
        item, bag = item[order], bag[order]
        first = np.flatnonzero(np.concatenate(([True], bag[1:] != bag[:-1])))
        node = np.repeat(item[first], np.diff(np.append(first, len(bag))))
        if roots is None:
            roots = bag[first], item[first]
        else:
            keys.append(bag[first])
            children.append(item[first])
        rest = np.ones(len(item), bool)
        rest[first] = False
        item, node = item[rest], node[rest]
        bag = node * 128 + np.bitwise_count(fp[item] ^ fp[node])
    if not keys:
        return *roots, np.empty(0, np.int64), np.empty(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key, kind="stable")
    return *roots, key[order], child[order]


def search(fp: np.ndarray, queries: np.ndarray, nodes: np.ndarray, query_fp: np.ndarray, key: np.ndarray, child: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Walk the trees for all (query, root) pairs at once; (query, found item) within the radius."""
    hits_q, hits_n = [], []
    while len(queries):
        d = np.bitwise_count(query_fp[queries] ^ fp[nodes]).astype(np.int64)
        near = d <= radius
        hits_q.append(queries[near])
        hits_n.append(nodes[near])
        low = np.searchsorted(key, nodes * 128 + np.maximum(d - radius, 0))
        high = np.searchsorted(key, nodes * 128 + d + radius, side="right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        queries, nodes = np.repeat(queries, n), child[at]
    return (np.concatenate(hits_q), np.concatenate(hits_n)) if hits_q else (np.empty(0, np.int64), np.empty(0, np.int64))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least label reachable for each of n items along the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def shard_hits(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near items (a, b) within each shard, some searches at a time: items of side 0 are the tree, all items of a shard
    of one side, or side 1, search it."""
    tree = np.flatnonzero(side == 0)
    if not len(tree):
        return
    root_shard, root, key, child = grow(shard[tree], fp[tree])
    two_sided = np.unique(shard[side == 1])
    asks = np.flatnonzero((side == 1) | ~np.isin(shard, two_sided))
    place = np.searchsorted(root_shard, shard[asks])
    known = (place < len(root_shard)) & (root_shard[np.minimum(place, len(root_shard) - 1)] == shard[asks])
    asks, place = asks[known], place[known]
    work = np.cumsum(np.bincount(np.searchsorted(root_shard, shard[tree]), minlength=len(root_shard))[place])
    at = 0
    while at < len(asks):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + VISITS, side="right")))
        q, node = search(fp[tree], asks[at:end], root[place[at:end]], fp, key, child, radius)
        keep = q != tree[node]
        yield q[keep], tree[node[keep]]
        at = end


def link_shards(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within each shard."""
    found = list(shard_hits(shard, side, fp, radius))
    a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2
    label = forest(a, b, len(fp))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def nearest_forest(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Places of the links (a, b) of a spanning forest of n items with the least distances d."""
    order = np.argsort(d, kind="stable")
    a, b = a[order], b[order]
    label, open_, kept = np.arange(n), np.arange(len(a)), [np.empty(0, np.int64)]
    while True:
        open_ = open_[label[a[open_]] != label[b[open_]]]
        if not len(open_):
            return order[np.concatenate(kept)]
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[open_]], open_)
        np.minimum.at(best, label[b[open_]], open_)
        pick = np.unique(best[best < len(a)])
        kept.append(pick)
        label = forest(label[a[pick]], label[b[pick]], n)[label]


def wide_links(shard: np.ndarray, side: np.ndarray, fp: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of items whose pieces are near and whose whole fingerprints (low, high) are too: those of a forest."""
    a, b, d = (np.empty(0, np.int64),) * 3
    for p, q in shard_hits(shard, side, fp):
        far = np.bitwise_count(low[p] ^ low[q]).astype(np.int64) + np.bitwise_count(high[p] ^ high[q])
        near = far <= WIDE_RADIUS
        a, b, d = np.concatenate((a, p[near])), np.concatenate((b, q[near])), np.concatenate((d, far[near]))
        keep = nearest_forest(a, b, d, len(fp))
        a, b, d = a[keep], b[keep], d[keep]
    return a, b


def whole_shards(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by (key, tile), with a number of the shard first; a shard that goes on in the next batch waits for it."""
    def numbered(cols):
        changed = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        return [np.concatenate(([0], np.cumsum(changed))), *cols[2:]]

    held: list[tuple] = []
    rows = 0
    for batch in batches:
        held.append(tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("key", "tile", *names)))
        rows += batch.num_rows
        if rows < BATCH:
            continue
        cols = [np.concatenate(x) for x in zip(*held)]
        whole = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
        cut = int(whole[-1]) + 1 if len(whole) else 0
        if cut:
            yield numbered([c[:cut] for c in cols])
        held = [tuple(c[cut:] for c in cols)]
        rows = len(cols[0]) - cut
    if rows:
        yield numbered([np.concatenate(x) for x in zip(*held)])


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def search_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, side, fp in whole_shards(batches, ("side", "fp")):
        yield _pairs(*link_shards(shard, side, fp.view(np.uint64)))


def wide_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, side, fp, node, low, high in whole_shards(batches, ("side", "fp", "node", "low", "high")):
        a, b = wide_links(shard, side, *(c.view(np.uint64) for c in (fp, low, high)))
        yield _pairs(node[a], node[b])


def shards(fps: DataFrame, item: str, shard: int, blocks: tuple = BLOCKS) -> DataFrame:
    """Rows of ``fps`` once for each tile of their shards, sorted by (key, tile)."""
    keyed = fps.withColumn("key", F.explode(shard_keys(F.col("fp"), blocks)))
    sizes = keyed.groupBy("key").count().where("count > 1")
    cells = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("count") / shard).cast("int"))
    cells = cells.withColumn("own", F.pmod(F.xxhash64(item), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiled = cells.withColumn("other", other).select(
        "key", (F.least("own", "other") * F.col("parts") + F.greatest("own", "other")).cast("long").alias("tile"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), *fps.columns,
    )
    # Side 1 holds the larger block of a tile of two blocks; a block against itself has side 0 only.
    return tiled.repartition("key", "tile").sortWithinPartitions("key", "tile")


def near_links(fps: DataFrame, fp: str = "fp", shard: int = SHARD) -> DataFrame:
    """(a, b): links of distinct fingerprints whose components are those of all links within RADIUS."""
    return shards(fps.select(F.col(fp).alias("fp")), "fp", shard).mapInArrow(search_partition, "a long, b long")


def wide_pairs(fps: DataFrame, shard: int = SHARD) -> DataFrame:
    """(a, b), distinct, a < b: near nodes of ``fps`` (node, low, high), distinct nodes with fingerprints of 128 bits.

    Within WIDE_RADIUS, and within RADIUS in one piece of 32 bits at least; so every two nodes of 15 or fewer differing
    bits are linked, by themselves or through others. Nodes of one fingerprint meet the least of them.
    """
    first = stored(fps.groupBy("low", "high").agg(F.min("node").alias("node")))
    equal = fps.join(first.withColumnRenamed("node", "least"), ["low", "high"]).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    piece = [F.shiftrightunsigned(F.col(c), n).bitwiseAND(F.lit(0xFFFFFFFF)) for c in ("low", "high") for n in (0, 32)]
    parts = first.select(F.explode(F.array(*[F.lit(t << 32) + p for t, p in enumerate(piece)])).alias("fp"), "node", "low", "high")
    found = shards(parts, "node", shard, PIECE_BLOCKS).mapInArrow(wide_partition, "a long, b long").unionByName(equal)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, extra: list[Column] | None = None) -> DataFrame:
    """(id, fp, component, extras): the smallest id among all documents whose fingerprints are reached by links.

    NULL and empty texts have fingerprint 0 and link like any other. Rows that repeat an id are nodes by their own
    texts; NULL ids take part, and a group of NULL ids only has a NULL component. An empty table gives an empty table.
    """
    marked = stored(docs.select(F.col(id_col).alias("id"), fingerprint_of(F.col(text), width, seed).alias("fp"), *(extra or [])))
    distinct = stored(marked.groupBy("fp").agg(F.min("id").alias("first")))
    labels = components(near_links(distinct))
    joined = labels.join(distinct, labels["node"] == distinct["fp"]).select("fp", "label", "first")
    groups = joined.groupBy("label").agg(F.min("first").alias("least"))
    moved = joined.join(groups, "label").select(F.col("fp").alias("moved_fp"), "least")
    # Stored, so that the last join has an exchange of its own on either side and Spark may split a hot fingerprint.
    home = stored(distinct.join(moved, F.col("fp") == F.col("moved_fp"), "left").select(
        F.col("fp").alias("home_fp"), F.when(F.col("moved_fp").isNull(), F.col("first")).otherwise(F.col("least")).alias("component")
    ))
    return marked.join(home, F.col("fp") == F.col("home_fp")).drop("home_fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id."""
    return near_groups(docs, id_col, text).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )

