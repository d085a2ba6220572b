"""Merkle manifest of a dataset, built by a butterfly exchange.

Rows become leaves (a hash of their length-prefixed fields), ranked within their group by id over sampled ranges, and cut
into aligned blocks of ``fanout ** levels`` leaves. Each block hashes its own subtree. Then the blocks swap roots round by
round: in round r the blocks of ``fanout`` neighbouring subtrees, one of each at the same offset, send each other what
their subtree has become, and every one of them hashes the common ancestor by itself. After log(blocks) rounds each block
holds the root of its group and all siblings on its way up, so no pass goes down again; a block is one small row, and a
message goes to one partner. The roots of the groups are the leaves of one more tree, made the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from pathlore.llm.common import stored
from pathlore.operators.core import spread

FANOUT = 2
BLOCK = 4096  # most leaves of one block
RANGE = 1 << 16  # leaves that one task sorts
ROUNDS_A_PLAN = 8  # rounds between two cuts of the lineage
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, a colon and the value: no two rows give the same string."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def block_levels(fanout: int, block: int) -> int:
    """Levels of the largest whole subtree with at most ``block`` leaves, one at least."""
    levels = 1
    while fanout ** (levels + 1) <= block:
        levels += 1
    return levels


def subtree(leaves: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """Node lists from the leaves up, ``levels`` times, or until one node is left where that is None."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([sha("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def fold(leaf: str, proof: Sequence[str], places: Sequence[tuple[int, int]], fanout: int) -> str:
    """The root that a leaf and its siblings give. ``places``: (index, number of leaves) of each tree on the way up."""
    node, siblings = leaf, iter(proof)
    for index, count in places:
        while count > 1:
            low = index // fanout * fanout
            node = sha("".join(node if i == index else next(siblings) for i in range(low, min(low + fanout, count))))
            index, count = index // fanout, -(-count // fanout)
    return node


def ranked(leaves: DataFrame, order: Sequence[str]) -> DataFrame:
    """``leaves`` with ``rank`` from 0 within ``g`` along ``order`` and ``n``, the leaves of ``g``.

    Ranges of (g, order) are cut by sampled bounds, so a hot group spreads over many tasks and rows that tie in everything
    are split too; the rank is the place in the range after the rows of the earlier ranges of the group.
    """
    ranges = leaves.count() // RANGE + 1
    tie = F.monotonically_increasing_id()
    laid = leaves.withColumn("_tie", tie).repartitionByRange(ranges, "g", *order, "_tie").sortWithinPartitions("g", *order, "_tie").drop("_tie")
    laid = stored(laid.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    held = laid.groupBy("g", "_range").agg(F.count(F.lit(1)).alias("_held"), F.min("_at").alias("_first"))  # a row a range, one more a group
    along = Window.partitionBy("g").orderBy("_range")
    ahead = held.select(
        "g", "_range", "_first", F.coalesce(F.sum("_held").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
        F.sum("_held").over(Window.partitionBy("g")).alias("n"),
    )
    joined = laid.join(ahead, ["g", "_range"])
    return joined.withColumn("rank", F.col("_ahead") + F.col("_at") - F.col("_first")).drop("_range", "_at", "_first", "_ahead")


def swap(state: DataFrame, fanout: int, round_: int) -> DataFrame:
    """One round of the exchange over (g, block, blocks, node, proof): ``node`` goes from the block's subtree of ``fanout ** round_``
    blocks to the next larger one.

    A block writes to the block at its own offset in each neighbouring subtree. The last subtree may be cut short: its
    last block also writes to those whose partner is not there. A group whose tree is whole keeps what it has.
    """
    width = F.lit(fanout**round_).cast("long")
    mine = F.expr(f"block div {fanout**round_}")
    nodes = F.expr(f"(blocks + {fanout**round_ - 1}) div {fanout**round_}")
    low = F.col("_mine") - F.col("_mine") % fanout
    run = F.sequence(low, F.least(low + (fanout - 1), F.col("_nodes") - 1))
    offset = F.col("block") % width
    others = F.filter(run, lambda s: s != F.col("_mine"))
    last = F.col("block") == F.col("blocks") - 1
    to = F.transform(others, lambda s: F.when(last, F.sequence(s * width + offset, s * width + width - 1)).otherwise(F.array(s * width + offset)))
    sent = state.withColumns({"_mine": mine, "_nodes": nodes}).withColumn("_to", F.concat(F.array("block"), F.flatten(to)))
    mail = sent.select("g", "blocks", "_mine", "node", "proof", "block", F.explode("_to").alias("_to")).where(F.col("_to") < F.col("blocks"))
    own = F.col("_to") == F.col("block")
    met = mail.groupBy("g", F.col("_to").alias("block")).agg(
        F.max("blocks").alias("blocks"), F.max(F.when(own, F.col("proof"))).alias("proof"), F.max(F.when(own, F.col("_mine"))).alias("_mine"),
        F.array_sort(F.collect_list(F.struct("_mine", "node"))).alias("_run"),  # at most ``fanout``
    )
    joined = F.array_join(F.transform("_run", lambda x: x["node"]), "")
    siblings = F.transform(F.filter("_run", lambda x: x["_mine"] != F.col("_mine")), lambda x: x["node"])
    whole = F.col("blocks") <= width
    return met.select(
        "g", "block", "blocks", F.when(whole, F.col("_run")[0]["node"]).otherwise(F.sha2(joined, 256)).alias("node"),
        F.when(whole, F.col("proof")).otherwise(F.concat("proof", siblings)).alias("proof"),
    )


def tree(leaves: DataFrame, order: Sequence[str], fanout: int = FANOUT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(ranked leaves with ``block``, blocks with the group's root as ``node`` and the siblings above the block as ``proof``)."""
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    levels = block_levels(fanout, block)
    size = fanout**levels
    rows = stored(ranked(leaves, order).withColumn("block", F.expr(f"rank div {size}")))

    def roots(part: pa.Table) -> pa.Table:
        part = part.sort_by("rank")
        n = part["n"][0].as_py()
        top = subtree(part["leaf"].to_pylist(), fanout, levels if n > size else None)[-1][0]
        return pa.table({"g": part["g"].slice(0, 1), "block": part["block"].slice(0, 1), "blocks": [-(-n // size)], "node": [top]})

    narrow = spread(rows.select("g", "block", "rank", "n", "leaf"), "g", "block")
    state = narrow.groupBy("g", "block").applyInArrow(roots, "g string, block long, blocks long, node string")
    state = stored(state.withColumn("proof", F.expr("cast(array() as array<string>)")))
    most, rounds = state.agg(F.max("blocks")).first()[0] or 0, 0
    while fanout**rounds < most:
        state = swap(state, fanout, rounds)
        rounds += 1
        if rounds % ROUNDS_A_PLAN == 0:
            state = stored(state)
    return rows, stored(state)


def manifest(docs: DataFrame, id_col: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, fanout: int = FANOUT, block: int = BLOCK, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, rank, n (leaves of its group), group_rank, groups, subroot, root and proof.

    ``proof`` lists the siblings from the leaf up to the group's subroot and from there to the root, each run left to
    right, so that ``fold`` gives the root again. Groups are ordered by their UTF-8 bytes, NULL first and a group of its
    own; leaves ascend by id, NULL first, rows of one id by their leaf. Rows that repeat in everything are leaves of their
    own. NULL fields and empty texts differ. ``carry`` adds columns computed from ``docs``; other columns are not read. An
    empty table has no leaves and no root, and gives an empty table. Texts never move, only their hashes.
    """
    carry = carry or {}
    levels = block_levels(fanout, block)
    size = fanout**levels
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # NULL before all others
    own = ["id", *[f"carried_{c}" for c in carry]]
    leaves = stored(docs.select(
        key.alias("g"), F.col(id_col).alias("id"), leaf_hash(*[F.col(c) for c in fields]).alias("leaf"), *[v.alias(f"carried_{c}") for c, v in carry.items()]
    ))
    rows, blocks = tree(leaves, ["id", "leaf"], fanout, block)
    subroots = blocks.where("block = 0").select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("node").alias("leaf"))
    group_rows, group_blocks = tree(subroots, ["id"], fanout, block)
    tops = prove(group_rows, group_blocks, ["id"], fanout, block).select(
        F.col("id").alias("g"), F.col("rank").alias("group_rank"), F.col("n").alias("groups"), F.col("node").alias("root"), F.col("proof").alias("above")
    )
    proved = prove(rows, blocks, own, fanout, block).join(tops, "g")
    return proved.select(
        F.col("id").alias(id_col), "leaf", "rank", "n", "group_rank", "groups", F.col("node").alias("subroot"), "root",
        F.concat("proof", "above").alias("proof"), *[F.col(f"carried_{c}").alias(c) for c in carry],
    )


def prove(rows: DataFrame, blocks: DataFrame, own: Sequence[str], fanout: int, block: int) -> DataFrame:
    """Every leaf with g, ``own``, leaf, rank, n, the root of g as ``node`` and ``proof``: its siblings inside its block, then those that the block has learnt."""
    levels = block_levels(fanout, block)
    size = fanout**levels
    names = ["g", *own, "leaf", "rank", "n"]

    def siblings(part: pa.Table, learnt: pa.Table) -> pa.Table:
        part = part.sort_by("rank")
        nodes = subtree(part["leaf"].to_pylist(), fanout, levels if part["n"][0].as_py() > size else None)
        above = learnt["proof"][0].as_py()
        proofs = []
        for at in range(len(part)):
            proof = []
            for below in nodes[:-1]:
                low = at // fanout * fanout
                proof += below[low:at] + below[at + 1 : low + fanout]
                at //= fanout
            proofs.append(proof + above)
        out = part.select(names).append_column("node", pa.array([learnt["node"][0].as_py()] * len(part), pa.string()))
        return out.append_column("proof", pa.array(proofs, pa.list_(pa.string())))

    left = spread(rows.select("block", *names), "g", "block").groupBy("g", "block")
    right = spread(blocks.select("g", "block", "node", "proof"), "g", "block").groupBy("g", "block")
    schema = StructType([*rows.select(*names).schema, StructField("node", StringType()), StructField("proof", ArrayType(StringType()))])
    return left.cogroup(right).applyInArrow(siblings, schema)


def folded_root(fanout: int = FANOUT) -> Callable[..., Column]:
    """Function (leaf, proof, rank, n, group_rank, groups) of columns: the root that a leaf gives with the siblings of a manifest row."""

    @F.arrow_udf("string")
    def fold_all(leaf: pa.Array, proof: pa.Array, rank: pa.Array, n: pa.Array, group_rank: pa.Array, groups: pa.Array) -> pa.Array:
        rows = zip(*[c.to_pylist() for c in (leaf, proof, rank, n, group_rank, groups)])
        return pa.array([fold(a, p, ((i, k), (j, m)), fanout) for a, p, i, k, j, m in rows], pa.string())

    return fold_all


def tamper_report(docs: DataFrame, id_col: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, fanout: int = FANOUT, block: int = BLOCK, bumped: str = "n_chars", every: int = 7) -> DataFrame:
    """The manifest checked against a changed copy: rows where ``every`` divides the crc32 of the id have ``bumped`` one higher there.

    id, leaf, subroot, root and proof_sha256 (hash of the joined siblings) are those of ``docs``; folded_root is what the
    leaf of the copy gives with these siblings, verified whether it is the root. A NULL id or a NULL ``bumped`` is not changed.
    """
    changed = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))
    higher = F.when(changed, F.col(bumped).cast("decimal(38,0)") + 1).otherwise(F.col(bumped).cast("decimal(38,0)"))
    copy = leaf_hash(*[higher if c == bumped else F.col(c) for c in fields])
    rows = manifest(docs, id_col, group, fields, fanout, block, carry={"copy_leaf": copy})
    folded = folded_root(fanout)(*[F.col(c) for c in ("copy_leaf", "proof", "rank", "n", "group_rank", "groups")])
    return rows.select(
        id_col, "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
