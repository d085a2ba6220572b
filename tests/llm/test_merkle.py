"""The manifest against a tree that is folded by hand."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pathlore.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, node int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(nodes, fanout):
    """(what remains, siblings of each node, function from (place, node, siblings) to what remains)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for who, i in enumerate(at):
            low = i - i % fanout
            proofs[who] += [nodes[j] for j in range(low, min(low + fanout, len(nodes))) if j != i]
            at[who] = i // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def with_leaf(leaves, i, other, fanout):
    return climb(leaves[:i] + [other] + leaves[i + 1 :], fanout)[0]


def brute(rows, fanout):
    if not rows:
        return []
    langs = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[2] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in langs}
    subroots = [climb([leaf(r) for r in own[s]], fanout)[0] for s in langs]
    root, above = climb(subroots, fanout)
    out = []
    for k, s in enumerate(langs):
        leaves = [leaf(r) for r in own[s]]
        _, proofs = climb(leaves, fanout)
        for i, r in enumerate(own[s]):
            changed = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                changed = (*r[:3], r[3] + 1, *r[4:])
            sub = with_leaf(leaves, i, leaf(changed), fanout)
            folded = with_leaf(subroots, k, sub, fanout)
            out.append((r[0], leaves[i], subroots[k], root, H(*proofs[i], *above[k]), folded, folded == root))
    return sorted(out, key=str)


def some_rows(seed, n):
    rng = random.Random(seed)
    out = [
        (i, rng.choice(["a", None, ""]), rng.choice(["en", "en", "en", "en", "de", "é", "zz", None, ""]), rng.choice([None, 0, 7, 2**63 - 1]),
         rng.choice([None, "", "té😀xt", "x" * 50_000, str(i)]), "clash", 3)
        for i in rng.sample(range(-50, 10_000), n)
    ]
    return out + out[:2] + [(None, "s", "en", 5, "no id", "", 0), (2**60 + 1, "s", "en", 5, "big", "", 0), (2**60, "t", "solo", None, None, "", 0)]


@pytest.mark.parametrize("n, fanout, block", [(0, 2, 4), (3, 2, 2), (90, 2, 2), (150, 3, 3), (131, 5, 25), (60, 2, 4096), (400, 4, 4)])
def test_report_is_that_of_a_tree_folded_by_hand(spark, monkeypatch, n, fanout, block):
    monkeypatch.setattr(merkle, "RANGE", 32)
    monkeypatch.setattr(merkle, "ROUNDS_A_PLAN", 3)
    rows = some_rows(n, n)
    got = merkle.tamper_report(spark.createDataFrame(rows, SCHEMA).repartition(4), fanout=fanout, block=block)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, fanout)


def test_the_proofs_of_a_manifest_lead_to_its_root(spark):
    rows = some_rows(5, 40)
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA), block=4, carry={"size": F.length("text")}).collect()
    assert len(made) == len(rows) and len({r["root"] for r in made}) == 1
    for r in made:
        places = ((r["rank"], r["n"]), (r["group_rank"], r["groups"]))
        assert merkle.fold(r["leaf"], r["proof"], places, 2) == r["root"]
        assert merkle.fold(merkle.sha("other"), r["proof"], places, 2) != r["root"]


def test_every_block_learns_the_root_without_a_way_down(spark):
    leaves = spark.range(37).select(F.lit("g").alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    rows, blocks = merkle.tree(leaves, ["id"], fanout=3, block=3)
    want = climb([H(str(i)) for i in range(37)], 3)
    got = {r["block"]: r for r in blocks.collect()}
    assert set(got) == set(range(13)) and {r["node"] for r in got.values()} == {want[0]}
    assert all(got[i // 3]["proof"] == want[1][i][-len(got[i // 3]["proof"]):] for i in range(37))


def test_an_empty_table(spark):
    assert merkle.tamper_report(spark.createDataFrame([], SCHEMA)).collect() == []
