"""Connected components against a union by hand, and the work of their rounds."""

import random

import pytest

from pathlore.llm import components as module
from pathlore.llm.components import components


def by_hand(edges):
    least = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in least and b in least and a != b and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    return least


@pytest.fixture
def rounds(monkeypatch):
    """The partitions of every table that is stored."""
    seen = []
    monkeypatch.setattr(module, "stored", lambda df, store=module.stored: (seen.append((out := store(df)).rdd.getNumPartitions()), out)[1])
    return seen


def labels(spark, edges):
    return {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}


def random_edges(n, rng):
    return [(rng.randrange(-n, n), rng.randrange(-n, n)) for _ in range(n)] + [(k, k + 1) for k in range(3 * n, 4 * n)] + [(None, 1), (5, None), (7, 7), (9 * n, 9 * n)]


def test_components_of_chains_hubs_and_null_ends(spark):
    rng = random.Random(2)
    edges = random_edges(60, rng) + [(1000, 1001 + k) for k in range(50)] + [(2000 - k, 2000) for k in range(1, 50)]
    rng.shuffle(edges)
    assert labels(spark, edges + edges[:20]) == by_hand(edges)
    assert labels(spark, [(None, 1), (3, 3)]) == {}


def test_stars_take_no_round(spark, rounds):
    edges = [(10 * k + j, 10 * k) for k in range(20) for j in range(1, 10)]
    assert labels(spark, edges) == by_hand(edges)
    assert len(rounds) == 1


def test_rounds_of_few_edges_are_stored_in_few_partitions(spark, rounds, monkeypatch):
    edges = random_edges(40, random.Random(4))
    with_conf = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        assert labels(spark, edges) == by_hand(edges)
        assert len(rounds) > 2 and set(rounds[1:]) == {1}
        monkeypatch.setattr(module, "EDGES_A_TASK", 10)
        del rounds[:]
        assert labels(spark, edges) == by_hand(edges)
        assert 1 < rounds[1] <= 23
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
