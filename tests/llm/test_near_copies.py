"""Near copies of the pipeline against brute-force Jaccard of five-word shingles."""

import random
from collections import Counter

import pytest
from test_llm_small import least_reachable, prose

import corpus_pipeline
from pathlore.llm import near_copies, simhash


def brute_shingles(text):
    words = (text or "").lower().split()
    span = min(5, len(words))
    return {tuple(words[k : k + span]) for k in range(len(words) - span + 1)} if words else set()


def brute_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def changed(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    rng = random.Random(5)
    rows, frame = [], prose(rng, 30)
    for _ in range(25):
        base = prose(rng, rng.randint(40, 300))
        rows.append(base)
        rows += [changed(rng, base, n) for n in (1, 2, 4, 7)]
        words = base.split()
        rows += [" ".join(words[: len(words) * k // 20]) for k in (15, 16, 17, 19)] + [base.replace(" ", "\n")]
    rows += [frame + " " + prose(rng, 12) for _ in range(40)] + ["", None, "  ", "one two", "One  two", "one two three", prose(rng, 4)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[i], t) for i, t in enumerate(rows)]


def test_groups_are_those_of_brute_force_jaccard(spark, monkeypatch):
    rows = corpus()
    sets = [brute_shingles(t) for _, t in rows]
    first = least_reachable([d for d, _ in rows], lambda a, b: brute_similarity(sets[a], sets[b]) >= 0.8)
    assert len(set(first)) < len(rows) - 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sample in (4000, 30):
        monkeypatch.setattr(near_copies, "SAMPLE", sample)
        assert Counter(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == Counter(set(first))


def test_copies_far_apart_in_their_fingerprints_go(spark):
    rng = random.Random(8)
    base = prose(rng, 400)
    rows = [(0, base)] + [(k, " ".join(base.split()[: 400 - 18 * k])) for k in range(1, 5)]
    assert brute_similarity(brute_shingles(rows[0][1]), brute_shingles(rows[4][1])) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [0]


def test_two_texts_under_one_id_both_stay(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(1, prose(rng, 50)), (1, prose(rng, 50)), (2, prose(rng, 50))], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, docs, "").count() == 3


def bits_apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b))


@pytest.mark.parametrize("shard", [4096, 3])
def test_fingerprint_search_links_what_is_near(spark, shard):
    rng = random.Random(11)
    whole = [(0, 0), ((1 << 64) - 1,) * 2]
    for _ in range(30):
        base = [rng.getrandbits(64), rng.getrandbits(64)]
        for n in (0, 0, 1, 4, 9, 15, 31):
            flip = rng.sample(range(128), n)
            whole.append(tuple(base[w] ^ sum(1 << f % 64 for f in flip if f // 64 == w) for w in (0, 1)))
    rows = [(k, *(x - (1 << 64) if x >> 63 else x for x in w)) for k, w in enumerate(whole)]
    got = [tuple(r) for r in simhash.wide_pairs(spark.createDataFrame(rows, "node long, low long, high long"), shard).collect()]
    assert len(set(got)) == len(got) and all(a < b and bits_apart(whole[a], whole[b]) <= simhash.WIDE_RADIUS for a, b in got)
    linked = least_reachable(list(range(len(rows))), lambda a, b: (min(a, b), max(a, b)) in set(got))
    assert all(linked[a] == linked[b] for a in range(len(rows)) for b in range(a) if bits_apart(whole[a], whole[b]) <= 15)


def test_stage_finds_its_copies_by_fingerprints(spark, monkeypatch):
    """The exact join behind the search gets only what the fingerprints left apart."""
    rng, asked = random.Random(12), []
    bases = [prose(rng, 200) for _ in range(20)]
    rows = [(2 * k + n, t) for k, b in enumerate(bases) for n, t in enumerate((b, changed(rng, b, 1)))]
    real = near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: asked.append(pairs.count()) or real(pairs, *a))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == Counter(range(0, 40, 2))
    assert asked[0] == 20 and sum(asked[1:]) == 0
