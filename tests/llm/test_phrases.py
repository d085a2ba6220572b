"""Phrase mining against counting every gram by hand."""

import random
import re
import weakref
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathlore.llm import phrases

SCHEMA = "lang string, text string, n long, score string"


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(rows, least, longest, cover, top):
    f, n = {}, Counter()
    for lang, text, *_ in rows:
        lang = lang or "und"
        for words in pieces(text):
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        known = {g: a for g, a in counts.items() if a >= least and len(g) > 1}
        held = Counter()
        for g, a in known.items():
            for size in range(2, len(g)):
                for i in range(len(g) - size + 1):
                    held[g[i : i + size]] = max(held[g[i : i + size]], a)
        found = []
        for g, a in known.items():
            if held[g] and 100 * held[g] >= cover * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (s, a, g, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocab = ["ab", "Ba", "cé", "d", "Éa", "ﬀ", "😀", "x y"]
    passage = "one two  three\tFour five six seven eight nine ten"
    out = []
    for i in range(300):
        words = [rng.choice(vocab) + rng.choice(["", "", ",", ".", "\n"]) for _ in range(rng.randint(0, 40))]
        text = rng.choice([" ", "\t", "  "]).join(words) + rng.choice(["", f" {passage} ", f". {passage}!", " ab ab ab ab ab ab ab "])
        out.append((rng.choice(["en", "en", "en", "de", None, "und"]), text, 1, "x"))
    out += [("en", None, 1, "x"), ("en", "", 1, "x"), (None, " .\n", 1, "x"), ("fr", "ab " * 5000, 1, "x"), ("fr", "z" * 100_000, 1, "x")]
    return out + out[:20]


@pytest.mark.parametrize("least, longest, cover, top", [(3, 5, 100, 50), (1, 3, 60, 10_000), (2, 4, 100, 7), (5, 2, 100, 100)])
def test_collocations_are_those_of_every_gram_counted(spark, rows, least, longest, cover, top):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = phrases.collocations(docs, least, longest, cover, top, packet=2000)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, longest, cover, top)


def test_a_full_bitmap_only_costs_time(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "is_set", lambda bitmap, hashes: np.ones(len(hashes), bool))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = phrases.collocations(docs, 3, 5, 100, 50)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, 5, 100, 50)


def test_unary_paths_are_compacted_to_whole_passages(spark):
    rows = [("en", "p q one two three four five six seven r s", 0, "")] * 3 + [("en", "u one two three four five six seven v", 0, "")] * 2
    graph = phrases.PhraseGraph(spark.createDataFrame(rows, SCHEMA), least=2, longest=3)
    got = {tuple(r) for r in graph.paths(graph.counts()).collect()}
    assert got == {
        ("en", "p q one two", 3, 2), ("en", "one two three four five six seven", 5, 5), ("en", "u one two", 2, 1),
        ("en", "six seven r s", 3, 2), ("en", "six seven v", 2, 1),
    }


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    row = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in zip("anlr", (big, 25 * big, big + 1, 2 * big + 1))])
    got = row.select(phrases.score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1000 * big * 25 * big // ((big + 1) * (2 * big + 1))


def test_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def counting_passes():
    every = SimpleNamespace(value=np.full(4096, 255, np.uint8))
    return [phrases._word_counts(1 << 22), phrases._pair_counts(1 << 22, every), phrases._edge_counts(1 << 22, every, every, 5)]


def test_counted_grams_are_sent_on_in_bounded_batches():
    text = " ".join(f"w{i}" for i in range(150_000))
    batch = pa.record_batch([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
    words, _, edges = (list(count(iter([batch]))) for count in counting_passes())
    for out, rows in ((words, 150_000), (edges, 149_999)):  # the last word alone is no edge
        assert max(b.num_rows for b in out) <= 1 << 16
        assert sum(b.num_rows for b in out) == sum(sum(b["n"].to_pylist()) for b in out) == rows
        assert len({g for b in out for g in b["gram"].to_pylist()}) == rows


def test_counting_holds_one_batch_of_texts():
    for count in counting_passes():
        seen = []

        def batches():
            for _ in range(3):
                batch = pa.record_batch([pa.array(["en"] * 2), pa.array(["one two three", "four. five six"])], names=["lang", "text"])
                seen.append(weakref.ref(batch))
                yield batch
                del batch
                assert seen[-1]() is None

        assert sum(b.num_rows for b in count(batches())) and len(seen) == 3
