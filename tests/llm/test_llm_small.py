"""Corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathlore.llm import (
    components, contamination, context_tree, exact_dedup, licenses, line_dedup, mixing, quality, secrets, simhash, token_counts,
)
from pathlore.llm.common import scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = ["alpha", "beta", "Gamma", "delta", "epsilon", "zeta", "Éta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi"]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "s", "ed"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = [(0, None, "en", "a", None), (1, "", "en", "a", 0), (2, " \t\n", "en", None, 3), (3, "one", None, "b", 3), (4, "one", "en", "b", 3), (None, "one two", "en", "b", 7)]
    base = prose(rng, 120)
    for i in range(5, 30):
        text = prose(rng, rng.randint(1, 60)).replace(" ", "\n", 1)
        out.append((i, text, "en", rng.choice(["a", "b", "c", None]), len(text)))
    out += [(40, base, "en", "c", len(base)), (41, base + " ", "en", "c", 0), (42, base.replace(" ", "  ", 1), "en", "c", 0), (43, base + " more", "en", "c", 0)]
    out += [(44, base, "en", "c", 0), (44, base, "en", "c", 0), (45, prose(rng, 30_000), "en", "c", 0), (46, "x" * 200_000, "en", "c", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 secrets ------------------------------------------------------------------------------------------------------

KEY = "AKIA" + "Q7" * 8
BLOB = "aZ9" * 10


def spans(text):
    return [(f["kind"], f["start"], f["end"]) for f in secrets.scan(text.encode())["findings"]]


def base_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, b, k in sorted(found)]


@pytest.mark.parametrize("text", [
    "é token = secret: abcdefghij", "TOKEN='abcdefgh' passwd:short", f"x {KEY} AKIAAKIASHORT", "0" * 31 + " " + "a" * 40, "paſſword=abcdefghijk", "api_key==abcdefgh",
    "api-key=abcdefgh apikey : \"abcdefgh", "", "secret" * 50, f"token={'f' * 40}",
])
def test_base_spans_are_those_of_the_rules(text):
    got = [s for s in spans(text) if s[0] in secrets.BASE]
    assert got == base_spans(text)


def test_weak_candidates_need_a_complement_in_their_scope():
    far = " word" * 100
    kinds = lambda text: [k for k, *_ in spans(text)]
    assert kinds(f"user: bob and http://host.example/x {far}") == []
    assert kinds(f"just {BLOB} here") == []
    assert kinds(f"user: bob {BLOB}") == ["identifier", "secret"]
    assert kinds(f"user: bob\n\n{BLOB}") == []  # a blank line ends the scope
    assert kinds(f"user: bob {far} {BLOB}") == ["identifier", "secret"]  # the scope alone bounds the join
    assert secrets.scan(f"user: bob {far} {BLOB}".encode(), reach=200)["findings"] == []
    assert kinds(f"https://host.example/{BLOB}/x and user: bob") == ["endpoint", "secret", "identifier"]  # a secret inside an endpoint
    assert kinds(f"https://host.example/{BLOB}/x alone") == []
    assert kinds("https://host.example/?login=bobby&token=abc123") == ["endpoint", "identifier", "secret"]
    assert kinds("https://host.example/?token=abc123 login=bobby") == ["endpoint", "secret", "identifier"]
    assert kinds("token=abcdefgh at http://host.example/x") == ["assign", "endpoint"]
    assert kinds(f"é {KEY} 10.0.0.1 password=abc123") == ["access", "endpoint", "secret"]
    assert kinds(f"{KEY} 10.0.0.1") == ["access"]  # an address beside a name is no credential


def test_secrets_at_the_end_of_a_very_long_text():
    filler = "é word " * 60_000 + "\n\n"
    text = filler + f"login: bobby {filler[:200]} {BLOB}\n\n" + filler + f"token=abcdefgh {KEY}"
    first = text.index("login")
    assert spans(text)[:2] == [("identifier", first, first + 12), ("secret", text.index(BLOB), text.index(BLOB) + len(BLOB))]
    assert [k for k, *_ in spans(text)] == ["identifier", "secret", "assign", "access"]
    assert [s for s in spans(text) if s[0] in secrets.BASE] == base_spans(text)


def test_interval_join_finds_a_partner_where_brute_force_does():
    rng = random.Random(3)
    for _ in range(200):
        cut = sorted(rng.sample(range(1000), 24))
        parts = [secrets.Part(a, b, "x") for a, b in zip(cut[::2], cut[1::2])]
        left, right = parts[::2], parts[1::2]
        scope = lambda at: at // 300
        near = lambda p, q: max(p.start, q.start) - min(p.end, q.end) <= 60 and scope(p.start) == scope(q.start)
        assert {p for p, _ in secrets.interval_join(left, right, scope, 60)} == {p for p in left if any(near(p, q) for q in right)}


def test_secret_digest(spark, docs, empty, rows):
    text = f"k {KEY} token=abcdefgh"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y")], "doc_id long, text string, _scan string")
    got = {r["doc_id"]: r for r in secrets.secret_digest(df).collect()}
    want = ",".join(":".join(map(str, s)) for s in base_spans(text))
    assert (got[1]["n_assign"], got[1]["n_access"], got[1]["n_hex"], got[1]["spans"]) == (1, 1, 0, want)
    assert got[1]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert (got[2]["spans"], got[2]["base_sha256"]) == ("", hashlib.sha256(b"").hexdigest())
    assert "_scan" in secrets.find_secrets(df).columns
    assert secrets.secret_digest(empty).count() == 0 and secrets.secret_digest(docs).count() == len(rows)


# ---- 2 context trees ------------------------------------------------------------------------------------------------


def brute_tree(train, text, depth):
    """log10 probability by the definition: a recursive weighting of every binary node's context tree."""
    nodes: dict = {}

    def places(t):
        padded = bytes(depth) + t + b"\0"
        for i in range(depth, len(padded)):
            for k in range(8):
                yield padded[i - depth : i], (k, padded[i] >> (8 - k)), padded[i] >> (7 - k) & 1

    for t in train:
        for context, prefix, bit in places(t):
            for d in range(depth + 1):
                nodes.setdefault((context[depth - d :], prefix), [0, 0])[bit] += 1
    kids: dict = {}
    for context, prefix in nodes:
        if context:
            kids.setdefault((context[1:], prefix), []).append((context, prefix))
    memo: dict = {}

    def kt(node):
        a, b = nodes.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(node):
        if node not in memo:
            own = kt(node)
            memo[node] = own if len(node[0]) == depth else float(np.logaddexp(own, sum(map(weighted, kids.get(node, [])))) - math.log(2))
        return memo[node]

    def predict(context, prefix, d):
        node = (context[depth - d :], prefix)
        if node not in nodes:
            return 0.5
        a, b = nodes[node]
        own = (b + 0.5) / (a + b + 1)
        if d == depth:
            return own
        stay = math.exp(kt(node) - math.log(2) - weighted(node))
        return stay * own + (1 - stay) * predict(context, prefix, d + 1)

    total = 0.0
    for context, prefix, bit in places(text):
        p = predict(context, prefix, 0)
        total += math.log10(p if bit else 1 - p)
    return total


def test_context_tree_is_the_recursive_definition(spark):
    texts = ["abracadabra", "abracadabra bra", "Cadabra é", "", None, "zzz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    raw = [lower(t or "").encode() for t in texts]
    train = [t for i, t in enumerate(raw) if i not in (2, 5)]
    got = {r["doc_id"]: r for r in context_tree.context_tree_scores(df, F.col("doc_id").isin(2, 5), depth=3, packet_bytes=16).collect()}
    for i, t in enumerate(raw):
        assert got[i]["score"] == pytest.approx(brute_tree(train, t, 3), rel=1e-5)


def test_word_counts_of_the_base_score(docs, empty, rows):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = context_tree.context_tree_scores(docs, held, packet_bytes=50_000).collect()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [(i, WORD.findall(lower(t or "")) + ["\0"]) for i, t, *_ in rows]
    count = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((i, out(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert context_tree.context_tree_scores(empty, held).count() == 0
    nothing = context_tree.context_tree_scores(docs.limit(5), F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["bits_per_byte"] == pytest.approx(8) for r in nothing)


# ---- 3 decontamination ----------------------------------------------------------------------------------------------


def brute_leaks(docs, items):
    out = {}
    for i, text in items:
        w = (text or "").lower().split()
        if not w:
            continue
        k = min(5, len(w))
        want = {" ".join(w[a : a + k]) for a in range(len(w) - k + 1)}
        for d, t, *_ in docs:
            x = (t or "").lower().split()
            have = {" ".join(x[a : a + k]) for a in range(len(x) - k + 1)}
            share = len(want & have) / len(want)
            if share >= 0.8:
                out[d, i] = max(share, out.get((d, i), 0))
    return out


def test_leaks_are_those_of_brute_force(spark, rows, empty):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(3, 40))) for i in range(12)] + [(20, "one"), (21, None), (22, " "), (23, "one two"), (0, prose(rng, 9))]
    planted = [t for t in rows]
    for i, text in items[:12]:
        w = text.split()
        for keep in (1.0, 0.95, 0.85, 0.7):
            x = list(w)
            for a in rng.sample(range(len(x)), round(len(x) * (1 - keep) / 5)):
                x[a] = "changed"
            planted.append((100 + i * 10 + round(keep * 10), prose(rng, 900) + " " + " ".join(x).upper() + "\n" + prose(rng, 30), "en", "a", 0))
    df = spark.createDataFrame(planted, SCHEMA).withColumn("item_id", F.lit(9)).withColumn("words", F.lit("clash"))
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in contamination.leak_pairs(df, tests).collect()}
    assert got == pytest.approx(brute_leaks(planted, items))
    clean = contamination.drop_leaks(df, tests)
    bad = {d for d, _ in got}
    assert clean.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in clean.collect()) == sorted((d is None, d or 0) for d, *_ in planted if d not in bad)
    assert contamination.leak_pairs(empty, tests).count() == 0 and contamination.leak_pairs(df, tests.limit(0)).count() == 0
    assert contamination.drop_leaks(df, tests.limit(0)).count() == len(planted)


# ---- 4 quality ------------------------------------------------------------------------------------------------------


def test_trees_separate_and_walk_as_single_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x[:400], y[:400], trees=30)
    assert ((model.score(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    for row in x[:5]:
        total = model.base
        for f, c, v in zip(model.feature, model.cut, model.value):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node]
        assert model.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-total)))
    assert len(set(quality.fit(x[:10], np.ones(10)).score(x))) == 1


def test_quality_scores(spark, docs, empty, rows):
    rng = random.Random(2)
    good = [(100 + i, prose(rng, 50), "en", "a", 0) for i in range(120)]
    poor = [(300 + i, " ".join(["BUY!!"] * rng.randint(20, 60)), "en", "a", 0) for i in range(120)]
    df = docs.unionByName(spark.createDataFrame(good + poor, SCHEMA))
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in poor] + [(None, 1), (5, None), (9999, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality_scores(df, labels).collect()}
    held = [r for i, r in got.items() if i is not None and i >= 100 and r["held_out"]]
    assert held and all(r["predicted"] == (r["doc_id"] < 300) == (r["score"] >= 0.7) for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert 0 <= got[0]["score"] <= 1 and got[0]["score"] == got[1]["score"]
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id >= 300").count() == 0 and kept.where("doc_id between 100 and 299").count() == 120
    assert quality.quality_scores(empty, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


# ---- 5 mixing -------------------------------------------------------------------------------------------------------


def test_targets_fill_up_to_their_limits():
    got = mixing.fair_targets({"b": 100, "a": 10, None: 40}, (3, 1, 2), 1.5)
    assert got == {"a": 20, "b": pytest.approx(225 - 20 - 80), None: 80}
    assert mixing.fair_targets({}, (1,), 1.5) == {} and mixing.fair_targets({"a": 0}, (1,), 1.5) == {"a": 0}


@pytest.mark.parametrize("ranges", [1, 13, None])
def test_mix_is_the_queue_of_brute_force(docs, empty, rows, ranges):
    got = mixing.mix_counts(docs, ranges=ranges).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    target = mixing.fair_targets(dict(size), (3, 1, 2), 1.5)
    taken, by_id = Counter(), {i: s for i, _, _, s, _ in rows}
    largest = Counter()
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + max(largest.values())
    assert sum(taken.values()) <= sum(target.values()) + 1e-6
    key = lambda rs: Counter((r["doc_id"], r["size"], r["taken"]) for r in rs)
    assert key(got) == key(mixing.mix_counts(docs.repartition(5), ranges=7).collect())  # the same at every size of ranges
    assert mixing.mix_counts(empty).count() == 0


def test_mix_rows_match_the_counts(docs):
    total = sum(r["taken"] for r in mixing.mix_counts(docs).collect())
    mixed = mixing.mix(docs)
    assert {"mix_round", "mix_time", *docs.columns} == set(mixed.columns)
    got = mixed.collect()
    words = sum(len(WORD.findall(r["text"])) for r in got)  # keys differ from ids, so the order of the documents does
    assert abs(words - total) <= 2 * 30_000 and [r["mix_time"] for r in got] == sorted(r["mix_time"] for r in got)
    assert max(Counter(r["doc_id"] for r in got if r["doc_id"] != 44).values()) <= 2
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_mix_of_repeated_rows_keeps_its_budget(spark):
    text = " ".join(["word"] * 10)
    docs = spark.createDataFrame([(1, text, "a", "x"), (1, text, "a", "y"), (2, text, "a", "z"), (2, text, "a", "z")], "doc_id long, text string, source string, note string")
    mixed = mixing.mix(docs, weights=(1,), share=0.5).collect()
    assert sum(len(r["text"].split()) for r in mixed) == 20 == sum(r["taken"] for r in mixing.mix_counts(docs, weights=(1,), share=0.5).collect())


# ---- 6 simhash ------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    import xxhash

    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    cut = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in cut]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(cut))


def least_reachable(ids, linked):
    least = {i: i for i in range(len(ids))}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j) and root(i) != root(j):
                least[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(ids))]


def test_fingerprints_and_components(docs, empty, rows):
    got = simhash.simhash_components(docs).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    comp = least_reachable([i for i, *_ in rows], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{f:016x}", c) for (i, *_), f, c in zip(rows, fps, comp))
    assert simhash.simhash_components(empty).count() == 0


def test_spark_hashes_like_the_library(spark):
    import xxhash

    texts = ["", "a", "é b c", "x" * 100]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()]
    assert [h % (1 << 64) for h in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


@pytest.mark.parametrize("shard", [3, 4096])
def test_trees_lose_no_link(spark, shard):
    rng = random.Random(4)
    fps = {0, 1, 7}
    while len(fps) < 150:
        f = rng.choice(sorted(fps)) if rng.random() < 0.7 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), shard=shard).collect()
    assert all((a % (1 << 64) ^ b % (1 << 64)).bit_count() for a, b in links)
    place = {f: i for i, f in enumerate(signed)}
    pairs = {frozenset((place[a], place[b])) for a, b in links}
    want = least_reachable(list(range(len(fps))), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert least_reachable(list(range(len(fps))), lambda i, j: frozenset((i, j)) in pairs) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


# ---- 7 licenses -----------------------------------------------------------------------------------------------------


def test_notices_are_found_anywhere(spark, docs, empty):
    rng = random.Random(6)
    texts, want = [], set()
    for i, (name, notice) in enumerate(licenses.TEMPLATES):
        for j, before in enumerate((0, 1, 3, 700)):
            doc = 1000 + i * 10 + j
            texts.append((doc, prose(rng, before) + "\n" + notice.upper() + "\n" + prose(rng, 20)))
            want.add((doc, name))
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("words", F.lit("clash"))
    got = licenses.document_licenses(df).collect()
    assert {(r["doc_id"], r["license"]) for r in got} >= want
    assert all(r["containment"] >= 0.8 for r in got)
    assert licenses.document_licenses(docs).count() == 0 and licenses.document_licenses(empty).count() == 0
    assert licenses.document_licenses(df, templates=[("none", "too short"), ("none", None)]).count() == 0


def test_bands_and_windows_cover_every_template_size():
    for n in range(1, 200):
        upper = 1 << math.ceil(math.log2(n))
        length, step = licenses.window_shape(upper)
        for start in range(0, 3 * step):
            first = start // step * step
            assert first <= start and first + length >= start + n
        least = math.ceil(0.8 * n - 1e-9) / (length + n - math.ceil(0.8 * n - 1e-9))
        assert 1 - (1 - least) ** licenses.BANDS > 0.9999


# ---- 8 tokens -------------------------------------------------------------------------------------------------------

public = pytest.importorskip("public_tokenizers")


def test_token_counts_are_those_of_whole_texts(docs, empty, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    got = token_counts.token_counts(docs, "piece_bpe_32k.model", 4096, piece=50, call=300)
    assert got.columns == [*docs.columns, "n_bytes", "n_tokens", "over_limit"]
    want = Counter((i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, *_ in rows if i != 46)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.where("doc_id is null or doc_id <> 46").collect()) == want
    assert token_counts.token_counts(empty, "piece_bpe_32k.model", 1).count() == 0


def test_cuts_are_safe():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    assert token_counts.can_cut("piece_bpe_32k.model") and not token_counts.can_cut("byte_bpe_50k.json")
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["a", "be ", " ", "▁", "\n", "é", "<s>", "  the", "日本", "\x00", " \n "]) for _ in range(rng.randint(0, 80)))
        parts = list(token_counts.safe_pieces(text, rng.randint(1, 12)))
        assert sum(len(sp.encode(p)) for p in parts) == len(sp.encode(text))


def test_other_vocabularies_encode_whole_texts(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(docs.where("doc_id < 30"), "byte_bpe_50k.json", 10).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in rows if i is not None and i < 30}


# ---- 9 lines --------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits):
    for _ in range(edits):
        i, way = rng.randint(0, len(text)), rng.random()
        text = text[:i] + rng.choice("abé") + text[i + (way < 0.3) :] if way < 0.7 else text[:i] + text[i + 1 :]
    return text


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_automaton_is_the_edit_distance(spark, threshold):
    rng = random.Random(threshold)
    pairs = []
    for n in [*range(7), 15, 16, 17, 31, 33, 48, 60] * 12:
        a = "".join(rng.choice("ab é") for _ in range(n))
        pairs.append((a, edited(rng, a, rng.randint(0, 4))))
    df = spark.createDataFrame(pairs, "x string, y string")
    got = df.select("x", "y", line_dedup.within_edits(F.col("x"), F.col("y"), threshold).alias("near")).collect()
    assert all(r["near"] == (distance(r["x"], r["y"]) <= threshold) for r in got)


@pytest.mark.parametrize("threshold,hot", [(1, 48), (1, 1), (2, 48)])
def test_copied_lines_are_those_of_brute_force(spark, threshold, hot):
    rng = random.Random(9)
    roots = ["".join(rng.choice("abcde é") for _ in range(n)).strip().ljust(n, "x") for n in (9, 12, 13, 20, 33)]
    texts = []
    for d in range(24):
        lines = [edited(rng, rng.choice(roots), rng.choice([0, 1, 1, 2, 5])) for _ in range(4)] + ["", "abc"]
        rng.shuffle(lines)
        texts.append((d, "\n".join(lines)))
    texts += [(30, None), (31, ""), (None, roots[0]), (32, "\r" + roots[1] + " ")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("place", F.lit(1)).withColumn("keys", F.lit("clash")).repartition(3)
    flat = [(d is None, d, p, x.strip(" \t\x0b\x0c\r")) for d, t in texts for p, x in enumerate((t or "").split("\n"))]
    flat = [x for x in flat if x[3]]
    flat.sort(key=lambda x: (x[0], x[1] or 0, x[2]))
    first = least_reachable(list(range(len(flat))), lambda i, j: distance(flat[i][3], flat[j][3]) <= (threshold if min(len(flat[i][3]), len(flat[j][3])) >= 8 else 0))
    dropped = {}
    for i, (_, d, p, _) in enumerate(flat):
        if first[i] != i:
            dropped.setdefault(d, set()).add(p)
    got = line_dedup.line_report(df, threshold=threshold, least=8, hot=hot).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_copies"], r["copies"]) for r in got} == {
        d: (len((t or "").split("\n")), len(dropped.get(d, ())), ",".join(map(str, sorted(dropped.get(d, ()))))) for d, t in texts
    }
    cleaned = line_dedup.drop_copied_lines(df, threshold=threshold, least=8, hot=hot)
    assert cleaned.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {
        d: t if d not in dropped else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in dropped[d]) for d, t in texts
    }


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_edits_of_texts_of_several_chunks(spark, monkeypatch, threshold):
    monkeypatch.setattr(line_dedup, "CHUNK", 32)
    rng = random.Random(12)
    pairs = []
    for n in (31, 32, 33, 63, 64, 65, 96, 97, 200):
        for edits in (0, 1, 1, 2, 2, 3, 4):
            x = "".join(rng.choice("abé\0") for _ in range(n))
            pairs.append((x, edited(rng, x, edits)))
    pairs += [("\0" + x, x) for x, _ in pairs[:5]] + [(x, "\0" + x) for x, _ in pairs[:5]]
    df = spark.createDataFrame(pairs, "x string, y string")
    for r in df.select("x", "y", line_dedup.within_edits(F.col("x"), F.col("y"), threshold).alias("near")).collect():
        assert r["near"] == (distance(r["x"], r["y"]) <= threshold), r


def test_variants_of_a_very_long_line(spark):
    rng = random.Random(13)
    base = "".join(rng.choice("abcdefg é") for _ in range(20_000)).strip().ljust(20_000, "x")
    texts = [base]
    for i in range(60):
        at = rng.randrange(len(base))
        texts.append(base[:at] + rng.choice(["", "Z", "Z" + base[at]]) + base[at + 1 :])
    texts += ["Y" + base, base + "Y", base[1:], base[:-1], "QQ" + base, base[:9000] + "QQ" + base[9002:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_copies"] for r in line_dedup.line_report(df).collect()}
    assert got == {i: int(0 < i < len(texts) - 2) for i in range(len(texts))}  # the last two are two edits from every other line


def test_line_dedup_edge_cases(docs, empty, rows):
    assert line_dedup.line_report(empty).count() == 0
    assert line_dedup.drop_copied_lines(docs, length="n_chars").count() == len(rows)


# ---- 10 exact dedup -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_cells", [32768, 1 << 29])
def test_exact_groups(docs, empty, rows, max_cells):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
    want = Counter()
    for t, members in groups.items():
        members.sort()
        for n, (_, none, i) in enumerate(members):
            keep = None if members[0][1] else members[0][2]
            want[(None if none else i, keep, len(members), n == 0, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_dedup.exact_dedup(docs.withColumn("sha", F.lit("clash")), max_cells=max_cells).collect()
    assert Counter(tuple(r) for r in got) == want
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_filter_without_room_changes_nothing(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 900).cast("string").alias("text"))
    got = exact_dedup.exact_dedup(df, max_cells=1).collect()
    assert sum(r["kept"] for r in got) == 900 and {r["keep_id"] for r in got} == set(range(900))


def test_names_do_not_clash(docs):
    assert scratch(docs.withColumn("_r1", F.lit(1)), "r1", "r2") == {"r1": "__r1", "r2": "_r2"}
