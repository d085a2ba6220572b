"""The pipeline's stages on small tables: each against brute force on its own input, and on awkward rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_small import brute_leaks, distance, least_reachable, prose
from test_near_copies import brute_shingles, brute_similarity

import corpus_pipeline
from pathlore.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    folder = tmp_path_factory.mktemp("tables")
    items = [(i, prose(rng, 25)) for i in range(4)]
    passage = prose(rng, 60)
    rows = []
    for i in range(60):
        lines = [prose(rng, rng.randint(8, 30)) for _ in range(rng.randint(1, 4))]
        if i % 6 == 0:
            lines.insert(1, passage if i % 12 else passage + "x")
        if i % 15 == 3:
            lines.append("see " + items[i // 15][1] + " end")
        rows.append([i, "\n".join(lines), "en", f"src{i % 3}", None])
    rows += [[70, rows[1][1], "en", "src1", 1], [71, rows[2][1].replace("\n", "  "), None, None, 1], [72, None, "en", "src0", 0], [73, "", "en", "src0", 0]]
    rows += [[74, rows[4][1], "en", "src1", 1]] * 2 + [[None, prose(rng, 20), "en", "src2", 1]]
    poor = [[200 + i, " ".join(["BUY!!"] * rng.randint(20, 60)), "en", "src0", 5] for i in range(60)]
    labels = [(r[0], 1) for r in rows if r[0] is not None and r[1]] + [(r[0], 0) for r in poor]
    spark.createDataFrame(rows + poor, SCHEMA).withColumns(
        {"row": F.lit(1), "_r1": F.lit("a"), "_score": F.lit(0.5), "mix_time": F.lit("then"), "size": F.lit(3)}
    ).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").withColumn("toxic", F.lit(None).cast("int")).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def by_id(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"]) for r in df.collect())


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Inputs and outputs of every stage, each stored and read again."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = docs, after
        docs = after
    return out


def test_names_and_columns(stages):
    assert list(stages) == ["quality_classifier", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    for name, (before, after) in stages.items():
        if name != "source_mixing":
            assert after.columns == before.columns and after.dtypes == before.dtypes


def test_poor_documents_go_and_good_ones_stay(stages):
    before, after = stages["quality_classifier"]
    assert after.where("doc_id >= 200").count() == 0
    assert after.where("doc_id < 72").count() == before.where("doc_id < 72").count()


def test_lines_against_brute_force(stages):
    before, after = stages["line_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.dropDuplicates(["doc_id", "text"]).collect()]
    flat = sorted((d is None, d or 0, p, x.strip(" \t\x0b\x0c\r")) for d, t in rows for p, x in enumerate((t or "").split("\n")))
    flat = [x for x in flat if x[3]]
    long = lambda i: len(flat[i][3]) >= 32
    near = lambda i, j: flat[i][3] == flat[j][3] or (long(i) and long(j) and abs(len(flat[i][3]) - len(flat[j][3])) <= 1 and distance(flat[i][3], flat[j][3]) <= 1)
    first = least_reachable(list(range(len(flat))), near)
    gone = {x[:3] for i, x in enumerate(flat) if first[i] != i}
    assert gone
    want = [((d is None, d or 0), t if not any((d is None, d or 0, p) in gone for p in range(9)) else "\n".join(
        x for p, x in enumerate(t.split("\n")) if (d is None, d or 0, p) not in gone)) for d, t in ((r["doc_id"], r["text"]) for r in before.collect())]
    assert by_id(after) == sorted(want, key=str) or sorted(by_id(after), key=str) == sorted(want, key=str)
    assert after.where("n_chars <> length(text) and n_chars > 5").count() == 0


def test_one_of_each_near_group_against_brute_force(stages):
    before, after = stages["simhash_near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    sets = [brute_shingles(t) for _, t in rows]
    comp = least_reachable([d for d, _ in rows], lambda a, b: brute_similarity(sets[a], sets[b]) >= 0.8)
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(set(comp))


def test_leaks_against_brute_force(stages, spark, sf_dir):
    before, after = stages["benchmark_decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    bad = {d for d, _ in brute_leaks(rows, items)}
    assert bad and sorted(map(str, (r["doc_id"] for r in after.collect()))) == sorted(str(d) for d, _ in rows if d not in bad)


def test_mix_meets_its_targets(stages):
    before, after = stages["source_mixing"]
    size, largest = Counter(), 0
    for r in before.collect():
        n = len((r["text"] or "").split())
        size[r["source"]] += n
        largest = max(largest, n)
    target = mixing.fair_targets(dict(size), (3, 1, 2), 1.5)
    taken, copies = Counter(), Counter()
    for r in after.collect():
        taken[r["source"]] += len(r["text"].split())
        copies[r["doc_id"], r["text"]] += 1
    assert max(copies.values()) <= 2 and all(abs(taken[s] - target[s]) <= 2 * largest for s in size)
    assert dict(after.dtypes)["mix_time"] == "double"


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    key = lambda df: Counter((r["doc_id"], r["text"], r["mix_round"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf_dir)) == key(stages["source_mixing"][1])


def test_every_stage_takes_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
