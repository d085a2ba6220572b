"""Cases that earlier versions left out."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pathlore.llm import context_tree


def test_an_unseen_byte_after_a_frequent_context_has_a_finite_score():
    texts = {b"aaaa\xff": 30_000_000, b"aaaa\x00": 0, b"eeea\xff": 270_000_000, b"eeea\x00": 1000}
    order = sorted(texts)
    keys = np.array([int.from_bytes(k, "big") for k in order], np.uint64)
    counts = np.array([texts[k] for k in order], np.int64)
    shard = int(context_tree.string_shard(keys)[0])
    assert set(context_tree.string_shard(keys)) == {shard}
    name = (pa.scalar("b"), pa.scalar(shard, pa.int32()))
    lists = pa.table({"packet": [1], "keys": [context_tree.squeeze_keys(keys)], "counts": [context_tree.squeeze(counts)]})
    model = context_tree.shard_model(4)(name, lists)
    low = context_tree.low_depths([(shard // context_tree.CLASSES, *np.frombuffer(model["sums"][0].as_py()).reshape(3, 256))])
    got = context_tree.unsqueeze(context_tree.answers(low)(name, lists, model)["data"][0].as_py(), np.float32)
    want = context_tree.log10_of(keys, context_tree.weigh(keys, counts, 4)[0], low)
    assert np.isfinite(got).all() and np.allclose(got, want, rtol=1e-5)


def test_exact_copies_of_short_lines_go_in_the_pipeline(spark):
    long = "a line that is long enough to be compared within one edit"
    rows = [(1, f"All rights reserved.\n{long}\n\nx", 5), (2, f"first\n All rights reserved.\r\n{long}!\n", 5), (3, "All rights reserved!\n\nx\nx", 5), (4, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_copied_lines(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], 5), 2: ("first\n", 6), 3: ("All rights reserved!\n", 21), 4: (None, 0)}
