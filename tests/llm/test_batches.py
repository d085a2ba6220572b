"""Texts reach Python functions some BATCH_BYTES at a time."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathlore.llm import common, near_copies, quality


@pytest.fixture
def unset(spark):
    had = spark.conf.get(common._BYTES, None)
    spark.conf.unset(common._BYTES)
    yield
    spark.conf.unset(common._BYTES) if had is None else spark.conf.set(common._BYTES, had)


def batch_bytes(text):
    """Bytes of the batch that a text came in."""

    @F.arrow_udf("long")
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([sum(len(t.as_py()) for t in batch)] * len(batch), pa.int64())

    return held(text)


def texts(spark):
    return spark.range(80, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word"), F.col("id"), F.lit(" ")), 15_000).alias("text"))


def stump():
    return quality.Forest(0.0, np.zeros((0, 31), np.int64), np.zeros((0, 31)), np.zeros((0, 31)))


@pytest.mark.parametrize("step", [lambda docs: quality.scored(docs, stump(), "p"), near_copies.drop_copies])
def test_batches_are_bounded_by_bytes(spark, unset, step):
    docs = texts(spark)
    total = docs.select(F.sum(F.length("text"))).first()[0]
    rows = step(docs)
    most, n = docs.select(batch_bytes("text").alias("b")).agg(F.max("b"), F.count("b")).first()
    assert rows.count() == n == 80
    assert most <= 2 * common.BATCH_BYTES < total


def test_a_limit_of_the_session_stays(spark, unset):
    spark.conf.set(common._BYTES, 12345678)
    quality.scored(texts(spark), stump(), "p")
    assert spark.conf.get(common._BYTES) == "12345678"
