"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the whole text, in an Arrow function. Trees are grown on binned statistics of a bounded sample
of labelled documents (``SAMPLE`` rows of least hash), flattened into arrays, and walked for all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import byte_texts, scratch, small_batches, whole_text

SAMPLE = 20_000  # labelled rows that a model is fitted on, at most
TREES, DEPTH, BINS, RATE, SMOOTH, LEAST = 80, 4, 64, 0.15, 1.0, 8

FEATURES = (
    "chars", "words", "lines", "word_length", "word_length_spread", "line_length", "upper", "digits", "spaces", "marks", "symbols", "bangs",
    "beyond_ascii", "distinct_words", "repeated_neighbours", "top_word", "distinct_lines", "repeated_line_chars", "letter_entropy",
    "short_words", "long_words", "stops_a_word", "words_with_symbols", "upper_words", "distinct_triples",
)

_BYTE = np.arange(256)
_UPPER, _DIGIT = (_BYTE >= 65) & (_BYTE <= 90), (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_MARK = np.isin(_BYTE, list(b".,;:?'\"()-"))
_ALPHA = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122))
_HIGH = _BYTE >= 128
_SYMBOL = ~(_ALPHA | _DIGIT | _SPACE | _MARK | _HIGH) & (_BYTE > 32)
_SYMBOLS = bytes(int(b) for b in _BYTE[_SYMBOL])


def statistics(text: bytes) -> list[float]:
    """The numbers of FEATURES for one text; all 0 for an empty one. Counts enter as logarithms, the rest as shares."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    w = max(len(words), 1)
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    counts: dict[bytes, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    of_lines: dict[bytes, int] = {}
    for x in lines:
        of_lines[x] = of_lines.get(x, 0) + 1
    letters = hist[_ALPHA | _HIGH]
    share = letters[letters > 0] / max(letters.sum(), 1)
    triples = len(set(zip(words, words[1:], words[2:])))
    odd = sum(1 for x in counts if x.strip(_SYMBOLS) != x)
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), float(size.mean()), float(size.std()), np.log1p(n / m),
        hist[_UPPER].sum() / n, hist[_DIGIT].sum() / n, hist[_SPACE].sum() / n, hist[_MARK].sum() / n, hist[_SYMBOL].sum() / n, hist[33] / n,
        hist[_HIGH].sum() / n, len(counts) / w, sum(a == b for a, b in zip(words, words[1:])) / w, max(counts.values(), default=0) / w,
        len(of_lines) / m, sum(len(x) * (c - 1) for x, c in of_lines.items()) / n, float(-(share * np.log2(share)).sum()),
        float((size <= 2).mean()), float((size >= 12).mean()), hist[46] / w, odd / max(len(counts), 1), sum(c for x, c in counts.items() if x.isupper()) / w,
        triples / max(len(words) - 2, 1),
    ]


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([statistics(t) for t in byte_texts(batch)], pa.list_(pa.float64()))

    return measured(whole_text(text))


@dataclass
class Forest:
    """Flat trees: node i of tree t asks whether feature[t, i] is over cut[t, i] and goes to 2i+2, else to 2i+1."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for the rows of a matrix; all trees of a block of rows walk together."""
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))[:, None]
        for k in range(0, len(x), 4096):
            rows = np.arange(k, min(k + 4096, len(x)))[None, :]
            node = np.zeros((len(self.feature), rows.shape[1]), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
            out[rows[0]] = self.base + self.value[trees, node].sum(axis=0)
        return 1 / (1 + np.exp(-out))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Second-order boosting of the logistic loss on quantile bins; without rows of both labels, the constant prior."""
    n, inner, nodes = len(y), 2**DEPTH - 1, 2 ** (DEPTH + 1) - 1
    rate = (y.sum() + 1) / (n + 2)
    base = float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    width = BINS + 1
    flat = binned + np.arange(x.shape[1]) * width
    feature, cut, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    raw = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            if len(rows) >= 2 * LEAST:
                where = flat[rows].ravel()
                size = x.shape[1] * width
                g = np.bincount(where, np.repeat(grad[rows], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                h = np.bincount(where, np.repeat(hess[rows], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                c = np.bincount(where, minlength=size).reshape(-1, width).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + SMOOTH) + (gt - g) ** 2 / (ht - h + SMOOTH) - gt**2 / (ht + SMOOTH)
                gain[(c < LEAST) | (len(rows) - c < LEAST)] = -1
                f, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, i], cut[t, i] = f, cuts[f][b]
            node[rows] = 2 * i + 1 + (x[rows, feature[t, i]] > cut[t, i])
        for i in range(inner, nodes):
            rows = node == i
            if rows.any():
                value[t, i] = -RATE * grad[rows].sum() / (hess[rows].sum() + SMOOTH)
        raw += value[t, node]
    return Forest(base, feature, cut, value)


def is_held_out(id_col: str) -> Column:
    """One row in four by the checksum of the id; NULL ids are held out, as they can carry no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Forest:
    """Model from the labelled rows that are not held out: at most ``sample`` of them, those of least hash.

    The hash bound is taken from the labels before any text is read, so only the sampled texts are measured. A document
    with several labels counts once with each; NULL labels and labels without a document are left out.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isNotNull() & ~is_held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_y"))
    picked = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")
    rows = texts.select("_id", "_y", statistics_column(F.col("_text")).alias("x")).toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.array(rows["x"].tolist())
    order = np.lexsort([*x.T, rows["_y"].to_numpy(), rows["_id"].to_numpy()])  # the same rows give the same model in any order
    return fit(x[order], rows["_y"].to_numpy()[order])


def scored(docs: DataFrame, model: Forest, out: str, text: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 in ``out``; NULL and empty texts are scored as texts without any words."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.score(np.array([statistics(t) for t in byte_texts(batch)]).reshape(-1, len(FEATURES))))

    return docs.withColumn(out, probability(whole_text(text)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score and predicted (1 from ``threshold`` on)."""
    rows = scored(docs.select(F.col(id_col), F.col(text)), train(docs, labels, id_col, text, sample=sample), "score", text)
    return rows.select(id_col, is_held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their columns."""
    name = scratch(docs, "score")["score"]
    return scored(docs, train(docs, labels, id_col, text, sample=sample), name, text).where(F.col(name) >= threshold).drop(name)
