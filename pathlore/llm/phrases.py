"""Phrase collocations mined from a weighted de Bruijn graph of word grams.

Nodes are grams of ``longest - 1`` words, edges grams of ``longest`` words that join two overlapping nodes, weights are
occurrences. Only the longest gram at each place is aggregated; a gram that a piece ends is kept with its own length and
is the correction of the piece's end. All shorter counts follow from the flow: a node occurs as often as its outgoing
edges and the ends at it together, and so on one word less at a time. Paths of nodes with one way in and one way out are
compacted to one phrase each, from which the grams that a longer one covers are read.

A phrase that occurs ``least`` times consists of words and of word pairs that occur ``least`` times. Two earlier passes
count those; bitmaps of their hashes (16 bits for each, never over ``MAX_BITS``) go to the tasks, and a place that misses
ends a piece there. A false hit only keeps a place that could have gone, so the counts are exact for any size of bitmap.
Every pass counts within packets of text first, and no group is ever gathered: a hot gram is one row a packet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.llm.common import stored, whole_text

BREAKS = ".,;:!?\n\x0b\x0c\r"
GAPS = " \t"
PACKET_BYTES = 4 << 20  # text counted at once within a task
SPELLED = 1 << 16  # counted grams that are spelled out, and sent on, at once
BITS_PER_GRAM = 16
MAX_BITS = 1 << 29  # 64 MB, the most that is sent to an executor
BUCKET_BITS = 32768  # bits of one bitmap of Spark's bitmap functions
TOTALS_BYTES = 16 << 20
NO_LANG = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 letter of a word, 1 gap, 2 end of a piece
_KIND[[ord(c) for c in GAPS]] = 1
_KIND[[ord(c) for c in BREAKS]] = 2


def packets(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(lang, text) of whole rows, with at most ``limit`` bytes of text unless a single row is longer."""
    for batch in batches:
        lang, text = batch.column(0), batch.column(1).cast(pa.large_string())
        ends = np.cumsum(np.asarray(pc.binary_length(text).to_numpy(zero_copy_only=False), np.int64))
        start = 0
        while start < len(text):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield lang.slice(start, stop - start), text.slice(start, stop - start)
            start = stop
        del batch, lang, text  # before the next one is read
        pa.default_memory_pool().release_unused()


class Words:
    """The words of a packet: ``unit`` numbers their (lang, word), ``joined[i]`` says that i and i + 1 share a piece."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        data = _LOWER[raw]
        kind = _KIND[data]
        letter = kind == 0
        ended = np.cumsum(kind == 2, dtype=np.int32) if len(kind) < 1 << 31 else np.cumsum(kind == 2)
        del kind
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = letter[:-1], letter[1:]
        filled = offsets[1:] > offsets[:-1]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after)
        del before, after
        row = np.searchsorted(offsets, starts, "right") - 1
        piece = ended[starts] + row
        del ended
        bounds = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts + 1, out=bounds[1:])
        whole = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[letter]))
        coded = whole.dictionary_encode()
        langs = lang.dictionary_encode()
        size = max(1, len(coded.dictionary))
        unit, self.units = numbered(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + coded.indices.to_numpy(zero_copy_only=False))
        self.unit = unit
        self.lang = langs.dictionary.take(pa.array(self.units // size))
        self.word = coded.dictionary.take(pa.array(self.units % size))
        self.joined = piece[1:] == piece[:-1]

    def hashes(self) -> np.ndarray:
        return word_hashes(self.lang.to_pylist(), self.word.to_pylist())


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of integer keys, and the key of each number."""
    coded = pa.array(keys, pa.int64()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)


def word_hashes(langs: list[str], words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{a}\t{b}") for a, b in zip(langs, words)], np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes % np.uint64(len(bitmap) * 8)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def rows_of(words: Words, units: np.ndarray, place: np.ndarray, size: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted grams as text, ``SPELLED`` at a time: the words ``units[place]`` to ``units[place + size - 1]``."""
    for start in range(0, len(counts), SPELLED):
        at, n = place[start : start + SPELLED], counts[start : start + SPELLED]
        spelled = [words.word.take(pa.array(units[at + k])) for k in range(size)]
        gram = spelled[0] if size == 1 else pc.binary_join_element_wise(*spelled, pa.scalar(" ", pa.large_string()))
        yield pa.record_batch(
            [words.lang.take(pa.array(units[at])).cast(pa.string()), gram.cast(pa.string()), pa.array(np.full(len(n), size), pa.int32()), pa.array(n, pa.int64())],
            names=["lang", "gram", "size", "n"],
        )


COUNTED = "lang string, gram string, size int, n long"
PAIR_SHIFT = np.uint64(24)  # pairs are counted by 40 bits of their hash: pairs that share them count together, so none is lost


def _word_counts(limit: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in packets(batches, limit):
            words = Words(lang, text)
            del lang, text  # their batch is not held any longer than it is read
            if len(words.unit):
                every = np.arange(len(words.units))
                yield from rows_of(words, every, every, 1, np.bincount(words.unit, minlength=len(words.units)))

    return count


def _pair_counts(limit: int, frequent) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in packets(batches, limit):
            words = Words(lang, text)
            del lang, text
            hashes = words.hashes()
            known = is_set(frequent.value, hashes >> np.uint64(1))[words.unit]
            at = np.flatnonzero(words.joined & known[:-1] & known[1:])
            if len(at):
                pair, keys = numbered((pair_hashes(hashes[words.unit[at]], hashes[words.unit[at + 1]]) >> PAIR_SHIFT).astype(np.int64))
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(np.bincount(pair, minlength=len(keys)), pa.int64())], names=["place", "n"])

    return count


def _edge_counts(limit: int, frequent, pairs, longest: int) -> Callable:
    """The longest gram at each place: ``longest`` words, or fewer where the piece, or what can be frequent of it, ends."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in packets(batches, limit):
            words = Words(lang, text)
            del lang, text
            if not len(words.unit):
                continue
            hashes = words.hashes()
            known = is_set(frequent.value, hashes >> np.uint64(1))[words.unit]
            linked = words.joined & known[:-1] & known[1:]
            at = np.flatnonzero(linked)
            linked[at] = is_set(pairs.value, pair_hashes(hashes[words.unit[at]], hashes[words.unit[at + 1]]) >> PAIR_SHIFT)
            reach = np.zeros(len(words.unit), np.int64)  # further words, at most longest - 1
            ahead = np.append(linked, False)
            for step in range(longest - 1):
                reach += ahead
                ahead = ahead & np.append(linked[step + 1 :], np.zeros(min(step + 2, len(ahead)), bool))
            size = len(words.units)
            for more in range(1, longest):
                at = np.flatnonzero(reach == more)
                if not len(at):
                    continue
                gram, seen = numbered(words.unit[at])
                for k in range(1, more + 1):
                    gram, seen = numbered(gram * size + words.unit[at + k])
                place = np.zeros(len(seen), np.int64)
                place[gram] = at  # any one occurrence of each gram
                yield from rows_of(words, words.unit, place, more + 1, np.bincount(gram, minlength=len(seen)))

    return count


def _word_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = word_hashes(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield pa.record_batch([pa.array((hashes >> np.uint64(1)).astype(np.int64))], names=["place"])


def bitmap(places: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits at ``place`` (non-negative) modulo their number, which follows the number of rows and is bounded by ``max_bits``."""
    wanted, bits = min(places.count() * BITS_PER_GRAM, max_bits), BUCKET_BITS
    while bits < wanted:
        bits *= 2
    at = places.select((F.col("place") % bits).alias("at"))
    parts = at.groupBy(F.expr(f"at div {BUCKET_BITS}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(at % {BUCKET_BITS})").alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():  # at most max_bits / 8 bytes
        out[r["bucket"] * BUCKET_BITS // 8 : (r["bucket"] + 1) * BUCKET_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "gram", "size").agg(F.sum("n").alias("n"))


def first_words(gram: Column, n: Column | int) -> Column:
    return F.substring_index(gram, " ", n)


class PhraseGraph:
    """Counts of words and of the graph's edges and ends over all texts.

    ``words``: (lang, gram, n) of the words that occur ``least`` times; ``totals``: (lang, words_total) of all words;
    ``records``: (lang, gram, size, n), edges where size is ``longest``, else ends of pieces. Texts are lower-cased (A-Z),
    cut into pieces at ``BREAKS`` and into words at spaces and tabs. A NULL text is empty, a NULL lang ``und``; repeated
    rows count each, the id is not read, and an empty table gives empty tables. A row longer than ``packet`` is one packet.
    """

    def __init__(self, docs: DataFrame, least: int = 100, longest: int = 5, lang: str = "lang", text: str = "text", packet: int = PACKET_BYTES, max_bits: int = MAX_BITS):
        if longest < 2 or least < 1:
            raise ValueError("longest must be 2 or more and least 1 or more")
        self.least, self.longest = least, longest
        sc = docs.sparkSession.sparkContext
        read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), whole_text(text).alias("text"))
        counted = summed(read.mapInArrow(_word_counts(packet), COUNTED))
        # One row more for each lang, with the empty gram: all its words.
        both = counted.select("lang", "n", F.explode(F.array("gram", F.lit(""))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        kept = stored(both.where((F.col("gram") == "") | (F.col("n") >= least)))
        self.totals = kept.where("gram = ''").select("lang", F.col("n").alias("words_total"))
        self.words = kept.where("gram <> ''").select("lang", "gram", "n")
        known = sc.broadcast(bitmap(self.words.select("lang", "gram").mapInArrow(_word_places, "place long"), max_bits))
        pairs = read.mapInArrow(_pair_counts(packet, known), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
        linked = sc.broadcast(bitmap(stored(pairs.where(F.col("n") >= least).select("place")), max_bits))
        self.records = stored(summed(read.mapInArrow(_edge_counts(packet, known, linked, longest), COUNTED)))

    def flow(self) -> dict[int, DataFrame]:
        """(lang, gram, n) by number of words: a gram occurs as often as the grams one word longer that begin with it, and its ends."""
        at = {self.longest: self.records.where(F.col("size") == self.longest).select("lang", "gram", "n")}
        for size in range(self.longest - 1, 1, -1):
            out = at[size + 1].select("lang", first_words(F.col("gram"), size).alias("gram"), "n")
            ends = self.records.where(F.col("size") == size).select("lang", "gram", "n")
            at[size] = out.unionByName(ends).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        return at

    def counts(self) -> DataFrame:
        """(lang, gram, size, n) of every phrase of 2 to ``longest`` words that occurs ``least`` times."""
        out = None
        for size, grams in self.flow().items():
            rows = grams.where(F.col("n") >= self.least).withColumn("size", F.lit(size))
            out = rows if out is None else out.unionByName(rows)
        return stored(out.select("lang", "gram", "size", "n"))

    def paths(self, counts: DataFrame) -> DataFrame:
        """(lang, path, n, edges): the graph of frequent edges with its unary paths compacted.

        Two edges belong to one path if the node between them occurs as often as either: then no other edge enters or
        leaves it and no piece starts or ends there. Edges follow pointers to the first edge of their path, twice as far
        each round. A path is never longer than a piece, and every piece starts somewhere, so there are no cycles.
        """
        edges = counts.where(F.col("size") == self.longest).select("lang", "gram", "n")
        inner = self.longest - 1
        nodes = counts.where(F.col("size") == inner).select("lang", F.col("gram").alias("node"), F.col("n").alias("through"))
        if inner == 1:
            nodes = self.words.select("lang", F.col("gram").alias("node"), F.col("n").alias("through"))
        last_words = lambda c: F.substring_index(c, " ", -inner)
        into = edges.select("lang", F.col("gram").alias("before"), "n", last_words(F.col("gram")).alias("node"))
        out = edges.select("lang", "gram", "n", first_words(F.col("gram"), inner).alias("node"))
        unary = nodes.join(into, ["lang", "node"]).where("n = through").drop("n")
        steps = unary.join(out, ["lang", "node"]).where("n = through").select("lang", "gram", F.col("before").alias("head"), F.lit(1).cast("long").alias("steps"))
        steps = stored(steps)
        while True:
            hop = steps.select("lang", F.col("gram").alias("head"), F.col("head").alias("farther"), F.col("steps").alias("more"))
            joined = steps.join(hop, ["lang", "head"], "left")
            longer = stored(joined.select(
                "lang", "gram", F.coalesce("farther", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("farther").isNotNull().alias("moved")
            ))
            steps = longer.drop("moved")
            if longer.where("moved").isEmpty():
                break
        placed = edges.join(steps, ["lang", "gram"], "left").select(
            "lang", F.coalesce("head", "gram").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"), "n", F.substring_index("gram", " ", -1).alias("last")
        )
        tails = F.transform(F.array_sort(F.collect_list(F.struct("steps", "last"))), lambda s: F.when(s["steps"] == 0, F.lit("")).otherwise(F.concat(F.lit(" "), s["last"])))
        return placed.groupBy("lang", "head").agg(tails.alias("tails"), F.max("n").alias("n")).select(
            "lang", F.concat("head", F.array_join("tails", "")).alias("path"), "n", F.size("tails").alias("edges")
        )

    def covered(self, counts: DataFrame) -> DataFrame:
        """(lang, gram, cover): the most occurrences of a longer counted phrase that holds the phrase.

        Sub-phrases of the longest phrases come from the paths, which name each of them once, the others from themselves.
        """
        if self.longest < 3:
            return counts.select("lang", "gram", F.lit(0).cast("long").alias("cover")).limit(0)
        whole = self.paths(counts).select("lang", F.col("path").alias("held"), "n", F.lit(self.longest).alias("below"))
        rest = counts.where((F.col("size") > 2) & (F.col("size") < self.longest)).select("lang", F.col("gram").alias("held"), "n", F.col("size").alias("below"))
        split = whole.unionByName(rest).withColumn("held", F.split("held", " "))
        sizes = F.sequence(F.lit(2), F.col("below") - 1)
        part = lambda m: F.transform(F.sequence(F.lit(1), F.size("held") - m + 1), lambda i: F.array_join(F.slice("held", i, m), " "))
        inside = split.select("lang", "n", F.explode(F.flatten(F.transform(sizes, part))).alias("gram"))
        return inside.groupBy("lang", "gram").agg(F.max("n").alias("cover"))


def small(totals: DataFrame) -> DataFrame:
    """One row a lang, marked for broadcast if they all fit in ``TOTALS_BYTES``."""
    held = totals.agg(F.sum(F.octet_length("lang") + 16)).first()[0] or 0
    return F.broadcast(totals) if held <= TOTALS_BYTES else totals


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exact: products are decimals of 38 digits."""
    top = (a * 1000).cast("decimal(19,0)") * n.cast("decimal(18,0)")
    under = left.cast("decimal(19,0)") * right.cast("decimal(18,0)")
    return F.call_function("div", top, under)


def scored(graph: PhraseGraph, cover: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of each phrase that no longer one covers with ``cover`` percent of its occurrences.

    l and r are the counts of the two parts at the cut with the lowest score, the earliest of equals.
    """
    counts = graph.counts()
    held = graph.covered(counts)
    free = counts.join(held, ["lang", "gram"], "left").where(F.col("cover").isNull() | (F.col("cover") * 100 < F.col("n") * cover)).drop("cover")
    cuts = free.select("lang", "gram", F.col("n").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.expr("substring_index(gram, ' ', k)"), "tail": F.expr("substring_index(gram, ' ', k - size)")})
    known = graph.words.unionByName(counts.select("lang", "gram", "n"))
    for part, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(known.select("lang", F.col("gram").alias(part), F.col("n").alias(name)), ["lang", part])
    cuts = cuts.join(small(graph.totals.withColumnRenamed("words_total", "n")), "lang").withColumn("score", score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "gram").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", F.col("gram").alias("phrase"), "b.a", "b.l", "b.r", "b.n", "b.score")


def top_phrases(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each lang by score, then a, both descending, then phrase, with ``rank`` from 1.

    Ranked within parts of a lang first, so that a hot lang is in one task with ``top`` rows a part only.
    """
    phrases = stored(phrases)
    parts = max(1, int((phrases.count() / top) ** 0.5))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    within = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
    first = phrases.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, cover: int = 100, top: int = 2000, **how) -> DataFrame:
    """The ``top`` phrases of each lang by how much more often their words meet than by chance; see ``PhraseGraph`` for the cases."""
    graph = PhraseGraph(docs, least, longest, **how)
    ranked = top_phrases(scored(graph, cover), top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
