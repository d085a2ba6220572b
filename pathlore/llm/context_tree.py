"""Language-model scoring by context-tree weighting over bytes.

Every byte is decided bit by bit (255 binary nodes), and every binary node has a tree of byte contexts from none up to
``DEPTH`` bytes. A node holds a Krichevsky-Trofimov estimate of its bits; its weighted probability is half that estimate
and half the product of its children, so a prediction mixes the estimates of all depths by how well each told the
training texts. The contexts of a corpus grow with it and are never in one place:

1. texts are packed (about ``PACKET`` bytes a row) and stored; a packet lists its distinct byte strings of DEPTH + 1 and
   its distinct words with their training counts, split into shards: byte strings by their last two context bytes, so a
   shard holds whole subtrees, words by hash;
2. shards add up their lists, in two steps so that a hot shard never meets all packets at once, and weight their subtrees;
   the two lowest depths, bounded by the alphabet (256 x 255 nodes), are put together from sums;
3. each packet gets back one number for each of its byte strings and words, and adds them up by document.

A word is known by its 64-bit hash here, so two words in some billions could share a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import byte_texts, stored, whole_text

DEPTH = 4  # context bytes
PACKET = 8 << 20  # bytes of text a packet
CLASSES = 4  # shards of byte strings for each last context byte
GROUP = 256  # packets whose lists meet in one task
SPARSE = 1 << 26  # cells of the dense table that numbers byte strings; beyond it they are sorted

_LISTS = "packet long, kind string, shard int, keys binary, counts binary"
_HEAP_SHIFT = np.arange(8)


def squeeze(values: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def squeeze_keys(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0: Stirling's series, eight steps up."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - low


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


# ---- packets -------------------------------------------------------------------------------------------------------


def number_strings(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct strings of depth + 1 bytes in order, number of the string that ends at each place from ``depth`` on)."""
    used = np.flatnonzero(np.bincount(data, minlength=256))
    letter = np.zeros(256, np.int64)
    letter[used] = np.arange(len(used))
    symbols, n = letter[data], len(data) - depth
    ids, keys = symbols[:n], used.astype(np.uint64)
    for j in range(1, depth + 1):
        code = ids * len(used) + symbols[j : n + j]
        if len(keys) * len(used) > SPARSE:
            codes, ids = np.unique(code, return_inverse=True)
        else:
            table = np.zeros(len(keys) * len(used), np.int64)
            table[code] = 1
            codes = np.flatnonzero(table)
            table[codes] = np.arange(len(codes))
            ids = table[code]
        keys = (keys[codes // len(used)] << np.uint64(8)) | used[codes % len(used)].astype(np.uint64)
    return keys, ids


def lay_out(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts one after the other, each behind ``depth`` zero bytes and with a zero byte for its end; first and last place of each."""
    data = np.frombuffer(b"".join(bytes(depth) + t + b"\0" for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(size + depth) - size - depth
    return data, start, start + size


def number_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of distinct words in order, number of each token's word, tokens of each text without its end)."""
    import xxhash

    number: dict[bytes, int] = {}
    ids, sizes = [], []
    for t in texts:
        words = t.split()
        sizes.append(len(words))
        ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    keys, place = np.unique(hashes, return_inverse=True)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
    return keys, place[flat] if len(number) else flat, np.array(sizes, np.int64)


def string_shard(keys: np.ndarray) -> np.ndarray:
    return (((keys >> np.uint64(8)) & np.uint64(255)) * np.uint64(CLASSES) + ((keys >> np.uint64(16)) & np.uint64(255)) % np.uint64(CLASSES)).astype(np.int64)


def pack(docs: DataFrame, id_col: str, text: str, held_out: Column, size: int = PACKET) -> DataFrame:
    """Stored packets (packet, ids, held, sizes, blob) of lower-cased (A-Z) texts; no shuffle, and a number once given stays."""
    id_type = docs.select(F.col(id_col)).dtypes[0][1]

    def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        ids, held, texts, bytes_held, id_kind = [], [], [], 0, None

        def packet():
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_arrays([
                pa.array([first + made], pa.int64()), pa.array([ids], pa.list_(id_kind)), pa.array([held], pa.list_(pa.bool_())),
                pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([blob], pa.large_binary()).cast(pa.binary()),
            ], ["packet", "ids", "held", "sizes", "blob"])

        for batch in batches:
            id_kind = batch.column(0).type
            for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_texts(batch.column(2))):
                ids.append(i)
                held.append(h)
                texts.append(t.lower())  # on bytes: A-Z only
                bytes_held += len(t)
                if bytes_held >= size:
                    yield packet()
                    made += 1
                    ids, held, texts, bytes_held = [], [], [], 0
        if texts:
            yield packet()

    rows = docs.select(F.col(id_col), F.coalesce(held_out, F.lit(False)), whole_text(text))
    return stored(rows.mapInArrow(packing, f"packet long, ids array<{id_type}>, held array<boolean>, sizes array<long>, blob binary"))


def unpack(sizes: list[int], blob: bytes) -> list[bytes]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob, max_output_size=max(sum(sizes), 1)) if sum(sizes) else b""
    ends = np.cumsum(sizes).tolist()
    return [data[b - n : b] for b, n in zip(ends, sizes)]


def training_counts(ids: np.ndarray, size: np.ndarray, start: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
    """How often each number occurs at the places of the texts that are not held out."""
    use = np.zeros(len(ids) + 1, np.int64)
    np.add.at(use, start[~held], 1)
    np.add.at(use, (start + size)[~held], -1)
    return np.bincount(ids[np.cumsum(use[:-1]) > 0], minlength=n)


def split_by(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its keys, in their order."""
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(shard[part[0]]), part


def list_packets(packets: DataFrame, depth: int, word_shards: int) -> DataFrame:
    """Lists of every packet by kind and shard: distinct keys in order, with their counts in training texts."""
    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, held = unpack(row["sizes"], row["blob"]), np.array(row["held"], bool)
                out = []
                data, start, end = lay_out(texts, depth)
                keys, ids = number_strings(data, depth)
                counts = training_counts(ids, end - start, start, held, len(keys))
                out += [("b", s, keys[at], counts[at]) for s, at in split_by(string_shard(keys))]
                keys, ids, sizes = number_words(texts)
                counts = training_counts(ids, sizes, np.cumsum(sizes) - sizes, held, len(keys))
                out += [("w", s, keys[at], counts[at]) for s, at in split_by((keys % np.uint64(word_shards)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["packet"]] * len(out), pa.int64()), pa.array([k for k, *_ in out], pa.string()), pa.array([s for _, s, *_ in out], pa.int32()),
                    pa.array([squeeze_keys(k) for *_, k, _ in out], pa.binary()), pa.array([squeeze(c.astype(np.uint32)) for *_, c in out], pa.binary()),
                ], ["packet", "kind", "shard", "keys", "counts"])

    return packets.select("packet", "held", "sizes", "blob").mapInArrow(listing, _LISTS)


# ---- shards --------------------------------------------------------------------------------------------------------


def merge(lists: Iterator[tuple[bytes, bytes]], kind=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Sum of key lists: distinct keys in order and their total counts."""
    keys, counts = zip(*((unsqueeze_keys(k), unsqueeze(c, kind)) for k, c in lists))
    all_keys = np.concatenate(keys)
    distinct, place = np.unique(all_keys, return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts).astype(float), len(distinct)).astype(np.int64)


def bits_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the last byte of each key: its eight binary nodes (heap numbers 1 to 255) and its bit at each."""
    symbol = (keys & np.uint64(255)).astype(np.int64)[:, None]
    return (1 << _HEAP_SHIFT) | (symbol >> (8 - _HEAP_SHIFT)), (symbol >> (7 - _HEAP_SHIFT)) & 1


def weigh(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Subtrees of one shard. Probability of a 1 at each binary node of each key as mixed from ``depth`` down to depth 2,
    and by heap number the sums that depth 1 needs: log weighted probability of its children, zeros and ones."""
    heap, bit = bits_of(keys)
    ones = (counts[:, None] * bit).ravel().astype(float)
    zeros = (counts[:, None] * (1 - bit)).ravel().astype(float)
    levels, below = {}, None
    for d in range(depth, 1, -1):
        context = (keys >> np.uint64(8)) & np.uint64((1 << (8 * d)) - 1)
        node = ((context[:, None] << np.uint64(8)) | heap.astype(np.uint64)).ravel()
        distinct, first, place = np.unique(node, return_index=True, return_inverse=True)
        a, b = np.bincount(place, zeros, len(distinct)), np.bincount(place, ones, len(distinct))
        own = log_estimate(a, b)
        if below is None:
            weighted, stay = own, np.ones(len(distinct))
        else:
            children = np.bincount(place[below[0]], below[1], len(distinct))
            weighted = np.logaddexp(own, children) - math.log(2)
            stay = np.exp(own - math.log(2) - weighted)
        levels[d] = place, stay, (b + 0.5) / (a + b + 1)
        below = first, weighted
    p = np.full(heap.size, 0.5)
    for d in range(depth, 1, -1):
        place, stay, estimate = levels[d]
        p = stay[place] * estimate[place] + (1 - stay[place]) * p
    flat = heap.ravel()
    return p.reshape(-1, 8), {
        "log": np.bincount(flat[below[0]], below[1], 256), "zeros": np.bincount(flat, zeros, 256), "ones": np.bincount(flat, ones, 256),
    }


def low_depths(stats: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Weights and estimates of depth 1 (last byte, heap number) and depth 0 (heap number) from the sums of all shards."""
    log, a, b = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for last, x, y, z in stats:
        log[last] += x
        a[last] += y
        b[last] += z
    own = log_estimate(a, b)
    weighted = np.logaddexp(own, log) - math.log(2)
    stay1, est1 = np.exp(own - math.log(2) - weighted), (b + 0.5) / (a + b + 1)
    a0, b0 = a.sum(axis=0), b.sum(axis=0)
    own0 = log_estimate(a0, b0)
    weighted0 = np.logaddexp(own0, weighted.sum(axis=0)) - math.log(2)
    return stay1, est1, np.exp(own0 - math.log(2) - weighted0), (b0 + 0.5) / (a0 + b0 + 1)


def log10_of(keys: np.ndarray, p: np.ndarray, low: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 probability of the last byte of each key after the bytes before it."""
    stay1, est1, stay0, est0 = low
    heap, bit = bits_of(keys)
    last = ((keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)[:, None]
    p = stay1[last, heap] * est1[last, heap] + (1 - stay1[last, heap]) * p
    p = stay0[heap] * est0[heap] + (1 - stay0[heap]) * p
    return np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=1)


def fold(p: np.ndarray) -> np.ndarray:
    """The smaller of p and 1 - p, the latter with a minus sign: float32 keeps its digits next to 1 as well as next to 0."""
    return np.where(p <= 0.5, p, p - 1).astype(np.float32)


def unfold(q: np.ndarray) -> np.ndarray:
    q = q.astype(float)
    return np.where(q < 0, 1 + q, q)


def _only_row(kind: str, shard: int, **arrays: bytes) -> pa.Table:
    return pa.table({"kind": [kind], "shard": pa.array([shard], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in arrays.items()}})


def merge_lists(key: tuple, lists: pa.Table) -> pa.Table:
    keys, counts = merge(zip(lists["keys"].to_pylist(), lists["counts"].to_pylist()), np.uint32)
    return _only_row(key[0].as_py(), key[1].as_py(), keys=squeeze_keys(keys), counts=squeeze(counts))


def shard_model(depth: int):
    def model(key: tuple, lists: pa.Table) -> pa.Table:
        kind, shard = key[0].as_py(), key[1].as_py()
        keys, counts = merge(zip(lists["keys"].to_pylist(), lists["counts"].to_pylist()), np.int64)
        if kind == "w":
            return _only_row(kind, shard, keys=squeeze_keys(keys), data=squeeze(counts), sums=np.array([counts.sum(), (counts > 0).sum()], float).tobytes())
        p, sums = weigh(keys, counts, depth)
        return _only_row(kind, shard, keys=squeeze_keys(keys), data=squeeze(fold(p)), sums=np.concatenate([sums["log"], sums["zeros"], sums["ones"]]).tobytes())

    return model


def answers(low: tuple[np.ndarray, ...]):
    """One number for each key that a packet listed: log10 probability of a byte string, training count of a word."""
    def answer(key: tuple, lists: pa.Table, model: pa.Table) -> pa.Table:
        kind, shard = key[0].as_py(), key[1].as_py()
        keys = unsqueeze_keys(model["keys"][0].as_py())
        if kind == "w":
            value = unsqueeze(model["data"][0].as_py(), np.int64).astype(float)
        else:
            value = log10_of(keys, unfold(unsqueeze(model["data"][0].as_py(), np.float32)).reshape(-1, 8), low)
        value = value.astype(np.float32 if kind == "b" else np.float64)
        out = [squeeze(value[np.searchsorted(keys, unsqueeze_keys(k.as_py()))]) for k in lists["keys"]]
        return pa.table({
            "packet": lists["packet"], "kind": pa.array([kind] * len(out)), "shard": pa.array([shard] * len(out), pa.int32()), "data": pa.array(out, pa.binary()),
        })

    return answer


def add_up(depth: int, word_shards: int, n_end: int):
    """Sums by document of one packet from the answers of its shards."""
    def total(key: tuple, packet: pa.Table, data: pa.Table) -> pa.Table:
        row = packet.to_pylist()[0]
        texts, held = unpack(row["sizes"], row["blob"]), np.array(row["held"], bool)
        got = {(k, s): d for k, s, d in zip(data["kind"].to_pylist(), data["shard"].to_pylist(), data["data"].to_pylist())}

        def values(kind, keys, shard, number):
            out = np.zeros(len(keys))
            for s, at in split_by(shard):
                out[at] = unsqueeze(got[kind, s], number)
            return out

        bytes_laid, start, end = lay_out(texts, depth)
        keys, ids = number_strings(bytes_laid, depth)
        logs = np.concatenate(([0.0], np.cumsum(values("b", keys, string_shard(keys), np.float32)[ids])))
        keys, ids, sizes = number_words(texts)
        counts = values("w", keys, (keys % np.uint64(word_shards)).astype(np.int64), np.float64)[ids]
        upto = np.cumsum(sizes)
        known = np.concatenate(([0], np.cumsum(counts > 0)))
        base = np.concatenate(([0.0], np.cumsum(np.log10(counts + 1))))
        return pa.table({
            "id": pa.array(row["ids"], packet.schema.field("ids").type.value_type), "held_out": held, "n_bytes": pa.array(row["sizes"], pa.int64()),
            "n_tokens": sizes + 1, "n_known": known[upto] - known[upto - sizes] + (n_end > 0),
            "base_counts": base[upto] - base[upto - sizes] + math.log10(n_end + 1), "score": logs[end] - logs[start],
        })

    return total


def context_tree_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH, packet_bytes: int = PACKET) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The models learn from the rows where ``held_out`` is not true (NULL: they learn). ``score`` is the log10 probability of
    the lower-cased (A-Z) text and its end; ``base_score`` that of its words and end by counts plus one. NULL texts are
    empty. Repeated rows count each. Without training rows every byte costs eight bits. Other columns are not read.
    """
    packets = pack(docs, id_col, text, held_out, packet_bytes)
    shape = packets.agg(F.count(F.lit(1)), F.sum(F.size(F.filter("held", lambda h: ~h)))).first()
    n_packets, n_end = shape[0], shape[1] or 0
    word_shards, parts = max(64, n_packets // 16), max(1, -(-n_packets // GROUP))
    lists = stored(list_packets(packets, depth, word_shards).withColumn("part", F.pmod(F.xxhash64("packet"), F.lit(parts)).cast("int")))
    summed = "kind string, shard int, keys binary, counts binary"
    merged = lists.select("packet", "kind", "shard", "part", "keys", "counts").groupBy("kind", "shard", "part").applyInArrow(merge_lists, summed)
    model = stored(merged.groupBy("kind", "shard").applyInArrow(shard_model(depth), "kind string, shard int, keys binary, data binary, sums binary"))
    stats = model.where("kind = 'b'").select("shard", "sums").collect()  # at most 1024 rows of 768 numbers
    low = low_depths([(r["shard"] // CLASSES, *np.frombuffer(r["sums"]).reshape(3, 256)) for r in stats])

    @F.udf("array<double>")
    def numbers(raw):
        return np.frombuffer(raw).tolist()

    words = model.where("kind = 'w'").select(numbers("sums").alias("s")).agg(F.sum(F.col("s")[0]), F.sum(F.col("s")[1])).first()
    train_tokens, distinct = int(words[0] or 0) + n_end, int(words[1] or 0) + (n_end > 0)
    spread = model.drop("sums").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = lists.drop("counts").groupBy("kind", "shard", "part").cogroup(spread.groupBy("kind", "shard", "part"))
    replies = asked.applyInArrow(answers(low), "packet long, kind string, shard int, data binary")
    id_type = docs.select(F.col(id_col)).dtypes[0][1]
    out = f"id {id_type}, held_out boolean, n_bytes long, n_tokens long, n_known long, base_counts double, score double"
    sums = packets.groupBy("packet").cogroup(replies.groupBy("packet")).applyInArrow(add_up(depth, word_shards, n_end), out)
    return sums.select(
        F.col("id").alias(id_col), "held_out", "n_bytes", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_counts") - F.col("n_tokens") * math.log10(train_tokens + distinct + 1)).alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
