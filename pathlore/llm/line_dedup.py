"""Line dedup by a segment-partition edit join, in DataFrame functions.

Lines within ``threshold`` edits are copies. A line is split into threshold + 1 segments of even length; a line within the
threshold must hold one of them unchanged, at a place that differs by no more than the edits to its left and right allow.
Each line is indexed by (its length, segment number, segment) and probes the indexes of its own and of shorter lengths
with the few substrings that can match. Candidates are verified by a banded bit-parallel automaton: one bit a diagonal,
one word of 2 * threshold + 1 bits for each number of edits.

A bucket of the index can be hot (thousands of variants of one passage share a segment). With threshold 1 such a bucket is
not paired: everything outside the other segment is equal, so its lines are linked through deletion keys (the line with
one place left open, or with one character removed), whose groups are bounded by the alphabet and linked as stars, with
work in proportion to the lines. Either way gives the same links.

Lines shorter than ``least`` code points say too little to be copies within an edit: of them, as of every line that is not
empty, exact copies are found by hash. ``short=False`` leaves them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import bounded, row_hashes, scratch, stored, whole_text
from pathlore.llm.components import components

THRESHOLD = 1
LEAST = 32
HOT = 48  # lines of a bucket that are still paired
BLOCK = 16  # characters that the automaton compares at once while nothing differs
CHUNK = 1024  # characters of which it looks at blocks only if they differ
PIECE = 16  # least characters of a piece that deletion keys leave open


def segment(length: Column, number: int, parts: int) -> tuple[Column, Column]:
    """(start from 0, length) of a segment: even lengths, the longer ones last."""
    short = F.expr("0") + F.floor(length / parts).cast("int")
    longer = length - short * parts
    return short * number + F.greatest(F.lit(0), F.lit(number) - (F.lit(parts) - longer)), short + (F.lit(number) >= F.lit(parts) - longer).cast("int")


def index_keys(line: Column, length: Column, threshold: int) -> list[Column]:
    """Keys under which a line is found: one for each segment."""
    out = []
    for i in range(threshold + 1):
        start, size = segment(length, i, threshold + 1)
        out.append(F.xxhash64(F.lit(i), length, F.substring(line, start + 1, size)))
    return out


def probe_keys(line: Column, length: Column, threshold: int) -> list[Column]:
    """Keys that a line looks up besides its own: shifted substrings of its length, all substrings of shorter lengths."""
    out = []
    for shorter in range(threshold + 1):
        other = length - shorter
        for i in range(threshold + 1):
            start, size = segment(other, i, threshold + 1)
            for shift in range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1):
                if shorter == 0 and shift == 0:
                    continue
                fits = (start + shift >= 0) & (start + shift + size <= length)
                out.append(F.when(fits, F.xxhash64(F.lit(i), other, F.substring(line, start + shift + 1, size))))
    return out


def within_edits(x: Column, y: Column, threshold: int) -> Column:
    """Whether the edit distance of two texts is at most ``threshold``.

    Bit d + threshold of word e is set at place t of ``y`` if its first t characters match the first t + d characters of
    ``x`` with e edits at most. While word 0 lives on the main diagonal and whole blocks are equal, nothing changes; when
    only the last word lives, blocks of each diagonal are compared; else the characters of the block step by step. Chunks of
    many blocks go the same way first, and hold their part of both texts, so that long texts are not searched from their start.
    """
    k, width = threshold, 2 * threshold + 1
    full = (1 << width) - 1
    names = [f"r{e}" for e in range(k + 1)]

    def state(*words):
        return F.struct(*[w.cast("int").alias(n) for n, w in zip(names, words)])

    settled = [F.lit(sum(1 << (d + k) for d in range(-e, e + 1))) for e in range(k + 1)]
    begin = state(*[F.lit(sum(1 << (d + k) for d in range(0, e + 1))) for e in range(k + 1)])

    def agree(text: Column, start: Column, part: Column) -> Column:
        """Diagonals on which ``text`` (``x`` from k characters before) goes on with ``part`` at place ``start`` (from 1)."""
        bits = F.lit(0)
        for d in range(-k, k + 1):
            same = F.substring(text, start + (d + k), F.length(part)) == part
            bits = bits + F.when(same, F.lit(1 << (d + k))).otherwise(F.lit(0))
        return bits

    def some_end(s: Column, text: Column, start: Column, part: Column, otherwise: Column) -> Column:
        """The state after ``part``: known at once where nothing differs, or where no edit is left."""
        clean = (s["r0"] != 0) & (F.substring(text, start + k, F.length(part)) == part) & (F.length(part) >= k)
        last_only = F.lit(True)
        for e in range(k):
            last_only = last_only & (s[f"r{e}"] == 0)
        alone = state(*[F.lit(0)] * k, s[f"r{k}"].bitwiseAND(agree(text, start, part)))
        return F.when(clean, state(*settled)).when(last_only, alone).otherwise(otherwise)

    def chunk(s: Column, c: Column) -> Column:
        text, whole = c["x"], c["y"]

        def step(s: Column, t: Column) -> Column:
            eq = agree(text, t, F.substring(whole, t, F.lit(1)))
            words = [s["r0"].bitwiseAND(eq)]
            for e in range(1, k + 1):
                less = s[f"r{e - 1}"]
                words.append(
                    s[f"r{e}"].bitwiseAND(eq).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(F.shiftleft(words[e - 1], 1).bitwiseAND(F.lit(full)))
                )
            return state(*words)

        def block(s: Column, b: Column) -> Column:
            start = b * BLOCK + 1
            part = F.substring(whole, start, F.lit(BLOCK))
            return some_end(s, text, start, part, F.aggregate(F.sequence(start, start + F.length(part) - 1), s, step))

        inside = F.aggregate(F.sequence(F.lit(0), F.floor((F.length(whole) - 1) / BLOCK).cast("int")), s, block)
        return some_end(s, text, F.lit(1), whole, inside)

    def window(c: Column) -> Column:
        """A chunk of ``y`` with the part of ``x`` beside it; before the first character of ``x`` stand NUL characters."""
        before = F.when(c == 0, F.concat(F.lit("\0" * k), F.substring(x, F.lit(1), F.lit(CHUNK + k)))).otherwise(
            F.substring(x, c * CHUNK + (1 - k), F.lit(CHUNK + 2 * k)))
        return F.struct(before.alias("x"), F.substring(y, c * CHUNK + 1, F.lit(CHUNK)).alias("y"))

    lines_up = F.abs(F.length(x) - F.length(y)) <= k
    chunks = F.when(F.length(y) > 0, F.sequence(F.lit(0), F.floor((F.length(y) - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(F.transform(chunks, window), begin, chunk)[names[-1]]
    return lines_up & (F.getbit(end, F.greatest(F.lit(0), F.length(x) - F.length(y) + k).cast("int")) == 1)


def read_lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, r1, r2, place, line): the lines of every text, without white space at their ends."""
    r1, r2 = row_hashes(id_col, text)
    split = docs.select(F.col(id_col).alias("doc"), r1.alias("r1"), r2.alias("r2"), F.posexplode(F.split(whole_text(text), "\n")).alias("place", "raw"))
    return split.select("doc", "r1", "r2", "place", F.btrim("raw", F.lit(" \t\x0b\x0c\r")).alias("line"))


def line_id(line: Column) -> Column:
    """128 bits of hash: exact copies share it."""
    return F.struct(F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2"))


def line_links(lines: DataFrame, texts: DataFrame, threshold: int, hot: int) -> DataFrame:
    """(a, b): links between different lines. ``lines`` has (id, keys, probes) once for each; ``texts`` gives (id, line) of any row."""
    rows = lines.select("id", F.explode(F.concat(
        F.transform("keys", lambda k: F.struct(k.alias("key"), F.lit(0).alias("role"))),
        F.transform(F.filter("probes", lambda k: k.isNotNull()), lambda k: F.struct(k.alias("key"), F.lit(1).alias("role"))),
    )).alias("x")).select("id", "x.key", "x.role")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("role") == 0).cast("int")).alias("indexed")).where("n > 1 and indexed > 0")
    live = stored(rows.join(sizes.select("key", "n"), "key"))
    paired = live.where(F.col("n") <= hot) if threshold == 1 else live
    left = paired.where("role = 0").select("key", F.col("id").alias("a"))
    right = paired.select("key", F.col("id").alias("b"), "role")
    pairs = left.join(right, "key").where("a <> b and (role = 1 or a < b)").select("a", "b").distinct()
    burning = live.where(F.col("n") > hot).select("id", "role").distinct() if threshold == 1 else None
    wanted = stored(live.select("id").distinct())
    n_wanted = wanted.count()
    known = stored(texts.join(bounded(wanted, n_wanted), "id", "left_semi").groupBy("id").agg(F.first("line").alias("line")))
    if burning is not None:
        pairs = pairs.unionByName(deletion_links(burning.join(bounded(known, n_wanted, 20_000), "id")))
    x, y = known.select(F.col("id").alias("a"), F.col("line").alias("x")), known.select(F.col("id").alias("b"), F.col("line").alias("y"))
    # Spread by pair, so that verifying the partners of one line is not left to one task.
    met = pairs.join(x, "a").join(y, "b")
    return met.where(within_edits(F.col("x"), F.col("y"), threshold)).select("a", "b")


def deletion_links(lines: DataFrame) -> DataFrame:
    """(a, b) between lines (id, line, role) one edit apart, as stars.

    A line is cut into about sqrt(length) pieces, by the shorter length of an edit: lines that agree but for one piece share
    the key of all that is around it. A line (role 1) looked up as the longer one has a piece of one more character. Only
    pieces whose surroundings are shared go on: places left open link pieces of one length, and a longer piece without one
    of its characters has the key of the shorter piece (role 0) that equals the rest. Work per line is length ** 1.5.
    """
    longer = F.col("role")
    size = F.length("line") - longer
    wide = F.greatest(F.lit(PIECE), F.ceil(F.sqrt(size)).cast("int"))
    pieces = F.greatest(F.lit(1), F.ceil(size / wide).cast("int"))

    def cut(b: Column) -> Column:
        start = b * wide
        long = F.when(b == pieces - 1, size - start).otherwise(wide) + longer
        around = (F.substring("line", F.lit(1), start), F.substring(F.col("line"), start + long + 1, F.length("line")))
        return F.struct(F.xxhash64(size, b, *[F.xxhash64(part) for part in around]).alias("around"), F.substring("line", start + 1, long).alias("piece"))

    open_rows = lines.repartition("id").select("id", "role", F.explode(F.transform(F.sequence(F.lit(0), pieces - 1), cut)).alias("c")).select("id", "role", "c.around", "c.piece")
    shared = open_rows.groupBy("around").agg(F.count(F.lit(1)).alias("n"), F.min("role").alias("least")).where("n > 1 and least = 0").select("around")
    met_pieces = open_rows.join(shared, "around")

    places = F.sequence(F.lit(0), F.length("piece") - 1)

    def but(p: Column) -> tuple[Column, Column]:
        return F.substring("piece", F.lit(1), p), F.substring(F.col("piece"), p + 2, F.length("piece"))

    opened = F.transform(places, lambda p: F.struct(F.xxhash64(F.lit("open"), F.col("around"), p, *but(p)).alias("key"), F.lit(0).alias("kind")))
    whole = F.array(F.struct(F.xxhash64(F.lit("cut"), F.col("around"), F.col("piece")).alias("key"), F.lit(1).alias("kind")))
    removed = F.transform(places, lambda p: F.struct(F.xxhash64(F.lit("cut"), F.col("around"), F.concat(*but(p))).alias("key"), F.lit(2).alias("kind")))
    keys = F.when(longer == 0, F.concat(opened, whole)).otherwise(removed)
    rows = met_pieces.select("id", F.explode(keys).alias("k")).select("id", "k.key", "k.kind")
    hubs = rows.groupBy("key").agg(
        F.min(F.when(F.col("kind") == 0, F.col("id"))).alias("least"), F.min(F.when(F.col("kind") == 1, F.col("id"))).alias("shorter"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    met = rows.join(hubs, "key").withColumn("hub", F.when(F.col("kind") == 0, F.col("least")).when(F.col("kind") == 2, F.col("shorter")))
    return met.where("hub is not null and hub <> id").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def copied_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, least: int = LEAST, hot: int = HOT, short: bool = True) -> DataFrame:
    """(r1, r2, places): for rows with lines that an earlier line is a copy of, the places of those lines.

    Classes of lines are components of the links. Of a class the line of the smallest id (NULL last), row hash and place
    stays. Rows that repeat id and text are one row here. Empty tables give no rows.
    """
    lines = read_lines(docs, id_col, text).where(F.length("line") >= (min(1, least) if short else least))
    size = F.length("line")

    def if_long(keys: list[Column]) -> Column:
        return F.when(size >= least, F.array(*keys)).otherwise(F.array().cast("array<bigint>"))

    seen = stored(lines.select(
        "doc", "r1", "r2", "place", line_id(F.col("line")).alias("id"),
        if_long(index_keys(F.col("line"), size, threshold)).alias("keys"), if_long(probe_keys(F.col("line"), size, threshold)).alias("probes"),
    ))
    once = seen.where(F.size("keys") > 0).groupBy("id").agg(F.first("keys").alias("keys"), F.first("probes").alias("probes"))
    texts = lines.select(line_id(F.col("line")).alias("id"), "line")
    classes = stored(components(line_links(once, texts, threshold, hot)))
    named = seen.select("doc", "r1", "r2", "place", "id").join(classes, F.col("id") == F.col("node"), "left")
    rows = named.select(F.coalesce("label", "id").alias("class"), F.struct(F.col("doc").isNull().alias("none"), "doc", "r1", "r2", "place").alias("at"))
    firsts = stored(rows.groupBy("class").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = rows.join(firsts, "class").where("at <> first")
    return later.groupBy("at.r1", "at.r2").agg(F.sort_array(F.collect_set("at.place")).alias("places"))


def line_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, least: int = LEAST, hot: int = HOT, short: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_copies and the places of its copied lines (from 0, joined by commas).

    NULL and empty texts are one empty line; lines with nothing in them are never copies.
    """
    r1, r2 = row_hashes(id_col, text)
    rows = docs.select(F.col(id_col), r1.alias("r1"), r2.alias("r2"), F.size(F.split(whole_text(text), "\n")).cast("long").alias("n_lines"))
    found = copied_lines(docs, id_col, text, threshold, least, hot, short)
    return rows.join(found, ["r1", "r2"], "left").select(
        id_col, "n_lines", F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_copies"), F.coalesce(F.array_join("places", ","), F.lit("")).alias("copies")
    )


def drop_copied_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: str | None = None, threshold: int = THRESHOLD, least: int = LEAST, hot: int = HOT, short: bool = True) -> DataFrame:
    """``docs`` with the copied lines taken out of the texts (and ``length``, if named, set anew); every row stays."""
    names = scratch(docs, "r1", "r2", "places")
    found = copied_lines(docs, id_col, text, threshold, least, hot, short).select(
        F.col("r1").alias(names["r1"]), F.col("r2").alias(names["r2"]), F.col("places").alias(names["places"])
    )
    keys = dict(zip((names["r1"], names["r2"]), row_hashes(id_col, text)))
    rows = docs.withColumns(keys).join(found, list(keys), "left")
    places = F.col(names["places"])
    left = F.array_join(F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(places, i)), "\n")
    cleaned = rows.withColumn(text, F.when(places.isNull(), F.col(text)).otherwise(left))
    if length is not None:
        cleaned = cleaned.withColumn(length, F.when(places.isNull(), F.col(length)).otherwise(F.length(text)))
    return cleaned.select(*docs.columns)
