r"""Chat formatting into budgeted windows.

A conversation is laid out turn by turn behind role markers and cut into windows of at most ``budget`` tokens. Prefix sums
of the turns' tokens choose the spans: a window takes turns while the sum since its first one fits, and always whole turns.
Every window but the first begins with the system turn and a little history, both without loss, so that each assistant
text is learnt once. Turns travel once, by conversation; the windows are cut in one pass over sorted rows that holds one
window at a time. A conversation over ``MAX_TURNS`` is dealt out in blocks of ``BLOCK_TURNS`` turns instead, each with
copies of the system turn and of the turns just before it, and a window then ends with its block.

Markers: ``[SYS]..[/SYS]``, ``[INST]..[/INST]`` (user), ``<s>..</s>`` (assistant), ``[ROLE]role[/ROLE]..[/TURN]`` (any other).
A marker inside a text gets a backslash behind its bracket, one that has backslashes there gets one more; taking one away
again restores every text.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import whole_text
from pathlore.llm.token_counts import can_cut, count_batch, piece_lengths
from pathlore.operators import core

MODEL = "piece_bpe_32k.model"
BUDGET = 2048  # tokens of a window; a single longer turn has a window of its own
HISTORY_TURNS = 2
HISTORY_TOKENS = 512
MAX_TURNS = 1 << 16  # turns of one conversation that one task sorts
BLOCK_TURNS = 1024
CALL_ROWS = 512  # turns that are Python objects at a time

MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_INSIDE = r"/?(?:s>|SYS\]|INST\]|ROLE\]|TURN\])"
_CONTROL = re.compile(rf"([<\[])(\\*{_INSIDE})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*{_INSIDE})")
_TURN = re.compile(r"\[SYS\](.*?)\[/SYS\]|\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[ROLE\](.*?)\[/ROLE\](.*?)\[/TURN\]", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """(the turn with its markers, start and end of the text in it)."""
    first, last = MARKS.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "[/TURN]")
    inner = escape(text)
    return first + inner + last, len(first), len(first) + len(inner)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a window, as they went in."""
    for found in _TURN.finditer(text):
        for role, inner in zip(MARKS, found.groups()):
            if inner is not None:
                yield role, unescape(inner)
        if found[5] is not None:
            yield unescape(found[4]), unescape(found[5])


@dataclass
class Turn:
    step: int
    role: str
    text: str  # with markers
    start: int
    end: int
    tokens: int


@dataclass
class Window:
    """Repeated turns, then the turns that count; ``base`` is the prefix sum at the first of these."""

    repeated: list[Turn]
    base: int
    own: list[Turn] = field(default_factory=list)

    def row(self, key: str) -> tuple:
        text, spans, at = [], [], 0
        for turn in (*self.repeated, *self.own):
            text.append(turn.text)
            if turn.role == "assistant" and len(text) > len(self.repeated):
                spans.append({"start": at + turn.start, "end": at + turn.end})
            at += len(turn.text)
        tokens = sum(t.tokens for t in self.repeated) + sum(t.tokens for t in self.own)
        return key, self.own[0].step, len(self.own), len(self.repeated), tokens, "".join(text), spans


def cut_windows(turns: Iterable[tuple[Turn, bool]], budget: int, history: int, history_tokens: int) -> Iterator[Window]:
    """Windows over the turns of one block; the flag tells copies that only serve as system turn or history."""
    system: Turn | None = None
    past: deque[Turn] = deque(maxlen=max(1, history))
    window, prefix = None, 0  # prefix: tokens of all turns of the block so far

    def repeats(first: Turn) -> list[Turn]:
        kept, total = [], 0
        for turn in reversed(past if history else ()):
            total += turn.tokens
            if total > history_tokens:
                break
            kept.insert(0, turn)
        fixed = first.tokens + (system.tokens if system else 0)
        while kept and fixed + sum(t.tokens for t in kept) > budget:
            kept.pop(0)
        return [system, *kept] if system else kept

    for turn, copy in turns:
        if not copy:
            if window and prefix + turn.tokens - window.base + sum(t.tokens for t in window.repeated) > budget:
                yield window
                window = None
            window = window or Window(repeats(turn), prefix)
            window.own.append(turn)
            prefix += turn.tokens
        if turn.step == 0 and turn.role == "system":
            system = turn
        else:
            past.append(turn)
    if window:
        yield window


WINDOW_TYPE = pa.schema([
    ("key", pa.string()), ("window", pa.int64()), ("n_turns", pa.int64()), ("n_repeated", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
WINDOW_SCHEMA = "key string, window long, n_turns long, n_repeated long, n_tokens long, text string, loss array<struct<start: long, end: long>>"
FLUSH_CHARS = 1 << 22


def as_windows(model: str, budget: int, history: int, history_tokens: int):
    """Pass over rows (key, block, step, copy, role, text) sorted by the first three: windows as they fill."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Turn, bool]]:
        lengths, cut = piece_lengths(model), can_cut(model)
        for batch in batches:
            for at in range(0, len(batch), CALL_ROWS):
                part = batch.slice(at, CALL_ROWS).to_pydict()
                laid = [marked(r, t) for r, t in zip(part["role"], part["text"])]
                tokens = count_batch([x[0] for x in laid], lengths, cut)
                for i, (text, start, end) in enumerate(laid):
                    yield (part["key"][i], part["block"][i]), Turn(part["step"][i], part["role"][i], text, start, end, tokens[i]), part["copy"][i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, rows, held = turns(batches), [], 0
        pending = next(stream, None)
        while pending:
            name = pending[0]

            def block():
                nonlocal pending
                while pending and pending[0] == name:
                    yield pending[1:]
                    pending = next(stream, None)

            for window in cut_windows(block(), budget, history, history_tokens):
                rows.append(window.row(name[0]))
                held += len(rows[-1][-2])
                if held >= FLUSH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), WINDOW_TYPE)], schema=WINDOW_TYPE)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), WINDOW_TYPE)], schema=WINDOW_TYPE)

    return run


@dataclass(frozen=True)
class Formatted:
    """``windows`` by ``key``; ``together`` says that those of one conversation are neighbours in order in one partition."""

    windows: DataFrame
    together: bool
    id_type: str

    def rows(self, id_col: str = "conv_id") -> DataFrame:
        """The windows with the conversation's id in the place of its key."""
        return self.windows.select(id_of(self.id_type).alias(id_col), *[c for c in self.windows.columns if c != "key"])


def id_of(kind: str):
    return F.when(F.col("key") != "", F.substr(F.col("key"), F.lit(2))).cast(kind)


def format_chats(
    chats: DataFrame, budget: int = BUDGET, history: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS, model: str = MODEL,
    id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", max_turns: int | None = None, block_turns: int = BLOCK_TURNS,
) -> Formatted:
    """Windows of every conversation: window (place of its first own turn), n_turns (own), n_repeated, n_tokens, text and loss.

    ``loss`` has the code points (end exclusive) of the assistant texts among the own turns; the first n_repeated turns are
    copies. Turns go by turn number, NULL first, ties by role and text; rows that repeat are turns of their own. A NULL text
    or role is empty; NULL ids are one conversation; any id that survives a cast to text and back will do. A system turn is
    kept if it is the first. A turn above the budget is never cut: it has a window of its own. An empty table has no windows;
    other columns are not read.
    """
    if budget < 1 or history < 0 or history >= block_turns:
        raise ValueError("budget must be positive and history between 0 and block_turns - 1")
    key = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    rows = chats.select(key.alias("key"), F.col(turn).alias("turn"), whole_text(F.col(role).cast("string")).alias("role"), whole_text(text).alias("text"))
    log = core.order_log(rows, ["key"], ["turn", "role", "text"], max_rows=max_turns or MAX_TURNS)
    kept = ["key", "block", "step", "copy", "role", "text"]
    if log.block is None:
        laid = log.df.withColumns({"block": F.lit(0).cast("long"), "copy": F.lit(False)}).select(*kept)
        laid = laid.sortWithinPartitions("key", "block", "step")  # the window of the steps has put each key into one partition
    else:
        own = log.df.withColumns({"block": core.block_of(F.col("step"), block_turns), "copy": F.lit(False)}).select(*kept)
        before = own.where(F.col("step") % block_turns >= block_turns - history).withColumns({"block": F.col("block") + 1, "copy": F.lit(True)})
        last = log.df.groupBy("key").agg(F.max("step").alias("last"))
        first = own.where("step = 0 and role = 'system'").join(last, "key").withColumn("last", core.block_of(F.col("last"), block_turns)).where("last > 0")
        system = first.withColumns({"block": F.explode(F.sequence(F.lit(1).cast("long"), F.col("last"))), "copy": F.lit(True)}).select(*kept)
        laid = core.spread(own.unionByName(before).unionByName(system), "key", "block").sortWithinPartitions("key", "block", "step")
    windows = laid.mapInArrow(as_windows(model, budget, history, history_tokens), WINDOW_SCHEMA)
    return Formatted(windows, log.block is None, dict(chats.dtypes)[id_col])


DIGEST_SCHEMA = "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its windows alone; the hashes are fed window by window."""
    names = [c.split()[0] for c in DIGEST_SCHEMA.split(", ")]
    key, out = None, []

    def close() -> None:
        out.append((key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted))

    for batch in batches:
        for at in range(0, len(batch), CALL_ROWS):
            for row in batch.slice(at, CALL_ROWS).to_pylist():
                if row["key"] != key:
                    if key is not None:
                        close()
                    key, n_turns, loss_chars, formatted = row["key"], 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for i, (role, text) in enumerate(read_turns(row["text"])):
                    if i >= row["n_repeated"]:
                        turns.update(f"{role}\n{text}\n".encode())
                        n_turns += 1
                for span in row["loss"]:
                    learnt = unescape(row["text"][span["start"] : span["end"]])
                    loss.update(learnt.encode())
                    loss_chars += len(learnt)
                formatted += len(row["text"])
        if len(out) >= CALL_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
            out = []
    if key is not None:
        close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)


def chat_digest(chats: DataFrame, id_col: str = "conv_id", **how) -> DataFrame:
    """One row per conversation, read back from its windows: n_turns, turns_sha256 (role and text of each turn, a line feed
    after either), loss_chars and loss_sha256 (the text under the loss mask) and formatted_chars (all windows).

    One hash over a whole conversation has to be fed in order, so its windows pass through one task, one at a time.
    """
    made = format_chats(chats, id_col=id_col, **how)
    windows = made.windows
    if not made.together:
        windows = core.spread(windows, "key").sortWithinPartitions("key", "window")
    digests = windows.select("key", "text", "loss", "n_repeated").mapInArrow(read_back, DIGEST_SCHEMA)
    return digests.select(id_of(made.id_type).alias(id_col), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
