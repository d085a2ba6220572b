"""Chat windows: exact round trips, and windows against a plain loop over each conversation."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathlore.llm import chats
from pathlore.llm.token_counts import piece_lengths

SCHEMA = "conv_id long, turn long, role string, text string, key string, block int, step string"
SCRAPS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]", "\\", "<", "[", "/", "s>", "INST]", "<\\/s>", "<INST]", "é😀", " ", "\n", "a"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "tool", "</s>", "[/ROLE]\\"]), st.lists(st.sampled_from(SCRAPS), max_size=12).map("".join)), max_size=6))
def test_markers_inside_texts_come_back(turns):
    laid = [chats.marked(*t) for t in turns]
    whole = "".join(x[0] for x in laid)
    assert list(chats.read_turns(whole)) == turns
    at = 0
    for (text, start, end), turn in zip(laid, turns):
        assert chats.unescape(whole[at + start : at + end]) == turn[1]
        at += len(text)


def plain(turns, budget, history, history_tokens, lengths, block):
    """Windows as lists of (role, text, own) over one conversation."""
    cost = [lengths([chats.marked(*t)[0]])[0] for t in turns]
    system = 0 if turns[0][0] == "system" else None
    out, own, repeated = [], [], []
    for i in range(len(turns)):
        used = sum(cost[j] for j in own + repeated)
        if own and (used + cost[i] > budget or i % block == 0):
            out.append((repeated, own))
            own = []
        if not own:
            past = [j for j in range(max(0, i - history), i) if j != system]
            while past and sum(cost[j] for j in past) > history_tokens:
                past.pop(0)
            fixed = cost[i] + (cost[system] if system is not None and i else 0)
            while past and fixed + sum(cost[j] for j in past) > budget:
                past.pop(0)
            repeated = ([system] if system is not None and i else []) + past
        own = own + [i]
    return out + [(repeated, own)]


def some_chats(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(12), 2**60 + 1, None]:
        turns = rng.randint(1, 25)
        for t in range(turns):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "system", "tool", None])
            text = rng.choice([None, "", "word " * rng.randint(1, 40), "".join(rng.choices(SCRAPS, k=8)), "long " * 400])
            rows.append((conv, rng.choice([t, t, t // 2, None]), role, text, "clash", 1, "x"))
    rows += [rows[3], rows[3], (-1, 0, "user", "</s>[INST] ok [/INST]", "", 0, ""), (-1, 1, "assistant", "</s>[INST] ok [/INST]", "", 0, "")]
    return rows


def in_order(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
    return {k: [(t[2].decode(), t[3].decode()) for t in sorted(v)] for k, v in by.items()}


@pytest.mark.parametrize("max_turns, block, budget, history, tokens", [(None, 1024, 120, 2, 60), (None, 1024, 400, 0, 0), (4, 6, 120, 3, 80), (4, 5, 2048, 2, 512)])
def test_windows_are_those_of_a_plain_loop(spark, max_turns, block, budget, history, tokens):
    rows = some_chats(budget + history)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made = chats.format_chats(docs, budget, history, tokens, max_turns=max_turns, block_turns=block)
    assert made.together == (max_turns is None)
    got = {}
    for r in made.rows().collect():
        got.setdefault(r["conv_id"], []).append(r)
    lengths = piece_lengths(chats.MODEL)
    want = in_order(rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        windows = plain(turns, budget, history, tokens, lengths, block if max_turns else 10**9)
        rows_of = sorted(got[conv], key=lambda r: r["window"])
        assert len(rows_of) == len(windows)
        for r, (repeated, own) in zip(rows_of, windows):
            assert (r["window"], r["n_turns"], r["n_repeated"]) == (own[0], len(own), len(repeated))
            assert list(chats.read_turns(r["text"])) == [turns[i] for i in repeated + own]
            assert [chats.unescape(r["text"][s["start"] : s["end"]]) for s in r["loss"]] == [turns[i][1] for i in own if turns[i][0] == "assistant"]
            assert r["n_tokens"] <= budget or len(own) == 1 and r["n_repeated"] <= 1


@pytest.mark.parametrize("max_turns, block", [(None, 1024), (4, 6)])
def test_digests_are_those_of_the_rows(spark, max_turns, block):
    rows = some_chats()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["conv_id"]: r for r in chats.chat_digest(docs, budget=100, history_tokens=50, max_turns=max_turns, block_turns=block).collect()}
    for conv, turns in in_order(rows).items():
        said = "".join(t for r, t in turns if r == "assistant")
        r = got.pop(conv)
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(said))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["formatted_chars"] > sum(len(b) for _, b in turns)
    assert not got


def test_an_empty_table(spark):
    assert chats.chat_digest(spark.createDataFrame([], SCHEMA)).collect() == []
