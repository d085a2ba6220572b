"""Secret scans with multipart credential linking.

Strong findings (assigned secrets, access keys, long hex strings) stand by themselves. Weak candidates (account names,
random-looking strings, short assigned values, hosts and addresses) say nothing alone: they are reported only where
complementary parts of one credential stand together. Parts are intervals of the text; an interval join by a sweep over
their starts pairs identifiers with secrets, and then endpoints with secrets that are reported, inside one scope (a block
of lines without a blank line); a ``reach`` in code points can bound it further. A document is one row, so the join needs no
shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathlore.llm.common import byte_texts, scratch, whole_text

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
IDENTIFIERS, SECRETS = {"access", "identifier"}, {"assign", "hex", "secret"}
BASE = {"assign", "access", "hex"}
LEAST = {"assign": 8, "access": 16, "hex": 32}

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_FLAGS = re.ASCII | re.IGNORECASE  # ASCII: no letter outside A-Z counts as one of the keywords'
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)" + _VALUE + r"([A-Za-z0-9+/_.=-]+)", _FLAGS)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a maximal run, so the same as runs of any length that are then filtered
IDENTIFIER = re.compile(r"(?:access[_-]?key[_-]?id|client[_-]?id|account(?:[_-]?id)?|user(?:[_-]?name)?|login)" + _VALUE + r"[A-Za-z0-9+/_.@=-]{3,}", _FLAGS)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(
    r"https?://[^\s\"'<>]{4,}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.]*\w)(?::\d{1,5})?"
    r"|(?:host|endpoint|server)" + _VALUE + r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::\d{1,5})?", _FLAGS)
URL_VALUE = re.compile(r"(?<=[/=:@])[A-Za-z0-9+_-]{20,}(?![A-Za-z0-9+_-])")  # a path segment or parameter of an endpoint

# One pass over the bytes that decides for nearly every text that a slow pattern cannot match.
_RUN = bytes(49 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_TOKEN = bytes(49 if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256))
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_NAME_WORDS = (b"access", b"client", b"account", b"user", b"login")
_BLANK = re.compile(r"\n[^\S\n]*\n")


class Part(NamedTuple):
    start: int
    end: int
    kind: str


def looks_random(value: str) -> bool:
    """Lower-case letters, capitals and at least two digits: a string that no word of a language makes."""
    return any(c.islower() for c in value) and any(c.isupper() for c in value) and sum(c.isdigit() for c in value) >= 2


def base_parts(text: str) -> list[Part]:
    """Strong findings, leftmost and non-overlapping for each kind; matches that are too short are consumed and dropped."""
    out = [Part(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [Part(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out + [Part(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def free_of(parts: list[Part]):
    """Whether an interval touches none of the parts."""
    taken = sorted((p.start, p.end) for p in parts)
    starts = [a for a, _ in taken]
    highest: list[int] = []
    for _, b in taken:
        highest.append(max(b, highest[-1]) if highest else b)

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or highest[i - 1] <= a

    return free


def weak_parts(text: str, strong: list[Part]) -> list[Part]:
    """Candidates that do not touch a strong finding. Names and secrets do not overlap each other (the earlier one stays);
    both may stand inside an endpoint, where a secret is a short assigned value or a random segment or parameter."""
    clear = free_of(strong)
    hosts = [Part(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text) if clear(*m.span())]
    outside = free_of(hosts)
    found = [Part(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
    found += [Part(m.start(), m.end(), "secret") for m in ASSIGN.finditer(text) if 4 <= len(m[2]) < LEAST["assign"]]
    found += [Part(m.start(), m.end(), "secret") for m in RANDOM.finditer(text) if looks_random(m[0]) and outside(*m.span())]
    for p in hosts:
        found += [Part(m.start(), m.end(), "secret") for m in URL_VALUE.finditer(text, p.start, p.end) if looks_random(m[0])]
    out: list[Part] = []
    last = -1
    for p in sorted(found, key=lambda p: (p.start, -p.end)):
        if p.start >= last and clear(p.start, p.end):
            out.append(p)
            last = p.end
    return hosts + out


def interval_join(left: list[Part], right: list[Part], scope_of, reach: int | None) -> Iterator[tuple[Part, Part]]:
    """For every left part its nearest right part on either side, within the scope (and the reach, if there is one).

    Sorted starts and binary search: enough to know which parts have a partner, without making all pairs of a scope.
    """
    right = sorted(right)
    starts = [p.start for p in right]
    ends = sorted(right, key=lambda p: p.end)
    end_at = [p.end for p in ends]
    for p in left:
        i = bisect_left(starts, p.start)
        after = right[i] if i < len(right) else None
        j = bisect_left(end_at, p.end + 1) - 1
        before = ends[j] if j >= 0 else None
        for q in (before, after):
            if q is not None and q != p and (reach is None or max(p.start, q.start) - min(p.end, q.end) <= reach) and scope_of(p.start) == scope_of(q.start):
                yield p, q


def linked_parts(text: str, strong: list[Part], reach: int | None = None) -> tuple[list[Part], list[tuple[Part, Part]]]:
    """(weak candidates to report, the links that support them)."""
    weak = weak_parts(text, strong)
    if not weak:
        return [], []
    blanks = [m.start() for m in _BLANK.finditer(text)]

    def scope_of(at: int) -> int:
        return bisect_left(blanks, at)

    parts = strong + weak
    names, keys = [p for p in parts if p.kind in IDENTIFIERS], [p for p in parts if p.kind in SECRETS]
    links = list(interval_join(names, keys, scope_of, reach)) + [(b, a) for a, b in interval_join(keys, names, scope_of, reach)]
    told = {p for link in links for p in link}
    sure = [p for p in keys if p.kind in BASE or p in told]
    with_hosts = list(interval_join([p for p in weak if p.kind == "endpoint"], sure, scope_of, reach))
    links += [(b, a) for a, b in with_hosts]
    told |= {a for a, _ in with_hosts}
    return [p for p in weak if p in told], sorted(set(links))


def may_match(raw: bytes) -> bool:
    """Whether any part but an endpoint can stand in the text; an endpoint alone is never reported."""
    low = raw.lower()
    return (
        any(w in low for w in _ASSIGN_WORDS) or b"AKIA" in raw or any(w in low for w in _NAME_WORDS)
        or b"1" * 32 in raw.translate(_RUN) or b"1" * 20 in raw.translate(_TOKEN)
    )


def scan(raw: bytes, reach: int | None = None) -> dict:
    if not may_match(raw):
        return {"findings": [], "links": []}
    text = raw.decode("utf-8", "replace")
    strong = base_parts(text)
    weak, links = linked_parts(text, strong, reach)
    ordered = sorted([*strong, *weak], key=lambda p: (p.start, KINDS.index(p.kind), p.end))
    return {
        "findings": [{"kind": p.kind, "start": p.start, "end": p.end, "base": p.kind in BASE} for p in ordered],
        "links": [{"a_kind": a.kind, "a_start": a.start, "a_end": a.end, "b_kind": b.kind, "b_start": b.start, "b_end": b.end} for a, b in links],
    }


_SPAN = "struct<kind:string,start:int,end:int,base:boolean>"
_LINK = "struct<a_kind:string,a_start:int,a_end:int,b_kind:string,b_start:int,b_end:int>"
_ARROW = pa.struct([
    ("findings", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))),
    ("links", pa.list_(pa.struct([(f"{side}_{n}", pa.string() if n == "kind" else pa.int32()) for side in "ab" for n in ("kind", "start", "end")]))),
])


def secrets_in(text: Column, reach: int | None = None) -> Column:
    @F.arrow_udf(f"struct<findings:array<{_SPAN}>,links:array<{_LINK}>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([scan(raw, reach) for raw in byte_texts(batch)], _ARROW)

    return scanned(whole_text(text))


def find_secrets(docs: DataFrame, text: str = "text", reach: int | None = None, findings: str = "findings", links: str = "links") -> DataFrame:
    """``docs`` with the findings of each text (kind, start, end in code points, base) and the links of weak ones.

    NULL and empty texts have none. Every row is scanned by itself, repeated rows too; other columns pass through.
    """
    name = scratch(docs, "scan")["scan"]
    return docs.withColumn(name, secrets_in(F.col(text), reach)).withColumns(
        {findings: F.col(name)["findings"], links: F.col(name)["links"]}
    ).drop(name)


def joined_spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def secret_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts of the strong kinds, hash of the strong spans, all spans."""
    found = find_secrets(docs.select(F.col(id_col), F.col(text)), text, findings="_findings", links="_links")
    base = F.filter("_findings", lambda f: f["base"])

    def number_of(kind: str) -> Column:
        return F.size(F.filter(base, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number_of(kind) for kind in ("assign", "access", "hex")]
    return found.select(id_col, *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("_findings")).alias("spans"))
