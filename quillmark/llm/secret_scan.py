"""Secret scan: patterns, and strings that a tokenizer finds hard to say.

Random strings cost a byte-level BPE vocabulary more tokens a character than
prose or identifiers do. Of every run of ``[A-Za-z0-9+/_=-]`` of 20 characters or more, what
no pattern and no known digest covers is tokenized, and reported as ``random`` if it has fewer than
``least_ratio`` characters a token, unless it is a known digest or number; words pass by their measure. Of a run with more, each stretch of
20 characters or more with fewer is reported, so words around a random string do not hide it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from quillmark.llm.byte_bpe import Encoder
from quillmark.llm.shared import map_texts

#: In this order where spans start together.
KINDS = ("assign", "access", "hex", "random")
LEAST_RATIO = 2.0
SPANS = "spans array<struct<kind: string, start: long, end: long, found: string>>"

# The patterns of the contract, and least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 24

#: Holds every match of ACCESS and HEX that is long enough, so texts without such a run need no further look.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

# What a long run may be without being a secret.
KNOWN = (
    re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})"),  # md5, sha-1, sha-2
    re.compile(r"sha(?:1|224|256|384|512)-[A-Za-z0-9+/]+={0,2}"),  # digests of subresources
    re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUIDs
    re.compile(r"[0-9+/_=-]+"),  # numbers, dates, rules
)


#: Digests among other characters of a run.
INSIDE = re.compile("|".join(rf"(?<![A-Za-z0-9])(?:{k.pattern})(?![A-Za-z0-9])" for k in KNOWN[:3]))
LEAST = 20
JOINTS = "/_=+-"


def stretches(lengths: list[int], least_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of tokens with fewer than ``least_ratio`` characters a token, by one pass (Ruzzo and Tompa)."""
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    total, at = 0.0, 0
    for n in lengths:
        before, total = total, total + least_ratio - n
        at += n
        if n >= least_ratio:
            continue
        new = (before, total, at - n, at)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= new[0]:
                j -= 1
            if j < 0 or kept[j][1] >= new[1]:
                kept.append(new)
                break
            new = (kept[j][0], new[1], kept[j][2], new[3])
            del kept[j:]
    return [k[2:] for k in kept]


def random_parts(part: str, encoder: Encoder, least_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run or the part of one: all of it, or else stretches of it."""
    known = lambda s: any(k.fullmatch(s) for k in KNOWN)
    if len(part) < LEAST or known(part):
        return []
    lengths = encoder.lengths(part)
    if len(part) < least_ratio * len(lengths):
        return [(0, len(part))]
    out = []
    for start, end in stretches(lengths, least_ratio):
        while start < end and part[start] in JOINTS:
            start += 1
        while start < end and part[end - 1] in JOINTS:
            end -= 1
        if end - start >= LEAST and not known(part[start:end]):
            out.append((start, end))
    return out


def find(text: str | None, encoder: Encoder, least_ratio: float = LEAST_RATIO) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, string) by start, then kind; positions are code points, ends exclusive."""
    if not text:
        return []
    spans = []
    lowered = text.encode("utf-8", "surrogatepass").lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end(), m[0]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    runs = list(RUN.finditer(text))
    if runs:
        spans += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        spans += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
        base = list(spans)
        for run in runs:
            start, end = run.span()
            covered = [(max(a, start), min(b, end)) for _, a, b, _ in base if start < b and a < end] + [(start + m.start(), start + m.end()) for m in INSIDE.finditer(run[0])]
            for a, b in [*sorted(covered), (end, end)]:
                spans += [("random", start + x, start + y, text[start + x : start + y]) for x, y in random_parts(text[start:a], encoder, least_ratio)]
                start = max(start, b)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, *, path: str, pattern: str, least_ratio: float = LEAST_RATIO, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``spans`` (kind, start, end, found); null and empty texts have none.

    Whole texts are searched, in one pass without a shuffle; repeated rows give
    equal spans; a column named spans is replaced.
    """

    def work():
        encoder = Encoder(path, pattern)
        name = ("kind", "start", "end", "found")
        return lambda texts: [[[dict(zip(name, s, strict=True)) for s in find(t, encoder, least_ratio)] for t in texts]]

    return map_texts(docs, work, SPANS, text=text, keep=keep)
