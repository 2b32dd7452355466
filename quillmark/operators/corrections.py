"""Corrections of lines: an edit is applied where its fragment is found once and only once; notes are read for the edits they quote."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDIT = T.StructType([T.StructField(n, T.StringType()) for n in ("op", "minted", "corrected", "at")])

#: What notes say, with a quoted word as Q; each maps its quotes to (op, minted, corrected, at). Fixed values.
_Q = r'"([^"]+)"'
SAYINGS = (
    (rf"{_Q}\s*is transcribed as\s*{_Q}", lambda a, b: ("replace", b, a, "")),
    (rf"{_Q}\s*instead of\s*{_Q}", lambda a, b: ("replace", b, a, "")),
    (rf"{_Q}\s*(?:->|→|=>)\s*{_Q}", lambda a, b: ("replace", a, b, "")),
    (rf"missing\s*{_Q}\s*before\s*{_Q}", lambda a, b: ("insert", "", a, f"before:{b}")),
    (rf"missing\s*{_Q}\s*after\s*{_Q}", lambda a, b: ("insert", "", a, f"after:{b}")),
    (rf"missing\s*{_Q}\s*(?:at|in)\s+the\s+end", lambda a: ("insert", "", a, "end")),
    (rf"missing\s*{_Q}\s*(?:at|in)\s+the\s+(?:beginning|start)", lambda a: ("insert", "", a, "start")),
    (rf"added\s*{_Q}\s*after\s*{_Q}", lambda a, b: ("delete", a, "", f"after:{b}")),
    (rf"added\s*{_Q}", lambda a: ("delete", a, "", "")),
)
_WHOLE = re.compile(rf"^\s*(?:correct boundary\s*:?\s*|we read\s*|should be\s*|it reads\s*)?{_Q}[\s.]*$", re.IGNORECASE)
_SAYINGS = [(re.compile(p, re.IGNORECASE), make) for p, make in SAYINGS]


def edits_in(note: str | None) -> list[tuple[str, str, str, str]]:
    """The edits (op, minted, corrected, at) that a note quotes, each once; a note that is one quotation gives the whole line."""
    text = (note or "").replace("“", '"').replace("”", '"')
    if whole := _WHOLE.match(text):
        return [("line", "", whole[1], "")]
    found: dict[tuple, None] = {}
    for pattern, make in _SAYINGS:
        # what one saying took is not read again by a later, wider one
        text = pattern.sub(lambda m, make=make: found.setdefault(make(*m.groups())) or " ", text)
    return list(found)


def spelled(text: str, fragment: str) -> str | None:
    """A fragment as a text has it once and only once, with either apostrophe."""
    forms = dict.fromkeys((fragment, fragment.replace("'", "’"), fragment.replace("’", "'")))
    return next((f for f in forms if f and text.count(f) == 1), None)


def joined(a: str, b: str) -> str:
    """Two parts of a line: a single letter or a mark goes on a word, words are apart."""
    close = not a or not b or a[-1] in "'’-" or b[0] in "'’,.;:" or 1 in (len(a), len(b))
    return a + b if close else f"{a} {b}"


def corrected(text: str | None, op: str, minted: str, new: str, at: str) -> str | None:
    """The line after an edit, or None where the edit's place is not clear."""
    line, (kind, _, anchor) = " ".join((text or "").split()), at.partition(":")
    if op == "line":
        return new
    if op == "replace":
        old = spelled(line, minted)
        return line.replace(old, new) if old else None
    if kind in ("before", "after"):
        here = spelled(line, anchor)
        if here is None:
            return None
        head, tail = line.split(here)
        if op == "insert":
            return head + (f"{new} {here}" if kind == "before" else f"{here} {new}") + tail
        rest = tail.lstrip()
        gone = next((f for f in (minted, minted.replace("'", "’"), minted.replace("’", "'")) if f and rest.startswith(f)), None)
        return " ".join((head + here + tail[: len(tail) - len(rest)] + rest[len(gone) :]).split()) if gone else None
    if op == "insert":
        return {"end": joined(line, new), "start": joined(new, line)}.get(kind)
    if kind == "start":
        return line[len(minted) :].lstrip() if line.startswith(minted) else None
    if kind == "end":
        core = line.rstrip(" ,.;:")  # the mark after a dropped word goes with it
        return core[: -len(minted)].rstrip() if core.endswith(minted) else None
    old = spelled(line, minted)
    return " ".join(line.replace(old, " ").split()) if old else None


@F.pandas_udf(T.ArrayType(EDIT))
def note_edits(note: pd.Series) -> pd.Series:
    names = EDIT.fieldNames()
    return note.map(lambda n: [dict(zip(names, e, strict=True)) for e in edits_in(n)])


@F.pandas_udf(T.StringType())
def with_edits(text: pd.Series, edits: pd.Series) -> pd.Series:
    """The line after all edits that have a clear place, in order; None if none has."""

    def apply(line, found):
        done = None
        for e in found if found is not None else []:
            after = corrected(line if done is None else done, e["op"], e["minted"], e["corrected"], e["at"])
            done = after if after is not None else done
        return done

    return pd.Series([apply(t, e) for t, e in zip(text, edits, strict=True)], dtype=object)
