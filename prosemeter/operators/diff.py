"""Word diffs of two texts."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a word-by-word comparison beyond which sentences are compared instead.
CELLS = 4_000_000

OPS = "array<struct<type: string, text: string>>"


def _units(text: str, by_sentence: bool) -> list[str]:
    """Pieces that add up to the text: words with the white space after them, or sentences."""
    return re.findall(r"[^.!?]*[.!?]+\s*|[^.!?]+$" if by_sentence else r"\s+|\S+\s*", text)


def operations(before: str, after: str) -> list[dict]:
    a, b = _units(before, False), _units(after, False)
    if len(a) * len(b) > CELLS:
        a, b = _units(before, True), _units(after, True)
        if len(a) * len(b) > CELLS:
            a, b = [before], [after]
    out: list[dict] = []

    def add(kind: str, parts: list[str]) -> None:
        if parts:
            if out and out[-1]["type"] == kind:
                out[-1]["text"] += "".join(parts)
            else:
                out.append({"type": kind, "text": "".join(parts)})

    for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            add("same", a[i:j])
        else:
            add("del", a[i:j])
            add("add", b[k:m])
    return out


def word_diff(before: Column, after: Column) -> Column:
    """Operations same, del and add in document order; null texts count as empty."""

    def run(befores: pd.Series, afters: pd.Series) -> pd.Series:
        return pd.Series([operations(a or "", b or "") for a, b in zip(befores, afters, strict=True)], dtype=object)

    return F.pandas_udf(run, OPS)(before, after)


def reconstructed(ops: Column, side: str) -> Column:
    """The text before (side "del") or after (side "add")."""
    return F.array_join(F.transform(F.filter(ops, lambda o: o["type"].isin("same", side)), lambda o: o["text"]), "")
