"""Sentence lengths made uneven: sentences are cut at safe places and neighbours joined.

A text is walked once, sentence by sentence, and what a change does to the lengths is kept as three sums, so the work
grows with the text only. Sentences and random numbers come in as arrays that Spark has made, so reruns agree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon

#: Where a sentence may be cut; what is cut away must be a clause of its own.
_CUT = re.compile(r"; |, (?:and|but|so|yet|while|whereas|because|although) ")
_ENDS = ".!?"
_DISCOURSE = frozenset(lexicon.TRANSITION_SWAPS) | frozenset(lexicon.LIST_MARKERS)
_PLAIN_OPENERS = (frozenset(lexicon.NON_ENTITIES) | {w.capitalize() for w in lexicon.STOPWORDS}) - {"I"}


@dataclass(frozen=True)
class Rule:
    """Which sentences are cut and joined: bounds are in words, inclusive; a joined one has `joined` words at most."""

    cut: tuple[int, int]
    join: tuple[int, int]
    joined: int
    cut_chance: float = 1.0
    join_chance: float = 1.0


FLAT = Rule((18, 46), (12, 34), 55)


class Lengths:
    """Count, sum and sum of squares of sentence lengths."""

    def __init__(self, sizes: list[int]) -> None:
        self.n, self.sum, self.squares = len(sizes), sum(sizes), sum(x * x for x in sizes)

    def change(self, old: list[int], new: list[int]) -> None:
        self.n += len(new) - len(old)
        self.sum += sum(new) - sum(old)
        self.squares += sum(x * x for x in new) - sum(x * x for x in old)

    def cv(self) -> float:
        """Sample deviation over mean; 0 below two sentences or without words."""
        if self.n < 2 or not self.sum:
            return 0.0
        return ((self.n * self.squares - self.sum**2) / (self.n * (self.n - 1))) ** 0.5 * self.n / self.sum


def size(sentence: str) -> int:
    return len(sentence.split())


def halves(sentence: str) -> list[str] | None:
    """Two sentences, cut at the first place that leaves six words before and five after; None without one."""
    for m in _CUT.finditer(sentence):
        head, tail = sentence[: m.start()].rstrip(" ,;"), sentence[m.end() :].strip()
        if size(head) >= 6 and size(tail) >= 5:
            return [head + ".", tail[:1].upper() + tail[1:] + ("" if tail[-1] in _ENDS else ".")]
    return None


def joinable(a: str, b: str, rule: Rule) -> bool:
    """Two statements of lengths within the rule; none that opens with a transition or a list marker is joined."""
    na, nb, (low, high) = size(a), size(b), rule.join
    opener = re.match(r"[A-Za-z]*", b)[0].lower()
    return low <= na <= high and low <= nb <= high and na + nb <= rule.joined and a.endswith(".") and opener not in _DISCOURSE


def joined(a: str, b: str) -> str:
    """b loses its capital only if its first word is none of a name."""
    first, space, rest = b.partition(" ")
    return f"{a.rstrip('.')}, and {first.lower() if first in _PLAIN_OPENERS else first}{space}{rest}"


def walked(sents: list[str], draws: list[float], rule: Rule) -> list[str]:
    """Each sentence joins the one before, is cut or stays; one that was changed is not changed again."""
    out: list[str] = []
    untouched = False
    for s, draw in zip(sents, draws, strict=True):
        if untouched and draw < rule.join_chance and joinable(out[-1], s, rule):
            out[-1] = joined(out[-1], s)
            untouched = False
            continue
        parts = halves(s) if rule.cut[0] <= size(s) <= rule.cut[1] and draw < rule.cut_chance else None
        out += parts or [s]
        untouched = parts is None
    return out


def forced(sents: list[str], least: float = 0.30, rule: Rule = FLAT) -> list[str]:
    """Sentences are cut in order until lengths vary by `least`, then neighbours joined; stops without a candidate."""
    lengths = Lengths([size(s) for s in sents])
    cut: list[str] = []
    for s in sents:
        parts = halves(s) if lengths.cv() < least and rule.cut[0] <= size(s) <= rule.cut[1] else None
        if parts:
            lengths.change([size(s)], [size(p) for p in parts])
        cut += parts or [s]
    out: list[str] = []
    for s in cut:
        if out and lengths.cv() < least and joinable(out[-1], s, rule):
            one = joined(out[-1], s)
            lengths.change([size(out[-1]), size(s)], [size(one)])
            out[-1] = one
        else:
            out.append(s)
    return out


def flat(sents: list[str], least_sentences: int, below: float) -> bool:
    return len(sents) >= least_sentences and Lengths([size(s) for s in sents]).cv() < below


def restructured(text: Column, sents: Column, draws: Column, wanted: Column, rule: Rule, least_sentences: int, below: float, force: bool) -> Column:
    """The text, walked by the rule where it is wanted and its lengths vary by less than `below`; else as it was.

    With `force`, what is still flat after the walk is forced. Null texts stay null.
    """

    def of(t: str | None, s: list[str] | None, d: list[float] | None, w: bool | None) -> str | None:
        if t is None or not w or not flat(s, least_sentences, below):
            return t
        out = walked(list(s), list(d), rule)
        return " ".join(forced(out) if force and flat(out, 4, 0.30) else out)

    def run(t: pd.Series, s: pd.Series, d: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([of(*row) for row in zip(t, s, d, w, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(text, sents, draws, wanted)
