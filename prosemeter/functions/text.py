"""Sentences and tokens as column expressions; none of them needs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\r\n"

#: A sentence ends after . ! or ? if white space and one of these follow.
_BOUNDARY = r"""(?<=[.!?])\s+(?=[A-Z0-9"'(])"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it, also within lambdas over arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def sentences(text: Column) -> Column:
    """Trimmed sentences in order, without empty ones; null for null."""
    return F.filter(F.transform(F.split(trimmed(text), _BOUNDARY), trimmed), lambda s: s != "")


def spaced(text: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != "")


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    """Letters with inner apostrophes and hyphens, on lowered text."""
    return all_of(F.lower(text), r"[A-Za-z][A-Za-z'\-]*")


def letters(text: Column) -> Column:
    """Runs of a-z and apostrophes, on lowered text."""
    return all_of(F.lower(text), "[a-z']+")


def long_words(text: Column) -> Column:
    """Runs of four letters or apostrophes and more, lowered."""
    return all_of(F.lower(text), "[a-zA-Z']{4,}")


def alphanumeric(text: Column) -> Column:
    return all_of(F.lower(text), "[a-z0-9']+")


def normalised(text: Column) -> Column:
    """Runs of letters, digits and apostrophes, on lowered text."""
    return all_of(F.lower(text), r"[\p{L}\p{N}'’]+")


def n_grams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams in order. Each shift is one pass, so the work grows with n times the tokens only."""

    def of(t: Column) -> Column:
        count = F.size(t) - (n - 1)
        out = F.slice(t, F.lit(1), count)
        for i in range(1, n):
            out = F.zip_with(out, F.slice(t, F.lit(1 + i), count), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(count > 0, out).otherwise(F.array().cast("array<string>"))

    return let(tokens, of)


def gram_hashes(tokens: Column, n: Column) -> Column:
    """64-bit hashes of the n-grams in order; n, by row, is 4 or 8.

    A gram's hash is that of its halves' hashes, so each doubling is one pass: two passes for four words, three for
    eight. A slice for each gram would copy the whole array each time, which is quadratic in a long text.
    """

    def doubled(h: Column, k: int) -> Column:
        count = F.size(h) - k
        pairs = F.zip_with(F.slice(h, F.lit(1), count), F.slice(h, F.lit(1 + k), count), lambda a, b: F.xxhash64(a, b))
        return F.when(count > 0, pairs).otherwise(F.array().cast("array<bigint>"))

    four = let(let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1)), lambda h: doubled(h, 2))
    return let(four, lambda h: F.when(n == 4, h).otherwise(doubled(h, 4)))


def clamped(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within bounds; null stays null, which greatest() and least() alone would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def snippet(text: Column, limit: int = 80) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(limit - 1))), F.lit("…")))
