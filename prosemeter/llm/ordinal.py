"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Method. A text's score is the sum of hashed weights, shared by all grades: the mean weight of its words' shapes, and
the weights of its distinct words and of its words' beginnings (inflected forms of a stem share them; one counts a few
times at most) over a damped root of the number of distinct words. Ordered thresholds cut the score's logistic
distribution into grades, so that P(grade >= k) = logistic(score - threshold k). Weights and thresholds are fitted
together on the log likelihood; the first threshold is free and each next one is the one before plus an exponential, so
they stay ordered. The expected grade and the tail probability of the wanted grade serve selection; its threshold is
calibrated on rated rows kept out of the fit.

The fit takes a bounded sample of rated rows, about `max_rated`, drawn by a hash of their id; their hashed features
come to the driver, no texts: 12 bytes for each of a row's distinct features. Scoring reads every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_texts
from .quality_rules import calibrated

#: Hashed words that a Python worker keeps.
KEPT_WORDS = 300_000

#: Bytes of a word's beginnings, each with a weight of its own, and how often in a text one counts at most.
BEGINNINGS, TIMES = (4, 6), 4

_SHAPE = bytes(48 if 48 <= b < 58 else 65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else b for b in range(256))
_LONG_RUN = re.compile(rb"(.)\1\1+", re.DOTALL)


def shape(word: bytes) -> bytes:
    """Digits as 0, capitals as A, other letters as a; no more than two of a kind in a row."""
    return _LONG_RUN.sub(rb"\1\1", word.translate(_SHAPE))


def hashed(word: bytes, buckets: int) -> tuple[int, tuple[int, ...], int]:
    """The places of the weights of a word, of its beginnings shorter than itself, and of its shape."""
    low = word.lower()
    own = xxhash.xxh32_intdigest(low) % buckets
    return own, tuple(xxhash.xxh32_intdigest(low[:n], n) % buckets for n in BEGINNINGS if len(low) > n), xxhash.xxh32_intdigest(shape(word), 1) % buckets


class Places(dict):
    """hashed() by word, computed once for a word; what is kept is bounded."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> tuple[int, tuple[int, ...], int]:
        if len(self) >= KEPT_WORDS:
            self.clear()
        out = self[word] = hashed(word, self.buckets)
        return out


def features(raw: bytes | None, places: Places) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text; none for a text without words."""
    words = raw.split() if raw else []
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    distinct: set[int] = set()
    begun: dict[int, int] = {}
    out: dict[int, float] = {}
    for w, n in Counter(words).items():
        own, beginnings, at = places[w]
        distinct.add(own)
        for x in beginnings:
            begun[x] = begun.get(x, 0) + n
        out[at] = out.get(at, 0.0) + n / len(words)
    damped = _damped(len(distinct))
    for x in distinct:
        out[x] = out.get(x, 0.0) + damped
    for x, n in begun.items():
        out[x] = out.get(x, 0.0) + damped * min(n, TIMES)
    out[places.buckets] = sum(map(bytes.__eq__, words, words[1:])) / len(words)
    return np.fromiter(out, np.int64, len(out)), np.fromiter(out.values(), np.float64, len(out))


def _damped(n: int) -> float:
    return 1 / (1 + n / 50) ** 0.5


@dataclass
class Ordinal:
    """weights: by place, the last for repeated words; thresholds: ascending, one fewer than grades."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds)))


def bounds(free: np.ndarray) -> np.ndarray:
    """The ordered thresholds of free parameters, between minus and plus infinity."""
    return np.concatenate([[-np.inf], np.concatenate([free[:1], np.exp(free[1:])]).cumsum(), [np.inf]])


def slopes(score: np.ndarray, grades: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood of each row, its derivative by the row's score, and the mean's by the free parameters."""
    cut = bounds(free)
    a, b = (1 / (1 + np.exp(np.clip(-(cut[grades + i] - score), -40, 40))) for i in (0, 1))
    p = np.maximum(b - a, 1e-12)
    by_cut = np.zeros(len(cut))
    np.add.at(by_cut, grades + 1, b * (1 - b) / p)
    np.add.at(by_cut, grades, -a * (1 - a) / p)
    up = by_cut[1:-1][::-1].cumsum()[::-1] / len(score)
    return np.log(p), a + b - 1, np.concatenate([up[:1], up[1:] * np.exp(free[1:])])


def train(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, buckets: int, epochs: int, rate: float, sparse: float, decay: float, seed: int) -> Ordinal:
    """Follow-the-regularised-leader in batches of 32 rows: rates by coordinate, and weights of little evidence stay 0.

    sparse, decay: penalties on the absolute and on the squared weights.
    """
    dealt = np.random.Generator(np.random.PCG64(seed))
    w, pull, squares = (np.zeros(buckets + 1) for _ in range(3))
    share = np.array([(grades >= k).mean() for k in range(1, n_grades)]).clip(0.01, 0.99)
    first = -np.log(share / (1 - share))
    free = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    free_squares = np.full(len(free), 1e-2)
    for _ in range(epochs):
        order = dealt.permutation(len(rows))
        for start in range(0, len(order), 32):
            batch = order[start : start + 32]
            where = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            touched, back = np.unique(where, return_inverse=True)
            _, slope, up = slopes(np.bincount(owner, w[where] * values, len(batch)), grades[batch], free)
            g = -np.bincount(back, slope[owner] * values, len(touched))
            before, squares[touched] = squares[touched], squares[touched] + g * g
            after = np.sqrt(squares[touched])
            pull[touched] += g - (after - np.sqrt(before)) / rate * w[touched]
            z = pull[touched]
            w[touched] = -np.sign(z) * np.maximum(np.abs(z) - sparse, 0) / ((1 + after) / rate + decay)
            free_squares += up * up
            free += 0.3 * up / np.sqrt(free_squares)
    return Ordinal(w, bounds(free)[1:-1])


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, wanted: int, max_rated: int = 20000, buckets: int = 1 << 18, epochs: int = 16, rate: float = 1.0, sparse: float = 4.0, decay: float = 1.0, caution: float = 3.0, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Ordinal:
    """ratings: id_col and grade_col from 0 to n_grades - 1; rows outside are not used. wanted: the grade to select from.

    A document rated more than once has its lowest grade. Without usable ratings all weights are 0 and every text passes.
    """
    usable = ratings.where(F.col(grade_col).between(0, n_grades - 1))
    n = usable.count()
    some = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 20)) < min(1.0, max_rated / max(n, 1)) * (1 << 20)
    drawn = usable.where(some).groupBy(F.col(id_col).alias("id")).agg(F.min(grade_col).cast("int").alias("grade"))

    kept: list[Places] = []

    def run(texts: list[bytes | None]) -> pa.Array:
        if not kept:
            kept.append(Places(buckets))
        found = [features(t, kept[0]) for t in texts]
        return pa.array([{"places": p, "values": v} for p, v in found], pa.struct([("places", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "id")  # about max_rated short rows
    rows = rows.select("id", "grade", over_texts(run, "places array<int>, values array<double>")(F.col("t")).alias("f"))
    seen = sorted(((r.id, r.grade, np.array(r.f.places, np.int64), np.array(r.f["values"])) for r in rows.toLocalIterator()), key=lambda r: (str(r[0]), len(r[2])))
    if not seen:
        return Ordinal(np.zeros(buckets + 1), np.linspace(-1, 1, n_grades - 1), 0.0)
    aside = np.array([xxhash.xxh32_intdigest(str(r[0])) % 4 == 0 for r in seen])
    grades = np.array([r[1] for r in seen])
    every = [(r[2], r[3]) for r in seen]
    model = train([x for x, a in zip(every, aside, strict=True) if not a] or every, grades[~aside] if (~aside).any() else grades, n_grades, buckets, epochs, rate, sparse, decay, seed)
    kept = aside if aside.any() else ~aside
    score = np.array([model.weights[p] @ v for (p, v), k in zip(every, kept, strict=True) if k])
    low = 1 - model.tails(score)[:, wanted - 1]
    good = grades[kept] >= wanted
    model.cut = 1 - min(1.0, calibrated(low[good], low[~good], caution))
    return model


def graded(docs: DataFrame, model: Ordinal, wanted: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_words, expected_grade, tail (probability of the wanted grade or more), kept.

    kept: the tail reaches the calibrated cut, a tie included. A null or empty text, or one of white space, has no
    evidence: its score is 0 and it is judged by the thresholds alone. A text of any length is read whole. Repeated rows
    and null ids get the answer of their text; an empty table gives an empty result; other columns of docs, of whatever
    name, are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("n_words", pa.int64()), ("expected_grade", pa.float64()), ("tail", pa.float64())])
    buckets = len(model.weights) - 1

    kept: list[Places] = []

    def run(texts: list[bytes | None]) -> pa.Array:
        if not kept:
            kept.append(Places(buckets))
        weights = shared.value.weights
        n, score = [], []
        for t in texts:
            places, values = features(t, kept[0])
            n.append(len(t.split()) if t else 0)
            score.append(float(weights[places] @ values))
        tails = shared.value.tails(np.array(score).reshape(-1))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(tails.sum(axis=1)), pa.array(tails[:, wanted - 1])], fields=list(kind))

    column = over_texts(run, "n_words long, expected_grade double, tail double")(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), column.alias("g")).select("doc_id", "g.*", (F.col("g.tail") >= model.cut).alias("kept"))
