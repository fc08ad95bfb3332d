"""Quality rules: statistics of whole texts, two plain rules, and an isolation forest over the statistics.

Method. Each tree of the forest splits a subsample of good documents' statistics at random columns and random values
until every row is alone or the depth limit is reached; values are drawn over the range that all labelled rows show. A
document's path to its leaf is short in most trees if it is unlike the others. Its anomaly score is 2 ** (-mean path / expected path). The threshold is calibrated on labelled rows: the
score that best separates good rows from bad ones (share of bad rows above it less `caution` times the share of good
rows above it).

Trees and threshold are fitted on a bounded sample: at most about `max_labelled` labelled rows, drawn by a hash of
their id; trees subsample the good ones. Their statistics, a few numbers each, come to the driver.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import over_texts

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_distinct", "n_upper", "n_bang", "n_digits", "n_lines", "n_single")
FIELDS = BASE + MORE
STATISTICS = ", ".join(f"{x} long" for x in FIELDS)

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def _count(raw: bytes, some: bytes) -> int:
    return len(raw) - len(raw.translate(None, some))


def statistics(raw: bytes | None) -> tuple[int, ...]:
    """FIELDS of one text; all 0 for null."""
    if not raw:
        return (0,) * len(FIELDS)
    words = raw.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        reach = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, reach)
                reach = i + 3
    distinct = len(set(words))
    return n, chars, _count(raw, _SYMBOLS), len(lines) - len(set(lines)), repeated, distinct, _count(raw, _UPPER), raw.count(b"!"), _count(raw, _DIGITS), len(lines), sum(len(w) == 1 for w in words)


def statistics_column(text):
    """A column of struct FIELDS for a column of texts."""

    def run(texts: list[bytes | None]) -> pa.Array:
        rows = np.array([statistics(t) for t in texts], np.int64).reshape(len(texts), len(FIELDS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(FIELDS))], list(FIELDS))

    return over_texts(run, STATISTICS)(text)


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Shares and lengths by document, for the forest; s: FIELDS."""
    n = np.maximum(s["n_words"], 1)
    chars = np.maximum(s["word_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    return np.stack([
        s["word_chars"] / n,
        s["n_symbols"] / n,
        s["n_dup_lines"] / lines,
        s["n_repeat_words"] / n,
        (n - s["n_distinct"]) / n / np.maximum(np.log10(n), 1),
        s["n_upper"] / chars,
        s["n_bang"] / n,
        s["n_digits"] / chars,
        np.log10(n / lines),
        s["n_single"] / n,
    ], 1).astype(np.float64)


def _expected(n: float) -> float:
    """Mean path of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays of nodes: column (-1: leaf), value, left and right child, path length at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    norm: float
    threshold: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for column, value, left, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            live = np.arange(len(x))
            while len(live):
                live = live[column[at[live]] >= 0]
                here = at[live]
                at[live] = np.where(x[live, column[here]] < value[here], left[here], right[here])
            total += path[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / self.norm)


def grow(x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int, subsample: int, seed: int) -> Forest:
    """Trees over subsamples of x. A split is drawn over what is left of the range low to high of its column.

    So a split can part a region that holds rows from one that holds none: what lies there is alone at once, though no
    row of x shows that the column varies.
    """
    dealt = np.random.Generator(np.random.PCG64(seed))
    size = min(subsample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2)))) + 4
    usable = np.flatnonzero(high > low)
    out = []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray, nodes=nodes) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _expected(len(rows))])
            if len(rows) > 1 and depth < limit and len(usable):
                c = int(dealt.choice(usable))
                v = dealt.uniform(low[c], high[c])
                under = rows[:, c] < v
                below, above = high.copy(), low.copy()
                below[c] = above[c] = v
                nodes[me][0:2] = c, v
                nodes[me][2] = split(rows[under], depth + 1, low, below)
                nodes[me][3] = split(rows[~under], depth + 1, above, high)
            return me

        split(x[dealt.choice(len(x), size, replace=False)], 0, low, high)
        a = np.array(nodes)
        out.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return Forest(out, max(_expected(size), 1e-9))


def calibrated(good: np.ndarray, bad: np.ndarray, caution: float) -> float:
    """The threshold between scores; above every good score if there is no bad row."""
    if not len(bad):
        return float(good.max(initial=1.0)) + 1e-9
    g, b = np.sort(good), np.sort(bad)
    cut = np.unique(np.concatenate([g, b, [1.0]]))
    gain = (len(b) - np.searchsorted(b, cut, "right")) / len(b) - caution * (len(g) - np.searchsorted(g, cut, "right")) / max(len(g), 1)
    i = len(cut) - 1 - int(gain[::-1].argmax())
    return float(cut[i] + (cut[min(i + 1, len(cut) - 1)] - cut[i]) / 2)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20000, trees: int = 128, subsample: int = 1024, caution: float = 20.0, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """labels: id_col and label_col (1: good, 0: bad; others are not used). Without good rows the forest keeps all."""
    n = labels.where(F.col(label_col).isin(0, 1)).count()
    some = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 20)) < min(1.0, max_labelled / max(n, 1)) * (1 << 20)
    drawn = labels.where(F.col(label_col).isin(0, 1) & some).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "id")  # at most max_labelled short rows
    seen = rows.select("label", statistics_column(F.col("t")).alias("s")).select("label", "s.*").toPandas().sort_values(list(FIELDS), kind="stable")
    seen = seen[(seen["n_words"] >= 50) & (100 * seen["n_repeat_words"] <= 50 * seen["n_words"])]  # the others fail by rule
    x = features({f: seen[f].to_numpy() for f in FIELDS})
    is_good = seen["label"].to_numpy() == 1
    if not is_good.any():
        return Forest([], 1.0)
    forest = grow(x[is_good], x.min(axis=0), x.max(axis=0), trees, subsample, seed)
    scores = forest.scores(x)
    forest.threshold = calibrated(scores[is_good], scores[~is_good], caution)
    return forest


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, the statistics, base_failed, anomaly (0 to 1) and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows. kept: neither that nor
    an anomaly above the forest's threshold. A null or empty text has no words and fails. Only these two columns of
    docs are looked at; repeated rows get equal answers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(texts: list[bytes | None]) -> pa.Array:
        rows = np.array([statistics(t) for t in texts], np.int64).reshape(len(texts), len(FIELDS))
        columns = {f: rows[:, i] for i, f in enumerate(FIELDS)}
        score = shared.value.scores(features(columns)) if shared.value.trees and len(texts) else np.zeros(len(texts))
        return pa.StructArray.from_arrays([*(pa.array(rows[:, i]) for i in range(len(FIELDS))), pa.array(score)], [*FIELDS, "anomaly"])

    judged = docs.select(F.col(id_col).alias("doc_id"), over_texts(run, f"{STATISTICS}, anomaly double")(F.col(text_col)).alias("s"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = judged.select("doc_id", "s.*").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= forest.threshold))


def statistics_of(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the statistics, by row."""
    return docs.select(F.col(id_col).alias("doc_id"), statistics_column(F.col(text_col)).alias("s")).select("doc_id", "s.*")
