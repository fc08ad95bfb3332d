"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is seen as its lower-cased letters; each run of other characters is one space. The model of a language gives
the probability of a character after the `order` - 1 before it. All languages' models share one set of tables: for
each order the hashes of the n-grams seen in any language, sorted, and beside them the interpolated log probability
in every language; likewise the hashes of contexts with their interpolation weights. An n-gram is looked up from the
highest order downwards by binary search; the language of the lowest mean cross-entropy per character is chosen.
A text is rejected if that cross-entropy is farther above the language's mean than calibration texts, kept out of the
counts, show for texts of its length: the lengths are cut into classes by powers of two, and what all languages' texts
of a class or a longer one show as a high quantile, with some slack, is the limit. A quantile of the entropy itself, not
the worst text, so that one odd calibration text does not let other languages pass.

The models are fitted on a bounded sample: about `docs_per_language` labelled rows of each language, drawn by a hash
of their id. N-grams of the sample are counted on the executors; only their distinct counts, bounded by the sample,
come to the driver. The tables are broadcast; their size is bounded by the sample too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, over_texts

_STEP = 0x9E3779B97F4A7C15 | 1
_PAD = "\x01"
_LETTER: list[np.ndarray] = []

#: Text at once while scoring; the arrays over its characters take some 100 bytes for each.
_SCORED_BYTES = 1 << 18


def _letters() -> np.ndarray:
    """By code point: whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def symbols(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts one after another, each after order - 1 pads; each text's first symbol after its pads; end.

    A symbol is a letter's code point, or 0 for a run of anything else; pads are 0. A text without a letter has none.
    """
    told = [("" if raw is None else raw.decode("utf-8", "replace")).lower().replace(_PAD, " ") for raw in texts]
    pad = _PAD * (order - 1)
    points = np.frombuffer("".join(f"{pad}{t} " for t in told).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(told)), np.fromiter((len(t) + order for t in told), np.int64, len(told)))
    letter = _letters()[points]
    before = np.empty_like(letter)
    before[:1] = False
    before[1:] = letter[:-1]
    kept = letter | before | (points == ord(_PAD))
    out, owner = np.where(letter, points, 0)[kept], owner[kept]
    ends = np.searchsorted(owner, np.arange(len(told)), "right")
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) + order - 1 if len(told) else np.empty(0, np.int64)
    return out, starts, ends


def keys(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 0 to order: by position, the hash of the n symbols that end there."""
    out, power = [np.zeros(len(codes), np.uint64)], np.uint64(1)
    wide = codes.astype(np.uint64) + np.uint64(1)
    for n in range(order):
        shifted = np.zeros_like(wide)
        shifted[n:] = wide[: len(wide) - n]
        out.append(out[-1] + shifted * power)
        power = np.uint64(int(power) * _STEP % 2**64)
    return out


def key(gram: str) -> int:
    """keys() for one n-gram."""
    total, power = 0, 1
    for c in reversed(gram):
        total, power = (total + (ord(c) + 1) * power) % 2**64, power * _STEP % 2**64
    return total


@dataclass
class Model:
    """grams[n]: hashes of n-grams and log probabilities by language; contexts[n]: of n-symbol contexts, log weights."""

    languages: list[str]
    order: int
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    #: By language: mean cross-entropy of calibration texts; by length class: how far above it is too far.
    means: np.ndarray
    limits: np.ndarray

    def _find(self, table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table[0], wanted)
        at[at == len(table[0])] = 0
        return at, table[0][at] == wanted

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """By position and language, of each symbol after those before it."""
        hashes = keys(codes, self.order)
        total = np.zeros((len(codes), len(self.languages)), np.float32)
        left = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            at, seen = self._find(self.grams[n], hashes[n][left])
            total[left[seen]] += self.grams[n][1][at[seen]]
            left = left[~seen]
            if not len(left):
                return total
            if n > 1:
                context = np.where(left > 0, hashes[n - 1][left - 1], 0)
                at, seen = self._find(self.contexts[n - 1], context)
                total[left[seen]] += self.contexts[n - 1][1][at[seen]]
        total[left] += self.contexts[0][1][0] + self.floor
        return total

    def entropies(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of each text, and its mean cross-entropy in nats by language."""
        codes, starts, ends = symbols(texts, self.order)
        n = ends - starts
        sums = np.zeros((len(texts), len(self.languages)))
        if len(codes):
            each = np.concatenate([self.log_probabilities(codes), np.zeros((1, len(self.languages)), np.float32)])
            sums = np.add.reduceat(each, np.stack([starts, ends], 1).ravel(), axis=0, dtype=np.float64)[::2]
        return n, -sums / np.maximum(n, 1)[:, None]


#: Classes of lengths: the last holds all texts of 2 ** (LENGTHS - 1) symbols or more.
LENGTHS = 13


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), LENGTHS - 1)


def limits(n: np.ndarray, excess: np.ndarray, tail: float, slack: float, room: float) -> np.ndarray:
    """By length class: slack times the tail quantile of the excess, and room; never lower than of a longer class.

    A class of few texts takes those of its neighbours in, until it has 50, or all there are.
    """
    classes = length_class(n)
    out = np.full(LENGTHS, np.inf)
    if len(n):
        for c in range(LENGTHS):
            reach = 0
            while (near := np.abs(classes - c) <= reach).sum() < min(50, len(n)):
                reach += 1
            out[c] = max(0.0, float(np.quantile(excess[near], tail))) * slack + room
    return np.maximum.accumulate(out[::-1])[::-1]


def _gram_counts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                langs = np.array(batch.column(0).to_pylist(), object)
                texts = batch.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    codes, starts, ends = symbols([t for t, x in zip(texts, langs, strict=True) if x == lang], order)
                    scored = np.concatenate([np.empty(0, np.int64), *(np.arange(a, b) for a, b in zip(starts, ends, strict=True))])
                    _, first, count = np.unique(keys(codes, order)[order][scored], return_index=True, return_counts=True)
                    grams = ["".join(map(chr, codes[i - order + 1 : i + 1])) for i in scored[first]]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(count, pa.int64())], ["lang", "gram", "n"])

    return run


def _table(entries: dict[str, np.ndarray], languages: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = np.fromiter(map(key, entries), np.uint64, len(entries))
    values = np.array(list(entries.values()), np.float32).reshape(len(entries), languages)
    by = np.argsort(hashes)
    return (hashes[by], values[by]) if len(by) else (np.zeros(1, np.uint64), np.zeros((1, languages), np.float32))


def kneser_ney(counts: dict[str, dict[str, int]], order: int) -> Model:
    """The model from counts of n-grams of the highest order, by language."""
    languages = sorted(counts)
    width = len(languages)
    level: list[list[dict[str, int]]] = [[] for _ in range(order + 1)]
    level[order] = [dict(counts[x]) for x in languages]
    for n in range(order - 1, 0, -1):
        level[n] = [dict(Counter(g[1:] for g in higher)) for higher in level[n + 1]]
    vocabulary = len({g for x in level[1] for g in x}) + 1
    floor = float(np.log(1 / vocabulary))
    lower: dict[str, np.ndarray] = {}
    below = np.full(width, 1 / vocabulary)
    grams, contexts = [(np.zeros(1, np.uint64), np.zeros((1, width), np.float32))], []
    for n in range(1, order + 1):
        union = sorted({g for x in level[n] for g in x})
        total: dict[str, np.ndarray] = {}
        kinds: dict[str, np.ndarray] = {}
        discount = np.empty(width)
        for i, own in enumerate(level[n]):
            once, twice = (sum(v == k for v in own.values()) for k in (1, 2))
            discount[i] = once / (once + 2 * twice) if once and twice else 0.5
            for g, v in own.items():
                total.setdefault(g[:-1], np.zeros(width))[i] += v
                kinds.setdefault(g[:-1], np.zeros(width))[i] += 1
        weight = {h: np.where(t > 0, discount * kinds[h] / np.maximum(t, 1), 1.0) for h, t in total.items()}
        now: dict[str, np.ndarray] = {}
        for g in union:
            h = g[:-1]
            own = np.array([x.get(g, 0) for x in level[n]], float)
            now[g] = np.maximum(own - discount, 0) * (own > 0) / np.maximum(total[h], 1) + weight[h] * (lower[g[1:]] if n > 1 else below)
        grams.append(_table({g: np.log(p) for g, p in now.items()}, width))
        contexts.append(_table({h: np.log(w) for h, w in weight.items()}, width))
        lower = now
    return Model(languages, order, grams, contexts, floor, np.zeros(width), np.full(LENGTHS, np.inf))


def labelled(docs: DataFrame, docs_per_language: int, max_languages: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, raw, part) of the sample, of the most frequent languages; part 0 is a quarter, for calibration."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    there = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages).collect()
    share = F.element_at(F.create_map(*[F.lit(x) for r in there for x in (r.lang, min(1.0, docs_per_language / r.n))]), F.col(lang_col)) if there else F.lit(0.0)
    dealt = F.xxhash64(F.col(id_col).cast("string"))
    rows = rows.where(F.pmod(dealt, F.lit(1 << 20)) < F.coalesce(share, F.lit(0.0)) * (1 << 20))
    return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("raw"), F.pmod(F.shiftright(dealt, 20), F.lit(4)).alias("part"))


def fit(docs: DataFrame, order: int = 4, docs_per_language: int = 2000, max_languages: int = 200, tail: float = 0.999, slack: float = 1.5, room: float = 0.25, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The models of all languages of lang_col, on a sample of rows with a language and a text (see `labelled`).

    tail, slack, room: a text is rejected beyond `slack` times the `tail` quantile of the calibration texts' excess, in
    nats a character, and `room`, for its class of lengths (see `limits`).
    Without a usable row the model has no language and predicts `und` for all.
    """
    sample = labelled(docs, docs_per_language, max_languages, id_col, text_col, lang_col)
    counted = sample.where("part > 0").select("lang", "raw").mapInArrow(_gram_counts(order), "lang string, gram string, n long")
    counts: dict[str, dict[str, int]] = {}
    for r in counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r.lang, {})[r.gram] = r.n
    model = kneser_ney(counts, order)
    if model.languages:
        shared = sample.sparkSession.sparkContext.broadcast(model)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in blocks(whole, 1, _SCORED_BYTES):
                    n, h = shared.value.entropies(batch.column(1).to_pylist())
                    best = h.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(best, pa.int64()), pa.array(n, pa.int64()), pa.array(h.min(axis=1))], ["best", "n", "h"])

        seen = sample.where("part = 0").select("lang", "raw").mapInArrow(measured, "best long, n long, h double").where("n > 0").toPandas()
        everyone = seen["h"].mean() if len(seen) else 0.0
        for i in range(len(model.languages)):
            own = seen[seen["best"] == i]
            model.means[i] = own["h"].mean() if len(own) else everyone
        n, best, h = (seen[c].to_numpy() for c in ("n", "best", "h"))
        model.limits = limits(n, h - model.means[best], tail, slack, room)
    return model


def predict(text, model: Model, spark: SparkSession):
    """A column of struct lang, score, entropy, rejected for a column of texts.

    score is the language's share of the likelihoods of 32 characters, or of fewer if the text has fewer. A text that
    is null or has no letter has lang `und`, score 0, a null entropy, and is rejected. Of equally likely languages the
    first by name is told. A text of any length is read whole; repeated rows get equal answers; nothing but the text is
    looked at, so other columns cannot clash.
    """
    shared = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])

    def of(texts: list[bytes | None]) -> list[dict]:
        m = shared.value
        if not m.languages or not texts:
            return [{"lang": "und", "score": 0.0, "entropy": None, "rejected": True} for _ in texts]
        n, h = m.entropies(texts)
        best, least = h.argmin(axis=1), h.min(axis=1)
        score = 1 / np.exp(-(h - least[:, None]) * np.minimum(n, 32)[:, None]).sum(axis=1)
        lettered = n > 1
        rejected = ~lettered | (least - m.means[best] > m.limits[length_class(n)])
        return [{"lang": m.languages[b], "score": s, "entropy": e, "rejected": r} if ok else {"lang": "und", "score": 0.0, "entropy": None, "rejected": True} for b, s, e, r, ok in zip(best.tolist(), score.tolist(), least.tolist(), rejected.tolist(), lettered.tolist(), strict=True)]

    def run(texts: list[bytes | None]) -> pa.Array:
        sizes = list(accumulate(len(t or b"") for t in texts))
        out, start = [], 0
        while start < len(texts):
            held = sizes[start - 1] if start else 0
            end = start + 1
            while end < len(texts) and sizes[end] - held <= _SCORED_BYTES:
                end += 1
            out += of(texts[start:end])
            start = end
        return pa.array(out, kind)

    return over_texts(run, "lang string, score double, entropy double, rejected boolean")(text)
