"""Sentence labels, their smoothing by neighbours, and regions: all within the row, as arrays in sentence order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import let, sentences
from . import issues

NAMES = ("human", "mix", "ai")


def raw_weights(sents: Column, allowlist: list[str] | None = None, keep_structure: bool = False) -> Column:
    """By sentence: 0, 1 or 2, from its own distinct issues (high 2, medium 1, low 0)."""

    def of(s: Column, told: Column) -> Column:
        found = issues.distinct_issues(issues.weighty(s, allowlist, keep_structure, told))
        return F.least(F.lit(2), issues.penalty(found, 2, 1, 0))

    told = F.lower(F.array_join(sents, " ")).rlike(lexicon.ANY_TELL)
    return let(told, lambda t: F.transform(sents, lambda s: of(s, t)))


def smoothed(weights: Column) -> Column:
    """Six tenths of a sentence's own weight and two of each neighbour's; an edge has itself for a neighbour."""

    def all_of(ws: Column) -> Column:
        def of(w: Column, i: Column) -> Column:
            s = 6 * w + 2 * F.coalesce(F.get(ws, i - 1), w) + 2 * F.coalesce(F.get(ws, i + 1), w)
            return F.when(s >= 14, 2).when(s >= 6, 1).otherwise(0)

        return F.when(F.size(ws) < 2, ws).otherwise(F.transform(ws, of))

    return let(weights, all_of)


def regions(weights: Column, least: int = 2) -> Column:
    """Structs (start, end, count) of runs of at least `least` sentences of weight 2; zero-based, ends inclusive."""

    def between(ends: Column) -> Column:
        starts = F.concat(F.array(F.lit(-1)), F.slice(ends, F.lit(1), F.size(ends) - 1))
        runs = F.zip_with(starts, ends, lambda a, b: F.struct((a + 1).alias("start"), (b - 1).alias("end"), (b - a - 1).alias("count")))
        return F.filter(runs, lambda r: r["count"] >= least)

    return let(weights, lambda w: let(F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.coalesce(F.get(w, i), F.lit(0)) != 2), between))


def labelled(docs: DataFrame, allowlist: list[str] | None = None, keep_structure: bool = False) -> DataFrame:
    """(doc_id, sents, raw, weights): sentences with their weights before and after smoothing."""
    base = docs.select("doc_id", sentences(F.col("text")).alias("sents"))
    raw = base.withColumn("raw", raw_weights(F.col("sents"), allowlist, keep_structure))
    return raw.withColumn("weights", smoothed(F.col("raw")))


def named(weight: Column) -> Column:
    return F.get(F.array(*map(F.lit, NAMES)), weight)


def distribution(weights: Column, value: int) -> Column:
    """Whole percent of sentences of a weight; 0 without sentences."""
    share = let(weights, lambda ws: F.try_divide(F.size(F.filter(ws, lambda w: w == value)) * 100.0, F.size(ws)))
    return F.coalesce(F.bround(share), F.lit(0)).cast("int")
