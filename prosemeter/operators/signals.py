"""Stylometric signals of a text as column expressions: no shuffle, no Python but for the compression ratio."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions.text import all_of, clamped, let, letters, long_words, sentences, spaced, words


def word_set(items: list[str]) -> Column:
    return F.array(*map(F.lit, items))


def not_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(lexicon.STOPWORDS))


def lengths(sents: Column) -> Column:
    """Words between white space in each sentence."""
    return F.transform(sents, lambda s: F.size(spaced(s)))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def mean_of(xs: Column) -> Column:
    return let(xs, lambda x: F.try_divide(_sum(x), F.size(x)))


def length_stats(sents: Column) -> tuple[Column, Column]:
    """Mean of sentence lengths in words and their coefficient of variation: sample deviation over mean, 0 below two."""

    def varied(n: Column) -> Column:
        def around(m: Column) -> Column:
            spread = F.sqrt(F.try_divide(_sum(F.transform(n, lambda x: (x - m) * (x - m))), F.size(n) - 1))
            return F.when(F.size(n) < 2, 0.0).otherwise(F.coalesce(F.try_divide(spread, m), F.lit(0.0)))

        return let(mean_of(n), around)

    return F.coalesce(mean_of(lengths(sents)), F.lit(0.0)), let(lengths(sents), varied)


def burstiness(sents: Column) -> Column:
    """0 to 100 by variation of sentence lengths; null below five sentences."""
    return F.when(F.size(sents) >= 5, let(length_stats(sents)[1] / 0.6 * 100, lambda x: clamped(x)))


def type_token_ratio(text: Column) -> Column:
    return let(words(text), lambda w: F.try_divide(F.size(F.array_distinct(w)), F.size(w)))


def content_words(text: Column) -> Column:
    """Distinct words that are no stop words and longer than a letter, in the order of their first place."""
    return F.array_distinct(F.filter(not_stopwords(words(text)), lambda w: F.length(w) > 1))


def coherence(sents: Column) -> Column:
    """Mean share of the smaller set of content words that neighbours have in common, times 200, within 0 to 100.

    Null without a pair of neighbours that both have content words.
    """

    def of(sets: Column) -> Column:
        pairs = F.zip_with(F.slice(sets, F.lit(1), F.size(sets) - 1), F.slice(sets, F.lit(2), F.size(sets) - 1), lambda a, b: F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b))))
        measured = F.filter(pairs, lambda x: x.isNotNull())
        return F.when(F.size(sets) >= 2, let(mean_of(measured), lambda m: clamped(m * 200)))

    return let(F.transform(sents, content_words), of)


def opener(sentence: Column) -> Column:
    """The first token, lowered, without quotes and punctuation around it."""
    return F.btrim(F.lower(F.get(spaced(sentence), F.lit(0))), F.lit("“”\"'(),.!?;:"))


def number_tokens(text: Column) -> Column:
    """Distinct numbers with an optional fraction and percent sign, without grouping commas, sorted."""
    return F.sort_array(F.array_distinct(F.transform(all_of(text, r"[0-9]+(?:[.,][0-9]+)?%?"), lambda n: F.regexp_replace(n, r"([0-9]),([0-9])", "$1$2"))))


def negations(text: Column) -> Column:
    """Tokens that negate, and tokens that end in n't."""
    tokens = all_of(F.lower(text), r"[\p{L}\p{N}_']+")
    return F.size(F.filter(tokens, lambda w: w.isin(lexicon.NEGATIONS) | w.endswith("n't")))


def mark_count(text: Column, marks: str = lexicon.MARKS) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def everyday_words(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(word): the distinct words of a corpus of human prose, and the stop words."""
    own = corpus.select(F.explode(letters(F.col(text_col))).alias("word"))
    return own.union(corpus.sparkSession.createDataFrame([(w,) for w in lexicon.STOPWORDS], "word string")).distinct()


def plain_register(docs: DataFrame, everyday: DataFrame) -> DataFrame:
    """(doc_id, plain): share of words that are everyday ones; 1 without words. Distinct words of a document are joined."""
    counted = tokens_of(docs, letters(F.col("text"))).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c"))
    joined = counted.join(everyday.withColumn("known", F.lit(True)), "word", "left")
    shares = joined.groupBy("doc_id").agg((F.sum(F.when(F.col("known"), F.col("c")).otherwise(0)) / F.sum("c")).alias("plain"))
    return docs.select("doc_id").join(shares, "doc_id", "left").select("doc_id", F.coalesce("plain", F.lit(1.0)).alias("plain"))


def _ratio(t: str | None) -> float | None:
    raw = re.sub(r"\s+", " ", t or "").strip().encode()
    return len(zlib.compress(raw)) / len(raw) if len(raw) >= 800 else None


def compression_ratio(text: Column) -> Column:
    """Compressed over plain bytes of the white-space-collapsed text; null below 800 bytes. Spark has no deflate."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_ratio).astype("float64")

    return F.pandas_udf(run, "double")(text)


def perplexity(ratio: Column) -> Column:
    return clamped((ratio - 0.30) / 0.30 * 100)


def surprisal_table(corpus: DataFrame, text_col: str = "text", common: int = 5000) -> DataFrame:
    """(word, n, surprisal, rank) of a corpus: -log2 of each word's share; rank 1 is the most frequent.

    Only the `common` most frequent words have a rank, so no task sees the whole vocabulary; it is null for the others.
    """
    from pyspark.sql import Window

    counts = corpus.select(F.explode(letters(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "word").limit(common).select("word", F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("rank"))
    told = counts.join(F.broadcast(total)).join(F.broadcast(top), "word", "left")  # one row, and `common` rows at most
    return told.select("word", "n", (-F.log2(F.col("n") / F.col("total"))).alias("surprisal"), "rank")


def tokens_of(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(tokens).alias("word"))


def content_tokens(text: Column) -> Column:
    """Runs of letters that are no stop words and longer than one, repeats kept."""
    return F.filter(not_stopwords(letters(text)), lambda w: F.length(w) > 1)


def word_choice(docs: DataFrame, table: DataFrame, common: int = 5000, unknown: float = 18.0) -> DataFrame:
    """(doc_id, n, rare_share, mean_surprisal, word_choice); null scores below 30 content tokens.

    Distinct words are counted by document first, so the join with the table is over fewer rows.
    """
    counted = tokens_of(docs, content_tokens(F.col("text"))).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("c"))
    joined = counted.join(table.select("word", "surprisal", "rank"), "word", "left")
    n = F.sum("c")
    rare = F.sum(F.when(F.coalesce(F.col("rank"), F.lit(common + 1)) > common, F.col("c")).otherwise(0)) / n
    mean = F.sum(F.col("c") * F.coalesce("surprisal", F.lit(unknown))) / n
    scored = joined.groupBy("doc_id").agg(n.alias("n"), rare.alias("rare_share"), mean.alias("mean_surprisal"))
    score = 0.55 * (152.0 - 300.0 * F.col("rare_share")) + 0.45 * (644.0 - 41.0 * F.col("mean_surprisal"))
    return scored.withColumn("word_choice", F.when(F.col("n") >= 30, clamped(score)))


def repeated(text: Column, sents: Column) -> Column:
    """Structs (n, word) of long words that stand four times and at least once a sentence; n is negative, ascending.

    In sorted order a word stands k times if it is its own (k - 1)th successor: one pass over a sorted array within
    the row, where grouping words by document would shuffle them all.
    """

    def of(s: Column, k: Column) -> Column:
        often = F.array_distinct(F.filter(F.transform(s, lambda w, i: F.when(F.get(s, i + k - 1) == w, w)), lambda w: w.isNotNull()))
        return F.sort_array(F.transform(often, lambda w: F.struct((-F.size(F.filter(s, lambda x: x == w))).alias("n"), w.alias("word"))))

    tokens = F.sort_array(not_stopwords(long_words(text)))
    return let(F.greatest(F.lit(4), F.size(sents)), lambda k: let(tokens, lambda s: of(s, k)))


def repetitions(docs: DataFrame) -> DataFrame:
    """(doc_id, word, n) of the repeated long words of docs."""
    rows = docs.select("doc_id", repeated(F.col("text"), sentences(F.col("text"))).alias("r"))
    return rows.select("doc_id", F.explode("r").alias("r")).select("doc_id", "r.word", (-F.col("r.n")).cast("long").alias("n"))
