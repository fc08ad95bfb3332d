"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Method. The mix shares `percent` of all words among sources by weight; a source's target stops at `most` times its
words, and the excess goes to the others by weight until none is above. Within a source the expected copies of a
document are its prior times a factor, `most` at the highest, so that the expected words are the target. The whole
copies are certain. What is left of an expectation is an inclusion probability p: documents are ranked by their random
odds u / (1 - u) over their inclusion odds p / (1 - p), and the first in that order are taken as long as their words
come nearer to what is left of the target. So the sample is of fixed size in words and of unequal probabilities.

u is a hash of the seed, the document's id and its text: rows of null or repeated ids have numbers of their own, and
reruns agree whatever the order and partitions of the rows. The cut in a source's order is found through bins of the
rank that are summed before they are ordered; only rows of the bin that holds the cut are then put into finer bins,
and rows of one finest bin are ordered. So no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bins of a rank at each level, and levels: a source's order is cut within BINS ** LEVELS bins.
BINS, LEVELS = 256, 2


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """sizes (a row for each source: source, source_size) with each source's weight and target.

    Sources in code point order, null last, get the weights in turn. A source reaches its limit at the level
    most * size / weight; below a level L a source gets L * weight. The level at which all add up to the wanted words
    lies after the first sources, in the order of their limits, for which the rest at the next limit would be too much.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("double"))
    ranked = ranked.withColumn("limit", F.lit(float(most)) * F.col("source_size")).withColumn("reached", F.col("limit") / F.col("weight"))
    everyone = Window.partitionBy()
    by_limit = Window.orderBy("reached", F.col("source").isNull(), F.col("source"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    wanted = F.sum("source_size").over(everyone) * (percent / 100)
    level = (wanted - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    found = ranked.withColumn("level", level).withColumn("turn", F.row_number().over(by_limit))
    first = F.min(F.when(F.col("level") <= F.col("reached"), F.struct("turn", "level"))).over(everyone)
    found = found.withColumn("level", first["level"])
    share = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return found.select("source", "source_size", "weight", share.alias("target"))


def uniform(id_col: Column, text: Column, seed: int) -> Column:
    """A number between 0 and 1, never either, from 52 bits of the MD5 of the seed, the id and the text's MD5."""
    own = F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("")), own).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def _key(source: Column) -> Column:
    """Null sources are one source of their own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def mixed(docs: DataFrame, size: Column, prior: Callable[[Column], Column] | None = None, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row (doc_id, size, source_size, target, copies, taken) for each row of docs, and the columns of carry.

    size: words of a row. prior: a column of relative expected copies, of a few distinct values, from the size; None:
    equal ones. taken is copies * size, at most `most` times the size. Rows of size 0, null and empty texts among them,
    get no copies. A null source is a source; a null id is an id like any other. Rows of equal id and text are ranked
    alike: as many of them are taken as the cut says, and which ones is all the same. Texts are hashed whole. An empty
    table gives an empty result. Other columns of docs, of whatever name, are not looked at. The targets are computed
    over one row for each source, in one task.
    """
    carry = carry or {}
    named = {k: f"carried{i}" for i, k in enumerate(carry)}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), uniform(F.col(id_col), F.col(text_col), seed).alias("u"), *[c.alias(named[k]) for k, c in carry.items()])
    rows = rows.withColumn("prior", (prior(F.col("size")) if prior else F.lit(1.0)).cast("double"))
    rows = materialise(rows.withColumn("key", _key(F.col("source"))), "mix-sizes")
    classes = rows.groupBy("source", "key", "prior").agg(F.sum("size").alias("words"))
    wanted = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, percent, most)
    wanted = wanted.select(_key(F.col("source")).alias("key"), "source_size", "target")

    # The factor of a source: over its priors from the largest, the first at which no smaller prior passes `most` too.
    classes = classes.drop("source").join(wanted, "key")
    down = Window.partitionBy("key").orderBy(F.desc("prior"))
    above, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - most * F.coalesce(F.sum("words").over(above), F.lit(0))
    factor = left / F.nullif(F.sum(F.col("words") * F.col("prior")).over(rest), F.lit(0.0))
    classes = classes.withColumn("factor", factor)
    fits = F.min(F.when(F.col("factor") * F.col("prior") <= most * (1 + 1e-12), F.struct(-F.col("prior"), F.col("factor").alias("factor")))).over(Window.partitionBy("key"))
    expected = F.least(F.lit(float(most)), F.coalesce(fits["factor"] * F.col("prior"), F.lit(float(most))))
    classes = classes.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-9))
    classes = classes.withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    certain = F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("key"))
    classes = classes.select("key", "prior", "source_size", "target", "whole", "p", (F.col("target") - certain).alias("left"))

    u = F.col("u")
    odds = F.when((F.col("p") > 1e-9) & (F.col("size") > 0), (u / (1 - u)) / (F.col("p") / (1 - F.col("p"))))
    ranked = rows.join(classes, ["key", "prior"]).withColumn("rank", odds / (1 + odds))  # the same order, from 0 to 1
    keep = ["doc_id", "size", "source_size", "target", "whole", "key", "left", "rank", *named.values()]
    ranked = materialise(ranked.select(*keep), "mix-ranks")

    # At each level: the words before each bin, and the bin that holds the cut. The last level's cut bin is ordered.
    cut = ranked.groupBy("key").agg(F.first("left").alias("need")).withColumns({"low": F.lit(0.0), "width": F.lit(1.0)})
    for _ in range(LEVELS):
        here = ranked.where("rank IS NOT NULL").join(cut, "key").where("rank >= low AND rank < low + width")
        binned = here.withColumn("bin", F.least(F.floor((F.col("rank") - F.col("low")) / F.col("width") * BINS), F.lit(BINS - 1)))
        summed = binned.groupBy("key", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("low").alias("low"), F.first("width").alias("width"))
        up_to = F.sum("words").over(Window.partitionBy("key").orderBy("bin"))
        crossing = summed.withColumn("upto", up_to).where("upto > need").groupBy("key").agg(F.min(F.struct("bin", "upto", "words", "need", "low", "width")).alias("c"))
        step = F.col("c.width") / BINS
        cut = crossing.select("key", (F.col("c.need") - (F.col("c.upto") - F.col("c.words"))).alias("need"), (F.col("c.low") + F.col("c.bin") * step).alias("low"), step.alias("width"))
        cut = materialise(cut, "mix-cut")
    # Without a cut, all of a source's words are fewer than needed: all are in.
    placed = ranked.join(cut.withColumnRenamed("need", "room"), "key", "left")
    last = placed.where("rank >= low AND rank < low + width")
    upto = F.sum("size").over(Window.partitionBy("key").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    last = last.withColumn("upto", upto).withColumn("in", F.col("upto") - F.col("size") / 2 <= F.col("room"))
    others = placed.where("rank IS NULL OR low IS NULL OR rank < low OR rank >= low + width").withColumn("upto", F.lit(0).cast("long"))
    others = others.withColumn("in", F.coalesce(F.col("rank").isNotNull() & (F.col("low").isNull() | (F.col("rank") < F.col("low"))), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("in").cast("long")).otherwise(F.lit(0)).cast("long")
    out = last.unionByName(others).withColumn("copies", copies)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(v).alias(k) for k, v in named.items()])
