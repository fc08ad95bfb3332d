"""Near-duplicate groups of documents: MinHash signatures in an LSH forest.

Method. A document's set is its distinct five-word shingles. Documents of equal sets form one class. Each class gets a
signature of minimum hashes; every tree of the forest sorts the classes by its own sequence of hashes out of it. A
region of a tree is a run of the sorted order whose members share the first hash. In a small region all pairs are
candidates. A larger region is read through a frame that slides over the sorted order: what is nearest there has the
longest common prefix, so the depth that is looked at adapts to how crowded the order is at each place; each member is
linked with the members of the frame before it whose signatures agree best. Candidates whose signatures agree in too
few places to come from the wanted similarity (over five standard errors away) are let go; the others are confirmed on
their full sets, for each class the best ones first, and then those that do not lie in one component by now.

What a frame leaves out of a large region is searched exactly: members of large regions are matched with members of
other components by their rarest shingles, of which similar sets share one (prefix filtering: of the smaller set the
2p / (1 + p) shortest prefix does, of the larger one that of p). So similar classes are missed only if they share the
first hash of no tree.

Candidates of small regions are all confirmed unless one component holds both by then; of a frame's, the best few for
each class, as all of them serve only to leave little to the search.

Nothing is collected but a fixed number of shingle counters: classes, regions, links and components are tables; regions
are counted by key with partial aggregation, hot keys are joined by broadcast of their bounded number, and sorted orders
are dealt by range, whatever a region holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, join_each, let_go, materialise, possibly_in

#: Minimum hashes of a class; trees of the forest; hashes of a tree's order; members of a small region; rows of a frame.
POOL, TREES, DEPTH, REGION, FRAME = 64, 16, 8, 32, 32

#: Links that one task contracts by itself.
UNITED = 100_000

#: Counters of shingles; their size does not grow with the input.
COUNTERS = 1 << 16

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _pool_keys(pool: int) -> tuple[np.ndarray, np.ndarray]:
    dealt = np.random.Generator(np.random.PCG64(20240229))
    x = dealt.integers(0, 2**64, pool, dtype=np.uint64)
    return x[:, None], (dealt.integers(0, 2**64, pool, dtype=np.uint64) | np.uint64(1))[:, None]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(raw: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; of a text of fewer words, the hash of all its words."""
    words = raw.lower().split() if raw else []  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for j in range(width):
        acc = acc * _MULTIPLIER + h[j : len(h) - width + 1 + j]
    return np.unique(_mixed(acc))


def signature(shingles: np.ndarray, x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The pool's minimum hashes as int32."""
    least = np.full(len(x), 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[None, i : i + 4096] ^ x) * a).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _lists(arrays: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, kind), *arrays])))


def _signed(pool: int, width: int):
    """Rows (doc_id, n_shingles, digest, sig, tally); the last row of a partition, of -1 shingles, has its counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, a = _pool_keys(pool)
        total, none = np.zeros(COUNTERS, np.int64), np.empty(0, np.int32)
        names = ["doc_id", "n_shingles", "digest", "sig", "tally"]
        for whole in batches:
            for batch in blocks(whole, 1):
                sets = [shingle_set(raw.as_py(), width) for raw in batch.column(1)]
                total += np.bincount((np.concatenate([np.empty(0, np.uint64), *sets]) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                sigs = _lists([signature(s, x, a) if len(s) else none for s in sets], np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(_digest, sets), pa.binary()), sigs, pa.nulls(len(sets), pa.binary())], names)
        let_go()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([None], pa.binary()), _lists([none], np.int32), pa.array([total.tobytes()], pa.binary())], names)

    return run


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for held in batch.column(0):
            total += np.frombuffer(held.as_py(), np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["counter", "n"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                sets = [shingle_set(raw.as_py(), width) for raw in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, sets), pa.binary()), _lists([s.view(np.int64) for s in sets], np.int64)], ["doc_id", "digest", "shingles"])
        let_go()

    return run


def _prefixes(counts, percent: int, width: int):
    """Rows (doc_id, digest, size, prefix): the rarest shingles of a set, of which a similar set has one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, 1):
                sets = [shingle_set(raw.as_py(), width) for raw in batch.column(1)]
                rare = []
                for own in sets:
                    by = np.lexsort((own, counts.value[(own % np.uint64(COUNTERS)).astype(np.int64)]))
                    rare.append(own[by[: len(own) + 1 - -(-percent * len(own) // 100)]].view(np.int64) if len(own) else own.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, sets), pa.binary()), pa.array(map(len, sets), pa.int32()), _lists(rare, np.int64)], ["doc_id", "digest", "size", "prefix"])
        let_go()

    return run


def least_agreeing(similarity: float, pool: int) -> int:
    """Places of two signatures that agree, five standard errors below what the similarity lets expect."""
    return math.floor(pool * (similarity - 5 * math.sqrt(similarity * (1 - similarity) / pool)))


def _neighbours(frame: int, best: int | None, percent: int, trees: int, pool: int):
    """Pairs (lo, hi, same) out of the sorted order of a forest's rows: each row with those up to `frame` before it in its region.

    same: places that agree, by their lowest bytes. best: so many for each row, those that agree most; None: all, each
    pair only in the first tree in which it shares a region.
    """
    least = least_agreeing(percent / 100, pool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            tree, key, cls, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            packed = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, 4 * trees + pool)
            rows = [tree, key, cls, n, packed]
            seen = 0 if held is None else len(held[0])
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
            held = [r[-frame:] for r in rows]
            tree, key, cls, n, packed = rows
            low, heads = packed[:, 4 * trees :], np.ascontiguousarray(packed[:, : 4 * trees]).view(np.int32)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for k in range(1, min(frame, len(cls) - 1) + 1):
                at = np.flatnonzero((key[k:] == key[:-k]) & (tree[k:] == tree[:-k])) + k
                at = at[at >= seen]
                if not len(at):
                    break  # a region is a run: who has none k before has none farther away
                at = at[100 * np.minimum(n[at], n[at - k]) >= percent * np.maximum(n[at], n[at - k])]
                for part in np.array_split(at, len(at) // 65536 + 1):
                    same = (low[part] == low[part - k]).sum(axis=1)
                    near = part[same >= least]
                    found.append((near, near - k, same[same >= least]))
            i, j, same = (np.concatenate([np.empty(0, np.int64), *(f[c] for f in found)]) for c in range(3))
            if best is None:
                first = (heads[i] == heads[j]).argmax(axis=1) == tree[i]
                i, j, same = i[first], j[first], same[first]
            elif len(i):
                by = np.lexsort((-same, i))
                i, j, same = i[by], j[by], same[by]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, same = i[rank < best], j[rank < best], same[rank < best]
            a, b = cls[i], cls[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(same.astype(np.int32))], ["lo", "hi", "same"])
        let_go()

    return run


def _united(frames):
    """Links of one partition, contracted: each member with the smallest member that these links reach."""
    import pandas as pd

    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for frame in frames:
        for a, b in zip(frame["lo"].tolist(), frame["hi"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                root.setdefault(min(a, b), min(a, b))
    found = [(find(x), x) for x in list(root)]
    yield pd.DataFrame([x for x in found if x[0] != x[1]], columns=["lo", "hi"], dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(hi, lo) for each node `hi` of links(lo, hi) that is not the smallest of its component `lo`.

    Links are first contracted within tasks of about UNITED each. Then every node joins its neighbours to its smallest
    neighbour, again and again, until only stars are left.
    """
    links = links.select("lo", "hi")
    parts = 1 + links.count() // UNITED
    edges = materialise(links.repartition(parts).mapInPandas(_united, "lo long, hi long"), "edges")
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")), F.sum("lo"))
    before = edges.select(mark.alias("m")).first().m
    while before[0]:
        both = edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")).union(edges.select("hi", "lo"))
        least = both.groupBy("x").agg(F.min("y").alias("l"), F.count(F.lit(1)).alias("degree")).withColumn("l", F.least("x", "l"))
        met = join_each(both, least, ["x"], "degree", 2 * before[0])
        pairs = met.select("l", "y").union(least.select("l", "x"))
        pairs = pairs.select(F.least("l", "y").alias("lo"), F.greatest("l", "y").alias("hi")).where("lo <> hi").distinct()
        edges, old = materialise(pairs, "edges"), edges
        discard(old)
        after = edges.select(mark.alias("m")).first().m
        if after == before:
            break
        before = after
    return edges


def _agreeing(pairs: DataFrame, classes: DataFrame, percent: int, pool: int) -> DataFrame:
    """Pairs (lo, hi) whose signatures can come from the wanted similarity, with set sizes that allow it."""
    a = classes.select(F.col("cls").alias("lo"), F.col("sig").alias("sa"), F.col("n_shingles").alias("na"))
    b = classes.select(F.col("cls").alias("hi"), F.col("sig").alias("sb"), F.col("n_shingles").alias("nb"))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda p, q: p == q), lambda e: e))
    near = pairs.join(a, "lo").join(b, "hi").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return near.where(same >= least_agreeing(percent / 100, pool)).select("lo", "hi")


def _best(pairs: DataFrame, n: int, before: bool = False) -> DataFrame:
    """Of pairs (lo, hi, same), those that agree best with either of their classes, n for each; before: only with hi."""
    ends = [("hi", "lo")] if before else [("hi", "lo"), ("lo", "hi")]
    each = pairs.select(F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ends])).alias("e"), "same")
    by = F.struct("same", F.xxhash64("e.x", "e.y").alias("h"), F.col("e.y").alias("y"))
    # What a class has is bounded: in each tree by its region or its frame.
    top = each.groupBy(F.col("e.x").alias("x")).agg(F.slice(F.sort_array(F.collect_list(by), asc=False), 1, n).alias("t"))
    top = top.select("x", F.explode("t.y").alias("y"))
    return top.select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct()


def _of_classes(docs: DataFrame, classes: DataFrame, some: DataFrame, run, returns: str) -> DataFrame:
    """`some` (cls and more) with what `run` makes of the text of each class; texts themselves are not shuffled.

    A class is named by its smallest id and its digest: rows of one id can have different texts.
    """
    ids = materialise(classes.select("cls", "doc_id", "digest").join(some, "cls"), "ids")
    made = possibly_in(docs, ids.select("doc_id"), "doc_id").mapInArrow(run, f"doc_id long, digest binary, {returns}")
    return made.join(ids, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).drop("doc_id", "digest")


def _rest(crowded: DataFrame, joined: DataFrame, docs: DataFrame, classes: DataFrame, counts: np.ndarray, percent: int, width: int) -> DataFrame:
    """Pairs (lo, hi) of different components within large regions that can be similar by their rarest shingles.

    Of the components that meet in a region the members of all but the largest ask; size is counted over all regions,
    so that the largest never asks. What follows a shared shingle in either order bounds the intersection from above.
    crowded: (key, cls); counts: of shingles, by counter, only for the order.
    """
    inside = crowded.join(joined.withColumnRenamed("hi", "cls"), "cls", "left").select("key", "cls", F.coalesce("lo", "cls").alias("comp"))
    inside = materialise(inside, "inside")
    wide = inside.groupBy("comp").agg(F.count(F.lit(1)).alias("c"))
    per = inside.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("rows")).join(wide, "comp")
    main = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("m.comp").alias("main"), "rows")
    mixed = join_each(inside, main, ["key"], "rows", inside.count()).groupBy("cls").agg(F.max("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("aside"))
    mixed = materialise(mixed, "mixed")
    discard(inside)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    rows = materialise(_of_classes(docs, classes, mixed, _prefixes(shared, percent, width), "size int, prefix array<long>"), "prefixes")
    discard(mixed)
    every = rows.select("cls", "comp", "aside", "size", F.posexplode("prefix").alias("at", "shingle"))
    shorter = F.col("at") <= F.col("size") - F.ceil(F.lit(2 * percent) * F.col("size") / (100 + percent) - 1e-9)
    named = lambda df, k: df.select("shingle", *[F.col(c).alias(f"{c}{k}") for c in ("cls", "comp", "size", "at")])
    ordered = (F.col("size1") < F.col("size2")) | ((F.col("size1") == F.col("size2")) & (F.col("cls1") < F.col("cls2")))
    most = F.least(F.col("size1") - F.col("at1"), F.col("size2") - F.col("at2"))
    able = (100 + percent) * most >= percent * (F.col("size1") + F.col("size2"))
    met = None
    for left, right in ((every.where(shorter), every.where("aside")), (every.where(shorter).where("aside"), every.where("NOT aside"))):
        here = named(left, 1).join(named(right, 2), "shingle").where((F.col("comp1") != F.col("comp2")) & ordered & able)
        here = here.select(F.least("cls1", "cls2").alias("lo"), F.greatest("cls1", "cls2").alias("hi"))
        met = here if met is None else met.union(here)
    return met.distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (lo, hi) with 100 * intersection >= percent * union on full sets. pairs is materialised."""
    some = pairs.select(F.col("lo").alias("cls")).union(pairs.select("hi")).distinct()
    sets = materialise(_of_classes(docs, classes, some, _sets(width), "shingles array<long>"), "sets")
    met = pairs.join(sets.select(F.col("cls").alias("lo"), F.col("shingles").alias("ta")), "lo")
    met = met.join(sets.select(F.col("cls").alias("hi"), F.col("shingles").alias("tb")), "hi")
    common = F.size(F.array_intersect("ta", "tb"))
    met = met.select("lo", "hi", common.alias("i"), (F.size("ta") + F.size("tb")).alias("n"))
    out = materialise(met.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("lo", "hi"), "links")
    discard(sets)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, pool: int = POOL, trees: int = TREES, depth: int = DEPTH, region: int = REGION, frame: int = FRAME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) for each row of docs.

    Links documents whose sets have 100 * intersection >= percent * union; component_id is the smallest id that links
    reach, kept says that it is the row's own. A null or empty text, or one of white space, has an empty set, is linked
    with nothing and kept. A row of null id is linked with nothing: its component is null and it is kept. Ids name
    documents: rows of one id are in one component, with what any of their texts is linked with, and repeated rows get
    equal answers. Texts of any length are read whole. An empty table gives an empty result. Other columns of docs, of
    whatever name, are not looked at.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    signed = materialise(docs.mapInArrow(_signed(pool, width), "doc_id long, n_shingles long, digest binary, sig array<int>, tally binary"), "signed")
    counts = np.zeros(COUNTERS, np.int64)
    for r in signed.where("n_shingles < 0").select("tally").mapInArrow(_tallied, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.counter] = r.n  # one row for each counter at most
    usable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()

    # A tree's order starts at hash 4 * tree of the signature; its first hash is the first key.
    first = classes.select("cls", F.posexplode(F.array(*[F.get("sig", F.lit(4 * t % pool)) for t in range(trees)])).alias("tree", "head")).select("cls", "tree", F.xxhash64("tree", "head").alias("key"))
    shared = materialise(first.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("rows", F.col("c")), "shared")
    met = join_each(first, shared, ["key"], "rows", trees * n_classes)
    order = F.slice(F.concat("sig", "sig"), F.pmod(4 * F.col("tree"), F.lit(pool)) + 1, F.lit(depth))
    hexed = lambda i, digits: F.lpad(F.right(F.hex(i), F.lit(digits)), digits, "0")
    heads = F.array(*[F.get("sig", F.lit(4 * t % pool)) for t in range(trees)])
    packed = F.unhex(F.concat(F.array_join(F.transform(heads, lambda i: hexed(i, 8)), ""), F.array_join(F.transform("sig", lambda i: hexed(i, 2)), "")))
    own = classes.select("cls", F.col("n_shingles").cast("int").alias("n"), "sig", packed.alias("packed"))
    forest = materialise(met.join(own, "cls").select("tree", "key", "cls", "n", "packed", "c", F.when(F.col("c") > region, order).alias("order")), "forest")
    discard(shared)
    small = forest.where(F.col("c") <= region).select("tree", "key", "cls", "n", "packed").repartition("key").sortWithinPartitions("tree", "key", "cls")
    pairs = small.mapInArrow(_neighbours(region, None, percent, trees, pool), "lo long, hi long, same int")
    large = forest.where(F.col("c") > region).repartitionByRange("tree", "order", "cls").sortWithinPartitions("tree", "order", "cls").select("tree", "key", "cls", "n", "packed")
    framed = large.mapInArrow(_neighbours(frame, 3, percent, trees, pool), "lo long, hi long, same int")
    pairs = pairs.withColumn("whole", F.lit(True)).union(framed.withColumn("whole", F.lit(False)))
    pairs = materialise(pairs.groupBy("lo", "hi").agg(F.max("same").alias("same"), F.max("whole").alias("whole")), "pairs")

    doubled = usable.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("a"), F.max(F.xxhash64("digest")).alias("b")).where("a <> b").select("doc_id")
    doubled = usable.select("doc_id", "digest").join(doubled, "doc_id").distinct().join(classes.select("digest", "cls"), "digest")
    links = materialise(doubled.join(doubled.groupBy("doc_id").agg(F.min("cls").alias("lo")), "doc_id").select("lo", F.col("cls").alias("hi")).where("lo < hi"), "doubled")
    joined, done = links, None

    def top(c: str) -> DataFrame:
        return joined.select(F.col("hi").alias(c), F.col("lo").alias(f"{c}_top"))

    # First what agrees best with each class, then what is not in one component by now, then the search over large regions.
    for turn in ("nearest", "others", "rest"):
        if turn == "nearest":
            asked = _best(pairs, 1).union(_best(pairs, 1, before=True)).distinct()
        elif turn == "others":
            apart = pairs.join(top("lo"), "lo", "left").join(top("hi"), "hi", "left").where(F.coalesce("lo_top", "lo") != F.coalesce("hi_top", "hi"))
            apart = apart.select(*pairs.columns).join(done, ["lo", "hi"], "left_anti")
            asked = apart.where("whole").select("lo", "hi").union(_best(apart.where("NOT whole"), 3)).distinct()
        else:
            crowded = forest.where(F.col("c") > region).select("key", "cls")
            asked = _agreeing(_rest(crowded, joined, docs, classes, counts, percent, width), classes, percent, pool).join(done, ["lo", "hi"], "left_anti")
        asked = materialise(asked, "asked")
        more = _confirmed(asked, docs, classes, percent, width)
        links, done = materialise(links.union(more), "links"), asked if done is None else materialise(done.union(asked), "asked")
        joined = components(links)
    discard(forest, pairs, links, done)

    # Components are named by their smallest id; then each row by its class.
    members = classes.select("cls", "doc_id", "digest", "copies").join(joined.select(F.col("hi").alias("cls"), "lo"), "cls", "left").withColumn("top", F.coalesce("lo", "cls"))
    members = materialise(members.select("top", "doc_id", "digest", "copies"), "members")
    ids = members.groupBy("top").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = materialise(join_each(members, ids, ["top"], "rows", n_classes).select("digest", "component_id", "copies"), "named")
    discard(members)
    some = usable.select("doc_id", "n_shingles", "digest")
    out = join_each(some, named, ["digest"], "copies", signed.count()).drop("digest")
    alone = signed.where("n_shingles = 0 OR (n_shingles > 0 AND doc_id IS NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
