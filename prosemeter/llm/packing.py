"""Best-fit packing of documents into bins of fixed capacity, with conflicts.

Method. Pieces are placed from the largest to the smallest. Open bins are kept in the order of their residual room;
each carries a bitmap of the sources and one of the duplicate clusters that it holds. For a piece, the search starts
at the bin with the least room that fits and goes on to its successors until one is compatible, that is, holds
neither the piece's source nor its cluster: the tightest compatible bin. Without one, a bin is opened.

Pieces are dealt by a hash of their id into shards of about `shard_rows` rows, however sources and clusters are
spread, and each shard is packed on its own; so a hot source or a large cluster never meets in one task, and at most
one bin in a shard's few hundred is left loosely filled by the cut between shards. A text longer than a bin is cut into
pieces; full ones have a bin of their own.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """Bin number and offset of each item (size, source mask, cluster mask), in the given order.

    A mask has one bit, or none for what never conflicts.
    """
    open_: list[tuple[int, int]] = []  # (room, bin)
    masks: list[list[int]] = []
    out = []
    for size, source, cluster in items:
        at = bisect_left(open_, (size, -1))
        while at < len(open_):
            held = masks[open_[at][1]]
            if not (held[0] & source or held[1] & cluster):
                break
            at += 1
        if at < len(open_):
            room, number = open_.pop(at)
        else:
            room, number = capacity, len(masks)
            masks.append([0, 0])
        masks[number][0] |= source
        masks[number][1] |= cluster
        out.append((number, capacity - room))
        if room > size or not size:
            insort(open_, (room - size, number))
    return out


def _bits(values: list) -> list[int]:
    """A mask for each value: one bit for each value that stands more than once, none for the others and null."""
    times: dict = {}
    for v in values:
        times[v] = times.get(v, 0) + 1
    bit = {v: 1 << i for i, v in enumerate(v for v, n in times.items() if n > 1 and v is not None)}
    return [bit.get(v, 0) for v in values]


def _packed(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("size", "doc_id", "piece", "source", "cluster", "shard")), strict=True), key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
        masks = zip(_bits([r[3] for r in rows]), _bits([r[4] for r in rows]), strict=True)
        placed = best_fit([(r[0], s, c) for r, (s, c) in zip(rows, masks, strict=True)], capacity)
        return pa.table({
            "doc_id": pa.array([r[1] for r in rows], pa.int64()),
            "piece": pa.array([r[2] for r in rows], pa.int64()),
            "size": pa.array([r[0] for r in rows], pa.int64()),
            "shard": pa.array([r[5] for r in rows], pa.int64()),
            "bin": pa.array([b for b, _ in placed], pa.int64()),
            "offset": pa.array([o for _, o in placed], pa.int64()),
        })

    return run


def pack(docs: DataFrame, size: Column, capacity: int = 2048, shard_rows: int = 4096, cluster: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row (doc_id, piece, size, shard, bin, offset) for each piece of each row of docs.

    Bins are numbered within shards. size: a column; null counts as 0, and a row of size 0 is one piece of size 0.
    cluster: rows of equal cluster never share a bin; by default, rows of equal text. A null source or cluster
    conflicts with nothing. Repeated rows are packed as often as they stand. An empty table gives an empty result.
    """
    cluster = F.xxhash64(text_col) if cluster is None else cluster
    cluster = F.when(F.col(text_col).isNotNull(), cluster)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), cluster.alias("cluster"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / capacity), F.lit(1)) - 1)))
    pieces = materialise(pieces.withColumn("size", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity)), "pieces")
    shards = max(1, -(-pieces.count() // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_packed(capacity), "doc_id long, piece long, size long, shard long, bin long, offset long")
