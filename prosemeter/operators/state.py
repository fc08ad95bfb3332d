"""State: history, fingerprints, quotas and rate windows as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon

HISTORY_CAP, TEXT_CAP = 100, 20_000


def fingerprint(text: Column) -> Column:
    """SHA-256 of the lowered text with white space collapsed."""
    flat = F.regexp_replace(F.lower(F.btrim(text, F.lit(" \t\r\n"))), r"[ \t\r\n]+", " ")
    return F.sha2(flat.cast("binary"), 256)


def newest(history: DataFrame, k: int = HISTORY_CAP) -> DataFrame:
    """The newest k entries, ties by id downwards."""
    return history.orderBy(F.desc("ts"), F.desc("id")).limit(k)


def appended(history: DataFrame, entries: DataFrame) -> DataFrame:
    """The history and further entries, whose outputs are kept up to TEXT_CAP characters; written as an append."""
    return history.unionByName(entries.withColumn("output", F.left("output", F.lit(TEXT_CAP))))


def cleared(history: DataFrame) -> DataFrame:
    return history.limit(0)


def public(history: DataFrame) -> DataFrame:
    """What others may see of an entry."""
    return history.select("id", "ts", "style", "score")


def without(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids, "id", "left_anti")


def generated(docs: DataFrame, history: DataFrame) -> DataFrame:
    """(doc_id, entry): the newest history entry whose output is the document's text but for case and white space."""
    first = history.groupBy("output_key").agg(F.max_by("id", F.struct("ts", "id")).alias("entry"))
    return docs.select("doc_id", fingerprint(F.col("text")).alias("output_key")).join(first, "output_key").select("doc_id", "entry")


def usage_by_day(requests: DataFrame) -> DataFrame:
    """(key, usage_date, words) from key, ts, words."""
    return requests.groupBy("key", F.to_date("ts").alias("usage_date")).agg(F.sum("words").alias("words"))


def quota(usage: DataFrame, requested: int, limit: int = 1000) -> DataFrame:
    return usage.withColumn("allowed", F.col("words") + requested <= limit)


def hits_in_window(events: DataFrame, key: str, seconds: int, budget: int) -> DataFrame:
    """Hits of the last `seconds` up to each event, and whether they are within the budget, counting denied ones too."""
    w = Window.partitionBy(key).orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("hits", F.count(F.lit(1)).over(w)).withColumn("within", F.col("hits") <= budget)


def rate_limited(events: DataFrame, key: str, seconds: int, budget: int) -> DataFrame:
    """(key, event_id, allowed), exactly: denied hits leave no trace in the window.

    A recurrence over one key's events in order, so a task keeps at most `budget` times of one key at once; events of
    a key come sorted and are read as they stream by.
    """
    from collections import deque
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = object(), deque()
        for batch in batches:
            keys, ids, at = (batch.column(i).to_pylist() for i in range(3))
            allowed = []
            for k, t in zip(keys, at, strict=True):
                if k != current:
                    current, held = k, deque()
                while held and held[0] <= t - seconds:
                    held.popleft()
                ok = len(held) < budget
                allowed.append(ok)
                if ok:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed)], [key, "event_id", "allowed"])

    rows = events.select(key, "event_id", F.col("ts").cast("timestamp").cast("double").alias("at")).repartition(key).sortWithinPartitions(key, "at", "event_id")
    kind = dict(events.dtypes)[key]
    return rows.select(key, "event_id", "at").mapInArrow(run, f"{key} {kind}, event_id long, allowed boolean")


def plan_allows(requests: DataFrame, spark) -> DataFrame:
    """requests(plan, words_today, requested, deep) with whether the plan allows them."""
    plans = spark.createDataFrame(lexicon.PLANS, "plan string, words_a_day int, deep_ok boolean")
    joined = requests.join(F.broadcast(plans), "plan")
    fits = F.col("words_a_day").isNull() | (F.col("words_today") + F.col("requested") <= F.col("words_a_day"))
    return joined.withColumn("allowed", fits & (F.col("deep_ok") | ~F.col("deep")))
