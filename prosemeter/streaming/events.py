"""Event-time windows, exact rate limits with state, and scoring of document streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import sentences
from ..operators import issues, signals


def windowed(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; rows later than the watermark are let go."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def scored(docs: DataFrame) -> DataFrame:
    """Row-wise signals of a stream of documents: no state."""
    s = sentences(F.col("text"))
    mean, cv = signals.length_stats(s)
    return docs.select("doc_id", F.size(s).alias("n_sentences"), mean.alias("mean_length"), cv.alias("cv"), signals.burstiness(s).alias("burstiness"), issues.syntactic(F.col("text"), s).alias("syntactic"))


def rate_limited(events: DataFrame, key: str, seconds: int, budget: int, late: str = "1 hour") -> DataFrame:
    """(key, event_id, allowed): the exact limiter as a stateful operator; a key's state is `budget` times at most.

    Events of one micro-batch are taken in time order; state of a quiet key times out with the watermark.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        allowed = []
        for t in rows["at"]:
            held = [h for h in held if h > t - seconds]
            allowed.append(len(held) < budget)
            if allowed[-1]:
                held.append(t)
        state.update((held,))
        if len(rows):
            state.setTimeoutTimestamp(int((rows["at"].max() + seconds) * 1000) + 1 if state.getCurrentWatermarkMs() < int((rows["at"].max() + seconds) * 1000) else state.getCurrentWatermarkMs() + 1)
        yield pd.DataFrame({key: [k[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    rows = events.withWatermark("ts", late).select(key, "event_id", "ts", F.col("ts").cast("timestamp").cast("double").alias("at"))
    kind = dict(events.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, allowed boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)
