"""Event logs as streams: windowed roll-ups, late data by watermark, budgets per episode."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphweft.session import ship


def role_rollup(events: DataFrame, ts: str, role: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per window and role: n, sum, mean, min, max; the same on a stream (rows later than ``late`` are left out) and a table."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    out = source.groupBy(F.window(ts, width), F.col(role).alias("role")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("window.start").alias("window_start"), "role", "n", "total", "mean", "least", "most")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Per key the sessions that a pause of ``gap`` ends: start, end, n."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    out = source.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def running_budget(events: DataFrame, key: str, cost: str, limit: float) -> DataFrame:
    """A stream of what each key has used up and whether its budget is spent; state is two numbers per key."""
    ship(events.sparkSession)

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls, used = state.get if state.exists else (0, 0.0)
        for batch in batches:
            calls, used = calls + len(batch), used + float(batch[cost].sum())
        state.update((calls, used))
        yield pd.DataFrame({key: [k[0]], "calls": [calls], "used": [used], "spent": [used > limit]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, calls long, used double, spent boolean", "calls long, used double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now and gives its result as a table in memory; for bounded sources."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
