"""Streaming twins of batch queries: the same transformations on readStream frames.

Event time and lateness are Spark's: a row later than the watermark is dropped from windows and deduplication, as streams must."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _timed(rows: DataFrame, column: str, late: str) -> DataFrame:
    """Rows with a watermark; times without a zone are read in the session's zone, which the engine sets to UTC."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and totals of tumbling windows; twin of the batch query event_windows."""
    w = _timed(events, "ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user parted by a gap."""
    s = _timed(events, "ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def first_deliveries(rows: DataFrame, key: str, arrived: str, late: str = "2 hours") -> DataFrame:
    """Each row once, however often it is delivered within the watermark."""
    return _timed(rows, arrived, late).dropDuplicatesWithinWatermark([key])


def outcomes(events: DataFrame) -> DataFrame:
    """(user_id, ok, failed, status) after each batch: an outcome ledger kept as state, one small row a user."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ok, failed = state.get if state.exists else (0, 0)
        for pdf in batches:
            ok, failed = ok + int((pdf["value"] > 0).sum()), failed + int((pdf["value"] <= 0).sum())
        state.update((ok, failed))
        yield pd.DataFrame({"user_id": [key[0]], "ok": [ok], "failed": [failed], "status": ["failed" if not ok else "partial" if failed else "success"]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, ok bigint, failed bigint, status string", "ok bigint, failed bigint", "update", GroupStateTimeout.NoTimeout)
