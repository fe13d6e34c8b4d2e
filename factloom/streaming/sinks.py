"""Sinks of streams: each batch written once, whatever is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_once(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to folder/batch=N; a batch that runs again after a loss replaces its own part, so no row comes twice. Runs until what is there is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(folder_rows: DataFrame, key: str) -> DataFrame:
    """(key, rows, batches): what an append ledger holds of each key."""
    return folder_rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct("batch").alias("batches"))
