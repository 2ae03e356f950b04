"""Streaming change capture: the revision log and the gated snapshot table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cashlens.session import checkpoint_dir


def revision_stream(observations: DataFrame, delay: str | None = None) -> DataFrame:
    """First sighting of each (event key, content).

    Keyed by key and content together, so a hot event key spreads over the state partitions.  With
    ``delay`` the state of old contents is dropped behind the watermark.
    """
    if delay:
        return observations.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(
            ["event_key", "payload_hash"]
        )
    return observations.dropDuplicates(["event_key", "payload_hash"])


def run_available(df: DataFrame, target: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now into a parquet table, with the checkpoint beside it."""
    q = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{target}/data")
        .option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def scratch_table(spark: SparkSession, name: str) -> str:
    """A fresh table location in the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def gated_replace(valid: Callable[[DataFrame], DataFrame], target: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink that replaces the table only when the rule table of the batch is empty.

    ``valid`` maps a batch to its violations; a batch with violations leaves the last good table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            if batch.isEmpty() or not valid(batch).isEmpty():
                return
            batch.write.mode("overwrite").parquet(f"{target}/version={batch_id}")
        finally:
            batch.unpersist()

    return write


def windowed_counts(observations: DataFrame, width: str, delay: str) -> DataFrame:
    """Event counts per window and type behind a watermark."""
    return (
        observations.withWatermark("observed_at", delay)
        .groupBy(F.window("observed_at", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )
