"""An event feed: all pages first, then the newest pages as they come, into one revision log.

One checkpoint serves both: a run takes the pages that no run has taken, at most ``pages_per_batch`` at a time, and ends
when there are none left. The first run is the bootstrap. Each batch logs the first sighting of every content that the
log does not hold yet; the log takes a batch id once, so a batch that is run again after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cashlens.operators.events import revisions
from cashlens.sources.publish import append_once, logged

c = F.col
CONTENT = ["event_key", "payload_hash"]


def revise(root: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: the batch's new revisions go to the log at ``root``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = revisions(batch)
        log = logged(batch.sparkSession, root, fresh.schema)
        if log is not None:
            keys = log.select("event_key").distinct().withColumn("_known", F.lit(True))
            fresh = fresh.join(log.select(*CONTENT), CONTENT, "left_anti").join(keys, "event_key", "left")
            fresh = fresh.withColumn("change_kind", F.when(c("_known"), "changed").otherwise(c("change_kind"))).drop("_known")
        append_once(fresh, root, batch_id, CONTENT)

    return write


def read_feed(
    spark: SparkSession, pages: str, schema, root: str, observations: Callable[[DataFrame], DataFrame], lower: Column | None = None, pages_per_batch: int = 100
) -> StreamingQuery:
    """Log what the pages hold that no earlier run has read, and return the ended run.

    ``observations`` maps page rows to event_key, payload_hash, observed_at and batch_seq. ``lower`` drops what was
    observed before it, as a run does that only wants the newest page of a feed it has not bootstrapped.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", pages_per_batch).option("latestFirst", False).parquet(pages)
    rows = observations(stream)
    if lower is not None:
        rows = rows.where(c("observed_at") >= lower)
    query = (
        rows.writeStream.foreachBatch(revise(f"{root}/log"))
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def revision_log(spark: SparkSession, root: str) -> DataFrame | None:
    return logged(spark, f"{root}/log")
