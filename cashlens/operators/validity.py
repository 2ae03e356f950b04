"""Values that hold between two dates, joined to rows by each row's own date.

An interval goes to every time bucket it touches, a row to the one bucket of its date: the join is an equi-join on key and
bucket, and the dates only filter within it. An interval is at most ``longest`` days, so it goes to a bounded number of
buckets. The best interval per row is a minimum that combines on the mappers, so neither a busy key nor many overlapping
intervals meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashlens.functions import policy as P

c = F.col
MANUAL, REVIEWED = "MANUAL", "REVIEWED"


def valid_intervals(intervals: DataFrame, longest: int = P.REVIEW_MAX_VALIDITY_DAYS) -> DataFrame:
    """Intervals that may be used: a source and a reason, a value from 0 to 100, dates in order and not too far apart."""
    text = lambda x: F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))
    days = F.datediff("expires_at", "as_of_date")
    return intervals.where(text(c("source")) & text(c("reason")) & c("value").between(0, 100) & days.between(0, longest))


def value_at(
    rows: DataFrame, intervals: DataFrame, row_id: str, keys: Sequence[str], on: str, value: str = "value", bucket_days: int = 30, out: str = "score"
) -> DataFrame:
    """Adds ``out`` and ``out``_kind to every row: the value that holds for its keys on its date, null where none does.

    ``intervals``: the keys, kind, as_of_date, expires_at (both included) and the value. A manual value goes before a
    reviewed one; of several of one kind the newest counts, then the one that ends later, then the larger value.
    ``row_id`` names each row once; rows with a null key or date get null.
    """
    bucket = lambda d: F.floor(F.unix_date(d) / bucket_days)
    rank = F.when(c("kind") == MANUAL, 0).when(c("kind") == REVIEWED, 1)
    spread = (
        intervals.where(rank.isNotNull())
        .select(*[c(k).alias(f"_k_{k}") for k in keys], rank.alias("_rank"), "kind", c("as_of_date").alias("_from"), c("expires_at").alias("_to"), c(value).alias("_value"))
        .withColumn("_bucket", F.explode(F.sequence(bucket(c("_from")), bucket(c("_to")))))
    )
    dated = rows.select(c(row_id).alias("_id"), *[c(k) for k in keys], c(on).cast("date").alias("_on"))
    dated = dated.withColumn("_at", bucket(c("_on")))
    same = [c(k) == c(f"_k_{k}") for k in keys] + [c("_at") == c("_bucket")]
    held = dated.join(spread, same).where(c("_on").between(c("_from"), c("_to")))
    order: list[Column] = [c("_rank"), -F.unix_date("_from"), -F.unix_date("_to"), -c("_value")]
    best = held.groupBy("_id").agg(F.min_by(F.struct("_value", "kind"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_best"))
    joined = rows.join(best, c(row_id) == c("_id"), "left")
    return joined.select(*[c(x) for x in rows.columns], c("_best._value").alias(out), c("_best.kind").alias(f"{out}_kind"))
