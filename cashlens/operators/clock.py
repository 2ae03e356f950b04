"""Firings under a cooldown, found by composing the map from a firing to the next one with itself.

After k rounds of joins on (company, time) all firings among the first 2**k of a chain are known, so no company is folded
run by run, however many it has.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.operators.scale import first_at_or_after
from cashlens.session import cut_lineage

c = F.col
KEY = ["company_id"]


def clock_firings(marks: DataFrame, wait_days: int, bucket: str = "hour") -> DataFrame:
    """The asking runs that fire, of ``marks`` (company_id, run_at, always).

    A mark with ``always`` fires and restarts the clock; another fires if none did in the ``wait_days`` before it.
    """
    wait = F.make_dt_interval(F.lit(wait_days))
    kind = lambda n: F.lit(n).alias("_kind")
    ask = F.when(~c("always"), c("run_at"))
    # each mark looks wait_days ahead for an ask, and from itself on for the next mark that fires anyway
    ahead = marks.select("company_id", (c("run_at") + wait).alias("_at"), kind(0), c("run_at").alias("_from"), F.lit(None).cast("timestamp").alias("_ask"))
    asks = marks.select("company_id", c("run_at").alias("_at"), kind(1), F.lit(None).cast("timestamp").alias("_from"), ask.alias("_ask"))
    found = first_at_or_after(ahead.unionByName(asks), KEY, ["_at", "_kind"], F.date_trunc(bucket, "_at"), "_ask", "_next")
    found = found.where("_kind = 0").select("company_id", c("_from").alias("run_at"), "_next")
    stops = running_stops(marks, bucket)
    jumps = found.join(stops, ["company_id", "run_at"]).where(c("_next").isNotNull() & (c("_stop").isNull() | (c("_next") < c("_stop"))))
    jumps = cut_lineage(jumps.select("company_id", "run_at", "_next"))
    first = marks.groupBy("company_id").agg(F.min("run_at").alias("run_at"))
    reached = marks.where("always").select("company_id", "run_at").unionByName(first).distinct()
    span = marks.agg((F.unix_seconds(F.max("run_at")) - F.unix_seconds(F.min("run_at"))).alias("s")).first()["s"]
    links = (span or 0) // (wait_days * 86400) + 1  # a chain has no more firings behind its first
    for _ in range(ceil(log2(links)) + 1):
        reached = cut_lineage(reached.unionByName(reached.join(jumps, KEY + ["run_at"]).select("company_id", c("_next").alias("run_at"))).distinct())
        second = jumps.select("company_id", c("run_at").alias("_next"), c("_next").alias("_second"))
        jumps = cut_lineage(jumps.join(second, KEY + ["_next"]).select("company_id", "run_at", c("_second").alias("_next")))
    return reached.join(marks.where("not always"), KEY + ["run_at"], "left_semi")


def running_stops(marks: DataFrame, bucket: str) -> DataFrame:
    """(company_id, run_at, _stop): the next mark behind each that fires whatever the clock says."""
    always = F.when(c("always"), c("run_at")).alias("_ask")
    here = marks.select("company_id", c("run_at").alias("_at"), F.lit(0).alias("_kind"), always)
    probes = marks.select("company_id", c("run_at").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("timestamp").alias("_ask"))
    found = first_at_or_after(here.unionByName(probes), KEY, ["_at", "_kind"], F.date_trunc(bucket, "_at"), "_ask", "_stop")
    return found.where("_kind = 1").select("company_id", c("_at").alias("run_at"), "_stop")
