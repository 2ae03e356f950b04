"""Periodic refresh as a stream: a refresh falls due by the clock, with no new run of the company.

Rows are runs and successes of a company. They wait in the company's state until the watermark has passed them, so that
any order of arrival within the delay gives the decisions of the batch form. One timer per company stands at its next
moment: the first waiting row, or the time the refresh falls due. It fires when the watermark passes it, whoever moved the
watermark. State and timers are kept by the checkpoint, so a restarted stream goes on where it was.

A refresh is due ``days`` behind the newest success while the company is in the zone, and once per success. Where the
company only enters the zone later, or its risk shortens the days, it is due at that run.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cashlens.functions import policy as P
from cashlens.operators.scale import lag_in_buckets, latest_by, running_in_buckets
from cashlens.streaming.trigger_stream import STATE_STORE

c = F.col
DAY_US = 86_400_000_000
ROW = "at_us bigint, success boolean, in_zone boolean, days int"
CLOCK = "in_zone boolean, days int, success_us bigint, fired boolean, last_us bigint"
COLUMNS = ["company_id", "due_us", "refresh_days", "success_us"]


def refresh_rows(runs: DataFrame, successes: DataFrame) -> DataFrame:
    """Runs (company_id, at, in_zone, risky) and successes (company_id, at) as rows of one stream or table."""
    yes = lambda column: F.coalesce(column, F.lit(False))
    days = F.when(yes(c("risky")), P.THRESHOLDS["high_risk_refresh_days"]).otherwise(P.THRESHOLDS["periodic_refresh_days"])
    known = "company_id is not null and at is not null"
    left = runs.where(known).select("company_id", "at", F.lit(False).alias("success"), yes(c("in_zone")).alias("in_zone"), days.cast("int").alias("days"))
    right = successes.where(known).select("company_id", "at", F.lit(True).alias("success"), F.lit(False).alias("in_zone"), F.lit(0).cast("int").alias("days"))
    return left.unionByName(right)


class RefreshClock(StatefulProcessor):
    """The zone, the days, the newest success and the waiting rows of a company."""

    def __init__(self, idle_days: int | None = None):
        self.idle = None if idle_days is None else idle_days * DAY_US

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.waiting = handle.getListState("waiting", ROW)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            kept = [(int(a), bool(s), bool(z), int(d)) for a, s, z, d in zip(batch.at_us, batch.success, batch.in_zone, batch.days, strict=True)]
            if kept:
                self.waiting.appendList(kept)
                first = min([r[0] for r in kept] + ([first] if first is not None else []))
        if first is not None:
            self.wake(first, timerValues.getCurrentWatermarkInMs(), keep_earlier=True)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed_ms = timerValues.getCurrentWatermarkInMs()
        passed = passed_ms * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        rows.sort(key=lambda r: (r[0], not r[1], r[2], r[3]))
        ready = [r for r in rows if r[0] < passed]
        later = rows[len(ready) :]
        zone, days, success, fired, last = self.clock.get() if self.clock.exists() else (False, 0, None, False, None)
        out = []

        def fire(at: int) -> None:
            nonlocal fired
            out.append((key[0], at, days, success))
            fired = True

        def due() -> int | None:
            return success + days * DAY_US if zone and success is not None and not fired else None

        for at, is_success, in_zone, row_days in ready:
            if due() is not None and due() <= at:
                fire(max(due(), last))
            if is_success:
                success, fired = at, False
            else:
                zone, days = in_zone, row_days
            last = at
        if due() is not None and max(due(), last) < passed:
            fire(max(due(), last))
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        if self.idle is not None and not later and last is not None and last + self.idle < passed:
            self.clock.clear()
        elif last is not None:
            self.clock.update((zone, days, success, fired, last))
            ahead = [r[0] for r in later[:1]] + [t for t in (due(), None if self.idle is None else last + self.idle) if t is not None]
            if ahead:
                self.wake(min(ahead), passed_ms, keep_earlier=False)
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def wake(self, at_us: int, watermark_ms: int, keep_earlier: bool) -> None:
        """One timer per company, behind the watermark: at ``at_us``, or where an earlier one stands there."""
        at = max(at_us // 1000 + 1, watermark_ms + 1)
        for other in list(self.handle.listTimers()):
            if keep_earlier and other <= at:
                return
            if other > watermark_ms:
                self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def refresh_stream(rows: DataFrame, delay: str, idle_days: int | None = None) -> DataFrame:
    """company_id, due_at, refresh_days and success_at of each refresh of a stream of ``refresh_rows``.

    ``delay`` is how late a row may arrive. State of a company without rows for ``idle_days`` is dropped.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = rows.withWatermark("at", delay).withColumn("at_us", F.unix_micros(c("at").cast("timestamp")))
    fired = timed.groupBy("company_id").transformWithStateInPandas(
        statefulProcessor=RefreshClock(idle_days),
        outputStructType="company_id bigint, due_us bigint, refresh_days int, success_us bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
    return as_times(fired)


def as_times(fired: DataFrame) -> DataFrame:
    return fired.select("company_id", F.timestamp_micros("due_us").alias("due_at"), "refresh_days", F.timestamp_micros("success_us").alias("success_at"))


def due_refreshes(rows: DataFrame, until: Column, bucket: str = "hour") -> DataFrame:
    """The refreshes that fall due before ``until``, from the rows before it: what the stream has fired at that watermark."""
    timed = rows.select("company_id", F.unix_micros(c("at").cast("timestamp")).alias("at_us"), (~c("success")).cast("int").alias("is_run"), "in_zone", "days", c("at").cast("timestamp").alias("_at"))
    timed = timed.where(c("_at") < until)
    order = ["at_us", "is_run", "in_zone", "days"]
    run = F.when(c("is_run") == 1, F.struct("at_us", "in_zone", "days"))
    measures = {"_run": ("max", run), "_success": ("max", F.when(c("is_run") == 0, c("at_us")))}
    states = running_in_buckets(timed, ["company_id"], order, F.date_trunc(bucket, "_at"), measures)
    states = states.withColumn("_state", F.struct(c("at_us").alias("last"), c("_run.in_zone").alias("zone"), c("_run.days").alias("days"), c("_success").alias("success")))
    steps = lag_in_buckets(states, ["company_id"], order, F.date_trunc(bucket, "_at"), "_state", "_before")
    end = F.unix_micros(until)
    closed = steps.select("company_id", c("_before").alias("s"), c("at_us").alias("end"), F.lit(True).alias("closed"))
    newest = latest_by(states.select("company_id", *order, "_state"), ["company_id"], [c(x) for x in order])
    open_ = newest.select("company_id", c("_state").alias("s"), end.alias("end"), F.lit(False).alias("closed"))
    due = F.greatest(c("s.success") + c("s.days") * F.lit(DAY_US), c("s.last"))
    found = closed.unionByName(open_).withColumn("due_us", due)
    found = found.where("s.zone and s.success is not null").where((c("due_us") < c("end")) | (c("closed") & (c("due_us") == c("end"))))
    first = found.groupBy("company_id", c("s.success").alias("success_us")).agg(F.min(F.struct("due_us", c("s.days").alias("days"))).alias("f"))
    return as_times(first.select("company_id", c("f.due_us").alias("due_us"), c("f.days").cast("int").alias("refresh_days"), "success_us"))
