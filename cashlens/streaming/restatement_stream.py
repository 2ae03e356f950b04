"""Restatements as a stream: the newest row per point identity by fetch time, in whatever order rows arrive.

State holds the best row's place only: its fetch time and ingest number. An older row never replaces a newer one. Rows that
the watermark has passed are late: Spark drops them before the state and counts them, see ``late_rows``. Once the
watermark has passed the stored fetch time, every row that may still come is newer, so the place is dropped and
nothing is lost; state is bounded by the delay, not by the number of points.

Identities are dealt out to a fixed number of groups by hash, and a group's places are one state value of packed arrays:
a call of the state costs more than a hundred rows, so there are calls per group and batch, none per identity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cashlens.streaming.trigger_stream import STATE_STORE

c = F.col
IDENTITY = ("company_id", "field_id", "security_id", "fiscal_period", "source_document")
#: An identity's hash (128 bits) and the place of its best row; of two rows the one with the larger place is newer.
PLACE = np.dtype([("high", "<i8"), ("low", "<i8"), ("fetch_us", "<i8"), ("ingest_no", "<i8")])


def places(rows: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(rows), PLACE)
    for name in PLACE.names:
        out[name] = rows[name].to_numpy()
    return out


def newest_places(found: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Positions in ``known`` and then ``found`` of the newest place per identity; on equal places the known one stays."""
    every = np.concatenate([known, found])
    is_known = np.arange(len(every)) < len(known)
    # ~x falls as x grows
    order = np.lexsort((is_known, ~every["ingest_no"], every["fetch_us"], every["low"], every["high"]))
    high, low = every["high"][order], every["low"][order]
    return order[np.r_[(high[1:] != high[:-1]) | (low[1:] != low[:-1]), np.ones(min(1, len(order)), bool)]]


class NewestRow(StatefulProcessor):
    """Lets a row through when it is newer than all rows of its identity so far; on equal time the smaller ingest number is."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "places binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = self.best.get()
        known = np.frombuffer(bytes(stored[0]), PLACE) if stored else np.empty(0, PLACE)
        none = np.empty(0, PLACE)
        # of each Arrow batch only the newest row per identity is held
        top = pd.concat([batch.iloc[newest_places(places(batch), none)] for batch in rows], ignore_index=True)
        found = places(top)
        newest = newest_places(found, known)
        arrived = np.sort(newest[newest >= len(known)]) - len(known)
        if not len(arrived):
            return
        watermark = timerValues.getCurrentWatermarkInMs()
        kept = np.concatenate([known, found])[newest]
        # no row up to the watermark comes in a later batch
        kept = kept[kept["fetch_us"] // 1000 >= watermark]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(kept):
            self.best.update((kept.tobytes(),))
            # places that are passed go with the next rows of the group, and all of them once the last is passed
            self.handle.registerTimer(int(kept["fetch_us"].max()) // 1000 + 1)
        else:
            self.best.clear()
        yield top.iloc[arrived][self.columns]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.best.clear()
        return iter(())

    def close(self) -> None:
        pass


def newest_rows(points: DataFrame, delay: str, identity: Sequence[str] = IDENTITY, groups: int = 512) -> DataFrame:
    """The points that were the newest of their identity when they arrived; the last of each is the newest of all.

    ``points`` is a stream with the identity, source_fetch_time (timestamp) and ingest_seq. Nulls in the identity are
    values of their own; rows without a fetch time or an ingest number are left out. A checkpoint keeps its ``groups``.
    """
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    known = points.where("source_fetch_time is not null and ingest_seq is not null")
    # one text, so that null parts of an identity are equal
    identity_text = F.to_json(F.struct(*identity), {"ignoreNullFields": "false"})
    timed = known.withWatermark("source_fetch_time", delay).withColumns(
        {
            "fetch_us": F.unix_micros("source_fetch_time"),
            "ingest_no": c("ingest_seq").cast("bigint"),
            "high": F.xxhash64(F.lit(1), identity_text),
            "low": F.xxhash64(F.lit(2), identity_text),
        }
    )
    dealt = timed.withColumn("point_group", F.pmod(c("high"), F.lit(groups)))
    names = points.columns
    return dealt.groupBy("point_group").transformWithStateInPandas(
        statefulProcessor=NewestRow(names), outputStructType=points.schema, outputMode="Append", timeMode="EventTime"
    )


def late_rows(query: StreamingQuery) -> int:
    """How many rows came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
