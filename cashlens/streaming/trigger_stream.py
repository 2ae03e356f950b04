"""Streaming trigger decisions: runs are classified by the batch expressions; a small state row holds the clock."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cashlens.functions import policy as P
from cashlens.operators.triggers import BACKLOG, DECISION_SCHEMA, classified

STATE_SCHEMA = "in_zone boolean, last_fire timestamp, backlog_done boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["company_id", "run_at", "fires", "mode", "trigger_type", "in_zone"]


class TriggerClock(StatefulProcessor):
    """Zone, time of the last fire and backlog flag of a company; everything else comes classified."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("clock", STATE_SCHEMA)
        self.wait = timedelta(days=P.THRESHOLDS["price_trigger_cooldown_days"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        zone, last, done = self.state.get() if self.state.exists() else (False, None, False)
        # One company's runs of one micro-batch, bounded by the release clock.
        runs = pd.concat(list(rows), ignore_index=True).sort_values("run_at", kind="stable").drop_duplicates("run_at")
        out = []
        for run in runs.itertuples():
            if run.zone is not None and run.zone == run.zone:
                zone = bool(run.zone)
            fired = (False, None, None)
            if isinstance(run.urgent, str):
                fired = (True, "URGENT_RISK_REVIEW", run.urgent)
            elif run.asks:
                backlog = run.backlog and not done
                waited = last is None or run.run_at.to_pydatetime() >= last + self.wait
                if waited if backlog or run.price else run.rested:
                    fired = (True, "PRICE_RISK_ANALYSIS", BACKLOG if backlog else run.kind)
                    last, done = run.run_at.to_pydatetime(), done or backlog
            out.append((run.company_id, run.run_at, *fired, zone))
        self.state.update((zone, last, bool(done)))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def trigger_stream(runs: DataFrame) -> DataFrame:
    """Decisions for a stream of company runs; needs the RocksDB state store."""
    runs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return classified(runs).groupBy("company_id").transformWithStateInPandas(
        statefulProcessor=TriggerClock(), outputStructType=DECISION_SCHEMA, outputMode="Append", timeMode="None"
    )
