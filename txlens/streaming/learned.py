"""Keys learned from a stream: each once, with its smallest sequence number, in state that expires.

A key's first batch says it is learned; a later batch that brings a smaller number says so again, so the smallest number over
all batches stands at the end. Batches are written under their own number and the state goes back with a repeated batch, so
repeating one changes nothing. A key that has not been seen for `keep` seconds of event time is forgotten, and is learned anew
if it comes back: its earlier row stays in the log.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _First(StatefulProcessor):
    def __init__(self, key: str, keep: int) -> None:
        self.key, self.keep = key, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "seq bigint, seen_ms bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        seq = seen = None
        for b in rows:
            low, high = int(b["seq"].min()), int(b["ms"].max())
            seq, seen = (low, high) if seq is None else (min(seq, low), max(seen, high))
        was = self.first.get() if self.first.exists() else None
        now = (seq, seen) if was is None else (min(seq, was[0]), max(seen, was[1]))
        self.first.update(now)
        self.handle.registerTimer(now[1] + self.keep * 1000)
        if was is None or now[0] < was[0]:
            yield pd.DataFrame({self.key: [key[0]], "first_seq": [now[0]], "corrected": [was is not None]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.first.exists() and self.first.get()[1] + self.keep * 1000 <= timerValues.getCurrentWatermarkInMs():
            self.first.clear()
        yield pd.DataFrame({self.key: pd.Series([], dtype="int64"), "first_seq": pd.Series([], dtype="int64"), "corrected": pd.Series([], dtype="bool")})


def first_seen(rows: DataFrame, key: str, seq: str, delay: str, keep: int) -> DataFrame:
    """The log (key, first_seq, corrected) as a stream. `rows` has an event time `ts`; null keys and numbers take no part."""
    x = rows.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).withWatermark("ts", delay)
    x = x.select(F.col(key).cast("long").alias(key), F.col(seq).cast("long").alias("seq"), F.unix_millis("ts").alias("ms"), "ts")
    return x.groupBy(key).transformWithStateInPandas(_First(key, keep), f"{key} bigint, first_seq bigint, corrected boolean", "Append", "EventTime")


def learned(log: DataFrame, key: str) -> DataFrame:
    """(key, first_seq): the smallest number of each key over all batches of the log."""
    return log.groupBy(key).agg(F.min("first_seq").alias("first_seq"))
