"""Payers' reputation over a stream, settled by watermark: what the table form gives, whatever the order of arrival.

Slots are event time. A payer's counts at a slot are answered once the watermark has passed the last slot that they are
made of, so rows that come out of order within the delay change nothing. State per (payer, part): landed and failed counts
per slot since the watermark (a map), the slots still to be answered (a map), and two decayed counts of everything older.
The maps hold the slots of the delay and the lag, however long the stream runs; an entry whose decayed total falls below
`least` is removed by a timer.

A payer with a large share of all rows is split: its events are dealt over parts by their id, every part is asked for every
slot of the payer, and the parts' answers, which leave in the same batch, are added up. Counts are halved by powers of two, so
sums are exact while they span fewer halvings than a double has bits, and right to the last bits beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txlens.streaming import run

PARTIAL = "payer bigint, part int, slot bigint, landed double, failed double, seen bigint"

# Fixed values
LEAST = 0.01


class _Counts(StatefulProcessor):
    """Counts of one (payer, part)."""

    def __init__(self, lag: int, half_life: int, least: float) -> None:
        self.lag, self.half_life, self.least = lag, half_life, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.old = handle.getValueState("old", "landed double, failed double, epoch bigint, seen bigint")
        self.recent = handle.getMapState("recent", "slot bigint", "ok bigint, fail bigint")
        self.asked = handle.getMapState("asked", "slot bigint", "open boolean")
        self.timer = handle.getValueState("timer", "at bigint")

    def close(self) -> None:
        pass

    def _wake(self, slot: int) -> None:
        """A timer for this slot unless an earlier one is set."""
        known = self.timer.get()[0] if self.timer.exists() else None
        if known is None or slot < known:
            # a timer fires once the watermark is past it
            self.handle.registerTimer(slot * 1000 - 1)
            self.timer.update((slot,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # a call per key: plain numbers, and one request per entry of a map
        counts, slots = {}, set()
        for batch in rows:
            for slot, landed, own in zip(batch["slot"].tolist(), batch["landed"].tolist(), batch["own"].tolist()):
                slots.add(slot)
                if own:
                    ok, fail = counts.get(slot, (0, 0))
                    known = landed is not None and landed == landed
                    counts[slot] = (ok + int(landed), fail + 1 - int(landed)) if known else (ok, fail)
        before = {k[0]: v for k, v in self.recent.iterator()} if counts and self.recent.exists() else {}
        for slot, (ok, fail) in counts.items():
            was = before.get(slot, (0, 0))
            self.recent.updateValue((slot,), (int(was[0] + ok), int(was[1] + fail)))
        for slot in slots:
            self.asked.updateValue((slot,), (True,))
        if slots:
            self._wake(min(slots) - self.lag)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        payer, part = key
        mark = timerValues.getCurrentWatermarkInMs() // 1000
        if self.timer.exists() and (expiredTimerInfo.getExpiryTimeInMs() + 1) // 1000 >= self.timer.get()[0]:
            self.timer.clear()
        landed, failed, epoch, seen = self.old.get() if self.old.exists() else (0.0, 0.0, 0, 0)
        slots = sorted((k[0], v[0], v[1]) for k, v in self.recent.iterator())
        pending = sorted(k[0] for k in self.asked.keys())
        out, at, due = [], 0, [s for s in pending if s - self.lag <= mark]

        def add(upto: int) -> None:
            """Counts of all slots up to this one, decayed to the epoch of the last of them."""
            nonlocal landed, failed, epoch, seen, at
            while at < len(slots) and slots[at][0] <= upto:
                slot, ok, fail = slots[at]
                now = max(epoch, slot // self.half_life)
                landed, failed = math.ldexp(landed, epoch - now) + ok, math.ldexp(failed, epoch - now) + fail
                epoch, seen, at = now, seen + ok + fail, at + 1

        for slot in due:
            add(slot - self.lag - 1)
            back = min(0, epoch - slot // self.half_life)
            out.append((payer, part, slot, math.ldexp(landed, back), math.ldexp(failed, back), seen))
        # rows still to come are not older than the mark
        add(mark - self.lag - 1)
        for state, gone, held in ((self.asked, due, pending), (self.recent, [s for s, _, _ in slots[:at]], slots)):
            if gone and len(gone) == len(held):
                state.clear()
            else:
                for slot in gone:
                    state.removeKey((slot,))
        total = math.ldexp(landed + failed, min(0, epoch - mark // self.half_life))
        if at == len(slots) and len(due) == len(pending) and (total < self.least or total == 0):
            for state in (self.old, self.timer, self.recent, self.asked):
                state.clear()
        else:
            self.old.update((landed, failed, int(epoch), int(seen)))
            if len(due) < len(pending):
                self._wake(pending[len(due)] - self.lag)
            elif at < len(slots):
                self._wake(slots[at][0] + self.lag + 1)
            elif self.least > 0:
                self._wake((epoch + int(math.log2((landed + failed) / self.least)) + 1) * self.half_life + 1)
        if out:
            kinds = ("int64", "int32", "int64", "float64", "float64", "int64")
            yield pd.DataFrame({c.split()[0]: np.array(x, t) for c, x, t in zip(PARTIAL.split(", "), zip(*out), kinds)})


def settled(events: DataFrame, lag: int, half_life: int, delay: int, hot: DataFrame | None = None, least: float = LEAST) -> DataFrame:
    """Answers (payer, part, slot, landed, failed, seen) of the parts, as a stream; `merged` adds them up.

    `events`: (tx_id, payer, slot, landed). `delay`: slots that rows may come late; later ones are dropped and counted by
    Spark. Rows without a payer or a slot from 0 on take no part. `hot`: (payer, parts) of the payers to split, a small table; parts may grow between runs, never shrink.
    """
    # Spark drops rows at the watermark too, so a row's time is one past its slot and the watermark one further back
    x = events.where("payer IS NOT NULL AND slot >= 0").withColumn("ts", F.timestamp_seconds(F.col("slot") + 1)).withWatermark("ts", f"{delay + 1} seconds")
    if hot is not None:
        x = x.join(F.broadcast(hot.select("payer", "parts")), "payer", "left")
    else:
        x = x.withColumn("parts", F.lit(1))
    parts = F.coalesce("parts", F.lit(1)).cast("int")
    x = x.withColumn("mine", F.pmod(F.xxhash64("tx_id"), parts).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    x = x.select("payer", "part", "slot", "landed", (F.col("part") == F.col("mine")).alias("own"), "ts")
    return x.groupBy("payer", "part").transformWithStateInPandas(_Counts(lag, half_life, least), PARTIAL, "Append", "EventTime")


def merged(partial: DataFrame) -> DataFrame:
    """Reputation per (payer, slot) from the answers of its parts."""
    g = partial.groupBy("payer", "slot").agg(F.sum("landed").alias("rep_landed"), F.sum("failed").alias("rep_failed"), (F.sum("seen") > 0).cast("int").alias("rep_seen"))
    total = F.col("rep_landed") + F.col("rep_failed")
    rate = F.when(total > 0, F.col("rep_failed") / F.greatest(total, F.lit(1e-9))).otherwise(F.lit(float("nan")))
    return g.select("payer", "slot", "rep_landed", "rep_failed", total.alias("rep_total"), rate.alias("rep_fail_rate"), "rep_seen")


def drain(partial: DataFrame, name: str = "reputation", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Reputation per (payer, slot) of everything available."""
    return run.drain_by_batch(partial, name, lambda batch, _: merged(batch), checkpoint, out).drop("batch")
