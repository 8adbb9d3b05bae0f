"""Stream forms of the log operators. Event time is a timestamp column `ts`; every state is bounded by a watermark."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txlens.functions import bits
from txlens.functions.numbers import count_if
from txlens.operators import funnel as FU

# Fixed values
STATUS_WAIT = "20 seconds"
CONFIRM_WAIT = "45 seconds"
RATE_TOLERANCE = 0.25
SAMPLE_ONE_IN = 1000


def first_wins(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """First arrival per packet identity; later copies inside the delay are dropped, then the key is forgotten."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def feed_race(a: DataFrame, b: DataFrame, within: str, delay: str) -> DataFrame:
    """Two feeds (sig, ts): the lead once both are seen within the bound; an unmatched row appears when it expires."""
    x = a.select(F.col("sig").alias("a_sig"), F.col("ts").alias("a_ts")).withWatermark("a_ts", delay)
    y = b.select(F.col("sig").alias("b_sig"), F.col("ts").alias("b_ts")).withWatermark("b_ts", delay)
    on = F.expr(f"a_sig = b_sig AND b_ts >= a_ts - INTERVAL {within} AND b_ts <= a_ts + INTERVAL {within}")
    return x.join(y, on, "full_outer").select(F.coalesce("a_sig", "b_sig").alias("sig"), "a_ts", "b_ts")


def follow(opps: DataFrame, status: DataFrame, wait: str, delay: str) -> DataFrame:
    """Each opportunity with its status if one comes within the wait, else without one when the wait is over."""
    x = opps.select(F.col("sig").alias("o_sig"), F.col("ts").alias("o_ts")).withWatermark("o_ts", delay).dropDuplicatesWithinWatermark(["o_sig"])
    y = status.select(F.col("sig").alias("s_sig"), F.col("ts").alias("s_ts"), "ok").withWatermark("s_ts", delay)
    on = F.expr(f"o_sig = s_sig AND s_ts >= o_ts AND s_ts <= o_ts + INTERVAL {wait}")
    return x.join(y, on, "left_outer").select(F.col("o_sig").alias("sig"), "o_ts", "s_ts",
                                              F.when(F.col("s_sig").isNull(), "disappeared").when(F.col("ok"), "landed-success").otherwise("landed-failed").alias("outcome"))


def funnel_window(gates: DataFrame, length: str, slide: str, delay: str) -> DataFrame:
    """Gate stages per sliding window, counted in one pass."""
    aggs = [count_if(c).alias(n) for n, c in FU.gate_stages().items()]
    g = gates.withWatermark("ts", delay).groupBy(F.window("ts", length, slide)).agg(*aggs)
    return g.select(F.col("window.end").alias("window_end"), *FU.STAGES)


def counters(events: DataFrame, by: Sequence[str], length: str, delay: str) -> DataFrame:
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", length), *by).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("window_start"), *by, "n")


def rate_check(decisions: DataFrame, length: str, budget: float, delay: str) -> DataFrame:
    """Decisions per window against the budget of a window, within 25%."""
    g = decisions.withWatermark("ts", delay).groupBy(F.window("ts", length)).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("window_start"), "n", (F.abs(F.col("n") - budget) <= budget * RATE_TOLERANCE).alias("within"))


def sessions(beats: DataFrame, proc: str, gap: str, delay: str) -> DataFrame:
    """Run segments of a process, separated by silence."""
    g = beats.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), proc).agg(F.count(F.lit(1)).alias("beats"))
    return g.select(proc, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "beats")


def decide(tx: DataFrame, lookup: DataFrame, threshold: float, sends: int) -> DataFrame:
    """Decision records with the policy in force: sent rows, and one in a thousand of the rest by a stable hash.

    `lookup` is a static table of scores and candidates by transaction; the same function runs on a table or a stream.
    """
    j = tx.join(lookup, "tx_id", "left")
    sent = F.coalesce(F.col("ev") >= threshold, F.lit(False)) & F.coalesce(F.col("n_candidates") > 0, F.lit(False))
    sampled = ~sent & (bits.mix_mod(bits.SAMPLE_SEED, F.col("tx_id"), SAMPLE_ONE_IN) == 0)
    return j.withColumn("sent", sent).withColumn("sampled", sampled).where("sent OR sampled").withColumn(
        "threshold", F.lit(float(threshold))).withColumn("sends", F.lit(int(sends)))


def reputation(events: DataFrame, lag: int, half_life: int, late_slots: int = 600) -> DataFrame:
    """Per event (tx_id, payer, slot, landed): decayed counts of the payer's events at slots <= slot - lag - 1.

    Every row is answered in the batch it comes in, from all events received by then. State per payer: two decayed
    counts of the events older than `late_slots` before its last slot, and landed and failed counts per slot since. A
    row within `late_slots` is answered exactly as a table would, given the events received; an older one has `late`
    true and null counts, as events around it have been added up. It still counts for later rows.
    """
    schema = "tx_id bigint, payer bigint, slot bigint, rep_landed double, rep_failed double, rep_seen int, late boolean"
    state_schema = "landed double, failed double, epoch bigint, until bigint, slots array<bigint>, oks array<double>, fails array<double>"

    def decayed(base: float, epoch: int, slots: np.ndarray, counts: np.ndarray, seen: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The base and the first `seen` slot counts at the epochs `at`."""
        out = np.zeros(len(at))
        own = slots // half_life
        for e in np.unique(own):  # epochs within `late_slots` and this batch
            mine = np.flatnonzero(own == e)
            total = np.concatenate([[0.0], np.cumsum(counts[mine])])
            out += np.ldexp(total[np.clip(seen - mine[0], 0, len(mine))], np.minimum(0, e - at).astype(int))
        return out + np.ldexp(np.full(len(at), base), np.minimum(0, epoch - at).astype(int))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        landed, failed, epoch, until, slots, oks, fails = state.get if state.exists else (0.0, 0.0, 0, None, [], [], [])
        rows = list(batches)
        rows = rows[0] if len(rows) == 1 else pd.concat(rows)
        # a call per payer: arrays, no tables
        ask, landed_now = rows["slot"].to_numpy(np.int64), rows["landed"].to_numpy(float, na_value=np.nan)
        placed, known = rows["slot"].notna().to_numpy(), ~np.isnan(landed_now)
        every = np.concatenate([np.array(slots, np.int64), ask[placed]])
        at, place = np.unique(every, return_inverse=True)
        counted, won = known[placed].astype(float), np.where(known, landed_now, 0.0)[placed]
        ok = np.bincount(place, np.concatenate([np.array(oks, float), won]), len(at))
        fail = np.bincount(place, np.concatenate([np.array(fails, float), counted - won]), len(at))
        seen = np.searchsorted(at, ask - lag - 1, side="right")
        late = ask - lag - 1 < until if until is not None else np.zeros(len(ask), bool)
        answers = [decayed(b, epoch, at, c, seen, ask // half_life) for b, c in ((landed, ok), (failed, fail))]
        any_seen = pd.arrays.IntegerArray(((seen > 0) | (until is not None)).astype("int32"), late.copy())
        yield pd.DataFrame({"tx_id": rows["tx_id"].to_numpy(), "payer": key[0], "slot": ask, "rep_landed": np.where(late, np.nan, answers[0]),
                            "rep_failed": np.where(late, np.nan, answers[1]), "rep_seen": any_seen, "late": late})
        old = at < at[-1:] - late_slots
        if old.any():
            until = max(int(at[old][-1]), until if until is not None else int(at[old][-1]))
            now = max(epoch, int(until // half_life))
            everything = np.array([old.sum()])
            landed, failed = (float(decayed(b, epoch, at[old], c[old], everything, np.array([now]))[0]) for b, c in ((landed, ok), (failed, fail)))
            epoch = now
        state.update((landed, failed, int(epoch), until, at[~old].tolist(), ok[~old].tolist(), fail[~old].tolist()))

    return events.groupBy("payer").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
