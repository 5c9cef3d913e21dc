"""The strength fold as a stream: by memory, what is settled, and the events that late ones may still come between.

An event is settled when the watermark has passed it: nothing earlier can come any more, so it is folded into score and
score_at for good.  Events beyond the watermark are kept as they are and folded behind what is settled whenever a batch
touches their memory, in the order of their times, however they came.  A timer settles a memory's last events when no
more come, so that what is kept of a memory is bounded by the events of one delay.  Events behind the watermark are
dropped by Spark.  Events with a null id, ts, op or time count for nothing; an empty stream gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import model


class Settled(NamedTuple):
    score: float
    score_at: float
    n_access: int = 0
    pinned: bool = False
    retired: bool = False


def step(s: float, at: float, rate: float, ts: float, op: str) -> tuple[float, float]:
    """Strength after an event; time never runs backwards."""
    s *= math.exp(-rate * max(0.0, ts - at) / model.DAY)
    at = max(at, ts)
    return (s + model.BOOST * (1 - s) if op == "access" else s), at


def folded(x: Settled, events: Iterable[tuple[float, int, str]], rate: float) -> Settled:
    """x after events (ts, seq, op) in their order; nothing counts after a retire."""
    for ts, _, op in events:
        if not x.retired:
            s, at = step(x.score, x.score_at, rate, ts, op)
            x = Settled(s, at, x.n_access + (op == "access"), x.pinned or op == "pin", op == "retire")
    return x


def stream_strength(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """events (id, seq, op, ts, event_time, created, rate) to (id, score, score_at, n_access, pinned, retired), a row
    for each memory that a batch touches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            *x, created, rate, ts, seq, op = state.get
            x, kept = Settled(*x), list(zip(ts, seq, op, strict=True))
        else:
            x, kept, created, rate = None, [], 0.0, 0.0
        for pdf in frames:
            if x is None and len(pdf):
                created, rate = float(pdf["created"].iloc[0]), float(pdf["rate"].iloc[0])
                x = Settled(model.INITIAL, created)
            kept += [(float(t), int(n), o) for t, n, o in zip(pdf["ts"], pdf["seq"], pdf["op"], strict=True) if t >= created]
        kept.sort()
        passed = state.getCurrentWatermarkMs() / 1000
        done = [e for e in kept if e[0] < passed]
        x, kept = folded(x, done, rate), kept[len(done) :]
        columns = zip(*kept, strict=True) if kept else ((), (), ())
        state.update((*x, created, rate, *map(list, columns)))
        if kept:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(kept[-1][0] * 1000)) + 1)
        if not state.hasTimedOut:
            now = folded(x, kept, rate)
            yield pd.DataFrame({"id": [key[0]], "score": [1.0 if now.pinned else now.score], "score_at": [now.score_at], "n_access": [int(now.n_access)], "pinned": [bool(now.pinned)], "retired": [bool(now.retired)]})

    known = events.where("id IS NOT NULL AND ts IS NOT NULL AND op IS NOT NULL AND event_time IS NOT NULL")
    out = "id string, score double, score_at double, n_access long, pinned boolean, retired boolean"
    kept = "score double, score_at double, n_access long, pinned boolean, retired boolean, created double, rate double, ts array<double>, seq array<long>, op array<string>"
    return known.withWatermark("event_time", delay).groupBy("id").applyInPandasWithState(run, out, kept, "update", GroupStateTimeout.EventTimeTimeout)
