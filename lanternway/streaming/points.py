"""Traces as a stream: the same deltas and cell visits, computed as points arrive."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanternway.functions import geo, timefn
from lanternway.functions.constants import RESOLUTION

_STATE = "seq long, event_time timestamp, x double, y double"


def located(points: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """Points of a stream with their grid cell; stateless."""
    return points.withColumn("cell_id", geo.cell_id(F.col("x"), F.col("y"), resolution))


def cell_visits(points: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Points and agents per cell and time window; points later than `late` no longer count."""
    rows = located(points).withWatermark("event_time", late)
    return rows.groupBy(F.window("event_time", window), "cell_id").agg(F.count("*").alias("n_points"), F.approx_count_distinct("agent_id").alias("n_agents"))


_UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def milliseconds(interval: str) -> int:
    """The length of an interval such as ``90 seconds`` or ``1 hour 30 minutes``."""
    words = interval.lower().removeprefix("interval ").split()
    if len(words) % 2 or not words:
        raise ValueError(f"no interval of numbers and units: {interval}")
    return sum(int(float(n) * _UNITS[u.removesuffix("s")]) for n, u in zip(words[::2], words[1::2], strict=True))


def deltas(points: DataFrame, forget: str = "1 hour") -> DataFrame:
    """Interval, distance and speed since the agent's point before; state is the last point per agent.

    Points of a micro-batch are taken in order of time, then `seq`. A point older than the agent's last
    gets no interval and does not move the state. State of an agent that is silent longer than the
    watermark's delay `forget` is dropped.
    """

    wait = milliseconds(forget)

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["event_time", "seq"])
        last = state.get if state.exists else None
        out = []
        for r in rows.itertuples(index=False):
            ahead = last is not None and r.event_time >= last[1]
            out.append((key[0], r.seq, r.event_time, (r.event_time - last[1]).total_seconds() if ahead else None, last[2] if ahead else None, last[3] if ahead else None, r.x, r.y))
            if last is None or ahead:
                last = (int(r.seq), r.event_time, float(r.x), float(r.y))
        state.update(last)
        state.setTimeoutTimestamp(int(last[1].timestamp() * 1000) + wait)
        yield pd.DataFrame(out, columns=["agent_id", "seq", "event_time", "interval_s", "px", "py", "x", "y"])

    pairs = points.withWatermark("event_time", forget).groupBy("agent_id").applyInPandasWithState(
        step, "agent_id string, seq long, event_time timestamp, interval_s double, px double, py double, x double, y double", _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    metres = geo.haversine(F.col("px"), F.col("py"), F.col("x"), F.col("y"))
    found = pairs.withColumn("metres", F.when(F.col("px").isNotNull() & ~F.isnan("px"), metres)).withColumn("interval_s", F.when(~F.isnan("interval_s"), F.col("interval_s")))
    return found.select("agent_id", "seq", "event_time", "interval_s", "metres", timefn.kmph(F.col("metres"), F.col("interval_s")).alias("kmph"))
