"""Size-dependent sessions and moving averages over streams, by state for each key.

Extension: the batch operators in framewright.operators.sessions and .learn are the measure; on
a stream in time order (for each key, within the watermark) the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framewright.operators.sessions import LEAST, LONG_GAP, SHORT_GAP

OUT = "user_id long, session long, n long, first_event long, last_event long"
STATE = "session long, n long, first_event long, last_event long, end double"


def bracket_stream(
    events: DataFrame, delay: str = "1 hour", least: int = LEAST, long_gap: float = LONG_GAP, short_gap: float = SHORT_GAP
) -> DataFrame:
    """Closed sessions of ``least`` records or more from a stream (user_id, event_id, ts, value),
    value being a record's duration in seconds."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        done = []
        if state.hasTimedOut:
            state.remove()
            if now and now[1] >= least:
                yield pd.DataFrame([(key[0], *now[:4])], columns=["user_id", "session", "n", "first_event", "last_event"])
            return
        rows = pd.concat(list(batches)).sort_values(["seconds", "event_id"])
        for r in rows.itertuples():
            gap = None if now is None else r.seconds - now[4]
            if now is not None and gap <= long_gap and not (now[1] >= least and gap > short_gap):
                now[1:] = [now[1] + 1, now[2], r.event_id, r.seconds + r.value]
            else:
                if now is not None and now[1] >= least:
                    done.append((key[0], *now[:4]))
                now = [0 if now is None else now[0] + 1, 1, r.event_id, r.event_id, r.seconds + r.value]
        state.update(tuple(now))
        state.setTimeoutTimestamp(int(max(now[4] + long_gap, state.getCurrentWatermarkMs() / 1000 + 1) * 1000))
        if done:
            yield pd.DataFrame(done, columns=["user_id", "session", "n", "first_event", "last_event"])

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (
        timed.withColumn("seconds", F.unix_micros("ts") / F.lit(1e6))
        .groupBy("user_id")
        .applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def count_stream(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Windowed counts by type, with late rows dropped after ``delay``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
