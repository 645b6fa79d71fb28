"""Streaming forms of the window and event operators: watermarks bound the state, late rows are dropped."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(events: DataFrame, time: str, length: str, by: Sequence[str] = (), late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts of tumbling (or sliding) windows."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    got = events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("count"))
    return got.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "count")


def sessions(events: DataFrame, time: str, gap: str, by: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Islands of events no further apart than `gap`."""
    got = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("count"))
    return got.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "count")


def value_runs(events: DataFrame, key: str, time: str, value: str, late: str = "10 minutes", timeout_ms: int = 600_000) -> DataFrame:
    """Run-length encoding of a discrete series: a row when a run of one value ends. State is one open run a key; it closes after a silence."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            v, a, b, n = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "cat": [v], "start": [a], "stop": [b], "count": [n]})
            return
        now = state.get if state.exists else None
        for pdf in parts:
            for t, v in pdf.sort_values(time)[[time, value]].itertuples(index=False):
                if now is not None and now[0] == v:
                    now = (v, now[1], max(now[2], t), now[3] + 1)
                else:
                    if now is not None:
                        out.append(now)
                    now = (v, t, t, 1)
        if now is not None:
            state.update(now)
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({key: [k[0]] * len(out), "cat": [o[0] for o in out], "start": [o[1] for o in out], "stop": [o[2] for o in out], "count": [o[3] for o in out]})

    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, cat string, start timestamp, stop timestamp, count long"
    return events.groupBy(key).applyInPandasWithState(run, out, "v string, a timestamp, b timestamp, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
