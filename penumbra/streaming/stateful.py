"""Operators with state by key: a sliding rate limit, newest revisions, and streaming windows.

The windows are an addition for Structured Streaming and have no counterpart among the batch
operators.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(requests: DataFrame, key: str, time: str, tie: str, limit: int, seconds: float) -> DataFrame:
    """The requests ``key, time (seconds), tie`` with ``accepted``: fewer than ``limit`` were accepted in the
    ``seconds`` before. Rejected requests don't count.

    Rows arrive sorted by key, and a task keeps the last accepted times of one key only, so a hot key
    needs no more memory than another.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for frame in frames:
            out = []
            for k, t in zip(frame[key], frame[time], strict=True):
                if k != current:
                    current, recent = k, deque()
                while recent and recent[0] <= t - seconds:
                    recent.popleft()
                if free := len(recent) < limit:
                    recent.append(t)
                out.append(free)
            yield frame.assign(accepted=out)

    rows = requests.select(key, time, tie).where(F.col(key).isNotNull())
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", accepted boolean"
    return rows.repartition(F.col(key)).sortWithinPartitions(key, time, tie).mapInPandas(run, schema)


def rate_limited_stream(requests: DataFrame, key: str, time: str, limit: int, seconds: float) -> DataFrame:
    """The same rule over a stream: the state of a key is the times accepted in the window."""
    kind = dict(requests.dtypes)[key]

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        out = []
        for t in rows[time]:
            recent = [r for r in recent if r > t - seconds]
            out.append(len(recent) < limit)
            if out[-1]:
                recent.append(float(t))
        state.update((recent,))
        yield pd.DataFrame({key: [k[0]] * len(out), time: rows[time].to_numpy(), "accepted": out})

    return (
        requests.select(key, time)
        .groupBy(key)
        .applyInPandasWithState(run, f"{key} {kind}, {time} double, accepted boolean", "recent array<double>", "append", GroupStateTimeout.NoTimeout)
    )


def newest_revision(jobs: DataFrame, job: str, revision: str) -> DataFrame:
    """Each job's highest revision; a repeated submission of one revision counts once."""
    top = jobs.groupBy(job).agg(F.max(revision).alias(revision))
    return jobs.join(top, [job, revision], "left_semi").dropDuplicates([job, revision])


def event_windows(events: DataFrame, time: str, value: Column, keys: list[str], width: str, slide: str, late: str) -> DataFrame:
    """Counts and sums by sliding event-time window, rows later than ``late`` being dropped by the watermark."""
    return (
        events.withWatermark(time, late)
        .groupBy(F.window(time, width, slide), *keys)
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")
    )
