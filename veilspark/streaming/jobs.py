"""The job state machine over a stream of state events: illegal changes as they come, and jobs that fall silent while at work.

State per job is its last state and time. Events of a job are taken in time order within a batch; an event not later than the
last one taken is late and doesn't change the state. A job that is at work and says nothing for `silence` milliseconds of
event time is reported as INTERRUPTED once the watermark has passed that; only a retry (UPLOADED) or an end may follow. With a checkpoint a
restarted stream goes on where it was and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark.operators.reports import ACTIVE, EDGES, STATES

OUT = "job string, at_ms long, previous string, status string, problem string"


def _followed(silence: int):
    legal = frozenset(EDGES)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, at = state.get if state.exists else (None, -1)
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((key[0], at + silence, last, "INTERRUPTED", "silent"))
            last, at = "INTERRUPTED", at + silence
        else:
            rows = sorted((int(t), n, s) for part in parts for t, n, s in zip(part["at_ms"], part["n"], part["status"], strict=True))
            for t, _, status in rows:
                if t <= at:
                    out.append((key[0], t, last, status, "late"))
                    continue
                if status != last and (last, status) not in legal and not (last is None and status == STATES[0]):
                    out.append((key[0], t, last, status, "illegal"))
                last, at = status, t
        state.update((last, at))
        if last in ACTIVE:
            state.setTimeoutTimestamp(max(at + silence, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return run


def followed(events: DataFrame, silence: int = 600_000, lateness: str = "10 minutes") -> DataFrame:
    """Of a stream of events (job, at: timestamp, n: order among equal times, status), the problems: see OUT."""
    rows = events.withWatermark("at", lateness).select("job", "at", F.unix_millis("at").alias("at_ms"), "n", "status")
    return rows.groupBy("job").applyInPandasWithState(_followed(silence), OUT, "last string, at_ms long", "append", GroupStateTimeout.EventTimeTimeout)
