"""Pipeline state kept by task over a stream of stage events, with timers for tasks that stand still."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.state import STAGES

#: Seconds without an event after which a task that isn't complete counts as stale.
STALE = 900
OUT = "task_id long, status string, failed_stage string, recover_from_stage string, events long, updated timestamp"


def task_states(events: DataFrame, late: str = "1 hour", stale: int = STALE) -> DataFrame:
    """Each task's state whenever its events (task_id, stage, status, ts, seq) change it, or time passes without any.

    What is kept of a task is, for each stage, its latest event by (ts, seq) and whether it ever succeeded, which stays so:
    late and repeated events change nothing that the whole log in order wouldn't. status is COMPLETE, FAILED, RUNNING, or
    STALE once the watermark is `stale` seconds beyond its last event; a later event makes it run again. Spark leaves out
    events older than the watermark, which is `late` behind the newest: a `late` as long as the log's disorder gives the end
    state of the whole log. Complete tasks are kept as well: a repeated task_id is answered from them. Events of unknown
    stages and null times are left out.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get) if state.exists else [[None] * len(STAGES), [False] * len(STAGES), 0, 0, ""]
        times, done, count, newest, told = [list(held[0]), list(held[1]), *held[2:]]
        for f in frames:
            for stage, status, ts, seq in zip(f["stage"], f["status"], f["ts"], f["seq"], strict=True):
                if stage not in STAGES or pd.isna(ts):
                    continue
                k, at = STAGES.index(stage), int(pd.Timestamp(ts).value // 1000)
                done[k] = done[k] or status == "SUCCESS"
                mark = f"{at:020d}|{int(seq):020d}|{status}"
                if times[k] is None or mark > times[k]:
                    count += times[k] is None or mark[:41] > times[k][:41]
                    times[k] = mark
                newest = max(newest, at)
        now = ["SUCCESS" if d else t.rsplit("|", 1)[1] if t else "PENDING" for t, d in zip(times, done, strict=True)]
        failed = next((s for s, x in zip(STAGES, now, strict=True) if x == "FAILED"), None)
        recover = next((s for s, x in zip(STAGES, now, strict=True) if x != "SUCCESS"), None)
        status = "COMPLETE" if recover is None else "STALE" if state.hasTimedOut else "FAILED" if failed else "RUNNING"
        mark = f"{status}|{failed}|{recover}|{newest}"
        state.update((times, done, count, newest, mark))
        if recover is not None and not state.hasTimedOut:
            state.setTimeoutTimestamp(max(newest // 1000 + stale * 1000, state.getCurrentWatermarkMs() + 1))
        if mark != told:
            yield pd.DataFrame({"task_id": [key[0]], "status": [status], "failed_stage": [failed], "recover_from_stage": [recover], "events": [count], "updated": [pd.Timestamp(newest, unit="us")]})

    kept = "times array<string>, done array<boolean>, count long, newest long, told string"
    return events.withWatermark("ts", late).groupBy("task_id").applyInPandasWithState(update, OUT, kept, "append", GroupStateTimeout.EventTimeTimeout)
