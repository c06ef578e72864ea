"""Rolling-hour admission: at most so many admitted calls per key within the last hour.

Only admitted calls count. An entry stands until it is more than an hour old.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR_US = 3600 * 1_000_000


def fold(times: Iterable[int], admitted: Iterable[int], limit: int, window: int = HOUR_US) -> tuple[list[bool], list[int]]:
    """Verdict of every call, and the admitted calls that still count."""
    live, out = deque(admitted), []
    for t in times:
        while live and t - live[0] > window:
            live.popleft()
        ok = limit <= 0 or len(live) < limit
        out.append(ok)
        if ok and limit > 0:
            live.append(t)
    return out, list(live)


def admit(calls: DataFrame, limit: int = 40, window: int = HOUR_US) -> DataFrame:
    """Batch form: ``key, call_id, at_us, admitted``, each key's calls in order of time and id.

    Calls without a key or a time can be neither counted nor ordered and are left out.

    Calls are sorted within partitions and folded as they stream through, so a key's calls are
    never held together; what is held is its admitted calls of one hour, ``limit`` at most.
    """

    def run(batches):
        key, live = None, []
        for pdf in batches:
            verdicts = []
            for k, group in pdf.groupby("key", sort=False, dropna=False):
                live = live if k == key else []
                key = k
                got, live = fold(group["at_us"].tolist(), live, limit, window)
                verdicts += got
            yield pdf.assign(admitted=verdicts)

    dealt = calls.select("key", "call_id", "at_us").filter("key IS NOT NULL AND at_us IS NOT NULL")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "at_us", "call_id")
    return dealt.mapInPandas(run, "key bigint, call_id bigint, at_us bigint, admitted boolean")


def admit_stream(calls: DataFrame, limit: int = 40, window: int = HOUR_US) -> DataFrame:
    """Streaming form over ``key, call_id, at_us``: state is a key's admitted calls of the last hour; idle keys expire.

    A key's calls of one micro-batch are sorted together, so bound the batch by the source's rate. Calls without a key or a time are left out, as
    in :func:`admit`; a call that comes late, in a later batch, is judged then.
    """

    def run(key, batches, state):
        live = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at_us", "call_id"])
        got, live = fold(rows["at_us"].tolist(), live, limit, window)
        state.update((live,))
        state.setTimeoutDuration(2 * window // 1000)
        yield rows.assign(admitted=got)[["key", "call_id", "at_us", "admitted"]]

    return calls.select("key", "call_id", "at_us").filter("key IS NOT NULL AND at_us IS NOT NULL").groupBy("key").applyInPandasWithState(run, "key bigint, call_id bigint, at_us bigint, admitted boolean", "live array<bigint>", "append", "ProcessingTimeTimeout")


def calls_of(events: DataFrame) -> DataFrame:
    """Calls from an event table: user, event and time in microseconds."""
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("call_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
