"""Structured Streaming forms of the append-only records and expiring state.

The record itself never expires; bounded state needs a watermark, which is an addition here and named where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpie.operators.origin import MARK_FIRST_S, MARK_MOST_S


def latest_snapshots(lines: DataFrame, key: str = "stem", time: str = "ts") -> DataFrame:
    """The newest snapshot of every process (update mode); late ones never replace a newer one."""
    rest = [c for c in lines.columns if c != key]
    return lines.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(time)).alias("s")).select(key, "s.*")


def run_ends(files: DataFrame) -> DataFrame:
    """The end of every run as its records arrive, however late."""
    return files.groupBy("stem").agg(F.max("ts").alias("end_s"))


def hold_sessions(refreshes: DataFrame, gap: str = "20 minutes", late: str = "1 day") -> DataFrame:
    """Holds of (file, pid) as sessions; the watermark bounds the state and drops what is later than ``late``."""
    rows = refreshes.withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "file", "pid").agg(F.count("*").alias("refreshes")).select("file", "pid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "refreshes")


MARKS = "server string, count int, last_s long, until_s long"
MARK_STATE = "count int, last_s long, until_s long"


#: Milliseconds for which state is kept after it can matter: marks after their end, processes after their last sample.
KEPT_MS = 86_400_000


def source_marks(events: DataFrame) -> DataFrame:
    """Marks of servers from (server, at_s, ok): a failure doubles the mark, a success drops it; update mode.

    A mark is forgotten with its count a day after its end, and at once after a success, so the state is bounded by the
    servers that failed lately.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, last, until = state.get if state.exists else (0, 0, 0)
        for at, ok in sorted((int(a), bool(o)) for b in batches for a, o in zip(b["at_s"], b["ok"])):
            if ok:
                count, until = 0, 0
            else:
                count, last = count + 1, at
                until = at + min(MARK_MOST_S, MARK_FIRST_S * 2 ** min(count - 1, 20))
        if count:
            state.update((count, last, until))
            state.setTimeoutDuration(1000 * (until - last) + KEPT_MS)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"server": [key[0]], "count": [count], "last_s": [last], "until_s": [until]})

    return events.groupBy("server").applyInPandasWithState(step, MARKS, MARK_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


PEAKS = "process string, peak double"
PEAK_STATE = "wall double, cpu double, peak double"


def peak_cores(samples: DataFrame) -> DataFrame:
    """Peak of CPU time over wall time between samples at least a second apart, per process; update mode.

    A process that has sent nothing for a day is over, and its state goes.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        wall, cpu, peak = state.get if state.exists else (None, None, 0.0)
        for w, c in sorted((float(a), float(b_)) for b in batches for a, b_ in zip(b["wall_s"], b["cpu_s"])):
            if wall is None:
                wall, cpu = w, c
            elif w - wall >= 1.0:
                peak = max(peak, (c - cpu) / (w - wall))
                wall, cpu = w, c
        state.update((wall, cpu, peak))
        state.setTimeoutDuration(KEPT_MS)
        yield pd.DataFrame({"process": [key[0]], "peak": [peak]})

    return samples.groupBy("process").applyInPandasWithState(step, PEAKS, PEAK_STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def paced(rows: DataFrame, seconds: int) -> DataStreamWriter:
    """A writer that looks at its stream at most once in so many seconds, as checks for eviction and sweeps do."""
    return rows.writeStream.trigger(processingTime=f"{seconds} seconds")


def observed(df: DataFrame, name: str, dropped: str) -> DataFrame:
    """Counts rows and drops as metrics of the stream."""
    return df.observe(name, F.count("*").alias("rows"), F.count_if(F.col(dropped)).alias("dropped"))
