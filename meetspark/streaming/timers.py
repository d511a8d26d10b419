"""Streams whose state ends by event time: stalled and expired jobs, request limits, chapters in order of time.

All take a column ``ts`` and a tolerance ``late``: the watermark stands that far behind the newest row, timers fire when it passes them, and
rows that come behind it are dropped and counted by Spark (``numRowsDroppedByWatermark``). State that a timer has ended is removed, so it
never grows with the jobs or clients seen.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import ORPHANED

_EVENT_TIME = GroupStateTimeout.EventTimeTimeout


def _ms(times: pd.Series) -> list[int]:
    return (pd.to_datetime(times).astype("datetime64[us]").astype("int64") // 1000).tolist()


def _seconds(length: str) -> float:
    return pd.Timedelta(length).total_seconds()


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def stream_stalled(events: DataFrame, timeout: str = "30 minutes", late: str = "10 minutes", ends: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """A failure event ``job_id, stage, status, pct, message, ts`` for every job of ``events(job_id, ts, status)`` that has been without an event
    for ``timeout`` of event time, at the time it ran out. A job whose latest event has one of the statuses ``ends`` is over and
    gives none; one that goes on after a failure is watched anew."""
    wait = int(1000 * _seconds(timeout))

    def step(key, frames, state: GroupState):
        out = []
        if state.hasTimedOut:
            out.append((key[0], "worker", "failed", 0, ORPHANED, _time(state.get[0] + wait)))
            state.remove()
        else:
            last, status = state.get if state.exists else (-1, "")
            for rows in frames:
                for at, s in sorted(zip(_ms(rows.ts), rows.status.fillna("").tolist(), strict=True)):
                    if at >= last:
                        last, status = at, s
            if status in ends:
                if state.exists:
                    state.remove()
            else:
                state.update((last, status))
                state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "stage", "status", "pct", "message", "ts"])

    keyed = events.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", late).groupBy("job_id")
    kind = events.schema["job_id"].dataType.simpleString()
    return keyed.applyInPandasWithState(step, f"job_id {kind}, stage string, status string, pct int, message string, ts timestamp", "last long, status string", "append", _EVENT_TIME)


def stream_expired(jobs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``job_id, expires_at`` of ``jobs(job_id, ts, expires_at)`` once event time reaches ``expires_at``; a later row of a job moves it."""

    def step(key, frames, state: GroupState):
        out = []
        if state.hasTimedOut:
            out.append((key[0], _time(state.get[1])))
            state.remove()
        else:
            held = state.get if state.exists else (-1, 0)
            for rows in frames:
                held = max([held, *zip(_ms(rows.ts), _ms(rows.expires_at), strict=True)], key=lambda x: x[0])
            state.update(held)
            state.setTimeoutTimestamp(max(held[1], state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["job_id", "expires_at"])

    keyed = jobs.select("job_id", F.col("ts").cast("timestamp").alias("ts"), F.col("expires_at").cast("timestamp").alias("expires_at")).filter("expires_at IS NOT NULL").withWatermark("ts", late).groupBy("job_id")
    kind = jobs.schema["job_id"].dataType.simpleString()
    return keyed.applyInPandasWithState(step, f"job_id {kind}, expires_at timestamp", "seen long, expires long", "append", _EVENT_TIME)


def stream_rate_limit(requests: DataFrame, cap: int = 5, window: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    """``client, ord, n_before, exceeded`` of ``requests(client, ord, ts)`` as they arrive: requests of the client at most ``window`` older, up to
    ``cap`` counted exactly (``n_before`` goes no higher).

    State is the list of a client's request times that a row within the tolerance can still count; what is older goes with every row
    and the rest when event time has passed. Requests of one batch go by time, then ord; a row that comes late counts what has come by then.
    """
    span = int(1_000_000 * _seconds(window))
    slack = int(1_000_000 * _seconds(late))

    def step(key, frames, state: GroupState):
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            held = list(state.get[0]) if state.exists else []
            rows = pd.concat(list(frames))
            times = pd.to_datetime(rows.ts).astype("datetime64[us]").astype("int64").tolist()
            for at, ord_ in sorted(zip(times, rows.ord.tolist(), strict=True)):
                n = min(cap, bisect.bisect_right(held, at) - bisect.bisect_left(held, at - span))
                out.append((key[0], ord_, n, n >= cap))
                bisect.insort(held, at)
            # older than every window to come, or beyond the cap of every one
            held = held[bisect.bisect_left(held, held[-1] - slack - span) :]
            settled = bisect.bisect_left(held, held[-1] - slack)
            held = held[max(0, settled - cap) :]
            state.update((held,))
            state.setTimeoutTimestamp(max((held[-1] + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client", "ord", "n_before", "exceeded"])

    keyed = requests.select("client", "ord", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late).groupBy("client")
    kind = requests.schema["client"].dataType.simpleString()
    return keyed.applyInPandasWithState(step, f"client {kind}, ord long, n_before long, exceeded boolean", "times array<long>", "append", _EVENT_TIME)


class _Chapters:
    """Chapters of one job's units in order: one that grows, and one that waits for short ones behind it."""

    def __init__(self, held: tuple, threshold: float, cap: float, least: float):
        self.threshold, self.cap, self.least = threshold, cap, least
        self.chapter, self.n, self.start, self.end, self.weight, self.mean, self.waits, self.w_start, self.w_end, self.w_n = held
        self.mean, self.out = np.asarray(self.mean, float), []

    def state(self) -> tuple:
        return self.chapter, self.n, self.start, self.end, self.weight, self.mean.tolist(), self.waits, self.w_start, self.w_end, self.w_n

    def add(self, start: float, end: float, words: int, vector: np.ndarray) -> None:
        words, norm, size = max(words, 1), float(np.linalg.norm(vector)), float(np.linalg.norm(self.mean))
        near = float(self.mean @ vector) / (size * norm) if self.n and size * norm > 0 else 0.0
        if self.n and near >= self.threshold and end - self.start <= self.cap:
            mixed = (self.mean * self.weight + vector * words) / (self.weight + words)
            size = float(np.linalg.norm(mixed))
            self.mean, self.weight, self.n, self.end = mixed / size if size else mixed, self.weight + words, self.n + 1, max(self.end, end)
            return
        self._close()
        self.mean, self.weight, self.n, self.start, self.end = vector, words, 1, start, end

    def _close(self) -> None:
        if not self.n:
            return
        if self.waits and (self.end - self.start < self.least or self.chapter == 0 and self.w_end - self.w_start < self.least):
            self.w_end, self.w_n = self.end, self.w_n + self.n
            return
        self._emit()
        self.waits, self.w_start, self.w_end, self.w_n = True, self.start, self.end, self.n

    def _emit(self) -> None:
        if self.waits:
            self.out.append((self.chapter, self.w_start, self.w_end, self.w_n))
            self.chapter += 1

    def finish(self) -> None:
        self._close()
        self._emit()


_NO_CHAPTER = (0, 0, 0.0, 0.0, 0, [], False, 0.0, 0.0, 0)


def stream_chapters_in_time(units: DataFrame, threshold: float = 0.7, cap: float = 180.0, least: float = 5.0, late: str = "2 minutes") -> DataFrame:
    """Chapters ``job_id, chapter, start, end, n_units`` of ``units(job_id, ts, unit, start, end, words, vector, last)`` that may arrive in any order within
    ``late``: the same as ``merge_similar_units`` and ``absorb_short_units`` give over the whole job.

    Units wait in state until the watermark has passed their ``ts`` (which must grow with ``unit``), or all units up to the one marked
    ``last`` are there. A chapter is given out once the one after it is found to be long enough not to be taken into it. State per job is the
    chapter that grows, the one that waits and the units within ``late``; it goes with the end of the job.
    """

    def step(key, frames, state: GroupState):
        *held, done, unit, start, end, words, at, size, flat, final = state.get if state.exists else (*_NO_CHAPTER, 0, [], [], [], [], [], [], [], -1)
        chapters = _Chapters(tuple(held), threshold, cap, least)
        bounds = np.cumsum([0, *size])
        waiting = [(*x, np.asarray(flat[bounds[i] : bounds[i + 1]], float)) for i, x in enumerate(zip(unit, start, end, words, at, strict=True))]
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for rows in frames:
                for u, s, e, w, t, v, z in zip(rows.unit, rows.start, rows.end, rows.words, _ms(rows.ts), rows.vector, rows["last"], strict=True):
                    waiting.append((int(u), float(s), float(e), int(w), t, np.asarray(v, float)))
                    final = int(u) if z else final
        waiting.sort(key=lambda x: x[0])
        whole = final >= 0 and done + len(waiting) == final + 1
        ready = [x for x in waiting if whole or x[4] <= mark]
        for u, s, e, w, _, v in ready:
            chapters.add(s, e, w, v)
        done, waiting = done + len(ready), [x for x in waiting if not whole and x[4] > mark]
        if final >= 0 and not waiting and (whole or any(x[0] == final for x in ready)):
            chapters.finish()
            if state.exists:
                state.remove()
        else:
            columns = list(zip(*(x[:5] for x in waiting), strict=True)) or [[]] * 5
            state.update((*chapters.state(), done, *(list(c) for c in columns), [len(x[5]) for x in waiting], [float(y) for x in waiting for y in x[5]], final))
            if waiting:
                state.setTimeoutTimestamp(max(min(x[4] for x in waiting), mark + 1))
        yield pd.DataFrame([(key[0], *x) for x in chapters.out], columns=["job_id", "chapter", "start", "end", "n_units"])

    keyed = units.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "unit", "start", "end", "words", "vector", F.coalesce("last", F.lit(False)).alias("last")).withWatermark("ts", late).groupBy("job_id")
    kind = units.schema["job_id"].dataType.simpleString()
    held = "chapter long, n long, c_start double, c_end double, weight long, mean array<double>, waits boolean, w_start double, w_end double, w_n long, done long"
    return keyed.applyInPandasWithState(step, f"job_id {kind}, chapter long, start double, end double, n_units long", f"{held}, unit array<long>, start array<double>, end array<double>, words array<long>, at array<long>, size array<int>, flat array<double>, final long", "append", _EVENT_TIME)
