"""Live metrics with Structured Streaming. Rows more than ``late`` behind the newest are dropped by the watermark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.clustering import average_linkage


def segment_rates(events: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their total value per job and tumbling or sliding window of ``events(job_id, ts, value)``."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withWatermark("ts", late).groupBy("job_id", w.alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return out.select("job_id", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A pause longer than ``gap`` closes a session."""
    out = events.withWatermark("ts", late).groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("job_id", F.col("w.start").alias("from"), F.col("w.end").alias("to"), "n")


def latest_stage_sink(path: str):
    """A ``foreachBatch`` function that keeps the last event of each job and stage: each batch writes its own winners, and a
    reader takes the winner over batches, so a batch that is written again changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy("job_id", "stage").agg(F.max(F.struct("ts", "value")).alias("x"))
        last.select("job_id", "stage", "x.ts", "x.value").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def read_latest_stage(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path).groupBy("job_id", "stage").agg(F.max(F.struct("ts", "value")).alias("x"))
    return rows.select("job_id", "stage", "x.ts", "x.value")


def _idle(idle: str | None) -> tuple[int, str]:
    """Milliseconds and kind of a state's timeout. With one, a query goes on for good: it is for triggers that do, not for a single run over
    what is there."""
    if idle is None:
        return 0, GroupStateTimeout.NoTimeout
    return int(pd.Timedelta(idle).total_seconds() * 1000), GroupStateTimeout.ProcessingTimeTimeout


def _closing(rows: pd.DataFrame, state: tuple, max_gap: float, max_words: int) -> tuple[list[tuple], tuple]:
    """Units that a job's next segments close, and the open one after them: ``unit, first, start, end, words, speaker``."""
    unit, first, start, end, words, speaker = state
    out = []
    for r in rows.itertuples():
        fits = first >= 0 and words + r.words <= max_words and (speaker == r.speaker or r.start - end <= max_gap)
        if not fits:
            if first >= 0:
                out.append((unit, start, end, words))
                unit += 1
            first, start, words = int(r.ord), float(r.start), 0
        end, words, speaker = float(r.end), words + int(r.words), str(r.speaker)
    return out, (unit, first, start, end, words, speaker)


def stream_units(segments: DataFrame, max_gap: float = 2.0, max_words: int = 80, idle: str | None = None) -> DataFrame:
    """Units of ``segments(job_id, ord, start, end, words, speaker, last)`` as they close; ``last`` marks the end of a job.

    State per job is the open unit alone; it goes when the job ends, or when the job has been silent for ``idle``, if given, which closes its open
    unit. Segments of a job have to arrive in order; within a batch they are sorted.
    """
    milliseconds, timeout = _idle(idle)

    def step(key, frames, state: GroupState):
        held = state.get if state.exists else (0, -1, 0.0, 0.0, 0, "")
        rows = pd.concat(list(frames)) if not state.hasTimedOut else None
        out, ended = [], state.hasTimedOut
        if rows is not None:
            out, held = _closing(rows.sort_values("ord"), held, max_gap, max_words)
            ended = bool(rows["last"].any())
        if ended:
            unit, first, start, end, words, _ = held
            out += [(unit, start, end, words)] if first >= 0 else []
            if state.exists:
                state.remove()
        else:
            state.update(held)
            if milliseconds:
                state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["job_id", "unit", "start", "end", "words"])

    return segments.groupBy("job_id").applyInPandasWithState(step, "job_id long, unit long, start double, end double, words long", "unit long, first long, start double, end double, words long, speaker string", "append", timeout)


def stream_chapters(units: DataFrame, threshold: float = 0.7, cap: float = 180.0, idle: str | None = None) -> DataFrame:
    """Chapters ``job_id, chapter, start, end, n_units`` of ``units(job_id, unit, start, end, words, vector, last)`` as they close.

    A unit joins the open chapter while its cosine with the chapter's vector reaches ``threshold`` and the chapter stays within ``cap``
    seconds; the vector is the weighted mean, made a unit vector after each unit. Units of a job have to arrive in order
    (``timers.stream_chapters_in_time`` puts them in order). State per job is the open chapter: its bounds, weight and vector. It goes when the job ends or has been silent for ``idle``, if given.
    """
    milliseconds, timeout = _idle(idle)

    def step(key, frames, state: GroupState):
        chapter, n, start, end, weight, mean = state.get if state.exists else (0, 0, 0.0, 0.0, 0, [])
        out, ended = [], state.hasTimedOut
        for rows in [] if state.hasTimedOut else [pd.concat(list(frames)).sort_values("unit")]:
            for r in rows.itertuples():
                v, w = np.asarray(r.vector, float), max(int(r.words), 1)
                m = np.asarray(mean, float)
                near = float(m @ v / max(np.linalg.norm(m) * np.linalg.norm(v), 1e-12)) if n and len(m) == len(v) else -1.0
                if n and near >= threshold and r.end - start <= cap:
                    mixed = (m * weight + v * w) / (weight + w)
                    size = np.linalg.norm(mixed)
                    mean, weight, n, end = (mixed / size if size else mixed).tolist(), weight + w, n + 1, float(r.end)
                else:
                    if n:
                        out.append((chapter, start, end, n))
                        chapter += 1
                    mean, weight, n, start, end = v.tolist(), w, 1, float(r.start), float(r.end)
            ended = bool(rows["last"].any())
        if ended:
            out += [(chapter, start, end, n)] if n else []
            if state.exists:
                state.remove()
        else:
            state.update((chapter, n, start, end, weight, list(mean)))
            if milliseconds:
                state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["job_id", "chapter", "start", "end", "n_units"])

    return units.groupBy("job_id").applyInPandasWithState(step, "job_id long, chapter long, start double, end double, n_units long", "chapter long, n long, start double, end double, weight long, mean array<double>", "append", timeout)


def stream_gallery(windows: DataFrame, threshold: float = 0.85, idle: str | None = None) -> DataFrame:
    """Speakers ``job_id, ord, speaker`` of ``windows(job_id, ord, embedding, last)`` as they arrive, batch by batch.

    State per job is its gallery: of each speaker the number of windows and the unit mean. Windows within ``threshold`` of a speaker take the
    nearest; the others of a batch are clustered into new speakers; then the means are blended by count. The state goes when the job
    ends or has been silent for ``idle``, if given.
    """
    milliseconds, timeout = _idle(idle)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)

    def step(key, frames, state: GroupState):
        counts, flat = state.get if state.exists else ([], [])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["job_id", "ord", "speaker"])
            return
        rows = pd.concat(list(frames)).sort_values("ord")
        vectors = unit(np.stack(rows.embedding.to_numpy()).astype(float))
        counts = list(counts)
        means = np.asarray(flat, float).reshape(len(counts), -1) if counts else np.zeros((0, vectors.shape[1]))
        far = 1 - vectors @ means.T if counts else np.full((len(vectors), 1), np.inf)
        own = np.where(far.min(axis=1) <= threshold, far.argmin(axis=1), -1)
        rest = np.flatnonzero(own < 0)
        own[rest] = len(counts) + average_linkage(vectors[rest], threshold)
        for k in np.unique(own).tolist():
            mean, n = unit(vectors[own == k].mean(axis=0)), int((own == k).sum())
            if k < len(counts):
                means[k] = unit(means[k] * counts[k] + mean * n)
                counts[k] += n
            else:
                means, counts = np.vstack([means, mean]), [*counts, n]
        if rows["last"].any():
            if state.exists:
                state.remove()
        else:
            state.update((counts, means.ravel().tolist()))
            if milliseconds:
                state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame({"job_id": key[0], "ord": rows.ord.to_numpy(), "speaker": [f"SPEAKER_{k:02d}" for k in own]})

    return windows.groupBy("job_id").applyInPandasWithState(step, "job_id long, ord long, speaker string", "counts array<long>, means array<double>", "append", timeout)
