"""Plans to cut long recordings at pauses."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chapters import build_chapters
from .intervals import pauses as pauses_of
from .scan import sorted_scan


def propose_n_parts(df: DataFrame, least: float = 300.0, most: float = 900.0, target: float = 600.0) -> DataFrame:
    """Number of parts of ``df(job_id, duration)``: near ``target`` seconds each, within the bounds."""
    d = F.col("duration")
    lo = F.greatest(F.lit(2), F.ceil(d / most - 1e-3))
    hi = F.greatest(lo, F.floor(d / least + 1e-3))
    n = F.when(d < 2 * least, 1).otherwise(F.least(hi, F.greatest(lo, F.bround(d / target, 0).cast("long"))))
    return df.select("job_id", "duration", n.cast("long").alias("n_parts"))


def needs_split(df: DataFrame, least: float = 300.0) -> DataFrame:
    return df.select("job_id", "duration", (F.col("duration") >= 2 * least).alias("needs_split"))


def _milli(x: float) -> float:
    return math.copysign(math.floor(abs(1000 * x) + 0.5) / 1000, x)


def choose_cuts(plans: DataFrame, pauses: DataFrame, least: float = 300.0, most: float = 900.0, half_width: float = 120.0) -> DataFrame:
    """``job_id, ord, at, pause_start, pause_end, pause, ideal, offset``: the cuts of ``plans(job_id, duration, n_parts)``, left to right.

    Cut i must lie at least ``least`` after the cut before and leave ``least`` for every part still to come; within that, not more than
    ``most`` after the cut before. Of the ``pauses(job_id, start, end, duration)`` whose middle lies there and is no cut yet,
    the one with the best ``duration - 0.15 * distance`` to the ideal place wins if one is not further than ``half_width`` from it (ties: the
    earlier); else the longest there (ties: the nearer, the earlier); else the ideal place moved into the bounds, with no pause. Where
    the bounds leave no room the cut keeps ``least`` from the start and from the cut before and stays within the recording.

    A scan of a job's pauses that holds those between the bounds of the next cut.
    """

    def scan(rows: Iterator[tuple]) -> Iterable[tuple]:
        rows = iter(rows)
        ahead = next(rows)
        duration, n = ahead[0], ahead[1]
        near: deque = deque()
        last, mids = None, set()
        for i in range(1, n):
            ideal = duration / n * i
            earliest = least if last is None else last + least
            latest = min(duration - least * (n - i), max(most if last is None else last + most, earliest))
            while near and near[0][2] < earliest:
                near.popleft()
            while ahead is not None and ahead[4] is not None and ahead[4] <= latest:
                if ahead[4] >= earliest:
                    near.append((ahead[2], ahead[3], ahead[4], ahead[5]))
                ahead = next(rows, None)
            inside = [p for p in near if p[2] <= latest]
            close = [p for p in inside if p[2] not in mids and abs(p[2] - ideal) <= half_width]
            if close:
                best = max(close, key=lambda p: p[3] - 0.15 * abs(p[2] - ideal))
            elif inside:
                best = max(inside, key=lambda p: (p[3], -abs(p[2] - ideal)))
            else:
                if earliest > latest + 1e-6:
                    at = min(max(ideal, least), duration - least)
                    at = max(earliest, min(at, duration - 1e-3))
                else:
                    at = min(max(ideal, earliest), latest)
                best = (_milli(at),) * 3 + (0.0,)
            last = best[2]
            mids = {last} if best[3] else mids  # earlier cuts are out of bounds by now
            yield i - 1, last, best[0], best[1], best[3], _milli(ideal), _milli(last - ideal)

    middle = F.floor((F.round(1000 * F.col("start")) + F.round(1000 * F.col("end")) + 1) / 2) / 1000  # whole milliseconds, half up
    met = plans.filter("n_parts > 1").select("job_id", F.col("duration").alias("whole"), "n_parts").join(pauses.select("job_id", "start", "end", middle.alias("mid"), "duration"), "job_id", "left")
    names = ("at", "pause_start", "pause_end", "pause", "ideal", "offset")
    return sorted_scan(met.select("job_id", "whole", "n_parts", "start", "end", "mid", "duration"), ["mid", "start"], scan, {"ord": "long"} | dict.fromkeys(names, "double"))


def parts_from_cuts(cuts: DataFrame, durations: DataFrame) -> DataFrame:
    """Parts between 0, the cuts and the end."""
    edges = cuts.select("job_id", F.col("at").alias("start")).unionByName(durations.select("job_id", F.lit(0.0).alias("start")))
    w = Window.partitionBy("job_id").orderBy("start")
    out = edges.join(durations, "job_id").withColumn("ord", F.row_number().over(w) - 1).withColumn("end", F.coalesce(F.lead("start").over(w), F.col("duration")))
    return out.select("job_id", F.col("ord").cast("long").alias("ord"), F.format_string("part%02d", F.col("ord") + 1).alias("part_id"), "start", "end")


def coalesce_short_parts(parts: DataFrame, least: float) -> DataFrame:
    """A part shorter than ``least`` goes into the next one; a short last one into the one before. A scan that holds two parts."""

    def short(part: tuple) -> bool:
        return round(part[1] - part[0], 3) + 1e-9 < least

    def scan(rows: Iterator[tuple]) -> Iterable[tuple]:
        n, done, held = 0, None, None
        for start, end in rows:
            if held and short(held):
                held = held[0], end
                continue
            if done:
                yield n, f"part{n + 1:02d}", *done
                n += 1
            done, held = held, (start, end)
        if done and held and short(held):
            done, held = (done[0], held[1]), None
        for part in (done, held):
            if part:
                yield n, f"part{n + 1:02d}", *part
                n += 1

    return sorted_scan(parts.select("job_id", "start", "end"), ["start", "end"], scan, {"ord": "long", "part_id": "string", "start": "double", "end": "double"})


def cut_plan(durations: DataFrame, regions: DataFrame, least: float = 240.0, most: float = 360.0, target: float = 300.0, min_pause: float = 0.8, half_width: float = 90.0, top: int = 15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cuts, parts and one row of metrics for each job of ``durations(job_id, duration)`` with ``regions(job_id, ord, start, end)`` of speech.

    Cuts as ``choose_cuts``, kept where a part ends after short parts were merged. Metrics: ``job_id, duration, requested_n_parts, n_parts,
    n_pauses, min_part_sec, max_part_sec, spread_sec, all_in_range, top_pauses`` (the longest first). A job too short to
    be cut has one part and no cuts.
    """
    wanted = propose_n_parts(durations, least, most, target)
    found = pauses_of(regions, durations, min_pause)
    cuts = choose_cuts(wanted, found, least, most, half_width)
    parts = coalesce_short_parts(parts_from_cuts(cuts, durations), least)
    ends = parts.select("job_id", F.round("end", 3).alias("at"))
    left = cuts.join(ends, ["job_id", "at"], "left_semi")
    left = left.withColumn("ord", (F.row_number().over(Window.partitionBy("job_id").orderBy("at")) - 1).cast("long"))
    sec = F.round(F.col("end") - F.col("start"), 3)
    of_parts = parts.groupBy("job_id").agg(F.count("*").alias("n_parts"), F.min(sec).alias("min_part_sec"), F.max(sec).alias("max_part_sec"), F.round(F.max(sec) - F.min(sec), 3).alias("spread_sec"), F.bool_and(sec.between(least, most)).alias("all_in_range"))
    long = cut_metrics(found, top).groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "mid", "duration"))), lambda x: F.struct(x["mid"].alias("mid"), x["duration"].alias("duration"))).alias("top_pauses"))
    counts = found.groupBy("job_id").agg(F.count("*").alias("n_pauses"))
    metrics = wanted.withColumnRenamed("n_parts", "requested_n_parts").join(of_parts, "job_id").join(counts, "job_id", "left").join(long, "job_id", "left")
    metrics = metrics.select("job_id", "duration", "requested_n_parts", "n_parts", F.coalesce("n_pauses", F.lit(0).cast("long")).alias("n_pauses"), "min_part_sec", "max_part_sec", "spread_sec", "all_in_range", "top_pauses")
    return left, parts, metrics


def cut_metrics(pauses: DataFrame, top: int = 15) -> DataFrame:
    """The ``top`` longest pauses of each job."""
    w = Window.partitionBy("job_id").orderBy(F.desc("duration"), "mid")
    return pauses.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("job_id", F.col("rank").cast("long").alias("rank"), "mid", "duration")


def merge_parts(parts: DataFrame, segments: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and chapters with times and ids of their part, as those of the whole job.

    ``parts(job_id, part_id, start)``; ``segments(job_id, part_id, ord, segment_id, start, end)``; ``chapters(job_id, part_id, ord,
    start, end, source_ids)``. Segments and chapters are numbered in order of the parts' starts and of place; source ids follow.
    """
    at = parts.select("job_id", "part_id", F.col("start").alias("shift"))
    w = Window.partitionBy("job_id").orderBy("shift", "part_id", "ord")

    def moved(df: DataFrame) -> DataFrame:
        return df.join(at, ["job_id", "part_id"]).withColumn("n", F.row_number().over(w)).withColumn("start", F.round(F.col("start") + F.col("shift"), 3)).withColumn("end", F.round(F.col("end") + F.col("shift"), 3))

    numbered = moved(segments).withColumn("new_id", F.format_string("s%04d", "n"))
    sources = chapters.select("job_id", "part_id", "ord", F.posexplode("source_ids").alias("pos", "segment_id")).join(numbered.select("job_id", "part_id", "segment_id", "new_id"), ["job_id", "part_id", "segment_id"])
    lists = sources.groupBy("job_id", "part_id", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new_id"))), lambda x: x["new_id"]).alias("source_ids"))
    whole = moved(chapters.drop("source_ids")).join(lists, ["job_id", "part_id", "ord"], "left")
    out = numbered.select("job_id", "part_id", F.col("n").cast("long").alias("ord"), F.col("new_id").alias("segment_id"), "start", "end")
    return out, whole.select("job_id", "part_id", (F.col("n") - 1).cast("long").alias("ord"), F.format_string("C%02d", F.col("n") - 1).alias("chapter_id"), "start", "end", "source_ids")


def merge_parts_continuous(parts: DataFrame, segments: DataFrame, vectors: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """Like ``merge_parts``, with chapters that go on over the edges of parts: ``segments`` also have ``speaker, text``, and the chapters are built
    (``build_chapters``, with its ``limits``) over the job's segments in their new order, so that what is open at the end of a part, a piece,
    a unit or a chapter, is carried into the next. ``vectors(job_id, unit, vector)`` are those of the whole job's units.

    A part without segments or text carries what is open through; a job of one part has the chapters of that part.
    """
    none = segments.select("job_id", "part_id", "ord", "start", "end", F.array().cast("array<string>").alias("source_ids")).limit(0)
    merged, _ = merge_parts(parts, segments, none)
    first = parts.select("job_id", "part_id", F.col("start").alias("shift"))
    old = segments.join(first, ["job_id", "part_id"])
    number = F.row_number().over(Window.partitionBy("job_id").orderBy("shift", "part_id", "ord"))
    said = old.select("job_id", number.cast("long").alias("ord"), "speaker", "text")
    whole = merged.join(said, ["job_id", "ord"])
    return whole, build_chapters(whole, vectors, **limits)


def merge_blocks(merged: DataFrame, segments: DataFrame) -> DataFrame:
    """``job_id, n_merged, n_expected, count_match, blocks_kept``: whether every segment of every part is in the merged job, and each part's are one block
    of neighbours."""
    runs = F.lag("part_id").over(Window.partitionBy("job_id").orderBy("ord"))
    seen = merged.withColumn("new", F.when(runs.eqNullSafe(F.col("part_id")), 0).otherwise(1)).groupBy("job_id").agg(F.count("*").alias("n_merged"), F.sum("new").alias("blocks"), F.countDistinct("part_id").alias("parts"))
    want = segments.groupBy("job_id").agg(F.count("*").alias("n_expected"))
    out = want.join(seen, "job_id", "left").withColumn("n_merged", F.coalesce("n_merged", F.lit(0).cast("long")))
    return out.select("job_id", "n_merged", "n_expected", (F.col("n_merged") == F.col("n_expected")).alias("count_match"), F.coalesce(F.col("blocks") == F.col("parts"), F.lit(False)).alias("blocks_kept"))


def validate_merge(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Per job: segments, segments that start before the one in front, and segments that no chapter or several have."""
    used = chapters.select("job_id", F.explode("source_ids").alias("segment_id")).groupBy("job_id", "segment_id").agg(F.count("*").alias("uses"))
    prev = F.lag("start").over(Window.partitionBy("job_id").orderBy("ord"))
    met = segments.withColumn("prev", prev).join(used, ["job_id", "segment_id"], "left")
    out = met.groupBy("job_id").agg(F.count("*").alias("n_segments"), F.count(F.when(F.col("start") < F.col("prev"), 1)).alias("n_back"), F.count(F.when(F.coalesce("uses", F.lit(0)) != 1, 1)).alias("n_not_once"))
    return out.withColumn("ok", (F.col("n_back") == 0) & (F.col("n_not_once") == 0))
