"""Interval algebra per ``job_id``: gaps and islands, cover, overlap. Every join has ``job_id`` as its equality key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running
from .scan import sorted_scan

_ORDER = ["start", "end", "ord"]
_FRAMES = 6000  # of a slice


def _with_reach(df: DataFrame) -> DataFrame:
    """With ``reach``, the largest end before the row in order of start."""
    return running(df, _ORDER, {"reach": ("max_before", F.col("end"))})


def interval_join(a: DataFrame, b: DataFrame, a_span: tuple[Column, Column], b_span: tuple[Column, Column], slice_sec: float = 60.0) -> DataFrame:
    """Rows of ``a`` and ``b`` of one job whose spans ``[from, to]`` meet, each pair once.

    Both sides are cut at every ``slice_sec`` seconds and joined on job and slice, so a long job is many small groups. A pair
    counts in the later of their first slices. Columns of ``b`` beside ``job_id`` must have names of their own.
    """
    first = lambda span: F.floor(span[0] / slice_sec)
    every = lambda span: F.explode(F.sequence(first(span), F.greatest(F.floor(span[1] / slice_sec), first(span))))
    left = a.select("*", first(a_span).alias("__fa"), a_span[0].alias("__a0"), a_span[1].alias("__a1"), every(a_span).alias("__k"))
    right = b.select("*", first(b_span).alias("__fb"), b_span[0].alias("__b0"), b_span[1].alias("__b1"), every(b_span).alias("__k"))
    met = left.join(right, ["job_id", "__k"]).filter("__k = greatest(__fa, __fb) AND __a0 <= __b1 AND __b0 <= __a1")
    return met.drop("__k", "__fa", "__fb", "__a0", "__a1", "__b0", "__b1")


def merge_regions(df: DataFrame, max_gap: float = 0.0, min_dur: float = 0.0) -> DataFrame:
    """Join regions not more than ``max_gap`` apart (against the furthest end so far); drop short ones afterwards.

    Rows that open a region are kept with the furthest end before them, which is where the region before ends; a job is never sorted
    whole.
    """
    ends = df.groupBy("job_id").agg(F.max("end").alias("last"))
    opens = _with_reach(df.select("job_id", *_ORDER)).filter(F.col("reach").isNull() | (F.col("start") - F.col("reach") > max_gap))
    paired = running(opens.drop("end"), ["start", "ord"], {"closed": ("next", F.col("reach"))}).join(ends, "job_id")
    islands = paired.select("job_id", "start", F.coalesce("closed", "last").alias("end"))
    if min_dur > 0:
        islands = islands.filter(F.col("end") - F.col("start") >= min_dur)
    return running(islands, ["start"], {"n": ("sum", F.lit(1))}).select("job_id", (F.col("n") - 1).cast("long").alias("ord"), "start", "end")


def interval_union(df: DataFrame, eps: float = 0.0) -> DataFrame:
    """Union of the non-empty intervals; intervals that touch merge."""
    return merge_regions(df.filter(F.col("end") > F.col("start")), eps)


def covered_sec(df: DataFrame) -> DataFrame:
    """Seconds of the union: of each interval what lies beyond the furthest end before it."""
    rows = _with_reach(df.filter(F.col("end") > F.col("start")).select("job_id", *_ORDER))
    new = F.greatest(F.col("end") - F.greatest("start", "reach"), F.lit(0.0))
    return rows.groupBy("job_id").agg(F.round(F.sum(new), 3).alias("covered_sec"))


def intersection_sec(a: DataFrame, b: DataFrame) -> DataFrame:
    """Seconds in both unions, by one sweep over the boundaries instead of a range join; a side is in where any of its intervals is open."""
    events = None
    for side, df in (("a", a), ("b", b)):
        real = df.filter(F.col("end") > F.col("start"))
        for col, step in (("start", 1), ("end", -1)):
            part = real.select("job_id", F.col(col).alias("t"), F.lit(step if side == "a" else 0).alias("a"), F.lit(step if side == "b" else 0).alias("b"))
            events = part if events is None else events.unionByName(part)
    at = events.groupBy("job_id", "t").agg(F.sum("a").alias("da"), F.sum("b").alias("db"))
    open_ = running(at, ["t"], {"a": ("sum", F.col("da")), "b": ("sum", F.col("db")), "after": ("next", F.col("t"))}, at="t").withColumn("dt", F.col("after") - F.col("t"))
    sec = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, F.col("dt"))), F.lit(0.0)), 3)
    on_a, on_b = F.col("a") > 0, F.col("b") > 0
    return open_.groupBy("job_id").agg(sec(on_a & on_b).alias("both_sec"), sec(on_a & ~on_b).alias("only_a_sec"), sec(on_b & ~on_a).alias("only_b_sec"), sec(on_a | on_b).alias("any_sec"))


def speech_iou(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """Seconds in both over seconds in either; 0 where either has seconds but none in common."""
    return intersection_sec(ref, hyp).select("job_id", F.round(F.when(F.col("any_sec") > 0, F.col("both_sec") / F.col("any_sec")).otherwise(1.0), 6).alias("iou"))


def find_holes(df: DataFrame, durations: DataFrame | None = None, min_hole: float = 0.5) -> DataFrame:
    """Gaps of ``min_hole`` or more before, between and (with ``durations(job_id, duration)``) after the intervals."""
    rows = df.filter(F.col("end") > F.col("start")).select("job_id", *_ORDER)
    if durations is not None:  # the end of a recording counts as a row after all others
        far = F.greatest(F.max("start").alias("s"), F.max("duration"))
        ends = rows.select("job_id", "start", F.lit(None).cast("double").alias("duration")).unionByName(durations.select("job_id", F.lit(None).cast("double").alias("start"), F.col("duration").cast("double").alias("duration")))
        ends = ends.groupBy("job_id").agg(far.alias("start"), F.max("duration").alias("close")).filter("close IS NOT NULL")
        rows = rows.withColumn("close", F.lit(None).cast("double")).unionByName(ends.select("job_id", "start", F.lit(float("inf")).alias("end"), F.lit(None).cast("long").alias("ord"), "close"))
    else:
        rows = rows.withColumn("close", F.lit(None).cast("double"))
    marked = _with_reach(rows).select("job_id", F.coalesce("reach", F.lit(0.0)).alias("reach"), F.coalesce("close", "start").alias("start"))
    gaps = marked.filter(F.col("start") - F.col("reach") >= min_hole)
    return gaps.select("job_id", F.round("reach", 3).alias("start"), F.round("start", 3).alias("end"))


def pauses(df: DataFrame, durations: DataFrame, min_pause: float = 0.3) -> DataFrame:
    """Holes with their length and middle."""
    found = find_holes(df, durations, min_pause)
    return found.withColumn("duration", F.round(F.col("end") - F.col("start"), 3)).withColumn("mid", F.round((F.col("start") + F.col("end")) / 2, 4))


def split_intervals(df: DataFrame, max_len: float = 25.0) -> DataFrame:
    """Slices of at most ``max_len`` seconds; the last is the remainder."""
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / max_len), F.lit(1)).cast("int")
    out = df.withColumn("slice", F.explode(F.sequence(F.lit(0), n - 1)))
    begin = F.col("start") + F.col("slice") * max_len
    out = out.withColumn("s", F.round(begin, 3)).withColumn("e", F.round(F.least(begin + max_len, F.col("end")), 3))
    return out.filter((n == 1) | (F.col("e") > F.col("s"))).select("job_id", "ord", "slice", "speaker", F.col("s").alias("start"), F.col("e").alias("end"))


def merge_same_speaker(df: DataFrame, max_gap: float = 0.3) -> DataFrame:
    """Join neighbours of one speaker not more than ``max_gap`` apart; speakers may overlap each other."""
    w = Window.partitionBy("job_id").orderBy("start", "ord")
    runs = df.withColumn("turned", F.when(F.lag("speaker").over(w).eqNullSafe(F.col("speaker")), 0).otherwise(1)).withColumn("run", F.sum("turned").over(w))
    inner = Window.partitionBy("job_id", "run").orderBy("start", "ord")
    reach = F.max("end").over(inner.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(reach.isNull() | (F.col("start") - reach > max_gap), 1).otherwise(0)).withColumn("island", F.sum("new").over(inner))
    out = runs.groupBy("job_id", "run", "island", "speaker").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("ord").alias("first"))
    return out.select("job_id", (F.row_number().over(Window.partitionBy("job_id").orderBy("run", "island")) - 1).cast("long").alias("ord"), "speaker", "start", "end")


def clip_turn_overlaps(df: DataFrame) -> DataFrame:
    """A turn ends where the next one starts, if that is inside it and later than its start."""
    nxt = F.lead("start").over(Window.partitionBy("job_id").orderBy("start", "ord"))
    return df.withColumn("end", F.when((nxt < F.col("end")) & (nxt > F.col("start")), nxt).otherwise(F.col("end")))


def absorb_short_turns(df: DataFrame, min_dur: float = 1.0) -> DataFrame:
    """One pass from the left: a turn below ``min_dur`` goes to its nearer neighbour (tie: the same speaker, else the left).

    A turn that waits lends its bounds to the next one. A scan that holds the last finished turn, the bounds that wait and one
    turn ahead.
    """

    def scan(rows: Iterator[tuple]) -> Iterable[tuple]:
        n, done, wait, first = 0, None, None, True
        for (start, _, end, speaker), after in pairwise(chain(rows, [None])):
            s, e = (start, end) if wait is None else (min(wait[0], start), max(wait[1], end))
            wait = None
            if e - s >= min_dur or (after is None and (first or done is None)):
                if done:
                    yield n, *done
                    n += 1
                done = speaker, s, e
            elif done and (after is None or s - done[2] < after[0] - e or (s - done[2] == after[0] - e and (done[0] == speaker or after[3] != speaker))):
                done = done[0], min(done[1], s), max(done[2], e)
            else:
                wait = s, e
            first = False
        if done:
            yield n, *done

    return sorted_scan(df.select("job_id", "start", "ord", "end", "speaker"), ["start", "ord"], scan, {"ord": "long", "speaker": "string", "start": "double", "end": "double"})


def merge_turns(df: DataFrame, max_gap: float = 0.3, min_dur: float = 1.0) -> DataFrame:
    """Merge, absorb, merge again; starts then never go back and every turn lasts a millisecond at least."""
    out = merge_same_speaker(absorb_short_turns(merge_same_speaker(df, max_gap), min_dur), max_gap)
    start = F.max("start").over(Window.partitionBy("job_id").orderBy("ord"))
    out = out.withColumn("start", F.round(start, 3)).withColumn("end", F.round(F.greatest(F.col("start") + 0.001, F.col("end")), 3))
    return out.withColumn("turn_id", F.format_string("t%04d", F.col("ord") + 1))


def embedding_windows(regions: DataFrame, win: float = 1.5, step: float = 0.75, least: float = 0.4) -> DataFrame:
    """Sliding windows over regions: the whole of a region up to ``win + step``, else full windows and a remainder."""
    dur = F.col("end") - F.col("start")
    full = F.floor((dur - win) / step + 1e-9).cast("int")
    spans = regions.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(dur <= win + step, 0).otherwise(full + 1))))
    begin = F.col("start") + F.col("k") * step
    spans = spans.withColumn("s", F.when(dur <= win + step, F.col("start")).otherwise(begin)).withColumn("e", F.when(dur <= win + step, F.col("end")).otherwise(F.least(begin + win, F.col("end"))))
    last = (dur > win + step) & (F.col("k") == full + 1)
    return spans.filter(~last | ((F.col("e") - F.col("s") >= least) & (F.col("start") + full * step + win < F.col("end")))).select("job_id", "ord", "k", F.round("s", 3).alias("start"), F.round("e", 3).alias("end"))


def speaker_at(points: DataFrame, turns: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Speaker of the first turn that holds the point ``mid``; the point's own where none does."""
    t = turns.select("job_id", F.col("start").alias("ts"), F.col("end").alias("te"), F.col("ord").alias("tord"), F.col("speaker").alias("found"))
    met = interval_join(points.select("job_id", "ord", "mid").distinct(), t, (F.col("mid"), F.col("mid")), (F.col("ts") - eps, F.col("te") + eps))
    found = met.groupBy("job_id", "ord", "mid").agg(F.min_by("found", "tord").alias("found"))
    return points.join(found, ["job_id", "ord", "mid"], "left").select("job_id", "ord", "mid", F.coalesce("found", "speaker").alias("speaker"))


def clip_to_part(regions: DataFrame, parts: DataFrame) -> DataFrame:
    """Regions cut to the parts of their job, in the part's own time."""
    p = parts.select("job_id", "part_id", F.col("start").alias("ps"), F.col("end").alias("pe"))
    met = interval_join(regions, p, (F.col("start"), F.col("end")), (F.col("ps"), F.col("pe"))).filter((F.col("start") < F.col("pe")) & (F.col("end") > F.col("ps")))
    met = met.select("job_id", "part_id", "ord", F.round(F.greatest("start", "ps") - F.col("ps"), 3).alias("start"), F.round(F.least("end", "pe") - F.col("ps"), 3).alias("end"))
    return met.filter(F.col("end") - F.col("start") > 1e-6)


def shift_part(df: DataFrame, parts: DataFrame) -> DataFrame:
    """From a part's own time back to the recording's; ids get the part's name in front."""
    p = parts.select("job_id", "part_id", F.col("start").alias("offset"))
    return df.join(p, ["job_id", "part_id"]).select("job_id", "part_id", F.concat_ws("_", "part_id", F.col("ord").cast("string")).alias("id"), F.round(F.col("start") + F.col("offset"), 3).alias("start"), F.round(F.col("end") + F.col("offset"), 3).alias("end"))


def slice_window(df: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows that reach into each part, with their texts in order and their number of speakers."""
    p = parts.select("job_id", "part_id", F.col("start").alias("ps"), F.col("end").alias("pe"))
    met = interval_join(df, p, (F.col("start"), F.col("end")), (F.col("ps"), F.col("pe"))).filter((F.col("start") < F.col("pe")) & (F.col("end") > F.col("ps")))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("ord", "text")))), lambda x: x["text"])
    return met.groupBy("job_id", "part_id").agg(F.count("*").alias("n"), F.countDistinct("speaker").alias("n_speakers"), F.array_join(texts, " ").alias("text_concat"))


def hysteresis_regions(frames: DataFrame, thr: float = 0.5, neg: float = 0.35, min_silence: int = 2, min_speech: int = 2, frame: float = 0.1, pad: float = 0.0) -> DataFrame:
    """Speech from frame probabilities: in at ``thr``, out once ``min_silence`` frames have passed since the first of a run below
    ``neg``, at that first one. Regions are widened by ``pad`` seconds, within the recording and not over the one before."""
    low = F.col("prob") < neg
    each = frames.select("job_id", "frame_idx", "prob")
    f = running(each, ["frame_idx"], {"high": ("last_known", F.when(~low, F.col("frame_idx")))}, at="frame_idx", width=_FRAMES)
    f = f.withColumn("low_from", F.coalesce(F.col("high") + 1, F.lit(0)))
    event = F.when(F.col("prob") >= thr, 1).when(low & (F.col("frame_idx") - F.col("low_from") >= min_silence), 0)
    events = f.select("job_id", "frame_idx", "low_from", event.alias("event")).filter("event IS NOT NULL")
    turns = running(events, ["frame_idx"], {"was": ("last_before", F.col("event"))}, at="frame_idx", width=_FRAMES).filter("event <> coalesce(was, 0)")
    closing = F.when(F.col("event") == 0, F.col("low_from"))
    total = frames.groupBy("job_id").agg((F.max("frame_idx") + 1).alias("n"))
    spans = running(turns, ["frame_idx"], {"b": ("next", closing)}, at="frame_idx", width=_FRAMES).filter("event = 1").join(total, "job_id")
    out = spans.select("job_id", F.col("frame_idx").alias("a"), F.coalesce("b", "n").alias("b"), "n").filter(F.col("b") - F.col("a") >= min_speech)
    out = out.withColumn("e", F.least(F.col("b") * frame + pad, F.col("n") * frame))
    out = running(out, ["a"], {"reach": ("max_before", F.col("e"))}, at="a", width=_FRAMES)
    out = out.withColumn("s", F.greatest(F.lit(0.0), F.col("a") * frame - pad, F.coalesce("reach", F.lit(0.0)))).filter("e > s")
    return running(out, ["a"], {"k": ("sum", F.lit(1))}, at="a", width=_FRAMES).select("job_id", (F.col("k") - 1).cast("long").alias("ord"), F.round("s", 3).alias("start"), F.round("e", 3).alias("end"))


def whole_file_region(durations: DataFrame) -> DataFrame:
    return durations.filter("duration > 0").select("job_id", F.lit(0).cast("long").alias("ord"), F.lit(0.0).alias("start"), F.col("duration").alias("end"))


def fill_holes_with_fallback(primary: DataFrame, secondary: DataFrame, durations: DataFrame, min_hole: float = 0.5) -> DataFrame:
    """Primary regions, and the parts of secondary ones inside the primary's holes, each with its origin."""
    holes = find_holes(primary, durations, min_hole).select("job_id", F.col("start").alias("hs"), F.col("end").alias("he"))
    inside = interval_join(secondary, holes, (F.col("start"), F.col("end")), (F.col("hs"), F.col("he"))).filter((F.col("start") < F.col("he")) & (F.col("end") > F.col("hs")))
    inside = inside.select("job_id", F.greatest("start", "hs").alias("start"), F.least("end", "he").alias("end"), F.lit("fallback").alias("origin"))
    return primary.select("job_id", "start", "end", F.lit("primary").alias("origin")).unionByName(inside)


def overlap_join(gold: DataFrame, hyp: DataFrame, pad: float = 0.0, least: float = 0.0) -> DataFrame:
    """For each gold row the hypothesis rows that overlap it by more than ``least`` (padded), their texts in order."""
    h = hyp.select("job_id", F.col("ord").alias("hord"), F.col("start").alias("hs"), F.col("end").alias("he"), F.col("text").alias("htext"))
    over = F.least("end", F.col("he") + pad) - F.greatest("start", F.col("hs") - pad)
    met = interval_join(gold, h, (F.col("start"), F.col("end")), (F.col("hs") - pad, F.col("he") + pad)).withColumn("over", over).filter(F.col("over") > least)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("hs", "hord", "htext"))), lambda x: x["htext"])
    return met.groupBy("job_id", "ord").agg(F.count("*").alias("n"), F.array_join(texts, " ").alias("hyp_text"))


def coverage_diff(df: DataFrame, systems: list[str]) -> DataFrame:
    """``df(job_id, system, start, end)``: for any two of a few named systems, seconds of the one outside and inside the other.

    ``other`` is ``*`` for all others together. One sweep over the boundaries with a counter for each system.
    """
    real = df.filter(F.col("end") > F.col("start")).filter(F.col("system").isin(systems))
    opens = real.select("job_id", "system", F.col("start").alias("t"), F.lit(1).alias("step"))
    closes = real.select("job_id", "system", F.col("end").alias("t"), F.lit(-1).alias("step"))
    steps = [F.sum(F.when(F.col("system") == s, F.col("step")).otherwise(0)).alias(f"n{i}") for i, s in enumerate(systems)]
    at = opens.unionByName(closes).groupBy("job_id", "t").agg(*steps)
    open_ = running(at, ["t"], {"after": ("next", F.col("t"))} | {f"open{i}": ("sum", F.col(f"n{i}")) for i in range(len(systems))}, at="t")
    open_ = open_.select("job_id", (F.col("after") - F.col("t")).alias("dt"), *((F.col(f"open{i}") > 0).alias(f"on{i}") for i in range(len(systems))))
    sec = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, F.col("dt"))), F.lit(0.0)), 3)
    cells = []
    for i, system in enumerate(systems):
        rest = F.lit(False)
        for j, other in enumerate(systems):
            if j != i:
                rest = rest | F.col(f"on{j}")
                cells.append((system, other, F.col(f"on{i}"), F.col(f"on{j}")))
        cells.append((system, "*", F.col(f"on{i}"), rest))
    table = F.array(*(F.struct(F.lit(s).alias("system"), F.lit(o).alias("other"), sec(a & ~b).alias("only_sec"), sec(a & b).alias("both_sec")) for s, o, a, b in cells))
    return open_.groupBy("job_id").agg(table.alias("c")).select("job_id", F.inline("c"))
