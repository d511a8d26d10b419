"""Hypotheses held against references."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import latin_chars, tokens, word_count
from .clustering import greedy_remap
from .gates import script_word_ratio
from .intervals import intersection_sec, interval_join, interval_union, overlap_join, speech_iou
from .running import running
from .scan import sorted_scan


def token_recall(gold: Column, hyp: Column) -> Column:
    """Share of the different gold words in the hypothesis; without gold words 1 if it has none either, else 0."""
    g, h = F.array_distinct(tokens(gold)), F.array_distinct(tokens(hyp))
    return F.round(F.when(F.size(g) == 0, F.when(F.size(h) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(g, h)) / F.size(g)), 6)


def pair_status(gold: DataFrame, hyp: DataFrame, recall: float = 0.55, pad: float = 0.5) -> DataFrame:
    """match, differ or missing for each gold row."""
    met = gold.select("job_id", "ord", "text", "start", "end").join(overlap_join(gold, hyp, pad), ["job_id", "ord"], "left")
    r = token_recall(F.col("text"), F.col("hyp_text"))
    return met.select("job_id", "ord", F.when(F.col("n").isNull(), "missing").when(r >= recall, "match").otherwise("differ").alias("status"))


def pair_status_strict(gold: DataFrame, hyp: DataFrame, jaccard: float = 0.55, recall: float = 0.7, pad: float = 0.0, mapping: DataFrame | None = None) -> DataFrame:
    """match, differ or missing for each gold row, where the speaker must be among those of the overlapping hypothesis rows.

    Texts agree if the different words in common are ``jaccard`` of the larger side's or ``recall`` of the gold's; where a side has no
    words, if both have the same (none). ``mapping(job_id, hyp, gold)`` renames hypothesis speakers; those without an entry keep their name.
    """
    if mapping is not None:
        names = mapping.select("job_id", F.col("hyp").alias("speaker"), F.col("gold").alias("__gold"))
        hyp = hyp.join(names, ["job_id", "speaker"], "left").withColumn("speaker", F.coalesce("__gold", "speaker")).drop("__gold")
    h = hyp.select("job_id", F.col("ord").alias("hord"), F.col("start").alias("hs"), F.col("end").alias("he"), F.col("text").alias("htext"), F.col("speaker").alias("hspeaker"))
    over = F.least("end", F.col("he") + pad) - F.greatest("start", F.col("hs") - pad)
    met = interval_join(gold, h, (F.col("start"), F.col("end")), (F.col("hs") - pad, F.col("he") + pad)).filter(over > 0)
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hs", "hord", "htext"))), lambda x: x["htext"]), " ")
    found = met.groupBy("job_id", "ord").agg(said.alias("hyp_text"), F.bool_or(F.col("hspeaker") == F.col("speaker")).alias("same"))
    g, t = tokens(F.col("text")), tokens(F.coalesce("hyp_text", F.lit("")))
    both = F.size(F.array_intersect(g, t))
    a, b = F.size(F.array_distinct(g)), F.size(F.array_distinct(t))
    alike = F.when((a == 0) | (b == 0), g == t).otherwise((both / F.greatest(a, b) >= jaccard) | (both / F.greatest(a, F.lit(1)) >= recall))
    status = F.when(F.col("hyp_text").isNull(), "missing").when(F.coalesce("same", F.lit(False)) & alike, "match").otherwise("differ")
    return gold.select("job_id", "ord", "text").join(found, ["job_id", "ord"], "left").select("job_id", "ord", status.alias("status"))


def speaker_stats(turns: DataFrame, least: float = 30.0) -> DataFrame:
    per = turns.groupBy("job_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("sec"))
    return per.groupBy("job_id").agg(F.count("*").alias("n_speakers"), F.count(F.when(F.col("sec") >= least, 1)).alias("n_large"))


def turn_metrics(turns: DataFrame) -> DataFrame:
    """Turns, short turns, changes of speaker between neighbours, speakers."""
    prev = F.lag("speaker").over(Window.partitionBy("job_id").orderBy("start", "ord"))
    t = turns.withColumn("switch", F.when(prev != F.col("speaker"), 1)).withColumn("d", F.col("end") - F.col("start"))
    return t.groupBy("job_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("d") < 1, 1)).alias("n_below_1s"), F.count(F.when(F.col("d") < 2, 1)).alias("n_below_2s"), F.count("switch").alias("switches"), F.countDistinct("speaker").alias("speakers"))


def transcript_glue(segments: DataFrame) -> DataFrame:
    """Order and overlaps of neighbours."""
    w = Window.partitionBy("job_id").orderBy("ord")
    s = segments.withColumn("ps", F.lag("start").over(w)).withColumn("pe", F.lag("end").over(w))
    return s.groupBy("job_id").agg(F.count(F.when(F.col("start") < F.col("ps"), 1)).alias("n_disorder"), F.count(F.when(F.col("pe") - F.col("start") > 0.25, 1)).alias("n_overlap"))


def transcript_checks(hyp: DataFrame, base: DataFrame, ends: DataFrame) -> DataFrame:
    """``job_id, check_id, status`` of a part's segments (ending at ``ends(job_id, duration)``) against a baseline's: order, overlaps,
    end, share of the baseline's words (each place counts) that the hypothesis has, and ratio of the numbers of words."""
    words = lambda df: df.select("job_id", F.explode(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")), " ")).alias("w")).filter("w <> ''").groupBy("job_id", "w").count()
    h, b = words(hyp).withColumnRenamed("count", "nh"), words(base).withColumnRenamed("count", "nb")
    bags = h.join(b, ["job_id", "w"], "full").groupBy("job_id").agg(F.sum("nh").alias("nh"), F.sum("nb").alias("nb"), F.sum(F.when(F.col("nh").isNotNull(), F.col("nb"))).alias("covered"))
    last = hyp.groupBy("job_id").agg(F.max("end").alias("last"))
    jobs = ends.join(transcript_glue(hyp), "job_id", "left").join(last, "job_id", "left").join(bags, "job_id", "left")
    cover = F.when(F.coalesce("nb", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("covered", F.lit(0)) / F.col("nb"))
    ratio = F.when(F.coalesce("nb", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("nh", F.lit(0)) / F.col("nb"))
    passed = lambda cond, other: F.when(cond, "PASS").otherwise(other)
    checks = {
        "T1_time_order": passed(F.coalesce("n_disorder", F.lit(0)) == 0, "FAIL"),
        "T2_overlap": passed(F.coalesce("n_overlap", F.lit(0)) == 0, "WARN"),
        "T3_inside_part": passed(F.coalesce("last", F.lit(0.0)) <= F.col("duration") + 1.0, "FAIL"),
        "T4_text_coverage": F.when(cover >= 0.85, "PASS").when(cover >= 0.70, "WARN").otherwise("FAIL"),
        "T5_length_ratio": passed(ratio.between(0.75, 1.35), "WARN"),
    }
    return jobs.select("job_id", F.inline(F.array(*(F.struct(F.lit(c).alias("check_id"), s.alias("status")) for c, s in checks.items()))))


def turns_glue(hyp: DataFrame, base: DataFrame, least: float = 30.0) -> DataFrame:
    """``job_id, check_id, status``: as many speakers, and as many of ``least`` seconds or more, as the baseline has."""
    b = speaker_stats(base, least).select("job_id", F.col("n_speakers").alias("bs"), F.col("n_large").alias("bl"))
    met = b.join(speaker_stats(hyp, least), "job_id", "left").fillna(0, ["n_speakers", "n_large"])
    row = lambda name, same: F.struct(F.lit(name).alias("check_id"), F.when(same, "PASS").otherwise("WARN").alias("status"))
    return met.select("job_id", F.inline(F.array(row("D1_speaker_count", F.col("n_speakers") == F.col("bs")), row("D2_large_speakers_ge30s", F.col("n_large") == F.col("bl")))))


def new_speakers_and_hotspot(turns: DataFrame, known: DataFrame, low: float, high: float) -> DataFrame:
    """``job_id, new_ids, n_hotspot, hotspot_sec``: speakers that ``known(job_id, speaker)`` lacks, and turns that reach into a stretch."""
    new = turns.select("job_id", "speaker").distinct().join(known.select("job_id", "speaker").distinct(), ["job_id", "speaker"], "left_anti")
    new = new.groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list("speaker")), ",").alias("new_ids"))
    inside = (F.col("end") > low) & (F.col("start") < high)
    spot = turns.groupBy("job_id").agg(F.count(F.when(inside, 1)).alias("n_hotspot"), F.round(F.coalesce(F.sum(F.when(inside, F.col("end") - F.col("start"))), F.lit(0.0)), 3).alias("hotspot_sec"))
    return spot.join(new, "job_id", "left").select("job_id", F.coalesce("new_ids", F.lit("")).alias("new_ids"), "n_hotspot", "hotspot_sec")


def _same(a: Sequence, b: Sequence) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _differing(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Both without their common beginning and end: some alignment of least cost always keeps these."""
    n = _same(a, b)
    a, b = a[n:], b[n:]
    m = _same(a[::-1], b[::-1])
    return a[: len(a) - m], b[: len(b) - m]


def _edit_distance(ref: str, hyp: str) -> int:
    """Edit distance in characters. A column of the table of costs is two whole numbers, whose bits say where costs rise and fall by one from
    one row to the next; a step makes the next column from the last by a few operations on all rows at once (Myers, Hyyrö)."""
    ref, hyp = _differing(ref, hyp)
    places: dict[str, int] = {}
    for i, x in enumerate(ref):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(ref)) - 1
    rise, fall = full, 0
    for y in hyp:
        at = places.get(y, 0)
        kept = at | fall
        down = (((at & rise) + rise) ^ rise) | at
        up = (fall | (down | rise) & full ^ full) << 1 | 1
        down = (down & rise) << 1
        rise, fall = (down | (kept | up) & full ^ full) & full, up & kept & full
    return len(hyp) + rise.bit_count() - fall.bit_count()


_EDIT = 1 << 24  # costs of an edit in whole numbers; a substitution is one less, so that ties go to it


def _edit_counts(ref: list | str, hyp: list | str) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of an alignment with the fewest edits, and among those the most substitutions.

    One row of costs at a time: a row's insertions are a running minimum. The two lengths and the total cost give all three counts.
    """
    ref, hyp = _differing(ref, hyp)
    codes: dict = {}
    r, h = (np.array([codes.setdefault(x, len(codes)) for x in side], dtype=np.int64) for side in (ref, hyp))
    n, m = len(r), len(h)
    along = np.arange(m + 1, dtype=np.int64) * _EDIT
    row = along
    for x in r:
        best = row + _EDIT
        best[1:] = np.minimum(best[1:], row[:-1] + np.where(h == x, 0, _EDIT - 1))
        row = np.minimum.accumulate(best - along) + along
    edits = -(-int(row[-1]) // _EDIT)
    substitutions = edits * _EDIT - int(row[-1])
    return substitutions, (edits - substitutions + n - m) // 2, (edits - substitutions - n + m) // 2


def _stretches(ref: DataFrame, hyp: DataFrame, pause: float) -> DataFrame:
    """``job_id, side, start, end, ord, text, island`` of both sides (0 and 1); an island is what lies between two common pauses."""
    sides = [df.select("job_id", F.lit(i).alias("side"), "start", "end", F.col("ord").cast("long").alias("ord"), F.coalesce("text", F.lit("")).alias("text")) for i, df in enumerate((ref, hyp))]
    order = ["start", "end", "side", "ord"]
    reach = running(sides[0].unionByName(sides[1]), order, {"reach": ("max_before", F.col("end"))})
    opens = F.when(F.col("reach").isNull() | (F.col("start") - F.col("reach") > pause), F.col("start"))
    return running(reach.withColumn("opens", opens).drop("reach"), order, {"island": ("last_known", F.col("opens"))})


def align(ref: DataFrame, hyp: DataFrame, unit: str = "word", pause: float = 0.0) -> DataFrame:
    """``job_id, island, n_ref, n_hyp, substitutions, deletions, insertions`` of ``ref`` and ``hyp(job_id, ord, start, end, text)``.

    Segments need no common ids: a job's texts are put in order of time on both sides and aligned by the fewest edits. Alignments never
    cross a common pause, a time longer than ``pause`` at which neither side has a segment (``island`` is where the stretch between two
    such pauses starts), so stretches are aligned on their own, in parallel, whatever the length of the job; time is the product of the two
    sides' units in a stretch. Units are words of letters and digits in lower case, or with ``unit="char"`` the characters of the texts joined
    by spaces as they are. Words of a stretch that only one side has are deletions or insertions.
    """
    if unit not in ("word", "char"):
        raise ValueError("unit must be word or char")
    met = _stretches(ref, hyp, pause)
    words = F.filter(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    said = words if unit == "word" else F.col("text")
    rows = met.select(F.struct("job_id", "island").alias("at"), "side", "start", "ord", said.alias("said"))

    def scan(group: Iterator[tuple]) -> Iterable[tuple]:
        held: tuple[list, list] = ([], [])
        for side, _, _, said in group:
            held[side].append(said)
        r, h = ([x for part in side for x in part] if unit == "word" else " ".join(side) for side in held)
        yield len(r), len(h), *_edit_counts(r, h)

    out = sorted_scan(rows, ["side", "start", "ord"], scan, dict.fromkeys(("n_ref", "n_hyp", "substitutions", "deletions", "insertions"), "long"), key="at")
    return out.select("at.job_id", "at.island", "n_ref", "n_hyp", "substitutions", "deletions", "insertions")


_COUNTS = ("substitutions", "deletions", "insertions")


def _rate(edits: Column, n: Column) -> Column:
    return F.round(F.when(n > 0, edits / n).when(edits > 0, 1.0).otherwise(0.0), 6)


def wer(ref: DataFrame, hyp: DataFrame, pause: float = 0.0) -> DataFrame:
    """``job_id, words, hyp_words, substitutions, deletions, insertions, edits, wer`` by ``align``; without reference words the rate is 1 if the
    hypothesis has any, else 0."""
    out = align(ref, hyp, "word", pause).groupBy("job_id").agg(F.sum("n_ref").alias("words"), F.sum("n_hyp").alias("hyp_words"), *(F.sum(c).alias(c) for c in _COUNTS))
    return out.withColumn("edits", F.col("substitutions") + F.col("deletions") + F.col("insertions")).withColumn("wer", _rate(F.col("edits"), F.col("words")))


def cer(ref: DataFrame, hyp: DataFrame, pause: float = 0.0) -> DataFrame:
    """``job_id, chars, edits, cer`` over the stretches of ``align``, spaces between segments included."""
    distance = F.udf(_edit_distance, "long", useArrow=False)
    text = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("start", "ord", "text")))), lambda x: x["text"]), " ")
    each = _stretches(ref, hyp, pause).groupBy("job_id", "island").agg(text(0).alias("r"), text(1).alias("h"))
    out = each.groupBy("job_id").agg(F.sum(F.length("r")).alias("chars"), F.sum(distance("r", "h")).alias("edits"))
    return out.withColumn("cer", _rate(F.col("edits"), F.col("chars")))


def error_rates(per_job: DataFrame, rate: str = "wer", units: str = "words") -> DataFrame:
    """One row over all jobs: ``macro`` is the mean of their rates, ``micro`` all edits over all units."""
    return per_job.agg(F.count("*").alias("n_jobs"), F.sum(units).alias(units), F.sum("edits").alias("edits"), F.round(F.avg(rate), 6).alias("macro"), _rate(F.sum("edits"), F.sum(units)).alias("micro"))


def speaker_count_gate(turns: DataFrame, most: int = 5, tiny: float = 3.0) -> DataFrame:
    """Speakers, tiny ones, and the share of the ``most`` largest."""
    per = turns.groupBy("job_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("sec"))
    rank = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("sec"), "speaker"))
    return per.withColumn("rank", rank).groupBy("job_id").agg(F.count("*").alias("n_speakers"), F.count(F.when(F.col("sec") < tiny, 1)).alias("n_tiny"), F.round(F.sum(F.when(F.col("rank") <= most, F.col("sec"))) / F.sum("sec"), 6).alias("top_share"))


def grid_summary(segments: DataFrame) -> DataFrame:
    """Median length and number of segments of three words or fewer, per job."""
    return segments.groupBy("job_id").agg(F.round(F.percentile(F.col("end") - F.col("start"), F.lit(0.5)), 6).alias("median_sec"), F.count(F.when(word_count(F.col("text")) <= 3, 1)).alias("n_short"))


def grid_variants(rows: DataFrame, durations: DataFrame, baseline: str, loss: float = 5.0) -> DataFrame:
    """Each variant of ``rows(variant, job_id, ord, start, end, text)`` against the variant ``baseline`` of the same job: share of
    ``durations(job_id, duration)`` that is covered, median length, segments of three words or fewer, percentage points of cover won or lost, and a
    warning at a loss of ``loss`` points or more."""
    key = F.struct("variant", "job_id").alias("job_id")
    cover = interval_union(rows.select(key, "ord", "start", "end")).groupBy("job_id").agg(F.sum(F.col("end") - F.col("start")).alias("sec")).select("job_id.*", "sec")
    each = grid_summary(rows.select(key, "start", "end", "text")).select("job_id.*", "median_sec", "n_short").join(cover, ["variant", "job_id"], "left").join(durations, "job_id")
    each = each.withColumn("cover", F.round(F.when(F.col("duration") > 0, F.coalesce("sec", F.lit(0.0)) / F.col("duration")).otherwise(0.0), 6))
    base = each.filter(F.col("variant") == baseline).select("job_id", F.col("cover").alias("base"))
    met = each.join(base, "job_id", "left").withColumn("delta_pp", F.round(100 * (F.col("cover") - F.col("base")), 3))
    return met.select("variant", "job_id", "cover", "median_sec", "n_short", "delta_pp", F.coalesce(F.col("delta_pp") <= -loss, F.lit(False)).alias("warn"))


def map_speakers(gold: DataFrame, hyp: DataFrame, least: float = 0.2, near: float = 2.0) -> DataFrame:
    """``job_id, hyp, gold``: hypothesis speakers matched one to one, gold segments in order.

    A gold segment of two different words or more takes the best segment of a speaker not yet matched: share of its words, plus
    half the share of its time, among segments that overlap it or start within ``near`` seconds. A scan of the job's gold segments, each with the
    best candidate of each speaker.
    """
    g = gold.select("job_id", F.col("ord").alias("g_ord"), F.col("speaker").alias("g_speaker"), F.array_distinct(tokens(F.col("text"))).alias("g_words"), F.col("start").alias("gs"), F.col("end").alias("ge")).filter("size(g_words) >= 2")
    h = hyp.select("job_id", F.col("ord").alias("h_ord"), F.col("speaker").alias("h_speaker"), F.array_distinct(tokens(F.col("text"))).alias("h_words"), F.col("start").alias("hs"), F.col("end").alias("he"))
    shared = F.least("ge", "he") - F.greatest("gs", "hs")
    met = interval_join(g, h, (F.col("gs") - near, F.col("ge") + near), (F.col("hs"), F.col("he"))).filter((shared > 0) | (F.abs(F.col("gs") - F.col("hs")) <= near)).withColumn("common", F.size(F.array_intersect("g_words", "h_words"))).filter("common > 0")
    score = F.col("common") / F.size("g_words") + F.when(shared > 0, 0.5 * shared / F.greatest(F.col("ge") - F.col("gs"), F.lit(0.01))).otherwise(0.0)
    best = met.groupBy("job_id", "g_ord", "g_speaker", "h_speaker").agg(F.min(F.struct((-F.round(score, 9)).alias("k"), "h_ord", "h_speaker")).alias("b"))
    per = best.groupBy("job_id", "g_ord", "g_speaker").agg(F.array_sort(F.collect_list("b")).alias("c"))

    def scan(rows: Iterator[tuple]) -> Iterable[tuple]:
        taken, given = set(), set()
        for _, gold_speaker, tries in rows:
            pick = next((t for t in tries if t["h_speaker"] not in taken), None)
            if pick and pick["k"] <= -least and gold_speaker not in given:
                taken.add(pick["h_speaker"])
                given.add(gold_speaker)
                yield pick["h_speaker"], gold_speaker

    return sorted_scan(per.select("job_id", "g_ord", "g_speaker", "c"), ["g_ord"], scan, {"hyp": "string", "gold": "string"})


def chapters_glue(hyp: DataFrame, base: DataFrame, ends: DataFrame, good: float = 0.80, fair: float = 0.60) -> DataFrame:
    """``job_id, check_id, status``: chapters of a part (ending at ``ends(job_id, duration)``) against those of a baseline.

    A job without chapters fails the first check and has no others.
    """
    w = Window.partitionBy("job_id").orderBy("ord")
    own = hyp.withColumn("ps", F.lag("start").over(w)).withColumn("pe", F.lag("end").over(w))
    own = own.groupBy("job_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("start") < F.col("ps"), 1)).alias("back"), F.count(F.when(F.col("pe") - F.col("start") > 0.25, 1)).alias("laps"), F.max("end").alias("last"))
    both = base.groupBy("job_id").agg(F.count("*").alias("n_base")).join(own, "job_id", "full").join(intersection_sec(hyp, base), "job_id", "left").join(ends, "job_id", "left")
    share = lambda other: F.coalesce(F.col("both_sec") / F.greatest(F.col("both_sec") + F.col(other), F.lit(1e-9)), F.lit(0.0))
    worse = F.least(share("only_a_sec"), share("only_b_sec"))
    ratio = F.col("n") / F.col("n_base")
    passed = lambda cond, other: F.when(cond, "PASS").otherwise(other)
    checks = {
        "C1_time_order": passed(F.col("back") == 0, "FAIL"),
        "C2_no_overlap": passed(F.col("laps") == 0, "FAIL"),
        "C3_inside_part": passed(F.col("last") <= F.col("duration") + 1.0, "FAIL"),
        "C4_timeline_vs_baseline": F.when(worse >= good, "PASS").when(worse >= fair, "WARN").otherwise("FAIL"),
        "C5_count_vs_baseline": F.when(F.col("n_base").isNotNull(), passed(ratio.between(0.5, 2.0), "WARN")),
    }
    rows = [F.struct(F.lit("C0_nonempty").alias("check_id"), passed(F.col("n").isNotNull(), "FAIL").alias("status"))]
    rows += [F.struct(F.lit(c).alias("check_id"), F.when(F.col("n").isNotNull(), s).alias("status")) for c, s in checks.items()]
    return both.select("job_id", F.inline(F.array(*rows))).filter("status IS NOT NULL")


def der(ref: DataFrame, hyp: DataFrame, collar: float = 0.25, slice_sec: float = 60.0) -> DataFrame:
    """Missed, false and confused seconds over the seconds of reference speech, per job; null without such speech.

    Speakers are matched one to one by common seconds. Both sides are cut at every ``slice_sec`` seconds, so the join has a slice
    as its key beside the job; the rest is one sweep. Time within ``collar`` of a reference boundary does not count.
    """

    def per_speaker(df: DataFrame) -> DataFrame:
        keyed = df.select(F.struct("job_id", "speaker").alias("job_id"), "ord", "start", "end")
        return interval_union(keyed).select("job_id.job_id", "job_id.speaker", "start", "end")

    def sliced(df: DataFrame, name: str) -> DataFrame:
        k = df.withColumn("k", F.explode(F.sequence(F.floor(F.col("start") / slice_sec), F.floor(F.col("end") / slice_sec))))
        return k.select("job_id", "k", F.col("speaker").alias(name), F.greatest(F.col("start"), F.col("k") * slice_sec).alias(f"{name}_s"), F.least(F.col("end"), (F.col("k") + 1) * slice_sec).alias(f"{name}_e"))

    r, h = per_speaker(ref), per_speaker(hyp)
    met = sliced(h, "cluster").join(sliced(r, "published"), ["job_id", "k"]).select("job_id", "cluster", "published", F.greatest("cluster_s", "published_s").alias("start"), F.least("cluster_e", "published_e").alias("end")).filter("end > start")
    names = greedy_remap(met.groupBy("job_id", "cluster", "published").agg(F.sum(F.col("end") - F.col("start")).alias("sec"))).select("job_id", "cluster", "published")
    right = met.join(names, ["job_id", "cluster", "published"])
    edges = r.select("job_id", F.explode(F.array("start", "end")).alias("t")).select("job_id", (F.col("t") - collar).alias("start"), (F.col("t") + collar).alias("end"))
    events = None
    for kind, df in (("ref", r), ("hyp", h), ("right", right), ("edge", edges)):
        for col, step in (("start", 1), ("end", -1)):
            part = df.select("job_id", F.col(col).alias("t"), *(F.lit(step if kind == k else 0).alias(k) for k in ("ref", "hyp", "right", "edge")))
            events = part if events is None else events.unionByName(part)
    at = events.groupBy("job_id", "t").agg(*(F.sum(k).alias(k) for k in ("ref", "hyp", "right", "edge")))
    w = Window.partitionBy("job_id").orderBy("t")
    on = at.select("job_id", (F.lead("t").over(w) - F.col("t")).alias("dt"), *(F.sum(k).over(w).alias(k) for k in ("ref", "hyp", "right", "edge"))).withColumn("dt", F.when(F.col("edge") <= 0, F.col("dt")).otherwise(0.0))
    zero = F.lit(0)
    sec = lambda n, name: F.round(F.coalesce(F.sum(n * F.col("dt")), F.lit(0.0)), 3).alias(name)
    out = on.groupBy("job_id").agg(sec(F.col("ref"), "ref_sec"), sec(F.greatest(F.col("ref") - F.col("hyp"), zero), "miss_sec"), sec(F.greatest(F.col("hyp") - F.col("ref"), zero), "false_sec"), sec(F.least("ref", "hyp") - F.col("right"), "confused_sec"))
    return out.withColumn("der", F.round(F.when(F.col("ref_sec") > 0, (F.col("miss_sec") + F.col("false_sec") + F.col("confused_sec")) / F.col("ref_sec")), 6))


def regression_bands(ref: DataFrame, hyp: DataFrame, segments: DataFrame, min_iou: float = 0.7, speakers: tuple[int, int] = (2, 4), min_ratio: float = 0.9, max_latin: int = 0) -> DataFrame:
    """``job_id, check_id, ok`` for speech overlap, speakers of ``hyp``, and the script and Latin letters of ``segments``."""
    jobs = speech_iou(ref, hyp).join(hyp.groupBy("job_id").agg(F.countDistinct("speaker").alias("n")), "job_id", "left").join(script_word_ratio(segments), "job_id", "left")
    jobs = jobs.join(segments.groupBy("job_id").agg(F.sum(latin_chars(F.col("text"))).alias("latin")), "job_id", "left")
    ok = {"REG.VAD.IoU": F.col("iou") >= min_iou, "REG.DIAR.speakers": F.col("n").between(*speakers), "REG.ASR.ratio": F.col("word_ratio") >= min_ratio, "REG.ASR.latin": F.col("latin") <= max_latin}
    return jobs.select("job_id", F.inline(F.array(*(F.struct(F.lit(k).alias("check_id"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in ok.items()))))
