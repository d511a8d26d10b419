"""Quality gates: check rows per job and their verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, latin_chars, starts_with_stamp, tokens, word_count
from .chapters import chapter_segments, chapter_text
from .insights import clock_gate
from .intervals import find_holes

_CHECK = ("job_id", "check_id", "status", "value")


def verdict(checks: DataFrame) -> DataFrame:
    """fail before warn before pass."""
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return checks.groupBy("job_id").agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), worst.cast("int") + 1).alias("verdict"))


def script_word_ratio(segments: DataFrame, script: str = "Latin") -> DataFrame:
    """Share of words wholly in one script, of words of two characters or more with a letter; 1 without words."""
    words = segments.filter(~is_blank(F.col("text"))).select("job_id", F.explode(tokens(F.col("text"))).alias("w")).filter(F.col("w").rlike(r"\p{L}"))
    counts = words.groupBy("job_id").agg(F.count("*").alias("total"), F.count(F.when(F.col("w").rlike(rf"^\p{{Is{script}}}+$"), 1)).alias("good"))
    jobs = segments.select("job_id").distinct().join(counts, "job_id", "left")
    return jobs.select("job_id", F.coalesce("total", F.lit(0)).alias("total_words"), F.coalesce(F.round(F.col("good") / F.col("total"), 3), F.lit(1.0)).alias("word_ratio"))


def check_monotonic(segments: DataFrame, durations: DataFrame | None = None, slack: float = 1.0) -> DataFrame:
    """The first segment of each job with bad bounds, before its predecessor, or (with ``durations(job_id, duration)``) more than ``slack``
    seconds beyond the end of the recording, if any; the reasons are tried in this order."""
    prev = F.lag("start").over(Window.partitionBy("job_id").orderBy("ord"))
    why = F.when((F.col("start") < 0) | (F.col("end") <= F.col("start")), "bounds").when(F.col("start") < prev, "order")
    if durations is not None:
        segments = segments.join(durations.select("job_id", F.col("duration").alias("__duration")), "job_id", "left")
        why = why.when(F.col("end") > F.col("__duration") + slack, "end")
    bad = segments.withColumn("why", why).groupBy("job_id").agg(F.min(F.when(F.col("why").isNotNull(), F.struct("ord", "why"))).alias("b"))
    return bad.select("job_id", F.lit("G1.4").alias("check_id"), F.when(F.col("b").isNull(), "pass").otherwise("fail").alias("status"), F.coalesce(F.col("b.why"), F.lit("")).alias("value"))


def transcript_gate(segments: DataFrame, script: str = "Latin", ratio: float = 0.9, max_empty: int = 50, max_holes: float = 500.0) -> DataFrame:
    """Check rows of a transcript: script ratio, Latin letters where another script is due, empty segments, seconds of holes, order."""
    words = script_word_ratio(segments, script).select("job_id", F.lit("G1.1").alias("check_id"), F.when(F.col("word_ratio") >= ratio, "pass").otherwise("fail").alias("status"), F.format_string("%.3f", "word_ratio").alias("value"))
    empty = segments.groupBy("job_id").agg(F.count(F.when(is_blank(F.col("text")), 1)).alias("n"), F.sum(latin_chars(F.col("text"))).alias("latin"))
    blank = empty.select("job_id", F.lit("G1.3").alias("check_id"), F.when(F.col("n") > max_empty, "warn").otherwise("pass").alias("status"), F.col("n").cast("string").alias("value"))
    out = words.unionByName(blank)
    if script != "Latin":
        out = out.unionByName(empty.select("job_id", F.lit("G1.2").alias("check_id"), F.when(F.col("latin") > 0, "fail").otherwise("pass").alias("status"), F.col("latin").cast("string").alias("value")))
    holes = find_holes(segments).groupBy("job_id").agg(F.sum(F.col("end") - F.col("start")).alias("sec"))
    holes = segments.select("job_id").distinct().join(holes, "job_id", "left").withColumn("sec", F.coalesce("sec", F.lit(0.0)))
    gaps = holes.select("job_id", F.lit("G1.5").alias("check_id"), F.when(F.col("sec") > max_holes, "warn").otherwise("pass").alias("status"), F.format_string("%.3f", F.round("sec", 3)).alias("value"))
    return out.unionByName(check_monotonic(segments)).unionByName(gaps).select(*_CHECK)


#: Declared limits of the checks: pass bands and, where there is one, the band that only warns.
THRESHOLDS = [
    ("G1.1", "word ratio", 0.9, None, None, None),
    ("G1.3", "empty segments", None, 50.0, None, None),
    ("G1.5", "seconds of holes", None, 500.0, None, None),
    ("G2.2", "chapters a minute", 0.4, 0.8, 0.3, 1.0),
    ("G2.3", "seconds of a chapter", 45.0, 180.0, None, None),
    ("G2.4", "words of a title", None, 10.0, None, None),
    ("G3.1", "mismatches", None, 0.0, None, None),
    ("G3.6", "key moments", 5.0, 12.0, None, None),
]


def thresholds(spark: SparkSession) -> DataFrame:
    """``check_id, what, low, high, warn_low, warn_high``, one row for each declared limit."""
    return spark.createDataFrame(THRESHOLDS, "check_id string, what string, low double, high double, warn_low double, warn_high double")


def _limits(check: str) -> tuple:
    return next(row[2:] for row in THRESHOLDS if row[0] == check)


def _row(df: DataFrame, name: str, status: Column | None = None, value: Column | None = None) -> DataFrame:
    """A check row for each job of ``df(job_id, n)``; by default it fails if ``n`` is above 0."""
    status = F.when(F.coalesce("n", F.lit(0)) > 0, "fail").otherwise("pass") if status is None else status
    return df.select("job_id", F.lit(name).alias("check_id"), status.alias("status"), (F.coalesce("n", F.lit(0)).cast("string") if value is None else value).alias("value"))


def _union(rows: list[DataFrame]) -> DataFrame:
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select(*_CHECK)


def chapter_gate(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """Check rows of chapters: bounds equal to those of the first and last source, density, length, words, stamps and uniqueness of titles,
    and every segment with text in exactly one chapter. The value is the number of offenders, or the density."""
    bridge = chapter_segments(chapters)
    met = bridge.join(segments.select("job_id", "segment_id", F.col("start").alias("s"), F.col("end").alias("e")), ["job_id", "segment_id"], "left")
    own = met.groupBy("job_id", "chapter_id").agg(F.min_by("s", "pos").alias("s"), F.max_by("e", "pos").alias("e"), F.min_by("segment_id", "pos").alias("first"))
    same = F.coalesce((F.col("start") == F.col("s")) & (F.col("end") == F.col("e")), F.lit(False))
    off = chapters.join(own, ["job_id", "chapter_id"], "left").groupBy("job_id").agg(F.count(F.when(~same, 1)).alias("n"))
    low, high, warn_low, warn_high = _limits("G2.2")
    density = F.round(F.col("k") / (F.col("last") / 60), 3)
    dense = chapters.groupBy("job_id").agg(F.count("*").alias("k")).join(segments.groupBy("job_id").agg(F.max("end").alias("last")), "job_id")
    dense = dense.select("job_id", F.when(F.col("last") > 0, density).otherwise(0.0).alias("n"))
    short, long, *_ = _limits("G2.3")
    most = int(_limits("G2.4")[1])
    sec, title = F.round(F.col("end") - F.col("start"), 3), F.lower(F.trim(F.coalesce("title", F.lit(""))))
    count = lambda cond: chapters.groupBy("job_id").agg(F.count(F.when(cond, 1)).alias("n"))
    titles = chapters.select("job_id", title.alias("t")).groupBy("job_id", "t").count().groupBy("job_id").agg(F.sum(F.when(F.col("t") == "", F.col("count")).when(F.col("count") > 1, 1).otherwise(0)).alias("n"))
    times = segments.filter(~is_blank(F.col("text"))).join(bridge, ["job_id", "segment_id"], "left").groupBy("job_id", "segment_id").agg(F.count("chapter_id").alias("c"))
    cover = times.groupBy("job_id").agg(F.count(F.when(F.col("c") != 1, 1)).alias("n"))
    warned = F.when(F.col("n") > 0, "warn").otherwise("pass")
    return _union(
        [
            _row(off, "G2.1"),
            _row(dense, "G2.2", F.when(F.col("n").between(low, high), "pass").when(F.col("n").between(warn_low, warn_high), "warn").otherwise("fail"), F.format_string("%.3f", "n")),
            _row(count((sec < short) | (sec > long)), "G2.3", warned),
            _row(count(word_count(F.col("title")) > most), "G2.4"),
            _row(count(starts_with_stamp(F.col("title"), strip_quotes=False)), "G2.5"),
            _row(titles, "G2.6"),
            _row(cover, "G2.7"),
        ]
    )


def insight_gate(items: DataFrame, sources: DataFrame, chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """Check rows of insights: ``items(job_id, chapter_id, kind, idx, text)`` and their
    ``sources(job_id, chapter_id, kind, idx, segment_id, start, end, speaker)``.

    Copied times and speakers are those of the segment, sources belong to the chapter, key points have a source, their digits stand in
    the chapter's text, and none begins with a stamp. The value is the number of offenders.
    """
    jobs = items.select("job_id").distinct()
    key = ["job_id", "chapter_id", "kind", "idx"]
    clock = clock_gate(sources, segments).select("job_id", F.col("n_bad").alias("n"))
    strange = sources.join(chapter_segments(chapters).select("job_id", "chapter_id", "segment_id").distinct(), ["job_id", "chapter_id", "segment_id"], "left_anti").groupBy("job_id").agg(F.count("*").alias("n"))
    points = items.filter("kind = 'key_points'")
    bare = points.join(sources.select(*key).distinct(), key, "left_anti").groupBy("job_id").agg(F.count("*").alias("n"))
    texts = chapter_text(chapters, segments, with_speaker=False).withColumnRenamed("text", "source")
    digits = points.join(texts, ["job_id", "chapter_id"], "left").select("job_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]+)"))).alias("g"), F.coalesce("source", F.lit("")).alias("source"))
    made_up = digits.filter(~F.contains("source", F.col("g"))).groupBy("job_id").agg(F.count("*").alias("n"))
    stamped = points.groupBy("job_id").agg(F.count(F.when(starts_with_stamp(F.col("text")), 1)).alias("n"))
    return _union([_row(jobs.join(df, "job_id", "left"), name) for name, df in (("G3.1", clock), ("G3.2", strange), ("G3.3", bare), ("G3.4", made_up), ("G3.7", stamped))])


def report_gate(moments: DataFrame, low: int = 5, high: int = 12) -> DataFrame:
    n = moments.groupBy("job_id").agg(F.count("*").alias("n"))
    return _row(n, "G3.6", F.when(F.col("n").between(low, high), "pass").otherwise("warn"))


def protocol_gate(reports: DataFrame, moments: DataFrame, sources: DataFrame, profile: str = "demo") -> DataFrame:
    """Check rows of ``reports(job_id, summary, draft_warning)`` and their ``moments(job_id, text, start, end, speaker, chapter_id)``.

    Every moment has the times, speaker and chapter of a source of the insights; there are five to twelve; neither a sentence of the
    summary nor a moment begins with a stamp; a demo report is marked as a draft.
    """
    same = ["job_id", "start", "end", "speaker", "chapter_id"]
    lost = moments.join(sources.select(*same).distinct(), same, "left_anti").groupBy("job_id").agg(F.count("*").alias("n"))
    number = reports.select("job_id").join(moments.groupBy("job_id").agg(F.count("*").alias("n")), "job_id", "left").fillna(0, ["n"])
    low, high, *_ = _limits("G3.6")
    said = reports.select("job_id", F.explode(F.split(F.coalesce("summary", F.lit("")), r"(?:[.!?]\s+|\n+)")).alias("text")).filter(~is_blank(F.col("text"))).unionByName(moments.select("job_id", "text"))
    stamped = said.groupBy("job_id").agg(F.count(F.when(starts_with_stamp(F.col("text")), 1)).alias("n"))
    draft = reports.select("job_id", F.when((F.lit(profile) != "demo") | F.coalesce("draft_warning", F.lit(False)), 0).otherwise(1).alias("n"))
    jobs = reports.select("job_id")
    return _union(
        [
            _row(jobs.join(lost, "job_id", "left"), "G3.1"),
            _row(number, "G3.6", F.when(F.col("n").between(low, high), "pass").otherwise("warn")),
            _row(jobs.join(stamped, "job_id", "left"), "G3.7"),
            _row(draft, "G3.8"),
        ]
    )
