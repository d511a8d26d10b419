"""Chapters out of transcript segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, tokens, word_count
from .clustering import cosine
from .scan import sorted_scan


def _by_ord():
    return Window.partitionBy("job_id").orderBy("ord")


def attach_empty_segments(segments: DataFrame) -> DataFrame:
    """Piece of each segment: blank ones belong to the piece before; leading blanks to the first."""
    n = F.sum(F.when(is_blank(F.col("text")), 0).otherwise(1)).over(_by_ord())
    return segments.withColumn("piece", F.greatest(n, F.lit(1)).cast("long"))


def pack_pieces(segments: DataFrame, max_gap: float = 2.0, max_words: int = 80) -> DataFrame:
    """Unit of each segment: pieces join while the gap is small (or the speaker goes on) and the words stay within the target.

    A scan of the job's pieces: the state is the unit's number, words, end and last speaker.
    """
    s = attach_empty_segments(segments)
    pieces = s.groupBy("job_id", "piece").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.sum(word_count(F.col("text"))).cast("int").alias("w"), F.min_by("speaker", "ord").alias("a"), F.max_by("speaker", "ord").alias("z"))

    def scan(rows: Iterator[tuple]) -> Iterable[tuple]:
        unit, words, end, last = -1, 0, 0.0, None
        for piece, s, e, w, a, z in rows:
            if unit >= 0 and words + w <= max_words and (last == a or s - end <= max_gap):
                words += w
            else:
                unit, words = unit + 1, w
            end, last = e, z
            yield piece, unit

    units = sorted_scan(pieces, ["piece"], scan, {"piece": "long", "unit": "long"})
    return s.join(units, ["job_id", "piece"])


def units(packed: DataFrame) -> DataFrame:
    """One row for each unit of ``pack_pieces`` that has text."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "segment_id"))), lambda x: x["segment_id"])
    words = F.sum(word_count(F.col("text"))).cast("long")
    return packed.groupBy("job_id", "unit").agg(F.min("start").alias("start"), F.max("end").alias("end"), words.alias("words"), ids.alias("source_ids")).filter("words > 0")


def merge_similar_units(units_with_vectors: DataFrame, threshold: float = 0.7, cap: float = 180.0, max_units: int | None = None) -> DataFrame:
    """Chapter of each unit of ``(job_id, unit, start, end, words, vector)``: a unit joins while its cosine with the chapter's vector
    reaches ``threshold`` and the chapter stays within ``cap`` seconds and ``max_units`` units.

    The chapter's vector starts as that of its first unit. When a unit joins, it is the mean of both, weighted by the chapter's words
    so far and the unit's (one at least), and made a unit vector again, so that neither outweighs by its length; a zero mean stays.
    Zero vectors, and vectors of another length, are like none. A scan with the vector as state.
    """

    def scan(rows: Iterator[tuple]) -> Iterable[tuple]:
        chapter, begin, weight, count, held, size = -1, 0.0, 0, 0, None, 0.0
        for unit, start, end, words, vector in rows:
            words, vector = max(words or 0, 1), np.asarray(vector, dtype=float)
            norm = float(np.sqrt(vector @ vector))
            like = float(held @ vector) / (size * norm) if held is not None and len(held) == len(vector) and size * norm > 0 else 0.0
            joins = chapter >= 0 and len(held) == len(vector) and like >= threshold and end - begin <= cap and (max_units is None or count < max_units)
            if joins:
                held = (held * weight + vector * words) / (weight + words)
                size = float(np.sqrt(held @ held))
                held, size = (held / size, 1.0) if size else (held, size)
                weight, count = weight + words, count + 1
            else:
                chapter, begin, weight, count, held, size = chapter + 1, start, words, 1, vector, norm
            yield unit, chapter

    rows = units_with_vectors.select("job_id", "unit", "start", "end", F.col("words").cast("long").alias("words"), F.coalesce("vector", F.array()).cast("array<double>").alias("vector"))
    return sorted_scan(rows, ["unit"], scan, {"unit": "long", "chapter": "long"})


def absorb_short_units(df: DataFrame, least: float = 5.0) -> DataFrame:
    """``df(job_id, ord, start, end)``: a short row joins the one before, leading short ones the next. A scan that holds one row."""

    def scan(rows: Iterator[tuple]) -> Iterable[tuple]:
        n, held = 0, None
        for _, start, end in rows:
            if held and (end - start < least or (n == 0 and held[1] - held[0] < least)):
                held = held[0], end
                continue
            if held:
                yield n, *held
                n += 1
            held = start, end
        if held:
            yield n, *held

    return sorted_scan(df.select("job_id", "ord", "start", "end"), ["ord"], scan, {"ord": "long", "start": "double", "end": "double"})


def embed_units(texts: DataFrame, dimensions: int = 64) -> DataFrame:
    """``job_id, unit, vector`` of ``texts(job_id, unit, text)``: hashed word vectors of length one, for where no model's vectors are at hand.

    A word counts as often as the unit has it, times ``1 + ln((1 + units) / (1 + units with it))``, in the dimension that the first eight
    digits of its md5 give. A unit without words has an empty vector, which is like none.
    """
    said = texts.select("job_id", "unit", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("word")).groupBy("job_id", "unit", "word").agg(F.count("*").alias("tf"))
    n = texts.count()
    rare = said.groupBy("word").agg((1 + F.log((1 + n) / (1 + F.count("*")))).alias("idf"))
    place = (F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    each = said.join(rare, "word").groupBy("job_id", "unit", place.alias("i")).agg(F.sum(F.col("tf") * F.col("idf")).alias("x"))
    rows = each.groupBy("job_id", "unit").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("size"))
    return texts.select("job_id", "unit").join(rows.select("job_id", "unit", dense.alias("vector")), ["job_id", "unit"], "left").withColumn("vector", F.coalesce("vector", F.array().cast("array<double>")))


def build_chapters(segments: DataFrame, vectors: DataFrame, max_gap: float = 2.0, max_words: int = 80, threshold: float = 0.7, cap: float = 180.0, least: float = 5.0) -> DataFrame:
    """Chapters of ``segments(job_id, ord, segment_id, speaker, text, start, end)`` with ``vectors(job_id, unit, vector)`` of their units.

    Pieces are packed into units, units without text go, neighbours alike are merged and short ones taken into the one before (leading
    ones into the next). Bounds are those of the first and last segment. Returns ``job_id, ord, chapter_id, start, end, source_ids,
    speakers`` (by first appearance), ``duration_sec``; a job without text has no rows. A unit without a vector has none alike.
    """
    packed = pack_pieces(segments, max_gap, max_words)
    whole = units(packed).join(vectors.select("job_id", "unit", "vector"), ["job_id", "unit"], "left")
    whole = whole.withColumn("vector", F.coalesce("vector", F.array().cast("array<double>")))
    merged = merge_similar_units(whole.select("job_id", "unit", "start", "end", "words", "vector"), threshold, cap)
    rough = whole.join(merged, ["job_id", "unit"]).groupBy("job_id", F.col("chapter").alias("ord")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    bounds = absorb_short_units(rough, least)
    # the chapters' bounds part the units: each belongs to the last chapter that starts no later
    marks = bounds.select("job_id", "start", F.col("ord").alias("chapter"), F.lit(None).cast("long").alias("unit")).unionByName(whole.select("job_id", "start", F.lit(None).cast("long").alias("chapter"), "unit"))
    along = Window.partitionBy("job_id").orderBy("start", F.col("chapter").isNull())
    owner = marks.withColumn("chapter", F.last("chapter", ignorenulls=True).over(along)).filter("unit IS NOT NULL").select("job_id", "unit", "chapter")
    rows = packed.join(owner, ["job_id", "unit"])
    first = rows.groupBy("job_id", "chapter", "speaker").agg(F.min("ord").alias("first"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("first", "speaker"))), lambda x: x["speaker"])
    speakers = first.groupBy("job_id", "chapter").agg(names.alias("speakers"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "segment_id"))), lambda x: x["segment_id"])
    out = rows.groupBy("job_id", "chapter").agg(F.min_by("start", "ord").alias("start"), F.max_by("end", "ord").alias("end"), ids.alias("source_ids")).join(speakers, ["job_id", "chapter"])
    return out.select("job_id", F.col("chapter").alias("ord"), F.format_string("C%02d", "chapter").alias("chapter_id"), "start", "end", "source_ids", "speakers", F.round(F.col("end") - F.col("start"), 3).alias("duration_sec"))


def chapter_metrics(chapters: DataFrame, short: float = 20.0, long: float = 180.0) -> DataFrame:
    """Chapters a minute, and how many are short or long."""
    d = F.col("end") - F.col("start")
    return chapters.groupBy("job_id").agg(F.count("*").alias("n_chapters"), F.round(F.count("*") / (F.max("end") / 60), 3).alias("chapters_per_minute"), F.count(F.when(d < short, 1)).alias("short_chapters"), F.count(F.when(d > long, 1)).alias("long_chapters"))


def chapter_segments(chapters: DataFrame) -> DataFrame:
    return chapters.select("job_id", "chapter_id", F.posexplode("source_ids").alias("pos", "segment_id"))


def chapter_speakers(chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """Speakers of each chapter by first appearance."""
    met = chapter_segments(chapters).join(segments.select("job_id", "segment_id", "speaker"), ["job_id", "segment_id"])
    first = met.groupBy("job_id", "chapter_id", "speaker").agg(F.min("pos").alias("pos"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "speaker"))), lambda x: x["speaker"])
    return first.groupBy("job_id", "chapter_id").agg(F.array_join(names, ",").alias("speakers"))


def chapter_text(chapters: DataFrame, segments: DataFrame, with_speaker: bool = True) -> DataFrame:
    """``speaker: text`` lines of the segments that are not blank; or all texts joined by a space."""
    met = chapter_segments(chapters).join(segments.select("job_id", "segment_id", "speaker", "text"), ["job_id", "segment_id"])
    if with_speaker:
        met = met.filter(~is_blank(F.col("text"))).withColumn("text", F.concat_ws(": ", "speaker", "text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return met.groupBy("job_id", "chapter_id").agg(F.array_join(lines, "\n" if with_speaker else " ").alias("text"))


def chapter_neighbors(chapters: DataFrame) -> DataFrame:
    return chapters.select("job_id", "chapter_id", F.lag("chapter_id").over(_by_ord()).alias("previous"), F.lead("chapter_id").over(_by_ord()).alias("next"))


def digest_chapters(chapters: DataFrame, segments: DataFrame, chars: int = 700, most: int = 8) -> DataFrame:
    """Leading lines of each chapter within a budget of characters (the first always), and up to ``most`` of their sources."""
    met = chapter_segments(chapters).join(segments.select("job_id", "segment_id", "speaker", "text"), ["job_id", "segment_id"]).filter(~is_blank(F.col("text")))
    met = met.withColumn("line", F.concat_ws(": ", "speaker", "text"))
    w = Window.partitionBy("job_id", "chapter_id").orderBy("pos")
    met = met.withColumn("used", F.sum(F.length("line") + 1).over(w)).withColumn("n", F.row_number().over(w)).filter((F.col("used") <= chars) | (F.col("n") == 1))
    rows = F.array_sort(F.collect_list(F.struct("pos", "line", "segment_id")))
    out = met.groupBy("job_id", "chapter_id").agg(rows.alias("r"))
    return out.select("job_id", "chapter_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("digest"), F.array_join(F.slice(F.transform("r", lambda x: x["segment_id"]), 1, most), ",").alias("sources"))


def merge_by_title_vectors(chapters: DataFrame, threshold: float = 0.75, max_leaves: int = 8, cap: float = 180.0) -> DataFrame:
    """``chapters(job_id, ord, start, end, vector)`` of titles to the group each belongs to: all weigh the same, a group has few leaves."""
    units = chapters.select("job_id", F.col("ord").alias("unit"), "start", "end", F.lit(1).cast("long").alias("words"), "vector")
    return merge_similar_units(units, threshold, cap, max_leaves).select("job_id", F.col("unit").alias("ord"), F.col("chapter").alias("parent"))


def late_windows(segments: DataFrame, win: float = 240.0, overlap: float = 60.0) -> DataFrame:
    """Each segment once for every overlapping window that it starts in, as ``win_id``."""
    step = win - overlap
    first = F.greatest(F.floor((F.col("start") - win) / step) + 1, F.lit(0)).cast("int")
    return segments.withColumn("win_id", F.explode(F.sequence(first, F.floor(F.col("start") / step).cast("int"))))


def late_chunk_boundaries(vectors: DataFrame, shortest: float = 45.0, longest: float = 180.0) -> DataFrame:
    """Chapter of each segment of ``vectors(job_id, win_id, ord, start, end, vector)``, which has a vector for each window it is in.

    The cosine of neighbours is averaged over windows. A chapter ends before a local minimum once it lasts ``shortest`` seconds, and
    before any segment that would carry it beyond ``longest``. A scan of the job's segments.
    """
    w = Window.partitionBy("job_id", "win_id").orderBy("ord")
    near = vectors.withColumn("sim", F.when(F.lag("ord").over(w).isNotNull(), cosine(F.col("vector"), F.lag("vector").over(w))))
    each = near.groupBy("job_id", "ord").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.round(F.avg("sim"), 9).alias("sim"))
    low = (F.col("sim") < F.coalesce(F.lag("sim").over(_by_ord()), F.lit(2.0))) & (F.col("sim") <= F.coalesce(F.lead("sim").over(_by_ord()), F.lit(2.0)))

    def scan(rows: Iterator[tuple]) -> Iterable[tuple]:
        chapter, begin = -1, 0.0
        for ord_, start, end, low in rows:
            if chapter < 0 or (low and start - begin >= shortest) or end - begin > longest:
                chapter, begin = chapter + 1, start
            yield ord_, chapter

    marked = each.select("job_id", F.col("ord").cast("long").alias("ord"), "start", "end", F.coalesce(low, F.lit(False)).alias("low"))
    return sorted_scan(marked, ["ord"], scan, {"ord": "long", "chapter": "long"})
