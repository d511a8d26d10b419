"""Versioned edits of transcripts and what they make stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_title, is_blank
from .chapters import chapter_segments


def apply_text_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """New texts by segment id; times never change. ``unknown_edits`` lists ids that match nothing."""
    e = edits.filter("new_text IS NOT NULL").select("job_id", "segment_id", "new_text")
    out = segments.join(e, ["job_id", "segment_id"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")
    return out.withColumn("empty", is_blank(F.col("text")))


def unknown_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    return edits.join(segments.select("job_id", "segment_id"), ["job_id", "segment_id"], "left_anti")


def apply_speaker_edits(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """New speakers by segment id, if the job has that speaker already."""
    known = segments.select("job_id", F.col("speaker").alias("new_speaker")).distinct()
    e = edits.filter("new_speaker IS NOT NULL").select("job_id", "segment_id", "new_speaker").join(known, ["job_id", "new_speaker"], "left_semi")
    return segments.join(e, ["job_id", "segment_id"], "left").withColumn("speaker", F.coalesce("new_speaker", "speaker")).drop("new_speaker")


def restore(segments: DataFrame, original: DataFrame) -> DataFrame:
    """Text and speaker of the first version, where it has the segment."""
    o = original.select("job_id", "segment_id", F.col("text").alias("t0"), F.col("speaker").alias("p0"), F.lit(True).alias("had"))
    out = segments.join(o, ["job_id", "segment_id"], "left")
    return out.withColumn("text", F.when(F.col("had"), F.col("t0")).otherwise(F.col("text"))).withColumn("speaker", F.when(F.col("had"), F.col("p0")).otherwise(F.col("speaker"))).drop("t0", "p0", "had")


def changed_segments(current: DataFrame, original: DataFrame) -> DataFrame:
    o = original.select("job_id", "segment_id", F.col("text").alias("t0"), F.col("speaker").alias("p0"))
    met = current.join(o, ["job_id", "segment_id"])
    return met.filter(~(F.col("text").eqNullSafe(F.col("t0")) & F.col("speaker").eqNullSafe(F.col("p0")))).select("job_id", "segment_id")


def stale_chapters(changed: DataFrame, chapters: DataFrame) -> DataFrame:
    """Changed segments by the first chapter (by ``ord``) that owns them; those that none owns under ``-``."""
    owned = chapters.select("job_id", "ord", "chapter_id", F.explode("source_ids").alias("segment_id"))
    bridge = owned.groupBy("job_id", "segment_id").agg(F.min_by("chapter_id", "ord").alias("chapter_id"))
    met = changed.join(bridge, ["job_id", "segment_id"], "left").withColumn("chapter_id", F.coalesce("chapter_id", F.lit("-")))
    return met.groupBy("job_id", "chapter_id").agg(F.array_join(F.array_sort(F.collect_list("segment_id")), ",").alias("segments"))


def edited_chapters(chapters: DataFrame, current: DataFrame, original: DataFrame) -> DataFrame:
    """Chapters with a segment that differs from the original or is new."""
    o = original.select("job_id", "segment_id", F.col("text").alias("t0"), F.col("speaker").alias("p0"), F.lit(True).alias("had"))
    c = current.join(o, ["job_id", "segment_id"], "left")
    c = c.filter(F.col("had").isNull() | ~(F.col("text").eqNullSafe(F.col("t0")) & F.col("speaker").eqNullSafe(F.col("p0")))).select("job_id", "segment_id")
    return chapter_segments(chapters).join(c, ["job_id", "segment_id"], "left_semi").select("job_id", "chapter_id").distinct()


def apply_titles(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    out = chapters.join(titles.select("job_id", "chapter_id", "new_title"), ["job_id", "chapter_id"], "left")
    return out.withColumn("title", F.when(F.col("new_title").isNotNull(), clean_title(F.col("new_title"))).otherwise(F.col("title"))).drop("new_title")


def stale_notice(markers: DataFrame) -> DataFrame:
    """``job_id, notice`` of ``markers(job_id, reason, chapters: array<struct<chapter_id, title, n>>)``, a sentence without any text of
    segments."""
    each = F.transform("chapters", lambda c: F.concat(c["chapter_id"], F.when(F.coalesce(c["title"], F.lit("")) != "", F.concat(F.lit(" “"), c["title"], F.lit("”"))).otherwise(""), F.lit(" ("), c["n"].cast("string"), F.lit(")")))
    edited = F.when(F.size("chapters") <= 0, "The summary is out of date: the transcript was edited after it.").otherwise(F.concat(F.lit("The summary is out of date because of edits in chapters: "), F.array_join(each, ", "), F.lit(".")))
    return markers.select("job_id", F.when(F.col("reason") == "titles_edited", "The summary is out of date: chapter titles were changed after it.").otherwise(edited).alias("notice"))


def stale_markers(changed: DataFrame, chapters: DataFrame, reports: DataFrame) -> DataFrame:
    """``job_id, reason, chapters`` of the jobs of ``reports(job_id)`` with changed segments; without a report there is no marker."""
    by = stale_chapters(changed, chapters).join(chapters.select("job_id", "chapter_id", "title"), ["job_id", "chapter_id"], "left")
    rows = F.array_sort(F.collect_list(F.struct("chapter_id", F.coalesce("title", F.lit("")).alias("title"), F.size(F.split("segments", ",")).cast("long").alias("n"))))
    return by.join(reports.select("job_id").distinct(), "job_id", "left_semi").groupBy("job_id").agg(F.lit("transcript_edited").alias("reason"), rows.alias("chapters"))


def mark_titles_stale(markers: DataFrame, retitled: DataFrame, chapters: DataFrame, reports: DataFrame) -> DataFrame:
    """Markers with those of ``retitled(job_id)`` added: all chapters without a count. A marker of edited text stays as it is."""
    rows = F.array_sort(F.collect_list(F.struct("chapter_id", "title", F.lit(0).cast("long").alias("n"))))
    new = chapters.join(retitled.select("job_id").distinct(), "job_id", "left_semi").join(reports.select("job_id").distinct(), "job_id", "left_semi")
    new = new.join(markers.filter("reason = 'transcript_edited'"), "job_id", "left_anti").groupBy("job_id").agg(F.lit("titles_edited").alias("reason"), rows.alias("chapters"))
    return markers.join(new, "job_id", "left_anti").unionByName(new)


def _most_edits(longer: Column, min_confidence: float) -> Column:
    return F.floor((1 - min_confidence) * longer + 1e-9).cast("int")


def similar_words(words: DataFrame, terms: DataFrame, min_confidence: float = 0.6, shortest: int = 6, few_terms: int = 20_000) -> DataFrame:
    """All pairs ``found, term, far, confidence`` of ``words(found)`` and ``terms(term)``, of ``shortest`` letters or more, whose confidence
    ``1 - edits / longer length`` reaches the bound: an exact join.

    With at most k edits, one of k + 1 parts of the term stands unchanged in the word, and if it is part i, shifted by no more than the i
    edits before it or the k - i after it allow. Terms are joined by their parts, words by their substrings at those places; pairs
    whose letters alone differ too much go before their edits are counted. k follows from the two lengths. Up to ``few_terms``
    terms are counted and sent to all tasks (some ten parts each); more are shuffled with the words' substrings.
    """
    return _alike(words, terms, min_confidence, shortest, few_terms).distinct()


def _alike(words: DataFrame, terms: DataFrame, min_confidence: float, shortest: int, few_terms: int) -> DataFrame:
    """The pairs of ``similar_words``, some more than once."""
    wide = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a few bytes of words are much work
    reach = 1 / min_confidence
    letters = "aggregate(split({0}, ''), 0L, (a, c) -> a | shiftleft(1L, pmod(ascii(c), 64)))"
    known = terms.select("term").filter(F.length("term") >= shortest).distinct()
    few = known.limit(few_terms + 1).count() <= few_terms
    t = known.withColumn("n", F.length("term")).withColumn("t_letters", F.expr(letters.format("term")))
    lengths = F.sequence(F.ceil(F.col("n") * min_confidence - 1e-9).cast("int"), F.floor(F.col("n") * reach + 1e-9).cast("int"))
    k_of = lambda other: _most_edits(F.greatest(F.col("n"), other), min_confidence)
    t = t.withColumn("k", F.explode(F.array_distinct(F.transform(lengths, k_of)))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    # parts of n div (k + 1) letters, the last n mod (k + 1) of them one longer
    size = lambda n: F.expr(f"cast({n} div (k + 1) + if(i >= k + 1 - {n} % (k + 1), 1, 0) as int)")
    place = lambda n: F.expr(f"cast(i * ({n} div (k + 1)) + greatest(0, i - (k + 1 - {n} % (k + 1))) as int)")
    keyed = t.select("term", "t_letters", "n", "k", "i", F.substring("term", place("n") + 1, size("n")).alias("part"))
    w = words.select("found").filter(F.length("found") >= shortest).distinct().repartition(wide).withColumn("l", F.length("found")).withColumn("letters", F.expr(letters.format("found")))
    spans = F.sequence(F.greatest(F.lit(shortest), F.ceil(F.col("l") * min_confidence - 1e-9).cast("int")), F.floor(F.col("l") * reach + 1e-9).cast("int"))
    w = w.withColumn("n", F.explode(spans)).withColumn("k", _most_edits(F.greatest("n", "l"), min_confidence)).filter("abs(n - l) <= k").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    w = w.withColumn("p", place("n")).withColumn("size", size("n"))
    low, high = F.expr("greatest(0, p - i, p + l - n - (k - i))"), F.expr("least(l - size, p + i, p + l - n + (k - i))")
    w = w.withColumn("low", low).withColumn("high", high).filter("low <= high").withColumn("q", F.explode(F.sequence("low", "high")))
    w = w.select("found", "letters", "n", "l", "k", "i", F.substring("found", F.col("q") + 1, F.col("size")).alias("part"))
    key = ["n", "k", "i", "part"]
    met = w.join(F.broadcast(keyed), key) if few else w.repartition(wide, *key).join(keyed.repartition(wide, *key), key)
    met = met.filter("bit_count(letters & ~t_letters) <= k AND bit_count(t_letters & ~letters) <= k")
    met = met.withColumn("far", F.expr("levenshtein(found, term, k)")).filter("far >= 0")  # -1 beyond k
    return met.select("found", "term", "far", F.round(1 - F.col("far") / F.greatest("n", "l"), 6).alias("confidence"))


def suggest_terms(segments: DataFrame, dictionary: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """``job_id, segment_id, from, to, found, suggested, confidence, start, end``: for every place of a word of six letters or more that is no
    term, the dictionary term nearest to it (ties: the first by name) if its confidence reaches the bound.

    ``from`` and ``to`` are characters of the segment's text, ``found`` the word in lower case, ``start`` and ``end`` the segment's times. Different
    words are matched once (``similar_words``); the transcript itself is never changed.
    """
    runs = segments.select("job_id", "segment_id", "start", "end", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+|\P{L}+"), F.lit(0))).alias("pos", "run"))
    so_far = F.sum(F.length("run")).over(Window.partitionBy("job_id", "segment_id").orderBy("pos"))
    places = runs.withColumn("to", so_far).withColumn("found", F.lower("run")).filter((F.length("found") >= 6) & F.col("run").rlike(r"^\p{L}"))
    pairs = _alike(places.select("found"), dictionary, min_confidence, 6, 20_000)
    best = pairs.groupBy("found").agg(F.min(F.struct((-F.col("confidence")).alias("k"), "term")).alias("b")).select("found", F.col("b.term").alias("suggested"), (-F.col("b.k")).alias("confidence")).filter("confidence < 1")
    return places.join(best, "found").select("job_id", "segment_id", (F.col("to") - F.length("run")).cast("long").alias("from"), F.col("to").cast("long").alias("to"), "found", "suggested", "confidence", "start", "end")
