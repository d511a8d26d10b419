"""Model replies made into items whose every time is copied from its source."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import digit_groups_verified, is_blank, starts_with_stamp, title_error, word_count
from .chapters import chapter_segments, chapter_text
from .scan import sorted_scan

_ITEM = "array<struct<text:string,segment_ids:array<string>>>"
EXTRACT = f"struct<key_points:{_ITEM},actions:{_ITEM},open_questions:{_ITEM},asr_notes:array<struct<text:string>>>"


_KINDS = ("key_points", "actions", "open_questions")
_SHAPE = "ARRAY<OBJECT<segment_ids: ARRAY<STRING>, text: STRING>>"
_LISTS = {"actions": _SHAPE, "asr_notes": "ARRAY<OBJECT<text: STRING>>", "key_points": _SHAPE, "open_questions": _SHAPE}


def valid_extract(text: Column, payload: Column) -> Column:
    """Whether a reply and its parsed payload are whole: the four lists and no other key, items of a text and one segment id or more and
    nothing else, notes of a text; texts and ids are strings. Anything else spoils the whole reply."""
    shape = "OBJECT<" + ", ".join(f"{k}: ({v}|ARRAY<VOID>)" for k, v in _LISTS.items()) + ">"
    typed = F.schema_of_variant(F.try_parse_json(text)).rlike(f"^{shape}$")  # keys are in order of name; elements that lack a key do not show
    each = [F.forall(payload[k], lambda i: i["text"].isNotNull() & (F.size(i["segment_ids"]) > 0) & F.forall(i["segment_ids"], lambda x: x.isNotNull())) for k in _KINDS]
    notes = F.forall(payload["asr_notes"], lambda n: n["text"].isNotNull())
    return F.coalesce(typed & each[0] & each[1] & each[2] & notes, F.lit(False))


def parse_extract(replies: DataFrame) -> DataFrame:
    """``replies(job_id, chapter_id, attempt, text)`` to items; a reply that is not valid as a whole gives none."""
    parsed = parse_payload(replies, "extract").filter("ok")

    def items_of(kind: str) -> Column:
        return F.transform(F.col("payload")[kind], lambda i, at: F.struct(F.lit(kind).alias("kind"), at.alias("idx"), i["text"].alias("text"), i["segment_ids"].alias("segment_ids")))

    items = F.flatten(F.array(*map(items_of, _KINDS)))
    return parsed.select("job_id", "chapter_id", "attempt", F.explode(items).alias("i")).select("job_id", "chapter_id", "attempt", "i.*")


def hydrate_items(items: DataFrame, chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """Sources of each item with times and speaker from the segment; an item with any id outside its chapter is dropped."""
    src = items.select("job_id", "chapter_id", "attempt", "kind", "idx", "text", F.posexplode("segment_ids").alias("pos", "segment_id"))
    allowed = chapter_segments(chapters).select("job_id", "chapter_id", "segment_id").distinct()
    known = allowed.join(segments.select("job_id", "segment_id", "start", "end", "speaker"), ["job_id", "segment_id"])
    met = src.join(known, ["job_id", "chapter_id", "segment_id"], "left")
    item = Window.partitionBy("job_id", "chapter_id", "attempt", "kind", "idx")
    return met.withColumn("all", F.min(F.col("start").isNotNull().cast("int")).over(item)).filter("`all` = 1").drop("all")


def filter_digit_verified(items: DataFrame, chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """Key points whose digits all stand in the chapter's text; other kinds pass."""
    texts = chapter_text(chapters, segments, with_speaker=False).withColumnRenamed("text", "source")
    met = items.join(texts, ["job_id", "chapter_id"], "left")
    return met.filter((F.col("kind") != "key_points") | digit_groups_verified(F.col("text"), F.col("source"))).drop("source")


def select_replies(replies: DataFrame, chapters: DataFrame, max_attempts: int = 2) -> DataFrame:
    """``job_id, chapter_id, attempt, status, n_unknown`` of each chapter with replies: which reply counts as a whole.

    Attempts go in order, ``max_attempts`` at most. A valid reply whose ids all belong to its chapter is ``accepted``. Any other is asked
    for again: the last one is ``reduced`` if it is valid (its items with unknown ids are left out) and else ``failed``. A chapter whose
    attempts are not used up has status ``retry`` and the latest attempt. What later filters drop from a reply never causes a retry.
    """
    allowed = chapters.select("job_id", "chapter_id", F.col("source_ids").alias("allowed"))
    made = parse_payload(replies, "extract").join(allowed, ["job_id", "chapter_id"], "left")
    used = F.flatten(F.flatten(F.array(*(F.transform(F.col("payload")[k], lambda i: i["segment_ids"]) for k in _KINDS))))
    unknown = F.size(F.filter(used, lambda x: ~F.coalesce(F.array_contains("allowed", x), F.lit(False))))
    n = F.row_number().over(Window.partitionBy("job_id", "chapter_id").orderBy("attempt"))
    tries = made.select("job_id", "chapter_id", "attempt", "ok", F.when(F.col("ok"), unknown).alias("unknown"), n.alias("n")).filter(F.col("n") <= max_attempts)
    clean = F.min(F.when(F.col("ok") & (F.col("unknown") == 0), F.struct("n", "attempt")))
    out = tries.groupBy("job_id", "chapter_id").agg(clean.alias("clean"), F.max(F.struct("n", "attempt", "ok", "unknown")).alias("last"))
    status = F.when(F.col("clean").isNotNull(), "accepted").when(F.col("last.n") < max_attempts, "retry").when(F.col("last.ok"), "reduced").otherwise("failed")
    return out.select("job_id", "chapter_id", F.coalesce("clean.attempt", "last.attempt").alias("attempt"), status.alias("status"), F.when(F.col("clean").isNotNull(), 0).otherwise(F.col("last.unknown")).cast("long").alias("n_unknown"))


def build_insights(replies: DataFrame, chapters: DataFrame, segments: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Items with their sources, of the reply that counts for each chapter (``select_replies``): those with an unknown id go, then key points
    with digits that the chapter does not have. A chapter that waits for a retry or failed has no rows."""
    used = select_replies(replies, chapters, max_attempts).filter(F.col("status").isin("accepted", "reduced")).select("job_id", "chapter_id", "attempt")
    items = parse_extract(replies.join(used, ["job_id", "chapter_id", "attempt"], "left_semi"))
    found = filter_digit_verified(hydrate_items(items, chapters, segments), chapters, segments)
    return found.select("job_id", "chapter_id", "attempt", "kind", "idx", "pos", "text", "segment_id", "start", "end", "speaker")


def speaker_totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy("job_id", "speaker").agg(F.round(F.sum(F.col("end") - F.col("start")), 3).alias("speech_sec"))


def llm_budget(calls: DataFrame, most: int) -> DataFrame:
    """``calls(job_id, ord)``: whether each call is within the job's budget, and what remains after it."""
    n = F.row_number().over(Window.partitionBy("job_id").orderBy("ord"))
    return calls.select("job_id", "ord", (n <= most).alias("allowed"), F.greatest(F.lit(0), F.lit(most) - n).cast("long").alias("remaining"))


def clock_gate(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """Copied sources whose times or speaker are not exactly those of the segment."""
    truth = segments.select("job_id", "segment_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("speaker").alias("p"))
    met = sources.join(truth, ["job_id", "segment_id"], "left")
    same = F.col("start").eqNullSafe(F.col("s")) & F.col("end").eqNullSafe(F.col("e")) & F.col("speaker").eqNullSafe(F.col("p"))
    return met.groupBy("job_id").agg(F.count("*").alias("n_sources"), F.count(F.when(~same, 1)).alias("n_bad")).withColumn("ok", F.col("n_bad") == 0)


def clock_mismatches(insight_chapters: DataFrame, sources: DataFrame, chapters: DataFrame, segments: DataFrame, report_chapters: DataFrame | None = None, moments: DataFrame | None = None) -> DataFrame:
    """``job_id, kind, item``: every copied time, speaker or title that is not exactly that of its origin.

    ``chapter`` unknown or with other bounds than in ``chapters(job_id, chapter_id, start, end, title)``; ``segment`` unknown, ``source`` with
    other times or speaker than its segment; ``report chapter`` unknown or with other bounds or title; ``moment`` of
    ``moments(job_id, pos, start, end, speaker, chapter_id)`` that no source of a known segment has. All joins are on job and id.
    """
    c = chapters.select("job_id", "chapter_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("title").alias("c_title"), F.lit(True).alias("known"))
    equal = lambda *names: [F.col(n).eqNullSafe(F.col(f"c_{n}")) for n in names]

    def differs(df: DataFrame, kind: str, *names: str) -> DataFrame:
        met = df.join(c, ["job_id", "chapter_id"], "left")
        right = F.col("known")
        for e in equal(*names):
            right = right & e
        return met.filter(~F.coalesce(right, F.lit(False))).select("job_id", F.lit(kind).alias("kind"), F.col("chapter_id").alias("item"))

    truth = segments.select("job_id", "segment_id", F.struct("start", "end", "speaker").alias("truth"))
    met = sources.join(truth, ["job_id", "segment_id"], "left").withColumn("own", F.struct("start", "end", "speaker"))
    out = differs(insight_chapters, "chapter", "start", "end")
    wrong = met.filter(~F.col("own").eqNullSafe(F.col("truth")))
    out = out.unionByName(wrong.select("job_id", F.when(F.col("truth").isNull(), "segment").otherwise("source").alias("kind"), F.col("segment_id").alias("item")))
    if report_chapters is not None:
        out = out.unionByName(differs(report_chapters, "report chapter", "start", "end", "title"))
    if moments is not None:
        held = met.filter("truth IS NOT NULL").select("job_id", "start", "end", "speaker", "chapter_id").distinct()
        lost = moments.join(held, ["job_id", "start", "end", "speaker", "chapter_id"], "left_anti")
        out = out.unionByName(lost.select("job_id", F.lit("moment").alias("kind"), F.col("pos").cast("string").alias("item")))
    return out


REPORT = "struct<summary:string,key_moments:array<struct<text:string,chapter_id:string,segment_id:string>>>"


def hydrate_moments(replies: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """Key moments of ``replies(job_id, text)`` with times and speaker of ``sources(job_id, chapter_id, segment_id, start, end, speaker)``.

    A moment without a source is an error if ``strict``; else it is left out, and so is any but the first of the same source.
    """
    m = replies.select("job_id", F.posexplode(F.from_json("text", REPORT)["key_moments"]).alias("pos", "m")).select("job_id", "pos", "m.text", "m.chapter_id", "m.segment_id")
    key = ["job_id", "chapter_id", "segment_id"]
    known = sources.select(*key, "start", "end", "speaker").dropDuplicates(key).withColumn("known", F.lit(True))
    if strict:
        lost = F.raise_error(F.concat(F.lit("moment without a source: "), F.col("chapter_id"), F.lit("/"), F.col("segment_id"))).cast("double")
        return m.join(known, key, "left").withColumn("start", F.when(F.col("known").isNull(), lost).otherwise(F.col("start"))).drop("known")
    first = F.row_number().over(Window.partitionBy(*key).orderBy("pos"))
    return m.join(known, key).withColumn("first", first).filter("first = 1").drop("first", "known")


def build_report(replies: DataFrame, sources: DataFrame, chapters: DataFrame, segments: DataFrame, profile: str = "demo", strict: bool = False) -> DataFrame:
    """One row per job of ``replies``: summary, key moments, seconds of each speaker, chapters, and whether it is a draft."""
    moments = hydrate_moments(replies, sources, strict).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "start", "end", "speaker", "chapter_id"))).alias("key_moments"))
    speakers = speaker_totals(segments).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(F.col("speaker").alias("id"), "speech_sec"))).alias("speakers"))
    refs = chapters.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("chapter_id").alias("id"), "title", "start", "end"))).alias("chapters"))
    out = replies.select("job_id", F.from_json("text", REPORT)["summary"].alias("summary"))
    for part in (moments, speakers, refs):
        out = out.join(part, "job_id", "left")
    return out.withColumn("draft_warning", F.lit(profile == "demo"))


def title_errors(titles: DataFrame, max_words: int = 10) -> DataFrame:
    """``job_id, chapter_id, title, error`` of ``titles(job_id, ord, chapter_id, title)``, white space made single: a title is a duplicate if an earlier
    chapter of the job has the same one, whatever its case."""
    clean = titles.withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " ")))
    place = F.row_number().over(Window.partitionBy("job_id", F.lower("title")).orderBy("ord"))
    return clean.withColumn("__place", place).select("job_id", "chapter_id", "title", title_error(F.col("title"), F.col("__place") > 1, max_words).alias("error"))


def select_titles(replies: DataFrame, chapters: DataFrame, max_attempts: int = 2, max_words: int = 10) -> DataFrame:
    """``job_id, chapter_id, title, attempt``: first attempt of ``replies(job_id, chapter_id, attempt, text)`` that holds for each chapter.

    A title holds if it is JSON, not empty, not too long, without a stamp and not that of an earlier chapter of the job, whatever
    its case. A chapter whose attempts all fail has nulls. A scan of the job's chapters that holds
    the titles taken.
    """
    title = F.trim(F.regexp_replace(F.from_json("text", "struct<title:string>")["title"], r"\s+", " "))
    made = replies.filter(F.col("attempt") <= max_attempts).select("job_id", "chapter_id", "attempt", title.alias("title"))
    fair = made.filter(~is_blank(F.col("title")) & (word_count(F.col("title")) <= max_words) & ~starts_with_stamp(F.col("title"), strip_quotes=False))
    tries = fair.groupBy("job_id", "chapter_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "title", F.lower("title").alias("key")))).alias("c"))
    each = chapters.select("job_id", "chapter_id", "ord").join(tries, ["job_id", "chapter_id"], "left")

    def scan(rows: Iterator[tuple]) -> Iterable[tuple]:
        used = set()
        for _, chapter_id, tries in rows:
            pick = next((t for t in tries or () if t["key"] not in used), None)
            if pick:
                used.add(pick["key"])
            yield chapter_id, pick and pick["title"], pick and pick["attempt"]

    return sorted_scan(each.select("job_id", "ord", "chapter_id", "c"), ["ord"], scan, {"chapter_id": "string", "title": "string", "attempt": "int"})


PAYLOADS = {
    "extract": EXTRACT,
    "report": REPORT,
    "title": "struct<title:string>",
    "batch": "struct<titles:array<struct<id:string,title:string>>>",
}


def parse_payload(replies: DataFrame, task: str) -> DataFrame:
    """The columns of ``replies(..., text)``, ``ok`` and the typed ``payload`` (null if not ok).

    ``extract`` wants its four lists whole (``valid_extract``); ``report`` allows no unknown keys and wants a text for each moment; ``title`` and ``batch``
    ignore them and want titles of a character or more, a batch at least one.
    """
    known = {"extract": ["key_points", "actions", "open_questions", "asr_notes"], "report": ["summary", "key_moments"]}
    keys, p = F.json_object_keys("text"), F.col("payload")
    text = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    none = lambda kind: F.array().cast(kind)
    if task == "extract":
        good = valid_extract(F.col("text"), p)
    elif task == "report":
        good = p["summary"].isNotNull() & F.forall(F.coalesce(p["key_moments"], none("array<struct<text:string,chapter_id:string,segment_id:string>>")), lambda m: text(m["text"]) & text(m["chapter_id"]) & text(m["segment_id"]))
    elif task == "title":
        good = text(p["title"])
    else:
        good = (F.size(F.coalesce(p["titles"], none("array<struct<id:string,title:string>>"))) > 0) & F.forall(F.coalesce(p["titles"], none("array<struct<id:string,title:string>>")), lambda t: text(t["id"]) & text(t["title"]))
    strict = F.forall(keys, lambda k: k.isin(known[task])) if task in known else keys.isNotNull()
    out = replies.withColumn("payload", F.from_json("text", PAYLOADS[task])).withColumn("ok", F.coalesce(keys.isNotNull() & strict & good, F.lit(False)))
    return out.withColumn("payload", F.when(F.col("ok"), F.col("payload")))


def select_batch_titles(batches: DataFrame, singles: DataFrame, chapters: DataFrame, max_attempts: int = 2, max_words: int = 10) -> DataFrame:
    """``job_id, chapter_id, title, origin``: the first attempt of ``batches(job_id, attempt, text)`` whose titles hold for all chapters of the
    job; for jobs without one, titles chapter by chapter from ``singles`` as ``select_titles`` does."""
    made = parse_payload(batches.filter(F.col("attempt") <= max_attempts), "batch").filter("ok").select("job_id", "attempt", F.posexplode("payload.titles").alias("pos", "t"))
    made = made.groupBy("job_id", "attempt", F.col("t.id").alias("chapter_id")).agg(F.max_by("t.title", "pos").alias("title"))  # the last of an id counts
    tries = batches.filter(F.col("attempt") <= max_attempts).select("job_id", "attempt").distinct()
    each = chapters.select("job_id", "chapter_id", "ord").join(tries, "job_id").join(made, ["job_id", "attempt", "chapter_id"], "left")
    each = each.withColumn("title", F.trim(F.regexp_replace("title", r"\s+", " ")))
    first = F.row_number().over(Window.partitionBy("job_id", "attempt", F.lower("title")).orderBy("ord"))
    fair = F.coalesce(~is_blank(F.col("title")) & (word_count(F.col("title")) <= max_words) & ~starts_with_stamp(F.col("title"), strip_quotes=False) & (first == 1), F.lit(False))
    whole = each.withColumn("fair", fair).groupBy("job_id", "attempt").agg(F.min(F.col("fair").cast("int")).alias("all")).filter("`all` = 1").groupBy("job_id").agg(F.min("attempt").alias("attempt"))
    batch = each.join(whole, ["job_id", "attempt"]).select("job_id", "chapter_id", "title", F.lit("batch").alias("origin"))
    rest = chapters.join(whole.select("job_id"), "job_id", "left_anti")
    return batch.unionByName(select_titles(singles, rest, max_attempts, max_words).select("job_id", "chapter_id", "title", F.lit("single").alias("origin")))


def build_prompts(template: str, chapters: DataFrame, segments: DataFrame) -> DataFrame:
    """``job_id, chapter_id, prompt``: ``template`` with the chapter's ``chapter_id, title, start, end``, its ``chapter_text`` (``speaker: text`` of
    segments with text) and its ``src_catalog`` (id, times and speaker of every segment) for the names in double braces.

    A name that stays unfilled is an error.
    """
    met = chapter_segments(chapters).join(segments.select("job_id", "segment_id", "speaker", "text", "start", "end"), ["job_id", "segment_id"])
    line = F.when(~is_blank(F.col("text")), F.concat(F.col("speaker"), F.lit(": "), F.trim("text")))
    entry = F.concat_ws(" | ", "segment_id", F.format_string("%.3f-%.3f", "start", "end"), "speaker")
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), entry.alias("entry"))))
    texts = met.groupBy("job_id", "chapter_id").agg(rows.alias("r"))
    texts = texts.select("job_id", "chapter_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("chapter_text"), F.array_join(F.transform("r", lambda x: x["entry"]), "\n").alias("src_catalog"))
    full = chapters.join(texts, ["job_id", "chapter_id"], "left")
    values = {"chapter_id": F.col("chapter_id"), "title": F.col("title"), "start": F.format_string("%.3f", "start"), "end": F.format_string("%.3f", "end"), "chapter_text": F.col("chapter_text"), "src_catalog": F.col("src_catalog")}
    left = [name for name in re.findall(r"\{\{(\w+)\}\}", template) if name not in values]
    if left:
        raise ValueError(f"unfilled names in the template: {', '.join(left)}")
    parts = re.split(r"\{\{(\w+)\}\}", template)  # texts and names in turn, so a value with braces is never filled itself
    return full.select("job_id", "chapter_id", F.concat(*(F.lit(x) if i % 2 == 0 else F.coalesce(values[x], F.lit("")) for i, x in enumerate(parts))).alias("prompt"))
