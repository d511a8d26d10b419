"""Registered queries of gates, glue checks, limits, artifacts and markers, and SQL for queries that are folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chapters as C
from ..operators import clustering as E
from ..operators import edits as I
from ..operators import evaluate as J
from ..operators import gates as H
from ..operators import insights as G
from ..operators import jobs as K
from ..sources import artifacts as A
from . import fixtures as X
from .recordings import _BRIDGE, _DUR, _EDITED, _MOMENTS, _WORDS, _durations, _now, _report_replies, _table, _title_replies, _unit_vectors, bent_hypothesis
from .registry import SQL, query

_STAMPED = "regexp_matches(lower(regexp_replace({0}, '^[\\s«\"''(\\[{{`]+', '')), '^(in this segment|this chapter|the speaker|here is)')"
_STATUS = "CASE WHEN coalesce(n, 0) > 0 THEN 'fail' ELSE 'pass' END AS status, coalesce(n, 0)::VARCHAR AS value"


def _gate(rows: list[tuple[str, str]], jobs: str) -> str:
    return " UNION ALL ".join(f"SELECT job_id, '{name}' AS check_id, {_STATUS} FROM {jobs} LEFT JOIN ({sql}) USING (job_id)" for name, sql in rows)


SQL["h4_chapter_gate"] = f"""WITH {X.CHAPTERS}, {_BRIDGE}, jb AS (SELECT DISTINCT job_id FROM chapters), own AS (SELECT job_id, chapter_id, arg_min(s."start", pos) AS s, arg_max(s."end", pos) AS e FROM bridge JOIN segments s USING (job_id, segment_id) GROUP BY ALL),
 lb AS (SELECT job_id, lower(trim(title)) AS t, count(*) AS k FROM chapters GROUP BY ALL), dn AS (SELECT job_id, round(count(*) / ((SELECT max("end") FROM segments s WHERE s.job_id = c.job_id) / 60), 3) AS n FROM chapters c GROUP BY job_id),
 fx AS ({_gate([('G2.1', 'SELECT c.job_id, count(*) FILTER (c."start" <> own.s OR c."end" <> own.e) AS n FROM chapters c JOIN own USING (job_id, chapter_id) GROUP BY c.job_id'), ('G2.4', f"SELECT job_id, count(*) FILTER ({_WORDS.format('title')} > 10) AS n FROM chapters GROUP BY job_id"), ('G2.5', "SELECT job_id, count(*) FILTER (regexp_matches(lower(trim(title)), '^(in this segment|this chapter|the speaker|here is)')) AS n FROM chapters GROUP BY job_id"), ('G2.6', "SELECT job_id, sum(CASE WHEN t = '' THEN k WHEN k > 1 THEN 1 ELSE 0 END)::BIGINT AS n FROM lb GROUP BY job_id"), ('G2.7', "SELECT job_id, count(*) FILTER (c <> 1) AS n FROM (SELECT s.job_id, s.segment_id, count(chapter_id) AS c FROM segments s LEFT JOIN bridge b USING (job_id, segment_id) WHERE trim(text) <> '' GROUP BY ALL) GROUP BY job_id")], 'jb')})
 SELECT * FROM fx UNION ALL SELECT job_id, 'G2.2', CASE WHEN n BETWEEN 0.4 AND 0.8 THEN 'pass' WHEN n BETWEEN 0.3 AND 1.0 THEN 'warn' ELSE 'fail' END, printf('%.3f', n::DOUBLE) FROM dn
 UNION ALL SELECT job_id, 'G2.3', CASE WHEN n > 0 THEN 'warn' ELSE 'pass' END, n::VARCHAR FROM (SELECT job_id, count(*) FILTER (round("end" - "start", 3) < 45 OR round("end" - "start", 3) > 180) AS n FROM chapters GROUP BY job_id)"""


def _insights(spark, d):
    """Three kinds of items for each chapter, some with invented digits, stamps, unknown or shifted sources, or none."""
    c = X.chapters(spark, d).withColumn("kind", F.explode(F.array(*map(F.lit, ("key_points", "actions", "open_questions")))))
    text = F.when(F.col("job_id") % 5 == 2, F.concat("title", F.lit(" 98765"))).when(F.col("job_id") % 7 == 1, F.concat(F.lit("«Here is "), "title")).otherwise(F.col("title"))
    items = c.select("job_id", "chapter_id", "kind", F.lit(0).alias("idx"), text.alias("text"), "ord", "source_ids")
    ids = F.when(F.col("ord") % 4 == 3, F.array().cast("array<string>")).when(F.col("job_id") % 7 == 3, F.array(F.lit("s9999"), F.col("source_ids")[0])).otherwise(F.slice("source_ids", 1, 2))
    src = items.select("job_id", "chapter_id", "kind", "idx", F.explode(ids).alias("segment_id"))
    s = X.segments(spark, d).select("job_id", "segment_id", "start", "end", "speaker")
    src = src.join(s, ["job_id", "segment_id"], "left").withColumn("start", F.when(F.col("job_id") % 11 == 4, F.col("start") + 0.5).otherwise(F.col("start")))
    return items.drop("ord", "source_ids"), src


_INSIGHTS = f"""{X.CHAPTERS}, {_BRIDGE}, it AS (SELECT job_id, chapter_id, unnest(['key_points', 'actions', 'open_questions']) AS kind, CASE WHEN job_id % 5 = 2 THEN title || ' 98765' WHEN job_id % 7 = 1 THEN '«Here is ' || title ELSE title END AS text,
 CASE WHEN ord % 4 = 3 THEN [] WHEN job_id % 7 = 3 THEN ['s9999', source_ids[1]] ELSE source_ids[1:2] END AS ids FROM chapters), jb AS (SELECT DISTINCT job_id FROM it),
 sr AS (SELECT i.job_id, chapter_id, kind, i.segment_id, CASE WHEN i.job_id % 11 = 4 THEN s."start" + 0.5 ELSE s."start" END AS "start", s."end", speaker, s."start" AS s0 FROM (SELECT job_id, chapter_id, kind, unnest(ids) AS segment_id FROM it) i LEFT JOIN segments s USING (job_id, segment_id)),
 tx AS (SELECT job_id, chapter_id, string_agg(s.text, ' ' ORDER BY pos) AS src FROM bridge JOIN segments s USING (job_id, segment_id) GROUP BY ALL)"""


@query("h5_insight_gate", f"""WITH {_INSIGHTS}, fx AS ({_gate([('G3.1', 'SELECT job_id, count(*) FILTER ("start" IS DISTINCT FROM s0) AS n FROM sr GROUP BY job_id'), ('G3.2', 'SELECT job_id, count(*) AS n FROM sr ANTI JOIN bridge USING (job_id, chapter_id, segment_id) GROUP BY job_id'), ('G3.3', "SELECT job_id, count(*) AS n FROM it WHERE kind = 'key_points' AND len(ids) = 0 GROUP BY job_id"), ('G3.4', "SELECT job_id, count(*) AS n FROM (SELECT it.job_id, src, unnest(regexp_extract_all(text, '[0-9]+')) AS g FROM it LEFT JOIN tx USING (job_id, chapter_id) WHERE kind = 'key_points') WHERE NOT contains(coalesce(src, ''), g) GROUP BY job_id"), ('G3.7', f"SELECT job_id, count(*) AS n FROM it WHERE kind = 'key_points' AND {_STAMPED.format('text')} GROUP BY job_id")], 'jb')}) SELECT * FROM fx""")
def h5_insight_gate(spark, d):
    return H.insight_gate(*_insights(spark, d), X.chapters(spark, d), X.segments(spark, d))


def _protocol(spark, d):
    """A report for each job: the first title as summary, a moment for each chapter; in some the summary or a time is wrong."""
    c = X.chapters(spark, d)
    s = X.segments(spark, d).select("job_id", F.col("segment_id").alias("sid"), F.col("start").alias("s"), F.col("end").alias("e"), "speaker")
    first = c.select("job_id", "chapter_id", "ord", "title", F.col("source_ids")[0].alias("sid")).join(s, ["job_id", "sid"])
    moments = first.select("job_id", F.col("title").alias("text"), F.when((F.col("job_id") % 3 == 1) & (F.col("ord") == 0), F.col("s") + 1.0).otherwise(F.col("s")).alias("start"), F.col("e").alias("end"), "speaker", "chapter_id")
    reports = c.filter("ord = 0").select("job_id", F.when(F.col("job_id") % 5 == 3, F.concat("title", F.lit(". This chapter is long"))).otherwise(F.col("title")).alias("summary"), (F.col("job_id") % 4 != 2).alias("draft_warning"))
    sources = first.select("job_id", "chapter_id", F.col("s").alias("start"), F.col("e").alias("end"), "speaker")
    return reports, moments, sources


@query("h6_protocol_gate", f"""WITH {_MOMENTS}, rp AS (SELECT job_id, CASE WHEN job_id % 5 = 3 THEN title || '. This chapter is long' ELSE title END AS summary, job_id % 4 <> 2 AS draft FROM chapters WHERE ord = 0),
 sd AS (SELECT job_id, unnest(regexp_split_to_array(summary, '[.!?]\\s+|\\n+')) AS text FROM rp UNION ALL SELECT job_id, text FROM mo), cn AS (SELECT job_id, count(*) AS n FROM mo GROUP BY job_id), fx AS ({_gate([('G3.1', "SELECT job_id, count(*) AS n FROM mo WHERE job_id % 3 = 1 AND chapter_id = 'C00' GROUP BY job_id"), ('G3.7', f"SELECT job_id, count(*) AS n FROM sd WHERE {_STAMPED.format('text')} GROUP BY job_id"), ('G3.8', 'SELECT job_id, 1 AS n FROM rp WHERE NOT draft')], '(SELECT job_id FROM rp)')})
 SELECT * FROM fx UNION ALL SELECT job_id, 'G3.6', CASE WHEN coalesce(n, 0) BETWEEN 5 AND 12 THEN 'pass' ELSE 'warn' END, coalesce(n, 0)::VARCHAR FROM rp LEFT JOIN cn USING (job_id)""")
def h6_protocol_gate(spark, d):
    return H.protocol_gate(*_protocol(spark, d))


# ---- glue and markers


_BAGS = """{0} AS (SELECT job_id, w, count(*) AS k FROM (SELECT job_id, unnest(string_split(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS w FROM {1}) WHERE w <> '' GROUP BY ALL)"""


@query("j4_transcript_checks", f"""WITH {X.HYPOTHESIS}, {_DUR.format('segments')}, {_BAGS.format('hb', 'hypothesis')}, {_BAGS.format('bb', 'segments')}, bg AS (SELECT job_id, sum(h.k) AS nh, sum(b.k) AS nb, coalesce(sum(b.k) FILTER (h.k IS NOT NULL), 0) AS cov FROM hb h FULL JOIN bb b USING (job_id, w) GROUP BY job_id),
 g AS (SELECT job_id, count(*) FILTER ("start" < ps) AS dis, count(*) FILTER (pe - "start" > 0.25) AS laps, max("end") AS last FROM (SELECT *, lag("start") OVER w AS ps, lag("end") OVER w AS pe FROM hypothesis WINDOW w AS (PARTITION BY job_id ORDER BY ord)) GROUP BY job_id),
 j AS (SELECT job_id, coalesce(dis, 0) AS dis, coalesce(laps, 0) AS laps, coalesce(last, 0) <= duration + 1 AS inside, CASE WHEN coalesce(nb, 0) = 0 THEN 1 ELSE cov / nb END AS cover, CASE WHEN coalesce(nb, 0) = 0 THEN 1 ELSE coalesce(nh, 0) / nb END AS ratio FROM durations LEFT JOIN g USING (job_id) LEFT JOIN bg USING (job_id))
 SELECT job_id, 'T1_time_order' AS check_id, CASE WHEN dis = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM j UNION ALL SELECT job_id, 'T2_overlap', CASE WHEN laps = 0 THEN 'PASS' ELSE 'WARN' END FROM j UNION ALL SELECT job_id, 'T3_inside_part', CASE WHEN inside THEN 'PASS' ELSE 'FAIL' END FROM j
 UNION ALL SELECT job_id, 'T4_text_coverage', CASE WHEN cover >= 0.85 THEN 'PASS' WHEN cover >= 0.7 THEN 'WARN' ELSE 'FAIL' END FROM j UNION ALL SELECT job_id, 'T5_length_ratio', CASE WHEN ratio BETWEEN 0.75 AND 1.35 THEN 'PASS' ELSE 'WARN' END FROM j""")
def j4_transcript_checks(spark, d):
    s = X.segments(spark, d)
    return J.transcript_checks(X.hypothesis(spark, d), s, _durations(s))


@query("j5_turns_glue", f"""WITH {X.HYPOTHESIS}, st AS (SELECT job_id, count(*) AS n, count(*) FILTER (sec >= 10) AS l FROM (SELECT job_id, speaker, sum("end" - "start") AS sec FROM segments GROUP BY ALL) GROUP BY job_id), sh AS (SELECT job_id, count(*) AS n, count(*) FILTER (sec >= 10) AS l FROM (SELECT job_id, speaker, sum("end" - "start") AS sec FROM hypothesis GROUP BY ALL) GROUP BY job_id)
 SELECT job_id, 'D1_speaker_count' AS check_id, CASE WHEN coalesce(sh.n, 0) = st.n THEN 'PASS' ELSE 'WARN' END AS status FROM st LEFT JOIN sh USING (job_id) UNION ALL SELECT job_id, 'D2_large_speakers_ge30s', CASE WHEN coalesce(sh.l, 0) = st.l THEN 'PASS' ELSE 'WARN' END FROM st LEFT JOIN sh USING (job_id)""")
def j5_turns_glue(spark, d):
    return J.turns_glue(X.hypothesis(spark, d), X.segments(spark, d), 10.0)


@query("j7_hotspot", f"""WITH {X.HYPOTHESIS}, nw AS (SELECT job_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS new_ids FROM hypothesis h WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.job_id = h.job_id AND s.speaker = h.speaker) GROUP BY job_id)
 SELECT job_id, coalesce(new_ids, '') AS new_ids, n_hotspot, hotspot_sec FROM (SELECT job_id, count(*) FILTER ("end" > 10 AND "start" < 25) AS n_hotspot, round(coalesce(sum("end" - "start") FILTER ("end" > 10 AND "start" < 25), 0), 3) AS hotspot_sec FROM hypothesis GROUP BY job_id) LEFT JOIN nw USING (job_id)""")
def j7_hotspot(spark, d):
    return J.new_speakers_and_hotspot(X.hypothesis(spark, d), X.segments(spark, d), 10.0, 25.0)


@query("j8_grid_variants", f"""WITH {X.HYPOTHESIS}, {_DUR.format('segments')}, r AS (SELECT 'base' AS variant, job_id, text, "end" - "start" AS d FROM segments UNION ALL SELECT 'thin', job_id, text, "end" - "start" FROM hypothesis), g AS (SELECT variant, job_id, round(sum(d) / any_value(duration), 6) AS cover, round(quantile_cont(d, 0.5), 6) AS median_sec, count(*) FILTER ({_WORDS.format('text')} <= 3) AS n_short FROM r JOIN durations USING (job_id) GROUP BY ALL)
 SELECT g.variant, g.job_id, g.cover, g.median_sec, g.n_short, round(100 * (g.cover - b.cover), 3) AS delta_pp, round(100 * (g.cover - b.cover), 3) <= -5 AS warn FROM g JOIN g b ON b.job_id = g.job_id AND b.variant = 'base'""")
def j8_grid_variants(spark, d):
    s, h = X.segments(spark, d), X.hypothesis(spark, d)
    part = lambda df, name: df.select(F.lit(name).alias("variant"), "job_id", "ord", "start", "end", "text")
    return J.grid_variants(part(s, "base").unionByName(part(h, "thin")), _durations(s), "base")


@query("j10_wer")
def j10_wer(spark, d):
    return J.wer(X.segments(spark, d), bent_hypothesis(spark, d), 0.2)


@query("j10_error_rates")
def j10_error_rates(spark, d):
    return J.error_rates(J.wer(X.segments(spark, d), bent_hypothesis(spark, d), 0.2))


_STALE = f"""{_EDITED}, {_BRIDGE}, sc AS (SELECT job_id, coalesce(c, '-') AS chapter_id, count(*) AS n FROM changed LEFT JOIN (SELECT job_id, segment_id, min(chapter_id) AS c FROM bridge GROUP BY ALL) USING (job_id, segment_id) WHERE job_id % 4 <> 1 GROUP BY ALL),
 nt AS (SELECT sc.job_id, 'The summary is out of date because of edits in chapters: ' || string_agg(sc.chapter_id || CASE WHEN coalesce(title, '') <> '' THEN ' “' || title || '”' ELSE '' END || ' (' || n || ')', ', ' ORDER BY sc.chapter_id) || '.' AS notice FROM sc LEFT JOIN chapters c ON c.job_id = sc.job_id AND c.chapter_id = sc.chapter_id GROUP BY sc.job_id)"""


def _marked(spark, d):
    s = X.segments(spark, d)
    reports = s.filter("job_id % 4 <> 1").select("job_id").distinct()
    return I.stale_markers(I.changed_segments(_now(spark, d), s), X.chapters(spark, d), reports), reports


@query("i6_stale_notice", f"WITH {_STALE} SELECT job_id, notice FROM nt")
def i6_stale_notice(spark, d):
    return I.stale_notice(_marked(spark, d)[0])


@query("i8_mark_titles_stale", f"""WITH {_STALE} SELECT job_id, 'transcript_edited' AS reason, count(*) AS n_chapters FROM sc GROUP BY job_id UNION ALL SELECT job_id, 'titles_edited', count(*) FROM chapters WHERE job_id % 3 = 0 AND job_id % 4 <> 1 AND job_id NOT IN (SELECT job_id FROM sc) GROUP BY job_id""")
def i8_mark_titles_stale(spark, d):
    markers, reports = _marked(spark, d)
    c = X.chapters(spark, d)
    return I.mark_titles_stale(markers, c.filter("job_id % 3 = 0").select("job_id"), c, reports).select("job_id", "reason", F.size("chapters").cast("long").alias("n_chapters"))


@query("k5_stale_staging", """SELECT event_id::VARCHAR AS staging_id FROM events WHERE TIMESTAMP '2024-01-20' - CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 1 HOUR ELSE date_trunc('second', ts) END >= INTERVAL 6 HOURS""")
def k5_stale_staging(spark, d):
    ts = F.col("ts").cast("timestamp")
    staged = _table(spark, d, "events").select(F.col("event_id").cast("string").alias("staging_id"), F.when(F.col("event_id") % 5 == 0, "unknown").otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"), (ts + F.expr("INTERVAL 1 HOUR")).alias("modified"))
    return K.stale_staging(staged, F.lit("2024-01-20 00:00:00").cast("timestamp"))


# ---- chapters and speakers


@query("f5_build_chapters")
def f5_build_chapters(spark, d):
    v = _unit_vectors(spark, d).select("job_id", "unit", "vector")
    out = C.build_chapters(X.segments(spark, d), v, threshold=0.1, least=9.0)
    return out.select("job_id", "ord", "chapter_id", "start", "end", F.array_join("source_ids", ",").alias("sources"), F.array_join("speakers", ",").alias("speakers"), "duration_sec")


def _split_jobs(spark, d, size=3):
    """Jobs as parts of ``size`` segments: the parts, and segments in the time of their part with ids of their own."""
    s = X.segments(spark, d).withColumn("part_id", F.format_string("part%02d", F.expr(f"ord div {size}")))
    parts = s.groupBy("job_id", "part_id").agg(F.min("start").alias("start"))
    local = s.join(parts.withColumnRenamed("start", "shift"), ["job_id", "part_id"])
    return parts, local.select("job_id", "part_id", (F.col("ord") % size).alias("ord"), F.format_string("p%d", F.col("ord") % size).alias("segment_id"), "speaker", "text", F.round(F.col("start") - F.col("shift"), 3).alias("start"), F.round(F.col("end") - F.col("shift"), 3).alias("end"))


@query("f7_merge_continuous")
def f7_merge_continuous(spark, d):
    from ..operators.planning import merge_parts_continuous

    v = _unit_vectors(spark, d).select("job_id", "unit", "vector")
    out = merge_parts_continuous(*_split_jobs(spark, d), v, threshold=0.1, least=9.0)[1]
    return out.select("job_id", "ord", "chapter_id", "start", "end", F.array_join("source_ids", ",").alias("sources"), F.array_join("speakers", ",").alias("speakers"), "duration_sec")


@query("f7_merge_blocks", f"""WITH {X.SEGMENTS} SELECT job_id, count(*) AS n_merged, count(*) AS n_expected, true AS count_match, true AS blocks_kept FROM segments GROUP BY job_id""")
def f7_merge_blocks(spark, d):
    from ..operators.planning import merge_blocks, merge_parts_continuous

    parts, local = _split_jobs(spark, d)
    v = _unit_vectors(spark, d).select("job_id", "unit", "vector")
    return merge_blocks(merge_parts_continuous(parts, local, v)[0], local)


@query("e6_update_gallery")
def e6_update_gallery(spark, d):
    v = X.vectors(spark, d).withColumn("speaker", F.format_string("SPEAKER_%02d", F.col("label")))
    early = E.speaker_centroids(v.filter("ord < 50"))
    return E.update_gallery(v.filter("ord >= 50").drop("speaker"), early, 0.5)[1].select("job_id", "speaker", "n_windows", F.round(F.col("centroid")[0], 6).alias("first"))


@query("e7_refine_reassign")
def e7_refine_reassign(spark, d):
    v = X.vectors(spark, d).withColumn("speaker", F.format_string("SPEAKER_%02d", F.col("label")))
    return E.refine_reassign(v.filter("ord >= 50").drop("speaker"), E.speaker_centroids(v.filter("ord < 50")), 0.5)


@query("e7_clear_winner")
def e7_clear_winner(spark, d):
    v = X.vectors(spark, d).withColumn("speaker", F.format_string("SPEAKER_%02d", F.col("label")))
    return E.clear_winner(v.filter("ord >= 50").drop("speaker"), E.speaker_centroids(v.filter("ord < 50")), 0.7)


# ---- artifacts and limits


@query("a3_validate_rows", f"""WITH {X.INTERVALS}, e AS (SELECT job_id, CASE WHEN "start" < 0 THEN 'negative' WHEN round("end", 3) <= round("start", 3) THEN 'empty' WHEN "start" < lag("start") OVER (PARTITION BY job_id ORDER BY ord) THEN 'order' END AS e FROM intervals)
 SELECT job_id, coalesce(string_agg(DISTINCT e, ',' ORDER BY e), '') AS errors, count(e) = 0 AS ok FROM e GROUP BY job_id""")
def a3_validate_rows(spark, d):
    return A.validate_rows(X.intervals(spark, d)).withColumn("errors", F.array_join("errors", ","))


@query("a5_nest_and_explode", f"""WITH {X.SEGMENTS} SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1 AS ord, segment_id AS id, speaker, text, "start", "end" FROM segments""")
def a5_nest_and_explode(spark, d):
    rows = X.segments(spark, d).select("job_id", "ord", F.col("segment_id").alias("id"), "speaker", "text", "start", "end")
    return A.explode_artifact(A.nest_artifact(rows, "segments"), "transcript")


@query("a6_convert_legacy", """SELECT conv_id, turn, printf('s%04d', turn) AS id, 't' || printf('%04d', turn) AS turn_id, CASE WHEN turn % 4 = 0 THEN 'SPEECH' ELSE role END AS speaker, trim(text) = '' AS empty FROM conversations""")
def a6_convert_legacy(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("id"), F.lit(None).cast("string").alias("turn_id"), F.when(F.col("turn") % 4 != 0, F.col("role")).alias("speaker"), "text")
    return A.convert_legacy_transcript(rows).select("conv_id", "turn", "id", "turn_id", "speaker", "empty")


_SPAN = "'- [' || printf('%02d:%02d', CAST(floor({0}.\"start\") AS BIGINT) // 60, CAST(floor({0}.\"start\") AS BIGINT) % 60) || '–' || printf('%02d:%02d', CAST(floor({0}.\"end\") AS BIGINT) // 60, CAST(floor({0}.\"end\") AS BIGINT) % 60) || '] '"


@query("a9_report_markdown", f"""WITH {X.CHAPTERS}, c AS (SELECT job_id, string_agg({_SPAN.format('chapters')} || title || ' (' || chapter_id || ')', chr(10) ORDER BY ord) AS c, min_by(title, ord) AS summary FROM chapters GROUP BY job_id),
 m AS (SELECT g.job_id, string_agg({_SPAN.format('g')} || h.title || ' (' || g.speaker || ', ' || chapter_id || ')', chr(10) ORDER BY h.ord) AS m FROM segments g JOIN chapters h ON h.job_id = g.job_id AND g.segment_id = h.source_ids[1] WHERE g.job_id % 3 <> 1 GROUP BY g.job_id),
 s AS (SELECT job_id, string_agg('- ' || speaker || CASE WHEN speaker = 'user' THEN ' — the user' ELSE '' END || ': ' || printf('%.3f', sec), chr(10) ORDER BY speaker) AS s FROM (SELECT job_id, speaker, round(sum("end" - "start"), 3)::DOUBLE AS sec FROM segments GROUP BY ALL) GROUP BY job_id)
 SELECT job_id, '# Report' || chr(10) || chr(10) || CASE WHEN job_id % 2 = 0 THEN '> draft' || chr(10) || chr(10) ELSE '' END || trim(summary) || chr(10) || chr(10) || '## Key moments' || chr(10) || coalesce(m, '') || chr(10) || chr(10) || '## Chapters' || chr(10) || c || chr(10) || chr(10) || '## Speakers' || chr(10) || s || chr(10) AS md FROM c JOIN s USING (job_id) LEFT JOIN m USING (job_id)""")
def a9_report_markdown(spark, d):
    from ..operators.insights import speaker_totals

    c, g = X.chapters(spark, d), X.segments(spark, d)
    jobs = c.filter("ord = 0").select("job_id", F.col("title").alias("summary"), (F.col("job_id") % 2 == 0).alias("draft"))
    first = c.filter("job_id % 3 <> 1").select("job_id", F.col("ord").alias("pos"), "chapter_id", F.col("title").alias("text"), F.col("source_ids")[0].alias("segment_id"))
    moments = first.join(g.select("job_id", "segment_id", "start", "end", "speaker"), ["job_id", "segment_id"])
    speakers = speaker_totals(g).withColumn("label", F.when(F.col("speaker") == "user", "the user"))
    return A.render_report_markdown(jobs, c, speakers, moments)



# ---- replies and prompts

_PROMPT = "Chapter {{chapter_id}} ({{start}} to {{end}}): {{title}}\n{{chapter_text}}\n---\n{{src_catalog}}"


@query("b21_build_prompts", f"""WITH {X.CHAPTERS}, {_BRIDGE}, t AS (SELECT job_id, chapter_id, string_agg(speaker || ': ' || trim(text), chr(10) ORDER BY pos) FILTER (trim(text) <> '') AS tx, string_agg(segment_id || ' | ' || printf('%.3f-%.3f', "start", "end") || ' | ' || speaker, chr(10) ORDER BY pos) AS ct FROM bridge JOIN segments USING (job_id, segment_id) GROUP BY ALL)
 SELECT job_id, chapter_id, 'Chapter ' || chapter_id || ' (' || printf('%.3f to %.3f', "start", "end") || '): ' || title || chr(10) || coalesce(tx, '') || chr(10) || '---' || chr(10) || ct AS prompt FROM chapters JOIN t USING (job_id, chapter_id)""")
def b21_build_prompts(spark, d):
    return G.build_prompts(_PROMPT, X.chapters(spark, d), X.segments(spark, d))


@query("g1_parse_titles", f"""WITH {X.CHAPTERS}, t AS (SELECT *, first(title) OVER (PARTITION BY job_id ORDER BY ord) AS f FROM chapters) SELECT job_id, chapter_id, attempt, CASE WHEN attempt = 2 THEN true WHEN ord % 3 = 1 THEN false WHEN ord % 3 = 2 THEN f <> '' ELSE title <> '' END AS ok FROM t, (VALUES (1), (2)) a(attempt)""")
def g1_parse_titles(spark, d):
    return G.parse_payload(_title_replies(spark, d), "title").select("job_id", "chapter_id", "attempt", "ok")


@query("g1_parse_reports", f"""WITH {X.CHAPTERS} SELECT job_id, min(title) FILTER (title = '') IS NULL AND job_id % 4 <> 3 AS ok FROM chapters GROUP BY job_id""")
def g1_parse_reports(spark, d):
    extra = F.regexp_replace("text", r"^\{", '{"other":1,')
    r = _report_replies(spark, d).withColumn("text", F.when(F.col("job_id") % 4 == 3, extra).otherwise(F.col("text")))
    return G.parse_payload(r, "report").select("job_id", "ok")


def _batches(spark, d):
    """Two replies with the titles of all chapters; every third job lacks one, another third has no JSON at first."""
    c = X.chapters(spark, d).withColumn("t", F.struct(F.col("chapter_id").alias("id"), F.concat_ws(" ", "title", "chapter_id").alias("title")))
    listed = F.transform(F.array_sort(F.collect_list(F.when((F.col("job_id") % 3 != 1) | (F.col("ord") > 0), F.struct("ord", "t")))), lambda x: x["t"])
    jobs = c.groupBy("job_id").agg(F.to_json(F.struct(listed.alias("titles"))).alias("full")).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2))))
    return jobs.select("job_id", "attempt", F.when((F.col("job_id") % 3 == 2) & (F.col("attempt") == 1), "titles follow").otherwise(F.col("full")).alias("text"))


@query("g2_batch_titles", SQL["g2_select_titles"].replace("SELECT job_id, chapter_id, title, attempt FROM f", "SELECT job_id, chapter_id, title, 'single' AS origin FROM f WHERE job_id % 3 = 1 UNION ALL SELECT job_id, chapter_id, trim(regexp_replace(title || ' ' || chapter_id, '\\s+', ' ', 'g')), 'batch' FROM chapters WHERE job_id % 3 <> 1"))
def g2_batch_titles(spark, d):
    return G.select_batch_titles(_batches(spark, d), _title_replies(spark, d), X.chapters(spark, d))
