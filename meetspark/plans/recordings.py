"""Registered queries over the recording tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chapters as C
from ..operators import clustering as E
from ..operators import edits as I
from ..operators import evaluate as J
from ..operators import gates as H
from ..operators import insights as G
from ..operators import intervals as V
from ..operators import jobs as K
from ..operators import planning as D
from . import fixtures as X
from .registry import query


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _durations(df):
    return df.groupBy("job_id").agg((F.max("end") + 1.0).alias("duration"))


_DUR = 'durations AS (SELECT job_id, max("end") + 1.0 AS duration FROM {0} GROUP BY job_id)'
_WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"
_TOKENS = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda x: length(x) >= 2)"


def _islands(src: str, gap: float, name: str = "islands", keys: str = "job_id", where: str = "true") -> str:
    return f"""{name}_r AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src} WHERE {where}),
{name}_m AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY "start", "end", ord) AS island FROM {name}_r),
{name} AS (SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY min("start")) - 1 AS ord, min("start") AS "start", max("end") AS "end" FROM {name}_m GROUP BY {keys}, island)"""


# ---- texts


@query("b_text_functions", f"""SELECT doc_id, {_WORDS.format('text')} AS words, length(text) - length(regexp_replace(text, '[a-zA-Z]', '', 'g')) AS latin, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS norm,
 len({_TOKENS.format('text')}) AS n_tokens, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) AS alias, sha256('salt:' || source) AS client FROM documents""")
def b_text_functions(spark, d):
    t = F.col("text")
    return _table(spark, d, "documents").select("doc_id", T.word_count(t).alias("words"), T.latin_chars(t).alias("latin"), T.normalize_text(t).alias("norm"), F.size(T.tokens(t)).alias("n_tokens"), T.clean_alias(t).alias("alias"), T.hash_client(F.col("source"), "salt").alias("client"))


@query("b4_clock", """SELECT l_orderkey, l_linenumber, CASE WHEN s // 3600 > 0 THEN printf('%d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) ELSE printf('%02d:%02d', (s // 60) % 60, s % 60) END AS clock, printf('%02d:%02d', s // 60, s % 60) AS mmss
 FROM (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 10) AS BIGINT) AS s FROM lineitem)""")
def b4_clock(spark, d):
    s = F.col("l_extendedprice") / 10
    return _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.format_clock(s).alias("clock"), T.format_mmss(s).alias("mmss"))


@query("b1_gain_plan", """SELECT event_id, gain_db, gain_db > 0 AS applied, gain_db > 0 AND raw > 18 AS capped FROM (SELECT event_id, raw, CASE WHEN rms >= -30 THEN 0 ELSE greatest(0, round(least(raw, 18, -1 - peak), 3)) END AS gain_db
 FROM (SELECT event_id, -value AS rms, -value / 2 AS peak, -23.0 + value AS raw FROM events))""")
def b1_gain_plan(spark, d):
    g = T.gain_plan(-F.col("value"), -F.col("value") / 2)
    return _table(spark, d, "events").select("event_id", g.alias("g")).select("event_id", "g.gain_db", "g.applied", "g.capped")


@query("b2_loudness", """SELECT user_id AS job_id, round(CASE WHEN sum(value * value) > 0 THEN 20 * log10(sqrt(sum(value * value) / count(*)) / 1000) ELSE -100 END, 4) AS rms_dbfs, round(20 * log10(max(value) / 1000), 4) AS peak_dbfs FROM events WHERE value > 0 GROUP BY user_id""")
def b2_loudness(spark, d):
    e = _table(spark, d, "events").filter("value > 0").withColumn("x", F.col("value") / 1000)
    found = e.groupBy(F.col("user_id").alias("job_id")).agg(*T.loudness(F.lit(1), F.col("x") * F.col("x"), F.col("x")))
    return found.select("job_id", F.round("rms_dbfs", 4).alias("rms_dbfs"), F.round("peak_dbfs", 4).alias("peak_dbfs"))


@query("b10_title_errors", f"""WITH {X.CHAPTERS}, t AS (SELECT job_id, ord, chapter_id, trim(regexp_replace(CASE ord % 5 WHEN 1 THEN '  ' WHEN 2 THEN repeat('many words ', 6) WHEN 3 THEN '12:30 ' || title WHEN 4 THEN upper(first(title) OVER (PARTITION BY job_id ORDER BY ord)) ELSE title END, '\\s+', ' ', 'g')) AS title FROM chapters)
 SELECT job_id, chapter_id, title, CASE WHEN title = '' THEN 'empty' WHEN len(string_split(title, ' ')) > 10 THEN 'long' WHEN ord % 5 = 3 THEN 'stamp' WHEN row_number() OVER (PARTITION BY job_id, lower(title) ORDER BY ord) > 1 THEN 'duplicate' END AS error FROM t""")
def b10_title_errors(spark, d):
    c, k = X.chapters(spark, d), F.col("ord") % 5
    first = F.first("title").over(Window.partitionBy("job_id").orderBy("ord"))
    title = F.when(k == 1, "  ").when(k == 2, "many words " * 6).when(k == 3, F.concat(F.lit("12:30 "), "title")).when(k == 4, F.upper(first)).otherwise(F.col("title"))
    return G.title_errors(c.select("job_id", "ord", "chapter_id", title.alias("title")))


@query("b13_upload_checks", """SELECT event_id, event_id * 1024 <= 5 * 1024 * 1024 AS fits, value > 90 AS will_trim, CASE WHEN value > 90 THEN 90.0::DOUBLE END AS trim_to_sec, event_id % 4 <> 3 AS loopback FROM events""")
def b13_upload_checks(spark, d):
    e = _table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 4).alias("k"))
    ip = F.when(F.col("k") == 0, "::ffff:127.0.0.9").when(F.col("k") == 1, "[::1]:8080").otherwise("10.0.0.7")
    host = F.when(F.col("k") == 2, "LOCALHOST:8000").otherwise("example.org")
    cut = T.trim_decision(F.col("value"), 1.5)
    return e.select("event_id", T.size_check(F.col("event_id") * 1024, 5).alias("fits"), cut["will_trim"].alias("will_trim"), cut["trim_to_sec"].alias("trim_to_sec"), T.is_loopback(ip, host).alias("loopback"))


@query("e12_embed_units", f"""WITH {X.SEGMENTS}, w AS (SELECT job_id, ord, unnest({_TOKENS.format('text')}) AS word FROM segments), t AS (SELECT job_id, ord, word, count(*) AS tf FROM w GROUP BY ALL), r AS (SELECT word, 1 + ln((1 + (SELECT count(*) FROM segments)) / (1 + count(*))) AS idf FROM t GROUP BY word),
 e AS (SELECT job_id, ord, ('0x' || md5(word)[1:8])::UBIGINT % 64 AS i, sum(tf * idf) AS x FROM t JOIN r USING (word) GROUP BY ALL), v AS (SELECT job_id, ord, count(*) AS n, sqrt(sum(x * x)) AS size, sum(x) AS total, max(x) AS most, arg_max(i, (x, -i::BIGINT)) AS top FROM e GROUP BY ALL)
 SELECT job_id, ord AS unit, coalesce(n, 0) AS n_dimensions, round(total / size, 6) AS total, round(most / size, 6) AS most FROM segments LEFT JOIN v USING (job_id, ord)""")
def e12_embed_units(spark, d):
    v = C.embed_units(X.segments(spark, d).select("job_id", F.col("ord").alias("unit"), "text"))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return v.select("job_id", "unit", F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("n_dimensions"), F.when(F.size("vector") > 0, F.round(total, 6)).alias("total"), F.round(F.array_max("vector"), 6).alias("most"))


@query("b8_script_word_ratio", f"""WITH {X.SEGMENTS}, w AS (SELECT job_id, unnest({_TOKENS.format('text')}) AS w FROM segments WHERE trim(text) <> '')
 SELECT job_id, coalesce(n, 0) AS total_words, coalesce(r, 1.0) AS word_ratio FROM (SELECT DISTINCT job_id FROM segments) LEFT JOIN
 (SELECT job_id, count(*) AS n, round(count(*) FILTER (regexp_full_match(w, '\\p{{Latin}}+')) / count(*), 3) AS r FROM w WHERE regexp_matches(w, '\\p{{L}}') GROUP BY job_id) USING (job_id)""")
def b8_script_word_ratio(spark, d):
    return H.script_word_ratio(X.segments(spark, d))


@query("b12_digits_verified", """SELECT a.item_id, list_bool_and(list_transform(list_filter(regexp_split_to_array(a.text || ' ' || a.item_id, '[^0-9]+'), lambda x: x <> ''), lambda g: contains(b.text || (b.item_id * 7), g))) IS NOT FALSE AS ok FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark)""")
def b12_digits_verified(spark, d):
    a = _table(spark, d, "benchmark")
    n = max(1, a.count())
    b = a.select(F.col("item_id").alias("i"), F.concat("text", (F.col("item_id") * 7).cast("string")).alias("source"))
    return a.join(b, F.col("i") == (F.col("item_id") + 1) % n).select("item_id", T.digit_groups_verified(F.concat_ws(" ", "text", F.col("item_id").cast("string")), F.col("source")).alias("ok"))


# ---- intervals

_UNION = _islands("intervals", 0.0, where='"end" > "start"')


@query("c1_merge_regions", f"""WITH {X.INTERVALS}, {_islands('intervals', 30.0)} SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY "start") - 1 AS ord, "start", "end" FROM islands WHERE "end" - "start" >= 5""")
def c1_merge_regions(spark, d):
    return V.merge_regions(X.intervals(spark, d), 30.0, 5.0)


@query("c2_interval_union", f"WITH {X.INTERVALS}, {_UNION} SELECT * FROM islands")
def c2_interval_union(spark, d):
    return V.interval_union(X.intervals(spark, d))


@query("c3_covered_sec", f"""WITH {X.INTERVALS}, {_UNION} SELECT job_id, round(sum("end" - "start"), 3) AS covered_sec FROM islands GROUP BY job_id""")
def c3_covered_sec(spark, d):
    return V.covered_sec(X.intervals(spark, d))


_SWEEP = f"""{_islands('ai', 0.0, 'a')}, {_islands('bi', 0.0, 'b')}, swp AS (SELECT job_id, t, sum(a) AS a, sum(b) AS b FROM (SELECT job_id, "start" AS t, 1 AS a, 0 AS b FROM a UNION ALL SELECT job_id, "end", -1, 0 FROM a UNION ALL SELECT job_id, "start", 0, 1 FROM b UNION ALL SELECT job_id, "end", 0, -1 FROM b) GROUP BY job_id, t),
 o AS (SELECT job_id, lead(t) OVER w - t AS dt, sum(a) OVER w AS a, sum(b) OVER w AS b FROM swp WINDOW w AS (PARTITION BY job_id ORDER BY t)),
 s AS (SELECT job_id, round(coalesce(sum(dt) FILTER (a > 0 AND b > 0), 0), 3) AS both_sec, round(coalesce(sum(dt) FILTER (a > 0 AND b <= 0), 0), 3) AS only_a_sec, round(coalesce(sum(dt) FILTER (b > 0 AND a <= 0), 0), 3) AS only_b_sec, round(coalesce(sum(dt) FILTER (a > 0 OR b > 0), 0), 3) AS any_sec FROM o GROUP BY job_id)"""
_TWO = f"""{X.INTERVALS}, ai AS (SELECT * FROM intervals WHERE speaker IN ('click', 'view')), bi AS (SELECT * FROM intervals WHERE speaker NOT IN ('click', 'view')), {_SWEEP}"""


def _two(spark, d):
    i = X.intervals(spark, d)
    on = F.col("speaker").isin("click", "view")
    return i.filter(on), i.filter(~on)


@query("c4_intersection_sec", f"WITH {_TWO} SELECT * FROM s")
def c4_intersection_sec(spark, d):
    return V.intersection_sec(*_two(spark, d))


@query("c5_speech_iou", f"WITH {_TWO} SELECT job_id, round(CASE WHEN any_sec > 0 THEN both_sec / any_sec ELSE 1.0 END, 6) AS iou FROM s")
def c5_speech_iou(spark, d):
    return V.speech_iou(*_two(spark, d))


_HOLES = """r AS (SELECT *, coalesce(max("end") OVER (PARTITION BY job_id ORDER BY "start", "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM {0} WHERE "end" > "start"),
 holes AS (SELECT job_id, round(reach, 3) AS "start", round("start", 3) AS "end" FROM r WHERE "start" - reach >= {1} UNION ALL SELECT job_id, round(last, 3), round(duration, 3) FROM durations LEFT JOIN (SELECT job_id, max("end") AS last FROM r GROUP BY job_id) USING (job_id) WHERE duration - coalesce(last, 0) >= {1})"""


_SYSTEMS = ["click", "view", "purchase", "error", "signup"]
_OTHERS = {(a, b): f'"{b}"' for a in _SYSTEMS for b in _SYSTEMS if a != b} | {(a, "*"): " OR ".join(f'"{b}"' for b in _SYSTEMS if b != a) for a in _SYSTEMS}


@query("c6_coverage_diff", f"""WITH {X.INTERVALS}, st AS (SELECT job_id, speaker, "start" AS t, 1 AS step FROM intervals UNION ALL SELECT job_id, speaker, "end", -1 FROM intervals),
 sw AS (SELECT job_id, t, {', '.join(f"coalesce(sum(step) FILTER (speaker = '{a}'), 0) AS {a}" for a in _SYSTEMS)} FROM st GROUP BY job_id, t HAVING count(*) FILTER (speaker IN ('click', 'view', 'purchase', 'error', 'signup')) > 0),
 op AS (SELECT job_id, lead(t) OVER w - t AS dt, {', '.join(f"sum({a}) OVER w > 0 AS {a}" for a in _SYSTEMS)} FROM sw WINDOW w AS (PARTITION BY job_id ORDER BY t))
 {' UNION ALL '.join(f"""SELECT job_id, '{a}' AS system, '{b}' AS other, round(coalesce(sum(dt) FILTER ("{a}" AND NOT ({on})), 0), 3) AS only_sec, round(coalesce(sum(dt) FILTER ("{a}" AND ({on})), 0), 3) AS both_sec FROM op GROUP BY job_id""" for (a, b), on in _OTHERS.items())}""")
def c6_coverage_diff(spark, d):
    return V.coverage_diff(X.intervals(spark, d).withColumnRenamed("speaker", "system"), _SYSTEMS)


@query("c7_find_holes", f"WITH {X.SEGMENTS}, {_DUR.format('segments')}, {_HOLES.format('segments', 0.5)} SELECT * FROM holes")
def c7_find_holes(spark, d):
    s = X.segments(spark, d)
    return V.find_holes(s, _durations(s))


@query("c8_pauses", f"""WITH {X.SEGMENTS}, {_DUR.format('segments')}, {_HOLES.format('segments', 0.3)} SELECT *, round("end" - "start", 3) AS duration, round(("start" + "end") / 2, 4) AS mid FROM holes""")
def c8_pauses(spark, d):
    s = X.segments(spark, d)
    return V.pauses(s, _durations(s))


@query("c9_split_intervals", f"""WITH {X.SEGMENTS}, k AS (SELECT *, greatest(ceil(("end" - "start") / 7.0), 1)::INT AS n FROM segments), e AS (SELECT *, unnest(range(0, n)) AS slice FROM k),
 f AS (SELECT job_id, ord, slice, speaker, n, round("start" + slice * 7.0, 3) AS s, round(least("start" + slice * 7.0 + 7.0, "end"), 3) AS e FROM e) SELECT job_id, ord, slice, speaker, s AS "start", e AS "end" FROM f WHERE n = 1 OR e > s""")
def c9_split_intervals(spark, d):
    return V.split_intervals(X.segments(spark, d), 7.0)


_SAME = """t0 AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY job_id ORDER BY "start", ord) IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS turned FROM intervals),
 t1 AS (SELECT *, sum(turned) OVER (PARTITION BY job_id ORDER BY "start", ord) AS run FROM t0), t2 AS (SELECT *, max("end") OVER (PARTITION BY job_id, run ORDER BY "start", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t1),
 t3 AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, run ORDER BY "start", ord) AS island FROM t2),
 turns AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY run, island) - 1 AS ord, speaker, min("start") AS "start", max("end") AS "end" FROM t3 GROUP BY job_id, run, island, speaker)"""


@query("c10_merge_same_speaker", f"WITH {X.INTERVALS}, {_SAME} SELECT * FROM turns")
def c10_merge_same_speaker(spark, d):
    return V.merge_same_speaker(X.intervals(spark, d), 20.0)


@query("c11_absorb_short_turns")
def c11_absorb_short_turns(spark, d):
    return V.absorb_short_turns(V.merge_same_speaker(X.segments(spark, d)), 10.0)


@query("c12_merge_turns")
def c12_merge_turns(spark, d):
    return V.merge_turns(X.segments(spark, d), 0.3, 10.0)


@query("c13_clip_turn_overlaps", f"""WITH {X.INTERVALS}, n AS (SELECT *, lead("start") OVER (PARTITION BY job_id ORDER BY "start", ord) AS nx FROM intervals) SELECT job_id, ord, speaker, "start", CASE WHEN nx < "end" AND nx > "start" THEN nx ELSE "end" END AS "end" FROM n""")
def c13_clip_turn_overlaps(spark, d):
    return V.clip_turn_overlaps(X.intervals(spark, d))


@query("c14_embedding_windows", f"""WITH {X.SEGMENTS}, b AS (SELECT job_id, ord, "start" AS s, "end" AS e, "end" - "start" AS dur, floor(("end" - "start" - 1.5) / 0.75 + 1e-9)::INT AS f FROM segments),
 k AS (SELECT *, unnest(range(0, CASE WHEN dur <= 2.25 THEN 1 ELSE f + 2 END)) AS k FROM b), w AS (SELECT *, CASE WHEN dur <= 2.25 THEN s ELSE s + k * 0.75 END AS ws, CASE WHEN dur <= 2.25 THEN e ELSE least(s + k * 0.75 + 1.5, e) END AS we FROM k)
 SELECT job_id, ord, k, round(ws, 3) AS "start", round(we, 3) AS "end" FROM w WHERE NOT (dur > 2.25 AND k = f + 1) OR (we - ws >= 0.4 AND s + f * 0.75 + 1.5 < e)""")
def c14_embedding_windows(spark, d):
    return V.embedding_windows(X.segments(spark, d).select("job_id", "ord", "start", "end"))


@query("c15_speaker_at", f"""WITH {X.SEGMENTS}, p AS (SELECT job_id, ord, speaker, ("start" + "end") / 2 + (ord % 3) * 5 AS mid FROM segments)
 SELECT p.job_id, p.ord, mid, coalesce(min_by(t.speaker, t.ord), any_value(p.speaker)) AS speaker FROM p LEFT JOIN segments t ON p.job_id = t.job_id AND mid BETWEEN t."start" - 1e-6 AND t."end" + 1e-6 GROUP BY p.job_id, p.ord, mid""")
def c15_speaker_at(spark, d):
    s = X.segments(spark, d)
    return V.speaker_at(s.select("job_id", "ord", "speaker", ((F.col("start") + F.col("end")) / 2 + (F.col("ord") % 3) * 5).alias("mid")), s)


_PARTS = """parts AS (SELECT job_id, printf('part%02d', k + 1) AS part_id, k * 20.0 AS "start", least((k + 1) * 20.0, duration) AS "end" FROM (SELECT *, unnest(range(0, greatest(ceil(duration / 20.0)::INT, 1))) AS k FROM durations))"""


def _parts(df):
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration") / 20.0).cast("int"), F.lit(1)) - 1))
    return _durations(df).withColumn("k", k).select("job_id", F.format_string("part%02d", F.col("k") + 1).alias("part_id"), (F.col("k") * 20.0).alias("start"), F.least((F.col("k") + 1) * 20.0, F.col("duration")).alias("end"))


_CLIP = """clipped AS (SELECT job_id, part_id, ord, s AS "start", e AS "end" FROM (SELECT g.job_id, part_id, g.ord, round(greatest(g."start", p."start") - p."start", 3) AS s, round(least(g."end", p."end") - p."start", 3) AS e FROM segments g JOIN parts p ON g.job_id = p.job_id AND g."start" < p."end" AND g."end" > p."start") WHERE e - s > 1e-6)"""


@query("c16_clip_to_part", f"WITH {X.SEGMENTS}, {_DUR.format('segments')}, {_PARTS}, {_CLIP} SELECT * FROM clipped")
def c16_clip_to_part(spark, d):
    s = X.segments(spark, d)
    return V.clip_to_part(s, _parts(s))


@query("c17_shift_part", f"""WITH {X.SEGMENTS}, {_DUR.format('segments')}, {_PARTS}, {_CLIP} SELECT c.job_id, c.part_id, c.part_id || '_' || ord AS id, round(c."start" + p."start", 3) AS "start", round(c."end" + p."start", 3) AS "end" FROM clipped c JOIN parts p USING (job_id, part_id)""")
def c17_shift_part(spark, d):
    s = X.segments(spark, d)
    return V.shift_part(V.clip_to_part(s, _parts(s)), _parts(s))


@query("c18_slice_window", f"""WITH {X.SEGMENTS}, {_DUR.format('segments')}, {_PARTS} SELECT g.job_id, part_id, count(*) AS n, count(DISTINCT speaker) AS n_speakers, coalesce(string_agg(text, ' ' ORDER BY ord) FILTER (text <> ''), '') AS text_concat FROM segments g JOIN parts p ON g.job_id = p.job_id AND g."start" < p."end" AND g."end" > p."start" GROUP BY g.job_id, part_id""")
def c18_slice_window(spark, d):
    s = X.segments(spark, d)
    return V.slice_window(s, _parts(s))


@query("c19_hysteresis_regions")
def c19_hysteresis_regions(spark, d):
    frame = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    return V.hysteresis_regions(_table(spark, d, "events").select(F.col("user_id").alias("job_id"), frame.alias("frame_idx"), F.pmod(F.col("value"), F.lit(1.0)).alias("prob")), pad=0.1)


@query("c20_whole_file_region", f"""WITH {X.SEGMENTS}, {_DUR.format('segments')} SELECT job_id, 0 AS ord, 0.0 AS "start", duration AS "end" FROM durations""")
def c20_whole_file_region(spark, d):
    return V.whole_file_region(_durations(X.segments(spark, d)))


@query("c22_overlap_join", f"""WITH {X.HYPOTHESIS} SELECT g.job_id, g.ord, count(*) AS n, string_agg(h.text, ' ' ORDER BY h."start", h.ord) AS hyp_text FROM segments g JOIN hypothesis h ON g.job_id = h.job_id AND least(g."end", h."end" + 0.5) - greatest(g."start", h."start" - 0.5) > 0 GROUP BY g.job_id, g.ord""")
def c22_overlap_join(spark, d):
    return V.overlap_join(X.segments(spark, d), X.hypothesis(spark, d), 0.5)


@query("c21_fill_holes", f"""WITH {X.SEGMENTS}, {_DUR.format('segments')}, p AS (SELECT * FROM segments WHERE ord % 3 <> 1), q AS (SELECT * FROM segments WHERE ord % 3 = 1), {_HOLES.format('p', 0.5)}
 SELECT job_id, "start", "end", 'primary' AS origin FROM p UNION ALL SELECT q.job_id, greatest(q."start", h."start"), least(q."end", h."end"), 'fallback' FROM q JOIN holes h ON q.job_id = h.job_id AND q."start" < h."end" AND q."end" > h."start" """)
def c21_fill_holes(spark, d):
    s = X.segments(spark, d)
    return V.fill_holes_with_fallback(s.filter("ord % 3 <> 1"), s.filter("ord % 3 = 1"), _durations(s))


# ---- part plans


@query("d1_propose_n_parts", f"""WITH {X.INTERVALS}, {_DUR.format('intervals')}, x AS (SELECT *, greatest(2, ceil(duration / 900 - 1e-3)) AS lo, floor(duration / 300 + 1e-3) AS h FROM durations)
 SELECT job_id, duration, CAST(CASE WHEN duration < 600 THEN 1 ELSE least(greatest(lo, h), greatest(lo, round_even(duration / 600, 0))) END AS BIGINT) AS n_parts FROM x""")
def d1_propose_n_parts(spark, d):
    return D.propose_n_parts(_durations(X.intervals(spark, d)))


@query("d6_needs_split", f"WITH {X.INTERVALS}, {_DUR.format('intervals')} SELECT job_id, duration, duration >= 600 AS needs_split FROM durations")
def d6_needs_split(spark, d):
    return D.needs_split(_durations(X.intervals(spark, d)))


def _cuts(spark, d):
    i = X.intervals(spark, d)
    dur = _durations(i)
    return D.choose_cuts(D.propose_n_parts(dur), V.pauses(i, dur)), dur


@query("d2_choose_cuts")
def d2_choose_cuts(spark, d):
    return _cuts(spark, d)[0]


@query("d2_choose_cuts_tight")
def d2_choose_cuts_tight(spark, d):
    i = X.intervals(spark, d)
    dur = _durations(i)
    return D.choose_cuts(dur.withColumn("n_parts", 2 + F.col("job_id") % 6), V.pauses(i, dur, 100.0), 400.0, 700.0, 15.0)


@query("d5_cut_plan")
def d5_cut_plan(spark, d):
    i = X.intervals(spark, d)
    metrics = D.cut_plan(_durations(i), i, min_pause=20.0)[2]
    return metrics.withColumn("longest", F.get("top_pauses", F.lit(0))["duration"]).drop("top_pauses")


@query("d3_parts_from_cuts")
def d3_parts_from_cuts(spark, d):
    return D.parts_from_cuts(*_cuts(spark, d))


@query("d4_coalesce_short_parts")
def d4_coalesce_short_parts(spark, d):
    return D.coalesce_short_parts(D.parts_from_cuts(*_cuts(spark, d)), 500.0)


@query("d5_cut_metrics", f"""WITH {X.INTERVALS}, {_DUR.format('intervals')}, {_HOLES.format('intervals', 0.3)}, p AS (SELECT job_id, round(("start" + "end") / 2, 4) AS mid, round("end" - "start", 3) AS duration FROM holes)
 SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY duration DESC, mid) AS rank, mid, duration FROM p QUALIFY rank <= 15""")
def d5_cut_metrics(spark, d):
    i = X.intervals(spark, d)
    return D.cut_metrics(V.pauses(i, _durations(i)))


# ---- speakers

_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))"


@query("e1_l2_normalize", f"SELECT vec_id, round(list_sum({_UNIT}), 6) AS total, round(({_UNIT})[1], 6) AS first FROM embeddings")
def e1_l2_normalize(spark, d):
    u = _table(spark, d, "embeddings").select("vec_id", E.l2_normalize(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.col("u")[0], 6).alias("first"))


@query("e2_cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def e2_cosine(spark, d):
    a = _table(spark, d, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(E.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


@query("e3_cluster_windows")
def e3_cluster_windows(spark, d):
    return E.cluster_windows(X.vectors(spark, d))


def _spoken(spark, d):
    return X.vectors(spark, d).withColumn("speaker", F.concat(F.lit("L"), F.col("label").cast("string")))


@query("e4_renumber_speakers", f"""WITH {X.VECTORS}, f AS (SELECT *, min(ord) OVER (PARTITION BY job_id, label) AS first FROM vectors) SELECT job_id, ord, printf('SPEAKER_%02d', dense_rank() OVER (PARTITION BY job_id ORDER BY first) - 1) AS speaker FROM f""")
def e4_renumber_speakers(spark, d):
    return E.renumber_speakers(_spoken(spark, d))


_CENTROIDS = f"""{X.VECTORS}, un AS (SELECT job_id, label, unnest({_UNIT}) AS x, unnest(range(0, len(embedding))) AS pos FROM vectors), me AS (SELECT job_id, label, pos, avg(x) AS x FROM un GROUP BY ALL),
 cv AS (SELECT job_id, 'L' || label AS speaker, list(x ORDER BY pos) AS v FROM me GROUP BY job_id, label)"""


@query("e5_speaker_centroids", f"""WITH {_CENTROIDS} SELECT job_id, speaker, n_windows, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM cv JOIN (SELECT job_id, 'L' || label AS speaker, count(*) AS n_windows FROM vectors GROUP BY ALL) USING (job_id, speaker)""")
def e5_speaker_centroids(spark, d):
    return E.speaker_centroids(_spoken(spark, d)).select("job_id", "speaker", "n_windows", F.round(F.col("centroid")[0], 6).alias("first"))


@query("e6_assign_to_gallery", f"""WITH {_CENTROIDS}, fa AS (SELECT w.job_id, ord, speaker, round(1 - greatest(-1, least(1, list_cosine_similarity(embedding::DOUBLE[], v))), 9) AS d FROM vectors w JOIN cv ON w.job_id = cv.job_id)
 SELECT job_id, ord, CASE WHEN min(d) <= 0.85 THEN arg_min(speaker, (d, speaker)) END AS speaker, round(min(d), 6) AS distance FROM fa GROUP BY job_id, ord""")
def e6_assign_to_gallery(spark, d):
    return E.assign_to_gallery(X.vectors(spark, d), E.speaker_centroids(_spoken(spark, d)))


@query("e10_refine_speakers")
def e10_refine_speakers(spark, d):
    return E.refine_speakers(X.vectors(spark, d).withColumn("speaker", F.format_string("SPEAKER_%02d", F.col("label"))))


@query("e11_turns_from_windows")
def e11_turns_from_windows(spark, d):
    return E.turns_from_windows(_spoken(spark, d).select("job_id", "ord", "speaker", "start", "end"), renumber=True)


@query("e7_cluster_then_match")
def e7_cluster_then_match(spark, d):
    return E.cluster_then_match(X.vectors(spark, d), E.speaker_centroids(_spoken(spark, d).filter("label < 6")))


@query("e8_greedy_remap")
def e8_greedy_remap(spark, d):
    v = _spoken(spark, d).withColumn("published", F.concat(F.lit("P"), (F.col("ord") % 7).cast("string")))
    return E.greedy_remap(v.groupBy("job_id", F.col("speaker").alias("cluster"), "published").agg(F.sum(F.col("end") - F.col("start")).alias("sec")))


@query("e9_absorb_micro_speakers")
def e9_absorb_micro_speakers(spark, d):
    v = _spoken(spark, d)
    sec = v.groupBy("job_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("sec"))
    return E.absorb_micro_speakers(sec.join(E.speaker_centroids(v), ["job_id", "speaker"]), 16.0)


# ---- chapters


@query("f1_attach_empty_segments", f"""WITH {X.SEGMENTS} SELECT job_id, ord, greatest(sum(CASE WHEN trim(text) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ord), 1)::BIGINT AS piece FROM segments""")
def f1_attach_empty_segments(spark, d):
    return C.attach_empty_segments(X.segments(spark, d)).select("job_id", "ord", "piece")


_PACK = f"""{X.SEGMENTS}, pc AS (SELECT job_id, piece, min("start") AS s, max("end") AS e, sum(w)::INT AS w, min_by(speaker, ord) AS a, max_by(speaker, ord) AS z FROM
 (SELECT *, {_WORDS.format('text')} AS w, greatest(sum(CASE WHEN trim(text) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ord), 1)::BIGINT AS piece FROM segments) GROUP BY job_id, piece),
 pk AS (SELECT job_id, piece, 0 AS unit, w, e, z FROM pc WHERE piece = 1 UNION ALL SELECT c.job_id, c.piece, CASE WHEN ok THEN unit ELSE unit + 1 END, CASE WHEN ok THEN pw + c.w ELSE c.w END, c.e, c.z FROM
 (SELECT c.*, k.unit, k.w AS pw, k.w + c.w <= 80 AND (k.z = c.a OR c.s - k.e <= 2.0) AS ok FROM pk k JOIN pc c ON c.job_id = k.job_id AND c.piece = k.piece + 1) c)"""


@query("f2_pack_pieces", f"WITH RECURSIVE {_PACK} SELECT job_id, piece, unit::BIGINT AS unit FROM pk")
def f2_pack_pieces(spark, d):
    return C.pack_pieces(X.segments(spark, d)).select("job_id", "piece", "unit").distinct()


def _vectors(spark, d):
    """All embeddings, ``vec_id`` from 0 without gaps, and their number."""
    v = _table(spark, d, "embeddings").select("vec_id", "embedding")
    return v, max(1, v.count())


def _unit_vectors(spark, d):
    u = C.units(C.pack_pieces(X.segments(spark, d)))
    v, n = _vectors(spark, d)
    return u.join(v, (F.col("job_id") * 7 + F.col("unit")) % n == F.col("vec_id")).select("job_id", "unit", "start", "end", "words", F.col("embedding").alias("vector"))


@query("f3_merge_similar_units")
def f3_merge_similar_units(spark, d):
    return C.merge_similar_units(_unit_vectors(spark, d), 0.1)


@query("f4_absorb_short_units")
def f4_absorb_short_units(spark, d):
    return C.absorb_short_units(X.segments(spark, d).select("job_id", "ord", "start", "end"), 9.0)


@query("f6_chapter_metrics", f"""WITH {X.CHAPTERS} SELECT job_id, count(*) AS n_chapters, round(count(*) / (max("end") / 60), 3) AS chapters_per_minute, count(*) FILTER ("end" - "start" < 20) AS short_chapters, count(*) FILTER ("end" - "start" > 180) AS long_chapters FROM chapters GROUP BY job_id""")
def f6_chapter_metrics(spark, d):
    return C.chapter_metrics(X.chapters(spark, d))


_BRIDGE = "bridge AS (SELECT job_id, chapter_id, unnest(source_ids) AS segment_id, unnest(range(0, len(source_ids))) AS pos FROM chapters)"


def _part_tables(spark, d):
    s = X.segments(spark, d)
    parts = _parts(s)
    local = V.clip_to_part(s, parts).withColumn("segment_id", F.format_string("p%04d", "ord"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "segment_id"))), lambda x: x["segment_id"])
    return parts, local, local.groupBy("job_id", "part_id", F.expr("ord div 4").alias("ord")).agg(F.min("start").alias("start"), F.max("end").alias("end"), ids.alias("source_ids"))


_MERGED = f"""{X.SEGMENTS}, {_DUR.format('segments')}, {_PARTS}, {_CLIP}, mg AS (SELECT job_id, part_id, ord // 4 AS block, row_number() OVER (PARTITION BY job_id ORDER BY part_id, ord) AS ord, round(c."start" + p."start", 3) AS "start", round(c."end" + p."start", 3) AS "end" FROM clipped c JOIN parts p USING (job_id, part_id)),
 ms AS (SELECT job_id, part_id, ord, printf('s%04d', ord) AS segment_id, "start", "end", block FROM mg)"""


@query("f7_merge_parts", f"WITH {_MERGED} SELECT * EXCLUDE (block) FROM ms")
def f7_merge_parts(spark, d):
    return D.merge_parts(*_part_tables(spark, d))[0]


@query("f7_merge_chapters", f"""WITH {_MERGED}, g AS (SELECT job_id, part_id, block, min("start") AS "start", max("end") AS "end", string_agg(segment_id, ',' ORDER BY ord) AS sources FROM ms GROUP BY ALL)
 SELECT job_id, part_id, row_number() OVER (PARTITION BY job_id ORDER BY part_id, block) - 1 AS ord, printf('C%02d', row_number() OVER (PARTITION BY job_id ORDER BY part_id, block) - 1) AS chapter_id, "start", "end", sources FROM g""")
def f7_merge_chapters(spark, d):
    return D.merge_parts(*_part_tables(spark, d))[1].withColumn("sources", F.array_join("source_ids", ",")).drop("source_ids")


@query("f7_validate_merge", f"""WITH {_MERGED}, l AS (SELECT *, lag("start") OVER (PARTITION BY job_id ORDER BY ord) AS prev FROM ms) SELECT job_id, count(*) AS n_segments, count(*) FILTER ("start" < prev) AS n_back, 0 AS n_not_once, count(*) FILTER ("start" < prev) = 0 AS ok FROM l GROUP BY job_id""")
def f7_validate_merge(spark, d):
    return D.validate_merge(*D.merge_parts(*_part_tables(spark, d)))


@query("f11_late_chunk_boundaries")
def f11_late_chunk_boundaries(spark, d):
    s = C.late_windows(X.segments(spark, d).select("job_id", "ord", "start", "end"), 20.0, 5.0)
    v, n = _vectors(spark, d)
    v = v.withColumnRenamed("embedding", "vector")
    return C.late_chunk_boundaries(s.join(v, (F.col("job_id") * 7 + F.col("ord") * 3 + F.col("win_id")) % n == F.col("vec_id")).drop("vec_id"), 4.0, 15.0)


@query("f12_merge_by_title_vectors")
def f12_merge_by_title_vectors(spark, d):
    v, n = _vectors(spark, d)
    v = v.withColumnRenamed("embedding", "vector")
    return C.merge_by_title_vectors(X.chapters(spark, d).join(v, (F.col("job_id") * 7 + F.col("ord")) % n == F.col("vec_id")), 0.0)


@query("f8_chapter_speakers", f"""WITH {X.CHAPTERS}, {_BRIDGE}, f AS (SELECT job_id, chapter_id, speaker, min(pos) AS pos FROM bridge JOIN segments USING (job_id, segment_id) GROUP BY ALL) SELECT job_id, chapter_id, string_agg(speaker, ',' ORDER BY pos) AS speakers FROM f GROUP BY ALL""")
def f8_chapter_speakers(spark, d):
    return C.chapter_speakers(X.chapters(spark, d), X.segments(spark, d))


@query("f9_chapter_text", f"""WITH {X.CHAPTERS}, {_BRIDGE} SELECT job_id, chapter_id, string_agg(speaker || ': ' || text, chr(10) ORDER BY pos) AS text FROM bridge JOIN segments USING (job_id, segment_id) WHERE trim(text) <> '' GROUP BY ALL""")
def f9_chapter_text(spark, d):
    return C.chapter_text(X.chapters(spark, d), X.segments(spark, d))


@query("f10_chapter_neighbors", f"""WITH {X.CHAPTERS} SELECT job_id, chapter_id, lag(chapter_id) OVER w AS previous, lead(chapter_id) OVER w AS next FROM chapters WINDOW w AS (PARTITION BY job_id ORDER BY ord)""")
def f10_chapter_neighbors(spark, d):
    return C.chapter_neighbors(X.chapters(spark, d))


# ---- insights


def _title_replies(spark, d):
    """Two attempts for each chapter; the first is no JSON, or the title of the job's first chapter, or its own."""
    c = X.chapters(spark, d).withColumn("first", F.first("title").over(Window.partitionBy("job_id").orderBy("ord")))
    title = lambda t: F.to_json(F.struct(t.alias("title")))
    own = F.when(F.col("ord") % 3 == 1, "no title").when(F.col("ord") % 3 == 2, title(F.upper("first"))).otherwise(title(F.col("title")))
    again = title(F.concat_ws("  ", "title", "chapter_id"))
    return c.select("job_id", "chapter_id", F.posexplode(F.array(own, again)).alias("n", "text")).select("job_id", "chapter_id", (F.col("n") + 1).alias("attempt"), "text")


@query("g2_select_titles", f"""WITH RECURSIVE {X.CHAPTERS}, t AS (SELECT job_id, ord, chapter_id, CASE WHEN ord % 3 = 1 THEN NULL WHEN ord % 3 = 2 THEN upper(first(title) OVER (PARTITION BY job_id ORDER BY ord)) ELSE title END AS a, title || ' ' || chapter_id AS b FROM chapters),
 u AS (SELECT job_id, ord, chapter_id, trim(regexp_replace(a, '\\s+', ' ', 'g')) AS a, trim(regexp_replace(b, '\\s+', ' ', 'g')) AS b FROM t), f AS (SELECT u.job_id, ord, chapter_id, CASE WHEN a <> '' THEN a ELSE b END AS title, CASE WHEN a <> '' THEN 1 ELSE 2 END AS attempt, [lower(CASE WHEN a <> '' THEN a ELSE b END)] AS used FROM u WHERE ord = 0
 UNION ALL SELECT job_id, ord, chapter_id, title, attempt, list_append(used, lower(title)) FROM (SELECT u.job_id, u.ord, u.chapter_id, used, CASE WHEN a <> '' AND NOT list_contains(used, lower(a)) THEN a ELSE b END AS title, CASE WHEN a <> '' AND NOT list_contains(used, lower(a)) THEN 1 ELSE 2 END AS attempt FROM f JOIN u ON u.job_id = f.job_id AND u.ord = f.ord + 1))
 SELECT job_id, chapter_id, title, attempt FROM f""")
def g2_select_titles(spark, d):
    return G.select_titles(_title_replies(spark, d), X.chapters(spark, d))


@query("g6_digest_chapters", f"""WITH {X.CHAPTERS}, {_BRIDGE}, l AS (SELECT job_id, chapter_id, pos, segment_id, speaker || ': ' || text AS line FROM bridge JOIN segments USING (job_id, segment_id) WHERE trim(text) <> ''),
 u AS (SELECT *, sum(length(line) + 1) OVER w AS used, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY job_id, chapter_id ORDER BY pos)) SELECT job_id, chapter_id, string_agg(line, chr(10) ORDER BY pos) AS digest, string_agg(segment_id, ',' ORDER BY pos) FILTER (n <= 8) AS sources FROM u WHERE used <= 700 OR n = 1 GROUP BY ALL""")
def g6_digest_chapters(spark, d):
    return C.digest_chapters(X.chapters(spark, d), X.segments(spark, d))


@query("g8_speaker_totals", f"""WITH {X.SEGMENTS} SELECT job_id, speaker, round(sum("end" - "start"), 3) AS speech_sec FROM segments GROUP BY ALL""")
def g8_speaker_totals(spark, d):
    return G.speaker_totals(X.segments(spark, d))


@query("g10_llm_budget", f"""WITH {X.INTERVALS} SELECT job_id, ord, n <= 20 AS allowed, greatest(0, 20 - n) AS remaining FROM (SELECT job_id, ord, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS n FROM intervals)""")
def g10_llm_budget(spark, d):
    return G.llm_budget(X.intervals(spark, d), 20)


def _replies(spark, d):
    """Two attempts a chapter, in eight kinds by ``(job_id + ord) % 8``: every way for a reply to count, to be asked for again or to fail."""
    c = X.chapters(spark, d).withColumn("k", (F.col("job_id") + F.col("ord")) % 8)
    item = lambda text, ids: F.struct(text.alias("text"), ids.alias("segment_ids"))
    good, lost, digits = item(F.col("title"), F.slice("source_ids", 1, 2)), item(F.col("title"), F.array(F.col("source_ids")[0], F.lit("s9999"))), item(F.concat("title", F.lit(" 98765")), F.slice("source_ids", 1, 2))
    odd = F.struct(F.col("title").alias("text"), F.slice("source_ids", 1, 2).alias("segment_ids"), F.lit(1).alias("weight"))
    bare = item(F.col("title"), F.array().cast("array<string>"))

    def reply(key_points=(), actions=(), questions=(), notes=True):
        lists = [F.array(*x).alias(n) for n, x in (("key_points", key_points), ("actions", actions), ("open_questions", questions))]
        return F.to_json(F.struct(*lists, *([F.array(F.struct(F.col("title").alias("text"))).alias("asr_notes")] if notes else [])))

    first = [reply([good], [good]), reply([good, lost]), F.lit("no reply"), reply([odd]), reply([bare]), reply([lost]), reply([digits], [digits]), reply([good], notes=False)]
    second = {1: reply([good], [], [good]), 2: reply([lost, good], [digits]), 3: reply([], [good]), 5: F.lit("{"), 7: reply([], [], [good, digits])}
    pick = lambda texts: F.coalesce(*(F.when(F.col("k") == k, t) for k, t in texts))
    tries = F.array(F.struct(F.lit(1).alias("attempt"), pick(enumerate(first)).alias("text")), F.struct(F.lit(2).alias("attempt"), pick(second.items()).alias("text")))
    return c.select("job_id", "chapter_id", F.inline(tries)).filter("text IS NOT NULL")


_STATUS = "WITH {0}, k AS (SELECT *, (job_id + ord) % 8 AS k FROM chapters)"
#: kind of reply: attempt, list and place of each item that counts; 'D' has digits that no chapter has
_COUNTS = "(VALUES (0, 1, 'key_points', 0, ''), (0, 1, 'actions', 0, ''), (1, 2, 'key_points', 0, ''), (1, 2, 'open_questions', 0, ''), (2, 2, 'key_points', 1, ''), (2, 2, 'actions', 0, ' 98765'), (3, 2, 'actions', 0, ''), (6, 1, 'key_points', 0, ' 98765'), (6, 1, 'actions', 0, ' 98765'), (7, 2, 'open_questions', 0, ''), (7, 2, 'open_questions', 1, ' 98765')) AS v(k, attempt, kind, idx, more)"


@query("g5_select_replies", _STATUS.format(X.CHAPTERS) + """ SELECT job_id, chapter_id, CASE WHEN k IN (0, 4, 6) THEN 1 ELSE 2 END AS attempt, CASE k WHEN 2 THEN 'reduced' WHEN 4 THEN 'retry' WHEN 5 THEN 'failed' ELSE 'accepted' END AS status, CASE WHEN k = 2 THEN 1 WHEN k NOT IN (4, 5) THEN 0 END AS n_unknown FROM k""")
def g5_select_replies(spark, d):
    return G.select_replies(_replies(spark, d), X.chapters(spark, d))


@query("g5_build_insights", _STATUS.format(X.CHAPTERS) + f""", {_BRIDGE}, i AS (SELECT job_id, chapter_id, attempt, kind, idx, title || more AS text FROM k JOIN {_COUNTS} USING (k)),
 src AS (SELECT job_id, chapter_id, string_agg(s.text, ' ' ORDER BY pos) AS src FROM bridge JOIN segments s USING (job_id, segment_id) GROUP BY ALL), ok AS (SELECT i.* FROM i JOIN src USING (job_id, chapter_id) WHERE kind <> 'key_points' OR list_bool_and(list_transform(list_filter(regexp_split_to_array(i.text, '[^0-9]+'), lambda x: x <> ''), lambda g: contains(src, g))) IS NOT FALSE)
 SELECT ok.job_id, ok.chapter_id, attempt, kind, idx, pos, ok.text, segment_id, s."start", s."end", s.speaker FROM ok JOIN bridge b USING (job_id, chapter_id) JOIN segments s USING (job_id, segment_id) WHERE pos < 2""")
def g5_build_insights(spark, d):
    return G.build_insights(_replies(spark, d), X.chapters(spark, d), X.segments(spark, d))


@query("g11_clock_mismatches", f"""WITH {X.CHAPTERS}, {_BRIDGE}, k AS (SELECT *, (job_id + ord) % 6 AS k FROM chapters)
 SELECT job_id, 'chapter' AS kind, chapter_id AS item FROM k WHERE k = 1 UNION ALL SELECT job_id, 'chapter', chapter_id || 'x' FROM k WHERE k = 2 UNION ALL SELECT job_id, 'source', source_ids[1] FROM k WHERE k = 3 UNION ALL SELECT job_id, 'segment', source_ids[1] || 'x' FROM k WHERE k = 4
 UNION ALL SELECT job_id, 'report chapter', chapter_id FROM k WHERE k IN (0, 5) UNION ALL SELECT job_id, 'moment', ord::VARCHAR FROM k WHERE k IN (1, 2, 4)""")
def g11_clock_mismatches(spark, d):
    c = X.chapters(spark, d).withColumn("k", (F.col("job_id") + F.col("ord")) % 6)
    s = X.segments(spark, d)
    k = F.col("k")
    insight = c.select("job_id", F.when(k == 2, F.concat("chapter_id", F.lit("x"))).otherwise(F.col("chapter_id")).alias("chapter_id"), F.when(k == 1, F.col("start") + 1).otherwise(F.col("start")).alias("start"), "end")
    first = c.withColumn("segment_id", F.col("source_ids")[0]).drop("start", "end", "title").join(s.select("job_id", "segment_id", "start", "end", "speaker"), ["job_id", "segment_id"])
    src = first.select("job_id", "chapter_id", F.when(k == 4, F.concat("segment_id", F.lit("x"))).otherwise(F.col("segment_id")).alias("segment_id"), "start", F.when(k == 3, F.col("end") + 0.5).otherwise(F.col("end")).alias("end"), "speaker")
    ref = c.select("job_id", "chapter_id", "start", F.when(k == 0, F.col("end") - 1).otherwise(F.col("end")).alias("end"), F.when(k == 5, F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"))
    moments = first.select("job_id", F.col("ord").alias("pos"), F.when(k == 1, F.col("start") + 1).otherwise(F.col("start")).alias("start"), F.when(k == 3, F.col("end") + 0.5).otherwise(F.col("end")).alias("end"), F.when(k == 2, F.lit("nobody")).otherwise(F.col("speaker")).alias("speaker"), "chapter_id")
    return G.clock_mismatches(insight, src, c, s, ref, moments)


def _report_replies(spark, d):
    """Two moments for each chapter: its first source, then the same again or, in two chapters of three, an unknown one."""
    c = X.chapters(spark, d)
    moment = lambda text, sid: F.struct(text.alias("text"), F.col("chapter_id"), sid.alias("segment_id"))
    first = F.col("source_ids")[0]
    two = F.array(moment(F.col("title"), first), moment(F.concat("title", F.lit("!")), F.when(F.col("ord") % 3 == 0, first).otherwise("s9999")))
    jobs = c.groupBy("job_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", two.alias("m")))), lambda x: x["m"])).alias("m"), F.min_by("title", "ord").alias("t"))
    return jobs.select("job_id", F.to_json(F.struct(F.col("t").alias("summary"), F.col("m").alias("key_moments"))).alias("text"))


def _sources(spark, d):
    s = X.segments(spark, d).select("job_id", "segment_id", "start", "end", "speaker")
    return C.chapter_segments(X.chapters(spark, d)).select("job_id", "chapter_id", "segment_id").join(s, ["job_id", "segment_id"])


_MOMENTS = f"""{X.CHAPTERS}, mo AS (SELECT c.job_id, 2 * (row_number() OVER (PARTITION BY c.job_id ORDER BY c.ord) - 1) AS pos, title AS text, chapter_id, segment_id, s."start", s."end", s.speaker FROM chapters c JOIN segments s ON s.job_id = c.job_id AND s.segment_id = c.source_ids[1])"""


@query("g7_hydrate_moments", f"WITH {_MOMENTS} SELECT * FROM mo")
def g7_hydrate_moments(spark, d):
    return G.hydrate_moments(_report_replies(spark, d), _sources(spark, d))


@query("g9_build_report", f"""WITH {_MOMENTS}, sp AS (SELECT job_id, speaker, round(sum("end" - "start"), 3) AS sec FROM segments GROUP BY ALL), t AS (SELECT job_id, string_agg(speaker, ',' ORDER BY speaker) AS speakers, round(sum(sec), 3) AS speech_sec FROM sp GROUP BY job_id),
 m AS (SELECT job_id, count(*) AS n_moments, string_agg(speaker, ',' ORDER BY pos) AS moment_speakers FROM mo GROUP BY job_id), c AS (SELECT job_id, min_by(title, ord) AS summary, string_agg(chapter_id, ',' ORDER BY ord) AS chapters FROM chapters GROUP BY job_id)
 SELECT job_id, summary, n_moments, moment_speakers, speakers, speech_sec, chapters, true AS draft_warning FROM c JOIN t USING (job_id) JOIN m USING (job_id)""")
def g9_build_report(spark, d):
    r = G.build_report(_report_replies(spark, d), _sources(spark, d), X.chapters(spark, d), X.segments(spark, d))
    total = F.round(F.aggregate("speakers", F.lit(0.0), lambda a, x: a + x["speech_sec"]), 3)
    return r.select("job_id", "summary", F.size("key_moments").cast("long").alias("n_moments"), F.array_join("key_moments.speaker", ",").alias("moment_speakers"), F.array_join("speakers.id", ",").alias("speakers"), total.alias("speech_sec"), F.array_join("chapters.id", ",").alias("chapters"), "draft_warning")


@query("g11_clock_gate", f"""WITH {X.HYPOTHESIS} SELECT job_id, count(*) AS n_sources, count(*) FILTER (bad) AS n_bad, count(*) FILTER (bad) = 0 AS ok FROM (SELECT h.job_id, NOT (h."start" IS NOT DISTINCT FROM s."start" AND h."end" IS NOT DISTINCT FROM s."end" AND h.speaker IS NOT DISTINCT FROM s.speaker) AS bad
 FROM (SELECT job_id, segment_id, speaker, CASE WHEN ord % 4 = 0 THEN "start" ELSE "start" - 0.25 END AS "start", "end" - 0.25 AS "end" FROM hypothesis) h LEFT JOIN segments s USING (job_id, segment_id)) GROUP BY job_id""")
def g11_clock_gate(spark, d):
    h = X.hypothesis(spark, d)
    h = h.select("job_id", "segment_id", "speaker", F.when(F.col("ord") % 4 == 0, F.col("start")).otherwise(F.col("start") - 0.25).alias("start"), (F.col("end") - 0.25).alias("end"))
    return G.clock_gate(h, X.segments(spark, d))


# ---- gates


@query("h2_check_end", f"""WITH {X.SEGMENTS}, e AS (SELECT job_id, max("end") - CASE job_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END AS duration FROM segments GROUP BY job_id),
 p AS (SELECT job_id, ord, CASE WHEN "end" <= "start" THEN 'bounds' WHEN "start" < lag("start") OVER (PARTITION BY job_id ORDER BY ord) THEN 'order' WHEN "end" > duration + 1 THEN 'end' END AS why FROM (SELECT * REPLACE (CASE WHEN job_id % 5 = 4 AND ord = 2 THEN greatest("start" - 30, 0) ELSE "start" END AS "start") FROM segments) JOIN e USING (job_id))
 SELECT job_id, 'G1.4' AS check_id, CASE WHEN count(why) = 0 THEN 'pass' ELSE 'fail' END AS status, coalesce(min_by(why, ord) FILTER (why IS NOT NULL), '') AS value FROM p GROUP BY job_id""")
def h2_check_end(spark, d):
    s = X.segments(spark, d)
    ends = s.groupBy("job_id").agg((F.max("end") - F.when(F.first(F.col("job_id") % 3) == 0, 0).when(F.first(F.col("job_id") % 3) == 1, 1).otherwise(4)).alias("duration"))
    moved = s.withColumn("start", F.when((F.col("job_id") % 5 == 4) & (F.col("ord") == 2), F.greatest(F.col("start") - 30, F.lit(0.0))).otherwise(F.col("start")))
    return H.check_monotonic(moved, ends)


@query("h2_check_monotonic", f"""WITH {X.INTERVALS}, p AS (SELECT *, CASE WHEN "start" < 0 OR "end" <= "start" THEN 'bounds' WHEN "start" < lag("start") OVER (PARTITION BY job_id ORDER BY ord) THEN 'order' END AS why FROM intervals)
 SELECT job_id, 'G1.4' AS check_id, CASE WHEN count(why) = 0 THEN 'pass' ELSE 'fail' END AS status, coalesce(min_by(why, ord) FILTER (why IS NOT NULL), '') AS value FROM p GROUP BY job_id""")
def h2_check_monotonic(spark, d):
    return H.check_monotonic(X.intervals(spark, d))


_GATE = f"""{X.SEGMENTS}, w AS (SELECT job_id, unnest({_TOKENS.format('text')}) AS w FROM segments WHERE trim(text) <> ''), jb AS (SELECT DISTINCT job_id FROM segments),
 wr AS (SELECT job_id, round(count(*) FILTER (regexp_full_match(w, '\\p{{Latin}}+')) / count(*), 3) AS r FROM w WHERE regexp_matches(w, '\\p{{L}}') GROUP BY job_id),
 cn AS (SELECT job_id, count(*) FILTER (trim(text) = '') AS n, sum(length(text) - length(regexp_replace(text, '[a-zA-Z]', '', 'g'))) AS latin FROM segments GROUP BY job_id),
 mo AS (SELECT *, CASE WHEN "start" < 0 OR "end" <= "start" THEN 'bounds' WHEN "start" < lag("start") OVER (PARTITION BY job_id ORDER BY ord) THEN 'order' END AS why FROM segments),
 hr AS (SELECT *, coalesce(max("end") OVER (PARTITION BY job_id ORDER BY "start", "end", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM segments WHERE "end" > "start"),
 ho AS (SELECT job_id, sum(round("start", 3) - round(reach, 3)) AS sec FROM hr WHERE "start" - reach >= 0.5 GROUP BY job_id),
 gate AS (SELECT job_id, 'G1.1' AS check_id, CASE WHEN coalesce(r, 1) >= 0.9 THEN 'pass' ELSE 'fail' END AS status, printf('%.3f', coalesce(r, 1)::DOUBLE) AS value FROM jb LEFT JOIN wr USING (job_id)
 UNION ALL SELECT job_id, 'G1.3', CASE WHEN n > 50 THEN 'warn' ELSE 'pass' END, n::VARCHAR FROM cn
 UNION ALL SELECT job_id, 'G1.4', CASE WHEN count(why) = 0 THEN 'pass' ELSE 'fail' END, coalesce(min_by(why, ord) FILTER (why IS NOT NULL), '') FROM mo GROUP BY job_id
 UNION ALL SELECT job_id, 'G1.5', CASE WHEN coalesce(sec, 0) > 500 THEN 'warn' ELSE 'pass' END, printf('%.3f', round(coalesce(sec, 0), 3)::DOUBLE) FROM jb LEFT JOIN ho USING (job_id))"""


@query("h3_transcript_gate", f"WITH {_GATE} SELECT * FROM gate")
def h3_transcript_gate(spark, d):
    return H.transcript_gate(X.segments(spark, d))


@query("h1_verdict", f"WITH {_GATE} SELECT job_id, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (status = 'warn') > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM gate GROUP BY job_id")
def h1_verdict(spark, d):
    return H.verdict(H.transcript_gate(X.segments(spark, d)))


@query("h4_chapter_gate", f"""WITH {X.CHAPTERS}, {_BRIDGE}, own AS (SELECT job_id, chapter_id, min(s."start") AS s, max(s."end") AS e FROM bridge JOIN segments s USING (job_id, segment_id) GROUP BY ALL),
 g AS (SELECT c.job_id, 'G2.1' AS check_id, count(*) FILTER (c."start" <> own.s OR c."end" <> own.e) AS n FROM chapters c JOIN own USING (job_id, chapter_id) GROUP BY c.job_id
 UNION ALL SELECT job_id, 'G2.5', count(*) FILTER (trim(title) = '' OR {_WORDS.format('title')} > 10 OR regexp_matches(lower(trim(title)), '^(in this segment|this chapter|the speaker|here is)')) FROM chapters GROUP BY job_id
 UNION ALL SELECT job_id, 'G2.7', count(*) FILTER (c <> 1) FROM (SELECT s.job_id, s.segment_id, count(chapter_id) AS c FROM segments s LEFT JOIN bridge b USING (job_id, segment_id) WHERE trim(text) <> '' GROUP BY ALL) GROUP BY job_id)
 SELECT job_id, check_id, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS status, n::VARCHAR AS value FROM g""")
def h4_chapter_gate(spark, d):
    return H.chapter_gate(X.chapters(spark, d), X.segments(spark, d))


@query("h6_report_gate", f"""WITH {X.CHAPTERS} SELECT job_id, 'G3.6' AS check_id, CASE WHEN count(*) BETWEEN 5 AND 12 THEN 'pass' ELSE 'warn' END AS status, count(*)::VARCHAR AS value FROM chapters GROUP BY job_id""")
def h6_report_gate(spark, d):
    return H.report_gate(X.chapters(spark, d))


# ---- edits

_EDITED = f"""{X.CHAPTERS}, {X.EDITS}, known AS (SELECT DISTINCT job_id, speaker FROM segments), now AS (SELECT s.job_id, s.segment_id, s.ord, s."start", s."end", coalesce(e.new_text, s.text) AS text, coalesce(k.speaker, s.speaker) AS speaker, s.text AS t0, s.speaker AS p0
 FROM segments s LEFT JOIN edits e USING (job_id, segment_id) LEFT JOIN known k ON k.job_id = s.job_id AND k.speaker = e.new_speaker), changed AS (SELECT job_id, segment_id FROM now WHERE text <> t0 OR speaker <> p0)"""


def _now(spark, d):
    s, e = X.segments(spark, d), X.edits(spark, d)
    return I.apply_speaker_edits(I.apply_text_edits(s, e), e)


@query("i1_i2_apply_edits", f"WITH {_EDITED} SELECT job_id, segment_id, text, speaker, trim(text) = '' AS empty FROM now")
def i1_i2_apply_edits(spark, d):
    return _now(spark, d).select("job_id", "segment_id", "text", "speaker", "empty")


@query("i4_restore", f"WITH {X.SEGMENTS} SELECT job_id, segment_id, text, speaker FROM segments")
def i4_restore(spark, d):
    return I.restore(_now(spark, d), X.segments(spark, d)).select("job_id", "segment_id", "text", "speaker")


@query("i5_changed_segments", f"WITH {_EDITED} SELECT * FROM changed")
def i5_changed_segments(spark, d):
    return I.changed_segments(_now(spark, d), X.segments(spark, d))


@query("i6_stale_chapters", f"""WITH {_EDITED}, {_BRIDGE} SELECT job_id, coalesce(c, '-') AS chapter_id, string_agg(segment_id, ',' ORDER BY segment_id) AS segments FROM changed LEFT JOIN (SELECT job_id, segment_id, arg_min(bridge.chapter_id, chapters.ord) AS c FROM bridge JOIN chapters USING (job_id, chapter_id) WHERE chapter_id <> 'C01' GROUP BY ALL) USING (job_id, segment_id) GROUP BY ALL""")
def i6_stale_chapters(spark, d):
    return I.stale_chapters(I.changed_segments(_now(spark, d), X.segments(spark, d)), X.chapters(spark, d).filter("chapter_id <> 'C01'"))


@query("i7_edited_chapters", f"WITH {_EDITED}, {_BRIDGE} SELECT DISTINCT job_id, chapter_id FROM bridge SEMI JOIN changed USING (job_id, segment_id)")
def i7_edited_chapters(spark, d):
    return I.edited_chapters(X.chapters(spark, d), _now(spark, d), X.segments(spark, d))


@query("i8_apply_titles", f"""WITH {X.CHAPTERS} SELECT job_id, chapter_id, CASE WHEN ord % 2 = 0 THEN trim(regexp_replace('New   ' || title, '\\s+', ' ', 'g')) ELSE title END AS title FROM chapters""")
def i8_apply_titles(spark, d):
    c = X.chapters(spark, d)
    new = c.filter("ord % 2 = 0").select("job_id", "chapter_id", F.concat(F.lit("New   "), "title").alias("new_title"))
    return I.apply_titles(c, new).select("job_id", "chapter_id", "title")


@query("i9_suggest_terms")
def i9_suggest_terms(spark, d):
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 6)))
    return I.suggest_terms(X.segments(spark, d), _table(spark, d, "benchmark").select(words.alias("term")))


# ---- evaluation


@query("j2_pair_status_strict", f"""WITH {X.HYPOTHESIS}, o AS (SELECT g.job_id, g.ord, string_agg(h.text, ' ' ORDER BY h."start", h.ord) AS hyp, bool_or(h.speaker = g.speaker) AS same FROM segments g JOIN hypothesis h ON g.job_id = h.job_id AND least(g."end", h."end" + 0.1) - greatest(g."start", h."start" - 0.1) > 0 GROUP BY ALL),
 r AS (SELECT s.job_id, s.ord, hyp, same, list_distinct({_TOKENS.format('text')}) AS g, list_distinct({_TOKENS.format("coalesce(hyp, '')")}) AS h, {_TOKENS.format('text')} = {_TOKENS.format("coalesce(hyp, '')")} AS equal FROM segments s LEFT JOIN o USING (job_id, ord))
 SELECT job_id, ord, CASE WHEN hyp IS NULL THEN 'missing' WHEN same AND CASE WHEN len(g) = 0 OR len(h) = 0 THEN equal ELSE len(list_intersect(g, h)) / greatest(len(g), len(h)) >= 0.55 OR len(list_intersect(g, h)) / len(g) >= 0.7 END THEN 'match' ELSE 'differ' END AS status FROM r""")
def j2_pair_status_strict(spark, d):
    return J.pair_status_strict(X.segments(spark, d), X.hypothesis(spark, d), pad=0.1)


@query("j2_pair_status", f"""WITH {X.HYPOTHESIS}, o AS (SELECT g.job_id, g.ord, string_agg(h.text, ' ' ORDER BY h."start", h.ord) AS hyp FROM segments g JOIN hypothesis h ON g.job_id = h.job_id AND least(g."end", h."end" + 0.5) - greatest(g."start", h."start" - 0.5) > 0 GROUP BY ALL),
 r AS (SELECT s.job_id, s.ord, hyp, list_distinct({_TOKENS.format('text')}) AS g, list_distinct({_TOKENS.format("coalesce(hyp, '')")}) AS h FROM segments s LEFT JOIN o USING (job_id, ord))
 SELECT job_id, ord, CASE WHEN hyp IS NULL THEN 'missing' WHEN round(CASE WHEN len(g) = 0 THEN CASE WHEN len(h) = 0 THEN 1.0 ELSE 0.0 END ELSE len(list_intersect(g, h)) / len(g) END, 6) >= 0.55 THEN 'match' ELSE 'differ' END AS status FROM r""")
def j2_pair_status(spark, d):
    return J.pair_status(X.segments(spark, d), X.hypothesis(spark, d))


@query("j3_map_speakers")
def j3_map_speakers(spark, d):
    return J.map_speakers(X.segments(spark, d), X.hypothesis(spark, d))


@query("j4_transcript_glue", f"""WITH {X.INTERVALS}, p AS (SELECT *, lag("start") OVER w AS ps, lag("end") OVER w AS pe FROM intervals WINDOW w AS (PARTITION BY job_id ORDER BY ord)) SELECT job_id, count(*) FILTER ("start" < ps) AS n_disorder, count(*) FILTER (pe - "start" > 0.25) AS n_overlap FROM p GROUP BY job_id""")
def j4_transcript_glue(spark, d):
    return J.transcript_glue(X.intervals(spark, d))


@query("j5_speaker_stats", f"""WITH {X.SEGMENTS} SELECT job_id, count(*) AS n_speakers, count(*) FILTER (sec >= 30) AS n_large FROM (SELECT job_id, speaker, sum("end" - "start") AS sec FROM segments GROUP BY ALL) GROUP BY job_id""")
def j5_speaker_stats(spark, d):
    return J.speaker_stats(X.segments(spark, d))


_GLUE = f"""{X.CHAPTERS}, {_DUR.format('segments')}, ai AS (SELECT job_id, ord, "start", "end" FROM chapters WHERE ord % 5 <> 4 AND job_id % 9 <> 0), bi AS (SELECT job_id, ord, "start", "end" FROM chapters), {_SWEEP},
 nh AS (SELECT job_id, count(*) AS n, count(*) FILTER ("start" < ps) AS back, count(*) FILTER (pe - "start" > 0.25) AS laps, max("end") AS last FROM (SELECT *, lag("start") OVER w AS ps, lag("end") OVER w AS pe FROM ai WINDOW w AS (PARTITION BY job_id ORDER BY ord)) GROUP BY job_id),
 fj AS (SELECT job_id, nb, n, back, laps, last <= duration + 1 AS inside, least(both_sec / greatest(both_sec + only_a_sec, 1e-9), both_sec / greatest(both_sec + only_b_sec, 1e-9)) AS worse FROM (SELECT job_id, count(*) AS nb FROM bi GROUP BY job_id) LEFT JOIN nh USING (job_id) LEFT JOIN s USING (job_id) LEFT JOIN durations USING (job_id))"""


@query("j6_chapters_glue", f"""WITH {_GLUE} SELECT job_id, 'C0_nonempty' AS check_id, CASE WHEN n IS NULL THEN 'FAIL' ELSE 'PASS' END AS status FROM fj
 UNION ALL SELECT job_id, 'C1_time_order', CASE WHEN back = 0 THEN 'PASS' ELSE 'FAIL' END FROM fj WHERE n > 0
 UNION ALL SELECT job_id, 'C2_no_overlap', CASE WHEN laps = 0 THEN 'PASS' ELSE 'FAIL' END FROM fj WHERE n > 0
 UNION ALL SELECT job_id, 'C3_inside_part', CASE WHEN inside THEN 'PASS' ELSE 'FAIL' END FROM fj WHERE n > 0
 UNION ALL SELECT job_id, 'C4_timeline_vs_baseline', CASE WHEN worse >= 0.8 THEN 'PASS' WHEN worse >= 0.6 THEN 'WARN' ELSE 'FAIL' END FROM fj WHERE n > 0
 UNION ALL SELECT job_id, 'C5_count_vs_baseline', CASE WHEN n / nb BETWEEN 0.5 AND 2.0 THEN 'PASS' ELSE 'WARN' END FROM fj WHERE n > 0""")
def j6_chapters_glue(spark, d):
    c = X.chapters(spark, d).select("job_id", "ord", "start", "end")
    return J.chapters_glue(c.filter("ord % 5 <> 4 AND job_id % 9 <> 0"), c, _durations(X.segments(spark, d)))


@query("j7_turn_metrics", f"""WITH {X.SEGMENTS}, p AS (SELECT *, lag(speaker) OVER (PARTITION BY job_id ORDER BY "start", ord) AS prev FROM segments) SELECT job_id, count(*) AS n, count(*) FILTER ("end" - "start" < 1) AS n_below_1s, count(*) FILTER ("end" - "start" < 2) AS n_below_2s, count(*) FILTER (prev <> speaker) AS switches, count(DISTINCT speaker) AS speakers FROM p GROUP BY job_id""")
def j7_turn_metrics(spark, d):
    return J.turn_metrics(X.segments(spark, d))


@query("j8_grid_summary", f"""WITH {X.SEGMENTS} SELECT job_id, round(quantile_cont("end" - "start", 0.5), 6) AS median_sec, count(*) FILTER ({_WORDS.format('text')} <= 3) AS n_short FROM segments GROUP BY job_id""")
def j8_grid_summary(spark, d):
    return J.grid_summary(X.segments(spark, d))


@query("j9_der")
def j9_der(spark, d):
    return J.der(X.segments(spark, d), X.hypothesis(spark, d), collar=0.1)


def bent_hypothesis(spark, d):
    """The hypothesis with words added and letters lost."""
    text = F.when(F.col("ord") % 7 == 3, F.concat("text", F.lit(" indeed so"))).when(F.col("ord") % 7 == 5, F.replace("text", F.lit("e"), F.lit(""))).otherwise(F.col("text"))
    return X.hypothesis(spark, d).withColumn("text", text)


@query("j10_cer")
def j10_cer(spark, d):
    return J.cer(X.segments(spark, d), bent_hypothesis(spark, d), 0.2)


@query("j11_speaker_count_gate", f"""WITH {X.INTERVALS}, p AS (SELECT job_id, speaker, sum("end" - "start") AS sec FROM intervals GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sec DESC, speaker) AS k FROM p) SELECT job_id, count(*) AS n_speakers, count(*) FILTER (sec < 30) AS n_tiny, round(sum(sec) FILTER (k <= 2) / sum(sec), 6) AS top_share FROM r GROUP BY job_id""")
def j11_speaker_count_gate(spark, d):
    return J.speaker_count_gate(X.intervals(spark, d), 2, 30.0)


@query("j12_regression_bands", f"""WITH {_GATE}, {X.HYPOTHESIS.removeprefix(X.SEGMENTS + ', ')}, ai AS (SELECT job_id, ord, "start", "end" FROM segments), bi AS (SELECT job_id, ord, "start", "end" FROM hypothesis), {_SWEEP}, hs AS (SELECT job_id, count(DISTINCT speaker) AS n FROM hypothesis GROUP BY job_id),
 fj AS (SELECT job_id, CASE WHEN any_sec > 0 THEN both_sec / any_sec ELSE 1 END AS iou, hs.n AS speakers, coalesce(r, 1.0) AS ratio, latin FROM s LEFT JOIN hs USING (job_id) LEFT JOIN wr USING (job_id) LEFT JOIN cn USING (job_id))
 SELECT job_id, 'REG.VAD.IoU' AS check_id, round(iou, 6) >= 0.7 AS ok FROM fj UNION ALL SELECT job_id, 'REG.DIAR.speakers', coalesce(speakers BETWEEN 2 AND 4, false) FROM fj UNION ALL SELECT job_id, 'REG.ASR.ratio', ratio >= 0.9 FROM fj UNION ALL SELECT job_id, 'REG.ASR.latin', latin <= 0 FROM fj""")
def j12_regression_bands(spark, d):
    s = X.segments(spark, d)
    return J.regression_bands(s, X.hypothesis(spark, d), s)


# ---- jobs


def _events(spark, d):
    return _table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ord"), "value")


_EV = "ev AS (SELECT user_id AS job_id, event_type AS stage, ts, event_id AS ord, value FROM events)"


@query("k1_latest_stage", f"""WITH {_EV}, s AS (SELECT job_id, stage, max_by(value, (ts, ord)) AS value, epoch_us(max(ts)) AS us, min((ts, ord)) AS first FROM ev GROUP BY ALL) SELECT job_id, stage, value, us, row_number() OVER (PARTITION BY job_id ORDER BY first) AS pos FROM s""")
def k1_latest_stage(spark, d):
    return K.latest_stage(_events(spark, d)).withColumn("us", F.unix_micros("ts")).drop("ts")


@query("k2_job_state", f"""WITH {_EV} SELECT job_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) AS seen, epoch_us(min(ts) FILTER (stage = 'error')) AS finished_at, CASE WHEN count(*) FILTER (stage = 'error') = 0 THEN 'running' ELSE 'done' END AS state FROM ev GROUP BY job_id""")
def k2_job_state(spark, d):
    s = K.job_state(_events(spark, d))
    return s.select("job_id", *(F.unix_micros(c).alias(c) for c in ("started", "seen", "finished_at")), "state")


@query("k3_rate_limit", """SELECT user_id AS client, event_id AS ord, n - 1 AS n_before, n - 1 >= 5 AS exceeded FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS n FROM events)""")
def k3_rate_limit(spark, d):
    return K.rate_limit(_events(spark, d).select(F.col("job_id").alias("client"), "ord", "ts"))


@query("k4_admission_audit", f"""WITH {X.INTERVALS}, s AS (SELECT job_id AS client, ord, "start" AS t, 1 AS step FROM intervals UNION ALL SELECT job_id, NULL, "end", -1 FROM intervals), o AS (SELECT *, sum(step) OVER (PARTITION BY client ORDER BY t, step, ord NULLS FIRST) AS open FROM s) SELECT client, ord, open, open > 3 AS refused FROM o WHERE step = 1""")
def k4_admission_audit(spark, d):
    return K.admission_audit(X.intervals(spark, d).withColumnRenamed("job_id", "client"))


_JOBS = f"""{_EV}, jb AS (SELECT job_id, min(ts) - INTERVAL 1 HOUR AS created_at, min(ts) + (job_id % 20) * INTERVAL 2 DAYS AS expires_at FROM ev GROUP BY job_id UNION ALL SELECT job_id + 100000, min(ts), max(ts) FROM ev GROUP BY job_id),
 ch AS (SELECT job_id, ord, ts, CASE stage WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, job_id % 3 = 0 AS has_chapters FROM ev),
 st AS (SELECT jb.*, CASE WHEN expires_at <= TIMESTAMP '2024-01-22' THEN 'expired' WHEN x.state = 'failed' AND x.has_chapters THEN 'done' ELSE coalesce(x.state, 'queued') END AS state, started_at, finished_at FROM jb LEFT JOIN (SELECT job_id, max_by({{'state': state, 'has_chapters': has_chapters}}, (ts, ord)) AS x, min(ts) FILTER (state = 'running') AS started_at, min(ts) FILTER (state IN ('done', 'failed')) AS finished_at FROM ch GROUP BY job_id) USING (job_id))"""


def _jobs(spark, d):
    """Jobs with times of creation and expiry, half of them without any event, and their changes of state."""
    e = _events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    some = e.groupBy("job_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    jobs = some.select("job_id", F.expr("a - INTERVAL 1 HOUR").alias("created_at"), F.expr("a + (job_id % 20) * INTERVAL 2 DAYS").alias("expires_at")).unionByName(some.select((F.col("job_id") + 100000).alias("job_id"), F.col("a").alias("created_at"), F.col("b").alias("expires_at")))
    state = F.when(F.col("stage") == "purchase", "done").when(F.col("stage") == "error", "failed").otherwise("running")
    return jobs, e.select("job_id", "ord", "ts", state.alias("state"), (F.col("job_id") % 3 == 0).alias("has_chapters"))


@query("k2_job_states", f"WITH {_JOBS} SELECT job_id, state, epoch_us(started_at) AS started_at, epoch_us(finished_at) AS finished_at FROM st")
def k2_job_states(spark, d):
    s = K.job_states(*_jobs(spark, d), F.lit("2024-01-22 00:00:00").cast("timestamp"))
    return s.select("job_id", "state", *(F.unix_micros(c).alias(c) for c in ("started_at", "finished_at")))


@query("k7_job_progress", f"""WITH {_JOBS}, s AS (SELECT job_id, stage, max_by(value, (ts, ord)) AS value, min((ts, ord)) AS first FROM ev GROUP BY ALL), p AS (SELECT job_id, stage, value, row_number() OVER (PARTITION BY job_id ORDER BY first) AS pos FROM s), q AS (SELECT *, CASE WHEN pos % 2 = 0 OR pos > 3 THEN 'running' ELSE 'done' END AS status, CAST(floor(value) AS BIGINT) % 100 AS pct FROM p),
 o AS (SELECT job_id, count(*) FILTER (status = 'done') AS done, arg_min(pct, pos) FILTER (status = 'running') AS share, arg_max(stage, pos) FILTER (status = 'running') AS bs, arg_max(pct, pos) FILTER (status = 'running') AS bp, arg_max(stage, pos) AS ls, arg_max(pct, pos) AS lp FROM q GROUP BY job_id)
 SELECT job_id, CASE WHEN state = 'done' THEN 100 ELSE greatest(CAST(least(100, floor(100 * (coalesce(done, 0) + coalesce(share, 0) / 100) / 7 + 1e-9)) AS BIGINT), CASE WHEN state = 'running' THEN coalesce(bp, lp) END) END AS pct, coalesce(bs, ls) AS stage,
 CASE WHEN state IN ('done', 'failed') AND finished_at IS NOT NULL THEN (epoch_us(finished_at) - epoch_us(created_at)) // 1000000 ELSE greatest(0, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at)) // 1000000) END AS elapsed_sec FROM st LEFT JOIN o USING (job_id)""")
def k7_job_progress(spark, d):
    jobs, changes = _jobs(spark, d)
    states = K.job_states(jobs, changes, F.lit("2024-01-22 00:00:00").cast("timestamp")).join(jobs.select("job_id", "created_at"), "job_id")
    s = K.latest_stage(_events(spark, d)).select("job_id", "pos", "stage", F.when((F.col("pos") % 2 == 0) | (F.col("pos") > 3), "running").otherwise("done").alias("status"), (F.floor("value") % 100).alias("pct"), F.lit(None).cast("double").alias("runtime_sec"))
    return K.job_progress(states, s, 7, F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("k4_admission", f"""WITH {X.INTERVALS}, r AS (SELECT job_id AS client, ord, "start" AS ts, job_id % 10 = 0 AS loopback, "start" + (ord % 5) AS started, greatest("start" + (ord % 5), "end") AS ended FROM intervals),
 s AS (SELECT ord, ts AS t, 1 AS rank, 1 AS a, 1 AS q, true AS own FROM r UNION ALL SELECT ord, started, CASE WHEN started = ts THEN 2 ELSE 0 END, 0, -1, false FROM r UNION ALL SELECT ord, ended, CASE WHEN ended = ts THEN 2 ELSE 0 END, -1, 0, false FROM r),
 w AS (SELECT ord, own, sum(a) OVER o - 1 AS active, sum(q) OVER o - 1 AS queued FROM s WINDOW o AS (ORDER BY t, rank, ord, own, a)), n AS (SELECT ord, count(*) OVER (PARTITION BY client ORDER BY ts RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS n_before FROM r),
 f AS (SELECT client, ord, n_before, active, queued, CASE WHEN n_before >= 40 AND NOT loopback THEN 'address' WHEN active >= 90 THEN 'concurrent' WHEN queued >= 7 THEN 'queue' END AS reason FROM r JOIN n USING (ord) JOIN (SELECT * FROM w WHERE own) USING (ord))
 SELECT client, ord, n_before, active::BIGINT AS active, queued::BIGINT AS queued, CASE WHEN reason IS NULL THEN 200 WHEN reason = 'address' THEN 429 ELSE 409 END AS status, reason FROM f""")
def k4_admission(spark, d):
    i = X.intervals(spark, d)
    r = i.select(F.col("job_id").alias("client"), "ord", F.col("start").alias("ts"), (F.col("job_id") % 10 == 0).alias("loopback"), (F.col("start") + F.col("ord") % 5).alias("started"), F.greatest(F.col("start") + F.col("ord") % 5, "end").alias("ended"))
    return K.admission(r, 40, 90, 7)


@query("k9_stage_plan", f"""WITH {X.CHAPTERS}, c AS (SELECT job_id, count(*) FILTER (trim(title) = '' OR (job_id % 4 = 1 AND ord = 0)) AS untitled FROM chapters GROUP BY job_id), p AS (SELECT *, unnest(['normalize', 'vad', 'diarize', 'asr', 'chunk', 'titles', 'extract', 'report']) AS stage, unnest(range(0, 8)) AS pos FROM c)
 SELECT job_id, pos, stage, CASE WHEN pos < 4 THEN CASE WHEN job_id % 3 = 0 OR pos = 1 THEN 'done' ELSE 'pending' END WHEN pos = 4 THEN 'done' WHEN pos = 5 THEN CASE WHEN untitled = 0 THEN 'done' ELSE 'unavailable' END WHEN pos = 6 THEN CASE WHEN job_id % 5 = 0 THEN 'done' ELSE 'pending' END ELSE 'pending' END AS status FROM p""")
def k9_stage_plan(spark, d):
    c = X.chapters(spark, d)
    has = F.array(*(F.struct(F.lit(artifact).alias("artifact"), valid.alias("valid")) for artifact, valid in (("regions", F.lit(True)), ("chapters", F.lit(True)), ("transcript", F.col("job_id") % 3 == 0), ("insights", F.col("job_id") % 5 == 0))))
    a = c.select("job_id").distinct().select("job_id", F.inline(has))
    titled = c.select("job_id", F.when((F.col("job_id") % 4 == 1) & (F.col("ord") == 0), " ").otherwise(F.col("title")).alias("title"))
    return K.stage_plan(a, titled, [s for s, _ in K.STEPS if s != "titles"])


@query("k5_expired", f"""WITH {_EV} SELECT job_id, epoch_us(min(ts)) AS started FROM ev GROUP BY job_id HAVING min(ts) + INTERVAL 20 DAYS <= TIMESTAMP '2024-01-22'""")
def k5_expired(spark, d):
    jobs = K.job_state(_events(spark, d)).withColumn("expires_at", F.expr("started + INTERVAL 20 DAYS"))
    return K.expired(jobs, F.lit("2024-01-22 00:00:00").cast("timestamp")).select("job_id", F.unix_micros("started").alias("started"))


@query("k6_stalled_jobs", f"""WITH {_EV} SELECT job_id, epoch_us(max(ts)) AS seen FROM ev GROUP BY job_id HAVING max(ts) < TIMESTAMP '2024-01-31' - INTERVAL 12 HOURS""")
def k6_stalled_jobs(spark, d):
    return K.stalled_jobs(K.job_state(_events(spark, d), terminal="failed"), F.lit("2024-01-31 00:00:00").cast("timestamp"), 12 * 3600).select("job_id", F.unix_micros("seen").alias("seen"))


@query("k7_progress", f"""WITH {_EV}, s AS (SELECT job_id, stage, max(ts) AS ts, min((ts, ord)) AS first FROM ev GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY first) AS pos FROM s) SELECT job_id, CAST(floor(100 * count(*) / 7) AS BIGINT) AS pct, max_by(stage, (ts, pos)) AS label FROM p GROUP BY job_id""")
def k7_progress(spark, d):
    return K.progress(K.latest_stage(_events(spark, d)), 7)


@query("k9_artifact_completeness", f"""WITH {_EV}, j AS (SELECT DISTINCT job_id, unnest(['click', 'view', 'error', 'purchase', 'asr']) AS stage FROM ev) SELECT job_id, stage, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.job_id = j.job_id AND ev.stage = j.stage) THEN 'done' ELSE 'pending' END AS status FROM j""")
def k9_artifact_completeness(spark, d):
    return K.artifact_completeness(K.latest_stage(_events(spark, d)), ["click", "view", "error", "purchase", "asr"])


@query("k12_finalize_speakers")
def k12_finalize_speakers(spark, d):
    v = X.vectors(spark, d).withColumn("speaker", F.format_string("SPEAKER_%02d", F.col("label")))
    return E.finalize_speakers(v, v.filter("ord % 2 = 0").select("job_id", "ord", "speaker", "start", "end"), least=16.0)


@query("k13_time_to_first", f"""WITH {_EV} SELECT job_id, round((epoch_us(min(ts) FILTER (stage = 'purchase')) - epoch_us(min(ts))) / 1e6, 3) AS sec FROM ev GROUP BY job_id HAVING count(*) FILTER (stage = 'purchase') > 0""")
def k13_time_to_first(spark, d):
    return K.time_to_first(_events(spark, d), "purchase")


@query("k14_stage_timings", f"WITH {_EV} SELECT stage, count(*) AS n, round(avg(value), 6) AS mean_value FROM ev GROUP BY stage")
def k14_stage_timings(spark, d):
    return K.stage_timings(_events(spark, d))
