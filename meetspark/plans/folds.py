"""SQL for queries that are folds over a job's rows: recursive common table expressions, one step for each row."""

from __future__ import annotations

from . import fixtures as X
from .recordings import _DUR, _HOLES, _PACK
from .registry import SQL

SQL["c19_hysteresis_regions"] = """WITH RECURSIVE f AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value - floor(value) AS p FROM events),
 st AS (SELECT DISTINCT job_id, -1::BIGINT AS i, NULL::BIGINT AS a, NULL::BIGINT AS t, NULL::BIGINT AS oa, NULL::BIGINT AS ob FROM f
 UNION ALL SELECT job_id, i, CASE WHEN a IS NULL THEN CASE WHEN p >= 0.5 THEN i END WHEN p < 0.35 AND i - t >= 2 THEN NULL ELSE a END, CASE WHEN a IS NOT NULL AND p < 0.35 AND i - t < 2 THEN t END, CASE WHEN a IS NOT NULL AND p < 0.35 AND i - t >= 2 THEN a END, CASE WHEN a IS NOT NULL AND p < 0.35 AND i - t >= 2 THEN t END
 FROM (SELECT f.job_id, f.i, f.p, st.a, coalesce(st.t, f.i) AS t FROM st JOIN f ON f.job_id = st.job_id AND f.i = st.i + 1)),
 n AS (SELECT job_id, count(*) AS n FROM f GROUP BY job_id), r AS (SELECT job_id, oa AS a, ob AS b FROM st WHERE oa IS NOT NULL UNION ALL SELECT job_id, a, n AS b FROM st JOIN n USING (job_id) WHERE a IS NOT NULL AND i = n - 1),
 q AS (SELECT job_id, a, a * 0.1::DOUBLE - 0.1 AS s, least(b * 0.1::DOUBLE + 0.1, n * 0.1::DOUBLE) AS e FROM r JOIN n USING (job_id) WHERE b - a >= 2),
 g AS (SELECT job_id, a, greatest(0, s, coalesce(max(e) OVER (PARTITION BY job_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s, e FROM q)
 SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY a) - 1 AS ord, round(s, 3) AS "start", round(e, 3) AS "end" FROM g WHERE e > s"""


def _cut_plans(n: str, pause: float, low: float, high: float, half: float) -> str:
    """``cuts`` and ``pt`` (parts) of the recordings ``intervals``; ``n`` is the number of parts by ``duration`` and ``job_id``."""
    return f"""{X.INTERVALS}, {_DUR.format('intervals')}, {_HOLES.format('intervals', pause)}, np AS (SELECT job_id, duration, {n} AS n FROM durations),
 pz AS (SELECT job_id, list({{'mid': floor((round(1000 * "start") + round(1000 * "end") + 1) / 2) / 1000, 'dur': round("end" - "start", 3), 's': "start", 'e': "end"}} ORDER BY "start") AS p FROM holes GROUP BY job_id), jp AS (SELECT np.*, coalesce(p, []) AS p FROM np LEFT JOIN pz USING (job_id) WHERE n > 1),
 ct AS (SELECT job_id, 0::BIGINT AS k, NULL::DOUBLE AS pl, 0::DOUBLE AS pause, NULL::DOUBLE AS used, NULL::DOUBLE AS "from", NULL::DOUBLE AS "to", NULL::DOUBLE AS ideal FROM jp
 UNION ALL SELECT job_id, k, coalesce(b.mid, free), coalesce(b.dur, 0), CASE WHEN b IS NULL THEN used ELSE b.mid END, coalesce(b.s, free), coalesce(b.e, free), ideal
 FROM (SELECT *, coalesce(list_sort(list_transform(list_filter(inside, lambda x: abs(x.mid - ideal) <= {half} AND x.mid IS DISTINCT FROM used), lambda x: {{'k': -(x.dur - 0.15 * abs(x.mid - ideal)), 'k2': 0::DOUBLE, 'mid': x.mid, 'dur': x.dur, 's': x.s, 'e': x.e}}))[1],
       list_sort(list_transform(inside, lambda x: {{'k': -x.dur, 'k2': abs(x.mid - ideal), 'mid': x.mid, 'dur': x.dur, 's': x.s, 'e': x.e}}))[1]) AS b,
       round(CASE WHEN lo > hi + 1e-6 THEN greatest(lo, least(least(greatest(ideal, {low}), duration - {low}), duration - 1e-3)) ELSE least(greatest(ideal, lo), hi) END, 3) AS free
 FROM (SELECT *, list_filter(p, lambda x: x.mid >= lo AND x.mid <= hi) AS inside FROM (SELECT *, least(duration - {low} * (n - k), greatest(soft, lo)) AS hi
 FROM (SELECT jp.job_id, jp.duration, jp.n, jp.p, ct.used, ct.k + 1 AS k, jp.duration / jp.n * (ct.k + 1) AS ideal, coalesce(ct.pl, 0) + {low} AS lo, coalesce(ct.pl, 0) + {high} AS soft FROM ct JOIN jp ON jp.job_id = ct.job_id AND ct.k + 1 < jp.n))))),
 cuts AS (SELECT job_id, k - 1 AS ord, round(pl, 3) AS "at", round("from", 3) AS pause_start, round("to", 3) AS pause_end, round(pause, 3) AS pause, round(ideal, 3) AS ideal, round(pl - ideal, 3) AS "offset" FROM ct WHERE k > 0),
 pt AS (SELECT job_id, row_number() OVER w - 1 AS ord, s AS "start", coalesce(lead(s) OVER w, duration) AS "end" FROM (SELECT job_id, "at" AS s FROM cuts UNION ALL SELECT job_id, 0 FROM durations) JOIN durations USING (job_id) WINDOW w AS (PARTITION BY job_id ORDER BY s))"""


_PLANS = _cut_plans("CAST(CASE WHEN duration < 600 THEN 1 ELSE least(greatest(greatest(2, ceil(duration / 900 - 1e-3)), floor(duration / 300 + 1e-3)), greatest(greatest(2, ceil(duration / 900 - 1e-3)), round_even(duration / 600, 0))) END AS BIGINT)", 0.3, 300, 900, 120)
#: few pauses, tight bounds and more parts than some recordings have room for: every rule for a cut decides some
_TIGHT = _cut_plans("CAST(2 + job_id % 6 AS BIGINT)", 100.0, 400, 700, 15)

SQL["d2_choose_cuts_tight"] = f"WITH RECURSIVE {_TIGHT} SELECT * FROM cuts"
SQL["d2_choose_cuts"] = f"WITH RECURSIVE {_PLANS} SELECT * FROM cuts"
SQL["d3_parts_from_cuts"] = f"""WITH RECURSIVE {_PLANS} SELECT job_id, ord, printf('part%02d', ord + 1) AS part_id, "start", "end" FROM pt"""


def _group(src: str, joins: str) -> str:
    """``gr(job_id, i, g)``: rows in order, each in the group of the one before where ``joins`` (``gs, ge`` the group's bounds so far)."""
    return f"""od AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS i FROM {src}), gr AS (SELECT job_id, i, 0::BIGINT AS g, "start" AS gs, "end" AS ge FROM od WHERE i = 1
 UNION ALL SELECT job_id, i, CASE WHEN ok THEN g ELSE g + 1 END, CASE WHEN ok THEN gs ELSE "start" END, "end" FROM (SELECT od.*, gr.g, gr.gs, {joins} AS ok FROM gr JOIN od ON od.job_id = gr.job_id AND od.i = gr.i + 1)),
 gg AS (SELECT job_id, g, min(gs) AS "start", arg_max(ge, i) AS "end" FROM gr GROUP BY job_id, g)"""


SQL["d4_coalesce_short_parts"] = f"""WITH RECURSIVE {_PLANS}, {_group('pt', 'round(gr.ge - gr.gs, 3) + 1e-9 < 500')}, la AS (SELECT *, max(g) OVER (PARTITION BY job_id) AS m FROM gg), fx AS (SELECT job_id, CASE WHEN g = m AND g > 0 AND round("end" - "start", 3) + 1e-9 < 500 THEN g - 1 ELSE g END AS g, "start", "end" FROM la)
 SELECT job_id, g AS ord, printf('part%02d', g + 1) AS part_id, min("start") AS "start", max("end") AS "end" FROM fx GROUP BY job_id, g"""
_BANDS = _cut_plans("CAST(CASE WHEN duration < 480 THEN 1 ELSE least(greatest(greatest(2, ceil(duration / 360 - 1e-3)), floor(duration / 240 + 1e-3)), greatest(greatest(2, ceil(duration / 360 - 1e-3)), round_even(duration / 300, 0))) END AS BIGINT)", 20.0, 240, 360, 90)
SQL["d5_cut_plan"] = f"""WITH RECURSIVE {_BANDS}, {_group('pt', 'round(gr.ge - gr.gs, 3) + 1e-9 < 240')}, la AS (SELECT *, max(g) OVER (PARTITION BY job_id) AS m FROM gg), fx AS (SELECT job_id, CASE WHEN g = m AND g > 0 AND round("end" - "start", 3) + 1e-9 < 240 THEN g - 1 ELSE g END AS g, "start", "end" FROM la),
 ps AS (SELECT job_id, g, round(max("end") - min("start"), 3) AS sec FROM fx GROUP BY job_id, g), pa AS (SELECT job_id, count(*) AS n_parts, min(sec) AS min_part_sec, max(sec) AS max_part_sec, round(max(sec) - min(sec), 3) AS spread_sec, bool_and(sec BETWEEN 240 AND 360) AS all_in_range FROM ps GROUP BY job_id),
 pn AS (SELECT job_id, count(*) AS n_pauses, max(round("end" - "start", 3)) AS longest FROM holes GROUP BY job_id)
 SELECT job_id, duration, n AS requested_n_parts, n_parts, coalesce(n_pauses, 0) AS n_pauses, min_part_sec, max_part_sec, spread_sec, all_in_range, longest FROM np JOIN pa USING (job_id) LEFT JOIN pn USING (job_id)"""
SQL["f4_absorb_short_units"] = f"""WITH RECURSIVE {X.SEGMENTS}, {_group('segments', '(od."end" - od."start" < 9 OR (gr.g = 0 AND gr.ge - gr.gs < 9))')} SELECT job_id, g AS ord, "start", "end" FROM gg"""

SQL["e8_greedy_remap"] = f"""WITH RECURSIVE {X.VECTORS}, ov AS (SELECT job_id, 'L' || label AS cluster, 'P' || (ord % 7) AS published, sum("end" - "start") AS sec FROM vectors GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY sec DESC, cluster, published) AS i FROM ov WHERE sec > 0),
 gm AS (SELECT job_id, i, true AS ok, [cluster] AS c, [published] AS p FROM rk WHERE i = 1 UNION ALL SELECT job_id, i, ok, CASE WHEN ok THEN list_append(c, cluster) ELSE c END, CASE WHEN ok THEN list_append(p, published) ELSE p END FROM (SELECT rk.*, gm.c, gm.p, NOT list_contains(gm.c, rk.cluster) AND NOT list_contains(gm.p, rk.published) AS ok FROM gm JOIN rk ON rk.job_id = gm.job_id AND rk.i = gm.i + 1))
 SELECT job_id, cluster, published, round(sec, 3) AS sec FROM rk JOIN (SELECT job_id, i FROM gm WHERE ok) USING (job_id, i)"""

# DuckDB's edit distance counts bytes, so letters beyond ASCII are given single bytes first.
_LETTERS = "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜßàáâäçèéêëíîïñóôöùúûüœ"
_BYTES = "".join(chr(c) for c in [*range(1, 9), *range(11, 32), 127, *map(ord, "~^`|{}[]\\@$#*+=<>")])[: len(_LETTERS)]


def _single_bytes(text: str) -> str:
    return f"translate({text}, '{_LETTERS}', {' || '.join(f'chr({ord(c)})' for c in _BYTES)})"


SQL["i9_suggest_terms"] = f"""WITH {X.SEGMENTS}, tm AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda w: length(w) >= 6)) AS term FROM benchmark),
 rn AS (SELECT job_id, segment_id, "start", "end", unnest(r) AS run, unnest(range(1, len(r) + 1)) AS pos FROM (SELECT *, regexp_extract_all(text, '\\p{{L}}+|\\P{{L}}+') AS r FROM segments)),
 wd AS (SELECT *, lower(run) AS found, sum(length(run)) OVER (PARTITION BY job_id, segment_id ORDER BY pos) AS "to" FROM rn),
 m AS (SELECT found, term, round(1 - levenshtein({_single_bytes('found')}, {_single_bytes('term')}) / greatest(length(found), length(term)), 6) AS conf FROM (SELECT DISTINCT found FROM wd WHERE length(found) >= 6 AND regexp_matches(found, '^\\p{{L}}')), tm),
 b AS (SELECT found, arg_min(term, (-conf, term)) AS suggested, max(conf) AS confidence FROM m GROUP BY found) SELECT job_id, segment_id, "to" - length(run) AS "from", "to", found, suggested, confidence, "start", "end" FROM wd JOIN b USING (found) WHERE confidence >= 0.6 AND confidence < 1"""
#: both sides in stretches between common pauses: what neither of them covers for 0.2 seconds
_ISLANDS = f"""{X.HYPOTHESIS}, bs AS (SELECT job_id, 0 AS side, ord, "start", "end", text FROM segments UNION ALL SELECT job_id, 1, ord, "start", "end", CASE WHEN ord % 7 = 3 THEN text || ' indeed so' WHEN ord % 7 = 5 THEN replace(text, 'e', '') ELSE text END FROM hypothesis),
 rc AS (SELECT *, max("end") OVER (PARTITION BY job_id ORDER BY "start", "end", side, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bs), il AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY "start", "end", side, ord) AS island FROM rc)"""
SQL["j10_cer"] = f"""WITH {_ISLANDS}, p AS (SELECT job_id, island, coalesce(string_agg(text, ' ' ORDER BY "start", ord) FILTER (side = 0), '') AS text, coalesce(string_agg(text, ' ' ORDER BY "start", ord) FILTER (side = 1), '') AS h FROM il GROUP BY ALL),
 e AS (SELECT job_id, sum(length(text))::BIGINT AS chars, sum(levenshtein({_single_bytes('text')}, {_single_bytes('h')}))::BIGINT AS edits FROM p GROUP BY job_id) SELECT job_id, chars, edits, round(CASE WHEN chars > 0 THEN edits / chars WHEN edits > 0 THEN 1 ELSE 0 END, 6) AS cer FROM e"""


def _same(src: str, gap: float, p: str) -> str:
    """``{p}(job_id, ord, speaker, start, end)``: neighbours of one speaker not more than ``gap`` apart made one."""
    return f"""{p}0 AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY job_id ORDER BY "start", ord) IS NOT DISTINCT FROM speaker THEN 0 ELSE 1 END AS turned FROM {src}),
 {p}1 AS (SELECT *, sum(turned) OVER (PARTITION BY job_id ORDER BY "start", ord) AS run FROM {p}0), {p}2 AS (SELECT *, max("end") OVER (PARTITION BY job_id, run ORDER BY "start", ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {p}1),
 {p}3 AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, run ORDER BY "start", ord) AS island FROM {p}2),
 {p} AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY run, island) - 1 AS ord, speaker, min("start") AS "start", max("end") AS "end" FROM {p}3 GROUP BY job_id, run, island, speaker)"""


def _absorb(src: str, least: float, p: str) -> str:
    """``{p}(job_id, ord, speaker, start, end)``: one pass from the left; the state is the last turn made and bounds that wait."""
    return f"""{p}i AS (SELECT *, row_number() OVER w AS i, lead("start") OVER w AS ns, lead(speaker) OVER w AS nsp, count(*) OVER (PARTITION BY job_id) AS m FROM {src} WINDOW w AS (PARTITION BY job_id ORDER BY "start", ord)),
 {p}r AS (SELECT DISTINCT job_id, 0::BIGINT AS i, 0::BIGINT AS n, NULL::DOUBLE AS ls, NULL::DOUBLE AS le, NULL::VARCHAR AS sp, NULL::DOUBLE AS ps, NULL::DOUBLE AS pe FROM {p}i
 UNION ALL SELECT job_id, i, CASE a WHEN 1 THEN n + 1 ELSE n END, CASE a WHEN 1 THEN cs WHEN 2 THEN least(ls, cs) ELSE ls END, CASE a WHEN 1 THEN ce WHEN 2 THEN greatest(le, ce) ELSE le END, CASE a WHEN 1 THEN speaker ELSE sp END, CASE a WHEN 3 THEN cs END, CASE a WHEN 3 THEN ce END
 FROM (SELECT *, CASE WHEN ce - cs >= {least} OR m = 1 OR (n = 0 AND i = m) THEN 1 WHEN n > 0 AND (i = m OR cs - le < ns - ce OR (cs - le = ns - ce AND (sp = speaker OR nsp <> speaker))) THEN 2 ELSE 3 END AS a
 FROM (SELECT t.job_id, t.i, t.m, t.ns, t.nsp, t.speaker, r.n, r.ls, r.le, r.sp, least(t."start", r.ps) AS cs, greatest(t."end", r.pe) AS ce FROM {p}r r JOIN {p}i t ON t.job_id = r.job_id AND t.i = r.i + 1))),
 {p} AS (SELECT job_id, n - 1 AS ord, arg_max(sp, i) AS speaker, arg_max(ls, i) AS "start", arg_max(le, i) AS "end" FROM {p}r WHERE n > 0 GROUP BY job_id, n)"""


def _turns(src: str, least: float) -> str:
    return f"""{_same(src, 0.3, 'ta')}, {_absorb('ta', least, 'tb')}, {_same('tb', 0.3, 'tc')}, td AS (SELECT job_id, ord, speaker, max("start") OVER (PARTITION BY job_id ORDER BY ord) AS s, "end" AS e FROM tc),
 tt AS (SELECT job_id, ord, speaker, round(s, 3) AS "start", round(greatest(round(s, 3) + 0.001, e), 3) AS "end", printf('t%04d', ord + 1) AS turn_id FROM td)"""


SQL["c11_absorb_short_turns"] = f"WITH RECURSIVE {X.SEGMENTS}, {_same('segments', 0.3, 'ta')}, {_absorb('ta', 10.0, 'tb')} SELECT * FROM tb"
SQL["c12_merge_turns"] = f"WITH RECURSIVE {X.SEGMENTS}, {_turns('segments', 10.0)} SELECT * FROM tt"
SQL["e11_turns_from_windows"] = f"""WITH RECURSIVE {X.VECTORS}, vs AS (SELECT job_id, ord, 'L' || label AS speaker, "start", "end" FROM vectors), {_turns('vs', 1.0)}, nx AS (SELECT *, lead("start") OVER (PARTITION BY job_id ORDER BY "start", ord) AS nx FROM tt),
 fs AS (SELECT job_id, speaker, dense_rank() OVER (PARTITION BY job_id ORDER BY min(ord)) - 1 AS k FROM tt GROUP BY job_id, speaker) SELECT job_id, ord, turn_id, printf('SPEAKER_%02d', k) AS speaker, "start", CASE WHEN nx < "end" AND nx > "start" THEN nx ELSE "end" END AS "end" FROM nx JOIN fs USING (job_id, speaker)"""


def _alike(src: str, threshold: float, cap: float, most: int) -> str:
    """``al(job_id, unit, c)`` of ``src(job_id, unit, start, end, words, x)``: the state is the chapter's start, weight and mean vector."""
    return f"""ai AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY unit) AS i FROM {src}), al AS (SELECT job_id, i, unit, 0::BIGINT AS c, "start" AS s, greatest(words, 1)::BIGINT AS w, 1::BIGINT AS k, x AS v FROM ai WHERE i = 1
 UNION ALL SELECT job_id, i, unit, CASE WHEN ok THEN c ELSE c + 1 END, CASE WHEN ok THEN s ELSE "start" END, CASE WHEN ok THEN w + g ELSE g END, CASE WHEN ok THEN k + 1 ELSE 1 END, CASE WHEN ok THEN list_transform(mix, lambda p: p / CASE WHEN len > 0 THEN len ELSE 1 END) ELSE x END
 FROM (SELECT *, sqrt(list_sum(list_transform(mix, lambda p: p * p))) AS len FROM (SELECT *, list_transform(list_zip(v, x), lambda p: (p[1] * w + p[2] * g) / (w + g)) AS mix FROM (SELECT a.job_id, a.i, a.unit, a."start", a.x, greatest(a.words, 1)::BIGINT AS g, l.c, l.s, l.w, l.k, l.v, coalesce(list_cosine_similarity(l.v, a.x), 0) >= {threshold} AND a."end" - l.s <= {cap} AND l.k < {most} AS ok FROM al l JOIN ai a ON a.job_id = l.job_id AND a.i = l.i + 1))))"""


_VEC = "(SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)"
SQL["f3_merge_similar_units"] = f"""WITH RECURSIVE {_PACK}, un AS (SELECT job_id, unit::BIGINT AS unit, min(pc.s) AS "start", max(pc.e) AS "end", sum(pc.w) AS words FROM pk JOIN pc USING (job_id, piece) GROUP BY ALL HAVING sum(pc.w) > 0),
 uv AS (SELECT un.*, x FROM un JOIN {_VEC} ON vec_id = (job_id * 7 + unit) % (SELECT count(*) FROM embeddings)), {_alike('uv', 0.1, 180.0, 1_000_000)} SELECT job_id, unit, c AS chapter FROM al"""
SQL["f12_merge_by_title_vectors"] = f"""WITH RECURSIVE {X.CHAPTERS}, uv AS (SELECT job_id, ord AS unit, "start", "end", 1 AS words, x FROM chapters JOIN {_VEC} ON vec_id = (job_id * 7 + ord) % (SELECT count(*) FROM embeddings)), {_alike('uv', 0.0, 180.0, 8)} SELECT job_id, unit AS ord, c AS parent FROM al"""

SQL["f11_late_chunk_boundaries"] = f"""WITH RECURSIVE {X.SEGMENTS}, lw AS (SELECT job_id, ord, "start", "end", unnest(range(greatest(floor(("start" - 20) / 15) + 1, 0)::BIGINT, floor("start" / 15)::BIGINT + 1)) AS win FROM segments),
 lv AS (SELECT lw.*, x FROM lw JOIN {_VEC} ON vec_id = (job_id * 7 + ord * 3 + win) % (SELECT count(*) FROM embeddings)), ls AS (SELECT *, CASE WHEN lag(ord) OVER w IS NOT NULL THEN list_cosine_similarity(x, lag(x) OVER w) END AS sim FROM lv WINDOW w AS (PARTITION BY job_id, win ORDER BY ord)),
 le AS (SELECT job_id, ord, min("start") AS "start", max("end") AS "end", round(avg(sim), 9) AS sim FROM ls GROUP BY job_id, ord), lo AS (SELECT *, coalesce(sim < coalesce(lag(sim) OVER w, 2) AND sim <= coalesce(lead(sim) OVER w, 2), false) AS low, row_number() OVER w AS i FROM le WINDOW w AS (PARTITION BY job_id ORDER BY ord)),
 lc AS (SELECT job_id, i, ord, 0::BIGINT AS c, "start" AS s FROM lo WHERE i = 1 UNION ALL SELECT job_id, i, ord, CASE WHEN opens THEN c + 1 ELSE c END, CASE WHEN opens THEN "start" ELSE s END FROM (SELECT lo.*, lc.c, lc.s, (lo.low AND lo."start" - lc.s >= 4) OR lo."end" - lc.s > 15 AS opens FROM lc JOIN lo ON lo.job_id = lc.job_id AND lo.i = lc.i + 1))
 SELECT job_id, ord, c AS chapter FROM lc"""
