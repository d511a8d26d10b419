"""Scans of sorted rows against plain loops, cut plans against hand-made cases and a loop, and a long job."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetspark.operators import chapters as C
from meetspark.operators import intervals as V
from meetspark.operators import planning as D
from meetspark.operators.scan import sorted_scan

PAUSE = "job_id string, start double, end double, duration double"


def loop_cuts(pauses, duration, n, least, most, half):
    """The rule for cuts, written from its description: bounds, then the near pauses, the longest, the moved ideal place."""
    cuts, used = [], set()
    for i in range(1, n):
        ideal = duration * i / n
        low = cuts[-1] + least if cuts else least
        high = min(duration - least * (n - i), max((cuts[-1] if cuts else 0) + most, low))
        room = [p for p in pauses if low <= (p[0] + p[1]) / 2 <= high]
        mid = lambda p: (p[0] + p[1]) / 2
        near = [p for p in room if abs(mid(p) - ideal) <= half and mid(p) not in used]
        if near:
            best = mid(max(near, key=lambda p: (p[1] - p[0] - 0.15 * abs(mid(p) - ideal), -mid(p))))
        elif room:
            best = mid(max(room, key=lambda p: (p[1] - p[0], -abs(mid(p) - ideal), -mid(p))))
        elif low > high + 1e-6:
            best = max(low, min(max(ideal, least), duration - least, duration - 1e-3))
        else:
            best = min(max(ideal, low), high)
        if room:
            used.add(best)
        cuts.append(round(best, 3))
    return cuts


def test_cuts_equal_a_loop_and_keep_their_bounds(spark):
    rng = random.Random(3)
    plans, rows, want = [], [], {}
    for j in range(60):
        n = rng.randint(2, 9)
        duration = n * rng.choice([200.0, 320.0, 900.0, 1200.0])
        marks = sorted(rng.sample(range(1, int(duration) * 2), 2 * rng.choice([0, 1, 3, 12, 60])))
        pauses = [(a / 2, b / 2) for a, b in zip(marks[::2], marks[1::2], strict=True)]
        plans.append((f"j{j}", duration, n))
        rows += [(f"j{j}", a, b, b - a) for a, b in pauses]
        want[f"j{j}"] = loop_cuts(pauses, duration, n, 300.0, 900.0, 120.0)
    got = {}
    for r in D.choose_cuts(spark.createDataFrame(plans, "job_id string, duration double, n_parts int"), spark.createDataFrame(rows, PAUSE).repartition(3)).orderBy("job_id", "ord").collect():
        got.setdefault(r.job_id, []).append(r.at)
    assert got.keys() == want.keys()
    for j, cuts in want.items():
        assert got[j] == pytest.approx(cuts, abs=2e-3), j
    for j, duration, n in plans:
        if duration >= 300 * n:  # there is room: no part is below the bound
            edges = [0.0, *got[j], duration]
            assert min(b - a for a, b in zip(edges, edges[1:], strict=False)) >= 300 - 1e-3


def plan(spark, duration, regions, least, most, target, half=90.0):
    d = spark.createDataFrame([("j", duration)], "job_id string, duration double")
    r = spark.createDataFrame([("j", i, a, b) for i, (a, b) in enumerate(regions)], "job_id string, ord long, start double, end double")
    cuts, parts, metrics = D.cut_plan(d, r, least, most, target, 0.8, half)
    return cuts.orderBy("ord").collect(), parts.orderBy("ord").collect(), metrics.collect()[0]


def test_cut_plans_of_known_recordings(spark):
    # a pause near the ideal place wins, its middle is the cut
    cuts, parts, m = plan(spark, 810.0, [(0.0, 250.0), (268.0, 520.0), (540.0, 810.0)], 180.0, 300.0, 270.0)
    assert m.requested_n_parts == m.n_parts == 3 and cuts[0].at == 259.0 and m.all_in_range
    assert [c.pause for c in cuts] == [18.0, 20.0] and [p.duration for p in m.top_pauses] == [20.0, 18.0]
    # speech without a pause is cut at the ideal places
    cuts, parts, m = plan(spark, 810.0, [(0.0, 810.0)], 180.0, 300.0, 270.0)
    assert [(c.at, c.pause) for c in cuts] == [(270.0, 0.0), (540.0, 0.0)] and m.all_in_range and m.n_pauses == 0
    # barely over three times the longest part: three parts, no crumb
    cuts, parts, m = plan(spark, 900.052, [(0.5, 899.552)], 240.0, 360.0, 300.0)
    assert m.n_parts == 3 and all(240 <= p.end - p.start <= 360 + 1e-6 for p in parts)
    # too short to be cut
    cuts, parts, m = plan(spark, 300.0, [(0.0, 300.0)], 240.0, 360.0, 300.0)
    assert cuts == [] and [(p.part_id, p.start, p.end) for p in parts] == [("part01", 0.0, 300.0)] and m.requested_n_parts == 1


def test_short_parts_go_to_the_next_or_the_last_to_the_one_before(spark):
    rng = random.Random(8)
    cases = {"a": [0.0, 0.052, 300.052, 600.052, 900.052], "b": [0.0, 1.0], "c": [0.0, 1.0, 2.0, 3.0], "d": [0.0, 300.0, 301.0]} | {f"r{i}": [0.0, *sorted(rng.sample(range(1, 4000), rng.randint(1, 30)))] for i in range(20)}
    rows = [(j, float(a), float(b)) for j, e in cases.items() for a, b in zip(e, e[1:], strict=False)]
    got = {}
    for r in D.coalesce_short_parts(spark.createDataFrame(rows, "job_id string, start double, end double"), 240.0).orderBy("job_id", "ord").collect():
        got.setdefault(r.job_id, []).append((r.start, r.end))
    for j, e in cases.items():
        work = [(float(a), float(b)) for a, b in zip(e, e[1:], strict=False)]
        while len(work) > 1 and (short := [i for i, (a, b) in enumerate(work) if b - a < 240.0]):
            i = min(short[0], len(work) - 2)
            work[i : i + 2] = [(work[i][0], work[i + 1][1])]
        assert got[j] == work, j


def test_merged_units_keep_a_unit_vector(spark):
    # five long units of one direction, then units that lean away: without a new norm the mean of opposite parts would shrink
    vec = lambda a: [float(np.cos(a)), float(np.sin(a))]
    angles, words = [0.0, 1.0, 1.9, 0.2, 1.2, 2.4], [1, 100, 1, 1, 50, 3]
    rows = [("j", i, float(i), float(i + 1), w, vec(a)) for i, (a, w) in enumerate(zip(angles, words, strict=True))]
    rows += [("z", 0, 0.0, 1.0, 5, [0.0, 0.0]), ("z", 1, 1.0, 2.0, 5, [0.0, 0.0]), ("z", 2, 2.0, 3.0, 0, None)]
    got = {(r.job_id, r.unit): r.chapter for r in C.merge_similar_units(spark.createDataFrame(rows, "job_id string, unit long, start double, end double, words long, vector array<double>"), 0.5, 100.0).collect()}
    chapter, want, held, weight = -1, {}, None, 0
    for i, (a, w) in enumerate(zip(angles, words, strict=True)):
        v = np.array(vec(a))
        if held is not None and held @ v / np.linalg.norm(held) >= 0.5:
            held, weight = (held * weight + v * w) / (weight + w), weight + w
            held = held / np.linalg.norm(held)
        else:
            chapter, held, weight = chapter + 1, v, w
        want["j", i] = chapter
    assert got == want | {("z", 0): 0, ("z", 1): 1, ("z", 2): 2}


def test_scan_of_many_jobs_over_batches(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("job_id"), "id")

    def scan(group):
        total = 0
        for (i,) in group:
            total += i
            yield i, total

    got = sorted_scan(rows, ["id"], scan, {"id": "long", "total": "long"})
    assert got.schema.simpleString() == "struct<job_id:bigint,id:bigint,total:bigint>"
    ends = {r.job_id: (r.n, r.total) for r in got.groupBy("job_id").agg(F.count("*").alias("n"), F.max("total").alias("total")).collect()}
    assert ends == {(k or None): (len(range(k, 60_000, 7)), sum(range(k, 60_000, 7))) for k in range(7)}
    stop = sorted_scan(rows, ["id"], lambda g: [next(g)], {"id": "long"})  # a scan may stop early
    assert sorted(r.id for r in stop.collect()) == list(range(7))


def test_long_jobs_take_linear_time(spark):
    took = {}
    for n in (20_000, 200_000):
        s = spark.range(n).select(F.lit("j").alias("job_id"), F.col("id").alias("ord"), F.concat(F.lit("s"), F.col("id")).alias("segment_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("speaker"), F.lit("one two three").alias("text"), (F.col("id") * 1.5).alias("start"), (F.col("id") * 1.5 + F.when(F.col("id") % 5 == 0, 0.4).otherwise(1.2)).alias("end"))
        began = time.time()
        assert C.pack_pieces(s).agg(F.count("*"), F.max("unit")).first()[0] == n
        assert V.absorb_short_turns(s).count() > n / 2
        took[n] = time.time() - began
    assert took[200_000] < 10 * took[20_000] + 20


def test_running_values_equal_plain_windows(spark):
    from pyspark.sql import Window

    from meetspark.operators.running import running

    rng = random.Random(6)
    rows = [(f"j{rng.randint(0, 3)}" if rng.random() > 0.1 else None, rng.choice([0.0, 9.99, 10.0, 10.01, 20.0, rng.uniform(-30, 300)]), i, rng.choice([None, rng.uniform(0, 400)])) for i in range(900)]
    df = spark.createDataFrame(rows, "job_id string, start double, ord long, x double")
    w = Window.partitionBy("job_id").orderBy("start", "ord")
    before, so_far, x = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0), F.col("x")
    want = df.select("job_id", "ord", F.max(x).over(before).alias("a"), F.coalesce(F.sum("ord").over(so_far), F.lit(0)).alias("b"), F.lag(x).over(w).alias("c"), F.last(x, True).over(so_far).alias("d"), F.lead(x).over(w).alias("e"))
    got = running(df, ["start", "ord"], {"a": ("max_before", x), "b": ("sum", F.col("ord")), "c": ("last_before", x), "d": ("last_known", x), "e": ("next", x)}, width=10.0)
    key = lambda r: r.ord
    named = [r for r in sorted(got.filter("job_id IS NOT NULL").select(*want.columns).collect(), key=key)]
    assert named == [r for r in sorted(want.filter("job_id IS NOT NULL").collect(), key=key)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "partitionBy" not in plan and "SinglePartition" not in plan


def test_interval_operators_of_long_jobs_equal_loops(spark):
    rng = random.Random(9)
    rows, frames = [], []
    for j in ("a", "b"):
        for i in range(400):
            s = round(rng.uniform(0, 9000), 3)
            rows.append((j, i, s, round(s + rng.choice([0.0, 1.0, 5.0, 40.0, 2500.0 if rng.random() < 0.01 else 2.0]), 3)))
    df = spark.createDataFrame(rows, "job_id string, ord long, start double, end double")
    unions = {}
    for j, _, s, e in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        u = unions.setdefault(j, [])
        if e > s:
            if u and s <= u[-1][1]:
                u[-1][1] = max(u[-1][1], e)
            else:
                u.append([s, e])
    got = {}
    for r in V.interval_union(df).orderBy("job_id", "ord").collect():
        got.setdefault(r.job_id, []).append([r.start, r.end])
    assert got == unions
    assert {r.job_id: r.covered_sec for r in V.covered_sec(df).collect()} == {j: pytest.approx(sum(e - s for s, e in u), abs=2e-3) for j, u in unions.items()}
    ends = spark.createDataFrame([("a", 12_000.0), ("b", 100.0), ("c", 5.0), ("d", None)], "job_id string, duration double")
    holes = {}
    for r in V.find_holes(df, ends).orderBy("job_id", "start").collect():
        holes.setdefault(r.job_id, []).append((r.start, r.end))
    want = {}
    for j, end in (("a", 12_000.0), ("b", 100.0), ("c", 5.0)):
        edges = [[0.0, 0.0], *unions.get(j, []), [end, end]]
        found = [(round(a[1], 3), round(b[0], 3)) for a, b in zip(edges, edges[1:], strict=False) if b[0] - a[1] >= 0.5]
        want[j] = found
    assert holes == {j: f for j, f in want.items() if f}


def test_continuous_parts_equal_the_whole_job(spark):
    rng = random.Random(21)
    rows, t = [], 0.0
    for i in range(60):
        t = round(t + rng.choice([0.0, 0.5, 3.0]), 3)
        rows.append(("j", i, f"s{i + 1:04d}", rng.choice("ab"), rng.choice(["", "one two three", "four " * rng.randint(1, 40)]), t, round(t + rng.choice([0.5, 4.0, 12.0]), 3)))
        t = rows[-1][6]
    kind = "job_id string, ord long, segment_id string, speaker string, text string, start double, end double"
    whole = spark.createDataFrame(rows, kind)
    n = C.units(C.pack_pieces(whole)).select("unit").collect()
    vectors = spark.createDataFrame([("j", r.unit, [rng.gauss(0, 1) for _ in range(3)]) for r in n], "job_id string, unit long, vector array<double>")
    edges = [0, 7, 8, 25, 41, 60]
    parts, local = [], []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        name = f"part{10 - k}"  # names do not follow time: starts do
        parts.append(("j", name, rows[a][5]))
        local += [("j", name, i, f"p{i}", r[3], r[4], round(r[5] - rows[a][5], 3), round(r[6] - rows[a][5], 3)) for i, r in enumerate(rows[a:b])]
    kind = "job_id string, part_id string, ord long, segment_id string, speaker string, text string, start double, end double"
    split = spark.createDataFrame(local, kind)
    merged, chapters = D.merge_parts_continuous(spark.createDataFrame(parts, "job_id string, part_id string, start double"), split, vectors, threshold=0.0, least=9.0)
    assert [(r.ord, r.segment_id, r.start, r.end, r.text) for r in merged.orderBy("ord").collect()] == [(i + 1, r[2], r[5], r[6], r[4]) for i, r in enumerate(rows)]
    want = C.build_chapters(whole, vectors, threshold=0.0, least=9.0)
    assert [tuple(r) for r in chapters.orderBy("ord").collect()] == [tuple(r) for r in want.orderBy("ord").collect()]
    # some chapter goes over an edge, which merging part by part could not give
    assert any(len({next(k for k, b in enumerate(edges[1:]) if int(s[1:]) - 1 < b) for s in r.source_ids}) > 1 for r in chapters.collect())
    assert tuple(D.merge_blocks(merged, split).first())[1:] == (60, 60, True, True)
    assert tuple(D.merge_blocks(merged.filter("ord <> 9"), split).first())[1:] == (59, 60, False, True)
