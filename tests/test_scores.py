"""Scores, coverage, merged parts and reports against plain Python and small hand-made cases."""

import itertools
import json
import random

import pytest

from meetspark.operators import evaluate, insights, intervals, planning
from pyspark.errors import PySparkException

TURN = "job_id long, ord long, speaker string, start double, end double"
SEGMENT = TURN + ", text string"


def turns(spark, rows):
    return spark.createDataFrame([(j, i, s, a, b) for i, (j, s, a, b) in enumerate(rows)], TURN)


def frames(rows, n):
    """Speakers in each tenth of a second."""
    return [{s for s, a, b in rows if a <= k < b} for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_der_equals_frames(spark, seed):
    rng = random.Random(seed)
    make = lambda names: [(rng.choice(names), a, a + rng.randrange(5, 300)) for a in (rng.randrange(0, 2000) for _ in range(12))]
    ref, hyp = make("abc"), make("xyzw")
    seconds = lambda rows: turns(spark, [(1, s, a / 10, b / 10) for s, a, b in rows])
    got = evaluate.der(seconds(ref), seconds(hyp), collar=0.0).first()
    r, h = frames(ref, 2400), frames(hyp, 2400)
    shared = {(x, a): sum(x in hh and a in rr for rr, hh in zip(r, h)) for x in "wxyz" for a in "abc"}
    names, used = {}, set()
    for (x, a), n in sorted(shared.items(), key=lambda p: (-p[1], p[0])):
        if n and x not in names and a not in used:
            names[x] = a
            used.add(a)
    miss = sum(max(len(rr) - len(hh), 0) for rr, hh in zip(r, h))
    false = sum(max(len(hh) - len(rr), 0) for rr, hh in zip(r, h))
    confused = sum(min(len(rr), len(hh)) - len(rr & {names.get(x) for x in hh}) for rr, hh in zip(r, h))
    assert (got.ref_sec, got.miss_sec, got.false_sec, got.confused_sec) == pytest.approx([x / 10 for x in (sum(map(len, r)), miss, false, confused)], abs=0.002)


def test_der_collar_and_empty_sides(spark):
    a = turns(spark, [(1, "a", 0.0, 10.0), (1, "b", 10.0, 20.0)])
    b = turns(spark, [(1, "x", 0.2, 10.2), (1, "y", 10.2, 19.8)])
    assert evaluate.der(a, b, collar=0.25).first().der == 0.0
    assert evaluate.der(a, a.limit(0)).first().der == 1.0
    assert evaluate.der(a.limit(0), b).first().der is None
    assert evaluate.der(a.limit(0), b.limit(0)).count() == 0


def test_coverage_of_each_system_outside_the_others(spark):
    rows = [(1, 0, "a", 0.0, 10.0), (1, 1, "a", 5.0, 12.0), (1, 2, "b", 8.0, 20.0), (1, 3, "c", 19.0, 25.0), (1, 4, "c", 30.0, 30.0)]
    df = spark.createDataFrame(rows, "job_id long, ord long, system string, start double, end double")
    got = {(r.system, r.other): (r.only_sec, r.both_sec) for r in intervals.coverage_diff(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == (8.0, 4.0) and got["b", "a"] == (8.0, 4.0) and got["c", "b"] == (5.0, 1.0)
    assert got["b", "*"] == (7.0, 5.0) and got["a", "c"] == (12.0, 0.0) and len(got) == 9
    assert intervals.coverage_diff(df.limit(0), ["a", "b"]).count() == 0


def matched(gold, hyp):
    """Best segment of a free speaker for each gold segment, in order."""
    out = {}
    for _, gs, ga, gb, gt in gold:
        words, choice = set(gt.split()), (0.0, None)
        for _, hs, ha, hb, ht in hyp:
            common, over = len(words & set(ht.split())), min(gb, hb) - max(ga, ha)
            if len(words) < 2 or hs in out or not common or (over <= 0 and abs(ga - ha) > 2):
                continue
            score = round(common / len(words) + (0.5 * over / max(gb - ga, 0.01) if over > 0 else 0), 9)
            choice = max(choice, (score, hs), key=lambda c: c[0])
        if choice[0] >= 0.2 and gs not in out.values():
            out[choice[1]] = gs
    return out


@pytest.mark.parametrize("seed", range(3))
def test_map_speakers_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]

    def make(names):
        at = itertools.accumulate(rng.randrange(1, 4) for _ in range(15))
        return [(i, rng.choice(names), float(t), t + rng.randrange(1, 4) + 0.0, " ".join(rng.choices(words, k=rng.randrange(1, 5)))) for i, t in enumerate(at)]

    gold, hyp = make("abc"), make("xyz")
    table = lambda rows: spark.createDataFrame([(1, *r) for r in rows], SEGMENT)
    got = {r.hyp: r.gold for r in evaluate.map_speakers(table(gold), table(hyp)).collect()}
    assert got == matched(gold, hyp)


def test_glue_of_a_job_without_chapters(spark):
    base = turns(spark, [(1, "", 0.0, 10.0), (1, "", 10.0, 20.0), (2, "", 0.0, 10.0)])
    hyp = turns(spark, [(1, "", 0.0, 11.0), (1, "", 10.0, 14.0)])
    ends = spark.createDataFrame([(1, 12.0), (2, 10.0)], "job_id long, duration double")
    got = {(r.job_id, r.check_id[:2]): r.status for r in evaluate.chapters_glue(hyp, base, ends).collect()}
    assert got == {(1, "C0"): "PASS", (1, "C1"): "PASS", (1, "C2"): "FAIL", (1, "C3"): "FAIL", (1, "C4"): "WARN", (1, "C5"): "PASS", (2, "C0"): "FAIL"}


def test_merged_parts_number_on_and_sources_follow(spark):
    parts = spark.createDataFrame([(1, "part01", 0.0), (1, "part02", 20.0)], "job_id long, part_id string, start double")
    s = spark.createDataFrame([(1, "part01", 0, "s0001", 1.0, 2.0), (1, "part02", 0, "s0001", 0.5, 3.0), (1, "part02", 1, "s0002", 4.0, 5.0)], "job_id long, part_id string, ord long, segment_id string, start double, end double")
    c = spark.createDataFrame([(1, "part01", 0, 1.0, 2.0, ["s0001"]), (1, "part02", 0, 0.5, 5.0, ["s0001", "s0002"])], "job_id long, part_id string, ord long, start double, end double, source_ids array<string>")
    segments, chapters = planning.merge_parts(parts, s, c)
    assert [(r.segment_id, r.start) for r in segments.orderBy("ord").collect()] == [("s0001", 1.0), ("s0002", 20.5), ("s0003", 24.0)]
    assert [(r.chapter_id, r.source_ids) for r in chapters.orderBy("ord").collect()] == [("C00", ["s0001"]), ("C01", ["s0002", "s0003"])]
    assert planning.validate_merge(segments, chapters).first().ok
    assert planning.validate_merge(segments, chapters.limit(1)).first().n_not_once > 0


def test_moments_need_a_source(spark):
    moments = [{"text": "x", "chapter_id": "C00", "segment_id": s} for s in ("s1", "s9", "s1")]
    replies = spark.createDataFrame([(1, json.dumps({"summary": "all", "key_moments": moments})), (2, "no json")], "job_id long, text string")
    sources = spark.createDataFrame([(1, "C00", "s1", 1.0, 2.0, "a")], "job_id long, chapter_id string, segment_id string, start double, end double, speaker string")
    assert [(r.pos, r.start, r.speaker) for r in insights.hydrate_moments(replies, sources).collect()] == [(0, 1.0, "a")]
    with pytest.raises(PySparkException):
        insights.hydrate_moments(replies, sources, strict=True).collect()
