"""Operators against small hand-made cases and plain Python folds."""

import random

import pytest

from meetspark.functions import text as T
from meetspark.operators import chapters, clustering, intervals, planning
from meetspark.sources import artifacts
from pyspark.sql import functions as F

TURN = "job_id long, ord long, speaker string, start double, end double"


def turns(spark, rows):
    return spark.createDataFrame([(j, i, s, a, b) for i, (j, s, a, b) in enumerate(rows)], TURN)


def test_merge_regions_uses_the_furthest_end(spark):
    df = turns(spark, [(1, "a", 0.0, 10.0), (1, "a", 1.0, 2.0), (1, "a", 10.25, 11.0), (1, "a", 20.0, 20.1)])
    assert [(r.start, r.end) for r in intervals.merge_regions(df, 0.25, 0.5).collect()] == [(0.0, 11.0)]
    assert intervals.merge_regions(df.limit(0)).count() == 0


def test_holes_lead_inside_and_trail(spark):
    df = turns(spark, [(1, "a", 1.0, 2.0), (1, "a", 2.25, 4.0)])
    d = spark.createDataFrame([(1, 6.0), (2, 3.0)], "job_id long, duration double")
    assert sorted((r.job_id, r.start, r.end) for r in intervals.find_holes(df, d).collect()) == [(1, 0.0, 1.0), (1, 4.0, 6.0), (2, 0.0, 3.0)]


def test_iou_without_common_seconds_is_zero(spark):
    a, b = turns(spark, [(1, "a", 0.0, 1.0)]), turns(spark, [(1, "a", 1.0, 2.0)])
    assert intervals.speech_iou(a, b).first().iou == 0.0
    assert intervals.speech_iou(a, a).first().iou == 1.0


def absorb(ts, least):
    """The mutable loop."""
    ts, i = [list(t) for t in ts], 0
    while i < len(ts) and len(ts) > 1:
        s, e, p = ts[i]
        if e - s >= least:
            i += 1
            continue
        left = s - ts[i - 1][1] if i else None
        right = ts[i + 1][0] - e if i + 1 < len(ts) else None
        if right is None or left is not None and (left < right or left == right and (ts[i - 1][2] == p or ts[i + 1][2] != p)):
            ts[i - 1][0], ts[i - 1][1] = min(ts[i - 1][0], s), max(ts[i - 1][1], e)
            del ts[i]
        else:
            ts[i + 1][0], ts[i + 1][1] = min(s, ts[i + 1][0]), max(e, ts[i + 1][1])
            del ts[i]
    return [tuple(t) for t in ts]


def test_absorb_short_turns_equals_the_loop(spark):
    rng, rows, want = random.Random(3), [], {}
    for job in range(60):
        t, mine = 0, []
        for _ in range(rng.randint(1, 9)):
            t += rng.choice([0, 250, 500])
            d = rng.choice([250, 500, 750, 1000, 2000])
            mine.append((t / 1000, (t + d) / 1000, rng.choice("ab")))
            t += d
        rows += [(job, p, s, e) for s, e, p in mine]
        want[job] = absorb(mine, 1.0)
    got = {}
    for r in intervals.absorb_short_turns(turns(spark, rows), 1.0).orderBy("job_id", "ord").collect():
        got.setdefault(r.job_id, []).append((r.start, r.end, r.speaker))
    assert got == want


def test_hysteresis_keeps_between_thresholds_and_resets_silence(spark):
    probs = [0.1, 0.6, 0.4, 0.2, 0.4, 0.2, 0.2, 0.1, 0.7, 0.7]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(probs)], "job_id long, frame_idx long, prob double")
    assert [(r.start, r.end) for r in intervals.hysteresis_regions(df).orderBy("ord").collect()] == [(0.1, 0.5), (0.8, 1.0)]


def test_average_linkage_and_micro_speakers(spark):
    import numpy as np

    v = np.array([[1, 0], [0.99, 0.01], [0, 1], [0.01, 0.99]], dtype=float)
    assert clustering.average_linkage(v, 0.5).tolist() == [0, 0, 1, 1]
    assert clustering.average_linkage(np.zeros((0, 2)), 0.5).tolist() == []
    df = spark.createDataFrame([(1, "a", 9.0, [1.0, 0.0]), (1, "b", 1.0, [0.9, 0.1]), (1, "c", 8.0, [0.0, 1.0])], "job_id long, speaker string, sec double, centroid array<double>")
    assert {r.speaker: r.target for r in clustering.absorb_micro_speakers(df).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_greedy_remap_is_one_to_one(spark):
    df = spark.createDataFrame([(1, "x", "p", 5.0), (1, "y", "p", 9.0), (1, "x", "q", 1.0), (1, "y", "q", 8.0)], "job_id long, cluster string, published string, sec double")
    assert sorted((r.cluster, r.published) for r in clustering.greedy_remap(df).collect()) == [("x", "q"), ("y", "p")]


def test_pack_pieces_breaks_on_words_and_gaps(spark):
    rows = [(1, 0, "s0", "a", "one two", 0.0, 1.0), (1, 1, "s1", "a", "", 1.0, 2.0), (1, 2, "s2", "a", "three", 9.0, 10.0), (1, 3, "s3", "b", "four", 13.0, 14.0), (1, 4, "s4", "b", "five six seven", 14.5, 15.0)]
    df = spark.createDataFrame(rows, "job_id long, ord long, segment_id string, speaker string, text string, start double, end double")
    assert [r.unit for r in chapters.pack_pieces(df, 2.0, 3).orderBy("ord").collect()] == [0, 0, 0, 1, 2]


def test_parts(spark):
    d = spark.createDataFrame([(1, 100.0), (2, 1300.0)], "job_id long, duration double")
    assert {r.job_id: r.n_parts for r in planning.propose_n_parts(d).collect()} == {1: 1, 2: 2}
    p = spark.createDataFrame([(1, 0.0, 50.0), (1, 50.0, 60.0), (1, 60.0, 100.0), (1, 100.0, 101.0)], "job_id long, start double, end double")
    assert [(r.start, r.end) for r in planning.coalesce_short_parts(p, 30.0).orderBy("ord").collect()] == [(0.0, 50.0), (50.0, 101.0)]


@pytest.mark.parametrize("ip,want", [("127.0.0.1", True), ("::1", True), ("::ffff:127.0.0.9", True), ("[::1]:80", True), ("localhost:99", True), ("128.0.0.1", False), (None, False)])
def test_loopback(spark, ip, want):
    assert spark.createDataFrame([(ip,)], "ip string").select(T.is_loopback(F.col("ip"))).first()[0] is want


def test_text_functions_of_null(spark):
    df = spark.createDataFrame([(None,), ("  A\n b  ",)], "t string")
    assert [tuple(r) for r in df.select(T.word_count(F.col("t")), T.is_blank(F.col("t")), T.clean_title(F.col("t"))).collect()] == [(0, True, ""), (2, False, "A b")]


def test_artifacts_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"schema_version": "1", "job_id": "j", "turns": [{"id": "t1", "start": 0.5, "end": 1.0, "speaker": "x"}, {"id": "t2", "start": 0.25, "end": 0.25, "speaker": "y"}]}')
    (tmp_path / "b.json").write_text("{broken")
    df = artifacts.read_artifacts(spark, str(tmp_path), "turns")
    assert df.count() == 2
    rows = artifacts.explode_artifact(df, "turns")
    assert artifacts.validate_rows(rows).first().errors == ["empty"]
    assert len(artifacts.nest_artifact(rows, "turns").first().turns) == 2
    artifacts.write_artifacts(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_streams_of_one_or_many_batches_agree(spark, tmp_path):
    from meetspark.streaming import live

    kind = "job_id long, ord long, start double, end double, words long, speaker string, last boolean"
    rows = [(1, 0, 0.0, 1.0, 50, "a", False), (1, 1, 1.5, 2.0, 40, "a", False), (1, 2, 9.0, 10.0, 5, "b", False), (1, 3, 10.0, 11.0, 5, "b", True)]
    found = []
    for name, cuts in (("one", [rows]), ("many", [rows[:1], rows[1:3], rows[3:]])):
        for i, part in enumerate(cuts):
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 100 if name == "one" else 1).parquet(str(tmp_path / name))
        q = live.stream_units(source).writeStream.format("memory").queryName(f"units_{name}").option("checkpointLocation", str(tmp_path / f"c{name}")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        found.append(sorted(tuple(r) for r in spark.sql(f"SELECT * FROM units_{name}").collect()))
    assert found[0] == found[1] == [(1, 0, 0.0, 1.0, 50), (1, 1, 1.5, 2.0, 40), (1, 2, 9.0, 11.0, 10)]
