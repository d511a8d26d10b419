"""Streams with event-time timers against loops and batch operators; restarts from the checkpoint."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetspark.operators import chapters, jobs
from meetspark.streaming import live, timers

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def play(spark, tmp_path, name, batches, ddl, build, restart_after=None):
    """All rows that a stream writes; it may be stopped after some batches and started again from its checkpoint."""
    for part in (batches[:restart_after], batches[restart_after:]) if restart_after else (batches,):
        for rows in part:
            n = len(list((tmp_path / "in").glob("b=*"))) if (tmp_path / "in").exists() else 0
            spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={n:03d}"))
        source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        q = build(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out")).collect()


@pytest.mark.parametrize("restart", [None, 2])
def test_stalled_jobs_fail_when_event_time_runs_out(spark, tmp_path, restart):
    rows = [
        [("a", at(0), "running"), ("b", at(1), "running"), ("c", at(2), "running")],
        [("a", at(20), "running"), ("c", at(10), "done"), ("b", at(0), "running")],  # b's row is older than what is known
        [("a", at(45), "running"), ("d", at(46), "running")],
        [("a", at(70), "done"), ("e", at(80), "running")],
        [("e", at(200), "done")],
    ]
    got = play(spark, tmp_path, "stalled", rows, "job_id string, ts timestamp, status string", lambda s: timers.stream_stalled(s, "30 minutes", "5 minutes"), restart)
    failed = {(r.job_id, r.stage, r.status, r.ts) for r in got}
    assert failed == {(j, "worker", "failed", t) for j, t in (("b", at(31)), ("d", at(76)))}  # e ends in the batch that moves time past it


def test_expired_jobs_and_moved_times(spark, tmp_path):
    rows = [[("a", at(0), at(30)), ("b", at(0), at(300)), ("n", at(0), None)], [("b", at(5), at(40))], [("c", at(60), at(500))], [("z", at(100), at(900))]]
    got = play(spark, tmp_path, "expired", rows, "job_id string, ts timestamp, expires_at timestamp", lambda s: timers.stream_expired(s, "5 minutes"))
    assert {(r.job_id, r.expires_at) for r in got} == {("a", at(30)), ("b", at(40))}


def test_rate_limit_equals_the_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((rng.choice("xyz"), i, at(rng.randint(0, 4000))) for i in range(240))
    rows.sort(key=lambda r: (r[2], r[1]))
    batches = [rows[i : i + 40] for i in range(0, 240, 40)]
    ddl = "client string, ord long, ts timestamp"
    got = play(spark, tmp_path, "limit", batches, ddl, lambda s: timers.stream_rate_limit(s, 5, "3 hours", "10 minutes"), 3)
    batch = {r.ord: r for r in jobs.rate_limit(spark.createDataFrame(rows, ddl), 5, 3 * 3600).collect()}
    # the batch counts requests of the same moment on both sides, the stream those before
    same = {o for o, r in batch.items() if sum(1 for x in rows if x[0] == r.client and x[2] == next(y[2] for y in rows if y[1] == o)) == 1}
    assert len(got) == 240 and len(same) > 200
    assert all(r.n_before == min(5, batch[r.ord].n_before) and r.exceeded == batch[r.ord].exceeded for r in got if r.ord in same)


@pytest.mark.parametrize("restart", [None, 2])
def test_chapters_in_any_order_equal_the_batch(spark, tmp_path, restart):
    rng = np.random.default_rng(5)
    rows = []
    for job in range(3):
        t = 0.0
        for u in range(30):
            d = float(rng.choice([2.0, 9.0, 20.0]))
            rows.append((job, T0 + dt.timedelta(seconds=t), u, t, t + d, int(rng.integers(0, 30)), rng.normal(size=3).tolist(), u == 29))
            t += d
    ddl = "job_id long, ts timestamp, unit long, start double, end double, words long, vector array<double>, last boolean"
    order = sorted(rows, key=lambda r: r[3] + float(rng.uniform(0, 50)))  # within a minute of their place
    batches = [order[i : i + 20] for i in range(0, len(order), 20)]
    got = play(spark, tmp_path, "chapters", batches, ddl, lambda s: timers.stream_chapters_in_time(s, 0.0, 60.0, 15.0, "2 minutes"), restart)
    df = spark.createDataFrame(rows, ddl)
    merged = chapters.merge_similar_units(df, 0.0, 60.0).join(df.drop("vector"), ["job_id", "unit"]).groupBy("job_id", F.col("chapter").alias("ord")).agg(F.min("start").alias("start"), F.max("end").alias("end"))
    want = sorted((r.job_id, r.ord, r.start, r.end) for r in chapters.absorb_short_units(merged, 15.0).collect())
    assert sorted((r.job_id, r.chapter, r.start, r.end) for r in got) == want
    assert sum(r.n_units for r in got) == len(rows)


def test_rates_sessions_and_latest_stages(spark, tmp_path):
    rows = [("a", at(m), float(m), s) for m, s in ((0, "vad"), (1, "vad"), (2, "asr"), (50, "asr"), (51, "vad"))] + [("b", at(5), 1.0, "vad")]
    ddl = "job_id string, ts timestamp, value double, stage string"
    df = spark.createDataFrame(rows, ddl)
    assert sorted(tuple(r) for r in live.segment_rates(df).collect()) == [("a", at(0), at(10), 3, 3.0), ("a", at(50), at(60), 2, 101.0), ("b", at(0), at(10), 1, 1.0)]
    assert len(live.segment_rates(df, slide="5 minutes").collect()) == 6
    assert sorted((r.job_id, r["from"], r.to, r.n) for r in live.sessions(df).collect()) == [("a", at(0), at(32), 3), ("a", at(50), at(81), 2), ("b", at(5), at(35), 1)]
    sink = live.latest_stage_sink(str(tmp_path / "sink"))
    sink(df.filter("value < 2"), 0)
    sink(df.filter("value >= 2"), 1)
    sink(df.filter("value >= 2"), 1)  # a batch that is written again changes nothing
    got = {(r.job_id, r.stage): (r.ts, r.value) for r in live.read_latest_stage(spark, str(tmp_path / "sink")).collect()}
    assert got == {("a", "vad"): (at(51), 51.0), ("a", "asr"): (at(50), 50.0), ("b", "vad"): (at(5), 1.0)}
