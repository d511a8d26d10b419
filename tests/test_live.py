"""Streams of chapters and galleries against their batch counterparts."""

import numpy as np
from pyspark.sql import functions as F

from meetspark.operators import chapters
from meetspark.streaming import live


def run(spark, tmp_path, name, batches, ddl, build):
    """All rows of a stream that reads one file for each batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streamed_chapters_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(job, u, 10.0 * u, 10.0 * u + 9, int(rng.integers(0, 30)), rng.normal(size=3).tolist(), u == 19) for job in range(3) for u in range(20)]
    ddl = "job_id long, unit long, start double, end double, words long, vector array<double>, last boolean"
    got = run(spark, tmp_path, "live_chapters", [[r for r in rows if r[1] < 7], [r for r in rows if 7 <= r[1]]], ddl, lambda s: live.stream_chapters(s, 0.0, 60.0))
    df = spark.createDataFrame(rows, ddl)
    batch = chapters.merge_similar_units(df, 0.0, 60.0).join(df.drop("vector"), ["job_id", "unit"]).groupBy("job_id", "chapter").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_units"))
    order = lambda rows: sorted((r.job_id, r.chapter, r.start, r.end, r.n_units) for r in rows)
    assert order(got) == order(batch.collect())


def test_streamed_gallery_keeps_its_speakers_over_batches(spark, tmp_path):
    e = np.eye(5)
    first = [(1, i, (e[i % 2] + 0.05 * e[4]).tolist(), False) for i in range(6)] + [(2, 0, e[3].tolist(), True)]
    later = [(1, 6, e[1].tolist(), False), (1, 7, e[2].tolist(), False), (1, 8, e[0].tolist(), True)]
    got = run(spark, tmp_path, "live_gallery", [first, later], "job_id long, ord long, embedding array<double>, last boolean", lambda s: live.stream_gallery(s, 0.5))
    assert {(r.job_id, r.ord): r.speaker for r in got} == {(1, i): f"SPEAKER_0{i % 2}" for i in range(6)} | {(2, 0): "SPEAKER_00", (1, 6): "SPEAKER_01", (1, 7): "SPEAKER_02", (1, 8): "SPEAKER_00"}
