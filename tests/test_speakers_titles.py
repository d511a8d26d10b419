"""Speaker refinement, late chunking, title merging and title choice on small hand-made cases."""

import json

from meetspark.operators import chapters, clustering, insights

WINDOW = "job_id long, ord long, start double, end double, speaker string, embedding array<double>"
X, Y, Z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]


def windows(spark, rows):
    return spark.createDataFrame([(1, i, 2.0 * i, 2.0 * i + 2.0, s, v) for i, (s, v) in enumerate(rows)], WINDOW)


def speakers(df):
    return [r.speaker for r in df.orderBy("ord").collect()]


def test_refined_clusters_keep_published_ids_and_new_ones_take_free_ids(spark):
    df = windows(spark, [("SPEAKER_01", X), ("SPEAKER_01", X), ("SPEAKER_01", Y), ("SPEAKER_00", Z), (None, [-1.0, 0.0, 0.0])])
    assert speakers(clustering.refine_speakers(df)) == ["SPEAKER_01", "SPEAKER_01", "SPEAKER_02", "SPEAKER_00", "SPEAKER_03"]
    assert clustering.refine_speakers(df.limit(0)).count() == 0


def test_clusters_match_the_gallery_as_it_was(spark):
    df = windows(spark, [("", X), ("", [0.9, 0.1, 0.0]), ("", Z)])
    gallery = spark.createDataFrame([(1, "SPEAKER_00", X), (1, "SPEAKER_01", Y)], "job_id long, speaker string, centroid array<double>")
    assert speakers(clustering.cluster_then_match(df, gallery)) == ["SPEAKER_00", "SPEAKER_00", "SPEAKER_02"]
    assert set(speakers(clustering.cluster_then_match(df, gallery.limit(0)))) == {"SPEAKER_00", "SPEAKER_01"}


def test_finished_jobs_lose_micro_speakers(spark):
    near = [0.1, 0.99, 0.0]
    df = windows(spark, [("SPEAKER_00", X)] * 3 + [("SPEAKER_01", Y)] * 3 + [("SPEAKER_02", Z)])
    assert speakers(clustering.finalize_speakers(df, df, least=2.0)) == ["SPEAKER_00"] * 3 + ["SPEAKER_01"] * 3 + ["SPEAKER_02"]
    df = windows(spark, [("SPEAKER_00", X)] * 3 + [("SPEAKER_01", near)] * 3 + [("SPEAKER_02", [-0.2, 0.1, 0.97])])
    assert speakers(clustering.finalize_speakers(df, df, least=3.0)) == ["SPEAKER_00"] * 3 + ["SPEAKER_01"] * 4


def test_late_chunks_end_at_minima_and_at_the_longest(spark):
    s = spark.createDataFrame([(1, i, 10.0 * i, 10.0 * i + 10.0) for i in range(40)], "job_id long, ord long, start double, end double")
    w = chapters.late_windows(s, 240.0, 60.0)
    assert sorted(r.win_id for r in w.filter("ord = 20").collect()) == [0, 1]
    assert w.select("ord").distinct().count() == 40
    from pyspark.sql import functions as F

    v = w.withColumn("vector", F.when(F.col("ord") < 8, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    got = [r.chapter for r in chapters.late_chunk_boundaries(v).orderBy("ord").collect()]
    assert got == [0] * 8 + [1] * 18 + [2] * 14
    assert chapters.late_chunk_boundaries(v.limit(0)).count() == 0


def test_title_groups_have_few_leaves(spark):
    c = spark.createDataFrame([(1, i, 5.0 * i, 5.0 * i + 5.0, X) for i in range(7)], "job_id long, ord long, start double, end double, vector array<double>")
    parents = lambda **k: [r.parent for r in chapters.merge_by_title_vectors(c, **k).orderBy("ord").collect()]
    assert parents(max_leaves=3) == [0, 0, 0, 1, 1, 1, 2]
    assert parents(cap=20.0) == [0, 0, 0, 0, 1, 1, 1]


def test_titles_take_the_first_fair_attempt(spark):
    c = spark.createDataFrame([(1, f"C0{i}", i) for i in range(4)], "job_id long, chapter_id string, ord long")
    said = {("C00", 1): {"title": " Plans  for May ", "more": 1}, ("C01", 1): {"title": "PLANS FOR MAY"}, ("C01", 2): {"title": "Costs"}, ("C02", 1): {"title": "This chapter has costs"}, ("C02", 2): {"title": " ".join("abcdefghijk")}, ("C02", 3): {"title": "Late"}}
    r = spark.createDataFrame([(1, k, a, json.dumps(v)) for (k, a), v in said.items()] + [(1, "C03", 1, "no json"), (1, "C03", 2, '{"title": null}')], "job_id long, chapter_id string, attempt int, text string")
    got = {x.chapter_id: (x.title, x.attempt) for x in insights.select_titles(r, c).collect()}
    assert got == {"C00": ("Plans for May", 1), "C01": ("Costs", 2), "C02": (None, None), "C03": (None, None)}


def test_units_reach_vectors_beyond_the_first_500(spark, monkeypatch):
    from pyspark.sql import functions as F

    from meetspark.plans import recordings as R

    vectors = spark.range(1000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    units = spark.range(300).select(F.col("id").alias("job_id"), F.lit(1).alias("unit"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit(3).alias("words"))
    monkeypatch.setattr(R, "_table", lambda *_: vectors)
    monkeypatch.setattr(R.X, "segments", lambda *_: units)
    monkeypatch.setattr(R.C, "pack_pieces", lambda x: x)
    monkeypatch.setattr(R.C, "units", lambda x: x)
    got = {r.job_id: r.vector[0] for r in R._unit_vectors(spark, "").collect()}
    assert got == {j: (7 * j + 1) % 1000 for j in range(300)}
