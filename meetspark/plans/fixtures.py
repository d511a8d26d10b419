"""Recording tables derived from the test tables, for Spark and as DuckDB CTEs. Times come from whole milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def segments(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    b = _read(spark, d, "conversations").select("conv_id", "turn", "role", F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "").otherwise(F.col("text")).alias("text"), (400 + 20 * F.length("text")).alias("dur"), (200 * ((F.col("turn") * 7 + F.col("conv_id") * 3) % 8)).alias("gap"))
    total = F.sum(F.col("dur") + F.col("gap")).over(w)
    return b.select(F.col("conv_id").alias("job_id"), F.col("turn").alias("ord"), F.format_string("s%04d", "turn").alias("segment_id"), F.col("role").alias("speaker"), "text", ((total - F.col("dur")) / 1000.0).alias("start"), (total / 1000.0).alias("end"))


SEGMENTS = """segments AS (SELECT conv_id AS job_id, turn AS ord, printf('s%04d', turn) AS segment_id, role AS speaker, text,
 (sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn) - dur) / 1000.0::DOUBLE AS "start", sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn) / 1000.0::DOUBLE AS "end"
 FROM (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE text END AS text, 400 + 20 * length(text) AS dur, 200 * ((turn * 7 + conv_id * 3) % 8) AS gap FROM conversations))"""


def intervals(spark: SparkSession, d: str) -> DataFrame:
    b = _read(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("speaker"), F.expr("((unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP'2024-01-01 00:00:00')) div 1000) div 1000").alias("ms"), F.floor(F.col("value") * 100).cast("bigint").alias("dur"))
    return b.select("job_id", "ord", "speaker", (F.col("ms") / 1000.0).alias("start"), ((F.col("ms") + F.greatest("dur", F.lit(1))) / 1000.0).alias("end"))


INTERVALS = """intervals AS (SELECT user_id AS job_id, event_id AS ord, event_type AS speaker, ms / 1000.0::DOUBLE AS "start", (ms + greatest(dur, 1)) / 1000.0::DOUBLE AS "end"
 FROM (SELECT *, ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000) // 1000 AS ms, CAST(floor(value * 100) AS BIGINT) AS dur FROM events))"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    return _read(spark, d, "embeddings").select(F.expr("vec_id div 100").alias("job_id"), (v % 100).alias("ord"), (0.75 * (v % 100)).alias("start"), (0.75 * (v % 100) + 1.5).alias("end"), "embedding", "label")


VECTORS = """vectors AS (SELECT vec_id // 100 AS job_id, vec_id % 100 AS ord, 0.75::DOUBLE * (vec_id % 100) AS "start", 0.75::DOUBLE * (vec_id % 100) + 1.5 AS "end", embedding, label FROM embeddings)"""


def chapters(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("c", F.expr("ord div 4"))
    g = s.groupBy("job_id", "c").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.collect_list("segment_id")).alias("source_ids"), F.min_by("text", "ord").alias("t"))
    return g.select("job_id", F.col("c").alias("ord"), F.format_string("C%02d", "c").alias("chapter_id"), "start", "end", "source_ids", F.array_join(F.slice(F.split("t", "[ \n]"), 1, 6), " ").alias("title"))


CHAPTERS = SEGMENTS + """, chapters AS (SELECT job_id, ord // 4 AS ord, printf('C%02d', ord // 4) AS chapter_id, min("start") AS "start", max("end") AS "end", list_sort(list(segment_id)) AS source_ids,
 array_to_string(string_split_regex(min_by(text, ord), '[ \\n]')[1:6], ' ') AS title FROM segments s GROUP BY job_id, s.ord // 4)"""


def hypothesis(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).filter("ord % 9 <> 8")
    return s.select("job_id", "ord", "segment_id", F.when(F.col("ord") % 13 == 12, "other").otherwise(F.col("speaker")).alias("speaker"), "text", (F.col("start") + 0.25).alias("start"), (F.col("end") + 0.25).alias("end"))


HYPOTHESIS = SEGMENTS + """, hypothesis AS (SELECT job_id, ord, segment_id, CASE WHEN ord % 13 = 12 THEN 'other' ELSE speaker END AS speaker, text, "start" + 0.25 AS "start", "end" + 0.25 AS "end" FROM segments WHERE ord % 9 <> 8)"""


def edits(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).filter("ord % 6 = 1")
    return s.select("job_id", "segment_id", F.concat(F.lit("edited "), F.col("text")).alias("new_text"), F.when(F.col("ord") % 12 == 1, "assistant").alias("new_speaker"))


EDITS = """edits AS (SELECT job_id, segment_id, 'edited ' || text AS new_text, CASE WHEN ord % 12 = 1 THEN 'assistant' END AS new_speaker FROM segments WHERE ord % 6 = 1)"""
