"""Stage artifacts as JSON documents: read, checked, taken apart into tables and put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTERVAL = "array<struct<start:double,end:double>>"
_ITEMS = "array<struct<text:string,src:array<struct<segment_id:string,start:double,end:double,speaker:string>>>>"
SCHEMAS = {
    "speech": f"schema_version string, job_id string, detector string, fallback_used boolean, regions {_INTERVAL}, fallback_regions {_INTERVAL}, speech_sec double, runtime_sec double",
    "turns": f"schema_version string, job_id string, diarizer string, speaker_count int, turns array<struct<id:string,start:double,end:double,speaker:string>>, holes {_INTERVAL}, runtime_sec double",
    "transcript": f"schema_version string, job_id string, engine string, language string, segments array<struct<id:string,turn_id:string,start:double,end:double,speaker:string,text:string,gain_db:double,empty:boolean>>, holes {_INTERVAL}, max_segment_sec double, runtime_sec double",
    "chapters": "schema_version string, job_id string, chunker string, embedding_model string, similarity_threshold double, chapters array<struct<id:string,start:double,end:double,source_ids:array<string>,speakers:array<string>,title:string,duration_sec:double>>, metrics struct<chapters_per_minute:double,short_chapters:int,long_chapters:int>, runtime_sec double",
    "audio": "schema_version string, job_id string, source struct<filename:string,size_bytes:bigint,duration_sec:double>, normalized struct<path:string,sample_rate:int,channels:int>, loudness struct<rms_dbfs:double,peak_dbfs:double,gain_db:double,gain_applied:boolean,capped:boolean>, vad_input struct<path:string,filter:string,applied:boolean>, asr_per_turn_gain boolean, runtime_sec double",
    "quality": "schema_version string, job_id string, russian_word_ratio double, total_words int, latin_chars_in_segments int, empty_segments int, hole_sec_total double, oov_words array<string>, verdict string, checks array<struct<id:string,status:string,value:string,threshold:string,message:string>>",
    "suggestions": "schema_version string, job_id string, dictionaries array<string>, applied boolean, suggestions array<struct<segment_id:string,span:array<int>,found:string,suggested:string,confidence:double,start:double,end:double>>",
    "insights": f"schema_version string, job_id string, provider string, model string, prompt_id string, chapters array<struct<id:string,start:double,end:double,key_points:{_ITEMS},actions:{_ITEMS},open_questions:{_ITEMS},asr_notes:array<struct<text:string>>>>, llm_calls int, runtime_sec double",
    "report": "schema_version string, job_id string, summary string, key_moments array<struct<text:string,start:double,end:double,speaker:string,chapter_id:string>>, speakers array<struct<id:string,label:string,speech_sec:double>>, chapters array<struct<id:string,title:string,start:double,end:double>>, provider string, model string, llm_calls int, draft_warning boolean, runtime_sec double",
    "job": "schema_version string, job_id string, created_at string, expires_at string, client_ip_hash string, state string, stages array<struct<stage:string,status:string,pct:double,runtime_sec:double,message:string,eta_sec:double,eta_total_sec:double>>, error string, finished_at string, early_ready boolean, speakers_finalized boolean",
}
#: The arrays of each kind; the first holds its main rows.
ARRAYS = {
    "speech": ["regions", "fallback_regions"],
    "turns": ["turns", "holes"],
    "transcript": ["segments", "holes"],
    "chapters": ["chapters"],
    "quality": ["checks"],
    "suggestions": ["suggestions"],
    "insights": ["chapters"],
    "report": ["key_moments", "speakers", "chapters"],
    "job": ["stages"],
    "audio": [],
}


def read_artifacts(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row for each document; a broken one has its text in ``_corrupt_record``."""
    return spark.read.schema(SCHEMAS[kind] + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def scan_jobs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Job documents; unreadable ones are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """``job_id, ord, start, end`` of the regions of speech documents."""
    return explode_artifact(read_artifacts(spark, path, "speech"), "speech")


def _ordered(value: Column, kind: T.DataType) -> Column:
    """A value with the keys of all its structs in order of their names and its numbers rounded to three decimals."""
    if isinstance(kind, T.StructType):
        fields = [_ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    return F.round(value, 3) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def _struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def documents(df: DataFrame) -> DataFrame:
    """``job_id, value``: each row as a JSON document with its keys in order at every depth and times rounded to three decimals."""
    fields = [_ordered(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return df.select("job_id", F.to_json(F.struct(*fields)).alias("value"))


def write_artifacts(df: DataFrame, path: str) -> None:
    """One JSON document for each row of ``df(job_id, ...)``, in a folder of its job."""
    documents(df).repartition("job_id").write.mode("overwrite").partitionBy("job_id").text(path)


def store_artifacts(df: DataFrame, path: str, created: str = "created_at", files_of: int = 1_000_000) -> None:
    """``df(job_id, ..., created)`` as Parquet by day of ``created`` (``job_date``; null times under their own), days that are written again replaced whole.

    Rows of a day are dealt out by job and sorted by it, so that a file holds many jobs and a job is found by its range; files have at most
    ``files_of`` rows. ``write_artifacts`` exports single jobs as JSON.
    """
    dated = df.withColumn("job_date", F.to_date(F.col(created).cast("timestamp")))
    ready = dated.repartition("job_date", F.pmod(F.xxhash64("job_id"), F.lit(16))).sortWithinPartitions("job_date", "job_id")
    ready.write.option("maxRecordsPerFile", files_of).option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("job_date").parquet(path)


def _with_others(names: list[str]):
    """Whether the JSON object of a row has a key beside these."""
    return lambda row: F.size(F.array_except(F.coalesce(F.json_object_keys(row), F.array().cast("array<string>")), F.array(*map(F.lit, names)))) > 0


def validate_documents(docs: DataFrame) -> DataFrame:
    """``name, kind, ok, errors`` of ``docs(name, text)``: file names and their JSON.

    A file named after a kind (``turns.json``) is held against that kind; another one against all, and takes the first it fits. Errors:
    ``json`` (not an object), ``version`` (not "1"), ``keys`` (an unknown key, in the document or in its rows), ``negative`` times,
    ``empty`` intervals and ``order`` (starts of segments that go back).
    """
    keys = F.json_object_keys("text")
    found = {}
    for kind, ddl in SCHEMAS.items():
        known = [f.name for f in _struct(ddl).fields]
        error = [F.when(keys.isNull(), "json"), F.when(~F.get_json_object("text", "$.schema_version").eqNullSafe(F.lit("1")), "version")]
        strange = F.size(F.array_except(keys, F.array(*map(F.lit, known)))) > 0
        for name in ARRAYS[kind]:
            inner = _struct(ddl)[name].dataType.elementType
            rows = F.from_json(F.get_json_object("text", f"$.{name}"), T.ArrayType(T.StringType()))
            strange = strange | F.exists(F.coalesce(rows, F.array().cast("array<string>")), _with_others(inner.names))
            if {"start", "end"} <= set(inner.names):
                typed = F.coalesce(F.from_json(F.get_json_object("text", f"$.{name}"), T.ArrayType(inner)), F.array().cast(T.ArrayType(inner)))
                error.append(F.when(F.exists(typed, lambda r: r["start"] < 0), "negative"))
                error.append(F.when(F.exists(typed, lambda r: F.round(r["end"], 3) <= F.round(r["start"], 3)), "empty"))
                if name == "segments":
                    back = F.exists(F.zip_with(typed, F.slice(typed, 2, 1 << 30), lambda x, y: y["start"] < x["start"]), lambda b: F.coalesce(b, F.lit(False)))
                    error.append(F.when(back, "order"))
        error.append(F.when(strange, "keys"))
        found[kind] = F.array_sort(F.array_distinct(F.filter(F.array(*error), lambda e: e.isNotNull())))
    base = F.regexp_extract("name", r"([^/]*?)(?:\.min)?\.json$", 1)
    tried = docs.select("name", base.alias("base"), *(e.alias(f"e_{kind}") for kind, e in found.items()))
    named, fits = None, None
    for kind in SCHEMAS:
        pair = F.struct(F.lit(kind).alias("kind"), F.col(f"e_{kind}").alias("errors"))
        named = F.when(F.col("base") == kind, pair) if named is None else named.when(F.col("base") == kind, pair)
        fits = F.when(F.size(f"e_{kind}") == 0, pair) if fits is None else fits.when(F.size(f"e_{kind}") == 0, pair)
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.when(F.array_contains("e_speech", "json"), F.array(F.lit("json"))).otherwise(F.array(F.lit("keys"))).alias("errors"))
    out = tried.select("name", F.coalesce(named, fits, none).alias("x"))
    return out.select("name", "x.kind", (F.size("x.errors") == 0).alias("ok"), "x.errors")


def explode_artifact(df: DataFrame, kind: str) -> DataFrame:
    """The rows of a document with their place."""
    return df.select("job_id", F.posexplode(ARRAYS[kind][0]).alias("ord", "x")).select("job_id", "ord", "x.*")


def explode_tables(df: DataFrame, kind: str) -> dict[str, DataFrame]:
    """All arrays of a kind as tables ``job_id, ord, ...``; speech regions in one table with their origin, insights also as items and sources."""
    out = {name: df.select("job_id", F.posexplode(name).alias("ord", "x")).select("job_id", "ord", "x.*") for name in ARRAYS[kind]}
    if kind == "speech":
        origin = lambda name, label: out[name].select("job_id", F.lit(label).alias("origin"), "ord", "start", "end")
        out["speech_regions"] = origin("regions", "primary").unionByName(origin("fallback_regions", "fallback"))
    if kind == "chapters":
        out["chapter_segments"] = out["chapters"].select("job_id", F.col("id").alias("chapter_id"), F.posexplode("source_ids").alias("pos", "segment_id"))
    if kind == "insights":
        items = None
        for name in ("key_points", "actions", "open_questions"):
            part = out["chapters"].select("job_id", F.col("id").alias("chapter_id"), F.lit(name).alias("kind"), F.posexplode(name).alias("idx", "i"))
            items = part if items is None else items.unionByName(part)
        out["items"] = items.select("job_id", "chapter_id", "kind", "idx", "i.text")
        out["sources"] = items.select("job_id", "chapter_id", "kind", "idx", F.posexplode("i.src").alias("pos", "s")).select("job_id", "chapter_id", "kind", "idx", "pos", "s.*")
    return out


def nest_artifact(rows: DataFrame, name: str) -> DataFrame:
    """Rows ``job_id, ord, ...`` as one array for each job."""
    inner = [c for c in rows.columns if c not in ("job_id", "ord")]
    packed = F.array_sort(F.collect_list(F.struct("ord", F.struct(*inner).alias("x"))))
    return rows.groupBy("job_id").agg(F.transform(packed, lambda s: s["x"]).alias(name))


def validate_rows(rows: DataFrame) -> DataFrame:
    """Errors of each job: negative times, empty intervals, starts that go back."""
    prev = F.lag("start").over(Window.partitionBy("job_id").orderBy("ord"))
    e = F.when(F.col("start") < 0, "negative").when(F.round("end", 3) <= F.round("start", 3), "empty").when(F.col("start") < prev, "order")
    out = rows.withColumn("e", e).groupBy("job_id").agg(F.array_sort(F.collect_set("e")).alias("errors"))
    return out.withColumn("ok", F.size("errors") == 0)


def convert_legacy_transcript(rows: DataFrame) -> DataFrame:
    """Old segments ``id, turn_id, speaker, text``: numbered ids, default turns and speakers, the blank mark."""
    number = F.col("id").try_cast("int")
    sid = F.when(number.isNotNull(), F.format_string("s%04d", number)).otherwise(F.col("id"))
    return rows.withColumn("id", sid).withColumn("turn_id", F.coalesce("turn_id", F.concat(F.lit("t"), F.substring("id", 2, 1 << 30)))).withColumn("speaker", F.coalesce("speaker", F.lit("SPEECH"))).withColumn("empty", F.trim(F.coalesce("text", F.lit(""))) == "")


def legacy_header(df: DataFrame) -> DataFrame:
    """``job_id, engine, language, max_segment_sec, runtime_sec`` of old documents ``job_id, model, engine, provider, language,
    max_segment_sec, runtime_sec``: the model or engine with the provider unless it names it, and defaults for what is missing."""
    given = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    engine = F.coalesce(given("model"), given("engine"), F.lit("unknown"))
    both = F.when(given("provider").isNotNull() & ~F.contains(engine, F.col("provider")), F.concat_ws("/", engine, "provider")).otherwise(engine)
    number = lambda c, default: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.col(c)).otherwise(default)
    return df.select("job_id", both.alias("engine"), F.coalesce(given("language"), F.lit("ru")).alias("language"), number("max_segment_sec", 25.0).alias("max_segment_sec"), number("runtime_sec", 0.0).alias("runtime_sec"))


def render_report_markdown(jobs: DataFrame, chapters: DataFrame, speakers: DataFrame, moments: DataFrame | None = None) -> DataFrame:
    """A markdown report for each job of ``jobs(job_id, summary, draft)``: summary, key moments, chapters and speakers.

    ``moments(job_id, pos, start, end, text, speaker, chapter_id)`` and ``chapters(job_id, ord, chapter_id, start, end, title)`` are listed with
    their time ranges in order, ``speakers(job_id, speaker, speech_sec)`` with their label where a column ``label`` has one. A job without rows
    for a section has it empty.
    """
    from ..functions.text import format_mmss

    lines = lambda df, line, by: df.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, line.alias("l")))), lambda s: s["l"]), "\n").alias("l"))
    span = F.concat(F.lit("- ["), format_mmss(F.col("start")), F.lit("–"), format_mmss(F.col("end")), F.lit("] "))
    c = lines(chapters, F.concat(span, F.coalesce("title", F.lit("")), F.lit(" ("), F.col("chapter_id"), F.lit(")")), "ord").withColumnRenamed("l", "c")
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit(" — "), F.col("label"))).otherwise(F.lit("")) if "label" in speakers.columns else F.lit("")
    s = lines(speakers, F.concat(F.lit("- "), F.col("speaker"), label, F.lit(": "), F.format_string("%.3f", "speech_sec")), "speaker").withColumnRenamed("l", "s")
    if moments is None:
        m = jobs.select("job_id", F.lit("").alias("m"))
    else:
        m = lines(moments, F.concat(span, F.col("text"), F.lit(" ("), F.col("speaker"), F.lit(", "), F.col("chapter_id"), F.lit(")")), "pos").withColumnRenamed("l", "m")
    draft = F.when(F.col("draft"), F.lit("> draft\n\n")).otherwise(F.lit(""))
    md = F.concat(F.lit("# Report\n\n"), draft, F.trim(F.coalesce("summary", F.lit(""))), F.lit("\n\n## Key moments\n"), F.coalesce("m", F.lit("")), F.lit("\n\n## Chapters\n"), F.coalesce("c", F.lit("")), F.lit("\n\n## Speakers\n"), F.coalesce("s", F.lit("")), F.lit("\n"))
    return jobs.join(c, "job_id", "left").join(s, "job_id", "left").join(m, "job_id", "left").select("job_id", md.alias("md"))
