"""Artifacts: documents written, read, checked and taken apart; payloads."""

import json

import pytest

from meetspark.operators import insights
from meetspark.sources import artifacts

INSIGHTS = {"schema_version": "1", "job_id": "j", "chapters": [{"id": "C00", "start": 0.0, "end": 2.0, "key_points": [{"text": "a", "src": [{"segment_id": "s1", "start": 0.0, "end": 1.0, "speaker": "A"}, {"segment_id": "s2", "start": 1.0, "end": 2.0, "speaker": "B"}]}], "actions": [{"text": "b", "src": []}]}]}


def test_documents_are_ordered_rounded_and_one_for_each_job(spark, tmp_path):
    rows = [("j1", "1", [(2.00049, 1.0, "x")]), ("j2", "1", [])]
    df = spark.createDataFrame(rows, "job_id string, schema_version string, rows array<struct<start:double,end:double,id:string>>")
    artifacts.write_artifacts(df, str(tmp_path / "out"))
    text = (next((tmp_path / "out" / "job_id=j1").glob("*.txt"))).read_text()
    assert text == '{"job_id":"j1","rows":[{"end":1.0,"id":"x","start":2.0}],"schema_version":"1"}\n'
    assert len(list((tmp_path / "out").glob("job_id=*/*.txt"))) == 2


def test_documents_are_checked_by_name_or_by_what_they_fit(spark):
    seg = lambda s, e, **more: {"id": "s1", "start": s, "end": e, "speaker": "A", "text": "x", **more}
    doc = lambda rows, **more: json.dumps({"schema_version": "1", "job_id": "j", "segments": rows, **more})
    cases = {
        "a/transcript.json": (doc([seg(0, 1), seg(1, 2)]), "transcript", []),
        "b/transcript.json": (doc([seg(1, 2), seg(0, 1)]), "transcript", ["order"]),
        "c/transcript.json": (doc([seg(-1, -1.0001, odd=1)], schema_version="2"), "transcript", ["empty", "keys", "negative", "version"]),
        "d/transcript.json": (doc([], more=1), "transcript", ["keys"]),
        "e/other.json": (doc([seg(0, 1)]), "transcript", []),
        "f/insights.min.json": (json.dumps(INSIGHTS), "insights", []),
        "g/other.json": ("no json", None, ["json"]),
        "h/other.json": ('{"schema_version": "1", "strange": 2}', None, ["keys"]),
    }
    got = {r.name: (r.kind, list(r.errors), r.ok) for r in artifacts.validate_documents(spark.createDataFrame([(n, t) for n, (t, *_) in cases.items()], "name string, text string")).collect()}
    assert got == {n: (kind, errors, not errors) for n, (_, kind, errors) in cases.items()}


def test_all_tables_of_documents(spark, tmp_path):
    (tmp_path / "insights.json").write_text(json.dumps(INSIGHTS, indent=1))
    (tmp_path / "speech.json").write_text(json.dumps({"schema_version": "1", "job_id": "j", "regions": [{"start": 0, "end": 1}], "fallback_regions": [{"start": 2, "end": 3}]}))
    tables = artifacts.explode_tables(artifacts.read_artifacts(spark, str(tmp_path / "insights.json"), "insights"), "insights")
    assert [(r.kind, r.idx, r.text) for r in tables["items"].collect()] == [("key_points", 0, "a"), ("actions", 0, "b")]
    assert [(r.pos, r.segment_id, r.speaker) for r in tables["sources"].orderBy("pos").collect()] == [(0, "s1", "A"), (1, "s2", "B")]
    speech = artifacts.explode_tables(artifacts.read_artifacts(spark, str(tmp_path / "speech.json"), "speech"), "speech")["speech_regions"]
    assert sorted((r.origin, r.start) for r in speech.collect()) == [("fallback", 2.0), ("primary", 0.0)]
    assert [(r.start, r.end) for r in artifacts.read_regions(spark, str(tmp_path / "speech.json")).collect()] == [(0.0, 1.0)]


def test_legacy_headers_have_defaults(spark):
    rows = [("a", "gig", None, "gpu", None, None, None), ("b", None, "x/cpu", "cpu", "en", 30.0, 1.5), ("c", "", "", "", "", 0.0, 0.0)]
    got = artifacts.legacy_header(spark.createDataFrame(rows, "job_id string, model string, engine string, provider string, language string, max_segment_sec double, runtime_sec double")).orderBy("job_id").collect()
    assert [tuple(r) for r in got] == [("a", "gig/gpu", "ru", 25.0, 0.0), ("b", "x/cpu", "en", 30.0, 1.5), ("c", "unknown", "ru", 25.0, 0.0)]


def test_payloads_are_strict_where_they_have_to_be(spark):
    def ok(task, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        return [r.ok for r in insights.parse_payload(df, task).orderBy("i").collect()]

    item = '{"text": "a", "segment_ids": ["s1"]}'
    whole = f'{{"key_points": [{item}], "actions": [], "open_questions": [], "asr_notes": []%s}}'  # all four lists are required
    assert ok("extract", whole % "", whole % ', "x": 1', f'{{"key_points": [{item}]}}', whole.replace('"s1"', "") % "", "no", None, "{}") == [True, False, False, False, False, False, False]
    assert ok("title", '{"title": "a", "x": 1}', '{"title": ""}', "[]") == [True, False, False]
    assert ok("batch", '{"titles": [{"id": "C00", "title": "a"}]}', '{"titles": []}', '{"titles": [{"id": "C00"}]}') == [True, False, False]
    assert ok("report", '{"summary": "", "key_moments": []}', '{"key_moments": []}', '{"summary": "a", "key_moments": [{"text": "a"}]}') == [True, False, False]


def test_prompts_reject_unknown_names(spark):
    c = spark.createDataFrame([(1, "C00", 0.0, 1.0, ["s1"], "{{end}}")], "job_id long, chapter_id string, start double, end double, source_ids array<string>, title string")
    s = spark.createDataFrame([(1, "s1", "A", " hi ", 0.0, 1.0)], "job_id long, segment_id string, speaker string, text string, start double, end double")
    assert insights.build_prompts("{{title}}: {{chapter_text}} {{src_catalog}}", c, s).first().prompt == "{{end}}: A: hi s1 | 0.000-1.000 | A"
    with pytest.raises(ValueError, match="other"):
        insights.build_prompts("{{other}}", c, s)


def test_rows_are_stored_by_day_and_replaced_whole(spark, tmp_path):
    ddl = "job_id string, created_at string, state string"
    path = str(tmp_path / "jobs")
    first = [(f"j{i}", f"2024-01-0{1 + i % 2}T10:00:00+00:00", "queued") for i in range(40)] + [("n", None, "queued")]
    artifacts.store_artifacts(spark.createDataFrame(first, ddl), path)
    artifacts.store_artifacts(spark.createDataFrame([("j1", "2024-01-02T10:00:00+00:00", "done")], ddl), path)
    got = sorted((r.job_id, str(r.job_date), r.state) for r in spark.read.parquet(path).collect())
    assert got == sorted([(f"j{i}", "2024-01-01", "queued") for i in range(0, 40, 2)] + [("j1", "2024-01-02", "done"), ("n", "None", "queued")])
    files = [p for p in (tmp_path / "jobs").rglob("*.parquet")]
    assert len(files) < 20  # not one for each job
