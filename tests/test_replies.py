"""Which reply counts: whole replies, retries and failures, against a plain loop."""

import json

from meetspark.operators import insights as G

SEG = [("j", f"s{i}", i, float(i), float(i + 1), "a" if i % 2 else "b", f"text {i} of 20{i}") for i in range(6)]
IDS = {"C0": ["s0", "s1", "s2"], "C1": ["s3", "s4", "s5"]}
ITEM = {"text": "point", "segment_ids": ["s0"]}


def reply(**lists):
    return json.dumps({"key_points": [], "actions": [], "open_questions": [], "asr_notes": []} | lists)


CASES = {
    "clean": ([reply(key_points=[ITEM], asr_notes=[{"text": "n"}])], "accepted", 1, 1),
    "empty": ([reply()], "accepted", 1, 0),
    "empty text": ([reply(actions=[ITEM | {"text": ""}])], "accepted", 1, 1),
    "digits never retry": ([reply(key_points=[ITEM | {"text": "in 1999"}]), reply(key_points=[ITEM])], "accepted", 1, 0),
    "one unknown item spoils the first": ([reply(key_points=[ITEM, ITEM | {"segment_ids": ["s0", "s9"]}]), reply(actions=[ITEM])], "accepted", 2, 1),
    "of another chapter": ([reply(key_points=[ITEM | {"segment_ids": ["s3"]}]), reply(key_points=[ITEM | {"segment_ids": ["s3"]}, ITEM])], "reduced", 2, 1),
    "invalid, then invalid": (["no", reply(actions=[{"text": "x"}])], "failed", 2, 0),
    "unknown, then invalid": ([reply(key_points=[ITEM | {"segment_ids": ["q"]}]), "[]"], "failed", 2, 0),
    "third attempt does not count": (["", "", reply(key_points=[ITEM])], "failed", 2, 0),
    "waits": (["no"], "retry", 1, 0),
    "unknown key": ([reply(more=1)], "retry", 1, 0),
    "missing list": ([json.dumps({"key_points": [], "actions": [], "open_questions": []})], "retry", 1, 0),
    "key in item": ([reply(actions=[ITEM | {"when": "now"}])], "retry", 1, 0),
    "no ids": ([reply(actions=[ITEM, ITEM | {"segment_ids": []}])], "retry", 1, 0),
    "number as text": ([reply(actions=[ITEM | {"text": 5}])], "retry", 1, 0),
    "null item": ([reply(actions=[None])], "retry", 1, 0),
    "null id": ([reply(actions=[ITEM | {"segment_ids": ["s0", None]}])], "retry", 1, 0),
    "note without text": ([reply(asr_notes=[{}])], "retry", 1, 0),
    "null reply": ([None], "retry", 1, 0),
}


def test_replies_count_as_a_whole(spark):
    jobs = list(CASES)
    replies = spark.createDataFrame([(str(j), "C0", n + 1, t) for j, name in enumerate(jobs) for n, t in enumerate(CASES[name][0])], "job_id string, chapter_id string, attempt int, text string")
    chapters = spark.createDataFrame([(str(j), c, i, ids) for j in range(len(jobs)) for i, (c, ids) in enumerate(IDS.items())], "job_id string, chapter_id string, ord long, source_ids array<string>")
    segments = spark.createDataFrame([(str(j), *s[1:]) for j in range(len(jobs)) for s in SEG], "job_id string, segment_id string, ord long, start double, end double, speaker string, text string")
    got = {jobs[int(r.job_id)]: (r.status, r.attempt) for r in G.select_replies(replies, chapters).collect()}
    assert got == {name: case[1:3] for name, case in CASES.items()}
    rows = {}
    for r in G.build_insights(replies, chapters, segments).collect():
        rows.setdefault(jobs[int(r.job_id)], []).append(r)
    assert {name: len(rows.get(name, [])) for name in jobs} == {name: case[3] for name, case in CASES.items()}
    (one,) = rows["clean"]
    assert (one.kind, one.idx, one.pos, one.segment_id, one.start, one.end, one.speaker) == ("key_points", 0, 0, "s0", 0.0, 1.0, "b")
