"""Clusters by parts, galleries, chapters, word errors, sliced joins, gates and padding against plain loops."""

import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from meetspark.operators import chapters, clustering, evaluate, gates, intervals


def plain_linkage(vectors, threshold):
    """Merges the closest two clusters until they are ``threshold`` apart."""
    unit = np.array([v / max(np.linalg.norm(v), 1e-12) for v in vectors])
    groups = [[i] for i in range(len(unit))]
    while len(groups) > 1:
        d, a, b = min((float(np.mean([1 - unit[x] @ unit[y] for x in groups[a] for y in groups[b]])), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
        if d >= threshold:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("threshold", [0.05, 0.5, 0.9, 1.2])
def test_average_linkage_equals_plain_merging(threshold):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 25):
        vectors = rng.normal(size=(n, 4)) + 2 * np.eye(4)[rng.integers(0, 4, n)]
        label = clustering.average_linkage(vectors, threshold)
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label.tolist())} == plain_linkage(vectors, threshold)
        assert label[0] == 0 and all(label[i] <= label[:i].max() + 1 for i in range(1, n))


def test_long_jobs_are_clustered_by_parts(spark):
    """5,000 windows of three clear voices, in parts of 600; and a job of one part like the whole."""
    rng = np.random.default_rng(4)
    voice = rng.integers(0, 3, 5000)
    rows = [(1, i, (5 * np.eye(6)[v] + rng.normal(0, 0.2, 6)).tolist()) for i, v in enumerate(voice)] + [(2, i, rng.normal(size=6).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "job_id long, ord long, embedding array<double>")
    got = clustering.cluster_windows(df, 0.5, part=600).toPandas().sort_values(["job_id", "ord"])
    own = got[got.job_id == 1].label.to_numpy()
    assert len(set(zip(voice.tolist(), own.tolist()))) == 3 and own[0] == 0
    small = got[got.job_id == 2].label.to_numpy()
    assert (small == clustering.average_linkage(np.array([r[2] for r in rows if r[0] == 2]), 0.5)).all()
    assert clustering.cluster_windows(df.limit(0)).count() == 0


def test_crowded_jobs_are_merged_by_rounds(spark):
    """Blocks of three clusters give what one group gives: alike and unlike clusters, equal ones, jobs on both sides of the bound."""
    rng = np.random.default_rng(8)
    rows = []
    for job, n in ((1, 60), (2, 5), (3, 41)):
        for i in range(n):
            v = 3 * np.eye(5)[rng.integers(0, 5)] + rng.normal(0, 1, 5) if job != 3 else np.eye(41)[i]
            rows.append((job, 7 * i - 20, int(rng.integers(1, 9)), (v / np.linalg.norm(v) * rng.uniform(0.8, 1)).tolist()))
    rows += [(4, i, 2, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "job_id long, id long, n long, mean array<double>")
    for threshold in (0.3, 0.7):
        merged, rounds = clustering.merge_alike(df, threshold, most=6)
        got = {(r.job_id, r.id): r.root for r in merged.collect()}
        assert len(got) == len(rows) and rounds > 1
        for job in (1, 2, 3, 4):
            own = [r for r in rows if r[0] == job]
            label = clustering.average_linkage(np.array([r[3] for r in own]), threshold, np.array([r[2] for r in own]))
            assert [got[job, r[1]] for r in own] == [own[int(np.flatnonzero(label == k)[0])][1] for k in label]
        assert len({x for (job, _), x in got.items() if job == 3}) == 41 and len({x for (job, _), x in got.items() if job == 4}) == 2
    assert clustering.merge_alike(df.filter("job_id = 3"), 0.7, most=6)[1] == 1  # nothing is alike


def test_windows_of_crowded_jobs_keep_their_labels(spark):
    rng = np.random.default_rng(9)
    rows = [(1, i, (2 * np.eye(8)[i % 8] + rng.normal(0, 0.5, 8)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "job_id long, ord long, embedding array<double>")
    one, many = (clustering.cluster_windows(df, 0.5, part=40, most=most).orderBy("ord").toPandas() for most in (4000, 10))
    assert one.equals(many) and one.label.iloc[0] == 0 and one.label.nunique() >= 8


def test_update_gallery_names_leftovers_and_blends(spark):
    e = np.eye(4)
    gallery = spark.createDataFrame([(1, "SPEAKER_00", 3, e[0].tolist()), (1, "SPEAKER_02", 1, e[1].tolist())], "job_id long, speaker string, n_windows long, centroid array<double>")
    seen = [(1, 0, 2 * e[0] + 0.1 * e[2]), (1, 1, e[3]), (1, 2, e[3] + 0.05 * e[0]), (1, 3, e[2]), (7, 0, e[1])]
    windows = spark.createDataFrame([(j, o, v.tolist()) for j, o, v in seen], "job_id long, ord long, embedding array<double>")
    assigned, after = clustering.update_gallery(windows, gallery, 0.5)
    assert {(r.job_id, r.ord): r.speaker for r in assigned.collect()} == {(1, 0): "SPEAKER_00", (1, 1): "SPEAKER_01", (1, 2): "SPEAKER_01", (1, 3): "SPEAKER_03", (7, 0): "SPEAKER_00"}
    got = {(r.job_id, r.speaker): (r.n_windows, np.array(r.centroid)) for r in after.collect()}
    unit = lambda v: v / np.linalg.norm(v)
    assert got[1, "SPEAKER_00"][0] == 4 and np.allclose(got[1, "SPEAKER_00"][1], unit(3 * e[0] + unit(seen[0][2])))
    assert got[1, "SPEAKER_02"][0] == 1 and np.allclose(got[1, "SPEAKER_02"][1], e[1])
    assert got[1, "SPEAKER_01"][0] == 2 and np.allclose(got[1, "SPEAKER_01"][1], unit(unit(seen[1][2]) + unit(seen[2][2]))) and got[7, "SPEAKER_00"][0] == 1


def test_two_passes_and_clear_winners(spark):
    e, unit = np.eye(4), lambda v: (v / np.linalg.norm(v)).tolist()
    kind = "job_id long, ord long, start double, end double, embedding array<double>"
    gallery = spark.createDataFrame([(1, "SPEAKER_00", 1, e[0].tolist()), (1, "SPEAKER_01", 1, e[1].tolist())], "job_id long, speaker string, n_windows long, centroid array<double>")
    # the second window is out of reach of the first pass and within that of the moved centroid
    rows = [(1, 0, 0.0, 1.0, unit(e[0] + e[2])), (1, 1, 1.0, 2.0, unit(0.6 * e[0] + e[2])), (1, 2, 2.0, 3.0, e[3].tolist())]
    got = {r.ord: r.speaker for r in clustering.refine_reassign(spark.createDataFrame(rows, kind), gallery, 0.4).collect()}
    assert got == {0: "SPEAKER_00", 1: "SPEAKER_00", 2: "SPEAKER_02"}
    # one clear, one short and between two speakers, one long and between them
    between = lambda x: unit(e[0] + e[1] + x)
    rows = [(1, 0, 0.0, 9.0, e[0].tolist()), (1, 1, 9.0, 10.0, between(3 * e[2])), (1, 2, 10.0, 15.0, between(3 * e[3])), (1, 3, 12.0, 13.0, between(3 * e[3]))]
    got = {r.ord: r.speaker for r in clustering.clear_winner(spark.createDataFrame(rows, kind), gallery, 0.69).collect()}
    assert got == {0: "SPEAKER_00", 1: "SPEAKER_00", 2: "SPEAKER_02", 3: "SPEAKER_02"}


def test_interval_join_meets_each_pair_once(spark):
    rng = random.Random(5)
    span = lambda: sorted((rng.uniform(0, 400), rng.uniform(0, 400))) if rng.random() < 0.3 else [t := rng.uniform(0, 400), t + rng.uniform(0, 30)]
    a, b = ([(rng.randint(0, 2), i, *span()) for i in range(60)] for _ in range(2))
    da, db = spark.createDataFrame(a, "job_id long, i long, s double, e double"), spark.createDataFrame(b, "job_id long, k long, bs double, be double")
    got = sorted((r.i, r.k) for r in intervals.interval_join(da, db, (F.col("s"), F.col("e")), (F.col("bs"), F.col("be"))).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


def test_padding_of_hysteresis_regions(spark):
    probs = [0.9, 0.9, 0.4, 0.1, 0.1, 0.1, 0.9, 0.9, 0.1, 0.4, 0.1, 0.9]
    frames = spark.createDataFrame([(1, i, p) for i, p in enumerate(probs)], "job_id long, frame_idx long, prob double")
    bare = [(r.start, r.end) for r in intervals.hysteresis_regions(frames).orderBy("ord").collect()]
    assert bare == [(0.0, 0.3), (0.6, 1.2)]  # two frames below after the first of them; a frame between resets the count
    padded = [(r.start, r.end) for r in intervals.hysteresis_regions(frames, pad=0.2).orderBy("ord").collect()]
    assert padded == [(0.0, 0.5), (0.5, 1.2)]


def plain_counts(ref, hyp):
    """Substitutions, deletions, insertions: fewest edits, then most substitutions."""
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, x in enumerate(ref, 1):
        row, before = [(i, 0, i, 0)], row
        for j, y in enumerate(hyp, 1):
            e, s, d, n = before[j - 1]
            ways = [(e, s, d, n) if x == y else (e + 1, s - 1, d, n)]
            e, s, d, n = before[j]
            ways.append((e + 1, s, d + 1, n))
            e, s, d, n = row[-1]
            ways.append((e + 1, s, d, n + 1))
            row.append(min(ways, key=lambda w: w[:2]))
    _, s, d, n = row[-1]
    return -s, d, n


@pytest.mark.parametrize("unit", ["word", "char"])
def test_alignment_equals_a_loop(spark, unit):
    rng = random.Random(12)
    kind = "job_id string, segment_id string, ord long, start double, end double, text string"
    sides, jobs = ([], []), {}
    for j in range(8):
        for side in (0, 1):
            t, rows = 0.0, []
            for i in range(rng.randint(0 if j else 3, 25)):
                t += rng.choice([0.0, 0.1, 0.5, 3.0])
                text = " ".join(rng.choice(["red", "Blue", "green,", "é1", "-"]) for _ in range(rng.randint(0, 9)))
                rows.append((f"j{j}", f"{side}-{i}", i, round(t, 2), round(t + 1.0, 2), None if rng.random() < 0.05 else text))
                t += 1.0
            sides[side].extend(rows)
            jobs.setdefault(f"j{j}", ([], []))[side].extend(rows)
    want = {}
    for j, both in jobs.items():
        marked = sorted(((r[3], r[4], side, r[2], r[5] or "") for side in (0, 1) for r in both[side]))
        far, groups = None, []
        for s, e, side, _, text in marked:
            if far is None or s - far > 0.2:
                groups.append((s, ([], [])))
            groups[-1][1][side].append((s, text))
            far = e if far is None else max(far, e)
        for s, (r, h) in groups:
            r, h = ([t for _, t in sorted(x, key=lambda x: x[0])] for x in (r, h))
            r, h = ([w for t in x for w in re.sub(r"[^\w]+|_", " ", t).lower().split()] if unit == "word" else " ".join(x) for x in (r, h))
            want[j, s] = (len(r), len(h), *plain_counts(r, h))
    ref, hyp = (spark.createDataFrame(x, kind) for x in sides)
    got = {(r.job_id, r.island): tuple(r)[2:] for r in evaluate.align(ref, hyp, unit, 0.2).collect()}
    assert got == want
    if unit == "word":
        rates = evaluate.wer(ref, hyp, 0.2)
        assert {r.job_id: (r.words, r.edits) for r in rates.collect()} == {j: (sum(v[0] for (k, _), v in want.items() if k == j), sum(sum(v[2:]) for (k, _), v in want.items() if k == j)) for j in {k for k, _ in want}}
        total, each = evaluate.error_rates(rates).first(), rates.collect()
        assert total.micro == pytest.approx(sum(r.edits for r in each) / sum(r.words for r in each), abs=1e-6) and total.macro == pytest.approx(sum(r.wer for r in each) / len(each), abs=1e-6)


def test_character_errors_equal_a_loop(spark):
    rng = random.Random(5)
    kind = "job_id long, ord long, start double, end double, text string"
    pairs = [("", ""), ("", "ab"), ("ab", ""), ("aaa", "aa"), ("abab", "ab"), ("ab", "ba"), ("é😀", "e😀€")]
    for _ in range(400):
        letters = "abé€😀 "[: rng.randint(1, 6)]
        r, h = (rng.choices(letters, k=rng.randint(0, 80)) for _ in range(2))
        h = h if rng.random() < 0.3 else [x for x in r if rng.random() < 0.9]
        h[len(h) // 2 : len(h) // 2] = rng.choices(letters, k=rng.randint(0, 4))
        pairs.append(("".join(r), "".join(h)))
    want = {i: (len(r), sum(plain_counts(r, h))) for i, (r, h) in enumerate(pairs)}
    ref, hyp = (spark.createDataFrame([(i, 0, 0.0, 1.0, p[side]) for i, p in enumerate(pairs)], kind) for side in (0, 1))
    assert {r.job_id: (r.chars, r.edits) for r in evaluate.cer(ref, hyp).collect()} == want


def test_long_stretches_cost_far_less_than_a_table_of_characters(spark):
    rng = random.Random(6)
    kind = "job_id long, ord long, start double, end double, text string"
    r = "".join(rng.choices("abcdefgh klmno", k=30_000))
    h = "x" + r.replace("e", "") + "y"

    def took(r, h, table):
        ref, hyp = (spark.createDataFrame([(0, 0, 0.0, 1.0, t)], kind) for t in (r, h))
        out = ref.join(hyp.select("job_id", F.col("text").alias("h")), "job_id").select(F.levenshtein("text", "h").alias("edits")) if table else evaluate.cer(ref, hyp)
        began = time.monotonic()
        edits = out.first().edits
        return edits, time.monotonic() - began

    for table in (False, True):
        took("ab", "b", table)  # code is compiled
    (edits, sec), (want, table_sec) = took(r, h, False), took(r, h, True)
    assert edits == want
    assert sec < table_sec / 2


def test_counts_of_edited_copies_equal_a_loop():
    rng = random.Random(7)
    for _ in range(500):
        r = rng.choices("abc", k=rng.randint(0, 30))
        h = list(r)
        at = rng.randint(0, len(h))
        h[at : at + rng.randint(0, 4)] = rng.choices("abc", k=rng.randint(0, 4))
        assert evaluate._edit_counts(r, h) == plain_counts(r, h)


def test_words_without_a_partner_are_insertions_or_deletions(spark):
    kind = "job_id string, segment_id string, ord long, start double, end double, text string"
    ref = spark.createDataFrame([("a", "x", 0, 0.0, 1.0, "one two"), ("b", "x", 0, 0.0, 1.0, "one")], kind)
    hyp = spark.createDataFrame([("a", "y", 0, 0.5, 1.5, "one too"), ("a", "z", 1, 9.0, 10.0, "and more"), ("c", "z", 0, 0.0, 1.0, "ghost")], kind)
    got = {r.job_id: (r.words, r.hyp_words, r.substitutions, r.deletions, r.insertions, r.wer) for r in evaluate.wer(ref, hyp).collect()}
    assert got == {"a": (2, 4, 1, 0, 2, 1.5), "b": (1, 0, 0, 1, 0, 1.0), "c": (0, 1, 0, 0, 1, 1.0)}


def plain_chapters(rows, vectors, threshold, cap, least):
    """Loops over one job's segments: pieces, units, alike neighbours, short ones."""
    pieces = []
    for r in rows:
        blank = not r[4].strip()
        if pieces and (blank or all(not x[4].strip() for x in pieces[-1])):
            pieces[-1].append(r)
        else:
            pieces.append([r])
    units = []
    for p in pieces:
        n = lambda u: sum(len(x[4].split()) for x in u)
        if units and n(units[-1]) + n(p) <= 80 and (units[-1][-1][3] == p[0][3] or p[0][5] - units[-1][-1][6] <= 2.0):
            units[-1] += p
        else:
            units.append(list(p))
    kept = [(u, np.array(vectors[i]), max(1, sum(len(x[4].split()) for x in u))) for i, u in enumerate(units) if any(x[4].strip() for x in u)]
    merged = []
    for u, v, w in kept:
        if merged and (c := merged[-1])[1] @ v / (np.linalg.norm(c[1]) * np.linalg.norm(v)) >= threshold and u[-1][6] - c[0][0][5] <= cap:
            merged[-1] = (c[0] + u, (c[1] * c[2] + v * w) / (c[2] + w), c[2] + w)
        else:
            merged.append((u, v, w))
    out = []
    for u, *_ in merged:
        if out and (u[-1][6] - u[0][5] < least or len(out) == 1 and out[0][-1][6] - out[0][0][5] < least):
            out[-1] = out[-1] + u
        else:
            out.append(u)
    return [(u[0][5], u[-1][6], [x[2] for x in u], list(dict.fromkeys(x[3] for x in u))) for u in out]


def test_build_chapters_equals_plain_loops(spark):
    rng, norm = random.Random(7), np.random.default_rng(7)
    rows, vectors = [], []
    for job in range(12):
        at = 0.0
        for i in range(25):
            at += rng.choice([0.5, 1.0, 4.0])
            n = rng.choice([0, 0, 3, 10, 30])
            rows.append((job, i, f"s{i:04d}", rng.choice("AB"), " ".join(["w"] * n), at, at + 0.5 + n / 4))
            at = rows[-1][6]
        vectors += [(job, u, norm.normal(size=3).tolist()) for u in range(25)]
    kind = "job_id long, ord long, segment_id string, speaker string, text string, start double, end double"
    got = chapters.build_chapters(spark.createDataFrame(rows, kind), spark.createDataFrame(vectors, "job_id long, unit long, vector array<double>"), threshold=0.0, cap=60.0, least=6.0).orderBy("job_id", "ord").collect()
    for job in range(12):
        want = plain_chapters([r for r in rows if r[0] == job], {u: v for j, u, v in vectors if j == job}, 0.0, 60.0, 6.0)
        assert [(r.start, r.end, list(r.source_ids), list(r.speakers)) for r in got if r.job_id == job] == want
        assert [r.chapter_id for r in got if r.job_id == job] == [f"C{i:02d}" for i in range(len(want))]


def test_thresholds_are_a_table(spark):
    rows = {r.check_id: r for r in gates.thresholds(spark).collect()}
    assert (rows["G2.2"].low, rows["G2.2"].high, rows["G2.2"].warn_low, rows["G2.2"].warn_high) == (0.4, 0.8, 0.3, 1.0) and rows["G3.6"].high == 12 and not math.isnan(rows["G1.1"].low)
