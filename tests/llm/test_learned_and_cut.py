"""Centroid clustering, subword quality and fill-in-the-middle against plain loops and on awkward tables."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from meetspark.llm import centroids, fill_in_middle, subword_quality
from meetspark.llm.words import blocks

from .test_llm import NASTY, clashing, docs

VEC = "vec_id long, embedding array<double>, label int"


def plain_clusters(rows, k, rounds, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(b"1:" + (b"" if r[0] is None else str(r[0]).encode())).hexdigest(), r[1])
    means = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m, strict=True))
    nearest = lambda v: min((far(v, m), c) for c, m in enumerate(means))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for c, vs in groups.items():
            means[c] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    within = collections.Counter()
    for _, c, d in out:
        within[c] += d
    return collections.Counter((i, c, d, within[c], sum(within.values()), tuple(means[c])) for i, c, d in out)


def random_vectors(seed, n=180):
    rng = random.Random(seed)
    base = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    return [(i * 7, [x + rng.gauss(0, 0.2) for x in rng.choice(base)]) for i in range(n)]


@pytest.mark.parametrize(("k", "width", "group"), [(16, 2, 16_384), (5, 4, 40), (3, 1, 1)])
def test_clusters_equal_plain_loop(spark, k, width, group):
    v = random_vectors(k)
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [float("nan")] + [0.0] * 63), (6, [float("inf")] + [0.0] * 63), (8, [None] + [0.0] * 63), (None, [0.5] * 64), (7, [0.25] * 64), (7, [-0.25] * 64), (0, v[0][1]), (0, v[0][1]), (9, [2.0**21, -(2.0**21)] + [0.0] * 62)]
    rows = v + odd
    df = clashing(spark.createDataFrame([(i, x, 0) for i, x in rows], VEC).repartition(3)).selectExpr("*", "1 AS units", "2 AS cluster", "3 AS distance", "4 AS ids", "5 AS entries")
    got = collections.Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in centroids.cluster(df, k=k, width=width, group_rows=group).collect())
    assert got == plain_clusters(rows, k, 3)


def test_clusters_of_few_equal_huge_and_no_vectors(spark):
    same = [(i, [0.1] * 64) for i in range(20)]
    got = centroids.cluster(spark.createDataFrame([(i, x, 0) for i, x in same], VEC)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 20
    few = [(1, [1.0] * 64), (2, [-1.0] * 64)]
    got = centroids.cluster(spark.createDataFrame([(i, x, 0) for i, x in few], VEC)).collect()
    assert sorted(r.cluster for r in got) == [0, 1]
    huge = [(i, [(-1.0) ** i * 1e300] * 64) for i in range(40)] + [(50, [0.0] * 64)]
    got = centroids.cluster(spark.createDataFrame([(i, x, 0) for i, x in huge], VEC), k=1).collect()
    assert len(got) == 41 and {r.inertia for r in got} == {(1 << 63) - 1} and min(r.distance for r in got) >= 0
    assert centroids.cluster(spark.createDataFrame([], VEC)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None, 0)], VEC)).collect() == []


def test_dictionary_is_lossless():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 5):
        block = rng.integers(-3, 3, (500, width)).astype(np.int32)
        block[0] = centroids.LIMIT
        block[1] = -centroids.LIMIT
        entries, codes = centroids.dictionary(block)
        assert (entries[codes] == block).all() and len({tuple(e) for e in entries}) == len(entries)


ODD = NASTY + [(20, "a<P>b"), (21, "<S"), (22, "P><M"), (23, "日本語" * 30_000), (24, "é" * 5), (25, "𝄞a" * 9), (26, "ab" * 70_000 + "é" * 40_000 + "日x" * 9_000), (27, "<P"), (28, "<M>"), (29, "́" * 3)]


def test_fill_in_middle_equals_plain_loop(spark):
    rng = random.Random(5)
    rows = ODD + [(100 + i, "".join(rng.choice(["a", "é", "日", "𝄞", "<", "P>", "\n", " "]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    found = fill_in_middle.fill_in_middle(clashing(docs(spark, rows)).selectExpr("*", "1 AS digest", "2 AS h1", "3 AS output", "4 AS form"))
    got = collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in found.withColumn("back", fill_in_middle.restored()).collect())
    want = collections.Counter()
    for i, t in rows:
        t, h = t or "", hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want[i, len(t), "plain", None, None, t, t] += 1
        elif h4 % 100 < 20:
            want[i, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}", t] += 1
        else:
            want[i, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}", t] += 1
    assert got == want and {w[2] for w in want} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(docs(spark, [])).collect() == []


@pytest.mark.parametrize("kind", ["ascii", "wide", "sparse", "mixed", "empty", "ragged"])
def test_boundary_set_selects_and_ranks(kind):
    rng = np.random.default_rng(2)
    texts = {"ascii": "abc" * 70_000, "wide": "日本" * 50_000, "sparse": "𝄞" * 60_000, "mixed": "".join(rng.choice(list("aé日𝄞"), 90_000)), "empty": "", "ragged": "日" + "a" * 65_532 + "éa" * 30_000}
    data = texts[kind].encode()
    want = [i for i, b in enumerate(data) if b & 0xC0 != 0x80]
    places = fill_in_middle.BoundarySet(np.frombuffer(data, np.uint8))
    k = np.unique(np.concatenate([rng.integers(0, len(want) + 1, 500), [0, len(want)]]))
    assert places.select(k).tolist() == [want[i] if i < len(want) else len(data) for i in k]
    x = np.unique(np.concatenate([rng.integers(0, len(data) + 1, 500), [0, len(data)], np.arange(65_500, 65_600)]))
    x = x[x <= len(data)]
    assert places.rank(x).tolist() == np.searchsorted(want, x).tolist()


def test_boundary_set_uses_all_containers():
    kinds = [type(fill_in_middle.BoundarySet(np.frombuffer(t.encode(), np.uint8)).containers[0]).__name__ for t in ("a" * 70_000, "日" * 30_000, "é" * 500)]
    assert kinds == ["_Runs", "_Bitmap", "_Array"]


def good_and_bad(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 90))]
        kind = i % 6
        text = " ".join(w) + "." if kind < 3 else " ".join(x.upper() + "!!" for x in w) if kind == 3 else " ".join(f"{x} {x} {x}" for x in w) if kind == 4 else " ".join(x + "###" for x in w)
        rows.append((i, text))
        labels.append((i, int(kind < 3), 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_subword_quality_learns_from_other_folds_only(spark):
    rows, labels = good_and_bad(400)
    # rows of the held-out fold carry wrong labels, which must not change a score
    fold = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _ in rows}
    wrong = [(i, 1 - q if fold[i] else q, t) for i, q, t in labels]
    right, other = ({r.doc_id: r for r in subword_quality.subword_quality(docs(spark, rows), spark.createDataFrame(x, LABELS)).collect()} for x in (labels, wrong))
    assert right == other
    held = [(right[i].predicted, q) for i, q, _ in labels if fold[i]]
    assert len(held) > 90 and sum(p == q for p, q in held) >= 0.98 * len(held)
    assert all(r.held_out == fold[r.doc_id] and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in right.values())


def test_subword_quality_scores_equal_plain_means():
    rows, labels = good_and_bad(60)
    model = subword_quality.train([t for _, t in rows], np.array([q for _, q, _ in labels]))
    texts = [t for _, t in rows[:20]] + ["", "one", "日本語" * 5_000, "a" * 70_000 + " b b b", "x\ny y", *(t or "" for _, t in NASTY)]
    want = [float(share @ model.line[bucket]) + model.bias for bucket, share in subword_quality.bags(texts)]
    import pyarrow as pa

    got = np.concatenate([model.block(b) for b in blocks(pa.array(texts))])
    assert np.allclose(got, want, atol=1e-3)
    again = np.concatenate([model.block(b) for b in blocks(pa.array(texts))])  # from the words already known
    assert np.allclose(got, again)


def test_subword_quality_features_by_hand():
    bucket = lambda words: sorted(subword_quality.grams(words)[0].tolist())
    assert len(bucket(["ab"])) == 3  # <ab, ab>, <ab>
    assert bucket(["ab", "cd"]) == sorted(bucket(["ab"]) + bucket(["cd"]))
    (rep, share), (other, _) = subword_quality.bags(["q q", "q r"])
    assert 0 in rep and 0 not in other and abs(share.sum() - 1) < 1e-6


def test_subword_quality_awkward_rows(spark):
    labels = [(6, 1, 0), (7, 0, 0), (4, 1, 0), (2, 0, 0), (None, 1, 1), (5, None, 0), (8, 2, 0), (10, 0, 1), (10, 1, 1), (99, 0, 0)]
    found = subword_quality.subword_quality(clashing(docs(spark)), clashing(spark.createDataFrame(labels, LABELS))).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(i for i, _ in NASTY)
    assert all(0 <= r.score <= 1 for r in found) and not next(r for r in found if r.doc_id is None).held_out
    one = subword_quality.subword_quality(docs(spark), spark.createDataFrame([(i, 0, 0) for i in range(4, 11)], LABELS)).collect()
    assert {r.predicted for r in one} == {0}
    assert {r.predicted for r in subword_quality.subword_quality(docs(spark), spark.createDataFrame([], LABELS)).collect()} == {1}
    assert subword_quality.subword_quality(docs(spark, []), spark.createDataFrame(labels, LABELS)).collect() == []
