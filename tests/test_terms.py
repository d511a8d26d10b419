"""Term suggestions against all pairs of words and terms."""

import random

import pytest

from meetspark.operators import edits as I


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("least", "few"), [(0.6, 20_000), (0.6, 5), (0.75, 20_000), (0.5, 3)])
def test_similar_words_equal_all_pairs(spark, least, few):
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 16))) for _ in range(25)]

    def bent(w):
        w = list(w)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "x", "é"])
        return "".join(w)

    words = [bent(rng.choice(base)) for _ in range(120)] + base[:5] + ["short", ""]
    got = {(r.found, r.term): (r.far, r.confidence) for r in I.similar_words(spark.createDataFrame([(w,) for w in words + words[:9]], "found string"), spark.createDataFrame([(t,) for t in base + base[:3] + ["tiny"]], "term string"), least, few_terms=few).collect()}
    want = {}
    for w in {w for w in words if len(w) >= 6}:
        for t in base:
            d, longer = edits(w, t), max(len(w), len(t))
            if d <= (1 - least) * longer + 1e-9:
                want[w, t] = (d, round(1 - d / longer, 6))
    assert got == want and len(want) > 50


def test_suggestions_have_places_and_times(spark):
    s = spark.createDataFrame([("j", "s1", "Ask Kubernets, kubernets; and KUBERNETES!", 1.0, 2.0), ("j", "s2", None, 2.0, 3.0), ("k", "s1", "", 0.0, 1.0), ("k", "s2", "xx postgress", 1.0, 4.0)], "job_id string, segment_id string, text string, start double, end double")
    found = I.suggest_terms(s, spark.createDataFrame([("kubernetes",), ("postgres",), ("kubernetas",)], "term string")).orderBy("job_id", "from").collect()
    assert [tuple(r) for r in found] == [("j", "s1", 4, 13, "kubernets", "kubernetas", 0.9, 1.0, 2.0), ("j", "s1", 15, 24, "kubernets", "kubernetas", 0.9, 1.0, 2.0), ("k", "s2", 3, 12, "postgress", "postgres", pytest.approx(8 / 9, abs=1e-6), 1.0, 4.0)]
